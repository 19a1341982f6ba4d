"""Small tables with the awkward cases, written as the queries read them."""
import os
import random

import pyarrow as pa
import pyarrow.parquet as pq

#: Names that operators use inside; as columns of the input they must not matter.
CLASHES = ("size", "copies", "h", "mark", "_text", "score", "sig", "key", "kept", "bucket", "n_words", "ids", "class_id", "line", "near", "gone", "part", "copy", "_row", "lang_pred")


def words(rng, n, vocabulary=400):
    return " ".join(f"{'abcdefghij'[i % 10]}{i}" for i in (int(vocabulary * rng.random() ** 2) for _ in range(n)))


def text_lines(rng, n):
    return "\n".join(words(rng, rng.randint(4, 30), 5_000) + "." for _ in range(n))


def awkward_documents():
    """(doc_id, text, lang, source) rows."""
    rng = random.Random(3)
    passage = words(rng, 80, 9_000)
    base = text_lines(rng, 12)
    rows = [
        (0, None, "en", "a"), (1, "", "en", "a"), (2, " \n\t \r ", "de", None), (3, "word", None, "b"), (4, "1234 !? 5", "de", "b"),
        (10, base, "en", "a"), (11, base, "en", "a"), (11, base, "en", "a"), (12, base.replace("a1 ", "zz ", 1) + " tail", "en", "b"),
        (13, text_lines(rng, 2) + "\n" + passage + "\n" + text_lines(rng, 3), "de", "b"), (14, passage + " and more " + words(rng, 30), "de", "c"),
        (15, words(rng, 20) + " " + passage, None, None), (16, "x y z w v " * 30, "en", "c"), (17, "# $ % " * 20 + words(rng, 12), "en", "c"),
        (20, words(rng, 40_000, 30_000), "en", "a"), (21, "y" * 50_000, "en", "b"), (22, "été à l’œuvre " * 40 + "日本語 😀 <|endoftext|>", "fr", "c"),
        (30, "one line of some thirty letters\nanother line of forty letters and more", "en", "a"),
        (31, "one line of some thirty lettArs\nanother line of forty letters and mor", "en", "a"),
        (32, "one line of some thirty letters!\nshort\nshort\nShort", "en", "a"), (33, "\n\n  \nshort", "en", "a"),
        (34, "one line of some thirty letters", "en", "a"), (None, "a row without an id " + passage, "en", "a"), (None, None, None, None), (-5, words(rng, 60), "de", "a"),
    ]
    rows += [(100 + i, words(rng, rng.randint(1, 300)), ("en", "de")[i % 2], ("a", "b", "c", "dé")[i % 4]) for i in range(40)]
    return rows


def write_documents(folder, rows, extra=True):
    os.makedirs(folder, exist_ok=True)
    cols = dict(zip(("doc_id", "text", "lang", "source"), zip(*rows) if rows else [[]] * 4))
    table = {"doc_id": pa.array(cols["doc_id"], pa.int64()), **{c: pa.array(cols[c], pa.string()) for c in ("text", "lang", "source")}}
    table["n_chars"] = pa.array([None if t is None else len(t) for t in cols["text"]], pa.int64())
    if extra:
        table |= {c: pa.array(["clash"] * len(rows), pa.string()) for c in CLASHES}
    pq.write_table(pa.table(table), f"{folder}/documents.parquet")
    labels = {"doc_id": pa.array([r[0] for r in rows], pa.int64()), "quality": pa.array([None if i % 7 == 0 else int(i % 5 > 0) for i in range(len(rows))], pa.int64()),
              "toxic": pa.array([None if i % 11 == 0 else int(i % 9 == 0) for i in range(len(rows))], pa.int64())}
    pq.write_table(pa.table(labels), f"{folder}/labels.parquet")
    rng = random.Random(9)
    vectors = [(i, [rng.gauss(0, 1) for _ in range(16)], i % 3) for i in range(0, 240 if rows else 0, 2)]
    write_embeddings(folder, vectors + ([(301, None, 1), (303, [float("nan")] * 16, 2), (305, [0.5] * 16, None)] if rows else []))
    return str(folder)


def write_embeddings(folder, rows):
    cols = list(zip(*rows)) if rows else [[]] * 3
    table = {"vec_id": pa.array(cols[0], pa.int64()), "embedding": pa.array(cols[1], pa.list_(pa.float32())), "label": pa.array(cols[2], pa.int32())}
    table |= {c: pa.array(["clash"] * len(rows), pa.string()) for c in (*CLASHES, "vector", "dim", "place", "error")}
    pq.write_table(pa.table(table), f"{folder}/embeddings.parquet")
    return str(folder)


def write_conversations(folder, rows):
    os.makedirs(folder, exist_ok=True)
    cols = list(zip(*rows)) if rows else [[]] * 4
    pq.write_table(pa.table({"conv_id": pa.array(cols[0], pa.int64()), "turn": pa.array(cols[1], pa.int64()), "role": pa.array(cols[2], pa.string()),
                             "text": pa.array(cols[3], pa.string()), "s": pa.array(["clash"] * len(rows), pa.string()), "blocks": pa.array(["clash"] * len(rows), pa.string())}),
                   f"{folder}/conversations.parquet")
    return str(folder)
