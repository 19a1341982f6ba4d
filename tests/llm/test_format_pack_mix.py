"""Packing and mixing: exact round trips and invariants; the pipeline."""
import random
import zlib
from array import array
from collections import defaultdict

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from lexigraph.llm import chat_format, packing, source_mix
from lexigraph.llm.queries import QUERIES

from .data import awkward_documents

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def reference_ids(text):
    t = Tokenizer.from_file(VOCABULARY)
    return t.encode(text, add_special_tokens=False).ids


def test_both_libraries_give_the_same_ids():
    enc = packing.Encoder(VOCABULARY)
    assert enc.fast is not None
    rng = random.Random(1)
    alphabet = " \n\t\r\x0b  \x85\x1cabé's'll12!.,<|endoftext|>日本\U0001f600"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(800)]
    texts += [" " * 5_000 + "a", "a \n" * 3_000, "<|endoftext|>", "ab" * 20_000]
    t = Tokenizer.from_file(VOCABULARY)
    for x in texts:
        assert enc.encode(x) == array("I", t.encode(x, add_special_tokens=False).ids).tobytes(), x[:50]


def test_packing_of_awkward_rows(spark, awkward):
    rows = awkward_documents()
    docs = spark.read.parquet(awkward + "/documents.parquet")
    got = packing.pack_documents(docs, docs_per_shard=20, with_ids=True).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        assert 1 <= r["length"] <= 1024 and r["ids_crc32"] == zlib.crc32(array("I", r["ids"]).tobytes())
        pieces[r["doc_id"]].append((r["doc_tokens"], r["start"], list(r["ids"])))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 1024
    want = defaultdict(list)
    for i, t, *_ in rows:
        ids = reference_ids(t or "") + [0]
        want[i] += [(len(ids), k, ids[k : k + 1024]) for k in range(0, len(ids), 1024)]
    assert {i: sorted(p) for i, p in pieces.items()} == {i: sorted(p) for i, p in want.items()}


def test_best_fit_is_tightest():
    rng = random.Random(2)
    lengths = sorted((rng.randint(1, 63) for _ in range(400)), reverse=True)
    where, offset, used = packing.best_fit(lengths, 64)
    room, opened = {}, 0
    for n, w, o in zip(lengths, where, offset):
        fits = [c for c in room.values() if c >= n]
        if fits:
            assert room[w] == min(fits) and o == 64 - room[w]
            room[w] -= n
        else:
            assert w == opened and o == 0
            room[w] = 64 - n
            opened += 1
    assert used == opened and 9 * used <= 11 * -(-sum(lengths) // 64) + 9 * 4  # known bound of the method


def test_padding_is_little(spark):
    got = QUERIES["op9_packing"](spark, "/root/testdata/sf0.01")
    total = got.groupBy("sequence_id").sum("length").collect()
    assert sum(r[1] for r in total) > 0.98 * 1024 * len(total)


def test_mix_keeps_targets_and_bounds(spark):
    got = QUERIES["op5_source_mix"](spark, "/root/testdata/sf0.01").toPandas()
    again = QUERIES["op5_source_mix"](spark, "/root/testdata/sf0.01").toPandas()
    src = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "source").toPandas()
    assert got.sort_values("doc_id").taken.tolist() == again.sort_values("doc_id").taken.tolist()
    assert (got.taken <= 2 * got["size"]).all()
    m = got.merge(src, on="doc_id").groupby("source").agg(taken=("taken", "sum"), target=("target", "first"), size=("source_size", "first"), largest=("size", "max"))
    assert ((m.taken - m.target).abs() <= 2 * m.largest).all()
    assert abs(m.target.sum() - 1.5 * m["size"].sum()) < 1 and (m.target <= 2 * m["size"] + 1e-6).all()


def test_applied_mix_repeats_rows(spark, awkward):
    docs = spark.read.parquet(awkward + "/documents.parquet")
    said = {}
    for r in source_mix.mix_sources(docs).collect():
        said[r["doc_id"], r["source"], r["size"]] = said.get((r["doc_id"], r["source"], r["size"]), 0) + r["copies"]
    out = source_mix.apply_mix(docs)
    assert out.columns == docs.columns
    rows = out.collect()
    assert len(rows) == sum(v for v in said.values())
    assert {(r["doc_id"], r["source"]) for r in rows} == {k[:2] for k, v in said.items() if v}


def test_chat_reads_back_exactly(spark, awkward):
    turns = spark.read.parquet(awkward + "/conversations.parquet")
    out = chat_format.format_chats(turns)
    back = {r["conv_id"]: r for r in chat_format.read_chats(out).collect()}
    rows = defaultdict(list)
    for r in turns.collect():
        rows[r["conv_id"]].append((r["turn"] is not None, r["turn"] or 0, r["role"] or "", r["text"] or ""))
    for i, t in rows.items():
        want = [x[2:] for x in sorted(t)]
        assert [(x["role"], x["text"]) for x in back[i]["turns"]] == want
        assert back[i]["loss_texts"] == [x for role, x in want if role == "assistant" and x]
    assert back[1]["n_blocks"] == 4


def brute_pipeline_invariants(spark, folder):
    docs = spark.read.parquet(folder + "/documents.parquet")
    columns, kept = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder).persist()
        kept.append((name, docs.count()))
        if name != "packing":
            assert docs.columns == columns
            yield name, docs
    yield "packing", docs


def test_pipeline_stage_by_stage(spark, awkward):
    rows = awkward_documents()
    stages = dict(brute_pipeline_invariants(spark, awkward))
    first = [r["doc_id"] for r in stages["language_id"].collect()]
    assert not {0, 1, 2, 4} & set(first) and {10, 11, 13, 20} <= set(first)
    lines = {r["doc_id"]: r for r in stages["line_dedup"].collect()}
    assert 11 not in lines and lines[10]["text"] == dict((r[0], r[1]) for r in rows)[10]
    assert all(r["n_chars"] == len(r["text"]) and r["kept"] == "clash" for r in lines.values())
    near = [r["doc_id"] for r in stages["near_dedup"].collect()]
    assert len(near) == len([i for i in near if i is None]) + len(set(near) - {None})
    mixed = stages["source_mix"].collect()
    texts = {r["doc_id"]: r["text"] for r in stages["near_dedup"].collect()}
    assert all(texts[r["doc_id"]] == r["text"] for r in mixed)
    pieces = stages["packing"].collect()
    want, got = defaultdict(int), defaultdict(int)
    for r in mixed:
        want[r["doc_id"]] += len(reference_ids(r["text"])) + 1
    for r in pieces:
        got[r["doc_id"]] += r["length"]
    assert got == want


def test_pipeline_runs_whole(spark, empty):
    assert corpus_pipeline.run(spark, empty).count() == 0
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 100
