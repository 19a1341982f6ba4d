"""Near-duplicates, substrings and lines against brute force."""
import hashlib
import re
from collections import Counter

import numpy as np
import pytest

from lexigraph.llm import line_dedup, prob_minhash, substring_dedup
from lexigraph.llm.queries import QUERIES

from .data import awkward_documents

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def split(text):
    return [w for w in SPACE.split(text or "") if w]


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# -- near-duplicates --------------------------------------------------------

def brute_jp(a, b):
    """Probability Jaccard from its definition."""
    w = {k: 1 + np.log(v) for k, v in a.items()}
    v = {k: 1 + np.log(x) for k, x in b.items()}
    every = set(w) | set(v)
    total = 0.0
    for d in set(w) & set(v):
        total += 1 / sum(max(w.get(e, 0) / w[d], v.get(e, 0) / v[d]) for e in every)
    return total


def shingle_counts(text):
    w = split(text)
    if not w:
        return Counter()
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or Counter([tuple(w)])


def test_probability_jaccard_is_its_definition():
    texts = [b"a b c d e f g h a b c d e f g", b"a b c d e f g h i j", b"a b c", b"x y z u v w"]
    d, s, c, _, _ = prob_minhash.shingles(texts)
    own = [(s[d == i], c[d == i]) for i in range(4)]
    for i in range(4):
        for j in range(4):
            a, b = shingle_counts(texts[i].decode()), shingle_counts(texts[j].decode())
            jp, plain = prob_minhash.probability_jaccard(own[i], own[j])
            assert abs(jp - brute_jp(a, b)) < 1e-12
            assert abs(plain - len(set(a) & set(b)) / len(set(a) | set(b))) < 1e-12


def test_registers_estimate_probability_jaccard():
    rng = np.random.RandomState(0)
    items = rng.randint(1, 2**62, 300).astype(np.uint64)
    a, b = np.arange(0, 200), np.arange(60, 300)
    weight = 1 + rng.randint(0, 3, 300)
    doc = np.repeat([0, 1], [len(a), len(b)])
    m = 4096
    reg = prob_minhash.prob_minhash(doc, np.concatenate([items[a], items[b]]), np.concatenate([weight[a], weight[b]]).astype(float), 2, m)
    w, v = np.zeros(300), np.zeros(300)
    w[a], v[b] = weight[a], weight[b]
    true = sum(1 / np.maximum(w / w[d], v / v[d]).sum() for d in set(a) & set(b))
    assert abs((reg[0] == reg[1]).mean() - true) < 4 * np.sqrt(true * (1 - true) / m)


def test_registers_do_not_depend_on_the_batch():
    rng = np.random.RandomState(1)
    items, weight = rng.randint(1, 2**62, 50).astype(np.uint64), rng.rand(50) + 0.5
    alone = prob_minhash.prob_minhash(np.zeros(50, dtype=np.int64), items, weight, 1)
    both = prob_minhash.prob_minhash(np.repeat([0, 1], [1, 50]), np.concatenate([items[:1], items]), np.concatenate([weight[:1], weight]), 2)
    assert (alone[0] == both[1]).all()


def brute_classes(rows):
    """Smallest id of the component of each id, by all pairs."""
    ids = sorted({r[0] for r in rows if r[0] is not None})
    sets = [(r[0], shingle_counts(r[1])) for r in rows if r[0] is not None]
    lead = {i: i for i in ids}

    def find(x):
        while lead[x] != x:
            x = lead[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and (len(set(x) & set(y)) / len(set(x) | set(y)) >= 0.8 or (set(x) & set(y) and len(x) < 2000 and brute_jp(x, y) >= 0.8)):
                p, q = find(a), find(b)
                lead[max(p, q)] = min(p, q)
    return {i: find(i) for i in ids}


def test_near_duplicate_classes(spark, awkward):
    rows = awkward_documents()
    got = QUERIES["op3_prob_minhash"](spark, awkward).collect()
    assert len(got) == len(rows)
    want = brute_classes(rows)
    for r in got:
        if r["doc_id"] is not None:
            assert r["class_id"] == want[r["doc_id"]], r
    assert want[12] == want[11] == 10


def test_chains_and_blocks_of_near_duplicates(spark):
    """A chain whose ends differ, and many items in one bucket that do not
    hang together, found block by block."""
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(12):
        words = list(base)
        for j in range(i):
            words[5 * j % 60 + 2] = f"x{j}"
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in prob_minhash.near_duplicates(df, similarity=0.8, block=2).collect()}
    assert got == brute_classes([(i, t) for i, t in rows])


def test_one_link_among_many_just_below(spark):
    """A text that links to one member of a component, while two dozen others
    sit just below: ranked by estimate, the one is often far down."""
    texts = {}
    for g in range(8):
        def variant(places):
            return [f"g{g}x{j // 5}" if j % 5 == 2 and j // 5 in places else f"g{g}w{j}" for j in range(1_000)]  # noqa: B023

        chain = [set(range(10 + 6 * i, 29 + 6 * i)) for i in range(25)]
        odd = {0, 1, 2, 3}
        for i, places in enumerate([*chain, chain[12] | {0}, odd]):
            texts[100 * g + i] = " ".join(variant(places))
    rows = list(texts.items())
    one = {i: set(shingle_counts(t)) for i, t in rows if i < 100}
    near = [i for i in range(26) if len(one[i] & one[26]) / len(one[i] | one[26]) >= 0.8]
    assert near == [25] and len(one[0] & one[26]) / len(one[0] | one[26]) > 0.79
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in prob_minhash.near_duplicates(df).collect()}
    assert got == {i: i // 100 * 100 for i in texts}


def test_plain_links_of_low_probability_jaccard(spark):
    """Texts and the same with a passage many times over: plain Jaccard 0.85,
    probability Jaccard below 0.6."""
    rows = []
    for g in range(12):
        text, passage = [f"g{g}w{j}" for j in range(200)], [f"g{g}p{j}" for j in range(30)]
        rows += [(2 * g, " ".join(text)), (2 * g + 1, " ".join(text + 30 * passage))]
    d, s, c, _, _ = prob_minhash.shingles([t.encode() for _, t in rows[:2]])
    jp, plain = prob_minhash.probability_jaccard((s[d == 0], c[d == 0]), (s[d == 1], c[d == 1]))
    assert jp < 0.6 and plain > 0.84
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in prob_minhash.near_duplicates(df).collect()}
    assert got == {i: i // 2 * 2 for i, _ in rows}


def test_first_of_each_keeps_one_row(spark, awkward):
    docs = spark.read.parquet(awkward + "/documents.parquet")
    kept = [r["doc_id"] for r in prob_minhash.first_of_each(docs).collect()]
    assert kept.count(10) == 1 and 11 not in kept and 12 not in kept and kept.count(None) == 2
    assert {0, 1, 2, 3, 4, 13, 16, 17, 20, 21} <= set(kept)


# -- substrings -------------------------------------------------------------

def brute_substrings(rows, k):
    first = {}
    for i, text in rows:
        w = split(text)
        for a in range(len(w) - k + 1):
            key = tuple(w[a : a + k])
            if i is not None:
                first[key] = min(first.get(key, i), i)
    out = []
    for i, text in rows:
        w = split(text)
        gone = set()
        for a in range(len(w) - k + 1):
            if i is not None and first[tuple(w[a : a + k])] < i:
                gone.update(range(a, a + k))
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_substrings_on_awkward_rows(spark, awkward):
    got = rows_of(QUERIES["op7_substring_dedup"](spark, awkward))
    want = brute_substrings([r[:2] for r in awkward_documents()], 50)
    assert got == want
    assert sum(r[2] for r in got) > 300


def test_hot_buckets_travel_singly_with_the_same_result(spark, awkward):
    docs = spark.read.parquet(awkward + "/documents.parquet")
    rows = [r[:2] for r in awkward_documents()]
    for hot in (0, 3):
        got = rows_of(substring_dedup.remove_repeats(docs, k=12, m=4, hot=hot, with_text=False))
        assert got == brute_substrings(rows, 12)


def test_minimisers_of_equal_windows_are_equal():
    text = b" ".join(b"w%d" % (i * i % 97) for i in range(400))
    words = text.split()
    d, start, n, mh, _, _ = substring_dedup.super_kmers([text, b"x y " + text], 20, 5)
    by = [{}, {}]
    for t, s, c, x in zip(d, start, n, mh):
        for w in range(s, s + c):
            by[t][w] = x
    assert len(by[0]) == len(words) - 19
    assert all(by[1][w + 2] == x for w, x in by[0].items())


# -- lines ------------------------------------------------------------------

def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def brute_lines(rows, edits=1, least=0):
    first = {}
    for i, text in sorted((r for r in rows if r[0] is not None and r[1] is not None)):
        for n, line in enumerate(text.split("\n")):
            if split(line):
                first[line] = min(first.get(line, (i, n)), (i, n))
    near = {a for a in first for b in first if len(a) >= least and len(b) >= least and abs(len(a) - len(b)) <= edits and first[b] < first[a] and distance(a, b) <= edits}
    out = []
    for i, text in rows:
        lines = [] if text is None else text.split("\n")
        keep = [x for n, x in enumerate(lines) if i is None or not split(x) or (first[x] == (i, n) and x not in near)]
        out.append((i, len(lines), len(lines) - len(keep), hashlib.sha256("\n".join(keep).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_lines_on_awkward_rows(spark, awkward):
    got = rows_of(QUERIES["op10_line_dedup"](spark, awkward))
    assert got == brute_lines([r[:2] for r in awkward_documents()])
    by = {r[0]: r[2] for r in got}
    # "Short" is one edit from "short": lines of any length count
    assert by[31] == 2 and by[32] == 3 and by[33] == 1 and by[34] == 1


def test_every_kind_of_edit(spark):
    rng = np.random.RandomState(5)
    base = ["".join(rng.choice(list("abcdé😀 "), 30)) for _ in range(20)]
    rows = [(i, s) for i, s in enumerate(base)]
    for i, s in enumerate(base):
        for j in range(6):
            at = rng.randint(0, 30)
            edit = (s[:at] + s[at + 1 :], s[:at] + "Z" + s[at + 1 :], s[:at] + "Y" + s[at:])[j % 3]
            rows.append((int(rng.randint(0, 10_000)) * 100 + 10 * i + j + 50, edit + ("\n" + edit[::-1] if j > 3 else "")))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = line_dedup.remove_lines(df).select("doc_id", "n_lines", "n_removed", "kept_sha256")
    assert rows_of(got) == brute_lines(rows)


@pytest.mark.parametrize("edits", [1, 2])
def test_short_lines_of_few_letters(spark, edits):
    rng = np.random.RandomState(edits)
    words = ["".join(rng.choice(list("abc"), rng.randint(1, 5 + 8 * (i % 2)))) for i in range(160)]
    rows = [(i, "\n".join(words[4 * i : 4 * i + 4])) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = line_dedup.remove_lines(df, edits=edits).select("doc_id", "n_lines", "n_removed", "kept_sha256")
    assert rows_of(got) == brute_lines(rows, edits)


def test_every_kind_of_two_edits(spark):
    rng = np.random.RandomState(9)
    base = ["".join(rng.choice(list("abcdefghijklé😀 "), 40)) for _ in range(12)]
    rows = list(enumerate(base))
    for i, s in enumerate(base):
        for j in range(27):
            t, places = s, sorted(rng.choice(40, 2 + (j > 17), replace=False))[::-1]
            for at, kind in zip(places, (j % 3, j // 3 % 3, 1)):
                t = (t[:at] + t[at + 1 :], t[:at] + "Z" + t[at + 1 :], t[:at] + "Y" + t[at:])[kind]
            rows.append((1_000 * (j + 1) + i, t))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = line_dedup.remove_lines(df, edits=2).select("doc_id", "n_lines", "n_removed", "kept_sha256")
    assert rows_of(got) == brute_lines(rows, 2)
    assert sum(r[2] for r in rows_of(got)) >= 18 * len(base)


def test_lines_only_equal_below_a_length(spark):
    rows = [(1, "abcd"), (2, "abce\nabcdefgh"), (3, "abcdefgi\nabcd")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = line_dedup.remove_lines(df, least=8).select("doc_id", "n_lines", "n_removed", "kept_sha256")
    assert rows_of(got) == brute_lines(rows, least=8)


def test_keys_of_a_long_line_come_in_parts(spark):
    for cut, opened in ((0, 2), (2, 0), (1, 1)):
        sums = line_dedup.prefix_sums(np.arange(1, 1_501, dtype=np.uint64))
        parts = list(line_dedup._gaps(sums, (500, 1_500, 500, 1_500), cut, opened))
        assert max(map(len, parts)) <= line_dedup._AT_ONCE
        assert sum(map(len, parts)) == 1_000 * 999 // (1 if cut == opened else 2)


def test_long_texts_are_cut_between_lines():
    text = "\n".join(f"line {i} " + "x" * (i % 50) for i in range(2_000))
    got = [(n, text.split("\n")[n]) for g in line_dedup._pieces(["a", text, ""], limit=3_000) for i, first, part in g if i == 1 for n, _ in enumerate(part.split("\n"), first)]
    assert [n for n, _ in got] == list(range(2_000))
