"""Quality rules with adaptive thresholds.

Every document gets a few integer signals.  For each (lang, source) group,
a mergeable quantile sketch of each signal is built: a histogram whose bins
are exact below 64 and 1/32 of an octave wide above, so a quantile is off
by 1/32 at most and sketches merge by adding counts.  Merged over sources
they give the sketch of a language, and over languages that of the corpus;
a group with few documents takes its thresholds from there.

A threshold is a fence: third quartile plus ``reach`` times the spread
between the quartiles (first quartile minus as much for the lower side).
The thresholds are joined to the documents, which are filtered by them.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage
from .batches import map_arrow, row_function
from .words import SPACES, mix64, window_hashes, word_hashes

SYMBOLS = "#*$%&|<>"
#: Signals judged by fences: expression, narrowest spread, whether the lower
#: fence counts too.  Shares are in thousandths.
RULES = {
    "word_length": (lambda: F.floor(F.col("word_chars") * 100 / F.col("n_words")), 40, True),
    "symbols": (lambda: F.floor(F.col("n_symbols") * 1000 / F.col("n_words")), 25, False),
    "dup_lines": (lambda: F.floor(F.col("n_dup_lines") * 1000 / F.col("n_lines")), 100, False),
    "repeats": (lambda: F.floor(F.col("n_repeat_words") * 1000 / F.col("n_words")), 60, False),
}
_SIGNALS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def _repeat_words(texts: list[bytes], k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Per text: words, and words inside k-word windows that occur twice or
    more in the text."""
    h, at = word_hashes(texts)
    n = np.diff(at)
    win = window_hashes(h, k)
    if not len(win):
        return n, np.zeros(len(texts), dtype=np.int64)
    doc = np.repeat(np.arange(len(texts)), n)
    inside = doc[: len(win)] == doc[k - 1 :]
    key = mix64(win ^ (doc[: len(win)].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    own = np.sort(key[inside])
    twice = np.unique(own[1:][own[1:] == own[:-1]])
    if not len(twice):
        return n, np.zeros(len(texts), dtype=np.int64)
    pos = np.minimum(np.searchsorted(twice, key), len(twice) - 1)
    found = np.flatnonzero(inside & (twice[pos] == key))
    edge = np.zeros(len(h) + 1, dtype=np.int64)
    edge[:-1] += np.bincount(found, minlength=len(h))
    edge[:] -= np.bincount(found + k, minlength=len(h) + 1)
    covered = np.cumsum(edge[:-1]) > 0
    return n, np.bincount(doc[covered], minlength=len(texts)).astype(np.int64)


def _signals(texts: list[bytes]) -> dict:
    out = {k: [] for k in ("word_chars", "n_symbols", "n_lines", "n_dup_lines")}
    for raw in texts:
        t = raw.decode("utf-8", "replace")
        out["word_chars"].append(len(t) - sum(t.count(c) for c in SPACES))
        out["n_symbols"].append(sum(t.count(c) for c in SYMBOLS))
        lines = [x for x in t.split("\n") if x.strip(SPACES)]
        out["n_lines"].append(len(lines))
        out["n_dup_lines"].append(len(lines) - len(set(lines)))
    n, repeats = _repeat_words(texts)
    return out | {"n_words": n, "n_repeat_words": repeats}


def text_signals(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns plus the signals of the column ``text`` (null: empty)."""
    d = docs.select(*keep, F.col("text").cast("binary").alias("_text"))
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(s, T.LongType()) for s in _SIGNALS])
    run = row_function(lambda texts: {s: v for s, v in _signals(texts).items()}, "_text", keep)

    def ordered(batches):
        for b in run(batches):
            yield b.select([f.name for f in schema.fields])

    return map_arrow(d, ordered, schema)


def _bin(v: Column) -> Column:
    octave = F.length(F.bin(v)) - 1
    shift = octave - 5
    return F.when(v < 64, v).otherwise(shift * 32 + F.floor(v / F.pow(F.lit(2), shift))).cast("long")


def _low(b: Column) -> Column:
    shift = F.floor(b / 32) - 1
    return F.when(b < 64, b).otherwise((b - shift * 32) * F.pow(F.lit(2), shift)).cast("long")


def sketches(signals: DataFrame) -> DataFrame:
    """(lang, source, rule, bin, n): the sketches of all groups, long form."""
    rules = F.array(*[F.struct(F.lit(r).alias("rule"), e().cast("long").alias("value")) for r, (e, _, _) in RULES.items()])
    rows = signals.where(F.col("n_words") > 0).select("lang", "source", F.explode_outer(rules).alias("r"))
    return rows.select("lang", "source", "r.rule", _bin(F.col("r.value")).alias("bin")).groupBy("lang", "source", "rule", "bin").agg(F.count(F.lit(1)).alias("n"))


def fences(sketch: DataFrame, reach: int = 3, min_docs: int = 100) -> DataFrame:
    """(lang, source, rule, low, high).  A group of under ``min_docs``
    documents takes its language's fences, a small language the corpus's."""
    def quartiles(d: DataFrame, by: list[str]) -> DataFrame:
        own = Window.partitionBy(*by, "rule")
        d = d.groupBy(*by, "rule", "bin").agg(F.sum("n").alias("n"))
        d = d.withColumn("upto", F.sum("n").over(own.orderBy("bin"))).withColumn("all", F.sum("n").over(own))
        at = lambda q: F.min(F.when(F.col("upto") * 4 >= F.col("all") * q, F.col("bin")))
        d = d.groupBy(*by, "rule").agg(F.max("all").alias("docs"), at(1).alias("b1"), at(3).alias("b3"))
        q1, q3 = _low(F.col("b1")), _low(F.col("b3") + 1) - 1
        narrowest = F.element_at(F.create_map(*[F.lit(x) for r, (_, s, _) in RULES.items() for x in (r, s)]), F.col("rule"))
        spread = F.greatest(q3 - q1, narrowest) * reach
        return d.select(*by, "rule", "docs", F.struct((q1 - spread).alias("low"), (q3 + spread).alias("high")).alias("fence"))

    both = quartiles(sketch, ["lang", "source"])
    lang = quartiles(sketch, ["lang"]).select(F.col("lang").alias("l"), F.col("rule").alias("r"), F.col("docs").alias("lang_docs"), F.col("fence").alias("lang_fence"))
    every = quartiles(sketch, []).select(F.col("rule").alias("a"), F.col("fence").alias("all_fence"))
    d = both.join(lang, F.col("lang").eqNullSafe(F.col("l")) & (F.col("rule") == F.col("r"))).join(every, F.col("rule") == F.col("a"))
    fence = F.when(F.col("docs") >= min_docs, F.col("fence")).when(F.col("lang_docs") >= min_docs, F.col("lang_fence")).otherwise(F.col("all_fence"))
    return d.withColumn("f", fence).select("lang", "source", "rule", "f.low", "f.high")


def judge(docs: DataFrame, reach: int = 3, min_docs: int = 100, keep: list[str] | None = None) -> DataFrame:
    """The signals of every row of ``docs`` (doc_id, text, lang, source),
    base_failed, kept and failed_rules.

    base_failed: under 10 words, or over a fifth of the words repeat.  kept:
    not base_failed and inside the fences of the row's group.  Null text is
    empty (0 words: base_failed).  Null lang or source is a group of its
    own.  Repeated rows are judged alike.  An empty table gives no row.  Very
    long texts are counted whole, in slices cut between words.  A value on a
    fence is inside.  Further columns aren't looked at; those named in ``keep``
    are carried and must not have the name of a signal or a result.

    ``min_docs`` is part of the method: a group of fewer documents takes the
    fences of its language, that of a small language those of the corpus.
    """
    s = cut_lineage(text_signals(docs, ["doc_id", "lang", "source", *(keep or [])]))
    f = fences(sketches(s), reach, min_docs)
    wide = f.groupBy("lang", "source").agg(F.map_from_entries(F.collect_list(F.struct("rule", F.struct("low", "high")))).alias("fences"))
    g = wide.select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), "fences")
    d = s.join(g, s["lang"].eqNullSafe(g["_lang"]) & s["source"].eqNullSafe(g["_source"]), "left")
    base = (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)
    failed = []
    for rule, (value, _, lower) in RULES.items():
        v, fence = value().cast("long"), F.element_at("fences", rule)
        bad = (v > fence["high"]) | (v < fence["low"]) if lower else v > fence["high"]
        failed.append(F.when(F.col("n_words") > 0, F.when(bad, F.lit(rule))))
    d = d.withColumn("base_failed", base).withColumn("failed_rules", F.array_compact(F.array(*failed)))
    return d.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0)).drop("_lang", "_source", "fences")
