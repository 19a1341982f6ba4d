"""Lexicon scoring: mean valence / arousal / dominance per document.

Per document: tokens ``[a-z]+`` of the lower-cased text; the mean of each
lexicon column over token OCCURRENCES found in the lexicon; ``matched`` =
number of such occurrences; ``coverage`` = matched / all tokens.
Documents with no match are dropped.  Works for any k-column lexicon.

Plan: tokens are counted inside each document row first (one row per
distinct token per document, so a word repeated everywhere is not a hot
join key), joined to the lexicon, and summed back per document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.arrays import explode_counts

def score_documents(docs: DataFrame, lexicon: DataFrame, columns=("valence", "arousal", "dominance"),
                    doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, <col> means..., matched, coverage) for documents with a match."""
    d = docs.select(doc, T.tokens_lexicon(text).alias("toks"))
    d = d.select(doc, F.size("toks").cast("long").alias("n_tokens"), "toks")
    counts = explode_counts(d, "toks", [doc, "n_tokens"], "word", "tf")
    j = counts.join(lexicon.select("word", *columns), "word")  # Spark picks the join by the lexicon's bytes
    aggs = [(F.sum(F.col(c) * F.col("tf")) / F.sum("tf")).alias(c) for c in columns]
    out = j.groupBy(doc).agg(*aggs, F.sum("tf").cast("long").alias("matched"),
                             F.first("n_tokens").alias("n_tokens"))
    return out.withColumn("coverage", F.col("matched") / F.col("n_tokens")).drop("n_tokens")


def summary(scores: DataFrame, columns=("valence", "arousal", "dominance")) -> DataFrame:
    aggs = []
    for c in columns:
        aggs += [F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max"), F.avg(c).alias(f"{c}_mean")]
    return scores.agg(F.count(F.lit(1)).alias("n_docs"), *aggs,
                      F.avg("coverage").alias("coverage_mean"))


def by_group(scores: DataFrame, group: str, columns=("valence", "arousal", "dominance")) -> DataFrame:
    """mean, sample std (NULL for one row) and count per group."""
    aggs = []
    for c in columns:
        aggs += [F.avg(c).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_std"),
                 F.count(c).alias(f"{c}_count")]
    return scores.groupBy(group).agg(*aggs)
