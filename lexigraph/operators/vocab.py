"""Word statistics and vocabulary selection.

``word_stats`` counts corpus frequency and document frequency of every
token in ONE hash aggregation keyed by word.  Each document row carries
its token array; the per-document counts are formed inside the row
(:func:`value_counts`, no shuffle), then one ``groupBy(word)`` sums them.
Both outputs are plain sums/counts, so the map side combines them before
the shuffle: a word found in every document reaches its reducer as one
partial row per map task, not one row per document (no skew from hot
words, no ``count(DISTINCT)`` plan).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import explode_counts


def doc_term_counts(docs: DataFrame, tokens: str = "tokens", doc: str = "doc_id",
                    term: str = "term") -> DataFrame:
    """(doc, term, tf) rows; counted inside each document row."""
    return explode_counts(docs, tokens, [doc], term, "tf")


def word_stats(docs: DataFrame, tokens: str = "tokens") -> DataFrame:
    """(word, freq, doc_freq) over a table with one token array per document."""
    rows = doc_term_counts(docs, tokens, term="word")
    return rows.groupBy("word").agg(
        F.sum("tf").alias("freq"),
        F.count(F.lit(1)).alias("doc_freq"),
    )


def candidates(stats: DataFrame, min_freq: int = 8, min_doc_freq: int = 3) -> DataFrame:
    return stats.where((F.col("freq") >= min_freq) & (F.col("doc_freq") >= min_doc_freq))


def top_by(df: DataFrame, n: int, score: str, key: str = "word",
           rank_col: str | None = "rank") -> DataFrame:
    """The n rows with the highest ``score``; ties broken by ``key`` ascending.

    A global top-n with a fixed n: Spark plans it as TakeOrderedAndProject
    (each task keeps n rows, the driver merges n x tasks), so the result
    size is bounded by n, whatever the input size.
    """
    top = df.orderBy(F.col(score).desc(), F.col(key).asc()).limit(n)
    if rank_col is None:
        return top
    # n rows at most: a single-partition window over them is bounded.
    w = Window.orderBy(F.col(score).desc(), F.col(key).asc())
    return top.withColumn(rank_col, F.row_number().over(w).cast("long"))
