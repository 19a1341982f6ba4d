"""Readers for the input tables and the corpus document table.

The document table (one row per document: doc_id, archive_folder, date,
place, text, source_file, series, word_count) is what every analysis
starts from.  :func:`corpus_from_documents` maps the driver's
``documents`` table onto it; :mod:`lexigraph.sources.blocks` builds it from
delimited text files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import has_words, normalise_newlines, series_of, word_count
from ..session import table_path

MIN_WORDS = 20


def spread(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Round-robin a scan that came out with fewer partitions than the
    cluster has cores (a small or unsplittable file), so per-row text work
    runs in parallel.  A large scan already has enough splits and is left
    as it is (no shuffle)."""
    target = min_partitions or df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < target:
        return df.repartition(target)
    return df


def read_table(spark: SparkSession, sf_dir: str, name: str, spread_out: bool = False) -> DataFrame:
    df = spark.read.parquet(table_path(sf_dir, name))
    return spread(df) if spread_out else df


def with_series_and_count(docs: DataFrame, source_col: str = "source_file") -> DataFrame:
    """Add ``series`` (prefix rules on the source file) and ``word_count``."""
    return docs.withColumn(
        "series", series_of(source_col, fixed.SERIES_PREFIXES, fixed.DEFAULT_SERIES)
    ).withColumn("word_count", word_count("text"))


def keep_long(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Documents with at least ``min_words`` white-space separated words.

    Tested on the text with an early-stopping pattern rather than on
    ``word_count``: a filter on the derived column would be pushed below
    the projection and count every document's words a second time.
    """
    return docs.where(has_words("text", min_words))


def corpus_from_documents(spark: SparkSession, sf_dir: str,
                          min_words: int | None = MIN_WORDS) -> DataFrame:
    """The document table from the driver's ``documents`` table.

    ``source`` stands for the archive / source file and ``lang`` for the
    place; there is no date, so it takes the default.  Columns not needed
    downstream are pruned by Catalyst at the parquet scan.
    """
    d = read_table(spark, sf_dir, "documents")
    docs = spread(d.select("doc_id", "source", "lang", "text")).select(
        F.col("doc_id"),
        F.col("source").alias("archive_folder"),
        F.lit(fixed.DEFAULT_DATE).alias("date"),
        F.col("lang").alias("place"),
        normalise_newlines(F.make_valid_utf8(F.col("text"))).alias("text"),
        F.col("source").alias("source_file"),
    )
    docs = with_series_and_count(docs)
    return keep_long(docs, min_words) if min_words else docs


def union_sources(*frames: DataFrame) -> DataFrame:
    """UNION ALL of document sources with the same columns."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
