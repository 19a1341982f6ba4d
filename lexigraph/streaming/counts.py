"""Word statistics kept up to date while documents arrive.

The batch aggregation runs as it is on a stream of document files: the counts
of each document are formed in its row, and the state store holds two numbers
a word.  A trigger writes only the words that its documents changed, as a
folder of its own number.  Counts only grow, so the current table is each word's
greatest counts over all folders.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators import vocab
from ..session import drop_path
from .ingest import _exists


def stream_word_stats(spark: SparkSession, docs_dir: str, out_dir: str, tokens: Column, schema: StructType | str, *,
                      files_per_trigger: int | None = None, available_now: bool = True, checkpoint: str | None = None):
    """Start counting the documents (Parquet files, such as the sink of the
    ingest) in ``docs_dir``; returns the StreamingQuery.

    ``tokens`` gives a document's words (null: none); ``schema`` names the
    columns it reads, and ``doc_id``.  Progress and state are kept in
    ``checkpoint``, by default inside ``out_dir`` (``_progress``, which readers
    skip): started again with the same folders, the query goes on where it
    ended, and a trigger that was cut off writes its folder anew.  The number of
    shuffle partitions is that of the first start.  Where the words outgrow the
    executors' memory, choose Spark's RocksDB state store before it.
    """
    found = checkpoint or f"{out_dir}/_progress"
    if _exists(spark, f"{out_dir}/words") and not _exists(spark, f"{found}/offsets"):
        raise ValueError(f"{out_dir} holds counts, but {found} holds no progress of them: files would be counted from the start")
    files = spark.readStream.schema(schema)
    if files_per_trigger:
        files = files.option("maxFilesPerTrigger", files_per_trigger)
    docs = files.parquet(docs_dir).select("doc_id", tokens.alias("tokens"))

    def write(changed: DataFrame, number: int) -> None:
        # a repeated trigger has the same number and the same rows
        changed.write.mode("overwrite").parquet(f"{out_dir}/words/trigger-{number}")

    w = vocab.word_stats(docs).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", found)
    return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")).start()


def current_word_stats(spark: SparkSession, out_dir: str) -> DataFrame:
    """(word, freq, doc_freq) after the last trigger that wrote.  One row a word
    and map task is shuffled, however many triggers there were."""
    columns = "word string, freq long, doc_freq long"
    if not _exists(spark, f"{out_dir}/words"):
        return spark.createDataFrame([], columns)
    rows = spark.read.schema(columns).parquet(f"{out_dir}/words/*")
    return rows.groupBy("word").agg(F.max("freq").alias("freq"), F.max("doc_freq").alias("doc_freq"))


def compact_word_stats(spark: SparkSession, out_dir: str) -> None:
    """Merges the folders of all triggers so far into one, with one row a word.

    The merged folder is whole before another one goes, and rows that stand
    twice change nothing: the current table is the same wherever this ends, and
    a trigger written anew does no harm.  The query may go on meanwhile."""
    if not _exists(spark, f"{out_dir}/words"):
        return
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{out_dir}/words")
    old = [f.getPath() for f in p.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(p)]
    # of the folders listed, those that were complete: a trigger still being written stays
    old = [str(f) for f in old if _exists(spark, f"{f}/_SUCCESS")]
    if len(old) < 2:
        return
    rows = spark.read.schema("word string, freq long, doc_freq long").parquet(*old)
    merged = rows.groupBy("word").agg(F.max("freq").alias("freq"), F.max("doc_freq").alias("doc_freq"))
    merged.write.parquet(f"{out_dir}/words/merged-{uuid.uuid4()}")
    for path in old:
        drop_path(spark, path)
