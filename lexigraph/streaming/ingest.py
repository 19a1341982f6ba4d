"""Incremental ingest: new archive files landing in a folder become rows of
the document table.

The block parser is row-wise (split, regex, no state), so it runs as is
on a file stream: ``readStream.text(wholetext)`` -> split records -> parse
-> series / word count / length filter -> parquet sink.  The file sink is
exactly-once; progress lives with the sink.  Rejected records go to their
own sink when a path is given.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..sources import blocks as BL
from ..sources.tables import keep_long, with_series_and_count


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def stream_documents(spark: SparkSession, in_dir: str, out_dir: str, name: str = "documents",
                     glob: str = "*.txt", lenient: bool = False, min_words: int | None = 20,
                     rejects_dir: str | None = None, available_now: bool = True, checkpoint: str | None = None):
    """Start the ingest query; returns the StreamingQuery (or two).

    Progress belongs to the sink: it is kept in ``checkpoint``, by default
    in a folder inside the sink (``_progress``, which readers skip).  A sink
    that already has a log must come with the progress that wrote it.
    """
    files = (spark.readStream.option("pathGlobFilter", glob)
             .text(in_dir, wholetext=True)
             .select(BL.file_name().alias("source_file"),
                     BL.normalise_newlines(F.make_valid_utf8("value")).alias("content")))
    docs, rejects = BL.parse_blocks(BL.split_blocks(files), lenient)
    docs = with_series_and_count(docs)
    if min_words:
        docs = keep_long(docs, min_words)
    def progress(sink: str, given: str | None) -> str:
        found = given or f"{sink}/_progress/{name}"
        if _exists(spark, f"{sink}/_spark_metadata") and not _exists(spark, f"{found}/commits"):
            raise ValueError(f"{sink} holds a stream's output, but {found} holds no progress of it: files would be skipped")
        return found

    w = docs.writeStream.format("parquet").option("path", out_dir) \
        .option("checkpointLocation", progress(out_dir, checkpoint))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    q = w.start()
    if rejects_dir is None:
        return q
    r = rejects.writeStream.format("parquet").option("path", rejects_dir) \
        .option("checkpointLocation", progress(rejects_dir, checkpoint and checkpoint + "-rejects"))
    r = r.trigger(availableNow=True) if available_now else r.trigger(processingTime="30 seconds")
    return q, r.start()
