"""Delimited text archives -> document table.

A file holds records separated by runs of 20+ '='.  A record carries
header lines (``ARCHIVE_FOLDER:``, ``DOCUMENT:``/``DOCUMENT_ID:``,
``DATE:``, ``PLACE:``, also ``SOURCE_IMAGES:``, ``PAGES:``), then a rule
of 20+ '-', then the body.  Records without a document id are rejects.
Without a rule, the body is everything after the last header line.

Everything is column expressions over (source_file, content) rows: split,
posexplode, regex extraction - one narrow stage, no shuffle.  Files are
read whole (``wholetext``), so one task handles one file.

``lenient=True`` reproduces the original header rule, where an empty
header value runs over the line break and takes the next line; the
default stops at the end of the line.  The default also accepts
``DOCUMENT_ID:`` as a header line when looking for the body.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.arrays import explode_rows
from ..functions.text import normalise_newlines, strip_ws

WS = fixed.PY_WHITESPACE
HWS = WS.replace(r"\n", "")   # white space except the line break


def header_pattern(key: str, lenient: bool = False) -> str:
    gap = f"[{WS}]*" if lenient else f"[{HWS}]*"
    return f"(?md)^{key}:{gap}(.+)$"


def header_line_pattern(lenient: bool = False) -> str:
    doc = "DOCUMENT" if lenient else "DOCUMENT(?:_ID)?"
    keys = "|".join(doc if k == "DOCUMENT" else k for k in fixed.HEADER_KEYS)
    return f"^({keys})[{WS}_]*:"


def file_name() -> F.Column:
    """Name of the file a row comes from (paths are URL-encoded there)."""
    last = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    return F.url_decode(F.replace(last, F.lit("+"), F.lit("%2B")))


def read_files(spark: SparkSession, path: str, glob: str = "*.txt",
               skip: list[str] | None = None) -> DataFrame:
    """(source_file, content) - one row per text file, bad UTF-8 replaced,
    CRLF/CR turned into LF."""
    df = spark.read.option("pathGlobFilter", glob).text(path, wholetext=True)
    df = df.select(file_name().alias("source_file"),
                   normalise_newlines(F.make_valid_utf8("value")).alias("content"))
    if skip:
        df = df.where(~F.col("source_file").isin(list(skip)))
    return df


def split_blocks(files: DataFrame) -> DataFrame:
    """(source_file, block_no, block): stripped, non-empty records."""
    b = files.select("source_file", F.posexplode_outer(F.split("content", fixed.BLOCK_SEPARATOR))
                     .alias("block_no", "raw")).where(F.col("raw").isNotNull())
    b = b.select("source_file", "block_no", strip_ws("raw").alias("block"))
    return b.where(F.col("block") != "")


def read_records(spark: SparkSession, path: str, glob: str = "*.txt", skip: list[str] | None = None) -> DataFrame:
    """(source_file, block_no, block) as :func:`split_blocks` gives, read
    record by record: for files too large for one row.  A file is split over
    tasks at the separators; block_no ascends within a file, with gaps."""
    sep = fixed.SEPARATOR_CHAR * fixed.SEPARATOR_RUN
    df = spark.read.option("pathGlobFilter", glob).option("lineSep", sep).text(path)
    # what is left of a longer run stands before the next record
    raw = F.regexp_replace(F.make_valid_utf8("value"), f"^{fixed.SEPARATOR_CHAR}+", "")
    df = df.select(file_name().alias("source_file"), F.monotonically_increasing_id().alias("block_no"),
                   strip_ws(normalise_newlines(raw)).alias("block")).where(F.col("block") != "")
    return df.where(~F.col("source_file").isin(list(skip))) if skip else df


def _field(block, key: str, default: str, lenient: bool):
    """A header's value; the default where it is missing or blank."""
    found = strip_ws(F.regexp_extract(block, header_pattern(key, lenient), 1))
    return F.when(found != "", found).otherwise(F.lit(default))


def parse_blocks(blocks: DataFrame, lenient: bool = False) -> tuple[DataFrame, DataFrame]:
    """(documents, rejects) from (source_file, block_no, block) rows.

    documents: doc_id, archive_folder, date, place, text, source_file, block_no.
    rejects: blocks with no document id, or a blank one.
    """
    blk = F.col("block")
    id_pat = header_pattern("DOCUMENT(?:_ID)?", lenient)
    lines = F.split(blk, "\n")
    meta_end = F.array_max(F.transform(
        lines, lambda l, i: F.when(l.rlike(header_line_pattern(lenient)), i + 1).otherwise(0)))
    fallback = F.array_join(F.slice(lines, meta_end + 1, F.greatest(F.size(lines) - meta_end, F.lit(0))), "\n")
    ruled = F.element_at(F.split(blk, fixed.BODY_RULE, 2), 2)
    body = strip_ws(F.when(blk.rlike(fixed.BODY_RULE), ruled).otherwise(fallback))
    parsed = blocks.select(
        "source_file", "block_no", "block",
        (strip_ws(F.regexp_extract(blk, id_pat, 1)) != "").alias("has_id"),
        strip_ws(F.regexp_extract(blk, id_pat, 1)).alias("doc_id"),
        _field(blk, "ARCHIVE_FOLDER", fixed.DEFAULT_ARCHIVE, lenient).alias("archive_folder"),
        _field(blk, "DATE", fixed.DEFAULT_DATE, lenient).alias("date"),
        _field(blk, "PLACE", fixed.DEFAULT_PLACE, lenient).alias("place"),
        body.alias("text"))
    docs = parsed.where("has_id").select("doc_id", "archive_folder", "date", "place", "text",
                                         "source_file", "block_no")
    rejects = parsed.where(~F.col("has_id")).select("source_file", "block_no", "block")
    return docs, rejects


def documents_from_files(spark: SparkSession, path: str, extra: list[str] | None = None,
                         skip: list[str] | None = None, lenient: bool = False,
                         min_words: int | None = 20) -> DataFrame:
    """The document table from a folder of archive files (plus extra paths):
    parse, series, word count, length filter."""
    from .tables import keep_long, union_sources, with_series_and_count
    files = [read_files(spark, path, skip=skip)] + [read_files(spark, p) for p in (extra or [])]
    docs, _ = parse_blocks(split_blocks(union_sources(*files)), lenient)
    docs = with_series_and_count(docs.drop("block_no"))
    return keep_long(docs, min_words) if min_words else docs


__all__ = ["read_files", "read_records", "split_blocks", "parse_blocks", "documents_from_files", "explode_rows"]
