"""A training corpus from the table ``documents``: language ID, line
deduplication, near-deduplication, mixing of sources, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last keep the columns of ``docs``.  Between stages the rows are written as
Parquet, into the folder named by spark.checkpoint.dir, and read again.

Columns needed: doc_id, text, lang, source.  Further columns, whatever their
names, are carried; n_chars is kept right where it exists.  Every stage reads
very long texts whole and gives no row for an empty table; what it does with
nulls, empty texts, ties and repeated rows stands with it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigraph.llm import language_id as lid
from lexigraph.llm import line_dedup, packing, prob_minhash, source_mix
from lexigraph.session import checkpoint_dir, ship_package, table_path

#: Below this probability of the likeliest language a document is rejected.
MIN_SCORE = 0.5


def _carried(docs: DataFrame) -> DataFrame:
    """The columns that operators read, and the whole row as ``_row``: no
    other column's name can clash."""
    return docs.select("doc_id", "text", "lang", "source", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))


def _rows(df: DataFrame, columns: list[str], text: str | None = None) -> DataFrame:
    """``_row`` as columns again, with a new text (column name) if given."""
    out = []
    for c in columns:
        if text and c == "text":
            out.append(F.col(text).alias(c))
        elif text and c == "n_chars":
            out.append(F.length(text).cast(df.schema["_row"].dataType[c].dataType).alias(c))
        else:
            out.append(F.col(f"_row.`{c}`").alias(c))
    return df.select(*out)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter and those of no clear language.  The
    model learns from the rows of ``docs`` that have a lang.

    Null and empty texts go; a null lang or doc_id is no ground to go.
    Repeated rows stay or go together; a score of exactly MIN_SCORE stays."""
    ship_package(spark)
    d = _carried(docs)
    model = lid.train(d.where(~lid.held_out(F.col("doc_id"))))
    found = lid.predict(d, model, ["_row"])
    return _rows(found.where((F.col("lang_pred") != "und") & (F.col("score") >= MIN_SCORE)), docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines that stand earlier in the corpus, or nearly so; documents
    of which no word is left go.

    Null and empty texts, which lose nothing, stay, and so do rows of null
    doc_id.  Repeated rows are one document: they lose the same lines.  Of
    equal lines the one of smallest doc_id, then line number, stays."""
    ship_package(spark)
    kept = line_dedup.remove_lines(_carried(docs), keep=["_row"])
    emptied = (F.col("n_removed") > 0) & ~F.coalesce(F.col("kept_text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    return _rows(kept.where(~emptied), docs.columns, "kept_text")


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first document of each near-duplicate class: that of the
    smallest doc_id, repeated rows once.  Texts without a word and rows of null
    doc_id stay."""
    ship_package(spark)
    return _rows(prob_minhash.first_of_each(_carried(docs)), docs.columns)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes documents until each source has its share of words; a document
    taken twice is two rows.

    Null and wordless texts are never taken; a null source is a source, a null
    doc_id an id like any other.  Repeated rows are queued one by one; equal
    places go by doc_id, then size."""
    ship_package(spark)
    return _rows(source_mix.apply_mix(_carried(docs)), docs.columns)


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their ids, placed in sequences of 1024.  The ids go
    with the documents, so fewer of these make a shard.

    Null and empty texts are one piece, the end id; a null doc_id passes
    through; repeated rows are documents of their own.  Ties: by length,
    content, doc_id."""
    ship_package(spark)
    return packing.pack_documents(_carried(docs), with_ids=True, docs_per_shard=2_000)


STAGES = [
    ("language_id", language_stage),
    ("line_dedup", line_stage),
    ("near_dedup", near_stage),
    ("source_mix", mix_stage),
    ("packing", pack_stage),
]

#: Prediction by a trained model and tokenising can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents in ``sf_dir``."""
    docs = spark.read.parquet(table_path(sf_dir, "documents"))
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4()}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
