"""TF-IDF over 1-2-grams, as a long (doc_id, term, weight) table.

Definition (scikit-learn's TfidfVectorizer defaults): raw term counts,
idf = ln((1 + n) / (1 + df)) + 1, rows scaled to unit L2 norm.  The
vocabulary keeps terms with ``min_df <= df <= max_df * n`` and, of those,
the ``max_features`` with the largest corpus count (ties: term ascending).

Plan: per-document term counts are formed inside each document row (no
shuffle); one ``groupBy(term)`` with map-side combine gives df and the
corpus count; the vocabulary is at most ``max_features`` rows, so it is
broadcast to the term rows (a size bound by construction, not a guess);
the row norm is one window over doc_id, at most ``max_features`` rows per
document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as T
from ..functions.arrays import explode_counts
from ..session import bounded


def terms(text="text", stop=None) -> F.Column:
    """Letters-only words, stop words removed, then unigrams + bigrams."""
    stop = fixed.stop_words(None) if stop is None else stop
    return T.ngrams_1_2(T.remove_words(T.tokens_words(text), stop))


def term_rows(docs: DataFrame, doc: str = "doc_id", text: str = "text", stop=None) -> DataFrame:
    """(doc_id, term, tf) for every 1-2-gram of every document."""
    return explode_counts(docs, terms(text, stop), [doc], "term", "tf")


def term_stats(rows: DataFrame) -> DataFrame:
    return rows.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total"))


def fit_vocabulary(rows: DataFrame, n_docs: int, min_df: int = 2, max_df: float = 0.85,
                   max_features: int | None = 5000) -> DataFrame:
    """(term, df, total, idf, term_idx) - the fitted vocabulary."""
    stats = term_stats(rows)
    max_count = max_df if isinstance(max_df, int) else max_df * n_docs
    kept = stats.where((F.col("df") >= min_df) & (F.col("df") <= F.lit(float(max_count))))
    order = [F.col("total").desc(), F.col("term").asc()]
    if max_features is not None:
        kept = kept.orderBy(*order).limit(max_features)
    idf = F.log((F.lit(1.0) + F.lit(n_docs)) / (F.lit(1.0) + F.col("df"))) + F.lit(1.0)
    # At most max_features rows: numbering them in one partition is bounded.
    return kept.withColumn("idf", idf).withColumn(
        "term_idx", (F.row_number().over(Window.orderBy("term")) - 1).cast("int"))


def weights(rows: DataFrame, vocabulary: DataFrame, doc: str = "doc_id",
            broadcast_limit: int | None = 200_000) -> DataFrame:
    """(doc_id, term, term_idx, tf, weight): tf * idf scaled to unit length per document.

    The vocabulary is broadcast up to ``broadcast_limit`` rows (counted); a
    larger one, or any with None, is joined as Spark sees fit.
    """
    v = vocabulary.select("term", "term_idx", "idf")
    if broadcast_limit is not None:
        v = bounded(v, broadcast_limit)
    w = rows.join(v, "term").withColumn("w", F.col("tf") * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(doc)))
    return w.withColumn("weight", F.col("w") / norm).drop("w", "idf")


def tfidf(docs: DataFrame, min_df: int = 2, max_df: float = 0.85,
          max_features: int | None = 5000, doc: str = "doc_id", text: str = "text",
          stop=None) -> tuple[DataFrame, DataFrame]:
    """Fit and apply: returns (vocabulary, weights)."""
    n = docs.count()
    rows = term_rows(docs, doc, text, stop)
    vocab = fit_vocabulary(rows, n, min_df, max_df, max_features)
    bl = 200_000 if max_features is not None and max_features <= 200_000 else None
    return vocab, weights(rows, vocab, doc, bl)


def group_mean_terms(weights_df: DataFrame, members: DataFrame, group: str,
                     n_top: int = 4, doc: str = "doc_id") -> DataFrame:
    """Label groups by their top terms of mean TF-IDF (absent = 0).

    mean = sum(weight) / group size; top ``n_top`` terms by mean desc,
    term asc, joined by ' / '.  ``members`` is (doc_id, group).
    """
    sizes = members.groupBy(group).agg(F.count(F.lit(1)).alias("group_size"))
    sums = weights_df.join(members, doc).groupBy(group, "term").agg(F.sum("weight").alias("s"))
    means = sums.join(sizes, group).withColumn("mean_weight", F.col("s") / F.col("group_size"))
    agg = means.groupBy(group).agg(
        F.array_sort(F.collect_list(F.struct(
            (-F.round("mean_weight", 9)).alias("k"), F.col("term")))).alias("ranked"))
    # collect_list is over the terms of one group, bounded by the vocabulary
    # size; only n_top of them are kept.
    return agg.select(group, T.join_top(F.col("ranked"), "term", n_top, " / ").alias("label"))
