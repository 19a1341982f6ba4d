"""Topic tables: summaries, crosstab, dominant match, class TF-IDF, LDA,
density topics and topic reduction."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import cut_lineage


def top_values(df: DataFrame, group: str, value: str, n: int, sep: str = ", ") -> DataFrame:
    """(group, top): the n most frequent values per group (count desc, value
    asc) joined by ``sep``.  Counting first means each group ranks its
    distinct values only."""
    c = df.groupBy(group, value).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(group).orderBy(F.col("_n").desc(), F.col(value).asc())
    c = c.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n)
    return c.groupBy(group).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", value))),
                                 lambda s: s[value]), sep).alias("top"))


def topic_summary(assign: DataFrame, n_archives: int = 5) -> DataFrame:
    """One row per non-empty topic: doc count, name, keywords, top archives.

    ``assign``: (doc_id, archive_folder, topic_num, topic, keywords).
    Name and keywords are per topic; ``min`` picks them deterministically.
    """
    base = assign.groupBy("topic_num").agg(
        F.count(F.lit(1)).alias("doc_count"), F.min("topic").alias("topic_name"),
        F.min("keywords").alias("keywords"))
    arch = top_values(assign, "topic_num", "archive_folder", n_archives) \
        .withColumnRenamed("top", "sample_archives")
    return base.join(arch, "topic_num")


def crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    """Long-form contingency table (a, b, n)."""
    return df.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))


def dominant_match(df: DataFrame, a: str, b: str) -> DataFrame:
    """For each a: its most common b (ties: b asc), group size, share in %."""
    ct = crosstab(df, a, b)
    w = Window.partitionBy(a).orderBy(F.col("n").desc(), F.col(b).asc())
    tot = F.sum("n").over(Window.partitionBy(a))
    ct = ct.withColumn("n_a", tot).withColumn("_r", F.row_number().over(w))
    return ct.where(F.col("_r") == 1).select(
        a, F.col(b).alias(f"dominant_{b}"), F.col("n_a"), F.col("n").alias("n_match"),
        (F.lit(100.0) * F.col("n") / F.col("n_a")).alias("pct"))


def class_counts(docs: DataFrame, cls: str, tokens: str = "tokens") -> DataFrame:
    """(cls, term, tf): how often each class has each term.  The position
    keeps null terms apart from empty lists; an inner ``explode`` would run the
    tokeniser a second time (see ``arrays.explode_rows``)."""
    rows = docs.select(cls, F.posexplode_outer(tokens).alias("_p", "term")).where(F.col("_p").isNotNull())
    return rows.groupBy(cls, "term").agg(F.count(F.lit(1)).alias("tf"))


def class_tfidf(docs: DataFrame, cls: str, tokens: str = "tokens", n_top: int = 10) -> DataFrame:
    """The top class-based TF-IDF terms (:func:`best_terms`) of documents."""
    return best_terms(class_counts(docs, cls, tokens), cls, n_top)


def best_terms(tf: DataFrame, cls: str, n_top: int = 10) -> DataFrame:
    """Class-based TF-IDF: score(t, c) = tf(t, c) * ln(1 + A / f(t)).

    tf(t, c): count of t in class c; f(t): count of t over all classes;
    A: mean number of tokens per class.  Top ``n_top`` per class (score
    desc, term asc).
    """
    ft = tf.groupBy("term").agg(F.sum("tf").alias("f"))
    A = tf.agg((F.sum("tf") / F.countDistinct(cls)).alias("A")).first()["A"] or 0.0
    s = tf.join(ft, "term").withColumn("score", F.col("tf") * F.log1p(F.lit(float(A)) / F.col("f")))
    w = Window.partitionBy(cls).orderBy(F.round("score", 9).desc(), F.col("term").asc())
    return s.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n_top) \
        .select(cls, "term", "score", "rank")


def topic_label(keywords: F.Column, stop: list[str], n_keep: int = 5, n_name: int = 4):
    """Keyword noise filter: length > 2, not in ``stop``; keep 5, name = first 4 by ' / '."""
    kept = F.slice(F.filter(keywords, lambda w: (F.length(w) > 2) & ~w.isin(list(stop))), 1, n_keep)
    return kept, F.array_join(F.slice(kept, 1, n_name), " / ")


def lda_topics(docs: DataFrame, tokens: str = "tokens", k: int = 15, passes: int = 20,
               min_df: int = 3, max_df: float = 0.7, seed: int = 42, stop: list[str] | None = None,
               doc: str = "doc_id", vocab_size: int = 100_000) -> tuple[DataFrame, DataFrame]:
    """MLlib online LDA over a bag of words: every pass reads every document.

    The vocabulary is the ``vocab_size`` most frequent words inside the
    document-frequency bounds; the document prior is fixed at 1/k.  Returns
    (assignments, topics): assignments (doc_id, topic_num) - argmax of the
    topic distribution, first topic on ties, NULL for an empty bag; topics
    (topic_num, topic, keywords) - top 6 terms, filtered and named by
    :func:`topic_label`."""
    from pyspark.ml.clustering import LDA
    from pyspark.ml.feature import CountVectorizer
    from pyspark.ml.functions import vector_to_array

    docs = cut_lineage(docs.select(doc, tokens))
    cv = CountVectorizer(inputCol=tokens, outputCol="bow", minDF=float(min_df), vocabSize=vocab_size,
                         maxDF=float(max_df * docs.count())).fit(docs)
    bow = cut_lineage(cv.transform(docs).select(doc, "bow"))
    model = LDA(k=k, maxIter=passes, optimizer="online", seed=seed, featuresCol="bow", docConcentration=[1.0 / k] * k,
                optimizeDocConcentration=False, subsamplingRate=1.0).fit(bow)
    dist = vector_to_array(F.col("topicDistribution"))
    assign = model.transform(bow).select(
        doc, F.when(F.array_max(dist) > 0, F.array_position(dist, F.array_max(dist)) - 1)
        .cast("int").alias("topic_num"))
    top = model.describeTopics(6)
    # k topics of 6 words: only the names of these are looked up
    used = {i for r in top.select("termIndices").collect() for i in r[0]}
    vocabulary = cv.vocabulary  # read once: each read brings all its words from the JVM
    names = docs.sparkSession.createDataFrame([(i, vocabulary[i]) for i in sorted(used)] or [(-1, "")], "i int, word string")
    named = top.select(F.col("topic").cast("int").alias("topic_num"), F.posexplode("termIndices").alias("r", "i")).join(names, "i")
    topics = named.groupBy("topic_num").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "word"))), lambda x: x["word"]).alias("top"))
    kept, name = topic_label(F.col("top"), stop or [])
    topics = topics.select("topic_num", name.alias("topic"), F.array_join(kept, ", ").alias("keywords"))
    return assign, topics


def reduced_points(points: DataFrame, components: int, id_col: str, vec: str) -> DataFrame:
    """(id, vec): the points centred and projected on their principal axes."""
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    x = points.select(id_col, array_to_vector(F.col(vec).cast("array<double>")).alias("x"))
    centred = StandardScaler(withMean=True, withStd=False, inputCol="x", outputCol="xc").fit(x).transform(x)
    out = PCA(k=components, inputCol="xc", outputCol="pc").fit(centred).transform(centred)
    return out.select(id_col, vector_to_array("pc").alias(vec))


def density_topics(points: DataFrame, k_core: int = 3, min_size: int = 12, eps_quantile: float = 0.9,
                   id_col: str = "vec_id", vec: str = "embedding", block_docs: int = 1500, components: int | None = 10) -> DataFrame:
    """Density clusters on an embedding column (the HDBSCAN-style step,
    re-expressed): the points are reduced to ``components`` principal axes
    (None: taken as they are); core distance = distance to the k-th
    neighbour; points are linked when their mutual-reachability distance is
    <= eps (a high quantile of core distances); connected components of the
    links are clusters; components under ``min_size`` become topic -1
    (outliers).  Returns (id, topic) with topics numbered by size desc."""
    from . import graph as G
    from . import quality as Q
    if components is not None:
        points = cut_lineage(reduced_points(points, components, id_col, vec))
    edges = Q.mutual_reach_edges(points, k_core, eps_quantile, id_col, vec, block_docs)
    comp = cut_lineage(G.connected_components(points.select(F.col(id_col).alias("node")), edges))
    sizes = comp.groupBy("component").agg(F.count(F.lit(1)).alias("size"),
                                          F.min("node").alias("first"))
    big = sizes.where(F.col("size") >= min_size)
    num = G.numbered(big, [F.col("size").desc(), F.col("first").asc()], "topic").withColumn("topic", F.col("topic").cast("int"))
    out = comp.join(num.select("component", "topic"), "component", "left")
    return out.select(F.col("node").alias(id_col), F.coalesce("topic", F.lit(-1)).alias("topic"))


def topic_info(assign: DataFrame, names: DataFrame, topic: str = "topic", outlier: int = -1, outlier_name: str = "") -> DataFrame:
    """One row per topic: number of documents, share in %, name, and whether
    it is the outlier topic.  ``names`` is (topic, name)."""
    n = assign.groupBy(topic).agg(F.count(F.lit(1)).alias("doc_count"))
    total = assign.agg(F.count(F.lit(1)).alias("total"))
    out = n.join(names, topic, "left").join(F.broadcast(total))  # one row
    return out.select(topic, "doc_count", (F.lit(100.0) * F.col("doc_count") / F.col("total")).alias("pct"),
                      F.when(F.col(topic) == outlier, F.lit(outlier_name)).otherwise(F.col("name")).alias("name"), (F.col(topic) == outlier).alias("is_outlier"))


def _ctfidf_unit(tf: DataFrame, cls: str) -> DataFrame:
    """(cls, term, w): class TF-IDF rows scaled to unit length per class."""
    ft = tf.groupBy("term").agg(F.sum("tf").alias("f"))
    A = tf.agg((F.sum("tf") / F.countDistinct(cls)).alias("A")).first()["A"] or 0.0
    s = tf.join(ft, "term").withColumn("w", F.col("tf") * F.log1p(F.lit(float(A)) / F.col("f")))
    norm = s.groupBy(cls).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return s.join(norm, cls).select(cls, "term", (F.col("w") / F.col("norm")).alias("w"))


def reduce_topics(docs: DataFrame, cls: str, target: int, tokens: str = "tokens") -> DataFrame:
    """The merges of :func:`merge_classes` for the classes of documents."""
    return merge_classes(cut_lineage(class_counts(docs, cls, tokens)), cls, target)


def merge_classes(tf0: DataFrame, cls: str, target: int) -> DataFrame:
    """(cls, topic): merge the two most similar topics (cosine of class
    TF-IDF vectors; ties: smaller ids) until ``target`` remain.  Merged
    topics pool their term counts and take the smaller id.  A driver loop
    over small DataFrames (one row per topic and term); each step is a
    self-join on term of the current topic vectors.  ``tf0`` is (cls, term,
    tf), read in every step."""
    mapping = cut_lineage(tf0.select(cls).distinct().withColumn("topic", F.col(cls)))
    # each step leaves one topic less
    while mapping.select("topic").distinct().count() > target:
        tf = cut_lineage(tf0.join(mapping, cls).groupBy("topic", "term").agg(F.sum("tf").alias("tf")))
        u = cut_lineage(_ctfidf_unit(tf, "topic"))
        a = u.select(F.col("topic").alias("t1"), "term", F.col("w").alias("w1"))
        b = u.select(F.col("topic").alias("t2"), "term", F.col("w").alias("w2"))
        sims = a.join(b, "term").where(F.col("t1") < F.col("t2")).groupBy("t1", "t2") \
            .agg(F.sum(F.col("w1") * F.col("w2")).alias("sim"))
        best = sims.orderBy(F.col("sim").desc(), "t1", "t2").first()
        if best is None:
            break
        mapping = cut_lineage(mapping.withColumn(
            "topic", F.when(F.col("topic") == best["t2"], F.lit(best["t1"])).otherwise(F.col("topic"))))
    return mapping
