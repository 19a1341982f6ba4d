"""Graph operators on (nodes, edges) DataFrames: modularity, connected
components, community numbering and naming.  Communities: ``communities``.

Edges are undirected (src, dst, weight); internally both directions are
kept.  All steps are joins and aggregations; the driver only loops over
rounds and reads one scalar (modularity / change count) per round.
Lineage is cut with reliable checkpoints into ``spark.checkpoint.dir``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage


def _directed(edges: DataFrame) -> DataFrame:
    """Both directions of each undirected edge; a self loop is kept once."""
    e = edges.select("src", "dst", F.col("weight").cast("double").alias("weight"))
    rev = e.where(F.col("src") != F.col("dst")).select(
        F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    return e.unionByName(rev)


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, k): weighted degree; a self loop counts twice (networkx rule)."""
    d = _directed(edges)
    k = d.select(F.col("src").alias("node"),
                 F.when(F.col("src") == F.col("dst"), 2 * F.col("weight")).otherwise(F.col("weight")).alias("w")) \
        .groupBy("node").agg(F.sum("w").alias("k"))
    return nodes.select("node").join(k, "node", "left").select("node", F.coalesce("k", F.lit(0.0)).alias("k"))


def modularity(nodes: DataFrame, edges: DataFrame, part: DataFrame, resolution: float = 1.0) -> DataFrame:
    """One row (q): sum over communities of L_c/m - resolution * (D_c / 2m)^2.

    ``part`` is (node, community).  L_c: weight of edges inside c (each
    once), D_c: sum of degrees in c, m: total edge weight.
    """
    m = float(edges.agg(F.sum("weight")).first()[0] or 0.0)
    inside = edges.join(part.select(F.col("node").alias("src"), F.col("community").alias("cs")), "src") \
        .join(part.select(F.col("node").alias("dst"), F.col("community").alias("cd")), "dst") \
        .where(F.col("cs") == F.col("cd")).groupBy(F.col("cs").alias("community")) \
        .agg(F.sum("weight").alias("lc"))
    dc = degrees(nodes, edges).join(part, "node").groupBy("community").agg(F.sum("k").alias("dc"))
    per = dc.join(inside, "community", "left").fillna(0.0, ["lc"])
    tot = per.agg(F.sum("lc").alias("l"), F.sum(F.col("dc") * F.col("dc")).alias("d2"))
    if m == 0:
        return tot.select(F.lit(0.0).alias("q"))
    return tot.select((F.coalesce(F.col("l"), F.lit(0.0)) / F.lit(m)
                       - F.lit(resolution) * F.coalesce(F.col("d2"), F.lit(0.0))
                       / F.lit(4.0 * m * m)).alias("q"))


def numbered(df: DataFrame, order: list, name: str) -> DataFrame:
    """``df`` with 0, 1, 2 ... in ``order`` as column ``name``: a range sort,
    numbers inside each partition, and the counts of those before it (one
    number per partition reaches the driver)."""
    ranked = cut_lineage(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    part, within = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    before, total = {}, 0
    for r in ranked.groupBy(part.alias("p")).count().orderBy("p").collect():
        before[r["p"]], total = total, total + r["count"]
    if not before:
        return ranked.withColumn(name, F.col("_at")).drop("_at")
    offset = F.element_at(F.create_map(*[F.lit(x) for k, v in before.items() for x in (k, v)]), part)
    return ranked.withColumn(name, (offset + within).cast("long")).drop("_at")


def number_communities(part: DataFrame, node: str = "node") -> DataFrame:
    """Renumber communities 0.. by size desc (ties: smallest member asc)."""
    sizes = part.groupBy("community").agg(F.count(F.lit(1)).alias("size"), F.min(node).alias("first"))
    ids = numbered(sizes, [F.col("size").desc(), F.col("first").asc()], "cluster_id")
    return part.join(ids.select("community", "cluster_id", "size"), "community").drop("community")


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node id that each node reaches.

    Alternating star contraction: each round hooks every node's larger
    neighbours to its smallest neighbour, then its smaller ones, until the
    edge set stays the same.  The number of rounds grows with the square of
    the logarithm of the node count whatever the diameter; there is no cap.
    """
    pairs = edges.select(F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b")).where(F.col("a") != F.col("b"))
    pairs = cut_lineage(pairs.distinct())
    mark = _edge_mark(pairs)
    while mark[0]:
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        hooked = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where(F.col("a") != F.col("b"))
        small = cut_lineage(hooked.unionByName(low.select("a", F.col("m").alias("b"))).distinct())
        new = _edge_mark(small)
        pairs = small
        if new == mark:
            break
        mark = new
    found = pairs.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.select("node").join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def _edge_mark(pairs: DataFrame) -> tuple:
    """Size and content mark of an edge set (equal sets have equal marks)."""
    h = F.xxhash64("a", "b")
    r = pairs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.shiftright(h, 20)).alias("x"), F.sum(F.pmod(h, F.lit(1 << 20))).alias("y")).first()
    return r["n"], r["x"], r["y"]
