"""Array-valued helpers (per-row, JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def once(col, fn) -> Column:
    """``fn(col)`` with ``col`` evaluated once for each row, however often
    ``fn`` names it and whether or not a lambda in it does.

    Projecting ``col`` first is not enough where it is named only once: the
    optimizer moves it into the lambda, which evaluates it for each element.
    """
    return F.transform(F.array(_c(col)), fn)[0]


def with_value_counts(df: DataFrame, col, out: str, value: str = "term",
                      count: str = "tf") -> DataFrame:
    """Add ``out``: array<struct<value, count>>, the distinct values of the
    array ``col`` with their counts.

    Sort, then take run starts; a run's length is the distance to the next
    start.  O(n log n) inside the row, so per-document term counts need no
    shuffle.  ``sort_array`` compares in compiled code (``array_sort`` runs a
    lambda for each comparison); its nulls come first and are a run of their own.  The sorted array and the run starts are separate projected
    columns: a lambda re-evaluates any expression it captures once per
    element, so capturing the sort itself would make this cubic.
    """
    s, st = f"_{out}_sorted", f"_{out}_starts"
    df = df.withColumn(s, F.sort_array(_c(col)))
    n = F.size(F.col(s))
    df = df.withColumn(st, F.filter(
        F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
        lambda i: (n > 0) & ((i == 1) | ~F.try_element_at(F.col(s), i)
                             .eqNullSafe(F.try_element_at(F.col(s), i - 1))),
    ))
    df = df.withColumn(out, F.transform(
        F.col(st),
        lambda p, k: F.struct(
            F.try_element_at(F.col(s), p).alias(value),
            (F.coalesce(F.try_element_at(F.col(st), k + 2), n + 1) - p).cast("long").alias(count),
        ),
    ))
    return df.drop(s, st)


def explode_rows(col, alias: str = "_e") -> Column:
    """``explode_outer``; pair with ``.where(F.col(alias).isNotNull())``.

    An inner ``explode`` makes the optimizer infer ``size(arr) > 0`` and push
    it below the projection that builds ``arr`` - the array expression
    (tokenising a whole text, say) is then evaluated twice, and any lambda
    in it re-evaluated per element.  The outer form infers nothing.
    """
    return F.explode_outer(_c(col)).alias(alias)


def explode_counts(df: DataFrame, col, keep: list[str], value: str = "term",
                   count: str = "tf") -> DataFrame:
    """(keep..., value, count) rows: one per distinct value of the array."""
    df = df.select(*keep, _c(col).alias("_arr"))
    df = with_value_counts(df, "_arr", "_vc", value, count)
    df = df.select(*keep, explode_rows("_vc", "_c")).where(F.col("_c").isNotNull())
    return df.select(*keep, f"_c.{value}", f"_c.{count}")
