"""Sequences and ranks: conditional ranks, runs, states of claims, staleness, pages of rows, shortlists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.operators.sampling import numbered


def ranked_if_any(rows: DataFrame, group: str, match: str, order: Sequence[Column]) -> DataFrame:
    """Rank within the group, null for groups in which nothing matches at all."""
    w = Window.partitionBy(group)
    return rows.withColumn("rank", F.when(F.max(match).over(w) > 0, F.row_number().over(w.orderBy(*order))))


def runs(rows: DataFrame, key: str, order: Sequence[str], value: str) -> DataFrame:
    """Rows with ``step`` and the number of their run of equal neighbours (``run``, from 1)."""
    w = Window.partitionBy(key).orderBy(*order)
    fresh = rows.withColumn("_f", (~F.lag(value).over(w).eqNullSafe(F.col(value))).cast("int")).withColumn("step", F.row_number().over(w) - 1)
    return fresh.withColumn("run", F.sum("_f").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_f")


def claim_states(rows: DataFrame, key: str, field: str, abstained: Column, fields: Sequence[str]) -> DataFrame:
    """(key, written, abstained, remaining): fields in the given order; what is written is not abstained."""
    target = F.array(*map(F.lit, fields))
    g = rows.groupBy(key).agg(F.collect_set(F.when(~abstained, F.col(field))).alias("_w"), F.collect_set(F.when(abstained, F.col(field))).alias("_a"))
    written, given_up = F.array_intersect(target, "_w"), F.array_except(F.array_intersect(target, "_a"), "_w")
    return g.select(key, written.alias("written"), given_up.alias("abstained"), F.array_except(F.array_except(target, "_w"), "_a").alias("remaining"))


def staleness(rows: DataFrame, key: str, at: str, limit: int) -> DataFrame:
    """(key, seconds, stale): seconds between a key's last row and the last row of all."""
    newest = rows.agg(F.max(at)).first()[0]
    last = rows.groupBy(key).agg(F.max(at).alias("_l"))
    s = last.withColumn("seconds", F.timestamp_diff("SECOND", F.col("_l"), F.lit(newest).cast(dict(rows.dtypes)[at])))
    return s.select(key, "seconds", (F.col("seconds") > limit).alias("stale"))


def weighted_score(checks: dict[int, Column]) -> Column:
    """The sum of the weights of the checks that hold."""
    return sum((F.when(F.coalesce(c, F.lit(False)), F.lit(w)).otherwise(F.lit(0)) for w, c in checks.items()), F.lit(0))


def page_of_rows(rows: DataFrame, order: Sequence[str], offset: int, limit: int) -> DataFrame:
    """Rows ``offset`` + 1 to ``offset`` + ``limit`` in the order, with their place (paging; no single-task window)."""
    return numbered(rows, order, "place").where((F.col("place") > offset) & (F.col("place") <= offset + limit))


def shortlist(rows: DataFrame, group: str, same: Column, order: Sequence[Column], n: int) -> DataFrame:
    """The first ``n`` of every group, equal ones once, with letters from A (the count is the feature)."""
    w = Window.partitionBy(group)
    top = rows.withColumn("_n", F.row_number().over(w.orderBy(*order))).where(F.col("_n") <= n)
    once = top.withColumn("_k", F.row_number().over(Window.partitionBy(group, same).orderBy("_n"))).where("_k = 1")
    return once.withColumn("letter", F.char(F.lit(64) + F.row_number().over(w.orderBy("_n")))).drop("_n", "_k")
