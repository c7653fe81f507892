"""Sampling and splitting with deterministic order: keys are ordered by their MD5 with a seed, so SQL can check them.

Ranks over large groups are two-level: the first two hex digits of the digest form 256 buckets whose counts give the
offset, so no task ever sorts a whole group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.runtime import cut


def digest(key: str, seed: int) -> Column:
    """The order of a key under a seed."""
    return F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed))))


def shuffled_rank(rows: DataFrame, groups: Sequence[str], key: str, seed: int = 7, rank: str = "rank") -> DataFrame:
    """1-based rank within the group in seeded order, exact, in two levels."""
    d = rows.withColumn("_d", digest(key, seed)).withColumn("_b", F.substring("_d", 1, 2))
    counts = d.groupBy(*groups, "_b").agg(F.count("*").alias("_c"))
    before = F.coalesce(F.sum("_c").over(Window.partitionBy(*groups).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.withColumn("_o", before).select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)], F.col("_b").alias("_ob"), "_o")
    same = F.col("_b") == F.col("_ob")
    for i, g in enumerate(groups):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    ranked = d.join(offsets, same).withColumn(rank, F.row_number().over(Window.partitionBy(*groups, "_b").orderBy("_d", key)) + F.col("_o"))
    return ranked.drop("_d", "_b", "_ob", "_o", *[f"_g{i}" for i in range(len(groups))])


def prefix_sums(rows: DataFrame, order: Sequence[str], value: str, out: str = "before", parts: int = 64) -> DataFrame:
    """Sum of ``value`` over all earlier rows in the order, without a single-task window.

    Rows are ranged over the order and checkpointed with their part; part totals give the offsets.
    """
    ranged = cut(rows.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))
    totals = ranged.groupBy("_part").agg(F.sum(value).alias("_t"))
    offsets = totals.withColumn("_o", F.coalesce(F.sum("_t").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_part", "_o")
    w = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return ranged.join(F.broadcast(offsets), "_part").withColumn(out, F.coalesce(F.sum(value).over(w), F.lit(0)) + F.col("_o")).drop("_part", "_o")


def numbered(rows: DataFrame, order: Sequence[str], out: str = "n", parts: int = 64) -> DataFrame:
    """1-based number of every row in the whole order, without a single-task window (ties in any order)."""
    return prefix_sums(rows.withColumn("_one", F.lit(1).cast("bigint")), order, "_one", "_before", parts).withColumn(out, (F.col("_before") + 1).cast("bigint")).drop("_one", "_before")


def ratio_split(rows: DataFrame, stratum: str, key: str, val: float = 0.10, test: float = 0.15, seed: int = 7) -> DataFrame:
    """Per stratum: train first, then round(n val) and round(n test) rows (half-even, at least 1 from 10 rows on)."""
    sizes = rows.groupBy(F.col(stratum).alias("_s")).agg(F.count("*").alias("_n"))
    least = F.when(F.col("_n") >= 10, 1).otherwise(0)
    sizes = sizes.withColumn("_v", F.greatest(least, F.bround(F.col("_n") * val, 0).cast("int"))).withColumn("_t", F.greatest(least, F.bround(F.col("_n") * test, 0).cast("int")))
    ranked = shuffled_rank(rows, [stratum], key, seed, "_r").join(F.broadcast(sizes), F.col(stratum).eqNullSafe(F.col("_s")))
    train = F.col("_n") - F.col("_v") - F.col("_t")
    return ranked.withColumn("new_split", F.when(F.col("_r") <= train, "train").when(F.col("_r") <= train + F.col("_v"), "val").otherwise("test")).drop("_s", "_n", "_v", "_t", "_r")


def evaluation_documents(rows: DataFrame, doc: str, targets: Sequence[tuple[str, int]], cap: int) -> DataFrame:
    """(doc, n, split): whole documents for evaluation, least wasteful first, until each target is met; the rest trains.

    A document wastes what it holds beyond ``cap``; picking stops with the document that reaches the target.
    """
    left = rows.where(F.col(doc).isNotNull()).groupBy(doc).agg(F.count("*").alias("n")).withColumn("capped", F.least(F.col("n"), F.lit(cap))).withColumn("waste", F.greatest(F.lit(0), F.col("n") - cap))
    out = None
    for split, target in targets:
        summed = cut(prefix_sums(left, ["waste", "capped", doc], "capped"))
        taken = summed.where(F.col("before") < target).select(doc, "n", F.lit(split).alias("split"))
        out = taken if out is None else out.unionByName(taken)
        left = summed.where(F.col("before") >= target).drop("before")
    return out.unionByName(left.select(doc, "n", F.lit("train").alias("split")))


def round_robin(rows: DataFrame, by: str, order: Sequence[Column], cap: int, target: int) -> DataFrame:
    """Up to ``target`` rows, one per group and turn, at most ``cap`` per group (a sampling operator: the limit is its feature)."""
    turn = Window.partitionBy(by).orderBy(*order)
    return rows.withColumn("turn", F.row_number().over(turn)).where(F.col("turn") <= cap).orderBy("turn", by).limit(target)


def quota_then_fill(rows: DataFrame, by: str, key: str, quota: int, target: int, seed: int = 7) -> DataFrame:
    """``quota`` rows of every group, then the rest in seeded order up to ``target``."""
    ranked = shuffled_rank(rows, [by], key, seed, "_r").withColumn("_d", digest(key, seed))
    return ranked.withColumn("by_quota", F.col("_r") <= quota).orderBy(F.desc("by_quota"), "_d", key).limit(target).drop("_r", "_d")


def balanced(rows: DataFrame, by: str, key: str, target: int, seed: int = 7) -> DataFrame:
    """Rows in turns over the groups, up to ``target``."""
    return shuffled_rank(rows, [by], key, seed, "turn").orderBy("turn", by).limit(target)


def replay_size(patch: int, ratio: float, available: int) -> int:
    """Rows to replay beside ``patch`` new ones for a share of ``ratio``."""
    return min(available, round(patch * ratio / (1 - ratio))) if ratio < 1 else available


def strided(page: Column, head: int, step: int) -> Column:
    """The first ``head`` pages and every ``step``-th after."""
    return (page < head) | ((page - head) % step == 0)
