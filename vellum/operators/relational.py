"""Joins, aggregates, windows, set operations and top-k that the engine names: thin, planner-friendly compositions.

Nothing here collects, and nothing pins a join strategy; sides are broadcast only by the planner's own size estimate.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.runtime import join_facts


# -- joins ---------------------------------------------------------------------------------------------------------

def alternate_key_join(left: DataFrame, right: DataFrame, keys: Sequence[tuple[str, str]], take: Sequence[str]) -> DataFrame:
    """Left join by the first (left, right) key that finds a row; ``take`` are the right columns, ``matched_by`` the key.

    Right rows must be unique per key (use ``keep_first``); null keys find nothing.
    """
    out, by = left, F.lit(None).cast("string")
    for i, (a, b) in enumerate(keys):
        side = right.where(F.col(b).isNotNull()).select(F.col(b).alias(f"_k{i}"), F.struct(*take).alias(f"_r{i}")).groupBy(f"_k{i}").agg(F.min(f"_r{i}").alias(f"_r{i}"))
        out = out.join(side, F.col(a) == F.col(f"_k{i}"), "left").drop(f"_k{i}")
    hit = F.coalesce(*[F.col(f"_r{i}") for i in range(len(keys))])
    for i in reversed(range(len(keys))):
        by = F.when(F.col(f"_r{i}").isNotNull(), F.lit(keys[i][0])).otherwise(by)
    return out.withColumn("matched_by", by).select(*left.columns, *[hit[c].alias(c if c not in left.columns else f"{c}_found") for c in take], "matched_by")


def override_join(base: DataFrame, overlay: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Left join; overlay values replace the base's where the overlay has a row (``overlaid`` tells)."""
    o = overlay.select(F.col(key).alias("_k"), F.struct(*columns).alias("_o")).dropDuplicates(["_k"])
    joined = base.join(o, base[key] == F.col("_k"), "left")
    return joined.select(*[F.when(F.col("_o").isNotNull(), F.col("_o")[c]).otherwise(base[c]).alias(c) if c in columns else base[c] for c in base.columns], F.col("_o").isNotNull().alias("overlaid"))


def page_window_join(points: DataFrame, pages: DataFrame, by: str, at: str, page: str, width: int) -> DataFrame:
    """Every point with the pages within ``width`` of it: the window is expanded to an equi-join, no range join."""
    wide = points.withColumn("_p", F.explode(F.sequence(F.col(at) - width, F.col(at) + width)))
    p = pages.withColumnsRenamed({by: "_by", page: "_page"})
    return wide.join(p, (F.col(by) == F.col("_by")) & (F.col("_p") == F.col("_page"))).drop("_p", "_by").withColumnRenamed("_page", f"found_{page}")


def pending(rows: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key is not done yet (resume)."""
    return rows.join(done.select(*keys).distinct(), list(keys), "left_anti")


def settled(done: DataFrame, status: str, retry: Sequence[str]) -> DataFrame:
    """Of what was done, all but what is to be tried again."""
    return done.where(~F.col(status).isin(*retry))


# -- first, last, top ----------------------------------------------------------------------------------------------

def keep_first(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, the first in the order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def top_per_group(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows per group with their rank (a top-k report)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def top_per_group_salted(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, salts: int = 32, rank: str = "rank") -> DataFrame:
    """As ``top_per_group`` for hot groups: top k per salted part first, then of those."""
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(salts)))
    part = top_per_group(salted, [*keys, "_salt"], order, k, "_part").drop("_part", "_salt")
    return top_per_group(part, keys, order, k, rank)


def keep_ranked(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], upto: Column, forced: Column) -> DataFrame:
    """The first ``upto`` rows of every key, and those that are forced."""
    ranked = rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.coalesce(forced, F.lit(False)) | (F.col("_rn") <= upto)).drop("_rn")


# -- aggregates ----------------------------------------------------------------------------------------------------

def counts_with_rate(rows: DataFrame, key: str, flag: Column) -> DataFrame:
    """Rows, flagged rows and rate per key."""
    return rows.groupBy(key).agg(F.count("*").alias("n"), F.count_if(flag).alias("flagged"), F.round(F.avg(flag.cast("double")), 6).alias("rate"))


def metric_summary(rows: DataFrame, group: str, metrics: Sequence[str]) -> DataFrame:
    """n, mean, min, max and population deviation of every metric per group (unpivoted, nulls and NaN left out)."""
    long_ = rows.unpivot([group], [*metrics], "metric", "x").where(F.col("x").isNotNull() & ~F.isnan("x"))
    return long_.groupBy(group, "metric").agg(F.count("*").alias("n"), F.round(F.avg("x"), 6).alias("mean"), F.min("x").alias("low"), F.max("x").alias("high"), F.round(F.stddev_pop("x"), 6).alias("deviation"))


def nearest_rank(rows: DataFrame, group: str, value: str, q: float) -> DataFrame:
    """The value at index round((n - 1) q), half-even, of the sorted values, without interpolation.

    Values are counted first, and the running counts go over distinct values: a group of any size is as many rows as it
    has values, and no row of the input is ranked.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("_c"))
    w = Window.partitionBy(group)
    running = counts.withColumn("_upto", F.sum("_c").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))).withColumn("_n", F.sum("_c").over(w))
    at = F.bround((F.col("_n") - 1) * F.lit(q), 0)
    return running.where((F.col("_upto") > at) & (F.col("_upto") - F.col("_c") <= at)).select(group, F.col(value).alias("value"), F.col("_n").alias("n"))


def split_leaks(rows: DataFrame, key: str, split: str = "split") -> DataFrame:
    """Keys that stand in more than one split."""
    return rows.where(F.col(split).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.array_join(F.array_sort(F.collect_set(split)), ",").alias("splits"), F.count_distinct(split).alias("n")).where("n > 1")


def most_common(rows: DataFrame, column: str, n: int) -> DataFrame:
    """The n most frequent values, ties by value (a top-k report)."""
    return rows.groupBy(column).agg(F.count("*").alias("count")).orderBy(F.desc("count"), column).limit(n)


# -- windows -------------------------------------------------------------------------------------------------------

def prefix_states(rows: DataFrame, key: str, order: Sequence[str], value: str, last: int | None = None) -> DataFrame:
    """Every row with what came before it (all, or the last few), as an array."""
    start = Window.unboundedPreceding if last is None else -last
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(start, -1)
    return rows.withColumn("history", F.collect_list(value).over(w))


def normalised_advantages(rows: DataFrame, group: str, value: str, floor: float = 1e-6) -> DataFrame:
    """(x - mean) / population deviation within the group, 0 where the deviation is under ``floor``.

    Mean and deviation are one aggregated row per group; the rows meet them without being gathered by group.
    """
    facts = rows.groupBy(F.col(group).alias("_g")).agg(F.avg(value).alias("_mean"), F.stddev_pop(value).alias("_dev"))
    met = rows.withColumn("_g", F.col(group)).drop(group)
    joined = join_facts(met, facts.where("_g IS NOT NULL"), "_g").withColumnRenamed("_g", group)
    return joined.withColumn("advantage", F.when(F.col("_dev") < floor, F.lit(0.0)).otherwise(F.round((F.col(value) - F.col("_mean")) / F.col("_dev"), 6))).drop("_mean", "_dev")


def owned(rows: DataFrame, group: str, label: str, order: Column) -> DataFrame:
    """Every row with ``owner``: the label of its group's first row; one aggregated row per group is joined back."""
    first = rows.groupBy(group).agg(F.min_by(label, order).alias("owner"))
    return join_facts(rows, first, group)


def strongest_label(rows: DataFrame, keys: Sequence[str], label: str, score: str, order: Sequence[str] = ("support", "wrong_target", "contradict", "weak_support")) -> DataFrame:
    """Per key the first label of ``order`` that any row has, else no_support, and the best score (null counts 0); rows without label are left out."""
    out = F.lit("no_support")
    for name in reversed(order):
        out = F.when(F.bool_or(F.col(label) == name), name).otherwise(out)
    return rows.where(F.col(label).isNotNull()).groupBy(*keys).agg(out.alias("label"), F.max(F.coalesce(score, F.lit(0.0))).alias("best"))


def nested(rows: DataFrame, key: str, columns: Sequence[str], out: str) -> DataFrame:
    """One row per key with an array of structs of its rows (the result is as large as the key's rows; nothing else is)."""
    return rows.groupBy(key).agg(F.collect_list(F.struct(*columns)).alias(out))


def without_repeats(rows: DataFrame, key: str, order: Sequence[str], value: str) -> DataFrame:
    """Rows whose value differs from the one before, renumbered as ``step``."""
    w = Window.partitionBy(key).orderBy(*order)
    kept = rows.withColumn("_b", F.lag(value).over(w)).where(~F.col("_b").eqNullSafe(F.col(value)) | F.col("_b").isNull())
    return kept.drop("_b").withColumn("step", F.row_number().over(w) - 1)


def capped(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], cap: int, salts: int = 32) -> DataFrame:
    """Rows with ``kept``: the first ``cap`` of every key (the cap is the feature).

    A row beyond the cap of its salted part is beyond that of its key; only the first of each part are ranked again.
    """
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(salts)))
    ranked = salted.withColumn("_part", F.row_number().over(Window.partitionBy(*keys, "_salt").orderBy(*order)))
    near = ranked.where(F.col("_part") <= cap).withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return near.withColumn("kept", F.col("_rn") <= cap).drop("_salt", "_part", "_rn").unionByName(ranked.where(F.col("_part") > cap).withColumn("kept", F.lit(False)).drop("_salt", "_part"))


def copies(rows: DataFrame, times: Column) -> DataFrame:
    """Every row ``times`` times with its copy number."""
    return rows.withColumn("copy", F.explode(F.when(times >= 1, F.sequence(F.lit(1), times)).otherwise(F.array().cast("array<int>"))))


def batches(rows: DataFrame, key: str, order: Sequence[str], size: int) -> DataFrame:
    """Rows with the number of their batch of ``size`` in order."""
    return rows.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1) / size))


def neighbours_joined(rows: DataFrame, key: str, order: Sequence[str], text: str) -> DataFrame:
    """Every row's text with the next one and the next two."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("two", F.concat_ws(" ", text, F.lead(text, 1).over(w))).withColumn("three", F.concat_ws(" ", text, F.lead(text, 1).over(w), F.lead(text, 2).over(w)))


# -- sets ----------------------------------------------------------------------------------------------------------

def union_with_origin(parts: dict[str, DataFrame], key: str) -> DataFrame:
    """Union of named parts with their origin; the first part that has a key wins."""
    out = None
    for rank, (name, part) in enumerate(parts.items()):
        p = part.withColumn("origin", F.lit(name)).withColumn("_rank", F.lit(rank))
        out = p if out is None else out.unionByName(p, allowMissingColumns=True)
    best = Window.partitionBy(key).orderBy("_rank", *[c for c in out.columns if c not in ("_rank", "origin", key)])
    return out.withColumn("_rn", F.row_number().over(best)).where("_rn = 1").drop("_rn", "_rank")


def first_origin(parts: dict[str, DataFrame], key: str) -> DataFrame:
    """(key, origin, origins): the first part that has a key, and how many have it; one mergeable aggregate."""
    out = None
    for rank, (name, part) in enumerate(parts.items()):
        p = part.select(key, F.lit(name).alias("_o"), F.lit(rank).alias("_r"))
        out = p if out is None else out.unionByName(p)
    return out.groupBy(key).agg(F.min_by("_o", "_r").alias("origin"), F.count_distinct("_o").alias("origins"))


def changes_between(before: Column, after: Column) -> Column:
    """struct(added, removed) of two arrays as sets, sorted."""
    return F.struct(F.array_sort(F.array_except(after, before)).alias("added"), F.array_sort(F.array_except(before, after)).alias("removed"))


# -- sequences -----------------------------------------------------------------------------------------------------

def matching_prefix(a: Column, b: Column) -> Column:
    """How many leading elements two arrays share."""
    same = F.transform(F.arrays_zip(a.alias("x"), b.alias("y")), lambda z: z["x"] == z["y"])
    first = F.array_position(F.transform(same, lambda s: F.coalesce(s, F.lit(False))), F.lit(False))
    return F.when(first > 0, first - 1).otherwise(F.size(same).cast("bigint"))


def inserted_after_first(rows: DataFrame, key: str, order: Sequence[str], match: Column, values: dict[str, Column]) -> DataFrame:
    """A copy of the first matching row of every key, with ``values`` set, inserted behind it; rows renumbered as ``step``."""
    first = keep_first(rows.where(match), [key], [F.col(c) for c in order])
    extra = first.withColumns(values).withColumn("_o", F.lit(1))
    w = Window.partitionBy(key).orderBy(*order, "_o")
    return rows.withColumn("_o", F.lit(0)).unionByName(extra).withColumn("step", F.row_number().over(w) - 1).drop("_o")


def paired_delta(rows: DataFrame, before: str, after: str) -> DataFrame:
    """Pairs, mean difference, and how many fell and rose."""
    b, a = F.col(before), F.col(after)
    return rows.agg(F.count("*").alias("pairs"), F.round(F.avg(a - b), 6).alias("mean_delta"), F.count_if(a < b).alias("lower"), F.count_if(a > b).alias("higher"))
