"""Reports over predictions, rankings and runs: counts with their rates, as one or two mergeable aggregates each.

Defined results: nulls are left out where a docstring says so and count as 0 or false elsewhere; denominators are at
least 1, so empty groups score 0; empty tables give no group (whole-table summaries give one row of zeros).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions.measures import f1


def _rate(part: Column, whole: Column) -> Column:
    return F.round(part / F.greatest(F.lit(1), whole), 6)


def map_sums(rows: DataFrame, group: str, counters: str) -> DataFrame:
    """(group, key, total): map-valued counters summed per key."""
    return rows.select(group, F.explode(counters).alias("key", "_v")).groupBy(group, "key").agg(F.sum("_v").alias("total"))


def claim_scores(rows: DataFrame, keys: Sequence[str], field: str, cited: Column, label: Column) -> DataFrame:
    """Per field and in total ('all'): micro precision, recall and F1 of claims, and rates of the evidence cited.

    A claim (``keys``) is written when any evidence of it is cited, and right when any of its evidence supports it.
    """
    marked = rows.withColumn("_c", F.coalesce(cited, F.lit(False))).withColumn("_l", label)
    support = F.col("_l").eqNullSafe(F.lit("support"))
    claims = marked.groupBy(field, *keys).agg(
        F.bool_or("_c").alias("written"), F.bool_or(support).alias("gold"), F.bool_or(support & F.col("_c")).alias("both"),
        F.count_if("_c").alias("cited"), F.count_if(F.col("_c") & support).alias("positive"), F.count_if(support).alias("known"),
        *[F.count_if(F.col("_c") & (F.col("_l") == v)).alias(v) for v in ("wrong_target", "ambiguous", "no_support")], F.count_if(F.col("_c") & F.col("_l").isNotNull()).alias("labelled"),
    )
    sums = claims.groupBy(field).agg(
        F.count_if(F.col("written") & F.col("both")).alias("tp"), F.count_if(F.col("written") & ~F.col("both")).alias("fp"), F.count_if(F.col("gold") & ~F.col("both")).alias("fn"),
        *[F.sum(c).alias(c) for c in ("cited", "positive", "known", "wrong_target", "ambiguous", "no_support", "labelled")],
    )
    counts = [c for c in sums.columns if c != field]
    both = sums.unionByName(sums.agg(*[F.sum(c).alias(c) for c in counts]).select(F.lit("all").alias(field), *counts))
    p, r = F.col("tp") / F.greatest(F.lit(1), F.col("tp") + F.col("fp")), F.col("tp") / F.greatest(F.lit(1), F.col("tp") + F.col("fn"))
    return both.select(
        field, "tp", "fp", "fn", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(f1(p, r), 6).alias("f1"), "cited",
        _rate(F.col("positive"), F.col("cited")).alias("cited_precision"), _rate(F.col("positive"), F.col("known")).alias("cited_recall"),
        *[_rate(F.col(c), F.col("cited")).alias(f"{c}_rate") for c in ("wrong_target", "ambiguous", "no_support", "labelled")],
    )


def label_report(rows: DataFrame, gold: Column, predicted: Column) -> DataFrame:
    """Per label and in total ('all'): rows, hits, precision, recall, F1; rows without a gold label are left out."""
    pairs = rows.select(gold.alias("g"), predicted.alias("p")).where("g IS NOT NULL").groupBy("g", "p").agg(F.count("*").alias("n"))
    sides = pairs.select(F.explode(F.array(F.struct(F.col("g").alias("label"), F.col("n").alias("gold"), F.lit(0).cast("bigint").alias("said"), F.when(F.col("g").eqNullSafe(F.col("p")), F.col("n")).otherwise(0).alias("hit")), F.struct(F.col("p").alias("label"), F.lit(0).cast("bigint").alias("gold"), F.col("n").alias("said"), F.lit(0).cast("bigint").alias("hit")))).alias("z")).select("z.*").where("label IS NOT NULL")
    per = sides.groupBy("label").agg(*[F.sum(c).alias(c) for c in ("gold", "said", "hit")])
    both = per.unionByName(per.agg(*[F.sum(c).alias(c) for c in ("gold", "said", "hit")]).select(F.lit("all").alias("label"), "gold", "said", "hit"))
    p, r = F.col("hit") / F.greatest(F.lit(1), F.col("said")), F.col("hit") / F.greatest(F.lit(1), F.col("gold"))
    return both.select("label", "gold", "said", "hit", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(f1(p, r), 6).alias("f1"))


def scope_stats(calls: DataFrame, scope: str, results: str, gold: str) -> DataFrame:
    """Per scope: calls, calls with a result, calls with a gold result."""
    hit = F.arrays_overlap(F.coalesce(results, F.array().cast("array<string>")), F.coalesce(gold, F.array().cast("array<string>")))
    return calls.groupBy(scope).agg(F.count("*").alias("calls"), F.count_if(F.size(results) > 0).alias("filled"), F.count_if(F.coalesce(hit, F.lit(False))).alias("hits"))


def rank_pollution(results: DataFrame, classes: DataFrame, call: Sequence[str], item: str, top: int = 5) -> DataFrame:
    """Per rank up to ``top``: results, noisy ones, ones the index lacks; as rank 0 the calls, those with noise first and anywhere.

    ``results`` has a rank column; ``classes`` one row (item, noisy) per indexed item.
    """
    seen = results.where(F.col("rank") <= top).join(classes.select(item, F.col("noisy").alias("_n")), item, "left").withColumn("_noisy", F.coalesce("_n", F.lit(False)))
    ranks = seen.groupBy(F.col("rank").cast("int").alias("rank")).agg(F.count("*").alias("results"), F.count_if("_noisy").alias("noisy"), F.count_if(F.col("_n").isNull()).alias("missing"))
    calls = seen.groupBy(*call).agg(F.bool_or(F.col("_noisy") & (F.col("rank") == 1)).alias("first"), F.bool_or("_noisy").alias("any"))
    return ranks.unionByName(calls.agg(F.count("*").alias("results"), F.count_if("first").alias("noisy"), F.count_if("any").alias("missing")).select(F.lit(0).alias("rank"), "results", "noisy", "missing"))


def threshold_rates(rows: DataFrame, best: str, first: str, at: Sequence[float] = (0.5, 0.7)) -> DataFrame:
    """One row: tasks, and the share whose best and whose first value reaches every threshold (null never does)."""
    out = [F.count("*").alias("tasks")]
    for name in (best, first):
        out += [F.round(F.avg(F.coalesce((F.col(name) >= t), F.lit(False)).cast("double")), 6).alias(f"{name}_{round(t * 100)}") for t in at]
    return rows.agg(*out)


def process_profile(steps: DataFrame, key: str, step: str, action: str, read: str, write: str) -> DataFrame:
    """Per sequence: steps, first reading and writing step, writings before any reading, whether it ever did both."""
    first = {a: F.min(F.when(F.col(action) == a, F.col(step))) for a in (read, write)}
    heads = steps.groupBy(key).agg(F.count("*").alias("steps"), first[read].alias("first_read"), first[write].alias("first_write"))
    early = steps.where(F.col(action) == write).join(heads.select(key, "first_read"), key).where(F.col("first_read").isNull() | (F.col(step) < F.col("first_read"))).groupBy(key).agg(F.count("*").alias("early"))
    return heads.join(early, key, "left").select(key, "steps", "first_read", "first_write", F.coalesce("early", F.lit(0)).alias("early_writes"), (F.col("first_read").isNotNull() & F.col("first_write").isNotNull()).alias("both"))


def manifest(parts: dict[str, DataFrame]) -> DataFrame:
    """(relation, rows) of several relations."""
    out = None
    for name, part in parts.items():
        one = part.agg(F.count("*").alias("rows")).select(F.lit(name).alias("relation"), "rows")
        out = one if out is None else out.unionByName(one)
    return out
