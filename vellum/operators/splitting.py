"""Splits and samples with budgets, quotas, caps and replacement; seeded orders are MD5 digests, as in ``sampling``.

Where a choice depends on the choices before it, rows are first reduced to one per document; budgets are then met by
rounds of running sums (every round settles all documents up to the next that does not fit), and only the greedy bin
rule passes its one row per source through one task, holding a counter per bin.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.operators.sampling import digest, prefix_sums, shuffled_rank
from vellum.runtime import cut


def within_budget(docs: DataFrame, order: Sequence[Column], doc: str, size: str, budget: int) -> DataFrame:
    """The documents that fit a budget when taken in order, one that does not fit being skipped.

    A round takes the longest beginning that fits, drops what is larger than the rest of the budget and goes on behind.
    """
    left = cut(docs.select(doc, F.col(size).cast("bigint").alias("_size"), F.struct(*order).alias("_at")).where("_size > 0"))
    taken = None
    while budget > 0:
        left = left.where(F.col("_size") <= budget)
        summed = cut(prefix_sums(left, ["_at"], "_size", "_before"))
        fits = summed.where(F.col("_before") + F.col("_size") <= budget)
        # The first that does not fit ends the round; what follows it waits.
        stop = summed.where(F.col("_before") + F.col("_size") > budget).agg(F.min("_at").alias("m")).first()["m"]
        if stop is not None:
            fits = fits.where(F.col("_at") < _literal(stop, summed.schema["_at"].dataType))
        fits = cut(fits.select(doc, "_size"))
        taken = fits if taken is None else taken.unionByName(fits)
        budget -= fits.agg(F.sum("_size")).first()[0] or 0
        if stop is None:
            break
        left = summed.where(F.col("_at") > _literal(stop, summed.schema["_at"].dataType)).select(doc, "_size", "_at")
    return (taken if taken is not None else left.limit(0)).select(doc)


def _literal(row, kind) -> Column:
    return F.struct(*[F.lit(row[f.name]).cast(f.dataType).alias(f.name) for f in kind.fields])


def reserved_documents(docs: DataFrame, doc: str, size: str, worth: str, reserve: int, targets: Sequence[tuple[str, int]], cap: int) -> DataFrame:
    """(doc, split): the ``reserve`` largest documents train; of the rest the worthiest serve each target; the others train.

    A document is worth at most ``cap``; picking for a target stops with the document that reaches it.
    """
    largest = docs.orderBy(F.desc(size), F.desc(doc)).limit(reserve).select(doc)
    left = docs.join(F.broadcast(largest), doc, "left_anti").select(doc, F.least(F.col(worth), F.lit(cap)).cast("bigint").alias("_w"), F.least(F.col(size), F.lit(cap)).alias("_c"), F.col(size).alias("_n"))
    out = largest.select(doc, F.lit("train").alias("split"))
    for split, target in targets:
        order = left.withColumn("_order", F.struct((-F.col("_c")).alias("a"), (-F.col("_n")).alias("b"), F.col(doc).alias("c")))
        summed = cut(prefix_sums(order, ["_order"], "_w", "_before"))
        out = out.unionByName(summed.where((F.col("_before") < target) & (F.col("_w") > 0)).select(doc, F.lit(split).alias("split")))
        left = summed.where((F.col("_before") >= target) | (F.col("_w") <= 0)).select(doc, "_w", "_c", "_n")
    return out.unionByName(left.select(doc, F.lit("train").alias("split")))


def least_filled(sizes: DataFrame, key: str, size: str, bins: Sequence[tuple[str, float]]) -> DataFrame:
    """(key, bin): from large to small to the bin filled least of its share (ties: least filled, then order of bins)."""
    total = sizes.agg(F.sum(size)).first()[0] or 0
    kind = dict(sizes.dtypes)[key]
    goals = [max(1.0, total * share) for _, share in bins]

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [0] * len(bins)
        for b in batches:
            out = []
            for n in b["n"]:
                k = min(range(len(bins)), key=lambda i: (held[i] / goals[i], held[i], i))
                held[k] += n
                out.append(bins[k][0])
            yield pd.DataFrame({key: b[key], "bin": out})

    rows = sizes.select(F.col(key), F.col(size).cast("bigint").alias("n")).repartition(1).sortWithinPartitions(F.desc("n"), key)
    return rows.mapInPandas(deal, f"{key} {kind}, bin string")


def isolated_quotas(rows: DataFrame, key: str, kind: str, doc: str, quotas: dict[str, dict[str, int]], seed: int = 7) -> DataFrame:
    """(key, split): quotas per split and kind, in that order, no document in two splits; shortages are filled regardless.

    Every step takes the first rows in seeded order whose document no other split has; within a step nothing depends on
    the rows before, so it is one anti join and a limit, and what is chosen stays as small as the quotas.
    """
    base = rows.select(F.col(key), F.col(kind).alias("_k"), F.coalesce(doc, F.lit("")).alias("_d")).withColumn("_o", digest(key, seed))
    chosen = cut(base.limit(0).withColumn("split", F.lit("")))
    for split, per in quotas.items():
        for k, quota in per.items():
            elsewhere = chosen.where(F.col("split") != split).select("_d").distinct()
            free = base.where(F.col("_k") == k).join(F.broadcast(chosen.select(key)), key, "left_anti").join(F.broadcast(elsewhere), "_d", "left_anti")
            chosen = cut(chosen.unionByName(free.orderBy("_o", key).limit(quota).withColumn("split", F.lit(split))))
    for split, per in quotas.items():
        have = {r["_k"]: r["n"] for r in chosen.where(F.col("split") == split).groupBy("_k").agg(F.count("*").alias("n")).collect()}  # the kinds of the quotas
        for k, quota in per.items():
            if have.get(k, 0) < quota:
                free = base.where(F.col("_k") == k).join(F.broadcast(chosen.select(key)), key, "left_anti")
                chosen = cut(chosen.unionByName(free.orderBy("_o", key).limit(quota - have.get(k, 0)).withColumn("split", F.lit(split))))
    return chosen.select(key, "split")


def with_replacement(rows: DataFrame, by: str, key: str, counts: dict[str, int], seed: int = 7) -> DataFrame:
    """(by, key, draw): exactly ``counts`` rows of every group that has any, rows repeated in seeded order where it is short."""
    spark = rows.sparkSession
    wanted = spark.createDataFrame(sorted(counts.items()), f"{by} string, _want long")
    ranked = shuffled_rank(rows.select(by, key), [by], key, seed, "_r")
    sizes = ranked.groupBy(by).agg(F.count("*").alias("_n")).join(F.broadcast(wanted), by)
    # A row serves the draws r, r + n, r + 2 n ...; rows beyond the count serve none.
    drawn = ranked.join(F.broadcast(sizes), by).where(F.col("_r") <= F.col("_want"))
    return drawn.select(by, key, F.explode(F.expr("sequence(_r, _want, _n)")).alias("draw"))


def stratified_take(rows: DataFrame, stratum: str, strata: Sequence[str], key: str, limit: int, seed: int = 7) -> DataFrame:
    """Rows of the strata in order, at most an equal share of each, up to ``limit`` (a sampling operator)."""
    share = -(-limit // max(1, len(strata)))
    place = F.array_position(F.array(*map(F.lit, strata)), F.col(stratum))
    ranked = shuffled_rank(rows.where(F.col(stratum).isin(*strata)), [stratum], key, seed, "turn").where(F.col("turn") <= share)
    return ranked.withColumn("_p", place).orderBy("_p", "turn").limit(limit).drop("_p")


def sources_in_turn(rows: DataFrame, source: str, order: Sequence[str], out: str = "place") -> DataFrame:
    """Every row with its place when sources, largest first, give one row per turn."""
    from vellum.operators.sampling import numbered

    sizes = rows.groupBy(F.col(source).alias("_s")).agg(F.count("*").alias("_size"))
    turn = F.row_number().over(Window.partitionBy(source).orderBy(*order))
    turned = rows.withColumn("_turn", turn).join(sizes, F.col(source).eqNullSafe(F.col("_s")), "left").withColumn("_minus", -F.col("_size"))
    return numbered(turned, ["_turn", "_minus", source, *order], out).drop("_turn", "_minus", "_size", "_s")


def audit_sample(rows: DataFrame, bucket: str, key: str, urgent: Column, size: int, seed: int = 7) -> DataFrame:
    """(key, bucket, part): a third of ``size`` from urgent rows, then equal parts of the buckets, then any (a sampling operator)."""
    base = rows.select(F.col(key), F.col(bucket), F.coalesce(urgent, F.lit(False)).alias("_u")).withColumn("_seeded", digest(key, seed))
    first = cut(base.where("_u").orderBy("_seeded", key).limit(size // 3).select(key, bucket, F.lit("urgent").alias("part")))
    rest = base.join(F.broadcast(first.select(key)), key, "left_anti")
    buckets = max(1, base.select(bucket).distinct().count())
    ranked = shuffled_rank(rest, [bucket], key, seed, "_r")
    share = (size - size // 3) // buckets
    second = cut(ranked.where(F.col("_r") <= share).orderBy("_seeded", key).limit(size - size // 3).select(key, bucket, F.lit("bucket").alias("part")))
    got = first.count() + second.count()
    third = rest.join(F.broadcast(second.select(key)), key, "left_anti").orderBy("_seeded", key).limit(max(0, size - got)).select(key, bucket, F.lit("fill").alias("part"))
    return first.unionByName(second).unionByName(third)


def diverse_take(rows: DataFrame, key: str, source: str, same: str, quota: int, seed: int = 7) -> DataFrame:
    """(key): up to ``quota`` rows in seeded order, the first half from different sources, none with the ``same`` of another.

    ``same`` lies within one source. Behind the last row of the first half any row may follow, then the rows before it.
    """
    base = rows.select(key, source, same).withColumn("_at", F.struct(digest(key, seed).alias("a"), F.col(key).alias("b")))
    half = max(1, quota // 2)
    heads = cut(base.groupBy(source).agg(F.min("_at").alias("_at")).orderBy("_at").limit(half).select("_at"))
    last = heads.agg(F.count("*").alias("n"), F.max("_at").alias("m")).first()
    behind = F.col("_at") > _literal(last["m"], base.schema["_at"].dataType) if last["n"] == half else F.lit(False)
    phased = base.join(F.broadcast(heads.withColumn("_head", F.lit(True))), "_at", "left").withColumn("_phase", F.when(F.col("_head"), 0).when(behind, 1).otherwise(2))
    # The first row of every ``same``; one aggregate, no ranking.
    once = phased.groupBy(same).agg(F.min(F.struct("_phase", "_at")).alias("m"))
    return once.orderBy("m").limit(quota).select(F.col("m._at.b").alias(key))


def capped_twice(rows: DataFrame, inner: str, outer: str, order: Sequence[Column], inner_cap: int, outer_cap: int) -> DataFrame:
    """At most ``inner_cap`` rows of every inner group, then ``outer_cap`` of every outer one (the caps are the feature)."""
    kept = rows.withColumn("_i", F.row_number().over(Window.partitionBy(inner).orderBy(*order))).where(F.col("_i") <= inner_cap)
    return kept.withColumn("_o", F.row_number().over(Window.partitionBy(outer).orderBy(*order))).where(F.col("_o") <= outer_cap).drop("_i", "_o")


def jittered(box: Column, key: Column, reach: int, copy: int) -> Column:
    """The box with its corners moved by up to ``reach``, by the digest of key and copy: the same for the same key."""
    d = F.md5(F.concat_ws("|", key, F.lit(str(copy))))
    return F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.get(box, i) + (F.conv(F.substring(d, i * 4 + 1, F.lit(4)), 16, 10).cast("int") % (2 * reach + 1)) - reach)
