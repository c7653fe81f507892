"""Joins that look for the right partner: defaults, fallbacks, nearest boxes, positions, hard negatives, siblings.

All are equi-joins followed by an aggregate that keeps the best partner; nothing is compared beyond its page, source or
key. Ties go to the smaller partner key. Null keys find nothing; pages without a partner give no row unless said.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions import geometry as G
from vellum.functions import text as T


def join_with_default(left: DataFrame, right: DataFrame, key: tuple[str, str], default: dict[str, Column]) -> DataFrame:
    """Left join; where nothing is found the right columns take ``default`` (``found`` tells)."""
    a, b = key
    side = right.where(F.col(b).isNotNull()).groupBy(F.col(b).alias("_k")).agg(F.min(F.struct(*default)).alias("_r"))
    return left.join(side, F.col(a) == F.col("_k"), "left").select(*left.columns, *[F.when(F.col("_r").isNull(), d).otherwise(F.col("_r")[c]).alias(c) for c, d in default.items()], F.col("_r").isNotNull().alias("found"))


def best_partner(left: DataFrame, right: DataFrame, on: tuple[str, str], left_key: str, right_key: str, score: Column, least: float | None = None) -> DataFrame:
    """(left_key, right_key, score): per left row the right row of the same ``on`` with the highest score.

    ``score`` may use the columns of both sides; null scores are no candidates, nor are scores under ``least``.
    """
    j = left.join(right, F.col(on[0]) == F.col(on[1])).withColumn("_s", F.round(score, 6)).where("_s IS NOT NULL")
    if least is not None:
        j = j.where(F.col("_s") >= least)
    # The smaller partner key wins ties.
    best = j.groupBy(left_key).agg(F.min(F.struct((-F.col("_s")).alias("s"), F.col(right_key).alias("k"))).alias("m"))
    return best.select(left_key, F.col("m.k").alias(right_key), (-F.col("m.s")).alias("score"))


def link_score(figure: Column, caption: Column, text: Column) -> Column:
    """How well a caption box fits a figure box: below is best, near, centred, starting like a caption; null beyond reach."""
    width = F.greatest(F.lit(1.0), (figure[2] - figure[0]).cast("double"))
    overlap = F.greatest(F.lit(0.0), F.least(figure[2], caption[2]) - F.greatest(figure[0], caption[0])) / width
    shift = F.least(F.lit(1.0), F.abs((figure[0] + figure[2]) / 2 - (caption[0] + caption[2]) / 2) / width)
    g = G.caption_gap(figure, caption)
    place = F.when(g["position"] == "below", 1.0).when(g["position"] == "above", -0.35).otherwise(-0.2)
    like = F.when(T.starts_with_marker(F.substring(text, 1, 40)), 0.35).otherwise(0.0)
    score = 1.8 * F.least(F.lit(1.0), overlap) + place + like - shift - g["gap"] / 500.0
    return F.when(G.valid(figure) & G.valid(caption) & (overlap > 0.15) & (g["gap"] <= 420), score)


def block_score(figure: Column, block: Column, text: Column) -> Column:
    """As ``link_score`` for raw text blocks: bonuses for what stands just below or above, titles and picture words."""
    fw, bw = (figure[2] - figure[0]).cast("double"), (block[2] - block[0]).cast("double")
    across = F.greatest(F.lit(0.0), F.least(figure[2], block[2]) - F.greatest(figure[0], block[0])) / F.greatest(F.lit(1.0), F.least(F.greatest(F.lit(1.0), fw), bw))
    below, above = block[1] - figure[3], figure[1] - block[3]
    t = T.normal_space(F.coalesce(text, F.lit("")))
    yes = lambda c, v: F.when(c, F.lit(v)).otherwise(F.lit(0.0))
    score = (
        across * 2.0 - F.least(F.abs(below), F.abs(above)) / 120.0 + yes(below.between(0, 180), 3.5) + yes(above.between(0, 120), 1.2)
        + yes(T.starts_with_marker(F.substring(t, 1, 80)), 4.0) + yes(F.contains(t, F.lit("《")) & F.contains(t, F.lit("》")), 1.2)
        + yes(F.contains(t, F.lit("山水")) | F.contains(t, F.lit("画")), 0.8) - yes(F.length(t) > 260, 2.0) - yes(across < 0.08, 2.0)
    )
    return F.when(G.valid(figure) & G.valid(block), score)


def reading_score(figure: Column, text_box: Column) -> Column:
    """Geometry alone in [0, 1]: horizontal share, vertical nearness, a little for the side."""
    shared = F.greatest(F.lit(0.0), F.least(figure[2], text_box[2]) - F.greatest(figure[0], text_box[0]))
    share = shared / F.greatest(F.lit(1.0), F.least(figure[2] - figure[0], text_box[2] - text_box[0]).cast("double"))
    gap = F.when(text_box[1] >= figure[3], text_box[1] - figure[3]).when(text_box[3] <= figure[1], figure[1] - text_box[3]).otherwise(0)
    side = F.when(text_box[1] >= figure[3], 0.12).when(text_box[3] <= figure[1], 0.04).otherwise(0.06)
    score = F.least(F.lit(1.0), 0.58 * share + 0.30 * F.greatest(F.lit(0.0), 1 - gap / 520.0) + side)
    return F.when(G.valid(figure) & G.valid(text_box), F.when((gap > 520) & (share < 0.35), 0.0).otherwise(score)).otherwise(F.lit(0.0))


def best_text_and_place(figures: DataFrame, texts: DataFrame, on: str, figure: str, text: str) -> DataFrame:
    """(figure, text, score): .55 likeness of the texts + .45 geometry; figures have (on, box, caption), texts (on, text_box, words).

    Likeness needs a sequence matcher, so it runs on Arrow batches, after geometry has left out what cannot match.
    """
    r = texts.withColumnsRenamed({on: "_on", "box": "text_box"})
    j = figures.join(r, F.col(on) == F.col("_on")).withColumn("_g", reading_score(F.col("box"), F.col("text_box"))).withColumn("_t", T.likeness("caption", "words"))
    j = j.where((F.col("_t") >= 0.08) & ((F.col("_g") > 0) | (F.col("_t") >= 0.95))).withColumn("_s", F.round(0.55 * F.col("_t") + 0.45 * F.col("_g"), 6))
    best = j.groupBy(figure).agg(F.min(F.struct((-F.col("_s")).alias("s"), F.col(text).alias("k"))).alias("m"))
    return best.select(figure, F.col("m.k").alias(text), (-F.col("m.s")).alias("score"))


def position_of_value(rows: DataFrame, arrays: DataFrame, key: str, value: str, array: str) -> DataFrame:
    """Every row with ``index``: where its value first stands in its key's array (null-safe), null where it does not."""
    places = arrays.select(F.col(key).alias("_k"), F.posexplode(array).alias("_i", "_v")).groupBy("_k", "_v").agg(F.min("_i").alias("index"))
    return rows.join(places, (F.col(key) == F.col("_k")) & F.col(value).eqNullSafe(F.col("_v")), "left").drop("_k", "_v")


def by_running_count(items: DataFrame, item_order: Sequence[str], steps: DataFrame, step: str, count: str) -> DataFrame:
    """Items handed out in order to steps that take ``count`` each; what is left over has no step.

    The steps' running totals become ranges; items are numbered without a single-task window and meet their step by
    explode and equality, since a step's range is as long as its count.
    """
    from vellum.operators.sampling import numbered, prefix_sums

    ranges = prefix_sums(steps.select(step, F.col(count).cast("bigint").alias("_c")), [step], "_c", "_from")
    taken = ranges.where("_c > 0").select(step, F.explode(F.sequence(F.col("_from") + 1, F.col("_from") + F.col("_c"))).alias("_n"))
    return numbered(items, item_order, "_n").join(taken, "_n", "left").drop("_n")


def hard_negatives(anchors: DataFrame, pool: DataFrame, by: str, key: str, other: str, allowed: Column, order: Sequence[Column], n: int) -> DataFrame:
    """(key, other, rank): up to ``n`` rows of the same ``by`` that are not allowed for the anchor (the count is the feature)."""
    p = pool.where(~F.coalesce(allowed, F.lit(False))).withColumnRenamed(by, "_by")
    # The best of every group are enough for all its anchors.
    few = p.withColumn("rank", F.row_number().over(Window.partitionBy("_by").orderBy(*order))).where(F.col("rank") <= n).select("_by", other, "rank")
    return anchors.join(few, F.col(by) == F.col("_by")).select(key, other, "rank")


def first_other(rows: DataFrame, group: str, key: str, differ: Sequence[str]) -> DataFrame:
    """(key, sibling): the smallest other key of the group that differs in all of ``differ`` (null equals null)."""
    left = rows.select(group, key, *differ).distinct()
    right = left.select(F.col(group).alias("_g"), F.col(key).alias("sibling"), *[F.col(c).alias(f"_{c}") for c in differ])
    apart = F.col(key) != F.col("sibling")
    for c in differ:
        apart = apart & ~F.col(c).eqNullSafe(F.col(f"_{c}"))
    return left.join(right, F.col(group) == F.col("_g")).where(apart).groupBy(key).agg(F.min("sibling").alias("sibling"))


def resolved(rows: DataFrame, authorities: DataFrame, keys: Sequence[Column], take: str) -> DataFrame:
    """Rows with the authority of the first of ``keys`` that names one; ``authorities`` has (authority_key, take)."""
    names = F.array_compact(F.array(*keys))
    tried = rows.withColumn("_id", F.monotonically_increasing_id()).select("*", F.posexplode_outer(names).alias("_p", "_k"))
    side = authorities.groupBy(F.col("authority_key").alias("_a")).agg(F.min(take).alias("_t"))
    met = tried.join(side, F.col("_k") == F.col("_a"), "left")
    return met.groupBy(*rows.columns).agg(F.min_by("_t", F.when(F.col("_t").isNotNull(), F.col("_p"))).alias(take))
