"""Set measures and small arithmetic used by reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def f1(precision: Column, recall: Column) -> Column:
    """0 when either is 0."""
    return F.when((precision <= 0) | (recall <= 0), F.lit(0.0)).otherwise(2 * precision * recall / F.greatest(F.lit(1e-12), precision + recall))


def set_scores(predicted: Column, gold: Column, empty_is_one: bool = False) -> Column:
    """struct(precision, recall, f1) of two arrays as sets.

    Empty sets score 0 (denominators of at least 1), or, with ``empty_is_one``, 1 when both are empty.
    """
    p, g = F.array_distinct(F.coalesce(predicted, F.array().cast("array<string>"))), F.array_distinct(F.coalesce(gold, F.array().cast("array<string>")))
    hit = F.size(F.array_intersect(p, g))
    precision, recall = hit / F.greatest(F.lit(1), F.size(p)), hit / F.greatest(F.lit(1), F.size(g))
    if empty_is_one:
        both = (F.size(p) == 0) & (F.size(g) == 0)
        precision, recall = F.when(both, 1.0).otherwise(precision), F.when(both, 1.0).otherwise(recall)
    return F.struct(precision.alias("precision"), recall.alias("recall"), f1(precision, recall).alias("f1"))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def first_filled(*options: Column) -> Column:
    """The first option that is neither null nor empty."""
    return F.coalesce(*[F.nullif(o, F.lit("")) for o in options])


def confidence_bucket(x: Column) -> Column:
    """[.9,1], [.75,.9), [.5,.75), [0,.5); null stays out as 'none'."""
    return F.when(x.isNull(), "none").when(x >= 0.9, "0.90-1.00").when(x >= 0.75, "0.75-0.89").when(x >= 0.5, "0.50-0.74").otherwise("0.00-0.49")


def stable_id(prefix: str, *parts: Column, length: int = 20) -> Column:
    """prefix + the first characters of the SHA-1 of the parts joined by '|'; null parts are skipped."""
    return F.concat(F.lit(prefix), F.substring(F.sha1(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, length))
