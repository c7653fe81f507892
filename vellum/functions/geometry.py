"""Boxes [x1, y1, x2, y2] as column expressions: validity, scales, overlaps, distances."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def valid(box: Column) -> Column:
    """Four coordinates, not degenerate; null counts as invalid."""
    return F.coalesce((F.size(box) == 4) & (box[2] > box[0]) & (box[3] > box[1]), F.lit(False))


def coerced(box: Column) -> Column:
    """Half-even rounded integers, null when invalid."""
    whole = F.transform(box, lambda v: F.bround(v.cast("double"), 0).cast("int"))
    return F.when(valid(whole), whole)


def area(box: Column) -> Column:
    """Area of a valid box, else 0."""
    return F.when(valid(box), (box[2] - box[0]).cast("double") * (box[3] - box[1])).otherwise(F.lit(0.0))


def intersection(a: Column, b: Column) -> Column:
    w = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    h = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    return F.when(valid(a) & valid(b) & (w > 0) & (h > 0), w.cast("double") * h).otherwise(F.lit(0.0))


def iou(a: Column, b: Column, invalid: float = 0.0) -> Column:
    """Intersection over union; ``invalid`` where a box is not valid (-1 means not scored)."""
    both = intersection(a, b)
    return F.when(valid(a) & valid(b), both / (area(a) + area(b) - both)).otherwise(F.lit(invalid))


def overlap_of_smaller(a: Column, b: Column) -> Column:
    """Intersection over the smaller area, 0 for invalid boxes."""
    return F.when(valid(a) & valid(b), intersection(a, b) / F.least(area(a), area(b))).otherwise(F.lit(0.0))


def coverage(box: Column, part: Column) -> Column:
    """Share of ``part`` inside ``box``."""
    return intersection(box, part) / F.greatest(F.lit(1.0), area(part))


def norm1000(box: Column, width: Column, height: Column) -> Column:
    """Pixels to thousandths of the page, half-even; null for pages without size."""
    sides = F.array(width, height, width, height)
    scaled = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.bround(F.get(box, i) * F.lit(1000.0) / F.get(sides, i), 0).cast("int"))
    return F.when((F.size(box) == 4) & (width > 0) & (height > 0), scaled)


def pixels(box: Column, width: Column, height: Column) -> Column:
    """Thousandths of the page to pixels, half-even."""
    sides = F.array(width, height, width, height)
    return F.when(F.size(box) == 4, F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.bround(F.get(box, i) * F.get(sides, i) / F.lit(1000.0), 0).cast("int")))


def clamped(box: Column, width: Column, height: Column) -> Column:
    """Coordinates cut to the page."""
    sides = F.array(width, height, width, height)
    return F.when(F.size(box) == 4, F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.least(F.greatest(F.get(box, i), F.lit(0)), F.get(sides, i))))


def caption_gap(figure: Column, caption: Column) -> Column:
    """(position, gap): the caption is below, above or overlapping, and how far away (8 units of tolerance)."""
    below, above = caption[1] >= figure[3] - 8, caption[3] <= figure[1] + 8
    return F.struct(
        F.when(below, "below").when(above, "above").otherwise("overlap").alias("position"),
        F.when(below, F.greatest(F.lit(0.0), caption[1] - figure[3])).when(above, F.greatest(F.lit(0.0), figure[1] - caption[3])).otherwise(F.lit(0.0)).alias("gap"),
    )


def horizontal_share(figure: Column, caption: Column) -> Column:
    """Horizontal overlap over the figure's width."""
    shared = F.greatest(F.lit(0.0), F.least(figure[2], caption[2]) - F.greatest(figure[0], caption[0]))
    return shared / F.greatest(F.lit(1.0), (figure[2] - figure[0]).cast("double"))


def page_distance(page: Column, start: Column, end: Column) -> Column:
    """0 inside [start, end], else the distance; the end defaults to the start."""
    last = F.coalesce(end, start)
    return F.when(page.isNull() | start.isNull(), F.lit(None).cast("int")).when(page < start, start - page).when(page > last, page - last).otherwise(F.lit(0))


def coordinate_modes(box: Column, norm: Column, width: Column, height: Column) -> Column:
    """array(struct(mode, distance)): how far a box, read as pixels, thousandths or pixels with axes swapped, is from the known one."""
    sides = (width, height, width, height)

    def away(at: tuple, scaled: bool) -> Column:
        return sum((F.abs((box[i] * 1000.0 / sides[i] if scaled else box[i]) - norm[k]) for k, i in enumerate(at)), F.lit(0.0))

    return F.array(
        F.struct(F.lit("pixels").alias("mode"), away((0, 1, 2, 3), True).alias("distance")),
        F.struct(F.lit("norm1000").alias("mode"), away((0, 1, 2, 3), False).alias("distance")),
        F.struct(F.lit("swapped").alias("mode"), away((1, 0, 3, 2), True).alias("distance")),
    )


def scale_suspicions(target: Column, caption: Column, width: Column, height: Column) -> Column:
    """Reasons why pixel boxes may have been read as thousandths: their areas would be far larger; fixed limits."""
    def raw(b):
        return (b[2] - b[0]).cast("double") * (b[3] - b[1]) / (width.cast("double") * height)

    def norm(b):
        c = F.transform(b, lambda v: F.least(v, F.lit(1000)))
        return (c[2] - c[0]).cast("double") * (c[3] - c[1]) / 1_000_000.0

    named = F.size(caption) == 4
    return F.array_compact(F.array(
        F.when(named & (raw(caption) > 0) & (norm(caption) > raw(caption) * 1.45) & (norm(caption) > 0.01), F.lit("caption_larger")),
        F.when((norm(target) > 0.35) & (raw(target) > 0.01) & (norm(target) > raw(target) * 1.45), F.lit("target_larger")),
    ))
