"""Quantities recorded in different units: every size in millimetres.

1. Each record yields *measures*: the size as its value states it, restatements in brackets, and the size in the
   caption, each with the unit notation it was written in ('' where no unit stands beside it).
2. Measures of the same entity under two notations are links. A link's scale is the log ratio of the two sizes; per
   pair of notations a robust median with its spread is taken over all records (one shuffled aggregate).
3. Medians are snapped to known conversions and propagated over the graph of notations from millimetres outwards.
4. Unlabelled sizes take the scale of their own record (reason or caption); beyond that, per source file, the scale
   (and offset, where the ratios disagree) that links their titles' sizes to those of resolved sources, propagated
   from the labelled ones until no source is added.

Defined results: null or empty values, 'not measured' and the like give no measure; a size without any unit in its
record gives no row in ``found_sizes`` and at most an inferred one in ``harmonised_sizes``; repeated rows count once;
several different rows of one key give the size of the smallest (value, reason, caption).
"""

from __future__ import annotations

import math
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.runtime import cut, stored

#: Millimetres per unit, by the notation of the unit (lower case, no final stop).
UNIT_MM = {
    "mm": 1.0, "millimetres": 1.0, "millimeters": 1.0, "millimetre": 1.0, "millimeter": 1.0, "millimetern": 1.0, "毫米": 1.0,
    "cm": 10.0, "centimetres": 10.0, "centimeters": 10.0, "centimetre": 10.0, "centimeter": 10.0, "zentimetern": 10.0, "zentimeter": 10.0, "厘米": 10.0, "公分": 10.0,
    "dm": 100.0, "m": 1000.0, "metres": 1000.0, "meters": 1000.0, "metre": 1000.0, "meter": 1000.0, "米": 1000.0,
    "in": 25.4, "inch": 25.4, "inches": 25.4, "zoll": 25.4, '"': 25.4, "″": 25.4, "”": 25.4, "英寸": 25.4,
    "ft": 304.8, "foot": 304.8, "feet": 304.8, "'": 304.8, "′": 304.8, "英尺": 304.8,
}
#: Scales between units that a measured ratio may snap to.
KNOWN_SCALES = sorted({a / b for a in (1.0, 10.0, 100.0, 1000.0, 25.4, 304.8) for b in (1.0, 10.0, 100.0, 1000.0, 25.4, 304.8)})
#: A median log ratio snaps to a known scale within this distance (about 3 %).
SNAP_TOLERANCE = 0.03
#: Links a source needs before a scale is inferred for its unlabelled sizes.
MIN_LINKS = 3

_FRACTIONS = {"¼": 1 / 4, "½": 1 / 2, "¾": 3 / 4, "⅐": 1 / 7, "⅑": 1 / 9, "⅒": 1 / 10, "⅓": 1 / 3, "⅔": 2 / 3, "⅕": 1 / 5, "⅖": 2 / 5, "⅗": 3 / 5, "⅘": 4 / 5, "⅙": 1 / 6, "⅚": 5 / 6, "⅛": 1 / 8, "⅜": 3 / 8, "⅝": 5 / 8, "⅞": 7 / 8}
_VULGAR = "".join(_FRACTIONS)
_NUMBER = rf"(?:\d+(?:[.,]\d+)?(?:[ -]\d+/\d+| ?[{_VULGAR}])?|\d+/\d+|[{_VULGAR}])"
_NUMBER_ALT = rf"(?:\d+[ -]\d+/\d+|\d+ ?[{_VULGAR}]|\d+/\d+|\d+(?:[.,]\d+)?|[{_VULGAR}])"
_UNIT = "|".join(sorted((re.escape(u) for u in UNIT_MM if not u.isalpha() or not u.isascii()), key=len, reverse=True)) + "|" + "|".join(
    rf"{u}(?![A-Za-z])" for u in sorted((u for u in UNIT_MM if u.isalpha() and u.isascii()), key=len, reverse=True)
)
_ONE = rf"(?P<{{p}}>{_NUMBER_ALT})\s*(?P<{{p}}u>{_UNIT})?\.?(?:\s*(?P<{{p}}i>{_NUMBER_ALT})\s*(?P<{{p}}iu>in(?:ch(?:es)?)?(?![A-Za-z])|\"|″|英寸)\.?)?"


def _one(p: str) -> str:
    return _ONE.format(p=p)


_LABEL_H = r"(?:\bheight|\bhigh|\bhöhe|\bh\b\.?|高|纵|縱)"
_LABEL_W = r"(?:\bwidth|\bwide|\bbreite|\bw\b\.?|\bb\b\.?|宽|寬|横|橫)"
_HW = re.compile(rf"{_LABEL_H}\s*[:=]?\s*{_one('a')}\W{{0,4}}{_LABEL_W}\s*[:=]?\s*{_one('b')}", re.I)
_WH = re.compile(rf"{_LABEL_W}\s*[:=]?\s*{_one('b')}\W{{0,4}}{_LABEL_H}\s*[:=]?\s*{_one('a')}", re.I)
_BY = re.compile(rf"{_one('a')}\s*(?:[x×*✕]|by|mal)\s*{_one('b')}(?P<more>\s*(?:[x×*✕]|by)\s*{_one('c')})?", re.I)
_DIAM = re.compile(rf"(?:\bdiam(?:eter|\.)?|\bdurchmesser|ø|⌀|直径|直徑|径)\s*[:=]?\s*{_one('a')}", re.I)


def _number(text: str) -> float:
    text = text.strip().replace(",", ".")
    total = 0.0
    for f, v in _FRACTIONS.items():
        if f in text:
            total += v
            text = text.replace(f, " ")
    for m in re.findall(r"(\d+)/(\d+)", text):
        total += int(m[0]) / int(m[1]) if int(m[1]) else 0.0
    rest = re.sub(r"\d+/\d+", " ", text).replace("-", " ").strip()
    return total + (float(rest.split()[0]) if rest else 0.0)


def _side(m: re.Match, p: str) -> tuple[float, str]:
    n, u = _number(m[p]), (m[p + "u"] or "").lower()
    if m[p + "i"]:
        # Feet with inches behind: the whole measure in feet.
        n += _number(m[p + "i"]) / 12.0
    return n, u


def first_size(text: str | None) -> tuple[float, float, str, str, int] | None:
    """(height, width, unit of height, unit of width, end) of the first size in a text."""
    if not text:
        return None
    found = []
    for kind, rx in (("hw", _HW), ("wh", _WH), ("by", _BY), ("diam", _DIAM)):
        if m := rx.search(text):
            found.append((m.start(), {"hw": 0, "wh": 1, "diam": 2, "by": 3}[kind], kind, m))
    if not found:
        return None
    _, _, kind, m = min(found, key=lambda x: x[:2])
    a, ua = _side(m, "a")
    if kind == "diam":
        return a, a, ua, ua, m.end()
    b, ub = _side(m, "b")
    if kind == "by" and not ub and m["more"]:
        ub = (m["cu"] or "").lower()
    ua, ub = ua or ub, ub or ua
    return a, b, ua, ub, m.end()


_NAMED = re.compile(rf"(?<![A-Za-z])(?:{_UNIT})", re.I)


def named_unit(text: str | None) -> str:
    """The unit a remark names, '' if none or more than one kind."""
    if not text:
        return ""
    words = [u.lower() for u in _NAMED.findall(text) if u.lower() not in ("in", "m", "'", '"', "”")]
    return words[0] if words and len({UNIT_MM[u] for u in words}) == 1 else ""


def measures_of(value, reason, caption) -> list[tuple[str, float, float, str, str]]:
    """(role, height, width, height's unit, width's unit) of a record's sizes; role: value, restated, caption."""
    first = first_size(value)
    if not first:
        return []
    h, w, uh, uw, end = first
    out = []
    if not uh and (r := named_unit(reason)):
        uh = uw = r
    out.append(("value", h, w, uh, uw))
    if (again := first_size(value[end:])) and again[2]:
        out.append(("restated", *again[:4]))
    best = None
    rest, at = caption or "", 0
    while (c := first_size(rest[at:])) is not None:
        # The caption may hold more than one size; the one that fits the value is meant.
        if best is None or (not best[2] and c[2]) or (abs(c[0] - h) < 1e-6 and abs(c[1] - w) < 1e-6):
            best = c
        at += c[4]
    if best and best[2]:
        out.append(("caption", *best[:4]))
    return out


_MEASURE = T.ArrayType(T.StructType([T.StructField(n, t) for n, t in zip(("role", "h", "w", "uh", "uw"), (T.StringType(), T.DoubleType(), T.DoubleType(), T.StringType(), T.StringType()))]))


@F.pandas_udf(_MEASURE)
def _measures(value: pd.Series, reason: pd.Series, caption: pd.Series) -> pd.Series:
    return pd.Series([[dict(zip(("role", "h", "w", "uh", "uw"), m)) for m in measures_of(v, r, c)] for v, r, c in zip(value, reason, caption)])


def size_records(targets: DataFrame) -> DataFrame:
    """One row per target that states a size: its measures beside source and title."""
    base = file_key(F.col("source_file"))
    rows = targets.where(F.col("target_id").isNotNull()).select(
        "target_id",
        base.alias("source"),
        F.lower(F.col("base_fields")["depicted_work_title"]).alias("title"),
        F.col("metadata_fields")["dimensions"]["value"].alias("value"),
        F.col("metadata_fields")["dimensions"]["reason"].alias("reason"),
        F.col("base_fields")["caption_text"].alias("caption"),
    )
    one = rows.where(F.col("value").rlike(f"[0-9{_VULGAR}]")).groupBy("target_id").agg(F.min(F.struct("value", "reason", "caption", "source", "title")).alias("r")).select("target_id", "r.*")
    return one.withColumn("m", _measures("value", "reason", "caption")).where(F.size("m") > 0)


def file_key(path: Column) -> Column:
    """A file's name without folders and letter case."""
    return F.lower(F.trim(F.regexp_extract(path, r"([^/\\]*)$", 1)))


def snap(log_ratio: Column) -> Column:
    """The known scale nearest to exp(log_ratio), null beyond the tolerance."""
    steps = F.array(*[F.struct(F.abs(log_ratio - F.lit(math.log(k))).alias("d"), F.lit(k).alias("k")) for k in KNOWN_SCALES])
    best = F.array_min(steps)
    return F.when(best["d"] <= SNAP_TOLERANCE, best["k"])


def notation_links(records: DataFrame) -> DataFrame:
    """(a, b, scale, links, spread): the snapped scale from notation a to notation b, measured on records with both."""
    pairs = records.select(F.explode(F.expr("transform(slice(m, 2, size(m)), x -> struct(m[0] AS p, x AS q))")).alias("z")).select(
        F.col("z.p.uh").alias("a"), F.col("z.q.uh").alias("b"), F.log(F.col("z.p.h") / F.col("z.q.h")).alias("r")
    )
    return (
        pairs.where("r IS NOT NULL AND a <> b AND a <> '' AND b <> ''")
        .groupBy("a", "b")
        .agg(F.percentile_approx("r", 0.5).alias("mid"), F.percentile_approx("r", F.array(F.lit(0.25), F.lit(0.75))).alias("q"), F.count("*").alias("links"))
        # 1 a-unit = exp(-mid) b-units.
        .select("a", "b", snap(-F.col("mid")).alias("scale"), "links", (F.col("q")[1] - F.col("q")[0]).alias("spread"))
        .where("scale IS NOT NULL")
    )


def notation_scales(records: DataFrame) -> DataFrame:
    """(unit, mm, via): millimetres per notation; measured links first, propagated from 'mm', then the known table.

    The notations are the keys of ``UNIT_MM``: a fixed vocabulary, so this graph stays a few dozen rows at any size.
    """
    spark = records.sparkSession
    links = [tuple(r) for r in notation_links(records).select("a", "b", "scale").collect()]
    edges: dict[str, list[tuple[str, float]]] = {}
    for a, b, s in links:
        edges.setdefault(a, []).append((b, s))
        edges.setdefault(b, []).append((a, 1.0 / s))
    # Anchors: the metric notations; everything reached from them over measured links is 'linked'.
    mm = {u: (UNIT_MM[u], "anchor") for u in ("mm", "cm", "m")}
    frontier = list(mm)
    while frontier:
        u = frontier.pop(0)
        for v, s in edges.get(u, []):
            if v not in mm:
                # 1 u = s v, hence 1 v = mm(u) / s.
                mm[v] = (mm[u][0] / s, "linked")
                frontier.append(v)
    for u, k in UNIT_MM.items():
        mm.setdefault(u, (k, "table"))
    return spark.createDataFrame([(u, float(k), via) for u, (k, via) in sorted(mm.items())], "unit string, mm double, via string")


def _half_up(x: Column) -> Column:
    return F.floor(F.round(x, 6) + 0.5).cast("bigint")


def found_sizes(targets: DataFrame) -> DataFrame:
    """(target_id, height_mm, width_mm) of every target with a size whose unit its own record names."""
    return stated_sizes(stored(size_records(targets)))


def stated_sizes(records: DataFrame) -> DataFrame:
    """``found_sizes`` of records that are parsed already."""
    scales = notation_scales(records)
    first = F.col("m")[0]
    caption = F.expr("try_element_at(filter(m, x -> x.role = 'caption'), 1)")
    rows = records.select(
        "target_id", first["h"].alias("h"), first["w"].alias("w"), first["uh"].alias("uh"), first["uw"].alias("uw"), caption["h"].alias("ch"), caption["w"].alias("cw"), caption["uh"].alias("cu")
    )
    book = F.broadcast(scales.select(F.col("unit"), F.col("mm")))  # a row per notation of UNIT_MM
    rows = (
        rows.withColumn("u", F.coalesce(F.nullif("uh", F.lit("")), "cu")).withColumn("v", F.coalesce(F.nullif("uw", F.lit("")), "cu"))
        .join(book.withColumnsRenamed({"unit": "u", "mm": "mu"}), "u")
        .join(book.withColumnsRenamed({"unit": "v", "mm": "mv"}), "v")
    )
    # An unlabelled size takes the caption's unit through the scale between the two numbers (1 where they agree).
    unlabelled = F.col("uh") == ""
    scale = F.when(unlabelled, F.when((F.col("h") > 0) & (F.col("ch") > 0), snap(F.log(F.col("ch") / F.col("h"))))).otherwise(F.lit(1.0))
    return rows.withColumn("s", scale).where("s IS NOT NULL").select(
        "target_id", _half_up(F.col("h") * F.col("mu") * F.col("s")).alias("height_mm"), _half_up(F.col("w") * F.col("mv") * F.col("s")).alias("width_mm")
    )


def source_scales(links: DataFrame) -> DataFrame:
    """(source, mm, plus, links): millimetres = mm * size + plus, from a source's (h, size) of titles known elsewhere.

    A plain scale where the ratios agree; else scale and offset from matching quantiles, if those leave little over.
    """
    quartiles = F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))
    fits = (
        links.withColumn("r", F.log(F.col("size") / F.col("h"))).groupBy("source")
        .agg(F.percentile("r", quartiles).alias("r"), F.percentile("h", quartiles).alias("x"), F.percentile("size", quartiles).alias("y"), F.percentile_approx("r", 0.5).alias("mid"), F.count("*").alias("links"))
        .where(F.col("links") >= MIN_LINKS)
        .withColumn("slope", F.when((F.col("x")[2] > F.col("x")[0]) & (F.col("y")[2] > F.col("y")[0]), snap(F.log((F.col("y")[2] - F.col("y")[0]) / (F.col("x")[2] - F.col("x")[0])))))
        .select("source", snap(F.col("mid")).alias("plain"), (F.col("r")[2] - F.col("r")[0]).alias("spread"), "slope", "y", "links")
    )
    rest = links.join(fits.where("slope IS NOT NULL").select("source", "slope"), "source").groupBy("source").agg(F.percentile(F.col("size") - F.col("slope") * F.col("h"), quartiles).alias("o"))
    tight = F.col("plain").isNotNull() & (F.col("spread") <= 2 * SNAP_TOLERANCE)
    shifted = ~tight & F.col("slope").isNotNull() & (F.col("o")[2] - F.col("o")[0] <= 2 * SNAP_TOLERANCE * F.col("y")[1])
    return (
        fits.join(rest, "source", "left")
        .select("source", F.when(shifted, F.col("slope")).otherwise(F.col("plain")).alias("mm"), F.when(shifted, F.col("o")[1]).otherwise(F.lit(0.0)).alias("plus"), "links")
        .where("mm IS NOT NULL")
    )


def harmonised_sizes(targets: DataFrame) -> DataFrame:
    """``found_sizes`` plus the unlabelled rest, by scale and offset that link their source to others: (..., via, links).

    Sources are linked over the titles they share. A source that is resolved gives sizes to its titles, which may link
    further sources; this goes on until no source is added.
    """
    records = stored(size_records(targets))
    stated = stored(stated_sizes(records))
    named = "title IS NOT NULL AND title <> ''"
    known = records.join(stated, "target_id").where(named).where("height_mm > 0").select("title", F.col("height_mm").cast("double").alias("size"))
    bare = cut(
        records.join(stated.select("target_id"), "target_id", "left_anti").where(F.col("m")[0]["uh"] == "")
        .select("target_id", "source", "title", F.col("m")[0]["h"].alias("h"), F.col("m")[0]["w"].alias("w"))
    )
    known, scales = cut(known), None
    while True:
        # One robust size per title, so that frequent titles link without pairing their rows.
        entity = known.groupBy("title").agg(F.percentile_approx("size", 0.5).alias("size"))
        open_ = bare if scales is None else bare.join(scales.select("source"), "source", "left_anti")
        fresh = cut(source_scales(open_.where(named).where("h > 0").join(entity, "title").select("source", "h", "size")))
        if fresh.isEmpty():
            break
        scales = fresh if scales is None else cut(scales.unionByName(fresh))
        sizes = bare.where(named).join(fresh, "source").select("title", (F.col("h") * F.col("mm") + F.col("plus")).alias("size")).where("size > 0")
        known = cut(known.unionByName(sizes))
    out = stated.select("target_id", "height_mm", "width_mm", F.lit("stated").alias("via"), F.lit(None).cast("bigint").alias("links"))
    if scales is None:
        return out
    # The offset of a source is one of its heights and widths alike.
    size = lambda c: _half_up(F.col(c) * F.col("mm") + F.col("plus"))
    return out.unionByName(bare.join(scales, "source").select("target_id", size("h").alias("height_mm"), size("w").alias("width_mm"), F.lit("linked").alias("via"), "links"))
