"""Schemas that drift between files: change report and one consistent table.

Every file's schema is a small graph (file - field - kind / name part / value class / nested key). Two consecutive files of a feed
are matched by similarity flooding: initial scores of field pairs are propagated over shared neighbours until they
converge; removed and added fields that choose each other above a threshold are one renamed field.

All per-row work (parsing JSON into variant, exploding keys, counting value classes) stays in the JVM and is
pre-aggregated to one row per (file, field); Python only sees those profiles, one group per pair of files.

Defined results: lines with a null feed or file name belong to no series and give no change; payloads that are not JSON objects give no field;
a field with only nulls has no kind and is never retyped; empty tables give empty results; repeated rows count once.
"""

from __future__ import annotations

import math
import re
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.runtime import broadcast_if_small, stored

#: Width of the hashed value-class profile of a field.
PROFILE_WIDTH = 96
#: Share of the old score kept in each flooding step, convergence bound and step limit.
FLOOD_KEEP, FLOOD_EPS, FLOOD_STEPS = 0.55, 1e-3, 40
#: A correspondence needs this converged score.
MATCH_AT = 0.42

CHANGE_SCHEMA = "feed string, file_name string, change_kind string, field_name string, new_name string"


def distinct_lines(exports: DataFrame) -> DataFrame:
    """Every delivered line once; rows without a payload are none."""
    return exports.where("payload IS NOT NULL").select("feed", "file_name", "delivered_at", "line_no", "payload").distinct()


def file_fields(exports: DataFrame) -> DataFrame:
    """(feed, file_name, delivered_at, line_no, field, kind, text, json) for every key of every distinct line.

    A line is parsed once, into a map of variants; keys of any spelling are kept. Lines that are no object have no field.
    """
    keyed = distinct_lines(exports).where(F.expr("json_object_keys(payload) IS NOT NULL")).select(
        "feed", "file_name", "delivered_at", "line_no", F.explode(F.expr("from_json(payload, 'map<string,variant>')")).alias("field", "_x")
    )
    return (
        keyed.withColumn("_s", F.expr("schema_of_variant(_x)"))
        .withColumn(
            "kind",
            F.when(F.col("_x").isNull() | (F.col("_s") == "VOID"), F.lit(None))
            .when(F.col("_s") == "STRING", "string")
            .when(F.col("_s") == "BOOLEAN", "boolean")
            .when(F.col("_s").isin("BIGINT", "INT", "SMALLINT", "TINYINT"), "whole")
            .when(F.col("_s").startswith("ARRAY"), "list")
            .when(F.col("_s").startswith("OBJECT"), "object")
            .otherwise("fraction"),
        )
        .withColumn("text", F.when(F.col("kind").isNotNull(), F.expr("try_variant_get(_x, '$', 'string')")))
        .withColumn("json", F.when(F.col("kind").isNotNull(), F.to_json("_x")))
        .select("feed", "file_name", "delivered_at", "line_no", "field", "kind", "text", "json")
    )


def fields_of_files(exports: DataFrame) -> DataFrame:
    """(feed, file_name, field_name, lines, kinds): what every file holds, before anything is matched."""
    kinds = F.array_join(F.array_sort(F.collect_set("kind")), ",")
    return file_fields(exports).groupBy("feed", "file_name", F.col("field").alias("field_name")).agg(F.count("*").alias("lines"), kinds.alias("kinds"))


def _classes():
    """The value classes of one value: its scalar leaves, numbers by magnitude and step, long strings by shape."""
    leaves = F.when(
        F.col("kind").isin("list", "object"),
        F.expr(r"""regexp_extract_all(json, '(?<=[:\\[,])\\s*("([^"\\\\]|\\\\.)*"|[-0-9.eE]+|true|false)', 1)"""),
    ).otherwise(F.array("text"))
    numeric = r"^-?[0-9]+([.][0-9]+)?$"

    def one(raw):
        x = F.lower(F.regexp_replace(raw, '^"|"$', ""))
        number = F.abs(x.try_cast("double"))
        return (
            F.when(
                x.rlike(numeric),
                F.concat(
                    F.when(number < 100, F.when(x.contains("."), "f").otherwise("n")).otherwise("n"),
                    F.when(x.contains(".") & (number <= 1), F.lit("unit"))
                    .when(number < 20, F.floor(number).cast("string"))
                    .otherwise(F.concat(F.lit("m"), F.floor(F.log2(number) * 1.5).cast("string"))),
                ),
            )
            .when(F.length(x) > 24, F.concat(F.lit("s"), F.substring(F.regexp_replace(x, "[0-9]+", "9"), 1, 12)))
            .otherwise(F.concat(F.lit("v"), F.regexp_replace(x, "[0-9]+", "9")))
        )

    return F.transform(leaves, one)


def field_profiles(fields: DataFrame) -> DataFrame:
    """One row per (feed, file, field): leading kind, lines seen, hashed value-class histogram."""
    counted = (
        fields.withColumn("_c", F.explode_outer(_classes()))
        .withColumn("_h", F.pmod(F.xxhash64("_c"), F.lit(PROFILE_WIDTH)))
        .groupBy("feed", "file_name", "delivered_at", "field", "kind", "_h", F.col("_c").isNull().alias("_null"))
        .agg(F.count("*").alias("n"))
    )
    nested = (
        fields.where("kind IN ('object', 'list')").select("feed", "file_name", "delivered_at", "field", F.explode(F.regexp_extract_all("json", F.lit(r'"((?:[^"\\]|\\.)*)"\s*:'), F.lit(1))).alias("key"))
        .groupBy("feed", "file_name", "delivered_at", "field").agg(F.sort_array(F.collect_set("key")).alias("keys"))
    )
    return counted.groupBy("feed", "file_name", "delivered_at", "field").agg(
        # The leading kind: most values, then the name, so that ties are stable.
        F.max(F.struct(F.when(F.col("kind").isNull(), 0).otherwise(1).alias("some"), "n", "kind"))["kind"].alias("_lead"),
        F.sort_array(F.collect_set("kind")).alias("kinds"),
        F.collect_list(F.when(~F.col("_null"), F.struct(F.col("_h").cast("int").alias("h"), F.col("n").cast("double").alias("n")))).alias("hist"),
        F.sum("n").alias("values"),
    ).drop("_lead").join(nested, ["feed", "file_name", "delivered_at", "field"], "left")


def name_profiles(profiles: DataFrame) -> DataFrame:
    """The value-class histogram of a field name over all files: what the name usually carries."""
    cells = profiles.select("field", F.explode("hist").alias("c")).groupBy("field", F.col("c.h").alias("h")).agg(F.sum("c.n").alias("n"))
    return cells.groupBy("field").agg(F.collect_list(F.struct("h", "n")).alias("usual"))


def _parts(name: str) -> list[str]:
    return [p for p in re.split(r"[^0-9A-Za-z]+", re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name).lower()) if p] or [name]


def _part_score(a: str, b: str) -> float:
    if a == b:
        return 1.0
    short, long_ = sorted((a, b), key=len)
    if len(short) >= 1 and long_.startswith(short):
        return 0.55 + 0.4 * len(short) / len(long_)
    it = iter(long_)
    if len(short) >= 2 and short[0] == long_[0] and all(c in it for c in short):
        return 0.6
    return 0.0


#: Scores of names already compared by a worker; started anew when there are many.
_COMPARED: dict[tuple[str, str], float] = {}


def name_score(a: str, b: str) -> float:
    """How well the parts of two field names pair up, abbreviations included."""
    score = _COMPARED.get((a, b))
    if score is None:
        x, y = _parts(a), _parts(b)
        best = sum(max(_part_score(p, q) for q in y) for p in x) + sum(max(_part_score(p, q) for p in x) for q in y)
        score = 1.0 if "".join(x) == "".join(y) else best / (len(x) + len(y))
        if len(_COMPARED) > 200_000:
            _COMPARED.clear()
        _COMPARED[a, b] = score
    return score


def _vector(cells) -> dict[int, float]:
    out: dict[int, float] = {}
    for c in cells if cells is not None else []:
        if c is not None:
            out[int(c["h"])] = out.get(int(c["h"]), 0.0) + float(c["n"])
    return out


def _cosine(a: dict[int, float], b: dict[int, float]) -> float | None:
    if not a or not b:
        return None
    # Square roots soften a dominating value.
    dot = sum(math.sqrt(v * b[k]) for k, v in a.items() if k in b)
    return dot / math.sqrt(sum(a.values()) * sum(b.values()))


def _incidence(fields: list[dict], nodes) -> tuple[list, np.ndarray]:
    """(neighbour nodes, fields x nodes incidence)."""
    names = sorted({n for f in fields for n in nodes(f)})
    at = {n: i for i, n in enumerate(names)}
    out = np.zeros((len(fields), len(names)))
    for i, f in enumerate(fields):
        out[i, [at[n] for n in nodes(f)]] = 1.0
    return names, out


def _both_ways(a: np.ndarray, b: np.ndarray, pair: np.ndarray) -> np.ndarray:
    """How well the neighbours of every field pair pair up: the mean of each neighbour's best partner."""
    if not pair.size:
        return np.zeros((a.shape[0], b.shape[0]))
    # Scores are not negative, so a product with the incidence masks what is no neighbour.
    best_b = (b[None, :, :] * pair[:, None, :]).max(axis=2)  # node of a x field of b
    best_a = (a[:, :, None] * pair[None, :, :]).max(axis=1)  # field of a x node of b
    n = a.sum(axis=1)[:, None] + b.sum(axis=1)[None, :]
    return (a @ best_b + best_a @ b.T) / np.maximum(n, 1)


def flood(old: list[dict], new: list[dict], rivals: bool = True) -> dict[tuple[str, str], float]:
    """Similarity flooding between two schema graphs; converged scores of all field pairs.

    A schema graph joins every field to its kinds, name parts, value classes and nested keys. All fields take part, so
    that fields of one name anchor the rest. In every step a pair of neighbours (two kinds, parts, classes or keys)
    receives the scores of the best field pairs beside it, and a pair of fields the scores of its neighbour pairs and,
    negatively and unless the new names stem from different files (``rivals``), what better rivals claim.
    """
    if not old or not new:
        return {}
    same = np.array([[a["field"] == b["field"] for b in new] for a in old])
    graphs = []
    for name, nodes, alike in (
        ("kinds", lambda f: set(f["kinds"]), lambda p, q: float(p == q)),
        ("parts", lambda f: set(_parts(f["field"])), _part_score),
        ("keys", lambda f: set(f.get("keys", ())), name_score),
    ):
        (u, a), (v, b) = _incidence(old, nodes), _incidence(new, nodes)
        first = np.array([[alike(p, q) for q in v] for p in u]).reshape(len(u), len(v))
        graphs.append((name, a, b, first))
    # Value classes are shared or not; a shared one carries the cosine of its two fields, others what floods to them.
    weights = []
    for kind in ("hist", "usual"):
        classes = sorted({h for f in (*old, *new) for h in f[kind]})
        at = {h: i for i, h in enumerate(classes)}
        sides = []
        for side in (old, new):
            m = np.zeros((len(side), len(classes)))
            for i, f in enumerate(side):
                for h, n in f[kind].items():
                    m[i, at[h]] = n
            sides.append(np.sqrt(m / np.maximum(m.sum(axis=1, keepdims=True), 1e-12)))
        a, b = sides
        weights.append((a, b, np.eye(len(classes)), (a.T > 0).astype(float), (b.T > 0).astype(float)))

    names = np.array([[name_score(a["field"], b["field"]) for b in new] for a in old])
    kinds = np.array([[1.0 if set(a["kinds"]) & set(b["kinds"]) else 0.0 for b in new] for a in old])
    nested = np.array([[bool(a.get("keys")) and bool(b.get("keys")) for b in new] for a in old])
    values = np.maximum.reduce([a @ b.T for a, b, *_ in weights])
    start = np.where(same, 1.0, 0.62 * values + 0.33 * names + 0.05 * kinds)
    score = start.copy()
    for _ in range(FLOOD_STEPS):
        # Field pairs to neighbour pairs: what starts alike stays so, the rest takes what is beside it.
        near = {}
        for name, a, b, first in graphs:
            near[name] = _both_ways(a, b, np.maximum(first, (1 - FLOOD_KEEP) * _both_ways(a.T, b.T, score)))
        flooded = []
        for a, b, first, shared_a, shared_b in weights:
            # Equal classes give the cosine; what they leave over goes to the scores that unlike class pairs received.
            pair = np.where(first > 0, 0.0, (1 - FLOOD_KEEP) * _both_ways(shared_a, shared_b, score))
            plain = a @ b.T
            spare = (1 - plain).clip(0, 1)
            other = (a * a) @ pair @ (b * b).T
            flooded.append(np.where((a.sum(axis=1) > 0)[:, None] & (b.sum(axis=1) > 0)[None, :], plain + spare * other, 0.0))
        value = np.maximum.reduce(flooded)
        # Keys inside objects are names within the values: they can only add to them.
        value = np.where(nested, np.maximum(value, near["keys"]), value)
        taken = np.where(same, 1.0, 0.62 * value + 0.33 * np.maximum(names, near["parts"]) + 0.05 * np.maximum(kinds, near["kinds"]))
        # A pair both sides prefer keeps its evidence; one outbid elsewhere gives way to the rival.
        rows_, cols = _best_other(score), _best_other(score.T).T
        rival = np.maximum(rows_, cols) if rivals else np.zeros_like(score)
        after = FLOOD_KEEP * score + (1 - FLOOD_KEEP) * taken * np.where(score >= rival, 1.0, (1.0 - (rival - score)).clip(0.0))
        change = float(np.abs(after - score).max())
        score = after
        if change < FLOOD_EPS:
            break
    return {(a["field"], b["field"]): float(score[i, j]) for i, a in enumerate(old) for j, b in enumerate(new)}


def _best_other(score: np.ndarray) -> np.ndarray:
    """Per cell the best score of the other cells of its row."""
    if score.shape[1] < 2:
        return np.zeros_like(score)
    order = np.sort(score, axis=1)
    return np.where(score == order[:, -1:], np.where((score == order[:, -1:]).sum(axis=1, keepdims=True) > 1, order[:, -1:], order[:, -2:-1]), order[:, -1:])


def match_fields(old: list[dict], new: list[dict], at: float = MATCH_AT) -> list[tuple[str, str, float]]:
    """Consistent one-to-one correspondences between fields that only one side has."""
    gone = [x for x in old if x["field"] not in {y["field"] for y in new}]
    come = [x for x in new if x["field"] not in {y["field"] for y in old}]
    # All fields take part in the flooding; only those that one side lacks can be renamed.
    only = {(a["field"], b["field"]) for a in gone for b in come}
    score = {k: v for k, v in flood(old, new).items() if k in only} if only else {}
    out, used = [], set()
    for (a, b), s in sorted(score.items(), key=lambda kv: (-kv[1], kv[0])):
        if s >= at and ("a", a) not in used and ("b", b) not in used:
            used |= {("a", a), ("b", b)}
            out.append((a, b, s))
    return out


def _pair_changes(pdf: pd.DataFrame) -> pd.DataFrame:
    feed, name = pdf["feed"].iloc[0], pdf["pair_file"].iloc[0]
    side = {
        k: [
            {"field": r.field, "kinds": list(r.kinds), "hist": _vector(r.hist), "usual": _vector(r.usual), "keys": list(r.keys)}
            for r in pdf[pdf["is_new"] == k].itertuples()
        ]
        for k in (False, True)
    }
    old, new = side[False], side[True]
    rows = []
    renamed = match_fields(old, new)
    gone, come = {a for a, _, _ in renamed}, {b for _, b, _ in renamed}
    before, after = {x["field"]: x for x in old}, {x["field"]: x for x in new}
    rows += [(feed, name, "renamed", a, b) for a, b, _ in renamed]
    rows += [(feed, name, "removed", f, "") for f in before if f not in after and f not in gone]
    rows += [(feed, name, "added", f, "") for f in after if f not in before and f not in come]
    rows += [
        (feed, name, "retyped", f, "")
        for f in before
        if f in after and before[f]["kinds"] and after[f]["kinds"] and before[f]["kinds"] != after[f]["kinds"]
    ]
    return pd.DataFrame(rows, columns=["feed", "file_name", "change_kind", "field_name", "new_name"])


def schema_changes(exports: DataFrame) -> DataFrame:
    """Every change between a file and the one its feed delivered before (columns of ``CHANGE_SCHEMA``)."""
    profiles = stored(field_profiles(stored(file_fields(exports))))
    usual = name_profiles(profiles)
    files = exports.select("feed", "file_name", "delivered_at").groupBy("feed", "file_name").agg(F.min("delivered_at").alias("delivered_at"))
    order = Window.partitionBy("feed").orderBy("delivered_at", "file_name")
    pairs = files.withColumn("before", F.lag("file_name").over(order)).where(F.col("before").isNotNull())
    # One row per (pair, side): a file is the new side of one pair and the old side of at most one.
    sides = pairs.select("feed", F.col("file_name").alias("pair_file"), F.col("file_name").alias("side_file"), F.lit(True).alias("is_new")).unionByName(
        pairs.select("feed", F.col("file_name").alias("pair_file"), F.col("before").alias("side_file"), F.lit(False).alias("is_new"))
    )
    known = profiles.join(usual, "field", "left").groupBy("feed", F.col("file_name").alias("side_file"), "field").agg(
        F.flatten(F.collect_list("hist")).alias("hist"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("kinds")))).alias("kinds"), F.first("usual").alias("usual"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("keys")))).alias("keys"),
    )
    joined = sides.join(known, ["feed", "side_file"]).select("feed", "pair_file", "is_new", "field", "kinds", "hist", "usual", "keys")
    return joined.groupBy("feed", "pair_file").applyInPandas(_pair_changes, CHANGE_SCHEMA)


#: The consistent table: column, type. Fixed by the target relation.
CANONICAL = {"target_id": "string", "image_scope": "string", "object_type": "string", "confidence": "double", "page_num": "int", "width": "int"}


def unified_exports(exports: DataFrame) -> DataFrame:
    """One consistent table of all lines: canonical columns cast to one type, everything else in ``extras``.

    Field names are assigned to canonical columns by flooding their corpus-wide profiles against those of the
    canonical names; list and object values give their first scalar leaf, percent-like confidences are scaled,
    integer codes are decoded by the label most often stated for the same target. A line that is no JSON object is a
    row with nothing known; all other names and values of a line are in ``extras``.
    """
    fields = stored(file_fields(exports))
    profiles = stored(field_profiles(fields))
    usual = name_profiles(profiles)
    canonical = [c for c in CANONICAL]
    vocabulary = profiles.groupBy("field").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("kinds")))).alias("kinds"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("keys")))).alias("keys"))
    # Names that stand in one line, by the distinct sets of names lines have.
    sets = fields.groupBy("feed", "file_name", "delivered_at", "line_no").agg(F.sort_array(F.collect_set("field")).alias("names")).select("names").distinct()
    beside = sets.select(F.explode("names").alias("field"), "names").select("field", F.explode("names").alias("other")).distinct().groupBy("field").agg(F.sort_array(F.collect_set("other")).alias("beside"))
    mapped = vocabulary.join(usual, "field", "left").join(beside, "field", "left").groupBy(F.lit(1).alias("one")).applyInPandas(_assign_canonical(canonical), "field string, canonical string")
    wide = (
        fields.join(broadcast_if_small(mapped), "field", "left")
        .withColumn("_leaf", F.when(F.col("kind").isin("list", "object"), F.regexp_replace(F.regexp_extract("json", r'[:\[]\s*("[^"]*"|[-0-9.]+|true|false)', 1), '"', "")).otherwise(F.col("text")))
        .groupBy("feed", "file_name", "delivered_at", "line_no")
        .agg(
            *[F.min(F.when(F.col("canonical") == c, F.col("_leaf"))).alias(c) for c in canonical],
            F.map_from_entries(F.array_sort(F.array_compact(F.collect_list(F.when(F.col("canonical").isNull(), F.struct("field", "json")))))).alias("extras"),
        )
    )
    # Lines that are no object stay, with nothing known.
    key = ["feed", "file_name", "delivered_at", "line_no"]
    lines = distinct_lines(exports).select(*[F.col(c).alias(f"_l{i}") for i, c in enumerate(key)]).distinct()
    same = reduce(lambda a, i: a & F.col(f"_l{i}").eqNullSafe(F.col(key[i])), range(1, 4), F.col("_l0").eqNullSafe(F.col("feed")))
    wide = lines.join(wide, same, "left").select(*[F.col(f"_l{i}").alias(c) for i, c in enumerate(key)], *canonical, "extras")
    wide = stored(wide)
    for c in ("image_scope", "object_type"):
        code = wide.where(F.col(c).rlike("^[0-9]+$")).select("target_id", F.col(c).alias("_code"))
        label = wide.where(~F.col(c).rlike("^[0-9]+$")).groupBy("target_id", F.col(c).alias("_label")).agg(F.count("*").alias("m"))
        book = (
            code.join(label, "target_id").groupBy("_code", "_label").agg(F.sum("m").alias("m"))
            .groupBy("_code").agg(F.max_by("_label", F.struct("m", "_label")).alias("_label"))
        )
        wide = wide.join(broadcast_if_small(book), F.col(c) == F.col("_code"), "left").withColumn(c, F.coalesce("_label", c)).drop("_code", "_label")
    number = F.col("confidence").try_cast("double")
    return wide.select(
        "feed", "file_name", "delivered_at", "line_no", "target_id", "image_scope", "object_type",
        F.when(number > 1, number / 100).otherwise(number).alias("confidence"),
        F.col("page_num").try_cast("int").alias("page_num"), F.col("width").try_cast("int").alias("width"), F.to_json("extras").alias("extras"),
    )


def _assign_canonical(canonical: list[str]):
    def assign(pdf: pd.DataFrame) -> pd.DataFrame:
        # One row per field name of the whole collection: a vocabulary, not data.
        fields = [{"field": r.field, "kinds": list(r.kinds), "hist": {}, "usual": _vector(r.usual), "keys": list(r.keys)} for r in pdf.sort_values("field").itertuples()]
        beside = {r.field: set(r.beside) for r in pdf.itertuples()}
        by_name = {f["field"]: f for f in fields}
        old = [by_name.get(c, {"field": c, "kinds": [], "hist": {}, "usual": {}, "keys": []}) for c in canonical]
        # Names of different files are no rivals; names of one line are told apart below.
        score = flood(old, fields, rivals=False)
        given: dict[str, str] = {}
        for (c, name), s in sorted(score.items(), key=lambda kv: (-kv[1], kv[0])):
            if s < MATCH_AT or name in given or (name in canonical and name != c):
                continue
            # One name of a line for one column.
            if not any(other != name and given.get(other) == c for other in beside[name]):
                given[name] = c
        return pd.DataFrame(sorted(given.items()), columns=["field", "canonical"])

    return assign
