"""Rows made out of rows: unions of kinds, fragments, regions, corrections, counterfactuals, chat rows. All by explode."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions import geometry as G
from vellum.functions import text as T

#: How many captions, labels and titles a profile holds, and fragments a text gives.
MOST_CAPTIONS, MOST_LABELS, MOST_TITLES, MOST_FRAGMENTS = 12, 12, 24, 6


def kinds_of_rows(parts: dict[str, DataFrame]) -> DataFrame:
    """Union of parts with their kind; columns some lack are null."""
    out = None
    for kind, part in parts.items():
        p = part.withColumn("kind", F.lit(kind))
        out = p if out is None else out.unionByName(p, allowMissingColumns=True)
    return out


def exploded_union(rows: DataFrame, keys: Sequence[str], arrays: dict[str, str], out: str) -> DataFrame:
    """(keys, out, origin): the elements of several arrays of a row, in one pass over the rows."""
    def tagged(name: str, a: str) -> Column:
        return F.transform(F.coalesce(a, F.array().cast("array<string>")), lambda x: F.struct(x.alias(out), F.lit(name).alias("origin")))

    return rows.select(*keys, F.explode(F.concat(*[tagged(n, a) for n, a in arrays.items()])).alias("_z")).select(*keys, f"_z.{out}", "_z.origin")


def without(rows: DataFrame, hidden: Sequence[str]) -> DataFrame:
    """The rows without their hidden columns."""
    return rows.drop(*hidden)


def normal_regions(raw: DataFrame, page: str, children: str, score: str, priority: Sequence[str], most: int) -> DataFrame:
    """(page, box, label, rank): valid boxes of nested results, equal (box, label) once, by priority and score, ``most`` a page."""
    flat = raw.select(page, F.col(score).alias("_s"), F.explode(children).alias("_c")).where(G.valid(F.col("_c.box")))
    once = flat.groupBy(page, F.col("_c.box").alias("box"), F.col("_c.label").alias("label")).agg(F.max("_s").alias("_s"))
    place = F.array_position(F.array(*map(F.lit, priority)), F.col("label"))
    w = Window.partitionBy(page).orderBy(place, F.desc("_s"), F.array_join(F.col("box").cast("array<string>"), ","))
    return once.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).drop("_s")


def label_fragments(text: Column, most: int = MOST_FRAGMENTS) -> Column:
    """The stretches of a text from one figure label to the next; none where there is at most one label."""
    marked = F.split(F.regexp_replace(text, f"({T.LABEL})", "\x01$1"), "\x01")
    trimmed = F.transform(F.slice(marked, F.lit(2), F.lit(most)), lambda x: F.regexp_replace(x, "^[ ;,，。]+|[ ;,，。]+$", ""))
    return F.when(F.size(marked) > 2, trimmed).otherwise(F.array().cast("array<string>"))


def fragments_of(rows: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(key, kind, text, fragment_id): a fragment for every column that is not blank, with a stable id."""
    cells = F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).alias("text")) for c in columns])
    long_ = rows.select(key, F.explode(cells).alias("_z")).select(key, "_z.kind", "_z.text").where(F.trim(F.coalesce("text", F.lit(""))) != "")
    return long_.withColumn("fragment_id", F.concat(F.lit("fr_"), F.substring(F.sha1(F.concat_ws("|", key, "kind", "text")), 1, 16)))


def anchor_profiles(rows: DataFrame, key: str, caption: str) -> DataFrame:
    """(key, captions, labels, titles): what a key's captions anchor; the first few of each in order (their number is the feature)."""
    few = rows.where(F.col(caption).isNotNull()).select(key, caption).distinct().withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(caption))).where(F.col("_n") <= MOST_CAPTIONS)
    g = few.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", caption))), lambda x: x[caption]).alias("captions"))
    labels = F.flatten(F.transform("captions", T.figure_labels))
    titles = F.flatten(F.transform("captions", lambda c: F.regexp_extract_all(c, F.lit("《([^》]{1,40})》"), F.lit(1))))
    return g.select(key, "captions", F.slice(F.array_distinct(labels), 1, MOST_LABELS).alias("labels"), F.slice(F.array_distinct(titles), 1, MOST_TITLES).alias("titles"))


def stamped(fields: Column, **values: str) -> Column:
    """A map with keys set."""
    names = list(values)
    return F.map_concat(F.map_filter(fields, lambda k, _: ~k.isin(*names)), F.create_map(*[F.lit(x) for kv in values.items() for x in kv]))


def corrected(rows: DataFrame, fixes: DataFrame, key: str, column: str, value: str) -> DataFrame:
    """The column with its corrections, what it replaced in ``original_`` + column (null where nothing changed)."""
    side = fixes.select(F.col(key).alias("_k"), F.col(value).alias("_v"))
    j = rows.join(side, F.col(key) == F.col("_k"), "left")
    changed = F.col("_v").isNotNull() & ~F.col("_v").eqNullSafe(F.col(column))
    return j.withColumn(f"original_{column}", F.when(changed, F.col(column))).withColumn(column, F.coalesce("_v", column)).drop("_k", "_v")


def counterfactuals(rows: DataFrame, claim: str, change: dict[str, Column]) -> DataFrame:
    """Every row as it is and with the fields of its claim changed."""
    other = F.col(claim)
    for field, value in change.items():
        other = other.withField(field, value)
    return rows.withColumn(claim, F.explode(F.array(F.col(claim), other)))


def chat_rows(rows: DataFrame, user: Column, assistant: Column) -> DataFrame:
    """Rows with ``messages``: array(struct(role, content))."""
    return rows.withColumn("messages", F.array(F.struct(F.lit("user").alias("role"), user.alias("content")), F.struct(F.lit("assistant").alias("role"), assistant.alias("content"))))
