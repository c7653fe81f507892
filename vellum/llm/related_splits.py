"""Splits that keep related records together.

Records are related when they share a document or a file; that carries over. The records are reduced to distinct
(document, file) pairs first, so a file with a third of all rows is one node. Borůvka-style contraction then lets every
component choose its smallest outgoing edge, writes the chosen edges to a persisted spanning forest and contracts;
components at least halve in number per round. Roots are stratified by size band and dealt to splits: the largest, at
most ``BIG_SHARE`` of them whatever the data, one by one to the split that lacks most records, the bands of all others
systematically to what is left of the shares.

Defined results: a null or empty doc_id or source_file relates nothing; a record with neither is its own group; null
keys (target_id) are ignored; repeated rows count once; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.runtime import Shelf, cut, join_facts

SPLITS = (("train", 0.75), ("val", 0.10), ("test", 0.15))
#: Buckets of the two-level rank that deals roots; a rank never needs one task to see a whole band.
RANK_BUCKETS = 128
#: A group is big when it holds more than one in so many of all records; so there are at most as many big groups.
BIG_SHARE = 2_000


def file_name_key(path: Column) -> Column:
    """The file name without folders and letter case; null when nothing is left."""
    return F.nullif(F.lower(F.trim(F.regexp_extract(path, r"([^/\\]*)$", 1))), F.lit(""))


def records_of(targets: DataFrame) -> DataFrame:
    """(target_id, d, f, split) without repeated rows; d and f are node ids of document and file."""
    doc = F.nullif(F.trim("doc_id"), F.lit(""))
    file = file_name_key(F.col("source_file"))
    return (
        targets.where(F.col("target_id").isNotNull())
        .select("target_id", F.when(doc.isNotNull(), F.concat(F.lit("d:"), doc)).alias("d"), F.when(file.isNotNull(), F.concat(F.lit("f:"), file)).alias("f"), "split")
        .distinct()
    )


def spanning_forest(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Contract ``edges`` (u, v) Borůvka-style: (roots: node, root), (forest: u, v), both written tables.

    Weights are the edges' hashes (the edge itself breaks ties), so every component has one smallest outgoing edge and
    the chosen edges close no cycle: a mutual choice is one edge. Every round is cut with written tables; a component
    that is hot in a round meets its choice by ``join_facts``.
    """
    shelf = Shelf(edges.sparkSession)
    base = shelf.put(
        edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u <> v").distinct()
        .withColumn("w", F.struct(F.xxhash64("u", "v").alias("h"), F.col("u").alias("eu"), F.col("v").alias("ev")))
    )
    roots = shelf.put(base.select(F.col("u").alias("node")).union(base.select("v")).distinct().select("node", F.col("node").alias("root")))
    live, forest = base, shelf.put(base.select("u", "v").limit(0))
    while not live.isEmpty():
        both = live.select("u", "v", "w").union(live.select(F.col("v").alias("u"), F.col("u").alias("v"), "w"))
        chosen = shelf.put(both.groupBy("u").agg(F.min(F.struct("w", "v")).alias("m")).select("u", F.col("m.v").alias("v"), F.col("m.w").alias("w")))
        picked = shelf.put(chosen.select(F.col("w.eu").alias("u"), F.col("w.ev").alias("v")).distinct())
        forest = forest.union(picked)
        # A mutual choice makes its smaller end the root; every other component points to its choice.
        mate = chosen.select(F.col("u").alias("v"), F.col("v").alias("back"))
        point = shelf.put(join_facts(chosen.select("u", "v"), mate, "v", computed=True).select("u", F.when((F.col("back") == F.col("u")) & (F.col("u") < F.col("v")), F.col("u")).otherwise(F.col("v")).alias("p")))
        held = point
        while True:  # pointer jumping: paths halve per step
            up = point.select(F.col("u").alias("p"), F.col("p").alias("pp"))
            jumped = shelf.put(join_facts(point, up, "p", computed=True).select("u", F.col("pp").alias("p"), (F.col("p") != F.col("pp")).alias("moved")))
            moved = not jumped.where("moved").isEmpty()
            shelf.drop(held)
            held, point = jumped, jumped.select("u", "p")
            if not moved:
                break
        at = point.select(F.col("u").alias("root"), F.col("p").alias("to"))
        stale = [roots, held, chosen, *([live] if live is not base else [])]
        roots = shelf.put(join_facts(roots, at, "root", computed=True).select("node", F.coalesce("to", "root").alias("root")))
        left, right = point.select("u", F.col("p").alias("pu")), point.select(F.col("u").alias("v"), F.col("p").alias("pv"))
        live = shelf.put(
            join_facts(join_facts(live, left, "u", computed=True), right, "v", computed=True)
            .select(F.coalesce("pu", "u").alias("u"), F.coalesce("pv", "v").alias("v"), "w").where("u <> v")
            .groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.min("w").alias("w"))
        )
        shelf.drop(*stale)
    shelf.drop(base)
    return roots, forest


def related_pairs(targets: DataFrame) -> DataFrame:
    """(u, v): distinct pairs of document and file that some record has both of."""
    return records_of(targets).where("d IS NOT NULL AND f IS NOT NULL").select(F.col("d").alias("u"), F.col("f").alias("v")).distinct()


def groups_of(targets: DataFrame) -> DataFrame:
    """(target_id, split, group): group is a node id of the component, or the record itself when it has no relation."""
    roots, _ = spanning_forest(related_pairs(targets))
    rows = records_of(targets).withColumn("node", F.coalesce("f", "d"))
    return join_facts(rows, roots, "node", computed=True).select("target_id", "split", F.coalesce("root", "node", F.concat(F.lit("t:"), "target_id")).alias("group"))


def relation_forest(targets: DataFrame) -> DataFrame:
    """(u, v): the persisted spanning forest, one tree per component; why two records are related is a path in it."""
    return spanning_forest(related_pairs(targets))[1]


def found_groups(targets: DataFrame) -> DataFrame:
    """(group_key, target_id) of every group that today's splits tear apart."""
    rows = groups_of(targets)
    # Pre-aggregated per group: three splits at most, whatever the group holds.
    torn = rows.groupBy("group").agg(F.min("target_id").alias("group_key"), F.min("split").alias("a"), F.max("split").alias("b")).where("a <> b").select("group", "group_key")
    return join_facts(rows, torn, "group").where("group_key IS NOT NULL").select("group_key", "target_id").distinct()


def dealt_big(sizes: list[tuple[str, int]], total: int, splits: tuple) -> tuple[dict[str, str], list[float]]:
    """(split of every big group, records every split still lacks): from large to small to the split that lacks most."""
    lack = [share * total for _, share in splits]
    given = {}
    for group, n in sorted(sizes, key=lambda x: (-x[1], x[0])):
        k = max(range(len(splits)), key=lambda i: (round(lack[i], 6), -i))
        given[group] = splits[k][0]
        lack[k] -= n
    return given, [max(0.0, x) for x in lack]


def dealt_splits(targets: DataFrame, splits: tuple = SPLITS) -> DataFrame:
    """(target_id, group_key, split): whole groups dealt to splits, close to the given shares."""
    rows = groups_of(targets).select("target_id", "group").distinct()
    sizes = cut(rows.groupBy("group").agg(F.count("*").alias("n"), F.min("target_id").alias("group_key")))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    big = F.col("n") > total / BIG_SHARE
    given, lack = dealt_big([(r["group"], r["n"]) for r in sizes.where(big).select("group", "n").collect()], total, splits)  # at most BIG_SHARE groups
    left = sum(lack)
    rest = [x / left for x in lack] if left else [share for _, share in splits]
    banded = sizes.where(~big).withColumn("band", F.floor(F.log2("n"))).withColumn("h", F.xxhash64("group")).withColumn("bucket", F.pmod("h", F.lit(RANK_BUCKETS)))
    counts = banded.groupBy("band", "bucket").agg(F.count("*").alias("c"))
    offset = counts.withColumn("before", F.coalesce(F.sum("c").over(Window.partitionBy("band").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("band", "bucket", "before")
    # At most RANK_BUCKETS rows for every power of two.
    ranked = banded.join(F.broadcast(offset), ["band", "bucket"]).withColumn("r", F.row_number().over(Window.partitionBy("band", "bucket").orderBy("h", "group")) - 1 + F.col("before"))
    # Systematic dealing: the fractional part of an irrational step spreads every share evenly over the ranks.
    turn = F.col("r") * F.lit(0.6180339887498949) + F.col("band") * F.lit(0.37) + F.lit(0.11)
    spot = turn - F.floor(turn)
    label, upto = F.lit(splits[0][0]), 0.0
    for (name, _), share in reversed(list(zip(splits[1:], rest[1:]))):
        label = F.when((spot >= upto) & (spot < upto + share), name).otherwise(label)
        upto += share
    dealt = ranked.select("group", "group_key", label.alias("split"))
    named = targets.sparkSession.createDataFrame(sorted(given.items()), "group string, split string")
    dealt = dealt.unionByName(sizes.where(big).join(F.broadcast(named), "group").select("group", "group_key", "split"))
    return join_facts(rows, dealt, "group").select("target_id", "group_key", "split")


def split_report(targets: DataFrame, splits: tuple = SPLITS) -> DataFrame:
    """Per split: records, groups, its share of all records and the share asked for."""
    dealt = dealt_splits(targets, splits)
    asked = F.create_map(*[F.lit(x) for k, v in splits for x in (k, v)])
    per = dealt.groupBy("split").agg(F.count("*").alias("records"), F.count_distinct("group_key").alias("groups"))
    return per.select("split", "records", "groups", F.round(F.col("records") / F.sum("records").over(Window.partitionBy(F.lit(1))), 6).alias("share"), F.try_element_at(asked, F.col("split")).alias("asked"))
