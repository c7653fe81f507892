"""Queries of partner-finding joins, boxes and scoped retrieval, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.functions import geometry as G
from vellum.functions import text as T
from vellum.operators import boxes, retrieval
from vellum.operators import matching as P
from vellum.operators import relational as R
from vellum.plans.book import Book
from vellum.plans.relational_queries import CAND, FIG, PAGE, SUP, _cand, _fig, _page, _sup
from vellum.plans.scalar_queries import _MARK

BOOK = Book()
queries, oracle_sql = (lambda: BOOK.calls), (lambda: BOOK.sql)


@BOOK.query("c2_default_row", f"SELECT s.pair_id, coalesce(f.split, CASE WHEN f.t IS NULL THEN 'none' END) AS split, CASE WHEN f.t IS NULL THEN 'unknown' ELSE f.trajectory_type END AS trajectory_type, f.t IS NOT NULL AS found FROM {SUP} s LEFT JOIN (SELECT target_id AS t, split, trajectory_type FROM (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY split NULLS FIRST, trajectory_type NULLS FIRST) AS rn FROM {FIG}) WHERE rn = 1) f ON s.task_id = f.t")
def c2_default_row(t):
    return P.join_with_default(_sup(t).select("pair_id", "task_id"), _fig(t), ("task_id", "target_id"), {"split": F.lit("none"), "trajectory_type": F.lit("unknown")}).select("pair_id", "split", "trajectory_type", "found")


@BOOK.query("c5_label_chain", f"""
WITH a AS (SELECT pair_id, min(rule_label) AS l FROM {SUP} WHERE candidate_kind = 'same_page_body' AND rule_label IS NOT NULL GROUP BY 1), b AS (SELECT evidence_id, min(rule_label) AS l FROM {SUP} WHERE rule_label IS NOT NULL AND evidence_id IS NOT NULL GROUP BY 1)
SELECT s.pair_id, coalesce(a.l, b.l, 'offline') AS label, CASE WHEN a.l IS NOT NULL THEN 'pair_id' WHEN b.l IS NOT NULL THEN 'evidence_id' END AS matched_by FROM {SUP} s LEFT JOIN a USING (pair_id) LEFT JOIN b ON s.evidence_id = b.evidence_id""")
def c5_label_chain(t):
    s = _sup(t)
    a = s.where("candidate_kind = 'same_page_body' AND rule_label IS NOT NULL").select(F.col("pair_id").alias("k1"), F.lit(None).cast("string").alias("k2"), F.col("rule_label").alias("label"))
    b = s.where("rule_label IS NOT NULL AND evidence_id IS NOT NULL").select(F.lit(None).cast("string").alias("k1"), F.col("evidence_id").alias("k2"), F.col("rule_label").alias("label"))
    j = R.alternate_key_join(s.select("pair_id", "evidence_id"), a.unionByName(b), [("pair_id", "k1"), ("evidence_id", "k2")], ["label"])
    return j.select("pair_id", F.coalesce("label", F.lit("offline")).alias("label"), "matched_by")


@BOOK.query("c6_resolved", f"""
WITH k AS (SELECT 'id::' || doc_id AS k, min(category) AS c FROM {PAGE} WHERE doc_id IS NOT NULL GROUP BY 1 UNION ALL SELECT 'file::' || lower(source_file), min(category) FROM {PAGE} WHERE source_file IS NOT NULL GROUP BY 1)
SELECT f.target_id, f.doc_id, f.source_file, coalesce((SELECT c FROM k WHERE k.k = 'id::' || f.doc_id), (SELECT c FROM k WHERE k.k = 'file::' || lower(f.source_file))) AS category FROM (SELECT DISTINCT target_id, doc_id, source_file FROM figure_targets) f""")
def c6_resolved(t):
    p = t.page_specs.select("doc_id", "source_file", "category")
    keys = p.where("doc_id IS NOT NULL").select(F.concat(F.lit("id::"), "doc_id").alias("authority_key"), "category").unionByName(p.where("source_file IS NOT NULL").select(F.concat(F.lit("file::"), F.lower("source_file")).alias("authority_key"), "category"))
    rows = t.figure_targets.select("target_id", "doc_id", "source_file").distinct()
    return P.resolved(rows, keys, [F.concat(F.lit("id::"), "doc_id"), F.concat(F.lit("file::"), F.lower("source_file"))], "category")


@BOOK.query("c12_pending_retry", f"SELECT target_id FROM {FIG} f WHERE NOT EXISTS (SELECT 1 FROM {SUP} s WHERE s.task_id = f.target_id AND coalesce(s.rule_label, 'error') <> 'error')")
def c12_pending_retry(t):
    done = _sup(t).where("task_id IS NOT NULL").select(F.col("task_id").alias("target_id"), F.coalesce("rule_label", F.lit("error")).alias("status"))
    return R.pending(_fig(t).select("target_id"), R.settled(done, "status", ("error",)), ["target_id"])


_A, _C = "a", "c"
_VAL = "(coalesce(len({b}), 0) = 4 AND {b}[3] > {b}[1] AND {b}[4] > {b}[2])"
_FC = "(SELECT DISTINCT candidate_id AS figure_id, page_id AS p, image_bbox AS a FROM page_candidates) f JOIN (SELECT DISTINCT candidate_id AS caption_id, page_id AS q, caption_bbox AS c, caption_text AS x FROM page_candidates) k ON f.p = k.q"
_FW = "greatest(1.0, a[3] - a[1])"
_LIKE = "CASE WHEN regexp_matches(regexp_replace(substring(coalesce(x, ''), 1, {n}), '\\s+', '', 'g'), '" + _MARK + "') THEN {v} ELSE 0.0 END"
_POS = "CASE WHEN c[2] >= a[4] - 8 THEN {b} WHEN c[4] <= a[2] + 8 THEN {u} ELSE {o} END"
_GAP = _POS.format(b="greatest(0, c[2] - a[4])", u="greatest(0, a[2] - c[4])", o="0")
_OVL = f"greatest(0.0, least(a[3], c[3]) - greatest(a[1], c[1])) / {_FW}"


def _pairs(t):
    b = t.page_candidates
    f = b.select(F.col("candidate_id").alias("figure_id"), F.col("page_id").alias("p"), F.col("image_bbox").alias("a")).distinct()
    c = b.select(F.col("candidate_id").alias("caption_id"), F.col("page_id").alias("q"), F.col("caption_bbox").alias("c"), F.col("caption_text").alias("x")).distinct()
    return f, c


@BOOK.query("c16_best_link", f"""
WITH j AS (SELECT figure_id, caption_id, round(1.8 * least(1.0, {_OVL}) + {_POS.format(b='1.0', u='-0.35', o='-0.2')} + {_LIKE.format(n=40, v=0.35)} - least(1.0, abs((a[1] + a[3]) / 2.0 - (c[1] + c[3]) / 2.0) / {_FW}) - CAST({_GAP} AS DOUBLE) / 500.0, 6) AS s
 FROM {_FC} WHERE {_VAL.format(b='a')} AND {_VAL.format(b='c')} AND {_OVL} > 0.15 AND {_GAP} <= 420)
SELECT figure_id, arg_min(caption_id, struct_pack(x := -s, y := caption_id)) AS caption_id, max(s) AS score FROM j WHERE s >= 1.0 GROUP BY 1""")
def c16_best_link(t):
    f, c = _pairs(t)
    return P.best_partner(f, c, ("p", "q"), "figure_id", "caption_id", P.link_score(F.col("a"), F.col("c"), F.coalesce("x", F.lit(""))), 1.0)


_ACR = "greatest(0.0, least(a[3], c[3]) - greatest(a[1], c[1])) / greatest(1.0, least(greatest(1.0, a[3] - a[1]), c[3] - c[1]))"
_NX = "trim(regexp_replace(coalesce(x, ''), '\\s+', ' ', 'g'))"


@BOOK.query("c17_best_block", f"""
WITH j AS (SELECT figure_id, caption_id, round({_ACR} * 2.0 - least(abs(c[2] - a[4]), abs(a[2] - c[4])) / 120.0 + CASE WHEN c[2] - a[4] BETWEEN 0 AND 180 THEN 3.5 ELSE 0.0 END + CASE WHEN a[2] - c[4] BETWEEN 0 AND 120 THEN 1.2 ELSE 0.0 END
 + CASE WHEN regexp_matches(regexp_replace(substring({_NX}, 1, 80), '\\s+', '', 'g'), '{_MARK}') THEN 4.0 ELSE 0.0 END + CASE WHEN contains({_NX}, '《') AND contains({_NX}, '》') THEN 1.2 ELSE 0.0 END
 + CASE WHEN contains({_NX}, '山水') OR contains({_NX}, '画') THEN 0.8 ELSE 0.0 END - CASE WHEN length({_NX}) > 260 THEN 2.0 ELSE 0.0 END - CASE WHEN {_ACR} < 0.08 THEN 2.0 ELSE 0.0 END, 6) AS s FROM {_FC} WHERE {_VAL.format(b='a')} AND {_VAL.format(b='c')})
SELECT figure_id, arg_min(caption_id, struct_pack(x := -s, y := caption_id)) AS caption_id, max(s) AS score FROM j WHERE s >= -8.0 GROUP BY 1""")
def c17_best_block(t):
    f, c = _pairs(t)
    return P.best_partner(f, c, ("p", "q"), "figure_id", "caption_id", P.block_score(F.col("a"), F.col("c"), F.col("x")), -8.0)


@BOOK.query("c19_text_and_place")
def c19_text_and_place(t):
    f = t.figure_targets.select("page_id", "target_id", F.col("target_bbox_px").alias("box"), F.col("base_fields")["caption_text"].alias("caption")).distinct()
    x = t.page_candidates.select("page_id", "candidate_id", F.col("caption_bbox").alias("box"), F.col("caption_text").alias("words")).distinct()
    return P.best_text_and_place(f, x, "page_id", "target_id", "candidate_id")


_RECT = "(SELECT DISTINCT page_id, candidate_id, image_bbox AS b, caption_score AS s FROM page_candidates WHERE page_id IS NOT NULL AND coalesce(len(image_bbox), 0) = 4 AND image_bbox[3] > image_bbox[1] AND image_bbox[4] > image_bbox[2])"
_SUPPRESSED = """
WITH RECURSIVE r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY {order}) AS n FROM {rect}),
w(page_id, n, kept, ids) AS (SELECT DISTINCT page_id, CAST(0 AS BIGINT), CAST([] AS INTEGER[][]), CAST([] AS VARCHAR[]) FROM r
 UNION ALL SELECT w.page_id, r.n, CASE WHEN x.hit THEN w.kept ELSE list_append(w.kept, r.b) END, CASE WHEN x.hit THEN w.ids ELSE list_append(w.ids, r.candidate_id) END FROM w JOIN r ON r.page_id = w.page_id AND r.n = w.n + 1,
 LATERAL (SELECT len(list_filter(w.kept, lambda k: CAST(greatest(0, least(k[3], r.b[3]) - greatest(k[1], r.b[1])) AS DOUBLE) * greatest(0, least(k[4], r.b[4]) - greatest(k[2], r.b[2])) > 0 AND CAST(greatest(0, least(k[3], r.b[3]) - greatest(k[1], r.b[1])) AS DOUBLE) * greatest(0, least(k[4], r.b[4]) - greatest(k[2], r.b[2]))
  >= {at} * (CAST(k[3] - k[1] AS DOUBLE) * (k[4] - k[2]) + CAST(r.b[3] - r.b[1] AS DOUBLE) * (r.b[4] - r.b[2]) - CAST(greatest(0, least(k[3], r.b[3]) - greatest(k[1], r.b[1])) AS DOUBLE) * greatest(0, least(k[4], r.b[4]) - greatest(k[2], r.b[2]))))) > 0 AS hit) x),
l AS (SELECT page_id, arg_max(ids, n) AS ids FROM w GROUP BY page_id) SELECT page_id, unnest(ids) AS candidate_id FROM l"""


@BOOK.query("c20_suppression", _SUPPRESSED.format(rect=_RECT, order="s DESC NULLS LAST, candidate_id", at=0.88))
def c20_suppression(t):
    return boxes.suppress_overlaps(t.page_candidates, "page_id", "candidate_id", "image_bbox", "caption_score")


@BOOK.query("c21_area_suppression", _SUPPRESSED.format(rect=_RECT, order="CAST(b[3] - b[1] AS DOUBLE) * (b[4] - b[2]) DESC, candidate_id", at=0.5))
def c21_area_suppression(t):
    b = t.page_candidates.select("page_id", "candidate_id", "image_bbox").withColumn("area", G.area(F.col("image_bbox")))
    return boxes.suppress_overlaps(b, "page_id", "candidate_id", "image_bbox", "area", 0.5)


@BOOK.query("c22_recovered_index", """
WITH p AS (SELECT page_id, list_sort(list(DISTINCT caption_text) FILTER (WHERE caption_text IS NOT NULL)) AS xs FROM page_candidates WHERE page_id IS NOT NULL GROUP BY 1), x AS (SELECT page_id, generate_subscripts(xs, 1) - 1 AS i, unnest(xs) AS v FROM p)
SELECT c.candidate_id, CAST(min(x.i) AS INTEGER) AS index FROM (SELECT DISTINCT candidate_id, page_id, caption_text FROM page_candidates) c LEFT JOIN x ON c.page_id = x.page_id AND c.caption_text = x.v GROUP BY c.candidate_id, c.page_id, c.caption_text""")
def c22_recovered_index(t):
    c = t.page_candidates.select("candidate_id", "page_id", "caption_text").distinct()
    arrays = c.where("page_id IS NOT NULL").groupBy("page_id").agg(F.array_sort(F.collect_set("caption_text")).alias("xs"))
    return P.position_of_value(c, arrays, "page_id", "caption_text", "xs").select("candidate_id", F.col("index").cast("int").alias("index"))


@BOOK.query("c23_handed_out", """
WITH s AS (SELECT user_id, count(*) AS c FROM events WHERE event_type = 'error' GROUP BY 1), r AS (SELECT user_id, c, sum(c) OVER (ORDER BY user_id) - c AS f FROM s), i AS (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS n FROM events)
SELECT event_id, user_id AS step FROM i LEFT JOIN r ON n > f AND n <= f + c""")
def c23_handed_out(t):
    steps = t.events.where("event_type = 'error'").groupBy(F.col("user_id").alias("step")).agg(F.count("*").alias("c"))
    return P.by_running_count(t.events.select("event_id", "ts"), ["ts", "event_id"], steps, "step", "c").select("event_id", "step")


@BOOK.query("c25_opened", f"SELECT e.pair_id, e.evidence_id, o.source_file, o.priority FROM (SELECT DISTINCT pair_id, evidence_id FROM support_candidates) e JOIN (SELECT evidence_id, arg_max(source_file, pair_id) AS source_file, arg_max(priority, pair_id) AS priority FROM {SUP} WHERE evidence_id IS NOT NULL GROUP BY 1) o USING (evidence_id)")
def c25_opened(t):
    last = _sup(t).where("evidence_id IS NOT NULL").groupBy("evidence_id").agg(F.max_by(F.struct("source_file", "priority"), "pair_id").alias("r")).select("evidence_id", "r.*")
    return t.support_candidates.select("pair_id", "evidence_id").distinct().join(last, "evidence_id").select("pair_id", "evidence_id", "source_file", "priority")


@BOOK.query("c26_of_source", f"SELECT f.source_file, count(DISTINCT f.target_id) AS targets, min(p.pages) AS pages FROM {FIG} f JOIN (SELECT source_file, count(*) AS pages FROM {PAGE} GROUP BY 1) p USING (source_file) GROUP BY 1")
def c26_of_source(t):
    p = _page(t).groupBy("source_file").agg(F.count("*").alias("pages"))
    return _fig(t).groupBy("source_file").agg(F.count_distinct("target_id").alias("targets")).join(p, "source_file")


@BOOK.query("c27_hard_negatives", f"""
WITH p AS (SELECT source_file, pair_id, row_number() OVER (PARTITION BY source_file ORDER BY priority DESC NULLS LAST, pair_id) AS rank FROM {SUP} WHERE NOT coalesce(rule_allowed, false) AND source_file IS NOT NULL)
SELECT f.target_id, p.pair_id, CAST(p.rank AS INTEGER) AS rank FROM (SELECT DISTINCT target_id, source_file FROM figure_targets) f JOIN p USING (source_file) WHERE p.rank <= 3""")
def c27_hard_negatives(t):
    pool = _sup(t).select("source_file", "pair_id", "priority", "rule_allowed")
    return P.hard_negatives(t.figure_targets.select("target_id", "source_file").distinct(), pool, "source_file", "target_id", "pair_id", F.col("rule_allowed"), [F.desc_nulls_last("priority"), F.col("pair_id")], 3)


@BOOK.query("c28_siblings", """
WITH r AS (SELECT DISTINCT page_id, target_id, base_fields['caption_text'] AS c, base_fields['depicted_work_title'] AS w FROM figure_targets WHERE page_id IS NOT NULL)
SELECT a.target_id, min(b.target_id) AS sibling FROM r a JOIN r b ON a.page_id = b.page_id AND a.target_id <> b.target_id AND a.c IS DISTINCT FROM b.c AND a.w IS DISTINCT FROM b.w GROUP BY 1""")
def c28_siblings(t):
    r = t.figure_targets.select("page_id", "target_id", F.col("base_fields")["caption_text"].alias("c"), F.col("base_fields")["depicted_work_title"].alias("w"))
    return P.first_other(r, "page_id", "target_id", ["c", "w"])


@BOOK.query("c29_first_wins", f"SELECT task_id, field, arg_min(pair_id, pair_id) AS pair_id, arg_min(gold_value, pair_id) FILTER (WHERE true) AS gold_value FROM (SELECT task_id, field, pair_id, coalesce(gold_value, '') AS gold_value FROM {SUP} WHERE task_id IS NOT NULL) GROUP BY 1, 2")
def c29_first_wins(t):
    s = _sup(t).where("task_id IS NOT NULL").withColumn("gold_value", F.coalesce("gold_value", F.lit("")))
    return R.keep_first(s, ["task_id", "field"], [F.col("pair_id")]).select("task_id", "field", "pair_id", "gold_value")


@BOOK.query("c30_found_and_missing", f"SELECT f.target_id, c.candidate_id, c.candidate_id IS NULL AS missing FROM (SELECT DISTINCT target_id FROM figure_targets) f LEFT JOIN (SELECT target_id, max(candidate_id) AS candidate_id FROM {CAND} WHERE target_id IS NOT NULL GROUP BY 1) c USING (target_id)")
def c30_found_and_missing(t):
    last = _cand(t).where("target_id IS NOT NULL").groupBy("target_id").agg(F.max("candidate_id").alias("candidate_id"))
    return t.figure_targets.select("target_id").distinct().join(last, "target_id", "left").withColumn("missing", F.col("candidate_id").isNull())


# -- scopes and boxes ------------------------------------------------------------------------------------------------

_SAME = "p.source_file = f.source_file"
_SCOPES = {
    "corpus": "true", "same_document": _SAME,
    "current_page": f"{_SAME} AND (f.page_num IS NULL OR (p.page_num IS NOT NULL AND p.page_num <= f.page_num AND p.page_num >= f.page_num))",
    "nearby_pages": f"{_SAME} AND (f.page_num IS NULL OR p.page_num IS NULL OR (p.page_num <= f.page_num + 1 AND p.page_num >= f.page_num - 1))",
}


@BOOK.query("c13_scopes", "WITH f AS (SELECT DISTINCT target_id, source_file, page_num FROM figure_targets), p AS (SELECT DISTINCT page_id, source_file, page_num FROM page_specs) " + " UNION ALL ".join(f"SELECT '{s}' AS scope, f.target_id, count(*) AS pages FROM f JOIN p ON {c} GROUP BY f.target_id" for s, c in _SCOPES.items() if s != "corpus"))
def c13_scopes(t):
    f = t.figure_targets.select("target_id", F.col("source_file").alias("task_source"), F.col("page_num").alias("task_page")).distinct()
    p = t.page_specs.select("page_id", F.col("source_file").alias("item_source"), F.col("page_num").alias("page_start"), F.col("page_num").alias("page_end")).distinct()
    out = None
    for scope in ("same_document", "current_page", "nearby_pages"):
        one = retrieval.scoped(f, p, scope).groupBy("target_id").agg(F.count("*").alias("pages")).select(F.lit(scope).alias("scope"), "target_id", "pages")
        out = one if out is None else out.unionByName(one)
    return out


@BOOK.query("f40_box_measures", """
SELECT candidate_id, round(CASE WHEN v THEN i / (x + y - i) ELSE 0.0 END, 6) AS iou, round(i / greatest(1.0, CASE WHEN w THEN y ELSE 0.0 END), 6) AS coverage FROM (SELECT candidate_id, u AND w AS v, w, CASE WHEN u THEN CAST(a[3] - a[1] AS DOUBLE) * (a[4] - a[2]) ELSE 0.0 END AS x, CASE WHEN w THEN CAST(c[3] - c[1] AS DOUBLE) * (c[4] - c[2]) ELSE 0.0 END AS y,
 CASE WHEN u AND w THEN CAST(greatest(0, least(a[3], c[3]) - greatest(a[1], c[1])) AS DOUBLE) * greatest(0, least(a[4], c[4]) - greatest(a[2], c[2])) ELSE 0.0 END AS i FROM (SELECT DISTINCT candidate_id, image_bbox AS a, caption_bbox AS c, """ + _VAL.format(b="image_bbox") + " AS u, " + _VAL.format(b="caption_bbox") + " AS w FROM page_candidates))")
def f40_box_measures(t):
    b = t.page_candidates.select("candidate_id", F.col("image_bbox").alias("a"), F.col("caption_bbox").alias("c")).distinct()
    return b.select("candidate_id", F.round(G.iou(F.col("a"), F.col("c")), 6).alias("iou"), F.round(G.coverage(F.col("a"), F.col("c")), 6).alias("coverage"))


@BOOK.query("f45_coerced_boxes", "SELECT candidate_id, CASE WHEN len(b) = 4 AND b[3] > b[1] AND b[4] > b[2] THEN array_to_string(b, ',') END AS box FROM (SELECT DISTINCT candidate_id, list_transform(bbox_pt, lambda v: CAST(round_even(v, 0) AS INTEGER)) AS b FROM page_candidates)")
def f45_coerced_boxes(t):
    b = t.page_candidates.select("candidate_id", "bbox_pt").distinct()
    return b.select("candidate_id", F.array_join(G.coerced(F.col("bbox_pt")).cast("array<string>"), ",").alias("box"))


@BOOK.query("f43_text_share", f"""
WITH f AS (SELECT DISTINCT candidate_id, page_id, image_bbox AS a FROM page_candidates WHERE {_VAL.format(b='image_bbox')}), k AS (SELECT DISTINCT page_id, caption_bbox AS c FROM page_candidates WHERE {_VAL.format(b='caption_bbox')})
SELECT f.candidate_id, round(least(1.0, sum(CASE WHEN k.c IS NULL THEN 0.0 ELSE CAST(greatest(0, least(a[3], c[3]) - greatest(a[1], c[1])) AS DOUBLE) * greatest(0, least(a[4], c[4]) - greatest(a[2], c[2])) END) / (CAST(any_value(a)[3] - any_value(a)[1] AS DOUBLE) * (any_value(a)[4] - any_value(a)[2]))), 6) AS share FROM f LEFT JOIN k USING (page_id) GROUP BY f.candidate_id, f.a""")
def f43_text_share(t):
    b = t.page_candidates
    f = b.where(G.valid(F.col("image_bbox"))).select("candidate_id", "page_id", F.col("image_bbox").alias("a")).distinct()
    k = b.where(G.valid(F.col("caption_bbox"))).select("page_id", F.col("caption_bbox").alias("c")).distinct()
    j = f.join(k, "page_id", "left").groupBy("candidate_id", "a").agg(F.sum(F.coalesce(G.intersection(F.col("a"), F.col("c")), F.lit(0.0))).alias("i"))
    return j.select("candidate_id", F.round(F.least(F.lit(1.0), F.col("i") / G.area(F.col("a"))), 6).alias("share"))


@BOOK.query("f47_coordinate_mode", """
WITH t AS (SELECT DISTINCT target_id, target_bbox_px AS px, target_bbox_norm1000 AS nm, width AS w, height AS h FROM figure_targets WHERE len(target_bbox_px) = 4 AND len(target_bbox_norm1000) = 4 AND width > 0 AND height > 0),
o AS (SELECT target_id, unnest([struct_pack(mode := 'pixels', d := abs(px[1] * 1000.0 / w - nm[1]) + abs(px[2] * 1000.0 / h - nm[2]) + abs(px[3] * 1000.0 / w - nm[3]) + abs(px[4] * 1000.0 / h - nm[4])),
 struct_pack(mode := 'norm1000', d := CAST(abs(px[1] - nm[1]) + abs(px[2] - nm[2]) + abs(px[3] - nm[3]) + abs(px[4] - nm[4]) AS DOUBLE)), struct_pack(mode := 'swapped', d := abs(px[2] * 1000.0 / h - nm[1]) + abs(px[1] * 1000.0 / w - nm[2]) + abs(px[4] * 1000.0 / h - nm[3]) + abs(px[3] * 1000.0 / w - nm[4]))]) AS z FROM t)
SELECT target_id, arg_min(z.mode, struct_pack(a := round(z.d, 4), b := z.mode)) AS mode, round(min(z.d), 4) AS distance FROM o GROUP BY 1""")
def f47_coordinate_mode(t):
    r = t.figure_targets.where((F.size("target_bbox_px") == 4) & (F.size("target_bbox_norm1000") == 4) & (F.col("width") > 0) & (F.col("height") > 0)).select("target_id", "target_bbox_px", "target_bbox_norm1000", "width", "height").distinct()
    modes = G.coordinate_modes(F.col("target_bbox_px"), F.col("target_bbox_norm1000"), F.col("width"), F.col("height"))
    best = r.select("target_id", F.explode(modes).alias("z")).groupBy("target_id").agg(F.min(F.struct(F.round("z.distance", 4).alias("d"), F.col("z.mode").alias("m"))).alias("m"))
    return best.select("target_id", F.col("m.m").alias("mode"), F.col("m.d").alias("distance"))
