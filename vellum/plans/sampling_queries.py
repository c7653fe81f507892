"""Queries of splits and samples with budgets, quotas, caps and replacement, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.functions import geometry as G
from vellum.operators import relational as R
from vellum.operators import sampling, splitting
from vellum.plans.book import Book
from vellum.plans.relational_queries import FIG, PAGE, SUP, _fig, _page, _sup

BOOK = Book()
queries, oracle_sql = (lambda: BOOK.calls), (lambda: BOOK.sql)

_D = "md5(concat_ws('|', {k}, '7'))"
_DOCS = f"(SELECT source_file, count(*) AS pages, CAST(sum(image_count) AS BIGINT) AS units FROM {PAGE} WHERE source_file IS NOT NULL GROUP BY 1)"


def _docs(t):
    return _page(t).where("source_file IS NOT NULL").groupBy("source_file").agg(F.count("*").alias("pages"), F.sum("image_count").alias("units"))


@BOOK.query("sample_density_documents", f"""
WITH RECURSIVE o AS (SELECT source_file, pages, row_number() OVER (ORDER BY units * 1.0 / pages DESC, units DESC, pages, source_file) AS n FROM {_DOCS}),
w AS (SELECT CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS used, CAST(NULL AS VARCHAR) AS picked UNION ALL SELECT o.n, CASE WHEN w.used + o.pages <= 100 THEN w.used + o.pages ELSE w.used END, CASE WHEN w.used + o.pages <= 100 THEN o.source_file END FROM w JOIN o ON o.n = w.n + 1 WHERE w.used < 100)
SELECT picked AS source_file FROM w WHERE picked IS NOT NULL""")
def sample_density_documents(t):
    d = _docs(t)
    order = [(-(F.col("units") / F.col("pages"))).alias("a"), (-F.col("units")).alias("b"), F.col("pages").alias("c"), F.col("source_file").alias("d")]
    return splitting.within_budget(d, order, "source_file", "pages", 100)


_WORTH = "(SELECT f.source_file, count(*) AS n, count(DISTINCT lower(c.caption_text)) AS worth FROM (SELECT DISTINCT target_id, source_file FROM figure_targets) f JOIN (SELECT target_id, min(caption_text) AS caption_text FROM page_candidates WHERE target_id IS NOT NULL GROUP BY 1) c USING (target_id) GROUP BY 1)"


@BOOK.query("sample_reserved_documents", f"""
WITH d AS (SELECT source_file, n, least(worth, 6) AS w, least(n, 6) AS c, row_number() OVER (ORDER BY n DESC, source_file DESC) AS r FROM {_WORTH}), a AS (SELECT *, coalesce(sum(w) OVER (ORDER BY c DESC, n DESC, source_file ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM d WHERE r > 3),
e AS (SELECT *, coalesce(sum(w) OVER (ORDER BY c DESC, n DESC, source_file ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b2 FROM a WHERE b >= 20 OR w <= 0)
SELECT source_file, 'train' AS split FROM d WHERE r <= 3 UNION ALL SELECT source_file, 'val' FROM a WHERE b < 20 AND w > 0 UNION ALL SELECT source_file, CASE WHEN b2 < 30 AND w > 0 THEN 'test' ELSE 'train' END FROM e""")
def sample_reserved_documents(t):
    c = t.page_candidates.where("target_id IS NOT NULL").groupBy("target_id").agg(F.min("caption_text").alias("caption_text"))
    d = t.figure_targets.select("target_id", "source_file").distinct().join(c, "target_id").groupBy("source_file").agg(F.count("*").alias("n"), F.count_distinct(F.lower("caption_text")).alias("worth"))
    return splitting.reserved_documents(d, "source_file", "n", "worth", 3, [("val", 20), ("test", 30)], 6)


@BOOK.query("sample_least_filled", f"""
WITH RECURSIVE s AS (SELECT source_file, count(*) AS c FROM {FIG} WHERE source_file IS NOT NULL GROUP BY 1), g AS (SELECT sum(c) AS total FROM s), o AS (SELECT source_file, c, row_number() OVER (ORDER BY c DESC, source_file) AS n FROM s),
w AS (SELECT CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS a, CAST(0 AS BIGINT) AS b, CAST(0 AS BIGINT) AS d, CAST(NULL AS VARCHAR) AS k, CAST(NULL AS VARCHAR) AS bin
 UNION ALL SELECT n, CASE WHEN bin = 'train' THEN a + c ELSE a END, CASE WHEN bin = 'val' THEN b + c ELSE b END, CASE WHEN bin = 'test' THEN d + c ELSE d END, source_file, bin FROM (SELECT o.n, w.a, w.b, w.d, o.c, o.source_file, (list_sort([struct_pack(f := w.a / greatest(1.0, total * 0.7), h := w.a, i := 0), struct_pack(f := w.b / greatest(1.0, total * 0.15), h := w.b, i := 1), struct_pack(f := w.d / greatest(1.0, total * 0.15), h := w.d, i := 2)])[1]).i AS i,
 CASE i WHEN 0 THEN 'train' WHEN 1 THEN 'val' ELSE 'test' END AS bin FROM w JOIN o ON o.n = w.n + 1, g))
SELECT k AS source_file, bin FROM w WHERE k IS NOT NULL""")
def sample_least_filled(t):
    s = _fig(t).where("source_file IS NOT NULL").groupBy("source_file").agg(F.count("*").alias("c"))
    return splitting.least_filled(s, "source_file", "c", [("train", 0.7), ("val", 0.15), ("test", 0.15)])


_QUOTAS = {s: {"caption_only": a, "retrieve_needed": b, "abstain_needed": c, "wrong_target_negative": d} for s, (a, b, c, d) in {"train": (12, 9, 14, 6), "val": (4, 3, 5, 200), "test": (4, 4, 5, 3)}.items()}


def _isolated_sql() -> str:
    parts, names = [f"r AS (SELECT DISTINCT target_id, trajectory_type AS k, coalesce(d, '') AS d, {_D.format(k='target_id')} AS o FROM (SELECT target_id, min(trajectory_type) AS trajectory_type, min(source_file) AS d FROM figure_targets GROUP BY 1))"], []
    chosen = lambda: "(" + " UNION ALL ".join(f"SELECT target_id, k, d, split FROM {n}" for n in names) + ")"
    for i, (split, per) in enumerate(_QUOTAS.items()):
        for j, (k, q) in enumerate(per.items()):
            free = "" if not names else f" AND NOT EXISTS (SELECT 1 FROM {chosen()} c WHERE c.target_id = r.target_id OR (c.d = r.d AND c.split <> '{split}'))"
            parts.append(f"s{i}{j} AS MATERIALIZED (SELECT target_id, k, d, '{split}' AS split FROM r WHERE k = '{k}'{free} ORDER BY o, target_id LIMIT {q})")
            names.append(f"s{i}{j}")
    for i, (split, per) in enumerate(_QUOTAS.items()):
        for j, (k, q) in enumerate(per.items()):
            have = f"(SELECT count(*) FROM s{i}{j})"
            parts.append(f"f{i}{j} AS MATERIALIZED (SELECT target_id, k, d, '{split}' AS split FROM (SELECT *, row_number() OVER (ORDER BY o, target_id) AS n FROM r WHERE k = '{k}' AND NOT EXISTS (SELECT 1 FROM {chosen()} c WHERE c.target_id = r.target_id)) WHERE n <= {q} - {have})")
            names.append(f"f{i}{j}")
    return "WITH " + ", ".join(parts) + f" SELECT target_id, split FROM {chosen()}"


@BOOK.query("sample_isolated_quotas", _isolated_sql())
def sample_isolated_quotas(t):
    r = t.figure_targets.groupBy("target_id").agg(F.min("trajectory_type").alias("trajectory_type"), F.min("source_file").alias("source_file"))
    return splitting.isolated_quotas(r, "target_id", "trajectory_type", "source_file", _QUOTAS)


@BOOK.query("sample_stratified_take", f"SELECT pair_id, candidate_kind FROM (SELECT pair_id, candidate_kind, row_number() OVER (PARTITION BY candidate_kind ORDER BY {_D.format(k='pair_id')}, pair_id) AS r, CASE candidate_kind WHEN 'same_page_body' THEN 1 WHEN 'local_caption_visual' THEN 2 ELSE 3 END AS p FROM {SUP} WHERE candidate_kind IN ('same_page_body', 'local_caption_visual', 'wrong_target_caption')) WHERE r <= 34 ORDER BY p, r LIMIT 100")
def sample_stratified_take(t):
    return splitting.stratified_take(_sup(t).select("pair_id", "candidate_kind"), "candidate_kind", ["same_page_body", "local_caption_visual", "wrong_target_caption"], "pair_id", 100).select("pair_id", "candidate_kind")


@BOOK.query("sample_sources_in_turn", "SELECT page_id, row_number() OVER (ORDER BY turn, -size, source_file, page_id) AS place FROM (SELECT page_id, source_file, row_number() OVER (PARTITION BY source_file ORDER BY page_id) AS turn, count(*) OVER (PARTITION BY source_file) AS size FROM (SELECT page_id, min(source_file) AS source_file FROM page_specs WHERE source_file IS NOT NULL GROUP BY 1))")
def sample_sources_in_turn(t):
    p = t.page_specs.where("source_file IS NOT NULL").groupBy("page_id").agg(F.min("source_file").alias("source_file"))
    return splitting.sources_in_turn(p, "source_file", ["page_id"]).select("page_id", "place")


_WANTED = {"click": 40, "error": 25, "purchase": 30000, "view": 10}


@BOOK.query("sample_with_replacement", "WITH w(event_type, want) AS (VALUES " + ", ".join(f"('{k}', {v})" for k, v in _WANTED.items()) + f"), r AS (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY {_D.format(k='event_id')}, event_id) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT event_type, event_id, unnest(generate_series(r, want, n)) AS draw FROM r JOIN w USING (event_type) WHERE r <= want")
def sample_with_replacement(t):
    return splitting.with_replacement(t.events.select("event_type", "event_id"), "event_type", "event_id", _WANTED)


@BOOK.query("sample_balanced_actions", f"SELECT event_id, turn FROM (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY {_D.format(k='event_id')}, event_id) AS turn FROM events) ORDER BY turn, event_type LIMIT 150")
def sample_balanced_actions(t):
    return sampling.balanced(t.events.select("event_id", "event_type"), "event_type", "event_id", 150).select("event_id", F.col("turn").cast("bigint").alias("turn"))


@BOOK.query("sample_replay_mix", f"WITH p AS (SELECT count(DISTINCT target_id) AS n FROM figure_targets WHERE split = 'val'), o AS (SELECT target_id, row_number() OVER (ORDER BY {_D.format(k='target_id')}, target_id) AS r, count(*) OVER () AS total FROM (SELECT DISTINCT target_id FROM figure_targets WHERE split = 'train')) SELECT target_id FROM o, p WHERE r <= least(total, CAST(round_even(n * 0.25 / 0.75, 0) AS BIGINT))")
def sample_replay_mix(t):
    f = t.figure_targets
    patch, pool = f.where("split = 'val'").select("target_id").distinct().count(), f.where("split = 'train'").select("target_id").distinct()
    return pool.orderBy(sampling.digest("target_id", 7), "target_id").limit(sampling.replay_size(patch, 0.25, pool.count()))


@BOOK.query("sample_audit", f"""
WITH b AS (SELECT pair_id, candidate_kind AS k, coalesce(priority >= 8, false) AS u, {_D.format(k='pair_id')} AS o FROM (SELECT DISTINCT pair_id, candidate_kind, priority FROM support_candidates)), a1 AS MATERIALIZED (SELECT pair_id, k FROM b WHERE u ORDER BY o, pair_id LIMIT 40),
r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY o, pair_id) AS n FROM b WHERE pair_id NOT IN (SELECT pair_id FROM a1)), a2 AS MATERIALIZED (SELECT pair_id, k FROM r WHERE n <= 80 // (SELECT count(DISTINCT k) FROM b) ORDER BY o, pair_id LIMIT 80),
a3 AS (SELECT pair_id, k FROM (SELECT *, row_number() OVER (ORDER BY o, pair_id) AS m FROM r WHERE pair_id NOT IN (SELECT pair_id FROM a2)) WHERE m <= 120 - (SELECT count(*) FROM a1) - (SELECT count(*) FROM a2))
SELECT pair_id, k AS candidate_kind, 'urgent' AS part FROM a1 UNION ALL SELECT pair_id, k, 'bucket' FROM a2 UNION ALL SELECT pair_id, k, 'fill' FROM a3""")
def sample_audit(t):
    s = t.support_candidates.select("pair_id", "candidate_kind", "priority").distinct()
    return splitting.audit_sample(s, "candidate_kind", "pair_id", F.col("priority") >= 8, 120)


@BOOK.query("sample_diverse", f"""
WITH b AS (SELECT pair_id, source_file AS s, source_file || '|' || field AS k, struct_pack(a := {_D.format(k='pair_id')}, b := pair_id) AS o FROM (SELECT DISTINCT pair_id, source_file, field FROM support_candidates WHERE source_file IS NOT NULL AND field IS NOT NULL)),
f AS MATERIALIZED (SELECT min(o) AS o FROM b GROUP BY s ORDER BY 1 LIMIT 8), p AS (SELECT CASE WHEN count(*) = 8 THEN max(o) END AS m FROM f), x AS (SELECT b.*, CASE WHEN o IN (SELECT o FROM f) THEN 0 WHEN m IS NOT NULL AND o > m THEN 1 ELSE 2 END AS ph FROM b, p),
d AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY ph, o) AS n FROM x) SELECT pair_id FROM d WHERE n = 1 ORDER BY ph, o LIMIT 16""")
def sample_diverse(t):
    s = t.support_candidates.where("source_file IS NOT NULL AND field IS NOT NULL").select("pair_id", "source_file", F.concat_ws("|", "source_file", "field").alias("same")).distinct()
    return splitting.diverse_take(s, "pair_id", "source_file", "same", 16)


@BOOK.query("sample_capped_pages", f"WITH a AS (SELECT *, row_number() OVER (PARTITION BY source_file ORDER BY score DESC NULLS LAST, page_id) AS i FROM {PAGE}), b AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY score DESC NULLS LAST, page_id) AS o FROM a WHERE i <= 3) SELECT page_id, category FROM b WHERE o <= 12")
def sample_capped_pages(t):
    return splitting.capped_twice(_page(t), "source_file", "category", [F.desc_nulls_last("score"), F.col("page_id")], 3, 12).select("page_id", "category")


@BOOK.query("sample_review", f"""
WITH r AS (SELECT target_id, split, confidence, row_number() OVER (PARTITION BY split ORDER BY confidence NULLS LAST, target_id) AS n FROM (SELECT target_id, min(split) AS split, min(confidence) AS confidence FROM figure_targets GROUP BY 1) WHERE split IS NOT NULL)
SELECT target_id, split, confidence < 0.2 AS forced FROM r WHERE confidence < 0.2 OR n <= CASE split WHEN 'train' THEN 62 WHEN 'val' THEN 19 ELSE 19 END""")
def sample_review(t):
    r = t.figure_targets.groupBy("target_id").agg(F.min("split").alias("split"), F.min("confidence").alias("confidence")).where("split IS NOT NULL")
    kept = R.keep_ranked(r, ["split"], [F.asc_nulls_last("confidence"), F.col("target_id")], F.when(F.col("split") == "train", 62).otherwise(19), F.col("confidence") < 0.2)
    return kept.select("target_id", "split", (F.col("confidence") < 0.2).alias("forced"))


@BOOK.query("sample_oversampled", "SELECT event_id, CAST(unnest(generate_series(1, CASE WHEN event_type = 'purchase' THEN 3 ELSE 1 END)) AS INTEGER) AS copy FROM events")
def sample_oversampled(t):
    return R.copies(t.events.select("event_id", "event_type"), F.when(F.col("event_type") == "purchase", 3).otherwise(1)).select("event_id", "copy")


@BOOK.query("sample_hard_oversampled", f"SELECT pair_id, CAST(unnest(generate_series(1, CASE WHEN rank > 1 THEN 2 ELSE 1 END)) AS INTEGER) AS copy FROM (SELECT pair_id, rule_label, row_number() OVER (PARTITION BY task_id ORDER BY priority DESC NULLS LAST, pair_id) AS rank FROM {SUP} WHERE task_id IS NOT NULL) WHERE rule_label = 'support'")
def sample_hard_oversampled(t):
    from pyspark.sql import Window

    r = _sup(t).where("task_id IS NOT NULL").withColumn("rank", F.row_number().over(Window.partitionBy("task_id").orderBy(F.desc_nulls_last("priority"), "pair_id"))).where("rule_label = 'support'")
    return R.copies(r, F.when(F.col("rank") > 1, 2).otherwise(1)).select("pair_id", "copy")


_J = "[{b}[i] + CAST('0x' || substring(md5(concat_ws('|', target_id, '{c}')), (i - 1) * 4 + 1, 4) AS INTEGER) % 41 - 20 for i in [1, 2, 3, 4]]"
_IU = "(CAST(greatest(0, least(a[3], j[3]) - greatest(a[1], j[1])) AS DOUBLE) * greatest(0, least(a[4], j[4]) - greatest(a[2], j[2])))"


@BOOK.query("sample_jittered_boxes", "WITH b AS (SELECT target_id, min(target_bbox_px) AS a FROM figure_targets WHERE len(target_bbox_px) = 4 GROUP BY 1), k AS (" + " UNION ALL ".join(f"SELECT target_id, a, {c} AS copy, {_J.format(b='a', c=c)} AS j FROM b" for c in (1, 2)) + f") SELECT target_id, copy, array_to_string(j, ',') AS box FROM k WHERE a[3] > a[1] AND a[4] > a[2] AND j[3] > j[1] AND j[4] > j[2] AND {_IU} / (CAST(a[3] - a[1] AS DOUBLE) * (a[4] - a[2]) + CAST(j[3] - j[1] AS DOUBLE) * (j[4] - j[2]) - {_IU}) >= 0.55")
def sample_jittered_boxes(t):
    b = t.figure_targets.where(F.size("target_bbox_px") == 4).groupBy("target_id").agg(F.min("target_bbox_px").alias("a"))
    k = b.select("target_id", "a", F.explode(F.array(*[F.struct(F.lit(c).alias("copy"), splitting.jittered(F.col("a"), F.col("target_id"), 20, c).alias("j")) for c in (1, 2)])).alias("z")).select("target_id", "a", "z.copy", "z.j")
    return k.where(G.iou(F.col("a"), F.col("j")) >= 0.55).select("target_id", "copy", F.array_join(F.col("j").cast("array<string>"), ",").alias("box"))
