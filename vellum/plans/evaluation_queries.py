"""Queries of reports over predictions, rankings and runs, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from vellum.functions import geometry as G
from vellum.functions import measures as M
from vellum.operators import evaluation as E
from vellum.operators import noise
from vellum.operators import relational as R
from vellum.plans.book import Book
from vellum.plans.relational_queries import _CLASS_SQL, _SCORE_SQL, CAND, FIG, PAGE, SUP, _classified, _fig, _page, _sup

BOOK = Book()
queries, oracle_sql = (lambda: BOOK.calls), (lambda: BOOK.sql)


@BOOK.query("d2_noisiest_sources", _CLASS_SQL + f"SELECT source, count(*) AS rows, count(*) FILTER (WHERE {_SCORE_SQL} >= 0.02) AS noisy, round(count(*) FILTER (WHERE {_SCORE_SQL} >= 0.02) * 1.0 / count(*), 6) AS noise_rate FROM c GROUP BY source ORDER BY noise_rate DESC, noisy DESC, source LIMIT 20")
def d2_noisiest_sources(t):
    return noise.noisiest_sources(_classified(t), 20, at=0.02)


@BOOK.query("d8_map_sums", f"SELECT category, 'images' AS key, CAST(sum(image_count) AS BIGINT) AS total FROM {PAGE} GROUP BY 1 UNION ALL SELECT category, 'anchors', CAST(sum(figure_anchor_count) AS BIGINT) FROM {PAGE} GROUP BY 1 UNION ALL SELECT category, 'terms', CAST(sum(landscape_term_count) AS BIGINT) FROM {PAGE} GROUP BY 1")
def d8_map_sums(t):
    p = _page(t).withColumn("counters", F.create_map(F.lit("images"), "image_count", F.lit("anchors"), "figure_anchor_count", F.lit("terms"), "landscape_term_count"))
    return E.map_sums(p, "category", "counters")


_RUNS = "(SELECT pair_id, task_id, field, gold_abstain, rule_label, rule_confidence, unnest(used_by_runs) AS run, cited_by_runs FROM (SELECT DISTINCT pair_id, task_id, field, gold_abstain, rule_label, rule_confidence, used_by_runs, cited_by_runs FROM support_candidates))"


@BOOK.query("d11_run_summary", f"""
SELECT run, count(*) AS used, count(DISTINCT task_id) AS tasks, round(avg(CASE WHEN list_contains(cited_by_runs, run) THEN 1.0 ELSE 0.0 END), 6) AS cited_rate, round(avg(CASE WHEN gold_abstain THEN 1.0 ELSE 0.0 END), 6) AS abstain_rate,
 round(count(*) FILTER (WHERE rule_label = 'support') * 1.0 / greatest(1, count(rule_label)), 6) AS support_rate_labelled, round(avg(rule_confidence), 6) AS mean_confidence, round(avg(coalesce(rule_confidence, 0)), 6) AS mean_confidence_all,
 count(*) FILTER (WHERE rule_label = 'wrong_target') AS wrong_targets FROM {_RUNS} GROUP BY run""")
def d11_run_summary(t):
    s = t.support_candidates.select("pair_id", "task_id", "field", "gold_abstain", "rule_label", "rule_confidence", "used_by_runs", "cited_by_runs").distinct()
    u = s.withColumn("run", F.explode("used_by_runs"))
    yes = lambda c: F.round(F.avg(F.coalesce(c, F.lit(False)).cast("double")), 6)
    return u.groupBy("run").agg(
        F.count("*").alias("used"), F.count_distinct("task_id").alias("tasks"), yes(F.array_contains("cited_by_runs", F.col("run"))).alias("cited_rate"), yes(F.col("gold_abstain")).alias("abstain_rate"),
        F.round(F.count_if(F.col("rule_label") == "support") / F.greatest(F.lit(1), F.count("rule_label")), 6).alias("support_rate_labelled"), F.round(F.avg("rule_confidence"), 6).alias("mean_confidence"),
        F.round(F.avg(F.coalesce("rule_confidence", F.lit(0.0))), 6).alias("mean_confidence_all"), F.count_if(F.col("rule_label") == "wrong_target").alias("wrong_targets"),
    )


@BOOK.query("d12_group_summary", f"""
WITH g AS (SELECT task_id, avg(rule_confidence) AS m, stddev_pop(rule_confidence) AS s, count(rule_confidence) AS n FROM {SUP} WHERE task_id IS NOT NULL GROUP BY 1 HAVING count(rule_confidence) > 0)
SELECT count(*) AS groups, CAST(sum(n) AS BIGINT) AS samples, round(avg(m), 6) AS mean_of_means, round(avg(s), 6) AS mean_deviation, round(avg(CASE WHEN s > 1e-6 THEN 1.0 ELSE 0.0 END), 6) AS varied FROM g""")
def d12_group_summary(t):
    g = _sup(t).where("task_id IS NOT NULL AND rule_confidence IS NOT NULL").groupBy("task_id").agg(F.avg("rule_confidence").alias("m"), F.stddev_pop("rule_confidence").alias("s"), F.count("*").alias("n"))
    return g.agg(F.count("*").alias("groups"), F.sum("n").alias("samples"), F.round(F.avg("m"), 6).alias("mean_of_means"), F.round(F.avg("s"), 6).alias("mean_deviation"), F.round(F.avg((F.col("s") > 1e-6).cast("double")), 6).alias("varied"))


@BOOK.query("d14_claim_scores", """
WITH s AS (SELECT DISTINCT pair_id, task_id, field, rule_label AS l, coalesce(len(cited_by_runs), 0) > 0 AS c FROM support_candidates),
q AS (SELECT field, task_id, bool_or(c) AS w, bool_or(coalesce(l = 'support', false)) AS g, bool_or(coalesce(l = 'support', false) AND c) AS b, count(*) FILTER (WHERE c) AS cited, count(*) FILTER (WHERE c AND l = 'support') AS positive, count(*) FILTER (WHERE l = 'support') AS known,
 count(*) FILTER (WHERE c AND l = 'wrong_target') AS wt, count(*) FILTER (WHERE c AND l = 'ambiguous') AS am, count(*) FILTER (WHERE c AND l = 'no_support') AS ns, count(*) FILTER (WHERE c AND l IS NOT NULL) AS la FROM s GROUP BY 1, 2),
f AS (SELECT coalesce(field, 'all') AS field, count(*) FILTER (WHERE w AND b) AS tp, count(*) FILTER (WHERE w AND NOT b) AS fp, count(*) FILTER (WHERE g AND NOT b) AS fn, CAST(sum(cited) AS BIGINT) AS cited, sum(positive) AS positive, sum(known) AS known, sum(wt) AS wt, sum(am) AS am, sum(ns) AS ns, sum(la) AS la FROM q GROUP BY ROLLUP (field)),
r AS (SELECT *, tp * 1.0 / greatest(1, tp + fp) AS p, tp * 1.0 / greatest(1, tp + fn) AS rc FROM f)
SELECT field, tp, fp, fn, round(p, 6) AS precision, round(rc, 6) AS recall, round(CASE WHEN p <= 0 OR rc <= 0 THEN 0 ELSE 2 * p * rc / (p + rc) END, 6) AS f1, cited, round(positive / greatest(1, cited), 6) AS cited_precision, round(positive / greatest(1, known), 6) AS cited_recall,
 round(wt / greatest(1, cited), 6) AS wrong_target_rate, round(am / greatest(1, cited), 6) AS ambiguous_rate, round(ns / greatest(1, cited), 6) AS no_support_rate, round(la / greatest(1, cited), 6) AS labelled_rate FROM r""")
def d14_claim_scores(t):
    s = t.support_candidates.select("pair_id", "task_id", "field", "rule_label", "cited_by_runs").distinct()
    return E.claim_scores(s, ["task_id"], "field", F.size(F.coalesce("cited_by_runs", F.array().cast("array<string>"))) > 0, F.col("rule_label"))


@BOOK.query("d16_set_scores_both_empty", """
WITH s AS (SELECT DISTINCT pair_id, list_distinct(coalesce(cited_by_runs, [])) AS p, list_distinct(coalesce(used_by_runs, [])) AS g FROM support_candidates),
q AS (SELECT pair_id, CASE WHEN len(p) = 0 AND len(g) = 0 THEN 1.0 ELSE len(list_intersect(p, g)) * 1.0 / greatest(1, len(p)) END AS pr, CASE WHEN len(p) = 0 AND len(g) = 0 THEN 1.0 ELSE len(list_intersect(p, g)) * 1.0 / greatest(1, len(g)) END AS re FROM s)
SELECT pair_id, round(pr, 6) AS precision, round(re, 6) AS recall, round(CASE WHEN pr <= 0 OR re <= 0 THEN 0 ELSE 2 * pr * re / (pr + re) END, 6) AS f1 FROM q""")
def d16_set_scores_both_empty(t):
    s = t.support_candidates.select("pair_id", "cited_by_runs", "used_by_runs").distinct().withColumn("s", M.set_scores(F.col("cited_by_runs"), F.col("used_by_runs"), True))
    return s.select("pair_id", *[F.round(F.col("s")[c], 6).alias(c) for c in ("precision", "recall", "f1")])


@BOOK.query("d17_label_report", f"""
WITH x AS (SELECT rule_label AS g, CASE WHEN rule_confidence >= 0.7 THEN 'support' WHEN rule_confidence >= 0.3 THEN 'ambiguous' ELSE 'no_support' END AS p FROM {SUP} WHERE rule_label IS NOT NULL),
l AS (SELECT g AS label, count(*) AS gold, 0 AS said, count(*) FILTER (WHERE g = p) AS hit FROM x GROUP BY 1 UNION ALL SELECT p, 0, count(*), 0 FROM x GROUP BY 1),
s AS (SELECT coalesce(label, 'all') AS label, CAST(sum(gold) AS BIGINT) AS gold, CAST(sum(said) AS BIGINT) AS said, CAST(sum(hit) AS BIGINT) AS hit FROM l GROUP BY ROLLUP (label)), r AS (SELECT *, hit * 1.0 / greatest(1, said) AS p, hit * 1.0 / greatest(1, gold) AS rc FROM s)
SELECT label, gold, said, hit, round(p, 6) AS precision, round(rc, 6) AS recall, round(CASE WHEN p <= 0 OR rc <= 0 THEN 0 ELSE 2 * p * rc / (p + rc) END, 6) AS f1 FROM r""")
def d17_label_report(t):
    c = F.col("rule_confidence")
    return E.label_report(_sup(t), F.col("rule_label"), F.when(c >= 0.7, "support").when(c >= 0.3, "ambiguous").otherwise("no_support"))


@BOOK.query("d22_scope_stats", f"""
WITH g AS (SELECT task_id, list(DISTINCT evidence_id) AS gold FROM {SUP} WHERE rule_label = 'support' GROUP BY 1), c AS (SELECT task_id, candidate_kind, list(DISTINCT evidence_id) FILTER (WHERE priority >= 4) AS results FROM {SUP} WHERE task_id IS NOT NULL GROUP BY 1, 2)
SELECT candidate_kind, count(*) AS calls, count(*) FILTER (WHERE coalesce(len(results), 0) > 0) AS filled, count(*) FILTER (WHERE len(list_intersect(coalesce(results, []), coalesce(gold, []))) > 0) AS hits FROM c LEFT JOIN g USING (task_id) GROUP BY 1""")
def d22_scope_stats(t):
    s = _sup(t)
    gold = s.where("rule_label = 'support'").groupBy("task_id").agg(F.collect_set("evidence_id").alias("gold"))
    calls = s.where("task_id IS NOT NULL").groupBy("task_id", "candidate_kind").agg(F.collect_set(F.when(F.col("priority") >= 4, F.col("evidence_id"))).alias("results"))
    return E.scope_stats(calls.join(gold, "task_id", "left"), "candidate_kind", "results", "gold")


_RANKED = f"(SELECT task_id, evidence_id, rule_label, page, candidate_kind, fragment_text, row_number() OVER (PARTITION BY task_id ORDER BY priority DESC NULLS LAST, pair_id) AS rank FROM {SUP} WHERE task_id IS NOT NULL)"


def _ranked(t):
    w = Window.partitionBy("task_id").orderBy(F.desc_nulls_last("priority"), "pair_id")
    return _sup(t).where("task_id IS NOT NULL").withColumn("rank", F.row_number().over(w))


@BOOK.query("d23_hit_rates", f"SELECT count(*) AS queries, round(avg(CASE WHEN f THEN 1.0 ELSE 0.0 END), 6) AS top1_rate, round(avg(CASE WHEN a THEN 1.0 ELSE 0.0 END), 6) AS any_rate FROM (SELECT task_id, bool_or(coalesce(rule_label = 'support', false) AND rank = 1) AS f, bool_or(coalesce(rule_label = 'support', false)) AS a FROM {_RANKED} WHERE rank <= 3 GROUP BY 1)")
def d23_hit_rates(t):
    r = _ranked(t).where("rank <= 3").withColumn("gold", F.col("rule_label").eqNullSafe(F.lit("support")))
    per = r.groupBy("task_id").agg(F.bool_or(F.col("gold") & (F.col("rank") == 1)).alias("f"), F.bool_or("gold").alias("a"))
    return per.agg(F.count("*").alias("queries"), F.round(F.avg(F.col("f").cast("double")), 6).alias("top1_rate"), F.round(F.avg(F.col("a").cast("double")), 6).alias("any_rate"))


@BOOK.query("d24_rank_pollution", f"""
WITH k AS (SELECT evidence_id, bool_or(candidate_kind = 'wrong_target_caption') AS noisy FROM {SUP} WHERE page IS NOT NULL AND evidence_id IS NOT NULL GROUP BY 1), s AS (SELECT r.task_id, r.rank, k.noisy AS n, coalesce(k.noisy, false) AS noisy FROM {_RANKED} r LEFT JOIN k USING (evidence_id) WHERE rank <= 5),
c AS (SELECT task_id, bool_or(noisy AND rank = 1) AS f, bool_or(noisy) AS a FROM s GROUP BY 1)
SELECT CAST(rank AS INTEGER) AS rank, count(*) AS results, count(*) FILTER (WHERE noisy) AS noisy, count(*) FILTER (WHERE n IS NULL) AS missing FROM s GROUP BY 1 UNION ALL SELECT 0, count(*), count(*) FILTER (WHERE f), count(*) FILTER (WHERE a) FROM c""")
def d24_rank_pollution(t):
    # The index holds the evidence whose page is known; captions of other targets are its noise.
    index = _sup(t).where("page IS NOT NULL AND evidence_id IS NOT NULL").groupBy("evidence_id").agg(F.bool_or(F.col("candidate_kind") == "wrong_target_caption").alias("noisy"))
    return E.rank_pollution(_ranked(t), index, ["task_id"], "evidence_id")


_IOU = "CASE WHEN len(a) = 4 AND len(b) = 4 AND a[3] > a[1] AND a[4] > a[2] AND b[3] > b[1] AND b[4] > b[2] THEN (CAST(greatest(0, least(a[3], b[3]) - greatest(a[1], b[1])) AS DOUBLE) * greatest(0, least(a[4], b[4]) - greatest(a[2], b[2]))) / (CAST(a[3] - a[1] AS DOUBLE) * (a[4] - a[2]) + CAST(b[3] - b[1] AS DOUBLE) * (b[4] - b[2]) - CAST(greatest(0, least(a[3], b[3]) - greatest(a[1], b[1])) AS DOUBLE) * greatest(0, least(a[4], b[4]) - greatest(a[2], b[2]))) END"


@BOOK.query("d25_box_rates", f"""
WITH x AS (SELECT f.target_id, c.candidate_id, c.caption_score, {_IOU} AS v FROM (SELECT target_id, page_id, min(target_bbox_px) AS a FROM figure_targets WHERE page_id IS NOT NULL GROUP BY 1, 2) f JOIN (SELECT DISTINCT candidate_id, page_id, image_bbox AS b, caption_score FROM page_candidates) c USING (page_id)),
p AS (SELECT target_id, max(v) AS best, arg_max(coalesce(v, -1.0), struct_pack(s := coalesce(caption_score, -1e9), k := candidate_id)) AS first FROM x GROUP BY 1)
SELECT count(*) AS tasks, round(avg(CASE WHEN best >= 0.5 THEN 1.0 ELSE 0.0 END), 6) AS best_50, round(avg(CASE WHEN best >= 0.7 THEN 1.0 ELSE 0.0 END), 6) AS best_70, round(avg(CASE WHEN first >= 0.5 THEN 1.0 ELSE 0.0 END), 6) AS first_50, round(avg(CASE WHEN first >= 0.7 THEN 1.0 ELSE 0.0 END), 6) AS first_70 FROM p""")
def d25_box_rates(t):
    f = t.figure_targets.where("page_id IS NOT NULL").groupBy("target_id", "page_id").agg(F.min("target_bbox_px").alias("a"))
    c = t.page_candidates.select("candidate_id", "page_id", F.col("image_bbox").alias("b"), "caption_score").distinct()
    v = G.iou(F.col("a"), F.col("b"), -1.0)
    per = f.join(c, "page_id").withColumn("v", v).groupBy("target_id").agg(F.max("v").alias("best"), F.max_by("v", F.struct(F.coalesce("caption_score", F.lit(-1e9)), "candidate_id")).alias("first"))
    return E.threshold_rates(per, "best", "first")


@BOOK.query("d26_process_profile", """
WITH s AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS step FROM events), h AS (SELECT user_id, count(*) AS steps, min(step) FILTER (WHERE event_type = 'view') AS first_read, min(step) FILTER (WHERE event_type = 'purchase') AS first_write FROM s GROUP BY 1)
SELECT user_id, steps, CAST(first_read AS INTEGER) AS first_read, CAST(first_write AS INTEGER) AS first_write, (SELECT count(*) FROM s WHERE s.user_id = h.user_id AND event_type = 'purchase' AND (first_read IS NULL OR step < first_read)) AS early_writes, first_read IS NOT NULL AND first_write IS NOT NULL AS both FROM h""")
def d26_process_profile(t):
    s = t.events.select("user_id", "event_type", (F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1).alias("step"))
    return E.process_profile(s, "user_id", "step", "event_type", "view", "purchase")


@BOOK.query("d27_marked_rate", f"SELECT field, round(count(*) FILTER (WHERE contains(rule_reason, 'page')) * 1.0 / greatest(1, count(*)), 6) AS rate, count(*) AS rows FROM (SELECT DISTINCT pair_id, field, rule_reason FROM support_candidates) GROUP BY 1")
def d27_marked_rate(t):
    s = t.support_candidates.select("pair_id", "field", "rule_reason").distinct()
    return s.groupBy("field").agg(F.round(F.count_if(F.contains("rule_reason", F.lit("page"))) / F.greatest(F.lit(1), F.count("*")), 6).alias("rate"), F.count("*").alias("rows"))


@BOOK.query("d29_runs_of_evidence", "SELECT task_id, evidence_id, array_to_string(list_sort(list(DISTINCT run)), ',') AS runs FROM (SELECT task_id, evidence_id, unnest(used_by_runs) AS run FROM support_candidates WHERE task_id IS NOT NULL AND evidence_id IS NOT NULL) GROUP BY 1, 2")
def d29_runs_of_evidence(t):
    s = t.support_candidates.where("task_id IS NOT NULL AND evidence_id IS NOT NULL").select("task_id", "evidence_id", F.explode("used_by_runs").alias("run"))
    return s.groupBy("task_id", "evidence_id").agg(F.array_join(F.array_sort(F.collect_set("run")), ",").alias("runs"))


@BOOK.query("d31_reason_counts", "SELECT source_role, reason, count(*) AS n FROM (SELECT pair_id, source_role, unnest(string_split(rule_reason, ' ')) AS reason FROM (SELECT DISTINCT pair_id, source_role, rule_reason FROM support_candidates WHERE rule_reason IS NOT NULL)) WHERE reason <> '' GROUP BY 1, 2")
def d31_reason_counts(t):
    s = t.support_candidates.where("rule_reason IS NOT NULL").select("pair_id", "source_role", "rule_reason").distinct()
    return s.select("source_role", F.explode(F.split("rule_reason", " ")).alias("reason")).where("reason <> ''").groupBy("source_role", "reason").agg(F.count("*").alias("n"))


@BOOK.query("d31_worst", f"SELECT task_id, round(avg(rule_confidence), 6) AS score, count(*) AS rows FROM {SUP} WHERE task_id IS NOT NULL AND rule_confidence IS NOT NULL GROUP BY 1 ORDER BY 2, 1 LIMIT 5")
def d31_worst(t):
    return _sup(t).where("task_id IS NOT NULL AND rule_confidence IS NOT NULL").groupBy("task_id").agg(F.round(F.avg("rule_confidence"), 6).alias("score"), F.count("*").alias("rows")).orderBy("score", "task_id").limit(5)


@BOOK.query("d34_manifest", f"SELECT 'pages' AS relation, count(*) AS rows FROM {PAGE} UNION ALL SELECT 'candidates', count(*) FROM {CAND} UNION ALL SELECT 'targets', count(*) FROM {FIG} UNION ALL SELECT 'fragments', count(*) FROM {SUP}")
def d34_manifest(t):
    from vellum.plans.relational_queries import _cand

    return E.manifest({"pages": _page(t), "candidates": _cand(t), "targets": _fig(t), "fragments": _sup(t)})


@BOOK.query("d35_verdict_rates", f"SELECT candidate_kind, count(*) AS rows, count(rule_label) AS judged, round(count(*) FILTER (WHERE rule_label = 'support') * 1.0 / greatest(1, count(rule_label)), 6) AS support_rate, round(count(*) FILTER (WHERE rule_label = 'wrong_target') * 1.0 / greatest(1, count(rule_label)), 6) AS wrong_rate FROM {SUP} GROUP BY 1")
def d35_verdict_rates(t):
    judged = F.greatest(F.lit(1), F.count("rule_label"))
    return _sup(t).groupBy("candidate_kind").agg(F.count("*").alias("rows"), F.count("rule_label").alias("judged"), F.round(F.count_if(F.col("rule_label") == "support") / judged, 6).alias("support_rate"), F.round(F.count_if(F.col("rule_label") == "wrong_target") / judged, 6).alias("wrong_rate"))


@BOOK.query("d18_sequence_ends", """
WITH s AS (SELECT DISTINCT pair_id, coalesce(used_by_runs, []) AS g, coalesce(cited_by_runs, []) AS p FROM support_candidates)
SELECT pair_id, coalesce(g[1] = p[1], false) AS first_equal, coalesce(g[len(g)] = p[len(p)], false) AS last_equal, len(g) = len(p) AS same_length FROM s""")
def d18_sequence_ends(t):
    none = F.array().cast("array<string>")
    s = t.support_candidates.select("pair_id", F.coalesce("used_by_runs", none).alias("g"), F.coalesce("cited_by_runs", none).alias("p")).distinct()
    end = lambda i: F.coalesce(F.try_element_at("g", F.lit(i)) == F.try_element_at("p", F.lit(i)), F.lit(False))
    return s.select("pair_id", end(1).alias("first_equal"), end(-1).alias("last_equal"), (F.size("g") == F.size("p")).alias("same_length"))


@BOOK.query("w9_last_per_key", "SELECT event_type, max(event_id) AS event_id, arg_max(value, struct_pack(a := ts, b := event_id)) AS value FROM events GROUP BY 1")
def w9_last_per_key(t):
    return t.events.groupBy("event_type").agg(F.max("event_id").alias("event_id"), F.max_by("value", F.struct("ts", "event_id")).alias("value"))
