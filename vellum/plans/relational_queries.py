"""Queries of the relational operators over whole tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from vellum.functions import measures as M
from vellum.operators import noise, relational as R
from vellum.plans.book import Book

BOOK = Book()
queries, oracle_sql = (lambda: BOOK.calls), (lambda: BOOK.sql)

SUP = "(SELECT DISTINCT pair_id, task_id, field, gold_value, gold_abstain, evidence_id, fragment_id, source_role, source_file, page, candidate_kind, priority, rule_label, rule_allowed, rule_confidence, fragment_text FROM support_candidates)"
FIG = "(SELECT DISTINCT target_id, page_id, doc_id, source_file, category, page_num, width, height, confidence, trajectory_type, split FROM figure_targets)"
CAND = "(SELECT DISTINCT candidate_id, page_id, target_id, source_file, page, area_ratio, caption_score, caption_text FROM page_candidates)"
PAGE = "(SELECT DISTINCT page_id, doc_id, source_file, page_num, category, score, image_count, figure_anchor_count, landscape_term_count, text_preview FROM page_specs)"


def _sup(t):
    return t.support_candidates.select("pair_id", "task_id", "field", "gold_value", "gold_abstain", "evidence_id", "fragment_id", "source_role", "source_file", "page", "candidate_kind", "priority", "rule_label", "rule_allowed", "rule_confidence", "fragment_text").distinct()


def _fig(t):
    return t.figure_targets.select("target_id", "page_id", "doc_id", "source_file", "category", "page_num", "width", "height", "confidence", "trajectory_type", "split").distinct()


def _cand(t):
    return t.page_candidates.select("candidate_id", "page_id", "target_id", "source_file", "page", "area_ratio", "caption_score", "caption_text").distinct()


def _page(t):
    return t.page_specs.select("page_id", "doc_id", "source_file", "page_num", "category", "score", "image_count", "figure_anchor_count", "landscape_term_count", "text_preview").distinct()


# -- predicates and classes ------------------------------------------------------------------------------------------

_ANY = lambda col, ws: "(" + " OR ".join(f"contains({col}, '{w}')" for w in ws) + ")"
_HITS = lambda col, ws: "(" + " + ".join(f"CAST(contains({col}, '{w}') AS INTEGER)" for w in ws) + ")"
_CLASS_SQL = f"""
WITH d AS (SELECT DISTINCT doc_id, source, coalesce(text, '') AS t, coalesce(evidence_type, '') AS kind, TRY_CAST(page_start AS INTEGER) AS page FROM documents),
e AS (SELECT *, lower(t) AS low, regexp_replace(t, '\\s+', '', 'g') AS bare, len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '(?:\\.{{5,}}|…{{2,}}|·{{4,}}|_{{5,}})'))) AS dots,
 len(regexp_extract_all(t, '(?:^|\\s|\\n)(?:第[一二三四五六七八九十百]+章|[0-9]+(?:\\.[0-9]+){{1,4}}).{{0,80}}?(?:\\.{{5,}}|…{{2,}}|·{{4,}}|_{{5,}})\\s*[0-9]{{1,4}}(?:\\s|$)')) AS sections,
 len(regexp_extract_all(t, '(?:^|\\n|\\s)\\[[0-9]{{1,3}}\\]')) AS marks FROM d),
f AS (SELECT *, len(regexp_extract_all(bare, '[一-鿿A-Za-z0-9]')) AS signal, greatest(1, length(bare)) AS size FROM e),
c AS (SELECT doc_id, source, CASE WHEN contains(kind, 'caption') THEN 'caption'
 WHEN sections >= 2 OR (dots >= 3 AND {_ANY('low', noise.CONTENTS_WORDS)}) OR (dots >= 4 AND length(t) < 2500) THEN 'toc'
 WHEN {_ANY('low', ('参考文献', 'bibliography', 'references'))} OR (marks >= 6 AND {_ANY('low', ('出版社', 'journal', 'doi'))}) THEN 'bibliography'
 WHEN (page IS NULL OR page <= 12) AND {_HITS('low', noise.FRONT_WORDS)} >= 2 THEN 'front_matter'
 WHEN {_ANY('t', noise.BACK_WORDS)} THEN 'back_matter'
 WHEN length(bare) <= 80 AND (regexp_matches(bare, '^[0-9]+$') OR {_ANY('bare', noise.HEADER_WORDS)}) THEN 'header_footer'
 WHEN size >= 20 AND (length(bare) - signal) * 1.0 / size > 0.65 AND signal < 40 THEN 'ocr_noise'
 WHEN regexp_matches(t, '(?i)(?:图|圖|Fig\\.?|Figure)\\s*[A-Za-z]?\\s*[0-9]+(?:[.\\-][0-9]+)*') THEN 'figure_reference_text' ELSE 'normal_body_text' END AS clean_type FROM f)
"""
_SCORE_SQL = "CASE clean_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in noise.SCORES.items()) + " END"


def _classified(t):
    d = t.documents.select("doc_id", "source", "text", "evidence_type", F.col("page_start").try_cast("int").alias("page")).distinct()
    return noise.classified(d, "text", "evidence_type", "page")


@BOOK.query("b3_noise_class", _CLASS_SQL + f"SELECT doc_id, clean_type, CAST({_SCORE_SQL} AS DOUBLE) AS noise_score, CAST({_SCORE_SQL} AS DOUBLE) < 0.7 AS usable FROM c")
def b3_noise_class(t):
    return _classified(t).select("doc_id", "clean_type", "noise_score", "usable")


@BOOK.query("d2_noise_by_source", _CLASS_SQL + f"SELECT source, count(*) AS rows, count(*) FILTER (WHERE CAST({_SCORE_SQL} AS DOUBLE) >= 0.7) AS noisy, round(avg(CASE WHEN CAST({_SCORE_SQL} AS DOUBLE) >= 0.7 THEN 1.0 ELSE 0.0 END), 6) AS noise_rate FROM c GROUP BY source")
def d2_noise_by_source(t):
    return noise.noise_by_source(_classified(t))


_TITLE_SQL = """
l AS (SELECT id, x, list_filter(list_transform(string_split(coalesce(x, ''), chr(10)), lambda y: trim(y)), lambda y: y <> '') AS ls FROM r),
f AS (SELECT id, x, len(ls) >= 6 AND (len(list_distinct(ls)) * 1.0 / greatest(1, len(ls)) <= 0.45 OR """ + _HITS("lower(coalesce(x, ''))", noise.TITLE_TERMS) + """ >= 2) AS repeated FROM l)"""


def _padded(text):
    """The text as it stands, or as the title page some of the pages would be: their own lines three times, with its terms."""
    return F.when(F.pmod(F.length(text), F.lit(3)) == 0, F.concat_ws("\n", text, text, text)).when(F.pmod(F.length(text), F.lit(3)) == 1, F.concat_ws("\n", F.lit("Copyright"), F.lit("ISBN 1"), F.lit("a\nb\nc"), text)).otherwise(text)


_PADDED_SQL = "CASE WHEN length({x}) % 3 = 0 THEN concat_ws(chr(10), {x}, {x}, {x}) WHEN length({x}) % 3 = 1 THEN concat_ws(chr(10), 'Copyright', 'ISBN 1', 'a' || chr(10) || 'b' || chr(10) || 'c', {x}) ELSE {x} END"


@BOOK.query("b7_repeated_title", f"WITH r AS (SELECT DISTINCT page_id AS id, {_PADDED_SQL.format(x='text_preview')} AS x FROM page_specs), {_TITLE_SQL} SELECT id AS page_id, repeated FROM f")
def b7_repeated_title(t):
    return t.page_specs.select("page_id", "text_preview").distinct().select("page_id", noise.repeated_title_page(_padded(F.col("text_preview"))).alias("repeated"))


@BOOK.query("b5_passage_roles", f"""
WITH r AS (SELECT DISTINCT pair_id AS id, candidate_kind AS k, {_PADDED_SQL.format(x='fragment_text')} AS x FROM support_candidates), {_TITLE_SQL.replace('SELECT id, x,', 'SELECT id, k, x,')},
o AS (SELECT *, lower(coalesce(x, '')) AS low FROM f)
SELECT id AS pair_id, CASE WHEN k = 'wrong_target_caption' THEN 'ocr_noise' WHEN {_ANY('low', noise.LIST_TERMS)} OR (len(regexp_extract_all(low, '{noise.YEAR}')) >= 3 AND {_HITS('low', noise.CITATION_TERMS)} >= 1) OR len(regexp_extract_all(low, '{noise.PAGE_LIST}')) >= 4 THEN 'bibliography' WHEN repeated THEN 'front_matter'
 WHEN regexp_matches(low, '{noise.OBJECT_TERMS}') THEN 'object_metadata' WHEN regexp_matches(low, '{noise.PLATE_TERMS}') THEN 'caption_or_plate' WHEN {_ANY("coalesce(x, '')", noise.STYLE_TERMS)} THEN 'style_analysis' ELSE 'historical_context' END AS role FROM o""")
def b5_passage_roles(t):
    s = t.support_candidates.select("pair_id", "candidate_kind", "fragment_text").distinct()
    kind = F.when(F.col("candidate_kind") == "wrong_target_caption", "ocr_noise").otherwise("normal_body_text")
    return s.select("pair_id", noise.passage_role(_padded(F.col("fragment_text")), kind).alias("role"))


@BOOK.query("b10_reason_gate", f"""
SELECT candidate_id, array_to_string(list_sort(list_filter([CASE WHEN coalesce(trim(caption_text), '') = '' THEN 'missing_caption' END, CASE WHEN caption_score < 6 THEN 'low_score' END, CASE WHEN area_ratio < 0.05 THEN 'too_small' END,
 CASE WHEN target_id IS NULL THEN 'no_target' END], lambda x: x IS NOT NULL)), ',') AS reasons, NOT (coalesce(trim(caption_text), '') = '' OR coalesce(caption_score < 6, false) OR coalesce(area_ratio < 0.05, false) OR target_id IS NULL) AS keep FROM {CAND}""")
def b10_reason_gate(t):
    why = noise.reasons(missing_caption=F.coalesce(F.trim("caption_text"), F.lit("")) == "", low_score=F.col("caption_score") < 6, too_small=F.col("area_ratio") < 0.05, no_target=F.col("target_id").isNull())
    return _cand(t).withColumn("why", why).select("candidate_id", F.array_join("why", ",").alias("reasons"), (F.size("why") == 0).alias("keep"))


# -- joins -----------------------------------------------------------------------------------------------------------

@BOOK.query("c1_inner_join", f"SELECT s.field, f.split, count(*) AS pairs FROM {SUP} s JOIN {FIG} f ON s.task_id = f.target_id GROUP BY 1, 2")
def c1_inner_join(t):
    s, f = _sup(t), _fig(t).select("target_id", "split")
    return s.join(f, s.task_id == f.target_id).groupBy("field", "split").agg(F.count("*").alias("pairs"))


@BOOK.query("c3_overlay", f"SELECT f.target_id, CASE WHEN o.page_id IS NOT NULL THEN o.category ELSE f.category END AS category, o.page_id IS NOT NULL AS overlaid FROM {FIG} f LEFT JOIN (SELECT page_id, min(category) AS category FROM {PAGE} GROUP BY page_id) o ON f.page_id = o.page_id")
def c3_overlay(t):
    o = _page(t).groupBy("page_id").agg(F.min("category").alias("category"))
    return R.override_join(_fig(t), o, "page_id", ["category"]).select("target_id", "category", "overlaid")


@BOOK.query("c4_alternate_key", f"""
SELECT s.pair_id, coalesce(a.page_id, b.page_id) AS page_id, CASE WHEN a.page_id IS NOT NULL THEN 'fragment_id' WHEN b.page_id IS NOT NULL THEN 'task_id' END AS matched_by
FROM {SUP} s LEFT JOIN (SELECT candidate_id, min(page_id) AS page_id FROM {CAND} GROUP BY 1) a ON s.fragment_id = a.candidate_id LEFT JOIN (SELECT target_id, min(page_id) AS page_id FROM {CAND} WHERE target_id IS NOT NULL GROUP BY 1) b ON s.task_id = b.target_id""")
def c4_alternate_key(t):
    return R.alternate_key_join(_sup(t).select("pair_id", "fragment_id", "task_id"), _cand(t).select("candidate_id", "target_id", "page_id"), [("fragment_id", "candidate_id"), ("task_id", "target_id")], ["page_id"]).select("pair_id", "page_id", "matched_by")


@BOOK.query("c7_support_lists", f"SELECT task_id, field, array_to_string(list_sort(list(DISTINCT evidence_id)), ',') AS evidence_ids, count(DISTINCT evidence_id) AS n FROM {SUP} WHERE rule_label = 'support' AND task_id IS NOT NULL GROUP BY 1, 2")
def c7_support_lists(t):
    s = _sup(t).where("rule_label = 'support' AND task_id IS NOT NULL")
    return s.groupBy("task_id", "field").agg(F.array_join(F.array_sort(F.collect_set("evidence_id")), ",").alias("evidence_ids"), F.count_distinct("evidence_id").alias("n"))


@BOOK.query("c8_nested", f"SELECT f.target_id, count(s.pair_id) AS fragments, count(DISTINCT s.field) AS fields, count(*) FILTER (WHERE s.rule_label = 'support') AS supporting FROM (SELECT DISTINCT target_id FROM figure_targets) f LEFT JOIN {SUP} s ON s.task_id = f.target_id GROUP BY f.target_id")
def c8_nested(t):
    per = _sup(t).groupBy("task_id").agg(F.count("*").alias("fragments"), F.count_distinct("field").alias("fields"), F.count_if(F.col("rule_label") == "support").alias("supporting"))
    none = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    # Rows that differ elsewhere are one target.
    return _fig(t).select("target_id").distinct().join(per, F.col("target_id") == F.col("task_id"), "left").select("target_id", none("fragments"), none("fields"), none("supporting"))


@BOOK.query("c8_nested_texts", f"SELECT f.target_id, array_to_string(list_sort(list(s.field || ':' || coalesce(s.fragment_text, '')) FILTER (WHERE s.pair_id IS NOT NULL)), chr(10)) AS nested FROM (SELECT DISTINCT target_id FROM figure_targets) f JOIN {SUP} s ON s.task_id = f.target_id GROUP BY f.target_id")
def c8_nested_texts(t):
    nest = R.nested(_sup(t).where("task_id IS NOT NULL"), "task_id", ["field", "fragment_text"], "xs")
    line = F.transform("xs", lambda x: F.concat(x["field"], F.lit(":"), F.coalesce(x["fragment_text"], F.lit(""))))
    return _fig(t).select("target_id").distinct().join(nest, F.col("target_id") == F.col("task_id")).select("target_id", F.array_join(F.array_sort(line), "\n").alias("nested"))


@BOOK.query("c9_label_precedence", f"""
SELECT task_id, field, coalesce(CASE WHEN bool_or(rule_label = 'support') THEN 'support' WHEN bool_or(rule_label = 'wrong_target') THEN 'wrong_target' WHEN bool_or(rule_label = 'contradict') THEN 'contradict' WHEN bool_or(rule_label = 'weak_support') THEN 'weak_support' END, 'no_support') AS label, max(coalesce(rule_confidence, 0)) AS best FROM {SUP} WHERE task_id IS NOT NULL AND rule_label IS NOT NULL GROUP BY 1, 2""")
def c9_label_precedence(t):
    return R.strongest_label(_sup(t).where("task_id IS NOT NULL"), ["task_id", "field"], "rule_label", "rule_confidence")


@BOOK.query("c10_semi", f"SELECT target_id, source_file FROM {FIG} f WHERE EXISTS (SELECT 1 FROM {SUP} s WHERE s.task_id = f.target_id AND s.rule_label = 'support')")
def c10_semi(t):
    s = _sup(t).where("rule_label = 'support'").select(F.col("task_id").alias("target_id"))
    return _fig(t).join(s, "target_id", "left_semi").select("target_id", "source_file")


@BOOK.query("c11_anti", f"SELECT target_id FROM {FIG} f WHERE NOT EXISTS (SELECT 1 FROM {SUP} s WHERE s.task_id = f.target_id)")
def c11_anti(t):
    return R.pending(_fig(t).select("target_id"), _sup(t).where("task_id IS NOT NULL").select(F.col("task_id").alias("target_id")), ["target_id"])


@BOOK.query("c14_page_window", f"SELECT f.target_id, count(*) AS pages, min(p.page_num) AS first_page, max(p.page_num) AS last_page FROM {FIG} f JOIN {PAGE} p ON f.doc_id = p.doc_id AND p.page_num BETWEEN f.page_num - 3 AND f.page_num + 3 GROUP BY f.target_id")
def c14_page_window(t):
    w = R.page_window_join(_fig(t).select("target_id", "doc_id", "page_num"), _page(t).select("doc_id", F.col("page_num").alias("page")), "doc_id", "page_num", "page", 3)
    return w.groupBy("target_id").agg(F.count("*").alias("pages"), F.min("found_page").alias("first_page"), F.max("found_page").alias("last_page"))


# -- aggregates ------------------------------------------------------------------------------------------------------

@BOOK.query("d1_counts", "SELECT run, field, count(*) AS n FROM (SELECT DISTINCT pair_id, field, used_by_runs FROM support_candidates), LATERAL (SELECT unnest(used_by_runs) AS run) GROUP BY 1, 2")
def d1_counts(t):
    return t.support_candidates.select("pair_id", "field", "used_by_runs").distinct().select("field", F.explode("used_by_runs").alias("run")).groupBy("run", "field").agg(F.count("*").alias("n"))


@BOOK.query("d3_distinct", f"SELECT split, count(DISTINCT doc_id) AS docs, count(DISTINCT source_file) AS files, count(DISTINCT page_id) AS pages, count(*) AS targets FROM {FIG} GROUP BY split")
def d3_distinct(t):
    return _fig(t).groupBy("split").agg(F.count_distinct("doc_id").alias("docs"), F.count_distinct("source_file").alias("files"), F.count_distinct("page_id").alias("pages"), F.count("*").alias("targets"))


@BOOK.query("d4_split_leaks", f"SELECT doc_id, array_to_string(list_sort(list(DISTINCT split)), ',') AS splits, count(DISTINCT split) AS n FROM {FIG} WHERE split IS NOT NULL AND doc_id IS NOT NULL GROUP BY doc_id HAVING count(DISTINCT split) > 1")
def d4_split_leaks(t):
    return R.split_leaks(_fig(t), "doc_id")


@BOOK.query("d5_cap_violations", f"SELECT split, lower(caption_text) AS caption, count(*) AS n FROM {FIG} f JOIN {CAND} c USING (target_id) WHERE caption_text IS NOT NULL AND split IS NOT NULL GROUP BY 1, 2 HAVING count(*) > CASE WHEN split = 'train' THEN 2 ELSE 1 END")
def d5_cap_violations(t):
    j = _fig(t).select("target_id", "split").join(_cand(t).select("target_id", "caption_text"), "target_id").where("caption_text IS NOT NULL AND split IS NOT NULL")
    return j.groupBy("split", F.lower("caption_text").alias("caption")).agg(F.count("*").alias("n")).where(F.col("n") > F.when(F.col("split") == "train", 2).otherwise(1))


_UNPIVOT = f"SELECT category, 'score' AS metric, CAST(score AS DOUBLE) AS x FROM {PAGE} UNION ALL SELECT category, 'image_count', CAST(image_count AS DOUBLE) FROM {PAGE} UNION ALL SELECT category, 'figure_anchor_count', CAST(figure_anchor_count AS DOUBLE) FROM {PAGE}"


@BOOK.query("d6_metric_summary", f"SELECT category, metric, count(*) AS n, round(avg(x), 6) AS mean, min(x) AS low, max(x) AS high, round(stddev_pop(x), 6) AS deviation FROM ({_UNPIVOT}) WHERE x IS NOT NULL GROUP BY 1, 2")
def d6_metric_summary(t):
    p = _page(t).select("category", *[F.col(c).cast("double").alias(c) for c in ("score", "image_count", "figure_anchor_count")])
    return R.metric_summary(p, "category", ["score", "image_count", "figure_anchor_count"])


@BOOK.query("d7_conditional_counts", f"SELECT candidate_kind, count(*) AS n, count(*) FILTER (WHERE rule_confidence >= 0.9) AS high, count(*) FILTER (WHERE rule_confidence < 0.5) AS low, round(avg(coalesce(rule_confidence, 0)), 6) AS mean_with_zero, round(avg(rule_confidence), 6) AS mean_known FROM {SUP} GROUP BY 1")
def d7_conditional_counts(t):
    c = F.col("rule_confidence")
    return _sup(t).groupBy("candidate_kind").agg(F.count("*").alias("n"), F.count_if(c >= 0.9).alias("high"), F.count_if(c < 0.5).alias("low"), F.round(F.avg(F.coalesce(c, F.lit(0.0))), 6).alias("mean_with_zero"), F.round(F.avg(c), 6).alias("mean_known"))


@BOOK.query("d13_set_scores", """
WITH s AS (SELECT DISTINCT pair_id, list_distinct(coalesce(cited_by_runs, [])) AS p, list_distinct(coalesce(used_by_runs, [])) AS g FROM support_candidates),
q AS (SELECT pair_id, len(list_intersect(p, g)) * 1.0 / greatest(1, len(p)) AS pr, len(list_intersect(p, g)) * 1.0 / greatest(1, len(g)) AS re FROM s)
SELECT pair_id, round(pr, 6) AS precision, round(re, 6) AS recall, round(CASE WHEN pr <= 0 OR re <= 0 THEN 0 ELSE 2 * pr * re / (pr + re) END, 6) AS f1 FROM q""")
def d13_set_scores(t):
    s = t.support_candidates.select("pair_id", "cited_by_runs", "used_by_runs").distinct().withColumn("s", M.set_scores(F.col("cited_by_runs"), F.col("used_by_runs")))
    return s.select("pair_id", *[F.round(F.col("s")[c], 6).alias(c) for c in ("precision", "recall", "f1")])


@BOOK.query("d15_rollup", f"SELECT coalesce(field, 'total') AS field, count(*) AS pairs, count(*) FILTER (WHERE rule_label = 'support') AS supported, round(avg(CASE WHEN rule_label = 'support' THEN 1.0 ELSE 0.0 END), 6) AS rate FROM {SUP} GROUP BY ROLLUP (field)")
def d15_rollup(t):
    yes = F.col("rule_label").eqNullSafe(F.lit("support"))
    return _sup(t).rollup("field").agg(F.count("*").alias("pairs"), F.count_if(yes).alias("supported"), F.round(F.avg(yes.cast("double")), 6).alias("rate")).withColumn("field", F.coalesce("field", F.lit("total")))


@BOOK.query("d19_nearest_rank", f"""
WITH r AS (SELECT source_role, length(fragment_text) AS v, row_number() OVER (PARTITION BY source_role ORDER BY length(fragment_text)) - 1 AS i, count(*) OVER (PARTITION BY source_role) AS n FROM {SUP} WHERE fragment_text IS NOT NULL)
SELECT source_role, v AS value, n FROM r WHERE i = round_even((n - 1) * 0.95, 0)""")
def d19_nearest_rank(t):
    return R.nearest_rank(_sup(t).withColumn("v", F.length("fragment_text")), "source_role", "v", 0.95)


@BOOK.query("d20_most_common", f"SELECT source_file, count(*) AS count FROM {SUP} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def d20_most_common(t):
    return R.most_common(_sup(t).select("source_file"), "source_file", 20)


@BOOK.query("d30_best_per_key", f"SELECT task_id, field, candidate_kind, max(priority) AS priority, arg_max(pair_id, struct_pack(a := priority, b := pair_id)) AS pair_id FROM {SUP} WHERE task_id IS NOT NULL GROUP BY 1, 2, 3")
def d30_best_per_key(t):
    return _sup(t).where("task_id IS NOT NULL").groupBy("task_id", "field", "candidate_kind").agg(F.max("priority").alias("priority"), F.max_by("pair_id", F.struct("priority", "pair_id")).alias("pair_id"))


@BOOK.query("d33_field_profiles", "SELECT k AS field, count(*) AS n, count(*) FILTER (WHERE v.abstain) AS abstained, count(*) FILTER (WHERE coalesce(v.value, '') = '') AS blank, min(length(v.value)) AS shortest, max(length(v.value)) AS longest FROM (SELECT DISTINCT target_id, metadata_fields FROM figure_targets), LATERAL (SELECT unnest(map_entries(metadata_fields)).key AS k, unnest(map_entries(metadata_fields)).value AS v) GROUP BY 1")
def d33_field_profiles(t):
    # Maps cannot be compared; entries of repeated rows are made distinct instead.
    e = t.figure_targets.select("target_id", F.explode("metadata_fields").alias("field", "v")).distinct()
    return e.groupBy("field").agg(F.count("*").alias("n"), F.count_if(F.col("v.abstain")).alias("abstained"), F.count_if(F.coalesce("v.value", F.lit("")) == "").alias("blank"), F.min(F.length("v.value")).alias("shortest"), F.max(F.length("v.value")).alias("longest"))


# -- windows ---------------------------------------------------------------------------------------------------------

@BOOK.query("w1_prefix_history", """
SELECT event_id, CAST(count(*) OVER p AS BIGINT) AS n_before, coalesce(string_agg(event_type, '>') OVER l, '') AS last_8 FROM events WINDOW p AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), l AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING)""")
def w1_prefix_history(t):
    e = t.events.select("event_id", "user_id", "ts", "event_type")
    n = F.count("*").over(Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1))
    return R.prefix_states(e, "user_id", ["ts", "event_id"], "event_type", 8).select("event_id", n.alias("n_before"), F.array_join("history", ">").alias("last_8"))


@BOOK.query("w3_advantages", "SELECT event_id, CASE WHEN stddev_pop(value) OVER g < 1e-6 THEN 0 ELSE round((value - avg(value) OVER g) / stddev_pop(value) OVER g, 6) END AS advantage FROM events WINDOW g AS (PARTITION BY event_type)")
def w3_advantages(t):
    return R.normalised_advantages(t.events.select("event_id", "event_type", "value"), "event_type", "value").select("event_id", "advantage")


@BOOK.query("w5_best_per_page", f"SELECT page_id, candidate_id, caption_score FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY caption_score DESC NULLS LAST, candidate_id) AS rn FROM {CAND}) WHERE rn = 1")
def w5_best_per_page(t):
    return R.keep_first(_cand(t), ["page_id"], [F.desc_nulls_last("caption_score"), F.col("candidate_id")]).select("page_id", "candidate_id", "caption_score")


@BOOK.query("w7_running_cap", f"SELECT pair_id, row_number() OVER (PARTITION BY source_file, field ORDER BY priority DESC NULLS LAST, pair_id) <= 5 AS kept FROM {SUP}")
def w7_running_cap(t):
    return R.capped(_sup(t), ["source_file", "field"], [F.desc_nulls_last("priority"), F.col("pair_id")], 5).select("pair_id", "kept")


@BOOK.query("w8_owner_split", f"SELECT DISTINCT target_id, arg_min(split, struct_pack(a := coalesce(page_num, 2147483647), b := target_id, c := split)) OVER (PARTITION BY source_file) AS owner FROM {FIG} WHERE split IS NOT NULL AND source_file IS NOT NULL")
def w8_owner_split(t):
    return R.owned(_fig(t).where("split IS NOT NULL AND source_file IS NOT NULL"), "source_file", "split", F.struct(F.coalesce("page_num", F.lit(2147483647)), "target_id", "split")).select("target_id", "owner").distinct()


@BOOK.query("w10_no_repeats", """
WITH b AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)
SELECT event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS step FROM b WHERE p IS NULL OR p IS DISTINCT FROM event_type""")
def w10_no_repeats(t):
    return R.without_repeats(t.events.select("event_id", "user_id", "ts", "event_type"), "user_id", ["ts", "event_id"], "event_type").select("event_id", "event_type", "step")


@BOOK.query("w12_neighbours", """
WITH d AS (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL), p AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10) || chr(10)), 1) AS n, unnest(string_split(text, chr(10) || chr(10))) AS x FROM d)
SELECT doc_id, n - 1 AS n, length(concat_ws(' ', x, lead(x, 1) OVER w)) AS two, length(concat_ws(' ', x, lead(x, 1) OVER w, lead(x, 2) OVER w)) AS three FROM p WINDOW w AS (PARTITION BY doc_id ORDER BY n)""")
def w12_neighbours(t):
    p = t.documents.where("text IS NOT NULL").select("doc_id", "text").distinct().select("doc_id", F.posexplode(F.split("text", "\n\n")).alias("n", "x"))
    return R.neighbours_joined(p, "doc_id", ["n"], "x").select("doc_id", F.col("n").cast("bigint").alias("n"), F.length("two").cast("bigint").alias("two"), F.length("three").cast("bigint").alias("three"))


@BOOK.query("w15_copies", f"SELECT pair_id, CAST(unnest(generate_series(1, CASE WHEN priority >= 7 THEN 3 WHEN priority >= 4 THEN 2 ELSE 1 END)) AS INTEGER) AS copy FROM {SUP}")
def w15_copies(t):
    n = F.when(F.col("priority") >= 7, 3).when(F.col("priority") >= 4, 2).otherwise(1)
    return R.copies(_sup(t).select("pair_id", "priority"), n).select("pair_id", "copy")


@BOOK.query("w16_last_wins", f"SELECT task_id, field, arg_max(gold_value, pair_id) FILTER (WHERE gold_value IS NOT NULL) AS value, count(*) AS written FROM {SUP} WHERE task_id IS NOT NULL GROUP BY 1, 2")
def w16_last_wins(t):
    g = _sup(t).where("task_id IS NOT NULL")
    return g.groupBy("task_id", "field").agg(F.max_by("gold_value", F.when(F.col("gold_value").isNotNull(), F.col("pair_id"))).alias("value"), F.count("*").alias("written"))


@BOOK.query("w22_batches", f"SELECT pair_id, (row_number() OVER (PARTITION BY task_id ORDER BY pair_id) - 1) // 2 AS batch FROM {SUP} WHERE task_id IS NOT NULL")
def w22_batches(t):
    return R.batches(_sup(t).where("task_id IS NOT NULL"), "task_id", ["pair_id"], 2).select("pair_id", "batch")


# -- order and top-k ---------------------------------------------------------------------------------------------------

@BOOK.query("t3_top_per_doc", f"SELECT doc_id, page_id, rank FROM (SELECT doc_id, page_id, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC NULLS LAST, page_id) AS rank FROM {PAGE} WHERE doc_id IS NOT NULL) WHERE rank <= 3")
def t3_top_per_doc(t):
    return R.top_per_group_salted(_page(t).where("doc_id IS NOT NULL"), ["doc_id"], [F.desc_nulls_last("score"), F.col("page_id")], 3).select("doc_id", "page_id", "rank")


@BOOK.query("t4_enum_order", f"SELECT split, CASE split WHEN 'train' THEN 0 WHEN 'val' THEN 1 WHEN 'test' THEN 2 ELSE 3 END AS position, count(*) AS n FROM {FIG} GROUP BY 1, 2 ORDER BY 2")
def t4_enum_order(t):
    rank = F.when(F.col("split") == "train", 0).when(F.col("split") == "val", 1).when(F.col("split") == "test", 2).otherwise(3)
    return _fig(t).groupBy("split", rank.alias("position")).agg(F.count("*").alias("n")).orderBy("position")


@BOOK.query("t7_weighted_top", f"SELECT page_id, CAST(5 * image_count + 3 * figure_anchor_count + landscape_term_count AS BIGINT) AS weight FROM {PAGE} WHERE 5 * image_count + 3 * figure_anchor_count + landscape_term_count > 0 ORDER BY 2 DESC, 1 LIMIT 50")
def t7_weighted_top(t):
    w = (5 * F.col("image_count") + 3 * F.col("figure_anchor_count") + F.col("landscape_term_count")).cast("bigint")
    return _page(t).select("page_id", w.alias("weight")).where("weight > 0").orderBy(F.desc("weight"), "page_id").limit(50)


# -- sets --------------------------------------------------------------------------------------------------------------

@BOOK.query("s1_ordered_dedup", f"SELECT key, min(pair_id) AS first_pair, count(*) AS n FROM (SELECT pair_id, lower(regexp_replace(fragment_text, '\\s+', '', 'g')) AS key FROM {SUP} WHERE fragment_text IS NOT NULL) WHERE key <> '' GROUP BY key HAVING count(*) > 1")
def s1_ordered_dedup(t):
    k = _sup(t).where("fragment_text IS NOT NULL").select("pair_id", F.lower(F.regexp_replace("fragment_text", r"(?U)\s+", "")).alias("key")).where("key <> ''")
    return k.groupBy("key").agg(F.min("pair_id").alias("first_pair"), F.count("*").alias("n")).where("n > 1")


@BOOK.query("s4_union_first_wins", f"SELECT target_id, arg_min(category, r) AS category, arg_min(o, r) AS origin FROM (SELECT target_id, category, 'figures' AS o, 0 AS r FROM {FIG} UNION ALL SELECT target_id, 'candidate', 'candidates', 1 FROM {CAND} WHERE target_id IS NOT NULL) GROUP BY target_id")
def s4_union_first_wins(t):
    parts = {"figures": _fig(t).select("target_id", "category"), "candidates": _cand(t).where("target_id IS NOT NULL").select("target_id", F.lit("candidate").alias("category"))}
    return R.union_with_origin(parts, "target_id").select("target_id", "category", "origin")


@BOOK.query("s9_changes", "SELECT pair_id, array_to_string(list_sort(list_filter(coalesce(cited_by_runs, []), lambda x: NOT list_contains(coalesce(used_by_runs, []), x))), ',') AS added, array_to_string(list_sort(list_filter(coalesce(used_by_runs, []), lambda x: NOT list_contains(coalesce(cited_by_runs, []), x))), ',') AS removed FROM (SELECT DISTINCT pair_id, cited_by_runs, used_by_runs FROM support_candidates)")
def s9_changes(t):
    none = F.array().cast("array<string>")
    c = R.changes_between(F.coalesce("used_by_runs", none), F.coalesce("cited_by_runs", none))
    return t.support_candidates.select("pair_id", "cited_by_runs", "used_by_runs").distinct().select("pair_id", F.array_join(c["added"], ",").alias("added"), F.array_join(c["removed"], ",").alias("removed"))


# -- sequences and runs --------------------------------------------------------------------------------------------------

@BOOK.query("d18_sequence_match", """
WITH s AS (SELECT DISTINCT pair_id, coalesce(used_by_runs, []) AS g, coalesce(cited_by_runs, []) AS p FROM support_candidates)
SELECT pair_id, CAST(len(list_filter(generate_series(1, least(len(g), len(p))), lambda i: g[1:i] = p[1:i])) AS BIGINT) AS prefix, g = p AS exact, coalesce(g[1] = p[1], false) AS first_equal FROM s""")
def d18_sequence_match(t):
    none = F.array().cast("array<string>")
    s = t.support_candidates.select("pair_id", F.coalesce("used_by_runs", none).alias("g"), F.coalesce("cited_by_runs", none).alias("p")).distinct()
    return s.select("pair_id", R.matching_prefix(F.col("g"), F.col("p")).cast("bigint").alias("prefix"), (F.col("g") == F.col("p")).alias("exact"), F.coalesce(F.try_element_at("g", F.lit(1)) == F.try_element_at("p", F.lit(1)), F.lit(False)).alias("first_equal"))


@BOOK.query("c24_run_comparison", """
WITH u AS (SELECT pair_id, field, unnest(used_by_runs) AS run FROM (SELECT DISTINCT pair_id, field, used_by_runs FROM support_candidates))
SELECT field, count(*) AS pairs, count(*) FILTER (WHERE a > 0) AS base_a, count(*) FILTER (WHERE b > 0) AS sft_b, count(*) FILTER (WHERE c > 0) AS grpo_c, count(*) FILTER (WHERE a > 0 AND b > 0 AND c > 0) AS in_all
FROM (SELECT pair_id, field, count(*) FILTER (WHERE run = 'base_a') AS a, count(*) FILTER (WHERE run = 'sft_b') AS b, count(*) FILTER (WHERE run = 'grpo_c') AS c FROM u GROUP BY 1, 2) GROUP BY field""")
def c24_run_comparison(t):
    u = t.support_candidates.select("pair_id", "field", "used_by_runs").distinct().select("pair_id", "field", F.explode("used_by_runs").alias("run"))
    p = u.groupBy("pair_id", "field").pivot("run", ["base_a", "sft_b", "grpo_c"]).count()
    has = {c: F.coalesce(F.col(c), F.lit(0)) > 0 for c in ("base_a", "sft_b", "grpo_c")}
    return p.groupBy("field").agg(F.count("*").alias("pairs"), *[F.count_if(h).alias(c) for c, h in has.items()], F.count_if(has["base_a"] & has["sft_b"] & has["grpo_c"]).alias("in_all"))


@BOOK.query("w21_inserted_rows", """
WITH f AS (SELECT user_id, min(struct_pack(a := ts, b := event_id)) AS m FROM events WHERE event_type = 'error' GROUP BY user_id),
x AS (SELECT e.user_id, e.ts, e.event_id, 0 AS o, e.event_type FROM events e UNION ALL SELECT e.user_id, e.ts, e.event_id, 1, 'inserted' FROM events e JOIN f ON e.user_id = f.user_id AND e.ts = f.m.a AND e.event_id = f.m.b)
SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id, o) - 1 AS step, event_type FROM x""")
def w21_inserted_rows(t):
    e = t.events.select("user_id", "ts", "event_id", "event_type")
    return R.inserted_after_first(e, "user_id", ["ts", "event_id"], F.col("event_type") == "error", {"event_type": F.lit("inserted")}).select("user_id", "step", "event_type")


@BOOK.query("f22_focus_window", """
SELECT DISTINCT doc_id, CASE WHEN strpos(text, 'bridge') > 0 THEN substring(text, greatest(strpos(text, 'bridge') - 40, 1), strpos(text, 'bridge') - greatest(strpos(text, 'bridge') - 40, 1) + 6 + 40) ELSE substring(text, 1, 80) END AS focus FROM documents WHERE text IS NOT NULL""")
def f22_focus_window(t):
    from vellum.functions import text as T

    return t.documents.where("text IS NOT NULL").select("doc_id", T.around(F.col("text"), "bridge", 40).alias("focus")).distinct()


@BOOK.query("d28_delta", f"""
WITH a AS (SELECT task_id, count(*) FILTER (WHERE rule_label = 'support') * 1.0 / count(*) AS r FROM {SUP} WHERE candidate_kind = 'same_page_body' AND task_id IS NOT NULL GROUP BY 1),
b AS (SELECT task_id, count(*) FILTER (WHERE rule_label = 'support') * 1.0 / count(*) AS r FROM {SUP} WHERE candidate_kind <> 'same_page_body' AND task_id IS NOT NULL GROUP BY 1)
SELECT count(*) AS tasks, round(avg(b.r - a.r), 6) AS mean_delta, count(*) FILTER (WHERE b.r < a.r) AS lower, count(*) FILTER (WHERE b.r > a.r) AS higher FROM a JOIN b USING (task_id)""")
def d28_delta(t):
    s = _sup(t).where("task_id IS NOT NULL")
    rate = F.avg(F.col("rule_label").eqNullSafe(F.lit("support")).cast("double"))
    a = s.where("candidate_kind = 'same_page_body'").groupBy("task_id").agg(rate.alias("a"))
    b = s.where("candidate_kind <> 'same_page_body'").groupBy("task_id").agg(rate.alias("b"))
    return R.paired_delta(a.join(b, "task_id"), "a", "b").withColumnRenamed("pairs", "tasks")
