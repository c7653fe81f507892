"""Queries of sequences, ranks, order and sets, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from vellum.functions import arrays as A
from vellum.operators import relational as R
from vellum.operators import sequences as S
from vellum.plans.book import Book
from vellum.plans.relational_queries import CAND, FIG, PAGE, SUP, _cand, _fig, _page, _sup
from vellum.streaming import events as E

BOOK = Book()
queries, oracle_sql = (lambda: BOOK.calls), (lambda: BOOK.sql)

_ORD = "PARTITION BY user_id ORDER BY ts, event_id"


@BOOK.query("w4_best_index", f"SELECT task_id, arg_max(i, struct_pack(a := c, b := -i)) AS best_index, max(c) AS best FROM (SELECT task_id, coalesce(rule_confidence, 0) AS c, row_number() OVER (PARTITION BY task_id ORDER BY pair_id) - 1 AS i FROM {SUP} WHERE task_id IS NOT NULL) GROUP BY 1")
def w4_best_index(t):
    i = F.row_number().over(Window.partitionBy("task_id").orderBy("pair_id")) - 1
    r = _sup(t).where("task_id IS NOT NULL").select("task_id", F.coalesce("rule_confidence", F.lit(0.0)).alias("c"), i.alias("i"))
    return r.groupBy("task_id").agg(F.max_by("i", F.struct(F.col("c"), -F.col("i"))).alias("best_index"), F.max("c").alias("best"))


@BOOK.query("w6_ranked_regions", f"""
WITH r AS (SELECT page_id, candidate_id, CASE WHEN target_id IS NOT NULL THEN area_ratio ELSE 0 END AS m, coalesce(caption_score, 0) AS l FROM {CAND}), g AS (SELECT *, max(m) OVER (PARTITION BY page_id) AS top FROM r)
SELECT page_id, candidate_id, CASE WHEN top > 0 THEN row_number() OVER (PARTITION BY page_id ORDER BY m DESC, l DESC, candidate_id) END AS rank FROM g""")
def w6_ranked_regions(t):
    r = _cand(t).select("page_id", "candidate_id", F.when(F.col("target_id").isNotNull(), F.col("area_ratio")).otherwise(0.0).alias("m"), F.coalesce("caption_score", F.lit(0.0)).alias("l"))
    return S.ranked_if_any(r, "page_id", "m", [F.desc("m"), F.desc("l"), F.col("candidate_id")]).select("page_id", "candidate_id", "rank")


@BOOK.query("w7_protected_cap", f"""
WITH r AS (SELECT pair_id, source_file, field, CASE WHEN rule_label = 'support' THEN 0 ELSE 1 END AS tier, priority FROM {SUP}), n AS (SELECT *, row_number() OVER (PARTITION BY source_file, field ORDER BY tier, priority DESC NULLS LAST, pair_id) AS rn FROM r) SELECT pair_id, tier = 0 OR rn <= 4 AS kept FROM n""")
def w7_protected_cap(t):
    r = _sup(t).select("pair_id", "source_file", "field", "priority", F.when(F.col("rule_label") == "support", 0).otherwise(1).alias("tier"))
    capped = R.capped(r, ["source_file", "field"], [F.col("tier"), F.desc_nulls_last("priority"), F.col("pair_id")], 4)
    return capped.select("pair_id", ((F.col("tier") == 0) | F.col("kept")).alias("kept"))


@BOOK.query("w8_capped_owner", """
WITH r AS (SELECT target_id, min(split) AS split, min(lower(base_fields['caption_text'])) AS c FROM figure_targets GROUP BY 1 HAVING min(split) IS NOT NULL AND min(base_fields['caption_text']) IS NOT NULL), o AS (SELECT c, arg_min(split, target_id) AS owner FROM r GROUP BY 1),
k AS (SELECT r.*, o.owner, row_number() OVER (PARTITION BY r.c, r.split ORDER BY target_id) AS rn FROM r JOIN o USING (c)) SELECT target_id, CASE WHEN split <> owner THEN 'leak' WHEN rn > 2 THEN 'capped' ELSE 'kept' END AS verdict FROM k""")
def w8_capped_owner(t):
    r = t.figure_targets.groupBy("target_id").agg(F.min("split").alias("split"), F.min(F.lower(F.col("base_fields")["caption_text"])).alias("c")).where("split IS NOT NULL AND c IS NOT NULL")
    o = R.owned(r, "c", "split", F.col("target_id"))
    k = R.capped(o, ["c", "split"], [F.col("target_id")], 2)
    return k.select("target_id", F.when(F.col("split") != F.col("owner"), "leak").when(~F.col("kept"), "capped").otherwise("kept").alias("verdict"))


_FIELDS = ("caption_text", "creator_or_attribution", "creation_period_or_dynasty", "collection_institution", "dimensions", "medium_material")
_STATE = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {{c}} THEN '{f}' END" for f in _FIELDS) + "], lambda x: x IS NOT NULL), ',')"


def _state_sql(test: str) -> str:
    return "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {test.format(f=f)} THEN '{f}' END" for f in _FIELDS) + "], lambda x: x IS NOT NULL), ',')"


@BOOK.query("w17_claim_states", f"""
WITH g AS (SELECT task_id, list(DISTINCT field) FILTER (WHERE NOT gold_abstain) AS w, list(DISTINCT field) FILTER (WHERE gold_abstain) AS a FROM {SUP} WHERE task_id IS NOT NULL GROUP BY 1)
SELECT task_id, {_state_sql("list_contains(coalesce(w, []), '{f}')")} AS written, {_state_sql("list_contains(coalesce(a, []), '{f}') AND NOT list_contains(coalesce(w, []), '{f}')")} AS abstained, {_state_sql("NOT list_contains(coalesce(w, []), '{f}') AND NOT list_contains(coalesce(a, []), '{f}')")} AS remaining FROM g""")
def w17_claim_states(t):
    s = S.claim_states(_sup(t).where("task_id IS NOT NULL"), "task_id", "field", F.col("gold_abstain"), _FIELDS)
    return s.select("task_id", *[F.array_join(c, ",").alias(c) for c in ("written", "abstained", "remaining")])


@BOOK.query("w18_staleness", "SELECT user_id, round(date_sub('second', max(ts), (SELECT max(ts) FROM events)) / 60.0, 2) AS minutes, date_sub('second', max(ts), (SELECT max(ts) FROM events)) > 1800 AS stale FROM events GROUP BY 1")
def w18_staleness(t):
    return S.staleness(t.events, "user_id", "ts", 1800).select("user_id", F.round(F.col("seconds") / 60.0, 2).alias("minutes"), "stale")


@BOOK.query("w19_collapsed_runs", f"""
WITH b AS (SELECT *, CASE WHEN lag(event_type) OVER ({_ORD}) IS DISTINCT FROM event_type THEN 1 ELSE 0 END AS f, row_number() OVER ({_ORD}) - 1 AS step FROM events), r AS (SELECT *, sum(f) OVER ({_ORD} ROWS UNBOUNDED PRECEDING) AS run FROM b)
SELECT user_id, CAST(run AS BIGINT) AS run, any_value(event_type) AS event_type, CAST(min(step) AS INTEGER) AS first_step, count(*) AS rows, round(sum(value), 4) AS total FROM r GROUP BY user_id, run""")
def w19_collapsed_runs(t):
    r = S.runs(t.events.select("user_id", "ts", "event_id", "event_type", "value"), "user_id", ["ts", "event_id"], "event_type")
    return r.groupBy("user_id", "run").agg(F.any_value("event_type").alias("event_type"), F.min("step").alias("first_step"), F.count("*").alias("rows"), F.round(F.sum("value"), 4).alias("total"))


@BOOK.query("w20_recovered_results", f"SELECT event_id, coalesce(lead(event_type) OVER ({_ORD}), event_type) AS result, round(lead(value) OVER ({_ORD}) - value, 6) AS delta FROM events")
def w20_recovered_results(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return t.events.select("event_id", F.coalesce(F.lead("event_type").over(w), "event_type").alias("result"), F.round(F.lead("value").over(w) - F.col("value"), 6).alias("delta"))


@BOOK.query("k1_running_states", f"""
WITH s AS (SELECT event_id, user_id, event_type, row_number() OVER ({_ORD}) AS step, count(*) FILTER (WHERE event_type = 'error') OVER ({_ORD} ROWS UNBOUNDED PRECEDING) AS errors, count(*) FILTER (WHERE event_type = 'purchase') OVER ({_ORD} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ends FROM events)
SELECT event_id, CAST(step AS INTEGER) AS step, errors, event_type = 'purchase' OR step = 25 AS terminated FROM s WHERE ends = 0 AND step <= 25""")
def k1_running_states(t):
    return E.running_episodes(t.events, "purchase", 25).select("event_id", "step", "errors", "terminated")


@BOOK.query("k10_replayed_rows", f"""
WITH s AS (SELECT event_id, user_id, event_type, row_number() OVER ({_ORD}) AS step, count(*) FILTER (WHERE event_type = 'error') OVER ({_ORD} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM events)
SELECT event_id, CAST(step AS INTEGER) AS step FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY step) AS n FROM s WHERE event_type = 'click' AND before > 0) WHERE n <= 2""")
def k10_replayed_rows(t):
    return E.replayed_matches(t.events, "click", "error", 2).select("event_id", "step")


# -- order -----------------------------------------------------------------------------------------------------------

@BOOK.query("t2_sorted", f"SELECT page_id, score FROM {PAGE} ORDER BY score DESC NULLS LAST, source_file NULLS LAST, page_num, page_id LIMIT 60")
def t2_sorted(t):
    return _page(t).orderBy(F.desc_nulls_last("score"), F.asc_nulls_last("source_file"), "page_num", "page_id").limit(60).select("page_id", "score")


@BOOK.query("t3_top_per_doc_limited", f"SELECT page_id FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC NULLS LAST, page_id) AS r FROM {PAGE} WHERE doc_id IS NOT NULL) WHERE r <= 3 ORDER BY score DESC NULLS LAST, page_id LIMIT 40")
def t3_top_per_doc_limited(t):
    top = R.top_per_group_salted(_page(t).where("doc_id IS NOT NULL"), ["doc_id"], [F.desc_nulls_last("score"), F.col("page_id")], 3)
    return top.orderBy(F.desc_nulls_last("score"), "page_id").limit(40).select("page_id")


@BOOK.query("t5_risk_order", "SELECT candidate_id, risk FROM (SELECT candidate_id, (CASE WHEN coalesce(caption_text, '') = '' THEN 3 ELSE 0 END) + (CASE WHEN coalesce(caption_score, 0) < 6 THEN 2 ELSE 0 END) + (CASE WHEN coalesce(area_ratio, 0) < 0.05 THEN 1 ELSE 0 END) AS risk FROM " + CAND + ") WHERE risk > 0 ORDER BY risk DESC, candidate_id LIMIT 50")
def t5_risk_order(t):
    risk = S.weighted_score({3: F.coalesce("caption_text", F.lit("")) == "", 2: F.coalesce("caption_score", F.lit(0.0)) < 6, 1: F.coalesce("area_ratio", F.lit(0.0)) < 0.05})
    return _cand(t).select("candidate_id", risk.alias("risk")).where("risk > 0").orderBy(F.desc("risk"), "candidate_id").limit(50)


@BOOK.query("t6_page_of_rows", f"SELECT page_id, place FROM (SELECT page_id, row_number() OVER (ORDER BY CASE WHEN category = 'journal' THEN 0 ELSE 1 END, source_file NULLS LAST, page_num, page_id) AS place FROM {PAGE}) WHERE place > 20 AND place <= 45")
def t6_page_of_rows(t):
    p = _page(t).select("page_id", F.when(F.col("category") == "journal", 0).otherwise(1).alias("forced"), F.coalesce("source_file", F.lit("\U0010ffff")).alias("s"), "page_num")
    return S.page_of_rows(p, ["forced", "s", "page_num", "page_id"], 20, 25).select("page_id", "place")


@BOOK.query("t8_review_cap", "WITH r AS (SELECT pair_id, unnest(string_split(rule_reason, ' ')) AS reason FROM (SELECT DISTINCT pair_id, rule_reason FROM support_candidates WHERE rule_reason IS NOT NULL)), n AS (SELECT *, row_number() OVER (PARTITION BY reason ORDER BY pair_id) AS k FROM (SELECT DISTINCT * FROM r)) SELECT pair_id, reason FROM n WHERE k <= 10")
def t8_review_cap(t):
    r = t.support_candidates.where("rule_reason IS NOT NULL").select("pair_id", F.explode(F.split("rule_reason", " ")).alias("reason")).distinct()
    return R.top_per_group_salted(r, ["reason"], [F.col("pair_id")], 10).select("pair_id", "reason")


@BOOK.query("t9_shortlist", """
WITH r AS (SELECT page_id, candidate_id, caption_text, row_number() OVER (PARTITION BY page_id ORDER BY caption_score DESC NULLS LAST, candidate_id) AS n FROM (SELECT DISTINCT page_id, candidate_id, caption_text, caption_score FROM page_candidates) WHERE caption_text IS NOT NULL),
d AS (SELECT *, row_number() OVER (PARTITION BY page_id, lower(caption_text) ORDER BY n) AS k FROM r WHERE n <= 8) SELECT page_id, candidate_id, chr(CAST(64 + row_number() OVER (PARTITION BY page_id ORDER BY n) AS INTEGER)) AS letter FROM d WHERE k = 1""")
def t9_shortlist(t):
    r = t.page_candidates.where("caption_text IS NOT NULL").select("page_id", "candidate_id", "caption_text", "caption_score").distinct()
    return S.shortlist(r, "page_id", F.lower("caption_text"), [F.desc_nulls_last("caption_score"), F.col("candidate_id")], 8).select("page_id", "candidate_id", "letter")


# -- sets ------------------------------------------------------------------------------------------------------------

_ARR = "(SELECT task_id, list(fragment_text ORDER BY pair_id) AS xs FROM (SELECT DISTINCT task_id, pair_id, fragment_text FROM support_candidates WHERE task_id IS NOT NULL AND fragment_text IS NOT NULL) GROUP BY 1)"


def _texts(t):
    s = t.support_candidates.where("task_id IS NOT NULL AND fragment_text IS NOT NULL").select("task_id", "pair_id", "fragment_text").distinct()
    return s.groupBy("task_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pair_id", "fragment_text"))), lambda x: x["fragment_text"]).alias("xs"))


@BOOK.query("s1_first_spellings", f"WITH k AS (SELECT task_id, xs, list_transform(xs, lambda x: lower(regexp_replace(x, '\\s+', '', 'g'))) AS ks FROM {_ARR}) SELECT task_id, array_to_string(list_filter(xs, lambda x, i: ks[i] <> '' AND list_position(ks, ks[i]) = i), chr(10)) AS texts FROM k")
def s1_first_spellings(t):
    from vellum.functions import text as T

    return _texts(t).select("task_id", F.array_join(A.first_by(F.col("xs"), T.compact), "\n").alias("texts"))


@BOOK.query("s2_distinct_in_order", f"SELECT task_id, array_to_string(list_filter(xs, lambda x, i: list_position(xs, x) = i), chr(10)) AS texts, len(list_distinct(xs)) AS n FROM {_ARR}")
def s2_distinct_in_order(t):
    d = F.array_distinct("xs")
    return _texts(t).select("task_id", F.array_join(d, "\n").alias("texts"), F.size(d).cast("bigint").alias("n"))


@BOOK.query("s5_union_with_origin", "WITH u AS (SELECT page_id, 'specs' AS origin, 0 AS r FROM page_specs WHERE page_id IS NOT NULL UNION ALL SELECT page_id, 'candidates', 1 FROM page_candidates WHERE page_id IS NOT NULL UNION ALL SELECT page_id, 'targets', 2 FROM figure_targets WHERE page_id IS NOT NULL) SELECT page_id, arg_min(origin, r) AS origin, count(DISTINCT origin) AS origins FROM u GROUP BY 1")
def s5_union_with_origin(t):
    parts = {n: p.where("page_id IS NOT NULL").select("page_id") for n, p in (("specs", t.page_specs), ("candidates", t.page_candidates), ("targets", t.figure_targets))}
    return R.first_origin(parts, "page_id")


@BOOK.query("s6_id_sets", f"WITH g AS (SELECT task_id, list(DISTINCT evidence_id) FILTER (WHERE rule_label = 'support') AS a, list(DISTINCT evidence_id) FILTER (WHERE priority >= 4) AS b FROM {SUP} WHERE task_id IS NOT NULL GROUP BY 1) SELECT task_id, array_to_string(list_sort(list_intersect(coalesce(a, []), coalesce(b, []))), ',') AS both, array_to_string(list_sort(list_filter(coalesce(a, []), lambda x: NOT list_contains(coalesce(b, []), x))), ',') AS missed FROM g")
def s6_id_sets(t):
    g = _sup(t).where("task_id IS NOT NULL").groupBy("task_id").agg(F.collect_set(F.when(F.col("rule_label") == "support", F.col("evidence_id"))).alias("a"), F.collect_set(F.when(F.col("priority") >= 4, F.col("evidence_id"))).alias("b"))
    return g.select("task_id", F.array_join(F.array_sort(F.array_intersect("a", "b")), ",").alias("both"), F.array_join(F.array_sort(F.array_except("a", "b")), ",").alias("missed"))


@BOOK.query("s7_complement", f"SELECT task_id, array_to_string(list_filter([{', '.join(repr(f) for f in _FIELDS)}], lambda x: NOT list_contains(fs, x)), ',') AS missing FROM (SELECT task_id, list(DISTINCT field) AS fs FROM {SUP} WHERE task_id IS NOT NULL GROUP BY 1)")
def s7_complement(t):
    g = _sup(t).where("task_id IS NOT NULL").groupBy("task_id").agg(F.collect_set("field").alias("fs"))
    return g.select("task_id", F.array_join(A.complement(_FIELDS, F.col("fs")), ",").alias("missing"))


@BOOK.query("s8_boundary", f"WITH g AS (SELECT task_id, list_sort(list(DISTINCT field)) AS fs, list(DISTINCT field) FILTER (WHERE rule_allowed AND source_role = 'primary_visual') AS b FROM {SUP} WHERE task_id IS NOT NULL GROUP BY 1) SELECT task_id, array_to_string(CASE WHEN len(coalesce(b, [])) > 0 THEN list_filter(fs, lambda x: list_contains(b, x)) ELSE fs END, ',') AS allowed FROM g")
def s8_boundary(t):
    g = _sup(t).where("task_id IS NOT NULL").groupBy("task_id").agg(F.array_sort(F.collect_set("field")).alias("fs"), F.collect_set(F.when(F.col("rule_allowed") & (F.col("source_role") == "primary_visual"), F.col("field"))).alias("b"))
    return g.select("task_id", F.array_join(A.bounded_by(F.col("fs"), F.col("b")), ",").alias("allowed"))


@BOOK.query("s10_appended", f"SELECT page_id AS id, 'page' AS kind, category, CAST(NULL AS DOUBLE) AS area_ratio FROM {PAGE} UNION ALL SELECT candidate_id, 'candidate', NULL, area_ratio FROM {CAND} WHERE target_id IS NULL")
def s10_appended(t):
    a = _page(t).select(F.col("page_id").alias("id"), F.lit("page").alias("kind"), "category")
    b = _cand(t).where("target_id IS NULL").select(F.col("candidate_id").alias("id"), F.lit("candidate").alias("kind"), "area_ratio")
    return a.unionByName(b, allowMissingColumns=True)


@BOOK.query("s11_in_gold_order", f"WITH g AS (SELECT task_id, list(DISTINCT evidence_id) FILTER (WHERE rule_label = 'support') AS gold, list(DISTINCT evidence_id) FILTER (WHERE page IS NOT NULL) AS here, list(DISTINCT evidence_id) FILTER (WHERE priority >= 3) AS near FROM {SUP} WHERE task_id IS NOT NULL GROUP BY 1) SELECT task_id, array_to_string(list_filter(list_sort(coalesce(gold, [])), lambda x: list_contains(coalesce(here, []), x) AND list_contains(coalesce(near, []), x)), ',') AS ids FROM g")
def s11_in_gold_order(t):
    g = _sup(t).where("task_id IS NOT NULL").groupBy("task_id").agg(F.collect_set(F.when(F.col("rule_label") == "support", F.col("evidence_id"))).alias("gold"), F.collect_set(F.when(F.col("page").isNotNull(), F.col("evidence_id"))).alias("here"), F.collect_set(F.when(F.col("priority") >= 3, F.col("evidence_id"))).alias("near"))
    return g.select("task_id", F.array_join(A.in_order_of(F.array_sort("gold"), F.col("here"), F.col("near")), ",").alias("ids"))
