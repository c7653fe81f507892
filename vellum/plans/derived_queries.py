"""Queries of derived values and generated rows, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.functions import arrays as A
from vellum.functions import derive as D
from vellum.functions import geometry as G
from vellum.functions import text as T
from vellum.operators import generators as U
from vellum.plans.book import Book
from vellum.plans.relational_queries import CAND, FIG, PAGE, SUP, _cand, _fig, _page, _sup
from vellum.plans.scalar_queries import CAPTIONS, _captions
from vellum.sources import files

BOOK = Book()
queries, oracle_sql = (lambda: BOOK.calls), (lambda: BOOK.sql)

_BARE = "lower(regexp_replace({x}, '\\s+', '', 'g'))"
_SPACE = "trim(regexp_replace({x}, '\\s+', ' ', 'g'))"
_TIDY = "regexp_replace(regexp_replace(regexp_replace(replace({x}, chr(0), ' '), '[ \\t\\r\\f\\v]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g')"
_LIST = lambda xs: "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + "]"
_HAS = lambda c, ws: "(" + " OR ".join(f"contains({c}, '{w}')" for w in ws) + ")"
#: First occurrences in order.
_ONCE = lambda e: f"list_filter({e}, lambda x, i: list_position({e}, x) = i)"


@BOOK.query("f3_important_terms", f"""
WITH k AS (SELECT target_id, list_transform(list_filter(list_transform(regexp_extract_all(caption, '《[^》]{{1,32}}》|[一-鿿]{{2,8}}'), lambda x: regexp_replace(x, '^《|》$', '', 'g')), lambda x: NOT list_contains({_LIST(D.EMPTY_TERMS)}, x)), lambda x: {_BARE.format(x='x')}) AS t FROM {CAPTIONS} WHERE caption IS NOT NULL)
SELECT target_id, array_to_string(({_ONCE('t')})[1:20], ',') AS terms FROM k""")
def f3_important_terms(t):
    return _captions(t).where("caption IS NOT NULL").select("target_id", F.array_join(D.important_terms(F.col("caption")), ",").alias("terms"))


_Q = lambda x: x.replace("'", "''")
_QUALITY = f"""CASE WHEN (regexp_matches(sp, '{_Q(D.NUMBER_ONLY)}') AND length(ba) <= 24) OR regexp_matches(sp, '{D.RUNNING_HEAD}') OR regexp_matches(tr, '^[a-z]{{1,4}}\\s+') OR regexp_matches(tr, '^[{_Q(D.INNER_START)}]') OR regexp_matches(ba, '^(图》|圖》|》)') THEN 'plain_body_text' WHEN regexp_matches(ba, '{D.CAPTION_START}') THEN 'explicit_caption'
 WHEN regexp_matches(x, '《[^》]{{1,40}}》') AND length(ba) <= 180 THEN 'title_caption' WHEN length(ba) <= 120 AND NOT regexp_matches(ba, '{D.NO_LANDSCAPE}') AND regexp_matches(ba, '{D.ART}') THEN 'short_art_caption' ELSE 'plain_body_text' END"""


@BOOK.query("f19_caption_quality", f"""
WITH k AS (SELECT candidate_id, target_id, caption_score, area_ratio, coalesce(caption_text, '') AS x, {_SPACE.format(x="coalesce(caption_text, '')")} AS sp, regexp_replace(coalesce(caption_text, ''), '\\s+', '', 'g') AS ba, trim(coalesce(caption_text, ''), ' ' || chr(9) || chr(10) || chr(13)) AS tr FROM {CAND}), q AS (SELECT *, {_QUALITY} AS label FROM k)
SELECT candidate_id, label, round(1e-7 + CASE WHEN target_id IS NOT NULL THEN 3.0 ELSE 0.6 END + CASE label WHEN 'explicit_caption' THEN 2.0 WHEN 'title_caption' THEN 1.4 WHEN 'short_art_caption' THEN 0.8 ELSE -4.0 END + CASE WHEN regexp_matches(x, '{D.ART}') THEN 0.8 ELSE 0.0 END
 + least(greatest(coalesce(caption_score, 0.0) / 2.0, -2.0), 4.0) + least(1.0, coalesce(area_ratio, 0.0) / 0.16), 4) AS score FROM q""")
def f19_caption_quality(t):
    c = F.col("caption_text")
    return _cand(t).select("candidate_id", D.caption_quality(c).alias("label"), F.round(D.caption_quality_score(F.col("target_id").isNotNull(), c, F.col("caption_score"), F.col("area_ratio"), F.lit(None).cast("double")) + 1e-7, 4).alias("score"))  # halves up in both engines


_TEXTS = "(SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL)"


@BOOK.query("f10_packed_sentences", f"""
WITH RECURSIVE p AS (SELECT doc_id, text, list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '([。！？.!?；;])\\s+', '\\1' || chr(1), 'g'), chr(1) || '|\\n+'), lambda x: {_SPACE.format(x='x')}), lambda x: x <> '') AS ps FROM {_TEXTS} WHERE length(text) > 360),
w(doc_id, i, done, o) AS (SELECT doc_id, CAST(0 AS BIGINT), CAST([] AS VARCHAR[]), '' FROM p UNION ALL SELECT w.doc_id, i + 1, CASE WHEN length(o) + length(ps[i + 1]) <= 460 OR o = '' THEN done ELSE list_append(done, o) END, CASE WHEN length(o) + length(ps[i + 1]) <= 460 THEN trim(o || ' ' || ps[i + 1]) ELSE ps[i + 1] END FROM w JOIN p ON w.doc_id = p.doc_id WHERE i < len(ps)),
l AS (SELECT doc_id, arg_max(CASE WHEN o <> '' THEN list_append(done, o) ELSE done END, i) AS d FROM w GROUP BY 1) SELECT doc_id, array_to_string(d[1:6], chr(10)) AS packed, len(d[1:6]) AS n FROM l UNION ALL SELECT doc_id, text, 1 FROM {_TEXTS} WHERE length(text) <= 360""")
def f10_packed_sentences(t):
    d = t.documents.where("text IS NOT NULL").select("doc_id", "text").distinct().withColumn("p", D.packed_sentences(F.col("text")))
    return d.select("doc_id", F.array_join("p", "\n").alias("packed"), F.size("p").cast("bigint").alias("n"))


_ENDS = "regexp_matches({x}, '[。！？；.!?;”’》】）)]$')"


@BOOK.query("f12_snippets", f"""
WITH RECURSIVE p AS (SELECT doc_id, {_TIDY.format(x='text')} AS c, list_filter(list_transform(regexp_extract_all({_TIDY.format(x='text')}, '[^。！？!?；;\\n]+[。！？!?；;]?'), lambda x: trim(x)), lambda x: x <> '') AS ps FROM {_TEXTS}),
w(doc_id, i, o, stop) AS (SELECT doc_id, CAST(0 AS BIGINT), '', false FROM p WHERE length(c) > 360 UNION ALL SELECT w.doc_id, i + 1, CASE WHEN length(o) >= 360 AND ({_ENDS.format(x='o')} OR length(o) >= 720) THEN o ELSE o || ps[i + 1] END, false FROM w JOIN p ON w.doc_id = p.doc_id WHERE i < len(ps))
SELECT doc_id, arg_max(o, i) AS snippet FROM w GROUP BY 1 UNION ALL SELECT doc_id, c FROM p WHERE length(c) <= 360""")
def f12_snippets(t):
    return t.documents.where("text IS NOT NULL").select("doc_id", "text").distinct().select("doc_id", D.snippet(F.col("text")).alias("snippet"))


_VALUES = "(SELECT DISTINCT pair_id, field, gold_value FROM support_candidates)"
_PERIOD = "CASE " + " ".join(f"WHEN v = '{k}' THEN '{x}'" for k, x in D.PERIOD_NAMES.items()) + " ELSE v END"


@BOOK.query("f23_field_values", f"""
WITH x AS (SELECT pair_id, field, {_SPACE.format(x="coalesce(gold_value, '')")} AS v FROM {_VALUES}) SELECT pair_id, CASE WHEN v = '' THEN '' WHEN field = 'dimensions' THEN replace(replace(replace(replace({_BARE.format(x='v')}, '×', 'x'), '*', 'x'), '厘米', 'cm'), '公分', 'cm') WHEN field = 'creation_period_or_dynasty' THEN {_PERIOD}
 ELSE lower(regexp_replace(replace(v, '圖', '图'), '[^0-9A-Za-z一-鿿]', '', 'g')) END AS value FROM x""")
def f23_field_values(t):
    s = t.support_candidates.select("pair_id", "field", "gold_value").distinct()
    return s.select("pair_id", D.field_value(F.col("field"), F.col("gold_value")).alias("value"))


@BOOK.query("f26_placeholders", f"SELECT target_id, k AS field, coalesce(list_contains({_LIST(D.PLACEHOLDERS)}, trim(regexp_replace(lower(trim(coalesce(v, ''))), '[\\s　]+', ' ', 'g'), ' .,;:!?()[]{{}}<>\"''。，；：！？（）【】' || chr(9) || chr(10) || chr(13))), false) AS placeholder FROM (SELECT DISTINCT target_id, unnest(map_keys(metadata_fields)) AS k, unnest(list_transform(map_values(metadata_fields), lambda x: x.value)) AS v FROM figure_targets)")
def f26_placeholders(t):
    e = t.figure_targets.select("target_id", F.explode("metadata_fields").alias("field", "m")).select("target_id", "field", F.col("m.value").alias("v")).distinct()
    return e.select("target_id", "field", D.is_placeholder(F.col("v")).alias("placeholder"))


@BOOK.query("f28_likeness")
def f28_likeness(t):
    return _captions(t).select("target_id", F.round(T.likeness("caption", "title"), 6).alias("likeness"))


@BOOK.query("f30_match_scores", f"""
WITH k AS (SELECT target_id, {_BARE.format(x="coalesce(caption, '')")} AS x, {_BARE.format(x="coalesce(title, '')")} AS y FROM {CAPTIONS}), s AS (SELECT *, list_distinct(string_split(x, '')) AS p, list_distinct(string_split(y, '')) AS q FROM k)
SELECT target_id, round(CASE WHEN x = '' OR y = '' THEN 0.0 WHEN contains(x, y) OR contains(y, x) THEN 1.0 ELSE len(list_intersect(p, q)) * 1.0 / len(list_distinct(list_concat(p, q))) END, 6) AS score FROM s""")
def f30_match_scores(t):
    return _captions(t).select("target_id", F.round(T.contains_or_overlap(F.col("caption"), F.col("title")), 6).alias("score"))


@BOOK.query("f33_joined_lines", f"""
WITH RECURSIVE p AS (SELECT pair_id, list_filter(list_transform(string_split(fragment_text, chr(10)), lambda x: {_SPACE.format(x='x')}), lambda x: x <> '') AS ls FROM (SELECT DISTINCT pair_id, fragment_text FROM support_candidates WHERE fragment_text IS NOT NULL)),
w(pair_id, i, o) AS (SELECT pair_id, CAST(0 AS BIGINT), '' FROM p UNION ALL SELECT w.pair_id, i + 1, CASE WHEN o = '' THEN ls[i + 1] ELSE o || CASE WHEN regexp_matches(ls[i + 1], '^[A-Za-z0-9]') OR regexp_matches(o, '[A-Za-z0-9]$') THEN ' ' ELSE '' END || ls[i + 1] END FROM w JOIN p ON w.pair_id = p.pair_id WHERE i < len(ls)) SELECT pair_id, arg_max(o, i) AS line FROM w GROUP BY 1""")
def f33_joined_lines(t):
    s = t.support_candidates.where("fragment_text IS NOT NULL").select("pair_id", "fragment_text").distinct()
    return s.select("pair_id", D.joined_lines(F.split("fragment_text", "\n")).alias("line"))


_SCOPE = "CASE " + " ".join(f"WHEN {_HAS('c', ws)} THEN '{n}'" for n, ws in D.SCOPE_WORDS) + " WHEN coalesce(title, '') <> '' THEN 'full_work' ELSE '' END"
_MATS = "list_concat(list_filter([" + ", ".join([f"CASE WHEN contains(n, '{m}') THEN '{m}' END" for m in D.MATERIALS] + [f"CASE WHEN contains(n, '{p}') AND NOT {_HAS('n', ws)} THEN '{p}' END" for p, ws in D.PART_MATERIALS]) + "], lambda x: x IS NOT NULL), regexp_extract_all(n, '[0-9]+(?:\\.[0-9]+)?\\s*[xX×]\\s*[0-9]+(?:\\.[0-9]+)?\\s*(?:cm|厘米)'))"


@BOOK.query("f34_inferred_fields", f"""
WITH k AS (SELECT target_id, title, coalesce(caption, '') AS c, {_SPACE.format(x="coalesce(caption, '')")} AS n FROM {CAPTIONS}), s AS (SELECT *, {_SCOPE} AS scope, {_MATS} AS m FROM k)
SELECT target_id, scope, CASE WHEN scope = 'partial_detail' THEN 'detail_crop' WHEN scope IN ('scroll_section', 'album_leaf') THEN scope WHEN contains(c, '轴') THEN 'hanging_scroll' WHEN contains(c, '卷') THEN 'handscroll' WHEN coalesce(title, '') <> '' THEN 'painting_or_figure' ELSE '' END AS kind, array_to_string({_ONCE('m')}, '；') AS materials FROM s""")
def f34_inferred_fields(t):
    k = _captions(t).withColumn("scope", D.shown_scope(F.col("caption"), F.col("title")))
    return k.select("target_id", "scope", D.object_kind(F.col("caption"), F.col("scope"), F.col("title")).alias("kind"), D.materials(F.col("caption")).alias("materials"))


_TAGGED = "text || CASE WHEN doc_id % 3 = 0 THEN '吴门与清初四王' WHEN doc_id % 3 = 1 THEN '文人画与青绿、南北宗' ELSE '' END"


@BOOK.query("f35_school_tags", f"WITH x AS (SELECT doc_id, {_TAGGED} AS t FROM {_TEXTS}), g AS (SELECT doc_id, list_filter([" + ", ".join(f"CASE WHEN contains(t, '{w}') THEN '{n}' END" for w, n in D.SCHOOL_TAGS) + f"], lambda x: x IS NOT NULL) AS g FROM x) SELECT doc_id, array_to_string({_ONCE('g')}, ',') AS tags FROM g")
def f35_school_tags(t):
    # The invented texts name no school; two thirds get a sentence that does.
    extra = F.when(F.col("doc_id") % 3 == 0, "吴门与清初四王").when(F.col("doc_id") % 3 == 1, "文人画与青绿、南北宗").otherwise("")
    d = t.documents.where("text IS NOT NULL").select("doc_id", "text").distinct()
    return d.select("doc_id", F.array_join(D.school_tags(F.concat("text", extra)), ",").alias("tags"))


@BOOK.query("f38_row_keys", "SELECT feed, file_name, line_no, concat_ws('|', coalesce(feed, ''), coalesce(file_name, ''), coalesce(CAST(line_no AS VARCHAR), ''), coalesce(payload, '')[1:256]) AS row_key FROM (SELECT DISTINCT feed, file_name, line_no, payload FROM target_exports)")
def f38_row_keys(t):
    e = t.target_exports.select("feed", "file_name", "line_no", "payload").distinct()
    return e.select("feed", "file_name", "line_no", D.row_key(F.col("feed"), F.col("file_name"), F.col("line_no"), payload=F.col("payload")).alias("row_key"))


@BOOK.query("f52_page_scores", f"SELECT page_id, CAST(image_count * 25 + figure_anchor_count * 8 + landscape_term_count * 2 + len(regexp_extract_all(coalesce(text_preview, ''), '[0-9]{{4}}')) * 3 - CASE WHEN regexp_matches(coalesce(text_preview, '')[1:800], '(?i)chapter|part') THEN 40 ELSE 0 END AS BIGINT) AS page_score FROM {PAGE}")
def f52_page_scores(t):
    x = F.coalesce("text_preview", F.lit(""))
    s = D.page_score(F.col("image_count"), F.col("figure_anchor_count"), F.col("landscape_term_count"), F.regexp_count(x, F.lit("[0-9]{4}")), F.substring(x, 1, 800).rlike("(?i)chapter|part"))
    return _page(t).select("page_id", s.cast("bigint").alias("page_score"))


@BOOK.query("f53_region_scores", f"SELECT candidate_id, round(CASE WHEN target_id IS NOT NULL THEN 4.0 ELSE 1.2 END + greatest(-2.0, least(8.0, coalesce(caption_score, -999.0))) + 2.0 * least(1.0, coalesce(area_ratio, 0.0) / 0.18) - CASE WHEN area_ratio > 0.68 THEN 3.0 ELSE 0.0 END, 6) AS region_score FROM {CAND}")
def f53_region_scores(t):
    return _cand(t).select("candidate_id", F.round(D.region_score(F.col("target_id").isNotNull(), F.col("caption_score"), F.col("area_ratio"), F.lit(None).cast("double")), 6).alias("region_score"))


@BOOK.query("f54_source_priorities", "SELECT doc_id, round_even(greatest(0.05, least(1.3, CASE authority_level WHEN 'A+' THEN 1.2 WHEN 'A' THEN 1.0 WHEN 'A-' THEN 0.85 WHEN 'B' THEN 0.55 WHEN 'C' THEN 0.25 ELSE 0.5 END + CASE WHEN coalesce(evidence_type = 'catalogue_entry', false) THEN 0.08 ELSE 0.0 END - CASE WHEN coalesce(contains(source, 'archive'), false) THEN 0.12 ELSE 0.0 END - CASE WHEN coalesce(contains(source, 'digest'), false) THEN 0.10 ELSE 0.0 END)), 3) AS priority FROM (SELECT DISTINCT doc_id, authority_level, evidence_type, source FROM documents)")
def f54_source_priorities(t):
    d = t.documents.select("doc_id", "authority_level", "evidence_type", "source").distinct()
    return d.select("doc_id", D.source_priority(F.col("authority_level"), F.col("evidence_type") == "catalogue_entry", F.contains("source", F.lit("archive")), F.contains("source", F.lit("digest"))).alias("priority"))


@BOOK.query("f64_cut_off_query", f"SELECT doc_id, {_SPACE.format(x='text')}[1:120] AS query FROM {_TEXTS} WHERE NOT contains(text, '\"') AND NOT contains(text, '�') AND {_SPACE.format(x='text')} <> ''")
def f64_cut_off_query(t):
    d = t.documents.where("text IS NOT NULL").select("doc_id", "text").distinct().where("NOT contains(text, '\"') AND NOT contains(text, '�')")
    broken = F.concat(F.lit('{"action": "retrieve", "query": "'), "text")
    return d.select("doc_id", D.cut_off_value(broken, "query").alias("query")).where("query IS NOT NULL")


@BOOK.query("f65_loose_json", "SELECT feed, file_name, line_no, json_extract_string(payload, '$.target_id') AS target_id, true AS parses FROM (SELECT DISTINCT feed, file_name, line_no, payload FROM target_exports)")
def f65_loose_json(t):
    e = t.target_exports.select("feed", "file_name", "line_no", "payload").distinct()
    # The line as some feeds write it: a key a line, no comma before the first ones, one too many at the end.
    loose = F.regexp_replace(F.regexp_replace(F.regexp_replace("payload", r"\}$", ",\n}"), r', "(confidence|page_num|width)"', '\n"$1"'), r"^\{", "{\n")
    fixed = D.with_commas(loose)
    return e.withColumn("x", fixed).select("feed", "file_name", "line_no", F.get_json_object("x", "$.target_id").alias("target_id"), F.expr("try_parse_json(x) IS NOT NULL").alias("parses"))


_IDS = f"(SELECT task_id, list(DISTINCT evidence_id) FILTER (WHERE rule_label = 'support') AS e, list(DISTINCT evidence_id) FILTER (WHERE rule_allowed) AS c, list(DISTINCT evidence_id) FILTER (WHERE priority >= 5) AS o FROM {SUP} WHERE task_id IS NOT NULL GROUP BY 1)"


def _ids(t):
    pick = lambda c: F.collect_set(F.when(c, F.col("evidence_id")))
    return _sup(t).where("task_id IS NOT NULL").groupBy("task_id").agg(pick(F.col("rule_label") == "support").alias("e"), pick(F.col("rule_allowed")).alias("c"), pick(F.col("priority") >= 5).alias("o"))


@BOOK.query("f69_gold_ids", f"SELECT task_id, array_to_string(list_sort(list_distinct(list_concat(coalesce(e, []), coalesce(c, [])))), ',') AS ids FROM {_IDS}")
def f69_gold_ids(t):
    return _ids(t).select("task_id", F.array_join(F.array_sort(A.united(F.col("e"), F.col("c"))), ",").alias("ids"))


@BOOK.query("f70_action_ids", "SELECT task_id, run, array_to_string(list_sort(list(DISTINCT evidence_id)), ',') AS used, array_to_string(list_sort(list(DISTINCT evidence_id) FILTER (WHERE c)), ',') AS cited FROM (SELECT DISTINCT task_id, evidence_id, unnest(used_by_runs) AS run, cited_by_runs FROM support_candidates WHERE task_id IS NOT NULL AND evidence_id IS NOT NULL), LATERAL (SELECT list_contains(coalesce(cited_by_runs, []), run) AS c) GROUP BY 1, 2")
def f70_action_ids(t):
    s = t.support_candidates.where("task_id IS NOT NULL AND evidence_id IS NOT NULL").select("task_id", "evidence_id", F.explode("used_by_runs").alias("run"), "cited_by_runs")
    cited = F.array_sort(F.collect_set(F.when(F.array_contains("cited_by_runs", F.col("run")), F.col("evidence_id"))))
    g = s.groupBy("task_id", "run").agg(F.array_join(F.array_sort(F.collect_set("evidence_id")), ",").alias("used"), cited.alias("c"))
    return g.select("task_id", "run", "used", F.when(F.size("c") > 0, F.array_join("c", ",")).alias("cited"))


@BOOK.query("f71_overlapping_ids", f"SELECT task_id, array_to_string(list_sort(list_intersect(CASE WHEN coalesce(len(e), 0) > 0 THEN e ELSE coalesce(c, []) END, coalesce(o, []))), ',') AS ids FROM {_IDS}")
def f71_overlapping_ids(t):
    return _ids(t).select("task_id", F.array_join(F.array_sort(A.hits_or_candidates(F.col("e"), F.col("c"), F.col("o"))), ",").alias("ids"))


_FIELDS = ("caption_text", "creator_or_attribution", "creation_period_or_dynasty", "collection_institution", "dimensions", "medium_material")
_FIRST = f"(SELECT task_id, field, arg_min(gold_value, pair_id) AS v FROM {SUP} WHERE task_id IS NOT NULL AND rule_label = 'support' AND gold_value IS NOT NULL GROUP BY 1, 2)"


@BOOK.query("f72_gold_fields", f"SELECT task_id, string_agg(field || '=' || v, ';' ORDER BY field) AS fields FROM {_FIRST} GROUP BY 1")
def f72_gold_fields(t):
    s = _sup(t).where("task_id IS NOT NULL AND rule_label = 'support' AND gold_value IS NOT NULL")
    m = s.groupBy("task_id").agg(F.array_sort(F.collect_list(F.struct("pair_id", F.col("field").alias("key"), F.col("gold_value").alias("value")))).alias("es"))
    first = A.first_per_key(F.transform("es", lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value"))))
    return m.select("task_id", F.array_join(F.transform(F.array_sort(F.map_entries(first)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("fields"))


@BOOK.query("f73_gold_claims", f"WITH f AS (SELECT unnest({_LIST(_FIELDS)}) AS field), t AS (SELECT DISTINCT target_id FROM figure_targets) SELECT t.target_id, f.field, coalesce(g.v, '') AS value, g.v IS NULL AS abstain FROM t CROSS JOIN f LEFT JOIN {_FIRST} g ON g.task_id = t.target_id AND g.field = f.field")
def f73_gold_claims(t):
    s = _sup(t).where("task_id IS NOT NULL AND rule_label = 'support' AND gold_value IS NOT NULL").groupBy("task_id", "field").agg(F.min_by("gold_value", "pair_id").alias("v"))
    known = s.groupBy("task_id").agg(F.map_from_entries(F.collect_list(F.struct("field", "v"))).alias("m"))
    rows = t.figure_targets.select("target_id").distinct().join(known, F.col("target_id") == F.col("task_id"), "left").withColumn("m", F.coalesce("m", F.create_map().cast("map<string,string>")))
    claims = rows.select("target_id", "m", F.explode(A.filled_or_default(_FIELDS, F.col("m"), F.lit(""))).alias("z"))
    return claims.select("target_id", "z.field", "z.value", (~F.map_contains_key("m", F.col("z.field"))).alias("abstain"))


@BOOK.query("f74_anchor_profiles", f"""
WITH c AS (SELECT page_id, list(DISTINCT caption_text) AS cs FROM page_candidates WHERE page_id IS NOT NULL AND caption_text IS NOT NULL GROUP BY 1), k AS (SELECT page_id, list_sort(cs)[1:12] AS cs FROM c), l AS (SELECT page_id, len(cs) AS captions, flatten(list_transform(cs, lambda x: list_transform(regexp_extract_all(x, '(?i)(?:图版|图|圖|figure|fig\\.?|plate|pl\\.|abb\\.|tafel|ill\\.)\\s*[0-9]+[a-z]?(?:[.-][0-9]+)*'), lambda y: lower(regexp_replace(y, '[\\s.]+', '', 'g'))))) AS ls,
 flatten(list_transform(cs, lambda x: regexp_extract_all(x, '《([^》]{{1,40}})》', 1))) AS ts FROM k) SELECT page_id, CAST(captions AS INTEGER) AS captions, array_to_string(({_ONCE('ls')})[1:12], ',') AS labels, array_to_string(({_ONCE('ts')})[1:24], ',') AS titles FROM l""")
def f74_anchor_profiles(t):
    return U.anchor_profiles(t.page_candidates.where("page_id IS NOT NULL"), "page_id", "caption_text").select("page_id", F.size("captions").alias("captions"), F.array_join("labels", ",").alias("labels"), F.array_join("titles", ",").alias("titles"))


@BOOK.query("f75_stamped", "SELECT target_id, len(map_keys(base_fields)) + 1 AS keys, 'v2' AS version FROM (SELECT target_id, arg_min(base_fields, ingested_at) AS base_fields FROM figure_targets WHERE base_fields IS NOT NULL GROUP BY target_id HAVING count(DISTINCT ingested_at) = count(*))")
def f75_stamped(t):
    one = t.figure_targets.where("base_fields IS NOT NULL").groupBy("target_id").agg(F.min_by("base_fields", "ingested_at").alias("m"), F.count("*").alias("c"), F.count_distinct("ingested_at").alias("d")).where("c = d")
    stamped = U.stamped(F.col("m"), version="v2")
    return one.select("target_id", F.size(stamped).cast("bigint").alias("keys"), F.try_element_at(stamped, F.lit("version")).alias("version"))


_CORR = f"(SELECT target_id, min(caption_text) AS x FROM {CAND} WHERE target_id IS NOT NULL AND caption_text IS NOT NULL GROUP BY 1)"


@BOOK.query("f76_corrected", f"SELECT f.target_id, coalesce(c.x, f.caption) AS caption, CASE WHEN c.x IS NOT NULL AND c.x IS DISTINCT FROM f.caption THEN f.caption END AS original_caption FROM {CAPTIONS} f LEFT JOIN {_CORR} c USING (target_id)")
def f76_corrected(t):
    fixes = _cand(t).where("target_id IS NOT NULL AND caption_text IS NOT NULL").groupBy("target_id").agg(F.min("caption_text").alias("x"))
    return U.corrected(_captions(t), fixes, "target_id", "caption", "x").select("target_id", "caption", "original_caption")


@BOOK.query("f80_missing_commas", "SELECT feed, file_name, line_no, true AS parses FROM (SELECT DISTINCT feed, file_name, line_no FROM target_exports)")
def f80_missing_commas(t):
    e = t.target_exports.select("feed", "file_name", "line_no", "payload").distinct()
    broken = F.regexp_replace("payload", r', "(object_type|image_scope|confidence|page_num|width)"', '\n"$1"')
    return e.withColumn("x", D.with_commas(broken)).select("feed", "file_name", "line_no", F.expr("try_parse_json(x) IS NOT NULL").alias("parses")).distinct()


@BOOK.query("f81_prompt_metadata", f"SELECT DISTINCT pair_id, trim(split_part(split_part(source_file, '；', 1), chr(10), 1)) AS source_file, CAST(page AS VARCHAR) AS page FROM {SUP} WHERE source_file IS NOT NULL")
def f81_prompt_metadata(t):
    s = _sup(t).where("source_file IS NOT NULL")
    prompt = F.concat(F.lit("source_file："), "source_file", F.lit("；"), F.coalesce(F.concat(F.lit("page："), F.col("page").cast("string")), F.lit("")), F.lit("\nfield："), "field")
    m = s.withColumn("m", D.named_parts(prompt, ("source_file", "page")))
    return m.select("pair_id", F.try_element_at("m", F.lit("source_file")).alias("source_file"), F.try_element_at("m", F.lit("page")).alias("page")).distinct()


# -- sources, projections, generated rows ------------------------------------------------------------------------------

@BOOK.query("a21_log_runs", "SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS started, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS ended, CAST(count(*) FILTER (WHERE event_type = 'error') AS INTEGER) AS rc, round(date_diff('second', date_trunc('second', min(ts)), date_trunc('second', max(ts))) / 60.0, 2) AS minutes, round(arg_max(value, struct_pack(a := ts, b := event_id)), 2) AS last_reward FROM events GROUP BY 1")
def a21_log_runs(t):
    e = t.events
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    ends = e.groupBy("user_id").agg(F.min("ts").alias("a"), F.max("ts").alias("b"), F.count_if(F.col("event_type") == "error").alias("rc"))
    lines = (
        ends.select("user_id", F.lit(0).cast("bigint").alias("at"), F.concat(F.lit("START "), stamp("a")).alias("line"))
        .unionByName(e.select("user_id", (F.unix_micros(F.col("ts").cast("timestamp")) * 4).alias("at"), F.concat(F.lit("\x1b[32mreward/mean:"), F.round("value", 2).cast("string"), F.lit("\x1b[0m")).alias("line")))
        .unionByName(ends.select("user_id", F.lit(2**62).alias("at"), F.concat(F.lit("END "), stamp("b"), F.lit(" rc="), F.col("rc").cast("string")).alias("line")))
    )
    r = files.log_runs(lines, "user_id", "line", "at", "reward/mean")
    return r.select("user_id", stamp("started").alias("started"), stamp("ended").alias("ended"), "rc", "minutes", F.col("last").alias("last_reward"))


@BOOK.query("a22_legacy_ids", "SELECT doc_id AS old_id, 'ev_' || sha1(concat_ws('|', source, CAST(page_start AS VARCHAR), text))[1:20] AS new_id FROM (SELECT DISTINCT doc_id, source, page_start, text FROM documents)")
def a22_legacy_ids(t):
    d = t.documents.select("doc_id", "source", "page_start", "text").distinct()
    return files.imported(d, "doc_id", ["source", "page_start", "text"]).select("old_id", "new_id")


@BOOK.query("a18_regions", """
WITH b AS (SELECT DISTINCT page_id, candidate_id, image_bbox AS box, 'figure' AS label, coalesce(caption_score, 0) AS s FROM page_candidates UNION ALL SELECT DISTINCT page_id, candidate_id, caption_bbox, 'caption', coalesce(caption_score, 0) FROM page_candidates),
v AS (SELECT page_id, array_to_string(box, ',') AS box, label, max(s) AS s FROM b WHERE coalesce(len(box), 0) = 4 AND box[3] > box[1] AND box[4] > box[2] GROUP BY 1, 2, 3), r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY CASE WHEN label = 'figure' THEN 0 ELSE 1 END, s DESC, box) AS rank FROM v) SELECT page_id, box, label, rank FROM r WHERE rank <= 6""")
def a18_regions(t):
    c = t.page_candidates
    kids = F.array(F.struct(F.lit("figure").alias("label"), F.col("image_bbox").alias("box")), F.struct(F.lit("caption").alias("label"), F.col("caption_bbox").alias("box")))
    raw = c.select("page_id", F.coalesce("caption_score", F.lit(0.0)).alias("score"), kids.alias("children"))
    return U.normal_regions(raw, "page_id", "children", "score", ("figure", "caption"), 6).select("page_id", F.array_join(F.col("box").cast("array<string>"), ",").alias("box"), "label", "rank")


@BOOK.query("a35_run_steps", "SELECT pair_id, run, 'used' AS origin FROM (SELECT DISTINCT pair_id, unnest(used_by_runs) AS run FROM support_candidates) UNION ALL SELECT pair_id, run, 'cited' FROM (SELECT DISTINCT pair_id, unnest(cited_by_runs) AS run FROM support_candidates)")
def a35_run_steps(t):
    s = t.support_candidates.select("pair_id", "used_by_runs", "cited_by_runs")
    return U.exploded_union(s, ["pair_id"], {"used": "used_by_runs", "cited": "cited_by_runs"}, "run").distinct()


@BOOK.query("b2_usable", f"SELECT pair_id FROM {SUP} WHERE rule_allowed IS DISTINCT FROM false")
def b2_usable(t):
    from vellum.operators.retrieval import usable

    return _sup(t).where(usable(F.col("rule_allowed"))).select("pair_id")


@BOOK.query("b24_public_columns", "SELECT DISTINCT candidate_id, page_id, page, area_ratio FROM page_candidates")
def b24_public_columns(t):
    hidden = ("target_id", "source_file", "source_stem", "page_count", "bbox_pt", "image_bbox", "caption_bbox", "caption_text", "caption_score", "page_width", "page_height")
    return U.without(t.page_candidates, hidden).distinct()


@BOOK.query("b25_slim_json", "SELECT feed, file_name, line_no, list_sort(list_filter(json_keys(payload), lambda x: json_type(json_extract(payload, '$.\"' || x || '\"')) <> 'NULL')) AS keys FROM (SELECT DISTINCT feed, file_name, line_no, payload FROM target_exports)")
def b25_slim_json(t):
    e = t.target_exports.select("feed", "file_name", "line_no", "payload").distinct()
    return e.select("feed", "file_name", "line_no", F.array_sort(F.json_object_keys(D.slim_json(F.col("payload")))).alias("keys"))


@BOOK.query("b26_public_evidence", f"SELECT pair_id, coalesce(nullif(gold_value, ''), nullif(fragment_text, ''), nullif(field, ''), 'none') AS text, round(coalesce(rule_confidence, 0), 3) AS score FROM {SUP}")
def b26_public_evidence(t):
    from vellum.functions import measures as M

    return _sup(t).select("pair_id", F.coalesce(M.first_filled(F.col("gold_value"), F.col("fragment_text"), F.col("field")), F.lit("none")).alias("text"), F.round(F.coalesce("rule_confidence", F.lit(0.0)), 3).alias("score"))


@BOOK.query("b31_suspicious_boxes", """
WITH b AS (SELECT DISTINCT target_id, target_bbox_px AS a, caption_bbox_px AS c, width AS w, height AS h FROM figure_targets WHERE len(target_bbox_px) = 4 AND width > 0 AND height > 0), r AS (SELECT target_id, (a[3] - a[1]) * 1.0 * (a[4] - a[2]) / (w * 1.0 * h) AS ra, (least(a[3], 1000) - least(a[1], 1000)) * 1.0 * (least(a[4], 1000) - least(a[2], 1000)) / 1000000.0 AS na,
 CASE WHEN len(c) = 4 THEN (c[3] - c[1]) * 1.0 * (c[4] - c[2]) / (w * 1.0 * h) END AS rc, CASE WHEN len(c) = 4 THEN (least(c[3], 1000) - least(c[1], 1000)) * 1.0 * (least(c[4], 1000) - least(c[2], 1000)) / 1000000.0 END AS nc FROM b)
SELECT target_id, array_to_string(list_filter([CASE WHEN coalesce(rc > 0 AND nc > rc * 1.45 AND nc > 0.01, false) THEN 'caption_larger' END, CASE WHEN na > 0.35 AND ra > 0.01 AND na > ra * 1.45 THEN 'target_larger' END], lambda x: x IS NOT NULL), ',') AS reasons FROM r""")
def b31_suspicious_boxes(t):
    f = t.figure_targets.where((F.size("target_bbox_px") == 4) & (F.col("width") > 0) & (F.col("height") > 0)).select("target_id", "target_bbox_px", "caption_bbox_px", "width", "height").distinct()
    return f.select("target_id", F.array_join(G.scale_suspicions(F.col("target_bbox_px"), F.col("caption_bbox_px"), F.col("width"), F.col("height")), ",").alias("reasons"))


@BOOK.query("u7_generated_rows", f"SELECT target_id, 'claim' AS kind, k AS name FROM (SELECT DISTINCT target_id, unnest(map_keys(metadata_fields)) AS k FROM figure_targets) UNION ALL SELECT task_id, 'evidence', evidence_id FROM (SELECT DISTINCT task_id, evidence_id FROM {SUP} WHERE task_id IS NOT NULL AND evidence_id IS NOT NULL)")
def u7_generated_rows(t):
    claims = t.figure_targets.select("target_id", F.explode(F.map_keys("metadata_fields")).alias("name"))
    links = _sup(t).where("task_id IS NOT NULL AND evidence_id IS NOT NULL").select(F.col("task_id").alias("target_id"), F.col("evidence_id").alias("name"))
    return U.kinds_of_rows({"claim": claims, "evidence": links}).distinct().select("target_id", "kind", "name")


_LAB = "(?i)(?:图版|图|圖|figure|fig\\.?|plate|pl\\.|abb\\.|tafel|ill\\.)\\s*[0-9]+[a-z]?(?:[.-][0-9]+)*"


@BOOK.query("u8_label_fragments", f"""
WITH s AS (SELECT DISTINCT pair_id, {_SPACE.format(x='fragment_text')} || ' ' || {_SPACE.format(x='gold_value')} || ' Fig. 2 with the rest' AS x FROM (SELECT DISTINCT pair_id, fragment_text, coalesce(gold_value, '-') AS gold_value FROM support_candidates WHERE fragment_text IS NOT NULL)),
p AS (SELECT pair_id, string_split(regexp_replace(x, '({_LAB})', chr(1) || '\\1', 'g'), chr(1)) AS ps FROM s), q AS (SELECT pair_id, ps[2:] AS ps FROM p WHERE len(ps) > 2)
SELECT pair_id, unnest(list_transform(ps[1:6], lambda x: trim(x, ' ;,，。'))) AS fragment, unnest(generate_series(0, len(ps[1:6]) - 1)) AS no FROM q""")
def u8_label_fragments(t):
    s = t.support_candidates.where("fragment_text IS NOT NULL").select("pair_id", F.concat_ws(" ", T.normal_space(F.col("fragment_text")), T.normal_space(F.coalesce("gold_value", F.lit("-"))), F.lit("Fig. 2 with the rest")).alias("x")).distinct()
    return s.select("pair_id", F.posexplode(U.label_fragments(F.col("x"))).alias("no", "fragment")).select("pair_id", "fragment", F.col("no").cast("bigint").alias("no"))


@BOOK.query("u9_target_fragments", """
WITH f AS (SELECT DISTINCT target_id, base_fields['caption_text'] AS c, base_fields['depicted_work_title'] AS w, metadata_fields['medium_material'].value AS m FROM figure_targets)
SELECT target_id, kind, text, 'fr_' || sha1(concat_ws('|', target_id, kind, text))[1:16] AS fragment_id FROM (SELECT target_id, 'caption' AS kind, c AS text FROM f UNION ALL SELECT target_id, 'title', w FROM f UNION ALL SELECT target_id, 'medium', m FROM f) WHERE coalesce(trim(text), '') <> ''""")
def u9_target_fragments(t):
    f = t.figure_targets.select("target_id", F.col("base_fields")["caption_text"].alias("caption"), F.col("base_fields")["depicted_work_title"].alias("title"), F.col("metadata_fields")["medium_material"]["value"].alias("medium")).distinct()
    return U.fragments_of(f, "target_id", ["caption", "title", "medium"]).select("target_id", "kind", "text", "fragment_id")


@BOOK.query("u10_boundary_rows", f"SELECT s.pair_id, CASE WHEN s.rule_label = 'support' THEN 'positive' WHEN NOT coalesce(s.rule_allowed, false) THEN 'negative' ELSE 'boundary' END AS kind, f.split FROM {SUP} s JOIN (SELECT target_id, min(split) AS split FROM figure_targets GROUP BY 1) f ON s.task_id = f.target_id WHERE s.rule_label IS NOT NULL")
def u10_boundary_rows(t):
    f = t.figure_targets.groupBy("target_id").agg(F.min("split").alias("split"))
    s = _sup(t).where("rule_label IS NOT NULL").join(f, F.col("task_id") == F.col("target_id"))
    return s.select("pair_id", F.when(F.col("rule_label") == "support", "positive").when(~F.coalesce("rule_allowed", F.lit(False)), "negative").otherwise("boundary").alias("kind"), "split")


@BOOK.query("u11_counterfactuals", f"SELECT pair_id, field, '' AS value, true AS abstain FROM {SUP} WHERE rule_label = 'wrong_target' UNION ALL SELECT pair_id, field, coalesce(gold_value, ''), gold_value IS NULL FROM {SUP} WHERE rule_label = 'wrong_target'")
def u11_counterfactuals(t):
    s = _sup(t).where("rule_label = 'wrong_target'").select("pair_id", F.struct("field", F.coalesce("gold_value", F.lit("")).alias("value"), F.col("gold_value").isNull().alias("abstain")).alias("claim"))
    return U.counterfactuals(s, "claim", {"value": F.lit(""), "abstain": F.lit(True)}).select("pair_id", "claim.field", "claim.value", "claim.abstain")


@BOOK.query("u14_chat_rows", f"SELECT pair_id, '{{\"role\":\"user\",\"content\":\"' || field || '\"}}' AS first_message, 2 AS messages FROM {SUP} WHERE gold_value IS NOT NULL")
def u14_chat_rows(t):
    s = _sup(t).where("gold_value IS NOT NULL")
    chat = U.chat_rows(s, F.col("field"), F.col("gold_value"))
    return chat.select("pair_id", F.to_json(F.col("messages")[0]).alias("first_message"), F.size("messages").alias("messages"))
