"""Queries of the scalar functions (text, hashes, geometry, JSON, dates) over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.functions import geometry as G
from vellum.functions import measures as M
from vellum.functions import text as T
from vellum.plans.book import Book

BOOK = Book()
queries, oracle_sql = (lambda: BOOK.calls), (lambda: BOOK.sql)


def _docs(t):
    return t.documents.select("doc_id", "text", "lang", "source", "page_start").distinct()


def _captions(t):
    return t.figure_targets.select("target_id", F.col("base_fields")["caption_text"].alias("caption"), F.col("base_fields")["depicted_work_title"].alias("title")).distinct()


CAPTIONS = "(SELECT DISTINCT target_id, base_fields['caption_text'] AS caption, base_fields['depicted_work_title'] AS title FROM figure_targets)"
DOCS = "(SELECT DISTINCT doc_id, text, lang, source, page_start FROM documents)"


@BOOK.query("f1_tokens", f"""
SELECT doc_id, CAST(len(tk) AS BIGINT) AS n_tokens, CAST(len(list_distinct(tk)) AS BIGINT) AS n_distinct, tk[1] AS first_token, tk[len(tk)] AS last_token
FROM (SELECT doc_id, list_concat(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_]+'), regexp_extract_all(lower(coalesce(text, '')), '[一-鿿]')) AS tk FROM {DOCS})""")
def f1_tokens(t):
    tk = T.tokens(F.col("text"))
    return _docs(t).withColumn("tk", tk).select("doc_id", F.size("tk").cast("bigint").alias("n_tokens"), F.size(F.array_distinct("tk")).cast("bigint").alias("n_distinct"), F.try_element_at("tk", F.lit(1)).alias("first_token"), F.try_element_at("tk", F.lit(-1)).alias("last_token"))


@BOOK.query("f2_bigram_tokens", f"""
WITH h AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS w, regexp_extract_all(lower(coalesce(text, '')), '[一-鿿]') AS c FROM {DOCS})
SELECT doc_id, CAST(len(w) + CASE WHEN len(c) >= 2 THEN len(c) - 1 ELSE len(c) END AS BIGINT) AS n_tokens,
       CASE WHEN len(c) >= 2 THEN c[1] || c[2] WHEN len(c) = 1 THEN c[1] END AS first_bigram FROM h""")
def f2_bigram_tokens(t):
    han = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(T.CJK), F.lit(0))
    tk = T.word_and_bigram_tokens(F.col("text"))
    return _docs(t).withColumn("tk", tk).withColumn("h", han).select("doc_id", F.size("tk").cast("bigint").alias("n_tokens"), F.when(F.size("h") > 0, F.try_element_at("tk", F.size("tk") - F.size("h") + F.when(F.size("h") >= 2, 2).otherwise(1))).alias("first_bigram"))


@BOOK.query("f4_compact", f"SELECT target_id, lower(regexp_replace(caption, '\\s+', '', 'g')) AS compact FROM {CAPTIONS}")
def f4_compact(t):
    return _captions(t).select("target_id", T.compact(F.col("caption")).alias("compact"))


@BOOK.query("f5_compact_alnum", f"SELECT target_id, lower(regexp_replace(replace(caption, '圖', '图'), '[^0-9A-Za-z一-鿿]', '', 'g')) AS compact FROM {CAPTIONS}")
def f5_compact_alnum(t):
    return _captions(t).select("target_id", T.compact_alnum(F.col("caption")).alias("compact"))


@BOOK.query("f6_clean_text", """
SELECT pair_id, sha1(regexp_replace(regexp_replace(regexp_replace(replace(fragment_text, chr(0), ' '), '[ \\t\\r\\f\\v]+', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g')) AS cleaned_sha1
FROM (SELECT DISTINCT pair_id, fragment_text FROM support_candidates)""")
def f6_clean_text(t):
    return t.support_candidates.select("pair_id", "fragment_text").distinct().select("pair_id", F.sha1(T.clean_text(F.col("fragment_text"))).alias("cleaned_sha1"))


@BOOK.query("f7_truncate", f"""
SELECT doc_id, CASE WHEN length(n) > 80 THEN n[1:77] || '...' ELSE n END AS inside, CASE WHEN length(n) > 80 THEN n[1:80] || '...' ELSE n END AS added, CASE WHEN length(n) > 80 THEN n[1:79] || '…' ELSE n END AS one
FROM (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS n FROM {DOCS})""")
def f7_truncate(t):
    x = F.col("text")
    return _docs(t).select("doc_id", T.truncated(x, 80).alias("inside"), T.truncated(x, 80, inside=False).alias("added"), T.truncated(x, 80, "…").alias("one"))


@BOOK.query("f8_head_tail", f"SELECT doc_id, CASE WHEN length(text) > 200 THEN text[1:120] || ' ... ' || right(text, 75) ELSE text END AS brief FROM {DOCS}")
def f8_head_tail(t):
    return _docs(t).select("doc_id", T.head_and_tail(F.col("text"), 200, 120).alias("brief"))


@BOOK.query("f9_sentences", f"""
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_sentences, CAST(list_max(list_transform(s, lambda x: length(x))) AS BIGINT) AS longest, s[1] AS first_sentence
FROM (SELECT doc_id, list_filter(list_transform(regexp_extract_all(regexp_replace(regexp_replace(regexp_replace(text, '[ \\t\\r\\f\\v]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g'), '[^。！？!?；;\\n]+[。！？!?；;]?'), lambda x: trim(x)), lambda x: x <> '') AS s FROM {DOCS})""")
def f9_sentences(t):
    s = T.sentences(F.col("text"))
    return _docs(t).withColumn("s", s).select("doc_id", F.size("s").cast("bigint").alias("n_sentences"), F.array_max(F.transform("s", F.length)).cast("bigint").alias("longest"), F.try_element_at("s", F.lit(1)).alias("first_sentence"))


@BOOK.query("f13_sentence_end", f"SELECT doc_id, regexp_matches(trim(text, ' ' || chr(10) || chr(9)), '[。！？；.!?;”’》】）)]$') AS complete FROM {DOCS}")
def f13_sentence_end(t):
    return _docs(t).select("doc_id", T.ends_sentence(F.col("text")).alias("complete"))


@BOOK.query("f14_caption_key", f"SELECT lower(trim(regexp_replace(caption, '\\s+', ' ', 'g'))) AS caption_key, count(*) AS n FROM {CAPTIONS} WHERE caption IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def f14_caption_key(t):
    return _captions(t).where("caption IS NOT NULL").groupBy(T.caption_key(F.col("caption")).alias("caption_key")).agg(F.count("*").alias("n")).where("n > 1")


_LABEL = "(?i)(?:图版|图|圖|figure|fig\\.?|plate|pl\\.|abb\\.|tafel|ill\\.)\\s*[0-9]+[a-z]?(?:[.-][0-9]+)*"


@BOOK.query("f15_figure_labels", f"""
SELECT target_id, CAST(len(l) AS BIGINT) AS n_labels, l[1] AS label FROM
(SELECT target_id, list_transform(regexp_extract_all(caption, '{_LABEL}'), lambda x: lower(regexp_replace(x, '[\\s.]+', '', 'g'))) AS l FROM {CAPTIONS} WHERE caption IS NOT NULL)""")
def f15_figure_labels(t):
    l = T.figure_labels(F.col("caption"))
    return _captions(t).where("caption IS NOT NULL").withColumn("l", l).select("target_id", F.size("l").cast("bigint").alias("n_labels"), F.try_element_at("l", F.lit(1)).alias("label"))


@BOOK.query("f16_titles", f"SELECT target_id, regexp_extract(caption, '《([^》]{{1,40}})》', 1) AS title FROM {CAPTIONS} WHERE caption IS NOT NULL")
def f16_titles(t):
    return _captions(t).where("caption IS NOT NULL").select("target_id", T.title_of(F.col("caption")).alias("title"))


_MARK = "(?i)^(?:〔?\\[?【?图|〔?\\[?【?圖|fig\\.?|figure|plate|pl\\.|abb\\.|tafel|ill\\.)"
_ONLY = "(?i)^(?:图版|图|圖|fig\\.?|figure|plate|pl\\.|abb\\.|tafel|ill\\.)\\s*[0-9]+[a-z]?(?:[.-][0-9]+)*\\s*[.:]?$"


@BOOK.query("f17_caption_predicates", f"SELECT target_id, regexp_matches(regexp_replace(coalesce(caption, ''), '\\s+', '', 'g'), '{_MARK}') AS has_marker, regexp_matches(trim(coalesce(caption, '')), '{_ONLY}') AS number_only FROM {CAPTIONS}")
def f17_caption_predicates(t):
    return _captions(t).select("target_id", T.starts_with_marker(F.col("caption")).alias("has_marker"), T.number_only_caption(F.col("caption")).alias("number_only"))


@BOOK.query("f18_caption_flags", f"""
SELECT target_id, array_to_string(list_sort(list_filter([CASE WHEN trim(c) = '' THEN 'empty' END, CASE WHEN regexp_matches(trim(c), '{_ONLY}') THEN 'number_only' END,
 CASE WHEN length(trim(c)) > 0 AND length(trim(c)) < 12 THEN 'too_short' END, CASE WHEN length(c) > 220 THEN 'too_long' END, CASE WHEN regexp_matches(c, '^[,.;:，。、；：]') THEN 'starts_inside' END,
 CASE WHEN length(c) > 0 AND len(regexp_extract_all(c, '[\\p{{L}}]')) < length(c) * 0.45 THEN 'few_letters' END], lambda x: x IS NOT NULL)), ',') AS flags FROM (SELECT target_id, coalesce(caption, '') AS c FROM {CAPTIONS})""")
def f18_caption_flags(t):
    return _captions(t).select("target_id", F.array_join(T.caption_flags(F.col("caption")), ",").alias("flags"))


@BOOK.query("f25_either_contains", f"""
SELECT target_id, (x <> '' AND y <> '' AND (contains(x, y) OR contains(y, x))) AS matches FROM
(SELECT target_id, lower(regexp_replace(replace(coalesce(caption, ''), '圖', '图'), '[^0-9A-Za-z一-鿿]', '', 'g')) AS x, lower(regexp_replace(replace(coalesce(title, ''), '圖', '图'), '[^0-9A-Za-z一-鿿]', '', 'g')) AS y FROM {CAPTIONS})""")
def f25_either_contains(t):
    return _captions(t).select("target_id", T.either_contains(F.col("caption"), F.col("title")).alias("matches"))


@BOOK.query("f29_char_jaccard", f"""
SELECT target_id, round(CASE WHEN len(x) = 0 OR len(y) = 0 THEN 0.0 ELSE len(list_intersect(x, y)) * 1.0 / len(list_distinct(list_concat(x, y))) END, 6) AS overlap FROM
(SELECT target_id, list_distinct(regexp_extract_all(coalesce(caption, ''), '[一-鿿]')) AS x, list_distinct(regexp_extract_all(coalesce(title, ''), '[一-鿿]')) AS y FROM {CAPTIONS})""")
def f29_char_jaccard(t):
    return _captions(t).select("target_id", F.round(T.char_jaccard(F.col("caption"), F.col("title")), 6).alias("overlap"))


@BOOK.query("f31_safe_name", "SELECT page_id, regexp_replace(coalesce(rel_path, ''), '[^A-Za-z0-9_.一-鿿-]+', '_', 'g')[1:120] AS name FROM (SELECT DISTINCT page_id, rel_path FROM page_specs)")
def f31_safe_name(t):
    return t.page_specs.select("page_id", "rel_path").distinct().select("page_id", T.safe_name(F.col("rel_path")).alias("name"))


@BOOK.query("f32_html_escape", f"SELECT target_id, replace(replace(replace(replace(caption, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') AS html FROM {CAPTIONS}")
def f32_html_escape(t):
    return _captions(t).select("target_id", T.html_escaped(F.col("caption")).alias("html"))


@BOOK.query("f27_matching_ratio")
def f27_matching_ratio(t):
    return _captions(t).select("target_id", F.round(T.matching_ratio(F.col("caption"), F.col("title")), 6).alias("ratio"))


@BOOK.query("f24_nfkc_key")
def f24_nfkc_key(t):
    return _captions(t).select("target_id", T.nfkc_key(F.col("caption")).alias("key"))


@BOOK.query("f79_windows", f"""
WITH d AS (SELECT doc_id, text, length(text) AS n FROM {DOCS} WHERE text IS NOT NULL),
w AS (SELECT doc_id, i, trim(text[i * 400 + 1 : i * 400 + 500]) AS part FROM d, LATERAL (SELECT unnest(generate_series(0, CASE WHEN n <= 500 THEN 0 ELSE CAST(ceil((n - 500) / 400.0) AS BIGINT) END)) AS i))
SELECT doc_id, count(*) AS windows, CAST(sum(length(part)) AS BIGINT) AS characters, max(sha1(part)) AS largest_sha1 FROM w WHERE part <> '' GROUP BY doc_id""")
def f79_windows(t):
    w = _docs(t).where("text IS NOT NULL").select("doc_id", F.explode(T.sliding_windows(F.col("text"), 500, 100)).alias("part"))
    return w.groupBy("doc_id").agg(F.count("*").alias("windows"), F.sum(F.length("part")).alias("characters"), F.max(F.sha1("part")).alias("largest_sha1"))


@BOOK.query("w13_word_ngrams", f"""
WITH w AS (SELECT target_id, regexp_extract_all(lower(caption), '[a-z]+') AS w FROM {CAPTIONS} WHERE caption IS NOT NULL),
g AS (SELECT target_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(generate_series(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) ELSE [] END) AS gram FROM w)
SELECT gram, count(*) AS n, count(DISTINCT target_id) AS targets FROM g GROUP BY gram""")
def w13_word_ngrams(t):
    words = F.regexp_extract_all(F.lower("caption"), F.lit("[a-z]+"), F.lit(0))
    g = _captions(t).where("caption IS NOT NULL").select("target_id", F.explode(T.word_ngrams(words, (3,))).alias("gram"))
    return g.groupBy("gram").agg(F.count("*").alias("n"), F.count_distinct("target_id").alias("targets"))


@BOOK.query("f36_stable_ids", "SELECT pair_id, 'ev_' || sha1(concat_ws('|', source_file, CAST(page AS VARCHAR), candidate_kind, fragment_text))[1:20] AS evidence_key, sha1(coalesce(fragment_text, ''))[1:16] AS text_key FROM (SELECT DISTINCT pair_id, source_file, page, candidate_kind, fragment_text FROM support_candidates)")
def f36_stable_ids(t):
    s = t.support_candidates.select("pair_id", "source_file", "page", "candidate_kind", "fragment_text").distinct()
    return s.select("pair_id", M.stable_id("ev_", F.col("source_file"), F.col("page"), F.col("candidate_kind"), F.col("fragment_text")).alias("evidence_key"), F.substring(F.sha1(F.coalesce("fragment_text", F.lit(""))), 1, 16).alias("text_key"))


_BOXES = "(SELECT DISTINCT candidate_id, page_id, image_bbox AS a, caption_bbox AS c, page_width AS pw, page_height AS ph FROM page_candidates)"
_VALID = "(len({b}) = 4 AND {b}[3] > {b}[1] AND {b}[4] > {b}[2])"
_OV = "(coalesce(" + _VALID.format(b="a") + " AND " + _VALID.format(b="c") + ", false))"
_INTER = f"(CASE WHEN {_OV} AND least(a[3], c[3]) > greatest(a[1], c[1]) AND least(a[4], c[4]) > greatest(a[2], c[2]) THEN CAST(least(a[3], c[3]) - greatest(a[1], c[1]) AS DOUBLE) * (least(a[4], c[4]) - greatest(a[2], c[2])) ELSE 0.0 END)"
_AREA = "(CAST({b}[3] - {b}[1] AS DOUBLE) * ({b}[4] - {b}[2]))"


@BOOK.query("f39_iou", f"""
SELECT candidate_id, round(CASE WHEN {_OV} THEN {_INTER} / ({_AREA.format(b='a')} + {_AREA.format(b='c')} - {_INTER}) ELSE -1.0 END, 6) AS iou,
 round(CASE WHEN {_OV} THEN {_INTER} / least({_AREA.format(b='a')}, {_AREA.format(b='c')}) ELSE 0.0 END, 6) AS of_smaller FROM {_BOXES}""")
def f39_iou(t):
    b = t.page_candidates.select("candidate_id", F.col("image_bbox").alias("a"), F.col("caption_bbox").alias("c")).distinct()
    return b.select("candidate_id", F.round(G.iou(F.col("a"), F.col("c"), -1.0), 6).alias("iou"), F.round(G.overlap_of_smaller(F.col("a"), F.col("c")), 6).alias("of_smaller"))


@BOOK.query("f44_norm1000", """
SELECT candidate_id, CAST(round_even(a[1] * 1000.0 / pw, 0) AS INTEGER) AS x1, CAST(round_even(a[2] * 1000.0 / ph, 0) AS INTEGER) AS y1, CAST(round_even(a[3] * 1000.0 / pw, 0) AS INTEGER) AS x2, CAST(round_even(a[4] * 1000.0 / ph, 0) AS INTEGER) AS y2
FROM (SELECT DISTINCT candidate_id, image_bbox AS a, page_width AS pw, page_height AS ph FROM page_candidates) WHERE len(a) = 4 AND pw > 0 AND ph > 0""")
def f44_norm1000(t):
    b = t.page_candidates.select("candidate_id", "image_bbox", "page_width", "page_height").distinct()
    n = b.select("candidate_id", G.norm1000(F.col("image_bbox"), F.col("page_width"), F.col("page_height")).alias("n")).where("n IS NOT NULL")
    return n.select("candidate_id", *[F.col("n")[i].alias(c) for i, c in enumerate(("x1", "y1", "x2", "y2"))])


@BOOK.query("f48_caption_geometry", f"""
SELECT candidate_id, CASE WHEN c[2] >= a[4] - 8 THEN 'below' WHEN c[4] <= a[2] + 8 THEN 'above' ELSE 'overlap' END AS position,
 CAST(CASE WHEN c[2] >= a[4] - 8 THEN greatest(0, c[2] - a[4]) WHEN c[4] <= a[2] + 8 THEN greatest(0, a[2] - c[4]) ELSE 0 END AS DOUBLE) AS gap,
 round(greatest(0.0, least(a[3], c[3]) - greatest(a[1], c[1])) / greatest(1.0, a[3] - a[1]), 6) AS share FROM {_BOXES} WHERE {_OV}""")
def f48_caption_geometry(t):
    a, c = F.col("a"), F.col("c")
    b = t.page_candidates.select("candidate_id", F.col("image_bbox").alias("a"), F.col("caption_bbox").alias("c")).distinct().where(G.valid(a) & G.valid(c))
    g = G.caption_gap(a, c)
    return b.select("candidate_id", g["position"].alias("position"), g["gap"].cast("double").alias("gap"), F.round(G.horizontal_share(a, c), 6).alias("share"))


@BOOK.query("f46_union_boxes", "SELECT page_id, min(a[1]) AS x1, min(a[2]) AS y1, max(a[3]) AS x2, max(a[4]) AS y2, count(*) AS regions FROM " + _BOXES + " WHERE coalesce(" + _VALID.format(b="a") + ", false) GROUP BY page_id")
def f46_union_boxes(t):
    a = F.col("image_bbox")
    b = t.page_candidates.select("candidate_id", "page_id", "image_bbox", "caption_bbox", "page_width", "page_height").distinct().where(G.valid(a))
    return b.groupBy("page_id").agg(F.min(a[0]).alias("x1"), F.min(a[1]).alias("y1"), F.max(a[2]).alias("x2"), F.max(a[3]).alias("y2"), F.count("*").alias("regions"))


@BOOK.query("f51_confidence_buckets", "SELECT CASE WHEN rule_confidence IS NULL THEN 'none' WHEN rule_confidence >= 0.9 THEN '0.90-1.00' WHEN rule_confidence >= 0.75 THEN '0.75-0.89' WHEN rule_confidence >= 0.5 THEN '0.50-0.74' ELSE '0.00-0.49' END AS bucket, field, count(DISTINCT pair_id) AS pairs FROM support_candidates GROUP BY 1, 2")
def f51_confidence_buckets(t):
    return t.support_candidates.groupBy(M.confidence_bucket(F.col("rule_confidence")).alias("bucket"), "field").agg(F.count_distinct("pair_id").alias("pairs"))


@BOOK.query("f78_durations", "SELECT target_id, round(date_diff('second', recorded_at, ingested_at) / 60.0, 2) AS minutes, strftime(recorded_at, '%Y%m%d_%H%M%S') AS tag FROM (SELECT DISTINCT target_id, recorded_at, ingested_at FROM figure_targets)")
def f78_durations(t):
    s = t.figure_targets.select("target_id", "recorded_at", "ingested_at").distinct()
    return s.select("target_id", F.round(F.timestamp_diff("SECOND", F.col("recorded_at"), F.col("ingested_at")) / 60.0, 2).alias("minutes"), F.date_format("recorded_at", "yyyyMMdd_HHmmss").alias("tag"))


@BOOK.query("f49_page_distance", """
SELECT pair_id, CAST(CASE WHEN p.page IS NULL OR f.page_num IS NULL THEN NULL ELSE abs(p.page - f.page_num) END AS INTEGER) AS distance
FROM (SELECT DISTINCT pair_id, task_id, page FROM support_candidates) p JOIN (SELECT target_id, min(page_num) AS page_num FROM figure_targets GROUP BY target_id) f ON p.task_id = f.target_id""")
def f49_page_distance(t):
    p = t.support_candidates.select("pair_id", "task_id", "page").distinct()
    f = t.figure_targets.groupBy("target_id").agg(F.min("page_num").alias("page_num"))
    return p.join(f, p.task_id == f.target_id).select("pair_id", G.page_distance(F.col("page"), F.col("page_num"), F.lit(None).cast("int")).alias("distance"))
