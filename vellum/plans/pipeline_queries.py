"""Queries of sampling, boxes, retrieval, chunking, parsing and event streams, with their SQL where it can say them."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.functions import lenient_json as J
from vellum.operators import boxes, chunking, retrieval, sampling
from vellum.plans.book import Book
from vellum.plans.relational_queries import FIG, PAGE, SUP, _fig, _page, _sup
from vellum.sources import files
from vellum.streaming import events as E

BOOK = Book()
queries, oracle_sql = (lambda: BOOK.calls), (lambda: BOOK.sql)

_MD5 = "md5(concat_ws('|', {k}, '7'))"


@BOOK.query("sample_ratio_split", f"""
WITH r AS (SELECT target_id, trajectory_type, row_number() OVER (PARTITION BY trajectory_type ORDER BY {_MD5.format(k='target_id')}, target_id) AS r, count(*) OVER (PARTITION BY trajectory_type) AS n FROM {FIG}),
b AS (SELECT *, greatest(CASE WHEN n >= 10 THEN 1 ELSE 0 END, CAST(round_even(n * 0.10, 0) AS INTEGER)) AS v, greatest(CASE WHEN n >= 10 THEN 1 ELSE 0 END, CAST(round_even(n * 0.15, 0) AS INTEGER)) AS e FROM r)
SELECT target_id, trajectory_type, CASE WHEN r <= n - v - e THEN 'train' WHEN r <= n - e THEN 'val' ELSE 'test' END AS new_split FROM b""")
def sample_ratio_split(t):
    return sampling.ratio_split(_fig(t).select("target_id", "trajectory_type"), "trajectory_type", "target_id")


@BOOK.query("sample_evaluation_documents", f"""
WITH d AS (SELECT source_file, count(*) AS n, least(count(*), 8) AS capped, greatest(0, count(*) - 8) AS waste FROM {FIG} GROUP BY 1),
a AS (SELECT *, coalesce(sum(capped) OVER (ORDER BY waste, capped, source_file ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM d),
r AS (SELECT source_file, n, capped, waste, coalesce(sum(capped) OVER (ORDER BY waste, capped, source_file ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM a WHERE b >= 60)
SELECT source_file, n, 'val' AS split FROM a WHERE b < 60 UNION ALL SELECT source_file, n, CASE WHEN b < 90 THEN 'test' ELSE 'train' END FROM r""")
def sample_evaluation_documents(t):
    return sampling.evaluation_documents(_fig(t), "source_file", [("val", 60), ("test", 90)], 8)


@BOOK.query("sample_round_robin", f"SELECT page_id, turn FROM (SELECT page_id, doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC NULLS LAST, page_num, page_id) AS turn FROM {PAGE} WHERE doc_id IS NOT NULL) WHERE turn <= 6 ORDER BY turn, doc_id LIMIT 100")
def sample_round_robin(t):
    r = sampling.round_robin(_page(t).where("doc_id IS NOT NULL"), "doc_id", [F.desc_nulls_last("score"), F.col("page_num"), F.col("page_id")], 6, 100)
    return r.select("page_id", F.col("turn").cast("bigint").alias("turn"))


@BOOK.query("sample_quota_fill", f"""
SELECT pair_id, by_quota FROM (SELECT pair_id, {_MD5.format(k='pair_id')} AS d, row_number() OVER (PARTITION BY field ORDER BY {_MD5.format(k='pair_id')}, pair_id) <= 20 AS by_quota FROM {SUP}) ORDER BY by_quota DESC, d, pair_id LIMIT 300""")
def sample_quota_fill(t):
    return sampling.quota_then_fill(_sup(t).select("pair_id", "field"), "field", "pair_id", 20, 300).select("pair_id", "by_quota")


@BOOK.query("sample_balanced", f"SELECT pair_id, turn FROM (SELECT pair_id, candidate_kind, row_number() OVER (PARTITION BY candidate_kind ORDER BY {_MD5.format(k='pair_id')}, pair_id) AS turn FROM {SUP}) ORDER BY turn, candidate_kind LIMIT 200")
def sample_balanced(t):
    return sampling.balanced(_sup(t).select("pair_id", "candidate_kind"), "candidate_kind", "pair_id", 200).select("pair_id", F.col("turn").cast("bigint").alias("turn"))


@BOOK.query("sample_strided_pages", f"SELECT page_id FROM {PAGE} WHERE page_num < 20 OR (page_num - 20) % 5 = 0")
def sample_strided_pages(t):
    return _page(t).where(sampling.strided(F.col("page_num"), 20, 5)).select("page_id")


@BOOK.query("c18_nearest_caption", """
WITH b AS (SELECT DISTINCT candidate_id, page_id, image_bbox AS a, caption_bbox AS c FROM page_candidates),
j AS (SELECT f.page_id, f.candidate_id AS figure_id, k.candidate_id AS caption_id, round(CAST(CASE WHEN k.c[2] >= f.a[4] - 8 THEN greatest(0, k.c[2] - f.a[4]) WHEN k.c[4] <= f.a[2] + 8 THEN greatest(0, f.a[2] - k.c[4]) ELSE 0 END AS DOUBLE)
 + 0.25 * abs((f.a[1] + f.a[3]) / 2.0 - (k.c[1] + k.c[3]) / 2.0) - 0.5 * greatest(0, least(f.a[3], k.c[3]) - greatest(f.a[1], k.c[1])), 6) AS cost
 FROM b f JOIN b k ON f.page_id = k.page_id WHERE len(f.a) = 4 AND f.a[3] > f.a[1] AND f.a[4] > f.a[2] AND len(k.c) = 4 AND k.c[3] > k.c[1] AND k.c[4] > k.c[2])
SELECT page_id, figure_id, arg_min(caption_id, struct_pack(x := cost, y := caption_id)) AS caption_id, min(cost) AS cost FROM j GROUP BY 1, 2""")
def c18_nearest_caption(t):
    b = t.page_candidates
    return boxes.nearest_caption(b.withColumnRenamed("candidate_id", "figure_id"), b.withColumnRenamed("candidate_id", "caption_id"), "page_id", "figure_id", "caption_id", "image_bbox", "caption_bbox")


_QUERIES = "(SELECT item_id AS query_id, item_text AS query_text, 'ridge_and_water_digest' AS source, CAST(item_id % 300 AS INTEGER) AS page FROM eval_items WHERE item_id % 20 = 0 UNION ALL SELECT 0, '...', 'ridge_and_water_digest', 12)"


def _asked(t):
    # The stated query set, and one query without a token, which is asked by its source's name.
    q = t.eval_items.where("item_id % 20 = 0").select(F.col("item_id").alias("query_id"), F.col("item_text").alias("query_text"), F.lit("ridge_and_water_digest").alias("source"), (F.col("item_id") % 300).cast("int").alias("page"))
    return q.unionByName(q.sparkSession.createDataFrame([(0, "...", "ridge_and_water_digest", 12)], "query_id long, query_text string, source string, page int"))


_TOKENS = "list_concat(regexp_extract_all(lower({c}), '[a-z0-9_]+'), regexp_extract_all(lower({c}), '[一-鿿]'))"
_NOISY = "CASE WHEN authority_level = 'C' THEN 0.5 WHEN authority_level IS NULL THEN 0.98 ELSE 0.0 END"
_HITS_SQL = f"""
WITH ds AS (SELECT doc_id, min(source) AS source, min(text) AS text, min({_NOISY}) AS noise, min(TRY_CAST(page_start AS INTEGER)) AS page_start, min(evidence_type) AS kind FROM documents WHERE text IS NOT NULL GROUP BY 1),
dc AS (SELECT doc_id, token, count(*) AS nd FROM (SELECT doc_id, unnest({_TOKENS.format(c='text')}) AS token FROM ds) GROUP BY 1, 2), dn AS (SELECT doc_id, greatest(1.0, sqrt(sum(nd * nd))) AS norm FROM dc GROUP BY 1),
qs AS (SELECT *, CASE WHEN len({_TOKENS.format(c='query_text')}) > 0 THEN query_text ELSE source END AS x FROM {_QUERIES}), qc AS (SELECT query_id, token, count(*) AS nq FROM (SELECT query_id, unnest({_TOKENS.format(c='x')}) AS token FROM qs) GROUP BY 1, 2),
h AS (SELECT query_id, doc_id, sum(least(nq, nd)) AS overlap FROM qc JOIN dc USING (token) GROUP BY 1, 2),
s AS (SELECT q.query_id, d.doc_id, q.page, d.page_start, d.text, d.kind, q.x, q.source = d.source AS same, (coalesce(h.overlap, 0) / n.norm + CASE WHEN q.source = d.source THEN 0.2 ELSE 0.0 END) * CASE WHEN d.noise > 0 THEN greatest(0.0, 1 - least(0.95, d.noise)) ELSE 1.0 END AS score
 FROM qs q CROSS JOIN ds d JOIN dn n USING (doc_id) LEFT JOIN h ON h.query_id = q.query_id AND h.doc_id = d.doc_id WHERE h.doc_id IS NOT NULL OR q.source = d.source)"""
_TOP = "r AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM {s} WHERE score > 0) SELECT query_id, doc_id, score, rank FROM r WHERE rank <= 10"


def _searched(t):
    noise_score = F.when(F.col("authority_level") == "C", 0.5).when(F.col("authority_level").isNull(), 0.98).otherwise(0.0)
    page = F.col("page_start").try_cast("int")
    d = t.documents.where("text IS NOT NULL").groupBy("doc_id").agg(F.min("source").alias("source"), F.min("text").alias("text"), F.min(noise_score).alias("noise_score"), F.min(page).alias("page_start"), F.min("evidence_type").alias("clean_type"))
    return d.withColumn("page_end", F.col("page_start"))


@BOOK.query("c15_retrieval", _HITS_SQL + ", z AS (SELECT query_id, doc_id, round(score, 6) AS score FROM s), " + _TOP.format(s="z"))
def c15_retrieval(t):
    return retrieval.search(_asked(t), _searched(t), k=10)


@BOOK.query("c15_nearby_pages", _HITS_SQL + ", z AS (SELECT query_id, doc_id, round(score, 6) AS score FROM s WHERE same AND (page_start IS NULL OR abs(page_start - page) <= 1)), " + _TOP.format(s="z"))
def c15_nearby_pages(t):
    return retrieval.search(_asked(t), _searched(t), k=10, scope="nearby_pages")


_BARE = "lower(regexp_replace({c}, '\\s+', '', 'g'))"
_WORDS_OF = "list_distinct(regexp_extract_all(x, '[A-Za-z]{{{a},{b}}}'))"
_FOUND = "len(list_filter(list_distinct(regexp_extract_all(x, '{p}')), lambda w: contains({t}, lower(w))))"


@BOOK.query("c15_anchored", _HITS_SQL + f"""
, b AS (SELECT *, {_BARE.format(c='text')} AS bare, CASE WHEN same AND page_start IS NOT NULL THEN abs(page_start - page) END AS away FROM s), m AS (SELECT *, {_FOUND.format(p='[0-9]{3}', t='bare')} AS nl, {_FOUND.format(p='[A-Za-z]{9,}', t='bare')} AS nt, {_FOUND.format(p='[A-Z][a-z]{4,5}', t='bare')} AS ne FROM b),
z AS (SELECT query_id, doc_id, round(score + CASE WHEN away IS NULL THEN 0.0 WHEN nl + nt + ne > 0 THEN CASE WHEN away = 0 THEN 0.08 WHEN away = 1 THEN 0.05 WHEN away <= 3 THEN 0.02 ELSE 0.0 END WHEN away = 0 THEN 0.015 WHEN away = 1 THEN 0.01 ELSE 0.0 END
 + CASE WHEN nl > 0 THEN least(0.30, 0.18 + 0.04 * (nl - 1)) ELSE 0.0 END + least(0.16, 0.04 * nt) + least(0.09, 0.03 * ne) + CASE WHEN kind = 'figure_reference_text' THEN 0.02 ELSE 0.0 END, 6) AS score FROM m), """ + _TOP.format(s="z"))
def c15_anchored(t):
    words = lambda p: F.array_distinct(F.regexp_extract_all("query_text", F.lit(p), F.lit(0)))
    q = _asked(t).withColumn("query_text", F.when(F.col("query_id") == 0, F.col("source")).otherwise(F.col("query_text")))
    q = q.withColumn("labels", words("[0-9]{3}")).withColumn("terms", words("[A-Za-z]{9,}")).withColumn("entities", words("[A-Z][a-z]{4,5}"))
    return retrieval.search(q, _searched(t), k=10, bonus=True)


_TIDY = "regexp_replace(regexp_replace(regexp_replace(replace({x}, chr(0), ' '), '[ \\t\\r\\f\\v]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g')"
_UNITS = f"""
p AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array({_TIDY.format(x='text')}, '\\n{{2,}}'), lambda x: {_TIDY.format(x='x')}), lambda x: x <> '') AS ps FROM (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL)),
q AS (SELECT doc_id, flatten(list_transform(ps, lambda x: CASE WHEN length(x) <= 1200 THEN [x] ELSE list_filter(list_transform(string_split(x, chr(10)), lambda y: {_TIDY.format(x='y')}), lambda y: y <> '') END)) AS ps FROM p),
s AS (SELECT doc_id, flatten(list_transform(ps, lambda x: list_filter(list_transform(regexp_extract_all(x, '[^。！？!?；;\n]+[。！？!?；;]?'), lambda y: {_TIDY.format(x='y')}), lambda y: y <> ''))) AS ss FROM q),
u AS (SELECT doc_id, flatten(list_transform(ss, lambda x: CASE WHEN length(x) <= 900 THEN [x] ELSE list_filter(list_transform(regexp_extract_all(x, '(?s).{{405,899}}[，,、 ]|.{{1,900}}'), lambda y: {_TIDY.format(x='y')}), lambda y: y <> '') END)) AS us FROM s)"""


@BOOK.query("w14_chunks", f"""
WITH RECURSIVE {_UNITS}, l AS (SELECT doc_id, list_transform(us, lambda x: length(x)) AS n, us FROM u WHERE len(us) > 0),
w(doc_id, i, first, total, a, b) AS (SELECT doc_id, CAST(1 AS BIGINT), CAST(1 AS BIGINT), CAST(n[1] AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT) FROM l
 UNION ALL SELECT doc_id, i + 1, CASE WHEN grown <= 900 THEN first WHEN seed + 1 + x > 900 THEN i + 1 WHEN two THEN i - 1 ELSE i END, CASE WHEN grown <= 900 THEN grown WHEN seed + 1 + x > 900 THEN x ELSE seed + 1 + x END, CASE WHEN grown > 900 THEN first END, CASE WHEN grown > 900 THEN i END
 FROM (SELECT w.doc_id, w.i, w.first, l.n[w.i + 1] AS x, w.total + 1 + l.n[w.i + 1] AS grown, w.i > w.first AND l.n[w.i] + coalesce(l.n[w.i - 1], 0) <= 160 AS two, CASE WHEN w.i > w.first AND l.n[w.i] + coalesce(l.n[w.i - 1], 0) <= 160 THEN l.n[w.i] + l.n[w.i - 1] + 1 ELSE l.n[w.i] END AS seed FROM w JOIN l ON l.doc_id = w.doc_id WHERE w.i < len(l.n))),
c AS (SELECT doc_id, a, b FROM w WHERE a IS NOT NULL UNION ALL SELECT doc_id, arg_max(first, i), max(i) FROM w GROUP BY doc_id)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY a) - 1 AS chunk_no, array_to_string(us[a:b], chr(10)) AS chunk FROM c JOIN l USING (doc_id)""")
def w14_chunks(t):
    # Two different texts of one key are two documents; the data has none.
    return chunking.chunked(t.documents.select("doc_id", "text").distinct(), "doc_id", "text").withColumn("chunk_no", F.col("chunk_no").cast("bigint"))


_EXPORTS = "(SELECT DISTINCT feed, file_name, line_no, payload FROM target_exports)"
def _sorted_keys(j: str, value, name: str) -> str:
    """SQL: the object ``j`` with sorted keys, each value by ``value``."""
    at = f"json_extract({j}, '$.\"' || {name} || '\"')"
    return f"'{{' || array_to_string(list_transform(list_sort(json_keys({j})), lambda {name}: '\"' || {name} || '\":' || {value(at)}), ',') || '}}'"


def _canon(p: str) -> str:
    """SQL: an object in canonical form, objects inside it, too."""
    inner = lambda j: f"CASE WHEN json_type({j}) = 'OBJECT' THEN {_sorted_keys(j, lambda k: f'CAST({k} AS VARCHAR)', 'y')} ELSE CAST({j} AS VARCHAR) END"
    return _sorted_keys(p, inner, "x")


def _exports(t):
    return t.target_exports.select("feed", "file_name", "line_no", "payload").distinct()


@BOOK.query("f61_lenient_json", f"SELECT feed, file_name, line_no, 'lenient' AS mode, {_canon('payload')} AS objects FROM {_EXPORTS}")
def f61_lenient_json(t):
    text = F.concat(F.lit("notes: "), F.col("payload"), F.lit(" and then "), F.col("payload"), F.lit(" end"))
    return _exports(t).withColumn("p", J.parse_objects(text)).select("feed", "file_name", "line_no", F.col("p.mode").alias("mode"), F.array_join("p.objects", "\n").alias("objects"))


@BOOK.query("f62_first_object", f"SELECT feed, file_name, line_no, {_canon('payload')} AS object FROM {_EXPORTS}")
def f62_first_object(t):
    # The closing bracket and all behind it are missing.
    cut_off = F.expr("concat('see: ', substring(payload, 1, length(payload) - 1))")
    return _exports(t).select("feed", "file_name", "line_no", J.first_object(cut_off).alias("object"))


@BOOK.query("f68_canonical_json", f"SELECT feed, file_name, line_no, {_canon('payload')} AS canonical FROM {_EXPORTS}")
def f68_canonical_json(t):
    return _exports(t).select("feed", "file_name", "line_no", J.canonical_json("payload").alias("canonical"))


@BOOK.query("s3_canonical_dedup", f"SELECT {_canon('payload')} AS canonical, count(*) AS copies, min(file_name) AS first_file FROM {_EXPORTS} GROUP BY 1")
def s3_canonical_dedup(t):
    return _exports(t).groupBy(J.canonical_json("payload").alias("canonical")).agg(F.count("*").alias("copies"), F.min("file_name").alias("first_file"))


@BOOK.query("a5_embedded_keys", "SELECT feed, file_name, line_no, json_extract_string(payload, '$.target_id') AS target_id, json_extract_string(payload, '$.page_num') AS page_num FROM (SELECT DISTINCT feed, file_name, line_no, payload FROM target_exports)")
def a5_embedded_keys(t):
    rows = t.target_exports.select("feed", "file_name", "line_no", "payload").distinct()
    return rows.select("feed", "file_name", "line_no", F.get_json_object("payload", "$.target_id").alias("target_id"), F.get_json_object("payload", "$.page_num").alias("page_num"))


@BOOK.query("a11_first_document_wins", """
WITH r AS (SELECT json_extract_string(payload, '$.target_id') AS target_id, file_name, row_number() OVER (PARTITION BY json_extract_string(payload, '$.target_id') ORDER BY file_name, line_no) AS rn, count(*) OVER (PARTITION BY json_extract_string(payload, '$.target_id')) AS copies
FROM (SELECT DISTINCT feed, file_name, line_no, payload FROM target_exports)) SELECT target_id, file_name, copies FROM r WHERE rn = 1""")
def a11_first_document_wins(t):
    rows = t.target_exports.select("feed", "file_name", "line_no", "payload").distinct().withColumn("target_id", F.get_json_object("payload", "$.target_id"))
    return files.first_wins(rows, ["target_id"], ["file_name", "line_no"]).select("target_id", "file_name", "copies")


@BOOK.query("a20_log_metrics", """
SELECT event_id AS step, max(value) AS reward, max(CAST(json_extract(props, '$.k') AS BIGINT)) AS k FROM events GROUP BY event_id""")
def a20_log_metrics(t):
    line = F.concat(F.lit("\x1b[32mINFO\x1b[0m step:"), F.col("event_id").cast("string"), F.lit(" - reward:"), F.col("value").cast("string"), F.lit(" - k:"), F.get_json_object("props", "$.k"))
    lines = t.events.select(line.alias("line"), F.col("event_id").alias("at"))
    m = files.log_metrics(lines, "line", "at", "step")
    return m.select("step", F.col("metrics")["reward"].alias("reward"), F.col("metrics")["k"].cast("bigint").alias("k"))


@BOOK.query("k_event_windows", """
SELECT time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '2000-01-01') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def k_event_windows(t):
    return E.windowed(t.events, "ts", "1 hour", ["event_type"], "value")


@BOOK.query("k_sessions", """
WITH b AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM b)
SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, sid""")
def k_sessions(t):
    return E.sessions(t.events, "ts", "30 minutes", "user_id")


@BOOK.query("k12_latest_per_key", "SELECT user_id, arg_max(event_type, struct_pack(a := ts, b := event_id)) AS event_type, max(ts) AS ts FROM events GROUP BY user_id")
def k12_latest_per_key(t):
    return E.latest(t.events, "user_id", ["ts", "event_id"], ["event_type", "ts"]).select("user_id", "event_type", "ts")


@BOOK.query("k1_replayed_states", """
SELECT user_id, count(*) AS steps, count(*) FILTER (WHERE event_type = 'error') AS errors, round(sum(value), 4) AS total, arg_max(event_type, struct_pack(a := ts, b := event_id)) AS last_event FROM events GROUP BY user_id""")
def k1_replayed_states(t):
    return E.replayed(t.events)


@BOOK.query("d_region_rollup", """
SELECT r_name, n_name, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name, n_name""")
def d_region_rollup(t):
    j = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy("r_name", "n_name").agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@BOOK.query("d_line_summary", """
SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS quantity, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS discount, count(*) AS lines FROM lineitem GROUP BY 1, 2""")
def d_line_summary(t):
    return t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("quantity"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("discount"), F.count("*").alias("lines"))
