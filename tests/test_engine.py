"""Operators, functions, sources and streams of the core, on fixtures; every registered query runs."""

import decimal
import importlib
import json
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from vellum.functions import geometry, lenient_json, measures
from vellum.functions import text as T
from vellum.operators import boxes, chunking, relational, retrieval, sampling
from tests.hostile import empty_copy
from vellum.plans import derived_queries, evaluation_queries, matching_queries, pipeline_queries, relational_queries, sampling_queries, scalar_queries, sequence_queries
from vellum.sources import files
from vellum.streaming import events


def one(spark, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}")


@pytest.mark.parametrize(("f", "x", "want"), [
    (T.compact, " A b\nC ", "abc"), (T.clean_text, "a \t b\n\n\n\nc ", "a b\n\nc"), (T.title_of, "见《溪山》图", "溪山"), (T.html_escaped, 'a<b>"&', "a&lt;b&gt;&quot;&amp;"),
    (lambda c: T.truncated(c, 8), "abcdefghij", "abcde..."), (lambda c: T.head_and_tail(c, 12, 4), "abcdefghijklmnop", "abcd ... nop"), (T.compact, None, None),
    (T.ends_sentence, "Done.", True), (T.ends_sentence, "Done", False), (T.number_only_caption, "Fig. 3", True), (T.number_only_caption, "Fig. 3 a tree", False), (T.safe_name, "a b/c?.pdf", "a_b_c_.pdf"),
    (lambda c: T.around(c, "fox", 2), "the quick fox runs", "k fox r"),
])
def test_text(spark, f, x, want):
    assert one(spark, x).select(f(F.col("x")).alias("y")).first()["y"] == want


def test_text_arrays(spark):
    r = one(spark, "Ink 山水 a b").select(T.tokens(F.col("x")).alias("a"), T.word_and_bigram_tokens(F.col("x")).alias("b"), T.sentences(F.lit("甲。乙！ c? d")).alias("c"), T.sliding_windows(F.lit("abcdefghij"), 4, 2).alias("d")).first()
    assert r["a"] == ["ink", "a", "b", "山", "水"] and r["b"] == ["ink", "a", "b", "山水"] and r["c"] == ["甲。", "乙！", "c?", "d"] and r["d"] == ["abcd", "cdef", "efgh", "ghij"]


def test_geometry(spark):
    df = spark.createDataFrame([([0, 0, 10, 10], [5, 0, 15, 10]), ([0, 0, 0, 5], [0, 0, 2, 2]), (None, [0, 0, 1, 1])], "a array<int>, b array<int>")
    got = [round(r[0], 4) for r in df.select(geometry.iou(F.col("a"), F.col("b"), -1.0)).collect()]
    assert got == [0.3333, -1.0, -1.0]
    assert df.select(geometry.norm1000(F.col("a"), F.lit(20), F.lit(40)).alias("n")).first()["n"] == [0, 0, 500, 250]


def test_set_scores(spark):
    df = spark.createDataFrame([(["a", "b"], ["b"]), ([], [])], "p array<string>, g array<string>")
    zero = [tuple(r[0]) for r in df.select(measures.set_scores(F.col("p"), F.col("g"))).collect()]
    ones = [tuple(r[0]) for r in df.select(measures.set_scores(F.col("p"), F.col("g"), True)).collect()]
    assert zero[0][:2] == (0.5, 1.0) and zero[1] == (0, 0, 0) and ones[1] == (1, 1, 1)


def test_lenient_json():
    assert lenient_json.parsed('[{"a": 1}]') == ("strict", [{"a": 1}])
    assert lenient_json.parsed('{"a": 1}\n{"a": 2},') == ("lines", [{"a": 1}, {"a": 2}])
    assert lenient_json.parsed('say {"a": 1} and {"a": 1} then {"a": 2}') == ("lenient", [{"a": 1}, {"a": 2}])
    assert lenient_json.parsed("nothing") == ("none", []) == lenient_json.parsed(None)
    assert lenient_json.parsed('see [1 {"a": "}"} "and so on') == ("lenient", [{"a": "}"}])
    assert lenient_json.objects_in('{bad {"c": 1} [{"d": 2}, 3]') == [{"c": 1}, {"d": 2}]
    assert json.loads(lenient_json.mended('{"a": [1, 2, {"b": "x')) == {"a": [1, 2, {"b": "x"}]}


def test_chunks_cover_and_bound(spark):
    long_text = "\n\n".join("Sentence number %d is here; and so on. " % i * 9 for i in range(12)) + "x" * 2500
    df = spark.createDataFrame([(1, long_text), (2, "  "), (3, None), (4, "one"), (5, "a b, " * 900), (6, "short; " * 300)], "k int, x string")
    units = {r["k"]: r["u"] for r in df.select("k", chunking.units(F.col("x")).alias("u")).collect()}
    chunks: dict = {}
    for r in chunking.chunked(df, "k", "x").orderBy("k", "chunk_no").collect():
        chunks.setdefault(r["k"], []).append(r["chunk"])
    assert set(chunks) == {1, 4, 5, 6} and chunks[4] == ["one"]
    for k, parts in chunks.items():
        assert all(len(c) <= chunking.CHUNK_CHARS for c in parts) and all(any(u in c for c in parts) for u in units[k])
    # Every chunk starts with the end of the one before where that is short enough.
    assert all(b.startswith("short;\nshort;") and a.endswith("short;\nshort;") for a, b in zip(chunks[6], chunks[6][1:]))


def test_joins(spark):
    left = spark.createDataFrame([(1, "x", "p"), (2, None, "q"), (3, "z", None)], "id int, a string, b string")
    right = spark.createDataFrame([("x", "m", 10), ("n", "q", 20)], "k string, l string, v int")
    got = {r["id"]: (r["v"], r["matched_by"]) for r in relational.alternate_key_join(left, right, [("a", "k"), ("b", "l")], ["v"]).collect()}
    assert got == {1: (10, "a"), 2: (20, "b"), 3: (None, None)}
    o = relational.override_join(left, spark.createDataFrame([(2, "new")], "id int, a string"), "id", ["a"])
    assert {r["id"]: (r["a"], r["overlaid"]) for r in o.collect()} == {1: ("x", False), 2: ("new", True), 3: ("z", False)}


def test_salted_top_k_equals_plain(spark):
    df = spark.range(2000).select((F.col("id") % 3).alias("g"), (F.col("id") * 7919 % 101).alias("v"), "id")
    order = [F.desc("v"), F.col("id")]
    plain = {tuple(r) for r in relational.top_per_group(df, ["g"], order, 5).collect()}
    assert plain == {tuple(r) for r in relational.top_per_group_salted(df, ["g"], order, 5).collect()}


def test_prefix_sums_and_ranks(spark):
    df = spark.range(500).select("id", (F.col("id") % 7 + 1).alias("v"))
    got = {r["id"]: r["before"] for r in sampling.prefix_sums(df, ["id"], "v", parts=9).collect()}
    total = 0
    for i in range(500):
        assert got[i] == total
        total += i % 7 + 1
    ranks = sorted(r["rank"] for r in sampling.shuffled_rank(df.withColumn("g", F.lit(None).cast("string")), ["g"], "id").collect())
    assert ranks == list(range(1, 501))
    assert sampling.replay_size(30, 0.25, 1000) == 10


def test_suppression_keeps_best(spark):
    df = spark.createDataFrame([("p", "a", [0, 0, 100, 100], 1.0), ("p", "b", [1, 1, 100, 100], 2.0), ("p", "c", [200, 0, 300, 100], None), ("p", "d", [5, 5, 5, 9], 9.0)], "page string, k string, box array<int>, s double")
    assert {r["k"] for r in boxes.suppress_overlaps(df, "page", "k", "box", "s").collect()} == {"b", "c"}


def test_anchors_are_searched_once_a_text(spark):
    """Pairs of query and document carry no text: anchors are found before the join, and equal the search of every pair."""
    docs = spark.createDataFrame([(1, "ink on Silk Road 215", "a", 0.0, 4, 4, "x"), (2, "ink roadside", "b", 0.0, None, None, "figure_reference_text"), (3, None, "a", 0.0, 1, 1, "x")], "doc_id int, text string, source string, noise_score double, page_start int, page_end int, clean_type string")
    asks = spark.createDataFrame([(9, "ink", "a", 4, ["215", "999"], ["silk ROAD", "roadside", "ink"], ["Silk", None]), (8, "ink", "c", None, None, None, None)], "query_id int, query_text string, source string, page int, labels array<string>, terms array<string>, entities array<string>")
    out = retrieval.search(asks, docs, bonus=True)
    assert {(r["query_id"], r["doc_id"]): r["score"] for r in out.collect()} == {(9, 1): 0.977214, (9, 2): 0.767107, (8, 1): 0.447214, (8, 2): 0.727107}
    assert "_words" not in out.columns and "_found" in retrieval.with_found_anchors(docs, asks).columns
    found = {r["doc_id"]: r["_found"] for r in retrieval.with_found_anchors(docs, asks).collect()}
    assert {k: sorted(v) for k, v in found.items()} == {1: ["215", "ink", "silk", "silkroad"], 2: ["ink", "roadside"], 3: []}


def test_search_against_brute_force(spark):
    docs = [(1, "red fox fox", "a", 0.0), (2, "red dog", "b", 0.5), (3, "", "a", 0.0), (4, None, "a", 0.0)]
    got = retrieval.search(spark.createDataFrame([(9, "red fox", "a")], "query_id int, query_text string, source string"), spark.createDataFrame(docs, "doc_id int, text string, source string, noise_score double")).collect()
    assert [(r["doc_id"], r["score"]) for r in got] == [(1, round(2 / 5 ** 0.5 + 0.2, 6)), (2, round(1 / 2 ** 0.5 * 0.5, 6))]


def test_sources(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"x": 1}\n\n{"x": 2}\nbad\n')
    assert files.read_jsonl(spark, str(tmp_path / "a.jsonl"), "x int", "drop").count() == 2
    with pytest.raises(Exception):
        files.read_jsonl(spark, str(tmp_path / "a.jsonl"), "x int", "fail").collect()
    assert files.read_jsonl(spark, str(tmp_path / "none.jsonl"), "x int", missing_ok=True).count() == 0
    assert files.tail(spark, str(tmp_path / "a.jsonl")) == "bad"
    df = spark.createDataFrame([(1, "train"), (2, "val")], "x int, split string")
    files.write_splits(df, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).where("split = 'val'").count() == 1
    files.write_csv(df, str(tmp_path / "c"), ["split", "gone"])
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).columns == ["split", "gone"]
    files.write_jsonl(df, str(tmp_path / "j"))
    files.write_jsonl(df.limit(0), str(tmp_path / "j"), append=True)
    files.write_jsonl(df, str(tmp_path / "j"), append=True)
    assert spark.read.json(str(tmp_path / "j")).count() == 4
    assert files.markdown_table(df.orderBy("x")).splitlines()[2] == "| 1 | train |"
    (tmp_path / "v1").mkdir()
    files.point_latest(str(tmp_path), "v1")
    assert (tmp_path / "latest").resolve().name == "v1"
    logs = spark.createDataFrame([("\x1b[1mstep:1\x1b[0m - a:2.5", 1), ("step:1 - a:3e1", 2), ("noise", 3)], "l string, n int")
    assert [(r["step"], r["metrics"]["a"]) for r in files.log_metrics(logs, "l", "n", "step").collect()] == [(1, 30.0)]


def test_streams(spark, data, tmp_path):
    src = spark.read.parquet(f"{data}/events.parquet")
    src.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))
    q = events.windowed(stream, "ts", "1 hour", ["event_type"], "value", "1 hour").writeStream.outputMode("complete").format("memory").queryName("hours").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("hours").agg(F.sum("n")).first()[0] == src.count()
    q = events.episodes(stream).writeStream.outputMode("update").format("memory").queryName("episodes").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("episodes").groupBy("user_id").agg(F.max("steps").alias("s")).agg(F.sum("s")).first()[0] == src.count()
    seen = []
    q = events.monitor(events.resumable(stream, ["user_id"]), lambda b, i: seen.append(b.count()), "1 second", str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    assert sum(seen) == src.select("user_id").distinct().count()


CORE = {n: (call, module.oracle_sql().get(n)) for module in (scalar_queries, relational_queries, pipeline_queries, evaluation_queries, matching_queries, sampling_queries, sequence_queries, derived_queries) for n, call in module.queries().items()}


def _plain(x):
    if isinstance(x, (float, decimal.Decimal)):
        return f"{float(x):.6f}".rstrip("0").rstrip(".")
    return "[" + ",".join(map(_plain, x)) + "]" if isinstance(x, (list, tuple)) else str(x)


@pytest.fixture(scope="session")
def duck(data):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for path in Path(data).glob("*.parquet"):
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(CORE))
def test_every_query_runs_and_equals_its_sql(spark, data, duck, name):
    call, sql = CORE[name]
    df = call(spark, data)
    columns = sorted(df.columns)
    got = sorted("|".join(_plain(r[c]) for c in columns) for r in df.collect())
    assert got
    if sql:
        found = duck.sql(sql)
        at = [found.columns.index(c) for c in columns]
        assert len(at) == len(found.columns) and got == sorted("|".join(_plain(r[i]) for i in at) for r in found.fetchall())


@pytest.fixture(scope="session")
def empty(spark, data, tmp_path_factory):
    return empty_copy(spark, data, tmp_path_factory.mktemp("empty"))


#: Whole-table summaries give one row, or a row per relation, of zeros.
SUMMARIES = {"d12_group_summary": 1, "d23_hit_rates": 1, "d24_rank_pollution": 1, "d25_box_rates": 1, "d28_delta": 1, "d34_manifest": 4, "d14_claim_scores": 1, "d17_label_report": 1, "c15_retrieval": 0}


@pytest.mark.parametrize("module", [evaluation_queries, matching_queries, sampling_queries, sequence_queries, derived_queries, relational_queries])
def test_empty_tables(spark, empty, module):
    for name, call in module.queries().items():
        assert call(spark, empty).count() == SUMMARIES.get(name, 0), name


def test_entry(spark):
    e = importlib.import_module("__spark_entry__")
    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
