"""The general problems: schema drift and units, on fixtures, hostile and empty tables."""

import datetime
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.hostile import empty_copy, hostile_copy, rows
from vellum.operators import schema_drift, unit_harmony
from vellum.plans import problems

EXPORT = "feed string, file_name string, delivered_at timestamp, line_no int, payload string"


def exports(spark, files):
    out = []
    for i, (name, lines) in enumerate(files):
        for n, line in enumerate(lines, 1):
            out.append(("f", name, datetime.datetime(2024, 1, 1 + i), n, line if isinstance(line, str) else json.dumps(line)))
    return spark.createDataFrame(out, EXPORT)


def changes(spark, files):
    return {tuple(r)[2:] for r in schema_drift.schema_changes(exports(spark, files)).collect()}


def test_added_removed_renamed_retyped(spark):
    a = [{"target_id": f"t{i}", "image_scope": ["full_work", "partial_detail"][i % 2], "width": 1500 + i, "note": "x"} for i in range(12)]
    b = [{"target_id": f"t{i}", "imageScope": ["full_work", "partial_detail"][i % 2], "width": str(1500 + i), "dpi": 200} for i in range(12)]
    assert changes(spark, [("a", a), ("b", b)]) == {("renamed", "image_scope", "imageScope"), ("retyped", "width", ""), ("removed", "note", ""), ("added", "dpi", "")}


def test_rename_by_values_alone_and_no_rename_by_chance(spark):
    a = [{"id": i, "object_type": ["painting", "photo", "diagram"][i % 3]} for i in range(12)]
    b = [{"id": i, "depicted": ["painting", "photo", "diagram"][i % 3]} for i in range(12)]
    assert ("renamed", "object_type", "depicted") in changes(spark, [("a", a), ("b", b)])
    c = [{"id": i, "crop_path": f"crops/{i}.jpg"} for i in range(12)]
    assert changes(spark, [("a", a), ("c", c)]) == {("removed", "object_type", ""), ("added", "crop_path", "")}


def test_flooding_propagates_from_equal_names():
    field = lambda name, hist, keys=(): {"field": name, "kinds": ["string"], "hist": hist, "usual": {}, "keys": list(keys)}
    old, new = [field("page_num", {1: 5.0}), field("page_width", {2: 5.0})], [field("pdf_no", {3: 5.0}), field("pdf_width", {2: 5.0})]
    # A sure pair with the same change of name part supports the weak one.
    assert schema_drift.flood(old, new)["page_num", "pdf_no"] > schema_drift.flood(old[:1], new[:1])["page_num", "pdf_no"] + 0.01
    nested = schema_drift.flood([field("size", {1: 5.0}, ["height", "width"])], [field("extent", {2: 5.0}, ["height", "width"])])
    assert nested["size", "extent"] > schema_drift.flood([field("size", {1: 5.0})], [field("extent", {2: 5.0})])["size", "extent"]


def test_unified_table_takes_one_name_of_a_line(spark):
    lines = [{"target_id": f"t{i}", "width": 1500 + i, "dpi": 1500 + i} for i in range(12)]
    out = schema_drift.unified_exports(exports(spark, [("a", lines)])).collect()
    assert {r["width"] for r in out} == {1500 + i for i in range(12)} and all("dpi" in json.loads(r["extras"]) for r in out)


def test_flooding_decides_rows():
    """Without its steps, two weak pairs are taken as they start; with them the sure pair beside them tips the balance."""
    field = lambda name, hist: {"field": name, "kinds": ["string"], "hist": hist, "usual": {}, "keys": []}
    old = [field("page_num", {1: 5.0, 9: 4.0}), field("page_width", {2: 5.0})]
    new = [field("pdf_no", {3: 5.0, 9: 4.0}), field("pdf_width", {2: 5.0})]
    steps = schema_drift.FLOOD_STEPS
    try:
        flooded = {(a, b) for a, b, _ in schema_drift.match_fields(old, new)}
        schema_drift.FLOOD_STEPS = 0
        plain = {(a, b) for a, b, _ in schema_drift.match_fields(old, new)}
    finally:
        schema_drift.FLOOD_STEPS = steps
    assert ("page_num", "pdf_no") in flooded and ("page_num", "pdf_no") not in plain


def test_pages_are_never_resolutions(spark):
    """A resolution beside a page under a strange name does not become the page; nothing of a line is lost."""
    a = [{"target_id": f"t{i}", "page_num": 10 + i, "width": 1500 + i, "dpi": 200} for i in range(12)]
    b = [{"target_id": f"t{i}", "pg": 10 + i, "w": 1500 + i, "dpi": 300, "odd ['key']": i} for i in range(12)]
    c = [{"target_id": f"t{i}", "dpi": 150} for i in range(12)]
    out = {(r["file_name"], r["target_id"]): r for r in schema_drift.unified_exports(exports(spark, [("a", a), ("b", b), ("c", [*c, "no object"])])).collect()}
    assert all(out[f, f"t{i}"]["page_num"] == 10 + i for f in "ab" for i in range(12)) and all(out["c", f"t{i}"]["page_num"] is None for i in range(12))
    assert json.loads(out["b", "t3"]["extras"])["odd ['key']"] == "3" and out["c", None]["extras"] is None and len(out) == 37


def test_nulls_and_broken_payloads(spark):
    a = [{"x": None, "y": 1}, "not json", {"y": 2}]
    b = [{"x": None, "y": 1.5}, {"y": 2.5}]
    assert changes(spark, [("a", a), ("b", b)]) == {("retyped", "y", "")}
    assert changes(spark, [("a", a)]) == set()


def test_order_is_by_delivery(spark):
    df = exports(spark, [("z", [{"a": 1}]), ("b", [{"a": 1, "q": True}])])
    assert [r["file_name"] for r in schema_drift.schema_changes(df).collect()] == ["b"]


def test_unified_table_has_one_type_per_column(spark, data):
    out = schema_drift.unified_exports(spark.read.parquet(f"{data}/target_exports.parquet"))
    assert dict(out.dtypes)["width"] == "int" and out.count() > 0
    assert out.where("confidence > 1").count() == 0


@pytest.mark.parametrize(("value", "reason", "caption", "mm"), [
    ("10.5 x 20 cm", None, None, (105, 200)), ("W. 20 cm, H. 10 cm", "", "", (100, 200)), ("横20公分 纵10公分", None, None, (100, 200)),
    ("高 10 宽 20 厘米", None, None, (100, 200)), ("3 ft 2 in x 2 ft", None, None, (965, 610)), ('9⅞ × 9¾ "', None, None, (251, 248)),
    ("diam. 23,4 cm", None, None, (234, 234)), ("image 21 x 30 cm; mount 23 x 32 cm", None, None, (210, 300)), ("12 * 13 * 14 cm", None, None, (120, 130)),
    ("18.6 x 73.0", "sizes in inches, see preface", None, (472, 1854)), ("463 x 2771", None, "Fig. 3, 463 x 2771 mm", (463, 2771)), ("46.4 x 51.9", None, "Fig. 3 (46.4 x 51.9 in.)", (1179, 1318)),
    ("1.5 m x 2 m", None, None, (1500, 2000)), ("10 x 20", None, None, None), ("not measured", None, None, None), ("", None, None, None), (None, None, None, None),
])
def test_sizes(spark, value, reason, caption, mm):
    schema = "target_id string, source_file string, base_fields map<string,string>, metadata_fields map<string,struct<value:string,abstain:boolean,source:string,confidence:double,reason:string>>"
    df = spark.createDataFrame([("t", "a.pdf", {"caption_text": caption}, {"dimensions": (value, False, "x", 0.5, reason)})] * 2, schema)
    got = [tuple(r)[1:] for r in unit_harmony.found_sizes(df).collect()]
    assert got == ([mm] if mm else [])


@settings(max_examples=150, deadline=None)
@given(st.floats(0.1, 400), st.floats(0.1, 400), st.sampled_from(["mm", "cm", "in.", "inches", "厘米"]), st.sampled_from([" x ", " × ", "×", " by "]))
def test_size_round_trip(a, b, unit, sign):
    h, w, uh, uw, _ = unit_harmony.first_size(f"{a:.1f}{sign}{b:.1f} {unit}")
    assert (round(h, 1), round(w, 1)) == (round(float(f"{a:.1f}"), 1), round(float(f"{b:.1f}"), 1)) and uh == uw == unit.rstrip(".")


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_any_text_is_no_crash(text):
    unit_harmony.measures_of(text, text, text)


def test_unlabelled_sizes_follow_their_source(spark):
    schema = "target_id string, source_file string, base_fields map<string,string>, metadata_fields map<string,struct<value:string,abstain:boolean,source:string,confidence:double,reason:string>>"
    out = []
    for i in range(6):
        out.append((f"a{i}", "known.pdf", {"depicted_work_title": f"T{i}"}, {"dimensions": (f"{10 + i}.0 x 20.0 cm", False, "x", 0.5, None)}))
        out.append((f"b{i}", "bare.pdf", {"depicted_work_title": f"T{i}"}, {"dimensions": (f"{100 + 10 * i} x 200", False, "x", 0.5, None)}))
    got = {r["target_id"]: (r["height_mm"], r["via"]) for r in unit_harmony.harmonised_sizes(spark.createDataFrame(out, schema)).collect()}
    assert got["b3"] == (130, "linked") and got["a3"] == (130, "stated") and len(got) == 12


def test_unlabelled_sources_link_over_others_and_with_offset(spark):
    schema = "target_id string, source_file string, base_fields map<string,string>, metadata_fields map<string,struct<value:string,abstain:boolean,source:string,confidence:double,reason:string>>"
    row = lambda k, f, t, v: (k, f, {"depicted_work_title": t}, {"dimensions": (v, False, "x", 0.5, None)})
    out = []
    for i in range(8):
        out.append(row(f"a{i}", "known.pdf", f"T{i}", f"{10 + 5 * i}.0 x 20.0 cm"))
        out += [row(f"b{i}", "bare.pdf", f"T{i}", f"{100 + 50 * i} x 200"), row(f"c{i}", "bare.pdf", f"U{i}", f"{300 + 50 * i} x 200")]
        # In centimetres, and only over titles of the source above.
        out.append(row(f"d{i}", "far.pdf", f"U{i}", f"{30 + 5 * i}.0 x 20.0"))
        # Millimetres with a margin of 40 around.
        out.append(row(f"e{i}", "margin.pdf", f"T{i}", f"{140 + 50 * i} x 240"))
    got = {r["target_id"]: (r["height_mm"], r["width_mm"]) for r in unit_harmony.harmonised_sizes(spark.createDataFrame(out, schema)).collect()}
    assert got["d2"] == (400, 200) and got["e2"] == (200, 200) and len(got) == 40


def test_hostile_and_empty_tables(spark, data, tmp_path_factory):
    bad = hostile_copy(spark, data, tmp_path_factory.mktemp("hostile"))
    none = empty_copy(spark, data, tmp_path_factory.mktemp("empty"))
    for name, call in problems.queries().items():
        assert rows(call(spark, bad)) == rows(call(spark, data)), name
        assert call(spark, none).count() == 0, name
