"""Kernels and operators of the training-data problems against brute force, round trips and held-out truth."""

import collections
import itertools
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vellum.llm import canonical, language_crf, leakage, packing, related_splits, scan_noise, split_overlap, truncation

FIGURE = "target_id string, doc_id string, source_file string, split string, base_fields map<string,string>, metadata_fields map<string,struct<value:string,abstain:boolean,source:string,confidence:double,reason:string>>"


def figures(spark, rows):
    return spark.createDataFrame([(t, d, f, s, {"caption_text": c} if c is not None else None, None) for t, d, f, s, c in rows], FIGURE)


# -- 1 ---------------------------------------------------------------------------------------------------------------

PROSE = "The painter left the mountain bare and the river moves between the pines. Each scholar described the footpath as a sign of patience. "
CAND = "pair_id string, source_file string, fragment_text string"
PAGES = "page_id string, source_file string, text_preview string"


def noise_rows(spark, texts):
    clean = [(f"c{i}", "other.pdf", PROSE * 3) for i in range(4)]
    return {tuple(r)[1:] for r in scan_noise.found_noise(spark.createDataFrame([(f"p{i}", "dir/Book.PDF", t) for i, t in enumerate(texts)], PAGES), spark.createDataFrame(clean, CAND)).collect() if r["record_table"] == "page_specs"}


def test_noise_kinds(spark):
    text = "Part iv: silk and stone   12\nThe painter left the moun-\ntain bare and the r1ver moves\nbetween the pines. Each scholar descri¬\nbed the footpatb as a sign.\n      - 12 -"
    got = noise_rows(spark, [text])
    assert got == {("p0", "header", "Part iv: silk and stone   12"), ("p0", "page_number", "- 12 -"), ("p0", "hyphenation", "mountain"), ("p0", "hyphenation", "described"), ("p0", "misread", "river"), ("p0", "misread", "footpath")}


def test_head_between_word_halves_and_unnumbered_head(spark):
    a = "12   WILLOWS OF THE NORTH\nThe painter left the moun-\nWILLOWS OF THE NORTH\ntain bare and"
    got = noise_rows(spark, [a])
    assert ("p0", "hyphenation", "mountain") in got and ("p0", "header", "WILLOWS OF THE NORTH") in got


def test_single_lines_and_nulls_are_quiet(spark):
    assert noise_rows(spark, ["253", "", None, "The painter left the river bare."]) == set()


def test_reflow(spark):
    out = scan_noise.repaired_text(spark.createDataFrame([("p", "b.pdf", "The painter left the moun-\ntain bare and\nthe r1ver moves.\n\nEach scholar.\n   [7]")], PAGES), spark.createDataFrame([(f"c{i}", "o.pdf", PROSE) for i in range(4)], CAND))
    assert out.where("record_id = 'p'").first()["text"] == "The painter left the mountain bare and the river moves.\n\nEach scholar."


def test_one_word_repaired_two_ways(spark):
    """Two frequent words of one skeleton: every place of the odd form goes by its own neighbours."""
    skeletons = spark.createDataFrame([("cliff", "diff")], "a string, b string")
    assert skeletons.where(scan_noise.skeleton(F.col("a")) == scan_noise.skeleton(F.col("b"))).count() == 1
    clean = [(f"c{i}", "o.pdf", "They climb the cliff above the lake. They note the diff below the line. " * 3) for i in range(4)]
    text = "“We climb the c1iff above it and note the c1iff below the line,” they say."
    out = scan_noise.repaired_text(spark.createDataFrame([("p", "b.pdf", text)], PAGES), spark.createDataFrame(clean, CAND)).where("record_id = 'p'").first()["text"]
    assert out == "“We climb the cliff above it and note the diff below the line,” they say."


def test_heads_seen_once_are_known_by_their_frame(spark):
    pages = [(f"p{i}{j}", f"s{i}.pdf", f"Part iv: {w} and stone   {j + 3}\nThe painter left the mountain bare and\nthe river moves between the pines.") for i, w in enumerate(("silk", "paper", "jade", "satin")) for j in range(2)]
    pages.append(("once", "lone.pdf", "Part ix: plaster and bronze\nThe painter left the mountain bare and\nthe river moves between the pines."))
    out = scan_noise.found_noise(spark.createDataFrame(pages, PAGES), spark.createDataFrame([("c", "o.pdf", PROSE)], CAND))
    assert out.where("noise_kind = 'header'").count() == 9


def test_skeleton_is_blind_to_confusions(spark):
    pairs = [("lines", "liries"), ("angular", "angiilar"), ("measurements", "rneasurements"), ("weathered", "vveathered"), ("delicate", "dehcate"), ("travellers", "travcllers"), ("cliff", "diff"), ("stone", "5†0ne")]
    df = spark.createDataFrame(pairs, "a string, b string")
    assert df.where(scan_noise.skeleton(F.col("a")) != scan_noise.skeleton(F.col("b"))).count() == 0


# -- 4 ---------------------------------------------------------------------------------------------------------------

BOOK = canonical.Reference([(1, "Suskweivla University Gallery", "柘溪大学画廊", 5), (2, "Suskweivla Scroll Collection", "柘溪卷轴文库", 1), (3, "Savqueivwu City Museum", "楫口市立博物馆", 0), (4, "Savqueivwu Museum of Art", "楫口美术馆", 0), (5, "Suvturku Foundation for Landscape Art", None, 0)])


@pytest.mark.parametrize(("value", "entry"), [
    ("Suskweivla Univ. Gall.", 1), ("University Gallery, Suskweivla", 1), ("SUSKWEIVLA  university gallery", 1), ("Süskweivlá University Gallery", 1), ("suskwievla universty gallery", 1), ("collection of the Suskweivla University Gallery", 1),
    ("柘溪大學畫廊 藏", 1), ("City Mus., Savqueivwu", 3), ("suvturku foundation art", 5), ("Savqueivwu Railway Museum", -1), ("Savqueivwu Museum", -1), ("Suskweivla Maritime Archive", -1), ("Hamranhe University Gallery", -1), ("private collection", -1), ("漪桥大学画廊", -1), ("", -1),
])
def test_mapping(value, entry):
    assert BOOK.meant(value) == entry


def test_ties_and_wrong_signs():
    """Equally near entries are none, unless one is written more often; a strange sign in a Chinese name is an error, a known one another name."""
    assert canonical.Reference([(1, "Aral", None, 0), (2, "Aril", None, 0)]).meant("Arxl") == -1
    assert canonical.Reference([(1, "Aral", None, 0), (2, "Aril", None, 3)]).meant("Arxl") == 2
    book = canonical.Reference([(1, "a", "柘溪大学画廊", 0), (2, "b", "楫口市立博物馆", 0), (3, "c", "楫口美术馆", 0)])
    assert [book.meant(v) for v in ("柘溪大字画廊", "柘溪大学画", "楫口大学画廊", "楫口美术馆藏", "溪柘大学画廊")] == [1, 1, -1, 3, 1]


def test_joined_lookup_equals_broadcast(spark, data):
    entries = spark.read.parquet(f"{data}/authority_entries.parquet")
    targets = spark.read.parquet(f"{data}/figure_targets.parquet")
    near, far = (sorted(map(tuple, canonical.mapped_values(targets, entries, n).collect())) for n in (canonical.BROADCAST_ENTRIES, 0))
    assert near == far and near


@settings(max_examples=200, deadline=None)
@given(st.text("abcdef", max_size=7), st.text("abcdef", max_size=7))
def test_deletions_find_all_near_words(a, b):
    """Two words within two plain edits share a form with at most two letters deleted."""
    def distance(x, y):
        d = list(range(len(y) + 1))
        for i, p in enumerate(x, 1):
            d, old = [i], d
            for j, q in enumerate(y, 1):
                d.append(min(old[j] + 1, d[-1] + 1, old[j - 1] + (p != q)))
        return d[-1]

    if distance(a, b) <= 2:
        assert canonical.deletions(a, 2) & canonical.deletions(b, 2)
    assert (canonical.weighted_distance(a, b, 9) == 0) == (a == b)


# -- 5 ---------------------------------------------------------------------------------------------------------------

def test_groups_against_union_find(spark):
    rng = random.Random(5)
    rows = [(f"t{i:04}", rng.choice([None, f"d{rng.randrange(60)}"]), rng.choice(["x/", "", "Y\\"]) + rng.choice([f"F{rng.randrange(90)}.pdf", "HOT.pdf", f"f{rng.randrange(90)}.PDF"]), rng.choice(["train", "val", "test", None]), "c") for i in range(600)]
    parent: dict = {}

    def find(a):
        while parent.setdefault(a, a) != a:
            a = parent[a]
        return a

    for t, d, f, *_ in rows:
        find(t)
        for n in filter(None, (d, re.sub(r".*[/\\]", "", f).lower())):
            parent[find(t)] = find(n)
    groups, splits = collections.defaultdict(set), collections.defaultdict(set)
    for t, _, _, s, _ in rows:
        groups[find(t)].add(t)
        splits[find(t)] |= {s} - {None}
    want = {(min(g), t) for k, g in groups.items() if len(splits[k]) > 1 for t in g}
    df = figures(spark, rows + rows[:50])
    assert {tuple(r) for r in related_splits.found_groups(df).collect()} == want
    dealt = related_splits.dealt_splits(df)
    assert dealt.count() == 600 and dealt.groupBy("group_key").agg(F.count_distinct("split").alias("n")).where("n > 1").count() == 0


def test_forest_spans_and_has_no_cycle(spark):
    rng = random.Random(6)
    edges = [(f"n{rng.randrange(120):03}", f"n{rng.randrange(120):03}") for _ in range(150)]
    roots, forest = related_splits.spanning_forest(spark.createDataFrame(edges, "u string, v string"))
    parent = {r["node"]: r["node"] for r in roots.collect()}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    trees = forest.collect()
    for u, v in trees:
        assert find(u) != find(v)
        parent[find(u)] = find(v)
    assert len({find(n) for n in parent}) == roots.select("root").distinct().count() and all(find(u) == find(v) for u, v in edges if u != v)


def test_shares_with_large_groups(spark):
    sizes = [300, 90, 70, 60, 55, 40, 35, 30, 30, 25] + [rng for rng in range(1, 24)]
    rows = [(f"t{i}-{k}", f"d{i}", f"f{i}.pdf", None, "") for i, n in enumerate(sizes) for k in range(n)]
    n = {r["split"]: r["share"] for r in related_splits.split_report(figures(spark, rows)).collect()}
    assert abs(n["train"] - 0.75) < 0.01 and abs(n["val"] - 0.1) < 0.01 and abs(n["test"] - 0.15) < 0.01


def test_hot_keys_meet_their_facts_by_broadcast(spark):
    from vellum.runtime import join_facts

    rows = spark.range(4000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"), "id").unionByName(spark.createDataFrame([(None, -1)], "k long, id long"))
    facts = spark.range(3000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    want = sorted((r["id"], r["v"]) for r in rows.join(facts, "k", "left").collect() if r["v"] is not None)
    assert sorted((r["id"], r["v"]) for r in join_facts(rows, facts, "k", limit=0).collect() if r["v"] is not None) == want


def test_long_chain_contracts(spark):
    edges = spark.createDataFrame([(f"n{i:04}", f"n{i + 1:04}") for i in range(80)], "u string, v string")
    roots, forest = related_splits.spanning_forest(edges)
    assert roots.select("root").distinct().count() == 1 and forest.distinct().count() == 80


def test_shares_of_many_small_groups(spark):
    df = figures(spark, [(f"t{i}", f"d{i // 2}", f"f{i // 2}.pdf", None, "") for i in range(4000)])
    n = {r["split"]: r["count"] for r in related_splits.dealt_splits(df).groupBy("split").count().collect()}
    assert abs(n["train"] - 3000) < 60 and abs(n["val"] - 400) < 60 and abs(n["test"] - 600) < 60


# -- 6 ---------------------------------------------------------------------------------------------------------------

def test_cut_texts(spark):
    rng, nouns = random.Random(1), ["river", "mountain", "pavilion", "footpath", "orchard", "terrace"]
    rows = []
    for i in range(500):
        full = f"Detail of the {rng.choice(nouns)} beside the {rng.choice(nouns)}, ink and colour on silk, City Museum"
        rows.append((f"t{i}", None, f"f{i % 25}.pdf", None, full))
    bad = {"x1": "Detail of the river beside the mount", "x2": "Detail of the pavilion beside the", "x3": "Detail of the orchard beside the river, ink and colour on", "x4": "Detail of the terr�"}
    rows += [(k, None, f"g{k}.pdf", None, v) for k, v in bad.items()]
    rows += [("y1", None, "h.pdf", None, "Detail of the river beside the orchard.")]
    none = spark.createDataFrame([], "pair_id string, source_file string, fragment_text string")
    assert {r["record_id"] for r in truncation.found_cuts(figures(spark, rows), none).collect()} == set(bad)


def test_ellipsis_is_no_final_stop(spark):
    rng, nouns = random.Random(1), ["river", "mountain", "pavilion", "footpath", "orchard", "terrace"]
    rows = [(f"t{i}", None, f"f{i % 25}.pdf", None, f"Detail of the {rng.choice(nouns)} beside the {rng.choice(nouns)}, ink and colour on silk, City Museum") for i in range(500)]
    bad = {"x1": "Detail of the river beside the mount...", "x2": "Detail of the pavilion beside the…", "x3": "Detail of the orchard beside the river, ink and colour on ...", "x4": "“Detail of the terrace beside the pav...”"}
    rows += [(k, None, f"g{k}.pdf", None, v) for k, v in bad.items()]
    none = spark.createDataFrame([], "pair_id string, source_file string, fragment_text string")
    assert {r["record_id"] for r in truncation.found_cuts(figures(spark, rows), none).collect()} == set(bad)


def test_field_limit(spark):
    rng = random.Random(2)
    nouns = ["river", "mountain", "pavilion", "footpath", "orchard", "terrace"]
    sentence = lambda: f"The {rng.choice(nouns)} and the {rng.choice(nouns)} stand beside the {rng.choice(nouns)} of the old painter."
    rows = [(f"t{i}", None, f"f{i % 40}.pdf", None, " ".join(sentence() for _ in range(rng.randrange(1, 4)))) for i in range(400)]
    rows += [(f"l{i}", None, "l.pdf", None, " ".join(sentence() for _ in range(4))[:100]) for i in range(9)]
    out = truncation.judged_texts(figures(spark, rows), spark.createDataFrame([], "pair_id string, source_file string, fragment_text string"))
    assert {r["record_id"] for r in out.where("at_limit").collect()} == {f"l{i}" for i in range(9)} and out.where("limit = 100").count() == 9
    assert {r["record_id"] for r in out.where("was_cut").collect()} == {f"l{i}" for i in range(9)}


def test_endings_without_a_rest_of_doubt(spark):
    """An ending that thousands of texts have and none goes on from: its rate is 1 to the last bit, its odds are a number."""
    none = spark.createDataFrame([], "pair_id string, source_file string, fragment_text string")
    rows = [(f"t{i}", None, f"f{i}.pdf", None, "Pines above the river, ink on silk¶") for i in range(3000)] + [("x", None, "g.pdf", None, "Pines above the ri")]
    out = {r["record_id"]: r for r in truncation.judged_texts(figures(spark, rows), none).select("record_id", "char_odds", "class_odds", "was_cut").collect()}
    assert out["t0"]["char_odds"] > 30 and out["x"]["char_odds"] < 0 and {k for k, r in out.items() if r["was_cut"]} == {"x"}


def test_nothing_left_of_a_text(spark):
    """A text that is only an ellipsis or a page line has no context: it is judged without odds."""
    none = spark.createDataFrame([], "pair_id string, source_file string, fragment_text string")
    out = truncation.judged_texts(figures(spark, [("a", None, "f.pdf", None, "..."), ("b", None, "f.pdf", None, "\n42"), ("c", None, "f.pdf", None, "A lake")]), none)
    assert {(r["record_id"], r["char_odds"] is None) for r in out.collect()} == {("a", True), ("b", True), ("c", False)}


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text("abc", max_size=9), max_size=6))
def test_context_keys_against_slices(texts):
    """Equal keys exactly for equal contexts of one order, and one end per text that is long enough."""
    codes, lengths = truncation._char_codes(texts)
    seen: dict = {}
    for n, (keys, owner, ends) in zip((1, 2, 4), truncation.context_keys(codes, lengths, truncation._seeds(["en"] * len(texts), 1), (1, 2, 4))):
        want = [(i, t[p - n : p], p == len(t)) for i, t in enumerate(texts) for p in range(n, len(t) + 1)]
        assert [(i, e) for i, _, e in want] == list(zip(owner.tolist(), ends.tolist()))
        for (_, piece, _), k in zip(want, keys.tolist()):
            assert seen.setdefault(piece, k) == k
    assert len(set(seen.values())) == len(seen)


def test_inner_counts_against_brute_force(spark):
    """Every end context of the wanted texts is counted exactly; longer contexts are only tried where shorter ones are wanted."""
    rng = random.Random(8)
    texts = ["".join(rng.choice("ab c.") for _ in range(rng.randrange(1, 40))) for _ in range(60)]
    keys = lambda t: truncation.end_keys([t], ["en"], 1, truncation._char_codes, truncation.CHAR_ORDERS)[0]
    forms = spark.createDataFrame([("en", t, t, 1 + i % 3) for i, t in enumerate(texts)], "lang string, chars string, classes string, weight long")
    wanted = spark.createDataFrame([(k,) for k in {k for t in texts[:30] for k in keys(t)}], "k long")
    got = {r["k"]: r["mid"] for r in truncation.inner_counts(forms, wanted).collect()}
    for t in texts[:30]:
        for n, k in zip(truncation.CHAR_ORDERS, keys(t)):
            want = sum((1 + i % 3) * sum(x[p - n : p] == t[-n:] for p in range(n, len(x))) for i, x in enumerate(texts))
            assert got.get(k, 0) == want


def test_valley():
    assert truncation.valley({}) is None and truncation.valley({-10: 30, -9: 20, -8: 5, -3: 9, -2: 40}) == (-7 - 3) / 2 * 0.5


# -- 7 ---------------------------------------------------------------------------------------------------------------

def plain_distance(x, y):
    d = list(range(len(y) + 1))
    for i, p in enumerate(x, 1):
        d, old = [i], d
        for j, q in enumerate(y, 1):
            d.append(min(old[j] + 1, d[-1] + 1, old[j - 1] + (p != q)))
    return d[-1]


def test_caption_join_against_brute_force(spark):
    rng = random.Random(9)
    base = ["".join(rng.choice("abcdeflmnrst") for _ in range(rng.randrange(26, 110))) for _ in range(40)] + ["ab" * 30, "a" * 50, "图版水墨绢本" * 6]

    def edited(s):
        s = list(s)
        for _ in range(rng.randrange(0, len(s) * 14 // 100 + 2)):
            at = rng.randrange(len(s))
            s[at : at + 1] = rng.choice([[], [rng.choice("abcxyz")], [s[at], rng.choice("abcxyz")]])
        return "".join(s)

    rows = [(f"a{i}", None, "f", "train", s) for i, s in enumerate(base)] + [(f"b{i}-{j}", None, "f", rng.choice(["val", "test"]), edited(s).upper() + "!") for i, s in enumerate(base) for j in range(4)]
    want = {(e[0], t[0]) for e in rows if e[3] != "train" for t in rows if t[3] == "train"
            if len(x := e[4].lower().rstrip("!")) >= 25 and len(t[4]) >= 25 and plain_distance(x, t[4]) * 100 <= 12 * max(len(x), len(t[4]))}
    got = {(r["eval_id"], r["train_id"]) for r in split_overlap.caption_overlaps(figures(spark, rows)).collect()}
    assert got == want and len(want) > 60


def test_box_join_against_brute_force(spark):
    rng = random.Random(3)
    rows, boxes = [], []
    for i in range(160):
        x, y, w, h = rng.randrange(60), rng.randrange(60), rng.randrange(20, 60), rng.randrange(20, 60)
        rows.append((f"t{i}", None, "f", ["train", "val", "test"][i % 3], None))
        boxes.append((f"p{i % 2}", f"t{i}", [x, y, x + w, y + h]))
        boxes.append((f"p{i % 2}", f"t{(i * 7) % 160}", [x + 1, y, x + w, y + h + 2]))
    boxes += [("p0", "t0", [5, 5, 5, 9]), (None, "t1", [0, 0, 9, 9]), ("p0", "t2", None), ("p0", None, [0, 0, 9, 9])]
    split = {r[0]: r[3] for r in rows}
    want = set()
    for p, a, m in boxes:
        for q, b, n in boxes:
            if p and p == q and a and b and m and n and split[a] != "train" and split[b] == "train" and m[2] > m[0]:
                i = max(0, min(m[2], n[2]) - max(m[0], n[0])) * max(0, min(m[3], n[3]) - max(m[1], n[1]))
                if i and i >= 0.8 * ((m[2] - m[0]) * (m[3] - m[1]) + (n[2] - n[0]) * (n[3] - n[1]) - i):
                    want.add((a, b))
    df = spark.createDataFrame(boxes, "page_id string, target_id string, image_bbox array<int>")
    assert {tuple(r) for r in split_overlap.box_overlaps(figures(spark, rows), df).collect()} == want and want


def test_overlap_candidates_are_not_stored(spark, monkeypatch):
    # Parts in another order hold the same pairs of characters and an equal head, but are far apart by edits.
    rng = random.Random(5)
    head, parts = "".join(rng.choice("abcdefghij") for _ in range(20)), ["".join(rng.choice("klmnopqrstuv") for _ in range(14)) for _ in range(5)]
    orders = rng.sample([*itertools.permutations(parts)], 80)
    rows = [(f"{s}{i}", None, "f", split, head + "".join(o)) for s, split, own in (("a", "train", orders[:40]), ("b", "val", orders[40:])) for i, o in enumerate(own)] + [("c", None, "f", "test", head + "".join(orders[0]) + "z")]
    counts, real = [], split_overlap.stored

    def counted(df):
        out = real(df)
        counts.append(out.count())
        return out

    monkeypatch.setattr(split_overlap, "stored", counted)
    got = {(r["eval_id"], r["train_id"]) for r in split_overlap.caption_overlaps(figures(spark, rows)).collect()}
    assert ("c", "a0") in got and max(counts) <= len(rows)


@pytest.mark.parametrize(("block", "most", "crowded"), [(3, 2, 0), (10**6, 10**6, 10**6)])
def test_found_overlaps_against_brute_force(spark, monkeypatch, block, most, crowded):
    rng = random.Random(11)
    base = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(30, 60))) for _ in range(6)]
    rows = [(f"t{i}", None, "f", ["train", "val", "test"][i % 3], base[i % 6 if i % 5 else 0][: rng.randrange(50, 60)] + "xy"[: i % 3]) for i in range(40)]
    # Targets of two texts, one of them on both sides, and repeated rows.
    rows += [("t1", None, "f", "val", base[3]), ("t2", None, "f", "train", base[0]), ("t3", None, "f", "train", base[4]), ("t5", None, "f", "val", None), *rows[:5]]
    boxes = [(f"p{i % 3}", f"t{i % 40}", [j := rng.randrange(6), j, j + 40, j + 40 + i % 5]) for i in range(90)] + [("p9", "t7", None)]
    monkeypatch.setattr(split_overlap, "LIST", most)
    monkeypatch.setattr(split_overlap, "BLOCK_TEXTS", block)
    monkeypatch.setattr(split_overlap, "TASK_ROWS", 5)
    real = split_overlap.box_overlaps
    monkeypatch.setattr(split_overlap, "box_overlaps", lambda t, c: real(t, c, crowded))

    def same(m, n):
        i = max(0, min(m[2], n[2]) - max(m[0], n[0])) * max(0, min(m[3], n[3]) - max(m[1], n[1]))
        return i >= 0.8 * ((m[2] - m[0]) * (m[3] - m[1]) + (n[2] - n[0]) * (n[3] - n[1]) - i)

    evals, trains = ([(r[0], r[4]) for r in rows if (r[3] == "train") is side] for side in (False, True))
    want = {tuple(sorted((a, b))) for a, x in evals for b, y in trains if a != b and x and y and plain_distance(x, y) * 100 <= 12 * max(len(x), len(y))}
    by_caption = len(want)
    sides = [{a for a, _ in part} for part in (evals, trains)]
    want |= {tuple(sorted((a, b))) for p, a, m in boxes for q, b, n in boxes if p == q and a != b and a in sides[0] and b in sides[1] and m and n and same(m, n)}
    df = spark.createDataFrame(boxes, "page_id string, target_id string, image_bbox array<int>")
    got = [tuple(r) for r in split_overlap.found_overlaps(figures(spark, rows), df).collect()]
    assert sorted(got) == sorted(want) and len(want) > by_caption > 40


def test_boxes_of_quiet_pages_are_moved_once(spark):
    # No copies of a region for the cells around it: they made up most of what the query moved.
    rows = [(f"t{i}", None, "f", ["train", "val"][i % 2], None) for i in range(8)]
    df = spark.createDataFrame([(f"p{i // 4}", f"t{i}", [0, 0, 50, 50 + i]) for i in range(8)], "page_id string, target_id string, image_bbox array<int>")
    out = split_overlap.box_overlaps(figures(spark, rows), df)
    assert "explode" not in out._jdf.queryExecution().optimizedPlan().toString() and out.count() == 8


# -- 8 ---------------------------------------------------------------------------------------------------------------

@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 50), max_size=60))
def test_first_fit_decreasing(sizes):
    bins = packing.first_fit_decreasing(sizes, 50)
    used = collections.Counter()
    for b, s in zip(bins, sizes):
        used[b] += s
    assert all(v <= 50 for v in used.values())
    # The same as the plain rule that scans all containers.
    free, want = [50] * max(1, len(sizes)), [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        want[i] = next(k for k, f in enumerate(free) if f >= sizes[i])
        free[want[i]] -= sizes[i]
    assert bins == want


def test_packing_is_whole(spark):
    docs = spark.createDataFrame([(i, "ink and water " * (i % 40)) for i in range(200)] + [(900, "mountain " * 5000), (901, None), (0, "")], "doc_id long, text string")
    enc = packing.encoder()
    out = packing.packed(docs, capacity=256, group_items=64).collect()
    per, full = collections.Counter(), collections.Counter()
    for r in out:
        per[r["doc_id"]] += r["tokens"]
        full[r["container_id"]] += r["tokens"]
    assert max(full.values()) <= 256 and per[900] == len(enc.encode_ordinary("mountain " * 5000)) and 901 not in per and len({(r["doc_id"], r["piece_no"]) for r in out}) == len(out) and len(per) == 201


# -- 9 ---------------------------------------------------------------------------------------------------------------

def test_leaks_against_brute_force(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(30)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(5, 60)))) for i in range(12)]
    docs = []
    for i in range(150):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(0, 80))]
        if i % 3 == 0:
            w = rng.choice(items)[1].split()
            n = rng.randrange(6, 14)
            at = rng.randrange(max(1, len(w) - n))
            words[5:5] = w[at : at + n]
        docs.append((i, ", ".join(words).upper().replace(", ", ",\n", 3)))
    docs += [(500, None), (501, ""), (0, docs[0][1])]

    def grams(t):
        w = re.findall(r"[^\W_]+", t.lower())
        return {tuple(w[i : i + 10]) for i in range(len(w) - 9)}

    want = {(d, i) for d, t in docs if t for i, x in items if grams(t) & grams(x)}
    got = {tuple(r) for r in leakage.found_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, item_text string")).collect()}
    assert got == want and len(want) > 10
    far = leakage.leaked_passages(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, item_text string"), limit=0)
    assert {(r["doc_id"], r["item_id"]) for r in far.collect()} == want


# -- 10 --------------------------------------------------------------------------------------------------------------

def test_forward_backward_against_enumeration():
    import itertools

    rng = np.random.default_rng(0)
    scores, move = rng.normal(size=(1, 4, 3)), rng.normal(size=(3, 3))
    gamma, moves = language_crf.forward_backward(scores, np.ones((1, 4), dtype=bool), move)
    want, pairs, z = np.zeros((4, 3)), np.zeros((3, 3)), 0.0
    for y in itertools.product(range(3), repeat=4):
        p = np.exp(sum(scores[0, t, y[t]] for t in range(4)) + sum(move[a, b] for a, b in zip(y, y[1:])))
        z += p
        for t in range(4):
            want[t, y[t]] += p
        for a, b in zip(y, y[1:]):
            pairs[a, b] += p
    assert np.allclose(gamma[0], want / z) and np.allclose(moves, pairs / z)


def test_labels(spark):
    df = spark.createDataFrame([("en-GB",), ("Deutsch",), ("zho",), ("und",), (" ",), (None,), ("nl",), ("FR",)], "l string")
    assert [r[0] for r in df.select(language_crf.label_language(F.col("l"))).collect()] == ["en", "de", "zh", "", "", "", "nl", "fr"]


@pytest.fixture(scope="module")
def learned(spark, data):
    docs = spark.read.parquet(f"{data}/../sf0.01/documents.parquet").select("doc_id", "text", "lang")
    return docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1")


def test_held_out_accuracy(spark, learned):
    """Paragraphs of documents the field never saw go by their document's label; a few labels and paragraphs differ by design."""
    field = language_crf.train(language_crf.training_rows(learned[0]))
    rows = [(r["lang"], [p for p in map(language_crf.tokens, r["text"].split("\n\n")) if p]) for r in learned[1].where("text IS NOT NULL").collect() if r["lang"] in field.languages]
    flat = [(k, p) for k, ps in rows for p in ps]
    said = [field.languages[int(m.sum(axis=0).argmax())] for m in field.marginals([p for _, p in flat])]
    assert len(flat) > 400 and sum(k == x for (k, _), x in zip(flat, said)) >= 0.93 * len(flat)


def test_segments_and_foreign_labels(spark, learned):
    extra = spark.createDataFrame([
        (10**9, "Der Maler zeigt die Brücke und den Wasserfall, nicht aber die Ferne.\n\nThe painter shows the bridge and the waterfall, but not the distance between them.\n\n12\n\nDie Tusche ist an dieser Stelle sehr dünn und kaum noch zu erkennen.", "en"),
        (10**9 + 1, "De schilder liet de berg kaal en de rivier stroomt tussen de bomen door naar het dal.", "nl"),
        (10**9 + 2, "The painter shows the bridge and the waterfall, but not the distance between them.", "nl"),
        (10**9 + 3, "The painter shows the bridge and the waterfall, und die Tusche ist an dieser Stelle sehr dünn, but not the distance between them.", "en"),
    ], "doc_id long, text string, lang string")
    docs = learned[0].unionByName(extra)
    out = language_crf.found_languages(docs).where("doc_id >= 1000000000").collect()
    assert {tuple(r) for r in out} == {(10**9, -1, "de"), (10**9, 1, "en"), (10**9 + 2, -1, "en")}
    runs = language_crf.mixed_segments(docs).where("doc_id >= 1000000000").orderBy("run_no").collect()
    assert [(r["doc_id"] - 10**9, r["lang"]) for r in runs] == [(3, "en"), (3, "de"), (3, "en")] and sum(r["words"] for r in runs) == 23
