"""Noise in text from scanned pages: broken words, misread characters, running heads, page numbers; reflowed text.

Lines: a line that is only a (possibly spaced, bracketed or roman) number is a page number. Running heads are found per
source by masking digits and mapping the rest to its confusable-glyph skeleton: a core that carries a page number
anywhere in the source, or comes back before different next lines, is a head. Heads of short sources come back too
seldom for that; they are known by their frame (the order of capitals, numerals, short words and punctuation): a frame
most of whose masked cores, over all sources, are proven heads makes the others of it heads, too.

Words: every character is replaced by the elementary strokes it may be confused with (a homomorphism, so two words that
differ only by confusions share the skeleton). Words are grouped by skeleton over all body text; a rare form beside a
much more frequent one, or one with a character no word has, is misread. Among several frequent forms the one the
neighbouring words support is chosen, occurrence by occurrence. Broken words are joined as the corpus writes them
mid-line, with or without hyphen. Reflow runs over windows of a record's lines: running sums number its paragraphs,
the next line shows whether a broken word goes on.

All counts are exact and taken over all texts; vocabularies and occurrences meet by shuffled or size-checked joins.

Defined results: null and empty texts and keys give no row; texts of one line have no heads, numbers or broken words;
repeated rows count once; a broken or odd word without a known form is repaired by the unambiguous characters alone;
one word may be repaired differently at its different places.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.runtime import broadcast_if_small, cut, stored

#: Single characters that stand for one another, mapped to one of them.
SAME_SHAPE = ("ec", "q9g", "l1!|i", "0o", "5s", "@a", "†t")
#: Characters that are read as several, by elementary strokes (after SAME_SHAPE).
STROKES = (("m", "rri"), ("n", "ri"), ("d", "ci"), ("w", "vv"), ("u", "ii"), ("b", "ii"), ("6", "ii"), ("h", "ii"))
#: Ligatures.
LIGATURES = (("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl"))
#: Characters no word has inside, and what they stand for when nothing else is known.
ODD_PLAIN = {"@": "a", "0": "o", "1": "l", "!": "i", "5": "s", "†": "t", "6": "b", "|": "l"}
#: A form is misread when another of its skeleton is this many times as frequent, and itself at least LEAST_USES.
TIMES, LEAST_USES = 8, 3
#: A head without number comes back in this many records, before different next lines.
HEAD_RECORDS = 3
#: A frame is one of heads from this many proven cores on, when they are at least this share of its cores.
FRAME_CORES, FRAME_SHARE = 3, 0.5
HYPHENS = "-‐­¬"

_PAGE_NUMBER = r"^[\s\[\]()–—·.-]*(?:[0-9lIO](?:[ ]?[0-9lIO]){0,5}|[ivxlcdm]{1,9}|[IVXLCDM]{1,9})[\s\[\]()–—·-]*$"
_LEFT_NUMBER = r"^[0-9lIO]{1,4}\s{2,}(?=\S)"
_RIGHT_NUMBER = r"(?<=\S)\s{2,}[0-9lIO]{1,4}$"
#: A run of word characters, the mark of a line break inside a word included.
_RUN = r"[\p{L}0-9@!†|'’␤-]+"
_OUTER = r"^['’-]+|['’|-]+$"


def skeleton(word: Column) -> Column:
    """The word in elementary strokes."""
    apart = reduce(lambda c, s: F.replace(c, F.lit(s[0]), F.lit(s[1])), LIGATURES, F.lower(word))
    single = F.translate(apart, "".join(g[:-1] for g in SAME_SHAPE), "".join(g[-1] * (len(g) - 1) for g in SAME_SHAPE))
    return reduce(lambda c, s: F.replace(c, F.lit(s[0]), F.lit(s[1])), STROKES, single)


def source_key(path: Column) -> Column:
    return F.lower(F.trim(F.regexp_extract(path, r"([^/\\]*)$", 1)))


def scanned_records(pages: DataFrame, candidates: DataFrame) -> DataFrame:
    """(record_table, record_id, source, text) of every text, repeated rows once."""
    a = pages.select(F.lit("page_specs").alias("record_table"), F.col("page_id").alias("record_id"), source_key(F.col("source_file")).alias("source"), F.col("text_preview").alias("text"))
    b = candidates.select(F.lit("support_candidates").alias("record_table"), F.col("pair_id").alias("record_id"), source_key(F.col("source_file")).alias("source"), F.col("fragment_text").alias("text"))
    return a.unionByName(b).where(F.col("record_id").isNotNull() & F.col("text").isNotNull() & (F.length(F.trim("text")) > 0)).distinct()


def _frame(bare: Column) -> Column:
    """The order of numerals (#), short words (themselves), capitals (X, A), other words (w) and punctuation of a line."""
    word = F.transform(
        F.split(bare, r"\s+"),
        lambda x: F.when(x.rlike(r"^(?:(?i:[ivxlcdm1!|]{1,6})|[0-9]{1,4})[:.]?$"), F.concat(F.lit("#"), F.regexp_extract(x, "[:.]?$", 0)))
        .when(F.length(x) <= 3, skeleton(x)).when(x.rlike(r"^[\p{Lu}0-9@!†|'’-]+$"), "X").when(x.rlike(r"^\p{Lu}"), "A").otherwise("w"),
    )
    return F.array_join(word, " ")


def classified_lines(records: DataFrame) -> DataFrame:
    """(record_table, record_id, n, line, t, role): role is body, blank, header or page_number; t is the line trimmed."""
    lines = records.withColumn("ls", F.split("text", "\n")).select(
        "record_table", "record_id", F.coalesce("source", F.lit("")).alias("source"), F.size(F.expr("filter(ls, x -> trim(x) <> '')")).alias("full"),
        F.posexplode(F.expr("transform(ls, (x, i) -> struct(x AS line, try_element_at(ls, i + 2) AS ahead))")).alias("n", "z"),
    ).select("record_table", "record_id", "source", "full", "n", "z.line", "z.ahead")
    t = F.trim(F.regexp_replace("line", r"[\s\xa0]+$", ""))
    # Only short lines of longer texts can be heads or numbers; the patterns are not tried on others.
    short = (F.col("full") > 1) & (F.length("t") <= 90)
    bare = F.when(F.col("short"), F.trim(F.regexp_replace(F.regexp_replace("t", _LEFT_NUMBER, ""), _RIGHT_NUMBER, "")))
    eligible = (F.length("bare") <= 70) & ~F.col("is_number") & F.col("bare").rlike(r"\p{L}{3}.*\s.*\p{L}{2}") & ~F.col("bare").rlike(r"[,;]|[.?!。，；、-]$")
    lines = (
        lines.withColumn("t", t).withColumn("short", short).withColumn("is_number", F.col("short") & F.col("t").rlike(_PAGE_NUMBER)).withColumn("bare", bare)
        .withColumn("core", F.when(eligible, skeleton(F.regexp_replace("bare", r"(?<![\p{L}@!†|])[0-9]+(?![\p{L}@!†|])", "#"))))
        .withColumn("numbered", F.col("core").isNotNull() & (F.col("bare") != F.col("t")) & F.col("bare").rlike(r"\p{L}{2}"))
        .withColumn("frame", F.when(F.col("core").isNotNull(), _frame(F.col("bare"))))
        .withColumn("ahead", F.when(F.col("core").isNotNull(), skeleton(F.substring(F.coalesce("ahead", F.lit("")), 1, 40))))
        .drop("short", "bare")
    )
    lines = stored(lines)
    # One row per record and core first, so that both counts are exact without sets.
    cores = (
        lines.where("core IS NOT NULL").groupBy("source", "core", "record_table", "record_id")
        .agg(F.max("numbered").alias("numbered"), F.min("ahead").alias("low"), F.max("ahead").alias("high"), F.min("frame").alias("frame"))
        .groupBy("source", "core").agg(F.count("*").alias("records"), F.max("numbered").alias("numbered"), (F.min("low") < F.max("high")).alias("differ"), F.min("frame").alias("frame"))
        .withColumn("elsewhere", F.sum("records").over(Window.partitionBy("core")) - F.col("records"))
        .withColumn("proven", F.col("numbered") | ((F.col("records") >= HEAD_RECORDS) & F.col("differ") & (F.col("elsewhere") * 4 <= F.col("records"))))
    )
    cores = cut(cores.select("source", "core", "frame", "proven"))
    frames = cores.groupBy("frame").agg(F.count("*").alias("all"), F.count_if("proven").alias("heads")).where((F.col("heads") >= FRAME_CORES) & (F.col("heads") >= FRAME_SHARE * F.col("all")))
    heads = cores.join(broadcast_if_small(frames.select("frame", F.lit(True).alias("framed"))), "frame", "left").where("proven OR framed").select("source", "core", F.lit(True).alias("known"))
    role = F.when(F.col("t") == "", "blank").when(F.col("is_number"), "page_number").when(F.coalesce("known", F.lit(False)), "header").otherwise("body")
    return lines.join(broadcast_if_small(heads), ["source", "core"], "left").select("record_table", "record_id", "n", "line", "t", role.alias("role"))


def body_lines(lines: DataFrame) -> DataFrame:
    """(record_table, record_id, body, ws): the reflowed text and its lower-case words in order.

    Windows over a record's lines, heads and numbers left out, number the paragraphs and look ahead from a broken word:
    its halves stay one word with a mark where the line broke.
    """
    w = Window.partitionBy("record_table", "record_id").orderBy("n")
    kept = (
        lines.where(F.col("role").isin("body", "blank"))
        .withColumn("paragraph", F.sum((F.col("role") == "blank").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).where("role = 'body'")
        .withColumn("goes_on", F.lead("paragraph").over(w)).withColumn("broken", F.col("t").rlike(r"[\p{L}0-9@!†|][" + HYPHENS + "]$") & F.col("goes_on").isNotNull())
    )
    end = F.when(F.col("broken"), "␤").when(F.col("goes_on") > F.col("paragraph"), "\n\n").otherwise(" ")
    start = F.when(F.lag("broken").over(w), F.ltrim("line")).otherwise(F.col("line"))
    piece = F.concat(F.when(F.col("broken"), F.regexp_replace(F.rtrim(F.regexp_replace(start, r"[\s\xa0]+$", "")), "[" + HYPHENS + "]$", "")).otherwise(start), end)
    texts = kept.withColumn("piece", piece).groupBy("record_table", "record_id").agg(F.array_sort(F.collect_list(F.struct("n", "piece"))).alias("ps"))
    body = F.array_join(F.transform("ps", lambda x: x["piece"]), "")
    words = F.transform(F.regexp_extract_all(F.lower("body"), F.lit(_RUN), F.lit(0)), lambda x: F.regexp_replace(x, _OUTER, ""))
    return texts.select("record_table", "record_id", body.alias("body")).withColumn("ws", words)


def word_occurrences(bodies: DataFrame) -> DataFrame:
    """(record_table, record_id, at, w, prev, next): words with their place; a broken one holds the mark of its break."""
    return bodies.select(
        "record_table", "record_id",
        F.posexplode(F.expr("transform(ws, (x, i) -> struct(x AS w, coalesce(get(ws, i - 1), '') AS prev, coalesce(get(ws, i + 1), '') AS next))")).alias("at", "z"),
    ).select("record_table", "record_id", "at", "z.w", "z.prev", "z.next").where(F.col("w").rlike(r"\p{L}"))


def _odd(w: Column) -> Column:
    """Has a character inside that no word has, beside letters only (no years, ordinals or plate numbers)."""
    return w.rlike(r"[@!†|ﬀﬁﬂﬃﬄ]") | (w.rlike(r"[0156]") & w.rlike(r"^(?:\p{L}|['’-])*[0156](?:\p{L}|['’0156-])*$") & ~w.rlike(r"^[0-9]+(?:st|nd|rd|th|s|a|b|c|d|cm|mm|in|m|e|er|ten|x)?$") & (F.length(F.regexp_replace(w, r"[^\p{L}]", "")) >= 2))


def _plain(w: Column) -> Column:
    apart = reduce(lambda c, s: F.replace(c, F.lit(s[0]), F.lit(s[1])), LIGATURES, w)
    return F.translate(apart, "".join(ODD_PLAIN), "".join(ODD_PLAIN.values()))


def vocabulary(bodies: DataFrame) -> DataFrame:
    """(w, c, s): whole mid-line words with count and skeleton."""
    words = bodies.select(F.explode("ws").alias("w")).groupBy("w").agg(F.count("*").alias("c"))
    return words.where(F.col("w").rlike(r"\p{L}") & ~F.col("w").contains("␤")).withColumn("s", skeleton(F.col("w")))


def repairs(bodies: DataFrame) -> DataFrame:
    """(record_table, record_id, at, noise_kind, repaired) of every misread or broken word, ``at`` its place in ``ws``."""
    occurrences = word_occurrences(bodies)
    place = ["record_table", "record_id", "at"]
    words = cut(vocabulary(bodies))
    good = words.where((F.col("c") >= LEAST_USES) & ~_odd(F.col("w")) & ~F.col("w").rlike("[0-9]") & (F.length("w") >= 2))
    forms = cut(good.groupBy("s").agg(F.sort_array(F.collect_list(F.struct("c", "w")), asc=False).alias("forms")))
    han = F.col("w").rlike(r"[⺀-鿿]")
    # Distinct suspicious words with the frequent forms of their skeleton.
    doubt = (
        words.where(~han & (F.length("w") >= 2)).join(forms, "s", "left")
        .withColumn("forms", F.filter(F.coalesce("forms", F.array().cast("array<struct<c:bigint,w:string>>")), lambda f: (f["w"] != F.col("w")) & (f["c"] >= F.when(_odd(F.col("w")), LEAST_USES).otherwise(F.col("c") * TIMES))))
        # A final '!' is only a letter when a word is known that it completes.
        .where((_odd(F.col("w")) & ~F.col("w").endswith("!")) | ((F.size("forms") > 0) & (F.length("w") >= 3) & ~F.col("w").rlike("[0-9]")))
        .select("w", "forms")
    )
    seen = cut(occurrences.join(broadcast_if_small(doubt), "w"))
    # One frequent form: taken as it is. Several: the one the neighbours support.
    single = seen.where(F.size("forms") <= 1).select(*place, F.coalesce(F.try_element_at("forms", F.lit(1))["w"], _plain(F.col("w"))).alias("repaired"), "w")
    several = seen.where(F.size("forms") > 1).select(*place, "w", "prev", "next", F.explode("forms").alias("f")).select(*place, "w", "prev", "next", F.col("f.w").alias("v"), F.col("f.c").alias("c"))
    asked = several.select(F.col("prev").alias("x"), F.col("v").alias("y")).union(several.select("v", "next")).distinct()
    pairs = (
        bodies.select(F.explode(F.expr("transform(ws, (x, i) -> struct(x AS x, coalesce(get(ws, i + 1), '') AS y))")).alias("z")).select("z.x", "z.y")
        .join(broadcast_if_small(asked), ["x", "y"], "left_semi").groupBy("x", "y").agg(F.count("*").alias("n"))
    )
    pairs = broadcast_if_small(pairs)
    scored = (
        several.join(pairs.withColumnsRenamed({"x": "prev", "y": "v", "n": "before"}), ["prev", "v"], "left")
        .join(pairs.withColumnsRenamed({"x": "v", "y": "next", "n": "after"}), ["v", "next"], "left")
        .withColumn("score", F.log1p(F.coalesce("before", F.lit(0))) * 2 + F.log1p(F.coalesce("after", F.lit(0))) * 2 + F.log("c"))
    )
    chosen = scored.groupBy(*place, "w").agg(F.max_by("v", F.struct("score", "c", "v")).alias("repaired")).select(*place, "repaired", "w")
    misread = single.unionByName(chosen).where(F.col("repaired") != F.col("w")).select(*place, F.lit("misread").alias("noise_kind"), "repaired")
    # Broken words: joined as the corpus writes them mid-line; misread parts by the skeleton of the whole.
    parts = cut(bodies.where(F.col("body").contains("␤")).select("record_table", "record_id", F.posexplode("ws").alias("at", "w")).where(F.col("w").contains("␤") & F.col("w").rlike(r"\p{L}") & ~F.col("w").startswith("␤") & ~F.col("w").endswith("␤")))
    types = parts.select("w").distinct().withColumn("solid", F.replace("w", F.lit("␤"), F.lit(""))).withColumn("dashed", F.replace("w", F.lit("␤"), F.lit("-")))
    known = words.select(F.col("w").alias("k"), F.col("c").alias("n"))
    best = forms.select("s", F.col("forms")[0].alias("top"))
    types = (
        types.join(known.withColumnsRenamed({"k": "solid", "n": "ns"}), "solid", "left").join(known.withColumnsRenamed({"k": "dashed", "n": "nd"}), "dashed", "left")
        .withColumn("ss", skeleton(F.col("solid"))).withColumn("sd", skeleton(F.col("dashed")))
        .join(best.withColumnsRenamed({"s": "ss", "top": "ts"}), "ss", "left").join(best.withColumnsRenamed({"s": "sd", "top": "td"}), "sd", "left")
    )
    ns, nd = F.coalesce("ns", F.lit(0)), F.coalesce("nd", F.lit(0))
    cs, cd = F.coalesce(F.col("ts.c"), F.lit(0)), F.coalesce(F.col("td.c"), F.lit(0))
    joined = (
        F.when((F.greatest(ns, nd) >= 1) & (F.greatest(ns, nd) * TIMES > F.greatest(cs, cd)), F.when(nd > ns, F.col("dashed")).otherwise(F.col("solid")))
        .when(F.greatest(cs, cd) > 0, F.when(cd > cs, F.col("td.w")).otherwise(F.col("ts.w")))
        .otherwise(F.when(_odd(F.col("solid")), _plain(F.col("solid"))).otherwise(F.col("solid")))
    )
    mended = types.select("w", joined.alias("repaired"))
    hyphenated = parts.join(broadcast_if_small(mended), "w").select(*place, F.lit("hyphenation").alias("noise_kind"), "repaired")
    return misread.unionByName(hyphenated)


def found_noise(pages: DataFrame, candidates: DataFrame) -> DataFrame:
    """(record_table, record_id, noise_kind, repaired) of every disturbance."""
    lines = stored(classified_lines(scanned_records(pages, candidates)))
    whole = lines.where(F.col("role").isin("header", "page_number")).select("record_table", "record_id", F.col("role").alias("noise_kind"), F.col("t").alias("repaired"))
    words = repairs(stored(body_lines(lines))).select("record_table", "record_id", "noise_kind", "repaired")
    return whole.unionByName(words).distinct()


def repaired_text(pages: DataFrame, candidates: DataFrame) -> DataFrame:
    """(record_table, record_id, text): continuous paragraphs, without heads and numbers, every word repaired in its place."""
    bodies = stored(body_lines(stored(classified_lines(scanned_records(pages, candidates)))))
    fixes = repairs(bodies).groupBy("record_table", "record_id").agg(F.map_from_entries(F.collect_list(F.struct("at", "repaired"))).alias("fixes"))

    def mend(x: Column, i: Column) -> Column:
        new, core = F.try_element_at("fixes", i), F.regexp_replace(x, _OUTER, "")
        # The first letter keeps its case.
        cased = F.when(F.substring(core, 1, 1).rlike(r"\p{Lu}"), F.concat(F.upper(F.substring(new, 1, 1)), F.substring(new, F.lit(2), F.length(new)))).otherwise(new)
        return F.when(new.isNull(), F.replace(x, F.lit("␤"), F.lit(""))).otherwise(F.concat(F.regexp_extract(x, r"^['’-]*", 0), cased, F.regexp_extract(x, r"['’|-]*$", 0)))

    # Words and what stands between them, zipped again after mending.
    runs = F.transform(F.regexp_extract_all("body", F.lit(_RUN), F.lit(0)), mend)
    mended = F.array_join(F.zip_with(F.split("body", _RUN), runs, lambda gap, run: F.concat(gap, F.coalesce(run, F.lit("")))), "")
    text = F.when(F.col("fixes").isNull(), F.replace("body", F.lit("␤"), F.lit(""))).otherwise(mended)
    rows = bodies.join(fixes, ["record_table", "record_id"], "left")
    return rows.select("record_table", "record_id", F.trim(F.regexp_replace(F.regexp_replace(text, r"[ \t]+", " "), r" ?\n\n ?", "\n\n")).alias("text"))
