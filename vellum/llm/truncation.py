"""Text cut off by field limits: a backward character n-gram model of where texts end.

For every final context (the last 1..n characters, read backwards from the end) the model compares how often texts end
there with how often they go on there, over all texts of the language. Orders are interpolated from short to long, each
text's own end left out, into log-odds of ending; a text below the threshold of its language and column, the valley in
the odds of that group, was cut. Rare
capitalised words (names) stand as one symbol, so that a context reaches beyond them, unless they are the last word and
the beginning of a known one. A second run of the same model over word classes keeps rare but complete endings from
being called cut. Field limits show as a pile of texts of one
length that none of the source exceeds and of which many look cut by themselves.

Counts are taken over all positions of all texts by array operations, filtered to contexts in which some text ends and
summed per task before the shuffle. Texts that read the same once normalised are one form, known by its MD5: long text is
shuffled once, counts and odds travel by that key, classes and keys of contexts are computed once a form. Broadcast are that filter (a fixed size) and the words that stand in at least
``KEEP_SHARE`` of all texts, by that share at most words per text / share.

Defined results: null and blank texts or null keys are no records; repeated rows count once; a text that ends with a
final stop is complete unless blanks follow it at the limit; an ellipsis is no final stop, the text before it is judged; ties and empty tables need no special case.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm.key_filter import key_filter, passing
from vellum.runtime import Shelf, broadcast_if_small

CHAR_ORDERS = (1, 2, 3, 5, 8, 12)
CLASS_ORDERS = (1, 2, 3, 4, 6, 8)
#: Weight of the shorter context in the longer one's estimate, and the estimate before any context.
BACK_OFF, BASE_RATE = 2.0, 0.05
#: A word is known from this share of all texts (and at least this many), a function word from the second
#: share or when it is known and that short.
KEEP_SHARE, KEEP_LEAST, FUNCTION_SHARE, FUNCTION_LETTERS = 0.001, 5, 0.08, 3
#: Log-odds between which a language and column's threshold is sought, its steps, the least texts in that range that
#: show a valley, and the threshold where no group shows one.
VALLEY, VALLEY_STEP, VALLEY_TEXTS, NO_VALLEY = (-6.0, 0.0), 0.5, 40, -2.0
#: Class log-odds from which a whole last word is a complete ending whatever its characters say.
EXCUSED = 0.5
#: Texts of exactly the greatest length that make it a limit, and texts a source needs.
LIMIT_PILE, LIMIT_TEXTS = 3, 5
#: Share of the texts of that length that must look cut by themselves: template texts pile up at a length, too.
LIMIT_SHARE = 0.4
#: Keys a task holds before it hands them on.
HELD_KEYS = 2_000_000
#: Contexts of an order that are counted in one array.
DENSE_CONTEXTS = 4_000_000
#: Characters of texts that a kernel reads at a time.
PIECE_CHARS = 1_000_000

_WORD = re.compile(r"[^\W\d_]+")
_HAN = re.compile(r"[⺀-鿿]")
_PAGE_LINE = re.compile(r"\n[ \t]*(?:[\[(–—-]*\s*)?(?:[0-9lIO][0-9lIO ]*|[ivxlcdm]+|[IVXLCDM]+)(?:\s*[\])–—-]*)?\s*$")
_STOP = re.compile(r"[.。!?！？][\"”“»)）\]』」]*$")
#: A mark of omission, which stands where a text was cut as well as where it trails off.
_ELLIPSIS = re.compile(r"\s*(?:[\[(（]\s*)?(?:\.{3,}|(?:\.\s){2,}\.|…+)[\"”“»)）\]』」\s]*$")
_GERMAN = re.compile(r"\b(?:der|die|das|und|ist|nicht|Tafel|Abb|eine|dem|von)\b")

STATE = "record_table string, record_id string, source string, lang string, n int, stopped boolean, torn boolean, trailing boolean, ends_known boolean, chars string"
FORM = "form binary, lang string, chars string, weight bigint, sources bigint, stopped boolean, classes string, ck array<bigint>, wk array<bigint>"


def source_key(path: Column) -> Column:
    return F.lower(F.trim(F.regexp_extract(path, r"([^/\\]*)$", 1)))


def text_records(targets: DataFrame, candidates: DataFrame) -> DataFrame:
    """(record_table, record_id, source, text) of every text that is not blank, repeated rows once."""
    a = targets.select(F.lit("figure_targets").alias("record_table"), F.col("target_id").alias("record_id"), source_key(F.col("source_file")).alias("source"), F.col("base_fields")["caption_text"].alias("text"))
    b = candidates.select(F.lit("support_candidates").alias("record_table"), F.col("pair_id").alias("record_id"), source_key(F.col("source_file")).alias("source"), F.col("fragment_text").alias("text"))
    return a.unionByName(b).where(F.col("record_id").isNotNull() & F.col("text").isNotNull() & (F.length(F.trim("text")) > 0)).distinct()


def known_words(records: DataFrame) -> tuple[set[str], set[str]]:
    """(known words, function words) by the share of distinct texts they stand in."""
    texts = records.select("text").distinct()
    total = records.select(F.unhex(F.md5("text"))).distinct().count()
    least = max(KEEP_LEAST, KEEP_SHARE * total)
    counts = texts.select(F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\p{L}+"), F.lit(0)))).alias("w")).groupBy("w").agg(F.count("*").alias("c")).where(F.col("c") >= least)
    rows = counts.collect()  # at most words per text / KEEP_SHARE
    return {r["w"] for r in rows}, {r["w"] for r in rows if r["c"] >= FUNCTION_SHARE * total or len(r["w"]) <= FUNCTION_LETTERS}


def normal_form(text: str, known: set[str], beginnings: set[str], lowered: set[str]) -> tuple[str, bool]:
    """(text with names as '^' and numbers as 9, is the last word a whole known one)."""
    t = _PAGE_LINE.sub("", text)
    t = re.sub(r"[-­‐¬]\s*\n\s*", "", t)
    t = re.sub(r"\d+", "9", re.sub(r"\s+", " ", t))
    end, shout = len(t), t.upper() == t and t.lower() != t
    last = {"known": True}

    def name(m: re.Match) -> str:
        w = m[0]
        if ord(w[0]) > 0x2E80:
            return w
        if shout:
            return w.lower() if w.lower() in lowered else "^"
        final = m.end() == end
        if w in known:
            return w
        if final and w in beginnings:
            last["known"] = False
            return w
        return w if w[0].islower() else "^"

    return _WORD.sub(name, t), last["known"]


def word_classes(normal: str, functions: set[str]) -> str:
    """The normal form with all but function words as '~' (names stay '^')."""
    out = []
    for w in re.findall(r"\^|[^\W_]+|[^\w\s]", normal):
        out.append(w if w in functions or not w[0].isalpha() or ord(w[0]) > 0x2E80 else "~" if w[0].islower() else "^")
    return " ".join(out)


_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def context_keys(codes: np.ndarray, lengths: np.ndarray, seeds: np.ndarray, orders: tuple) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per order (key, text, is it the end) of every position that has so long a context.

    ``codes`` holds the symbols of all texts one after the other. A context is hashed from sums of powers, so that all
    positions of an order take a few array operations; ``seeds`` (language and kind) and the order are mixed in.
    """
    size = len(codes)
    owner = np.repeat(np.arange(len(lengths)), lengths)
    stop = np.cumsum(lengths)
    inside = np.arange(size) - (stop - lengths)[owner]
    with np.errstate(over="ignore"):
        power, back = np.ones(size + 1, dtype=np.uint64), np.ones(size + 1, dtype=np.uint64)
        power[1:] = np.multiply.accumulate(np.full(size, _BASE, dtype=np.uint64))
        back[1:] = np.multiply.accumulate(np.full(size, _BACK, dtype=np.uint64))
        total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum((codes + np.uint64(1)) * power[:size], dtype=np.uint64)])
        for n in orders:
            at = np.flatnonzero(inside >= n - 1)
            key = (total[at + 1] - total[at + 1 - n]) * back[at + 1 - n]
            yield _mixed(_mixed(key + np.uint64(n)) ^ seeds[owner[at]]).view(np.int64), owner[at], at + 1 == stop[owner[at]]


def _char_codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64), np.array([len(t) for t in texts], dtype=np.int64)


def _class_codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    words = [t.split(" ") for t in texts]
    return np.array([xxhash.xxh64_intdigest(w) for ws in words for w in ws], dtype=np.uint64), np.array([len(ws) for ws in words], dtype=np.int64)


#: The two forms the model reads: column, kind, symbols and orders.
FORMS = (("chars", 1, _char_codes, CHAR_ORDERS), ("classes", 2, _class_codes, CLASS_ORDERS))


def _seeds(langs: list[str], kind: int) -> np.ndarray:
    book = {x: xxhash.xxh64_intdigest(f"{kind}:{x}") for x in set(langs)}
    return np.array([book[x] for x in langs], dtype=np.uint64)


def _pieces(texts: list[str]) -> Iterator[slice]:
    """Slices of about ``PIECE_CHARS`` characters, a longer text alone."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        if held and held + len(t) > PIECE_CHARS:
            yield slice(start, i)
            start, held = i, 0
        held += len(t)
    if start < len(texts):
        yield slice(start, len(texts))


def end_keys(texts: list[str], langs: list[str], kind: int, symbols, orders: tuple) -> list[list[int]]:
    """The keys of every text's final contexts, from the shortest to the longest it has."""
    codes, lengths = symbols(texts)
    out: list[list[int]] = [[] for _ in texts]
    for keys, owner, ends in context_keys(codes, lengths, _seeds(langs, kind), orders):
        for i, k in zip(owner[ends].tolist(), keys[ends].tolist()):
            out[i].append(k)
    return out


def text_states(records: DataFrame, known: set[str]) -> DataFrame:
    """Every record with the form the model reads (columns of ``STATE``) and its key."""
    shared = records.sparkSession.sparkContext.broadcast(known)

    def states(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = shared.value
        beginnings = {w[:i] for w in known for i in range(1, len(w))}
        lowered = {w.lower() for w in known}
        for b in batches:
            out = []
            for table, key, source, text in zip(b["record_table"], b["record_id"], b["source"], b["text"]):
                body = _ELLIPSIS.sub("", _PAGE_LINE.sub("", text))
                normal, whole = normal_form(body, known, beginnings, lowered)
                lang = "zh" if _HAN.search(text) else "de" if len(_GERMAN.findall(text)) >= 2 else "en"
                out.append((
                    table, key, source, lang, len(text), bool(_STOP.search(body.rstrip())), "�" in text.rstrip()[-2:],
                    text != text.rstrip(), whole, normal,
                ))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in STATE.split(", ")])

    return records.mapInPandas(states, STATE).withColumn("form", F.unhex(F.md5(F.concat_ws(":", "lang", "chars"))))


def text_forms(states: DataFrame, texts: DataFrame, functions: set[str]) -> DataFrame:
    """Every distinct form with its weight, its classes and the keys of its ends (columns of ``FORM``)."""
    shared = states.sparkSession.sparkContext.broadcast(functions)

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        functions, longest, words = shared.value, max(CHAR_ORDERS), max(CLASS_ORDERS)
        for b in batches:
            langs = b["lang"].tolist()
            b["classes"] = [word_classes(t, functions) for t in b["chars"]]
            b["ck"] = end_keys([t[-longest:] for t in b["chars"]], langs, 1, _char_codes, CHAR_ORDERS)
            b["wk"] = end_keys([" ".join(t.rsplit(" ", words)[-words:]) for t in b["classes"]], langs, 2, _class_codes, CLASS_ORDERS)
            yield b

    counts = texts.groupBy("form").agg(F.count("*").alias("weight"), F.count_distinct("source").alias("sources"), F.min("stopped").alias("stopped"))
    shapes = states.select("form", "lang", "chars").dropDuplicates(["form"])
    return shapes.join(counts, "form").select("form", "lang", "chars", "weight", "sources", "stopped").mapInPandas(keyed, FORM)


def inner_keys(codes: np.ndarray, lengths: np.ndarray, weights: np.ndarray, seed: int, orders: tuple, seen: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(keys, weights) of the inner contexts that pass the filter, order by order.

    A context can only pass where the shorter one does, so every order reads what the one before left. Short contexts
    over a small alphabet are counted by number, without hashing a position.
    """
    size, seeds = len(codes), np.uint64(seed)
    owner = np.repeat(np.arange(len(lengths)), lengths)
    stop = np.cumsum(lengths)
    inside = np.arange(size) - (stop - lengths)[owner]
    weight = weights[owner].astype(np.float64)
    ids, symbols = pd.factorize(codes)
    wide = max(1, len(symbols))
    with np.errstate(over="ignore"):
        power, back = np.ones(size + 1, dtype=np.uint64), np.ones(size + 1, dtype=np.uint64)
        power[1:] = np.multiply.accumulate(np.full(size, _BASE, dtype=np.uint64))
        back[1:] = np.multiply.accumulate(np.full(size, _BACK, dtype=np.uint64))
        total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum((codes + np.uint64(1)) * power[:size], dtype=np.uint64)])
        # The last position of a text is its end.
        at = np.flatnonzero(np.arange(size) + 1 < stop[owner])
        for n in orders:
            at = at[inside[at] >= n - 1]
            if not len(at):
                return
            if wide**n <= DENSE_CONTEXTS:
                number = np.zeros(len(at), dtype=np.int64)
                for k in range(n - 1, -1, -1):
                    number = number * wide + ids[at - k]
                counts = np.bincount(number, weights=weight[at], minlength=1)
                found = np.flatnonzero(counts)
                plain, rest = np.zeros(len(found), dtype=np.uint64), found.copy()
                for k in range(n - 1, -1, -1):
                    plain += (symbols[rest % wide].astype(np.uint64) + np.uint64(1)) * power[k]
                    rest //= wide
                keys = _mixed(_mixed(plain + np.uint64(n)) ^ seeds).view(np.int64)
                hit = passing(keys, seen)
                yield keys[hit], counts[found][hit].astype(np.int64)
                passed = np.zeros(len(counts), dtype=bool)
                passed[found[hit]] = True
                at = at[passed[number]]
            else:
                keys = _mixed(_mixed((total[at + 1] - total[at + 1 - n]) * back[at + 1 - n] + np.uint64(n)) ^ seeds).view(np.int64)
                hit = passing(keys, seen)
                at = at[hit]
                yield keys[hit], weight[at].astype(np.int64)


def inner_counts(forms: DataFrame, wanted: DataFrame) -> DataFrame:
    """(k, mid): how often the contexts that are wanted stand inside texts, by weight.

    Every inner position is read; positions whose context is no end context are dropped by a filter with false positives
    only, the rest is summed per task before the shuffle. The filter saves work, it decides nothing: the join does.
    """
    bits = forms.sparkSession.sparkContext.broadcast(key_filter(wanted))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = np.frombuffer(bits.value, dtype=np.uint8)
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def summed() -> tuple[np.ndarray, np.ndarray]:
            keys, counts = np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held])
            order = np.argsort(keys)
            keys, counts = keys[order], counts[order]
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, dtype=np.int64)
            return keys[first], np.add.reduceat(counts, first) if len(first) else counts[:0]

        size = 0
        for b in batches:
            for lang, own in b.groupby("lang", sort=True):
                for part in _pieces(own["chars"].tolist()):
                    weights = own["weight"].iloc[part].to_numpy(dtype=np.int64)
                    for column, kind, symbols, orders in FORMS:
                        codes, lengths = symbols(own[column].iloc[part].tolist())
                        for keys, counts in inner_keys(codes, lengths, weights, int(_seeds([lang], kind)[0]), orders, seen):
                            held.append((keys, counts))
                            size += len(keys)
                    if size > 2 * HELD_KEYS:
                        held = [summed()]
                        size = len(held[0][0])
                        if size > HELD_KEYS:
                            yield pd.DataFrame({"k": held[0][0], "mid": held[0][1]})
                            held, size = [], 0
        if held:
            keys, counts = summed()
            yield pd.DataFrame({"k": keys, "mid": counts})

    return forms.select("lang", "chars", "classes", "weight").mapInPandas(run, "k bigint, mid bigint").groupBy("k").agg(F.sum("mid").alias("mid"))


def log_odds(chain: str, alone: Column) -> Column:
    """Log-odds of ending from the (order, stop, mid) of a chain, and from the sources of the whole text.

    Interpolated from the shortest context to the longest, the text's own end left out. The rate of ending and that of
    going on are kept side by side: contexts that end very many texts and stand inside none leave a rate of 1 whose
    complement a double no longer tells from 0.
    """
    step = lambda p, one, other: (one + BACK_OFF * p) / (one + other + BACK_OFF)
    rates = F.aggregate(
        chain, F.struct(F.lit(BASE_RATE).alias("p"), F.lit(1 - BASE_RATE).alias("q")),
        lambda r, x: F.struct(step(r["p"], x["stop"] - 1, x["mid"]).alias("p"), step(r["q"], x["mid"], x["stop"] - 1).alias("q")),
    )
    # Where the form stands alone in many sources, it was not cut in any: the whole text is the longest context.
    return F.log((alone - 1 + BACK_OFF * rates["p"]) / (BACK_OFF * rates["q"]))


def ending_scores(states: DataFrame, functions: set[str], shelf: Shelf) -> DataFrame:
    """(form, char_odds, class_odds): log-odds of ending for every distinct form without final stop."""
    # Texts that differ in names only share a form; they count by source and length.
    texts = shelf.put(states.groupBy("form", "source", "n").agg(F.min("stopped").alias("stopped")))
    forms = shelf.put(text_forms(states, texts, functions))
    # Nothing is left of a text that is an ellipsis or a page line: no context, no odds.
    open_ = forms.where("NOT stopped AND size(ck) > 0")
    wanted = shelf.put(open_.select(F.explode(F.concat("ck", "wk")).alias("k")).distinct())
    # A long context is wanted only where the shortest is; those are few.
    ends = []
    for key in ("ck", "wk"):
        first = broadcast_if_small(open_.select(F.element_at(key, 1).alias("first")).distinct())
        ends.append(forms.where(f"size({key}) > 0").join(first, F.element_at(key, 1) == F.col("first"), "left_semi").select(F.explode(key).alias("k"), "weight"))
    ends = ends[0].unionByName(ends[1]).groupBy("k").agg(F.sum("weight").alias("stop"))
    model = shelf.put(wanted.join(ends, "k").join(inner_counts(forms, wanted), "k", "left").select("k", "stop", F.coalesce("mid", F.lit(0)).alias("mid")))
    shelf.drop(wanted)
    shape = F.unhex(F.md5(F.concat_ws(":", "lang", "classes")))
    class_sources = texts.join(forms.select("form", shape.alias("shape")), "form").groupBy("shape").agg(F.count_distinct("source").alias("class_sources"))
    out = open_.select("form", shape.alias("shape"), "sources", F.element_at("ck", -1).alias("ck"), F.element_at("wk", -1).alias("wk")).join(class_sources, "shape")
    for key, name, alone in (("ck", "char_odds", "sources"), ("wk", "class_odds", "class_sources")):
        # Chains of contexts that share an end are one: the deepest context stands for them.
        chains = open_.select(F.element_at(key, -1).alias("deep"), key).dropDuplicates(["deep"]).select("deep", F.posexplode(key).alias("o", "k"))
        # The shortest contexts are few and on every chain.
        low = model.join(broadcast_if_small(chains.where("o <= 1").select("k").distinct()), "k", "left_semi")
        cells = chains.where("o <= 1").join(broadcast_if_small(low), "k").unionByName(chains.where("o > 1").join(model, "k"))
        met = shelf.put(cells.groupBy("deep").agg(F.array_sort(F.collect_list(F.struct("o", "stop", "mid"))).alias("m")))
        out = out.join(met.withColumnRenamed("deep", key), key).withColumn(name, log_odds("m", F.col(alone))).drop("m")
    out = shelf.put(out.select("form", "char_odds", "class_odds"))
    shelf.drop(texts, forms, model)
    return out


def field_limits(states: DataFrame) -> DataFrame:
    """(record_table, source, limit): a greatest length that piles up."""
    lengths = states.groupBy("record_table", "source", "n").agg(F.count("*").alias("c"))
    most = lengths.groupBy("record_table", "source").agg(F.max(F.struct("n", "c")).alias("m"), F.sum("c").alias("texts"))
    return most.where((F.col("m.c") >= LIMIT_PILE) & (F.col("texts") >= LIMIT_TEXTS)).select("record_table", "source", F.col("m.n").alias("limit"))


def valley(counts: dict[int, int]) -> float | None:
    """The middle of the emptiest stretch of a histogram of log-odds (by step number), None where too little is in range."""
    low, high = (round(x / VALLEY_STEP) for x in VALLEY)
    bins = [counts.get(i, 0) for i in range(low, high)]
    if sum(bins) < VALLEY_TEXTS:
        return None
    least = min(bins)
    # The longest run of emptiest steps; of equal ones the one nearest to even odds.
    runs, i = [], 0
    while i < len(bins):
        j = i
        while j < len(bins) and bins[j] == least:
            j += 1
        if j > i:
            runs.append((j - i, i, j))
        i = max(j, i + 1)
    _, i, j = max(runs)
    return (low + (i + j) / 2) * VALLEY_STEP


def thresholds_of(rows: DataFrame) -> dict[tuple[str, str], float]:
    """Log-odds below which a text counts as cut, by (language, column), from the odds of all texts without final stop.

    Complete and cut texts pile up on either side of a valley; the threshold lies in it. A group with too few texts in
    range takes its language's valley, then that of all texts. At most languages x columns x steps rows are collected.
    """
    low, high = VALLEY
    near = rows.where((F.col("evidence") >= low) & (F.col("evidence") < high) & ~F.col("stopped") & ~F.col("trailing"))
    steps = near.groupBy("lang", "record_table", F.floor(F.col("evidence") / VALLEY_STEP).cast("int").alias("step")).agg(F.count("*").alias("c")).collect()
    sums: dict[tuple[str, str], dict[int, int]] = {}
    for r in steps:
        for key in ((r["lang"], r["record_table"]), (r["lang"], ""), ("", "")):
            own = sums.setdefault(key, {})
            own[r["step"]] = own.get(r["step"], 0) + r["c"]
    found = {k: v for k, h in sums.items() if (v := valley(h)) is not None}
    default = found.get(("", ""), NO_VALLEY)
    return {("", ""): default} | {k: found.get(k, found.get((k[0], ""), default)) for k in sums if k[1]}


def judged_texts(targets: DataFrame, candidates: DataFrame, thresholds: dict | None = None) -> DataFrame:
    """Every record with its odds, its source's limit and whether it was cut; ``thresholds`` replace the derived ones."""
    shelf = Shelf(targets.sparkSession, "zstd")
    records = shelf.put(text_records(targets, candidates))
    known, functions = known_words(records)
    states = shelf.put(text_states(records, known))
    shelf.drop(records)
    limits = field_limits(states)
    odds = ending_scores(states, functions, shelf)
    states = states.drop("chars")
    rows = states.join(odds, "form", "left").join(limits, [states.record_table.eqNullSafe(limits.record_table), states.source.eqNullSafe(limits.source)], "left").select(states["*"], "char_odds", "class_odds", "limit")
    # A word that is broken off, and Chinese, go by characters; a whole last word may also be excused by its class.
    evidence = F.when(~F.col("ends_known") | (F.col("lang") == "zh"), F.coalesce("char_odds", F.lit(0.0))).otherwise(F.when(F.col("class_odds") >= EXCUSED, F.col("class_odds")).otherwise(F.col("char_odds")))
    rows = shelf.put(
        rows.withColumn("evidence", evidence).withColumn("piled", F.coalesce(F.col("n") == F.col("limit"), F.lit(False)))
        .select("record_table", "record_id", "source", "lang", "n", "stopped", "torn", "trailing", "ends_known", "char_odds", "class_odds", "evidence", "limit", "piled")
    )
    derived = {**thresholds_of(rows), **(thresholds or {})}
    at = F.lit(derived["", ""])
    for (lang, column), value in derived.items():
        if lang:
            at = F.when((F.col("lang") == lang) & (F.col("record_table") == column), F.lit(value)).otherwise(at)
    rows = rows.withColumn("own", F.coalesce(F.col("torn") | (~F.col("stopped") & (F.col("trailing") | (F.col("evidence") < at))), F.lit(False)))
    limited = rows.where("piled").groupBy(F.col("record_table").alias("lt"), F.col("source").alias("ls")).agg(F.avg(F.col("own").cast("double")).alias("share")).where(F.col("share") >= LIMIT_SHARE).select("lt", "ls", F.lit(True).alias("limited"))
    judged = rows.join(limited, F.col("record_table").eqNullSafe(F.col("lt")) & F.col("source").eqNullSafe(F.col("ls")), "left").withColumn("limited", F.coalesce("limited", F.lit(False)))
    at_limit = F.col("piled") & F.col("limited")
    return (
        judged.withColumn("at_limit", at_limit).withColumn("limit", F.when(F.col("limited"), F.col("limit")))
        .withColumn("was_cut", F.col("own") | (at_limit & (~F.col("stopped") | F.col("trailing")))).drop("lt", "ls", "limited", "piled", "own")
    )


def found_cuts(targets: DataFrame, candidates: DataFrame) -> DataFrame:
    """(record_table, record_id) of every cut text."""
    return judged_texts(targets, candidates).where("was_cut").select("record_table", "record_id").distinct()


def cut_rates(targets: DataFrame, candidates: DataFrame) -> DataFrame:
    """Texts, cut texts and their rate per column and source."""
    rows = judged_texts(targets, candidates)
    return rows.groupBy("record_table", "source").agg(
        F.count("*").alias("texts"), F.count_if("was_cut").alias("cut_texts"), F.round(F.avg(F.col("was_cut").cast("double")), 6).alias("cut_rate"), F.max("limit").alias("field_limit")
    )
