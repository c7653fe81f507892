"""Mapping of freely entered values to a canonical list: symmetric-delete dictionary, weighted Damerau-Levenshtein.

Only distinct values are looked up (pre-aggregated per list and value). Every word of the list's names is entered under
all forms with up to ``MAX_EDITS`` letters deleted, so a value's word finds its candidates by its own deletions; Chinese
names are entered whole in the same way. Candidates are verified by weighted Damerau-Levenshtein; an entry is meant when
all its telling words are found (or all but one, if nothing else in the value is left unexplained and no second entry
fits as well). Ranking: cost of edits, missing and unexplained words, then how often the entry is written exactly.

A list of up to ``BROADCAST_ENTRIES`` entries is broadcast as dictionaries. A longer one is joined: values and entries
meet on shared deletions of the two rarest words of every entry - the necessary prefix, since at most one word may be
missing - and every value is then decided among its own candidates by the same rule.

Defined results: null, blank and placeholder values and abstained ones are no case; values written exactly like an
entry are no case; a value that fits no entry, or two equally well that are written equally often, is reported with
entry_id -1; repeated rows count once; reference rows without a name are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.runtime import broadcast_if_small, cut, stored

FIELDS = {"collection_institution": "institution", "creation_period_or_dynasty": "period", "medium_material": "medium"}
PLACEHOLDERS = ("n/a", "unknown", "-")
MAX_EDITS = 2
#: The reference list is broadcast as dictionaries up to this many rows (counted); a longer one is joined.
BROADCAST_ENTRIES = 50_000
#: Words a worker remembers the candidates of.
REMEMBERED = 200_000
#: Words that tell nothing about which entry is meant.
FUNCTION_WORDS = frozenset("the a an of for at on upon and with to f de du der und et from now".split())
GENERIC_WORDS = frozenset("dynasty period era dyn reign".split())
#: Traditional characters and their simplified forms.
SIMPLIFIED = str.maketrans("絹紙綾設畫館書國庫學廊軸圖會繪術寶漆綠繡彩聯齋藝閣樓橋灣嶼峽瀾靄嵐筆觀廳縣鎮齊龍風歷東蘇櫟滄蒼樺", "绢纸绫设画馆书国库学廊轴图会绘术宝漆绿绣彩联斋艺阁楼桥湾屿峡澜霭岚笔观厅县镇齐龙风历东苏栎沧苍桦")
_CJK = re.compile(r"[㐀-鿿]")
_KEPT = re.compile(r"(?:现藏于|藏于|收藏|旧藏|藏)")


def plain(text: str) -> str:
    """Compatibility forms folded, accents and case removed, blanks collapsed."""
    text = unicodedata.normalize("NFKD", text.replace("ß", "ss")).casefold()
    text = "".join(c for c in text if not unicodedata.combining(c))
    return " ".join(unicodedata.normalize("NFKC", text).translate(SIMPLIFIED).split())


def words(text: str) -> list[tuple[str, bool]]:
    """(word, abbreviated) of a plain text; words in brackets are left out."""
    text = re.sub(r"\([^)]*\)?|\[[^\]]*\]?", " ", text)
    return [(m[1], bool(m[2])) for m in re.finditer(r"([^\W_]+)(\.?)", text)]


def deletions(word: str, edits: int) -> set[str]:
    """The word and all its forms with up to ``edits`` letters deleted."""
    forms, layer = {word}, {word}
    for _ in range(edits):
        layer = {w[:i] + w[i + 1 :] for w in layer for i in range(len(w))}
        forms |= layer
    return forms


def edits_allowed(length: int) -> int:
    return 0 if length < 3 else 1 if length < 6 else MAX_EDITS


def weighted_distance(a: str, b: str, limit: float) -> float:
    """Damerau-Levenshtein; doubled letters and transpositions cost less than other edits, the first letter more."""
    if a == b:
        return 0.0
    if abs(len(a) - len(b)) > limit + 1:
        return limit + 1
    before, row = None, [1.0 * j for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        old, row_ = row, [i * 1.0]
        for j, y in enumerate(b, 1):
            drop = 0.7 if i > 1 and a[i - 2] == x else 1.0
            put = 0.7 if j > 1 and b[j - 2] == y else 1.0
            best = min(old[j] + drop, row_[j - 1] + put, old[j - 1] + (0.0 if x == y else 1.2 if i == j == 1 else 1.0))
            if before is not None and j > 1 and x == b[j - 2] and a[i - 2] == y and x != y:
                best = min(best, before[j - 2] + 0.8)
            row_.append(best)
        before, row = old, row_
    return row[-1]


def abbreviates(short: str, word: str) -> bool:
    """A prefix, or letters in order that keep the first one (natl for national, fdn for foundation)."""
    if not short or short[0] != word[0] or len(short) >= len(word):
        return False
    if word.startswith(short):
        return True
    it = iter(word)
    return len(short) >= 2 and all(c in it for c in short)


def han_form(text: str) -> str:
    """The characters of a plain Chinese value."""
    return re.sub(r"[\s,;:.·、，。；：()（）]", "", text)


class Reference:
    """Lookup structures of one list of the reference, or of the candidates of one value."""

    def __init__(self, rows: list[tuple[int, str, str | None, int]], signs: frozenset = frozenset()):
        self.exact: dict[str, int] = {}
        self.han: dict[str, int] = {}
        self.entries: dict[int, list[str]] = {}
        self.uses: dict[int, int] = {}
        self.holders: dict[str, set[int]] = {}
        for entry, name, alt, uses in sorted(rows, key=lambda r: r[0]):
            text = plain(name)
            self.exact.setdefault(text, entry)
            self.uses[entry] = uses
            if alt:
                self.han.setdefault(han_form(plain(alt)), entry)
            self.entries[entry] = telling_words(text)
            for w in self.entries[entry]:
                self.holders.setdefault(w, set()).add(entry)
        self.seen: dict[tuple[str, bool], dict[str, float]] = {}
        self.deleted: dict[str, set[str]] = {}
        for w in self.holders:
            for d in deletions(w, edits_allowed(len(w))):
                self.deleted.setdefault(d, set()).add(w)
        self.han_signs = signs or {c for w in self.han for c in w}
        self.han_deleted: dict[str, set[str]] = {}
        for w in self.han:
            for d in deletions(w, han_edits(len(w))):
                self.han_deleted.setdefault(d, set()).add(w)

    def near(self, word: str, abbreviated: bool) -> dict[str, float]:
        """Reference words the word may stand for, with cost."""
        if (word, abbreviated) in self.seen:
            return self.seen[word, abbreviated]
        out: dict[str, float] = {}
        for d in deletions(word, edits_allowed(len(word) + 1)):
            for w in self.deleted.get(d, ()):
                limit = edits_allowed(max(len(w), len(word)))
                if w not in out and (c := weighted_distance(word, w, limit)) <= limit:
                    out[w] = c
        if abbreviated:
            for w in self.holders:
                if abbreviates(word, w):
                    out[w] = min(out.get(w, 9.0), 0.3)
        if len(self.seen) >= REMEMBERED:
            self.seen.clear()
        self.seen[word, abbreviated] = out
        return out

    def han_meant(self, text: str) -> int:
        """The entry of a Chinese value: its name, or the only one an edit away; -1 if none or several.

        Names of a list often differ by one character that both use; such a character is another name, not an error.
        """
        bare = han_form(text)
        forms = (bare, _KEPT.sub("", bare))
        for form in forms:
            if form in self.han:
                return self.han[form]
        for form in forms:
            near = {
                w for d in deletions(form, han_edits(len(form) + 1)) for w in self.han_deleted.get(d, ())
                if weighted_distance(form, w, 1) <= 1.2 and (len(form) != len(w) or any(x not in self.han_signs for x, y in zip(form, w) if x != y) or sorted(form) == sorted(w))
            }
            if near:
                return self.han[near.pop()] if len(near) == 1 else -1
        return -1

    def meant(self, value: str, heard: frozenset = frozenset()) -> int:
        """The entry a value means, or -1; ``heard`` are words of the value that entries beyond these know."""
        text = plain(value)
        if _CJK.search(text):
            return self.han_meant(text)
        if text.strip(" .,;:?") in self.exact:
            return self.exact[text.strip(" .,;:?")]
        given = [(w, a) for w, a in words(text)]
        options = [self.near(w, a) if w not in FUNCTION_WORDS or len(w) > 3 else {} for w, a in given]
        candidates = {e for o in options for w in o for e in self.holders[w]}
        ranked = []
        for e in candidates:
            need, used, cost, missing = self.entries[e], set(), 0.0, []
            for w in need:
                fits = sorted((o[w], i) for i, o in enumerate(options) if w in o and i not in used)
                if fits:
                    cost += fits[0][0]
                    used.add(fits[0][1])
                else:
                    missing.append(w)
            if missing and (len(need) < 3 or len(missing) > 1):
                continue
            loose = [w for i, (w, a) in enumerate(given) if i not in used and w not in FUNCTION_WORDS and w not in GENERIC_WORDS and len(w) > 2]
            if missing and loose:
                continue
            if cost > 0.5 * MAX_EDITS * len(need) + 1:
                continue
            # A value's loose words that other entries would explain count against this one.
            known = sum(1 for i, o in enumerate(options) if i not in used and (o or given[i][0] in heard))
            ranked.append((len(missing), known, round(cost, 6), -len(need), -self.uses[e], e))
        if not ranked:
            return -1
        ranked.sort()
        if len(ranked) > 1 and (ranked[0][:5] == ranked[1][:5] or (ranked[0][0] and ranked[0][:3] == ranked[1][:3])):
            return -1
        return ranked[0][-1]


def telling_words(text: str) -> list[str]:
    """The words of a plain name that tell which entry it is; words like 'era' count only where there is no other."""
    told = [w for w, _ in words(text) if w not in FUNCTION_WORDS]
    return [w for w in told if w not in GENERIC_WORDS] or told


def han_edits(length: int) -> int:
    return 0 if length < 4 else 1


def free_values(targets: DataFrame) -> DataFrame:
    """(target_id, list_name, value) of every stated value of the mapped fields."""
    rows = []
    for field, list_name in FIELDS.items():
        cell = F.col("metadata_fields")[field]
        rows.append(targets.select("target_id", F.lit(list_name).alias("list_name"), cell["value"].alias("value"), cell["abstain"].alias("abstain")))
    out = rows[0].unionByName(rows[1]).unionByName(rows[2])
    blank = r"^[\s\x{a0}\x{3000}]*$"
    return (
        out.where(F.col("target_id").isNotNull() & F.col("value").isNotNull() & ~F.coalesce("abstain", F.lit(False)))
        .where(~F.col("value").rlike(blank) & ~F.lower(F.trim("value")).isin(*PLACEHOLDERS))
        .select("target_id", "list_name", "value").distinct()
    )


def mapped_values(targets: DataFrame, entries: DataFrame, limit: int = BROADCAST_ENTRIES) -> DataFrame:
    """(target_id, list_name, value, entry_id) of every value that is not written exactly like an entry."""
    values = stored(free_values(targets))
    names = entries.where("entry_id IS NOT NULL AND entry_name IS NOT NULL").select("entry_id", "list_name", "entry_name", "entry_alt").dropDuplicates(["entry_id"])
    counted = values.groupBy("list_name", "value").agg(F.count("*").alias("uses"))
    used = cut(names.join(counted, (names.list_name == counted.list_name) & (names.entry_name == counted.value), "left").select(names.entry_id, names.list_name, "entry_name", "entry_alt", F.coalesce("uses", F.lit(0)).alias("uses")))
    distinct = counted.join(names.select("list_name", F.col("entry_name").alias("value")).distinct(), ["list_name", "value"], "left_anti").select("list_name", "value")
    book = _by_broadcast(distinct, used) if used.limit(limit + 1).count() <= limit else _by_join(distinct, used)
    # A value typed by a third of all rows is one row of the book.
    return values.join(broadcast_if_small(book), ["list_name", "value"]).select("target_id", "list_name", "value", "entry_id")


BOOK = "list_name string, value string, entry_id bigint"


def _by_broadcast(distinct: DataFrame, used: DataFrame) -> DataFrame:
    """Every distinct value decided against the whole list, which was counted."""
    lists: dict[str, list] = {}
    for r in used.collect():
        lists.setdefault(r["list_name"], []).append((r["entry_id"], r["entry_name"], r["entry_alt"], r["uses"]))
    shared = distinct.sparkSession.sparkContext.broadcast(lists)

    def look_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        books = {k: Reference(v) for k, v in shared.value.items()}
        none = Reference([])
        for b in batches:
            yield b.assign(entry_id=[books.get(l, none).meant(v) for l, v in zip(b["list_name"], b["value"])])

    return distinct.mapInPandas(look_up, BOOK)


def value_keys(value: str) -> set[str]:
    """What a value may share with an entry that it means: its whole form or deletions of its words."""
    text = plain(value)
    if _CJK.search(text):
        bare = han_form(text)
        return {"z:" + d for form in (bare, _KEPT.sub("", bare)) for d in deletions(form, han_edits(len(form) + 1))}
    keys = {"x:" + text.strip(" .,;:?")}
    for w, _ in words(text):
        if w not in FUNCTION_WORDS or len(w) > 3:
            keys |= {"d:" + d for d in deletions(w, edits_allowed(len(w) + 1))}
    return keys


def entry_keys(name: str, alt: str | None, rare: list[str]) -> set[str]:
    """The keys of an entry: its whole forms and the deletions of its rarest words."""
    keys = {"x:" + plain(name)}
    if alt:
        bare = han_form(plain(alt))
        keys |= {"z:" + d for d in deletions(bare, han_edits(len(bare)))}
    for w in rare:
        keys |= {"d:" + d for d in deletions(w, edits_allowed(len(w)))}
    return keys


def _by_join(distinct: DataFrame, used: DataFrame) -> DataFrame:
    """Every distinct value decided among the entries it shares a key with, by joins of any size."""
    strings = "array<string>"

    @F.pandas_udf(strings)
    def keys_of_value(v: pd.Series) -> pd.Series:
        return v.map(lambda x: sorted(value_keys(x)))

    @F.pandas_udf(strings)
    def words_of_name(v: pd.Series) -> pd.Series:
        return v.map(lambda x: telling_words(plain(x)))

    @F.pandas_udf(strings)
    def keys_of_entry(name: pd.Series, alt: pd.Series, rare: pd.Series) -> pd.Series:
        return pd.Series([sorted(entry_keys(n, a, list(r) if r is not None else [])) for n, a, r in zip(name, alt, rare)])

    @F.pandas_udf(strings)
    def forms_of_word(v: pd.Series) -> pd.Series:
        return v.map(lambda w: sorted(deletions(w, edits_allowed(len(w)))))

    @F.pandas_udf("array<struct<w:string,short:boolean,forms:array<string>>>")
    def words_of_value(v: pd.Series) -> pd.Series:
        return v.map(lambda x: [] if _CJK.search(plain(x)) else [{"w": w, "short": a, "forms": sorted(deletions(w, edits_allowed(len(w) + 1)))} for w, a in set(words(plain(x))) if w not in FUNCTION_WORDS or len(w) > 3])

    @F.pandas_udf("boolean")
    def close(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([weighted_distance(x, y, edits_allowed(max(len(x), len(y)))) <= edits_allowed(max(len(x), len(y))) for x, y in zip(a, b)])

    # The two rarest words of every entry, by how many entries of the list hold them.
    told = stored(used.select("entry_id", "list_name", F.explode(words_of_name("entry_name")).alias("w")).distinct())
    often = stored(told.groupBy("list_name", "w").agg(F.count("*").alias("n")))
    rank = F.row_number().over(Window.partitionBy("entry_id").orderBy("n", "w"))
    rare = told.join(often, ["list_name", "w"]).withColumn("r", rank).where("r <= 2").groupBy("entry_id").agg(F.collect_list("w").alias("rare"))
    known = stored(used.join(rare, "entry_id", "left"))
    by_key = known.select("entry_id", "list_name", F.explode(keys_of_entry("entry_name", "entry_alt", "rare")).alias("k"))
    met = distinct.withColumn("k", F.explode(keys_of_value("value"))).join(by_key, ["list_name", "k"]).select("list_name", "value", "entry_id")
    # What words of values stand for: close words of the list, or words that keep the letters of an abbreviation in order.
    typed = stored(distinct.select("list_name", "value", F.explode(words_of_value("value")).alias("z")).select("list_name", "value", "z.*"))
    asked = typed.groupBy("list_name", F.col("w").alias("v"), "short").agg(F.any_value("forms").alias("forms"))
    near = asked.select("list_name", "v", F.explode("forms").alias("d")).join(often.select("list_name", "w", F.explode(forms_of_word("w")).alias("d")), ["list_name", "d"]).select("list_name", "v", "w").distinct().where(close("v", "w"))
    in_order = F.expr("concat('^', array_join(transform(split(v, ''), c -> concat(c, '.*')), ''))")
    stands_for = (
        asked.where("short").select("list_name", "v").distinct().withColumn("h", F.substring("v", 1, 1))
        .join(often.select("list_name", "w").withColumn("h", F.substring("w", 1, 1)), ["list_name", "h"])
        .where((F.length("v") < F.length("w")) & F.rlike(F.col("w"), in_order) & ((F.length("v") >= 2) | F.col("w").startswith(F.col("v")))).select("list_name", "v", "w")
    )
    stands_for = stored(stands_for)
    heard = near.select("list_name", "v").unionByName(stands_for.select("list_name", "v")).distinct()
    heard = typed.select("list_name", "value", F.col("w").alias("v")).join(heard, ["list_name", "v"]).groupBy("list_name", "value").agg(F.collect_set("v").alias("heard"))
    rare_words = known.select("list_name", "entry_id", F.explode("rare").alias("w"))
    shortened = typed.where("short").select("list_name", "value", F.col("w").alias("v")).join(stands_for, ["list_name", "v"]).join(rare_words, ["list_name", "w"]).select("list_name", "value", "entry_id")
    candidates = met.unionByName(shortened).distinct().join(known.select("entry_id", "entry_name", "entry_alt", "uses"), "entry_id").join(heard, ["list_name", "value"], "left")
    # The signs the Chinese names of a list use: at most as many as there are characters.
    signs: dict[str, frozenset] = {}
    for r in used.where("entry_alt IS NOT NULL").select("list_name", F.explode(F.split("entry_alt", "")).alias("c")).distinct().groupBy("list_name").agg(F.collect_list("c").alias("cs")).collect():
        signs[r["list_name"]] = frozenset(plain("".join(r["cs"])))

    def decide(pdf: pd.DataFrame) -> pd.DataFrame:
        name, value, heard = pdf["list_name"].iloc[0], pdf["value"].iloc[0], pdf["heard"].iloc[0]
        book = Reference(list(zip(pdf["entry_id"], pdf["entry_name"], pdf["entry_alt"], pdf["uses"])), signs.get(name, frozenset()))
        return pd.DataFrame({"list_name": [name], "value": [value], "entry_id": [book.meant(value, frozenset(heard if heard is not None else ()))]})

    decided = candidates.groupBy("list_name", "value").applyInPandas(decide, BOOK)
    return distinct.join(decided, ["list_name", "value"], "left").select("list_name", "value", F.coalesce("entry_id", F.lit(-1).cast("bigint")).alias("entry_id"))


def found_entries(targets: DataFrame, entries: DataFrame) -> DataFrame:
    """(target_id, list_name, entry_id), -1 where no entry is meant."""
    return mapped_values(targets, entries).select("target_id", "list_name", "entry_id").distinct()
