"""Text functions as column expressions: tokens, cleaning, sentences, keys, captions, windows.

All stay inside generated code; the few that Spark has no expression for are Arrow-batched pandas UDFs at the end.
Null in, null out, unless a docstring says otherwise.
"""

from __future__ import annotations

import difflib
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

CJK = r"[\x{4e00}-\x{9fff}]"
#: Fixed value: a sentence, up to a Latin or CJK end or a line break.
SENTENCE = r"[^。！？!?；;\n]+[。！？!?；;]?"
#: Fixed value: a figure label.
LABEL = r"(?i:图版|图|圖|figure|fig\.?|plate|pl\.|abb\.|tafel|ill\.)\s*[0-9]+[A-Za-z]?(?:[.-][0-9]+)*"
#: Characters a complete sentence may end with.
SENTENCE_ENDERS = "。！？；.!?;”’》】）)"


def tokens(text: Column) -> Column:
    """Lower-case Latin words and digits, then single CJK characters; null counts as empty."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.concat(F.regexp_extract_all(low, F.lit(r"[a-z0-9_]+"), F.lit(0)), F.regexp_extract_all(low, F.lit(CJK), F.lit(0)))


def word_and_bigram_tokens(text: Column) -> Column:
    """Lower-case Latin words and the bigrams of the text's CJK characters."""
    low = F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))
    han = F.regexp_extract_all(low, F.lit(CJK), F.lit(0))
    pairs = F.when(F.size(han) >= 2, F.transform(F.sequence(F.lit(1), F.size(han) - 1), lambda i: F.concat(F.element_at(han, i), F.element_at(han, i + 1)))).otherwise(han)
    return F.concat(F.regexp_extract_all(low, F.lit(r"[a-z0-9]+"), F.lit(0)), pairs)


def compact(text: Column) -> Column:
    """Without white space, lower case."""
    return F.lower(F.regexp_replace(text, r"(?U)\s+", ""))


def compact_alnum(text: Column) -> Column:
    """Only Latin letters, digits and CJK, lower case, 圖 as 图."""
    return F.lower(F.regexp_replace(F.translate(text, "圖", "图"), r"[^0-9A-Za-z\x{4e00}-\x{9fff}]", ""))


def clean_text(text: Column) -> Column:
    """NUL as blank, runs of blanks and tabs as one, three and more line breaks as two, trimmed."""
    t = F.regexp_replace(text, "\x00", " ")
    t = F.regexp_replace(t, r"[ \t\r\f\x0B]+", " ")
    t = F.regexp_replace(t, r"\n{3,}", "\n\n")
    return F.regexp_replace(t, r"^\s+|\s+$", "")


def normal_space(text: Column) -> Column:
    """White space collapsed to single blanks, trimmed."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def truncated(text: Column, limit: int, mark: str = "...", inside: bool = True) -> Column:
    """At most ``limit`` characters; the mark counts (inside) or is added."""
    t = normal_space(text)
    kept = max(0, limit - len(mark)) if inside else limit
    return F.when(F.length(t) > limit, F.concat(F.substring(t, 1, kept), F.lit(mark))).otherwise(t)


def head_and_tail(text: Column, limit: int, head: int, gap: str = " ... ") -> Column:
    """A long text as its head and as much of its tail as fits."""
    tail = max(0, limit - head - len(gap))
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, head), F.lit(gap), F.substring(text, -tail, tail))).otherwise(text)


def sentences(text: Column) -> Column:
    """Cleaned runs up to a Latin or CJK sentence end, empty ones left out."""
    found = F.regexp_extract_all(clean_text(text), F.lit(SENTENCE), F.lit(0))
    return F.filter(F.transform(found, lambda s: F.trim(s)), lambda s: s != "")


def ends_sentence(text: Column) -> Column:
    """Ends with one of the sentence enders."""
    return clean_text(text).rlike("[" + "".join("\\" + c if c in ".?)" else c for c in SENTENCE_ENDERS) + "]$")


def caption_key(text: Column) -> Column:
    """White space collapsed, lower case."""
    return F.lower(normal_space(text))


def figure_labels(text: Column) -> Column:
    """Distinct figure labels such as Fig. 3, Plate 12a, 图5, without inner blanks, lower case."""
    found = F.regexp_extract_all(text, F.lit(r"(?i)(?:图版|图|圖|figure|fig\.?|plate|pl\.|abb\.|tafel|ill\.)\s*[0-9]+[a-z]?(?:[.-][0-9]+)*"), F.lit(0))
    return F.array_distinct(F.transform(found, lambda x: F.lower(F.regexp_replace(x, r"[\s.]+", ""))))


def title_of(text: Column) -> Column:
    """The first title in 《…》, '' if none."""
    return F.regexp_extract(text, r"《([^》]{1,40})》", 1)


def starts_with_marker(text: Column) -> Column:
    """Starts like a caption."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", "").rlike(r"(?i)^(?:〔?\[?【?图|〔?\[?【?圖|fig\.?|figure|plate|pl\.|abb\.|tafel|ill\.)")


def number_only_caption(text: Column) -> Column:
    """Nothing but a figure number."""
    return F.trim(F.coalesce(text, F.lit(""))).rlike(r"(?i)^(?:图版|图|圖|fig\.?|figure|plate|pl\.|abb\.|tafel|ill\.)\s*[0-9]+[a-z]?(?:[.-][0-9]+)*\s*[.:]?$")


def caption_flags(text: Column) -> Column:
    """Sorted flags of a doubtful caption."""
    t = F.coalesce(text, F.lit(""))
    letters = F.regexp_count(t, F.lit(r"[\p{L}]"))
    return F.array_sort(F.array_compact(F.array(
        F.when(F.trim(t) == "", "empty"),
        F.when(number_only_caption(t), "number_only"),
        F.when((F.length(F.trim(t)) > 0) & (F.length(F.trim(t)) < 12), "too_short"),
        F.when(F.length(t) > 220, "too_long"),
        F.when(t.rlike("^[,.;:，。、；：]"), "starts_inside"),
        F.when((F.length(t) > 0) & (letters < F.length(t) * 0.45), "few_letters"),
    )))


def char_jaccard(a: Column, b: Column) -> Column:
    """Overlap of the sets of CJK characters."""
    x = F.array_distinct(F.regexp_extract_all(F.coalesce(a, F.lit("")), F.lit(CJK), F.lit(0)))
    y = F.array_distinct(F.regexp_extract_all(F.coalesce(b, F.lit("")), F.lit(CJK), F.lit(0)))
    both = F.size(F.array_intersect(x, y))
    return F.when((F.size(x) == 0) | (F.size(y) == 0), F.lit(0.0)).otherwise(both / F.size(F.array_union(x, y)))


def contains_or_overlap(a: Column, b: Column) -> Column:
    """1 when one compact text contains the other, else the overlap of their character sets."""
    x, y = compact(F.coalesce(a, F.lit(""))), compact(F.coalesce(b, F.lit("")))
    p, q = F.array_distinct(F.split(x, "")), F.array_distinct(F.split(y, ""))
    return (
        F.when((x == "") | (y == ""), F.lit(0.0)).when(F.contains(x, y) | F.contains(y, x), F.lit(1.0))
        .otherwise(F.size(F.array_intersect(p, q)) / F.size(F.array_union(p, q)))
    )


def either_contains(a: Column, b: Column) -> Column:
    """Equal, or one inside the other, both not empty after compacting."""
    x, y = compact_alnum(F.coalesce(a, F.lit(""))), compact_alnum(F.coalesce(b, F.lit("")))
    return (x != "") & (y != "") & (F.contains(x, y) | F.contains(y, x))


def safe_name(text: Column) -> Column:
    """A file name: other characters as _, at most 120."""
    return F.substring(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^A-Za-z0-9_.\x{4e00}-\x{9fff}-]+", "_"), 1, 120)


def html_escaped(text: Column) -> Column:
    t = F.replace(text, F.lit("&"), F.lit("&amp;"))
    for raw, name in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        t = F.replace(t, F.lit(raw), F.lit(name))
    return t


def word_ngrams(words: Column, sizes: tuple = (3, 2, 1)) -> Column:
    """Runs of n words joined by blanks, longer ones first."""
    def runs(n: int) -> Column:
        joined = F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.array_join(F.slice(words, i, n), " "))
        return F.when(F.size(words) >= n, joined).otherwise(F.array().cast("array<string>"))

    return F.concat(*[runs(n) for n in sizes])


def sliding_windows(text: Column, size: int, overlap: int) -> Column:
    """Trimmed windows of ``size`` characters every ``size - overlap``, the last one reaching the end."""
    step = size - overlap
    count = F.when(F.length(text) <= size, F.lit(1)).otherwise(F.ceil((F.length(text) - size) / step).cast("int") + 1)
    return F.filter(F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.trim(F.substring(text, i * step + 1, F.lit(size)))), lambda x: x != "")


def around(text: Column, anchor: str, window: int) -> Column:
    """The text within ``window`` characters of the first anchor, its beginning if the anchor is not there."""
    at = F.locate(anchor, text)
    start = F.greatest(at - window, F.lit(1))
    return F.when(at > 0, F.substring(text, start, at - start + F.length(F.lit(anchor)) + window)).otherwise(F.substring(text, F.lit(1), F.lit(2 * window)))


@F.pandas_udf(T.StringType())
def nfkc_key(text: pd.Series) -> pd.Series:
    """Compatibility-normalised, lower case, without punctuation (Spark has no NFKC)."""
    def key(x):
        if x is None:
            return None
        y = unicodedata.normalize("NFKC", x).lower()
        return "".join(c for c in y if not unicodedata.category(c).startswith("P") and not c.isspace())

    return text.map(key)


@F.pandas_udf(T.DoubleType())
def matching_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity of two texts, 0 where one is null or empty."""
    return pd.Series([difflib.SequenceMatcher(None, x, y, autojunk=False).ratio() if x and y else 0.0 for x, y in zip(a, b)])


#: Signs that do not count when two texts are compared.
COMPARED_WITHOUT = "，。、“”‘’：:；;（）()【】[]《》<>|/\\"


@F.pandas_udf(T.DoubleType())
def likeness(a: pd.Series, b: pd.Series) -> pd.Series:
    """1 when one text holds the other, else the larger of matching ratio (first 320 signs) and shared words; 0 for blanks."""
    drop = str.maketrans("", "", COMPARED_WITHOUT)

    def form(x):
        return "".join((x or "").lower().split()).translate(drop)

    def one(x, y):
        x, y = form(x), form(y)
        if not x or not y:
            return 0.0
        if x in y or y in x:
            return 1.0
        p, q = (set(re.findall(r"[\u4e00-\u9fff]{2,}|[a-z0-9]+", v)) for v in (x, y))
        return max(difflib.SequenceMatcher(None, x[:320], y[:320]).ratio(), len(p & q) / max(1, len(p | q)))

    return pd.Series([one(x, y) for x, y in zip(a, b)])
