"""Values derived from captions, fields and scores, as column expressions. Null in, null out, unless a docstring says otherwise."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from vellum.functions import text as T

HAN = r"[\x{4e00}-\x{9fff}]"
#: Terms that name nothing, and how many terms of a text count.
EMPTY_TERMS, MOST_TERMS = ("中国", "山水", "山水画", "作品", "图像", "论文"), 20
#: Values that stand for none, and the signs around them that do not count.
PLACEHOLDERS = ("", "na", "n/a", "none", "null", "unknown", "unspecified", "not specified", "not mentioned", "not shown", "missing", "无", "无法判断", "没有", "不详", "不明", "未详", "未知", "未注明", "未提及", "未说明")
PLACEHOLDER_EDGES = " \t\r\n.,;:!?()[]{}<>\"'。，；：！？（）【】"
#: One name per period.
PERIOD_NAMES = {"明代": "明", "Ming dynasty": "明", "宋代": "宋", "Song dynasty": "宋", "Northern Song": "北宋", "Southern Song": "南宋", "元代": "元", "Yuan dynasty": "元", "清代": "清", "Qing dynasty": "清", "唐代": "唐", "Tang dynasty": "唐", "金代": "金"}
#: Tags by a word of title or topics.
SCHOOL_TAGS = (
    ("李郭", "li_guo_tradition"), ("董巨", "dong_ju_tradition"), ("马夏", "ma_xia_school"), ("元四家", "yuan_four_masters"), ("吴门", "wu_school"), ("浙派", "zhe_school"), ("松江", "songjiang_school"),
    ("南北宗", "southern_northern_school_theory"), ("南宗", "southern_school_theory"), ("北宗", "northern_school_theory"), ("四王", "four_wangs"), ("清初四王", "four_wangs"), ("四僧", "four_monks"), ("清初四僧", "four_monks"),
    ("扬州", "yangzhou_school"), ("正统派", "orthodox_school"), ("文人画", "literati_painting"), ("青绿", "blue_green_landscape"), ("巨碑", "monumental_landscape"), ("园林", "garden_landscape"), ("近现代", "modern_ink"),
)
#: Words of a caption by what it shows, in the order they are tried; materials, whole ones before their parts.
SCOPE_WORDS = (("partial_detail", ("局部", "截取", "基础上进行截取")), ("scroll_section", ("之一", "其一", "一段")), ("album_leaf", ("图册", "册页")))
MATERIALS = ("绢本设色", "绢本水墨", "纸本设色", "纸本水墨", "卷绢")
PART_MATERIALS = (("绢本", ("绢本设色", "绢本水墨")), ("纸本", ("纸本设色", "纸本水墨")), ("水墨", ("绢本水墨", "纸本水墨")), ("设色", ("绢本设色", "纸本设色")))
AUTHORITY_WEIGHT = {"A+": 1.2, "A": 1.0, "A-": 0.85, "B": 0.55, "C": 0.25}


def _any(text: Column, words) -> Column:
    return reduce(lambda a, w: a | F.contains(text, F.lit(w)), words, F.lit(False))


def important_terms(text: Column) -> Column:
    """Titles in 《》 and runs of 2 to 8 Chinese signs, compact, once each, those that name nothing left out."""
    found = F.regexp_extract_all(text, F.lit(rf"《[^》]{{1,32}}》|{HAN}{{2,8}}"), F.lit(0))
    bare = F.transform(found, lambda x: F.regexp_replace(x, "^《|》$", ""))
    kept = F.transform(F.filter(bare, lambda x: ~x.isin(*EMPTY_TERMS)), T.compact)
    return F.slice(F.array_distinct(kept), 1, MOST_TERMS)


def is_placeholder(value: Column) -> Column:
    """Null, blank or a word that stands for none, signs around it aside."""
    plain = F.regexp_replace(F.lower(F.trim(F.coalesce(value, F.lit("")))), r"[\s\x{3000}]+", " ")
    edge = "[" + "".join("\\" + c if c in ".[](){}?!\\^$-" else c for c in PLACEHOLDER_EDGES) + "]+"
    return F.regexp_replace(plain, f"^{edge}|{edge}$", "").isin(*PLACEHOLDERS)


def field_value(field: Column, value: Column) -> Column:
    """A value as it is compared: sizes without blanks and with one sign, periods by one name, the rest compact."""
    plain = T.normal_space(F.coalesce(value, F.lit("")))
    size = reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), (("×", "x"), ("*", "x"), ("厘米", "cm"), ("公分", "cm")), F.regexp_replace(F.lower(plain), r"(?U)\s+", ""))
    names = F.create_map(*[F.lit(x) for kv in PERIOD_NAMES.items() for x in kv])
    return F.when(plain == "", "").when(field == "dimensions", size).when(field == "creation_period_or_dynasty", F.coalesce(F.try_element_at(names, plain), plain)).otherwise(T.compact_alnum(plain))


def joined_lines(lines: Column) -> Column:
    """Lines as one text; a blank only where one side is Latin or a digit."""
    filled = F.filter(F.transform(lines, T.normal_space), lambda x: x != "")
    step = lambda a, x: F.when(a == "", x).otherwise(F.concat(a, F.when(x.rlike("^[A-Za-z0-9]") | a.rlike("[A-Za-z0-9]$"), " ").otherwise(""), x))
    return F.aggregate(filled, F.lit(""), step)


def packed_sentences(text: Column, short: int = 360, room: int = 460, most: int = 6) -> Column:
    """Sentences joined while they fit into ``room`` characters, the first ``most`` (their number is the feature)."""
    parts = F.filter(F.transform(F.split(text, r"(?<=[。！？.!?；;])\s+|\n+"), T.normal_space), lambda x: x != "")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))
    fits = lambda s, x: F.length(s["open"]) + F.length(x) <= room
    step = lambda s, x: F.when(fits(s, x), F.struct(s["done"].alias("done"), F.trim(F.concat(s["open"], F.lit(" "), x)).alias("open"))).otherwise(F.struct(F.when(s["open"] != "", F.array_append(s["done"], s["open"])).otherwise(s["done"]).alias("done"), x.alias("open")))
    packed = F.aggregate(parts, start, step, lambda s: F.when(s["open"] != "", F.array_append(s["done"], s["open"])).otherwise(s["done"]))
    return F.when(F.length(text) <= short, F.array(text)).otherwise(F.slice(F.when(F.size(parts) == 0, F.array(F.substring(text, 1, 900))).otherwise(packed), 1, most))


def snippet(text: Column, soft: int = 360) -> Column:
    """Whole sentences up to ``soft`` characters and the next sentence end, at most about twice as many."""
    clean = T.clean_text(text)
    parts = T.sentences(text)
    # Where the text may end: after the first sentence that reaches the soft limit with an end, or the hard one.
    upto = F.aggregate(parts, F.lit(""), lambda a, x: F.when((F.length(a) >= soft) & (T.ends_sentence(a) | (F.length(a) >= 2 * soft)), a).otherwise(F.concat(a, x)))
    return F.when(F.length(clean) <= soft, clean).otherwise(upto)


def school_tags(text: Column) -> Column:
    """The tags whose word stands in the text, once each, in the order of the rules."""
    return F.array_distinct(F.array_compact(F.array(*[F.when(F.contains(text, F.lit(w)), F.lit(t)) for w, t in SCHOOL_TAGS])))


def shown_scope(caption: Column, title: Column) -> Column:
    """What of a work a caption says is shown; the whole where only a title is known; '' else."""
    c = F.coalesce(caption, F.lit(""))
    out = F.when(F.coalesce(title, F.lit("")) != "", "full_work").otherwise("")
    for name, words in reversed(SCOPE_WORDS):
        out = F.when(_any(c, words), name).otherwise(out)
    return out


def object_kind(caption: Column, scope: Column, title: Column) -> Column:
    """The kind of object by scope, then by the caption's word for its mounting."""
    c = F.coalesce(caption, F.lit(""))
    return (
        F.when(scope == "partial_detail", "detail_crop").when(scope.isin("scroll_section", "album_leaf"), scope).when(F.contains(c, F.lit("轴")), "hanging_scroll").when(F.contains(c, F.lit("卷")), "handscroll")
        .when(F.coalesce(title, F.lit("")) != "", "painting_or_figure").otherwise("")
    )


def materials(caption: Column) -> Column:
    """Materials and sizes a caption names, joined; a part only where no whole one with it stands there."""
    c = T.normal_space(F.coalesce(caption, F.lit("")))
    whole = [F.when(F.contains(c, F.lit(m)), F.lit(m)) for m in MATERIALS]
    parts = [F.when(F.contains(c, F.lit(p)) & ~_any(c, ws), F.lit(p)) for p, ws in PART_MATERIALS]
    sizes = F.regexp_extract_all(c, F.lit(r"[0-9]+(?:\.[0-9]+)?\s*[xX×]\s*[0-9]+(?:\.[0-9]+)?\s*(?:cm|厘米)"), F.lit(0))
    return F.array_join(F.array_distinct(F.concat(F.array_compact(F.array(*whole, *parts)), sizes)), "；")


def page_score(images: Column, anchors: Column, terms: Column, hints: Column, noisy: Column) -> Column:
    """How much a page promises; fixed weights."""
    return images * 25 + anchors * 8 + terms * 2 + hints * 3 - F.when(noisy, 40).otherwise(0)


def region_score(embedded: Column, caption: Column, area: Column, text_share: Column) -> Column:
    """How likely a region is a figure; fixed weights; a missing caption score counts as the worst."""
    return (
        F.when(embedded, 4.0).otherwise(1.2) + F.least(F.greatest(F.coalesce(caption, F.lit(-999.0)), F.lit(-2.0)), F.lit(8.0)) + 2.0 * F.least(F.lit(1.0), F.coalesce(area, F.lit(0.0)) / 0.18)
        - F.when(area > 0.68, 3.0).otherwise(0.0) - 2.0 * F.coalesce(text_share, F.lit(0.0))
    )


def source_priority(authority: Column, describes_objects: Column, legacy: Column, low_trust: Column) -> Column:
    """A weight in [0.05, 1.3] by authority and what the source is; half-even to three places."""
    weights = F.create_map(*[F.lit(x) for kv in AUTHORITY_WEIGHT.items() for x in kv])
    yes = lambda c, v: F.when(F.coalesce(c, F.lit(False)), F.lit(v)).otherwise(F.lit(0.0))
    base = F.coalesce(F.try_element_at(weights, authority), F.lit(0.5)) + yes(describes_objects, 0.08) - yes(legacy, 0.12) - yes(low_trust, 0.10)
    return F.bround(F.greatest(F.lit(0.05), F.least(F.lit(1.3), base)), 3)


def named_parts(text: Column, keys: tuple, mark: str = "：", ends: str = "；\n") -> Column:
    """A map of key to what stands between its mark and the next end; keys that are not there are left out."""
    entries = [F.when(F.contains(text, F.lit(k + mark)), F.struct(F.lit(k).alias("k"), F.trim(F.regexp_extract(text, f"{k}{mark}([^{ends}]*)", 1)).alias("v"))) for k in keys]
    return F.map_from_entries(F.array_compact(F.array(*entries)))


def with_commas(text: Column) -> Column:
    """JSON text with missing commas between a value and the next line's key or object put in, trailing ones out."""
    t = F.regexp_replace(text, r'([}\]"0-9el])[ \t]*\n\s*(")', "$1,\n$2")
    t = F.regexp_replace(t, r"(\})\s*\n\s*(\{)", "$1,\n$2")
    return F.regexp_replace(t, r",\s*([}\]])", "$1")


def cut_off_value(text: Column, key: str, most: int = 120) -> Column:
    """The value of a key in JSON text that breaks off inside it: up to a broken sign, blanks collapsed, ``most`` characters."""
    rest = F.regexp_extract(text, rf'(?s)"{key}"\s*:\s*"(.*)$', 1)
    plain = T.normal_space(F.regexp_replace(rest, "(?s)�.*$", ""))
    return F.when(plain != "", F.substring(plain, 1, most))


def row_key(*parts: Column, payload: Column, most: int = 256) -> Column:
    """The parts and the beginning of a payload joined by '|'; null counts as blank."""
    blank = F.lit("")
    return F.concat_ws("|", *[F.coalesce(p.cast("string"), blank) for p in parts], F.substring(F.coalesce(payload, blank), 1, most))


def slim_json(text: Column) -> Column:
    """JSON text without members that are null, empty lists or empty objects, inside out to depth three."""
    member = r'"(?:[^"\\]|\\.)*"\s*:\s*(?:null|\[\s*\]|\{\s*\})'
    out = text
    for _ in range(3):
        out = F.regexp_replace(F.regexp_replace(out, rf",\s*{member}(?=\s*[,}}])", ""), rf"\{{\s*{member}\s*(?:,\s*|(?=\}}))", "{")
        out = F.regexp_replace(out, rf"\{{\s*{member}\s*(?:,\s*|(?=\}}))", "{")
    return out


#: What art captions speak of, what is no landscape, a caption that is only a number, and a running head.
ART = r"(?i)山水|溪山|寒林|江山|山图|山圖|山居|山楼|山樓|秋山|春山|夏山|雪景|雪溪|洞庭|罗浮|羅浮|林泉|峰|岩|巖|崖|石|泉|松|皴|米点|米點|青绿|青綠|浅绛|淺絳|手卷|长卷|長卷|卷|册|冊|页|頁|轴|軸|图|圖|painting|landscape|mountain|river|handscroll|album|hanging\s+scroll"
NO_LANDSCAPE = r"(?i)坐像|肖像|圣贤图|聖賢圖|帝后|人物肖像|画虎|畫虎|虎圖|书法|書法|墨迹|墨跡|calligraphy|portrait"
NUMBER_ONLY = r"(?i)^(?:〔?\[?【?(?:图|圖)|Fig\.?|Figure)\s*[一二三四五六七八九十百0-9IVXivx:：.—_ -]+】?\.?$"
CAPTION_START = r"(?i)^(〔?\[?【?图|〔?\[?【?圖|Fig\.?|Figure|Plate)"
RUNNING_HEAD = r"(?i)^(?:[0-9]+\s+)?(?:SOUTHERN\s+SUNG\s+PAINTING|YUAN\s+LITERATI\s+PAINTING|MAINLAND\s+CHINESE\s+PAINTING)\s*[0-9]*[I1]?$"
#: Signs a caption does not start with, and bonuses per label.
INNER_START = "，。、；：,.;:”’\"'"
QUALITY_BONUS = {"explicit_caption": 2.0, "title_caption": 1.4, "short_art_caption": 0.8, "plain_body_text": -4.0}


def caption_quality(text: Column) -> Column:
    """The label of a caption: explicit, title, short art caption, or plain text; null counts as plain text."""
    t = F.coalesce(text, F.lit(""))
    spaced, bare = T.normal_space(t), F.regexp_replace(t, r"(?U)\s+", "")
    trimmed = F.regexp_replace(t, r"^\s+|\s+$", "")
    plain = (spaced.rlike(NUMBER_ONLY) & (F.length(bare) <= 24)) | spaced.rlike(RUNNING_HEAD) | trimmed.rlike(r"^[a-z]{1,4}\s+") | trimmed.rlike(f"^[{INNER_START}]") | bare.rlike("^(图》|圖》|》)")
    return (
        F.when(plain, "plain_body_text").when(bare.rlike(CAPTION_START), "explicit_caption").when(t.rlike("《[^》]{1,40}》") & (F.length(bare) <= 180), "title_caption")
        .when((F.length(bare) <= 120) & ~bare.rlike(NO_LANDSCAPE) & bare.rlike(ART), "short_art_caption").otherwise("plain_body_text")
    )


def caption_quality_score(embedded: Column, text: Column, score: Column, area: Column, text_share: Column) -> Column:
    """How good a captioned region is; fixed weights; missing numbers count 0."""
    bonus = F.create_map(*[F.lit(x) for kv in QUALITY_BONUS.items() for x in kv])
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return (
        F.when(embedded, 3.0).otherwise(0.6) + F.try_element_at(bonus, caption_quality(text)) + F.when(F.coalesce(text, F.lit("")).rlike(ART), 0.8).otherwise(0.0)
        + F.least(F.greatest(zero(score) / 2.0, F.lit(-2.0)), F.lit(4.0)) + F.least(F.lit(1.0), zero(area) / 0.16) - 2.0 * zero(text_share)
    )
