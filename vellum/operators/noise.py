"""Rule-based classes of text passages, as one chained expression over counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Patterns and keywords of the classes, in the order they are tried.
DOT_LEADER = r"(?:\.{5,}|…{2,}|·{4,}|_{5,})"
SECTION_PAGE = r"(?:^|\s|\n)(?:第[一二三四五六七八九十百]+章|[0-9]+(?:\.[0-9]+){1,4}).{0,80}?(?:\.{5,}|…{2,}|·{4,}|_{5,})\s*[0-9]{1,4}(?:\s|$)"
REFERENCE_MARK = r"(?:^|\n|\s)\[[0-9]{1,3}\]"
FIGURE_REFERENCE = r"(?i)(?:图|圖|Fig\.?|Figure)\s*[A-Za-z]?\s*[0-9]+(?:[.\-][0-9]+)*"
CONTENTS_WORDS = ("目录", "目 录", "contents", "本章小结", "主要结论", "创新之处", "不足与展望")
FRONT_WORDS = ("摘要", "abstract", "关键词", "key words", "目录", "目 录")
BACK_WORDS = ("致谢", "作者在读期间", "科研成果简介", "攻读硕士", "攻读博士", "附录", "声明")
HEADER_WORDS = ("硕士学位论文", "博士学位论文", "万方数据", "版权所有")
BIBLIOGRAPHY_WORDS, JOURNAL_WORDS = ("参考文献", "bibliography", "references"), ("出版社", "journal", "doi")
#: Limits of the rules.
FRONT_PAGES, HEADER_CHARS, NOISE_CHARS, SCAN_SIGNAL, OTHER_SHARE, FEW_SIGNS, SHORT_LIST = 12, 80, 20, 0.35, 0.65, 40, 2500
#: Score per class; classes with 0.7 and more are not usable.
SCORES = {"caption": 0.0, "toc": 0.98, "bibliography": 0.92, "front_matter": 0.78, "back_matter": 0.84, "header_footer": 0.76, "ocr_noise": 0.86, "figure_reference_text": 0.02, "normal_body_text": 0.0}


def _any(text: Column, words: tuple) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def _hits(text: Column, words: tuple) -> Column:
    return sum((F.contains(text, F.lit(w)).cast("int") for w in words), F.lit(0))


def passage_class(text: Column, kind: Column, page: Column, quality: Column) -> Column:
    """The first class whose rule holds; null text counts as empty."""
    t = F.coalesce(text, F.lit(""))
    low, bare = F.lower(t), F.regexp_replace(t, r"(?U)\s+", "")
    dots = F.size(F.filter(F.split(t, r"\n"), lambda x: x.rlike(DOT_LEADER)))
    sections, marks = F.regexp_count(t, F.lit(SECTION_PAGE)), F.regexp_count(t, F.lit(REFERENCE_MARK))
    signal = F.regexp_count(bare, F.lit(r"[\x{4e00}-\x{9fff}A-Za-z0-9]"))
    size = F.greatest(F.lit(1), F.length(bare))
    other = F.length(bare) - signal
    return (
        F.when(F.contains(F.coalesce(kind, F.lit("")), F.lit("caption")), "caption")
        .when((sections >= 2) | ((dots >= 3) & _any(low, CONTENTS_WORDS)) | ((dots >= 4) & (F.length(t) < SHORT_LIST)), "toc")
        .when(_any(low, BIBLIOGRAPHY_WORDS) | ((marks >= 6) & _any(low, JOURNAL_WORDS)), "bibliography")
        .when((page.isNull() | (page <= FRONT_PAGES)) & (_hits(low, FRONT_WORDS) >= 2), "front_matter")
        .when(_any(t, BACK_WORDS), "back_matter")
        .when((F.length(bare) <= HEADER_CHARS) & (bare.rlike("^[0-9]+$") | _any(bare, HEADER_WORDS)), "header_footer")
        .when((size >= NOISE_CHARS) & ((F.contains(F.coalesce(quality, F.lit("")), F.lit("vlm_ocr")) & (signal / size < SCAN_SIGNAL)) | ((other / size > OTHER_SHARE) & (signal < FEW_SIGNS))), "ocr_noise")
        .when(t.rlike(FIGURE_REFERENCE), "figure_reference_text")
        .otherwise("normal_body_text")
    )


def class_score(kind: Column) -> Column:
    book = F.create_map(*[F.lit(x) for k, v in SCORES.items() for x in (k, v)])
    return F.coalesce(F.try_element_at(book, kind), F.lit(0.0))


def classified(rows: DataFrame, text: str, kind: str, page: str, quality: str | None = None) -> DataFrame:
    """The rows with clean_type, noise_score and usable."""
    q = F.col(quality) if quality else F.lit("")
    c = rows.withColumn("clean_type", passage_class(F.col(text), F.col(kind), F.col(page), q))
    return c.withColumn("noise_score", class_score(F.col("clean_type"))).withColumn("usable", F.col("noise_score") < 0.7)


def noise_by_source(classified_rows: DataFrame, source: str = "source") -> DataFrame:
    """Rows, noisy rows and their rate per source."""
    return classified_rows.groupBy(source).agg(F.count("*").alias("rows"), F.count_if(~F.col("usable")).alias("noisy"), F.round(F.avg((~F.col("usable")).cast("double")), 6).alias("noise_rate"))


def noisiest_sources(classified_rows: DataFrame, n: int, source: str = "source", at: float = 0.7) -> DataFrame:
    """The ``n`` sources with the highest share of rows scoring ``at`` or more (a top-n report; ties by count, then name)."""
    noisy = F.col("noise_score") >= at
    per = classified_rows.groupBy(source).agg(F.count("*").alias("rows"), F.count_if(noisy).alias("noisy"), F.round(F.avg(noisy.cast("double")), 6).alias("noise_rate"))
    return per.orderBy(F.desc("noise_rate"), F.desc("noisy"), source).limit(n)


#: Terms of title pages.
TITLE_TERMS = ("copyright", "isbn", "printed in", "all rights reserved", "preface")


def repeated_title_page(text: Column) -> Column:
    """At least six lines, of which at most 45 in 100 are distinct or which hold two terms of title pages."""
    t = F.coalesce(text, F.lit(""))
    lines = F.filter(F.transform(F.split(t, r"\n"), lambda x: F.trim(x)), lambda x: x != "")
    few = F.size(F.array_distinct(lines)) / F.greatest(F.lit(1), F.size(lines)) <= 0.45
    return (F.size(lines) >= 6) & (few | (_hits(F.lower(t), TITLE_TERMS) >= 2))


#: Terms and patterns of bibliographies and indexes.
LIST_TERMS = ("bibliography", "references", "works cited", "glossary-index", "list of plates")
CITATION_TERMS = ("university press", "yale university", "journal", "vol.", " no.", " pp.", "edited by", "publisher")
SEE_TERMS = ("see also", "see under", " see ")
YEAR, PAGE_RANGE, PAGE_LIST = r"\b(18|19|20)[0-9]{2}\b", r"\b[0-9]{1,3}[-,]\s*[0-9]{1,3}\b", r"\b[0-9]{1,3}(?:-[0-9]{1,3})?(?:,\s*[0-9]{1,3}){2,}\b"


def list_like(text: Column) -> Column:
    """Does a text look like a bibliography or an index: by its terms, years with citation words, or page references?"""
    low = F.lower(F.coalesce(text, F.lit("")))
    count = lambda term: (F.length(low) - F.length(F.replace(low, F.lit(term), F.lit("")))) / len(term)
    see = sum((count(x) for x in SEE_TERMS), F.lit(0))
    return (
        _any(low, LIST_TERMS) | ((F.regexp_count(low, F.lit(YEAR)) >= 3) & (_hits(low, CITATION_TERMS) >= 1))
        | ((see >= 2) & (F.regexp_count(low, F.lit(PAGE_RANGE)) >= 4)) | ((F.regexp_count(low, F.lit(PAGE_LIST)) >= 4) & (F.length(low) < 2500))
    )


#: Terms of the roles a passage may have, in the order they are tried.
OBJECT_TERMS = r"(accession|object number|medium|dimensions|collection|馆藏|藏品|尺寸|材质|作者|年代)"
PLATE_TERMS = r"(图\s*[0-9]|圖\s*[0-9]|fig\.|figure|plate|插图|图版|caption)"
STYLE_TERMS = ("风格", "画派", "笔墨", "皴法", "构图", "设色", "南宗", "北宗", "文人画")
NO_ROLE_CLASSES = ("toc", "bibliography", "front_matter", "back_matter", "ocr_noise")


def passage_role(text: Column, clean_type: Column) -> Column:
    """What a passage is good for: its class where that says it all, else by its terms; background where none holds."""
    t = F.coalesce(text, F.lit(""))
    low = F.lower(t)
    return (
        F.when(clean_type.isin(*NO_ROLE_CLASSES), clean_type).when(list_like(text), "bibliography").when(repeated_title_page(text), "front_matter")
        .when(low.rlike(OBJECT_TERMS), "object_metadata").when(low.rlike(PLATE_TERMS), "caption_or_plate").when(_any(t, STYLE_TERMS), "style_analysis").otherwise("historical_context")
    )


def reasons(**checks: Column) -> Column:
    """The sorted names of the checks that hold; a row is kept when none does."""
    return F.array_sort(F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in checks.items()])))
