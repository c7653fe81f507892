"""Evaluation texts leaking into training text: prefix-filtered set join on word shingles.

A passage of ``PASSAGE_WORDS`` words is a set of consecutive shingles of ``SHINGLE_WORDS`` words. Shingles are ordered by
rarity, counted over the whole corpus; containing a passage means containing all its shingles, so its rarest shingle is
the necessary prefix. The corpus is read once for the places of all shingles that any item holds: numbers only, no text.
Those places give the rarities, and where a prefix stands its position gives the only window of the document that can
hold the passage (positional bound, item-sized). Only documents with such a window are read again, and compared exactly.

The evaluation side is broadcast only below a checked number of rows; beyond it the joins are shuffled on the shingle or
the document with rows of a few numbers. A frequent shingle costs its own places, nothing else.

Defined results: null or empty texts and keys have no passage; items shorter than the passage cannot leak; repeated
rows of a key count once; words are runs of letters and digits, compared without case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.runtime import BROADCAST_ROWS, broadcast_if_small, cut, stored

SHINGLE_WORDS = 5
PASSAGE_WORDS = 10


def words_of(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def _shingles(words: str, n: int) -> Column:
    """(s, p): hash and position of every run of n words in column ``words``; words are hashed once each."""
    run = ", ".join(f"get(h, i + {k})" for k in range(n))
    return F.expr(f"transform(array(transform({words}, w -> xxhash64(w))), h -> IF(size(h) >= {n}, transform(sequence(0, size(h) - {n}), i -> struct(xxhash64({run}) AS s, i AS p)), array()))[0]")


def leaked_passages(documents: DataFrame, items: DataFrame, passage: int = PASSAGE_WORDS, shingle: int = SHINGLE_WORDS, limit: int = BROADCAST_ROWS) -> DataFrame:
    """(doc_id, item_id, passages): documents that hold ``passage`` consecutive words of an item."""
    shingle = min(shingle, passage)
    texts = documents.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text")
    tests = cut(
        items.where("item_id IS NOT NULL AND item_text IS NOT NULL").select("item_id", words_of(F.col("item_text")).alias("iw")).distinct().where(F.size("iw") >= passage)
    )
    item_shingles = tests.select("item_id", "iw", F.explode(_shingles("iw", shingle)).alias("z")).select("item_id", "iw", F.col("z.s").alias("s"), F.col("z.p").alias("p"))
    wanted = cut(item_shingles.select("s").distinct())
    docs = texts.select("doc_id", words_of(F.col("text")).alias("dw")).where(F.size("dw") >= passage)
    places = stored(
        docs.select("doc_id", F.size("dw").alias("words"), F.explode(_shingles("dw", shingle)).alias("z"))
        .select("doc_id", "words", F.col("z.s").alias("s"), F.col("z.p").alias("p")).join(broadcast_if_small(wanted, limit), "s", "left_semi")
    )
    rarity = places.groupBy("s").agg(F.count("*").alias("n"))
    # The necessary prefix of every passage window: its rarest shingle. A window with an unseen shingle cannot match.
    ahead = Window.partitionBy("item_id").orderBy("p").rowsBetween(0, passage - shingle)
    ranked = item_shingles.join(broadcast_if_small(rarity, limit), "s", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    prefix = cut(
        ranked.withColumn("m", F.min(F.struct("n", "s", "p")).over(ahead))
        .where((F.col("p") <= F.size("iw") - passage) & (F.col("m.n") > 0))
        .select("item_id", F.col("m.s").alias("s"), (F.col("m.p") - F.col("p")).alias("shift"), F.expr(f"array_join(slice(iw, p + 1, {passage}), ' ')").alias("window"))
        .distinct()
    )
    windows = (
        places.join(broadcast_if_small(prefix, limit), "s").withColumn("at", F.col("p") - F.col("shift"))
        .where((F.col("at") >= 0) & (F.col("at") + passage <= F.col("words"))).select("doc_id", "at", "item_id", "window").distinct()
    )
    windows = stored(windows)
    # Of the documents concerned the words, once; the windows meet them by document.
    concerned = texts.join(broadcast_if_small(windows.select("doc_id").distinct(), limit), "doc_id", "left_semi").select("doc_id", words_of(F.col("text")).alias("dw"))
    hits = concerned.join(broadcast_if_small(windows, limit), "doc_id").where(F.expr(f"array_join(slice(dw, at + 1, {passage}), ' ')") == F.col("window"))
    return hits.groupBy("doc_id", "item_id").agg(F.count_distinct("window").alias("passages"))


def found_leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id) of every leak."""
    return leaked_passages(documents, items).select("doc_id", "item_id")
