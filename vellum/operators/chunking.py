"""Sentence-aware chunking with overlap, as expressions over one document's arrays: nothing is grouped or shuffled.

A text becomes an array of units (sentences of its paragraphs, overlong ones split by one pattern), the units an array of
lengths, and one ``aggregate`` over their positions keeps where the open chunk starts and which spans are closed. Only
numbers are folded; the texts of the spans are sliced out at the end.

Defined results: null and blank texts give no chunk; a text of one unit is one chunk; repeated rows give repeated chunks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions import text as T
from vellum.runtime import stored

#: Characters of a chunk, of its overlap, units of its overlap, and of a paragraph that is one piece.
CHUNK_CHARS, OVERLAP_CHARS, OVERLAP_UNITS, LONG_PARAGRAPH = 900, 160, 2, 1200
#: An overlong unit is cut behind the last of these in the part that starts at this share of a chunk.
CUT_BEHIND, CUT_FROM = "，,、 ", 0.45


def units(text: Column, size: int = CHUNK_CHARS) -> Column:
    """The sentences of a text in order, none longer than ``size``."""
    filled = lambda a: F.filter(F.transform(a, T.clean_text), lambda x: x != "")
    paragraphs = filled(F.split(T.clean_text(text), r"\n{2,}"))
    pieces = F.flatten(F.transform(paragraphs, lambda p: F.when(F.length(p) <= LONG_PARAGRAPH, F.array(p)).otherwise(filled(F.split(p, r"\n")))))
    whole = F.flatten(F.transform(pieces, lambda p: filled(F.regexp_extract_all(p, F.lit(T.SENTENCE), F.lit(0)))))
    # The rest if it fits, else up to the last cutting place far enough behind, else a full chunk.
    part = rf"(?s).{{1,{size}}}$|.{{{int(size * CUT_FROM)},{size - 1}}}[{CUT_BEHIND}]|.{{{size}}}"
    return F.flatten(F.transform(whole, lambda s: F.when(F.length(s) <= size, F.array(s)).otherwise(filled(F.regexp_extract_all(s, F.lit(part), F.lit(0))))))


def _spans(n: str, size: int) -> str:
    """SQL: closed (first, last) unit positions of every chunk, from the unit lengths in column ``n``."""
    # The overlap: the last unit, and the one before while both are short.
    two = f"(i - 1 > s.first AND {OVERLAP_UNITS} > 1 AND {n}[i - 2] + {n}[i - 3] <= {OVERLAP_CHARS})"
    seed = f"(IF({two}, {n}[i - 2] + {n}[i - 3] + 1, {n}[i - 2]))"
    grown = f"(s.total + 1 + {n}[i - 1])"
    closed = "array_append(s.done, named_struct('a', s.first, 'b', i - 1))"
    return f"""aggregate(sequence(2, size({n})),
      named_struct('done', CAST(array() AS array<struct<a:int,b:int>>), 'first', 1, 'total', {n}[0]),
      (s, i) -> CASE WHEN {grown} <= {size} THEN named_struct('done', s.done, 'first', s.first, 'total', {grown})
        WHEN {seed} + 1 + {n}[i - 1] > {size} THEN named_struct('done', {closed}, 'first', i, 'total', {n}[i - 1])
        ELSE named_struct('done', {closed}, 'first', IF({two}, i - 2, i - 1), 'total', {seed} + 1 + {n}[i - 1]) END,
      s -> array_append(s.done, named_struct('a', s.first, 'b', size({n}))))"""


def chunked(rows: DataFrame, key: str, text: str, size: int = CHUNK_CHARS) -> DataFrame:
    """(key, chunk_no, chunk) of every text."""
    cut = rows.where(F.col(text).isNotNull()).select(F.col(key).alias("_key"), units(F.col(text), size).alias("_u")).where(F.size("_u") > 0)
    # Written once: the fold reads units and lengths many times.
    measured = stored(cut.withColumn("_n", F.transform("_u", F.length)))
    spans = F.when(F.size("_n") > 1, F.expr(_spans("_n", size))).otherwise(F.expr("array(named_struct('a', 1, 'b', 1))"))
    placed = measured.withColumn("_s", spans).select("_key", "_u", F.posexplode("_s").alias("chunk_no", "_z"))
    return placed.select(F.col("_key").alias(key), "chunk_no", F.array_join(F.expr("slice(_u, _z.a, _z.b - _z.a + 1)"), "\n").alias("chunk"))
