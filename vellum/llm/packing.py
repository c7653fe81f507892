"""Filling fixed-capacity containers with texts: first-fit decreasing over a tournament tree, in randomised groups.

Texts are measured in tokens of a public tokenizer (path given, never copied here). Items go to groups by hash, about
``GROUP_ITEMS`` each, so every group is one bounded task whatever the input; inside a group first-fit decreasing keeps
the free space of all containers in a tournament tree and finds the first that fits in logarithmic time.

Defined results: a null text or key has no piece; an empty text is one piece of 0 tokens; a text longer than the
capacity is cut into full containers and a rest, which is packed like any other item; repeated rows of a key count once
(of several different texts of a key, the one with most tokens).
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY = 2048
GROUP_ITEMS = 8192
#: Below /opt/tokenizers; overridden by the caller where the vocabulary lies elsewhere.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The split pattern that goes with that vocabulary (fixed value).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
SCHEMA = "doc_id bigint, piece_no int, tokens int, container_id string"


def encoder(path: str = VOCABULARY):
    """The tokenizer of a rank file."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("given", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, tokens) of every text, one Arrow batch at a time."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(path)
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "tokens": [len(enc.encode_ordinary(t)) for t in b["text"]]})

    rows = documents.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text")
    return rows.mapInPandas(count, "doc_id bigint, tokens int").groupBy("doc_id").agg(F.max("tokens").alias("tokens"))


class Tournament:
    """Free space of containers 0..n-1; ``place`` takes the first that fits."""

    def __init__(self, n: int, capacity: int):
        self.leaves = 1 << max(0, n - 1).bit_length()
        self.best = [capacity] * (2 * self.leaves)

    def place(self, need: int) -> int:
        best, k = self.best, 1
        while k < self.leaves:
            k *= 2
            if best[k] < need:
                k += 1
        best[k] -= need
        at = k - self.leaves
        while k > 1:
            k //= 2
            left, right = best[2 * k], best[2 * k + 1]
            best[k] = left if left >= right else right
        return at


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """The container of every item, items taken from large to small (ties in given order)."""
    tree, out = Tournament(max(1, len(sizes)), capacity), [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        out[i] = tree.place(sizes[i])
    return out


def packed(documents: DataFrame, capacity: int = CAPACITY, path: str = VOCABULARY, group_items: int = GROUP_ITEMS) -> DataFrame:
    """(doc_id, piece_no, tokens, container_id) of every text or piece."""
    counts = token_counts(documents, path)
    groups = max(1, -(-documents.count() // group_items))
    full = F.when(F.col("tokens") > capacity, F.floor((F.col("tokens") - 1) / capacity)).otherwise(F.lit(0)).cast("int")
    pieces = counts.withColumn("full", full).withColumn("rest", (F.col("tokens") - F.col("full") * capacity).cast("int"))
    whole = pieces.where("full > 0").select("doc_id", F.explode(F.expr("sequence(0, full - 1)")).alias("piece_no")).select(
        "doc_id", "piece_no", F.lit(capacity).alias("tokens"), F.concat_ws("-", F.lit("w"), F.col("doc_id").cast("string"), F.col("piece_no").cast("string")).alias("container_id")
    )

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["tokens", "doc_id"], ascending=[False, True])
        bins = first_fit_decreasing(pdf["tokens"].tolist(), capacity)
        g = pdf["g"].iloc[0]
        return pd.DataFrame({"doc_id": pdf["doc_id"], "piece_no": pdf["piece_no"], "tokens": pdf["tokens"], "container_id": [f"g{g}-{b}" for b in bins]})

    items = pieces.select("doc_id", F.col("full").alias("piece_no"), F.col("rest").alias("tokens"), F.pmod(F.xxhash64("doc_id", F.lit(20)), F.lit(groups)).alias("g"))
    return items.groupBy("g").applyInPandas(pack, SCHEMA).unionByName(whole)


def packing_report(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Containers, tokens and unused share of a packing."""
    bins = pieces.groupBy("container_id").agg(F.sum("tokens").alias("used"))
    return bins.agg(
        F.count("*").alias("containers"), F.sum("used").alias("tokens"), F.max("used").alias("fullest"),
        (F.lit(1.0) - F.sum("used") / (F.count("*") * capacity)).alias("unused_share"), F.ceil(F.sum("used") / capacity).alias("least_containers"),
    )
