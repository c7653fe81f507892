"""Greedy overlap suppression and nearest captions per page.

Suppression depends on the order of what was kept, so it is a fold over rows sorted by page and score: one pass per
partition, holding only the kept regions of the current page.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.functions import geometry as G


def suppress_overlaps(regions: DataFrame, page: str, key: str, box: str, score: str, threshold: float = 0.88) -> DataFrame:
    """(page, key): best score first, a region is dropped when it overlaps a kept one by ``threshold`` or more."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Rows come sorted by page and score; a page may go on in the next batch.
        current, kept = None, []
        for pdf in batches:
            pages, keys = [], []
            for p, k, b in zip(pdf["p"], pdf["k"], pdf["b"]):
                if p != current:
                    current, kept = p, []
                own = float(b[2] - b[0]) * float(b[3] - b[1])
                for o, size in kept:
                    w, h = min(b[2], o[2]) - max(b[0], o[0]), min(b[3], o[3]) - max(b[1], o[1])
                    if w > 0 and h > 0 and float(w) * h >= threshold * (own + size - float(w) * h):
                        break
                else:
                    kept.append((b, own))
                    pages.append(p)
                    keys.append(k)
            yield pd.DataFrame({page: pages, key: keys})

    rows = regions.where(F.col(page).isNotNull() & G.valid(F.col(box))).select(F.col(page).alias("p"), F.col(key).alias("k"), F.col(box).alias("b"), F.col(score).cast("double").alias("s")).distinct()
    return rows.repartition("p").sortWithinPartitions("p", F.desc_nulls_last("s"), "k").mapInPandas(fold, f"{page} string, {key} string")


def nearest_caption(figures: DataFrame, captions: DataFrame, page: str, figure: str, caption: str, box: str, caption_box: str) -> DataFrame:
    """(page, figure, caption, cost): per figure the caption of its page with the smallest gap + .25 centre shift - .5 overlap."""
    f = figures.where(G.valid(F.col(box))).select(F.col(page).alias("p"), F.col(figure).alias("f"), F.col(box).alias("a")).distinct()
    c = captions.where(G.valid(F.col(caption_box))).select(F.col(page).alias("q"), F.col(caption).alias("c"), F.col(caption_box).alias("b")).distinct()
    a, b = F.col("a"), F.col("b")
    shift = F.abs((a[0] + a[2]) / 2 - (b[0] + b[2]) / 2)
    shared = F.greatest(F.lit(0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    cost = F.round(G.caption_gap(a, b)["gap"] + 0.25 * shift - 0.5 * shared, 6)
    j = f.join(c, F.col("p") == F.col("q")).withColumn("cost", cost)
    return j.groupBy("p", "f").agg(F.min(F.struct("cost", "c")).alias("m")).select(F.col("p").alias(page), F.col("f").alias(figure), F.col("m.c").alias(caption), F.col("m.cost").alias("cost"))
