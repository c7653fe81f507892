"""Queries of the training-data operators and their SQL, merged into the entry point when this subpackage is there."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vellum.llm import canonical, language_crf, leakage, packing, related_splits, scan_noise, split_overlap, truncation
from vellum.runtime import table


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": lambda s, d: scan_noise.found_noise(table(s, d, "page_specs"), table(s, d, "support_candidates")),
        "p1_text": lambda s, d: scan_noise.repaired_text(table(s, d, "page_specs"), table(s, d, "support_candidates")),
        "p4_found": lambda s, d: canonical.found_entries(table(s, d, "figure_targets"), table(s, d, "authority_entries")),
        "p5_found": lambda s, d: related_splits.found_groups(table(s, d, "figure_targets")),
        "p5_splits": lambda s, d: related_splits.dealt_splits(table(s, d, "figure_targets")),
        "p5_forest": lambda s, d: related_splits.relation_forest(table(s, d, "figure_targets")),
        "p5_report": lambda s, d: related_splits.split_report(table(s, d, "figure_targets")),
        "p6_found": lambda s, d: truncation.found_cuts(table(s, d, "figure_targets"), table(s, d, "support_candidates")),
        "p6_rates": lambda s, d: truncation.cut_rates(table(s, d, "figure_targets"), table(s, d, "support_candidates")),
        "p7_found": lambda s, d: split_overlap.found_overlaps(table(s, d, "figure_targets"), table(s, d, "page_candidates")),
        "p7_report": lambda s, d: split_overlap.overlap_report(table(s, d, "figure_targets"), table(s, d, "page_candidates")),
        "p7_boxes": lambda s, d: split_overlap.box_overlaps(table(s, d, "figure_targets"), table(s, d, "page_candidates")).distinct(),
        "p7_classes": lambda s, d: split_overlap.overlap_classes(table(s, d, "figure_targets")),
        "p8_containers": lambda s, d: packing.packed(table(s, d, "documents")),
        "p8_report": lambda s, d: packing.packing_report(packing.packed(table(s, d, "documents"))),
        "p9_found": lambda s, d: leakage.found_leaks(table(s, d, "documents"), table(s, d, "eval_items")),
        "p10_found": lambda s, d: language_crf.found_languages(table(s, d, "documents")),
        "p10_languages": lambda s, d: language_crf.document_languages(table(s, d, "documents")),
        "p10_labels": lambda s, d: language_crf.stated_languages(table(s, d, "documents")),
        "p10_segments": lambda s, d: language_crf.mixed_segments(table(s, d, "documents")),
    }


def _notations() -> str:
    names = " ".join(f"WHEN b IN ({', '.join(repr(n) for n in v.split())}) THEN '{k}'" for k, v in language_crf.NOTATIONS.items())
    unknown = ", ".join(repr(u) for u in language_crf.UNKNOWN_LABELS)
    return f"CASE WHEN w IN ({unknown}) OR b IN ({unknown}) THEN '' {names} ELSE w END"


_BOX = "coalesce(len({b}), 0) = 4 AND {b}[3] > {b}[1] AND {b}[4] > {b}[2]"
_INTER = "CAST(greatest(0, least(x.a[3], y.a[3]) - greatest(x.a[1], y.a[1])) AS DOUBLE) * greatest(0, least(x.a[4], y.a[4]) - greatest(x.a[2], y.a[2]))"
_WORDS = "regexp_extract_all(lower({c}), '[\\p{{L}}\\p{{N}}]+')"


def oracle_sql() -> dict[str, str]:
    """SQL over the whole tables; the rest is tested against brute force and held-out truth on fixtures.

    p7_found has none: the SQL engine's edit distance counts bytes, the problem counts characters.
    """
    return {
        # Transitive closure over (document, file) pairs.
        "p5_found": """
WITH RECURSIVE r AS (SELECT DISTINCT target_id, nullif(trim(doc_id), '') AS d, nullif(lower(trim(regexp_extract(source_file, '([^/]*)$', 1))), '') AS f, split FROM figure_targets),
e AS (SELECT DISTINCT 'd:' || d AS a, 'f:' || f AS b FROM r WHERE d IS NOT NULL AND f IS NOT NULL), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
c(n, m) AS (SELECT a, a FROM u UNION SELECT c.n, u.b FROM c JOIN u ON c.m = u.a), g AS (SELECT n, min(m) AS root FROM c GROUP BY n),
t AS (SELECT r.target_id, r.split, coalesce(g.root, 'f:' || f, 'd:' || d, target_id) AS root FROM r LEFT JOIN g ON g.n = coalesce('f:' || r.f, 'd:' || r.d)),
k AS (SELECT root, min(target_id) AS group_key FROM t GROUP BY root HAVING count(DISTINCT split) > 1)
SELECT DISTINCT group_key, target_id FROM t JOIN k USING (root)""",
        # All regions of a page against each other.
        "p7_boxes": f"""
WITH s AS (SELECT DISTINCT target_id, CASE WHEN split = 'train' THEN 'train' ELSE 'eval' END AS side FROM figure_targets WHERE target_id IS NOT NULL AND split IN ('train', 'val', 'test')),
b AS (SELECT DISTINCT page_id, target_id, side, image_bbox AS a FROM page_candidates JOIN s USING (target_id) WHERE page_id IS NOT NULL AND {_BOX.format(b='image_bbox')})
SELECT DISTINCT x.target_id AS eval_id, y.target_id AS train_id FROM b x JOIN b y ON x.page_id = y.page_id AND x.side = 'eval' AND y.side = 'train'
WHERE {_INTER} >= 0.8 * (CAST(x.a[3] - x.a[1] AS DOUBLE) * (x.a[4] - x.a[2]) + CAST(y.a[3] - y.a[1] AS DOUBLE) * (y.a[4] - y.a[2]) - {_INTER}) AND {_INTER} > 0""",
        "p10_labels": f"SELECT DISTINCT doc_id, {_notations()} AS label FROM (SELECT doc_id, lower(trim(coalesce(lang, ''))) AS w, regexp_extract(lower(trim(coalesce(lang, ''))), '^([^-_ (]*)', 1) AS b FROM documents WHERE doc_id IS NOT NULL)",
        # Every run of ten words of either side.
        "p9_found": f"""
WITH d AS (SELECT DISTINCT doc_id, {_WORDS.format(c='text')} AS w FROM documents WHERE text IS NOT NULL), i AS (SELECT DISTINCT item_id, {_WORDS.format(c='item_text')} AS w FROM eval_items WHERE item_text IS NOT NULL),
x AS (SELECT doc_id, unnest(list_transform(generate_series(1, len(w) - 9), lambda k: array_to_string(w[k : k + 9], ' '))) AS g FROM d WHERE len(w) >= 10),
y AS (SELECT item_id, unnest(list_transform(generate_series(1, len(w) - 9), lambda k: array_to_string(w[k : k + 9], ' '))) AS g FROM i WHERE len(w) >= 10)
SELECT DISTINCT doc_id, item_id FROM x JOIN y USING (g)""",
    }
