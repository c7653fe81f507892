"""Lexical retrieval with scopes: token multiset overlap over the document's norm, as an inverted-token equi-join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.functions import geometry as G
from vellum.functions import text as T
from vellum.operators.relational import top_per_group_salted
from vellum.runtime import broadcast_if_small


def token_counts(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, token, n)."""
    return rows.select(F.col(key).alias("_key"), F.explode(T.tokens(F.col(text))).alias("token")).groupBy("_key", "token").agg(F.count("*").alias("n")).withColumnRenamed("_key", key)


def search(queries: DataFrame, documents: DataFrame, query: str = "query_id", doc: str = "doc_id", k: int = 10, scope: str = "corpus", bonus: bool = False) -> DataFrame:
    """(query, doc, score, rank): the k best documents of every query with a positive score.

    ``queries`` has (query, query_text, source), ``documents`` (doc, text, source, noise_score); a query without tokens
    uses its source's name. score = sum of min(counts) / max(1, norm of the document's counts), plus 0.2 in the same
    source, times (1 - noise, at least 0.05); documents of the query's source take part even without a common token.
    Scopes other than corpus need ``page`` in queries and ``page_start``, ``page_end`` in documents. With ``bonus``
    (arrays ``labels``, ``terms``, ``entities`` in queries, ``clean_type`` in documents) anchors that stand in the text
    add up. Documents marked ``usable`` false are left out. Ties go to the smaller document key. Queries are a stated
    set; a frequent token costs its own postings only.
    """
    if "usable" in documents.columns:
        documents = documents.where(usable(F.col("usable")))
    asked = queries.withColumn("query_text", F.when(F.size(T.tokens(F.col("query_text"))) > 0, F.col("query_text")).otherwise(F.col("source")))
    # The queries are few: joined by broadcast, the token counts of all documents stay where they are.
    asked = broadcast_if_small(asked)
    q = broadcast_if_small(token_counts(asked, query, "query_text").select(query, "token", F.col("n").alias("nq")))
    d = token_counts(documents, doc, "text").select(doc, "token", F.col("n").alias("nd"))
    norms = d.groupBy(doc).agg(F.greatest(F.lit(1.0), F.sqrt(F.sum(F.col("nd") * F.col("nd")))).alias("norm"))
    hits = d.join(q, "token").groupBy(query, doc).agg(F.sum(F.least("nq", "nd")).alias("overlap"))
    # Documents of the query's own source score without overlap, too.
    own = documents.select(doc, F.col("source").alias("_s")).join(asked.select(query, F.col("source").alias("_s")), "_s").join(norms.select(doc), doc, "left_semi").select(query, doc, F.lit(0).cast("bigint").alias("overlap"))
    hits = hits.unionByName(own).groupBy(query, doc).agg(F.max("overlap").alias("overlap"))
    pages = [F.col("page_start").alias("page_start"), F.coalesce("page_end", "page_start").alias("page_end")] if scope != "corpus" or bonus else []
    extra = ["clean_type", "_found"] if bonus else []
    if bonus:
        documents = with_found_anchors(documents, asked)
    facts = documents.select(doc, F.col("source").alias("_ds"), F.coalesce("noise_score", F.lit(0.0)).alias("_noise"), *pages, *extra).join(norms, doc)
    asks = asked.select(query, F.col("source").alias("_qs"), *(["page"] if pages else []), *(["labels", "terms", "entities"] if bonus else []))
    noise = F.when(F.col("_noise") > 0, F.greatest(F.lit(0.0), 1 - F.least(F.lit(0.95), F.col("_noise")))).otherwise(F.lit(1.0))
    same = F.col("_ds").eqNullSafe(F.col("_qs"))
    score = (F.col("overlap") / F.col("norm") + F.when(same, 0.2).otherwise(0.0)) * noise
    met = hits.join(facts, doc).join(asks, query)
    if pages:
        met = met.where(in_scope(scope, same, F.col("page"), F.col("page_start"), F.col("page_end")))
    if bonus:
        score = score + anchor_bonus(F.col("_found"), F.col("labels"), F.col("terms"), F.col("entities"), same, F.col("page"), F.col("page_start"), F.col("page_end"), F.col("clean_type"))
    scored = met.withColumn("score", F.round(score, 6)).where("score > 0").select(query, doc, "score")
    return top_per_group_salted(scored, [query], [F.desc("score"), F.col(doc)], k)


def usable(flag):
    """Only an explicit false leaves a row out."""
    return ~flag.eqNullSafe(F.lit(False))


def with_found_anchors(documents: DataFrame, queries: DataFrame) -> DataFrame:
    """Documents with ``_found``, the anchors of all queries that stand in their text without blanks.

    A text is made compact and searched once, not for every query and word: pairs of query and document then carry a
    short list instead of the text. The queries are a stated set, so their words go along in one broadcast row.
    """
    empty = F.array().cast("array<string>")
    words = queries.select(F.explode(F.concat(*[F.coalesce(c, empty) for c in ("labels", "terms", "entities")])).alias("w")).select(T.compact(F.col("w")).alias("w")).where(F.length("w") > 0)
    documents = documents.crossJoin(F.broadcast(words.agg(F.collect_set("w").alias("_words"))))
    # An array of one binds the compact text; named in the inner function itself it would be made anew for every word.
    found = F.transform(F.array(T.compact(F.col("text"))), lambda t: F.filter("_words", lambda w: F.contains(t, w)))
    return documents.withColumn("_found", found[0]).drop("_words")


def anchor_bonus(found, labels, terms, entities, same_source, page, start, end, clean_type):
    """What a text gains by its figure labels, caption terms, entities and nearness to the page asked for."""

    def hits(words, least: int):
        return F.size(F.filter(F.transform(F.coalesce(words, F.array().cast("array<string>")), T.compact), lambda w: (F.length(w) >= least) & F.array_contains(found, w)))

    n_labels, n_terms, n_entities = hits(labels, 1), hits(terms, 4), hits(entities, 2)
    anchored = (n_labels + n_terms + n_entities) > 0
    away = F.when(same_source, G.page_distance(page, start, end))
    near = (
        F.when(away.isNull(), 0.0).when(anchored, F.when(away == 0, 0.08).when(away == 1, 0.05).when(away <= 3, 0.02).otherwise(0.0))
        .otherwise(F.when(away == 0, 0.015).when(away == 1, 0.01).otherwise(0.0))
    )
    return (
        near + F.when(n_labels > 0, F.least(F.lit(0.30), 0.18 + 0.04 * (n_labels - 1))).otherwise(0.0)
        + F.least(F.lit(0.16), 0.04 * n_terms) + F.least(F.lit(0.09), 0.03 * n_entities) + F.when(clean_type == "figure_reference_text", 0.02).otherwise(0.0)
    )


def in_scope(scope: str, same_source, page, start, end):
    """The scope condition of a join: corpus, same_document, current_page, nearby_pages; null pages per scope."""
    last = F.coalesce(end, start)
    known = page.isNotNull() & start.isNotNull()
    if scope == "corpus":
        return F.lit(True)
    if scope == "same_document":
        return same_source
    if scope == "current_page":
        return same_source & (page.isNull() | F.coalesce(start.isNotNull() & (start <= page) & (page <= last), F.lit(False)))
    return same_source & (~known | ((start <= page + 1) & (last >= page - 1)))


def scoped(tasks: DataFrame, items: DataFrame, scope: str) -> DataFrame:
    """Tasks (task_source, task_page) with the items (item_source, page_start, page_end) their scope allows.

    Items meet tasks by source, so a source costs its tasks times its items; ``page_window_join`` is the way for windows
    of pages within large sources.
    """
    same = F.col("task_source") == F.col("item_source")
    joined = tasks.join(items, same)
    return joined.where(in_scope(scope, same, F.col("task_page"), F.col("page_start"), F.col("page_end")))


def hit_rates(results: DataFrame, gold: DataFrame, query: str = "query_id", doc: str = "doc_id") -> DataFrame:
    """Queries, and the share with a gold document at rank 1 and among all results."""
    marked = results.join(gold.select(query, doc, F.lit(True).alias("gold")), [query, doc], "left")
    per = marked.groupBy(query).agg(F.bool_or(F.coalesce("gold", F.lit(False)) & (F.col("rank") == 1)).alias("top1"), F.bool_or(F.coalesce("gold", F.lit(False))).alias("any"))
    return per.agg(F.count("*").alias("queries"), F.round(F.avg(F.col("top1").cast("double")), 6).alias("top1_rate"), F.round(F.avg(F.col("any").cast("double")), 6).alias("any_rate"))


def ranked_positions(results: DataFrame, query: str = "query_id") -> DataFrame:
    """How many results stand at every rank."""
    return results.groupBy("rank").agg(F.count("*").alias("n"), F.count_distinct(query).alias("queries"), F.round(F.avg("score"), 6).alias("mean_score"))

