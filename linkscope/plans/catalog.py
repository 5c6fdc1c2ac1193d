"""The registered queries over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkscope.config import EngineConfig
from linkscope.functions import keywords, linker, text, urls
from linkscope.operators import links, reports, rerank, scope, stats, suggest
from linkscope.plans import oracle
from linkscope.sources import tables as T
from linkscope.streaming import changes

CFG = EngineConfig()
Query = Callable[[SparkSession, str], DataFrame]


def _stats(s: SparkSession, d: str) -> DataFrame:
    return stats.compute(T.links(s, d), T.posts(s, d), CFG)


def _tokens(s: SparkSession, d: str) -> DataFrame:
    return text.tokenised(T.read(s, d, "documents"))


def _pairs(s: SparkSession, d: str) -> DataFrame:
    ids = T.read(s, d, "documents").select("doc_id")
    return ids.select(F.col("doc_id").alias("a")).join(ids.select((F.col("doc_id") - 1).alias("a"), F.col("doc_id").alias("b")), "a")


def _pools(s: SparkSession, d: str) -> DataFrame:
    """Each document with its three successors, by equal keys."""
    ids = T.read(s, d, "documents").select("doc_id")
    steps = ids.select(F.col("doc_id").alias("source"), F.explode(F.array(*[F.col("doc_id") + k for k in (1, 2, 3)])).alias("target"))
    return steps.join(ids.select(F.col("doc_id").alias("target")), "target").select("source", "target")


def _heuristic(s: SparkSession, d: str) -> DataFrame:
    docs = T.documents(s, d)
    src, tgt = docs.select(F.col("doc_id").alias("source"), F.col("category").alias("cs")), docs.select(F.col("doc_id").alias("target"), F.col("category").alias("ct"), "title", "age_days")
    keyword = F.array_join(F.slice(F.split("title", " "), 1, 3), " ")
    met = _pools(s, d).join(src, "source").join(tgt, "target").withColumn("keyword", keyword)
    return met.select("source", "target", "keyword", text.heuristic_relevance(F.col("keyword"), F.col("title"), F.col("age_days"), F.col("cs") == F.col("ct")).alias("heuristic"))


def _blended(s: SparkSession, d: str) -> DataFrame:
    met = text.batch_scores(_pools(s, d), _tokens(s, d)).withColumn("cosine", F.round("cosine", 9)).join(_heuristic(s, d), ["source", "target"])
    best = met.withColumn("best", F.max("cosine").over(Window.partitionBy("source")))
    return best.select("source", "target", text.blended_relevance(F.col("cosine"), F.col("best"), F.col("heuristic")).alias("relevance"))


def _target_pool(s: SparkSession, d: str) -> DataFrame:
    docs = T.documents(s, d)
    next_one = docs.select(F.col("doc_id").alias("source"), (F.col("doc_id") + 1).alias("target"))
    return text.target_pool(docs.select(F.col("doc_id").alias("source")), docs.select(F.col("doc_id").alias("target"), "age_days"), next_one, CFG)


def _keyword_match(s: SparkSession, d: str) -> DataFrame:
    docs = T.documents(s, d)
    word = docs.select(F.col("doc_id").alias("a"), F.lower(F.regexp_extract("title", r"[A-Za-z]+", 0)).alias("keyword")).where("keyword != ''")
    met = _pairs(s, d).join(word, "a").join(docs.select(F.col("doc_id").alias("b"), "text"), "b")
    found = F.expr(r"text rlike concat('(?iu)(?<![\\p{L}\\p{N}\\p{M}_&])', keyword, '(?![\\p{L}\\p{N}\\p{M}_])')")
    return met.select("a", "b", "keyword", found.alias("found"))


def _page_links(s: SparkSession, d: str) -> DataFrame:
    return links.extract_links(T.read(s, d, "pages"), "page_id", "url", "html", CFG)


def _internal(s: SparkSession, d: str) -> DataFrame:
    pages = T.read(s, d, "pages").select(F.col("page_id").alias("source_id"), F.col("url").alias("base"))
    return _page_links(s, d).join(pages, "source_id").where(urls.is_internal(F.col("url"), F.col("base"))).groupBy("source_id").agg(F.count("*").alias("internal_links"))


def _title_keywords(s: SparkSession, d: str) -> DataFrame:
    @F.pandas_udf("array<string>")
    def found(titles):
        return titles.map(lambda t: keywords.title_keywords(t, CFG.min_words))

    return T.documents(s, d).select("doc_id", F.posexplode(found("title")).alias("pos", "keyword"))


def _topic_phrases(s: SparkSession, d: str) -> DataFrame:
    """Phrases of each document; frequencies of its own terms come by join, as the list of its eight top terms is all that phrases need."""
    docs, n = T.documents(s, d), T.read(s, d, "documents").count()
    top = text.top_terms(text.weights(_tokens(s, d), n), CFG.top_terms)
    held = top.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("term", F.struct("tf", "df", "rank")))).alias("top"))

    @F.pandas_udf("array<string>")
    def found(titles, tops):
        import pandas as pd

        def one(title: str, top: dict | None) -> list[str]:
            ranked = sorted((top or {}).items(), key=lambda x: x[1]["rank"])
            return keywords.topic_phrases(title or "", {t: v["tf"] for t, v in ranked}, {t: v["df"] for t, v in ranked}, n, CFG.top_terms, CFG.min_single_word)

        return pd.Series([one(t, v) for t, v in zip(titles, tops, strict=True)])

    return docs.join(held, "doc_id", "left").select("doc_id", F.posexplode(found("title", "top")).alias("pos", "phrase"))


def _insert_link(s: SparkSession, d: str) -> DataFrame:
    @F.pandas_udf("string")
    def put(html, keyword):
        import pandas as pd

        return pd.Series([linker.insert(h or "", k or "", "https://example.test/?a=1&b=2") for h, k in zip(html, keyword, strict=True)])

    word = F.regexp_extract("html", r"<p>[^<]*?([A-Za-z]{4,})", 1)
    return T.read(s, d, "pages").select("page_id", word.alias("keyword"), put("html", word).alias("new_content"))


def _keyword_context(s: SparkSession, d: str) -> DataFrame:
    @F.pandas_udf("string")
    def around(html, keyword):
        import pandas as pd

        return pd.Series([linker.keyword_context(h or "", k or "") for h, k in zip(html, keyword, strict=True)])

    word = F.regexp_extract("html", r"<p>[^<]*?([A-Za-z]{4,})", 1)
    return T.read(s, d, "pages").select("page_id", word.alias("keyword"), around("html", word).alias("context"))


def _suggestions(s: SparkSession, d: str) -> DataFrame:
    rows = T.documents(s, d).select(F.col("doc_id").alias("id"), "title", F.col("text").alias("content"), "age_days", F.array("category").alias("categories"))
    return suggest.generate(rows, rows, rows.select(F.col("id").alias("source"), (F.col("id") + 1).alias("target")), CFG)


def _incremental(s: SparkSession, d: str) -> DataFrame:
    """An index without the links of every tenth post and with other links of theirs, brought up to date."""
    posts, now = T.posts(s, d), T.links(s, d)
    changed = now.where("source_post_id % 10 = 1").select(F.col("source_post_id").alias("post_id")).distinct()
    old = now.where("source_post_id % 10 != 1").unionByName(now.where("source_post_id % 10 = 1 and pos = 1").withColumn("target_post_id", F.col("target_post_id") + 1))
    fresh = now.where("source_post_id % 10 = 1")
    return changes.recount(changes.replace_links(old, changed, fresh), old, stats.compute(old, posts, CFG), changed, posts, CFG, changed.limit(0))


def _lifecycle(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Every tenth post saved with its first two links alone, every tenth trashed, deleted and published: index and figures brought up to date."""
    before, k = T.posts(s, d), F.col("id") % 10
    links_before = scope.prune(T.links(s, d), before, CFG)
    after = before.where(k != 4).withColumn("status", F.when(k == 2, "trash").when(k == 5, "publish").otherwise(F.col("status")))
    op = F.when(k == 1, "save").when(k == 2, "trash").when(k == 4, "delete").when(k == 5, "publish")
    told = before.select(F.col("id").alias("post_id"), op.alias("op")).where("op is not null")
    feed = told.select("post_id", F.lit(2).alias("seq"), "op").unionByName(told.select("post_id", F.lit(1).alias("seq"), F.lit("save").alias("op")))
    fresh = T.links(s, d).where("source_post_id % 10 != 1 or pos <= 2")
    return changes.apply_changes(links_before, stats.compute(links_before, before, CFG), feed, fresh, after, CFG)


def _stored(s: SparkSession, d: str) -> DataFrame:
    """A pass over the sources with even ids, whose first links stand for what was generated."""
    made = T.links(s, d).where("pos = 1").select("source_post_id", "target_post_id", F.lit("anew").alias("keyword"), F.lit(50.0).alias("relevance_score"))
    passed = T.posts(s, d).where("id % 2 = 0").select(F.col("id").alias("source_post_id"))
    return suggest.store(T.suggestions(s, d), made, passed).select("source_post_id", "target_post_id", "keyword", "relevance_score", "status")


def _status(s: SparkSession, d: str) -> DataFrame:
    """Changes of every seventh id, many of them of no suggestion, every third to a status that is none."""
    asked = T.suggestions(s, d).where("id % 7 = 0").select((F.col("id") + F.when(F.col("id") % 2 == 0, 9).otherwise(0)).alias("id"), F.when(F.col("id") % 3 == 0, "lost").otherwise("applied").alias("status"))
    return reports.set_status(T.suggestions(s, d), asked)[1]


def _build_index(s: SparkSession, d: str) -> DataFrame:
    """Pages as posts whose address is the first link of their menu, some of them drafts or attachments."""
    k, first = F.col("page_id"), F.regexp_extract("html", '<a href="/([^"]*)"', 1)
    posts = T.read(s, d, "pages").select(
        k.alias("id"), F.when(k % 5 == 3, "draft").when(k % 7 == 2, "inherit").otherwise("publish").alias("status"), F.when((k % 7 == 2) & (k % 5 != 3), "attachment").otherwise("post").alias("type"),
        F.col("html").alias("content"), F.concat(F.lit(CFG.site_url + "/"), first, F.lit("/")).alias("permalink"), first.alias("slug"), F.lit(None).cast("string").alias("desired_slug"), F.array(F.lit(1).cast("long")).alias("category_ids"),
    )
    return links.build_index(posts, CFG).select("source_post_id", "pos", "target_post_id", "link_url")


def _rerank(s: SparkSession, d: str) -> DataFrame:
    """Canned replies: every third source gets none, the others one score for each odd candidate, some out of bounds, in prose."""
    order = Window.partitionBy("source_post_id").orderBy(F.desc("relevance_score"), "id")
    cands = T.suggestions(s, d).select(F.col("source_post_id").alias("source"), F.row_number().over(order).alias("number"), F.col("relevance_score").alias("relevance"))
    asked = cands.groupBy("source").agg(F.count("*").cast("int").alias("n"))
    pairs = F.transform(F.filter(F.sequence(F.lit(1), F.col("n")), lambda i: i % 2 == 1), lambda i: F.concat(F.lit('"'), i.cast("string"), F.lit('": '), ((F.col("source") + i) % 140).cast("string")))
    reply = F.when(F.col("source") % 3 == 2, "no scores today").otherwise(F.concat(F.lit("Here: {"), F.array_join(pairs, ", "), F.lit("}")))
    return rerank.override(cands, rerank.scores(asked.select("source", reply.alias("reply"), "n")))


def _prompts(s: SparkSession, d: str) -> DataFrame:
    """Each document as a source, its three successors as candidates with their first title words as the phrase."""
    docs = T.documents(s, d)
    found = docs.select(F.col("doc_id").alias("target"), "title", F.col("text").alias("excerpt"), F.array_join(F.slice(F.split("title", " "), 1, 3), " ").alias("keyword"))
    cands = _pools(s, d).join(found, "target").withColumn("number", (F.col("target") - F.col("source")).cast("int"))
    return rerank.prompts(docs.select(F.col("doc_id").alias("source"), "title", "text"), cands, CFG)


def queries() -> dict[str, Query]:
    return {
        "in_scope_posts": lambda s, d: scope.scoped(T.posts(s, d), CFG).select("id", "status", "type"),
        "suggestion_sources": lambda s, d: scope.suggestion_sources(T.posts(s, d), CFG).select("id"),
        "prune_index": lambda s, d: scope.prune(T.links(s, d), T.posts(s, d), CFG),
        "outbound_counts": lambda s, d: stats.outbound(T.links(s, d)),
        "inbound_counts": lambda s, d: stats.inbound(T.links(s, d)),
        "linking_sources": lambda s, d: scope.linking_sources(T.links(s, d), T.posts(s, d).where("status = 'draft'").select(F.col("id").alias("target_post_id"))),
        "post_type_labels": lambda s, d: T.posts(s, d).select("id", reports.type_label(F.col("type"), CFG).alias("label")),
        "affected_posts": lambda s, d: scope.affected(T.links(s, d), _stats(s, d)),
        "orphan_scores": _stats,
        "orphan_priority": lambda s, d: _stats(s, d).select("post_id", stats.priority(F.col("orphan_score")).alias("priority")),
        "orphan_posts": lambda s, d: reports.orphans(_stats(s, d), T.posts(s, d), CFG).select("post_id", "title", "type", "orphan_score", "priority"),
        "low_outbound_posts": lambda s, d: reports.low_outbound(_stats(s, d), T.posts(s, d), CFG).select("post_id", "title", "outbound_count"),
        "top_linked_posts": lambda s, d: reports.top_linked(_stats(s, d), T.posts(s, d)).select("post_id", "title", "inbound_count"),
        "count_orphans": lambda s, d: reports.orphans(_stats(s, d), T.posts(s, d), CFG, None).agg(F.count("*").alias("n")),
        "count_low_outbound": lambda s, d: reports.low_outbound(_stats(s, d), T.posts(s, d), CFG, None).agg(F.count("*").alias("n")),
        "summary": lambda s, d: reports.summary(_stats(s, d), T.posts(s, d), T.links(s, d), T.suggestions(s, d), CFG),
        "report_totals": lambda s, d: reports.report_totals(_stats(s, d), T.posts(s, d), CFG),
        "link_badge": lambda s, d: reports.link_badge(_stats(s, d)),
        "post_links": lambda s, d: reports.outbound_links(T.links(s, d), T.posts(s, d)).select("source_post_id", "pos", "target_post_id", "target_title", "target_status"),
        "inbound_links": lambda s, d: reports.inbound_links(T.links(s, d), T.posts(s, d)).select("target_post_id", "source_post_id", "pos", "source_title"),
        "broken_links": lambda s, d: reports.broken_links(T.links(s, d), T.posts(s, d)),
        "pending_suggestions": lambda s, d: reports.pending(T.suggestions(s, d), T.posts(s, d), CFG).select("id", "source_post_id", "target_post_id", "source_title", "target_title", "relevance_score"),
        "apply_outcome": lambda s, d: reports.apply_outcome(T.suggestions(s, d), T.posts(s, d), CFG),
        "unpublished_targets": lambda s, d: links.unpublished_targets(T.links(s, d).select(F.concat(F.lit(CFG.site_url), "link_url").alias("url")).distinct(), T.posts(s, d)),
        "carried_targets": lambda s, d: links.carried_targets(T.links(s, d).select("source_post_id", "link_url").distinct(), T.links(s, d), T.posts(s, d)),
        "tokenize": lambda s, d: _tokens(s, d).select("doc_id", F.array_join("tokens", " ").alias("tokens")),
        "term_frequency": lambda s, d: text.term_frequency(_tokens(s, d)).select("doc_id", "term", "tf"),
        "document_frequency": lambda s, d: text.document_frequency(_tokens(s, d)),
        "top_terms": lambda s, d: text.top_terms(text.weights(_tokens(s, d)), CFG.top_terms).select("doc_id", "term", "rank", F.round("weight", 6).alias("weight")),
        "cosine": lambda s, d: text.cosine(_pairs(s, d), text.weights(_tokens(s, d))).select("a", "b", F.round("cosine", 6).alias("cosine")),
        "batch_scores": lambda s, d: text.batch_scores(_pools(s, d), _tokens(s, d)).select("source", "target", F.round("cosine", 6).alias("cosine")),
        "heuristic_relevance": _heuristic,
        "blended_relevance": _blended,
        "target_pool": _target_pool,
        "front_runners": lambda s, d: text.top_k(T.suggestions(s, d), "source_post_id", "relevance_score", "id", CFG.front_runners).select("source_post_id", "id", "relevance_score", "rank"),
        "title_keywords": _title_keywords,
        "topic_phrases": _topic_phrases,
        "keyword_match": _keyword_match,
        "matchable_text": lambda s, d: T.read(s, d, "pages").select("page_id", links.matchable(F.col("html")).alias("matchable")),
        "extract_links": lambda s, d: _page_links(s, d).select("source_id", "pos", "link_url", "anchor_text"),
        "resolve_urls": lambda s, d: _page_links(s, d).select("source_id", "pos", "url"),
        "internal_links": _internal,
        "keyword_context": _keyword_context,
        "insert_link": _insert_link,
        "suggestions": _suggestions,
        "incremental_stats": _incremental,
        "lifecycle_stats": lambda s, d: _lifecycle(s, d)[1],
        "lifecycle_links": lambda s, d: _lifecycle(s, d)[0],
        "stored_suggestions": _stored,
        "set_status": _status,
        "build_index": _build_index,
        "scorer_prompts": _prompts,
        "rerank_override": _rerank,
    }


def oracle_sql() -> dict[str, str]:
    return dict(oracle.SQL)
