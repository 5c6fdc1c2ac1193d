"""Reports over posts, links, stats and suggestions. Limits are features: a report's top rows, ties by id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkscope.config import EngineConfig
from linkscope.operators.scope import in_scope, scoped
from linkscope.operators.stats import priority

LABELS = {"publish": "Published", "draft": "Draft", "pending": "Pending review", "future": "Scheduled", "trash": "Trashed", "private": "Private"}


def _joined(stats: DataFrame, posts: DataFrame, cfg: EngineConfig) -> DataFrame:
    return stats.join(scoped(posts, cfg).select(F.col("id").alias("post_id"), "title", "type", "post_date"), "post_id")


def orphans(stats: DataFrame, posts: DataFrame, cfg: EngineConfig, limit: int | None = 50) -> DataFrame:
    found = _joined(stats.where("inbound_count = 0"), posts, cfg).withColumn("priority", priority(F.col("orphan_score")))
    return found.orderBy(F.desc("orphan_score"), "post_id").limit(limit) if limit else found


def low_outbound(stats: DataFrame, posts: DataFrame, cfg: EngineConfig, limit: int | None = 50) -> DataFrame:
    found = _joined(stats.where(F.col("outbound_count") <= cfg.max_outbound), posts, cfg)
    return found.orderBy("outbound_count", F.desc("post_date"), "post_id").limit(limit) if limit else found


def top_linked(stats: DataFrame, posts: DataFrame, limit: int = 20) -> DataFrame:
    """Published posts of any type and category."""
    live = posts.where("status = 'publish'").select(F.col("id").alias("post_id"), "title", "type")
    return stats.where("inbound_count > 0").join(live, "post_id").orderBy(F.desc("inbound_count"), "post_id").limit(limit)


def outbound_links(links: DataFrame, posts: DataFrame) -> DataFrame:
    """Links with the posts they lead to."""
    return links.join(posts.select(F.col("id").alias("target_post_id"), F.col("title").alias("target_title"), F.col("status").alias("target_status")), "target_post_id")


def inbound_links(links: DataFrame, posts: DataFrame) -> DataFrame:
    """Links with the posts they come from."""
    return links.join(posts.select(F.col("id").alias("source_post_id"), F.col("title").alias("source_title")), "source_post_id")


def status_label(status: Column) -> Column:
    labels = F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])
    return F.when(F.coalesce(status, F.lit("")) == "", "Deleted").otherwise(F.coalesce(F.try_element_at(labels, status), status))


def broken_links(links: DataFrame, posts: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Links to posts that readers can't see. An attachment is seen if it has no parent, or its parent is gone, published or private.

    files: column link_url, of links that lead to an uploaded file.
    """
    source = posts.select(F.col("id").alias("source_post_id"), F.col("title").alias("source_title"))
    target = posts.select(F.col("id").alias("t_id"), F.col("title").alias("target_title"), F.col("status").alias("t_status"), F.col("type").alias("t_type"), F.col("parent_id").alias("t_parent"))
    parent = posts.select(F.col("id").alias("p_id"), F.col("status").alias("p_status"))
    # Parents are joined to the few posts that have one. In a join with links, all that lead to a post without one, or to none, would have one key.
    child = F.coalesce(F.col("t_parent") > 0, F.lit(False))
    alone = target.where(~child).select("*", F.lit(None).cast("long").alias("p_id"), F.lit(None).cast("string").alias("p_status"))
    targets = target.where(child).join(parent, F.col("p_id") == F.col("t_parent"), "left").unionByName(alone)
    met = links.join(source, "source_post_id").join(targets, F.col("target_post_id") == F.col("t_id"), "left")
    met = met.where(F.col("t_id").isNull() | ~F.col("t_status").isin("publish", "private"))
    inherits = (F.col("t_status") == "inherit") & (F.col("t_type") == "attachment")
    seen = inherits & ((F.coalesce(F.col("t_parent"), F.lit(0)) == 0) | F.col("p_id").isNull() | F.col("p_status").isin("publish", "private"))
    found = met.where(~F.coalesce(seen, F.lit(False)))
    if files is not None:
        found = found.join(files.select("link_url").distinct(), "link_url", "left_anti")
    status = F.when(inherits, F.col("p_status")).otherwise(F.col("t_status"))
    return found.select("source_post_id", "pos", "target_post_id", "link_url", "source_title", "target_title", status.alias("target_status"), status_label(status).alias("target_label"))


def pending(suggestions: DataFrame, posts: DataFrame, cfg: EngineConfig, limit: int | None = 50) -> DataFrame:
    """Pending suggestions between posts in scope."""
    live = scoped(posts, cfg)
    found = suggestions.where("status = 'pending'")
    found = found.join(live.select(F.col("id").alias("source_post_id"), F.col("title").alias("source_title")), "source_post_id").join(live.select(F.col("id").alias("target_post_id"), F.col("title").alias("target_title")), "target_post_id")
    return found.orderBy(F.desc("relevance_score"), "id").limit(limit) if limit else found


def summary(stats: DataFrame, posts: DataFrame, links: DataFrame, suggestions: DataFrame, cfg: EngineConfig) -> DataFrame:
    """One row; links in all and broken links are not scoped, the rest is."""
    inside = _joined(stats, posts, cfg).agg(
        F.count("*").alias("total_posts"),
        F.count_if(F.col("inbound_count") == 0).alias("orphan_posts"),
        F.count_if(F.col("outbound_count") <= cfg.max_outbound).alias("low_outbound"),
        F.round(F.round(F.avg("inbound_count"), 4), 1).alias("avg_inbound"),
        F.round(F.round(F.avg("outbound_count"), 4), 1).alias("avg_outbound"),
    )
    one = lambda df, name: df.agg(F.count("*").alias(name))
    for df, name in ((links, "total_links"), (broken_links(links, posts), "broken_links"), (pending(suggestions, posts, cfg, None), "pending_suggestions")):
        inside = inside.join(one(df, name))  # one row on either side
    return inside


def report_totals(stats: DataFrame, posts: DataFrame, cfg: EngineConfig, shown: int = 100) -> DataFrame:
    """How many rows a list shows of how many."""
    parts = [("orphans", orphans(stats, posts, cfg, None)), ("low_outbound", low_outbound(stats, posts, cfg, None))]
    rows = [df.agg(F.count("*").alias("total")).select(F.lit(name).alias("report"), F.least(F.col("total"), F.lit(shown)).alias("shown"), "total") for name, df in parts]
    return rows[0].unionByName(rows[1])


def link_badge(stats: DataFrame) -> DataFrame:
    return stats.select("post_id", F.concat(F.lit("↓"), F.col("inbound_count").cast("string"), F.lit(" ↑"), F.col("outbound_count").cast("string")).alias("badge"))


def apply_outcome(suggestions: DataFrame, posts: DataFrame, cfg: EngineConfig) -> DataFrame:
    """What applying each suggestion comes to, by the guards in their order, and the source's new content where it is applied."""
    src = posts.select(F.col("id").alias("s_id"), F.col("content").alias("s_content"), in_scope(cfg).alias("s_ok"))
    tgt = posts.select(F.col("id").alias("t_id"), F.col("permalink").alias("t_url"), in_scope(cfg).alias("t_ok"))
    met = suggestions.join(src, F.col("source_post_id") == F.col("s_id"), "left").join(tgt, F.col("target_post_id") == F.col("t_id"), "left")
    guard = (
        F.when(F.col("status") != "pending", "not_pending")
        .when(F.col("source_post_id") == F.col("target_post_id"), "same_post")
        .when(F.col("s_id").isNull() | F.col("t_id").isNull(), "post_missing")
        .when(~(F.col("s_ok") & F.col("t_ok")), "out_of_scope")
        .when(F.trim("keyword") == "", "keyword_missing")
    )
    shortcodes = cfg.shortcodes

    @F.pandas_udf("string")
    def linked(contents, keywords, urls):
        import pandas as pd

        from linkscope.functions.linker import insert

        return pd.Series([None if c is None or k is None else insert(c, k, u or "", shortcodes) for c, k, u in zip(contents, keywords, urls, strict=True)], dtype=object)

    # The linker reads only what passes the guards.
    guarded = met.select("id", guard.alias("guard"), F.when(guard.isNull(), F.col("s_content")).alias("content"), "keyword", "t_url")
    tried = guarded.select("id", "guard", linked("content", "keyword", "t_url").alias("new_content"))
    return tried.select("id", F.coalesce("guard", F.when(F.col("new_content").isNull(), "keyword_missing").otherwise("ok")).alias("outcome"), "new_content")


def set_status(suggestions: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """changes: id, status. The table with the new statuses, and for each change whether it succeeded: the suggestion is there, the status a known one."""
    wanted = changes.groupBy("id").agg(F.max("status").alias("new_status"))
    known = F.col("new_status").isin("pending", "applied", "dismissed")
    after = suggestions.join(wanted, "id", "left").withColumn("status", F.when(known, F.col("new_status")).otherwise(F.col("status"))).select(suggestions.columns)
    done = wanted.join(suggestions.select("id", F.lit(True).alias("there")).distinct(), "id", "left").select("id", F.coalesce(F.col("there") & known, F.lit(False)).alias("succeeded"))
    return after, done


def type_label(kind: Column, cfg: EngineConfig) -> Column:
    """The label of a post type, or the type itself if none is configured."""
    label = F.when(F.lit(False), kind)
    for name, shown in cfg.type_labels:
        label = label.when(kind == name, F.lit(shown)) if shown else label
    return label.otherwise(kind)


def highlight(context: Column, keyword: str) -> Column:
    """The context as HTML text, the keyword marked."""
    import re

    safe = context
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#039;")):
        safe = F.replace(safe, F.lit(a), F.lit(b))
    escaped = keyword
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#039;")):
        escaped = escaped.replace(a, b)
    return F.regexp_replace(safe, "(?iu)(" + re.sub(r"([^\w\s])", r"\\\1", escaped) + ")", "<mark>$1</mark>") if keyword else safe
