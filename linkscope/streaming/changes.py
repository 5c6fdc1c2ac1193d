"""Incremental upkeep: a batch of changed posts turns the old index and figures into what a full rebuild would give."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from linkscope.config import EngineConfig
from linkscope.operators import stats
from linkscope.operators.scope import excluded, prune, published_type


def latest(changes: DataFrame) -> DataFrame:
    """changes: post_id, seq, op. The last change of each post."""
    return changes.groupBy("post_id").agg(F.max_by("op", "seq").alias("op"))


#: Operations after which a post has links of its own again; all others leave it without.
LINKED_AGAIN = ("save", "publish", "untrash")


def replace_links(links: DataFrame, changed: DataFrame, fresh: DataFrame) -> DataFrame:
    """The index without the old links of the changed posts (post_id), with their fresh ones."""
    return links.join(changed.select(F.col("post_id").alias("source_post_id")), "source_post_id", "left_anti").unionByName(fresh)


def recount(links: DataFrame, old_links: DataFrame, old_stats: DataFrame, changed: DataFrame, posts: DataFrame, cfg: EngineConfig, appeared: DataFrame | None = None) -> DataFrame:
    """Figures after a change, from the difference that the changed posts' old and new links make; the rest is kept.

    appeared: post_id of changed posts without old figures, whose links from others are counted in full; None has them looked up.
    """
    ids = changed.select(F.col("post_id").alias("source_post_id")).distinct()
    if appeared is None:
        appeared = changed.join(old_stats, "post_id", "left_anti").select("post_id").distinct()
    now = links.join(ids, "source_post_id", "left_semi").select("source_post_id", "target_post_id", F.lit(1).alias("sign"))
    was = old_links.join(ids, "source_post_id", "left_semi").select("source_post_id", "target_post_id", F.lit(-1).alias("sign"))
    no = lambda value: F.lit(value).cast("long")
    arrives = now.unionByName(was).where("source_post_id != target_post_id").select(F.col("target_post_id").alias("post_id"), F.col("sign").cast("long").alias("d_in"), no(0).alias("out"), no(0).alias("own"), no(0).alias("all_in"), no(0).alias("is_new"))
    leaves = now.select(F.col("source_post_id").alias("post_id"), no(0).alias("d_in"), no(1).alias("out"), no(0).alias("own"), no(0).alias("all_in"), no(0).alias("is_new"))
    marks = changed.select("post_id", no(0).alias("d_in"), no(0).alias("out"), no(1).alias("own"), no(0).alias("all_in"), no(0).alias("is_new"))
    to_new = links.where("source_post_id != target_post_id").join(appeared.select(F.col("post_id").alias("target_post_id")), "target_post_id", "left_semi")
    counted = to_new.select(F.col("target_post_id").alias("post_id"), no(0).alias("d_in"), no(0).alias("out"), no(0).alias("own"), no(1).alias("all_in"), no(0).alias("is_new"))
    new = appeared.select("post_id", no(0).alias("d_in"), no(0).alias("out"), no(0).alias("own"), no(0).alias("all_in"), no(1).alias("is_new"))
    rows = reduce(DataFrame.unionByName, (arrives, leaves, marks, counted, new))
    touched = rows.groupBy("post_id").agg(*[F.sum(c).alias(c) for c in ("d_in", "out", "all_in")], F.max("own").alias("own"), F.max("is_new").alias("is_new"))
    shown = posts.where(published_type(cfg)).select("id", "post_date", "pageviews", "is_sticky", excluded(cfg).alias("barred"))
    near = touched.join(shown, F.col("post_id") == F.col("id"), "left")
    met = old_stats.withColumnsRenamed({"inbound_count": "old_in", "outbound_count": "old_out", "orphan_score": "old_score", "post_id": "old_id"}).join(near, F.col("old_id") == F.col("post_id"), "full_outer")
    fresh_in = F.when(F.col("is_new") == 1, F.col("all_in")).otherwise(F.coalesce("old_in", F.lit(0)) + F.col("d_in"))
    fresh_out = F.when(F.col("own") == 1, F.col("out")).otherwise(F.coalesce("old_out", F.lit(0)))
    same = F.col("post_id").isNull()
    told = met.select("*", F.when(same, F.col("old_in")).otherwise(fresh_in).alias("inbound_count"), F.when(same, F.col("old_out")).otherwise(fresh_out).alias("outbound_count"))
    kept = told.where(same | F.col("id").isNotNull() & (~F.col("barred") | (F.col("inbound_count") > 0) | (F.col("outbound_count") > 0)))
    return kept.select(F.coalesce("post_id", "old_id").alias("post_id"), "inbound_count", "outbound_count", F.when(same, F.col("old_score")).otherwise(stats.orphan_score(cfg)).alias("orphan_score"))


def apply_changes(links: DataFrame, old_stats: DataFrame, changes: DataFrame, fresh: DataFrame, posts: DataFrame, cfg: EngineConfig) -> tuple[DataFrame, DataFrame]:
    """Links and figures after a batch of changes (post_id, seq, op); posts is the table after it, fresh the links found in it.

    A saved, published or restored post has its fresh links, if it is in scope; one that left publication, was trashed or deleted has none
    and no figures. Without auto_scan, saves are left to the next full scan. Links that point at a removed post stay, to be reported as broken.
    """
    changed = latest(changes if cfg.auto_scan else changes.where("op != 'save'"))
    again = changed.where(F.col("op").isin(*LINKED_AGAIN)).select(F.col("post_id").alias("source_post_id"))
    found = prune(fresh.join(again, "source_post_id", "left_semi"), posts, cfg)
    now = replace_links(links, changed, found)
    return now, recount(now, links, old_stats, changed, posts, cfg)


def stream_of(feed: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> DataStreamWriter:
    """feed: a stream of changes. Each micro-batch's last changes go to handle, which reads, applies and writes a new version."""
    return feed.writeStream.foreachBatch(lambda batch, n: handle(latest(batch), n)).option("checkpointLocation", checkpoint)
