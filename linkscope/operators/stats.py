"""Degrees of the link graph and the orphan score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkscope.config import EngineConfig
from linkscope.operators.scope import excluded, published_type


def outbound(links: DataFrame) -> DataFrame:
    return links.groupBy(F.col("source_post_id").alias("post_id")).agg(F.count("*").alias("outbound_count"))


def inbound(links: DataFrame) -> DataFrame:
    """Parallel links count each; a post's links to itself don't."""
    return links.where("source_post_id != target_post_id").groupBy(F.col("target_post_id").alias("post_id")).agg(F.count("*").alias("inbound_count"))


def orphan_score(cfg: EngineConfig) -> Column:
    """Age in months over links, weighted for sticky and much-read posts; over 100 views outweigh stickiness."""
    seconds = F.expr(f"timestampdiff(SECOND, post_date, TIMESTAMP_NTZ '{cfg.as_of}')").cast("double")
    days = F.greatest(F.lit(1.0), seconds / 86400.0)
    importance = F.when(F.coalesce(F.col("pageviews"), F.lit(0)) > 100, 2.0).when(F.col("is_sticky"), 1.5).otherwise(1.0)
    # Half up on the double itself, which every engine computes alike; round() may look at its decimal digits instead.
    return F.floor((days / 30.0) * (1.0 / (F.col("inbound_count") + 1)) * importance * 100.0 + 0.5).cast("double") / 100.0


def priority(score: Column) -> Column:
    return F.when(score > 5, "high").when(score > 2, "medium").otherwise("low")


def compute(links: DataFrame, posts: DataFrame, cfg: EngineConfig) -> DataFrame:
    """A row for each post in scope, and for published posts of excluded categories that a link touches."""
    return figures(inbound(links), outbound(links), posts, cfg)


def figures(inbound_counts: DataFrame, outbound_counts: DataFrame, posts: DataFrame, cfg: EngineConfig) -> DataFrame:
    counts = posts.where(published_type(cfg)).join(inbound_counts, F.col("id") == F.col("post_id"), "left").drop("post_id").join(outbound_counts, F.col("id") == F.col("post_id"), "left").drop("post_id")
    kept = counts.where(~excluded(cfg) | F.col("inbound_count").isNotNull() | F.col("outbound_count").isNotNull())
    filled = kept.withColumns({c: F.coalesce(F.col(c), F.lit(0)).cast("long") for c in ("inbound_count", "outbound_count")})
    return filled.select(F.col("id").alias("post_id"), "inbound_count", "outbound_count", orphan_score(cfg).alias("orphan_score"))
