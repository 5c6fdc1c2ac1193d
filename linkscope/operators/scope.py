"""Which posts count: published, of a scanned type, in no excluded category."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkscope.config import EngineConfig


def published_type(cfg: EngineConfig, p: str = "") -> Column:
    col = lambda c: F.col(f"{p}.{c}" if p else c)
    return (col("status") == "publish") & (col("type").isin(*cfg.post_types) if cfg.post_types else F.lit(False))


def excluded(cfg: EngineConfig, p: str = "") -> Column:
    ids = F.col(f"{p}.category_ids" if p else "category_ids")
    if not cfg.excluded_categories:
        return F.lit(False)
    return F.coalesce(F.arrays_overlap(ids, F.array(*[F.lit(c).cast("long") for c in cfg.excluded_categories])), F.lit(False))


def in_scope(cfg: EngineConfig, p: str = "") -> Column:
    return published_type(cfg, p) & ~excluded(cfg, p)


def scoped(posts: DataFrame, cfg: EngineConfig) -> DataFrame:
    return posts.where(in_scope(cfg))


def suggestion_sources(posts: DataFrame, cfg: EngineConfig) -> DataFrame:
    """Posts that may get links or be linked to: in scope and without a password."""
    return scoped(posts, cfg).where(~F.coalesce(F.col("has_password"), F.lit(False)))


def prune(links: DataFrame, posts: DataFrame, cfg: EngineConfig) -> DataFrame:
    """Links whose source is in scope; what points at a removed post stays, to be reported as broken."""
    return links.join(scoped(posts, cfg).select(F.col("id").alias("source_post_id")), "source_post_id", "left_semi")


def linking_sources(links: DataFrame, targets: DataFrame) -> DataFrame:
    """targets: target_post_id. Every post that links to one of them."""
    return links.join(targets.select("target_post_id").distinct(), "target_post_id", "left_semi").select("source_post_id").distinct()


def affected(links: DataFrame, stats: DataFrame) -> DataFrame:
    """Every post that a recount must look at: sources, targets and those with figures."""
    ids = links.select(F.col("source_post_id").alias("post_id")).union(links.select("target_post_id")).union(stats.select("post_id"))
    return ids.distinct()
