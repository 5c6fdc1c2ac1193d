"""Connected components by alternating large and small stars, for links that no machine could hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkscope.llm.common import fresh_path, removed, written

#: Stars halve the depth of every tree each round, so this is beyond any table.
MAX_ROUNDS = 60


def _digest(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], int(row["h"] or 0)


def components(links: DataFrame, left: str, right: str) -> DataFrame:
    """links: pairs of ids. Gives (id, component) for every id that has a link to another; component is the smallest id reachable.

    Each round is two aggregations and two joins. The aggregations combine before the shuffle, and in the joins one side has one row a
    key, so an id with very many links is split by adaptive execution. Every round is a table in the shared folder,
    and takes the place of the one before it. Links with a
    null end are left out; repeated links and links of an id to itself change nothing.
    """
    ends = links.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v")).where(F.col(left).isNotNull() & F.col(right).isNotNull() & (F.col("u") != F.col("v")))
    path = fresh_path(links.sparkSession, "links")
    edges = written(ends.distinct(), "links", path)
    before = _digest(edges)
    for _ in range(MAX_ROUNDS if before[0] else 0):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        old, path = path, fresh_path(links.sparkSession, "stars")
        edges = written(small.unionByName(least.select("u", F.col("m").alias("v"))).where(F.col("u") != F.col("v")).distinct(), "stars", path)
        removed(links.sparkSession, old)
        now = _digest(edges)
        if now == before:
            break
        before = now
    roots = edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)
