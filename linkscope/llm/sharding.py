"""Operator 6, sharding by balanced label propagation.

Documents with equal texts are linked. Every document starts on a shard by hash, its label. In each round, every group that is not yet
settled looks at where its documents' neighbours are and wishes for the shard that has most of them, of the shards with room for the whole
group; wishes are let in, larger groups first, until a shard's quota is full, and a group that is let in moves there together. A group that
fits nowhere whole takes what a shard has left, and its rest wishes again: so a group larger than a shard fills one after another. What is
not settled does not hold room, or full shards could never exchange anything. Rounds end when every group is settled, or so few rows are let
in that further rounds would not pay; ``links_kept`` tells how many links lie inside shards. Documents without links move only to even
out the counts: the law is ``rows``, counts at most one apart.

State is a row for each part of a group, never a list of its members: the part is a range of the members' hashes. Quotas are kept with
histograms of wishes, by size and, for the size that a shard cannot take as a whole, by a draw; the draw is salted with the round, so that a
wish that lost is not the one that loses again. Slots come from a two-level numbering (counts of hash buckets, then places inside a bucket), so that no shard is one task.

Defined results: a null text has size 1 and the checksum of an empty one, and no links; an empty text is a text like any other; repeated rows are
placed one by one; a null id is placed too; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkscope.llm.common import quoted, written

LAW = "rows"


#: Hashes of members run from 0 to this; sizes have LEVELS levels, four to a doubling; wishes of one level take DRAWS draws.
SPAN, LEVELS, DRAWS = 1 << 40, 161, 4096


@dataclass(frozen=True)
class ShardRules:
    shards: int = 16
    max_rounds: int = 60
    least_share: float = 1e-5
    bucket_rows: int = 20_000


def _quotas(n: int, shards: int) -> list[int]:
    return [n // shards + (j < n % shards) for j in range(shards)]


def _array(values: list) -> Column:
    return F.array(*[F.lit(v).cast("long") for v in values])


def _let_in(wishes: dict[int, int], room: int) -> tuple[int, int]:
    """The first rank, in ascending order, whose wishes do not fit any more (beyond all ranks if all fit), and the room that is left before it."""
    for rank in sorted(wishes):
        if wishes[rank] > room:
            return rank, room
        room -= wishes[rank]
    return max(wishes, default=0) + 1, room


def propagate(groups: DataFrame, quotas: list[int], rules: ShardRules) -> DataFrame:
    """groups: (grp, n, own), own being the counts of its documents by shard. Gives settled parts: (grp, low, high, shard), hashes from low up to high."""
    shards, free, all_rows = range(rules.shards), list(quotas), sum(quotas)
    parts = written(groups.select("grp", "n", "own", F.lit(0).cast("long").alias("low"), F.lit(SPAN).cast("long").alias("high")), "parts")
    settled = [parts.limit(0).select("grp", "low", "high", F.lit(0).alias("shard"))]
    for turn in range(rules.max_rounds):
        most = max(free)
        if most <= 0:
            break

        def salt(*x, turn=turn) -> Column:
            return F.xxhash64("grp", "low", *map(F.lit, x), F.lit(turn))

        # The neighbours' favourite of the shards with room for all, or at least for much of it; ties go round by the group's hash.
        whole = F.col("n") <= most
        rank = [F.struct(F.when(whole, F.lit(free[j]) >= F.col("n")).otherwise(2 * free[j] >= most).alias("room"), F.col("own")[j].alias("n"), salt(j).alias("tie"), F.lit(j).alias("j")) for j in shards]
        aimed = parts.select("*", F.greatest(*rank)["j"].alias("aim"))
        level = F.when(whole, F.lit(LEVELS) - F.least(F.floor(4 * F.log2(F.col("n").cast("double"))).cast("int"), F.lit(LEVELS - 1))).otherwise(0)
        wishing = written(aimed.select("*", F.least(F.col("n"), F.get(_array(free), F.col("aim"))).alias("ask"), level.alias("level"), F.pmod(salt("draw"), F.lit(DRAWS)).cast("int").alias("draw")), "wishes")
        by_level: dict[int, dict[int, int]] = {j: {} for j in shards}
        for r in wishing.groupBy("aim", "level").agg(F.sum("ask").alias("n")).collect():  # at most LEVELS + 1 rows a shard
            by_level[r["aim"]][r["level"]] = r["n"]
        if not any(by_level.values()):
            break
        if most > max(quotas) / 2 and any(0 in x for x in by_level.values()):  # groups larger than a shard first, or they would get parts of shards
            by_level = {j: {k: n for k, n in x.items() if k == 0} for j, x in by_level.items()}
        bar, left = zip(*(_let_in(by_level[j], free[j]) for j in shards), strict=True)
        by_draw: dict[int, dict[int, int]] = {j: {} for j in shards}
        for r in wishing.where(F.col("level") == F.get(_array(bar), F.col("aim"))).groupBy("aim", "draw").agg(F.sum("ask").alias("n")).collect():  # at most DRAWS rows a shard
            by_draw[r["aim"]][r["draw"]] = r["n"]
        draw_bar, now_free = zip(*(_let_in(by_draw[j], left[j]) for j in shards), strict=True)
        let_in, free = sum(free) - sum(now_free), list(now_free)
        edge, draw_edge = F.get(_array(bar), F.col("aim")), F.get(_array(draw_bar), F.col("aim"))
        done = (F.col("level") < edge) | ((F.col("level") == edge) & (F.col("draw") < draw_edge))
        cut = F.when(F.col("ask") < F.col("n"), F.col("low") + F.floor((F.col("high") - F.col("low")) * (F.col("ask") / F.col("n"))).cast("long")).otherwise(F.col("high"))
        moved = wishing.select("*", done.alias("done"), cut.alias("cut"))
        settled.append(moved.where("done").select("grp", "low", F.col("cut").alias("high"), F.col("aim").alias("shard")))
        rest = moved.where("done and ask < n").select("grp", (F.col("n") - F.col("ask")).alias("n"), "own", F.col("cut").alias("low"), "high")
        parts = moved.where("not done").select("grp", "n", "own", "low", "high").unionByName(rest)
        if 0 < let_in < rules.least_share * all_rows:
            break
    return reduce(DataFrame.unionByName, settled)


def assign(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: ShardRules | None = None) -> DataFrame:
    """Per row: doc_id, size, text_crc32, law, shard, slot, grown_shard (null under this law)."""
    rules = rules or ShardRules()
    text = quoted(text_col)
    whole = F.coalesce(text, F.lit(""))
    base = docs.select(
        quoted(id_col).alias("doc_id"),
        (F.octet_length(whole) + 1).cast("long").alias("size"),
        F.crc32(whole.cast("binary")).alias("text_crc32"),
        F.when(text.isNotNull(), F.sha2(text, 256)).alias("grp"),
        F.monotonically_increasing_id().alias("row"),
    )
    rows = written(base, "rows")
    n = rows.count()
    quotas = _quotas(n, rules.shards)
    homed = rows.select("*", F.pmod(F.xxhash64("row", "doc_id"), F.lit(rules.shards)).cast("int").alias("home"))
    cells = written(homed.where("grp is not null").groupBy("grp", "home").agg(F.count("*").alias("n")), "cells")
    own = F.array(*[F.coalesce(F.sum(F.when(F.col("home") == j, F.col("n"))), F.lit(0)) for j in range(rules.shards)])
    linked = cells.groupBy("grp").agg(F.sum("n").alias("n"), own.alias("own")).where("n > 1")
    # A group's rows meet its parts by home as well, so that a large group is spread.
    found = cells.join(propagate(linked, quotas, rules), "grp").select("grp", "home", "low", "high", F.col("shard").alias("moved"))
    homed = homed.select("*", F.pmod(F.xxhash64("row", F.lit("place")), F.lit(SPAN)).alias("at"))
    here = (homed["grp"] == found["grp"]) & (homed["home"] == found["home"]) & (homed["at"] >= found["low"]) & (homed["at"] < found["high"])
    # Linked documents come first in their shard, so that those without links are the ones that give way.
    n_buckets = max(1, -(-n // (rules.shards * rules.bucket_rows)))
    shard = F.coalesce(F.col("moved"), homed["home"]).alias("shard")
    bucket = (F.when(F.col("moved").isNull(), n_buckets).otherwise(0) + F.pmod(F.xxhash64("row"), F.lit(n_buckets))).cast("int").alias("bucket")
    labelled = written(homed.join(found, here, "left").select("row", "doc_id", "size", "text_crc32", shard, bucket), "labelled")
    sums = labelled.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    begins = sums.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begin"))
    inside = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("row")) - 1
    numbered = labelled.select("*", inside.alias("inside")).join(begins, ["shard", "bucket"]).select("doc_id", "size", "text_crc32", "shard", (F.col("begin") + F.col("inside")).alias("place"))
    # What lies beyond a shard's quota is numbered through all shards, and fills the gaps of the others in that order.
    held = {r["shard"]: r["n"] for r in sums.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
    over, gaps, queue = [], [], 0
    for j in range(rules.shards):
        extra = held.get(j, 0) - quotas[j]
        over.append(queue)
        queue += max(0, extra)
    at = 0
    for j in range(rules.shards):
        gap = max(0, quotas[j] - held.get(j, 0))
        gaps.append((at, at + gap, j, held.get(j, 0)))
        at += gap
    quota = F.get(_array(quotas), F.col("shard"))
    ticket = F.get(_array(over), F.col("shard")) + F.col("place") - quota
    stays = F.col("place") < quota
    new_shard, new_slot = F.lit(None).cast("int"), F.lit(None).cast("long")
    for a, b, j, h in gaps:
        if b > a:
            hit = (ticket >= a) & (ticket < b)
            new_shard, new_slot = F.when(hit, F.lit(j)).otherwise(new_shard), F.when(hit, ticket - a + h).otherwise(new_slot)
    return numbered.select(
        "doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), F.when(stays, F.col("shard")).otherwise(new_shard).cast("int").alias("shard"), F.when(stays, F.col("place")).otherwise(new_slot).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def links_kept(placed: DataFrame) -> DataFrame:
    """One row: the links between rows of ``assign`` with equal texts (by size and checksum, empty ones left out), and how many lie inside a shard."""
    cells = placed.where("size > 1").groupBy("size", "text_crc32", "shard").agg(F.count("*").alias("n"))
    groups = cells.groupBy("size", "text_crc32").agg(F.sum("n").alias("n"), F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("kept"))
    return groups.agg(F.coalesce(F.sum(F.col("n") * (F.col("n") - 1) / 2), F.lit(0)).cast("long").alias("links"), F.coalesce(F.sum("kept"), F.lit(0)).cast("long").alias("kept"))


def query(spark, sf_dir: str) -> DataFrame:
    """op6: every document of the table."""
    return assign(spark.read.parquet(f"{sf_dir}/documents.parquet"))
