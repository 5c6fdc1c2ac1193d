"""Operator 10, approximate nearest neighbours by vantage-point trees.

Vectors are dealt into shards by a hash of their id; each task builds the tree of its shard in memory and lets the queries stream past it in
blocks. A node is a vantage point; its halves, split by rank of distance, know the least and greatest distance of their points to it. A
half whose triangle-inequality bound, times ``factor``, exceeds the query's present k-th distance is passed over: factor one is exact
search, larger ones pass over more. The k best of each shard meet by query.

Defined results: vectors that are null, empty, zero or hold a null or a number that isn't finite take no part, nor do rows without an id;
vectors meet only those of their length; ties go to the smaller id; repeated rows are neighbours each; a query that is repeated asks
once; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkscope.llm.common import quoted


@dataclass(frozen=True)
class NeighbourRules:
    k: int = 10
    factor: float = 1.05
    leaf: int = 64
    least_rows: int = 2048
    shard_rows: int = 1 << 15
    block: int = 256


class VantageTree:
    """The points of a shard, reordered so that every node is a slice of them."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf: int) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors, self.leaf = ids[order], np.ascontiguousarray(vectors[order], dtype=np.float64), leaf
        self.root = self._build(0, len(ids))
        self.squares = (self.vectors**2).sum(axis=1)

    def _build(self, a: int, b: int) -> tuple:
        """(a, b) for a leaf, else (a, b, vantage point, inner, its bounds, outer, its bounds)."""
        if b - a <= self.leaf:
            return (a, b)
        point = self.vectors[a + (b - a) // 2].copy()
        d = distances(point[None, :], self.vectors[a:b])[0]
        middle = (b - a) // 2
        order = np.argpartition(d, middle)
        self.vectors[a:b], self.ids[a:b], d = self.vectors[a:b][order], self.ids[a:b][order], d[order]
        bounds = [(d[:middle].min(), d[:middle].max()), (d[middle:].min(), d[middle:].max())]
        return (a, b, point, self._build(a, a + middle), bounds[0], self._build(a + middle, b), bounds[1])

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """Distances and ids of the k nearest of each query, by distance and then id; inf and -1 where there are fewer.

        Each query first goes down to the leaf it seems to belong to, which gives a limit to its k-th distance; then all queries sweep over
        the tree together, so that a node is visited once for all whose limit it may beat.
        """
        fresh = lambda: (np.full((len(queries), k), np.inf), np.full((len(queries), k), -1, dtype=np.int64))
        everyone, first, best = np.arange(len(queries)), fresh(), fresh()
        self._visit(self.root, everyone, queries, own, first, None, factor)
        self._visit(self.root, everyone, queries, own, best, first[0][:, -1], factor)
        return best

    def _visit(self, node: tuple, some: np.ndarray, queries: np.ndarray, own: np.ndarray, best: tuple, limit: np.ndarray | None, factor: float) -> None:
        """limit: of each query's k-th distance; None to go down one way only."""
        if not len(some):
            return
        most = best[0][some, -1] if limit is None else np.minimum(best[0][some, -1], limit[some])
        if len(node) == 2:
            a, b = node
            # A product tells roughly how far each pair is; only pairs that may be among the best, errors allowed for, are measured.
            squares = (queries[some] ** 2).sum(axis=1)[:, None] + self.squares[None, a:b]
            rough = squares - 2 * (queries[some] @ self.vectors[a:b].T)
            may = (rough <= most[:, None] ** 2 + 1e-9 * squares) & (own[some][:, None] != self.ids[None, a:b])
            if not may.any():
                return
            near = np.flatnonzero(may.any(axis=1))
            some, may = some[near], may[near]
            row, column = np.nonzero(may)
            d = np.full(may.shape, np.inf)
            d[row, column] = measured(queries[some[row]], self.vectors[a + column])
            all_d = np.concatenate([best[0][some], d], axis=1)
            all_ids = np.concatenate([best[1][some], np.broadcast_to(self.ids[a:b], d.shape)], axis=1)
            all_ids = np.where(np.isinf(all_d), -1, all_ids)
            order = np.lexsort((np.where(all_ids < 0, np.iinfo(np.int64).max, all_ids), all_d))[:, : best[0].shape[1]]
            best[0][some] = np.take_along_axis(all_d, order, axis=1)
            best[1][some] = np.take_along_axis(all_ids, order, axis=1)
            return
        _, _, point, inner, (lo_in, hi_in), outer, (lo_out, hi_out) = node
        d = distances(queries[some], point[None, :])[:, 0]
        below, above = np.maximum(np.maximum(lo_in - d, d - hi_in), 0), np.maximum(np.maximum(lo_out - d, d - hi_out), 0)
        for half, bound, other in ((inner, below, above), (outer, above, below)):
            keep = (bound < other) | ((bound == other) & (half is inner)) if limit is None else bound * factor <= most * (1 + 1e-9)
            self._visit(half, some[keep], queries, own, best, limit, factor)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of each row of a to each of b, from differences, in double precision."""
    return np.sqrt(((a[:, None, :] - b[None, :, :]) ** 2).sum(axis=-1))


def measured(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distance of each row of a to that of b."""
    return np.sqrt(((a - b) ** 2).sum(axis=-1))


def _fit(vector: Column) -> Column:
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & sound & F.exists(vector, lambda x: x != 0)


def search(vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", rules: NeighbourRules | None = None) -> DataFrame:
    """queries: rows of the same columns. Gives query_id, rank, vec_id, score."""
    rules = rules or NeighbourRules()
    slim = lambda df: df.select(quoted(id_col).cast("long").alias("id"), quoted(vector_col).cast("array<double>").alias("vector")).where(F.col("id").isNotNull() & _fit(F.col("vector")))
    rows, asked = slim(vectors), slim(queries).dropDuplicates(["id"])
    n = rows.count()
    n_shards = max(1, -(-n // rules.shard_rows), min(vectors.sparkSession.sparkContext.defaultParallelism, n // rules.least_rows))
    size = F.size("vector")
    filed = rows.select(size.alias("size"), F.pmod(F.xxhash64("id"), F.lit(n_shards)).cast("int").alias("shard"), F.lit(False).alias("asks"), "id", "vector")
    spread = asked.select(size.alias("size"), F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1))).alias("shard"), F.lit(True).alias("asks"), "id", "vector")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, held, tree = None, [], [], None
        for batch in batches:
            for at in range(0, batch.num_rows, rules.block):
                some = batch.slice(at, rules.block)
                sizes, shards, asks = (some.column(c).to_numpy(zero_copy_only=False) for c in ("size", "shard", "asks"))
                cuts = np.flatnonzero((np.diff(sizes) != 0) | (np.diff(shards) != 0) | (np.diff(asks.astype(int)) != 0)) + 1
                for a, b in zip([0, *cuts], [*cuts, len(sizes)], strict=True):
                    if key != (sizes[a], shards[a]):
                        key, ids, held, tree = (sizes[a], shards[a]), [], [], None
                    part = some.slice(a, b - a)
                    own = part.column("id").to_numpy(zero_copy_only=False)
                    values = part.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(b - a, -1)
                    if not asks[a]:
                        ids.append(own)
                        held.append(values)
                        continue
                    if tree is None:
                        if not ids:
                            continue
                        tree = VantageTree(np.concatenate(ids), np.concatenate(held), rules.leaf)
                        ids, held = [True], []
                    d, found = tree.search(values, own, rules.k, rules.factor)
                    there = found >= 0 if not (tree.ids < 0).any() else ~np.isinf(d)
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(own, there.sum(axis=1))), pa.array(found[there]), pa.array(d[there])], names=["query_id", "vec_id", "score"])

    met = filed.unionByName(spread).repartition("size", "shard").sortWithinPartitions("size", "shard", "asks", "id").mapInArrow(run, "query_id long, vec_id long, score double")
    ranked = met.select("query_id", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")).alias("rank"), "vec_id", "score")
    return ranked.where(F.col("rank") <= rules.k)


def query(spark, sf_dir: str) -> DataFrame:
    """op10: the rows whose id is divisible by 100, against every row."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return search(vectors, vectors.where("vec_id % 100 = 0")).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
