"""Operator 5, SimHash near-dedup by pigeonring filtering.

Fingerprints are made in Arrow batches, equal ones are folded into one, and candidates come from chains: with m segments and a budget of
k bits, a pair within k bits has a segment from which every chain of l consecutive segments (round the ring) differs in at most
floor(l * k / m) bits. With m = 5 and k = 4 the first segment of such a chain is equal and the second differs in at most one bit, so
each fingerprint is filed under its own first two segments, and under the variants of the second with one bit turned: 75 short rows a
fingerprint, with keys of 26 bits. Of a pair, one finds the other's own key among its variants, so only own rows meet own and variant
rows, never variants each other: of N fingerprints, a row meets N / 2 ** 26 own ones, 15 at 1e9 and 745 at 5e10 fingerprints, in memory
and some nanoseconds each. Longer chains prune these pairs before the full check, and of the pairs that pass it, a batch hands on a forest
that joins the same fingerprints.

A key with more than ``run_limit`` own rows, and more than 16 times what evenly spread fingerprints would give it, would be a block of all
pairs. Its fingerprints go another, equally exact way: any two of them within 4 bits share a point within 2 bits of both, so each is filed
under its 2,081 points within 2 bits, and the members of a point, all within 4 bits of each other, are linked in a star. The work is in
proportion to these fingerprints, however many are alike. The limit grows with N, so that this stays the way of dense groups alone.

Defined results: a null text, an empty one and one without words have fingerprint 0 and are linked like any other; repeated rows give
repeated rows; a null id has a fingerprint, and its component is the smallest id that shares it, or null; empty tables give empty
results; further columns are ignored by ``groups`` and kept by ``keep_one``,
which keeps one row of each group, rows without an id among them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkscope.llm.common import first_of_groups, quoted, written
from linkscope.llm.graph import components

SEED = 42
BITS = 64
#: Shingles hashed at a time, so that a text of any length takes bounded memory besides itself.
BLOCK = 1 << 16
#: Pairs of a batch that are held before they shrink to a forest.
PAIRS = 1 << 20


@dataclass(frozen=True)
class SimHashRules:
    shingle: int = 4
    max_bits: int = 4
    segments: int = 5
    run_limit: int = 256

    def __post_init__(self) -> None:
        if not 0 < self.max_bits < self.segments <= 2 * self.max_bits + 1:
            raise ValueError("chains of two need max_bits < segments <= 2 * max_bits + 1")


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """A bit is 1 if it is set in over half of the shingles' hashes."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    n = max(1, len(words) - shingle + 1)
    first, last = starts[:n].tolist(), ends[min(shingle, len(words)) - 1 :].tolist()
    digest, sums = xxhash.xxh64_intdigest, np.zeros(BITS, dtype=np.int64)
    for at in range(0, n, BLOCK):
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(first[at : at + BLOCK], last[at : at + BLOCK], strict=True)], dtype="<u8")
        sums += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * sums > n, bitorder="little").view("<u8")[0])


def _widths(segments: int) -> list[int]:
    return [BITS // segments + (i < BITS % segments) for i in range(segments)]


def chain_masks(rules: SimHashRules) -> list[list[int]]:
    """By first segment: the bits of chains of 1, 2, ... segments round the ring."""
    low, own = 0, []
    for w in _widths(rules.segments):
        own.append(((1 << w) - 1) << low)
        low += w
    return [[sum(own[(i + k) % rules.segments] for k in range(n)) for n in range(1, rules.segments + 1)] for i in range(rules.segments)]


def chain_keys(prints: np.ndarray, rules: SimHashRules) -> tuple[np.ndarray, np.ndarray]:
    """Keys and, for each, the position of its fingerprint: the first two segments of each chain, and their variants.

    The lowest bit of a key tells variants from own segments, so that sorted rows of one key begin with the own ones.
    """
    own, all_keys, rows = np.arange(len(prints)), [], []
    for i, masks in enumerate(chain_masks(rules)):
        second = masks[1] & ~masks[0]
        variants = np.array([0, *(1 << b for b in range(BITS) if second >> b & 1)], dtype=np.uint64)
        turned = (prints & np.uint64(masks[1]))[:, None] ^ variants[None, :]
        low = np.uint64(sum(_widths(rules.segments)[:i]))
        packed = (turned >> low) | (turned << (np.uint64(BITS) - low)) if low else turned  # the chain's bits come to lie lowest
        mixed = (packed << np.uint64(5)) | np.uint64(i << 1) | (variants != 0).astype(np.uint64)[None, :]
        all_keys.append(mixed.ravel())
        rows.append(np.repeat(own, len(variants)))
    return np.concatenate(all_keys), np.concatenate(rows)


def points_within_two() -> np.ndarray:
    one = [1 << b for b in range(BITS)]
    return np.array([0, *one, *(a | b for a, b in combinations(one, 2))], dtype=np.uint64)


def _batches(schema: pa.Schema, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(columns[0]), 1 << 17):
        yield pa.RecordBatch.from_arrays([pa.array(c[at : at + (1 << 17)]) for c in columns], schema=schema)


KEYED = pa.schema([("key", pa.int64()), ("print", pa.int64())])
LINKED = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("hot", pa.bool_())])


def _file(make, step: int):
    """A mapInArrow function that files each fingerprint under its keys, step fingerprints at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = batch.column("print").to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(prints), step):
                some = prints[at : at + step]
                keys, rows = make(some)
                yield from _batches(KEYED, keys.view(np.int64), some[rows].view(np.int64))

    return run


def _near(a: np.ndarray, b: np.ndarray, rules: SimHashRules, masks: list[list[int]]) -> np.ndarray:
    """Pairs with a chain whose every length keeps its budget, then the full check."""
    x = a ^ b
    good = np.zeros(len(x), dtype=bool)
    for chain in masks:
        ok = np.ones(len(x), dtype=bool)
        for n, mask in enumerate(chain[:-1], 1):
            ok &= np.bitwise_count(x & np.uint64(mask)) <= n * rules.max_bits // rules.segments
        good |= ok
    good[good] = np.bitwise_count(x[good]) <= rules.max_bits
    return good


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Keys and fingerprints of sorted rows, batch by batch; the next batch begins with the first row of the key that the last one ended in."""
    keys, prints = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64)
    for batch in batches:
        keys = np.concatenate([keys, batch.column("key").to_numpy(zero_copy_only=False)])
        prints = np.concatenate([prints, batch.column("print").to_numpy(zero_copy_only=False).view(np.uint64)])
        if len(keys):
            yield keys, prints
            first = int(np.searchsorted(keys, keys[-1]))
            keys, prints = keys[first : first + 1], prints[first : first + 1]


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what the pairs (a, b) join, each fingerprint to the smallest it reaches: fewer than there are fingerprints."""
    nodes, places = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = places[: len(a)], places[len(a) :]
    label = np.arange(len(nodes))
    while (label[u] != label[v]).any():
        np.minimum.at(label, np.maximum(label[u], label[v]), np.minimum(label[u], label[v]))
        while (label[label] != label).any():
            label = label[label]
    own = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[label[own]], nodes[own]


def _emit(a: list[np.ndarray], b: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    if any(map(len, a)):
        roots, members = forest(np.concatenate(a), np.concatenate(b))
        yield from _batches(LINKED, roots.view(np.int64), members.view(np.int64), np.zeros(len(roots), dtype=bool))


def _compared(keys: np.ndarray, prints: np.ndarray, variant: np.ndarray, hot: np.ndarray, rules: SimHashRules, masks: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Near pairs of the rows of a batch: each row with the own rows of its key, those before it for an own row."""
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    run = np.cumsum(np.r_[True, keys[1:] != keys[:-1]]) - 1
    owns = np.add.reduceat(~variant, first)
    begin = first[run]
    # How many own rows a row still meets: an own row those before it.
    meets = np.where(hot, 0, np.where(variant, owns[run], np.arange(len(keys)) - begin))
    at, some_a, some_b = np.flatnonzero(meets > 0), [], []
    held = d = 0
    while len(at):
        a, b = prints[at], prints[begin[at] + d]
        ok = (a != b) & (np.bitwise_count(a ^ b) <= rules.max_bits)
        ok[ok] = _near(a[ok], b[ok], rules, masks)
        some_a.append(a[ok])
        some_b.append(b[ok])
        held += len(some_a[-1])
        if held > PAIRS:  # those so far shrink to a forest
            roots, members = forest(np.concatenate(some_a), np.concatenate(some_b))
            some_a, some_b, held = [roots], [members], 0
        d += 1
        at = at[meets[at] > d]
    return (np.concatenate(some_a), np.concatenate(some_b)) if some_a else (np.empty(0, np.uint64), np.empty(0, np.uint64))


def _pairs_of_runs(rules: SimHashRules, limit: int):
    """Sorted rows to links, and to the fingerprints of keys with more than limit own rows, marked hot.

    A key's own rows come first; they are carried from batch to batch until the key ends, at most limit of them, after which the key is
    known to be hot and stays so to its end.
    """
    masks = chain_masks(rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, was_hot, carried = None, False, np.empty(0, dtype=np.uint64)
        for batch in batches:
            filed = batch.column("key").to_numpy(zero_copy_only=False)
            prints = batch.column("print").to_numpy(zero_copy_only=False).view(np.uint64)
            if not len(filed):
                continue
            keys, variant = filed >> 1, (filed & 1).astype(bool)
            if keys[0] != now:
                was_hot, carried = False, carried[:0]
            old = len(carried)
            if old:
                keys, prints, variant = np.r_[np.full(old, now), keys], np.r_[carried, prints], np.r_[np.zeros(old, dtype=bool), variant]
            first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            over = np.add.reduceat(~variant, first) > limit
            over[0] |= was_hot
            hot = np.repeat(over, np.diff(np.r_[first, len(keys)]))
            found = np.unique(prints[hot])
            yield from _batches(LINKED, found.view(np.int64), found.view(np.int64), np.ones(len(found), dtype=bool))
            a, b = _compared(keys, prints, variant, hot, rules, masks)
            yield from _emit([a], [b])
            now, was_hot = keys[-1], bool(over[-1])
            carried = prints[first[-1] :][~variant[first[-1] :]] if not was_hot else prints[:0]

    return run


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links the members of each point to its first; a batch hands on a forest."""
    for keys, prints in _runs(batches):
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        head = np.repeat(prints[first], np.diff(np.r_[first, len(keys)]))
        yield from _emit([head[head != prints]], [prints[head != prints]])


def links(prints: DataFrame, rules: SimHashRules) -> DataFrame:
    """prints: distinct fingerprints in a column print. Gives pairs (a, b) that link all that lie within max_bits, directly or in chains."""
    limit = max(rules.run_limit, 16 * prints.count() >> sum(_widths(rules.segments)[-2:]))
    filed = prints.mapInArrow(_file(lambda x: chain_keys(x, rules), 4096), "key long, print long")
    met = written(filed.repartition(F.shiftright("key", 1)).sortWithinPartitions("key", "print").mapInArrow(_pairs_of_runs(rules, limit), "a long, b long, hot boolean"), "candidates")
    near = np.array([0, *(1 << b for b in range(BITS))], dtype=np.uint64) if rules.max_bits <= 2 else points_within_two()
    if rules.max_bits > 4:
        raise ValueError("runs beyond run_limit are exact up to 4 bits")
    points = lambda x: ((x[:, None] ^ near[None, :]).ravel(), np.repeat(np.arange(len(x)), len(near)))
    hot = met.where("hot").select(F.col("a").alias("print")).distinct().mapInArrow(_file(points, 64), "key long, print long")
    starred = hot.repartition("key").sortWithinPartitions("key", "print").mapInArrow(_stars, "a long, b long, hot boolean")
    return met.where("not hot").unionByName(starred).select("a", "b").distinct()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(doc_id, print) of every row; print is the fingerprint as a signed long."""
    slim = docs.select(quoted(id_col).alias("doc_id"), quoted(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch.column("text")), dtype=np.uint64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(got.view(np.int64))], names=["doc_id", "print"])

    return slim.mapInArrow(run, f"doc_id {dict(slim.dtypes)['doc_id']}, print long")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: SimHashRules | None = None) -> DataFrame:
    """(doc_id, print, component_id) of every row; component_id is the smallest id reachable over links."""
    rules = rules or SimHashRules()
    made = written(fingerprints(docs, id_col, text_col, rules.shingle), "prints")
    nodes = written(made.groupBy("print").agg(F.min("doc_id").alias("first_id")), "nodes")
    found = links(nodes.select("print"), rules)
    a, b = nodes.select(F.col("print").alias("a"), F.col("first_id").alias("ia")), nodes.select(F.col("print").alias("b"), F.col("first_id").alias("ib"))
    joined = components(found.join(a, "a").join(b, "b").select("ia", "ib"), "ia", "ib")
    classes = nodes.join(joined.select(F.col("id").alias("first_id"), "component"), "first_id", "left").select("print", F.coalesce("component", "first_id").alias("component_id"))
    return made.join(classes, "print").select("doc_id", "print", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: SimHashRules | None = None) -> DataFrame:
    """One row of each group, with all its columns: that with the smallest id, of rows that share it one."""
    return first_of_groups(docs, id_col, text_col, lambda *rows: groups(*rows, rules))


def query(spark, sf_dir: str) -> DataFrame:
    """op5: every document of the table."""
    return groups(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")
