"""Near copies by the shingles that texts share: SimHash by pigeonring filtering for candidates, then the exact Jaccard similarity.

Texts whose sets of five-word shingles have a similarity of 0.8 or more are linked. Equal sets are folded into one node. A bit of a long
SimHash fingerprint is 1 if over half the shingles' hashes have it set. Sets at 0.8 differ in at most 16.1 % of the bits (in 15.2 % if they
are large, in 18.8 % if they have up to ``SMALL`` shingles; by enumeration of all such pairs up to 260 shingles), so 4 bits of 64 don't do.

The fingerprint is a ring of ``bands`` segments of ``rows`` bits. Each node is filed under every segment, with the 128 bits that follow it
round the ring. Nodes with an equal segment are a run; of a run, the pairs go on whose chain from that segment keeps its budget, a quarter of
its bits, at each of its lengths: the segment, 64 bits more, and 128 bits more. Of a hundred million pairs of unrelated sets four pass. There
are as many segments as leave a chance of about ``MISS`` to miss a pair at 0.8; closer pairs are missed less, and sets of up to SMALL shingles
have more segments. Segments are wider for large tables, so that a run holds some 2^14 nodes. Nothing is linked by a fingerprint alone:
candidates are checked on the whole sets.

Nodes of a run that candidates join in more than ``run_limit`` would be a block of all pairs; they are a crowded key. In a run of over
``DENSE`` nodes leaders find dense groups first, so that a large group is compared with the others only. A run of over ``run_rows`` nodes is
dealt to parts, and each two parts make a run.

Crowded keys are settled in rounds. A round picks some of a key's nodes as pivots, from those outside its largest group, compares all its
nodes with them, and joins the groups that near copies connect. A pivot has then met every node of the key and leaves it, so a key is done
once the nodes left in it are of one group: a group of near copies of any size takes few pivots. The rows of a key are dealt to ``PARTS``
parts, and each round has twice the pivots of the one before. A key whose nodes left hold at most ``task_nodes`` sets and ``task_shingles``
shingles is searched breadth first by one task, and keys with common nodes by one task together if that is less work (``units``). Every pair
of near copies among the candidates so ends in one group, and no task holds a run or a key beyond these bounds.

Defined results: words are parted by ASCII white space and compared in ASCII lower case; a text of fewer words than a shingle is one shingle;
null, empty and wordless texts have the empty set, and are copies of each other; repeated rows are copies; ``groups`` leaves out
rows without an id, ``keep_one`` keeps one row of each group, rows without an id too; empty tables give empty results; further columns are
kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, reduce
from math import ceil, log, log1p

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkscope.llm.common import first_of_groups, quoted, written
from linkscope.llm.graph import components
from linkscope.llm.simhash import forest

SEED = 42
#: Shingles whose bits are added at a time: as many as a byte counts.
BLOCK = 255
#: Chance at most to miss a pair at 0.8.
MISS = 1e-6
#: Share of the bits in which sets at 0.8 differ at most, and in which those of up to SMALL shingles do.
DIFFER, DIFFER_SMALL, SMALL = 0.1612, 0.1875, 8
#: Chains of near copies that keep their budget, at least: by calculation 0.97 of those of small sets.
KEPT = 0.95
#: Bits of a word of a chain.
WORD = 64
#: Nodes of a run that are compared without looking for dense groups, and leaders that look for them.
DENSE, LEADERS = 1 << 9, 64
#: Pairs of nodes compared at a time, and candidates of a run held before they shrink.
STEP, HELD = 1 << 18, 1 << 20
#: Parts that the rows of a crowded value are dealt to.
PARTS = 64
#: Most pivots of a key in a round; more rounds take the rest.
PIVOTS = 512
#: Parts of a large cluster for each task's bound that it fills: two make a unit, with room for uneven ones.
ROOM = 2.2


@dataclass(frozen=True)
class CopyRules:
    shingle: int = 5
    least: tuple[int, int] = (4, 5)  # the similarity as a fraction, so that the check is one of whole numbers
    bands: int = 76  # segments at least
    rows: int = 10  # bits of a segment at least
    run_limit: int = 32
    run_rows: int = 1 << 20
    task_nodes: int = 1 << 12
    task_shingles: int = 1 << 20


@dataclass(frozen=True)
class Ring:
    """rows: bits of a segment; bands: segments; more: segments of small sets, beyond bands outside the ring."""

    rows: int
    bands: int
    more: int

    @property
    def budgets(self) -> tuple[int, int]:
        """Bits in which chains of one and of two words after the segment may differ."""
        return (self.rows + WORD) // 4, (self.rows + 2 * WORD) // 4


def ring(rules: CopyRules, nodes: int) -> Ring:
    rows = max(rules.rows, nodes.bit_length() - 14)
    bands, more = (max(rules.bands, ceil(log(MISS) / log1p(-KEPT * (1 - share) ** rows))) for share in (DIFFER, DIFFER_SMALL))
    return Ring(rows, bands, max(bands, more))


def shingles(text: str | None, shingle: int) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    joined, starts, at = b" ".join(words), [], 0
    for w in words:
        starts.append(at)
        at += len(w) + 1
    ends = [*(s - 1 for s in starts[1:]), len(joined)]
    digest = xxhash.xxh64_intdigest
    pairs = zip(starts[: max(1, len(words) - shingle + 1)], ends[min(shingle, len(words)) - 1 :], strict=True)
    return np.unique(np.fromiter((digest(joined[a:b], SEED) for a, b in pairs), dtype=np.uint64))


def node_of(found: np.ndarray) -> int:
    """A signed number that stands for the set."""
    return int(np.uint64(xxhash.xxh64_intdigest(found.tobytes(), SEED)).view(np.int64))


@cache
def _lots(words: int) -> tuple[np.ndarray, ...]:
    """Odd numbers that make words of further hashes from one."""
    rng = np.random.default_rng(SEED)
    return tuple(rng.integers(0, 1 << 64, words, dtype=np.uint64) | np.uint64(1) for _ in range(3))


def fingerprint(found: np.ndarray, shape: Ring) -> bytes:
    """The bits of all segments of a set, eight a byte."""
    if not len(found):
        return b""
    bits = shape.rows * (shape.more if len(found) <= SMALL else shape.bands)
    turn, shift, mix = (v[: -(-bits // WORD)] for v in _lots(-(-shape.rows * shape.more // WORD)))
    sums = np.zeros(len(turn) * WORD, dtype=np.int64)
    for at in range(0, len(found), BLOCK):
        x = found[at : at + BLOCK, None] * turn + shift
        x = (x ^ (x >> np.uint64(32))) * mix
        x ^= x >> np.uint64(29)
        sums += np.unpackbits(x.astype("<u8", copy=False).view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * sums[:bits] > len(found), bitorder="little").tobytes()


def alike(shared: np.ndarray | int, a: np.ndarray | int, b: np.ndarray | int, rules: CopyRules) -> np.ndarray | bool:
    """Whether sets of a and b shingles that share so many are near copies."""
    p, q = rules.least
    return shared * (p + q) >= p * (a + b)


def _runs(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple[list, ...]]:
    """The columns of each run of equal first column, of sorted rows."""
    held: tuple[list, ...] = tuple([] for _ in names)
    for batch in batches:
        for row in zip(*(batch.column(n).to_pylist() for n in names), strict=True):
            if held[0] and held[0][-1] != row[0]:
                yield held
                held = tuple([] for _ in names)
            for own, value in zip(held, row, strict=True):
                own.append(value)
    if held[0]:
        yield held


def segments(prints: list[bytes], shape: Ring) -> tuple[np.ndarray, np.ndarray]:
    """Keys, by fingerprint and segment, and the two words that follow each segment round the ring; fingerprints of one length."""
    own = np.arange(shape.more if 8 * len(prints[0]) >= shape.more * shape.rows else shape.bands)
    bits = np.unpackbits(np.frombuffer(b"".join(prints), dtype=np.uint8).reshape(len(prints), -1), axis=1, bitorder="little")
    values = bits[:, : len(own) * shape.rows].reshape(len(prints), len(own), shape.rows) @ (1 << np.arange(shape.rows, dtype=np.int64))
    after = ((own[:, None] + 1) * shape.rows + np.arange(2 * WORD)[None, :]) % (shape.bands * shape.rows)
    words = np.packbits(bits[:, after], axis=2, bitorder="little").view("<u8")
    return (own << shape.rows) + values, words


def _filed(shape: Ring):
    """(node, print) to (key, node, first, second), a row a segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, prints = batch.column("node").to_numpy(zero_copy_only=False), batch.column("print").to_pylist()
            for size in sorted({len(p) for p in prints} - {0}):
                at = np.flatnonzero([len(p) == size for p in prints])
                for some in np.split(at, range(128, len(at), 128)):
                    keys, words = segments([prints[i] for i in some], shape)
                    columns = keys.ravel(), np.repeat(nodes[some], keys.shape[1]), *(words[:, :, k].ravel().view(np.int64) for k in (0, 1))
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "node", "first", "second"])

    return run


def _counted(shape: Ring):
    """(node, print) to (key, n), the rows of each segment of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _filed(shape)(batches):
            keys, n = np.unique(batch.column("key").to_numpy(), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], names=["key", "n"])

    return run


def near(a: np.ndarray, b: np.ndarray, budgets: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Places in a and in b, arrays of two words a row, whose chains keep their budgets."""
    one = np.bitwise_count(a[:, 0][:, None] ^ b[:, 0][None, :])
    i, j = np.nonzero(one <= budgets[0])
    ok = one[i, j].astype(np.int64) + np.bitwise_count(a[i, 1] ^ b[j, 1]) <= budgets[1]
    return i[ok], j[ok]


def _large(a: np.ndarray, b: np.ndarray, n: int, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Root of each of n places that pairs (a, b) join, and whether its group is of more than limit."""
    root = np.arange(n)
    roots, members = forest(a, b)
    root[members] = roots
    return root, np.bincount(root, minlength=n)[root] > limit


def _told(a: np.ndarray, b: np.ndarray, n: int, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs (a, b) of n places, and the group of each place: -1, but for groups of more than limit, whose pairs are left out."""
    if not len(a):
        return a, b, np.full(n, -1)
    root, large = _large(a, b, n, limit)
    return a[~large[a]], b[~large[a]], np.where(large, root, -1)


def short_candidates(runs: np.ndarray, words: np.ndarray, budgets: tuple[int, int], limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The candidates of sorted short runs, as ``_told`` gives them; a row meets those before it, nearest first, all rows at a time."""
    edges = np.flatnonzero(np.r_[True, runs[1:] != runs[:-1], True])
    before = np.arange(len(runs)) - np.repeat(edges[:-1], np.diff(edges))
    first, at, all_a, all_b, d = np.ascontiguousarray(words[:, 0]), np.flatnonzero(before), [], [], 1
    while len(at):
        ok = at[np.bitwise_count(first[at] ^ first[at - d]) <= budgets[0]]
        ok = ok[np.bitwise_count(words[ok] ^ words[ok - d]).sum(axis=1, dtype=np.int64) <= budgets[1]]
        all_a.append(ok)
        all_b.append(ok - d)
        d += 1
        at = at[before[at] >= d]
    return _told(np.concatenate([*all_a, at]), np.concatenate([*all_b, at]), len(runs), limit)


def long_candidates(words: np.ndarray, budgets: tuple[int, int], limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The candidates of one long run, as ``_told`` gives them."""
    n, free, dense = len(words), np.arange(len(words)), []
    rng = np.random.default_rng(SEED)
    for _ in range(LEADERS):
        if len(free) <= DENSE:
            break
        leader = rng.choice(free)
        hits = near(words[leader][None], words[free], budgets)[1]
        if len(hits) > limit:
            dense.append(free[hits])
            free = np.delete(free, hits)
    order = np.concatenate([*dense, free])
    ends = np.cumsum([len(d) for d in dense], dtype=np.int64)
    sorted_words, all_a, all_b, held = words[order], [], [], 0
    for d in dense:
        all_a.append(np.full(len(d), d[0]))
        all_b.append(d)
    at = 0
    while at < n:
        group = int(np.searchsorted(ends, at, side="right"))
        stop = min(at + max(1, STEP // (n - at)), int(ends[group]) if group < len(dense) else n)
        begin = int(ends[group]) if group < len(dense) else at
        i, j = near(sorted_words[at:stop], sorted_words[begin:], budgets)
        i, j = i + at, j + begin
        all_a.append(order[i[i < j]])
        all_b.append(order[j[i < j]])
        held += len(all_a[-1])
        if held > HELD:  # those of large groups shrink to a forest
            a, b = np.concatenate(all_a), np.concatenate(all_b)
            root, large = _large(a, b, n, limit)
            many = np.flatnonzero(large)
            all_a, all_b = [a[~large[a]], root[many]], [b[~large[a]], many]
            held = 0
        at = stop
    return _told(np.concatenate(all_a), np.concatenate(all_b), n, limit)


def _whole_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """Runs, nodes, first and second words of sorted rows, in pieces of whole runs."""
    held: list[tuple[np.ndarray, ...]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = tuple(batch.column(n).to_numpy(zero_copy_only=False) for n in ("run", "node", "first", "second"))
        last = int(np.searchsorted(columns[0], columns[0][-1]))
        if last or (held and held[0][0][-1] != columns[0][-1]):
            yield tuple(np.concatenate(c) for c in zip(*held, tuple(c[:last] for c in columns), strict=True))
            held = []
        held.append(tuple(c[last:] for c in columns))
    if held:
        yield tuple(np.concatenate(c) for c in zip(*held, strict=True))


def _met(rules: CopyRules, shape: Ring):
    """Sorted (run, node, first, second) to candidates (null, a, b), and to the nodes (key, a, null) of crowded keys."""

    def told(runs: np.ndarray, nodes: np.ndarray, i: np.ndarray, j: np.ndarray, groups: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(i):
            a, b = np.minimum(nodes[i], nodes[j]), np.maximum(nodes[i], nodes[j])
            yield pa.RecordBatch.from_arrays([pa.nulls(len(i), pa.int64()), pa.array(a), pa.array(b)], names=["key", "a", "b"])
        for g in np.unique(groups[groups >= 0]):
            own = nodes[groups == g]
            key = xxhash.xxh64_intdigest(f"{runs[g]} {own.min()}", SEED) - (1 << 63)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), key)), pa.array(own), pa.nulls(len(own), pa.int64())], names=["key", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for runs, nodes, *words in _whole_runs(batches):
            both = np.stack(words, axis=1).view(np.uint64)
            edges = np.flatnonzero(np.r_[True, runs[1:] != runs[:-1], True])
            size = np.diff(edges)
            for k in np.flatnonzero(size > DENSE):
                some = slice(edges[k], edges[k + 1])
                yield from told(runs[some], nodes[some], *long_candidates(both[some], shape.budgets, rules.run_limit))
            some = np.repeat((size > 1) & (size <= DENSE), size)
            if some.any():
                yield from told(runs[some], nodes[some], *short_candidates(runs[some], both[some], shape.budgets, rules.run_limit))

    return run


def _checked(rules: CopyRules):
    """Rows with sets set_a and set_b to those of near copies, without the sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column("set_a"), batch.column("set_b"), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (x, y))
                least = alike(min(len(x), len(y)), len(x), len(y), rules)
                good.append(bool(least and alike(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y), rules)))
            rest = [n for n in batch.schema.names if n not in ("set_a", "set_b")]
            yield batch.select(rest).filter(pa.array(good, pa.bool_()))

    return run


def _spans(starts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The places of n from each start on, one after another."""
    return np.arange(n.sum()) + np.repeat(starts - (np.cumsum(n) - n), n)


def tree(sets: list[np.ndarray], rules: CopyRules) -> list[tuple[int, int]]:
    """Places of sets that are near copies, as many pairs as join all that such pairs join.

    A near copy lacks at most ``spare`` shingles of a set, so it holds one of any spare + 1; the rarest ones find those worth comparing.
    """
    p, q = rules.least
    sizes, found = np.fromiter(map(len, sets), dtype=np.int64, count=len(sets)), []
    begin, ids = np.cumsum(sizes) - sizes, np.unique(np.concatenate(sets), return_inverse=True)[1]
    often = np.bincount(ids)
    holders, first = np.repeat(np.arange(len(sets)), sizes)[np.argsort(ids, kind="stable")], np.cumsum(often) - often
    left, mine = np.ones(len(sets), dtype=bool), np.zeros(len(often), dtype=bool)
    for seed in range(len(sets)):
        if not left[seed]:
            continue
        left[seed], waiting = False, [seed]
        while waiting:
            at = waiting.pop()
            own = ids[begin[at] : begin[at] + sizes[at]]
            spare = len(own) * (q - p) // q
            rare = own[np.argpartition(often[own], spare)[: spare + 1]]
            maybe = holders[_spans(first[rare], often[rare])]
            maybe = np.unique(maybe[left[maybe]])
            maybe = maybe[alike(np.minimum(sizes[at], sizes[maybe]), sizes[at], sizes[maybe], rules)]
            if not len(maybe):
                continue
            mine[own] = True
            shared = np.add.reduceat(mine[ids[_spans(begin[maybe], sizes[maybe])]], np.cumsum(sizes[maybe]) - sizes[maybe], dtype=np.int64)
            mine[own] = False
            near = maybe[alike(shared, sizes[at], sizes[maybe], rules)]
            left[near] = False
            found += [(at, int(x)) for x in near]
            waiting += near.tolist()
    return found


def _searched(rules: CopyRules):
    """Sorted (unit, node, set) to pairs of nodes that are near copies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, nodes, sets in _runs(batches, "unit", "node", "set"):
            pairs = tree([np.frombuffer(s, dtype=np.uint64) for s in sets], rules)
            yield pa.RecordBatch.from_arrays([pa.array([nodes[i[k]] for i in pairs], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return run


def _dealt(many: DataFrame, few: DataFrame, on: str, by: str, how: str = "inner") -> DataFrame:
    """many, of which a value of ``on`` may have any share, with the few rows of each value, which are copied to each part; ``by`` deals the rows to parts."""
    part = F.pmod(F.xxhash64(by), F.lit(PARTS)).cast("int")
    copied = few.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    return many.withColumn("part", part).join(copied, [on, "part"], how).drop("part")


def _pivoted(rules: CopyRules, shape: Ring):
    """What ``_met`` gives, and the smallest node of each crowded key as its pivot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _met(rules, shape)(batches):  # a crowded key is one batch
            crowded = batch.column("key").null_count == 0
            pivot = pa.array(np.full(batch.num_rows, batch.column("a").to_numpy().min())) if crowded else pa.nulls(batch.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, pivot], names=["key", "a", "b", "pivot"])

    return run


def units(small: DataFrame, rules: CopyRules) -> DataFrame:
    """(unit, node): any two nodes with a common key of small are together in a unit, which is one task's work.

    small: (key, pivot, node, size), of keys that a task holds. Texts of one kind are neighbours under many keys; a node would go to a task for
    each of them. So keys with common nodes make a cluster, and each node belongs to one. A cluster that a task holds is a unit. A larger one is
    dealt to parts, and each two parts are a unit. Where that would be more rows or more pairs than the keys have, the keys stay units.
    """
    own = written(small.groupBy("node").agg(F.first("size").alias("size"), F.collect_set("pivot").alias("pivots")).withColumn("low", F.array_min("pivots")), "own")
    joined = components(own.select("low", F.explode("pivots").alias("pivot")), "low", "pivot")
    cluster = written(joined.select(F.col("id").alias("pivot"), F.col("component").alias("cluster")), "clusters")
    nodes = own.select("node", "size", F.col("low").alias("pivot")).join(cluster, "pivot", "left").select("node", "size", F.coalesce("cluster", "pivot").alias("cluster"))
    nodes = written(nodes, "clustered")
    keys = small.groupBy("key", "pivot").agg(F.count("*").alias("n")).groupBy("pivot").agg(F.sum("n").alias("rows"), F.sum(F.col("n") * F.col("n")).alias("pairs"))
    cost = keys.join(cluster, "pivot", "left").groupBy(F.coalesce("cluster", "pivot").alias("cluster")).agg(F.sum("rows").alias("rows"), F.sum("pairs").alias("pairs"))
    fill = F.greatest(F.col("n") / rules.task_nodes, F.col("total") / rules.task_shingles)
    parts = F.when(fill <= 1, 1).otherwise(F.ceil(fill * ROOM) + 1).cast("bigint")
    told = nodes.groupBy("cluster").agg(F.count("*").alias("n"), F.sum("size").alias("total")).withColumn("parts", parts).join(cost, "cluster")
    whole = (F.col("n") * F.greatest(F.lit(1), F.col("parts") - 1) <= F.col("rows")) & (F.col("n") * F.col("n") <= F.col("pairs"))
    told = written(told.select("cluster", "parts", whole.alias("whole")), "told")
    dealt = nodes.join(F.broadcast(told.where("whole")), "cluster").withColumn("part", F.pmod(F.xxhash64("node"), "parts"))
    other = F.when(F.col("parts") == 1, F.array(F.lit(0).cast("bigint"))).otherwise(F.array_remove(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1), F.col("part")))
    dealt = dealt.withColumn("other", F.explode(other))
    made = dealt.select(F.xxhash64("cluster", F.least("part", "other"), F.greatest("part", "other")).alias("unit"), "node")
    split = told.where("not whole")
    if split.isEmpty():
        return made
    kept = split.select("cluster").join(cluster, "cluster", "left").select(F.coalesce("pivot", "cluster").alias("pivot"))
    return made.unionByName(small.join(kept, "pivot", "left_semi").select(F.col("key").alias("unit"), "node"))


def crowded_links(hot: DataFrame, sets: DataFrame, rules: CopyRules) -> DataFrame:
    """Pairs of nodes (a, b), near copies, that join all that near copies with a common key of hot join.

    hot: (key, pivot, node), a pivot being one of the key's nodes; sets: (node, size, set).
    """
    p, q = rules.least
    set_a, set_b = sets.select(F.col("node").alias("a"), F.col("set").alias("set_a")), sets.select(F.col("node").alias("b"), F.col("set").alias("set_b"))
    own = hot.groupBy("node").agg(F.collect_list(F.struct("key", "pivot")).alias("keys")).join(sets.select("node", "size"), "node")
    left = written(own.select("node", "size", F.explode("keys").alias("k")).select("k.key", "k.pivot", "node", "size", F.col("node").alias("label")), "left")
    found, small, pivots = [], [], 1
    while True:
        sums = left.groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("total"), F.min("label").alias("low"), F.max("label").alias("high"))
        large = (F.col("n") > rules.task_nodes) | (F.col("total") > rules.task_shingles)
        keys = written(sums.where("low < high").select("key", large.alias("large")), "open_keys")
        small.append(left.join(keys.where("not large"), "key", "left_semi").select("key", "pivot", "node", "size"))
        if keys.where("large").isEmpty():
            break
        over = written(_dealt(left, keys.where("large").select("key"), "key", "node"), "over")
        most = over.groupBy("key", "label").agg(F.count("*").alias("n")).groupBy("key").agg(F.max(F.struct("n", "label")).getField("label").alias("most"))
        turn = F.row_number().over(Window.partitionBy("key").orderBy(F.xxhash64("node"), "node"))
        outside = _dealt(over, most, "key", "node").where("label != most").withColumn("turn", turn).where(F.col("turn") <= pivots)
        picked = written(outside.select("key", F.col("node").alias("b"), F.col("size").alias("size_b"), F.col("label").alias("label_b")), "pivots")
        met = _dealt(over, picked, "key", "node").where((F.col("label") != F.col("label_b")) & (F.least("size", "size_b") * (p + q) >= (F.col("size") + F.col("size_b")) * p))
        pairs = met.select(F.col("node").alias("a"), "b", "label", "label_b").distinct()
        near = written(_dealt(pairs.join(set_a, "a"), set_b.join(picked.select("b").distinct(), "b"), "b", "a").select("a", "b", "label", "label_b", "set_a", "set_b").mapInArrow(_checked(rules), "a long, b long, label long, label_b long"), "near")
        found.append(near.select("a", "b"))
        merged = components(near, "label", "label_b").select(F.col("id").alias("label"), "component")
        rest = over.join(picked.select("key", F.col("b").alias("node")), ["key", "node"], "left_anti")
        left = written(_dealt(rest, merged, "label", "node", "left").select("key", "pivot", "node", "size", F.coalesce("component", "label").alias("label")), "left")
        pivots = min(2 * pivots, PIVOTS)
    held = units(written(reduce(DataFrame.unionByName, small), "small"), rules).join(sets.select("node", "set"), "node").repartition("unit").sortWithinPartitions("unit", "node")
    return reduce(DataFrame.unionByName, found, held.mapInArrow(_searched(rules), "a long, b long"))


def dealt_runs(prints: DataFrame, rules: CopyRules, shape: Ring, nodes: int) -> DataFrame:
    """(run, node, first, second) of every segment of (node, print); a segment of over run_rows nodes is dealt to parts, and each two parts are a run."""
    filed = prints.mapInArrow(_filed(shape), "key long, node long, first long, second long")
    if nodes <= rules.run_rows:
        return filed.select(F.shiftleft("key", 24).alias("run"), "node", "first", "second")
    n = prints.mapInArrow(_counted(shape), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") > rules.run_rows)
    parts = written(n.select("key", F.ceil(F.col("n") * 2 / rules.run_rows).alias("parts")), "long_runs")
    own = filed.join(F.broadcast(parts), "key", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("node"), "parts"), F.lit(0)))
    other = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("parts") - 1, F.lit(0)))))
    place = F.least("part", "other") * F.coalesce("parts", F.lit(1)) + F.greatest("part", "other")
    return other.select((F.shiftleft("key", 24) + place).alias("run"), "node", "first", "second")


def links(docs: DataFrame, nodes: DataFrame, prints: DataFrame, rules: CopyRules, shape: Ring, rows: int) -> DataFrame:
    """Pairs of nodes (a, b), near copies, that join all that near copies among the candidates join.

    docs: (doc_id, text), of at most ``rows`` rows; nodes: (node, first_id), first_id being a document with that set; prints: (node, print).
    """
    runs = dealt_runs(written(prints, "prints"), rules, shape, rows).repartition("run").sortWithinPartitions("run")
    met = written(runs.mapInArrow(_pivoted(rules, shape), "key long, a long, b long, pivot long"), "met")
    hot = written(met.where("key is not null").select("key", "pivot", F.col("a").alias("node")), "hot")
    pairs = written(met.where("key is null").select("a", "b").distinct(), "pairs")
    wanted = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).unionByName(hot.select("node")).distinct()
    texts = docs.join(nodes.join(wanted, "node").select(F.col("first_id").alias("doc_id"), "node"), "doc_id").select("node", "text")

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                sets = [shingles(t.as_py(), rules.shingle) for t in some.column("text")]
                ok = [n.as_py() == node_of(s) for n, s in zip(some.column("node"), sets, strict=True)]  # an id may have several texts
                made = [some.column("node"), pa.array(map(len, sets), pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())]
                yield pa.RecordBatch.from_arrays(made, names=["node", "size", "set"]).filter(pa.array(ok, pa.bool_()))

    sets = written(texts.mapInArrow(again, "node long, size long, set binary").dropDuplicates(["node"]), "sets")
    a, b = sets.select(F.col("node").alias("a"), F.col("set").alias("set_a")), sets.select(F.col("node").alias("b"), F.col("set").alias("set_b"))
    checked = pairs.join(a, "a").join(b, "b").select("a", "b", "set_a", "set_b").mapInArrow(_checked(rules), "a long, b long")
    return checked.unionByName(crowded_links(hot, sets, rules))


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: CopyRules | None = None) -> DataFrame:
    """(doc_id, node, component_id) of every row with an id; component_id is the smallest id of the group of near copies."""
    rules = rules or CopyRules()
    slim = docs.select(quoted(id_col).alias("doc_id"), quoted(text_col).alias("text")).where("doc_id is not null")
    rows = slim.count()
    shape = ring(rules, rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                some = batch.slice(at, 1024)
                nodes, prints = [], []
                for text in some.column("text"):
                    found = shingles(text.as_py(), rules.shingle)
                    nodes.append(node_of(found))
                    prints.append(fingerprint(found, shape))
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), pa.array(nodes, pa.int64()), pa.array(prints, pa.binary())], names=["doc_id", "node", "print"])

    made = written(slim.mapInArrow(run, f"doc_id {dict(slim.dtypes)['doc_id']}, node long, print binary"), "shingled")
    nodes = written(made.groupBy("node").agg(F.min("doc_id").alias("first_id")), "nodes")
    prints = made.join(nodes, (made["node"] == nodes["node"]) & (made["doc_id"] == nodes["first_id"])).select(made["node"], "print").dropDuplicates(["node"])
    joined = components(links(slim, nodes, prints, rules, shape, rows), "a", "b")
    classes = nodes.join(joined.select(F.col("id").alias("node"), "component"), "node", "left").select("node", "first_id", F.coalesce("component", "node").alias("component"))
    least = classes.groupBy("component").agg(F.min("first_id").alias("component_id"))
    return made.select("doc_id", "node").join(classes.join(least, "component").select("node", "component_id"), "node").select("doc_id", "node", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: CopyRules | None = None) -> DataFrame:
    """One row of each group, with all its columns: that with the smallest id, of rows that share it one."""
    return first_of_groups(docs, id_col, text_col, lambda *rows: groups(*rows, rules))
