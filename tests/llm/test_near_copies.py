"""The pipeline's near-duplicate stage against brute force over all pairs."""

import random

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from linkscope.llm import nearcopies


def shingles(text):
    words = (text or "").lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def firsts(rows):
    """The smallest id of each group that pairs at 0.8 join."""
    sets, up = [shingles(t) for _, t in rows], list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for k, b in enumerate(sets[:i]):
            if a == b or 5 * len(a & b) >= 4 * len(a | b):
                up[root(i)] = root(k)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), doc_id), doc_id)
    return sorted(set(least.values()))


def changed(rng, words, n):
    words = list(words)
    for i in rng.sample(range(len(words)), n):
        words[i] = f"new{rng.randrange(10**9)}"
    return " ".join(words)


def test_near_dedup_equals_brute_force(spark):
    rng, texts = random.Random(4), [None, "", " \n", "Only three words", "only THREE words", "only four other words"]
    for _ in range(60):  # from nearly equal to well under 0.8
        words = [f"w{rng.randrange(4000)}" for _ in range(rng.randint(50, 400))]
        texts += [" ".join(words)] + [changed(rng, words, rng.randint(1, 2 + len(words) // 25)) for _ in range(3)]
    words = [f"w{rng.randrange(4000)}" for _ in range(200)]  # a group beyond the run limit, whose members differ from each other more than from the first
    texts += [changed(rng, words, rng.randint(2, 8)) for _ in range(120)] + [" ".join(words)] * 2
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    docs = spark.createDataFrame([(i, t, "m") for i, t in rows] + [(None, "no id", "m"), (None, "no id", "m"), rows[0] + ("m",)], "doc_id long, text string, node string")
    got = corpus_pipeline.near_dedup(spark, docs, "")
    assert got.columns == docs.columns
    ids = [r.doc_id for r in got.collect()]
    assert ids.count(None) == 1 and sorted(i for i in ids if i is not None) == firsts(rows)
    assert corpus_pipeline.near_dedup(spark, docs.limit(0), "").count() == 0


def test_crowded_keys_in_rounds_equal_brute_force(spark):
    """Groups that outgrow a task's bound: tight ones, a chain of small steps, and texts that share keys but are no copies."""
    rng, texts = random.Random(6), []
    for size, most in ((90, 3), (60, 9), (50, 14)):
        words = [f"w{rng.randrange(4000)}" for _ in range(180)]
        texts += [changed(rng, words, rng.randint(1, most)) for _ in range(size)]
    words = [f"w{rng.randrange(4000)}" for _ in range(160)]
    for _ in range(60):
        words = changed(rng, words, 2).split()
        texts.append(" ".join(words))
    rng.shuffle(texts)
    rules = nearcopies.CopyRules(rows=1, run_limit=6, task_nodes=12, task_shingles=4000)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in nearcopies.keep_one(docs, rules=rules).collect()) == firsts(list(enumerate(texts)))


def chains(rng, n, groups):
    """Rows of two words: n drawn by lot, groups of (rows, share of turned bits) round one centre each, and a path of small steps."""
    bits = [*rng.integers(0, 2, (n, 128))]
    for size, share in groups:
        centre = rng.integers(0, 2, 128)
        bits += [centre ^ (rng.random(128) < share) for _ in range(size)]
    for _ in range(25):
        bits.append(bits[-1] ^ np.isin(np.arange(128), rng.choice(128, 12, replace=False)))
    return np.packbits(np.array(bits, dtype=np.uint8)[rng.permutation(len(bits))], axis=1, bitorder="little").view("<u8")


def told(words, budgets, limit):
    """The candidates by all pairs: those of groups of at most limit, and the members of the others."""
    near = [(i, j) for i in range(len(words)) for j in range(i) if (d := [(int(x) ^ int(y)).bit_count() for x, y in zip(words[i], words[j])])[0] <= budgets[0] and sum(d) <= budgets[1]]
    up = list(range(len(words)))
    for i, j in near:
        up = [up[j] if x == up[i] else x for x in up]
    crowded = {i for i, x in enumerate(up) if up.count(x) > limit}
    return {p for p in near if p[0] not in crowded}, {frozenset(k for k in crowded if up[k] == up[i]) for i in crowded}


def as_told(a, b, groups):
    return {(max(p), min(p)) for p in zip(a.tolist(), b.tolist())}, {frozenset(np.flatnonzero(groups == g).tolist()) for g in set(groups.tolist()) - {-1}}


@pytest.mark.parametrize("held", [20, 1 << 20])
def test_candidates_of_a_run_equal_all_pairs(monkeypatch, held):
    monkeypatch.setattr(nearcopies, "DENSE", 64)
    monkeypatch.setattr(nearcopies, "HELD", held)
    monkeypatch.setattr(nearcopies, "STEP", 5000)
    words, budgets = chains(np.random.default_rng(1), 250, [(180, 0.05), (40, 0.09), (6, 0.1), (2, 0.1)]), (18, 34)
    wanted = told(words, budgets, 30)
    assert len(wanted[0]) > 10 and len(wanted[1]) >= 2
    assert as_told(*nearcopies.long_candidates(words, budgets, 30)) == wanted
    assert as_told(*nearcopies.short_candidates(np.zeros(len(words), dtype=np.int64), words, budgets, 30)) == wanted


@pytest.mark.parametrize("step", [1, 7, 10_000])
def test_runs_across_batches(step):
    """Runs of one row, short ones and one beyond DENSE give the same candidates however they are cut into batches."""
    rng, rules = np.random.default_rng(2), nearcopies.CopyRules()
    shape, sizes = nearcopies.ring(rules, 100), [1, 60, 2, 1, nearcopies.DENSE + 40, 30]
    words = [chains(rng, 0, [(max(0, n - 25), 0.07)])[:n] if n > 25 else chains(rng, n, [])[:n] for n in sizes]
    wanted, first = set(), 0
    for w in words:
        near = told(w, shape.budgets, rules.run_limit)
        wanted |= {(None, first + b, first + a) for a, b in near[0]} | {(first + min(g), first + k, None) for g in near[1] for k in g}
        first += len(w)
    runs, nodes, both = np.repeat(np.arange(len(sizes)), sizes), np.arange(first), np.concatenate(words).view(np.int64)
    columns = [runs, nodes, both[:, 0], both[:, 1]]
    batches = (pa.RecordBatch.from_arrays([pa.array(c[at : at + step]) for c in columns], names=["run", "node", "first", "second"]) for at in range(0, first, step))
    rows = [tuple(r.values()) for b in nearcopies._met(rules, shape)(batches) for r in b.to_pylist()]
    least = {}
    for key, a, _ in rows:
        if key is not None:
            least[key] = min(a, least.get(key, a))
    assert {(None if k is None else least[k], a, b) for k, a, b in rows} == wanted and any(k for k, _, _ in wanted)


def test_fingerprint_and_its_segments():
    """Bits are majorities; keys and words are the segments and what follows them round the ring."""
    shape, rng = nearcopies.ring(nearcopies.CopyRules(), 1000), np.random.default_rng(7)
    for n in (1, 4, 8, 9, 300, 1000):
        found = np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64))
        singles = [np.unpackbits(np.frombuffer(nearcopies.fingerprint(found[i : i + 1], shape), dtype=np.uint8), bitorder="little") for i in range(n)]
        own = np.unpackbits(np.frombuffer(nearcopies.fingerprint(found, shape), dtype=np.uint8), bitorder="little")
        count = shape.more if n <= nearcopies.SMALL else shape.bands
        assert (own[: count * shape.rows] == (2 * np.sum(singles, axis=0, dtype=np.int64)[: len(own)] > n)[: count * shape.rows]).all()
        keys, words = nearcopies.segments([nearcopies.fingerprint(found, shape)], shape)
        assert keys.shape == (1, count)
        round_ring = np.tile(own[: shape.bands * shape.rows], 3)
        for k in range(count):
            assert keys[0, k] == (k << shape.rows) + sum(int(b) << i for i, b in enumerate(own[k * shape.rows : (k + 1) * shape.rows]))
            after = round_ring[(at := (k + 1) * shape.rows % (shape.bands * shape.rows)) : at + 128]
            assert [int(w) for w in words[0, k]] == [sum(int(b) << i for i, b in enumerate(after[x : x + 64])) for x in (0, 64)]
    assert nearcopies.fingerprint(np.empty(0, dtype=np.uint64), shape) == b""


@pytest.mark.parametrize("nodes", [1000, 1 << 27])
def test_sets_at_the_least_similarity_are_candidates(nodes):
    shape, rng = nearcopies.ring(nearcopies.CopyRules(), nodes), np.random.default_rng(9)
    assert shape.rows == (10 if nodes == 1000 else 14)
    for _ in range(300):
        shared = int(rng.choice([4, 8, 12, 20, 60, 400]))
        x = rng.integers(0, 1 << 64, shared + shared // 4, dtype=np.uint64)
        cut = int(rng.integers(0, shared // 4 + 1))
        sets = np.unique(x[: shared + cut]), np.unique(np.r_[x[:shared], x[shared + cut :]])
        (ka, wa), (kb, wb) = (nearcopies.segments([nearcopies.fingerprint(s, shape)], shape) for s in sets)
        both = min(ka.shape[1], kb.shape[1])
        assert any(len(nearcopies.near(wa[0, [k]], wb[0, [k]], shape.budgets)[0]) for k in np.flatnonzero(ka[0, :both] == kb[0, :both]))


def test_runs_dealt_to_parts_equal_brute_force(spark):
    """Runs of over run_rows nodes lose no pair, nor do crowded keys in them."""
    rng, texts = random.Random(8), []
    for size in (70, 2, 2, 3, 2):
        words = [f"w{rng.randrange(4000)}" for _ in range(150)]
        texts += [changed(rng, words, rng.randint(1, 3)) for _ in range(size)]
    texts += [" ".join(f"w{rng.randrange(4000)}" for _ in range(80)) for _ in range(60)]
    rng.shuffle(texts)
    rules = nearcopies.CopyRules(rows=4, run_rows=8, run_limit=6)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in nearcopies.keep_one(docs, rules=rules).collect()) == firsts(list(enumerate(texts)))


def test_tree_joins_what_pairs_join():
    rng, rules = random.Random(5), nearcopies.CopyRules()
    words = [f"w{i}" for i in range(150)]
    texts = [changed(rng, words, rng.randint(1, 12)) for _ in range(80)]
    found = nearcopies.tree([nearcopies.shingles(t, 5) for t in texts], rules)
    up = list(range(80))
    for a, b in found:
        assert 5 * len(shingles(texts[a]) & shingles(texts[b])) >= 4 * len(shingles(texts[a]) | shingles(texts[b]))
        up = [up[a] if x == up[b] else x for x in up]
    assert len(set(up)) == len(firsts(list(enumerate(texts))))


def test_a_set_goes_to_its_task_once(spark, monkeypatch):
    """Sets that meet under many keys go to one task together, not to a task for each key."""

    def searched(rules):
        def run(batches):
            for batch in batches:
                yield pa.RecordBatch.from_arrays([batch.column("node")] * 2, names=["a", "b"])

        return run

    rng, sets = random.Random(3), np.random.default_rng(3).integers(0, 1 << 64, (60, 20), dtype=np.uint64)
    keys = {k: rng.sample(range(60), 40) for k in range(30)}
    hot = spark.createDataFrame([(k, min(own), n) for k, own in keys.items() for n in own], "key long, pivot long, node long")
    made = spark.createDataFrame([(n, 20, np.sort(x).tobytes()) for n, x in enumerate(sets)], "node long, size long, set binary")
    monkeypatch.setattr(nearcopies, "_searched", searched)
    assert sorted(r.a for r in nearcopies.crowded_links(hot, made, nearcopies.CopyRules()).collect()) == list(range(60))


def test_units_hold_the_pairs_of_keys(spark):
    """A cluster that a task holds, one that is dealt to parts, and one whose keys have little in common and so stay units."""
    rng = random.Random(12)
    keys = [rng.sample(range(20), 9) for _ in range(12)]
    keys += [rng.sample(range(100, 160), 12) for _ in range(60)]
    keys += [list(range(200 + 7 * k, 208 + 7 * k)) for k in range(20)]
    small = spark.createDataFrame([(k, min(own), n, 5) for k, own in enumerate(keys) for n in own], "key long, pivot long, node long, size long")
    got = {}
    for unit, node in nearcopies.units(small, nearcopies.CopyRules(task_nodes=30, task_shingles=1000)).collect():
        got.setdefault(unit, []).append(node)
    assert all(len(v) == len(set(v)) <= 30 for v in got.values())
    pairs = {(a, b) for own in got.values() for a in own for b in own}
    assert all((a, b) in pairs for own in keys for a in own for b in own)
    assert [sorted(v) for v in got.values() if min(v) < 100] == [sorted({n for own in keys[:12] for n in own})]
    assert sum(len(v) for v in got.values() if 100 <= min(v) < 200) <= 60 * 5 < 60 * 12
    assert sorted(sorted(v) for v in got.values() if min(v) >= 200) == keys[72:]


def test_stages_of_odd_rows(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, clashing names and empty tables go through every stage."""
    row = "doc_id long, text string, lang string, source string, n_chars long, kept_row int, mark string, keys string"
    good = " ".join(f"word{i} item{i} thing{i}" for i in range(40)) + "."
    long = "\n".join(f"Line{i} holds{i} some{i} words{i} and more{i} text{i}." for i in range(4000))
    docs = spark.createDataFrame(
        [(1, None, None, None, None, 1, "a", "k"), (2, "", "en", "s", 0, 2, "a", "k"), (None, good, None, None, None, 3, None, None), (3, good, "en", "s", 1, 4, "a", "k"), (3, good, "en", "s", 1, 4, "a", "k"), (4, long, "en", "s", 1, 5, "a", "k"), (4, long + " Another end.", "en", "s", 1, 6, "a", "k")], row
    )
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, "")
        assert got.columns == docs.columns and stage(spark, docs.limit(0), "").count() == 0, name
        kept = sorted(r.kept_row for r in got.collect())
        assert {"quality_rules": kept == [3, 4, 4, 5, 6], "language_id": set(kept) <= {3, 4, 5, 6}, "near_dedup": kept == [1, 4, 5]}[name], name
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), "").count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").where("doc_id = 3").count() >= 2
