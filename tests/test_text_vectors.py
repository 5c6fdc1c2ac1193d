"""Text vectors on odd rows, and that no single term of a document is shuffled where its row can be counted alone."""

import math
from collections import Counter

import pytest

from linkscope.functions import text

DOCS = [(1, ["oak", "elm", "oak"]), (2, ["elm"]), (3, []), (4, ["oak", "fir", "elm", "fir"]), (4, ["fir", "oak", "elm", "fir"]), (4, ["yew"]), (None, ["yew", "oak"]), (None, ["oak", "oak"]), (9, None)]


@pytest.fixture
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id long, tokens array<string>")


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def _counts():
    merged = {}
    for doc, tokens in DOCS:
        for t in tokens or []:
            merged[doc, len(tokens), t] = merged.get((doc, len(tokens), t), 0) + 1
    return merged


def test_counts_merge_rows_of_one_id_and_length(docs):
    assert Counter(map(tuple, text.term_frequency(docs).collect())) == Counter((*k, v) for k, v in _counts().items())


def test_distinct_documents_are_counted_without_a_shuffle(spark):
    one = spark.createDataFrame([(i, ["oak", "elm", "oak"]) for i in range(9)], "doc_id long, tokens array<string>")
    assert "Aggregate" not in _plan(text.term_frequency(one))


def _weights(n_docs=len(DOCS)):
    df = Counter(t for _, tokens in DOCS for t in set(tokens or []))
    return {k: c / k[1] * (math.log((1 + n_docs) / (1 + df[k[2]])) + 1) for k, c in _counts().items()}


@pytest.mark.parametrize("share", [8e-5, 0.5, 2.0])
def test_weights_whether_frequent_or_rare(docs, monkeypatch, share):
    monkeypatch.setattr(text, "FREQUENT", share)
    got = Counter((r["doc_id"], r["n"], e["term"], round(e["weight"], 9)) for r in text.weights(docs).collect() for e in r["entries"])
    assert got == Counter((*k, round(w, 9)) for k, w in _weights().items())
    best = sorted((-round(w, 12), t) for (doc, _, t), w in _weights().items() if doc == 4)[:2]
    assert [r["term"] for r in text.top_terms(text.weights(docs), 2).where("doc_id = 4").orderBy("rank").collect()] == [t for _, t in best]


def test_the_list_of_frequent_terms_is_bounded(docs, monkeypatch):
    monkeypatch.setattr(text, "MAX_FREQUENT", 1)
    least, listed = text.frequent_terms(text.document_frequency(docs), len(DOCS))
    assert listed.num_rows <= 1 and least > 2
    assert sum(len(r["entries"]) for r in text.weights(docs).collect()) == len(_weights())


def _brute_batch(source, targets):
    members = [(d, t) for m in [source, *targets] for d, t in DOCS if d is not None and d == m and t]
    df, pool = Counter(t for _, tokens in members for t in set(tokens)), len(targets) + 1

    def vector(doc):
        tf = Counter((len(t), x) for d, t in {(d, tuple(t)) for d, t in members} if d == doc for x in t)
        return [(x, c / n * (math.log((1 + pool) / (1 + df[x])) + 1)) for (n, x), c in tf.items()]

    own = vector(source)
    for target in targets:
        other = vector(target)
        dot = sum(a * b for x, a in own for y, b in other if x == y) if target != source else 0
        yield (source, target, round(min(1.0, dot / math.sqrt(sum(a * a for _, a in own) * sum(b * b for _, b in other))), 9) if dot else 0.0)


def test_batches_of_odd_pairs(spark, docs):
    asked = {1: [2, 4, 4, 3, 9, 1, 77], 4: [1, 2], 3: [1], 2: [1, None]}
    pairs = spark.createDataFrame([(s, t) for s, ts in asked.items() for t in ts] + [(None, 1)], "source long, target long")
    found = text.batch_scores(pairs, docs)
    want = [x for s, ts in asked.items() for x in _brute_batch(s, ts)] + [(None, 1, 0.0)]
    assert Counter((a, b, round(c, 9)) for a, b, c in found.collect()) == Counter(want)
    assert "Generate" not in _plan(found)


def test_cosines_of_odd_pairs(spark, docs):
    pairs = spark.createDataFrame([(1, 2), (1, 4), (1, 3), (2, 77), (1, 1), (None, 1)], "a long, b long")
    got = {(r["a"], r["b"]): r["cosine"] for r in text.cosine(pairs, text.weights(docs)).collect()}
    w = _weights()
    dot = lambda a, b: sum(x * y for (d, _, t), x in w.items() if d == a for (e, _, u), y in w.items() if e == b and t == u)
    length = lambda a: sum(x * x for (d, _, _), x in w.items() if d == a)
    assert got[1, 2] == pytest.approx(dot(1, 2) / math.sqrt(length(1) * length(2)))
    assert got[1, 1] == pytest.approx(1.0)
    assert got[1, 3] == got[2, 77] == got[None, 1] == 0.0
