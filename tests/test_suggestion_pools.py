"""Targets that many sources meet are prepared once, and give each source what it would get alone."""

import random
from collections import Counter

from linkscope.config import EngineConfig
from linkscope.functions import keywords
from linkscope.operators import suggest

CFG = EngineConfig()
WORDS = [a + b for a in ("garden", "rose", "Ökö", "soil", "it's", "ſoil", "tomato") for b in ("", "s", "bed", "-grass", " & co")]


def _posts(rng, ids):
    text = lambda n: " ".join(rng.choices(WORDS, k=n))
    return [suggest.Post(i, text(5), text(40) + rng.choice(["", "\n\n", " a@b.test", "<p>x</p>"]), float(i), frozenset()) for i in ids]


def test_a_pool_gives_the_phrases_of_each_source():
    rng = random.Random(3)
    targets, sources = _posts(rng, range(30)), _posts(rng, range(100, 130))
    pool = suggest.Pool(targets, CFG)
    for source in sources:
        words = [source.words(CFG.text_chars), *(t.words(CFG.text_chars) for t in targets)]
        df, own = Counter(t for w in words for t in set(w)), set(words[0])
        for at, target in enumerate(targets):
            plain = keywords.title_keywords(target.title, CFG.min_words) + keywords.topic_phrases(target.title, Counter(words[at + 1]), df, len(words), CFG.top_terms, CFG.min_single_word)
            assert pool.phrases(at, own) == plain
        assert suggest.for_source(source, targets, CFG, pool) == suggest.for_source(source, targets, CFG)


def test_targets_are_prepared_once(monkeypatch):
    """Before, each source had the phrases of all targets worked out anew."""
    rng, made = random.Random(4), []
    real = suggest.title_keywords
    monkeypatch.setattr(suggest, "title_keywords", lambda *a: made.append(a) or real(*a))
    targets = _posts(rng, range(10))
    pool = suggest.Pool(targets, CFG)
    for source in _posts(rng, range(20, 40)):
        suggest.for_source(source, targets, CFG, pool)
    assert len(made) == len(targets)


def test_letters_that_fold_to_ascii_are_found():
    target, source = suggest.Post(1, "Soil Health Guide", "soil health guide " * 3, 1.0, frozenset()), suggest.Post(2, "x", "about ſoil health guide and topsoil health guide", 1.0, frozenset())
    assert any(f["keyword"] == "Soil Health Guide" for f in suggest.candidates(source, [target], CFG))


def test_sources_are_dealt_to_all_cores(spark):
    rows = spark.createDataFrame([(i, f"Soil Health Guide {i}", "a soil health guide " * 9, float(i), ["x"]) for i in range(50)], "id long, title string, content string, age_days double, categories array<string>").coalesce(1)
    made = suggest.generate(rows, rows, rows.selectExpr("id as source", "id + 1 as target"), CFG)
    assert made.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert made.count() > 0
