import pytest

from linkscope.config import EngineConfig
from linkscope.functions import text
from linkscope.operators import reports, rerank, stats, suggest

CFG = EngineConfig(excluded_categories=(), as_of="2026-02-01 00:00:00")
POSTS = "id long, status string, type string, title string, content string, post_date timestamp_ntz, is_sticky boolean, pageviews long, parent_id long, category_ids array<long>"


def posts_of(spark, rows):
    import datetime

    day = datetime.datetime(2026, 1, 2)
    return spark.createDataFrame([(i, s, t, f"Post {i}", "", day, i == 2, 500 if i == 3 else None, p, [1]) for i, s, t, p in rows], POSTS)


def links_of(spark, rows):
    return spark.createDataFrame([(s, t, n, u) for n, (s, t, u) in enumerate(rows)], "source_post_id long, target_post_id long, pos int, link_url string")


def test_degrees_and_scores(spark):
    posts = posts_of(spark, [(1, "publish", "post", 0), (2, "publish", "post", 0), (3, "publish", "page", 0), (4, "draft", "post", 0), (5, "publish", "product", 0)])
    links = links_of(spark, [(1, 2, ""), (1, 2, ""), (2, 2, ""), (1, 9, "")])
    got = {r.post_id: (r.inbound_count, r.outbound_count, r.orphan_score) for r in stats.compute(links, posts, CFG).collect()}
    assert got == {1: (0, 3, 1.0), 2: (2, 1, 0.5), 3: (0, 0, 2.0)}


def test_broken_targets(spark):
    rows = [(1, "publish", "post", 0), (11, "publish", "post", 0), (12, "private", "post", 0), (13, "draft", "post", 0), (14, "inherit", "attachment", 0), (15, "inherit", "attachment", 13), (16, "inherit", "attachment", 11), (17, "inherit", "attachment", 404), (18, "trash", "attachment", 0)]
    links = links_of(spark, [(1, t, f"/{t}") for t in (11, 12, 13, 14, 15, 16, 17, 18, 404)] + [(1, 13, "/uploads/x.png")])
    files = spark.createDataFrame([("/uploads/x.png",)], "link_url string")
    got = {(r.target_post_id, r.target_label) for r in reports.broken_links(links, posts_of(spark, rows), files).collect()}
    assert got == {(13, "Draft"), (15, "Draft"), (18, "Trashed"), (404, "Deleted")}


def test_no_types_means_nothing(spark):
    posts = posts_of(spark, [(1, "publish", "post", 0)])
    assert stats.compute(links_of(spark, [(1, 1, "")]), posts, EngineConfig(post_types=())).count() == 0


def test_rerank_keeps_own_scores_without_enough(spark):
    replies = spark.createDataFrame([(1, 'Sure: {"1": 250, "2": -4, "9": 3}', 3), (2, '{"1": 50}', 3), (3, "", 2), (4, '{"1": "x", "2": 7.9}', 2)], "source long, reply string, n int")
    assert sorted(map(tuple, rerank.scores(replies).collect())) == [(1, 1, 100), (1, 2, 0), (4, 2, 7)]


def test_highlight(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("a <b> Rock & Roll",)], "c string")
    assert df.select(reports.highlight(F.col("c"), "rock & roll")).first()[0] == "a &lt;b&gt; <mark>Rock &amp; Roll</mark>"


WORKSHOP = [
    (21, "Truing Wheels", "Wheels wobble when spokes loosen. True wheels roll straight and spare the rims of a touring bicycle."),
    (22, "Winter Commuting", "Salt eats wheels and chains alike. Wash the chains, grease the spokes and check all wheels of a touring bicycle."),
    (23, "Oiling Chains", "Chains last longer when clean. Oil chains after rain, wipe salt away and look for wear."),
    (24, "Night Lights", "A touring bicycle needs lights at night, reflectors and a spare battery."),
]


def workshop():
    return [suggest.Post(i, t, f"<p>{c}</p>", 10.0, frozenset()) for i, t, c in WORKSHOP]


def test_suggestions_of_a_small_corpus():
    posts = workshop()
    got = suggest.for_source(posts[1], [p for p in posts if p.id != 22], EngineConfig())
    assert {f["target"].id for f in got} == {21, 23}
    assert all(f["keyword"].lower() in f["context"].lower() and 0 <= f["relevance"] <= 100 for f in got)
    assert len({f["keyword"].lower() for f in got}) == len(got) == len({f["target"].id for f in got})


def test_probes_are_capped():
    from unittest import mock

    words = [f"keyword{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(90)]
    source = suggest.Post(0, "Source", "<p>" + " ".join(words) + " shared shared</p>", 1.0, frozenset())
    targets = [suggest.Post(i + 1, f"{w.title()} shared", f"<p>{w} {w} shared</p>", 1.0, frozenset()) for i, w in enumerate(words)]
    with mock.patch.object(suggest, "keyword_context", return_value=None) as probe:
        suggest.candidates(source, targets, EngineConfig(min_words=1))
    assert probe.call_count <= 40


def test_target_pool_is_bounded(spark):
    ids = spark.range(300)
    pool = text.target_pool(ids.selectExpr("id as source"), ids.selectExpr("id as target", "id % 30 as age_days"), ids.selectExpr("id as source", "id + 1 as target"), EngineConfig())
    assert pool.groupBy("source").count().selectExpr("max(count)", "min(count)").first()[:] == (100, 100)
    assert pool.where("source = target or target = source + 1").count() == 0


@pytest.mark.parametrize("op", ["save", "delete"])
def test_latest_change(spark, op):
    from linkscope.streaming.changes import latest

    df = spark.createDataFrame([(1, 1, "status"), (1, 2, op), (2, 1, "save")], "post_id long, seq long, op string")
    assert {r.post_id: r.op for r in latest(df).collect()} == {1: op, 2: "save"}


def test_scorer_is_asked_and_may_fail(spark):
    sources = spark.createDataFrame([(1, "One  title", "t " * 1000), (2, None, None), (3, "Three", "no candidates")], "source long, title string, text string")
    cands = spark.createDataFrame([(1, n, f"T{n}", "e" * 500, "k", float(n)) for n in range(1, 15)] + [(2, 1, None, None, None, 7.0)], "source long, number int, title string, excerpt string, keyword string, relevance double")
    asked = rerank.prompts(sources, cands, EngineConfig())
    got = {r.source: r for r in asked.collect()}
    assert {k: r.n for k, r in got.items()} == {1: 12, 2: 1}
    assert "Source: One title\n" in got[1].prompt and "\n2) T2 / " + "e" * 240 + "… / anchor: k\n3)" in got[1].prompt and len(got[1].prompt) < 6000

    def scorer(prompt):
        if "One title" not in prompt:
            raise OSError("not reached")
        return 'As asked: {"1": 250, "2": "12.7", "3": "high", ' + ", ".join(f'"{n}": {n}' for n in range(4, 15)) + "}"

    after = {(r.source, r.number): r.relevance for r in rerank.override(cands.select("source", "number", "relevance"), rerank.scores(rerank.ask(asked, scorer))).collect()}
    assert after[1, 1] == 100 and after[1, 2] == 12 and after[1, 3] == 3 and after[1, 12] == 12 and after[1, 13] == 13 and after[2, 1] == 7


def test_only_exclusions_of_the_newest_make_the_pool_longer(spark):
    targets = spark.createDataFrame([(i, float(i)) for i in range(60)], "id long, age_days double")
    cases = {1: range(5, 60), 2: [], 3: [0, 1, 2], 4: [*range(4), 4, 6, 8, 50], 5: [0, 0, 0], 6: range(60)}
    for wanted in (3, 5):
        for source, barred in cases.items():
            met = over = 0
            for i in range(60):
                if met < wanted:
                    over, met = over + (i in set(barred)), met + (i not in set(barred))
            got = suggest.passed_over(targets, spark.createDataFrame([(source, b) for b in barred], "source long, target long"), wanted)
            assert got == over, (source, wanted)
