"""Changes one after another, brought up to date, against a rebuild from the tables as they are then."""

import pytest
from pyspark.sql import functions as F

from linkscope.config import EngineConfig
from linkscope.operators import reports, stats, suggest
from linkscope.operators.scope import prune
from linkscope.sources import tables
from linkscope.streaming import changes

CFG = EngineConfig()
POST = "id long, status string, type string, post_date timestamp_ntz, pageviews long, is_sticky boolean, category_ids array<long>"
LINK = "source_post_id long, target_post_id long, pos int"
#: 6 is a draft that others link to, 7 lies in an excluded category, 8 has no links.
LINKS = [(1, 2, 1), (1, 3, 2), (1, 1, 3), (2, 3, 1), (3, 1, 1), (3, 1, 2), (2, 6, 2), (4, 7, 1), (6, 4, 1), (6, 1, 2)]


def posts(spark, changed=None):
    rows = {i: (i, "draft" if i == 6 else "publish", "post", [3 if i == 7 else 1]) for i in range(1, 9)}
    for i, status in (changed or {}).items():
        if status is None:
            del rows[i]
        else:
            rows[i] = (i, status, "post", rows[i][3])
    df = spark.createDataFrame([(i, s, t, None, False, c) for i, s, t, c in rows.values()], "id long, status string, type string, pageviews long, is_sticky boolean, category_ids array<long>")
    return df.withColumn("post_date", F.expr("TIMESTAMP_NTZ '2001-01-01 00:00:00'"))


@pytest.mark.parametrize(
    ("ops", "after", "fresh"),
    [
        ([(1, 1, "save")], {}, [(1, 3, 1), (1, 8, 2)]),
        ([(1, 1, "save")], {}, []),
        ([(3, 1, "trash")], {3: "trash"}, [(3, 2, 1)]),
        ([(3, 1, "status")], {3: "draft"}, []),
        ([(2, 1, "delete"), (4, 1, "delete")], {2: None, 4: None}, []),
        ([(6, 1, "publish")], {6: "publish"}, [(6, 4, 1), (6, 6, 2)]),
        ([(6, 1, "publish"), (6, 2, "trash")], {6: "trash"}, [(6, 4, 1)]),
        ([(3, 1, "trash"), (3, 2, "untrash"), (1, 1, "save")], {}, [(3, 8, 1), (1, 3, 1)]),
        ([], {}, []),
    ],
)
def test_changes_equal_a_rebuild(spark, ops, after, fresh):
    before, now = posts(spark), posts(spark, after)
    links = prune(spark.createDataFrame(LINKS, LINK), before, CFG)
    feed = spark.createDataFrame(ops, "post_id long, seq long, op string")
    got_links, got_stats = changes.apply_changes(links, stats.compute(links, before, CFG), feed, spark.createDataFrame(fresh, LINK), now, CFG)
    changed = {p for p, _, _ in ops}
    live = {r.id for r in now.where("status = 'publish' and id != 7").collect()}
    want = [x for x in LINKS if x[0] not in changed and x[0] in live | {3, 1, 2, 4} and x[0] != 6] + [x for x in fresh if x[0] in live]
    assert sorted(map(tuple, got_links.select("source_post_id", "target_post_id", "pos").collect())) == sorted(want)
    rebuilt = stats.compute(spark.createDataFrame(want, LINK), now, CFG)
    assert sorted(map(tuple, got_stats.collect())) == sorted(map(tuple, rebuilt.collect()))


def test_status_changes(spark):
    table = spark.createDataFrame([(1, "pending"), (2, "pending"), (3, "applied")], "id long, status string")
    after, done = reports.set_status(table, spark.createDataFrame([(1, "applied"), (2, "unheard"), (9, "dismissed")], "id long, status string"))
    assert sorted(map(tuple, after.collect())) == [(1, "applied"), (2, "pending"), (3, "applied")]
    assert sorted(map(tuple, done.collect())) == [(1, True), (2, False), (9, False)]


def test_store_keeps_what_was_decided(spark):
    row = "id long, source_post_id long, target_post_id long, keyword string, relevance_score double, status string"
    stored = spark.createDataFrame([(1, 1, 2, "a", 1.0, "pending"), (2, 1, 3, "b", 1.0, "dismissed"), (3, 1, 4, "c", 1.0, "applied"), (4, 5, 2, "d", 1.0, "pending")], row)
    made = spark.createDataFrame([(1, 2, "e", 9.0), (1, 3, "f", 9.0), (1, 4, "g", 9.0), (1, 5, "h", 9.0), (5, 6, "i", 9.0)], "source_post_id long, target_post_id long, keyword string, relevance_score double")
    got = suggest.store(stored, made, spark.createDataFrame([(1,), (7,)], "source_post_id long")).collect()
    assert sorted((r.keyword, r.status) for r in got) == [("b", "dismissed"), ("c", "applied"), ("d", "pending"), ("e", "pending"), ("h", "pending")]
    assert len({r.id for r in got}) == len(got)


def test_apply_goes_through_the_linker(spark):
    row = "id long, status string, type string, content string, permalink string, category_ids array<long>"
    texts = {1: "<h2>rain</h2><p>no, <a href=/x>rain</a> [caption]rain[/caption] Rain falls</p>", 2: "<h2>rain</h2><script>rain</script>", 3: r"<p>a\Eb rain\Q</p>"}
    table = spark.createDataFrame([(i, "publish", "post", t, f"https://example.test/{i}/?a&b", [1]) for i, t in texts.items()] + [(4, "draft", "post", "rain", "https://example.test/4/", [1])], row)
    asked = spark.createDataFrame([(1, 1, 2, "rain", "pending"), (2, 2, 1, "rain", "pending"), (3, 3, 1, r"a\Eb", "pending"), (4, 1, 1, "rain", "pending"), (5, 1, 4, "rain", "pending"), (6, 1, 9, "rain", "pending"), (7, 1, 2, " ", "pending"), (8, 1, 2, "rain", "applied")], "id long, source_post_id long, target_post_id long, keyword string, status string")
    got = {r.id: (r.outcome, r.new_content) for r in reports.apply_outcome(asked, table, CFG).collect()}
    assert got[1] == ("ok", texts[1].replace("Rain falls", '<a href="https://example.test/2/?a&#038;b">Rain</a> falls'))
    assert got[3][0] == "ok" and r"a\Eb</a> rain\Q" in got[3][1]
    assert {i: got[i] for i in (2, 4, 5, 6, 7, 8)} == {2: ("keyword_missing", None), 4: ("same_post", None), 5: ("out_of_scope", None), 6: ("post_missing", None), 7: ("keyword_missing", None), 8: ("not_pending", None)}


def test_saves_wait_without_auto_scan(spark):
    links = spark.createDataFrame(LINKS, LINK)
    feed = spark.createDataFrame([(1, 1, "save"), (3, 1, "trash")], "post_id long, seq long, op string")
    now, _ = changes.apply_changes(links, stats.compute(links, posts(spark), CFG), feed, spark.createDataFrame([(1, 8, 1)], LINK), posts(spark, {3: "trash"}), EngineConfig(auto_scan=False))
    assert sorted(map(tuple, now.select("source_post_id", "target_post_id", "pos").collect())) == sorted(x for x in LINKS if x[0] != 3)


def test_stream_of_changes_publishes_versions(spark, tmp_path):
    """Micro-batches of a change feed, each with its posts' last changes; readers see the version published last."""
    row = "post_id long, seq long, op string"
    spark.createDataFrame([(1, 1, "save"), (1, 2, "trash"), (2, 1, "save")], row).coalesce(1).write.parquet(str(tmp_path / "feed"))
    seen = []

    def handle(batch, n):
        seen.append(sorted(map(tuple, batch.collect())))
        tables.publish(batch, str(tmp_path / "table"), f"v{n}")

    feed = spark.readStream.schema(row).parquet(str(tmp_path / "feed"))
    for more in ([], [(2, 5, "delete")]):
        if more:
            spark.createDataFrame(more, row).coalesce(1).write.mode("append").parquet(str(tmp_path / "feed"))
        changes.stream_of(feed, handle, str(tmp_path / "checkpoint")).trigger(availableNow=True).start().awaitTermination(60)
        assert sorted(map(tuple, tables.current(spark, str(tmp_path / "table")).collect())) == seen[-1]
    assert seen == [[(1, "trash"), (2, "save")], [(2, "delete")]]
    with pytest.raises(FileNotFoundError):
        tables.current(spark, str(tmp_path / "none"))
