"""Links whose target has no parent must not meet under one key."""

from linkscope.operators import reports


def test_the_join_with_parents_takes_posts_that_have_one(spark):
    posts = spark.createDataFrame([(i, "draft" if i % 2 else "publish", "post", f"t{i}", 0) for i in range(1, 400)] + [(500, "inherit", "attachment", "a", 1), (501, "inherit", "attachment", "b", 2), (502, "inherit", "attachment", "c", 0)], "id long, status string, type string, title string, parent_id long")
    links = spark.createDataFrame([(2, i, i, f"/{i}/") for i in range(1, 600)], "source_post_id long, target_post_id long, pos int, link_url string")
    found = reports.broken_links(links, posts)
    assert {r["target_post_id"]: r["target_label"] for r in found.collect() if r["target_post_id"] in (1, 2, 500, 501, 502, 599)} == {1: "Draft", 500: "Draft", 599: "Deleted"}
    # Before, the join with parents had the links on its left side.
    plan = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    at = next(i for i, line in enumerate(plan) if "Join LeftOuter, (p_id" in line)
    depth = len(plan[at]) - len(plan[at].lstrip(" :+-"))
    below = [x for x in plan[at + 1 :]]
    inner = [x for x, d in ((x, len(x) - len(x.lstrip(" :+-"))) for x in below) if d > depth]
    assert not any("link_url" in x for x in inner[: next((i for i, x in enumerate(below) if len(x) - len(x.lstrip(" :+-")) <= depth), len(inner))])
