import pytest
from pyspark.sql import functions as F

from linkscope.config import EngineConfig
from linkscope.functions import urls
from linkscope.operators import links

BASE = "https://north.example.org/trips/alps/day-one/"
HREFS = [
    ("../day-two/", "https://north.example.org/trips/alps/day-two/"),
    ("/maps?sheet=7#legend", "https://north.example.org/maps?sheet=7"),
    ("//cdn.north.example.org/m.css", "https://cdn.north.example.org/m.css"),
    ("photos/1.jpg", "https://north.example.org/trips/alps/day-one/photos/1.jpg"),
    ("?view=list", "https://north.example.org/trips/alps/day-one/?view=list"),
    ("HTTP://North.Example.org", "http://north.example.org/"),
    ("http://me:pw@north.example.org:81/x/./y/../z", "http://north.example.org:81/x/z"),
    ("./", "https://north.example.org/trips/alps/day-one/"),
    ("../../../../../up", "https://north.example.org/up"),
    ("/a//b/", "https://north.example.org/a//b/"),
    (" \t/padded\n", "https://north.example.org/padded"),
    ("#map", None),
    ("tel:+4100", None),
    ("data:text/plain,x", None),
    ("   ", None),
    (None, None),
]


def test_resolve(spark):
    df = spark.createDataFrame([(i, h) for i, (h, _) in enumerate(HREFS)], "i int, href string")
    got = {r.i: r.url for r in df.select("i", urls.resolve(F.col("href"), F.lit(BASE)).alias("url")).collect()}
    assert [got[i] for i in range(len(HREFS))] == [u for _, u in HREFS]


def test_internal_ignores_case_and_www(spark):
    seen = {"hTTp://NORTH.example.ORG:8080/gear": True, "https://www.north.example.org/": True, "../hut": True, "https://south.example.org/trips/": False, "https://truenorth.example.org/": False, "tel:1": False, "#": False}
    df = spark.createDataFrame([(h,) for h in seen], "href string")
    url = urls.resolve(F.col("href"), F.lit(BASE))
    got = {r.href: bool(r.ok) for r in df.select("href", F.coalesce(urls.is_internal(url, F.lit("https://North.example.org/trips")), F.lit(False)).alias("ok")).collect()}
    assert got == seen


POST = "id long, status string, type string, content string, permalink string, slug string, desired_slug string, category_ids array<long>"


def test_index_resolves_live_hidden_and_carried(spark):
    site = "https://example.test/"
    content = '<p><a href="/b/">b</a> <a href="/c/">c</a> <a href="/gone/">g</a> <a href="https://other.test/">o</a> <a href="0">z</a> <a href="/t/">t</a></p>'
    posts = spark.createDataFrame(
        [(1, "publish", "post", content, site + "a/", "a", None, [1]), (2, "publish", "post", "", site + "b/", "b", None, [1]), (3, "draft", "post", "", site + "c/", "c", None, [1]), (4, "trash", "post", "", site + "t__trashed/", "t__trashed", None, [1]), (5, "publish", "post", content, site + "e/", "e", None, [3])], POST
    )
    before = spark.createDataFrame([(1, 1, 99, "/gone/")], "source_post_id long, pos int, target_post_id long, link_url string")
    got = links.build_index(posts, EngineConfig(site_url=site), before).orderBy("pos").collect()
    assert [(r.source_post_id, r.link_url, r.target_post_id) for r in got] == [(1, "/b/", 2), (1, "/c/", 3), (1, "/gone/", 99), (1, "/t/", 4)]


@pytest.mark.parametrize("html", [None, "", "<a>", "<a href>x", "<p>no links"])
def test_anchors_of_odd_pages(html):
    assert links.anchors(html) == []


def test_short_context_is_the_grandparents():
    long = "x" * 60
    assert links.anchors(f"<div>{long}<p><a href='/a'>go</a></p></div>")[0]["context"] == long + "go"
    assert links.anchors(f"<div>head<p>{long}<a href='/a'>go</a></p></div>")[0]["context"] == long + "go"
