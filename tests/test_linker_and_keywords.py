import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from linkscope.functions.keywords import cap, keyword_pattern, title_keywords, tokenise, topic_phrases
from linkscope.functions.linker import find, insert, keyword_context, matchable_text

URL = "https://example.test/x/"


def linked(html, keyword="tomatoes"):
    return insert(html, keyword, URL)


@pytest.mark.parametrize(
    ("before", "after"),
    [
        ("<p>Grow tomatoes now</p>", f'<p>Grow <a href="{URL}">tomatoes</a> now</p>'),
        ("<p>Tomatoes first, tomatoes next</p>", f'<p><a href="{URL}">Tomatoes</a> first, tomatoes next</p>'),
        ('<p title="tomatoes">x</p><p>tomatoes</p>', f'<p title="tomatoes">x</p><p><a href="{URL}">tomatoes</a></p>'),
        ("<a href='/'>tomatoes</a> tomatoes", f"<a href='/'>tomatoes</a> <a href=\"{URL}\">tomatoes</a>"),
        ("<h2>tomatoes</h2><p>tomatoes</p>", f'<h2>tomatoes</h2><p><a href="{URL}">tomatoes</a></p>'),
        ("<script>tomatoes</script>tomatoes", f'<script>tomatoes</script><a href="{URL}">tomatoes</a>'),
        ("<!-- tomatoes -->tomatoes", f'<!-- tomatoes --><a href="{URL}">tomatoes</a>'),
        ("[caption]tomatoes[/caption] tomatoes", f'[caption]tomatoes[/caption] <a href="{URL}">tomatoes</a>'),
        ("<code>tomatoes</code> tomatoes", f'<code>tomatoes</code> <a href="{URL}">tomatoes</a>'),
        ('<pre class="wp-block-code">tomatoes</pre><pre>tomatoes</pre>', f'<pre class="wp-block-code">tomatoes</pre><pre><a href="{URL}">tomatoes</a></pre>'),
        ("a@tomatoes.test http://x.test/tomatoes tomatoes", f'a@tomatoes.test http://x.test/tomatoes <a href="{URL}">tomatoes</a>'),
    ],
)
def test_links_the_first_place_that_may_be(before, after):
    assert linked(before) == after


@pytest.mark.parametrize("html", ["", "none", "<p>tomatoesque</p>", "cherry<b>tomatoes</b>", "<b>tomatoes</b>ish", "<h1>tomatoes</h1>", '<p title="tomatoes', "<textarea>tomatoes</textarea>", "<figcaption>tomatoes</figcaption>", "<script>tomatoes"])
def test_leaves_the_rest_alone(html):
    assert linked(html) is None


def test_ampersands_apostrophes_and_urls():
    assert insert("<p>salt &amp; pepper</p>", "salt & pepper", URL) == f'<p><a href="{URL}">salt &amp; pepper</a></p>'
    assert insert("<p>gardener&#8217;s guide</p>", "gardener's guide", URL) == f'<p><a href="{URL}">gardener&#8217;s guide</a></p>'
    assert insert("word", "word", "https://e.test/?a=1&b=2") == '<a href="https://e.test/?a=1&#038;b=2">word</a>'
    assert insert("word", " ", URL) is None


@given(st.text(alphabet="ab <>/\"'=!-[]&;pscript\n", max_size=60), st.sampled_from(["ab", "a b", "b"]))
@settings(max_examples=200, deadline=None)
def test_insertion_only_adds(html, keyword):
    span = find(html, keyword)
    if span:
        assert html[span[0] : span[1]].lower() == keyword
        assert insert(html, keyword, URL) == html[: span[0]] + f'<a href="{URL}">' + html[span[0] : span[1]] + "</a>" + html[span[1] :]


def test_context_and_matchable_text():
    text = " ".join(f"word{i}" for i in range(60)) + " tomatoes " + " ".join(f"more{i}" for i in range(80))
    got = keyword_context(f"<p>{text}</p>", "tomatoes")
    assert "tomatoes" in got and got.startswith("...") and got.endswith("...") and len(got) < 330
    assert matchable_text("<h1>t</h1><p>a<b>b</b>c &amp; <code>x</code>d</p><style>s</style>") == "abc &amp; d"


def test_titles():
    assert title_keywords("What Is Cold Brew Coffee?") == ["What Is Cold Brew Coffee", "Cold Brew Coffee"]
    assert title_keywords("Growing &amp; Pruning Roses, Tomatoes and Herbs") == ["Growing & Pruning Roses, Tomatoes and Herbs"]
    assert title_keywords("Hello") == [] and title_keywords(None) == []
    assert len(cap("word " * 100)) <= 255 and not cap("word " * 100).endswith(" ")
    assert tokenise("Über den Fluß, ДОМ and the été!") == ["über", "den", "fluß", "дом", "été"]


def test_topic_phrases_need_distinct_single_words():
    counts = {"roses": 3, "garden": 1, "soil": 2}
    got = topic_phrases("Roses in the Garden", counts, {"roses": 1, "garden": 9, "soil": 1}, 10)
    assert got == ["Roses", "roses", "soil"]


def test_whole_words_in_any_case():
    assert keyword_pattern("дом").search("Мой ДОМ.") and not keyword_pattern("cat").search("category")
