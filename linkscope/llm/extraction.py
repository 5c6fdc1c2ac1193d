"""Operator 9, main text of web pages by equivalence-class template deduction.

Pages of one host are dealt into groups of about ``group_pages`` by a hash of their id, so that a host with any share of the pages spreads
over tasks and no group outgrows one. In a group, the tokens of a page are its tags and text runs, each told apart by its path of
elements. Tokens with the same occurrence vector (their counts on the group's distinct pages) form a class. A class is valid if its tokens
come in the same order on every page; one that is not falls into the pairs of start and end tag of which it consists, which are. A tag
may belong to a class whatever its support, a text run only if half of the group's pages, four at least, have it, near-equal pages counted once.
Classes nest: each lies in a gap of the class that holds the nearest element around it. The valid classes are the template; what is left in its
gaps are the slots, each named by the innermost template element around it.

Slots alone decide. A slot is left out if a template element around it is a menu, header, footer, sidebar, notice, advert, form or
comment section by its name or class; text outside every class is one slot without a name, and stays. If a page has filled slots inside an
article, those are its main text. On other pages text runs of the template go, and so do slots that hold links and little else on the
group's pages together, unless they are paragraphs or headings.

A page is read once, from left to right, in time in proportion to its length, whatever is left open in it.

Defined results: a null or empty html has the text ''; a null url belongs to the host ''; repeated rows are read one by one and count once
for the template; a null id is kept; scripts, styles, form fields, frames and what is never shown (template, noscript) are no text; empty
tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkscope.llm.common import quoted, written

NAME = re.compile(r"[A-Za-z][A-Za-z0-9:-]*")
MARK = re.compile(r"[>\"']")
#: Elements whose content is no markup, or never shown.
RAW = {n: re.compile(rf"</{n}\s*>", re.I) for n in "script style noscript template iframe textarea select".split()}
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""")
QUOTED = re.compile(r"""=\s*(?:"[^"]*"|'[^']*')""")
HEADING = re.compile(r"h[1-6]")
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
JUNK_TAGS = frozenset("head title nav footer aside form menu dialog button fieldset".split())
MAIN_TAGS = frozenset(("article", "main"))
#: Words of class, id and role that name what surrounds an article, and words that name the article itself.
JUNK_WORDS = frozenset(
    "ad ads adv advert advertisement adverts alert banner breadcrumb breadcrumbs comment comments consent contentinfo cookie cookies copyright disqus footer "
    "gdpr header hidden login masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted promotion "
    "recommended related replies respond search share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget".split()
)
MAIN_WORDS = frozenset("article articlebody body content entry headline main page post story text title wrapper".split())
#: Elements that an end tag of an inline element or a paragraph does not close.
BARRIER = frozenset("article aside body div footer form header html li main nav section table td th tr ul ol".split())
#: Elements that close an open one of their name.
SIBLINGS = frozenset("p li tr td th dt dd option".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre".split())


@dataclass(frozen=True)
class ExtractionRules:
    group_pages: int = 64
    group_bytes: int = 16 << 20
    min_support: float = 0.5
    min_pages: int = 4
    min_class: int = 2
    near_equal: float = 0.5
    link_share: float = 0.8
    broadcast_rows: int = 50_000


def scan(html: str) -> Iterator[tuple[str, str, str]]:
    """("text", "", text), ("start", name, attributes) and ("end", name, ""), in page order.

    A tag that does not end is text. Each failure to find an end is remembered, so that no part of a page is searched again and again.
    """
    n, at, failed, dead = len(html), 0, set(), {}

    def find(what: str, start: int) -> int:
        if start >= dead.get(what, n + 1):
            return -1
        found = html.find(what, start)
        if found < 0:
            dead[what] = start
        return found

    def tag_end(start: int) -> int:
        """The place of the > outside quotation marks, or -1; failed: marks from which no such place can be reached."""
        seen = []
        while start < dead.get("mark", n + 1):
            mark = MARK.search(html, start)
            if mark is None:
                dead["mark"] = start
                break
            place = mark.start()
            if mark[0] == ">":
                return place
            if place in failed:
                break
            seen.append(place)
            close = find(mark[0], place + 1)
            if close < 0:
                break
            start = close + 1
        failed.update(seen)
        return -1

    look = 0
    while (start := find("<", look)) >= 0:
        look, end, item = start + 1, -1, None  # until an end is found, this is text that goes on
        following = html[start + 1 : start + 2]
        if html.startswith("<!--", start):
            close = find("-->", start + 4)
            end = close + 3 if close >= 0 else n
        elif following and following in "!?/":
            end = find(">", start) + 1 or -1
            if following == "/" and end >= 0 and (name := NAME.match(html, start + 2)):
                item = ("end", name[0].lower(), "")
        elif (name := NAME.match(html, start + 1)) and (close := tag_end(name.end())) >= 0:
            tag, end = name[0].lower(), close + 1
            if tag in RAW:
                ended = RAW[tag].search(html, end)
                end = ended.end() if ended else n
            else:
                item = ("start", tag, html[name.end() : close])
        if end < 0:
            continue
        if start > at:
            yield "text", "", html[at:start]
        if item:
            yield item
        at = look = end
    if at < n:
        yield "text", "", html[at:]


def _element(name: str, attrs: str) -> tuple[str, bool, bool]:
    """The element's step in a path, whether its name or classes say that it surrounds an article, and whether they say that it is one."""
    junk, main, words = name in JUNK_TAGS, name in MAIN_TAGS, []
    if "=" in attrs:
        for key, a, b, c in ATTRIBUTE.findall(attrs):
            key, value = key.lower(), a or b or c
            if key in ("class", "id", "role", "itemprop"):
                words += re.split(r"[\s_-]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", value).lower())
            elif key == "style" and re.search(r"display\s*:\s*none", value) or key == "aria-hidden" and value == "true":
                junk = True
    if "hidden" in attrs and "hidden" in QUOTED.sub("=", attrs).lower().replace("/", " ").split():
        junk = True
    if words:
        main = main or name not in INLINE and "articlebody" in words
        junk = junk or not MAIN_WORDS.intersection(words) and not JUNK_WORDS.isdisjoint(words) or "comment" in words or "comments" in words
    return (f"{name}.{'.'.join(words)}" if words else name), junk, main and not junk


class Paths:
    """Numbers for the paths of elements of a group's pages; path 0 is outside every element."""

    def __init__(self) -> None:
        self.numbers: dict[tuple[int, str, bool], int] = {}
        self.parent, self.name, self.junk, self.main, self.inside = [0], [""], [False], [False], [False]

    def child(self, parent: int, name: str, attrs: str) -> int:
        step, junk, main = _element(name, attrs)
        number = self.numbers.setdefault((parent, step, junk), len(self.parent))
        if number == len(self.parent):
            self.parent.append(parent)
            self.name.append(name)
            self.junk.append(junk or name == "header" and not self.inside[parent])  # an article's own header is part of it
            self.main.append(main)
            self.inside.append(main or self.inside[parent])
        return number

    def around(self, path: int) -> Iterator[int]:
        """The path and those around it, innermost first."""
        while path:
            yield path
            path = self.parent[path]


@dataclass
class Run:
    """A block of text: the path of its block, its parts with the paths that they lie in, and how much of them is linked."""

    path: int
    parts: list[tuple[int, str, bool]] = field(default_factory=list)

    def text(self, parts: list[tuple[int, str, bool]] | None = None) -> str:
        return " ".join(entities.unescape("".join(t for _, t, _ in (self.parts if parts is None else parts))).split())


#: Tags are numbers: twice the path for a start, one more for an end.
Page = list["int | Run"]


def parse(html: str, paths: Paths) -> Page:
    """The tags and text runs of a page. What is left open ends with the element around it, or with the page; stray end tags are ignored."""
    tokens: Page = []
    stack: list[tuple[str, int]] = [("", 0)]
    opened: Counter = Counter()
    run: Run | None = None

    def close_to(depth: int) -> None:
        while len(stack) > depth:
            name, path = stack.pop()
            opened[name] -= 1
            if name not in INLINE or paths.junk[path]:
                tokens.append(2 * path + 1)

    def close(name: str, within: bool) -> None:
        """Ends the innermost element of this name, unless (within) a barrier lies before it."""
        if opened[name]:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] == name:
                    close_to(depth)
                    return
                if within and stack[depth][0] in BARRIER:
                    return

    for kind, name, rest in scan(html):
        if kind == "text":
            if run is None:
                if rest.isspace():
                    continue
                run = Run(next((p for p in paths.around(stack[-1][1]) if paths.name[p] not in INLINE), 0))
                tokens.append(run)
            run.parts.append((stack[-1][1], rest, opened["a"] > 0))
            continue
        inline = name in INLINE
        if not inline:
            run = None
        elif name == "br" and run is not None:
            run.parts.append((stack[-1][1], " ", False))
        if kind == "end":
            close(name, inline or name == "p")
            continue
        if name in SIBLINGS:
            close(name, True)
        path = paths.child(stack[-1][1], name, rest)
        if paths.main[path] and not paths.inside[stack[-1][1]]:
            junk = next((d for d in range(1, len(stack)) if paths.junk[stack[d][1]]), None)
            if junk is not None:  # an unclosed menu does not swallow the article
                close_to(junk)
                path = paths.child(stack[-1][1], name, rest)
        if not inline or paths.junk[path]:
            tokens.append(2 * path)
        if name not in VOID and not rest.endswith("/"):
            stack.append((name, path))
            opened[name] += 1
    close_to(1)
    return tokens


@dataclass
class TemplateClass:
    vector: tuple[int, ...]
    tokens: list
    parent: int | None = None


@dataclass
class Template:
    """Valid classes, the paths of the elements whose tags they hold, and their text runs (path, text)."""

    classes: list[TemplateClass] = field(default_factory=list)
    elements: set[int] = field(default_factory=set)
    texts: set[tuple[int, str]] = field(default_factory=set)


def _distinct(sequences: list[list], rules: ExtractionRules) -> list[int]:
    """Places of pages of which none shares most of its longer texts with an earlier one of them."""
    owners: dict[tuple, list[int]] = defaultdict(list)
    own = [{t for t in s if isinstance(t, tuple) and len(t[1]) >= 30} or {t for t in s if isinstance(t, tuple)} for s in sequences]
    kept = []
    for i, texts in enumerate(own):
        shared = Counter(j for t in texts for j in owners[t])
        if not any(n >= rules.near_equal * min(len(texts), len(own[j])) for j, n in shared.items()):
            kept.append(i)
            for t in texts:
                owners[t].append(i)
    return kept


def deduce(pages: list[Page], paths: Paths, rules: ExtractionRules) -> Template:
    """The template of a group's distinct pages."""
    sequences = [[t if isinstance(t, int) else (t.path, t.text()) for t in p] for p in pages]
    counts = [Counter(s) for s in sequences]
    distinct = _distinct(sequences, rules)
    support = Counter(t for i in distinct for t in counts[i] if isinstance(t, tuple))
    least = max(rules.min_pages, rules.min_support * len(distinct))
    vectors: dict[object, list[tuple[int, int]]] = defaultdict(list)  # only pages that have the token
    for i, c in enumerate(counts):
        for token, k in c.items():
            if isinstance(token, int) or support[token] >= least:
                vectors[token].append((i, k))
    number: dict[tuple, int] = {}
    class_of = {token: number.setdefault(tuple(v), len(number)) for token, v in vectors.items()}
    by_class: list[list] = [[] for _ in number]
    for token, c in class_of.items():
        by_class[c].append(token)
    # On each page, the class's tokens in the order in which they first come.
    orders: list[list | None] = [None] * len(number)
    valid = [len(tokens) >= rules.min_class for tokens in by_class]
    for sequence in sequences:
        here: dict[int, list] = defaultdict(list)
        for token in dict.fromkeys(sequence):
            if token in class_of:
                here[class_of[token]].append(token)
        for c, order in here.items():
            orders[c] = orders[c] or order
            valid[c] = valid[c] and order == orders[c]
    found = Template()
    holder: dict[int, int] = {}
    for vector, c in number.items():
        tags = [t for t in by_class[c] if isinstance(t, int)]
        pairs = [[t, t + 1] for t in tags if not t & 1 and class_of.get(t + 1) == c]
        for tokens in [orders[c]] if valid[c] else pairs:
            found.classes.append(TemplateClass(tuple(k for _, k in vector), tokens))
            found.texts.update(t for t in tokens if isinstance(t, tuple))
            for t in tokens:
                if isinstance(t, int):
                    found.elements.add(t >> 1)
                    holder[t >> 1] = len(found.classes) - 1
    for c, one in enumerate(found.classes):
        first = next((t >> 1 if isinstance(t, int) else t[0] for t in one.tokens), 0)
        one.parent = next((holder[p] for p in paths.around(first) if p in holder and holder[p] != c), None)
    return found


class Slots:
    """The slots of a group's template, and what the group's pages have in them."""

    def __init__(self, pages: list[Page], template: Template, paths: Paths, rules: ExtractionRules) -> None:
        self.template, self.paths, self.rules = template, paths, rules
        self.known: dict[int, tuple[int, bool, bool]] = {0: (0, False, False)}
        chars, linked = Counter(), Counter()
        for page in pages:
            for run in page:
                if isinstance(run, Run):
                    for path, text, link in run.parts:
                        slot, n = self.of(path)[0], len(text.strip())
                        chars[slot] += n
                        linked[slot] += n * link
        self.links = {s for s, n in chars.items() if linked[s] >= rules.link_share * n and paths.name[s] not in PROSE}

    def of(self, path: int) -> tuple[int, bool, bool]:
        """The slot of a path, whether the template says that it is left out, and whether it lies in an article."""
        way = []
        while path not in self.known:
            way.append(path)
            path = self.paths.parent[path]
        for p in reversed(way):
            slot, out, main = self.known[self.paths.parent[p]]
            if p in self.template.elements:
                block = self.paths.name[p] not in INLINE
                slot, out, main = p if block else slot, out or self.paths.junk[p], main or self.paths.main[p]
            self.known[p] = slot, out, main
            path = p
        return self.known[path]

    def main_text(self, page: Page) -> str:
        kept: list[tuple[bool, Run, str]] = []
        for run in page:
            if isinstance(run, Run):
                parts = [x for x in run.parts if not self.of(x[0])[1]]
                if text := run.text(parts):
                    kept.append((self.of(run.path)[2], run, text))
        if any(main for main, _, _ in kept):
            return "\n".join(text for main, _, text in kept if main)
        return "\n".join(text for _, run, text in kept if (run.path, run.text()) not in self.template.texts and self.of(run.path)[0] not in self.links)


def extract_group(htmls: list[str], rules: ExtractionRules) -> list[str]:
    """The main texts of a group's pages, equal pages read once."""
    paths = Paths()
    pages = {h: parse(h, paths) for h in dict.fromkeys(htmls)}
    distinct = list(pages.values())
    slots = Slots(distinct, deduce(distinct, paths, rules), paths, rules)
    texts = {h: slots.main_text(p) for h, p in pages.items()}
    return [texts[h] for h in htmls]


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rules: ExtractionRules | None = None) -> DataFrame:
    """Per row: page_id, url and text."""
    rules = rules or ExtractionRules()
    host = F.coalesce(F.lower(F.regexp_extract(quoted(url_col), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))
    slim = pages.select(quoted(id_col).alias("page_id"), quoted(url_col).alias("url"), F.coalesce(quoted(html_col), F.lit("")).alias("html"), host.alias("host"))
    # Only hosts with more than one group are listed; so short a list, counted here, is sent to all, a longer one joined.
    sizes = slim.groupBy("host").agg(F.count("*").alias("n"), F.sum(F.octet_length("html")).alias("bytes"))
    n_groups = F.greatest(F.ceil(F.col("n") / rules.group_pages), F.ceil(F.col("bytes") / rules.group_bytes))
    large = written(sizes.select("host", n_groups.alias("n_groups")).where("n_groups > 1"), "hosts")
    listed = F.broadcast(large) if large.count() <= rules.broadcast_rows else large
    bucket = F.pmod(F.xxhash64("page_id", "url"), F.coalesce("n_groups", F.lit(1)).cast("long"))
    dealt = slim.join(listed, "host", "left").select("page_id", "url", "html", "host", bucket.alias("bucket"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def done() -> Iterator[pa.RecordBatch]:
            ids, urls, htmls = zip(*held, strict=True)
            texts = extract_group(list(htmls), rules)
            for at in range(0, len(ids), 256):
                here = slice(at, at + 256)
                yield pa.RecordBatch.from_arrays([pa.array(ids[here], id_type), pa.array(urls[here], pa.string()), pa.array(texts[here], pa.string())], names=["page_id", "url", "text"])

        for batch in batches:
            id_type = batch.schema.field("page_id").type
            for at in range(0, batch.num_rows, 64):
                some = batch.slice(at, 64).to_pydict()
                for page_id, url, html, h, b in zip(some["page_id"], some["url"], some["html"], some["host"], some["bucket"], strict=True):
                    if held and key != (h, b):
                        yield from done()
                        held = []
                    key = (h, b)
                    if held and html == held[-1][2]:
                        html = held[-1][2]  # a copy is held once
                    held.append((page_id, url, html))
        if held:
            yield from done()

    kind = slim.schema["page_id"].dataType.simpleString()
    return dealt.repartition("host", "bucket").sortWithinPartitions("host", "bucket", F.xxhash64("html"), "page_id").mapInArrow(run, f"page_id {kind}, url string, text string")


def query(spark, sf_dir: str) -> DataFrame:
    """op9: every page of the table."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
