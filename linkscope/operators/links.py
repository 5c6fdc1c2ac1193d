"""Building and maintaining the link index."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkscope.config import EngineConfig
from linkscope.functions import urls
from linkscope.operators.scope import scoped

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
LINK = "array<struct<pos:int,href:string,anchor:string,context:string>>"


class _Anchors(HTMLParser):
    """Anchors in document order, with the text of their parent, or of its parent if that is short."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []  # the page's text; a node's is the part of it from begin to end
        self.root: dict = {"tag": "", "begin": 0, "end": None, "up": None}
        self.at, self.found = self.root, []

    def _leave(self, node: dict) -> None:
        """Ends the open nodes up to this one."""
        while self.at is not node["up"]:
            self.at["end"] = len(self.parts)
            self.at = self.at["up"]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in VOID:
            return
        if tag in ("p", "li") and self.at["tag"] == tag:
            self._leave(self.at)
        self.at = {"tag": tag, "begin": len(self.parts), "end": None, "up": self.at}
        if tag == "a":
            self.found.append((dict(attrs).get("href"), self.at))

    def handle_endtag(self, tag: str) -> None:
        node = self.at
        while node["up"] is not None and node["tag"] != tag:
            node = node["up"]
        if node["up"] is not None:
            self._leave(node)

    def handle_data(self, data: str) -> None:
        self.parts.append(data)

    def links(self) -> list[dict]:
        out = []
        for href, node in self.found:
            text = lambda n: "".join(self.parts[n["begin"] : n["end"]]).strip()
            if not href or href == "0":
                continue
            up = node["up"]
            context = text(up) if up["tag"] or up["up"] is None else ""
            if len(context.encode()) < 50 and up["up"] is not None:
                context = text(up["up"])
            out.append({"pos": len(out) + 1, "href": href, "anchor": text(node), "context": context})
        return out


def anchors(html: str | None) -> list[dict]:
    parser = _Anchors()
    parser.feed(html or "")
    parser.close()
    return parser.links()


def extract_links(pages: DataFrame, id_col: str, url_col: str, html_col: str, cfg: EngineConfig) -> DataFrame:
    """source_id, pos, link_url as written, anchor_text, context, and url: the link resolved against its page, null if it leads nowhere."""
    slim = pages.select(F.col(id_col).alias("source_id"), F.col(url_col).alias("base"), F.col(html_col).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("pos", pa.int32()), ("href", pa.string()), ("anchor", pa.string()), ("context", pa.string())]))
        for batch in batches:
            found = pa.array([anchors(h.as_py()) for h in batch.column("html")], kind)
            yield pa.RecordBatch.from_arrays([batch.column("source_id"), batch.column("base"), found], names=["source_id", "base", "links"])

    parsed = slim.mapInArrow(run, f"source_id {dict(slim.dtypes)['source_id']}, base string, links {LINK}").select("source_id", "base", F.inline("links"))
    return parsed.select(
        "source_id", "pos", F.substring("href", 1, cfg.url_chars).alias("link_url"), F.substring("anchor", 1, cfg.anchor_chars).alias("anchor_text"), F.substring("context", 1, cfg.context_chars).alias("context"), urls.resolve(F.col("href"), F.col("base")).alias("url")
    )


def live_targets(found: DataFrame, posts: DataFrame) -> DataFrame:
    """Adds target_id: the published post or the attachment whose permalink the URL is, smallest id first; ?p=, ?page_id= and ?attachment_id= name one by number."""
    seen = posts.where("status = 'publish' or (status = 'inherit' and type = 'attachment')")
    by_url = seen.groupBy(urls.comparable_url(F.col("permalink")).alias("key")).agg(F.min("id").alias("by_url"))
    number = F.expr("try_cast(nullif(regexp_extract(url, '[?&](?:p|page_id|attachment_id)=([0-9]+)', 1), '') as bigint)")
    ids = seen.select(F.col("id").alias("number"), F.col("id").alias("by_number"))
    met = found.withColumns({"key": urls.comparable_url(F.col("url")), "number": number}).join(by_url, "key", "left")
    # Few URLs name a post by number; the others take no part in that join, where they would all have one key.
    numbered = met.where("number is not null").join(ids, "number", "left").unionByName(met.where("number is null").withColumn("by_number", F.lit(None).cast("long")))
    return numbered.withColumn("target_id", F.coalesce("by_url", "by_number")).drop("key", "number", "by_url", "by_number")


def unpublished_targets(wanted: DataFrame, posts: DataFrame) -> DataFrame:
    """wanted: distinct url. The first unpublished post by id whose address, once published, is the URL: (url, target_id).

    A trashed post goes by the slug it had: the desired one, else its own without the mark.
    """
    hidden = posts.where(F.col("status").isin("draft", "pending", "future", "trash"))
    slug = F.when(F.col("status") == "trash", F.coalesce("desired_slug", F.regexp_replace("slug", "__trashed$", ""))).otherwise(F.col("slug"))
    address = F.concat(F.regexp_extract("permalink", r"^(.*?)[^/]*/?$", 1), slug, F.lit("/"))
    named = hidden.select(F.lower(slug).alias("last"), urls.comparable_url(address).alias("key"), F.col("id"))
    asked = wanted.select("url", urls.last_segment(F.col("url")).alias("last"), urls.comparable_url(F.col("url")).alias("key"))
    return asked.join(named, ["last", "key"]).groupBy("url").agg(F.min("id").alias("target_id"))


def carried_targets(found: DataFrame, previous: DataFrame, posts: DataFrame) -> DataFrame:
    """found: (source_post_id, link_url) without a target. The target the index had, if that post is gone or hidden: adds target_id.

    Of repeated rows of the index, the last counts.
    """
    last = previous.groupBy("source_post_id", "link_url").agg(F.max_by("target_post_id", "pos").alias("had"))
    seen = posts.where(F.col("status").isin("publish", "private", "inherit")).select(F.col("id").alias("had"))
    return found.join(last, ["source_post_id", "link_url"]).join(seen, "had", "left_anti").select("source_post_id", "link_url", F.col("had").alias("target_id"))


def build_index(posts: DataFrame, cfg: EngineConfig, previous: DataFrame | None = None) -> DataFrame:
    """The links of all posts in scope: live target, else unpublished, else carried over, else dropped."""
    found = extract_links(scoped(posts, cfg), "id", "permalink", "content", cfg)
    inside = found.where(urls.is_internal(F.col("url"), F.lit(cfg.site_url)))
    live = live_targets(inside, posts)
    hidden = unpublished_targets(live.where("target_id is null").select("url").distinct(), posts).withColumnRenamed("target_id", "hidden_id")
    met = live.join(hidden, "url", "left").withColumn("target_id", F.coalesce("target_id", "hidden_id")).withColumnRenamed("source_id", "source_post_id")
    if previous is not None:
        carried = carried_targets(met.where("target_id is null").select("source_post_id", "link_url").distinct(), previous, posts).withColumnRenamed("target_id", "carried_id")
        met = met.join(carried, ["source_post_id", "link_url"], "left").withColumn("target_id", F.coalesce("target_id", "carried_id"))
    return met.where("target_id is not null").select("source_post_id", "pos", F.col("target_id").alias("target_post_id"), "anchor_text", "context", "link_url")


def matchable(html: Column) -> Column:
    """As functions.linker.matchable_text, in the JVM."""
    from linkscope.functions.linker import REMOVALS

    for pattern, by in REMOVALS:
        html = F.regexp_replace(html, "(?is)" + pattern, by)
    return F.trim(html)
