"""Suggestions for new links: candidate phrases of the newest targets, found in each source, scored and chosen.

The newest targets are a bounded list (targets a source may have, and the most that one source has to pass over), so each task holds them
with their texts cut to cfg.text_chars, and the sources stream past.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import islice

import pandas as pd
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkscope.config import EngineConfig
from linkscope.functions.keywords import APOSTROPHES, WORD, cap, keyword_pattern, title_grams, title_keywords, tokenise, trim_trailing_punctuation
from linkscope.functions.linker import keyword_context, matchable_text

#: The most targets that a task may hold; sources that exclude more of the newest need the windowed pool of functions.text.target_pool.
MAX_HELD = 20_000
#: The most pools of targets that a task keeps; nearly all sources meet the same one.
MAX_POOLS = 16

MANY_SPELLINGS = frozenset("&" + APOSTROPHES)


@dataclass
class Post:
    """held: tokens of the post, made once for all sources that meet it."""

    id: int
    title: str
    content: str
    age_days: float
    categories: frozenset
    held: dict = field(default_factory=dict, repr=False)

    def words(self, chars: int | None) -> list[str]:
        if ("words", chars) not in self.held:
            self.held["words", chars] = tokenise(html.unescape(self.title) + " " + html.unescape(self.strip(chars)))
        return self.held["words", chars]

    def scored_words(self, chars: int | None) -> list[str]:
        if ("scored", chars) not in self.held:
            self.held["scored", chars] = tokenise(self.title + " " + self.strip(chars))
        return self.held["scored", chars]

    def counted(self, chars: int | None) -> Counter:
        if ("counted", chars) not in self.held:
            self.held["counted", chars] = Counter(self.scored_words(chars))
        return self.held["counted", chars]

    def strip(self, chars: int | None) -> str:
        raw = self.content[:chars] if chars else self.content
        raw = re.sub(r"<(script|style)[^>]*>.*?</\1>", "", raw, flags=re.S | re.I)
        return re.sub(r"<[^>]*>", "", raw).strip()


def _cosines(first: Counter, others: list[Counter]) -> list[float]:
    """Cosines of one text with others, each the counts of its words, by frequencies among them all."""
    df, n = Counter(first.keys()), 1 + len(others)
    for counts in others:
        df.update(counts.keys())
    inverse = {d: math.log((1 + n) / (1 + d)) + 1 for d in set(df.values())}

    def vector(counts: Counter) -> tuple[dict[str, float], float]:
        total = counts.total()
        v = {t: c / total * inverse[df[t]] for t, c in counts.items()}
        return v, sum([w * w for w in v.values()])

    (a, length), out = vector(first), []
    for counts in others:
        b, other = vector(counts)
        dot = sum(w * b[t] for t, w in a.items() if t in b)
        out.append(min(1.0, dot / math.sqrt(length * other)) if dot else 0.0)
    return out


def heuristic(keyword: str, source: Post, target: Post) -> float:
    lower = lambda s: re.sub("[A-Z]", lambda m: m[0].lower(), s)
    value = 1.5 if lower(keyword) == lower(trim_trailing_punctuation(html.unescape(target.title).strip())) else 1.0
    value *= 1 + 0.1 * len(re.findall(r"[A-Za-z][A-Za-z'-]*", keyword))
    value *= 1.2 if target.age_days < 30 else 1.1 if target.age_days < 90 else 1.0
    return math.floor(value * (1.3 if source.categories & target.categories else 1.0) * 100 + 0.5) / 100


WORD_RUN = regex.compile(f"[{WORD}]+")
#: Letters outside ASCII that a pattern in any case takes for ASCII ones.
FOLDED = frozenset("\u017f\u212a\u0130\u0131")


@dataclass
class Probe:
    """A phrase, the runs of its words if they are ASCII, and whether some character of it has many spellings."""

    phrase: str
    lower: str
    spelt: bool
    runs: frozenset


@lru_cache(maxsize=1 << 16)
def _probe(phrase: str) -> Probe:
    lower, spelt = phrase.lower(), bool(MANY_SPELLINGS.intersection(phrase))
    return Probe(phrase, lower, spelt, frozenset() if spelt else frozenset(r for r in WORD_RUN.findall(lower) if r.isascii()))


class Pool:
    """Targets that many sources meet, with all that doesn't depend on the source.

    A source raises the frequency of its own words by one and of no others. So each target's terms are sorted once by their weights without
    it and once by those with it, and its top terms are among the first of the one list that the source lacks and of the other that it has.
    """

    def __init__(self, targets: list[Post], cfg: EngineConfig) -> None:
        self.targets, self.cfg = targets, cfg
        self.counts = {p.id: Counter(p.words(cfg.text_chars)) for p in targets}
        self.df = Counter(t for c in self.counts.values() for t in c)
        self.n = len(self.counts) + 1
        self.common = max(1, math.ceil(self.n / 2))
        inverse = [math.log((1 + self.n) / (1 + d)) + 1 for d in range(self.n + 1)]
        rows = {}
        for i, counts in self.counts.items():
            total = sum(counts.values())
            lists = [sorted((-(c / total * inverse[self.df[t] + more]), t.encode(), t) for t, c in counts.items()) for more in (0, 1)]
            rows[i] = lists
        self.ranked = rows
        self.fixed = []
        for p in targets:
            whole = title_keywords(p.title, cfg.min_words)
            longer, singles = title_grams(p.title)
            self.fixed.append((whole + [c for c in map(cap, longer) if c], singles))

    def top(self, target: int, own: set[str]) -> list[str]:
        without, having = self.ranked[target]
        best = list(islice((x for x in without if x[2] not in own), self.cfg.top_terms))
        best += islice((x for x in having if x[2] in own), self.cfg.top_terms)
        return [x[2] for x in sorted(best)[: self.cfg.top_terms]]

    def phrases(self, at: int, own: set[str]) -> list[str]:
        """As title_keywords and topic_phrases."""
        (fixed, singles), cfg, target = self.fixed[at], self.cfg, self.targets[at].id
        top, counts = self.top(target, own), self.counts[target]
        distinct = {t for t in top if len(t) >= cfg.min_single_word and self.df[t] + (t in own) <= self.common}
        found = [cap(g) for g in singles if g.lower() in distinct] + [cap(t) for t in top if t in distinct and counts[t] >= 2]
        return fixed + [c for c in found if c]


def candidates(source: Post, targets: list[Post], cfg: EngineConfig, pool: Pool | None = None) -> list[dict]:
    """Phrases of each target, newest first, that the source's text holds where a link may stand.

    pool: of these targets, if it is at hand. The source is none of them.
    """
    pool = pool or Pool([p for p in targets if p.id != source.id], cfg)
    own = set(source.words(cfg.text_chars))
    text, probes, found = matchable_text(source.content, cfg.shortcodes), 0, []
    lower = text.lower()
    here = None if FOLDED.intersection(text) else set(WORD_RUN.findall(lower))
    for at, target in enumerate(pool.targets):
        counts, matches, shared = pool.counts[target.id], 0, None
        first: dict[str, Probe] = {}
        for phrase in pool.phrases(at, own):
            probe = _probe(phrase)
            first.setdefault(probe.lower, probe)
        for probe in list(first.values())[: cfg.phrases_per_target]:
            # Most phrases are nowhere in the text: a run of ASCII letters must stand there as it is. Only a phrase with a character of many spellings needs its pattern to know.
            if here is not None and not probe.runs <= here:
                continue
            keyword = probe.phrase
            if not probe.spelt and probe.lower not in lower or not keyword_pattern(keyword).search(text):
                continue
            if " " not in keyword:
                if shared is None:
                    shared = {t for t in own.intersection(counts) if pool.df[t] + 1 <= pool.common}
                if not shared - {probe.lower}:
                    continue
            if probes >= cfg.probes_per_source:
                return found
            probes += 1
            context = keyword_context(source.content, keyword, cfg.shortcodes)
            if context is None:
                continue
            found.append({"target": target, "keyword": keyword, "context": context, "heuristic": heuristic(keyword, source, target)})
            matches += 1
            if matches >= cfg.matches_per_target:
                break
    return found


def scored(source: Post, found: list[dict], cfg: EngineConfig) -> list[dict]:
    """Relevance 0 to 100: cosine over the best one, and the heuristic."""
    cosines = _cosines(source.counted(None), [f["target"].counted(cfg.text_chars) for f in found]) if found else []
    best = max([0.0, *cosines])
    for f, c in zip(found, cosines, strict=True):
        f["relevance"] = math.floor(1000 * (0.7 * (c / best if best else 0.0) + 0.3 * min(1.0, f["heuristic"] / 5)) + 0.5) / 10
    return found


def choose(found: list[dict], limit: int) -> list[dict]:
    """Best first, one for each target and each keyword."""
    targets, keywords, kept = set(), set(), []
    for f in sorted(found, key=lambda x: -x["relevance"]):
        if f["target"].id in targets or f["keyword"].lower() in keywords or len(kept) >= limit:
            continue
        targets.add(f["target"].id)
        keywords.add(f["keyword"].lower())
        kept.append(f)
    return kept


def for_source(source: Post, targets: list[Post], cfg: EngineConfig, pool: Pool | None = None) -> list[dict]:
    return choose(scored(source, candidates(source, targets, cfg, pool), cfg), cfg.suggestions_per_source)


def passed_over(targets: DataFrame, excluded: DataFrame, wanted: int) -> int:
    """The most targets that one source has to pass over before it has met ``wanted`` others, newest first.

    Exclusions of older targets count for nothing, however many a source has.
    """
    order = ["age_days", F.desc("id")]
    newest = targets.select("id", "age_days").orderBy(*order).limit(wanted + MAX_HELD + 1)
    ranked = newest.select(F.col("id").alias("target"), F.row_number().over(Window.orderBy(*order)).alias("rank"))
    hits = excluded.select("source", "target").distinct().join(F.broadcast(ranked), "target")  # bounded by MAX_HELD ids
    turn = F.row_number().over(Window.partitionBy("source").orderBy("rank"))
    counted = hits.withColumn("turn", turn).where(F.col("rank") - F.col("turn") < wanted).groupBy("source").count()
    return counted.agg(F.max("count")).first()[0] or 0


def generate(sources: DataFrame, targets: DataFrame, excluded: DataFrame, cfg: EngineConfig) -> DataFrame:
    """sources and targets: id, title, content, age_days, categories; excluded: source, target (linked or dismissed)."""
    wanted = cfg.targets_per_source + 1  # one may be the source itself
    most = passed_over(targets, excluded, wanted)
    if most > MAX_HELD:
        raise ValueError("one source excludes more of the newest targets than a task may hold")
    newest = targets.orderBy("age_days", F.desc("id")).limit(wanted + most)
    cut = newest.withColumn("content", F.substring("content", 1, cfg.text_chars))
    held = [Post(r["id"], r["title"] or "", r["content"] or "", float(r["age_days"]), frozenset(r["categories"] or ())) for r in cut.collect()]  # bounded by MAX_HELD texts
    known = sources.sparkSession.createDataFrame([(p.id,) for p in held], "target long")
    barred = excluded.join(F.broadcast(known), "target", "left_semi").groupBy("source").agg(F.collect_set("target").alias("barred"))
    rows = sources.join(barred, sources["id"] == barred["source"], "left").select("id", "title", "content", "age_days", "categories", "barred")
    # A source takes milliseconds, and a file may be one task's work: sources are dealt to all cores, in a number that adaptive execution leaves alone.
    rows = rows.repartition(4 * sources.sparkSession.sparkContext.defaultParallelism, F.xxhash64("id", "title"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pools: dict[tuple, Pool] = {}
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                source = Post(row.id, row.title or "", row.content or "", float(row.age_days), frozenset(row.categories if row.categories is not None else ()))
                barred = {row.id, *(row.barred if row.barred is not None else ())}
                open_targets = [p for p in held if p.id not in barred][: cfg.targets_per_source]
                key = tuple(p.id for p in open_targets)
                pool = pools.pop(key, None) or Pool(open_targets, cfg)
                pools[key] = pool  # the last one used comes last
                if len(pools) > MAX_POOLS:
                    del pools[next(iter(pools))]
                out += [(source.id, f["target"].id, f["keyword"], f["context"], f["relevance"]) for f in for_source(source, open_targets, cfg, pool)]
            yield pd.DataFrame(out, columns=["source_post_id", "target_post_id", "keyword", "context", "relevance_score"])

    return rows.mapInPandas(run, "source_post_id long, target_post_id long, keyword string, context string, relevance_score double")


def store(stored: DataFrame, generated: DataFrame, processed: DataFrame) -> DataFrame:
    """The table of suggestions after a pass over the sources of processed (source_post_id).

    Their pending suggestions go, applied and dismissed ones stay, and new ones come in as pending unless the pair was dismissed or applied.
    Ids of new ones are hashes of source, target and keyword, which need no counter.
    """
    columns = ["id", "source_post_id", "target_post_id", "keyword", "relevance_score", "status"]
    kept = stored.join(processed.select("source_post_id", F.lit(True).alias("in_pass")).distinct(), "source_post_id", "left").where("in_pass is null or status != 'pending'")
    settled = stored.where("status in ('dismissed', 'applied')").select("source_post_id", "target_post_id").distinct()
    fresh = generated.join(settled, ["source_post_id", "target_post_id"], "left_anti").join(processed.select("source_post_id").distinct(), "source_post_id", "left_semi")
    new_id = F.xxhash64("source_post_id", "target_post_id", "keyword").bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(1 << 62))
    return kept.select(columns).unionByName(fresh.select(new_id.alias("id"), "source_post_id", "target_post_id", "keyword", "relevance_score", F.lit("pending").alias("status")))
