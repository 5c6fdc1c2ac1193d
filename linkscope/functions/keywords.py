"""Anchor phrases from titles and texts, and the patterns that find them."""

from __future__ import annotations

import html
import math
import re
from collections.abc import Callable
from functools import lru_cache

import regex

from linkscope.config import TEXT_STOP_WORDS, TITLE_STOP_WORDS

EDGE = regex.compile(r"^([^\p{L}\p{N}]*)(.*?)([^\p{L}\p{N}]*)$", regex.S)
WORD = r"\p{L}\p{N}\p{M}_"
APOSTROPHES = "'’‘"
#: Spellings of an ampersand and an apostrophe in HTML.
AMPERSANDS = ("&amp;", "&#038;", "&#38;", "&#x26;", "&")
APOSTROPHE_SPELLINGS = ("&#039;", "&#39;", "&#x27;", "&apos;", "&#8217;", "&#x2019;", "&rsquo;", "&#8216;", "&#x2018;", "&lsquo;", *APOSTROPHES)
_TITLE, _TEXT = frozenset(TITLE_STOP_WORDS), frozenset(TEXT_STOP_WORDS)


def trim_trailing_punctuation(title: str) -> str:
    return regex.sub(r"[\s?!.,;:…]+$", "", title)


def clean_title(title: str) -> str:
    return trim_trailing_punctuation(" ".join(html.unescape(title).split()))


def cap(keyword: str, chars: int = 255) -> str:
    if len(keyword) <= chars:
        return keyword
    head = keyword[:chars]
    return (head[: head.rfind(" ")] if head.rfind(" ") > 0 else head).rstrip()


def runs(title: str, stays: Callable[[str], bool]) -> list[list[str]]:
    """Cores of adjacent words. A word that does not stay ends a run, as does punctuation before or after a word."""
    found: list[list[str]] = [[]]
    for word in title.split(" "):
        before, core, after = EDGE.match(word).groups()
        if not core or not stays(core) or before:
            found.append([])
        if core and stays(core):
            found[-1].append(core)
            if after:
                found.append([])
    return [r for r in found if r]


def _meaningful(core: str) -> bool:
    return len(core) > 2 and core.lower() not in _TITLE


def title_keywords(title: str | None, min_words: int = 3) -> list[str]:
    """The whole title if it has enough words, and the first run of enough meaningful words."""
    text = clean_title(title or "")
    whole = [cap(text)] if sum(bool(regex.search(r"[\p{L}\p{N}]", w)) for w in text.split(" ")) >= min_words else []
    long = (r for r in runs(text, _meaningful) if len(r) >= max(1, min_words))
    short = [cap(" ".join(r[: max(3, min_words)])) for r in [next(long, None)] if r]
    return [k for k in dict.fromkeys(whole + short) if k]


def tokenise(text: str) -> list[str]:
    return [w for w in regex.sub(r"[^\p{L}\p{N}]+", " ", text.lower()).split() if len(w) > 2 and w not in _TEXT]


def top_terms(counts: dict[str, int], df: dict[str, int], n_docs: int, k: int) -> dict[str, float]:
    total = sum(counts.values())
    weight = {t: c / total * (math.log((1 + n_docs) / (1 + df.get(t, 0))) + 1) for t, c in counts.items()}
    return dict(sorted(weight.items(), key=lambda x: (-x[1], x[0].encode()))[:k])


def _edge(w: str) -> bool:
    return len(w) >= 3 and w.lower() not in _TEXT


def title_grams(title: str) -> tuple[list[str], list[str]]:
    """Three- and two-word phrases of a title, and the single words that may be one."""
    found: dict[int, list[str]] = {3: [], 2: [], 1: []}
    for size in found:
        for run in runs(clean_title(title), bool):
            grams = (run[i : i + size] for i in range(len(run) - size + 1))
            found[size] += [" ".join(g) for g in grams if _edge(g[0]) and _edge(g[-1])]
    return found[3] + found[2], found[1]


def topic_phrases(title: str, counts: dict[str, int], df: dict[str, int], n_docs: int, k: int = 8, min_single: int = 4) -> list[str]:
    """Three-, two- and one-word phrases of the title, then terms that the text repeats; single words must be distinctive."""
    top, common = top_terms(counts, df, n_docs, k), max(1, math.ceil(n_docs / 2))
    distinct = lambda w: len(w) >= min_single and w in top and df.get(w, 0) <= common
    longer, singles = title_grams(title)
    found = longer + [w for w in singles if distinct(w.lower())]
    found += [t for t in top if distinct(t) and counts[t] >= 2]
    return [c for c in map(cap, found) if c]


def keyword_body(keyword: str) -> str:
    def spelt(char: str) -> str:
        if char == "&":
            return "(?:" + "|".join(map(re.escape, AMPERSANDS)) + ")"
        if char in APOSTROPHES:
            return "(?:" + "|".join(map(re.escape, APOSTROPHE_SPELLINGS)) + ")"
        return re.escape(char)

    return "".join(map(spelt, keyword))


@lru_cache(maxsize=1 << 14)
def keyword_pattern(keyword: str) -> regex.Pattern:
    """Whole words, any case; a guard stands only beside a word character."""
    word = regex.compile(f"[{WORD}]")
    left = f"(?<![{WORD}&])" if keyword and word.match(keyword[0]) else ""
    right = f"(?![{WORD}])" if keyword and word.match(keyword[-1]) else ""
    return regex.compile(left + keyword_body(keyword) + right, regex.I)
