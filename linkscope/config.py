"""Settings that change results."""

from __future__ import annotations

from dataclasses import dataclass

#: Words that start or end no phrase of a title.
TITLE_STOP_WORDS = (
    "the a an and or but in on at to for of with by is are was were be been being have has had do does did will would could should may might must "
    "shall can this that these those i you he she it we they what which who when where why how all each every both few more most other some such no "
    "nor not only own same so than too very just also"
).split()
#: Words that no text vector holds; the title's and these.
TEXT_STOP_WORDS = [*TITLE_STOP_WORDS, *"your our their its from as if about into over after before up down out off".split()]


@dataclass(frozen=True)
class EngineConfig:
    """An empty post_types puts nothing in scope. Dates are compared with as_of, never with the clock."""

    post_types: tuple[str, ...] = ("post", "page")
    excluded_categories: tuple[int, ...] = (3, 4)
    min_words: int = 3
    site_url: str = "https://example.test"
    as_of: str = "2001-08-15 00:00:00"
    max_outbound: int = 2
    targets_per_source: int = 100
    probes_per_source: int = 40
    phrases_per_target: int = 12
    matches_per_target: int = 3
    suggestions_per_source: int = 10
    front_runners: int = 12
    top_terms: int = 8
    min_single_word: int = 4
    keyword_chars: int = 255
    url_chars: int = 500
    anchor_chars: int = 255
    context_chars: int = 500
    text_chars: int = 4000
    auto_scan: bool = True  # whether a saved post is scanned at once
    #: Characters of a source's title and text, and of a candidate's title, excerpt and phrase, that the scorer reads.
    prompt_source: tuple[int, int] = (150, 1500)
    prompt_candidate: tuple[int, int, int] = (120, 240, 80)
    type_labels: tuple[tuple[str, str], ...] = (("post", "Post"), ("page", "Page"), ("attachment", "Media"))
    shortcodes: tuple[str, ...] = ()
