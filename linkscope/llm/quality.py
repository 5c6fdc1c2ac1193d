"""Operator 1, quality rules [native]: line-first cleaning with DataFrame functions only.

Every line with a word is judged by punctuation, navigation and boilerplate rules. Failing lines go; a
document that loses more than ``max_lost`` of its visible characters is rejected, as is one that fails the
base rules (under 50 words, or over half of its words in repeated three-word windows).

Everything is computed inside the row, so there is no shuffle and no key to skew. Windows are compared by
64-bit hash within one text.

Defined results: a null text has no words, fails the base rules and has the clean text ''; an empty text
likewise; repeated rows are judged one by one; empty tables give empty results; columns besides the id and the text
are ignored by ``judge`` and kept by ``clean``, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkscope.llm.common import ASCII_SPACE, free_name, quoted

SPACES = r"[\x20\t-\r]+"
SYMBOLS = "#*$%&|<>"
NAVIGATION = "|»›•·"
ENDINGS = (".", "!", "?", "…", '"', "'", "”", "’", "»", ")", ":", ";")
#: Phrases, in lower case, of lines that sites repeat.
BOILERPLATE = (
    "all rights reserved", "click here", "cookie policy", "enable javascript", "licensed under", "log in to", "lorem ipsum",
    "privacy policy", "read more", "released under", "share this", "sign up for", "subscribe to", "terms of service", "terms of use",
)
#: Up to so many repeated windows are looked up one after another; beyond, a sort finds them.
FEW_WINDOWS = 64


@dataclass(frozen=True)
class QualityRules:
    min_words: int = 50
    max_repeat_percent: int = 50
    min_line_words: int = 3
    min_unended_words: int = 6
    max_symbols_per_visible: float = 0.1
    max_exclaims_per_word: float = 1 / 3
    max_navigation_per_word: float = 0.25
    max_upper_share: float = 0.5
    max_boilerplate_words: int = 40
    max_lost: float = 0.5


def _count_of(text: Column, chars: str) -> Column:
    return F.length(F.regexp_replace(text, f"[^{chars}]+", ""))


def _words(text: Column) -> Column:
    """An empty text gives one empty word, which the callers leave out."""
    return F.split(F.trim(text, F.lit(ASCII_SPACE)), SPACES)


def line_stays(line: Column, rules: QualityRules) -> Column:
    """Whether a line passes every rule. line: struct of bare (trimmed, white space as one space), marks (its symbols, separators and capitals) and n_words."""
    bare, marks, n_words = line["bare"], line["marks"], line["n_words"]
    visible = F.length(bare) - n_words + 1
    fails = (
        (n_words < rules.min_line_words)
        | ((n_words < rules.min_unended_words) & ~F.substring(bare, -1, 1).isin(*ENDINGS))
        | (_count_of(marks, SYMBOLS) > rules.max_symbols_per_visible * visible)
        | (_count_of(marks, NAVIGATION) > rules.max_navigation_per_word * n_words)
        | (_count_of(marks, "!?") > rules.max_exclaims_per_word * n_words)
        | (_count_of(marks, r"\p{Lu}") > F.greatest(F.lit(8), rules.max_upper_share * visible))
        | ((n_words <= rules.max_boilerplate_words) & bare.rlike("(?i)" + "|".join(BOILERPLATE)))
    )
    return ~fails


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: QualityRules | None = None) -> DataFrame:
    """Per row: the id as doc_id, the base figures, the verdict, the lines lost and the clean text."""
    rules = rules or QualityRules()
    text = F.coalesce(quoted(text_col), F.lit(""))
    # Each select makes arrays that the next one refers to more than once, so that no lambda makes them anew.
    bare = F.transform(F.split(text, "\n"), lambda x: F.struct(x.alias("line"), F.trim(x, F.lit(ASCII_SPACE)).alias("bare")))
    every = "".join(dict.fromkeys(SYMBOLS + NAVIGATION + "!?")) + r"\p{Lu}"
    folded = F.transform(F.filter(bare, lambda x: x["bare"] != ""), lambda x: F.struct(x["line"].alias("line"), F.when(x["bare"].rlike(r"[\t-\r]|  "), F.regexp_replace(x["bare"], SPACES, " ")).otherwise(x["bare"]).alias("bare")))
    lines = F.transform(folded, lambda x: F.struct(x["line"].alias("line"), x["bare"].alias("bare"), F.regexp_replace(x["bare"], f"[^{every}]+", "").alias("marks"), (F.length(x["bare"]) - F.length(F.replace(x["bare"], F.lit(" "), F.lit(""))) + 1).alias("n_words")))
    split = docs.select(quoted(id_col).alias("doc_id"), text.alias("text"), _words(text).alias("words"), lines.alias("lines"))
    # The last two windows are shorter, and so equal to none.
    windows = F.transform("words", lambda w, i: F.xxhash64(w, F.get("words", i + 1), F.get("words", i + 2)))
    hashed = split.select("*", windows.alias("windows"), F.transform(F.filter("lines", lambda x: line_stays(x, rules)), lambda x: x["line"]).alias("stay"))
    ordered = hashed.select("*", F.sort_array("windows").alias("ordered"))
    after = F.slice("ordered", 2, F.greatest(F.size("ordered"), F.lit(1)))
    twice = ordered.select("*", F.array_distinct(F.filter(after, lambda x, i: x == F.get("ordered", i))).alias("twice"))
    by_sort = F.when(F.size("twice") > FEW_WINDOWS, F.sort_array(F.transform("windows", lambda x, i: F.struct(x.alias("h"), i.alias("i")))))
    pairs = twice.select("*", by_sort.alias("pairs"))
    few = F.filter(F.transform("windows", lambda x, i: F.when(F.array_contains("twice", x), i).otherwise(-1)), lambda i: i >= 0)
    many = F.transform(
        F.filter("pairs", lambda x, k: F.coalesce(x["h"] == F.get("pairs", k - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get("pairs", k + 1)["h"], F.lit(False))),
        lambda x: x["i"],
    )
    starts = F.when(F.size("twice") == 0, F.array().cast("array<int>")).when(F.size("pairs") > 0, many).otherwise(few)
    covered = F.size(F.array_distinct(F.flatten(F.transform(starts, lambda i: F.array(i, i + 1, i + 2)))))
    counted = pairs.select(
        "doc_id",
        F.when(F.get("words", F.lit(0)) == "", 0).otherwise(F.size("words")).cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        _count_of(F.col("text"), SYMBOLS).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct(F.col("lines.line")))).cast("long").alias("n_dup_lines"),
        covered.cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.size("stay").cast("long").alias("n_lines_kept"),
        F.array_join("stay", "\n").alias("clean_text"),
        F.monotonically_increasing_id().alias("mark"),
    )
    failed = (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words"))
    left = F.length(F.regexp_replace("clean_text", SPACES, "")).cast("double")
    judged = counted.select("*", failed.alias("base_failed"), F.when(F.col("word_chars") > 0, 1 - left / F.col("word_chars")).otherwise(1.0).alias("lost"))
    # A test of a number that is not deterministic: filters on the figures stop above it, and don't repeat the lambdas below inside each other.
    return judged.where("mark >= 0").select(*[c for c in judged.columns if c != "mark"], (~F.col("base_failed") & (F.col("lost") <= rules.max_lost)).alias("kept"))


def clean(docs: DataFrame, text_col: str = "text", length_col: str = "n_chars", rules: QualityRules | None = None) -> DataFrame:
    """The rows that are kept, with all their columns; the text is the clean text, and its length is set anew if length_col is there."""
    whole = free_name(docs, "row")
    packed = docs.select(F.struct(*[quoted(c) for c in docs.columns]).alias(whole), quoted(text_col).alias("text"))
    judged = judge(packed, whole, "text", rules).where("kept")
    row = F.col("doc_id")
    columns = [F.col("clean_text").alias(c) if c == text_col else F.length("clean_text").cast(dict(docs.dtypes)[c]).alias(c) if c == length_col else row.getField(c).alias(c) for c in docs.columns]
    return judged.select(*columns)


def query(spark, sf_dir: str) -> DataFrame:
    """op1: every document of the table."""
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_lines_kept"
    )
