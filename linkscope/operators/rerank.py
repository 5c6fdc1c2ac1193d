"""Replies of an outside scorer, which may be missing, wrong or partial; the engine's own score then stands."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkscope.config import EngineConfig


#: What the scorer is asked for; its reply is read by ``scores``.
ASKED = 'Give each numbered target a whole number from 0 to 100: the worth of a link to it from the source, for a reader. Reply with a JSON object such as {"1": 70} and nothing else.'


def clip(text: Column, chars: int) -> Column:
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(flat) > chars, F.concat(F.substring(flat, 1, chars), F.lit("…"))).otherwise(flat)


def prompts(sources: DataFrame, candidates: DataFrame, cfg: EngineConfig) -> DataFrame:
    """sources: source, title, text; candidates: source, number, title, excerpt, keyword. (source, prompt, n) of each source with candidates.

    Only the front runners are asked for, so a prompt is bounded; nulls are empty texts.
    """
    part = lambda name, chars: clip(F.coalesce(name, F.lit("")), chars)
    title, excerpt, phrase = (part(c, n) for c, n in zip(("title", "excerpt", "keyword"), cfg.prompt_candidate, strict=True))
    line = F.concat("number", F.lit(") "), title, F.lit(" / "), excerpt, F.lit(" / anchor: "), phrase)
    listed = candidates.where(F.col("number").between(1, cfg.front_runners)).select("source", F.struct("number", line.alias("line")).alias("row"))
    asked = listed.groupBy("source").agg(F.array_join(F.sort_array(F.collect_list("row")).getField("line"), "\n").alias("lines"), F.count("*").cast("int").alias("n"))
    head = [F.lit(ASKED + "\nSource: "), part("title", cfg.prompt_source[0]), F.lit("\n"), part("text", cfg.prompt_source[1]), F.lit("\nTargets:\n"), "lines"]
    return sources.join(asked, "source").select("source", F.concat(*head).alias("prompt"), "n")


def scores(replies: DataFrame) -> DataFrame:
    """replies: source, reply, n (candidates asked for). (source, number, score) of replies with at least half of the scores."""
    obj = F.regexp_extract("reply", r"(?s)\{[^{}]*\}", 0)
    parsed = replies.select("source", "n", F.from_json(obj, "map<string,string>").alias("map"))
    one = parsed.select("source", "n", F.explode("map").alias("number", "value"))
    score = F.expr("if(try_cast(value as double) is null, null, cast(least(100D, greatest(0D, try_cast(value as double))) as int))")
    good = one.select("source", "n", F.expr("try_cast(number as int)").alias("number"), score.alias("score")).where("number between 1 and n and score is not null")
    enough = F.count("*").over(Window.partitionBy("source")) >= F.ceil(F.col("n") / 2)
    return good.select("*", enough.alias("enough")).where("enough").select("source", "number", "score")


def override(candidates: DataFrame, scored: DataFrame) -> DataFrame:
    """candidates: source, number, relevance. A score replaces the relevance; rows without one keep theirs."""
    met = candidates.join(scored, ["source", "number"], "left")
    return met.select("source", "number", F.coalesce(F.col("score").cast("double"), "relevance").alias("relevance"))


def ask(prompts: DataFrame, scorer: Callable[[str], str | None]) -> DataFrame:
    """prompts: source, prompt, n. A fault of the scorer is an empty reply."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def safely(prompt: str) -> str:
            try:
                return scorer(prompt) or ""
            except Exception:  # noqa: BLE001 - an outside service may fail in any way
                return ""

        for pdf in batches:
            yield pd.DataFrame({"source": pdf["source"], "reply": pdf["prompt"].map(safely), "n": pdf["n"]})

    return prompts.select("source", "prompt", "n").mapInPandas(run, "source long, reply string, n int")
