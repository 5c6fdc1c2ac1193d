"""The opN queries of this folder and their DuckDB equivalents, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from linkscope.llm import bpe, chat, extraction, language, neighbours, oracle, packing, quality, sharding, simhash, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_rules": quality.query,
        "op2_chat": chat.query,
        "op3_bpe": bpe.query,
        "op4_warc": warc.query,
        "op5_simhash": simhash.query,
        "op6_sharding": sharding.query,
        "op7_packing": packing.query,
        "op8_language_id": language.query,
        "op9_html_extraction": extraction.query,
        "op10_vantage_neighbours": neighbours.query,
    }


def oracle_sql() -> dict[str, str]:
    return oracle.oracle_sql()
