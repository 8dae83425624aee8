"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lantern.llm import fingerprints, html_extract, importance, mixing, near_dedup, nearest, prefix_trie, quality_rules, sentencepiece_codec, token_counts, toxicity, url_filter, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_html_extract": html_extract.query,
        "op2_near_dedup": near_dedup.query,
        "op3_quality_rules": quality_rules.query,
        "op4_url_filter": url_filter.query,
        "op5_token_counts": token_counts.query,
        "op6_sentencepiece": sentencepiece_codec.query,
        "op7_warc": warc.query,
        "op8_mixing": mixing.query,
        "op9_fingerprints": fingerprints.query,
        "op10_toxicity": toxicity.query,
        "op11_prefix_trie": prefix_trie.query,
        "op12_importance": importance.query,
        "op13_nearest": nearest.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_near_dedup": near_dedup.oracle(), "op4_url_filter": url_filter.oracle(), "op7_warc": warc.oracle(), "op11_prefix_trie": prefix_trie.oracle()}
