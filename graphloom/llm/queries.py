"""The queries of this subpackage, each over its whole table, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import chat, clustering, exact_dedup, minhash, mixing, oracles, packing, prefix_trie, quality, repeats, secrets, token_files, url_filter, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc_revisits": warc.op1,
    "op2_chat_format": chat.op2,
    "op3_secret_ownership": secrets.op3,
    "op4_circulant_minhash": minhash.op4,
    "op5_token_shards": token_files.op5,
    "op6_budget_mix": mixing.op6,
    "op7_line_quality": quality.op7,
    "op8_suffix_dedup": repeats.op8,
    "op9_slack_packing": packing.op9,
    "op10_exact_dedup": exact_dedup.op10,
    "op11_centroid_clusters": clustering.op11,
    "op12_prefix_trie": prefix_trie.op12,
    "op13_url_filter": url_filter.op13,
}

ORACLE_SQL: dict[str, str] = {
    "op1_warc_revisits": warc.OP1_SQL,
    "op2_chat_format": oracles.OP2_SQL,
    "op3_secret_ownership": oracles.OP3_SQL,
    "op4_circulant_minhash": oracles.OP4_SQL,
    "op7_line_quality": oracles.OP7_SQL,
    "op8_suffix_dedup": oracles.OP8_SQL,
    "op10_exact_dedup": exact_dedup.OP10_SQL,
    "op11_centroid_clusters": clustering.OP11_SQL,
    "op12_prefix_trie": prefix_trie.OP12_SQL,
    "op13_url_filter": url_filter.OP13_SQL,
}
