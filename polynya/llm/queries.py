"""The registered queries of this folder and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from polynya.llm import (
    dialogue, fingerprints, html, jaccard, lines, lm, mixing, packing, periodic, quality, sharding, topk, toxicity,
)
from polynya.llm.base import table

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {
    "op1_pitman_yor": lambda s, d: lm.op1_pitman_yor(table(s, d, "documents")),
    "op2_ngram_jaccard": lambda s, d: jaccard.op2_ngram_jaccard(table(s, d, "documents")),
    "op3_exact_top_k": lambda s, d: topk.op3_exact_top_k(table(s, d, "embeddings")),
    "op4_order_minhash": lambda s, d: fingerprints.op4_order_minhash(table(s, d, "documents")),
    "op5_quality": lambda s, d: quality.op5_quality(table(s, d, "documents"), table(s, d, "labels")),
    "op6_toxicity": lambda s, d: toxicity.op6_toxicity(table(s, d, "documents"), table(s, d, "labels")),
    "op8_source_mixing": lambda s, d: mixing.op8_source_mixing(table(s, d, "documents")),
    "op7_html_rendering": lambda s, d: html.op7_html_rendering(table(s, d, "pages")),
    "op9_packing": lambda s, d: packing.op9_packing(table(s, d, "documents")),
    "op10_rendezvous_sharding": lambda s, d: sharding.op10_rendezvous_sharding(table(s, d, "documents")),
    "op11_periodic_runs": lambda s, d: periodic.op11_periodic_runs(table(s, d, "documents")),
    "op12_conversation_repair": lambda s, d: dialogue.op12_conversation_repair(table(s, d, "conversations")),
    "op13_line_dedup": lambda s, d: lines.op13_line_dedup(table(s, d, "documents")),
}

ORACLES: dict[str, str] = {
    "op2_ngram_jaccard": jaccard.OP2_SQL,
    "op3_exact_top_k": topk.OP3_SQL,
    "op8_source_mixing": mixing.OP8_SQL,
    "op11_periodic_runs": periodic.OP11_SQL,
    "op12_conversation_repair": dialogue.OP12_SQL,
    "op13_line_dedup": lines.OP13_SQL,
}
