"""The registered queries of this subpackage and, where SQL can express them, their DuckDB text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from refrain.llm import oracle
from refrain.llm.embedding_dedup import op1_embedding_near_dedup
from refrain.llm.html_text import op7_html_main_text
from refrain.llm.line_dedup import op2_line_dedup
from refrain.llm.mixing import op5_pareto_mix
from refrain.llm.near_dedup import op6_minhash_near_dedup
from refrain.llm.packing import op4_best_fit_packing
from refrain.llm.pii import op8_pii_spans
from refrain.llm.quality import op3_quality_rules
from refrain.llm.secrets import op10_secret_scan
from refrain.llm.warc import op9_warc_round_trip

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_embedding_near_dedup": op1_embedding_near_dedup,
        "op2_line_dedup": op2_line_dedup,
        "op3_quality_rules": op3_quality_rules,
        "op4_best_fit_packing": op4_best_fit_packing,
        "op5_pareto_mix": op5_pareto_mix,
        "op6_minhash_near_dedup": op6_minhash_near_dedup,
        "op7_html_main_text": op7_html_main_text,
        "op8_pii_spans": op8_pii_spans,
        "op9_warc_round_trip": op9_warc_round_trip,
        "op10_secret_scan": op10_secret_scan,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_embedding_near_dedup": oracle.OP1,
        "op2_line_dedup": oracle.OP2,
        "op5_pareto_mix": oracle.OP5,
        "op6_minhash_near_dedup": oracle.OP6,
        "op8_pii_spans": oracle.OP8,
        "op9_warc_round_trip": oracle.OP9,
    }
