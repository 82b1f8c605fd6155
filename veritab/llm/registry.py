"""The queries of this folder, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from veritab.llm import op2_decontamination as op2, op8_signature_join as op8, op10_token_counts as op10, op11_warc as op11, op13_hard_negatives as op13
from veritab.llm.op12_alignment import op12_alignment
from veritab.llm.op1_token_files import op1_token_files
from veritab.llm.op3_quality import op3_quality
from veritab.llm.op4_permutation_index import op4_permutation_index
from veritab.llm.op5_toxicity import op5_toxicity
from veritab.llm.op6_packing import op6_packing
from veritab.llm.op7_suffix_dedup import op7_suffix_dedup
from veritab.llm.op9_html import op9_html

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_files": op1_token_files,
    "op2_decontamination": op2.op2_decontamination,
    "op3_quality": op3_quality,
    "op4_permutation_index": op4_permutation_index,
    "op5_toxicity": op5_toxicity,
    "op6_packing": op6_packing,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_signature_join": op8.op8_signature_join,
    "op9_html": op9_html,
    "op10_token_counts": op10.op10_token_counts,
    "op11_warc": op11.op11_warc,
    "op12_alignment": op12_alignment,
    "op13_hard_negatives": op13.op13_hard_negatives,
}
ORACLES: dict[str, str] = {"op2_decontamination": op2.ORACLE, "op8_signature_join": op8.ORACLE, "op10_token_counts": op10.ORACLE,
                          "op11_warc": op11.ORACLE, "op13_hard_negatives": op13.ORACLE}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
