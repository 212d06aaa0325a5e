"""Queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm.decontaminate import OP10_SQL, op10_decontaminate
from ledgerloom.llm.html_text import op5_html_text
from ledgerloom.llm.mixing import OP6_SQL, op6_mix_sources
from ledgerloom.llm.near_text import op3_near_dedup
from ledgerloom.llm.near_vectors import OP4_SQL, op4_near_vectors
from ledgerloom.llm.pii import op7_pii_surrogates
from ledgerloom.llm.sharding import op8_shard
from ledgerloom.llm.substring import OP1_SQL, op1_substring_dedup
from ledgerloom.llm.toxicity import op2_toxicity
from ledgerloom.llm.warc import OP9_SQL, op9_warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_substring_dedup": op1_substring_dedup,
        "op2_toxicity": op2_toxicity,
        "op3_near_dedup": op3_near_dedup,
        "op4_near_vectors": op4_near_vectors,
        "op5_html_text": op5_html_text,
        "op6_mix_sources": op6_mix_sources,
        "op7_pii_surrogates": op7_pii_surrogates,
        "op8_shard": op8_shard,
        "op9_warc": op9_warc,
        "op10_decontaminate": op10_decontaminate,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_substring_dedup": OP1_SQL,
        "op4_near_vectors": OP4_SQL,
        "op6_mix_sources": OP6_SQL,
        "op9_warc": OP9_SQL,
        "op10_decontaminate": OP10_SQL,
    }
