"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vellum.llm import bpe, decontaminate, langid, linededup, lm, quality, secrets, simhash, substring, suffixarray


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = [
        simhash.op1_simhash,
        langid.op2_language_id,
        quality.op3_quality_rules,
        bpe.op4_bpe,
        lm.op5_lm_scoring,
        decontaminate.op6_decontaminate,
        secrets.op7_secret_scan,
        linededup.op8_line_dedup,
        substring.op9_substring_dedup,
        suffixarray.op10_suffix_array_dedup,
    ]
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict[str, str]:
    return {"op3_quality_rules": quality.OP3_SQL, "op8_line_dedup": linededup.OP8_SQL, "op9_substring_dedup": substring.OP9_SQL, "op10_suffix_array_dedup": suffixarray.OP10_SQL}
