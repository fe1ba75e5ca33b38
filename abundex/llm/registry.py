"""The operators' queries, and SQL for those that SQL can express."""

from __future__ import annotations

from abundex.llm import chat, decontam, langid, licenses, linededup, mixing, neardup, outliers, rules, wordlm


def queries() -> dict:
    found = (
        licenses.op1_license_scan,
        outliers.op2_quality_rules,
        decontam.op3_benchmark_decontamination,
        chat.op4_chat_formatting,
        langid.op5_language_id,
        wordlm.op6_lm_scoring,
        mixing.op7_source_mixing,
        rules.op8_quality_classifier,
        neardup.op9_minhash_near_dedup,
        linededup.op10_line_dedup,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict:
    return {"op1_license_scan": licenses.oracle(), "op3_benchmark_decontamination": decontam.ORACLE, "op4_chat_formatting": chat.ORACLE, "op10_line_dedup": linededup.ORACLE}
