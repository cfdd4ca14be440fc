"""The registered queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, exact_dedup, filter_audit, language, mixing, negatives, pages, quality, repeats, secret_scan, simhash, topk

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        quality.op1_quality,
        language.op2_language_id,
        mixing.op3_mixing,
        exact_dedup.op4_exact_dedup,
        topk.op5_top_k,
        bpe.op6_bpe,
        repeats.op7_repeats,
        simhash.op8_simhash,
        secret_scan.op9_secret_scan,
        chat.op10_chat_format,
        filter_audit.op11_filter_audit,
        pages.op12_main_text,
        negatives.op13_hard_negatives,
    )
}
ORACLES: dict[str, str] = {
    "op3_mixing": mixing.ORACLE,
    "op4_exact_dedup": exact_dedup.ORACLE,
    "op5_top_k": topk.ORACLE,
    "op10_chat_format": chat.ORACLE,
    "op11_filter_audit": filter_audit.ORACLE,
    "op13_hard_negatives": negatives.ORACLE,
}
