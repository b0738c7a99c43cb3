"""The queries of this subpackage and their SQL, for the entry module."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontaminate, language_id, line_dedup, near_dedup, quality_classifier, quality_rules, secrets, sharding, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_sharding": sharding.op1_sharding, "op4_line_dedup": line_dedup.op4_line_dedup, "op10_warc": warc.op10_warc, "op2_bpe": bpe.op2_bpe, "op3_secret_scans": secrets.op3_secret_scans, "op6_decontaminate": decontaminate.op6_decontaminate, "op7_quality_rules": quality_rules.op7_quality_rules, "op5_near_dedup": near_dedup.op5_near_dedup, "op8_language_id": language_id.op8_language_id, "op9_quality_classifier": quality_classifier.op9_quality_classifier}


def oracle_sql() -> dict[str, str]:
    return {"op1_sharding": sharding.oracle_sql(), "op4_line_dedup": line_dedup.ORACLE_SQL, "op10_warc": warc.ORACLE_SQL, "op6_decontaminate": decontaminate.ORACLE_SQL}
