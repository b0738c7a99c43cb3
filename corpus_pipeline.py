"""The corpus pipeline: quality rules, line dedup, near dedup, decontamination, BPE.

Each stage takes (spark, docs, sf_dir), works on every row that its predecessor kept and returns a DataFrame;
all but the last return the columns of docs. run() writes each stage's result to the shared folder and
reads it again, so a lost executor costs one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from factorium.llm import bpe, decontaminate, line_dedup, near_dedup, quality_rules
from factorium.llm.common import materialize, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that fail the base rules, or whose score is under the threshold of this stage's own input, go."""
    return quality_rules.keep(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go from the texts; n_chars follows. Every row stays, an emptied text too."""
    return line_dedup.drop_lines(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class stays: that of the smallest doc_id."""
    return near_dedup.keep_one(docs)


def contamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated rows go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded text."""
    return bpe.encode(docs)


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("near_dedup", near), ("decontamination", contamination), ("bpe", encoding)]

#: Signatures, the ratio's threshold and BPE have no SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
