"""The corpus pipeline: quality, near duplicates, decontamination, mixing, token ids.

Each stage gets the rows that the one before it wrote. STAGES lists them; run() applies them all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from meshframe.llm import common, stages

STAGES = [
    ("quality", stages.good_documents),
    ("near_duplicates", stages.distinct_documents),
    ("decontamination", stages.uncontaminated_documents),
    ("mixing", stages.mixed_documents),
    ("token_ids", stages.token_files),
]

#: No SQL expresses the stages; tests hold them against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
