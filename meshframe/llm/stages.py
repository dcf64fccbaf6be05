"""Operators as stages of a corpus pipeline: (spark, docs, sf_dir) to the rows that go on.

Each stage's rows are to be written before the next stage begins on them: a stage deletes what
earlier ones left, but for tables that its own documents are still read from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, decontaminate, jaccard, mixing, quality, token_output


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What importance resampling keeps."""
    return quality.kept_documents(docs, common.table(spark, sf_dir, "labels"))


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates the row with the least doc_id, a null one last; of
    rows with the same doc_id one. Documents without words stay."""
    common.sweep(docs)
    rows, key = common.keyed(docs, "near-documents")
    own = rows.select("doc_id", F.col(key).alias("key"))

    def best() -> DataFrame:
        found = jaccard.join(rows.select(F.col(key).alias("doc_id"), "text")).select(F.col("doc_id").alias("key"), "component_id")
        return (
            found.join(own, "key")
            .groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("best"))
            .select(F.col("best.key").alias(key))
        )

    # As many rows as documents: never to be broadcast, however small at the time.
    kept = common.settled(best, "distinct-rows").hint("merge")
    return rows.join(kept, key, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])


def uncontaminated_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    common.sweep(docs)
    return decontaminate.clean(docs, common.table(spark, sf_dir, "benchmark"))


def mixed_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    common.sweep(docs)
    return mixing.mixed_documents(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids written and read back."""
    import public_tokenizers

    common.sweep(docs)
    return token_output.encode_and_read_back(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
