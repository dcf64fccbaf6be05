"""The queries of the corpus operators: thin views of what the operators return. Those whose
operators write tables on the way write their rows and delete these."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, brown_lm, common, decontaminate, html_extract, jaccard, mixing, quality, secret_scan, suffix_dedup, token_output


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.resample(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = common.table(spark, sf_dir, "embeddings")
    return common.settled(lambda: ann.nearest(vectors, vectors.where("vec_id % 50 = 0")), "op2")


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(common.table(spark, sf_dir, "documents"))
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    n = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", n("assign"), n("access"), n("hex"), F.sha2(text("base"), 256).alias("base_sha256"), text("spans").alias("spans"),
        (F.size("spans") - F.size("base")).cast("long").alias("n_random"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return common.settled(lambda: jaccard.join(common.table(spark, sf_dir, "documents")), "op4")


def op5_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return common.settled(lambda: brown_lm.score(common.table(spark, sf_dir, "documents")), "op5")


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_extract.main_text(common.table(spark, sf_dir, "pages"))
    return found.withColumn("n_chars", F.char_length("text").cast("long"))


def op7_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_output.encode_and_read_back(common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return common.settled(lambda: decontaminate.hits(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark")), "op8")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return common.settled(lambda: mixing.mix(common.table(spark, sf_dir, "documents")), "op9")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = common.settled(lambda: suffix_dedup.dedup(common.table(spark, sf_dir, "documents")), "op10")
    return found.select("doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), "kept_sha256")


def queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {}
