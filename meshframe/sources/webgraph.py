"""Web graph dumps: a header of three unsigned 32-bit numbers (pages, most out-links, pages in a
file) and files of fixed-width records (number of out-links, then links from 1 on, 0 as padding)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arithmetic import mixed
from ..session import ship
from .files import put

PAGE = "page long, outlinks array<long>"


def read_metadata(spark: SparkSession, path: str) -> dict[str, int]:
    """The header; it is 12 bytes whatever the graph."""
    raw = spark.read.format("binaryFile").load(path).select("content").first()["content"]
    return dict(zip(("pages", "max_outlinks", "pages_per_file"), np.frombuffer(bytes(raw), "<u4", 3).tolist()))


def read_pages(spark: SparkSession, paths: str | list[str], metadata: dict[str, int]) -> DataFrame:
    """(page, outlinks) from files whose names end in their number, from 0. A link beyond the last
    page is an error."""
    ship(spark)
    width, per_file, last = metadata["max_outlinks"] + 1, metadata["pages_per_file"], metadata["pages"]

    def decode(batches):
        for pdf in batches:
            for path, raw in zip(pdf["path"], pdf["content"]):
                number = int("".join(c for c in path.rsplit("/", 1)[-1].split(".")[0] if c.isdigit()))
                rows = np.frombuffer(raw, "<u4").reshape(-1, width)
                if (rows[:, 1:] > last).any() or (rows[:, 0] >= width).any():
                    raise ValueError(f"{path}: a link beyond page {last}, or too many links")
                yield pd.DataFrame({"page": number * per_file + 1 + np.arange(len(rows)), "outlinks": [r[1 : 1 + r[0]].astype(np.int64) for r in rows]})

    return spark.read.format("binaryFile").load(paths).select("path", "content").mapInPandas(decode, PAGE)


def encode_pages(outlinks: list[list[int]], max_outlinks: int) -> bytes:
    """The records of some pages in order, as a file holds them."""
    out = np.zeros((len(outlinks), max_outlinks + 1), "<u4")
    for i, x in enumerate(outlinks):
        out[i, 0] = len(x)
        out[i, 1 : 1 + len(x)] = x
    return out.tobytes()


def write_dump(pages: DataFrame, folder: str, last: int, per_file: int) -> None:
    """Write (page, outlinks) as a header, folder/metadata, and files of per_file records in
    folder/pages; pages without a row have no links. The widest page sets the records' width."""
    most = pages.agg(F.max(F.size("outlinks"))).first()[0] or 0
    put(f"{folder}/metadata", np.array([last, most, per_file], "<u4").tobytes())

    def run(pdf):
        number = int(pdf["file"].iloc[0])
        rows = [[] for _ in range(min(per_file, last - number * per_file))]
        for page, links in zip(pdf["page"], pdf["outlinks"]):
            if links is not None:
                rows[int(page) - 1 - number * per_file] = list(links)
        put(f"{folder}/pages/{number}.bin", encode_pages(rows, most))
        return pd.DataFrame({"file": [number]})

    ship(pages.sparkSession)
    every = pages.sparkSession.range(1, last + 1).select(F.col("id").alias("page")).join(pages, "page", "left")
    every.withColumn("file", F.expr(f"(page - 1) div {per_file}")).groupBy("file").applyInPandas(run, "file long").count()


def edges(pages: DataFrame) -> DataFrame:
    return pages.select(F.col("page").alias("src"), F.explode("outlinks").alias("dst"))


def generate(spark: SparkSession, pages: int, max_outlinks: int = 20, seed: int = 0) -> DataFrame:
    """(page, outlinks): 0 to max_outlinks links, 90 % of them within 0.1 % of all pages around
    their page, 9 % within 1 %, and the rest anywhere. The seed decides all."""
    u = lambda *salt: mixed(seed, F.col("page"), *salt) / 4294967296.0
    rows = spark.range(1, pages + 1).select(F.col("id").alias("page")).withColumn("n", F.floor(u(0) * (max_outlinks + 1)).cast("int"))

    def link(k):
        kind, at = u(1, k), u(2, k)
        reach = F.when(kind < 0.9, max(1, pages // 1000)).when(kind < 0.99, max(1, pages // 100)).otherwise(pages)
        return (F.pmod(F.col("page") - 1 + F.floor((at * 2 - 1) * reach), F.lit(pages)) + 1).cast("long")

    return rows.select("page", F.when(F.col("n") > 0, F.transform(F.sequence(F.lit(1), F.col("n")), link)).otherwise(F.array().cast("array<long>")).alias("outlinks"))
