"""Link graphs: degrees, inversion and PageRank over (src, dst) rows.

Ranks follow rank'[d] = sum over links s to d of damping * rank[s] / out-degree(s): duplicate links
count twice, pages without out-links lose their rank, nothing is normalised, and pages that no
link reaches get 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.durable import durable, iterate


def out_degree(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src").agg(F.count("*").alias("degree"))


def in_degree(edges: DataFrame) -> DataFrame:
    return edges.groupBy("dst").agg(F.count("*").alias("degree"))


def invert(edges: DataFrame) -> DataFrame:
    """(dst, src, n, degree): links by their target, equal ones as one row with their number, and
    the out-degree of the source."""
    return edges.groupBy("dst", "src").agg(F.count("*").alias("n")).join(out_degree(edges), "src")


def pages_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("page")).union(edges.select("dst")).distinct()


def _spread(weighted: DataFrame, pages: DataFrame, damping: float, rounds: int) -> DataFrame:
    """Rank steps over (src, dst, share). Links with equal ends are one row already, and a page
    with very many in-links is summed in every task before it meets itself."""

    def step(rank, _):
        sums = weighted.join(rank, weighted["src"] == rank["page"]).groupBy("dst").agg(F.sum(F.col("rank") * F.col("share") * damping).alias("rank"))
        return pages.join(sums, pages["page"] == sums["dst"], "left").select("page", F.coalesce("rank", F.lit(0.0)).alias("rank"))

    return iterate(step, pages.withColumn("rank", F.lit(1.0)), rounds)


def pagerank(edges: DataFrame, rounds: int = 2, damping: float = 0.85, pages: DataFrame | None = None) -> DataFrame:
    """(page, rank) by pushing ranks along out-links."""
    pages = durable(pages_of(edges) if pages is None else pages)
    n = edges.groupBy("src", "dst").agg(F.count("*").alias("n"))
    shares = n.join(out_degree(edges), "src").select("src", "dst", (F.col("n") / F.col("degree")).alias("share"))
    return _spread(durable(shares), pages, damping, rounds)


def pagerank_pull(inverted: DataFrame, pages: DataFrame, rounds: int = 2, damping: float = 0.85) -> DataFrame:
    """The same from inverted links: every page gathers from the sources that link to it."""
    shares = inverted.select("src", "dst", (F.col("n") / F.col("degree")).alias("share"))
    return _spread(durable(shares), durable(pages), damping, rounds)
