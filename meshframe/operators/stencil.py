"""2D filters over pixel rows (y, x, v), with clamped edges and 8-bit wrap-around.

Pixels go to square tiles with a halo as wide as the filter's radius, at most four tiles each, and
numpy filters a tile in one task. One exchange for each pass, whatever the radius.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.durable import durable
from ..session import ship

MAX_RADIUS, MAX_ROUNDS = 15, 25


def elliptical(weights: np.ndarray, a: float, b: float) -> np.ndarray:
    """The filter with weights inside an ellipse alone, of half axes a along x and b along y."""
    r = len(weights) // 2
    y, x = np.mgrid[-r : r + 1, -r : r + 1]
    return np.where((x / a) ** 2 + (y / b) ** 2 <= 1, weights, 0)


def convolve(image: DataFrame, weights, tile: int = 512, flip_rows: bool = True) -> DataFrame:
    """Each pixel's weighted neighbourhood, wrapped to signed 8 bits. Beyond an edge its nearest
    pixel counts. flip_rows: the filter's rows are read last first, as images stored bottom-up
    need it."""
    ship(image.sparkSession)
    w = np.asarray(weights, np.int64)
    w = w[::-1] if flip_rows else w
    radius = len(w) // 2
    if w.shape != (2 * radius + 1,) * 2 or not 0 <= radius <= MAX_RADIUS:
        raise ValueError("a filter is a square of odd size, of radius 15 at most")
    if tile <= 2 * radius:
        raise ValueError("a tile must be wider than the filter")
    y0, y1, x0, x1 = image.agg(F.min("y"), F.max("y"), F.min("x"), F.max("x")).first()
    if y0 is None:
        return image.select("y", "x", "v")
    near = lambda c: F.array_distinct(F.transform(F.array(F.lit(-radius), F.lit(0), F.lit(radius)), lambda d: F.floor((F.col(c) + d) / tile)))
    halo = image.select("y", "x", F.col("v").cast("long").alias("v")).withColumn("ty", F.explode(near("y"))).withColumn("tx", F.explode(near("x")))

    def filtered(pdf):
        ty, tx = int(pdf["ty"].iloc[0]), int(pdf["tx"].iloc[0])
        top, left = max(ty * tile, y0), max(tx * tile, x0)
        h, wide = min((ty + 1) * tile - 1, y1) - top + 1, min((tx + 1) * tile - 1, x1) - left + 1
        if h <= 0 or wide <= 0:
            return pd.DataFrame({"y": [], "x": [], "v": []})
        grid = np.zeros((h + 2 * radius, wide + 2 * radius), np.int64)
        grid[pdf["y"].to_numpy() - top + radius, pdf["x"].to_numpy() - left + radius] = pdf["v"]
        rows = np.clip(np.arange(top - radius, top + h + radius), y0, y1) - top + radius
        cols = np.clip(np.arange(left - radius, left + wide + radius), x0, x1) - left + radius
        grid = grid[rows][:, cols]
        out = sum(w[i, j] * grid[i : i + h, j : j + wide] for i in range(len(w)) for j in range(len(w)))
        y, x = np.mgrid[top : top + h, left : left + wide]
        return pd.DataFrame({"y": y.ravel(), "x": x.ravel(), "v": ((out.ravel() + 128) % 256) - 128})

    return halo.groupBy("ty", "tx").applyInPandas(filtered, "y long, x long, v int")


def convolve_rounds(image: DataFrame, weights, rounds: int = 10, **options) -> DataFrame:
    """The filter again and again; each round's image is written before the next reads it."""
    if not 1 <= rounds <= MAX_ROUNDS:
        raise ValueError("between 1 and 25 rounds")
    for k in range(rounds):
        image = convolve(image if k == 0 else durable(image), weights, **options)
    return image
