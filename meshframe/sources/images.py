"""Images as (y, x, r, g, b) rows of signed bytes, rows bottom-up as 24-bit bitmap files keep them."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from .files import put


def decode_bmp(raw: bytes) -> np.ndarray:
    """Height by width by 3 bytes, blue first; the first row is the lowest."""
    start, = struct.unpack_from("<I", raw, 10)
    width, height, _, bits = struct.unpack_from("<iiHH", raw, 18)
    if raw[:2] != b"BM" or bits != 24:
        raise ValueError("not a 24-bit bitmap")
    stride = (width * 3 + 3) // 4 * 4
    rows = np.frombuffer(raw, np.uint8, stride * abs(height), start).reshape(abs(height), stride)[:, : width * 3].reshape(abs(height), width, 3)
    return rows[::-1] if height < 0 else rows


def encode_bmp(pixels: np.ndarray) -> bytes:
    height, width, _ = pixels.shape
    pad = -width * 3 % 4
    body = np.pad(pixels.reshape(height, width * 3), ((0, 0), (0, pad))).astype(np.uint8).tobytes()
    return struct.pack("<2sIHHI", b"BM", 54 + len(body), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, width, height, 1, 24, 0, len(body), 0, 0, 0, 0) + body


def read_bmp(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    ship(spark)

    def decode(batches):
        for pdf in batches:
            for path, raw in zip(pdf["path"], pdf["content"]):
                p = decode_bmp(bytes(raw)).view(np.int8)
                for at in range(0, len(p), 256):  # some rows at a time
                    part = p[at : at + 256]
                    y, x = np.mgrid[at : at + len(part), : p.shape[1]]
                    yield pd.DataFrame({"path": path, "y": y.ravel(), "x": x.ravel(), "r": part[..., 2].ravel(), "g": part[..., 1].ravel(), "b": part[..., 0].ravel()})

    return spark.read.format("binaryFile").load(paths).select("path", "content").mapInPandas(decode, "path string, y long, x long, r tinyint, g tinyint, b tinyint")


def write_bmp(pixels: DataFrame, folder: str, height: int) -> None:
    """Write (y, x, r, g, b) as files number.bmp of so many rows each; file k has rows from
    k * height on."""

    def run(pdf):
        number = int(pdf["file"].iloc[0])
        y, x = pdf["y"].to_numpy() - number * height, pdf["x"].to_numpy()
        out = np.zeros((int(y.max()) + 1, int(x.max()) + 1, 3), np.uint8)
        for k, c in enumerate("bgr"):
            out[y, x, k] = pdf[c].to_numpy().astype(np.int8).view(np.uint8)
        put(f"{folder}/{number}.bmp", encode_bmp(out))
        return pd.DataFrame({"file": [number]})

    ship(pixels.sparkSession)
    pixels.withColumn("file", F.expr(f"y div {height}")).groupBy("file").applyInPandas(run, "file long").count()


def random_image(spark: SparkSession, height: int, width: int, seed: int = 0) -> DataFrame:
    cells = spark.range(height * width).select(F.floor(F.col("id") / width).alias("y"), (F.col("id") % width).alias("x"))
    byte = lambda k: (F.pmod(F.xxhash64("y", "x", F.lit(seed), F.lit(k)), F.lit(256)) - 128).cast("tinyint")
    return cells.select("y", "x", byte(0).alias("r"), byte(1).alias("g"), byte(2).alias("b"))
