import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def table(spark):
    return lambda name: spark.read.parquet(f"{SMALL}/{name}.parquet")


@pytest.fixture
def documents(spark):
    """A table of documents from (doc_id, text) pairs, with columns whose names operators use."""

    def make(rows, source=None):
        rows = [(i, t, "en", source(k) if source else f"s{k % 3}", 0, "x", 1, 2, 3, 4, 5) for k, (i, t) in enumerate(rows)]
        return spark.createDataFrame(rows, DOCS + ", key string, size int, rows int, label int, block int, start int")

    return make


LONG = "".join(f"w{i * 7919 % 100003} " for i in range(20_000))
EDGES = [(1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, "one"), (5, "one"), (None, "no id here but some words to read"), (6, LONG), (7, LONG), (1 << 60, "émigré naïve Ünder STRASSE ß \x00 nul"), (8, "a b c d e f g h i j k l m n o p q r s t u v w x y z")]
