"""Helpers shared by the corpus operators: input tables, shared scratch tables, word rules."""

from __future__ import annotations

import gc
import os
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship

#: A word is a maximal run of characters other than space, tab, line feed, VT, FF and CR.
WORD_PATTERN = "[^\\x20\\x09-\\x0D]+"
#: A-Z to a-z and nothing else.
LOWER_ASCII = {c: c + 32 for c in range(65, 91)}
#: The same white space as WORD_PATTERN, turned into spaces.
_BLANKS = {c: 32 for c in range(9, 14)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: str | None) -> list[str]:
    """The words of a text; none for null."""
    return [w for w in text.translate(_BLANKS).split(" ") if w] if text else []


def id_text(df: DataFrame, column: str, *others) -> DataFrame:
    """The id as text, for its way through Python: pandas makes floats of integers beside nulls."""
    return df.select(F.col(column).cast("string").alias(column), *others)


def id_back(df: DataFrame, like: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, F.col(column).cast(like.schema[column].dataType))


def unused(df: DataFrame, name: str) -> str:
    """The name, longer where a column of the table has it already (Spark ignores case)."""
    held = {c.lower() for c in df.columns}
    while name.lower() in held:
        name += "_"
    return name


def keyed(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """The rows as a table with a key of their own, written, so that every later job finds the same
    keys; and the key's name."""
    key = unused(df, "row_key")
    rows = cut(df.withColumn(key, F.monotonically_increasing_id()), name)
    _keyed.update(f.rsplit("/", 1)[0] for f in rows.inputFiles())
    return rows, key


#: Tables of keyed() that are still there.
_keyed: set[str] = set()


def sweep(docs: DataFrame) -> None:
    """Delete the tables that keyed() made for rows that have been written since, which are all but
    those that docs is read from; let go of the shuffles."""
    gone = _keyed - {f.rsplit("/", 1)[0] for f in docs.inputFiles()}
    _keyed.difference_update(gone)
    _delete(docs.sparkSession, gone)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where
    that is unset, which only a local session may do."""
    conf = spark.sparkContext.getConf()
    at = conf.get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = os.path.join(tempfile.gettempdir(), f"meshframe-{os.getuid()}")
        os.makedirs(at, exist_ok=True)
    at = at.rstrip("/")
    return at if ":" in at.split("/")[0] else f"file://{at}"


def fresh(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing uses yet."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write the rows as a table in the shared folder and read them back, which ends the lineage:
    a lost executor costs no recomputation of what stands above."""
    spark, path = df.sparkSession, fresh(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    if _made:
        _made[-1].append(path)
    return out


#: Paths of the tables that cut() wrote inside each settled() that is open.
_made: list[list[str]] = []


def settled(make, name: str) -> DataFrame:
    """What make() returns, written as a table; the other tables that cut() wrote on the way are
    deleted, the shuffles let go of, and the user's settings put back."""
    _made.append([])
    try:
        out = cut(make(), name)
    finally:
        *paths, own = _made.pop() or [None]
    _delete(out.sparkSession, paths)
    _user_batches(out.sparkSession)
    if _made:
        _made[-1].append(own)
    return out


def _delete(spark: SparkSession, paths) -> None:
    conf = spark._jsc.hadoopConfiguration()
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)
    gc.collect()
    for _ in range(2):
        time.sleep(1.2)  # the gateway lets go of Python's objects once a second, listeners of the last plan
        spark._jvm.System.gc()


def discard(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete tables of cut() that no lazy plan needs any more, and let go of the shuffles behind
    what has been written, which Spark deletes when the driver's garbage collector finds them."""
    _delete(spark, {f.rsplit("/", 1)[0] for df in tables for f in df.inputFiles()})


def trim() -> None:
    """Give back what earlier tasks of this Python worker freed; workers outlive tasks."""
    import ctypes

    import pyarrow

    pyarrow.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
#: The user's own bound on batches, and what operators put in its place.
_bounds: dict[str, str | None] = {"user": None, "own": None}


def small_batches(spark: SparkSession, mb: int = 8) -> None:
    """Bound the bytes that one Arrow batch holds, as texts may be very long; give the Python
    workers this package. The bound holds for the session until settled() puts the user's own back,
    since results are lazy; a smaller one of the user's stands."""
    ship(spark)
    now = spark.conf.get(_BATCH, None)
    if now != _bounds["own"]:
        _bounds["user"] = now
    user = _bounds["user"]
    _bounds["own"] = str(min(mb << 20, int(user)) if user and user.isdigit() and int(user) > 0 else mb << 20)
    spark.conf.set(_BATCH, _bounds["own"])


def _user_batches(spark: SparkSession) -> None:
    if _bounds["own"] and spark.conf.get(_BATCH, None) == _bounds["own"]:
        spark.conf.set(_BATCH, _bounds["user"]) if _bounds["user"] else spark.conf.unset(_BATCH)
    _bounds["own"] = None
