"""Helpers that the training-data operators share.

Rows are identified by a 128-bit hash of all their columns (``row_key``), never by an id that
may be null or repeated.  Intermediate tables are written to the shared folder named by
``spark.checkpoint.dir`` (``settle``), so that a lost executor loses no work and no plan is
evaluated twice.
"""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of anything but these ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of an Arrow batch.
BATCH_ROWS = 512
#: The white-space characters themselves.
BLANKS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only a local master, where driver and executors are one process, may leave it unset: a folder
    is then made.  On a cluster a local folder would lose rows, so an unset one is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def settle(df: DataFrame, group_rows: int | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts lineage, survives executors.

    Rows that hold long lists set ``group_rows``, the rows of a Parquet row group: readers decode up to 4,096 rows of one at a time.
    """
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{uuid.uuid4().hex}"
    (df.write.option("parquet.block.row.count.limit", group_rows) if group_rows else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most BATCH_ROWS rows, unless the session has its own setting.

    A Python worker then holds a few megabytes of texts at a time rather than ten thousand rows.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(BATCH_ROWS))


_HELD: list = []


def held(make, *args):
    """``make(*args)``, which a Python worker keeps for its next tasks until another one is asked for.

    Spark hands workers on from stage to stage; with one such value at a time a worker does not carry the models of stages before.
    """
    if not _HELD or _HELD[0] != (make, args):
        _HELD.clear()
        pa.default_memory_pool().release_unused()
        _HELD[:] = [(make, args), make(*args)]
    return _HELD[1]


def hash128(*columns: Column) -> tuple[Column, Column]:
    """Two independent 64-bit hashes of the same columns; together collisions are negligible."""
    return F.xxhash64(*columns), F.xxhash64(F.lit(0x5EED), *reversed(columns))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def pack(df: DataFrame, key: bool = False) -> DataFrame:
    """All columns in one struct ``row`` so that internal names cannot clash with the caller's.

    With ``key``, also ``k1`` and ``k2``, a 128-bit key of the whole row; rows that are equal in
    every column share it.
    """
    packed = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))
    if not key:
        return packed
    k1, k2 = hash128(*[F.col("row").getField(c) for c in df.columns])
    return packed.select("row", k1.alias("k1"), k2.alias("k2"))


def unpack(df: DataFrame, names: list[str], **new: Column) -> DataFrame:
    """Undo ``pack``; new columns replace the caller's columns of the same name."""
    return df.select(
        *[F.col("row").getField(c).alias(c) for c in names if c not in new],
        *[c.alias(n) for n, c in new.items()],
    )
