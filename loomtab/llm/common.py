"""What the operators of this subpackage share: tables, the shared folder, words."""

from __future__ import annotations

import math
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.shipping import ship

#: Byte classes of the two word definitions, for ``bytes.translate`` and ``bytes.split``.
ASCII_UPPER = bytes(range(65, 91))
ASCII_LOWER = bytes(range(97, 123))
LOWER = bytes.maketrans(ASCII_UPPER, ASCII_LOWER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables, whole."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def columns(df: DataFrame) -> list[Column]:
    """All columns, whatever their names."""
    return [F.col(f"`{c.replace('`', '``')}`") for c in df.columns]


def free(df: DataFrame, name: str) -> str:
    """A name that no column begins with: ``name``, or that with more underscores."""
    while any(c.lower().startswith(name.lower()) for c in df.columns):
        name = f"_{name}"
    return name


#: Rows and bytes of a batch between Spark and a Python worker, where the session has no setting of its own.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1024", "spark.sql.execution.arrow.maxBytesPerBatch": "16m"}


def small_batches(spark: SparkSession) -> None:
    """Bounds what a worker holds of whole texts at once (a session's own setting stays), and gives workers the package."""
    ship(spark)
    for key, value in BATCHES.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the setting is unset (tests, local mode) a folder of the driver is taken.
    """
    sc = spark.sparkContext
    there = sc.getConf().get("spark.checkpoint.dir") or sc._jsc.sc().getCheckpointDir().getOrElse(None)
    if not there:
        there = "file://" + tempfile.mkdtemp(prefix="shared-")
        sc.setCheckpointDir(there)
    elif sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(there)
    return there.rstrip("/")


def written(df: DataFrame, name: str, *folders: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, in ``folders`` by columns: cuts the lineage, survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*folders).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.__dict__["written_at"] = path
    return out


def released(*tables: DataFrame | None) -> None:
    """Deletes tables of ``written``: for those that are only read by tables that are written too."""
    for t in tables:
        if t is not None:
            path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t.__dict__["written_at"])
            path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """``df.checkpoint()`` in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def extent(df: DataFrame, column: str) -> tuple[int, int]:
    """Rows, and bytes of a text column, over all rows."""
    n, size = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(column)), F.lit(0))).first()
    return n, size


def pieces(total: int, each: int, least: int = 1) -> int:
    """Number of parts of about ``each`` that ``total`` takes."""
    return max(least, math.ceil(total / each))


def utf8(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """A string column's values as bytes; null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased, all else as it is."""
    return F.translate(c, ASCII_UPPER.decode(), ASCII_LOWER.decode())


def packed(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values).tobytes()


def word_offsets(words: list[bytes]) -> tuple[bytes, np.ndarray]:
    """The words joined by a space, and where each starts (with one end more)."""
    at = np.zeros(len(words) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1, out=at[1:])
    return b" ".join(words), at
