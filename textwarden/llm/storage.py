"""Where operators cut lineage: the shared folder that the session names."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid

import pyarrow as pa

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir or, where that is unset, the context's. In local mode one is made if there is none."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if not named and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return (named or sc.getCheckpointDir()).rstrip("/")


def give_back() -> None:
    """Returns memory that a worker has freed but keeps to the system; workers live through many stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to the checkpoint folder, all at once."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to a new folder below the checkpoint folder, and read again.

    Unlike a checkpointed table it tells the planner its true size, where loops of joins would multiply estimates.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def removed(*tables: DataFrame | None) -> None:
    """Deletes tables made by :func:`stored` that nothing reads any more."""
    for t in tables:
        if path := getattr(t, "_stored_at", None):
            spark = t.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _loose(t: T.DataType) -> T.DataType:
    if isinstance(t, T.StructType):
        return T.StructType([T.StructField(f.name, _loose(f.dataType), True) for f in t.fields])
    if isinstance(t, T.ArrayType):
        return T.ArrayType(_loose(t.elementType), True)
    if isinstance(t, T.MapType):
        return T.MapType(_loose(t.keyType), _loose(t.valueType), True)
    return t


def loosened(df: DataFrame) -> DataFrame:
    """df with nulls allowed everywhere inside nested columns, as rows that pass through Arrow functions are declared."""
    nested = {f.name: _loose(f.dataType) for f in df.schema if isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType))}
    return df.select(*[F.col(f"`{c}`").cast(nested[c]).alias(c) if c in nested else F.col(f"`{c}`") for c in df.columns])
