"""Helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as the contracts spell it: [\x20\x09-\x0D].
SPACE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; where unset, a new one on a single machine and an error on a cluster."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="spark-tidemark-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def written(df: DataFrame, group_mb: int = 128) -> tuple[DataFrame, str]:
    """``df`` as a table in the shared folder, and its path; row groups hold ``group_mb`` at most, less for rows that are large."""
    path = f"{shared_dir(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").option("parquet.block.size", group_mb << 20).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` once as a table in the shared folder and read it back.

    Cuts lineage, so lost executors cost a re-read and never a recomputation, and it fixes
    row numbers made by ``monotonically_increasing_id``.
    """
    return written(df)[0]


def dropped(spark: SparkSession, path: str) -> None:
    """Delete a table of ``written`` that nothing will read again."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``batches``; when they end, what was freed goes back to the system, as an idle worker lives on beside the stages that follow."""
    yield from batches
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim:
        trim(0)


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(c, UPPER, LOWER)


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def wrapped(df: DataFrame, **named: Column) -> DataFrame:
    """``named`` beside each whole row of ``df`` as the struct ``_row``: no column of ``df`` can clash with them."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), *[c.alias(k) for k, c in named.items()])


def unwrapped(rows: DataFrame, like: DataFrame, **new: Column) -> DataFrame:
    """The columns of ``like`` out of ``_row``, those of ``new`` in its types instead; a renewed text renews ``n_chars``."""
    return rows.select(*[(new[c].cast(like.schema[c].dataType) if c in new else F.col(f"_row.`{c}`")).alias(c) for c in like.columns])
