"""Small helpers that several operators of this folder share."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pairloom.session import shared_folder, ship
from pairloom.sources.tables import table

__all__ = ["binary", "fresh_folder", "held", "hold_only", "in_batches", "place_in", "read", "slots", "table"]


BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
SPLITS = "spark.sql.files.minPartitionNum"


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A supplied table; the package is made importable in the workers first."""
    ship(spark)
    return table(spark, folder, name)


def in_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` with the package at hand in the workers. Rows hold whole texts,
    so batches are kept short unless the session asks for a size of its own."""
    ship(df.sparkSession)
    conf = df.sparkSession.conf
    if conf.get(BATCH) == "10000":  # Spark's own choice, meant for rows of numbers
        conf.set(BATCH, "1000")
    return df.mapInArrow(run, schema)


def slots(spark: SparkSession) -> int:
    """Partitions of a shuffle in this session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


_held: list[dict] = []


def held(cache: dict) -> dict:
    """Marks a look-up table that a worker process keeps between tasks."""
    _held.append(cache)
    return cache


def hold_only(*wanted: dict) -> None:
    """Empties the tables that other operators have left in this worker process."""
    for cache in _held:
        if not any(cache is x for x in wanted):
            cache.clear()


def give_back() -> None:
    """Hands memory that earlier steps have freed in this worker process back to the system,
    where the C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def place_in(docs: DataFrame) -> Column:
    """A number for each row of a table of files, the same whenever the table is read.

    How files are split depends on the cores at hand unless a number of splits is
    named; naming it keeps the numbers when executors come or go.
    """
    conf = docs.sparkSession.conf
    if conf.get(SPLITS, None) is None:
        conf.set(SPLITS, str(slots(docs.sparkSession)))
    return F.monotonically_increasing_id()


def fresh_folder(spark: SparkSession, kind: str) -> str:
    """A new folder below the one every executor can reach."""
    return f"{shared_folder(spark)}/pairloom-{spark.sparkContext.applicationId}/{kind}-{uuid.uuid4().hex}"


def binary(column: str) -> Column:
    """UTF-8 bytes of a text column; null counts as empty."""
    return F.encode(F.coalesce(F.col(column), F.lit("")), "UTF-8")
