"""Helpers that all training-data operators share: tables, shared folders, learning folds."""

from __future__ import annotations

import ctypes
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.sources.shared import removed, shared_dir, stored, stored_at  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the corpus, read by Spark from wherever ``sf_dir`` points."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Scratch:
    """Tables in the shared folder that a job removes when their last reader is done."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def stored(self, df: DataFrame, what: str, light: bool = False) -> DataFrame:
        """``df`` written and read back; a ``light`` table, whose last step is cheap, in as many files as there
        are cores at most, not one a shuffle partition."""
        path = shared_dir(self.spark, what)
        out = stored_at(df.coalesce(self.spark.sparkContext.defaultParallelism) if light else df, path)
        self.paths[id(out)] = (path, out)
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            removed(self.spark, self.paths.pop(id(t))[0])


def columns(df: DataFrame) -> list[Column]:
    """All columns of ``df``, whatever characters their names hold."""
    return [df[quoted(c)] for c in df.columns]


def quoted(name: str) -> str:
    """A column's name for select(), dots and backticks included."""
    return "`" + name.replace("`", "``") + "`"


def numbered_columns(df: DataFrame) -> DataFrame:
    """``df`` with columns c0, c1 and so on, for Python stages, which can't take names with dots."""
    return df.toDF(*[f"c{k}" for k in range(len(df.columns))])


def small_batches(spark: SparkSession, rows: int = 1000, size: int = 8 << 20) -> None:
    """Let this session's Arrow batches hold at most so many rows and bytes; smaller settings stay.

    Whole texts go to Python in these batches, and both processes keep memory of that size.
    """
    for name, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", size)):
        now = re.fullmatch(r"(\d+)b?", spark.conf.get(f"spark.sql.execution.arrow.{name}"))
        if now and not 0 < int(now[1]) <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(most))


def give_back() -> None:
    """Freed memory of this process goes back to the system."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def released(run: Callable) -> Callable:
    """``run`` for mapInArrow, giving freed memory back to the system at its end, as workers stay for later tasks."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def learnable(doc_id: Column | str = "doc_id") -> Column:
    """True for rows that models may learn from: crc32 of the id's text is not 0 mod 5."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return ~held_out(doc_id)


def held_out(doc_id: Column | str = "doc_id") -> Column:
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fraction(column: Column, salt: int = 0) -> Column:
    """A deterministic uniform number in [0, 1) for a key."""
    return F.pmod(F.xxhash64(column, F.lit(salt)), F.lit(1 << 30)) / F.lit(float(1 << 30))
