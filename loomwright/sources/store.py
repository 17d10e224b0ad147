"""A table of results by key that several writers fill: buckets of keys, committed batches, compaction.

Folders are ``rows/batch=<name>/bucket=<n>``; a lookup reads only the buckets that its keys
fall in.  A batch counts once it stands in the commits (see ``sinks.commit``), so a writer that
ends early leaves nothing that is read.  Where two writers made the same key, the batch
committed first wins for every reader.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructType

from loomwright.sources import sinks
from loomwright.sources.shared import removed, shared_dir, stored_at


class KeyedStore:
    """Rows of ``schema`` (DDL, ``key`` one of its columns) under ``root``, a folder that all executors share.

    Without a schema the rows are what the first batch holds.  Keys are unique to a reader; null keys are never
    stored.  The number of buckets belongs to the table.
    """

    def __init__(self, spark: SparkSession, root: str, schema: str | None = None, key: str = "key", buckets: int = 256):
        self.spark, self.root, self.key, self.buckets = spark, root.rstrip("/"), key, buckets
        self.schema = StructType.fromDDL(schema) if schema else None

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def batches(self) -> dict[str, int]:
        """Committed batches that no compaction replaced, with the number of their commit; one small file a commit."""
        try:
            return {r["batch"]: r["number"] for r in sinks.committed(self.spark, self.root).collect()}
        except AnalysisException:
            return {}

    def _of(self, batches: dict[str, int], buckets: list[int] | None = None) -> DataFrame:
        """The rows of some batches, one a key: that of the earliest commit."""
        if not batches:
            return self.spark.createDataFrame([], self.schema or f"`{self.key}` string")
        if not self.schema:
            first = min(batches, key=batches.get)
            self.schema = self.spark.read.parquet(f"{self.root}/rows/batch={first}").drop("bucket").schema
        stored = StructType([*self.schema.fields]).add("batch", StringType()).add("bucket", IntegerType())
        rows = self.spark.read.schema(stored).parquet(f"{self.root}/rows").where(F.col("batch").isin(*batches))
        if buckets is not None:
            rows = rows.where(F.col("bucket").isin(*buckets))
        if len(batches) > 1:  # within one batch keys are unique
            order = self.spark.createDataFrame(list(batches.items()), "batch string, _number long")
            rest = [c for c in self.schema.names if c != self.key]
            met = rows.join(F.broadcast(order), "batch").groupBy(self.key).agg(F.min_by(F.struct(F.lit(0), *rest), "_number").alias("_first"))
            rows = met.select(self.key, *[F.col("_first")[c].alias(c) for c in rest])
        return rows.select(*self.schema.names)

    def lookup(self, keys: DataFrame) -> DataFrame:
        """Stored rows of the keys in ``keys`` (a column named as the store's key), from their buckets' files only."""
        wanted = keys.select(self.key).where(F.col(self.key).isNotNull()).distinct()
        buckets = [r[0] for r in wanted.select(self._bucket()).distinct().collect()]  # at most self.buckets numbers
        return self._of(self.batches(), buckets).join(wanted, self.key, "left_semi")

    def everything(self) -> DataFrame:
        return self._of(self.batches())

    def _write(self, rows: DataFrame, replaces: tuple[str, ...] = ()) -> str:
        batch = uuid.uuid4().hex
        placed = (rows.select(*self.schema.names) if self.schema else rows).withColumn("bucket", self._bucket()).repartition("bucket", self.key).sortWithinPartitions("bucket", self.key)
        placed.write.partitionBy("bucket").parquet(f"{self.root}/rows/batch={batch}")
        sinks.commit(self.spark, self.root, batch, replaces)
        return batch

    def fill(self, rows: DataFrame, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """What the store has for the keys of ``rows`` after ``make`` gave the rows of those that were missing.

        ``make`` gets one of ``rows`` for each missing key.  They are written down first, so an outside service isn't
        asked again for what a lost executor worked out before it, only for the tasks that are run again.
        """
        path = shared_dir(self.spark, "missing")
        asked = rows.where(F.col(self.key).isNotNull()).dropDuplicates([self.key])
        missing = stored_at(asked.join(self.lookup(asked).select(self.key), self.key, "left_anti"), path)
        if not missing.isEmpty():
            self._write(make(missing).where(F.col(self.key).isNotNull()).dropDuplicates([self.key]))
        removed(self.spark, path)
        return self.lookup(rows)

    def compact(self) -> int:
        """Writes all batches as one that replaces them, and tells how many there were.  Batches committed meanwhile stay."""
        old = self.batches()
        if len(old) > 1:
            self._write(self._of(old), tuple(old))
        return len(old)

    def sweep(self) -> int:
        """Deletes the files of replaced batches, once no reader works on them, and tells how many there were."""
        gone = [r["batch"] for r in sinks.replaced(self.spark, self.root).collect()]
        for batch in gone:
            removed(self.spark, f"{self.root}/rows/batch={batch}")
        return len(gone)
