"""Incremental ingest as a Structured Streaming job: what is available now, then stop.

The checkpoint remembers which files were read; a batch drops records whose key is
stored already, continues the ids and appends to member partitions.  Rows carry the
stream they came by and its batch number, so a batch that is run again finds itself and
writes nothing, and a stream with a new checkpoint is another stream, whose batches
count from 0 again.
"""

from __future__ import annotations

from concurrent.futures import Future

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.operators.ingest import new_records, numbered


def run_available(spark: SparkSession, source: str, schema, target: str, checkpoint: str, key: str = "postUrl", order: tuple[str, ...] = ("postedAt", "postUrl"), marks: tuple[str, ...] = ()) -> None:
    """Read new parquet files of ``source`` and append unseen records to ``target`` (chunk_id, batch, member partitions).

    With ``marks`` (such as member, source) records older than their group's newest stored one are left out, too.
    """
    stream: Future = Future()  # the id that the checkpoint keeps

    def write(batch: DataFrame, number: int) -> None:
        stored, name = stored_rows(spark, target, schema), f"{stream.result(timeout=300)}:{number}"
        if stored.where(F.col("batch") == name).limit(1).count():
            return
        unseen = batch.where(F.col(key).isNotNull()).dropDuplicates([key]).unionByName(batch.where(F.col(key).isNull()))
        if marks:
            unseen = new_records(unseen, stored, key, marks)
        else:
            unseen = unseen.join(stored.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")
        numbered(unseen, stored, order).withColumn("batch", F.lit(name)).write.mode("append").partitionBy("member").parquet(target)

    query = spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    stream.set_result(query.id)
    query.awaitTermination()


def stored_rows(spark: SparkSession, target: str, schema) -> DataFrame:
    """What ``target`` holds; no rows where it isn't there yet."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(target)
    except AnalysisException:
        empty = spark.createDataFrame([], schema)
        return empty.withColumns({"chunk_id": F.lit(None).cast("long"), "batch": F.lit(None).cast("string")})


def run_stateful(spark: SparkSession, source: str, schema, target: str, checkpoint: str, keys: tuple[str, ...], time: str, late: str = "30 days", per_batch: int | None = None, prepare=None) -> None:
    """Appends records of new parquet files of ``source`` to ``target`` whose ``keys`` (such as member, source and address)
    haven't been seen, without reading the target.

    Seen keys are the stream's state, dealt by key over the executors and kept for ``late`` behind the newest ``time``;
    records without a time, or older than that, are left out.  The sink commits each batch's files once, so a run that
    ends early goes on where it was.  ``per_batch`` bounds the files of a batch; ``prepare`` may derive columns.
    """
    reader = spark.readStream.schema(schema)
    rows = (reader.option("maxFilesPerTrigger", per_batch) if per_batch else reader).parquet(source)
    rows = prepare(rows) if prepare else rows
    fresh = rows.where(F.col(time).isNotNull()).withWatermark(time, late).dropDuplicatesWithinWatermark(list(keys))
    fresh.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
