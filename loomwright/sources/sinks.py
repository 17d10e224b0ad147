"""Writing: member shards in pairs, JSON dumps, metrics, conditional publishing."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from loomwright.operators.ingest import CHUNK_COLUMNS, conform


def shard(member: Column) -> Column:
    """A member's shard name: lower case, blanks as underscores, without points."""
    return F.replace(F.replace(F.lower(member), F.lit(" "), F.lit("_")), F.lit("."), F.lit(""))


def commit(spark: SparkSession, root: str, batch: str, replaces: tuple[str, ...] = ()) -> int:
    """Adds ``batch`` to the commits under ``root`` and returns its number: the next one that no other writer takes first.

    The entry is written aside and then gets its number as a name, which fails where that is taken, so each number
    has one writer and an entry is seen whole or not at all.  Batches that it ``replaces`` no longer count from then on.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    fs_path = jvm.org.apache.hadoop.fs.Path
    folder, text = fs_path(f"{root}/commits"), "\n".join([batch, *(f"-{b}" for b in replaces)])
    fs = folder.getFileSystem(conf)
    fs.mkdirs(folder)
    number = max([int(f.getPath().getName()) + 1 for f in fs.listStatus(folder) if f.getPath().getName().isdigit()], default=0)
    if fs.getUri().getScheme() == "file":  # its rename takes an existing name, a link never does
        return _linked(folder.toUri().getPath(), batch, text, number)
    aside, files = fs_path(folder, f".{batch}"), jvm.org.apache.hadoop.fs.FileContext.getFileContext(folder.toUri(), conf)
    out = fs.create(aside, True)
    out.write(bytearray(text.encode()))
    out.close()
    none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    while True:
        try:
            files.rename(aside, fs_path(folder, f"{number:012d}"), none)
            return number
        except Py4JJavaError as e:
            if "FileAlreadyExists" not in str(e.java_exception):
                raise
            number += 1


def _linked(folder: str, batch: str, text: str, number: int) -> int:
    aside = os.path.join(folder, f".{batch}")
    with open(aside, "w") as out:
        out.write(text)
    while True:
        try:
            os.link(aside, os.path.join(folder, f"{number:012d}"))
        except FileExistsError:
            number += 1
        else:
            os.unlink(aside)
            return number


def _entries(spark: SparkSession, root: str) -> DataFrame:
    number = F.col("_metadata.file_name").cast("long").alias("number")
    return spark.read.text(f"{root}/commits", pathGlobFilter="[0-9]*").select(F.col("value").alias("batch"), number)


def replaced(spark: SparkSession, root: str) -> DataFrame:
    """batch: those that a later commit replaced."""
    return _entries(spark, root).where(F.col("batch").startswith("-")).select(F.substring("batch", 2, 1 << 20).alias("batch")).distinct()


def committed(spark: SparkSession, root: str) -> DataFrame:
    """batch, number: those that are committed under ``root`` and not replaced; one small file each."""
    return _entries(spark, root).where(~F.col("batch").startswith("-")).join(replaced(spark, root), "batch", "left_anti")


def append_pair(chunks: DataFrame, vectors: DataFrame, root: str) -> str:
    """Appends chunks (conformed, a folder a member) and their vectors (chunk_id, embedding) as one batch; its name.

    Both sides are written to folders of the batch, then the batch is committed.  Readers take committed batches
    only, so a run that ends in between leaves the pair as it was, and a second run writes another batch.  Appends of
    several writers commit one after another.
    """
    spark, batch = chunks.sparkSession, uuid.uuid4().hex
    members = chunks.select("chunk_id", shard(F.col("member")).alias("shard"))
    vectors.select("chunk_id", F.col("embedding").cast("array<float>")).join(members, "chunk_id").write.partitionBy("shard").parquet(f"{root}/embeddings/batch={batch}")
    conform(chunks).withColumn("shard", shard(F.col("member"))).write.partitionBy("shard").parquet(f"{root}/chunks/batch={batch}")
    commit(spark, root, batch)
    return batch


def read_pair(spark: SparkSession, root: str) -> DataFrame:
    """Chunks of committed batches with their vector; of vectors that stand twice in a batch one is taken, chunks without
    one have null."""
    done = F.broadcast(committed(spark, root))  # one row a batch
    schema = StructType.fromDDL("chunk_id long, embedding array<float>, batch string, shard string")
    side = lambda name, schema: spark.read.schema(schema).parquet(f"{root}/{name}").join(done, "batch", "left_semi")
    v = side("embeddings", schema).dropDuplicates(["batch", "chunk_id"]).select("batch", "chunk_id", "embedding")
    stored = StructType([StructField(c, StructType.fromDDL(f"x {t}")[0].dataType) for c, t in CHUNK_COLUMNS.items()]).add("batch", "string").add("shard", "string")
    return side("chunks", stored).drop("shard").join(v, ["batch", "chunk_id"], "left").drop("batch")


def dump(rows: DataFrame, path: str) -> None:
    """Rows as JSON lines; what JSON has no form for is written as text by Spark."""
    rows.write.mode("overwrite").json(path)


def publish(new: DataFrame, push: Callable[[DataFrame], None]) -> bool:
    """Calls ``push`` only if there is a new row; tells whether it did."""
    some = not new.isEmpty()
    if some:
        push(new)
    return some
