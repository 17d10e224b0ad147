"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}  # application id -> temporary folder, for masters of one machine
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession, what: str) -> str:
    """A fresh folder under ``spark.checkpoint.dir``, which driver and executors share.

    Where that is unset, a local master (as in tests) gets a temporary folder; a cluster
    must name one, as no folder of one machine is seen by the others.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        name = spark.sparkContext.applicationId
        if name not in _LOCAL:
            _LOCAL[name] = "file://" + tempfile.mkdtemp(prefix="loomwright-")
        root = _LOCAL[name]
    return f"{root.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def stored_at(df: DataFrame, path: str) -> DataFrame:
    """The rows of ``df`` written to ``path`` and read back.

    This cuts lineage: later stages read files that survive lost executors, and steps
    that must agree (such as partition numbers) see one version.  The shuffles that made
    the rows are removed, as the files hold all that they did.
    """
    spark, schema = df.sparkSession, df.schema
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    return spark.read.schema(schema).parquet(path)


def stored(df: DataFrame, what: str) -> DataFrame:
    """The rows of ``df`` in a fresh shared folder."""
    return stored_at(df, shared_dir(df.sparkSession, what))


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a folder of any file system that Spark knows."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
