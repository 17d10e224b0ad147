"""The keyed store: lookups read their buckets only, two writers, failures, compaction."""

from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from loomwright.sources.store import KeyedStore


def _keys(spark, *numbers):
    return spark.createDataFrame([(None if n is None else f"k{n}",) for n in numbers], "key string")


def _store(spark, path, buckets=16):
    return KeyedStore(spark, f"file://{path}", "key string, v string", buckets=buckets)


def test_fill_and_prune(spark, tmp_path):
    store, made = _store(spark, tmp_path), []

    def make(rows):
        made.append(sorted(r["key"] for r in rows.collect()))
        return rows.withColumn("v", F.upper("key"))

    got = store.fill(_keys(spark, 1, 2, 2, None), make)
    assert sorted(map(tuple, got.collect())) == [("k1", "K1"), ("k2", "K2")]
    assert store.fill(_keys(spark, 1, 3), make).count() == 2 and made == [["k1", "k2"], ["k3"]]
    assert store.fill(_keys(spark, 1, 3), make).count() == 2 and len(made) == 2 and len(store.batches()) == 2
    store.fill(spark.range(400).select(F.concat(F.lit("k"), "id").alias("key")), lambda r: r.withColumn("v", F.lit("x")))
    assert store.lookup(_keys(spark, 77, 500, None)).collect()[0]["v"] == "x"


def test_lookup_reads_its_buckets(spark, tmp_path):
    store = _store(spark, tmp_path)
    store.fill(spark.range(400).select(F.concat(F.lit("k"), "id").alias("key")), lambda r: r.withColumn("v", F.lit("x")))
    (batch,) = store.batches()
    bucket = _keys(spark, 77).select(store._bucket()).first()[0]
    for folder in (tmp_path / "rows" / f"batch={batch}").glob("bucket=*"):
        if folder.name != f"bucket={bucket}":
            for f in folder.glob("*.parquet"):
                f.write_bytes(b"not a table")  # a lookup that opened it would fail
    assert store.lookup(_keys(spark, 77)).count() == 1
    with pytest.raises(Exception):
        store.everything().collect()


def test_two_writers_agree(spark, tmp_path):
    def write(who):
        return _store(spark, tmp_path).fill(spark.range(50).select(F.concat(F.lit("k"), "id").alias("key")), lambda r: r.withColumn("v", F.lit(who))).collect()

    with ThreadPoolExecutor(3) as pool:
        list(pool.map(write, "abc"))
    store = _store(spark, tmp_path)
    before = sorted(map(tuple, store.everything().collect()))
    assert len(before) == 50 and len({v for _, v in before}) == 1
    n = store.compact()
    assert n >= 1 and len(store.batches()) == 1 and sorted(map(tuple, store.everything().collect())) == before
    assert store.sweep() == (n if n > 1 else 0) and sorted(map(tuple, store.everything().collect())) == before
    assert store.compact() == 1


def test_a_writer_that_fails_leaves_nothing(spark, tmp_path):
    store = _store(spark, tmp_path)

    def broken(rows):
        return rows.withColumn("v", F.raise_error(F.lit("ended")).cast("string"))

    with pytest.raises(Exception):
        store.fill(_keys(spark, 1), broken)
    (tmp_path / "rows").mkdir(exist_ok=True)
    assert store.batches() == {} and not store.everything().count()
    assert store.fill(_keys(spark, 1), lambda r: r.withColumn("v", F.lit("y"))).collect()[0]["v"] == "y"
