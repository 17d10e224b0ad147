"""The index of cells gives the k best rows of all pairs, and scores few of them where vectors cluster."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwright.operators import retrieval as R
from loomwright.operators.pruned import CellIndex

CHUNKS, BATTERY = "chunk_id long, member string, embedding array<float>", "query_idx long, q array<float>"


def _found(df):
    return sorted((r.query_idx, str(r.member), r.rank, r.chunk_id, repr(r.rel)) for r in df.collect())


def _same(chunks, battery, k, cells=16):
    want = R.top_k(R.scored(chunks, battery).select("query_idx", "member", "chunk_id", "rel"), k)
    index = CellIndex(chunks, cells)
    assert _found(index.top_k(battery, k, 2)) == _found(want)
    return index


def test_clustered_vectors(spark):
    rng = np.random.default_rng(5)
    middles = rng.normal(size=(20, 16))
    x = middles[rng.integers(0, 20, 4000)] + 0.05 * rng.normal(size=(4000, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[1000:2400] = x[7]  # a third of all rows are copies
    rows = spark.createDataFrame([(i, f"m{i % 3}", v.tolist()) for i, v in enumerate(x)], CHUNKS)
    asked = spark.createDataFrame([(i, x[i * 31].tolist()) for i in range(12)], BATTERY)
    index = _same(rows, asked, 5, 24)
    work = index.work(asked, 5, 2).collect()
    assert {r.rows for r in work} == {4000} and len(work) == 12
    assert sum(r.scored for r in work) < 0.5 * 12 * 4000
    index.drop()


@pytest.mark.parametrize("k", [1, 4])
def test_odd_rows(spark, k):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(60, 4)).tolist()
    rows = [(i, f"m{i % 2}" if i % 5 else None, v) for i, v in enumerate(x)]
    rows += [(100, "m0", None), (101, "m0", [float("nan"), 0.0, 0.0, 0.0]), (102, "m0", [1.0, None, 0.0, 0.0]), (103, "m1", [1.0, 2.0]), (104, "m1", []), (105, "few", x[0]), (106, "few", None), (107, "m0", [float("inf"), 1.0, 1.0, 1.0])]
    rows += [(200 + i, "m1", x[3]) for i in range(9)]  # ties
    chunks = spark.createDataFrame(rows, CHUNKS)
    asked = spark.createDataFrame([(0, x[3]), (1, [0.0] * 4), (2, None), (3, [1.0, float("nan"), 0.0, 0.0]), (4, [1.0, 2.0]), (5, [-v for v in x[3]])], BATTERY)
    _same(chunks, asked, k)
    assert not CellIndex(chunks.where(F.lit(False))).top_k(asked, k).count()
    assert not CellIndex(chunks).top_k(asked.where(F.lit(False)), k).count()
