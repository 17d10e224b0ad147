"""Exact top-k by dot product that skips cells of vectors which can't reach the k-th score.

Vectors lie in cells around centres; a cell's rows keep their distance to the centre, so
q.x <= q.centre + |q| * distance bounds every score without reading the vector.  The most
promising cells of each group are scored first; the k-th score found there decides which
other cells, and which rows in them, are read.  Results equal ``retrieval.top_k`` of all pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from loomwright.functions.scalar import dot
from loomwright.operators import retrieval as R
from loomwright.sources.shared import removed, shared_dir, stored

#: Pairs of (query, member, cell) without vectors that may be broadcast: some 10 MB.
PAIR_BOUND = 1 << 18
#: The cell of vectors that no bound holds for (another length, or numbers that aren't finite): always scored.
LOOSE = -1


def centres(chunks: DataFrame, cells: int = 64, held: int = 20, steps: int = 8) -> np.ndarray:
    """Up to ``cells`` centres by Lloyd's steps on at most ``held`` x ``cells`` vectors, the first in a hash order of their
    ids that have the first one's length and finite numbers.  They decide how much is skipped, never what is found."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    order = F.xxhash64(F.col("chunk_id").cast("string"))
    good = chunks.where(F.col("embedding").isNotNull() & finite & (F.size("embedding") > 0)).orderBy(order, "chunk_id").limit(held * cells).select("embedding")
    rows = [r[0] for r in good.collect()]
    rows = [r for r in rows if len(r) == len(rows[0])]
    if not rows:
        return np.zeros((0, 0))
    x = np.array(rows, dtype=np.float64)
    c = np.unique(x[:cells], axis=0)
    for _ in range(steps):
        near = np.argmin((c * c).sum(1) - 2 * (x @ c.T), axis=1)
        c = np.array([x[near == i].mean(0) if (near == i).any() else c[i] for i in range(len(c))])
    return c


class CellIndex:
    """Vectors dealt to cells, as a table in the shared folder: a folder a cell, rows sorted by distance.

    ``rows`` has chunk_id, member, embedding, distance, cell; ``cells`` has member, cell, n and the largest distance.
    Rows without a vector are left out.  A cell that holds very many rows, such as copies, is written by many tasks.
    """

    def __init__(self, chunks: DataFrame, cells: int = 64):
        self.spark, self.centres = chunks.sparkSession, centres(chunks, cells)
        middles = self.centres
        slim = chunks.where("embedding is not null").select("chunk_id", "member", "embedding")

        def dealt(batches):
            squares = (middles * middles).sum(1)
            for batch in batches:
                for at in range(0, batch.num_rows, 4096):
                    b = batch.slice(at, 4096)
                    vectors = b.column(2)
                    cell, distance = np.full(b.num_rows, LOOSE, dtype=np.int32), np.full(b.num_rows, np.inf)
                    if len(middles):
                        fits = np.flatnonzero(vectors.value_lengths().to_numpy(zero_copy_only=False) == middles.shape[1])
                        x = vectors.take(pa.array(fits)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, middles.shape[1])
                        whole = np.isfinite(x).all(axis=1)
                        fits, x = fits[whole], x[whole]
                        near = np.argmin(squares - 2 * (x @ middles.T), axis=1)
                        cell[fits], distance[fits] = near, np.sqrt(((x - middles[near]) ** 2).sum(1))
                    yield pa.RecordBatch.from_arrays([*b.columns, pa.array(distance), pa.array(cell)], names=["chunk_id", "member", "embedding", "distance", "cell"])

        schema = StructType([*slim.schema.fields, StructField("distance", DoubleType()), StructField("cell", IntegerType())])
        placed = slim.mapInArrow(dealt, schema).repartitionByRange("cell", "distance", "chunk_id").sortWithinPartitions("cell", "distance")
        self.path = shared_dir(self.spark, "cells")
        placed.write.partitionBy("cell").parquet(self.path)
        self.rows = self.spark.read.schema(schema).parquet(self.path)
        self.cells = self.rows.groupBy("member", "cell").agg(F.count("*").alias("n"), F.max("distance").alias("far"))

    def drop(self) -> None:
        """Removes the table."""
        removed(self.spark, self.path)

    def _pairs(self, battery: DataFrame) -> DataFrame:
        """query_idx, member, cell, n, middle, norm, slack, bound: no score of the cell's rows exceeds ``bound``."""
        where = self.spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(self.centres)], "cell int, centre array<double>")
        size = lambda v: F.sqrt(dot(F.col(v), F.col(v)))
        met = battery.crossJoin(F.broadcast(where)).select("query_idx", "cell", dot(F.col("q"), F.col("centre")).alias("middle"), size("q").alias("norm"), size("centre").alias("size"))
        loose = battery.select("query_idx", F.lit(LOOSE).alias("cell"), *[F.lit(None).cast("double").alias(c) for c in ("middle", "norm", "size")])
        both = self.cells.join(R.small(met.unionByName(loose), PAIR_BOUND), "cell")
        both = both.withColumn("slack", 1e-9 * (1 + F.col("norm") * (F.col("size") + F.col("far"))))  # sums in another order
        return both.withColumn("bound", F.coalesce(F.col("middle") + F.col("norm") * F.col("far") + F.col("slack"), F.lit(float("inf"))))

    def _reaching(self, pairs: DataFrame) -> DataFrame:
        """Rows of the pairs' cells that can reach the pair's ``floor``; all of them where either isn't known."""
        told = pairs.select("query_idx", F.col("member").alias("_member"), F.col("cell").alias("_cell"), "middle", "norm", "slack", "floor")
        met = self.rows.join(R.small(told, PAIR_BOUND), (F.col("cell") == F.col("_cell")) & F.col("member").eqNullSafe(F.col("_member")))
        return met.where(F.coalesce(F.col("middle") + F.col("norm") * F.col("distance") + F.col("slack") >= F.col("floor"), F.lit(True)))

    def _scored(self, pairs: DataFrame, battery: DataFrame) -> DataFrame:
        rows = self._reaching(pairs).select("query_idx", "member", "chunk_id", "embedding").join(R.small(battery.select("query_idx", "q")), "query_idx")
        return rows.select("query_idx", "member", "chunk_id", dot(F.col("embedding"), F.col("q")).alias("rel"))

    def _steps(self, battery: DataFrame, k: int, probe: int) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(pairs scored first, their k best, the other pairs that can still reach the k-th score)."""
        place = Window.partitionBy("query_idx", "member").orderBy(F.desc_nulls_first("middle"), "cell")
        before = F.sum(F.when(F.col("cell") == LOOSE, 0).otherwise(F.col("n"))).over(place.rowsBetween(Window.unboundedPreceding, -1))
        pairs = stored(self._pairs(battery).withColumn("first", F.col("middle").isNull() | (F.coalesce(before, F.lit(0)) < probe * k)), "pairs")
        first = pairs.where("first").withColumn("floor", F.lit(None).cast("double"))
        best = stored(R.top_k(self._scored(first, battery), k), "best")
        floor = best.where((F.col("rank") == k) & ~F.isnan("rel")).select("query_idx", F.col("member").alias("_member"), F.col("rel").alias("floor"))
        rest = pairs.where("not first").alias("p").join(floor.alias("f"), (F.col("p.query_idx") == F.col("f.query_idx")) & F.col("member").eqNullSafe(F.col("_member")), "left")
        rest = rest.select("p.*", "floor").where(F.coalesce(F.col("bound") >= F.col("floor"), F.lit(True)))
        return first, best, rest

    def top_k(self, battery: DataFrame, k: int, probe: int = 8) -> DataFrame:
        """query_idx, member, chunk_id, rel, rank: the k best rows of each member and query; NaN and null last, ties by chunk_id.

        battery: query_idx (unique), q.  About ``probe`` x k rows a group are scored first.
        """
        battery = R.small(battery)
        _, best, rest = self._steps(battery, k, probe)
        return R.top_k(best.drop("rank").unionByName(self._scored(rest, battery)), k)

    def work(self, battery: DataFrame, k: int, probe: int = 8) -> DataFrame:
        """query_idx, rows, scored: all rows with a vector, and those that ``top_k`` scores."""
        first, _, rest = self._steps(R.small(battery), k, probe)
        seen = self._reaching(first.unionByName(rest)).groupBy("query_idx").agg(F.count("*").alias("scored"))
        return self.cells.agg(F.sum("n").alias("rows")).crossJoin(F.broadcast(seen)).select("query_idx", "rows", "scored")
