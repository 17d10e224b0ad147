"""Vector code compression (13): Lloyd's codebooks of vector parts with Hamerly's bounds.

Vectors become integers and are cut into equal parts; each part position has a codebook
of integer entries.  Every part keeps its entry, one upper bound of the distance to it
and one lower bound of the distance to the second-nearest, written to the shared folder
with the integers from round to round.  When the entries move, the bounds move with
them; a part whose upper bound is strictly below the lower one, or below half the
distance from its entry to the nearest other, keeps its entry without a look at the
rest.  All others are compared with every entry in whole numbers, ties to the lower
index.  Bounds are floating-point numbers widened by 1e-12, far more than they are
rounded, so a part that keeps its entry has no tie.

A round is one pass over the table without a shuffle; what returns to the driver is one
sum and count an entry, whose number is that of the codebooks.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import Scratch, released

WIDE = 1e-12
SCALE = 4096
STATE = "ints array<long>, entry binary, upper binary, lower binary, summary array<long>"


@dataclass
class Codes:
    """rows: the caller's id and label, code and error; codebooks: part, entry, position; scans: parts that met all
    entries, by pass."""

    rows: DataFrame
    codebooks: list[list[list[int]]]
    scans: list[int]

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(x) for part in self.codebooks for entry in part for x in entry).encode()).hexdigest()


def squared(vectors: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to their own entries."""
    return ((vectors - entries) ** 2).sum(-1)


def moved(old: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry of one codebook: how far it has moved at most, and how far any other has."""
    far = np.sqrt(squared(old, new).astype(float)) * (1 + WIDE)
    others = np.array([max([*far[:k], *far[k + 1 :]], default=0.0) for k in range(len(far))])
    return far, others


def half_way(entries: np.ndarray) -> np.ndarray:
    """For each entry: half the distance to the nearest other at least."""
    d = np.sqrt(((entries[:, None] - entries[None]) ** 2).sum(-1).astype(float))
    np.fill_diagonal(d, np.inf)
    return d.min(1) / 2 * (1 - WIDE)


def nearest(vectors: np.ndarray, entries: np.ndarray, block: int = 4096) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index of the nearest entry (the lower of equals), its squared distance, and a lower bound of the
    second-nearest's distance."""
    out = []
    for at in range(0, len(vectors), block):
        d = ((vectors[at : at + block, None] - entries[None]) ** 2).sum(-1)
        k = d.argmin(1)
        row = np.arange(len(d))
        best = d[row, k]
        if len(entries) > 1:
            d[row, k] = np.iinfo(np.int64).max
            second = np.sqrt(d.min(1).astype(float)) * (1 - WIDE)
        else:
            second = np.full(len(d), np.inf)
        out.append((k, best, second))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def reassigned(vectors: np.ndarray, entries: np.ndarray, k: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> int:
    """Brings one part position's k, upper and lower up to date in place; the number of full scans."""
    limit = np.maximum(lower, half_way(entries)[k])
    open_ = np.flatnonzero(~(upper < limit))
    upper[open_] = np.sqrt(squared(vectors[open_], entries[k[open_]]).astype(float)) * (1 + WIDE)
    open_ = open_[~(upper[open_] < limit[open_])]
    if len(open_):
        k[open_], best, lower[open_] = nearest(vectors[open_], entries)
        upper[open_] = np.sqrt(best.astype(float)) * (1 + WIDE)
    return len(open_)


def kept_vectors(vectors: DataFrame, vector: str, parts: int) -> tuple[DataFrame, int]:
    """Rows whose vector is whole, with its components as integers in ``ints``, and their dimension (0: none)."""
    v = F.col(vector).cast("array<double>")
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = vectors.where(v.isNotNull() & whole & (F.size(v) > 0) & (F.size(v) % parts == 0)).withColumn("_v", v)
    first = good.select("vec_id", F.size("_v").alias("n"), "_v").orderBy(F.col("vec_id").asc_nulls_last(), "_v").limit(1).collect()
    if not first:
        return good.limit(0), 0
    dims = first[0]["n"]
    most = float(math.isqrt((1 << 61) // dims))
    ints = F.transform("_v", lambda x: F.floor(F.greatest(F.least(x * SCALE, F.lit(most)), F.lit(-most))).cast("long"))
    return good.where(F.size("_v") == dims).withColumn("ints", ints), dims


def compress(vectors: DataFrame, vector: str = "embedding", parts: int = 8, entries: int = 16, rounds: int = 6) -> Codes:
    """Codes of the vectors of ``vectors`` (vec_id, label and the vector; other columns are not carried).

    Left out: null vectors, those with null or non-finite components, and those whose length isn't a multiple of
    ``parts`` or differs from that of the first kept row.  First rows are those of the smallest vec_id (null last),
    equal ones by their components; rows that repeat an id are coded each.  Fewer rows than ``entries`` make smaller
    codebooks, none an empty result.  Components beyond isqrt(2**61 / dimension) after scaling count as that, so that
    all sums of squares are exact 64-bit numbers.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    fields = [StructField("vec_id", vectors.schema["vec_id"].dataType), StructField("label", vectors.schema["label"].dataType)]
    told = StructType([*fields, StructField("code", StringType()), StructField("error", LongType())])
    kept, dims = kept_vectors(vectors, vector, parts)
    if not dims:
        return Codes(spark.createDataFrame([], told), [[] for _ in range(parts)], [])
    width = dims // parts
    state = scratch.stored(kept.select("vec_id", "label", "ints"), "vectors")
    seeds = state.orderBy(F.col("vec_id").asc_nulls_last(), "ints").limit(entries).collect()
    books = np.array([r["ints"] for r in seeds], dtype=np.int64).reshape(len(seeds), parts, width).transpose(1, 0, 2).copy()
    moves, scans = None, []

    def passed(books: np.ndarray, moves, last: bool):
        size = books.shape[1]

        def step(batch, sums, counts):
            ints = batch.column(2).flatten().to_numpy().reshape(-1, parts, width)
            n = len(ints)
            if moves is None:
                k, upper, lower = np.zeros((n, parts), np.uint8), np.full((n, parts), np.inf), np.zeros((n, parts))
            else:
                k, upper, lower = (np.frombuffer(b"".join(batch.column(c).to_pylist()), kind).reshape(n, parts).copy() for c, kind in ((3, np.uint8), (4, float), (5, float)))
            scanned, error = 0, np.zeros(n, dtype=np.int64)
            for p in range(parts):
                own, u, low = k[:, p].astype(np.int64), upper[:, p].copy(), lower[:, p].copy()
                if moves is not None:
                    far, others = moves[p]
                    u, low = (u + far[own]) * (1 + WIDE), np.maximum(0, low - others[own]) * (1 - WIDE)
                scanned += reassigned(ints[:, p], books[p], own, u, low)
                k[:, p], upper[:, p], lower[:, p] = own, u, low
                if last:
                    error += squared(ints[:, p], books[p][own])
                else:
                    np.add.at(sums[p], own, ints[:, p])
                    counts[p] += np.bincount(own, minlength=size)
            return k, upper, lower, error, scanned

        def run(batches):
            sums, counts, scanned = np.zeros((parts, size, width), np.int64), np.zeros((parts, size), np.int64), 0
            some = None
            for batch in batches:
                if not batch.num_rows:
                    continue
                k, upper, lower, error, s = step(batch, sums, counts)
                scanned, some = scanned + s, batch
                if last:
                    code = [bytes(r).hex() for r in k]
                    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(code, pa.string()), pa.array(error)], names=told.names)
                else:
                    raw = [pa.array([r.tobytes() for r in x], pa.binary()) for x in (k, upper, lower)]
                    none = pa.nulls(batch.num_rows, pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(3)), *raw, none], names=names)
            if some is not None and not last:
                summary = np.concatenate([np.concatenate([counts[..., None], sums], axis=2).ravel(), [scanned]])
                null = [pa.nulls(1, c.type) for c in some.columns[:2]]
                empty = [pa.nulls(1, pa.list_(pa.int64())), *(pa.nulls(1, pa.binary()) for _ in range(3))]
                yield pa.RecordBatch.from_arrays([*null, *empty, pa.array([summary.tolist()], pa.list_(pa.int64()))], names=names)

        return released(run)

    schema = StructType([*fields, *StructType.fromDDL(STATE).fields])
    names = schema.names
    for _ in range(rounds):
        before, state = state, scratch.stored((state if moves is None else state.where("summary is null")).mapInArrow(passed(books, moves, False), schema), "bounds")
        scratch.drop(before)
        total = state.where("summary is not null").select(F.posexplode("summary").alias("at", "x")).groupBy("at").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x"))
        flat = [int(r["x"]) for r in sorted(total.collect(), key=lambda r: r["at"])]  # one number a component of the codebooks
        scans.append(flat.pop())
        old, books = books, books.copy()
        for p in range(parts):
            for e in range(books.shape[1]):
                at = (p * books.shape[1] + e) * (width + 1)
                if count := flat[at]:
                    books[p, e] = [x // count for x in flat[at + 1 : at + 1 + width]]
        moves = [moved(a, b) for a, b in zip(old, books, strict=True)]
    rows = scratch.stored((state if moves is None else state.where("summary is null")).mapInArrow(passed(books, moves, True), told), "codes")
    scratch.drop(state)
    return Codes(rows, books.tolist(), scans)


def op13_vector_codes(spark: SparkSession, vectors: DataFrame) -> DataFrame:
    """Codes and errors of all vectors, with the errors summed over equal labels (nulls together)."""
    found = compress(vectors)
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit((1 << 63) - 1).cast("decimal(38,0)")).cast("long")
    by_label = found.rows.groupBy(F.col("label").alias("_label")).agg(total.alias("label_error"))
    both = found.rows.join(by_label, F.col("label").eqNullSafe(F.col("_label")))
    return both.select("vec_id", "code", "error", "label_error", F.lit(found.digest()).alias("codebooks_sha256"))


def _sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """The rounds one after another, each part against every entry."""
    steps = [
        f"""kept AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"part AS MATERIALIZED (SELECT vec_id, label, p, v[p * (len(v) // {parts}) + 1 : (p + 1) * (len(v) // {parts})] AS v FROM kept, range({parts}) r(p))",
        f"first AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS k FROM kept ORDER BY vec_id LIMIT {entries})",
        "c0 AS MATERIALIZED (SELECT p, k, v FROM part JOIN first USING (vec_id))",
    ]
    distance = "CAST(list_sum(list_transform(list_zip(a.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT)"
    for t in range(rounds + 1):
        steps.append(f"a{t} AS MATERIALIZED (SELECT a.vec_id, any_value(a.label) AS label, a.p, any_value(a.v) AS v, min({{'d': {distance}, 'k': c.k}}) AS m FROM part a JOIN c{t} c ON a.p = c.p GROUP BY a.vec_id, a.p)")
        if t < rounds:
            mean = f"SELECT p, k, list(x ORDER BY i) AS v FROM (SELECT p, m.k AS k, i, CAST(floor(sum(v[i]) / count(*)) AS BIGINT) AS x FROM a{t}, range(1, len(v) + 1) r(i) GROUP BY p, m.k, i) GROUP BY p, k"
            steps.append(f"c{t + 1} AS MATERIALIZED (SELECT c.p, c.k, coalesce(n.v, c.v) AS v FROM c{t} c LEFT JOIN ({mean}) n ON c.p = n.p AND c.k = n.k)")
    steps.append(f"book AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, k)) AS h FROM c{rounds})")
    steps.append(f"code AS (SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', CAST(m.k AS INTEGER)), '' ORDER BY p) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id)")
    return "WITH " + ",\n".join(steps) + "\nSELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM code, book"


#: For tables whose vec_id is unique, as in the corpus.
OP13_SQL = _sql()
