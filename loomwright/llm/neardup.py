"""Embedding near-dedup (6): collision-counting projections.

Equal vectors of a label are one node.  Unit vectors are projected on ``LINES`` random
lines.  For a pair at cosine ``least`` the difference on a line is near normal with
deviation d = sqrt((2 - 2 least) / dimension); two vectors collide on a line if they
are within ``WINDOW`` deviations of each other there (the window is centred on the
query).  A pair whose collisions reach the calibrated count - which a pair at the
threshold misses with probability below ``MISS`` - is verified by its cosine in
double precision.

The first line sorts the nodes into blocks of a bounded size (a range partitioning);
only block pairs whose ranges come within ``REACH`` deviations meet in a task.  There
every line is sorted, the window around each query is a range of places in that order,
and a pair's collisions are the lines on which the one's place lies in the other's
window.  Tasks return counts of links and a spanning forest, never the pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, released
from .graph import components

LINES, WINDOW, REACH, MISS, BLOCK = 24, 1.5, 6.0, 1e-3, 4096


def lines(dimension: int, n: int = LINES, seed: int = 6) -> np.ndarray:
    a = np.random.default_rng([seed, dimension]).standard_normal((dimension, n))
    return a / np.linalg.norm(a, axis=0)


def needed_count(n: int = LINES, window: float = WINDOW, miss: float = MISS) -> int:
    """The largest count that Binomial(n, P(|N| <= window)) stays below with probability at most ``miss``."""
    p, below = math.erf(window / math.sqrt(2)), 0.0
    for k in range(n + 1):
        below += math.comb(n, k) * p**k * (1 - p) ** (n - k)
        if below > miss:
            return k
    return n


def deviation(dimension: int, least: float) -> float:
    return math.sqrt((2 - 2 * least) / dimension)


def valid(vector) -> F.Column:
    """Not null or empty, without null or non-finite components, not zero."""
    v = F.transform(vector, lambda x: x.cast("double"))
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & fine & F.exists(v, lambda x: x != 0), F.lit(False))


def near_duplicates(vectors: DataFrame, least: float = 0.93, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row.

    Vectors are compared only where labels are equal and not null; others, and invalid
    vectors, link with nothing.  Vectors of unlike dimensions don't link.
    """
    scratch = Scratch(vectors.sparkSession)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    good = valid(F.col("embedding")) & F.col("label").isNotNull()
    # 128 bits of hash tell vectors apart; a node's number is given once, where the nodes are written
    hashed = {"h1": F.when(good, F.xxhash64("label", "embedding")), "h2": F.when(good, F.xxhash64("embedding", F.lit(6), "label"))}
    rows = rows.withColumns(hashed)
    nodes = rows.where("h1 is not null").groupBy("h1", "h2").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("embedding").alias("v"))
    nodes = scratch.stored(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")

    def project(batches):
        for b in batches:
            offsets, values = b.column(4).offsets.to_numpy(), b.column(4).values.to_numpy()
            v = [values[x:y] for x, y in zip(offsets, offsets[1:])]
            unit, first = [], []
            for x in v:
                x = x / np.abs(x).max()
                unit.append(x / np.linalg.norm(x))
                first.append(float(unit[-1] @ lines_of(len(x))[:, 0]))
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(unit, pa.list_(pa.float64())), pa.array([len(x) for x in v], pa.int32()), pa.array(first)], names=["node", "least", "copies", "label", "v", "dim", "p"])

    table: dict[int, np.ndarray] = {}

    def lines_of(dim):
        if dim not in table:
            table[dim] = lines(dim)
        return table[dim]

    placed = scratch.stored(nodes.select("node", "least", "copies", "label", "v").mapInArrow(project, "node long, least long, copies long, label long, v array<double>, dim int, p double"), "projected")
    total = placed.count()
    unplaced, placed = placed, scratch.stored(placed.repartitionByRange(max(1, -(-total // block)), "label", "dim", "p").withColumn("block", F.spark_partition_id()), "blocks")
    scratch.drop(unplaced)
    spans = placed.groupBy("label", "dim", "block").agg(F.min("p").alias("low"), F.max("p").alias("high"))
    a, b = spans.alias("a"), spans.alias("b")
    reach = REACH * F.sqrt(F.lit(2 - 2 * least) / F.col("a.dim"))
    near = a.join(b, (F.col("a.label") == F.col("b.label")) & (F.col("a.dim") == F.col("b.dim")) & (F.col("a.block") <= F.col("b.block")) & (F.col("b.low") - F.col("a.high") <= reach) & (F.col("a.low") - F.col("b.high") <= reach))
    near = near.select(F.col("a.label").alias("label"), F.col("a.dim").alias("dim"), F.col("a.block").alias("x"), F.col("b.block").alias("y"))
    keyed = near.select("label", "dim", F.col("x").alias("block"), F.struct("x", "y").alias("pair"), F.lit(0).alias("side")).unionByName(near.where("x <> y").select("label", "dim", F.col("y").alias("block"), F.struct("x", "y").alias("pair"), F.lit(1).alias("side")))
    dealt = placed.join(keyed, ["label", "dim", "block"]).select("label", "dim", F.col("pair.x").alias("x"), F.col("pair.y").alias("y"), "side", "node", "copies", "v")
    need = needed_count()

    def links_of(key, held):
        """Numbers of links and a spanning forest of one pair of blocks."""
        sides = [[np.concatenate(part) for part in zip(*side, strict=True)] for side in held if side]
        if not sides or (key[2] != key[3] and len(sides) < 2):
            return
        same = key[2] == key[3]
        (ids_a, copies_a, a), (ids_b, copies_b, b) = sides[0], sides[-1]
        axes, width = lines_of(a.shape[1]), WINDOW * deviation(a.shape[1], least)
        rank, low, high = [], [], []
        kind = np.uint16 if len(b) < 1 << 16 else np.uint32
        for k in range(LINES):  # each line sorted: places of one side, and the window around each vector of the other
            on_line, mine = b @ axes[:, k], a @ axes[:, k]
            order = np.argsort(on_line, kind="stable")
            place = np.empty(len(order), dtype=kind)
            place[order] = np.arange(len(order), dtype=kind)
            rank.append(place)
            low.append(np.searchsorted(on_line[order], mine - width, "left").astype(kind))
            high.append(np.searchsorted(on_line[order], mine + width, "right").astype(kind))
        links = [np.zeros(len(ids_a), dtype=np.int64), np.zeros(len(ids_b), dtype=np.int64)]
        root = {}

        def find(n):
            while root.get(n, n) != n:
                n = root[n]
            return n

        for s in range(0, len(a), 256):
            hits = np.zeros((min(256, len(a) - s), len(b)), dtype=np.uint8)
            for k in range(LINES):  # unsigned: a place before the window wraps to a large number
                hits += (rank[k][None] - low[k][s : s + 256, None]) < (high[k] - low[k])[s : s + 256, None]
            i, j = np.nonzero(hits >= need)
            i = i + s
            if same:
                i, j = i[i < j], j[i < j]
            for at in range(0, len(i), 1 << 16):
                x, y = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
                near = np.einsum("ij,ij->i", a[x], b[y]) >= least
                x, y = x[near], y[near]
                np.add.at(links[0], x, copies_b[y])
                np.add.at(links[1], y, copies_a[x])
                for u, v in zip(ids_a[x].tolist(), ids_b[y].tolist(), strict=True):
                    if (p := find(u)) != (q := find(v)):
                        root[max(p, q)] = min(p, q)
        out = [(int(n), int(c), False) for own, got in zip((ids_a, ids_b), links, strict=True) for n, c in zip(own, got, strict=True) if c]
        out += [(n, find(n), True) for n in root]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.bool_()), strict=True)], names=["a", "b", "edge"])

    def count(batches):
        at, held = None, ([], [])
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.array([c.to_numpy() for c in batch.columns[:4]])
            side, node, copies, lists = batch.column(4).to_numpy(), batch.column(5).to_numpy(), batch.column(6).to_numpy(), batch.column(7)
            offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy()
            new = np.append(True, (key[:, 1:] != key[:, :-1]).any(0) | (side[1:] != side[:-1]))
            cuts = np.append(np.flatnonzero(new), batch.num_rows)
            for x, y in zip(cuts, cuts[1:]):
                own = tuple(key[:, x].tolist())
                if own != at:
                    if at is not None:
                        yield from links_of(at, held)
                    at, held = own, ([], [])
                held[side[x]].append((node[x:y], copies[x:y], values[offsets[x] : offsets[y]].reshape(y - x, own[1])))
        if at is not None:
            yield from links_of(at, held)

    found = scratch.stored(dealt.repartition("label", "dim", "x", "y").sortWithinPartitions("label", "dim", "x", "y", "side").mapInArrow(released(count), "a long, b long, edge boolean"), "links")
    scratch.drop(placed)
    links = found.where("not edge").groupBy(F.col("a").alias("node")).agg(F.sum("b").alias("others"))
    roots = components(found.where("edge").select("a", "b"))
    named = scratch.stored(nodes.select("node", "h1", "h2", "least", "copies").join(links, "node", "left").join(roots, "node", "left").select("h1", "h2", "least", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "node").alias("root")), "named")
    comp = named.groupBy("root").agg(F.min("least").alias("component_id"))
    done = rows.select("vec_id", "h1", "h2").join(named.join(comp, "root").select("h1", "h2", "n_links", "component_id"), ["h1", "h2"], "left")
    scratch.drop(nodes, found)
    return done.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op6_near_duplicates(spark: SparkSession, vectors: DataFrame) -> DataFrame:
    return near_duplicates(vectors)
