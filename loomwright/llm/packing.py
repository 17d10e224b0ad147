"""Best-fit packing (4): a configuration linear program over the length histogram.

Documents become pieces of at most ``capacity`` tokens.  Only the histogram of
piece lengths (at most ``capacity`` numbers, whatever the corpus holds) reaches the
driver.  There the covering program "fewest sequences so that every length is covered"
is solved by multiplicative weights: in each round a knapsack dynamic program prices all
configurations, and every length that is behind its share of the round is brought up by
one that is nearly the best with it.  Many are, as most rooms can be filled exactly; one
is drawn, so that no filler is used up alone.  The fractional numbers are rounded to
whole sequences, the longest lengths first, and what is left is solved again.  Placing
the pieces is then arithmetic on (length, rank).
"""

from __future__ import annotations

import logging

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import released, stored
from .tokens import crc32_ids, default_vocabulary, encoder

CAPACITY = 2048


def pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None, end_id: int = 0, known: int = 1 << 20) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, part, local_rank of every piece.

    Null and empty texts hold only the end id.  Rows that repeat a doc_id are
    documents of their own.  ``local_rank`` counts pieces of one length in one part.
    """
    vocabulary = vocabulary or default_vocabulary()

    def cut(batches):
        enc, seen = encoder(vocabulary, known), np.zeros(capacity + 1, dtype=np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                out = []
                parts = some.column(2).to_pylist()
                for doc_id, ids, part in zip(some.column(0).to_pylist(), enc.encode_all(some.column(1)), parts, strict=True):
                    ids = np.append(ids, np.uint32(end_id)).astype(np.uint32)
                    for k, a in enumerate(range(0, len(ids), capacity)):
                        own = ids[a : a + capacity]
                        n = len(own)
                        out.append((doc_id, k, a, n, crc32_ids(own), part, int(seen[n])))
                        seen[n] += 1
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "local_rank"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"), F.spark_partition_id().alias("part"))
    return rows.mapInArrow(released(cut), "doc_id long, piece int, start long, length long, ids_crc32 long, part int, local_rank long")


def _knapsack(price: np.ndarray, capacity: int) -> np.ndarray:
    """Highest total price within each room 0..capacity: unbounded knapsack over 1..capacity; ``price[l]`` <= 0
    leaves a length out."""
    lengths = np.flatnonzero(price > 0)
    value = np.zeros(capacity + 1)
    worth, upto = price[lengths], np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        n = upto[c]
        value[c] = value[c - 1]
        if n:
            value[c] = max(value[c], float((value[c - lengths[:n]] + worth[:n]).max()))
    return value


def _configuration(first: int, value: np.ndarray, price: np.ndarray, lengths: np.ndarray, wanted: np.ndarray, capacity: int, random: np.random.Generator, slack: float) -> np.ndarray:
    """A configuration that holds ``first`` and whose price is within ``slack`` of the best that does.

    The table of the knapsack is walked back; of the lengths that keep the price within the slack one is
    drawn, in proportion to what is wanted of it and to the fourth power of the length, which spares short
    pieces for the gaps that only they fill.
    """
    out, room = [first], capacity - first
    while room:
        some = lengths[: np.searchsorted(lengths, room, side="right")]
        loss = value[room] - (value[room - some] + price[some])
        near = loss <= slack + 1e-12
        weight = np.where(near, some.astype(float) ** 4, 0.0)
        if (weight * wanted[some]).any():
            weight *= wanted[some]
        elif value[room] - value[room - 1] <= slack + 1e-12 or not near.any():
            slack -= value[room] - value[room - 1]  # leave one place free
            room -= 1
            continue
        upto = np.cumsum(weight)
        k = min(int(np.searchsorted(upto, random.random() * upto[-1], side="right")), len(some) - 1)
        out.append(int(some[k]))
        slack -= max(0.0, float(loss[k]))
        room -= out[-1]
    return np.array(sorted(out, reverse=True), dtype=np.int64)


def _fill(rest: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Whole configurations for the open lengths: the longest first, the gap filled exactly where possible."""
    out, rest = [], rest.copy()
    while rest.any():
        left, own, have = capacity, [], rest.copy()
        first = int(np.flatnonzero(have)[-1])
        own.append(first)
        have[first] -= 1
        left -= first
        # subset sums of the open lengths (each as often as it is there) reaching the fullest total
        while left:
            fit = np.flatnonzero(have[: left + 1])
            if not len(fit):
                break
            if len(own) >= 2 or have.sum() < 3:
                nxt = int(fit[-1])
            else:  # the pair that fills best, else the longest
                other = left - fit
                under = np.maximum.accumulate(np.where(have[: left + 1] > 0, np.arange(left + 1), 0))
                best = fit + under[other]
                nxt = int(fit[len(fit) - 1 - int(np.argmax(best[::-1]))])
            own.append(nxt)
            have[nxt] -= 1
            left -= nxt
        kinds, counts = np.unique(own, return_counts=True)
        times = int(np.min(rest[kinds] // counts))
        out.append((np.array(own, dtype=np.int64), times))
        rest[kinds] -= counts * times
    return out


def cover(need: np.ndarray, capacity: int, rounds: int = 12, rate: float = 0.02, slack: float = 5e-4, seed: int = 4) -> tuple[dict[int, dict[bytes, float]], float, float]:
    """A fractional cover: for each length the configurations that were opened for it with their numbers of
    sequences; their total; and a lower bound of any cover's total.

    Multiplicative weights: a length's price is its room times exp(-rate x how far it is ahead of the round's
    share of its pieces).  In each round a knapsack over these prices is solved, and each length that is
    behind, the longest first, is brought up by a configuration within ``slack`` of the best that holds it.
    Prices at which no configuration is worth more than 1 bound the total from below.
    """
    random = np.random.default_rng(seed)
    rows = np.flatnonzero(need)
    room = np.arange(capacity + 1) / capacity
    covered = np.zeros(capacity + 1)
    found: dict[int, dict[bytes, float]] = {}
    bound = float((need * room).sum())
    for k in range(1, rounds + 1):
        ahead = np.zeros(capacity + 1)
        ahead[rows] = covered[rows] / need[rows] - (k - 1) / rounds
        price = np.where(need > 0, room * np.exp(-rate * ahead), 0.0)
        value = _knapsack(price, capacity)
        bound = max(bound, float((need * price).sum() / value[capacity]))
        wanted = np.maximum(need * (k / rounds) - covered, 0.0)
        for length in rows[::-1].tolist():
            if wanted[length] <= 1e-9:
                continue
            own = _configuration(length, value, price, rows, wanted, capacity, random, slack)
            kinds, counts = np.unique(own, return_counts=True)
            step = float(wanted[length]) / int(counts[kinds == length][0])
            column = found.setdefault(length, {})
            column[own.tobytes()] = column.get(own.tobytes(), 0.0) + step
            covered[kinds] += counts * step
            wanted[kinds] = np.maximum(wanted[kinds] - counts * step, 0.0)
    return found, sum(sum(c.values()) for c in found.values()), bound


def configurations(histogram: dict[int, int], capacity: int = CAPACITY, programs: int = 12, rates: tuple[float, ...] = (0.02, 0.1, 0.5, 2.0), gap: float = 1e-3) -> tuple[list[tuple[np.ndarray, int]], int, float]:
    """(lengths of a configuration, number of sequences) that hold the histogram exactly; how many sequences
    the program gave; and the bound below which no packing can be.

    Rounding: the longest lengths first, each takes the configurations that were opened for it, most used
    first, in whole numbers and as long as pieces are left for them.  What is left is a smaller program of
    its own, until one gives nothing; the few pieces left then are filled in, the longest first.
    Lengths that fill sequences in many ways need small steps of the weights; few lengths that compete for
    the same fillers need large ones.  So the steps ``rates`` are tried in turn until a packing is within
    ``gap`` of the bound; where none is, the smallest packing counts.
    """
    if len(rates) > 1:
        tried, least = [], 0.0
        for rate in rates:
            tried.append(configurations(histogram, capacity, programs, (rate,)))
            least = max(least, tried[-1][2])
            if sum(times for _, times in tried[-1][0]) <= np.ceil(least * (1 + gap)):
                break
        found, by_program, _ = min(tried, key=lambda x: sum(times for _, times in x[0]))
        return found, by_program, least
    need = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in histogram.items():
        need[length] = n
    out: list[tuple[np.ndarray, int]] = []
    full = int(need[capacity])
    if full:
        out.append((np.array([capacity]), full))
        need[capacity] = 0
    least, by_program = 0.0, 0
    for attempt in range(programs):
        if not need.any():
            break
        found, _, bound = cover(need, capacity, rate=rates[0], seed=4 + attempt)
        least, before = least or bound, by_program
        for length in sorted(found, reverse=True):
            for key, x in sorted(found[length].items(), key=lambda c: -c[1]):
                own = np.frombuffer(key, dtype=np.int64)
                kinds, counts = np.unique(own, return_counts=True)
                times = int(min(np.ceil(x - 1e-9), np.min(need[kinds] // counts)))
                if times > 0:
                    out.append((own, times))
                    need[kinds] -= counts * times
                    by_program += times
        if by_program == before:
            break
    out += _fill(need, capacity)
    total = sum(times for _, times in out)
    logging.getLogger(__name__).info("packing: %d sequences, %d full pieces, %d by the program; bound %.1f", total, full, by_program, full + least)
    return out, by_program, full + least


def pack(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None, end_id: int = 0, known: int = 1 << 20) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    ``known`` bounds the pieces of text whose ids a worker remembers.
    """
    spark = docs.sparkSession
    rows = stored(pieces(docs, capacity, vocabulary, end_id, known), "pieces")
    counts = rows.groupBy("part", "length").agg(F.count("*").alias("n"))
    earlier = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = stored(counts.select("part", "length", "n", earlier.alias("before")), "piece-counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    place = _placement(configurations(histogram, capacity)[0], capacity)

    def put(batches):
        first, count, base, slot_at, slots = place
        for batch in batches:
            length = batch.column(3).to_numpy()
            rank = batch.column(5).to_numpy()
            k = np.empty(len(rank), dtype=np.int64)
            for n in np.unique(length):
                own = length == n
                k[own] = slot_at[n] + np.searchsorted(first[slot_at[n] : slot_at[n + 1]], rank[own], side="right") - 1
            within = rank - first[k]
            sequence, offset = base[k] + within // count[k], slots[k] + (within % count[k]) * length
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    # parts x lengths rows grow with the corpus: slim rows are sorted to meet them, and nothing is broadcast
    ranked = rows.join(counts.hint("merge"), ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("local_rank")).alias("rank"))
    return ranked.mapInArrow(released(put), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def _placement(found: list[tuple[np.ndarray, int]], capacity: int):
    """For each length, in order of rank: first rank, copies a sequence, first sequence, first offset."""
    rows: list[list[tuple[int, int, int, int]]] = [[] for _ in range(capacity + 2)]
    ranks, sequences = np.zeros(capacity + 1, dtype=np.int64), 0
    for own, times in found:
        kinds, counts = np.unique(own, return_counts=True)
        at = 0
        for n, c in zip(kinds.tolist()[::-1], counts.tolist()[::-1], strict=True):
            rows[n].append((int(ranks[n]), c, sequences, at))
            ranks[n] += c * times
            at += n * c
        sequences += times
    flat = np.array([r for group in rows for r in group], dtype=np.int64).reshape(-1, 4)
    return (*(np.ascontiguousarray(x) for x in flat[:, :3].T), np.append(0, np.cumsum([len(g) for g in rows])), np.ascontiguousarray(flat[:, 3]))


def op4_pack(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return pack(docs)
