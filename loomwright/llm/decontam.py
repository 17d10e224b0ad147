"""Benchmark decontamination (5): SimHash of item-sized windows, verified exactly.

Words are runs of letters and digits in lower case.  For a benchmark item of L
words every window of L words of a document that shares at least one 5-word shingle
with the item (others have similarity 0) gets a 64-bit SimHash.  A multi-index over
eight blocks, each probed within 2 bits, finds every item of that length within
Hamming distance ``RADIUS`` = 23: by the pigeonhole principle some block then differs
in at most 2 bits.  At similarity 0.8 the expected distance is below 10, so a radius
of 23 loses nothing in practice.  Candidates are verified by the weighted Jaccard
similarity of their shingles (weights: how often each stands), 0.8 or more.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import numbered_columns, quoted, released, small_batches, stored
from .textnum import NON_WORD, shingles, word_hashes

RADIUS, WORDS = 23, 5
_NEAR = np.array([0, *(1 << i for i in range(8)), *((1 << i) | (1 << j) for i, j in combinations(range(8), 2))], dtype=np.uint8)
_BITS = np.arange(64, dtype=np.uint64)


def _signs(hashes: np.ndarray) -> np.ndarray:
    """+1 or -1 for each bit of each hash."""
    return (((hashes[:, None] >> _BITS) & np.uint64(1)).astype(np.int32) << 1) - 1


def _pack(sums: np.ndarray) -> np.ndarray:
    """Rows of 64 sums to fingerprints (sum >= 0 sets the bit)."""
    return np.packbits(sums >= 0, axis=1, bitorder="little").view(np.uint64).ravel()


def simhash(hashes: np.ndarray) -> int:
    return int(_pack(_signs(hashes).sum(0, keepdims=True))[0])


def weighted_similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard of two multisets of shingles."""
    x, n = np.unique(a, return_counts=True)
    y, m = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    low = int(np.minimum(n[i], m[j]).sum())
    return low / (len(a) + len(b) - low) if len(a) + len(b) else 0.0


class Index:
    """Benchmark items by length: shingles, fingerprints, block tables.  Items are told apart by their place in ``items``."""

    def __init__(self, items: list[tuple[int | None, str | None]]):
        self.lengths: dict[int, dict] = {}
        self.names = [item_id for item_id, _ in items]
        found = []
        for place, (_, text) in enumerate(items):
            words = word_hashes((text or "").lower(), NON_WORD)
            if len(words):
                found.append((place, len(words), shingles(words, WORDS)))
        keys, owner = [], []
        for n in sorted({x[1] for x in found}):
            own = [x for x in found if x[1] == n]
            prints = np.array([simhash(s) for _, _, s in own], dtype=np.uint64)
            table = np.zeros((8, 256, len(own)), dtype=bool)
            for b in range(8):
                value = (prints >> np.uint64(8 * b)).astype(np.uint8)
                for j, v in enumerate(value):
                    table[b, v ^ _NEAR, j] = True
            self.lengths[n] = {"ids": [x[0] for x in own], "sets": [x[2] for x in own], "prints": prints, "table": table}
            for _, _, s in own:
                keys.append(s)
                owner.append(np.full(len(s), n))
        keys = np.concatenate(keys) if keys else np.empty(0, np.uint64)
        owner = np.concatenate(owner) if owner else np.empty(0, int)
        order = np.argsort(keys, kind="stable")
        self.keys, self.owner = keys[order], owner[order]  # shingle -> lengths of items that hold it
        self.maybe = np.zeros(1 << 20, dtype=bool)
        self.maybe[keys >> np.uint64(44)] = True
        self.widths = sorted({min(n, WORDS) for n in self.lengths})

    def search(self, text: str | None, least: float = 0.8) -> list[tuple[int | None, int, float]]:
        """(item_id, first word, similarity) of the best window for each item found, in the order of the items."""
        words = word_hashes((text or "").lower(), NON_WORD)
        best: dict[int, tuple[float, int]] = {}
        for k in self.widths:
            if len(words) >= k:
                self._search(words, shingles(words, k), k, least, best)
        return [(self.names[i], at, s) for i, (s, at) in sorted(best.items())]

    def _search(self, words, doc, k, least, best) -> None:
        hit = np.flatnonzero(self.maybe[doc >> np.uint64(44)])
        if not len(hit):
            return
        lo, hi = np.searchsorted(self.keys, doc[hit], "left"), np.searchsorted(self.keys, doc[hit], "right")
        hit, lo, hi = hit[hi > lo], lo[hi > lo], hi[hi > lo]
        starts: dict[int, list] = {}
        for q, a, b in zip(hit.tolist(), lo.tolist(), hi.tolist(), strict=True):
            for n in set(self.owner[a:b].tolist()):
                if min(n, WORDS) == k:
                    starts.setdefault(n, []).append(q)
        for n, hits in starts.items():
            m = max(1, n - WORDS + 1)  # shingles in a window
            last = max(0, len(doc) - m)
            hits = np.unique(hits)  # of the windows that hold a hit, the starts: a union of ranges
            edge = np.zeros(last + 2, dtype=np.int64)
            np.add.at(edge, np.clip(hits - m + 1, 0, last), 1)
            np.add.at(edge, np.minimum(hits, last) + 1, -1)
            reach = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
            own = self.lengths[n]
            for at in range(0, len(reach), 4096):
                self._windows(doc, reach[at : at + 4096], m, own, least, best)

    def _windows(self, doc, starts, m, own, least, best) -> None:
        a, b = int(starts[0]), int(min(starts[-1] + m, len(doc)))
        if b - a > 4 * len(starts) + 4 * m:  # far apart: in two parts, so memory follows the windows
            if len(starts) > 1:
                half = len(starts) // 2
                self._windows(doc, starts[:half], m, own, least, best)
                self._windows(doc, starts[half:], m, own, least, best)
                return
        total = np.zeros((b - a + 1, 64), dtype=np.int32)
        np.cumsum(_signs(doc[a:b]), axis=0, out=total[1:])
        end = np.minimum(starts + m, len(doc))
        prints = _pack(total[end - a] - total[starts - a])
        cand = np.zeros((len(starts), len(own["ids"])), dtype=bool)
        for block in range(8):
            cand |= own["table"][block, (prints >> np.uint64(8 * block)).astype(np.uint8)]
        for i, j in np.argwhere(cand):
            if int(prints[i] ^ own["prints"][j]).bit_count() <= RADIUS:
                s = weighted_similarity(doc[starts[i] : end[i]], own["sets"][j])
                if s >= least:
                    item, at = own["ids"][j], int(starts[i])
                    if item not in best or (s, -at) > (best[item][0], -best[item][1]):
                        best[item] = (s, at)


_HITS = "array<struct<item_id:bigint,first_word:bigint,similarity:double>>"


def mark(docs: DataFrame, benchmark: DataFrame, least: float = 0.8, block_items: int = 20_000, block_chars: int = 1 << 24, name: str = "hits") -> DataFrame:
    """The columns of ``docs`` with ``name`` (replaced if it is there): item_id, first_word, similarity of each item found.

    Null, empty and wordless texts hold nothing; wordless items are found nowhere.  An
    item is a row of ``benchmark``, whatever its id: null ids are found as null, texts
    that share an id each, rows that repeat whole once.  A document shorter than an item
    is one window.  Items are taken some ``block_items`` or ``block_chars`` characters at
    a time, whichever is less, so what reaches a worker is bounded; each block is a pass
    over the documents, which are then written once with a row number, and the hits of
    each pass, too.
    """
    spark = docs.sparkSession
    small_batches(spark)
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("text is not null").distinct()
    size = items.agg(F.count("*").alias("rows"), F.sum(F.length("text").cast("long")).alias("chars")).first()
    blocks = max(1, -(-size["rows"] // block_items), -(-(size["chars"] or 0) // block_chars))

    def index(k):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        return spark.sparkContext.broadcast(Index(sorted(((r[0], r[1]) for r in part.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))))

    kept = [c for c in docs.columns if c != name]
    if blocks == 1:
        return _marked(docs.select(*map(quoted, kept)), index(0), least, name)
    rows = stored(docs.select(*[F.col(quoted(c)).alias(f"c{k}") for k, c in enumerate(kept)], F.monotonically_increasing_id().alias("row")), "numbered-documents")
    found = None
    for k in range(blocks):
        ix = index(k)
        own = _marked(rows.select("row", F.col(f"c{kept.index('text')}").alias("text")), ix, least, "hits").where(F.size("hits") > 0)
        own = stored(own.select("row", "hits"), "hits")
        found = own if found is None else found.unionByName(own)
        ix.unpersist()
    all_hits = found.groupBy("row").agg(F.array_sort(F.flatten(F.collect_list("hits"))).alias("hits"))
    out = rows.join(all_hits, "row", "left")
    return out.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(kept)], F.coalesce("hits", F.array().cast(_HITS)).alias(name))


def _marked(df: DataFrame, index, least: float, name: str) -> DataFrame:
    names, text_at = df.columns, df.columns.index("text")
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("first_word", pa.int64()), ("similarity", pa.float64())]))

    def find(batches):
        ix = index.value
        for batch in batches:
            new = []
            for at in range(0, batch.num_rows, 256):
                new += [[{"item_id": i, "first_word": w, "similarity": s} for i, w, s in ix.search(t, least)] for t in batch.column(text_at).slice(at, 256).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(new, kind)], names=[*names, name])

    hits = df.select(F.array().cast(_HITS).alias(name)).schema.fields
    return numbered_columns(df).mapInArrow(released(find), StructType([*df.schema.fields, *hits]))


def decontaminate(docs: DataFrame, benchmark: DataFrame, least: float = 0.8) -> DataFrame:
    """``docs`` without the rows that hold a benchmark item."""
    name = "hits"
    while name in docs.columns:  # a caller's own column stays
        name += "_"
    return mark(docs, benchmark, least, name=name).where(F.size(name) == 0).drop(name)


def op5_decontamination(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row a document and item it holds: doc_id, item_id, first_word, similarity."""
    found = mark(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), benchmark).drop("text")
    return found.select("doc_id", F.inline("hits"))
