"""Substring dedup (11): documents parsed relative to the indexed blocks of the whole corpus.

A document is cut into blocks that depend on its words alone: each window of ``window``
words belongs to the place of its smallest seed (a hash of ``seed`` words, the leftmost
of equals), and a block is what the windows of one place cover.  All blocks of all
documents are the reference; its index is a table of (seed, block) with how often each
stands.  The parse takes a document's blocks from left to right: blocks that stand
elsewhere chain into one factor of the relative Lempel-Ziv parse, of a window's length
at least.  A factor ends where a block stands nowhere else while its seed does.  There,
and only there, the windows of both kinds of blocks are looked up one by one, those of
equal blocks once, as a window across a factor's boundary may stand elsewhere, too.  What
factors and such windows cover is repeated.

Nothing is paired: lookups are counts and joins on hashes, whose hot keys are counted
before they are shuffled and split by skew joins.  Seeds that stand once, which are most,
leave before texts are read again.
Blocks, seeds and windows are told apart by 64-bit hashes, windows only among those of one seed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import Scratch, columns, numbered_columns, quoted, released, small_batches
from .textnum import U, Prefixes, exact_words, mix

WINDOW, SEED = 35, 12
_PLACE = U((1 << 28) - 1)  # of a word in its text; the other bits order the seeds


def smallest(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` keys in a row."""
    have = 1
    while 2 * have <= width:
        keys, have = np.minimum(keys[:-have], keys[have:]), 2 * have
    return np.minimum(keys[: len(keys) - (width - have)], keys[width - have :]) if width > have else keys


def blocks(words: np.ndarray, window: int = WINDOW, seed: int = SEED) -> tuple[np.ndarray, ...]:
    """Of the blocks of a text's word hashes: first window, number of windows, seed, block."""
    n = len(words)
    if n < window:
        return (np.empty(0, np.int64),) * 4
    sums, at = Prefixes(words), np.arange(n - seed + 1)
    seeds = sums.spans(at, at + seed)
    place = (smallest((seeds & ~_PLACE) | at.astype(U), window - seed + 1) & _PLACE).astype(np.int64)
    first = np.concatenate([[0], np.flatnonzero(np.diff(place)) + 1])
    after = np.append(first[1:], len(place))
    name = mix(sums.spans(first, after + window - 1) + (place[first] - first).astype(U))
    return first, after - first, seeds[place[first]].view(np.int64), name.view(np.int64)


def encoded(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _blocks_of_rows(window: int, seed: int):
    def run(batches):
        for batch in batches:
            k1, k2 = (batch.column(c).to_numpy() for c in (0, 1))
            found = [blocks(exact_words(encoded(t)), window, seed) for t in batch.column(2).to_pylist()]
            times = [len(f[0]) for f in found]
            first, width, seeds, names = (np.concatenate(x) for x in zip(*found, strict=True))
            arrays = [np.repeat(k1, times), np.repeat(k2, times), first.astype(np.int32), width.astype(np.int32), seeds, names]
            yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], names=["k1", "k2", "first", "width", "seed", "block"])

    return run


def _windows_of_rows(window: int):
    def run(batches):
        done = set()  # copies of a text that meet in a task are looked at once
        for batch in batches:
            for k1, k2, text, todo in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                if (k1, k2) in done:
                    continue
                done.add((k1, k2))
                first, width, seeds, names = (np.array([t[c] for t in todo], dtype=np.int64) for c in ("first", "width", "seed", "block"))
                sums, place = Prefixes(exact_words(encoded(text))), np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width)
                at = np.repeat(first, width) + place
                hashes = sums.spans(at, at + window).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(seeds, width)), pa.array(hashes), pa.array(np.repeat(names, width)), pa.array(place.astype(np.int32))], names=["seed", "window", "block", "place"])

    return run


def keyed(docs: DataFrame) -> DataFrame:
    """All columns of ``docs`` as c0, c1 and so on, with a key of 128 bits of the text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = docs.select(*columns(docs), text.alias("_text"))
    own = numbered_columns(own).withColumnRenamed(f"c{len(docs.columns)}", "text")
    return own.select("*", F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(7), "text").alias("k2"))


def repeated_windows(docs: DataFrame, scratch: Scratch, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """k1, k2 (of a text), marks: first window of a block, and a bit for each of its windows that stands elsewhere."""
    texts = keyed(docs).select("k1", "k2", "text")
    all_blocks = scratch.stored(texts.mapInArrow(released(_blocks_of_rows(window, seed)), "k1 long, k2 long, first int, width int, seed long, block long"), "blocks")
    seeds = all_blocks.groupBy("seed").agg(F.count("*").alias("n"), (F.min("block") != F.max("block")).alias("mixed")).where("n > 1").select("seed", "mixed")
    seeds = scratch.stored(seeds, "seeds", light=True)
    again = scratch.stored(all_blocks.join(seeds, "seed"), "seeds-again", light=True)
    scratch.drop(all_blocks, seeds)
    index = again.groupBy("seed", "block", "width", "mixed").agg(F.count("*").alias("n"), F.min(F.struct("k1", "k2", "first")).alias("one"))
    index = scratch.stored(index, "index", light=True)
    whole = index.where("n > 1").select("seed", "block", F.expr("shiftleft(1L, width) - 1").alias("mask"))
    ends = index.where("mixed").select("one.k1", "one.k2", F.struct("one.first", "width", "seed", "block").alias("block"))
    ends = scratch.stored(ends.groupBy("k1", "k2").agg(F.collect_list("block").alias("todo")), "ends", light=True)  # of one text
    read = texts.join(ends.hint("shuffle_hash"), ["k1", "k2"]).select("k1", "k2", "text", "todo")
    single = scratch.stored(read.mapInArrow(released(_windows_of_rows(window)), "seed long, window long, block long, place int"), "windows")
    twice = single.groupBy("seed", "window").agg(F.min("block").alias("low"), F.max("block").alias("high")).where("low <> high").select("seed", "window")
    found = single.join(twice, ["seed", "window"]).groupBy("seed", "block").agg(F.expr("bit_or(shiftleft(1L, place))").alias("mask"))
    masks = scratch.stored(whole.unionByName(found).groupBy("seed", "block").agg(F.expr("bit_or(mask)").alias("mask")), "masks", light=True)
    scratch.drop(single, index, ends)
    marks = again.join(masks, ["seed", "block"]).groupBy("k1", "k2").agg(F.collect_set(F.struct("first", "mask")).alias("marks"))  # of one text
    out = scratch.stored(marks, "marks", light=True)
    scratch.drop(again, masks)
    return out


def covered(n: int, marks, window: int = WINDOW) -> np.ndarray:
    """True for each of ``n`` words that a marked window covers."""
    first, mask = (np.array([m[c] for m in marks], dtype=np.int64) for c in ("first", "mask"))
    step = np.zeros(n + 1, dtype=np.int64)
    for place in range(int(mask.max()).bit_length()):
        at = first[(mask >> place) & 1 == 1] + place
        np.add.at(step, at, 1)
        np.add.at(step, at + window, -1)
    return np.cumsum(step[:-1]) > 0


def without_repeats(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """``docs`` with n_words, repeats (start and end in words, end exclusive) and kept (the other words, joined by one
    space); columns of these names are replaced.

    Words are what stands between ASCII white space, unchanged.  Every copy of a repeated window goes, the first one
    and those in the same text too.  Null, empty and wordless texts, and those of fewer words than a window, have no
    repeats.  Rows are told apart by their text only: copies of a text repeat each other from ``window`` words on,
    whatever their ids, and get equal results.  ``window`` is from ``seed`` words to 62 more.  One text's words and
    marks are held by one task.
    """
    if not seed <= window <= seed + 61:
        raise ValueError("a window holds a seed, and 61 words more at most")
    small_batches(docs.sparkSession)
    names = [c for c in docs.columns if c.lower() not in ("n_words", "repeats", "kept")]
    docs = docs.select(*map(quoted, names))
    scratch = Scratch(docs.sparkSession)
    marks = repeated_windows(docs, scratch, window, seed)
    n = len(names)
    rows = keyed(docs).join(marks.hint("shuffle_hash"), ["k1", "k2"], "left").select("marks", "text", *[f"c{k}" for k in range(n)])

    def run(batches):
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            sizes, spans, kept = [], [], []
            for marked, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = encoded(text).split()
                sizes.append(len(words))
                if not marked:
                    spans.append([])
                    kept.append(b" ".join(words).decode("utf-8", "surrogatepass"))
                    continue
                gone = covered(len(words), marked, window)
                edge = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]))).reshape(-1, 2)
                spans.append([{"start": int(a), "end": int(b)} for a, b in edge])
                kept.append(b" ".join([words[k] for k in np.flatnonzero(~gone).tolist()]).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], pa.array(sizes, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.string())], names=[*names, "n_words", "repeats", "kept"])

    extra = docs.select(F.lit(0).cast("long").alias("n_words"), F.expr("cast(null as array<struct<start:bigint,end:bigint>>)").alias("repeats"), F.lit("").alias("kept")).schema.fields
    return rows.mapInArrow(released(run), StructType([*docs.schema.fields, *extra]))


def op11_substrings(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document."""
    found = without_repeats(docs.select("doc_id", "text"))
    removed = F.aggregate("repeats", F.lit(0).cast("long"), lambda n, r: n + r.end - r.start)
    return found.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))
