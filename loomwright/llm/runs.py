"""Periodic run detection (12): runs of a text's words by Lyndon edges, after Ellert and Fischer.

Words are compared in byte order only.  One scan from left to right keeps, for every
word, the previous smaller suffix; each comparison of two suffixes is an edge (j, i)
with the length l of their common extension, and i is the next smaller suffix of j or
j the previous smaller suffix of i.  Extensions are not matched twice: where an edge
(k, j) of extension m is followed by (k, i), and (j, i) has another extension, the
smaller one holds for (k, i); where they are equal, matching goes on behind them, and
the stretch that has been matched farthest to the right hands its inner edges on.
A run of period p and three periods or more has its Lyndon root on an edge of length p
that repeats; the first such edge and its extension to the left give the run.  There
are no suffix arrays, suffix trees or fingerprints.

Words that no run can hold are set aside first: in a run of period p every word but the
first p has occurred within the last p words, so only stretches of such words, as long
as a run would make them, are scanned.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import numbered_columns, quoted, released, small_batches

RUNS = "array<struct<start:long,length:long,period:long>>"


def extended(w: list, k: int, i: int, l: int) -> int:
    """The common extension of the suffixes at k < i, which agree in the first ``l`` words."""
    n, step = len(w), 4
    while i + l < n and w[k + l] == w[i + l]:
        l += 1
        while i + l + step <= n and w[k + l : k + l + step] == w[i + l : i + l + step]:
            l += step
            step = min(2 * step, 4096)
        step = 4
    return l


def lyndon_edges(w: list, extend=extended) -> list[tuple[int, int, int]]:
    """(j, i, common extension) of every pair of a suffix and its next or previous smaller suffix."""
    n = len(w)
    equal = [0] * (n + 1)  # of the suffixes at i and i + 1
    for i in range(n - 2, -1, -1):
        if w[i] == w[i + 1]:
            equal[i] = equal[i + 1] + 1
    left, left_l = [-1] * n, [0] * n  # previous smaller suffix
    right, right_l = [n] * n, [0] * n  # next smaller suffix
    a = b = reach = 0  # w[a : a + reach - b] equals w[b : reach]: what was matched farthest
    edges = []
    for i in range(1, n):
        j = i - 1
        l = equal[j]
        if i + l > reach:
            a, b, reach = j, i, i + l
        while True:
            edges.append((j, i, l))
            if i + l < n and w[j + l] < w[i + l]:
                left[i], left_l[i] = j, l
                break
            right[j], right_l[j] = i, l
            k, m = left[j], left_l[j]
            if k < 0:
                break
            if m != l:
                l = min(m, l)
            else:
                known = None
                if k >= b and i + l < reach:  # both lie in the copy: look at the same places of the original
                    x, y = k - b + a, i - b + a
                    known = left_l[y] if left[y] == x else right_l[x] if right[x] == y else None
                if known is not None and i + known < reach:
                    l = known
                else:
                    l = extend(w, k, i, l if known is None else max(l, reach - i))
                    if i + l >= reach:
                        a, b, reach = k, i, i + l
            j = k
    return edges


def runs_of(w: list, exponent: int = 4, least: int = 6) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of ``exponent`` (3 or more) periods and ``least`` items, in order."""
    found = []
    for j, i, l in lyndon_edges(w):
        p = i - j
        if l <= (exponent - 2) * p or (j >= p and w[j - p : j] == w[i - p : i]):
            continue  # too short, or not the first root
        back = 0
        while back < j and w[j - 1 - back] == w[i - 1 - back]:
            back += 1
        if back + p + l >= max(least, exponent * p):
            found.append((j - back, back + p + l, p))
    return sorted(found, key=lambda r: (r[0], r[2]))


def stretches(texts: list[list], exponent: int, least: int) -> list[tuple[int, int, int]]:
    """(text, begin, end) of the stretches of words that may hold runs, with a word more at either end; in order."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    first, total = np.concatenate([[0], np.cumsum(sizes)]), int(sizes.sum())
    if not total:
        return []
    name = np.empty(total, dtype=np.int64)
    for t, at, n in zip(texts, first, sizes, strict=False):
        name[at : at + n] = np.fromiter(map({}.setdefault, t, range(at, at + n)), dtype=np.int64, count=n)
    order = np.argsort(name, kind="stable")
    again = name[order[1:]] == name[order[:-1]]
    gap = np.full(total, total + 1, dtype=np.int64)  # to the last occurrence in the text
    gap[order[1:][again]] = (order[1:] - order[:-1])[again]
    found, low = [], 1
    while max(exponent * low, least) <= sizes.max():  # periods from low to 2 * low - 1
        far = 2 * low - 1
        need = min(max(least - p, (exponent - 1) * p) for p in (range(low, 2 * low) if low < least else (low,)))
        breaks = np.concatenate([[-1], np.flatnonzero(gap > far), [total]])
        long = np.flatnonzero(np.diff(breaks) > need)
        begin, end = breaks[long] + 1, breaks[long + 1]
        text = np.searchsorted(first, begin, side="right") - 1
        found += zip(text.tolist(), np.maximum(first[text], begin - far - 1).tolist(), np.minimum(first[text + 1], end + 1).tolist(), strict=True)
        low *= 2
    merged = []
    for t, begin, end in sorted(found):
        if merged and merged[-1][0] == t and begin <= merged[-1][2]:
            merged[-1][2] = max(end, merged[-1][2])
        else:
            merged.append([t, begin, end])
    return [(t, b - int(first[t]), e - int(first[t])) for t, b, e in merged]


def runs_of_texts(texts: list[list], exponent: int = 4, least: int = 6) -> list[list[tuple[int, int, int]]]:
    """The runs of each list of words."""
    out = [[] for _ in texts]
    for t, begin, end in stretches(texts, exponent, least):
        part = texts[t][begin:end]
        rank = {x: r for r, x in enumerate(sorted(set(part)))}
        out[t] += [(begin + s, n, p) for s, n, p in runs_of([rank[x] for x in part], exponent, least)]
    return out


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run holds after its first period, joined by one space."""
    if not runs:
        return b" ".join(words)
    keep = np.ones(len(words), dtype=bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return b" ".join(words[k] for k in np.flatnonzero(keep).tolist())


def periodic_runs(docs: DataFrame, exponent: int = 4, least: int = 6) -> DataFrame:
    """``docs`` with n_words, runs (start, length and period in words, by start) and collapsed (the text with one
    period of each run left, its words joined by one space); columns of these names are replaced.

    Words are what stands between ASCII white space, unchanged.  Null, empty and wordless texts have no runs and
    collapse to the empty text.  Each row is looked at alone, so repeated rows and equal ids get equal results, and
    null ids don't matter; whatever other columns there are stay.  A text is held whole by one task, some hundred
    bytes a word.
    """
    if exponent < 3:
        raise ValueError("runs of less than three periods can't be told from single Lyndon edges")
    small_batches(docs.sparkSession)
    names = [c for c in docs.columns if c.lower() not in ("n_words", "runs", "collapsed")]
    docs = docs.select(*map(quoted, names))
    at = next(k for k, c in enumerate(names) if c.lower() == "text")

    def run(batches):
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for batch in batches:
            words = [(t or "").encode("utf-8", "surrogatepass").split() for t in batch.column(at).to_pylist()]
            runs = runs_of_texts(words, exponent, least)
            left = [collapsed(w, r).decode("utf-8", "surrogatepass") for w, r in zip(words, runs, strict=True)]
            told = pa.array([[{"start": s, "length": n, "period": p} for s, n, p in r] for r in runs], kind)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([len(w) for w in words], pa.int64()), told, pa.array(left, pa.string())], names=[*names, "n_words", "runs", "collapsed"])

    extra = StructType().add("n_words", "long").add("runs", docs.sparkSession.range(0).select(F.lit(None).cast(RUNS)).schema[0].dataType).add("collapsed", "string")
    return numbered_columns(docs).mapInArrow(released(run), StructType([*docs.schema.fields, *extra.fields]))


def made_periodic(docs: DataFrame) -> DataFrame:
    """doc_id and text; where crc32 of the id (h) is divisible by 10, the words from a = g % n on repeat with period
    1 + (n - a) // (3 + g % 8), g being h // 10.  Null ids leave the text alone."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), h.alias("_h"), F.floor(h / 10).alias("_g"))
    words = F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "")
    n = F.size(words)
    a = F.when(n > 0, F.expr("_g") % n).cast("int")
    rest = n - a
    p = (F.lit(1) + F.floor(rest / (F.lit(3) + F.col("_g") % 8))).cast("int")
    again = F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil(rest / p).cast("int")))
    text = F.concat_ws(" ", F.slice(words, F.lit(1), a), F.slice(again, F.lit(1), rest))
    return own.select("doc_id", F.when((F.col("_h") % 10 == 0) & (n > 0), text).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The runs of every text of ``docs`` made periodic, as numbers and digests."""
    found = periodic_runs(made_periodic(docs))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("start"), (-r.period).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start, r.length, r.period), F.lit("\n"))), "")
    told = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    start, length, period = -F.col("best.start"), F.col("best.length"), -F.col("best.period")
    return told.select("doc_id", "n_runs", start.alias("start"), length.alias("length"), period.alias("period"), F.floor(1000 * length / period).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
