"""N-gram Jaccard join (3): PartEnum signatures, exact verification, components.

Sets are distinct 5-word shingles; equal sets are one node.  Nodes are banded by size
so that sets of similarity >= 4/5 lie in one band or in neighbouring ones; instance i
serves band i and its pairs with band i + 1.  There, two sets in reach differ in at
most k elements.  The shingle domain is cut into n1 first-level partitions of two
halves each: with k differences over more than (k + 1) / 2 partitions, one partition
has at most one difference, so one of its halves (the enumerated subsets of size one
of two) is equal in both sets.  A signature is the hash of such a half.

An empty half says nothing and would be shared by all, so it gets no signature.  In
exchange there are ``spare`` more halves: sets with at most that many empty halves
still share a filled one with every set in reach.  The rare sets with more empty
halves also get prefix signatures (their first n - ceil(4n/5) + 1 shingles by hash),
which any two sets in reach share.  Nothing is lost by either.

Signatures are dealt into buckets by their hash, packed, and grouped with numpy.  The
nodes of a signature are a block; a signature of more than ``most`` nodes gives several
blocks.  Equal blocks are kept once.  Pairs are never listed before they are filtered:

* First each node of a block meets the block's smallest node only.  A sketch of each
  set (how many shingles lie in each range of hashes) rules out nearly every pair that
  isn't similar; texts are read for the rest alone, and compared exactly.
* What those links leave in different components is then compared, block by block (and
  block against block of one large signature), by the sketches, in cells of bounded
  size; again texts are read only for pairs that the sketches leave.

The sketch bound is exact: what two sets' counts differ by in all is at most the number
of elements that one of them lacks.  Intermediate tables and shuffle files are removed
once their last reader is done.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, quoted, released, small_batches
from .graph import components
from .textnum import U, mix, shingle_set

_HIGH_SIZE = 1 << 40
_SIG_BYTES = 5  # of a signature's hash that tell signatures of one bucket apart


def _bands() -> np.ndarray:
    """Largest set size of each band: a band's sizes are within a factor of 4/5."""
    tops, low = [], 1
    while low < _HIGH_SIZE:
        tops.append(low * 5 // 4)
        low = tops[-1] + 1
    return np.array(tops, dtype=np.int64)


_TOP = _bands()


def reach(instance: int) -> int:
    """Most differences between two sets of instance ``instance`` with similarity >= 4/5:
    (r - d) / (r + d) >= 4/5 for r the sum of the sizes, so d <= r / 9."""
    r = int(_TOP[instance])
    return (r + min(int(_TOP[instance + 1]), r * 5 // 4)) // 9


def shape(instance: int) -> tuple[int, int]:
    """First-level partitions (of two halves), and empty halves that a set may have."""
    k = reach(instance)
    low = int(_TOP[instance - 1]) + 1 if instance else 1
    spare = 0
    for _ in range(6):
        halves = k + 1 + spare
        expected = halves * np.exp(-low / halves)
        spare = int(expected + 3 * np.sqrt(expected)) if k else 0
    halves = k + 1 + spare
    return (halves + 1) // 2, spare + halves % 2


_SHAPES: dict[int, tuple[int, int]] = {}


def node_of(s: np.ndarray) -> int:
    """A 64-bit id of a set."""
    with np.errstate(over="ignore"):
        return int(mix(np.array([np.sum(mix(s + U(7))) + U(len(s))], dtype=U)).view(np.int64)[0])


def signatures(s: np.ndarray) -> np.ndarray:
    """All signatures of a sorted shingle set."""
    n = len(s)
    band = int(np.searchsorted(_TOP, n))
    out = []
    with np.errstate(over="ignore"):
        for instance in (band, band - 1) if band else (band,):
            if instance not in _SHAPES:
                _SHAPES[instance] = shape(instance)
            n1, spare = _SHAPES[instance]
            seed = mix(np.array([instance + 1], dtype=U))[0]
            h = mix(s ^ seed)
            half = (((h >> U(32)) * U(2 * n1)) >> U(32)).astype(np.int64)  # partition half // 2, half half % 2
            total = np.zeros(2 * n1, dtype=U)
            np.add.at(total, half, mix(h + seed))
            filled = np.bincount(half, minlength=2 * n1) > 0
            out.append(mix(total + mix(np.arange(2 * n1, dtype=U) + seed))[filled])
            if 2 * n1 - int(filled.sum()) > spare:
                out.append(mix(np.sort(h)[: n - -(-4 * n // 5) + 1] + mix(np.array([~seed], dtype=U))[0]))
    return np.concatenate(out)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """100 * intersection >= 80 * union."""
    if len(a) > len(b):
        a, b = b, a
    if 100 * len(a) < 80 * len(b):
        return False
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    n = int(np.count_nonzero(b[at] == a))
    return 100 * n >= 80 * (len(a) + len(b) - n)


_QUARTERS = np.array([0, 2, 4, 6], dtype=np.uint8)


def sketch(s: np.ndarray) -> bytes:
    """How many shingles (3: or more) lie in each of 64, 256, 1024, ... equal ranges of hashes, as many
    ranges as shingles at least; two bits a range."""
    bits = 6
    while len(s) > 1 << bits:
        bits += 2
    counts = np.minimum(np.bincount((s >> U(64 - bits)).astype(np.int64), minlength=1 << bits), 3).astype(np.uint8)
    return np.bitwise_or.reduce(counts.reshape(-1, 4) << _QUARTERS, axis=1).tobytes()


def _coarser(counts: np.ndarray, ranges: int) -> np.ndarray:
    """Counts over fewer ranges; exact, as saturated counts stay saturated."""
    if counts.shape[1] == ranges:
        return counts
    return np.minimum(counts.reshape(len(counts), ranges, -1).sum(2, dtype=np.int64), 3).astype(np.uint8)


class Sketches:
    """Sizes and sketches of some nodes; finds the pairs of them that these don't rule out."""

    def __init__(self, sizes: np.ndarray, sketches: list[bytes]):
        self.sizes = sizes
        self.width = 4 * np.array([len(x) for x in sketches], dtype=np.int64)
        self.place = np.empty(len(sketches), dtype=np.int64)
        self.counts = {}
        for w in np.unique(self.width).tolist():
            own = np.flatnonzero(self.width == w)
            self.place[own] = np.arange(len(own))
            packed = np.frombuffer(b"".join([sketches[k] for k in own.tolist()]), np.uint8)
            self.counts[w] = ((packed[:, None] >> _QUARTERS) & 3).reshape(-1, w)

    def possible(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x, y = self.sizes[i], self.sizes[j]
        fits = 100 * np.minimum(x, y) >= 80 * np.maximum(x, y)
        i, j = i[fits], j[fits]
        keep = np.zeros(len(i), dtype=bool)
        kinds = self.width[i] * (1 << 32) + self.width[j]
        for kind in np.unique(kinds).tolist():
            v, w = kind >> 32, kind & 0xFFFFFFFF
            own, step = np.flatnonzero(kinds == kind), max(1, (1 << 21) // max(v, w))
            for at in range(0, len(own), step):
                some = own[at : at + step]
                a = _coarser(self.counts[v][self.place[i[some]]], min(v, w))
                b = _coarser(self.counts[w][self.place[j[some]]], min(v, w))
                gap = (np.maximum(a, b) - np.minimum(a, b)).sum(1, dtype=np.int64)
                keep[some] = 9 * gap <= self.sizes[i[some]] + self.sizes[j[some]]
        return i[keep], j[keep]


def _rows(docs: DataFrame) -> DataFrame:
    """doc_id, text, and a hash of the text that tells rows of one doc_id apart."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("of_text"))


def sets(docs: DataFrame) -> DataFrame:
    """doc_id, of_text, n_shingles, node and sketch (null for an empty set)."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some, n, node, counts = batch.slice(at, 256), [], [], []
                for t in some.column(1).to_pylist():
                    s = shingle_set(t)
                    n.append(len(s))
                    node.append(node_of(s) if len(s) else None)
                    counts.append(sketch(s) if len(s) else None)
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(2), pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array(counts, pa.binary())], names=["doc_id", "of_text", "n_shingles", "node", "sketch"])

    return _rows(docs).mapInArrow(released(run), "doc_id long, of_text long, n_shingles long, node long, sketch binary")


def signature_rows(docs: DataFrame, buckets: int) -> DataFrame:
    """bucket, nodes, counts, sigs: packed signatures, a row for each bucket and slice of documents."""

    def pack(found):
        own = np.concatenate([np.full(len(s), n, dtype=np.int64) for n, s in found.items()])
        sig = np.concatenate(list(found.values()))
        bucket = (sig % U(buckets)).astype(np.int64)
        order = np.lexsort((own, bucket))
        own, bucket = own[order], bucket[order]
        sig = np.ascontiguousarray((sig[order] // U(buckets)).view(np.uint8).reshape(-1, 8)[:, :_SIG_BYTES])
        cuts = np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(bucket))
        rows = [[], [], [], []]
        for a, b in zip(cuts, cuts[1:]):
            ids, counts = np.unique(own[a:b], return_counts=True)
            for col, x in zip(rows, (int(bucket[a]), ids.tobytes(), counts.astype(np.int32).tobytes(), sig[a:b].tobytes()), strict=True):
                col.append(x)
        return pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), *(pa.array(x, pa.binary()) for x in rows[1:])], names=["bucket", "nodes", "counts", "sigs"])

    def run(batches):
        found, held = {}, 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for t in batch.column(0).slice(at, 256).to_pylist():
                    s = shingle_set(t)
                    if len(s) and (n := node_of(s)) not in found:
                        found[n] = signatures(s)
                        held += len(found[n])
                        if held > 1 << 19:
                            yield pack(found)
                            found, held = {}, 0
        if found:
            yield pack(found)

    return docs.select(F.col("text").cast("string").alias("text")).where("text is not null").mapInArrow(released(run), "bucket long, nodes binary, counts binary, sigs binary")


_BLOCKS = "hub long, sig long, no int, members binary"


def _block_batch(hub: np.ndarray, members: np.ndarray, sig: np.ndarray | None = None, no: int = 0):
    """Blocks of one size: a row of ``members`` each."""
    n, width = members.shape
    of = [pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32())] if sig is None else [pa.array(sig), pa.array([no], pa.int32())]
    offsets = pa.py_buffer((np.arange(n + 1) * 8 * width).astype(np.int32).tobytes())
    data = pa.Array.from_buffers(pa.binary(), n, [None, offsets, pa.py_buffer(np.ascontiguousarray(members).tobytes())])
    return pa.RecordBatch.from_arrays([pa.array(hub), *of, data], names=["hub", "sig", "no", "members"])


def block_rows(packed: DataFrame, most: int, held: int) -> DataFrame:
    """The nodes that share a signature, two at least, and the smallest of them (hub).

    A signature of more than ``most`` nodes gives several blocks, numbered under its sig (else null).
    A task holds about ``held`` signatures: beyond that, blocks of the signatures with many nodes are
    given out at once, and only their smallest node stays.
    """

    def ordered(own, sig):
        own, sig = np.concatenate(own), np.concatenate(sig)
        order = np.lexsort((own, sig))
        own, sig = own[order], sig[order]
        new = np.append(True, (sig[1:] != sig[:-1]) | (own[1:] != own[:-1]))
        own, sig = own[new], sig[new]
        first = np.flatnonzero(np.append(True, sig[1:] != sig[:-1]))
        return own, sig, first, np.diff(np.append(first, len(sig)))

    def large(bucket, own, sig, first, size, given):
        """Blocks of the signatures of many nodes."""
        for a, n in zip(first.tolist(), size.tolist()):
            name = int(sig[a])
            key = mix(np.array([name], dtype=U) ^ mix(np.array([bucket], dtype=U))).view(np.int64)
            for at in range(0, n, most):
                members = own[a + at : a + min(n, at + most)]
                yield _block_batch(own[a : a + 1], members[None], key, given.get(name, 0))
                given[name] = given.get(name, 0) + 1

    def small(own, first, size):
        for m in np.unique(size).tolist():
            starts, step = first[size == m], max(1, (1 << 20) // m)
            for at in range(0, len(starts), step):
                members = np.unique(own[starts[at : at + step, None] + np.arange(m)], axis=0)
                yield _block_batch(members[:, 0], members)

    def run(batches):
        at, own, sig, n, bound, given = None, [], [], 0, held, {}

        def close():
            o, s, first, size = ordered(own, sig)
            several = (size > most) | np.isin(s[first], np.array(list(given), dtype=U))
            yield from large(at, o, s, first[several & (size > 1)], size[several & (size > 1)], given)
            yield from small(o, first[~several & (size > 1)], size[~several & (size > 1)])

        for batch in batches:
            for bucket, ids, counts, sigs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bucket != at:
                    if own:
                        yield from close()
                    at, own, sig, n, bound, given = bucket, [], [], 0, held, {}
                own.append(np.repeat(np.frombuffer(ids, np.int64), np.frombuffer(counts, np.int32)))
                wide = np.zeros((len(sigs) // _SIG_BYTES, 8), dtype=np.uint8)
                wide[:, :_SIG_BYTES] = np.frombuffer(sigs, np.uint8).reshape(-1, _SIG_BYTES)
                sig.append(wide.view(U).ravel())
                n += len(own[-1])
                if n > bound:
                    o, s, first, size = ordered(own, sig)
                    many = size > most
                    yield from large(at, o, s, first[many], size[many], given)
                    stay = np.repeat(~many, size)
                    stay[first] = True
                    own, sig = [o[stay]], [s[stay]]
                    n = len(own[0])
                    bound = max(held, 2 * n)
        if own:
            yield from close()

    return packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(released(run), _BLOCKS)


def star(blocks: DataFrame) -> DataFrame:
    """a, b: each block's smallest node with each of the others, once."""

    def run(batches):
        for batch in batches:
            hub = batch.column(0).to_numpy()
            ids = [np.frombuffer(x, np.int64) for x in batch.column(1).to_pylist()]
            if ids:
                a, b = np.repeat(hub, [len(x) for x in ids]), np.concatenate(ids)
                yield pa.RecordBatch.from_arrays([pa.array(a[a != b]), pa.array(b[a != b])], names=["a", "b"])

    return blocks.select("hub", "members").mapInArrow(released(run), "a long, b long").distinct()


def sketched(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs that sizes and sketches don't rule out.  A frequent ``a`` is left to AQE's skew join."""

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            if n:
                sizes = np.concatenate([batch.column(2).to_numpy(), batch.column(4).to_numpy()])
                i, j = Sketches(sizes, batch.column(3).to_pylist() + batch.column(5).to_pylist()).possible(np.arange(n), np.arange(n) + n)
                yield pa.RecordBatch.from_arrays([pa.array(batch.column(0).to_numpy()[i]), pa.array(batch.column(1).to_numpy()[j - n])], names=["a", "b"])

    side = lambda x: nodes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return both.select("a", "b", "n_a", "s_a", "n_b", "s_b").mapInArrow(released(run), "a long, b long")


SLOTS = 1 << 21


def among(rows: DataFrame, wanted: DataFrame, kind: str = "left_semi") -> DataFrame:
    """The rows whose of_text may be one of the ``wanted`` (or, with left_anti, is none of them), without a shuffle.

    Only a hash to 2^21 slots is broadcast, so at most that many numbers, whatever the corpus holds.
    """
    slots = wanted.select(F.pmod(wanted.columns[0], F.lit(SLOTS)).alias("_slot")).distinct()
    return rows.join(F.broadcast(slots), F.pmod("of_text", F.lit(SLOTS)) == F.col("_slot"), kind)


def verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, scratch: Scratch, what: str) -> DataFrame:
    """The pairs whose texts' sets are similar.  A text is read for each node of a pair, and goes with each pair."""
    ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    need = scratch.stored(ends.join(nodes, "node").select("node", F.col("doc_id").alias("_doc_id"), F.col("of_text").alias("_of_text")), f"{what}-need", light=True)
    rows = among(_rows(docs).where("text is not null"), need.select("_of_text"))
    found = rows.join(need, rows["doc_id"].eqNullSafe(need["_doc_id"]) & (rows["of_text"] == need["_of_text"])).select("node", "text").dropDuplicates(["node"])
    texts = scratch.stored(found, f"{what}-texts", light=True)
    side = lambda x: texts.select(F.col("node").alias(x), F.col("text").alias(f"t_{x}"))

    def run(batches):
        known: dict[int, np.ndarray] = {}  # the sets of the latest nodes on the left
        for batch in batches:
            keep = []
            for at in range(0, batch.num_rows, 64):
                some = batch.slice(at, 64)
                for a, x, y in zip(*(some.column(k).to_pylist() for k in (0, 2, 3)), strict=True):
                    if a not in known:
                        if len(known) >= 8:
                            known.pop(next(iter(known)))
                        known[a] = shingle_set(x)
                    keep.append(similar(known[a], shingle_set(y)))
            if any(keep):
                yield batch.select(["a", "b"]).filter(pa.array(keep))

    links = scratch.stored(pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "t_a", "t_b").mapInArrow(released(run), "a long, b long"), what)
    scratch.drop(need, texts)
    return links


def cells(blocks: DataFrame, roots: DataFrame, most: int) -> DataFrame:
    """sig, hub, loose, no, members: the nodes of each signature of several blocks, dealt anew to blocks of
    about ``most``: those of its commonest component so far, and the others (loose).

    Two nodes of the commonest component need not be compared, so only blocks of loose nodes are paired,
    with each other and with the rest.  A signature whose nodes are all in one component has no rows.
    """

    def unpack(batches):
        for batch in batches:
            for sig, hub, members in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                node = np.frombuffer(members, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(node), sig)), pa.array(np.full(len(node), hub)), pa.array(node)], names=["sig", "hub", "node"])

    def pack(batches):
        for batch in batches:
            members = [np.unique(np.array(x, dtype=np.int64)).tobytes() for x in batch.column(4).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(members, pa.binary())], names=["sig", "hub", "loose", "no", "members"])

    member = blocks.where("sig is not null").select("sig", "hub", "members").mapInArrow(released(unpack), "sig long, hub long, node long")
    member = member.join(roots, "node", "left").select("sig", "hub", "node", F.coalesce("root", "node").alias("root"))
    sizes = member.groupBy("sig", "root").agg(F.count("*").alias("n"), F.min("hub").alias("hub"))
    sizes = sizes.groupBy("sig").agg(F.max(F.struct("n", "root")).alias("top"), F.sum("n").alias("total"), F.min("hub").alias("hub")).where("top.n < total")
    dealt = member.select("sig", "node", "root").join(sizes, "sig").withColumn("loose", F.col("root") != F.col("top.root"))
    count = F.ceil(F.when(F.col("loose"), F.col("total") - F.col("top.n")).otherwise(F.col("top.n")) / most)
    dealt = dealt.withColumn("no", F.pmod(F.xxhash64("node"), count).cast("int"))
    return dealt.groupBy("sig", "hub", "loose", "no").agg(F.collect_list("node").alias("members")).mapInArrow(released(pack), "sig long, hub long, loose boolean, no int, members binary")


def across(blocks: DataFrame, dealt: DataFrame, pairs: DataFrame, nodes: DataFrame, roots: DataFrame, cell: int) -> DataFrame:
    """Pairs of nodes of one signature that lie in different components so far, without those that
    the sketches rule out.  In a block, its smallest node has met the others already.

    Blocks of one smallest node mostly hold the same nodes, so they go together, each node once: in one
    cell, or where they hold more than ``cell`` nodes or 16 times as many members, in several.
    ``dealt`` are the cells of the signatures of several blocks.
    ``pairs`` are those of the smallest nodes, whose number is that of the nodes.
    """
    one = blocks.where("sig is null and length(members) > 16").select("hub", F.col("members").alias("x"), F.lit(None).cast("binary").alias("y"))
    loose, rest = dealt.where("loose"), dealt.where("not loose")
    within = loose.select("hub", F.col("members").alias("x"), F.col("members").alias("y"))

    def met(first, second, which):
        f, s = first.alias("f"), second.alias("s")
        return f.join(s, (F.col("f.sig") == F.col("s.sig")) & which).select(F.col("f.hub").alias("hub"), F.col("f.members").alias("x"), F.col("s.members").alias("y"))

    between = met(loose, loose, F.col("f.no") < F.col("s.no")).unionByName(met(loose, rest, F.lit(True)))
    todo = one.unionByName(within).unionByName(between)
    weight = todo.groupBy("hub").agg((F.sum(F.length("x") + F.coalesce(F.length("y"), F.lit(0))) / 8).alias("members"))
    weight = weight.join(pairs.groupBy(F.col("a").alias("hub")).agg(F.count("*").alias("others")), "hub", "left")
    parts = F.ceil(F.greatest(F.coalesce("others", F.lit(0)) / cell, F.col("members") / (16 * cell))).cast("int")
    parts = weight.select("hub", F.greatest(parts, F.lit(1)).alias("parts"))
    dealt = todo.join(parts, "hub").select("hub", F.pmod(F.xxhash64("x", "y"), F.col("parts")).cast("int").alias("part"), "x", "y")

    def unpack(batches):
        for batch in batches:
            for hub, part, x, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                node = np.unique(np.frombuffer(x + (y or b""), np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(node), hub)), pa.array(np.full(len(node), part, dtype=np.int32)), pa.array(node)], names=["hub", "part", "node"])

    member = dealt.mapInArrow(released(unpack), "hub long, part int, node long").distinct()
    member = member.join(nodes.select("node", "n", "sketch"), "node").join(roots, "node", "left")
    null = lambda kind: F.lit(None).cast(kind)
    rows = member.select("hub", "part", F.lit(0).alias("kind"), "node", F.coalesce("root", "node").alias("root"), "n", F.col("sketch").alias("x"), null("binary").alias("y"))
    rows = rows.unionByName(dealt.select("hub", "part", F.lit(1).alias("kind"), null("long").alias("node"), null("long").alias("root"), null("long").alias("n"), "x", "y"))

    def compare(batches):
        at, node, todo = None, [], []

        def close():
            if not todo:
                return
            node.sort()
            ids, root, size = (np.array(c, dtype=np.int64) for c in list(zip(*node, strict=True))[:3])
            counts, hub, n = Sketches(size, [r[3] for r in node]), ids == at[0], len(ids)
            place = []  # of each block's nodes, of the two blocks to compare
            for x, y in todo:
                i = np.searchsorted(ids, np.frombuffer(x, np.int64))
                if y is None:
                    place.append((i[~hub[i]],) * 2)
                else:
                    j = np.searchsorted(ids, np.frombuffer(y, np.int64))
                    place += [(i, j), (j, i)]
            rows = max(1, (1 << 22) // n)
            for low in range(0, n, rows):  # some rows of the table of all pairs at a time
                met = np.zeros((min(rows, n - low), n), dtype=bool)
                for i, j in place:
                    own = i[np.searchsorted(i, low) : np.searchsorted(i, low + rows)] - low
                    met[own[:, None], j[None]] = True
                own = np.arange(low, low + len(met))
                met &= (root[own][:, None] != root[None]) & (own[:, None] < np.arange(n)[None])
                i, j = np.nonzero(met)
                i, j = counts.possible(i + low, j)
                if len(i):
                    yield pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(ids[j])], names=["a", "b"])

        for batch in batches:
            for hub, part, kind, n, root, size, x, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (hub, part) != at:
                    yield from close()
                    at, node, todo = (hub, part), [], []
                if kind == 0:
                    node.append((n, root, size, x))
                else:
                    todo.append((x, y))
        yield from close()

    return rows.repartition("hub", "part").sortWithinPartitions("hub", "part", "kind").mapInArrow(released(compare), "a long, b long").distinct()


def jaccard_join(docs: DataFrame, most: int = 2048, bucket_size: int = 1 << 20, cell: int = 4096) -> DataFrame:
    """doc_id, n_shingles, component_id of every row, and of_text (a hash of the text) and root, which names
    its group (null without shingles).

    Null, empty and wordless texts have no shingles and are components of their own.
    Rows with equal sets are linked; a null doc_id takes part and is the smallest only
    where there is no other.  Rows that repeat a doc_id are all kept.
    """
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark)
    ids = scratch.stored(sets(docs), "sets")
    total = ids.agg(F.coalesce(F.sum("n_shingles"), F.lit(0))).first()[0]
    buckets = max(1, int(0.6 * total / bucket_size))
    own = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "of_text")).alias("row")
    nodes = ids.where("node is not null").groupBy("node").agg(own, F.min("n_shingles").alias("n"), F.min("sketch").alias("sketch"))
    nodes = scratch.stored(nodes.select("node", "row.doc_id", "row.of_text", "n", "sketch"), "nodes", light=True)
    found = scratch.stored(block_rows(signature_rows(docs, buckets), most, 3 * bucket_size), "found")
    blocks = scratch.stored(found.where("sig is null").distinct().unionByName(found.where("sig is not null")), "blocks", light=True)
    scratch.drop(found)
    pairs = scratch.stored(star(blocks), "star", light=True)
    maybe = scratch.stored(sketched(pairs, nodes), "maybe", light=True)
    links = verified(maybe, docs, nodes, scratch, "links")
    scratch.drop(maybe)
    roots = scratch.stored(components(links), "roots", light=True)
    dealt = scratch.stored(cells(blocks, roots, most), "cells", light=True)
    more = scratch.stored(across(blocks, dealt, pairs, nodes, roots, cell), "more")
    scratch.drop(blocks, dealt, pairs)
    if not more.isEmpty():
        further = verified(more, docs, nodes, scratch, "further")
        scratch.drop(roots)
        roots = scratch.stored(components(links.unionByName(further)), "roots", light=True)
        scratch.drop(further)
    named = nodes.select("node", F.col("doc_id").alias("least")).join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    of_root = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of_node = scratch.stored(named.join(of_root, "root").select("node", "component_id", "root"), "of-node", light=True)
    scratch.drop(links, more, nodes, roots)
    return ids.join(of_node, "node", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "of_text", "root")


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group: the smallest doc_id (null last), then the smallest text hash.

    Rows without shingles are in no group and stay.  Only the texts of groups of several rows
    are moved: the others are told apart by a hash to a fixed number of slots, which is broadcast.
    """
    scratch = Scratch(docs.sparkSession)
    joined = scratch.stored(jaccard_join(docs).where("root is not null").select("doc_id", "of_text", "root"), "joined", light=True)
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "of_text")
    groups = joined.groupBy("root").agg(F.count("*").alias("rows"), F.min(row).alias("best")).where("rows > 1")
    member = joined.join(groups, "root").select("doc_id", "of_text", (row == F.col("best")).alias("_stays")).distinct()
    member = scratch.stored(member.select(F.col("doc_id").alias("_id"), F.col("of_text").alias("_of"), "_stays"), "members", light=True)
    scratch.drop(joined)
    known = docs.select(*[F.col(quoted(c)).alias(f"c{k}") for k, c in enumerate(docs.columns)], F.col("doc_id").cast("long").alias("_doc"), F.xxhash64(F.col("text").cast("string")).alias("of_text"))
    alone = among(known, member.select("_of"), "left_anti")
    maybe = among(known, member.select("_of"))
    told = maybe.join(member, F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("of_text") == F.col("_of")), "left")
    others, first = told.where("_stays is null"), told.where("_stays").dropDuplicates(["_doc", "of_text"])
    back = [F.col(f"c{k}").alias(c) for k, c in enumerate(docs.columns)]
    return alone.select(*back).unionByName(others.select(*back)).unionByName(first.select(*back))


def op3_ngram_join(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return jaccard_join(docs).drop("of_text", "root")
