"""Token-ID output (7): encode texts and keep the ids in Parquet list columns.

File format: one Parquet folder whose files hold ascending, disjoint document
ranges.  ``ids`` is a list column that is dictionary-encoded (a 49k vocabulary
needs at most 16 bits an id) or, with ``encoding="delta"``, DELTA_BINARY_PACKED;
row groups and pages have set sizes, and parquet's column and offset indexes let
a reader skip to the pages of a document range.  The small columns (doc_id, part,
local_start, n_tokens) can be read alone.
"""

from __future__ import annotations

import json
import re
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import partitions, shared_dir

_SPACE = re.compile(r"[ \n\t\r]+")
_KEPT = "\x1c\x1d\x1e\x1f"
_MARK = "<|endoftext|>"
_ENCODERS: dict[str, "Encoder"] = {}


class _Slots(dict):
    """Piece to slot number; a new piece gets the next slot and waits in ``new``."""

    def __missing__(self, piece: str) -> int:
        self[piece] = slot = len(self)
        self.new.append(piece)
        return slot


class Encoder:
    """Encodes texts piece by piece between white space, remembering pieces.

    The tokenizer drops white space and no pre-token spans it, so a text's ids are
    the ids of its pieces joined; a corpus repeats most pieces.  ``most`` bounds the
    memory: when more pieces are known, those that were used often stay, half as many.
    """

    def __init__(self, path: str, most: int = 1 << 20):
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        # the same vocabulary for words of lower-case letters alone, which the normalizer and the pre-tokenizer's patterns leave as they are
        plain = json.loads(self.tokenizer.to_str()) | {"normalizer": None, "added_tokens": []}
        plain["pre_tokenizer"] = {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
        self.words = Tokenizer.from_str(json.dumps(plain))
        self.mark = self.tokenizer.token_to_id(_MARK)
        size = self.tokenizer.get_vocab_size()
        self.kind = np.uint16 if size <= 1 << 16 else np.uint32
        self.ends_word = np.zeros(size, dtype=bool)  # ids of tokens that end a pre-token
        for token, i in self.tokenizer.get_vocab().items():
            self.ends_word[i] = token.endswith("</w>")
        self.known = _Slots()
        self.known.new = []
        self.ids, self.size = np.empty(1 << 16, dtype=self.kind), 0
        self.starts, self.ends, self.used = (np.zeros(1 << 16, dtype=np.int32) for _ in range(3))

    def _trim(self) -> None:
        """Keeps the pieces that were used most, at most half of ``most`` and those used twice at least."""
        n, half = len(self.known), self.most // 2
        used = self.used[:n]
        least = max(2, int(np.partition(used, n - half)[n - half]) + 1)
        keep = np.flatnonzero(used >= least)
        ids, bounds = self._gather(keep)
        pieces = list(self.known)
        self.known = _Slots(zip([pieces[k] for k in keep.tolist()], range(len(keep))))
        self.known.new = []
        self.ids, self.size = np.concatenate([ids, np.empty(1 << 16, dtype=self.kind)]), len(ids)
        self.used[: len(keep)] = used[keep] // 2
        self.used[len(keep) :] = 0
        self.starts[: len(keep)], self.ends[: len(keep)] = bounds[:-1], bounds[1:]

    def _add(self, slots: np.ndarray, ids: np.ndarray, bounds: np.ndarray) -> None:
        end = self.size + len(ids)
        if end > len(self.ids):
            self.ids = np.resize(self.ids, 2 * end)
        if len(self.known) > len(self.starts):
            more = np.zeros(2 * len(self.known) - len(self.starts), dtype=np.int32)
            self.starts, self.ends, self.used = (np.concatenate([x, more]) for x in (self.starts, self.ends, self.used))
        self.ids[self.size : end] = ids
        self.starts[slots], self.ends[slots] = self.size + bounds[:-1], self.size + bounds[1:]
        self.size = end

    def _plain(self, text: str, tokenizer=None) -> np.ndarray:
        return np.array((tokenizer or self.tokenizer).encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=np.int64)

    def _learn(self) -> None:
        """Encodes the pieces that wait.  ASCII pieces share the ids of their lower-case
        form, and of a letter's word and the point or comma after it."""
        known, parts, bases = self.known, [], []
        new, known.new = known.new, []
        for p in new:
            if p.isascii() and "<" not in p:
                low = p.lower()
                if low[-1:] in ".," and low[-2:-1].isalpha():
                    parts.append((known[p], known[low[:-1]], known[low[-1]]))
                elif low != p:
                    parts.append((known[p], known[low], known[""]))
                else:
                    bases.append(p)
            else:
                bases.append(p)
        bases, known.new = bases + known.new, []  # with the forms that those led to
        words, others = [], []
        for p in bases:  # words: one pre-token each
            (words if p.isalpha() and p == p.lower() and (p.isascii() or unicodedata.is_normalized("NFC", p)) else others).append(p)
        odd = [p for p in others if "<|" in p]  # may hold special tokens themselves
        if odd:
            others = [p for p in others if "<|" not in p]
        slot = lambda pieces: np.fromiter(map(known.__getitem__, pieces), dtype=np.int64, count=len(pieces))
        if words:
            ids = self._plain(" ".join(words), self.words)
            bounds = np.append(0, np.flatnonzero(self.ends_word[ids]) + 1)
            if len(bounds) == len(words) + 1:
                self._add(slot(words), ids, bounds)
            else:
                others += words
        if others:  # in one call, with a special token between pieces
            ids = self._plain(_MARK.join(others) + _MARK)
            marks = np.flatnonzero(ids == self.mark)
            self._add(slot(others), np.delete(ids, marks), np.append(0, marks - np.arange(len(marks))))
        for p in odd:
            ids = self._plain(p)
            self._add(slot([p]), ids, np.array([0, len(ids)]))
        if parts:
            own, a, b = np.array(parts, dtype=np.int64).T
            ids, bounds = self._gather(np.stack([a, b], 1).ravel())
            self._add(own, ids, bounds[::2])

    def _gather(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        start = self.starts[at].astype(np.int64)
        size = self.ends[at] - start
        end = np.cumsum(size)
        total = int(end[-1]) if len(end) else 0
        return self.ids[np.repeat(start - (end - size), size) + np.arange(total)], np.append(0, end)

    def encode(self, text: str | None) -> np.ndarray:
        """The ids of a whole text."""
        return self.encode_all([text])[0]

    def encode_all(self, texts) -> list[np.ndarray]:
        """The ids of each whole text of a list or an Arrow column."""
        out: list[np.ndarray] = []
        for ids, ends in self.encode_parts(texts):
            out += np.split(ids, ends[1:-1])
        return out

    def encode_parts(self, texts):
        """(ids, bounds of each text) for parts of about a million characters, whose new pieces are learned together."""
        some, chars = [], 0
        for at in range(0, len(texts), 64):
            for text in texts[at : at + 64] if isinstance(texts, list) else texts.slice(at, 64).to_pylist():
                some.append(text or "")
                chars += len(some[-1])
                if chars > 1 << 20:
                    yield self._encode(some)
                    some, chars = [], 0
        if some:
            yield self._encode(some)

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.known) > self.most:
            self._trim()
        found, words, look = [], [0], self.known.__getitem__
        for text in texts:
            # str.split also cuts at U+001C to U+001F, which the tokenizer keeps
            pieces = _SPACE.split(text) if any(c in text for c in _KEPT) else text.split()
            found.append(np.fromiter(map(look, pieces), dtype=np.int64, count=len(pieces)))
            words.append(len(pieces))
        if self.known.new:
            self._learn()
        at = np.concatenate(found)
        self.used[: len(self.known)] += np.bincount(at, minlength=len(self.known)).astype(np.int32)
        ids, bounds = self._gather(at)
        return ids, bounds[np.cumsum(words)]


def encoder(path: str, most: int = 1 << 20) -> Encoder:
    """One encoder a Python worker and vocabulary file, kept between tasks."""
    if path not in _ENCODERS or _ENCODERS[path].most != most:
        _ENCODERS[path] = Encoder(path, most)
    return _ENCODERS[path]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def crc32_ids(ids: np.ndarray) -> int:
    """Unsigned crc32 of the ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, dtype="<u4"))


def files_for(docs: DataFrame, size: int = 64 << 20, least: int = 8 << 20) -> int:
    """How many files a table that is made from ``docs`` should have, from the plan's estimate of its bytes."""
    spark = docs.sparkSession
    held = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if held > 1 << 58:  # unknown
        return partitions(spark)
    return max(1, -(-held // size), min(spark.sparkContext.defaultParallelism, -(-held // least)))


def write_token_table(
    docs: DataFrame,
    path: str,
    vocabulary: str | None = None,
    end_id: int = 1,
    encoding: str = "dictionary",
    files: int | None = None,
    row_group_bytes: int = 32 << 20,
    page_bytes: int = 256 << 10,
) -> None:
    """Encode ``doc_id, text`` and write the token table described above.

    Null and empty texts give only the end id; a null doc_id sorts first; rows that
    repeat a doc_id are all kept, in order of their text's hash.  Other columns are
    ignored.  The text is moved once, by doc_id range, so each file is a sorted range;
    without ``files`` there is one for each 64 MB that the plan expects to read, or for
    each 8 MB as long as cores are free.
    """
    vocabulary = vocabulary or default_vocabulary()
    schema = "doc_id long, part int, local_start long, n_tokens long, ids array<int>"
    arrow = pa.schema([("doc_id", pa.int64()), ("part", pa.int32()), ("local_start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def encode(batches):
        enc, start = encoder(vocabulary), 0
        for batch in batches:
            at = 0
            for ids, bounds in enc.encode_parts(batch.column(1)):
                some = batch.slice(at, len(bounds) - 1)
                at += some.num_rows
                values = np.insert(ids.astype(np.int32), bounds[1:], end_id)
                bounds = bounds + np.arange(len(bounds))
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values))
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(2), pa.array(start + bounds[:-1]), pa.array(np.diff(bounds)), lists], schema=arrow)
                start += int(bounds[-1])

    spark = docs.sparkSession
    ranged = (
        docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"))
        .repartitionByRange(files or files_for(docs), "doc_id")
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
        .withColumn("part", F.spark_partition_id())
    )
    (
        ranged.mapInArrow(encode, schema)
        .write.option("compression", "zstd")
        .option("parquet.block.size", row_group_bytes)
        .option("parquet.page.size", page_bytes)
        .option("parquet.writer.version", "PARQUET_2_0" if encoding == "delta" else "PARQUET_1_0")
        .option("parquet.enable.dictionary", str(encoding == "dictionary").lower())
        .option("parquet.dictionary.page.size", 1 << 20)
        .parquet(path)
    )


def part_offsets(spark: SparkSession, path: str) -> DataFrame:
    """part, offset: ids in all earlier parts.  There is one row a file; the rows that
    meet in the driver are as many as the table has files, whatever the corpus holds."""
    sums = spark.read.parquet(path).groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()
    rows, total = [], 0
    for r in sums:
        rows.append((r["part"], total))
        total += r["n"]
    return spark.createDataFrame(rows, "part int, offset long")


def read_token_table(spark: SparkSession, path: str, low: int | None = None, high: int | None = None) -> DataFrame:
    """doc_id, start, n_tokens, ids; with bounds, only the pages of that doc_id range are read."""
    rows = spark.read.parquet(path)
    if low is not None:
        rows = rows.where(F.col("doc_id") >= low)
    if high is not None:
        rows = rows.where(F.col("doc_id") <= high)
    offsets = part_offsets(spark, path)  # one row a file, so small enough to broadcast
    return rows.join(F.broadcast(offsets), "part").select("doc_id", (F.col("offset") + F.col("local_start")).alias("start"), "n_tokens", "ids")


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, all computed from the files."""

    def digest(batches):
        for batch in batches:
            lists = batch.column(2)
            bounds, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
            sums = [zlib.crc32(values[a:b].astype("<u4", copy=False).tobytes()) for a, b in zip(bounds, bounds[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(bounds).astype(np.int64)), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return read_token_table(spark, path).select("doc_id", "start", "ids").mapInArrow(digest, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op7_token_table(spark: SparkSession, docs: DataFrame) -> DataFrame:
    path = shared_dir(spark, "tokens")
    write_token_table(docs, path)
    return token_digests(spark, path)
