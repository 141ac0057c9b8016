"""Best-fit packing planned on the histogram of lengths.

Documents are tokenised and cut into pieces; only the number of pieces of each
length is planned with. Best-fit decreasing places all pieces of one length at
once: sequences that look alike (same room left) form a range of sequence
numbers, so the plan is a list of slots "ranks [r, r + n) of this length go to
sequences [s, s + n) at this offset". Its size depends on the capacity alone
(see ``plan``), never on the number of documents. Pieces then take their slots
by joining on length and rank within length.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratafac.llm import kernels as ke

#: Bytes of text tokenised at a time, and words remembered per worker.
BATCH_BYTES = 4 << 20
REMEMBER = 1_000_000

PIECES = "id long, piece int, start long, length long, ids_crc32 long, ids array<int>"


class WordIds:
    """Token ids of white-space separated words, each tokenised once in a
    worker process.

    Valid for tokenizers that never merge across white space. Words are known
    by their 64-bit hash; new ones go to the tokenizer many at a time and are
    numbered in that order. Their hashes are kept in sorted runs, and a run
    is merged with the one before it once it is as long. Beyond ``REMEMBER``
    words the memory starts anew.
    """

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer
        self.clear()

    def clear(self) -> None:
        self.runs: list[tuple[np.ndarray, np.ndarray]] = []  # sorted hashes, numbers
        self.offsets, self.pool = np.zeros(1, np.int64), np.zeros(0, np.uint32)
        self.words = 0

    def learn(self, keys: np.ndarray, texts: list[str]) -> None:
        """``keys`` are sorted."""
        got = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        ends = self.offsets[self.words] + np.cumsum([len(x) for x in got])
        self.offsets = _room(self.offsets, self.words + 1, len(ends))
        self.pool = _room(self.pool, int(self.offsets[self.words]), int(ends[-1] - self.offsets[self.words]))
        self.pool[self.offsets[self.words] : ends[-1]] = np.fromiter(chain.from_iterable(got), np.uint32, int(ends[-1] - self.offsets[self.words]))
        self.offsets[self.words + 1 : self.words + 1 + len(ends)] = ends
        run = (keys, np.arange(self.words, self.words + len(keys)))
        self.words += len(keys)
        while self.runs and len(self.runs[-1][0]) <= len(run[0]):
            before = self.runs.pop()
            run = tuple(np.concatenate(x) for x in zip(before, run))
            order = np.argsort(run[0], kind="stable")
            run = tuple(x[order] for x in run)
        self.runs.append(run)

    def numbers(self, keys: np.ndarray) -> np.ndarray:
        """Numbers of the words with these hashes, -1 for new ones."""
        out = np.full(len(keys), -1, np.int64)
        for known, number in self.runs:
            at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
            out = np.where(known[at] == keys, number[at], out)
        return out

    def ids(self, b: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and the offsets of the texts."""
        s, e, h, doc = ke.words(b, off)
        u, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        number = self.numbers(u)
        if self.words + (number < 0).sum() > REMEMBER:
            self.clear()
            number[:] = -1
        fresh = np.flatnonzero(number < 0)
        if len(fresh):
            raw = b.tobytes()
            number[fresh] = self.words + np.arange(len(fresh))
            self.learn(u[fresh], [raw[s[i] : e[i]].decode("utf-8") for i in first[fresh]])
        ids, ends = gather(self.pool, self.offsets, number[inverse])
        ends = np.concatenate([[0], ends])
        return ids, ends[np.searchsorted(doc, np.arange(len(off)))]


def _room(x: np.ndarray, used: int, more: int) -> np.ndarray:
    """``x`` with room for ``more`` values after the first ``used``."""
    if used + more <= len(x):
        return x
    out = np.zeros(max(used + more, 2 * len(x)), x.dtype)
    out[:used] = x[:used]
    return out


def gather(pool: np.ndarray, offsets: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenate the pool's pieces ``index``; returns them and their ends."""
    size = (offsets[index + 1] - offsets[index]).astype(np.int64)
    end = np.cumsum(size)
    if not len(index) or end[-1] == 0:
        return pool[:0], end
    at = np.repeat(offsets[index] - (end - size), size)
    at += np.arange(end[-1])
    return pool[at], end


def word_ids(text: str) -> WordIds:
    """The worker's memory of a tokenizer file's words; the file is parsed once per process."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    cache = ke.worker_cache()
    name = ("words", len(text), zlib.crc32(text.encode()))
    if name not in cache:
        cache[name] = WordIds(Tokenizer.from_str(text))
    return cache[name]


def _token_pieces(batches: Iterator[pa.RecordBatch], text: str, capacity: int, end_id: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    words = word_ids(text)
    for batch in batches:
        b, off = ke.text_buffer(batch.column(1))
        names = batch.column(0)
        i, n = 0, len(off) - 1
        while i < n:
            j = max(i + 1, int(np.searchsorted(off, off[i] + BATCH_BYTES, side="right")) - 1)
            ids, first = words.ids(b[off[i] : off[j]], off[i : j + 1] - off[i])
            # append the end id to every document
            ids = np.insert(ids, first[1:], end_id).astype("<u4")
            first = first + np.arange(len(first))
            doc, piece, start, length, crc = [], [], [], [], []
            lists = [0]
            for k in range(j - i):
                lo, hi = int(first[k]), int(first[k + 1])
                for p, at in enumerate(range(lo, hi, capacity)):
                    to = min(at + capacity, hi)
                    doc.append(i + k)
                    piece.append(p)
                    start.append(at - lo)
                    length.append(to - at)
                    crc.append(zlib.crc32(ids[at:to].tobytes()))
                    lists.append(to)
            values = pa.array(ids.astype(np.int32) if with_ids else np.zeros(0, np.int32), pa.int32())
            id_lists = pa.ListArray.from_arrays(pa.array(lists if with_ids else [0] * len(lists), pa.int32()), values)
            yield pa.RecordBatch.from_arrays(
                [names.take(pa.array(doc, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), id_lists],
                ["id", "piece", "start", "length", "ids_crc32", "ids"],
            )
            i = j


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1, with_ids: bool = True,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenise whole texts, append ``end_id`` and cut what is longer than
    ``capacity``: ``id``, ``piece``, ``start``, ``length``, ``ids_crc32`` (of
    little-endian unsigned 32-bit ids) and ``ids`` (empty if not ``with_ids``).

    The tokenizer must not merge across white space (a word's ids are then the
    same everywhere). Null and empty texts give one piece with the end id.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(lambda it: _token_pieces(it, shared.value, capacity, end_id, with_ids), PIECES)


def plan(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Best-fit decreasing over counts.

    Returns slots (length, first rank, count, first sequence, offset) and the
    number of sequences. Sequences of equal room form ranges; a length fills
    the sequences with the least sufficient room as far as they go, then opens
    new ones. All sequences that a length fills alike take one slot per piece
    in them, and the last one, which may stay half filled, takes its own, so
    each of the rooms in use gives at most ``2 * capacity / length`` slots to
    a length, whatever the counts.
    """
    rooms: list[int] = []  # sorted rooms that have ranges
    ranges: dict[int, list[tuple[int, int]]] = {}  # room -> ranges (first, count)
    slots = []
    opened = 0

    def put(room: int, first: int, count: int) -> None:
        if room > 0 and count > 0:
            if room not in ranges:
                bisect.insort(rooms, room)
                ranges[room] = []
            ranges[room].append((first, count))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} doesn't fit {capacity}")
        while left:
            i = bisect.bisect_left(rooms, length)
            if i < len(rooms):
                room = rooms[i]
                first, count = ranges[room].pop()
                if not ranges[room]:
                    del ranges[room]
                    rooms.pop(i)
            else:
                room, first = capacity, opened
                count = -(-left // (capacity // length))
                opened += count
            per = room // length
            # sequences filled with ``per`` pieces each, then one with the rest
            for n, pieces in ((min(count, left // per), per), (1, left % per)):
                if n and pieces and count and left >= n * pieces:
                    for k in range(pieces):
                        slots.append((length, rank, n, first, capacity - room + k * length))
                        rank += n
                    put(room - pieces * length, first, n)
                    first, count, left = first + n, count - n, left - n * pieces
            put(room, first, count)
    return slots, opened


def _ranked(pieces: DataFrame, salts: int) -> DataFrame:
    """Add ``rank`` (from 0) within ``length``; a length that most pieces have
    is ranked in ``salts`` parts whose counts are summed up."""
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("id", "piece"), F.lit(salts)).cast("int"))
    counts = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    w = Window.partitionBy("length").orderBy("_salt")
    before = counts.select(F.col("length").alias("_length"), F.col("_salt").alias("_part"), (F.sum("_n").over(w) - F.col("_n")).alias("_before"))
    order = Window.partitionBy("length", "_salt").orderBy(F.col("id").asc_nulls_first(), "piece", "ids_crc32")
    local = salted.withColumn("_local", F.row_number().over(order))
    out = local.join(before, (F.col("length") == F.col("_length")) & (F.col("_salt") == F.col("_part")))
    return out.withColumn("rank", F.col("_before") + F.col("_local") - 1).drop("_salt", "_length", "_part", "_before", "_local")


def pack(pieces: DataFrame, capacity: int = 4096, rows_per_part: int = 4_000) -> DataFrame:
    """Give every row of ``pieces`` (with ``id``, ``piece``, ``length``,
    ``ids_crc32``) a ``sequence_id`` and a gapless ``offset`` in it.

    ``pieces`` is read three times: pass a written table. The histogram has
    ``capacity`` rows at most and the slot table is bounded by ``plan``, so
    both pass through the driver whatever the input. Rows alike are packed
    each; an empty table gives an empty result.
    """
    spark = pieces.sparkSession
    counted = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots, _ = plan(counted, capacity)
    schema = "s_length long, s_rank long, s_count long, s_first long, s_offset long"
    slot_table = spark.createDataFrame(slots, schema)
    salts = max(1, -(-max(counted.values(), default=1) // rows_per_part))
    ranked = _ranked(pieces, salts)
    inside = (F.col("length") == F.col("s_length")) & (F.col("rank") >= F.col("s_rank")) & (F.col("rank") < F.col("s_rank") + F.col("s_count"))
    # the slot table is bounded by the capacity alone (see ``plan``)
    placed = ranked.join(F.broadcast(slot_table), inside)
    placed = placed.withColumn("sequence_id", F.col("s_first") + F.col("rank") - F.col("s_rank")).withColumn("offset", F.col("s_offset"))
    return placed.drop("rank", "s_length", "s_rank", "s_count", "s_first", "s_offset")
