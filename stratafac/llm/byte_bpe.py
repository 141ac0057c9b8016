"""Byte-level BPE encoding and decoding on NumPy matrices.

A batch of texts is split into pre-tokens by one vectorised pass over code
point classes (the public split pattern's classes: letters, numbers, white
space, rest). Distinct pre-tokens are encoded once: they are put into matrices
by length bucket, one row each, and in every round every row merges its
leftmost pair of minimum rank; pair ranks come from a hashed pair table, and
rows are compacted to the left after each merge. Ids are kept per worker for
pre-tokens seen before, in a bounded table.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratafac.llm import kernels as ke

#: Bytes of text handled at a time in a task.
BATCH_BYTES = 1 << 20
#: Pre-tokens remembered per worker; beyond it the memory starts anew.
REMEMBER = 400_000
#: Rows longer than this merge all non-overlapping pairs of their minimum rank
#: in a round (the same result if a token's rank exceeds its parts' ranks).
LONG_ROW = 96

_LETTER, _NUMBER, _SPACE, _OTHER = 1, 2, 3, 0
#: The contractions that the split pattern tries first.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


class Vocabulary:
    """Token bytes by id, and the pair table, of a rank file.

    The pair table holds (left id, right id) -> merged id for every split of a
    token into two tokens, in an open-addressing hash table that is probed for
    whole arrays at once.
    """

    def __init__(self, lines: list[str]):
        ranks: dict[bytes, int] = {}
        for line in lines:
            if line.strip():
                token, rank = line.split()
                ranks[base64.b64decode(token)] = int(rank)
        self.size = max(ranks.values()) + 1
        by_id: list[bytes] = [b""] * self.size
        for token, rank in ranks.items():
            by_id[rank] = token
        self.pool = np.frombuffer(b"".join(by_id), np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(t) for t in by_id])]).astype(np.int64)
        self.byte_id = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        pairs = [
            (ranks[t[:i]], ranks[t[i:]], r)
            for t, r in ranks.items()
            for i in range(1, len(t))
            if t[:i] in ranks and t[i:] in ranks
        ]
        left, right, merged = (np.array(x, np.int64) for x in zip(*pairs))
        self.rising = bool(np.all(merged > np.maximum(left, right)))
        bits = max(4, int(len(pairs) * 2).bit_length())
        self.mask = (1 << bits) - 1
        self.slot_key = np.full(1 << bits, -1, np.int64)
        self.slot_value = np.full(1 << bits, -1, np.int32)
        key = left * self.size + right
        todo = np.arange(len(key))
        at = self._slot(key)
        while len(todo):
            free = self.slot_key[at[todo]] == -1
            place, first = np.unique(at[todo][free], return_index=True)
            winner = todo[free][first]
            self.slot_key[place] = key[winner]
            self.slot_value[place] = merged[winner]
            todo = np.setdiff1d(todo, winner, assume_unique=True)
            taken = self.slot_key[at[todo]] != key[todo]
            at[todo[taken]] = (at[todo[taken]] + 1) & self.mask

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (ke.mix(key.astype(np.uint64)) & np.uint64(self.mask)).astype(np.int64)

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merged id of each pair, or the largest int32 where there is none."""
        out = np.full(left.shape, np.iinfo(np.int32).max, np.int32)
        ok = (left >= 0) & (right >= 0)
        key = left[ok].astype(np.int64) * self.size + right[ok]
        got = np.full(len(key), np.iinfo(np.int32).max, np.int32)
        at = self._slot(key)
        open_ = np.arange(len(key))
        while len(open_):
            found = self.slot_key[at[open_]]
            hit = found == key[open_]
            got[open_[hit]] = self.slot_value[at[open_[hit]]]
            open_ = open_[~hit & (found != -1)]
            at[open_] = (at[open_] + 1) & self.mask
        out[ok] = got
        return out


def load_vocabulary(lines: list[str]) -> Vocabulary:
    """The worker's copy of the vocabulary, built once per process."""
    cache = ke.worker_cache()
    name = ("bpe", len(lines), hashlib.sha256("\n".join(lines).encode()).hexdigest())
    if name not in cache:
        cache[name] = Vocabulary(lines)
    return cache[name]


def _classes() -> np.ndarray:
    """Class of every code point, from the pattern engine's own properties."""
    cache = ke.worker_cache()
    if "classes" not in cache:
        import regex

        table = np.zeros(0x110000, np.uint8)
        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        for code, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_SPACE, r"\s+")):
            for m in regex.finditer(pattern, every):
                s, e = (x if x < 0xD800 else x + 0x800 for x in m.span())
                table[s:e] = code
        cache["classes"] = table
    return cache["classes"]


def split_points(b: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Byte places at which pre-tokens of the texts begin (empty texts have none).

    The vectorised form of ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+|
    ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``.
    """
    if not len(b):
        return np.zeros(0, np.int64)
    lead = (b & 0xC0) != 0x80  # first byte of each code point
    cp = np.frombuffer(b.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    place = np.flatnonzero(lead)
    kind = _classes()[cp]
    n = len(cp)
    begins = np.zeros(n + 1, bool)
    begins[np.searchsorted(place, offsets)] = True  # a text begins (or all end) here
    begins = begins[: n + 1]
    begins[n] = True
    new = np.ones(n, bool)
    new[1:] = (kind[1:] != kind[:-1]) | begins[1:n]
    space = kind == _SPACE
    # the last character of a white-space run that is followed by something
    # else in its text: a blank joins the next token, others stand alone
    last = np.zeros(n, bool)
    last[:-1] = space[:-1] & ~space[1:] & ~begins[1:n]
    joined = last & (cp == 0x20)
    new |= last
    after = np.flatnonzero(joined) + 1
    new[after] = False
    # contractions: an apostrophe that starts a token and is followed by one of the endings
    quote = np.flatnonzero((cp == 0x27) & new)
    for ending in CONTRACTIONS:
        k = len(ending)
        fits = quote[quote + k < n]
        ok = np.ones(len(fits), bool)
        for j, ch in enumerate(ending, 1):
            ok &= (cp[fits + j] == ord(ch)) & ~begins[fits + j]
        fits = fits[ok]
        quote = np.setdiff1d(quote, fits, assume_unique=True)
        new[fits + 1] = False
        rest = fits + 1 + k
        rest = rest[rest < n]
        # what is left of the letters begins a token of its own
        new[rest[(kind[rest] == _LETTER) & ~begins[rest]]] = True
    return place[new]


def merge_rows(vocab: Vocabulary, rows: np.ndarray) -> np.ndarray:
    """Encode a matrix of byte ids (one pre-token per row, padded with -1)."""
    none = np.iinfo(np.int32).max
    rows = rows.copy()
    active = np.arange(len(rows))
    rank = vocab.merged(rows[:, :-1], rows[:, 1:])
    while len(active):
        best = rank.argmin(axis=1)  # leftmost minimum
        least = rank[np.arange(len(active)), best]
        live = least < none
        if not live.all():
            active, rank, best, least = active[live], rank[live], best[live], least[live]
            if not len(active):
                break
        x = rows[active]
        w = x.shape[1]
        # put the merged id in place and shift the rest left by one
        col = np.arange(w - 1)
        x[:, :-1] = np.where(col > best[:, None], x[:, 1:], x[:, :-1])
        x[:, -1] = -1
        i = np.arange(len(active))
        x[i, best] = least
        rows[active] = x
        rank[:, :-1] = np.where(col[:-1] > best[:, None], rank[:, 1:], rank[:, :-1])
        rank[:, -1] = none
        rank[i, best] = vocab.merged(x[i, best], x[i, best + 1])
        has = best > 0
        rank[i[has], best[has] - 1] = vocab.merged(x[i[has], best[has] - 1], x[i[has], best[has]])
        longest = int((x >= 0).sum(axis=1).max())
        if longest < 2:
            break
        if longest < w // 2:  # compaction of the columns
            rows[active, :longest] = merge_rows(vocab, rows[active][:, :longest])
            break
    return rows


def merge_long(vocab: Vocabulary, ids: np.ndarray) -> np.ndarray:
    """Encode one long pre-token: all leftmost non-overlapping pairs of the
    minimum rank merge in a round. New pairs hold the merged token and rank
    above it (``Vocabulary.rising``), so the order of merges is the same."""
    none = np.iinfo(np.int32).max
    while len(ids) > 1:
        rank = vocab.merged(ids[:-1], ids[1:])
        least = rank.min()
        if least == none:
            break
        at = np.flatnonzero(rank == least)
        if not vocab.rising:
            at = at[:1]
        # of overlapping places take every other one, from the left
        run = np.concatenate([[True], np.diff(at) > 1])
        since = np.arange(len(at)) - np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
        at = at[since % 2 == 0]
        ids = ids.copy()
        ids[at] = least
        ids = np.delete(ids, at + 1)
    return ids


def _gather(pool: np.ndarray, offsets: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenate the pool's pieces ``index``; returns them and their ends."""
    size = (offsets[index + 1] - offsets[index]).astype(np.int64)
    end = np.cumsum(size)
    if not len(index) or end[-1] == 0:
        return pool[:0], end
    at = np.repeat(offsets[index] - (end - size), size)
    at += np.arange(end[-1])
    return pool[at], end


class Memory:
    """Ids of pre-tokens seen before: sorted hashes, and a pool of ids."""

    def __init__(self):
        self.keys = np.zeros(0, np.uint64)
        self.offsets = np.zeros(1, np.int64)
        self.pool = np.zeros(0, np.int32)

    def add(self, keys: np.ndarray, offsets: np.ndarray, pool: np.ndarray) -> None:
        every = np.concatenate([self.keys, keys])
        order = np.argsort(every, kind="stable")
        both = np.concatenate([self.pool, pool])
        starts = np.concatenate([self.offsets, offsets[1:] + self.offsets[-1]])
        self.pool, end = _gather(both, starts, order)
        self.keys, self.offsets = every[order], np.concatenate([[0], end])


def encode_pretokens(vocab: Vocabulary, b: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and ids of the byte strings ``b[start:end]``."""
    size = end - start
    out_len = np.zeros(len(start), np.int64)
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    edges = [0, *(1 << j for j in range(LONG_ROW.bit_length()) if 1 << j < LONG_ROW), LONG_ROW]
    for lo, hi in zip(edges[:-1], edges[1:]):
        mine = np.flatnonzero((size > lo) & (size <= hi))
        for s in range(0, len(mine), 50_000):
            i = mine[s : s + 50_000]
            at = start[i, None] + np.arange(hi)
            rows = np.where(at < end[i, None], vocab.byte_id[b[np.minimum(at, len(b) - 1)]], -1).astype(np.int32)
            if hi > 1:
                rows = merge_rows(vocab, rows)
            held = rows >= 0
            out_len[i] = held.sum(axis=1)
            parts.append((i, rows[held]))
    for i in np.flatnonzero(size > LONG_ROW):
        ids = merge_long(vocab, vocab.byte_id[b[start[i] : end[i]]])
        out_len[i] = len(ids)
        parts.append((np.array([i]), ids))
    offsets = np.concatenate([[0], np.cumsum(out_len)])
    pool = np.empty(offsets[-1], np.int32)
    for i, ids in parts:
        n = out_len[i]
        pool[np.repeat(offsets[i] - (np.cumsum(n) - n), n) + np.arange(len(ids))] = ids
    return offsets, pool


def encode_batch(vocab: Vocabulary, b: np.ndarray, offsets: np.ndarray, memory: Memory) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts one after the other, and each text's first place."""
    start = split_points(b, offsets)
    if not len(start):
        return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
    end = np.append(start[1:], len(b))
    c, pi = ke.prefix_sums(b)
    key = ke.mix((c[end] - c[start]) * pi[start] + (end - start).astype(np.uint64))
    u, first, inverse = np.unique(key, return_index=True, return_inverse=True)
    at = np.searchsorted(memory.keys, u)
    known = (memory.keys[np.minimum(at, len(memory.keys) - 1)] == u) if len(memory.keys) else np.zeros(len(u), bool)
    if not known.all():
        i = first[~known]
        ids_off, ids = encode_pretokens(vocab, b, start[i], end[i])
        if len(memory.keys) + len(i) > REMEMBER:
            memory.__init__()
            i = first
            ids_off, ids = encode_pretokens(vocab, b, start[i], end[i])
            memory.add(u, ids_off, ids)
        else:
            memory.add(u[~known], ids_off, ids)
        at = np.searchsorted(memory.keys, u)
    ids, ends = _gather(memory.pool, memory.offsets, at[inverse])
    ends = np.concatenate([[0], ends])
    return ids, ends[np.searchsorted(start, offsets)]


def _slices(off: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``BATCH_BYTES`` (one longer text by itself)."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + BATCH_BYTES, side="right")) - 1)
        yield i, j
        i = j


def _pieces(b: np.ndarray) -> Iterator[np.ndarray]:
    """A long text in pieces of about ``BATCH_BYTES``, cut before a blank that
    follows a printing ASCII character: a token always begins there."""
    s = 0
    while len(b) - s > 2 * BATCH_BYTES:
        at = s + BATCH_BYTES
        cut = np.flatnonzero((b[at:] == 0x20) & (b[at - 1 : -1] > 0x20) & (b[at - 1 : -1] < 0x7F))
        if not len(cut):
            break
        yield b[s : at + cut[0]]
        s = at + int(cut[0])
    yield b[s:]


def encode_texts(batches: Iterator[pa.RecordBatch], lines: list[str]) -> Iterator[pa.RecordBatch]:
    vocab, memory = load_vocabulary(lines), Memory()
    for batch in batches:
        b, off = ke.text_buffer(batch.column(1))
        for i, j in _slices(off):
            if off[j] - off[i] > 2 * BATCH_BYTES:
                ids = np.concatenate([encode_batch(vocab, x, np.array([0, len(x)]), memory)[0] for x in _pieces(b[off[i] : off[j]])])
                first = np.array([0, len(ids)])
            else:
                ids, first = encode_batch(vocab, b[off[i] : off[j]], off[i : j + 1] - off[i], memory)
            lists = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), lists], ["id", "ids"])


def read_ranks(path: str) -> list[str]:
    """Lines of a rank file (vocabulary files are bounded and part of the installation)."""
    with open(path) as f:
        return f.read().split("\n")


def encode(docs: DataFrame, ranks: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token ids of every whole text: ``id``, ``ids`` (array of int).

    Defined cases: a null or empty text has no ids; a text is never cut, and
    pre-tokens of any length are encoded; equal rows are encoded each; an
    empty table gives an empty result; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(ranks)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(lambda it: encode_texts(it, shared.value), "id long, ids array<int>")


def decode_ids(vocab: Vocabulary, ids: np.ndarray) -> bytes:
    """Bytes of a sequence of ids."""
    return _gather(vocab.pool, vocab.offsets, ids.astype(np.int64))[0].tobytes()


def _list_parts(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    off = col.offsets.to_numpy()
    return col.values.to_numpy(zero_copy_only=False), off


def decode_lists(batches: Iterator[pa.RecordBatch], lines: list[str]) -> Iterator[pa.RecordBatch]:
    vocab = load_vocabulary(lines)
    for batch in batches:
        ids, off = _list_parts(batch.column(1))
        out = [decode_ids(vocab, ids[s:e]) for s, e in zip(off[:-1], off[1:])]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["id", "data"])


def decode(encoded: DataFrame, ranks: list[str], id_col: str = "id", ids_col: str = "ids") -> DataFrame:
    """Bytes of every row's ids: ``id``, ``data``. Null ids decode to no bytes."""
    shared = encoded.sparkSession.sparkContext.broadcast(ranks)
    ids = F.coalesce(F.col(ids_col), F.array().cast("array<int>"))
    rows = encoded.select(F.col(id_col).cast("long").alias("id"), ids.alias("ids"))
    return rows.mapInArrow(lambda it: decode_lists(it, shared.value), "id long, data binary")


def digest_lists(batches: Iterator[pa.RecordBatch], lines: list[str]) -> Iterator[pa.RecordBatch]:
    """Count and digests of ids (as decimal numbers joined by commas) and of the decoded bytes."""
    vocab = load_vocabulary(lines)
    numbers = [f"{i},".encode() for i in range(vocab.size)]
    pool = np.frombuffer(b"".join(numbers), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in numbers])]).astype(np.int64)
    for batch in batches:
        ids, off = _list_parts(batch.column(1))
        n, text_sha, data_sha = [], [], []
        for s, e in zip(off[:-1], off[1:]):
            decimal, data = hashlib.sha256(), hashlib.sha256()
            for i in range(s, e, BATCH_BYTES // 4):
                part = ids[i : min(e, i + BATCH_BYTES // 4)].astype(np.int64)
                written = _gather(pool, offsets, part)[0].tobytes()
                decimal.update(written if i + len(part) < e else written[:-1])
                data.update(_gather(vocab.pool, vocab.offsets, part)[0].tobytes())
            n.append(int(e - s))
            text_sha.append(decimal.hexdigest())
            data_sha.append(data.hexdigest())
        cols = [batch.column(0), pa.array(n, pa.int64()), pa.array(text_sha), pa.array(data_sha)]
        yield pa.RecordBatch.from_arrays(cols, ["id", "n_tokens", "ids_sha256", "decoded_sha256"])


def digests(encoded: DataFrame, ranks: list[str]) -> DataFrame:
    """``id``, ``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` of ``encode``'s rows."""
    shared = encoded.sparkSession.sparkContext.broadcast(ranks)
    schema = "id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return encoded.mapInArrow(lambda it: digest_lists(it, shared.value), schema)
