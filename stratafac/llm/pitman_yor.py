"""Hierarchical Pitman-Yor bigram model: fitted by Gibbs sampling, used for scoring.

Restaurants: one per previous word (and one for the start of a text), all with
the unigram restaurant as parent, whose parent is uniform over the training
words and one unknown word. A customer of a context's restaurant is a training
token; each of its tables is a customer of the unigram restaurant.

Everything moves as packed arrays between parts of bounded size:

* groups of texts, coded by a dictionary of their own once (``_encoded``);
* buckets of word pairs, by the hash of the context. A context with more than a
  quarter of a bucket's tokens is split by the next word, and only its totals of
  customers and tables are exchanged;
* parts of the unigram restaurant, by the hash of the word.

A group asks a bucket for each of its distinct pairs once, so a pair that is in
every text costs a bucket one entry per group. A round seats the customers of
every pair given the parent's probabilities, sends the numbers of tables to the
unigram restaurant, and seats that. Seating is a Chinese-restaurant draw in
sequence, where the customers up to the next new table are drawn in one step
(a beta-geometric number, dealt to the open tables by Polya urns), followed by Gibbs moves: a random customer of every pair leaves and sits down
again. All pairs of a part move at once, seeing each other's tables as of the
move before; tables of other parts as of the round before. The probabilities of
the rounds after the burn-in are averaged.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratafac.llm import kernels as ke
from stratafac.llm.tables import Scratch

UNKNOWN, BEGIN, END_ID = 0, 1, 2
#: The end token's code in a group until its words are counted.
END = -1

# Sizes that bound a task's memory.
GROUP_BYTES = 8 << 20
BUCKET_TOKENS = 2_000_000


@dataclass(frozen=True)
class Model:
    """Fixed hyperparameters and the length of the chain."""

    discount: float = 0.6
    strength: float = 1.0
    parent_discount: float = 0.5
    parent_strength: float = 1.0
    burn_in: int = 1
    samples: int = 2
    moves: int = 4  # Gibbs moves of each pair in a round
    seed: int = 42
    group_bytes: int = GROUP_BYTES
    bucket_tokens: int = BUCKET_TOKENS


# --- packed arrays -----------------------------------------------------------


def pack(x: np.ndarray) -> bytes:
    """Bytes of equal place together, then compressed."""
    x = np.ascontiguousarray(x)
    return zstandard.ZstdCompressor(level=1).compress(x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes())


def unpack(data: bytes | None, kind=np.int64) -> np.ndarray:
    if not data:
        return np.zeros(0, kind)
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(kind).ravel()


# --- Chinese restaurants -----------------------------------------------------


def _first_seating(rng, p, customers, context, totals, discount, strength):
    """Owner and size of the tables of a seating in sequence; ``totals`` (tables
    by context) grows with the tables opened.

    Pass k draws how many customers join the k open tables of each pair before
    the next one opens. The way back deals them: those who join tables 1 to k
    from the opening of table k on are split between k and the older ones by a
    Polya urn, so each table costs one draw.
    """
    n = len(customers)
    open_, seated, passes = np.arange(n), np.ones(n, np.int64), []
    while len(open_):
        k = len(passes) + 1
        fresh = (strength + discount * totals[context[open_]]) * p[open_]
        # the next table opens with chance r after each customer, r being beta-distributed
        r = rng.beta(fresh, seated - discount * k)
        left = customers[open_] - seated
        with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
            until = np.log(1.0 - rng.random(len(open_))) / np.log1p(-r)
        joining = np.where(until < left, until, left).astype(np.int64)
        passes.append((open_, seated, joining))
        more = joining < left
        open_, seated = open_[more], (seated + joining)[more] + 1
        np.add.at(totals, context[open_], 1)
    owners, sizes, waiting = [], [], np.zeros(n, np.int64)
    for k in range(len(passes), 0, -1):
        pairs, seated, joining = passes[k - 1]
        waiting[pairs] += joining
        own = waiting[pairs]
        if k > 1:
            own = rng.binomial(own, rng.beta(1 - discount, seated - 1 - discount * (k - 1)))
            waiting[pairs] -= own
        owners.append(pairs)
        sizes.append(own + 1)
    owner, size = np.concatenate(owners), np.concatenate(sizes)
    order = np.argsort(owner, kind="stable")
    return owner[order], size[order]


def _move(rng, owner, size, p, customers, context, totals, discount, strength):
    """One customer of every pair leaves its table and sits down again."""
    n = len(customers)
    first = np.searchsorted(owner, np.arange(n))
    last = np.append(first[1:], len(owner)) - 1
    end = np.cumsum(size)
    leaves = np.searchsorted(end, end[first] - size[first] + np.minimum((rng.random(n) * customers).astype(np.int64), customers - 1), side="right")
    size[leaves] -= 1
    empty = size[leaves] == 0
    before = last - first + 1
    tables = before - empty
    np.subtract.at(totals, context[empty], 1)
    fresh = (strength + discount * totals[context]) * p
    rest = customers - 1 - discount * tables
    opens = rng.random(n) * (fresh + rest) < fresh
    weight = np.where(size > 0, size - discount, 0.0)
    end = np.cumsum(weight)
    joins = np.searchsorted(end, end[first] - weight[first] + rng.random(n) * rest, side="right")
    joins = np.clip(joins, first, last)
    size[joins[~opens]] += 1
    owner = np.concatenate([owner, np.flatnonzero(opens)])
    size = np.concatenate([size, np.ones(int(opens.sum()), np.int64)])
    kept = size > 0
    owner, size = owner[kept], size[kept]
    order = np.argsort(owner, kind="stable")
    owner, size = owner[order], size[order]
    now = np.bincount(owner, minlength=n)
    np.add.at(totals, context, now - tables)
    return owner, size


def seat(rng: np.random.Generator, p: np.ndarray, customers: np.ndarray, context: np.ndarray, elsewhere: np.ndarray, discount: float, strength: float, moves: int) -> np.ndarray:
    """Tables of each pair: ``customers`` of dish probability ``p`` in the
    restaurant ``context``, which has ``elsewhere`` tables in other parts."""
    tables = np.minimum(customers, 1)
    totals = elsewhere + np.bincount(context, tables, len(elsewhere))
    many = np.flatnonzero(customers > 1)
    if len(many):
        p, c, at = p[many], customers[many], context[many]
        owner, size = _first_seating(rng, p, c, at, totals, discount, strength)
        for _ in range(moves):
            owner, size = _move(rng, owner, size, p, c, at, totals, discount, strength)
        tables[many] = np.bincount(owner, minlength=len(many))
    return tables


# --- texts -------------------------------------------------------------------

#: kinds: texts (ids, held, sizes, a: codes of all tokens), words (part, a: the
#: group's words of a part in order, b: their training tokens). A word's code is
#: its place in all of the group's words by part; the end token follows them.
_ENCODED = "kind string, g long, part int, ids array<long>, held array<boolean>, sizes array<long>, a binary, b binary"


class _Codes(dict):
    def __missing__(self, word):
        self[word] = n = len(self)
        return n


def _encoded(batches: Iterator[pa.RecordBatch], group_bytes: int, n_parts: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    g = TaskContext.get().partitionId() << 32
    schema = pa.schema([("kind", pa.string()), ("g", pa.int64()), ("part", pa.int32()), ("ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("sizes", pa.list_(pa.int64())), ("a", pa.binary()), ("b", pa.binary())])
    known, ids, held, parts, size = _Codes(), [], [], [], 0

    def close():
        nonlocal g, known, ids, held, parts, size
        words = list(known)
        part = np.fromiter((zlib.crc32(w) % n_parts for w in words), np.int64, len(words))
        place = np.array(sorted(range(len(words)), key=words.__getitem__), np.int64)
        place = place[np.argsort(part[place], kind="stable")]
        number = np.empty(len(words) + 1, np.int32)
        number[place], number[-1] = np.arange(len(words)), len(words)
        codes = number[np.concatenate(parts)]
        sizes = np.array([len(x) for x in parts])
        trained = np.bincount(codes[np.repeat(~np.array(held), sizes)], minlength=len(words))
        row = dict.fromkeys(schema.names)
        out = [row | {"kind": "texts", "g": g, "ids": ids, "held": held, "sizes": sizes.tolist(), "a": pack(codes)}]
        for k, (x, z) in _runs(part[place]):
            joined = zstandard.ZstdCompressor(level=1).compress(b" ".join([words[i] for i in place[x:z]]))
            out.append(row | {"kind": "words", "g": g, "part": k, "a": joined, "b": pack(trained[x:z])})
        g, known, ids, held, parts, size = g + 1, _Codes(), [], [], [], 0
        return pa.RecordBatch.from_pylist(out, schema)

    for batch in batches:
        for i, held_out, text in zip(*batch.columns):
            words = text.as_py().lower().split()  # of bytes: A-Z only, and x20 and x09 to x0D
            codes = np.empty(len(words) + 1, np.int32)
            codes[:-1], codes[-1] = np.fromiter(map(known.__getitem__, words), np.int32, len(words)), END
            parts.append(codes)
            ids.append(i.as_py())
            held.append(held_out.as_py())
            size += len(text.as_buffer()) + 64
            if size >= group_bytes:
                yield close()
    if ids:
        yield close()


def _runs(x: np.ndarray) -> Iterator[tuple[int, tuple[int, int]]]:
    """Values of a sorted array and where each begins and ends."""
    if len(x):
        cut = np.flatnonzero(np.append(True, x[1:] != x[:-1]))
        yield from zip(x[cut].tolist(), zip(cut.tolist(), np.append(cut[1:], len(x)).tolist()))


#: Replies to the groups; a part's totals stand in its first one.
_IDS = "kind string, g long, part int, a binary, b binary, tokens long, words long"


def _numbered(batch: pa.Table, n_parts: int) -> pa.Table:
    """Numbers and training tokens of a part's words for every group that has them.
    Frequent words get small numbers, which pack well."""
    rows = sorted(batch.to_pylist(), key=lambda r: r["g"])
    lists = [zstandard.ZstdDecompressor().decompress(r["a"]).split(b" ") for r in rows]
    coded = pa.chunked_array([pa.array(x, pa.binary()) for x in lists]).combine_chunks().dictionary_encode()
    at = coded.indices.to_numpy()
    c = np.bincount(at, np.concatenate([unpack(r["b"]) for r in rows]), len(coded.dictionary)).astype(np.int64)
    known = np.flatnonzero(c)
    ids = np.zeros(len(c), np.int64)
    ids[known[np.argsort(-c[known], kind="stable")]] = END_ID + rows[0]["part"] + n_parts * np.arange(1, len(known) + 1)
    out, first = [], 0
    for i, (r, x) in enumerate(zip(rows, lists)):
        mine = at[first : first + len(x)]
        first += len(x)
        out.append({"kind": "ids", "g": r["g"], "part": r["part"], "a": pack(ids[mine]), "b": pack(c[mine]), "tokens": 0 if i else int(c.sum()), "words": 0 if i else len(known)})
    return pa.Table.from_pylist(out, _schema(_IDS))


@dataclass(frozen=True)
class Counts:
    """Of the training tokens: their number, distinct ones, and texts; buckets
    of pairs, and parts of the words (a word's is that of its number)."""

    tokens: int
    words: int
    texts: int
    n_buckets: int
    n_parts: int


# --- pairs of a group ----------------------------------------------------------


def _pairs(row: dict, replies: list[dict], counts: Counts, model: Model) -> dict[str, np.ndarray]:
    """Distinct pairs of a group in order of (bucket, context, word), with the
    place of each token's pair among them."""
    codes, sizes = unpack(row["a"], np.int32), np.array(row["sizes"])
    replies = sorted((r for r in replies if r["kind"] == "ids"), key=lambda r: r["part"])
    ids = np.concatenate([*(unpack(r["a"]) for r in replies), [END_ID if counts.texts else UNKNOWN]])
    known = np.concatenate([*(unpack(r["b"]) for r in replies), [counts.texts]])
    # words by their rank among the ids; the unknown ones share one, and the start has its own
    every, rank = np.unique(np.append(ids, [UNKNOWN, BEGIN]), return_inverse=True)
    count = np.zeros(len(every), np.int64)
    count[rank[: len(ids)]] = known
    word = rank[codes]
    before = np.empty_like(word)
    before[1:] = word[:-1]
    starts = np.cumsum(sizes) - sizes
    before[starts] = rank[-1]
    key, inverse = np.unique(before * len(every) + word, return_inverse=True)
    trained = np.repeat(~np.array(row["held"]), sizes)
    u, w = np.divmod(key, len(every))
    limit = max(1, model.bucket_tokens // 4)
    context_count = count.copy()
    context_count[rank[-1]] = counts.texts
    ways = np.maximum(-(-context_count // limit), 1)
    ways[rank[-2]] = counts.n_buckets
    mixed = ke.mix(every.astype(np.uint64))
    spread = mixed[w] % ways[u].astype(np.uint64)
    bucket = (ke.mix(mixed[u] + spread) % np.uint64(counts.n_buckets)).astype(np.uint16 if counts.n_buckets < 1 << 16 else np.int64)
    order = np.argsort(bucket, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    n = np.bincount(inverse[trained], minlength=len(key))
    u, w = u[order], w[order]
    return {"bucket": bucket[order], "u": every[u], "w": every[w], "n": n[order], "split": ways[u] > 1, "place": place[inverse], "count": known[codes], "starts": starts}


_REQUEST = "bucket int, g long, u binary, w binary, n binary, split binary"


def _requests(groups: pa.Table, replies: pa.Table, counts: Counts, model: Model) -> pa.Table:
    out = []
    for row in groups.to_pylist():
        p = _pairs(row, replies.to_pylist(), counts, model)
        for bucket, (a, z) in _runs(p["bucket"]):
            u = p["u"][a:z]
            out.append({
                "bucket": bucket, "g": row["g"], "u": pack(np.diff(u, prepend=0)), "w": pack(p["w"][a:z]), "n": pack(p["n"][a:z]),
                "split": pack(np.unique(u[p["split"][a:z]])),
            })
    return pa.Table.from_pylist(out, _schema(_REQUEST))


def _schema(text: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_(), "totals": pa.list_(pa.struct([("u", pa.int64()), ("c", pa.int64()), ("t", pa.int64())]))}
    fields = [x.split(maxsplit=1) for x in text.replace(_TOTALS, "totals").split(", ")]
    return pa.schema([(name, kinds[kind]) for name, kind in fields])


_TOTALS = "array<struct<u:long,c:long,t:long>>"

# --- buckets -------------------------------------------------------------------

#: kinds: pairs (a, b, c: contexts, words, customers; d: split contexts), index
#: (g, a: places of the group's pairs), words (part, a, b: words and tables for the
#: unigram restaurant), tables (a: tables of pairs with several customers; totals
#: of the split contexts).
_BUCKET = f"kind string, bucket int, g long, part int, a binary, b binary, c binary, d binary, totals {_TOTALS}"


def _row(**values) -> dict:
    return {"kind": None, "bucket": None, "g": None, "part": None, "a": None, "b": None, "c": None, "d": None, "totals": None} | values


class _Bucket:
    """The pairs of a bucket and what the rounds need to know about them."""

    def __init__(self, bucket: int, u: np.ndarray, w: np.ndarray, c: np.ndarray, split: np.ndarray, counts: Counts):
        self.bucket, self.w, self.c, self.split, self.counts = bucket, w, c, split, counts
        new = np.append(True, u[1:] != u[:-1]) if len(u) else np.zeros(0, bool)
        self.context, self.contexts = np.cumsum(new) - 1, u[new]
        self.at_split = np.searchsorted(self.contexts, split)
        self.words, self.word = np.unique(w, return_inverse=True)
        part = (self.words - END_ID) % counts.n_parts
        part[self.words < END_ID] = -1
        self.order = np.argsort(part, kind="stable")
        self.part = part[self.order]

    def sums(self, x: np.ndarray) -> np.ndarray:
        return np.bincount(self.context, x, len(self.contexts)).astype(np.int64)

    def one_each(self) -> np.ndarray:
        return np.minimum(self.c, 1)

    def tables_of(self, row: dict | None) -> np.ndarray:
        tables = self.one_each()
        if row is not None:
            tables[self.c > 1] = unpack(row["a"])
        return tables

    def outputs(self, tables: np.ndarray) -> Iterator[dict]:
        """Rows of kinds words and tables."""
        by_word = np.bincount(self.word, tables, len(self.words)).astype(np.int64)[self.order]
        words = self.words[self.order]
        for part, (x, z) in _runs(self.part):
            if part >= 0:
                yield _row(kind="words", bucket=self.bucket, part=part, a=pack(np.diff(words[x:z], prepend=0)), b=pack(by_word[x:z]))
        c, t = self.sums(self.c)[self.at_split], self.sums(tables)[self.at_split]
        totals = [{"u": int(x), "c": int(y), "t": int(z)} for x, y, z in zip(self.split, c, t)]
        yield _row(kind="tables", bucket=self.bucket, a=pack(tables[self.c > 1]), totals=totals)

    def parents(self, replies: list[dict], root: "Root", model: Model) -> np.ndarray:
        """Parent probability of every pair's word."""
        weight = np.zeros(len(self.words))
        for r in replies:
            weight[self.order[self.part == r["part"]]] = unpack(r["a"], np.float64)
        return root.probability(weight, self.counts, model)[self.word]

    def totals(self, own: np.ndarray, row: dict | None, name: str) -> np.ndarray:
        """Sums by context over all buckets: those of split contexts from ``row``."""
        out = own.copy()
        if row is not None:
            for x in row["totals"] or ():
                out[np.searchsorted(self.contexts, x["u"])] = x[name]
        return out

    def probability(self, tables: np.ndarray, parent: np.ndarray, totals: dict | None, model: Model) -> np.ndarray:
        customers = self.totals(self.sums(self.c), totals, "c")[self.context]
        open_ = self.totals(self.sums(tables), totals, "t")[self.context]
        own = self.c - model.discount * tables
        return (own + (model.strength + model.discount * open_) * parent) / (model.strength + customers)


@dataclass(frozen=True)
class Root:
    """Totals of the unigram restaurant."""

    customers: int
    tables: int

    def probability(self, weight: np.ndarray, counts: Counts, model: Model) -> np.ndarray:
        """From each word's customers less the discounted tables."""
        rest = (model.parent_strength + model.parent_discount * self.tables) / (counts.words + 1)
        return (weight + rest) / (model.parent_strength + self.customers)


def _unique_pairs(u: np.ndarray, w: np.ndarray, n_ids: int) -> tuple[np.ndarray, np.ndarray]:
    """Order by (u, w) and where each distinct pair begins. The requests are
    sorted runs, which a stable sort of one key merges."""
    if n_ids >= 1 << 31:
        return ke.unique_rows(u, w)
    return ke.unique_rows(u * n_ids + w)


def _merged(batch: pa.Table, counts: Counts) -> pa.Table:
    """The pairs of a bucket from the requests of all groups, each with one table."""
    rows = sorted(batch.to_pylist(), key=lambda r: r["g"])
    us, ws, ns = ([f(unpack(r[k])) for r in rows] for k, f in (("u", np.cumsum), ("w", np.asarray), ("n", np.asarray)))
    split = np.unique(np.concatenate([unpack(r["split"]) for r in rows]))
    u, w, n = np.concatenate(us), np.concatenate(ws), np.concatenate(ns)
    order, firsts = _unique_pairs(u, w, int(w.max()) + 1)
    number = np.empty(len(order), np.int64)
    new = np.zeros(len(order), np.int64)
    new[firsts] = 1
    number[order] = np.cumsum(new) - 1
    c = np.add.reduceat(n[order], firsts)
    u, w = u[order][firsts], w[order][firsts]
    bucket = rows[0]["bucket"]
    out = [_row(kind="pairs", bucket=bucket, a=pack(np.diff(u, prepend=0)), b=pack(w), c=pack(c), d=pack(split))]
    at = 0
    for r, x in zip(rows, us):
        out.append(_row(kind="index", bucket=bucket, g=r["g"], a=pack(np.diff(number[at : at + len(x)], prepend=0))))
        at += len(x)
    b = _Bucket(bucket, u, w, c, split, counts)
    out.extend(b.outputs(b.one_each()))
    return pa.Table.from_pylist(out, _schema(_BUCKET))


def _bucket(rows: list[dict], counts: Counts) -> _Bucket:
    r = next(r for r in rows if r["kind"] == "pairs")
    return _Bucket(r["bucket"], np.cumsum(unpack(r["a"])), unpack(r["b"]), unpack(r["c"]), unpack(r["d"]), counts)


def _one(rows: list[dict], kind: str) -> dict | None:
    return next((r for r in rows if r["kind"] == kind), None)


def _seated(pairs: pa.Table, news: pa.Table, counts: Counts, root: Root, model: Model, step: int) -> pa.Table:
    """A round of a bucket: its customers seated anew given the parent."""
    if not pairs.num_rows:
        return _schema(_BUCKET).empty_table()
    b, news = _bucket(pairs.to_pylist(), counts), news.to_pylist()
    before = b.sums(b.tables_of(_one(news, "tables")))
    elsewhere = b.totals(before, _one(news, "totals"), "t") - before
    parent = b.parents([r for r in news if r["kind"] == "reply"], root, model)
    rng = np.random.default_rng([model.seed, step, b.bucket])
    tables = seat(rng, parent, b.c, b.context, elsewhere, model.discount, model.strength, model.moves)
    return pa.Table.from_pylist(list(b.outputs(tables)), _schema(_BUCKET))


def _answered(pairs: pa.Table, news: pa.Table, counts: Counts, roots: list[Root], model: Model) -> pa.Table:
    """Averaged log10 probabilities of every group's pairs."""
    answer = pa.schema([("g", pa.int64()), ("bucket", pa.int32()), ("a", pa.binary())])
    if not pairs.num_rows:
        return answer.empty_table()
    rows, news = pairs.to_pylist(), news.to_pylist()
    b = _bucket(rows, counts)
    p = np.zeros(len(b.c))
    for s, root in enumerate(roots):
        of = [r for r in news if r["g"] == s]
        parent = b.parents([r for r in of if r["kind"] == "reply"], root, model)
        p += b.probability(b.tables_of(_one(of, "tables")), parent, _one(of, "totals"), model)
    p = np.log10(p / len(roots)).astype(np.float32)
    out = [{"g": r["g"], "bucket": b.bucket, "a": pack(p[np.cumsum(unpack(r["a"]))])} for r in rows if r["kind"] == "index"]
    return pa.Table.from_pylist(out, answer)


# --- the unigram restaurant ------------------------------------------------------

_REPLY = "bucket int, part int, a binary, customers long, tables long"


def _unigrams(batch: pa.Table, counts: Counts, tables_before: int, model: Model, step: int) -> pa.Table:
    """A round of a part of the unigram restaurant; the first reply has the totals."""
    rows = sorted(batch.to_pylist(), key=lambda r: r["bucket"])
    words = [np.cumsum(unpack(r["a"])) for r in rows]
    known, inverse = np.unique(np.concatenate(words), return_inverse=True)
    customers = np.bincount(inverse, np.concatenate([unpack(r["b"]) for r in rows]), len(known)).astype(np.int64)
    rng = np.random.default_rng([model.seed, step, 1 << 31, rows[0]["part"]])
    p = np.full(len(known), 1.0 / (counts.words + 1))
    elsewhere = np.array([int(tables_before * (1 - len(known) / counts.words))])
    tables = seat(rng, p, customers, np.zeros(len(known), np.int64), elsewhere, model.parent_discount, model.parent_strength, model.moves)
    weight = customers - model.parent_discount * tables
    out, at = [], 0
    for i, (r, w) in enumerate(zip(rows, words)):
        mine = weight[inverse[at : at + len(w)]]
        at += len(w)
        out.append({"bucket": r["bucket"], "part": r["part"], "a": pack(mine), "customers": 0 if i else int(customers.sum()), "tables": 0 if i else int(tables.sum())})
    return pa.Table.from_pylist(out, _schema(_REPLY))


# --- the job -----------------------------------------------------------------------


def _split_totals(tables: DataFrame) -> DataFrame:
    """Totals of the split contexts for every bucket that has a share of them."""
    each = tables.where("kind = 'tables'").select("bucket", F.explode("totals").alias("x"))
    sums = each.groupBy(F.col("x.u").alias("u")).agg(F.sum("x.c").alias("c"), F.sum("x.t").alias("t"))
    back = each.select("bucket", F.col("x.u").alias("b_u")).join(sums, F.col("u") == F.col("b_u"))
    return back.groupBy("bucket").agg(F.collect_list(F.struct("u", "c", "t")).alias("totals"))


def _news(tables: DataFrame, replies: DataFrame, sample: int) -> DataFrame:
    """What the buckets get to know in a round, in the columns of ``_BUCKET``."""
    g, none, no_totals = F.lit(sample).cast("long").alias("g"), F.lit(None), F.lit(None).cast(_TOTALS).alias("totals")
    binary = none.cast("binary").alias("a")
    replied = replies.select(F.lit("reply").alias("kind"), "bucket", g, "part", "a", no_totals)
    kept = tables.where("kind = 'tables'").select("kind", "bucket", g, none.cast("int").alias("part"), "a", no_totals)
    totals = _split_totals(tables).select(F.lit("totals").alias("kind"), "bucket", g, none.cast("int").alias("part"), binary, "totals")
    return replied.union(kept).union(totals)


_SCORED = "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _scored(groups: pa.Table, replies: pa.Table, counts: Counts, model: Model) -> pa.Table:
    out = []
    for row in groups.to_pylist():
        got = replies.to_pylist()
        p = _pairs(row, got, counts, model)
        answers = sorted((r for r in got if r["kind"] == "p"), key=lambda r: r["part"])
        logs = np.concatenate([unpack(r["a"], np.float32) for r in answers]).astype(np.float64)[p["place"]]
        base = np.log10((p["count"] + 0.5) / (counts.tokens + 0.5 * (counts.words + 1)))
        sums = [np.add.reduceat(x, p["starts"]) for x in (base, logs, (p["count"] > 0).astype(np.int64))]
        columns = [row["ids"], row["held"], row["sizes"], sums[2], np.full(len(row["ids"]), counts.tokens), sums[0], sums[1]]
        out.append(pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(columns, _schema(_SCORED))], schema=_schema(_SCORED)))
    return pa.concat_tables(out) if out else _schema(_SCORED).empty_table()


def score(docs: DataFrame, model: Model = Model(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fit the model on the texts whose crc32 of the id is not 1 modulo 5 and
    score all: ``id``, ``held_out``, ``n_tokens``, ``n_known``,
    ``train_tokens``, ``base_score`` and ``score`` per row.

    Null and empty texts have the end token alone; a null id counts as not held
    out; repeated rows are texts of their own. Without training texts every
    probability is 1, the unknown word's; an empty table gives no rows. A task
    holds a group of ``group_bytes`` or one longer text. Other columns are never read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    i = F.col(id_col).cast("long")
    held = F.coalesce(F.crc32(i.cast("string")) % 5 == 1, F.lit(False))
    rows = docs.select(i.alias("id"), held.alias("held"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    group_bytes = model.group_bytes
    encoded = scratch.bucketed(rows.mapInArrow(lambda it: _encoded(it, group_bytes, n_parts), _ENCODED), "lm-encoded", n_parts, "g", "kind")
    texts = encoded.where("kind = 'texts'").select("g", "ids", "held", "sizes", "a")
    words = encoded.where("kind = 'words'").select("part", "g", "a", "b")
    ids = scratch.write(words.groupBy("part").applyInArrow(lambda t: _numbered(t, n_parts), _IDS), "lm-ids")
    n_tokens, n_words = ids.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()
    sizes, learned = F.explode(F.arrays_zip("sizes", "held")).alias("x"), F.when(~F.col("x.held"), 1)
    all_tokens, n_texts = texts.select(sizes).agg(F.coalesce(F.sum("x.sizes"), F.lit(0)), F.count(learned)).first()
    # the end token is one of the words
    counts = Counts(n_tokens + n_texts, n_words + (n_texts > 0), n_texts, max(1, math.ceil(all_tokens / model.bucket_tokens)), n_parts)
    numbers = ids.select("kind", "g", "part", "a", "b")

    asked = texts.groupBy("g").cogroup(numbers.groupBy("g")).applyInArrow(lambda d, r: _requests(d, r, counts, model), _REQUEST)
    merged = asked.groupBy("bucket").applyInArrow(lambda t: _merged(t, counts), _BUCKET)
    base = scratch.bucketed(merged, "lm-pairs", counts.n_buckets, "bucket", "kind")
    pairs, tables = base.where("kind = 'pairs'"), base.where("kind in ('words', 'tables')")
    root = Root(0, counts.words)
    news, roots, kept = None, [], []
    for step in range(model.burn_in + model.samples + 1):
        # the parts of the unigram restaurant are those of the words
        sent = tables.where("kind = 'words'").select("part", "bucket", "a", "b")
        before = root.tables
        replies = scratch.write(sent.groupBy("part").applyInArrow(lambda t: _unigrams(t, counts, before, model, step), _REPLY), f"lm-replies-{step}")
        n = replies.agg(F.sum("customers"), F.sum("tables")).first()
        root = Root(n[0] or 0, n[1] or 0)
        if step > model.burn_in:
            kept.append(_news(tables, replies, len(kept)))
            roots.append(root)
        if step < model.burn_in + model.samples:
            news, now = _news(tables, replies, 0), root
            seated = pairs.groupBy("bucket").cogroup(news.groupBy("bucket")).applyInArrow(lambda p, t: _seated(p, t, counts, now, model, step), _BUCKET)
            tables = scratch.write(seated, f"lm-tables-{step}")

    news = kept[0]
    for more in kept[1:]:
        news = news.union(more)
    known = base.where("kind in ('pairs', 'index')")
    answers = known.groupBy("bucket").cogroup(news.groupBy("bucket")).applyInArrow(lambda p, t: _answered(p, t, counts, roots, model), "g long, bucket int, a binary")
    none = F.lit(None).cast("binary").alias("b")
    both = numbers.union(answers.select(F.lit("p").alias("kind"), "g", F.col("bucket").alias("part"), "a", none))
    return texts.groupBy("g").cogroup(both.groupBy("g")).applyInArrow(lambda d, r: _scored(d, r, counts, model), _SCORED)
