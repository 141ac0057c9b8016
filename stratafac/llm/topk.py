"""Exact top-k search by block-at-a-time pruning.

Vectors are laid out in blocks: up to ``BLOCK_ROWS`` vectors that are
neighbours by id, stored as a matrix (the block's forward index; 16-bit
integers where they suffice) with the largest and smallest value of every term.
For a query, a block can score at most the sum over terms of the larger of
``q * max`` and ``q * min``. Blocks are visited in the order of that bound and
scored through their forward index, until the bound falls below the k-th score
so far; a block whose bound equals it is still visited if it has an id that is
smaller than the k-th result's, because ties go to smaller ids.

Queries are dealt into chunks. Four steps, each in cells of bounded size:

1. Chunks meet the blocks' bounds (not the blocks); the block with the highest
   bound for a query is its seed.
2. A chunk's seeds are scored, which gives every query a first k-th result.
3. Chunks meet the bounds again; only pairs of a chunk and a block that may
   still hold a better result for one of its queries are kept.
4. Only these blocks are sent to the chunk and scored, best bound first. One
   window per query merges the answers.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratafac.llm.tables import written

BLOCK_ROWS = 256
#: Vectors in a group of blocks and queries in a chunk.
GROUP_ROWS = 16_384
CHUNK_ROWS = 1_024
#: Blocks whose bounds meet a chunk in one cell.
SLICE_BLOCKS = 4_096

BLOCK = "dim int, least long, ids binary, wide boolean, matrix binary, high binary, low binary"
FOUND = "q_no long, pos int, query long, score long, vec long"
NONE = np.iinfo(np.int64).min
LAST = np.iinfo(np.int64).max


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """Rows with an id and a vector of finite components; ``unit`` per whole."""
    v = F.col(vec_col)
    ok = F.col(id_col).isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.where(ok).select(F.col(id_col).cast("long").alias("id"), v.cast("array<double>").alias("v"))


def pack_block(ids: list[int], rows: np.ndarray) -> dict:
    """A block's columns."""
    m = np.ascontiguousarray(rows, np.int64)
    wide = bool(m.size) and (m.max() > 32_767 or m.min() < -32_768)
    kept = m if wide else m.astype(np.int16)
    return {"dim": m.shape[1], "least": min(ids), "ids": np.array(ids, np.int64).tobytes(), "wide": wide, "matrix": kept.tobytes(), "high": m.max(axis=0).tobytes(), "low": m.min(axis=0).tobytes()}


def _blocks(batches, scale: float, rows: int):
    """Pack sorted (id, v) rows into blocks, one length of vectors each."""
    held: dict[int, list] = {}

    def block(dim: int, part: list) -> pa.RecordBatch:
        kept = pack_block([i for i, _ in part], np.stack([m for _, m in part]).astype(np.int64))
        kinds = (pa.int32(), pa.int64(), pa.binary(), pa.bool_(), pa.binary(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(kept.values(), kinds)], list(kept))

    for batch in batches:
        ids = batch.column(0).to_numpy()
        off = batch.column(1).offsets.to_numpy()
        flat = np.floor(batch.column(1).values.to_numpy(zero_copy_only=False) * scale)
        for i, (s, e) in enumerate(zip(off[:-1], off[1:])):
            dim = int(e - s)
            part = held.setdefault(dim, [])
            part.append((int(ids[i]), flat[s:e].copy()))
            if len(part) >= rows:
                yield block(dim, held.pop(dim))
    for dim, part in held.items():
        yield block(dim, part)


def _packed(rows: DataFrame, n_rows: int, scale: float, block_rows: int, per_task: int, name: str) -> DataFrame:
    """A written table of blocks in id order, numbered."""
    parts = max(1, math.ceil(n_rows / per_task))
    key = F.xxhash64("v")
    ranged = rows.withColumn("k", key).repartitionByRange(parts, "id", "k").sortWithinPartitions("id", "k", "v").select("id", "v")
    blocks = ranged.mapInArrow(lambda it: _blocks(it, scale, block_rows), BLOCK)
    return written(blocks.withColumn("no", F.monotonically_increasing_id()), name)


def unpack(ids: bytes, dim: int, wide: bool, matrix: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Ids and matrix of a block."""
    names = np.frombuffer(ids, np.int64)
    return names, np.frombuffer(matrix, np.int64 if wide else np.int16).reshape(len(names), dim).astype(np.int64)


def _kind(q: np.ndarray, most: int):
    """Products in doubles are exact below 2^53."""
    return np.float64 if most * int(np.abs(q).max(initial=0)) * max(1, q.shape[1]) < 2**53 else np.int64


def bounds(q: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """The most that each block can score for each query."""
    kind = _kind(q, max(int(np.abs(high).max(initial=0)), int(np.abs(low).max(initial=0))))
    q, high, low = q.astype(kind), high.astype(kind), low.astype(kind)
    return (np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T).astype(np.int64)


def _reaches(bound: np.ndarray, least: np.ndarray, score: np.ndarray, who: np.ndarray) -> np.ndarray:
    """Whether a block of this bound and least id can improve on a k-th result."""
    return (score == NONE) | (bound > score) | ((bound == score) & (least < who))


def search(q_ids: np.ndarray, q: np.ndarray, index: list[tuple[np.ndarray, np.ndarray]], k: int, floor: tuple[np.ndarray, np.ndarray] | None = None):
    """Top k (scores, ids) of every query over the blocks of ``index``, and the
    number of (query, block) pairs scored. ``floor`` is a k-th result (score,
    id) that each query has already; what doesn't improve on it may be left out.
    """
    high, low = (np.stack([f(m, axis=0) for _, m in index]) for f in (np.max, np.min))
    least = np.array([ids.min() for ids, _ in index])
    bound = bounds(q, high, low)
    kind = _kind(q, max(int(np.abs(m).max(initial=0)) for _, m in index))
    qk = q.astype(kind)
    order = np.argsort(~bound, axis=1, kind="stable")
    best, who = np.full((len(q), k), NONE, np.int64), np.full((len(q), k), LAST, np.int64)
    f_score, f_who = floor if floor is not None else (np.full(len(q), NONE), np.full(len(q), LAST))
    live, scored = np.arange(len(q)), 0
    for turn in range(len(index)):
        at = order[live, turn]
        # ends: neither the floor nor the k-th score so far can be reached by this or later blocks
        reach = np.maximum(f_score[live], best[live, -1])
        going = bound[live, at] >= reach
        live, at = live[going], at[going]
        if not len(live):
            break
        useful = _reaches(bound[live, at], least[at], f_score[live], f_who[live]) & _reaches(bound[live, at], least[at], best[live, -1], who[live, -1])
        for j in np.unique(at[useful]):
            rows = live[useful & (at == j)]
            ids, m = index[j]
            score = (qk[rows] @ m.astype(kind).T).astype(np.int64)
            score = np.where(ids[None, :] == q_ids[rows, None], NONE, score)
            scored += len(rows)
            s = np.concatenate([best[rows], score], axis=1)
            w = np.concatenate([who[rows], np.broadcast_to(ids, score.shape)], axis=1)
            w = np.where(s == NONE, LAST, w)
            pick = np.lexsort((w, ~s), axis=1)[:, :k]
            best[rows] = np.take_along_axis(s, pick, axis=1)
            who[rows] = np.take_along_axis(w, pick, axis=1)
    return best, who, scored


def _chunks(t: pa.Table) -> list[dict]:
    """Query chunks of a cell with their ids, matrices and, if asked for, floors."""
    out = []
    for r in t.to_pylist():
        ids, q = unpack(r["ids"], r["dim"], r["wide"], r["matrix"])
        score, who = np.full(len(ids), NONE), np.full(len(ids), LAST)
        for f in r.get("floors") or []:
            score[f["pos"]], who[f["pos"]] = f["score"], f["vec"]
        out.append({"no": r["q_no"], "ids": ids, "q": q, "floor": (score, who)})
    return out


def _ends(t: pa.Table, dim: int) -> tuple[np.ndarray, ...]:
    """Numbers, largest and smallest values and least ids of a cell's blocks of ``dim`` terms."""
    mine = [r for r in t.to_pylist() if r["dim"] == dim]
    high, low = (np.array([np.frombuffer(r[c], np.int64) for r in mine], np.int64).reshape(len(mine), dim) for c in ("high", "low"))
    return np.array([r["no"] for r in mine], np.int64), high, low, np.array([r["least"] for r in mine], np.int64)


def _seeds(queries: pa.Table, ends: pa.Table) -> pa.Table:
    """For every query the block of the highest bound of a cell."""
    cols: dict[str, list] = {n: [np.zeros(0, np.int64)] for n in ("q_no", "pos", "no", "bound")}
    for c in _chunks(queries):
        numbers, high, low, _ = _ends(ends, c["q"].shape[1])
        if len(numbers):
            bound = bounds(c["q"], high, low)
            at = bound.argmax(axis=1)
            for n, v in zip(cols, (np.full(len(at), c["no"]), np.arange(len(at)), numbers[at], bound.max(axis=1))):
                cols[n].append(v)
    return pa.table({n: pa.array(np.concatenate(v), pa.int32() if n == "pos" else pa.int64()) for n, v in cols.items()})


def _survivors(queries: pa.Table, ends: pa.Table) -> pa.Table:
    """(chunk, block) pairs of a cell in which a query can find a better result."""
    q_no, no = [], []
    for c in _chunks(queries):
        numbers, high, low, least = _ends(ends, c["q"].shape[1])
        if len(numbers):
            score, who = c["floor"]
            open_ = _reaches(bounds(c["q"], high, low), least[None, :], score[:, None], who[:, None]).any(axis=0)
            q_no += [c["no"]] * int(open_.sum())
            no += numbers[open_].tolist()
    return pa.table({"q_no": pa.array(q_no, pa.int64()), "no": pa.array(no, pa.int64())})


def _cell(blocks: pa.Table) -> list[tuple[np.ndarray, np.ndarray]]:
    return [unpack(r["ids"], r["dim"], r["wide"], r["matrix"]) for r in blocks.to_pylist()]


def _answers(queries: pa.Table, blocks: pa.Table, k: int) -> pa.Table:
    """Results of a chunk in one cell of blocks, without some that its floors outdo."""
    cols: dict[str, list] = {n: [np.zeros(0, np.int64)] for n in ("q_no", "pos", "query", "score", "vec")}
    for c in _chunks(queries):
        if not blocks.num_rows:
            continue
        best, who, _ = search(c["ids"], c["q"], _cell(blocks), k, c["floor"])
        i, j = np.nonzero(best != NONE)
        for n, v in zip(cols, (np.full(len(i), c["no"]), i, c["ids"][i], best[i, j], who[i, j])):
            cols[n].append(v)
    return pa.table({n: pa.array(np.concatenate(v), pa.int32() if n == "pos" else pa.int64()) for n, v in cols.items()})


def top_k(vectors: DataFrame, is_query, k: int = 5, scale: float = 256.0, id_col: str = "vec_id", vec_col: str = "embedding",
          block_rows: int = BLOCK_ROWS, group_rows: int = GROUP_ROWS, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """The ``k`` largest integer inner products of every query row against all
    rows: ``query_id``, ``rank`` (from 1), ``vec_id``, ``score``.

    ``is_query`` is a condition on the column ``id``. Components become
    ``floor(scale * x)``; ties go to the smaller id; fewer than ``k``
    candidates give all of them.

    Defined cases: rows with a null id, or a vector that is null or holds null
    or non-finite components, take no part; vectors of another length than the
    query's are no candidates; rows with the query's own id are none either;
    repeated rows are candidates each; every row under a query's id is a query
    of its own, with its own ranks; an empty table gives an empty result.
    Scores are 64-bit integers.
    """
    rows = usable(vectors, id_col, vec_col)
    asked = rows.where(is_query)
    n, n_asked = rows.count(), asked.count()
    index = _packed(rows, n, scale, block_rows, group_rows, "topk-index")
    chunks = _packed(asked, n_asked, scale, chunk_rows, 16 * chunk_rows, "topk-queries")
    n_groups = max(1, math.ceil(n / group_rows))
    n_chunks = max(1, chunks.count())
    n_slices = max(1, math.ceil(n / (block_rows * SLICE_BLOCKS)))
    part = lambda m: F.pmod(F.xxhash64("no"), F.lit(m)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    queries = chunks.select(F.col("no").alias("q_no"), part(n_chunks).alias("c"), "dim", "ids", "wide", "matrix")
    ends = index.select("no", "dim", "high", "low", "least")
    ends = ends.withColumn("s", part(n_slices)).withColumn("c", every(n_chunks))

    def meet(asking: DataFrame, what, schema: str) -> DataFrame:
        left = asking.withColumn("s", every(n_slices))
        return left.groupBy("s", "c").cogroup(ends.groupBy("s", "c")).applyInArrow(lambda _, a, z: what(a, z), schema)

    content = index.select("no", "dim", "ids", "wide", "matrix")

    def answers(asking: DataFrame, pairs: DataFrame, name: str) -> DataFrame:
        """Results of chunks in the blocks of their pairs, in cells of a chunk and some of its blocks."""
        pairs = pairs.withColumn("b", part(n_groups))
        # renamed on one side, as both come from the same table
        left = asking.join(pairs.select("q_no", F.col("b").alias("cell")).distinct(), "q_no")
        right = pairs.join(content, "no")
        cells = left.groupBy("cell", "q_no").cogroup(right.groupBy("b", "q_no"))
        return written(cells.applyInArrow(lambda _, a, z: _answers(a, z, k), FOUND), name)

    by_bound = Window.partitionBy("q_no", "pos").orderBy(F.desc("bound"), "no")
    seeds = meet(queries, _seeds, "q_no long, pos int, no long, bound long").withColumn("turn", F.row_number().over(by_bound))
    seeds = written(seeds.where("turn = 1").select("q_no", "no").distinct(), "topk-seeds")
    first = answers(queries, seeds, "topk-first")
    by_score = Window.partitionBy("q_no", "pos").orderBy(F.desc("score"), "vec")
    kth = first.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") == k)
    # at most one for each query of a chunk
    floors = written(kth.groupBy("q_no").agg(F.collect_list(F.struct("pos", "score", "vec")).alias("floors")), "topk-floors")
    floored = queries.join(floors, "q_no", "left")
    pairs = written(meet(floored, _survivors, "q_no long, no long").join(seeds, ["q_no", "no"], "left_anti"), "topk-pairs")
    found = first.unionByName(answers(floored, pairs, "topk-rest"))
    ranked = found.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k)
    return ranked.select(F.col("query").alias("query_id"), F.col("rank").cast("int"), F.col("vec").alias("vec_id"), "score")
