"""MinHash near-dedup with HyperMinHash sketches.

A document's set of 5-word shingles is split by hash into ``REGISTERS``
buckets; of the smallest hash of a bucket the sketch stores the leading-zero
count and ``MANTISSA`` bits behind it, 16 bits per register (empty buckets
borrow from another by a fixed random order). Documents with equal sets are
one node, named by a hash of the set. Then, over nodes:

1. Bands of ``ROWS`` compressed registers are the keys of candidate groups.
   A candidate pair shares a group and its Jaccard similarity, estimated from
   the registers and corrected for chance collisions, is not clearly below the
   threshold. Families are the components of the graph of candidate pairs: every
   member of a group is first held against the group's smallest node (a star, not
   all pairs); then members of different families are compared block by block on
   sketches, and one pair is emitted for two families that meet.
2. Within a family, links are decided on the full shingle sets, in blocks of
   ``BLOCK`` nodes: all nodes against one block of pivots, then those outside the
   family's largest component against all. A block emits a spanning forest of its
   links, never the links themselves.
3. The components of these edges are the result. No cap is set anywhere: pairs
   that share no band but a family are compared as well.

A pair at similarity 0.75 shares no band with probability (1 - 0.75^4)^32,
about 5e-6; above it, less.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratafac.llm import kernels as ke
from stratafac.llm.components import components
from stratafac.llm.tables import Scratch, written

SHINGLE = 5
BITS = 7
REGISTERS = 1 << BITS
MANTISSA = 10
ROWS = 4
#: Sketch estimates this many standard errors below the threshold are dropped.
MARGIN = 6.0
#: Nodes compared with each other at a time, and bytes of shingles per task.
BLOCK = 512
TASK_BYTES = 16 << 20
SLICE = 2 << 20

SKETCH = "id long, text_hash long, n_shingles long, set_lo long, set_hi long, registers binary"


def _sets(b: np.ndarray, off: np.ndarray, shingle: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    _, _, h, doc = ke.words(b, off, lower=True)
    first = np.searchsorted(doc, np.arange(len(off)))
    grams = ke.ngrams(h, shingle)
    for s, e in zip(first[:-1].tolist(), first[1:].tolist()):
        if e - s >= shingle:
            yield np.unique(grams[s : e - shingle + 1])
        elif e > s:
            # the whole sequence as one shingle, told apart from others by its length
            yield ke.mix(ke.ngrams(h[s:e], e - s) + np.uint64(e - s))
        else:
            yield h[:0]


def _borrow_order() -> np.ndarray:
    """For each register, the fixed order in which it borrows when empty."""
    cache = ke.worker_cache()
    if "borrow" not in cache:
        i = np.arange(REGISTERS, dtype=np.uint64)
        keys = ke.mix(i[:, None] * np.uint64(0x9E3779B97F4A7C15) + ke.mix(i[None, :] + np.uint64(77)))
        cache["borrow"] = np.argsort(keys, axis=1)
    return cache["borrow"]


def sketch(x: np.ndarray) -> np.ndarray:
    """HyperMinHash registers of sorted distinct 64-bit hashes."""
    edges = np.arange(REGISTERS, dtype=np.uint64) << np.uint64(64 - BITS)
    at = np.searchsorted(x, edges)
    owned = at < np.append(at[1:], len(x))
    rest = (x[np.minimum(at, len(x) - 1)] << np.uint64(BITS)) | np.uint64(1)
    zeros = np.uint64(63) - _log2(rest)
    mantissa = (rest << zeros) << np.uint64(1) >> np.uint64(64 - MANTISSA)
    reg = ((np.minimum(zeros, np.uint64(63)) << np.uint64(MANTISSA)) | mantissa).astype(np.uint16)
    empty = np.flatnonzero(~owned)
    if len(empty):
        order = _borrow_order()[empty]
        reg[empty] = reg[order[np.arange(len(empty)), owned[order].argmax(axis=1)]]
    return reg


def _log2(x: np.ndarray) -> np.ndarray:
    """Floor of the binary logarithm of positive uint64 values."""
    out = np.zeros(x.shape, np.uint64)
    x = x.copy()
    for step in (32, 16, 8, 4, 2, 1):
        big = x >= (np.uint64(1) << np.uint64(step))
        out[big] += np.uint64(step)
        x[big] >>= np.uint64(step)
    return out


def _sketches(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        b, off = ke.text_buffer(batch.column(2))
        i, n = 0, len(off) - 1
        while i < n:
            j = max(i + 1, int(np.searchsorted(off, off[i] + SLICE, side="right")) - 1)
            size, lo, hi, regs = [], [], [], []
            for x in _sets(b[off[i] : off[j]], off[i : j + 1] - off[i], shingle):
                size.append(len(x))
                if len(x):
                    a, z = _prints(x)
                    lo.append(a)
                    hi.append(z)
                    regs.append(sketch(x).tobytes())
                else:
                    lo.append(0)
                    hi.append(0)
                    regs.append(None)
            names = [batch.column(c).slice(i, j - i) for c in (0, 1)]
            cols = [*names, pa.array(size, pa.int64()), pa.array(lo, pa.int64()), pa.array(hi, pa.int64()), pa.array(regs, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["id", "text_hash", "n_shingles", "set_lo", "set_hi", "registers"])
            i = j


def chance(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Probability that registers of unrelated sets of ``n`` and ``m`` shingles collide."""
    z = np.arange(0, 40)
    per = [np.maximum(x[:, None] / REGISTERS, 1.0) for x in (n, m)]
    lead = [(1 - 2.0 ** -(z + 1)) ** k - (1 - 2.0**-z) ** k for k in per]
    return (lead[0] * lead[1]).sum(axis=1) / 2**MANTISSA


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Collision-corrected Jaccard similarity of rows of registers."""
    same = (a == b).mean(axis=1)
    c = chance(n, m)
    return np.clip((same - c) / (1 - c), 0.0, 1.0)


def least_estimate(threshold: float) -> float:
    """Estimates below this are clearly below the threshold. A register is a
    random draw from the union, also if it was borrowed, so the standard error
    doesn't depend on the sets' sizes."""
    return threshold - MARGIN * np.sqrt(threshold * (1 - threshold) / REGISTERS)


def _passing(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        t = pa.table(batch)
        if len(t) == 0:
            continue
        a, b = (np.frombuffer(b"".join(t[c].to_pylist()), np.uint16).reshape(len(t), REGISTERS) for c in ("x_registers", "y_registers"))
        n, m = (t[c].to_numpy().astype(np.float64) for c in ("x_n", "y_n"))
        possible = np.minimum(n, m) >= threshold * np.maximum(n, m) - 1e-9
        keep = possible & (estimate(a, b, n, m) >= least_estimate(threshold))
        yield from t.select(["x", "y"]).filter(pa.array(keep)).to_batches()


def _prints(x: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set of hashes."""
    lo, hi = ke.mix(x), ke.mix(x ^ np.uint64(0xA0761D6478BD642F))
    return tuple(int(v.sum(dtype=np.uint64).astype(np.int64)) for v in (lo, hi))


def _text_sets(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    """(text, node, label, blocks, block) -> the text's shingle set and the
    prints that name it beside the other columns."""
    for batch in batches:
        b, off = ke.text_buffer(batch.column(0))
        i, n = 0, len(off) - 1
        while i < n:
            j = max(i + 1, int(np.searchsorted(off, off[i] + SLICE, side="right")) - 1)
            sets = list(_sets(b[off[i] : off[j]], off[i : j + 1] - off[i], shingle))
            lo, hi = zip(*(_prints(x) for x in sets))
            size = [len(x) for x in sets]
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0] + size), pa.int32()), pa.array(np.concatenate(sets).view(np.int64)))
            placed = [batch.column(c).slice(i, j - i) for c in range(1, 5)]
            cols = [*placed, pa.array(size, pa.int64()), pa.array(lo, pa.int64()), pa.array(hi, pa.int64()), lists]
            yield pa.RecordBatch.from_arrays(cols, ["node", "label", "blocks", "block", "n_shingles", "set_lo", "set_hi", "shingles"])
            i = j


def _compare(rows: pa.Table, threshold: float) -> pa.Table:
    """Cells of candidate groups: every row marked ``from_r`` against the other
    rows of its cell; of the pairs that pass, one for every two families."""
    rows = rows.sort_by([("band", "ascending"), ("key", "ascending"), ("i", "ascending"), ("j", "ascending")])
    cell = np.stack([rows[c].to_numpy().astype(np.int64) for c in ("band", "key", "i", "j")], axis=1)
    node, label, n = (rows[c].to_numpy() for c in ("node", "label", "n_shingles"))
    left = rows["from_r"].to_numpy(zero_copy_only=False).astype(bool)
    regs = np.frombuffer(b"".join(rows["registers"].to_pylist()), np.uint16).reshape(len(node), REGISTERS)
    cut = np.flatnonzero(np.concatenate([[True], np.any(cell[1:] != cell[:-1], axis=1)]))
    out_x, out_y = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for s, e in zip(cut, np.append(cut[1:], len(cell))):
        r, m = s + np.flatnonzero(left[s:e]), s + np.flatnonzero(~left[s:e])
        for t in range(0, len(r), 64):
            x, y = (v.ravel() for v in np.meshgrid(r[t : t + 64], m, indexing="ij"))
            ok = label[x] != label[y]
            x, y = x[ok], y[ok]
            nx, ny = n[x].astype(np.float64), n[y].astype(np.float64)
            ok = np.minimum(nx, ny) >= threshold * np.maximum(nx, ny) - 1e-9
            x, y, nx, ny = x[ok], y[ok], nx[ok], ny[ok]
            if len(x):
                ok = estimate(regs[x], regs[y], nx, ny) >= least_estimate(threshold)
                x, y = x[ok], y[ok]
                lo, hi = np.minimum(label[x], label[y]), np.maximum(label[x], label[y])
                order, new = ke.unique_rows(lo, hi)
                out_x.append(node[x[order[new]]])
                out_y.append(node[y[order[new]]])
    x, y = np.concatenate(out_x), np.concatenate(out_y)
    return pa.table({"x": pa.array(np.minimum(x, y), pa.int64()), "y": pa.array(np.maximum(x, y), pa.int64())})


def _common(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of every left with every right set."""
    if len(left) * len(right) <= 64:
        return np.array([[len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for j in right] for i in left], np.int64)
    size = np.array([len(x) for x in sets])
    u, place, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), size)
    shared = count[place] > 1
    column = (np.cumsum(count > 1) - 1)[place[shared]]
    owner = owner[shared]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    out = np.zeros((len(left), len(right)), np.float64)
    width = 4096
    for s in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        i, j = np.searchsorted(column, (s, s + width))
        m = np.zeros((len(sets), width), np.float32)
        m[owner[i:j], column[i:j] - s] = 1
        out += m[left] @ m[right].T
    return np.rint(out).astype(np.int64)


def _forest(node: np.ndarray, sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (root, node) that connect what the links between ``left`` and
    ``right`` connect."""
    size = np.array([len(x) for x in sets])
    both = _common(sets, left, right)
    linked = 100 * both >= threshold * (size[left][:, None] + size[right][None, :] - both)
    i, j = np.nonzero(linked)
    i, j = left[i], right[j]
    root = np.arange(len(node))
    while True:
        low = root.copy()
        np.minimum.at(low, i, root[j])
        np.minimum.at(low, j, root[i])
        low = low[low]
        if np.array_equal(low, root):
            break
        root = low
    moved = np.flatnonzero(root != np.arange(len(node)))
    return node[root[moved]], node[moved]


def _link(rows: pa.Table, threshold: int) -> pa.Table:
    """Cells of families: the rows marked ``pivot`` against those marked ``other``."""
    rows = rows.sort_by([("label", "ascending"), ("i", "ascending"), ("j", "ascending")])
    cell = np.stack([rows[c].to_numpy().astype(np.int64) for c in ("label", "i", "j")], axis=1)
    node = rows["node"].to_numpy()
    pivot, other = (rows[c].to_numpy(zero_copy_only=False).astype(bool) for c in ("pivot", "other"))
    lists = rows["shingles"].combine_chunks()
    lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
    flat, off = lists.values.to_numpy().view(np.uint64), lists.offsets.to_numpy()
    cut = np.flatnonzero(np.concatenate([[True], np.any(cell[1:] != cell[:-1], axis=1)]))
    out_x, out_y = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for s, e in zip(cut, np.append(cut[1:], len(cell))):
        names, first, inverse = np.unique(node[s:e], return_index=True, return_inverse=True)
        sets = [flat[off[k] : off[k + 1]] for k in s + first]
        left, right = np.unique(inverse[pivot[s:e]]), np.unique(inverse[other[s:e]])
        if len(left) and len(right):
            x, y = _forest(names, sets, left, right, threshold)
            out_x.append(x)
            out_y.append(y)
    return pa.table({"x": pa.array(np.concatenate(out_x), pa.int64()), "y": pa.array(np.concatenate(out_y), pa.int64())})


class _Near:
    """One run over one table of documents. Nodes of its graph are the
    distinct shingle sets, named by a hash of their prints."""

    SET = ("set_lo", "set_hi", "n_shingles")

    def __init__(self, docs: DataFrame, shingle: int, threshold: int):
        self.docs, self.shingle, self.threshold = docs, shingle, threshold
        self.scratch = Scratch(docs.sparkSession)
        sketches = docs.select("id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(lambda it: _sketches(it, shingle), SKETCH)
        self.sketches = written(sketches.withColumn("node", F.xxhash64(*self.SET)), "near-sketches")
        sets = self.sketches.where("n_shingles > 0 and id is not null")
        # one row per set; equal sets have equal registers
        nodes = sets.groupBy("node").agg(F.min("id").alias("rep"), F.max("n_shingles").alias("n_shingles"), F.min("registers").alias("registers"))
        self.nodes = written(nodes, "near-nodes")

    def bands(self) -> DataFrame:
        """(node, band, key): four compressed registers are one key of 64 bits."""
        width = 4 * ROWS
        keys = F.transform(
            F.sequence(F.lit(0), F.lit(REGISTERS // ROWS - 1)),
            lambda i: F.struct(i.alias("band"), F.conv(F.substring(F.hex("registers"), i * width + 1, F.lit(width)), 16, -10).cast("long").alias("key")),
        )
        return self.scratch.write(self.nodes.select("node", F.explode(keys).alias("b")).select("node", "b.band", "b.key"), "near-bands")

    def shared(self, bands: DataFrame) -> DataFrame:
        """(band, key, first, node): the bands' rows whose key two nodes have,
        with the group's smallest node. Most keys have one node and end here."""
        groups = bands.groupBy("band", "key").agg(F.min("node").alias("first"), F.max("node").alias("_last")).where("first < _last").drop("_last")
        # written: a join of two plain shuffles, which Spark can split at a hot key
        groups = written(groups, "near-groups")
        return written(bands.join(groups, ["band", "key"]), "near-shared")

    def stars(self, shared: DataFrame) -> DataFrame:
        """Members of candidate groups, each linked to its group's smallest node."""
        return shared.where("first < node").select(F.col("first").alias("x"), F.col("node").alias("y")).distinct()

    def estimated(self, pairs: DataFrame) -> DataFrame:
        """Keep the pairs (x, y) whose sketches don't rule them out."""
        part = lambda p: self.nodes.select(F.col("node").alias(p), F.col("n_shingles").alias(f"{p}_n"), F.col("registers").alias(f"{p}_registers"))
        t = self.threshold / 100
        both = pairs.join(part("x"), "x").join(part("y"), "y").select("x", "y", "x_n", "y_n", "x_registers", "y_registers")
        return both.mapInArrow(lambda it: _passing(it, t), "x long, y long")

    def unresolved(self, shared: DataFrame, labels: DataFrame) -> DataFrame:
        """Of the candidate pairs between different families, one for every two
        families that meet in a cell; after joining these, none is left."""
        t = self.threshold / 100
        labelled = shared.join(labels.withColumnRenamed("node", "l_node"), F.col("node") == F.col("l_node"), "left")
        labelled = written(labelled.select("node", "band", "key", F.coalesce("label", "node").alias("label")), "near-labelled")
        groups = labelled.groupBy("band", "key").agg(
            F.min_by("label", "node").alias("first_label"), F.min("node").alias("first"),
            F.min("label").alias("_a"), F.max("label").alias("_z"), F.count("*").alias("size"),
        ).where("_a < _z and size > 2")
        groups = written(groups.select("band", "key", "first", "first_label", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks")), "near-groups")
        members = labelled.join(groups, ["band", "key"]).where("node <> first")
        block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
        every = F.sequence(F.lit(0), F.col("blocks") - 1)
        strangers = members.where("label <> first_label")
        own = strangers.select("*", F.lit(True).alias("from_r"), block.alias("i"), F.explode(every).alias("j"))
        # members meet only the blocks that hold a node of another family than the first's
        held = written(strangers.select("band", "key", block.alias("i")).distinct(), "near-held")
        rest = members.select("*", F.lit(False).alias("from_r"), block.alias("j")).join(held, ["band", "key"])
        cells = written(own.unionByName(rest).select("band", "key", "i", "j", "node", "label", "from_r"), "near-cells")
        tasks = cells.count() // (16 * BLOCK) + 1
        with_registers = cells.join(self.nodes.select("node", "n_shingles", "registers"), "node")
        with_registers = with_registers.withColumn("task", F.pmod(F.xxhash64("band", "key", "i", "j"), F.lit(tasks)))
        found = with_registers.groupBy("task").applyInArrow(lambda rows: _compare(rows, t), "x long, y long")
        return found.where("x <> y").distinct()

    def families(self) -> DataFrame:
        """(node, label) of the nodes that are in a candidate pair."""
        bands = self.bands()
        shared = self.shared(bands)
        self.scratch.drop(bands)
        pairs = written(self.estimated(self.stars(shared)), "near-candidates")
        labels = components(pairs, "near")
        more = written(self.unresolved(shared, labels), "near-bridges")
        return labels if more.isEmpty() else components(pairs.union(more), "near")

    def cells(self, rows: DataFrame, n_bytes: int) -> DataFrame:
        """Edges from cells (label, i, j) of (node, shingles), ``pivot`` against ``other``."""
        tasks = n_bytes // TASK_BYTES + 1
        threshold = self.threshold
        rows = rows.withColumn("task", F.pmod(F.xxhash64("label", "i", "j"), F.lit(tasks)))
        return rows.groupBy("task").applyInArrow(lambda t: _link(t, threshold), "x long, y long")

    def edges(self, families: DataFrame) -> DataFrame:
        """Edges that connect the nodes of a family as its links do."""
        shingle = self.shingle
        sizes = families.groupBy("label").agg(F.count("*").alias("size"))
        sizes = written(sizes.select(F.col("label").alias("s_label"), F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks")), "near-families")
        placed = families.join(sizes, F.col("label") == F.col("s_label")).join(self.nodes.withColumnRenamed("node", "n_node"), F.col("node") == F.col("n_node"))
        placed = placed.select("node", "label", "blocks", "rep", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"))
        placed = written(placed, "near-members")
        # sets keep their family's columns, so that they needn't be joined to them; a repeated id can have other texts
        texts = self.docs.join(placed.hint("shuffle_hash"), F.col("id") == F.col("rep")).select("text", "node", "label", "blocks", "block")
        schema = "node long, label long, blocks int, block int, n_shingles long, set_lo long, set_hi long, shingles array<long>"
        sets = texts.mapInArrow(lambda it: _text_sets(it, shingle), schema).where(F.xxhash64(*self.SET) == F.col("node"))
        members = self.scratch.write(sets.select("node", "label", "blocks", "block", "shingles"), "near-sets")
        n_bytes = (members.agg(F.sum(F.size("shingles").cast("long"))).first()[0] or 0) * 8
        # all nodes against the first block, whose nodes are on both sides in its own cell
        zero, first = F.lit(0).alias("i"), F.col("block") == 0
        rows = members.select("node", "label", "shingles", zero, F.col("block").alias("j"), first.alias("pivot"), F.lit(True).alias("other"))
        more = members.where(first & (F.col("blocks") > 1))
        more = more.select("node", "label", "shingles", zero, F.explode(F.sequence(F.lit(1), F.col("blocks") - 1)).alias("j"), F.lit(True).alias("pivot"), F.lit(False).alias("other"))
        edges = written(self.cells(rows.unionByName(more), 2 * n_bytes), "near-links")
        every = F.sequence(F.lit(0), F.col("blocks") - 1)
        # in families of several blocks: who is outside the largest component, against all
        large = members.where("blocks > 1")
        if large.isEmpty():
            self.scratch.drop(members)
            return edges
        known = components(edges, "near").select(F.col("node").alias("k_node"), F.col("label").alias("part"))
        parts = large.select("node", "label").join(known, F.col("node") == F.col("k_node"), "left").select("node", "label", F.coalesce("part", "node").alias("part"))
        most = parts.groupBy("label", "part").agg(F.count("*").alias("n")).groupBy("label").agg(F.max_by("part", F.struct("n", "part")).alias("most"))
        outside = parts.join(written(most.withColumnRenamed("label", "m_label"), "near-largest"), F.col("label") == F.col("m_label")).where("part <> most").select("node", "label")
        outside = written(outside, "near-outside")
        groups = outside.groupBy("label").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("groups"))
        groups = written(groups.withColumnRenamed("label", "g_label"), "near-outside-sizes")
        mine = large.join(groups, F.col("label") == F.col("g_label"))
        group = F.pmod(F.xxhash64("node"), F.col("groups")).cast("int")
        left = mine.join(outside.select(F.col("node").alias("o_node")), F.col("node") == F.col("o_node"), "left_semi")
        left = left.select("node", "label", "shingles", group.alias("i"), F.explode(every).alias("j"), F.lit(True).alias("pivot"), F.lit(False).alias("other"))
        right = mine.select("node", "label", "shingles", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("i"), F.col("block").alias("j"), F.lit(False).alias("pivot"), F.lit(True).alias("other"))
        copies = outside.join(groups, F.col("label") == F.col("g_label")).agg(F.max("groups")).first()[0] or 0
        links = written(self.cells(left.unionByName(right), 2 * n_bytes * (1 + copies)), "near-links")
        self.scratch.drop(members)
        return edges.union(links)

    def classes(self) -> DataFrame:
        labels = components(self.edges(self.families()), "near")
        named = self.nodes.select("node", "rep").join(labels.withColumnRenamed("node", "l_node"), F.col("node") == F.col("l_node"), "left")
        named = written(named.select("node", "rep", F.coalesce("label", "node").alias("label")), "near-named")
        least = written(named.groupBy("label").agg(F.min("rep").alias("component_id")), "near-least")
        return named.join(least, "label").select(F.col("node").alias("c_node"), "component_id")


def near_duplicates(docs: DataFrame, threshold: int = 75, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``n_shingles``, ``component_id``, ``kept`` and ``text_hash``
    (xxhash64 of the text) of every row.

    Two documents are linked if 100 * intersection >= ``threshold`` * union of
    their shingle sets (A-Z lower-cased, words ``[^\\x20\\x09-\\x0D]+``; a
    document with fewer words has its whole sequence as one shingle).
    ``component_id`` is the smallest id reachable over links, ``kept`` whether
    it is the row's own.

    Defined cases: null texts and texts without words have no shingles and are
    linked with nothing; a row with a null id is linked with nothing, has a
    null component and is kept; rows that repeat an id are judged by their own
    texts; an empty table gives an empty result; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    near = _Near(rows, shingle, threshold)
    out = near.sketches.select("id", "n_shingles", "text_hash", "node").join(near.classes(), F.col("node") == F.col("c_node"), "left")
    alone = F.col("id").isNull() | (F.col("n_shingles") == 0)
    component = F.when(alone, F.col("id")).otherwise(F.col("component_id"))
    return out.select("id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"), "text_hash")
