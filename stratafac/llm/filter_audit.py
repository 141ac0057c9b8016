"""Interaction audit of document filters by a Gray-code walk over their subsets.

Every document is reduced to the mask of the filters it fails, and the masks
are counted per part: with five filters a part has at most 32 mask cells
however many documents it holds. The walk visits the 32 subsets of filters in
Gray-code order, so that one filter is switched on or off at a time: each cell
keeps a counter of the active filters it fails, and a cell joins or leaves the
survivors when its counter reaches or leaves zero. The survivors of all 32
states are stored; every step of every order of the filters is a difference of
two states.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import permutations
from math import factorial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Filters by the bit of a mask, from bit 0 on.
LETTERS = "ABCDE"
_CAPITALS = bytes(range(65, 91))
_SYMBOLS = b"#$%&*|"
_CONTINUED = bytes(range(0x80, 0xC0))


@dataclass(frozen=True)
class Limits:
    min_words: int = 200
    distinct_percent: int = 50
    capital_percent: int = 3


def text_mask(data: bytes, limits: Limits) -> int:
    """Bits of the filters A to D that a UTF-8 text fails."""
    words = data.split()  # ASCII white space: x20 and x09 to x0D
    n = len(words)
    points = len(data.translate(None, _CONTINUED))
    capitals = len(data) - len(data.translate(None, _CAPITALS))
    return (
        (n < limits.min_words)
        | (100 * len(set(words)) < limits.distinct_percent * n) << 1
        | (100 * capitals > limits.capital_percent * points) << 2
        | (len(data.translate(None, _SYMBOLS)) < len(data)) << 3
    )


def _masks(batches: Iterator[pa.RecordBatch], limits: Limits) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [text_mask(x.as_py(), limits) for x in batch.column(3)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found, pa.int32())], ["id", "part", "digest", "mask"])


def document_masks(docs: DataFrame, limits: Limits = Limits(), id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """``id``, ``part``, ``digest`` (SHA-256 of the text) and ``mask`` of the
    filters A to D for every row. Null texts count as empty, null parts too."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"),
        F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(text, 256)).alias("digest"),
        text.cast("binary").alias("text"),
    )
    return rows.mapInArrow(lambda it: _masks(it, limits), "id long, part string, digest binary, mask int")


def mask_cells(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents, good and toxic ones per ``part`` and full ``mask`` (A to E).

    E is failed by a row whose text a smaller id has. Rows are counted per
    (text, part, id) first and per (text, part) next, where the least id's
    row is told from the others by a minimum, so a text that many documents
    share is summed before it is shuffled and no row joins its copies. A label counts
    if any row of ``labels`` with that id has it; rows with a null id have no
    labels, fail E never and make no copy fail.
    """
    # null ids are spread by their text
    salt = F.when(F.col("id").isNull(), F.xxhash64("digest")).otherwise(F.lit(0).cast("long"))
    flags = labels.groupBy(F.col("doc_id").cast("long").alias("l_id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False)).cast("long")).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False)).cast("long")).alias("toxic"),
    )
    flags = flags.where("l_id is not null").withColumn("l_salt", F.lit(0).cast("long"))
    rows = masks.withColumn("salt", salt)
    joined = rows.join(flags, (rows["id"] == flags["l_id"]) & (rows["salt"] == flags["l_salt"]), "left")
    sums = [F.sum(c).alias(c) for c in ("n", "good", "toxic")]
    one = joined.select("id", "salt", "part", "digest", "mask", F.lit(1).cast("long").alias("n"), F.coalesce("good", F.lit(0).cast("long")).alias("good"), F.coalesce("toxic", F.lit(0).cast("long")).alias("toxic"))
    by_id = one.groupBy("id", "salt", "digest", "part", "mask").agg(*sums)
    counts = F.struct("id", "n", "good", "toxic")
    by_part = by_id.groupBy("digest", "part", "mask").agg(
        F.min(F.when(F.col("id").isNotNull(), counts)).alias("first"),
        F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("free_n"),
        *sums,
    )
    least = by_part.groupBy("digest").agg(F.min("first.id").alias("least"))
    split = by_part.join(least, "digest")
    own = (F.col("first.id") == F.col("least")).cast("int")
    # rows that pass E: those of the least id, and those without an id
    passing = split.select(
        "part", "mask",
        (F.coalesce(F.col("first.n") * own, F.lit(0)) + F.col("free_n")).alias("n"),
        F.coalesce(F.col("first.good") * own, F.lit(0)).alias("good"),
        F.coalesce(F.col("first.toxic") * own, F.lit(0)).alias("toxic"),
    )
    failing = split.select(
        "part", (F.col("mask") + F.lit(16)).alias("mask"),
        (F.col("n") - F.coalesce(F.col("first.n") * own, F.lit(0)) - F.col("free_n")).alias("n"),
        (F.col("good") - F.coalesce(F.col("first.good") * own, F.lit(0))).alias("good"),
        (F.col("toxic") - F.coalesce(F.col("first.toxic") * own, F.lit(0))).alias("toxic"),
    )
    return passing.union(failing).where("n > 0").groupBy("part", "mask").agg(*sums)


def gray_walk(cells: np.ndarray) -> np.ndarray:
    """Survivors of every subset of filters.

    ``cells`` is (..., 2^k, values) by failure mask; the result has the same
    shape, by the subset of active filters. Step i of the walk switches the
    filter of the lowest set bit of i.
    """
    n = cells.shape[-2]
    active_failures = np.zeros(n, np.int64)
    running = cells.sum(axis=-2)
    states = np.empty_like(cells)
    subset = 0
    states[..., 0, :] = running
    for i in range(1, n):
        bit = i & -i
        subset ^= bit
        touched = np.flatnonzero(np.arange(n) & bit)
        if subset & bit:
            gone = touched[active_failures[touched] == 0]
            active_failures[touched] += 1
            running = running - cells[..., gone, :].sum(axis=-2)
        else:
            active_failures[touched] -= 1
            back = touched[active_failures[touched] == 0]
            running = running + cells[..., back, :].sum(axis=-2)
        states[..., subset, :] = running
    return states


def order_steps(cells: np.ndarray) -> dict[str, np.ndarray]:
    """Columns of the audit for ``cells`` (parts, 2^k, 3), each (parts, k! * k)."""
    k = len(LETTERS)
    states = gray_walk(cells)
    orders = list(permutations(range(k)))
    before = np.array([sum(1 << f for f in o[:s]) for o in orders for s in range(k)])
    fails = np.array([f for o in orders for f in o])
    after = before | 1 << fails
    masks = np.arange(1 << k)
    failing = np.stack([cells[:, masks >> f & 1 == 1, 0].sum(axis=1) for f in range(k)], axis=1)
    only = cells[:, 1 << np.arange(k), 0]
    removed = states[:, before] - states[:, after]
    # orders that put exactly a given subset before a filter
    orders_with = np.array([factorial(m.bit_count()) * factorial(k - 1 - m.bit_count()) if m.bit_count() < k else 0 for m in range(1 << k)])
    shapley = np.stack([((states[:, masks >> f & 1 == 0, 0] - states[:, masks[masks >> f & 1 == 0] | 1 << f, 0]) * orders_with[masks >> f & 1 == 0]).sum(axis=1) for f in range(k)], axis=1)
    return {
        "kept": states[:, after, 0],
        "removed": removed[:, :, 0],
        "redundant": failing[:, fails] - removed[:, :, 0],
        "unique_fails": only[:, fails],
        "good_lost": removed[:, :, 1],
        "toxic_lost": removed[:, :, 2],
        "shapley": shapley[:, fails],
    }


AUDIT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"
_PARTS_AT_ONCE = 256


def _audit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = ["".join(LETTERS[f] for f in o) for o in permutations(range(len(LETTERS)))]
    orders = np.repeat(names, len(LETTERS))
    steps = np.tile(np.arange(1, len(LETTERS) + 1, dtype=np.int32), len(names))
    for batch in batches:
        for i in range(0, len(batch), _PARTS_AT_ONCE):
            some = batch.iloc[i : i + _PARTS_AT_ONCE]
            cells = np.zeros((len(some), 1 << len(LETTERS), 3), np.int64)
            for row, values in enumerate(some["cells"]):
                for c in values:
                    cells[row, c["mask"]] = c["n"], c["good"], c["toxic"]
            columns = order_steps(cells)
            yield pd.DataFrame({
                "part": np.repeat(some["part"].to_numpy(), len(orders)), "filter_order": np.tile(orders, len(some)), "step": np.tile(steps, len(some)),
                **{k: v.ravel() for k, v in columns.items()},
            })


def audit(docs: DataFrame, labels: DataFrame, limits: Limits = Limits(), id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """One row per part, order of the filters and step.

    Nulls: see ``document_masks`` and ``mask_cells``. Empty texts fail A;
    repeated rows (equal id and text) count each, and E compares ids only, so
    they don't fail for each other. Texts of any length are read whole, one at
    a time. An empty table has no parts and gives no rows; a part without
    failures gives its 600 rows with zeros. Other columns of ``docs`` are
    never read.
    """
    cells = mask_cells(document_masks(docs, limits, id_col, text_col, part_col), labels)
    # at most 32 cells a part
    parts = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    return parts.mapInPandas(_audit, AUDIT)
