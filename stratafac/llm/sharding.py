"""Sharding by proportional stratified interleaving.

Rows are put in a seeded order within their source and get the fractional rank
(rank - 1/2) / size of the source; the order of all rows by fractional rank
spreads every source evenly over the whole, so equal consecutive cuts give
shards that all have the mixture of the whole.

Both numberings (rank within a source, place in the whole) are made without
collecting a source or the whole in one task: rows are cut into ranges of the
sort key, the ranges' counts are summed up to the ranges' first numbers, and
``row_number`` runs within a range only. DataFrame functions throughout.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows per range of a sort key, on average.
RANGE_ROWS = 4_000


def _numbered(df: DataFrame, groups: list[str], range_col: str, order: list, name: str) -> DataFrame:
    """Number the rows from 1 by (range, order) within ``groups``; a higher
    range sorts after every lower one."""
    counts = df.groupBy(*groups, range_col).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))
    counts = counts.withColumn("_before", F.sum("_n").over(w.orderBy(range_col)) - F.col("_n")).drop("_n")
    cond = [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in [*groups, range_col]]
    counts = counts.select(*(F.col(c).alias(f"_k_{c}") for c in [*groups, range_col]), "_before")
    local = F.row_number().over(Window.partitionBy(*groups, range_col).orderBy(*order))
    # the joined side has one row per range: 1 / RANGE_ROWS of the input and one per source
    numbered = df.withColumn("_local", local)
    out = numbered.join(counts, on=_all(cond), how="inner")
    return out.withColumn(name, (F.col("_before") + F.col("_local")).cast("long")).drop("_local", "_before", *(f"_k_{c}" for c in [*groups, range_col]))


def _all(conditions):
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def interleaved_shards(docs: DataFrame, n_shards: int, seed: int = 17, id_col: str = "doc_id", source_col: str = "source",
                       carry: dict | None = None, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Assign every row to a shard; shard sizes differ by one row at most, and
    of each source every shard gets its share within two rows.

    ``carry`` maps names to further columns to compute from ``docs`` and keep.
    Returns ``id``, ``source``, the carried columns, ``shard`` (from 0) and
    ``slot`` (gapless from 0 within the shard, in interleaved order).

    Defined cases: null sources form a source of their own; null ids are
    ordered like any id; rows alike in id are ordered by the carried columns
    (rows alike in all are interchangeable); fewer rows than shards leave the
    last shards empty; an empty table gives an empty result; other columns of
    ``docs`` don't interfere.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be positive")
    extra = carry or {}
    base = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), *(c.alias(k) for k, c in extra.items()))
    keys = docs.select(F.col(source_col).cast("string").alias("source"))
    sizes = keys.groupBy("source").agg(F.count("*").alias("_size"))
    total = keys.count()
    n_ranges = max(1, math.ceil(total / range_rows))
    shuffle = F.xxhash64(F.lit(seed), F.col("id"))
    # the top 31 bits of the shuffle key, scaled to a range number: monotone in the key
    high = F.shiftrightunsigned(shuffle, 33)
    rows = base.withColumn("_mix", F.shiftrightunsigned(shuffle, 1)).withColumn("_range", F.floor(high * F.lit(n_ranges) / F.lit(2**31)).cast("long"))
    rows = _numbered(rows, ["source"], "_range", ["_mix", F.col("id").asc_nulls_first(), *extra], "_rank")
    sizes = sizes.select(F.col("source").alias("_source"), "_size")
    rows = rows.join(sizes, on=F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    rows = rows.withColumn("_place", (F.col("_rank") - F.lit(0.5)) / F.col("_size"))
    rows = rows.withColumn("_range", F.floor(F.col("_place") * F.lit(float(n_ranges))).cast("long"))
    rows = _numbered(rows, [], "_range", ["_place", F.col("source").asc_nulls_first(), "_rank"], "_number")
    index = F.col("_number") - F.lit(1)
    # shard s holds the places from floor(s * total / n) on
    rows = rows.withColumn("shard", F.expr(f"cast((({n_shards}L * _number) - 1) div {max(total, 1)}L as int)"))
    first = F.expr(f"(cast(shard as bigint) * {max(total, 1)}L) div {n_shards}L")
    return rows.select("id", "source", *extra, "shard", (index - first).cast("long").alias("slot"))
