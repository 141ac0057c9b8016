"""Sampling without replacement by keyed hash.

"Take k of n without replacement" is "keep the k rows with the smallest
keyed hash (ties by a key column)". Merging k rows in one task would not
scale with k, so the k-th smallest hash is located by two small histogram
passes over the 32-bit hash, and the sample is a plain distributed filter.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratafac.functions.hashing import hash_bits, hash_uniform

def smallest_k(df: DataFrame, hash_col: str, tie_cols: list[str], k: int) -> DataFrame:
    """Rows with the ``k`` smallest ``(hash_col, *tie_cols)``; ``hash_col`` holds
    unsigned 32-bit values. Result equals ``orderBy(hash, *ties).limit(k)``."""
    if k <= 0:
        return df.limit(0)

    h = F.col(hash_col)
    # Pass 1: 65,536 coarse buckets (high 16 bits); at most 65,536 counts reach the driver.
    coarse = df.groupBy(F.shiftright(h, 16).alias("b")).count().orderBy("b").collect()
    seen = 0
    bucket = None
    for row in coarse:
        if seen + row["count"] >= k:
            bucket = row["b"]
            break
        seen += row["count"]
    if bucket is None:  # k >= n: everything
        return df
    # Pass 2: exact hash values inside that bucket (at most 65,536 distinct).
    fine = (
        df.filter(F.shiftright(h, 16) == bucket)
        .groupBy(h.alias("v"))
        .count()
        .orderBy("v")
        .collect()
    )
    for row in fine:
        if seen + row["count"] >= k:
            cut, need = row["v"], k - seen
            break
        seen += row["count"]
    below = df.filter(h < cut)
    # Rows sharing the cut hash are few (expected n / 2^32); order them by the tie key.
    at_cut = df.filter(h == cut).orderBy(*tie_cols).limit(int(need))
    return below.unionByName(at_cut)


def smallest_k_predicate(df: DataFrame, hash_col: str, tie_cols: list[str], k: int) -> tuple[Column, bool]:
    """Membership in ``smallest_k`` as a row predicate over the hash and tie
    columns: ``h < cut`` or ``h == cut`` with a tie key among the few picked
    at the cut. Returns ``(predicate, everything)``; the histogram passes run
    on ``df`` (two aggregates), the predicate can then filter any table that
    can compute the same hash — no join needed."""
    if k <= 0:
        return F.lit(False), False
    h = F.col(hash_col)
    coarse = df.groupBy(F.shiftright(h, 16).alias("b")).count().orderBy("b").collect()
    seen, bucket = 0, None
    for row in coarse:
        if seen + row["count"] >= k:
            bucket = row["b"]
            break
        seen += row["count"]
    if bucket is None:
        return F.lit(True), True
    fine = df.filter(F.shiftright(h, 16) == bucket).groupBy(h.alias("v")).count().orderBy("v").collect()
    for row in fine:
        if seen + row["count"] >= k:
            cut, need = int(row["v"]), k - seen
            break
        seen += row["count"]
    ties = df.filter(h == cut).orderBy(*tie_cols).limit(int(need)).select(*tie_cols).collect()
    if len(tie_cols) != 1:
        raise ValueError("predicate form supports one tie column")
    tie_vals = [r[0] for r in ties]
    return (h < F.lit(cut)) | ((h == F.lit(cut)) & F.col(tie_cols[0]).isin(tie_vals)), False


def threshold_sample(df: DataFrame, fraction: float, seed: int, *key_parts) -> DataFrame:
    """Bernoulli sample: keep a row when its keyed uniform is below ``fraction``."""
    return df.filter(hash_uniform(seed, *key_parts) < F.lit(float(fraction)))


def minibatch(ratings: DataFrame, fraction: float, seed: int, t: int, mode: str = "threshold", n: int | None = None) -> DataFrame:
    """One SGLD minibatch of round ``t``.

    ``exact``: exactly ``int(n·fraction)`` ratings without replacement;
    ``threshold``: each rating independently with probability ``fraction``
    (one filter, no ordering; the batch size then varies around n·fraction).
    """
    if mode == "threshold":
        return threshold_sample(ratings, fraction, seed, "batch", t, F.col("user"), F.col("item"))
    if mode != "exact":
        raise ValueError(mode)
    total = n if n is not None else ratings.count()
    k = int(total * fraction)
    keyed = ratings.withColumn("_h", hash_bits(seed, "batch", t, F.col("user"), F.col("item")))
    return smallest_k(keyed, "_h", ["user", "item"], k).drop("_h")


def batch_table(ratings: DataFrame, fraction: float, seed: int, first: int, rounds: int) -> DataFrame:
    """The batches of ``rounds`` rounds from round ``first`` on, drawn in one
    pass: ``t`` and the rating, for every round whose batch has it.

    Each rating is in each round's batch with probability ``fraction``,
    independently. The rounds between two of its batches are geometrically
    distributed, so a rating draws one keyed uniform per batch that it is in,
    not one per round. Fractions of 0 and 1 give no and every round.
    """
    drawn = ratings.select("user", "item", "rating")
    if fraction <= 0 or rounds <= 0:
        return drawn.withColumn("t", F.lit(first).cast("bigint")).limit(0).select("t", "user", "item", "rating")

    def skipped(k: Column) -> Column:
        if fraction >= 1:
            return F.lit(0).cast("bigint")
        u = hash_uniform(seed, "skip", first, F.col("user"), F.col("item"), k)
        return F.least(F.floor(F.log(u) / F.lit(math.log1p(-fraction))), F.lit(rounds)).cast("bigint")

    start = F.struct(F.lit(-1).cast("bigint").alias("last"), F.array().cast("array<bigint>").alias("hits"))

    def step(acc: Column, k: Column) -> Column:
        def moved(at: Column) -> Column:
            return F.struct(at.alias("last"), F.when(at < rounds, F.concat(acc["hits"], F.array(at))).otherwise(acc["hits"]).alias("hits"))

        # the place is bound, so that its hash is taken once
        at = F.array(acc["last"] + 1 + skipped(k))
        return F.when(acc["last"] >= rounds, acc).otherwise(F.element_at(F.transform(at, moved), 1))

    # Few ratings have many more hits than the mean; only these take the steps after ``usual``.
    usual = min(rounds + 1, math.ceil(2 * fraction * rounds) + 4)

    def rest(acc: Column) -> Column:
        more = F.aggregate(F.sequence(F.lit(usual + 1), F.lit(rounds + 1)), acc, step, lambda a: a["hits"])
        return F.when(acc["last"] >= rounds, acc["hits"]).otherwise(more)

    first_hits = F.aggregate(F.sequence(F.lit(1), F.lit(usual)), start, step)
    hits = F.element_at(F.transform(F.array(first_hits), rest if usual <= rounds else lambda acc: acc["hits"]), 1)
    each = drawn.select(F.explode(hits).alias("t"), "user", "item", "rating")
    return each.withColumn("t", F.col("t") + F.lit(first).cast("bigint"))
