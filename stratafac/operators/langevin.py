"""Stochastic-gradient Langevin dynamics, one round as DataFrame operations.

Round ``t`` with step ``eps``, N ratings and a batch of m:

    x ← x + ½·eps·(N·G_x − (1/h_x)·x ⊙ λ) + noise      for ids touched by the batch

where ``G_x`` is the batch-mean likelihood gradient of id x, ``h_x`` its
inclusion probability and ``λ`` the diagonal prior precision. Untouched rows
are carried over unchanged. Every term is a join or hash aggregate keyed by
id; no factor matrix is gathered anywhere.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratafac.functions.hashing import hash_normal, py_hash_normal
from stratafac.functions.vectors import elem
from stratafac.operators.model import attach_factors, prediction
from stratafac.schema import ITEM, USER


def batch_entities(batch: DataFrame) -> DataFrame:
    """Distinct users and items in the batch as ``(kind, id)``."""
    users = batch.select(F.lit(USER).alias("kind"), F.col("user").alias("id")).distinct()
    items = batch.select(F.lit(ITEM).alias("kind"), F.col("item").alias("id")).distinct()
    return users.unionByName(items)


def row_gradients(batch: DataFrame, factors: DataFrame, d: int) -> DataFrame:
    """Per batch rating, ``gu = (x - u·v)·v`` and ``gv = (x - u·v)·u``."""
    rated = attach_factors(batch, factors)
    e = F.col("rating") - prediction(d)
    return rated.select(
        "user",
        "item",
        F.array(*[e * elem("p", k) for k in range(d)]).alias("gu"),
        F.array(*[e * elem("q", k) for k in range(d)]).alias("gv"),
    )


def sides(factors: DataFrame, *cols: str) -> tuple[DataFrame, DataFrame]:
    """User and item rows of a factor table as ``(id, v, ...)``."""
    return tuple(factors.filter(F.col("kind") == kind).select("id", "v", *cols) for kind in (USER, ITEM))


def batch_gradient_sums(batch: DataFrame, factors: DataFrame, d: int) -> DataFrame:
    """G4 (unscaled): ``Σ e·v`` per user and ``Σ e·u`` per item as ``(kind, id, g)``."""
    return side_gradient_sums(batch, *sides(factors), d).withColumnRenamed("gs", "g")


def batch_gradients(batch: DataFrame, factors: DataFrame, d: int, m: int | Column) -> DataFrame:
    """Batch-mean gradients (sums divided by the batch size ``m``)."""
    sums = batch_gradient_sums(batch, factors, d)
    m_col = m.cast("double") if isinstance(m, Column) else F.lit(float(m))
    return sums.select("kind", "id", F.array(*[elem("g", k) / m_col for k in range(d)]).alias("g"))


def lam_elem(kind: Column, lam_u: list[float], lam_v: list[float], k: int) -> Column:
    return F.when(kind == USER, F.lit(float(lam_u[k]))).otherwise(F.lit(float(lam_v[k])))


def prior_term(factors_h: DataFrame, lam_u: list[float], lam_v: list[float], d: int) -> DataFrame:
    """``(1/h)·v ⊙ λ`` for rows of ``(kind, id, v, h)``."""
    return factors_h.select(
        "kind",
        "id",
        F.array(*[elem("v", k) * lam_elem(F.col("kind"), lam_u, lam_v, k) / F.col("h") for k in range(d)]).alias("prior"),
    )


def shared_noise(seed: int, t: int, eps: float, d: int) -> list[float]:
    """G6 (reference): one N(0, eps·I) vector for all rows touched in round t."""
    sd = math.sqrt(eps)
    return [sd * py_hash_normal(seed, "noise", t, k) for k in range(d)]


def per_row_noise(seed: int, t: int, eps: float, d: int) -> Column:
    """G6 (``per_row``): an independent N(0, eps·I) vector per (kind, id)."""
    sd = F.lit(math.sqrt(eps))
    return F.array(*[sd * hash_normal(seed, "noise", t, F.col("kind"), F.col("id"), k) for k in range(d)])


def _noise_columns(noise: str, seed: int, t: int, eps: float, d: int) -> list[Column]:
    """G6 as ``d`` columns; ``per_row`` keys on the row's ``kind`` and ``id``."""
    if noise == "shared":
        return [F.lit(x) for x in shared_noise(seed, t, eps, d)]
    if noise == "per_row":
        col = per_row_noise(seed, t, eps, d)
        return [col.getItem(k) for k in range(d)]
    if noise == "none":
        return [F.lit(0.0)] * d
    raise ValueError(noise)


def _scalar(x: int | float | Column) -> Column:
    return x.cast("double") if isinstance(x, Column) else F.lit(float(x))


def _updated(d: int, n_total, m, eps: float, lam: list[Column], noise: list[Column]) -> Column:
    """``v + ½·eps·(N·gs/m − v ⊙ λ / h) + noise`` where the batch touched the
    row (``gs`` not null), else ``v`` unchanged."""
    half = F.lit(0.5 * eps)
    n_col, m_col = _scalar(n_total), _scalar(m)
    new = []
    for k in range(d):
        grad = n_col * (elem("gs", k) / m_col)
        prior = elem("v", k) * lam[k] / F.col("h")
        new.append(elem("v", k) + half * (grad - prior) + noise[k])
    return F.when(F.col("gs").isNull(), F.col("v")).otherwise(F.array(*new))


def sgld_update(
    factors_h: DataFrame,
    batch: DataFrame,
    d: int,
    n_total: int | Column,
    m: int | Column,
    eps: float,
    lam_u: list[float],
    lam_v: list[float],
    t: int,
    seed: int = 42,
    noise: str = "shared",
) -> DataFrame:
    """One round, as the trainer runs it. ``factors_h`` is
    ``(kind, id, blk, v, h)``; same shape out.

    ``m`` (batch size) and ``n_total`` may be ints or scalar-subquery columns,
    e.g. ``batch.select(count(1)).scalar()``, which keeps the round one plan.
    """
    users, items = sides(factors_h, "h")
    sums = side_gradient_sums(batch, users, items, d)
    args = dict(d=d, n_total=n_total, m=m, eps=eps, t=t, seed=seed, noise=noise)
    new_u = update_side(users, sums, USER, lam=lam_u, **args).select(F.lit(USER).alias("kind"), "id", F.lit(0).alias("blk"), "v", "h")
    new_v = update_side(items, sums, ITEM, lam=lam_v, **args).select(F.lit(ITEM).alias("kind"), "id", F.lit(0).alias("blk"), "v", "h")
    return new_u.unionByName(new_v)


def attached_sides(batch: DataFrame, users: DataFrame, items: DataFrame, hot_users: list[int] = [], hot_items: list[int] = []) -> DataFrame:
    """``batch`` with the user's vector ``q`` and the item's ``p``.

    Rows of a hot id would all meet its factor row in one bucket. They stay
    where they are read and get the vector of the few hot ids by broadcast (the
    caller bounds the lists); the other rows are shuffled to the buckets. Each
    batch row takes one of the four ways.
    """
    q = users.select(F.col("id").alias("user"), F.col("v").alias("q"))
    p = items.select(F.col("id").alias("item"), F.col("v").alias("p"))

    def ways(key: str, rows: DataFrame, hot: list[int]):
        is_hot = F.col(key).isin(hot)
        return [(~is_hot, rows), (is_hot, F.broadcast(rows.filter(is_hot)))] if hot else [(F.lit(True), rows)]

    parts = [
        batch.filter(of_user & of_item).join(qs, "user").join(ps, "item").select("user", "item", "rating", "q", "p")
        for of_user, qs in ways("user", q, hot_users)
        for of_item, ps in ways("item", p, hot_items)
    ]
    return reduce(DataFrame.unionByName, parts)


def side_gradient_sums(
    batch: DataFrame, users: DataFrame, items: DataFrame, d: int, hot_users: list[int] = [], hot_items: list[int] = []
) -> DataFrame:
    """G4 (unscaled) from separate user and item tables ``(id, v, h)``:
    ``(kind, id, gs)``. Only batch-sized rows are shuffled when the two
    tables are bucketed by id; an id's sum is first taken in each task."""
    rated = attached_sides(batch, users, items, hot_users, hot_items).withColumn("e", F.col("rating") - prediction(d))
    pack = F.array(*[F.col(f"s{k}") for k in range(d)]).alias("gs")
    gu = rated.groupBy(F.col("user").alias("id")).agg(*[F.sum(F.col("e") * elem("p", k)).alias(f"s{k}") for k in range(d)])
    gv = rated.groupBy(F.col("item").alias("id")).agg(*[F.sum(F.col("e") * elem("q", k)).alias(f"s{k}") for k in range(d)])
    return gu.select(F.lit(USER).alias("kind"), "id", pack).unionByName(gv.select(F.lit(ITEM).alias("kind"), "id", pack))


def update_side(
    side: DataFrame,
    sums: DataFrame,
    kind: str,
    d: int,
    n_total: int | Column,
    m: int | Column,
    eps: float,
    lam: list[float],
    t: int,
    seed: int = 42,
    noise: str = "shared",
) -> DataFrame:
    """G7 on one side ``(id, v, h)``."""
    g = sums.filter(F.col("kind") == kind).select("id", "gs")
    joined = side.join(g, "id", "left").withColumn("kind", F.lit(kind))
    v = _updated(d, n_total, m, eps, [F.lit(float(x)) for x in lam], _noise_columns(noise, seed, t, eps, d))
    return joined.select("id", v.alias("v"), "h")


def with_inclusion(factors: DataFrame, incl_user: DataFrame, incl_item: DataFrame) -> DataFrame:
    """Attach ``h`` (B5) to the factor table once, before the rounds start."""
    h = incl_user.select(F.lit(USER).alias("kind"), "id", "h").unionByName(
        incl_item.select(F.lit(ITEM).alias("kind"), "id", "h")
    )
    return factors.join(h, ["kind", "id"], "left")
