"""Model arithmetic as batched expressions over ratings ⋈ factors.

A rating row with its user vector ``q`` and item vector ``p`` attached is the
unit of work; predictions, residuals and per-rating gradients are unrolled
array expressions, and per-id gradient sums are hash aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratafac.functions.vectors import dot, elem, sq_norm
from stratafac.schema import ITEM, USER

# L2 penalty of the SGD trainers and of the R1 trainer; the
# rating scale used by the (disabled) prediction clipping.
RHO_L2 = 0.2
RHO_R1 = 0.5
CLIP_LOW, CLIP_HIGH = 1.0, 5.0


def attach_factors(ratings: DataFrame, factors: DataFrame) -> DataFrame:
    """ratings ⋈ user factors ⋈ item factors (inner: both ids must be known)."""
    users = factors.filter(F.col("kind") == USER).select(F.col("id").alias("user"), F.col("v").alias("q"))
    items = factors.filter(F.col("kind") == ITEM).select(F.col("id").alias("item"), F.col("v").alias("p"))
    return ratings.join(users, "user").join(items, "item")


def prediction(d: int, q: str = "q", p: str = "p") -> Column:
    return dot(q, p, d)


def predict(rated: DataFrame, d: int) -> DataFrame:
    """``pred = q·p`` for rows that carry ``q`` and ``p``."""
    return rated.withColumn("pred", prediction(d))


def residuals(rated: DataFrame, d: int) -> DataFrame:
    """``e = rating - q·p`` (present cells only, so the mask is implicit)."""
    return rated.withColumn("e", F.col("rating") - prediction(d))


def clip_prediction(pred: Column, low: float = CLIP_LOW, high: float = CLIP_HIGH) -> Column:
    """Predictions in (0, low) become low; above high become high."""
    return (
        F.when((pred > 0) & (pred < low), F.lit(low))
        .when(pred > high, F.lit(high))
        .otherwise(pred)
    )


def l2_gradient(rated: DataFrame, d: int, rho: float = RHO_L2) -> DataFrame:
    """Summed squared-error gradients per id.

    Per rating: ``g_q = -e·p + rho·q`` and ``g_p = -e·q + rho·p`` (the standard
    L2 objective ``e²/2 + rho/2 (|q|² + |p|²)``). Returns ``(kind, id, g)``.
    """
    e = F.col("rating") - prediction(d)
    with_e = rated.withColumn("e", e)
    r = F.lit(float(rho))
    user_g = with_e.groupBy(F.col("user").alias("id")).agg(
        *[F.sum(-F.col("e") * elem("p", k) + r * elem("q", k)).alias(f"g{k}") for k in range(d)]
    )
    item_g = with_e.groupBy(F.col("item").alias("id")).agg(
        *[F.sum(-F.col("e") * elem("q", k) + r * elem("p", k)).alias(f"g{k}") for k in range(d)]
    )
    pack = [F.array(*[F.col(f"g{k}") for k in range(d)]).alias("g")]
    return user_g.select(F.lit(USER).alias("kind"), "id", *pack).unionByName(
        item_g.select(F.lit(ITEM).alias("kind"), "id", *pack)
    )


def objectives(rated: DataFrame, d: int, rho: float = RHO_R1) -> DataFrame:
    """``obj_l2 = Σ e²/2 + rho/2 Σ(|q|²+|p|²)`` and ``obj_abs`` with ``|e|``.

    The penalty is charged once per rating, as a per-draw objective would be.
    """
    e = F.col("rating") - prediction(d)
    pen = F.lit(float(rho) / 2.0) * (sq_norm("q", d) + sq_norm("p", d))
    return rated.agg(
        F.sum(e * e / 2.0 + pen).alias("obj_l2"),
        F.sum(F.abs(e) + pen).alias("obj_abs"),
    )


def with_counts(ratings: DataFrame, user_n: DataFrame, item_n: DataFrame) -> DataFrame:
    """Attach the full-matrix rating counts ``ni`` (user) and ``nj`` (item)."""
    return ratings.join(user_n.withColumnRenamed("n", "ni"), "user").join(
        item_n.withColumnRenamed("n", "nj"), "item"
    )


def r1_gradient(rated: DataFrame, d: int, rho: float = RHO_R1, mode: str = "as_written") -> DataFrame:
    """E5: count-weighted sign gradients, per rating (``g_q``, ``g_p`` arrays).

    ``as_written``: ``g_q = -(ni/nj)·sign(e)·q + rho·q``, ``g_p = -sign(e)·p + rho·p``
    (each step only rescales its own vector). ``cross_factor``: the data term
    uses the other side's vector, ``-(ni/nj)·sign(e)·p`` and ``-sign(e)·q``.
    ``sign(0) = 0`` instead of the 0/0 of the literal formula.
    """
    s = F.signum(F.col("rating") - prediction(d))
    w = F.col("ni").cast("double") / F.col("nj").cast("double")
    r = F.lit(float(rho))
    src_q, src_p = ("q", "p") if mode == "as_written" else ("p", "q")
    if mode not in ("as_written", "cross_factor"):
        raise ValueError(mode)
    g_q = F.array(*[-w * s * elem(src_q, k) + r * elem("q", k) for k in range(d)])
    g_p = F.array(*[-s * elem(src_p, k) + r * elem("p", k) for k in range(d)])
    return rated.select("user", "item", "rating", g_q.alias("g_q"), g_p.alias("g_p"))


def apply_gradient(factors: DataFrame, grads: DataFrame, eta: float, d: int) -> DataFrame:
    """``v ← v - eta·g`` for ids with a gradient; others unchanged.

    Both sides step from the old values (the gradients were computed from
    them), which is the batched form of the simultaneous q/p update.
    """
    joined = factors.join(grads, ["kind", "id"], "left")
    e = F.lit(float(eta))
    new_v = F.when(
        F.col("g").isNull(), F.col("v")
    ).otherwise(F.array(*[elem("v", k) - e * elem("g", k) for k in range(d)]))
    return joined.select("kind", "id", "blk", new_v.alias("v"))


def factor_norms(factors: DataFrame, d: int) -> DataFrame:
    """``Σ_id v_k²`` per side and dimension (input to precision resampling)."""
    return factors.groupBy("kind").agg(
        *[F.sum(elem("v", k) * elem("v", k)).alias(f"n{k}") for k in range(d)]
    ).select("kind", F.posexplode(F.array(*[F.col(f"n{k}") for k in range(d)])).alias("k", "norm2"))
