"""Factor tables: ``(kind, id, blk, v)`` with kind 'U' (users) or 'V' (items).

Start values are pure functions of (seed, kind, id, k), so a factor row can be
rebuilt on any executor without shipping a matrix from the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratafac.functions.hashing import hash_normal, hash_uniform
from stratafac.schema import ITEM, USER

# Constant start (SGD/SGLD and the R1 trainer) and SGLD prior.
CONST_SGD = 0.3
CONST_R1 = 0.5
PRIOR_PRECISION = 2.0  # LambdaU = LambdaV = 2 I
ARITH_BASE, ARITH_STEP, ARITH_MOD = 0.3, 0.01, 11  # v_k(id) = 0.3 + 0.01·((7·id + 3·k) mod 11)


def start_vector(method: str, kind: str, id_col: Column, d: int, seed: int = 42, value: float = CONST_SGD, std: float = 1.0) -> Column:
    """Start vector for one id as an ``array<double>`` expression."""
    if method == "constant":
        return F.array(*[F.lit(float(value)) for _ in range(d)])
    if method == "uniform":
        return F.array(*[hash_uniform(seed, "init", kind, id_col, k) for k in range(d)])
    if method == "gaussian":
        return F.array(*[F.lit(float(std)) * hash_normal(seed, "init", kind, id_col, k) for k in range(d)])
    if method == "arithmetic":
        return arithmetic_vector(id_col, d)
    raise ValueError(f"unknown init {method!r}")


def arithmetic_vector(id_col: Column, d: int, step: Column | int = 0) -> Column:
    """Deterministic test factors ``0.3 + 0.01·((7·id + 3·k + step) mod 11)``."""
    s = step if isinstance(step, Column) else F.lit(step)
    return F.array(
        *[
            F.lit(ARITH_BASE) + F.lit(ARITH_STEP) * F.pmod(F.lit(7) * id_col + F.lit(3 * k) + s, F.lit(ARITH_MOD)).cast("double")
            for k in range(d)
        ]
    )


def sql_arithmetic(id_expr: str, k_expr: str, step_expr: str = "0") -> str:
    return (
        f"({ARITH_BASE}::DOUBLE + {ARITH_STEP}::DOUBLE * "
        f"CAST(((7 * {id_expr} + 3 * {k_expr} + {step_expr}) % {ARITH_MOD}) AS DOUBLE))"
    )


def init_factors(
    ratings: DataFrame,
    d: int,
    method: str = "constant",
    seed: int = 42,
    value: float = CONST_SGD,
    std: float = 1.0,
) -> DataFrame:
    """Factor rows for every user and item present in ``ratings``."""
    users = ratings.select(F.col("user").alias("id")).distinct()
    items = ratings.select(F.col("item").alias("id")).distinct()

    def side(ids: DataFrame, kind: str) -> DataFrame:
        return ids.select(
            F.lit(kind).alias("kind"),
            F.col("id").cast("bigint").alias("id"),
            F.lit(0).alias("blk"),
            start_vector(method, kind, F.col("id"), d, seed, value, std).alias("v"),
        )

    return side(users, USER).unionByName(side(items, ITEM))


def factors_from_table(factors: DataFrame) -> DataFrame:
    """Warm start from a saved factor table (any ``blk`` is reset)."""
    return factors.select("kind", F.col("id").cast("bigint"), F.lit(0).alias("blk"), "v")


def sgld_init(ratings: DataFrame, d: int, value: float = CONST_SGD, precision: float = PRIOR_PRECISION) -> tuple[DataFrame, list[float], list[float]]:
    """Constant U and V plus the diagonal prior precisions (lists of ``d``)."""
    return init_factors(ratings, d, "constant", value=value), [precision] * d, [precision] * d


def long_form(factors: DataFrame, value_col: str = "v", out: str = "val") -> DataFrame:
    """``(kind, id, k, val)``: one row per factor entry (for comparisons)."""
    return factors.select("kind", "id", F.posexplode(value_col).alias("k", out))
