"""Column expressions over factor vectors stored as ``array<double>``.

Element access ``v[k]`` and plain arithmetic stay inside whole-stage codegen,
whereas the higher-order functions (``zip_with``/``aggregate``/``transform``)
fall back to interpreted evaluation. With the rank ``d`` known when the plan
is built, the vector algebra is therefore unrolled into ``d`` scalar terms.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def elem(v: Column | str, k: int) -> Column:
    col = F.col(v) if isinstance(v, str) else v
    return col.getItem(k)


def dot(a: Column | str, b: Column | str, d: int) -> Column:
    """Inner product of two length-``d`` arrays."""
    terms = [elem(a, k) * elem(b, k) for k in range(d)]
    return reduce(lambda x, y: x + y, terms)


def sq_norm(a: Column | str, d: int) -> Column:
    return dot(a, a, d)


def axpy(alpha: Column | float, x: Column | str, y: Column | str, d: int) -> Column:
    """``y + alpha * x`` element-wise, as a new array."""
    a = alpha if isinstance(alpha, Column) else F.lit(float(alpha))
    return F.array(*[elem(y, k) + a * elem(x, k) for k in range(d)])


def scale(alpha: Column | float, x: Column | str, d: int) -> Column:
    a = alpha if isinstance(alpha, Column) else F.lit(float(alpha))
    return F.array(*[a * elem(x, k) for k in range(d)])


def zeros(d: int) -> Column:
    return F.array(*[F.lit(0.0) for _ in range(d)])


# Comparison grid: 2^-20. Values built from short decimals (x.5, 0.31, ...)
# often sit exactly on a 6-decimal midpoint, where summation-order noise flips
# the rounding; no decimal with fewer than 21 digits is a midpoint of a binary
# grid, so rounding to multiples of 2^-20 is stable across engines.
GRID = 1048576.0


def round6(x: Column) -> Column:
    """Round to the 2^-20 grid (about 6 decimals) and fold -0.0 into 0.0."""
    r = F.round(x * F.lit(GRID)) / F.lit(GRID)
    return F.when(r == 0, F.lit(0.0)).otherwise(r)


def sql_round6(expr: str) -> str:
    r = f"(round(({expr}) * {GRID}) / {GRID})"
    return f"(CASE WHEN {r} = 0 THEN 0.0::DOUBLE ELSE {r} END)"
