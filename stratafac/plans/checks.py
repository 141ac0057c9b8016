"""Output shaping shared by the registered queries and their SQL twins.

A registered query ends in a fixed list of typed columns. Doubles are rounded
to 6 places (with -0.0 folded into 0.0) on both engines so that summation
order does not change the value hash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratafac.functions.vectors import round6, sql_round6

_SPARK_TYPES = {"l": "bigint", "d": "double", "s": "string", "b": "boolean"}
_SQL_TYPES = {"l": "BIGINT", "d": "DOUBLE", "s": "VARCHAR", "b": "BOOLEAN"}

Spec = list[tuple[str, str]]


def shape(df: DataFrame, spec: Spec) -> DataFrame:
    cols = []
    for name, kind in spec:
        c = F.col(f"`{name}`").cast(_SPARK_TYPES[kind])
        if kind == "d":
            c = round6(c)
        cols.append(c.alias(name))
    return df.select(*cols)


def shape_sql(core: str, spec: Spec) -> str:
    cols = []
    for name, kind in spec:
        expr = f'CAST(t."{name}" AS {_SQL_TYPES[kind]})'
        if kind == "d":
            expr = sql_round6(expr)
        cols.append(f'{expr} AS "{name}"')
    return f"SELECT {', '.join(cols)} FROM ({core}) t"
