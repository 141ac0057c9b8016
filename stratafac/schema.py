"""Canonical table schemas."""

from pyspark.sql import types as T

RATINGS = T.StructType(
    [
        T.StructField("user", T.LongType(), False),
        T.StructField("item", T.LongType(), False),
        T.StructField("rating", T.DoubleType(), False),
    ]
)

# One table for both sides of the model: kind = 'U' (user rows) or 'V' (item
# rows); blk is the row/column block the id belongs to (0 when unblocked).
FACTORS = T.StructType(
    [
        T.StructField("kind", T.StringType(), False),
        T.StructField("id", T.LongType(), False),
        T.StructField("blk", T.IntegerType(), False),
        T.StructField("v", T.ArrayType(T.DoubleType(), False), False),
    ]
)

METRICS = T.StructType(
    [
        T.StructField("scenario", T.StringType(), False),
        T.StructField("model", T.StringType(), False),
        T.StructField("epoch", T.IntegerType(), False),
        T.StructField("rmse", T.DoubleType(), True),
        T.StructField("objective", T.DoubleType(), True),
        T.StructField("elapsed_s", T.DoubleType(), False),
    ]
)

USER = "U"
ITEM = "V"
