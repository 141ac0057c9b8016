"""Rating statistics and normalisation.

Per-key statistics are hash aggregates (partial aggregation map-side, so a key
holding a third of all rows costs one partial row per map task) joined back
onto the ratings. No window spans a whole user: a window partitioned by user
would send a hot user's entire row to one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratafac.schema import ITEM, USER

# Fixed value: the SGLD minibatch fraction used for inclusion probabilities.
DEFAULT_BATCH_FRACTION = 0.05


def global_means(train: DataFrame, test: DataFrame) -> DataFrame:
    """Train mean, test mean and their unweighted average (one row)."""
    tagged = train.select(F.lit(True).alias("is_train"), "rating").unionByName(
        test.select(F.lit(False).alias("is_train"), "rating")
    )
    # One pass over both inputs: conditional averages, no join.
    means = tagged.agg(
        F.avg(F.when(F.col("is_train"), F.col("rating"))).alias("train_mean"),
        F.avg(F.when(~F.col("is_train"), F.col("rating"))).alias("test_mean"),
    )
    return means.select(
        "train_mean",
        "test_mean",
        ((F.col("train_mean") + F.col("test_mean")) / 2.0).alias("mean_rate"),
    )


def global_stats(df: DataFrame) -> DataFrame:
    """Mean, population std, max and count of all present ratings (one row)."""
    return df.agg(
        F.avg("rating").alias("mean"),
        F.stddev_pop("rating").alias("std"),
        F.max("rating").alias("max"),
        F.count(F.lit(1)).cast("bigint").alias("n"),
    )


def global_stats_values(df: DataFrame) -> dict[str, float]:
    """The one-row summary as Python scalars (four numbers to the driver)."""
    row = global_stats(df).first()
    return {k: (float(row[k]) if row[k] is not None else float("nan")) for k in ("mean", "std", "max", "n")}


def summary_values(df: DataFrame) -> tuple[int, int, dict[str, float]]:
    """Extent (max ids + 1) and global stats in one aggregate pass."""
    row = df.agg(
        (F.max("user") + 1).alias("n_users"),
        (F.max("item") + 1).alias("n_items"),
        F.avg("rating").alias("mean"),
        F.stddev_pop("rating").alias("std"),
        F.max("rating").alias("max"),
        F.count(F.lit(1)).alias("n"),
    ).first()
    g = {k: (float(row[k]) if row[k] is not None else float("nan")) for k in ("mean", "std", "max", "n")}
    return int(row["n_users"] or 0), int(row["n_items"] or 0), g


def global_center(df: DataFrame) -> DataFrame:
    """``rating - mean(rating)``."""
    mean = global_stats_values(df)["mean"]
    return df.withColumn("rating", F.col("rating") - F.lit(mean))


def user_stats(df: DataFrame) -> DataFrame:
    """Per-user mean, population std and count of present ratings."""
    return df.groupBy("user").agg(
        F.avg("rating").alias("mean"),
        F.stddev_pop("rating").alias("std"),
        F.count(F.lit(1)).cast("bigint").alias("n"),
    )


def user_zscore(df: DataFrame) -> DataFrame:
    """Per-user z-score over present cells; a user with std 0 maps to 0.

    Stats are aggregated then joined back; AQE turns the join into a
    broadcast when the per-user table is small at run time and splits skewed
    partitions otherwise.
    """
    stats = user_stats(df).select("user", "mean", "std")
    z = F.when(F.col("std") > 0, (F.col("rating") - F.col("mean")) / F.col("std")).otherwise(F.lit(0.0))
    return df.join(stats, "user").select("user", "item", z.alias("rating"))


def item_center(df: DataFrame) -> DataFrame:
    """Column centring: subtract each item's mean."""
    means = df.groupBy("item").agg(F.avg("rating").alias("item_mean"))
    return df.join(means, "item").select(
        "user", "item", (F.col("rating") - F.col("item_mean")).alias("rating")
    )


def counts(df: DataFrame, key: str) -> DataFrame:
    """Number of present ratings per ``key`` (``user`` or ``item``)."""
    return df.groupBy(key).agg(F.count(F.lit(1)).cast("bigint").alias("n"))


def inclusion_prob(df: DataFrame, key: str, fraction: float = DEFAULT_BATCH_FRACTION) -> DataFrame:
    """Probability that a minibatch of ``int(N·fraction)`` draws touches the id:
    ``h = 1 - (1 - n/N) ** int(N·fraction)``. ``N`` is a scalar subquery, so the
    whole computation is one lazy plan."""
    total = df.select(F.count(F.lit(1)).cast("double")).scalar()
    m = F.floor(total * F.lit(float(fraction))).cast("double")
    c = counts(df, key)
    h = F.lit(1.0) - F.pow(F.lit(1.0) - F.col("n") / total, m)
    return c.select(F.col(key).alias("id"), "n", h.alias("h"))


def align_test(
    test: DataFrame,
    factors: DataFrame,
    d: int,
    cold_start: str = "init",
    init_value: float = 0.3,
    init_method: str = "constant",
    seed: int = 42,
) -> DataFrame:
    """Attach user vector ``q`` and item vector ``p`` to every test cell.

    ``cold_start='init'`` gives ids unseen in training their start vector
    (what an index into the initial matrix would return); ``'drop'`` removes
    the cells instead.
    """
    from stratafac.operators.factors import start_vector

    users = factors.filter(F.col("kind") == USER).select(F.col("id").alias("user"), F.col("v").alias("q"))
    items = factors.filter(F.col("kind") == ITEM).select(F.col("id").alias("item"), F.col("v").alias("p"))
    how = "left" if cold_start == "init" else "inner"
    out = test.join(users, "user", how).join(items, "item", how)
    q0 = start_vector(init_method, USER, F.col("user"), d, seed, init_value)
    p0 = start_vector(init_method, ITEM, F.col("item"), d, seed, init_value)
    return out.select(
        "user",
        "item",
        "rating",
        F.col("q").isNotNull().alias("user_known"),
        F.col("p").isNotNull().alias("item_known"),
        F.coalesce("q", q0).alias("q"),
        F.coalesce("p", p0).alias("p"),
    )
