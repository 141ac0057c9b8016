"""Rating sources: text triples, dense text matrices, the driver tables.

Every source returns the canonical ``(user, item, rating)`` table with 0-based
ids. Nothing is densified: a rating matrix is the set of its present cells.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratafac.functions.hashing import hash_bits

ZERO_EPS = 1e-12  # |rating| at or below this counts as "missing" (Q1 parity mode)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def read_ratings(spark: SparkSession, path: str, base: int = 1) -> DataFrame:
    """Whitespace-separated integer triples (extra columns ignored).

    ``base`` is the id of the first user/item in the file (1 for the classic
    ``u.data`` layout); ids are shifted to 0-based.
    """
    parts = F.split(F.trim(F.col("value")), r"\s+")
    return (
        spark.read.text(path)
        .filter(F.length(F.trim(F.col("value"))) > 0)
        .select(
            (parts.getItem(0).cast("bigint") - base).alias("user"),
            (parts.getItem(1).cast("bigint") - base).alias("item"),
            parts.getItem(2).cast("double").alias("rating"),
        )
    )


PARSED = "user bigint, item bigint, rating double, file string, line string, reason string, ok int"
_BLANKS = " \t\r\n\x0b\x0c"


def parse_ratings(spark: SparkSession, path: str, base: int = 1) -> DataFrame:
    """Every non-blank line of a triples text, read once: its cells, or the line
    and the reason that it is no rating. Columns as ``PARSED``.

    Reasons: ``fields`` (fewer than three), ``id`` (no 64-bit integer), ``id below
    base``, ``rating`` (no finite number). Columns beyond the third are ignored.
    """
    text = F.btrim(F.col("value"), F.lit(_BLANKS))
    parts = F.split(text, r"\s+")
    user, item = (F.try_subtract(F.get(parts, F.lit(k)).try_cast("bigint"), F.lit(base).cast("bigint")) for k in (0, 1))
    rating = F.get(parts, F.lit(2)).try_cast("double")
    cells = spark.read.text(path).filter(F.length(text) > 0).select(
        user.alias("user"), item.alias("item"), rating.alias("rating"), F.size(parts).alias("fields"),
        F.col("_metadata.file_path").alias("file"), F.col("value").alias("line"),
    )
    finite = F.abs("rating") < F.lit(float("inf"))  # NaN is above every number
    reason = (
        F.when(F.col("fields") < 3, "fields")
        .when(F.col("user").isNull() | F.col("item").isNull(), "id")
        .when((F.col("user") < 0) | (F.col("item") < 0), "id below base")
        .when(F.col("rating").isNull() | ~finite, "rating")
    )
    checked = cells.withColumn("reason", reason)
    bad = F.col("reason").isNotNull()
    return checked.select(
        "user", "item", "rating",
        F.when(bad, F.col("file")).alias("file"), F.when(bad, F.col("line")).alias("line"),
        "reason", F.when(bad, 0).otherwise(1).alias("ok"),
    )


def read_ratings_checked(spark: SparkSession, path: str, table_path: str, base: int = 1) -> tuple[DataFrame, DataFrame]:
    """The ratings of a triples text and the table of its rejected lines
    ``(file, line, reason)``. The text is parsed once, into ``table_path`` (a new
    folder), with one partition for each; a text without lines gives two empty tables."""
    parse_ratings(spark, path, base).write.partitionBy("ok").parquet(table_path)
    rows = spark.read.schema(PARSED).parquet(table_path)
    good = rows.filter(F.col("ok") == 1).select("user", "item", "rating")
    return good, rows.filter(F.col("ok") == 0).select("file", "line", "reason")


def ratings_from_tables(spark: SparkSession, sf_dir: str, dup: str = "avg") -> DataFrame:
    """Driver-table adapter: customers rate parts by the quantity they order.

    orders ⋈ lineitem on the order key, one rating per (customer, part);
    repeated pairs are merged by ``dup`` (``avg``, ``sum`` as a sparse matrix
    constructor would do, or ``last`` by order key). Only three columns reach the scans.
    """
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    joined = lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(
        F.col("o_custkey").alias("user"),
        F.col("l_partkey").alias("item"),
        F.col("l_quantity").cast("double").alias("rating"),
        F.col("o_orderkey").alias("at"),
    )
    return merge_duplicates(joined, dup, "at")


def merge_duplicates(df: DataFrame, how: str = "sum", order_col: str | None = None) -> DataFrame:
    """Collapse repeated (user, item) cells; partial aggregation runs map-side.

    ``last`` keeps the rating with the largest ``order_col`` (ties: the largest
    rating), as an overwriting matrix assignment does.
    """
    if how == "last":
        if order_col is None:
            raise ValueError("dup='last' needs a column that orders the ratings")
        last = F.max_by("rating", F.struct(order_col, "rating"))
        return df.groupBy("user", "item").agg(last.cast("double").alias("rating"))
    agg = {"sum": F.sum, "avg": F.avg, "max": F.max, "min": F.min}[how]
    return df.groupBy("user", "item").agg(agg("rating").cast("double").alias("rating"))


def read_dense_matrix(spark: SparkSession, path: str, sep: str = ",", base: int = 0) -> DataFrame:
    """Dense text matrix (one row per user, one column per item, 0 = missing) as triples."""
    return dense_cells_to_triples(read_dense_cells(spark, path, sep), base=base)


def read_dense_cells(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """All cells ``(row, col, value)`` of a dense text matrix, from 0.

    Files are split as any text file: non-blank
    lines are numbered within their split, in reading order, and splits are
    offset by the line counts of the splits before them in (file name, start)
    order, so part files written in row order keep their numbering and a
    single file of any size is read by many tasks. Only one row per split goes
    through the window that sums the counts.
    """
    lines = (
        spark.read.text(path)
        .select(
            F.col("_metadata.file_path").alias("f"),
            F.col("_metadata.file_block_start").alias("s"),
            F.monotonically_increasing_id().alias("at"),
            F.col("value").alias("line"),
        )
        .filter(F.length(F.trim(F.col("line"))) > 0)
    )
    numbered = lines.withColumn("i", F.row_number().over(Window.partitionBy("f", "s").orderBy("at")) - 1)
    counted = lines.groupBy("f", "s").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("f", "s").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counted.select("f", "s", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("off"))
    rows = numbered.join(offsets, ["f", "s"]).select((F.col("off") + F.col("i")).alias("row"), "line")
    pattern = r"\s+" if sep.isspace() else sep
    cells = rows.select("row", F.posexplode(F.split(F.trim(F.col("line")), pattern)).alias("col", "cell"))
    return cells.select("row", "col", F.col("cell").cast("double").alias("value"))


def dense_cells_to_triples(cells: DataFrame, base: int = 0) -> DataFrame:
    """``(row, col, value)`` cells → triples, keeping non-zero cells only."""
    return cells.filter(F.col("value") != 0).select(
        (F.col("row") + base).cast("bigint").alias("user"),
        (F.col("col") + base).cast("bigint").alias("item"),
        F.col("value").cast("double").alias("rating"),
    )


def dense_to_triples(
    df: DataFrame, row_col: str, vec_col: str, base: int = 1, zero_below: float | None = None
) -> DataFrame:
    """A dense matrix stored as one array per row → triples of non-zero cells.

    ``zero_below`` first sets cells under the cut to 0 (they then drop out);
    ``base=1`` reproduces the 1-based triples of the list conversion.
    """
    cells = df.select(F.col(row_col).alias("row"), F.posexplode(vec_col).alias("col", "value"))
    value = F.col("value").cast("double")
    if zero_below is not None:
        value = F.when(value < F.lit(zero_below), F.lit(0.0)).otherwise(value)
    return dense_cells_to_triples(cells.select("row", "col", value.alias("value")), base=base)


def observed(df: DataFrame, zero_is_missing: bool = False) -> DataFrame:
    """Present cells. ``zero_is_missing`` reproduces "value != 0 means observed"."""
    if not zero_is_missing:
        return df
    return df.filter(F.abs(F.col("rating")) > F.lit(ZERO_EPS))


def small_slice(df: DataFrame, n_users: int = 100, n_items: int = 100) -> DataFrame:
    """Top-left ``n_users × n_items`` corner (a pushed-down range filter)."""
    return df.filter((F.col("user") < n_users) & (F.col("item") < n_items))


def extent(df: DataFrame) -> DataFrame:
    """Matrix shape from the largest ids (ids may have gaps)."""
    return df.agg(
        (F.max("user") + 1).cast("bigint").alias("n_users"),
        (F.max("item") + 1).cast("bigint").alias("n_items"),
    )


def extent_values(df: DataFrame) -> tuple[int, int]:
    row = extent(df).first()
    return int(row["n_users"] or 0), int(row["n_items"] or 0)


def holdout_split(df: DataFrame, k: int = 2, seed: int = 42) -> DataFrame:
    """Per-user holdout: each user's ``k`` cells with the smallest keyed hash
    go to ``test``, the rest to ``train``.

    ``row_number() <= k`` is planned with a partial WindowGroupLimit before the
    shuffle, so at most ``k`` candidates per user and map task cross the
    network; the ranking happens only on those, never on a whole user's row.
    They give one cutoff per user, and the ratings meet the cutoffs on the user
    alone. A cell that occurs twice goes to one side; rows without a user train.
    """
    key = F.struct(hash_bits(seed, "holdout", F.col("user"), F.col("item")).alias("h"), F.col("item"))
    ranked = df.select("user", key.alias("key")).withColumn("rn", F.row_number().over(Window.partitionBy("user").orderBy("key")))
    cuts = ranked.filter(F.col("rn") <= k).groupBy("user").agg(F.max("key").alias("cut"))
    return df.join(cuts, "user", "left").select(
        "user",
        "item",
        "rating",
        F.when(key <= F.col("cut"), F.lit("test")).otherwise(F.lit("train")).alias("split"),
    )


def train_test(df: DataFrame, k: int = 2, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    split = holdout_split(df, k, seed)
    train = split.filter(F.col("split") == "train").drop("split")
    test = split.filter(F.col("split") == "test").drop("split")
    return train, test
