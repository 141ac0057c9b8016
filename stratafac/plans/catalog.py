"""Registered queries: one per operator of the inventory, each with its SQL twin.

Every query reads the driver tables (via the rating adapter) and runs over the
whole table. Parameters are the reference's defaults unless stated.
``QUERIES[name](spark, sf_dir)`` returns a DataFrame; ``ORACLE[name]`` is the
equivalent DuckDB SQL over the same parquet views. Queries without a SQL twin
(iterative trainers) are checked by row count and by the pytest suite.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratafac.functions.hashing import MIX_A, MIX_B, MIX_P, MIX_SHIFT_1, sql_hash_bits, sql_hash_index, sql_hash_normal, sql_hash_uniform, sql_mix_bits, sql_mix_normal
from stratafac.operators import attack as atk
from stratafac.operators import blocks, evaluate, model, sampling, stats
from stratafac.operators import factors as fac
from stratafac.schema import ITEM, USER
from stratafac.plans.checks import Spec, shape, shape_sql
from stratafac.sources import ratings as src

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}

# Fixed experiment parameters (reference defaults).
SEED = 42
RANK = 10  # C = D = 10 factors
BLOCKS = 4  # DSGD block count
HOLDOUT_K = 2  # test cells per user in the hash holdout
BATCH_FRACTION = 0.05  # SGLD minibatch fraction


def register(name: str, spec: Spec, sql: str | None = None):
    def deco(fn: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return shape(fn(spark, sf_dir), spec)

        run.__name__ = f"query_{name}"
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = shape_sql(sql, spec)
        return fn

    return deco


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.ratings_from_tables(spark, sf_dir)


# --- SQL building blocks ---------------------------------------------------

RATINGS_SQL = (
    'SELECT o_custkey AS "user", l_partkey AS item, CAST(avg(l_quantity) AS DOUBLE) AS rating '
    "FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey, l_partkey"
)


def with_ratings(body: str, extra: str = "") -> str:
    more = f", {extra}" if extra else ""
    return f"WITH r AS ({RATINGS_SQL}){more} {body}"


def holdout_sql(k: int = HOLDOUT_K, seed: int = SEED) -> str:
    h = sql_hash_bits(seed, "holdout", '@"user"', "@item")
    return (
        'SELECT "user", item, rating, CASE WHEN row_number() OVER '
        f'(PARTITION BY "user" ORDER BY {h}, item) <= {k} THEN \'test\' ELSE \'train\' END AS split FROM r'
    )


TRIPLE: Spec = [("user", "l"), ("item", "l"), ("rating", "d")]

# --- A. sources ------------------------------------------------------------


@register("ratings", TRIPLE, with_ratings("SELECT * FROM r"))
def q_ratings(spark, sf_dir):
    """The canonical rating table from the driver tables."""
    return ratings(spark, sf_dir)


@register(
    "ratings_dup_sum",
    TRIPLE,
    'SELECT o_custkey AS "user", l_partkey AS item, CAST(sum(l_quantity) AS DOUBLE) AS rating '
    "FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey, l_partkey",
)
def q_ratings_dup_sum(spark, sf_dir):
    """A2: repeated cells summed, as a sparse-matrix constructor does."""
    return src.ratings_from_tables(spark, sf_dir, dup="sum")


@register(
    "ratings_dup_last",
    TRIPLE,
    'SELECT o_custkey AS "user", l_partkey AS item, CAST(arg_max(l_quantity, (o_orderkey, l_quantity)) AS DOUBLE) AS rating '
    "FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey, l_partkey",
)
def q_ratings_dup_last(spark, sf_dir):
    """A2: of repeated cells the one of the latest order, as an overwriting assignment does."""
    return src.ratings_from_tables(spark, sf_dir, dup="last")


@register(
    "dense_to_triples",
    TRIPLE,
    "SELECT vec_id + 1 AS \"user\", CAST(pos AS BIGINT) AS item, val AS rating FROM ("
    "SELECT vec_id, pos, CAST(embedding[pos] AS DOUBLE) AS val FROM ("
    "SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS pos FROM embeddings) x) e "
    "WHERE val <> 0",
)
def q_dense_to_triples(spark, sf_dir):
    """A4: dense rows (embeddings) → 1-based triples of the non-zero cells."""
    emb = src.table(spark, sf_dir, "embeddings")
    return src.dense_to_triples(emb, "vec_id", "embedding", base=1)


def _scratch(spark, name: str) -> str:
    import uuid

    from stratafac.session import scratch_path

    return scratch_path(spark, f"{name}-{uuid.uuid4().hex[:12]}")


def _written(df: DataFrame, name: str) -> DataFrame:
    """Computed once, in the shared folder, for the plans that read it often."""
    path = _scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


@register("text_ratings", TRIPLE, with_ratings("SELECT * FROM r"))
def q_text_ratings(spark, sf_dir):
    """A1: ratings written as 1-based whitespace text ("user item rating ts"), read back."""
    r = ratings(spark, sf_dir)
    line = F.concat_ws(
        " ",
        (F.col("user") + 1).cast("string"),
        (F.col("item") + 1).cast("string"),
        F.col("rating").cast("string"),
        F.lit("0"),
    )
    path = _scratch(spark, "ratings-text")
    r.select(line.alias("value")).write.text(path)
    return src.read_ratings(spark, path, base=1)


@register(
    "text_ratings_checked",
    [("status", "s")] + TRIPLE,
    with_ratings(
        f'SELECT CASE WHEN m < 4 THEN [\'fields\', \'id\', \'id below base\', \'rating\'][m + 1] ELSE \'ok\' END AS status, '
        '"user", item, CASE WHEN m >= 4 THEN rating END AS rating FROM (SELECT *, ("user" + item) % 20 AS m FROM r) x'
    ),
)
def q_text_ratings_checked(spark, sf_dir):
    """A1: ratings written as text, a fifth of the lines damaged in four ways, read
    back as ratings and as rejected lines with their reason (each line ends in its
    cell, so that a rejected one can be named)."""
    fault = F.pmod(F.col("user") + F.col("item"), F.lit(20))
    u, i, r = (F.col("user") + 1).cast("string"), (F.col("item") + 1).cast("string"), F.col("rating").cast("string")
    fields = (
        F.when(fault == 0, F.array())
        .when(fault == 1, F.array(F.lit("x"), i, r))
        .when(fault == 2, F.array(u, F.lit("0"), r))
        .when(fault == 3, F.array(u, i, F.lit("NaN")))
        .otherwise(F.array(u, i, r))
    )
    line = F.concat_ws(" ", fields, F.concat_ws(":", F.col("user").cast("string"), F.col("item").cast("string")))
    path = _scratch(spark, "faulty-text")
    ratings(spark, sf_dir).select(line.alias("value")).write.text(path)
    good, rejected = src.read_ratings_checked(spark, path, _scratch(spark, "parsed"))
    cell = F.split(F.substring_index("line", " ", -1), ":")
    named = rejected.select(
        F.col("reason").alias("status"), cell[0].cast("bigint").alias("user"), cell[1].cast("bigint").alias("item"),
        F.lit(None).cast("double").alias("rating"),
    )
    return good.withColumn("status", F.lit("ok")).unionByName(named)


@register(
    "dense_text",
    TRIPLE,
    "SELECT vec_id + 1 AS \"user\", CAST(pos AS BIGINT) AS item, val AS rating FROM ("
    "SELECT vec_id, pos, CAST(embedding[pos] AS DOUBLE) AS val FROM ("
    "SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS pos FROM embeddings) x) e "
    "WHERE val <> 0",
)
def q_dense_text(spark, sf_dir):
    """A3: embeddings written as a dense comma-separated text matrix (rows in id
    order over several part files), read back as triples."""
    emb = src.table(spark, sf_dir, "embeddings")
    cells = F.transform(F.col("embedding"), lambda x: x.cast("double").cast("string"))
    path = _scratch(spark, "dense-text")
    emb.repartitionByRange(4, "vec_id").sortWithinPartitions("vec_id").select(
        F.array_join(cells, ",").alias("value")
    ).write.text(path)
    return src.read_dense_matrix(spark, path, sep=",", base=1)


@register(
    "observed",
    TRIPLE,
    with_ratings(
        'SELECT r."user", item, CASE WHEN s.std > 0 THEN (rating - s.mean) / s.std ELSE 0.0 END AS rating '
        'FROM r JOIN s USING ("user") '
        "WHERE abs(CASE WHEN s.std > 0 THEN (rating - s.mean) / s.std ELSE 0.0 END) > 1e-12",
        's AS (SELECT "user", avg(rating) AS mean, stddev_pop(rating) AS std FROM r GROUP BY "user")',
    ),
)
def q_observed(spark, sf_dir):
    """A5: z-scored cells that stay observed when an exact 0 counts as missing."""
    return src.observed(stats.user_zscore(ratings(spark, sf_dir)), zero_is_missing=True)


@register("small_slice", TRIPLE, with_ratings('SELECT * FROM r WHERE "user" < 100 AND item < 100'))
def q_small_slice(spark, sf_dir):
    """The 100 × 100 corner."""
    return src.small_slice(ratings(spark, sf_dir))


@register(
    "holdout_split",
    TRIPLE + [("split", "s")],
    with_ratings(holdout_sql()),
)
def q_holdout_split(spark, sf_dir):
    """Per-user hash-ranked holdout (2 test cells per user)."""
    return src.holdout_split(ratings(spark, sf_dir), HOLDOUT_K, SEED)


@register(
    "extent",
    [("n_users", "l"), ("n_items", "l")],
    with_ratings('SELECT max("user") + 1 AS n_users, max(item) + 1 AS n_items FROM r'),
)
def q_extent(spark, sf_dir):
    """Matrix shape from the largest ids."""
    return src.extent(ratings(spark, sf_dir))


# --- B. statistics ---------------------------------------------------------


@register(
    "mean_rate",
    [("train_mean", "d"), ("test_mean", "d"), ("mean_rate", "d")],
    with_ratings(
        "SELECT train_mean, test_mean, (train_mean + test_mean) / 2 AS mean_rate FROM ("
        "SELECT avg(CASE WHEN split = 'train' THEN rating END) AS train_mean, "
        "avg(CASE WHEN split = 'test' THEN rating END) AS test_mean FROM h) x",
        f"h AS ({holdout_sql()})",
    ),
)
def q_mean_rate(spark, sf_dir):
    """B1: train mean, test mean and their unweighted average."""
    train, test = src.train_test(ratings(spark, sf_dir), HOLDOUT_K, SEED)
    return stats.global_means(train, test)


@register(
    "global_center",
    TRIPLE,
    with_ratings('SELECT "user", item, rating - (SELECT avg(rating) FROM r) AS rating FROM r'),
)
def q_global_center(spark, sf_dir):
    """B2: global centring."""
    return stats.global_center(ratings(spark, sf_dir))


@register(
    "user_zscore",
    TRIPLE,
    with_ratings(
        'SELECT r."user", item, CASE WHEN s.std > 0 THEN (rating - s.mean) / s.std ELSE 0.0 END AS rating '
        'FROM r JOIN s USING ("user")',
        's AS (SELECT "user", avg(rating) AS mean, stddev_pop(rating) AS std FROM r GROUP BY "user")',
    ),
)
def q_user_zscore(spark, sf_dir):
    """Per-user z-score over present cells."""
    return stats.user_zscore(ratings(spark, sf_dir))


@register(
    "item_center",
    TRIPLE,
    with_ratings(
        'SELECT "user", item, rating - avg(rating) OVER (PARTITION BY item) AS rating FROM r'
    ),
)
def q_item_center(spark, sf_dir):
    """Column centring."""
    return stats.item_center(ratings(spark, sf_dir))


@register(
    "user_counts",
    [("user", "l"), ("n", "l")],
    with_ratings('SELECT "user", count(*) AS n FROM r GROUP BY "user"'),
)
def q_user_counts(spark, sf_dir):
    """Ratings per user."""
    return stats.counts(ratings(spark, sf_dir), "user")


@register(
    "item_counts",
    [("item", "l"), ("n", "l")],
    with_ratings("SELECT item, count(*) AS n FROM r GROUP BY item"),
)
def q_item_counts(spark, sf_dir):
    """Ratings per item."""
    return stats.counts(ratings(spark, sf_dir), "item")


def _incl_sql(key: str) -> str:
    return with_ratings(
        f"SELECT {key} AS id, count(*) AS n, "
        f"1.0 - pow(1.0 - count(*) / (SELECT count(*) FROM r)::DOUBLE, "
        f"floor((SELECT count(*) FROM r) * {BATCH_FRACTION})::DOUBLE) AS h FROM r GROUP BY {key}"
    )


INCL_SPEC: Spec = [("id", "l"), ("n", "l"), ("h", "d")]


@register("incl_prob_user", INCL_SPEC, _incl_sql('"user"'))
def q_incl_prob_user(spark, sf_dir):
    """Minibatch inclusion probability per user."""
    return stats.inclusion_prob(ratings(spark, sf_dir), "user", BATCH_FRACTION)


@register("incl_prob_item", INCL_SPEC, _incl_sql("item"))
def q_incl_prob_item(spark, sf_dir):
    """Minibatch inclusion probability per item."""
    return stats.inclusion_prob(ratings(spark, sf_dir), "item", BATCH_FRACTION)


@register(
    "global_stats",
    [("mean", "d"), ("std", "d"), ("max", "d"), ("n", "l")],
    with_ratings("SELECT avg(rating) AS mean, stddev_pop(rating) AS std, max(rating) AS max, count(*) AS n FROM r"),
)
def q_global_stats(spark, sf_dir):
    """Global mean, population std, max, count."""
    return stats.global_stats(ratings(spark, sf_dir))


@register(
    "user_stats",
    [("user", "l"), ("mean", "d"), ("std", "d"), ("n", "l")],
    with_ratings(
        'SELECT "user", avg(rating) AS mean, stddev_pop(rating) AS std, count(*) AS n FROM r GROUP BY "user"'
    ),
)
def q_user_stats(spark, sf_dir):
    """Per-user mean, population std, count."""
    return stats.user_stats(ratings(spark, sf_dir))


# --- D. initialisation -----------------------------------------------------

FACTOR_LONG: Spec = [("kind", "s"), ("id", "l"), ("k", "l"), ("val", "d")]


def _ids_sql(table: str = "r") -> str:
    return (
        f"SELECT 'U' AS kind, \"user\" AS id FROM (SELECT DISTINCT \"user\" FROM {table}) a "
        f"UNION ALL SELECT 'V' AS kind, item AS id FROM (SELECT DISTINCT item FROM {table}) b"
    )


def _long_sql(val_expr: str, table: str = "r") -> str:
    return (
        f"SELECT kind, id, k, {val_expr} AS val FROM ({_ids_sql(table)}) ids, "
        f"(SELECT range AS k FROM range({RANK})) kk"
    )


@register("init_constant", FACTOR_LONG, with_ratings(_long_sql(f"{fac.CONST_SGD}::DOUBLE")))
def q_init_constant(spark, sf_dir):
    """Constant start 0.3 for every user and item."""
    return fac.long_form(fac.init_factors(ratings(spark, sf_dir), RANK, "constant"))


@register(
    "init_uniform",
    FACTOR_LONG,
    with_ratings(_long_sql(sql_hash_uniform(SEED, "init", "@kind", "@id", "@k"))),
)
def q_init_uniform(spark, sf_dir):
    """Keyed uniform [0, 1) start."""
    return fac.long_form(fac.init_factors(ratings(spark, sf_dir), RANK, "uniform", seed=SEED))


@register(
    "init_sgld",
    FACTOR_LONG,
    with_ratings(
        _long_sql(f"{fac.CONST_SGD}::DOUBLE")
        + f" UNION ALL SELECT lam AS kind, range AS id, range AS k, {fac.PRIOR_PRECISION}::DOUBLE AS val "
        "FROM range(" + str(RANK) + "), (SELECT 'LambdaU' AS lam UNION ALL SELECT 'LambdaV') l"
    ),
)
def q_init_sgld(spark, sf_dir):
    """D3: SGLD start: constant U, V and the diagonal prior precision 2·I."""
    factors, lam_u, lam_v = fac.sgld_init(ratings(spark, sf_dir), RANK)
    diag = factors.sparkSession.createDataFrame(
        [(name, k, k, float(val)) for name, lam in (("LambdaU", lam_u), ("LambdaV", lam_v)) for k, val in enumerate(lam)],
        "kind string, id bigint, k bigint, val double",
    )
    return fac.long_form(factors).unionByName(diag.select("kind", "id", F.col("k").cast("int"), "val"))


# --- E. model arithmetic (arithmetic factors, so nothing depends on training) ---


def _a(id_expr: str, k: int, step: str = "0") -> str:
    return fac.sql_arithmetic(id_expr, str(k), step)


def _sql_dot(u: str = '"user"', i: str = "item") -> str:
    return " + ".join(f"{_a(u, k)} * {_a(i, k)}" for k in range(RANK))


def _sql_sqnorm(x: str) -> str:
    return " + ".join(f"{_a(x, k)} * {_a(x, k)}" for k in range(RANK))


def arith_factors(df: DataFrame) -> DataFrame:
    return fac.init_factors(df, RANK, "arithmetic")


def rated_arith(spark, sf_dir) -> DataFrame:
    r = ratings(spark, sf_dir)
    return model.attach_factors(r, arith_factors(r))


@register(
    "predict",
    TRIPLE + [("pred", "d")],
    with_ratings(f'SELECT "user", item, rating, {_sql_dot()} AS pred FROM r'),
)
def q_predict(spark, sf_dir):
    """q·p for every rating."""
    return model.predict(rated_arith(spark, sf_dir), RANK)


@register(
    "predict_clipped",
    [("user", "l"), ("item", "l"), ("pred", "d")],
    with_ratings(
        'SELECT "user", item, CASE WHEN pr > 0 AND pr < 1.0 THEN 1.0 WHEN pr > 5.0 THEN 5.0 ELSE pr END AS pred '
        f'FROM (SELECT "user", item, {_sql_dot()} AS pr FROM r) x'
    ),
)
def q_predict_clipped(spark, sf_dir):
    """Predictions clipped to the 1..5 rating scale."""
    rated = rated_arith(spark, sf_dir)
    return rated.select("user", "item", model.clip_prediction(model.prediction(RANK)).alias("pred"))


@register(
    "residuals",
    TRIPLE + [("e", "d")],
    with_ratings(f'SELECT "user", item, rating, rating - ({_sql_dot()}) AS e FROM r'),
)
def q_residuals(spark, sf_dir):
    """Rating - q·p."""
    return model.residuals(rated_arith(spark, sf_dir), RANK).select("user", "item", "rating", "e")


GRAD_LONG: Spec = [("kind", "s"), ("id", "l"), ("k", "l"), ("g", "d")]


def _l2_grad_sql() -> str:
    rho = model.RHO_L2
    parts = []
    for k in range(RANK):
        parts.append(
            f"SELECT 'U' AS kind, \"user\" AS id, {k} AS k, sum(-e * {_a('item', k)} + {rho}::DOUBLE * {_a(chr(34) + 'user' + chr(34), k)}) AS g "
            f'FROM e GROUP BY "user"'
        )
        parts.append(
            f"SELECT 'V' AS kind, item AS id, {k} AS k, sum(-e * {_a(chr(34) + 'user' + chr(34), k)} + {rho}::DOUBLE * {_a('item', k)}) AS g "
            "FROM e GROUP BY item"
        )
    return " UNION ALL ".join(parts)


_E_CTE = f'e AS (SELECT "user", item, rating, rating - ({_sql_dot()}) AS e FROM r)'


@register("l2_gradient", GRAD_LONG, with_ratings(_l2_grad_sql(), _E_CTE))
def q_l2_gradient(spark, sf_dir):
    """Summed L2 gradients per user and item (rho = 0.2)."""
    g = model.l2_gradient(rated_arith(spark, sf_dir), RANK)
    return fac.long_form(g, "g", "g")


@register(
    "r1_objective",
    [("obj_l2", "d"), ("obj_abs", "d")],
    with_ratings(
        f"SELECT sum(e * e / 2.0 + pen) AS obj_l2, sum(abs(e) + pen) AS obj_abs FROM ("
        f'SELECT rating - ({_sql_dot()}) AS e, {model.RHO_R1 / 2.0}::DOUBLE * (({_sql_sqnorm(chr(34) + "user" + chr(34))}) + ({_sql_sqnorm("item")})) AS pen FROM r) x'
    ),
)
def q_r1_objective(spark, sf_dir):
    """Squared-error objective (reported) and its absolute-error twin (rho = 0.5)."""
    return model.objectives(rated_arith(spark, sf_dir), RANK, model.RHO_R1)


def _r1_grad_sql() -> str:
    rho = model.RHO_R1
    u = '"user"'
    parts = []
    for k in range(RANK):
        parts.append(
            f'SELECT "user", item, {k} AS k, '
            f"-w * s * {_a(u, k)} + {rho}::DOUBLE * {_a(u, k)} AS g_q, "
            f"-s * {_a('item', k)} + {rho}::DOUBLE * {_a('item', k)} AS g_p FROM x"
        )
    return " UNION ALL ".join(parts)


@register(
    "r1_gradient",
    [("user", "l"), ("item", "l"), ("k", "l"), ("g_q", "d"), ("g_p", "d")],
    with_ratings(
        _r1_grad_sql(),
        'nu AS (SELECT "user", count(*) AS ni FROM r GROUP BY "user"), '
        "ni AS (SELECT item, count(*) AS nj FROM r GROUP BY item), "
        f'x AS (SELECT r."user", r.item, CAST(sign(rating - ({_sql_dot("r." + chr(34) + "user" + chr(34), "r.item")})) AS DOUBLE) AS s, '
        'CAST(ni AS DOUBLE) / CAST(nj AS DOUBLE) AS w FROM r JOIN nu USING ("user") JOIN ni USING (item))',
    ),
)
def q_r1_gradient(spark, sf_dir):
    """E5: R1 gradients as written (count-weighted sign, own-vector data term)."""
    r = _written(ratings(spark, sf_dir), "ratings")
    rc = model.with_counts(r, stats.counts(r, "user"), stats.counts(r, "item"))
    g = model.r1_gradient(model.attach_factors(rc, arith_factors(r)), RANK, model.RHO_R1, "as_written")
    return g.select("user", "item", F.posexplode(F.arrays_zip("g_q", "g_p")).alias("k", "z")).select(
        "user", "item", "k", F.col("z.g_q").alias("g_q"), F.col("z.g_p").alias("g_p")
    )


FIRST_STEP = 0.9  # harmonic schedule eta0 / (0 + 1)


@register(
    "factor_step",
    FACTOR_LONG,
    with_ratings(
        "SELECT g.kind, g.id, g.k, "
        + "CASE WHEN g.kind = 'U' THEN "
        + fac.sql_arithmetic("g.id", "g.k")
        + f" ELSE {fac.sql_arithmetic('g.id', 'g.k')} END - {FIRST_STEP}::DOUBLE * g.g AS val FROM g",
        _E_CTE + f", g AS ({_l2_grad_sql()})",
    ),
)
def q_factor_step(spark, sf_dir):
    """One batched L2 step from the old pair (eta = 0.9)."""
    r = ratings(spark, sf_dir)
    f0 = arith_factors(r)
    g = model.l2_gradient(model.attach_factors(r, f0), RANK)
    return fac.long_form(model.apply_gradient(f0, g, FIRST_STEP, RANK))


@register(
    "factor_norms",
    [("kind", "s"), ("k", "l"), ("norm2", "d")],
    with_ratings(
        "SELECT kind, k, sum(val * val) AS norm2 FROM ("
        + _long_sql(fac.sql_arithmetic("id", "k"))
        + ") x GROUP BY kind, k"
    ),
)
def q_factor_norms(spark, sf_dir):
    """Per-dimension squared norms of U and V."""
    return model.factor_norms(arith_factors(ratings(spark, sf_dir)), RANK)


# --- H. evaluation (test = hash holdout, factors = arithmetic on train ids) ---

_SPLIT_CTE = (
    f"h AS ({holdout_sql()}), "
    "train AS (SELECT \"user\", item, rating FROM h WHERE split = 'train'), "
    "test AS (SELECT \"user\", item, rating FROM h WHERE split = 'test'), "
    'ku AS (SELECT DISTINCT "user" AS uid FROM train), ki AS (SELECT DISTINCT item AS iid FROM train)'
)


def _cold(id_expr: str, known: str, k: int, step: str = "0") -> str:
    return f"(CASE WHEN {known} IS NOT NULL THEN {_a(id_expr, k, step)} ELSE {fac.CONST_SGD}::DOUBLE END)"


_ALIGNED_PRED = " + ".join(f"{_cold('t.' + chr(34) + 'user' + chr(34), 'ku.uid', k)} * {_cold('t.item', 'ki.iid', k)}" for k in range(RANK))
_ALIGNED_FROM = 'test t LEFT JOIN ku ON t."user" = ku.uid LEFT JOIN ki ON t.item = ki.iid'


def split_arith(spark, sf_dir):
    """The split, written once, and factors of the training ids."""
    split = _written(src.holdout_split(ratings(spark, sf_dir), HOLDOUT_K, SEED), "split")
    train, test = (split.filter(F.col("split") == side).drop("split") for side in ("train", "test"))
    return train, test, arith_factors(train)


@register(
    "aligned_test",
    TRIPLE + [("user_known", "b"), ("item_known", "b"), ("pred", "d")],
    with_ratings(
        f't."user", t.item, t.rating, ku.uid IS NOT NULL AS user_known, ki.iid IS NOT NULL AS item_known, '
        f"{_ALIGNED_PRED} AS pred FROM {_ALIGNED_FROM}".join(["SELECT ", ""]),
        _SPLIT_CTE,
    ),
)
def q_aligned_test(spark, sf_dir):
    """Test cells with train factors attached; unseen ids keep the start value."""
    train, test, f = split_arith(spark, sf_dir)
    a = stats.align_test(test, f, RANK, "init", fac.CONST_SGD)
    return a.withColumn("pred", model.prediction(RANK))


@register(
    "squared_errors",
    TRIPLE + [("sq_err", "d")],
    with_ratings(f't."user", t.item, t.rating, pow(t.rating - ({_ALIGNED_PRED}), 2) AS sq_err FROM {_ALIGNED_FROM}'.join(["SELECT ", ""]), _SPLIT_CTE),
)
def q_squared_errors(spark, sf_dir):
    """H2: squared error of each test cell."""
    train, test, f = split_arith(spark, sf_dir)
    return evaluate.squared_errors(test, f, RANK)


@register(
    "rmse",
    [("rmse", "d"), ("n", "l")],
    with_ratings(
        f"SELECT sqrt(avg(pow(t.rating - ({_ALIGNED_PRED}), 2))) AS rmse, count(*) AS n FROM {_ALIGNED_FROM}",
        _SPLIT_CTE,
    ),
)
def q_rmse(spark, sf_dir):
    """H1: held-out RMSE over all test cells."""
    train, test, f = split_arith(spark, sf_dir)
    return evaluate.rmse(test, f, RANK)


@register(
    "rmse_skip_zero",
    [("rmse", "d"), ("n", "l")],
    with_ratings(
        f"SELECT sqrt(avg(e * e)) AS rmse, count(*) AS n FROM (SELECT t.rating - ({_ALIGNED_PRED}) AS e FROM {_ALIGNED_FROM}) x "
        f"WHERE abs(e) > {evaluate.ZERO_EPS}",
        _SPLIT_CTE,
    ),
)
def q_rmse_skip_zero(spark, sf_dir):
    """H1: RMSE over test cells with a non-zero residual only."""
    train, test, f = split_arith(spark, sf_dir)
    return evaluate.rmse(test, f, RANK, skip_zero=True)


SNAPSHOT_STEPS = 3


@register(
    "rmse_by_step",
    [("step", "l"), ("rmse", "d"), ("n", "l")],
    with_ratings(
        "SELECT step, sqrt(avg(e * e)) AS rmse, count(*) AS n FROM ("
        "SELECT st.range AS step, t.rating - ("
        + " + ".join(f"{_cold('t.' + chr(34) + 'user' + chr(34), 'ku.uid', k, 'st.range')} * {_cold('t.item', 'ki.iid', k, 'st.range')}" for k in range(RANK))
        + f") AS e FROM {_ALIGNED_FROM}, range({SNAPSHOT_STEPS}) st) x GROUP BY step",
        _SPLIT_CTE,
    ),
)
def q_rmse_by_step(spark, sf_dir):
    """H3: RMSE of three snapshot steps over all test cells, in one aggregate."""
    train, test = src.train_test(ratings(spark, sf_dir), HOLDOUT_K, SEED)
    ids = fac.init_factors(train, RANK, "constant").select("kind", "id")
    steps = ids.select("kind", "id", F.explode(F.sequence(F.lit(0), F.lit(SNAPSHOT_STEPS - 1))).alias("step"))
    snaps = steps.select("step", "kind", "id", fac.arithmetic_vector(F.col("id"), RANK, F.col("step")).alias("v"))
    return evaluate.rmse_by_step(test, snaps, RANK)


# --- C. attacks (reference setting: 30 % attackers, 50 % fillers, item 1) ---

ATTACK = atk.AttackScenario(kind="average", at_size=0.3, fil_size=0.5, target=1, seed=SEED)
RANDOM_ATTACK = atk.AttackScenario(kind="random", at_size=0.3, fil_size=0.5, target=1, seed=SEED)
SMALL_ATTACK = atk.AttackScenario(kind="random", at_size=0.1, fil_size=0.2, target=7, seed=SEED)
U = '"user"'


def _attack_ctes(sc: atk.AttackScenario) -> str:
    h_att = sql_hash_bits(sc.seed, "attacker", f"@{U}")
    ctes = [
        f"ext AS (SELECT max({U}) + 1 AS L, max(item) + 1 AS M FROM r)",
        "g AS (SELECT avg(rating) AS mean, stddev_pop(rating) AS std, max(rating) AS mx FROM r)",
        f"cand AS (SELECT unnest(range(0, (SELECT L - 1 FROM ext))) AS {U})",
        f"att AS (SELECT {U} FROM (SELECT {U}, row_number() OVER (ORDER BY {h_att}, {U}) AS rn FROM cand) x "
        f"WHERE rn <= (SELECT floor(L * {sc.at_size}::DOUBLE) FROM ext))",
        f"size AS (SELECT *, CAST(ceil(pool / n_r) AS BIGINT) AS n_c FROM (SELECT M - 1 AS pool, CAST(ceil(sqrt(M - 1)) AS BIGINT) AS n_r, "
        f"least(CAST(floor(M * {sc.fil_size}::DOUBLE) AS BIGINT), M - 1) AS k FROM ext))",
    ]
    # the permutation of the pool's grid, a round at a time
    keep = U
    source = "att"
    for i in range(atk.ROUNDS):
        source = f"({sql_mix_bits(source, keep, sc.seed, [atk.ROUND_SALT + i, U], f'k{i}')})"
        keep += f", k{i}"
    ctes.append(f"p0 AS (SELECT *, j // n_c AS l, j % n_c AS c FROM (SELECT *, unnest(range(0, k + n_r * n_c - pool)) AS j FROM {source} CROSS JOIN size))")
    for i in range(atk.ROUNDS):
        moved, by, n = ("l", "c", "n_r") if i % 2 == 0 else ("c", "l", "n_c")
        h = f"(({by} + k{i}) * {MIX_A}) % {MIX_P}"
        shifted = f"((xor(h, h >> {MIX_SHIFT_1}) * {MIX_B}) % {MIX_P}) >> 7"
        ctes.append(f"p{i + 1} AS (SELECT * EXCLUDE (h) REPLACE (({moved} + ({shifted})) % {n} AS {moved}) FROM (SELECT *, {h} AS h FROM p{i}))")
    ctes.append(
        f"fil AS (SELECT {U}, item FROM (SELECT {U}, l * n_c + c AS item, j, k, pool FROM p{atk.ROUNDS}) x WHERE item < pool "
        f"QUALIFY row_number() OVER (PARTITION BY {U} ORDER BY j) <= k)"
    )
    ctes.append(f"zfil AS ({sql_mix_normal('fil', f'{U}, item', sc.seed, [atk.VALUE_SALT, U, 'item'], 'z')})")
    if sc.kind == "random":
        fill = f"SELECT {U}, item, (SELECT mean FROM g) + (SELECT std FROM g) * z AS rating FROM zfil"
    else:
        ctes.append(f"us AS (SELECT {U}, avg(rating) AS m, stddev_pop(rating) AS s FROM r GROUP BY {U})")
        fill = (
            f"SELECT zfil.{U}, zfil.item, coalesce(us.m, (SELECT mean FROM g)) + coalesce(us.s, (SELECT std FROM g)) * z "
            f"AS rating FROM zfil LEFT JOIN us USING ({U})"
        )
    ctes.append(
        f"fake AS (SELECT * FROM ({fill}) f WHERE item <> {sc.target} "
        f"UNION ALL SELECT {U}, CAST({sc.target} AS BIGINT) AS item, (SELECT mx FROM g) AS rating FROM att)"
    )
    ctes.append(
        f"atk AS (SELECT r.* FROM r ANTI JOIN fake f USING ({U}, item) UNION ALL SELECT * FROM fake)"
    )
    return ", ".join(ctes)


@register("attackers", [("user", "l")], with_ratings("SELECT * FROM att", _attack_ctes(ATTACK)))
def q_attackers(spark, sf_dir):
    """30 % of the user range (last id excluded), by keyed hash."""
    n_users, _ = src.extent_values(ratings(spark, sf_dir))
    return atk.choose_attackers(spark, n_users, ATTACK.at_size, SEED)


@register("fillers", [("user", "l"), ("item", "l")], with_ratings("SELECT * FROM fil", _attack_ctes(ATTACK)))
def q_fillers(spark, sf_dir):
    """50 % of the item range per attacker (last id excluded)."""
    n_users, n_items = src.extent_values(ratings(spark, sf_dir))
    att = atk.choose_attackers(spark, n_users, ATTACK.at_size, SEED)
    return atk.choose_fillers(att, n_items, ATTACK.fil_size, SEED)


@register("random_attack", TRIPLE, with_ratings("SELECT * FROM fake", _attack_ctes(RANDOM_ATTACK)))
def q_random_attack(spark, sf_dir):
    """Fake cells ~ N(global mean, global std); target at the global max."""
    return atk.fake_cells(ratings(spark, sf_dir), RANDOM_ATTACK)


@register("average_attack", TRIPLE, with_ratings("SELECT * FROM fake", _attack_ctes(ATTACK)))
def q_average_attack(spark, sf_dir):
    """C4: fake cells ~ N(attacker mean, attacker std); target at the global max."""
    return atk.fake_cells(ratings(spark, sf_dir), ATTACK)


@register(
    "attack_target",
    TRIPLE,
    with_ratings(f"SELECT {U}, CAST({ATTACK.target} AS BIGINT) AS item, (SELECT mx FROM g) AS rating FROM att", _attack_ctes(ATTACK)),
)
def q_attack_target(spark, sf_dir):
    """The pushed cells (attacker, target item) at the global maximum."""
    return atk.target_cells(ratings(spark, sf_dir), ATTACK)


@register("attack_overlay", TRIPLE, with_ratings("SELECT * FROM atk", _attack_ctes(ATTACK)))
def q_attack_overlay(spark, sf_dir):
    """The attacked rating table (fake cells replace real ones)."""
    return atk.attack(ratings(spark, sf_dir), ATTACK)


SUMMARY_SCENARIOS = (ATTACK, RANDOM_ATTACK, SMALL_ATTACK)


def _summary_sql() -> str:
    parts = []
    for sc in SUMMARY_SCENARIOS:
        parts.append(
            f"(WITH r AS ({RATINGS_SQL}), {_attack_ctes(sc)} SELECT '{sc.name}' AS scenario, "
            f"{sc.at_size}::DOUBLE AS at_size, {sc.fil_size}::DOUBLE AS fil_size, {sc.target} AS target, "
            "(SELECT count(*) FROM att) AS n_attackers, (SELECT count(*) FROM fake) AS n_fake, "
            "(SELECT count(*) FROM atk) AS n_rows)"
        )
    return " UNION ALL ".join(parts)


@register(
    "attack_size_summary",
    [("scenario", "s"), ("at_size", "d"), ("fil_size", "d"), ("target", "l"), ("n_attackers", "l"), ("n_fake", "l"), ("n_rows", "l")],
    _summary_sql(),
)
def q_attack_size_summary(spark, sf_dir):
    """Scenario table with the size of each attack."""
    r = _written(ratings(spark, sf_dir), "ratings")
    n_users, n_items, g = stats.summary_values(r)
    out = None
    for sc in SUMMARY_SCENARIOS:
        plan = atk.plan_attack(r, sc, n_users, n_items, g)
        row = atk.attack_sizes(r, plan).select(
            F.lit(sc.name).alias("scenario"),
            F.lit(sc.at_size).alias("at_size"),
            F.lit(sc.fil_size).alias("fil_size"),
            F.lit(sc.target).alias("target"),
            "n_attackers",
            "n_fake",
            "n_rows",
        )
        out = row if out is None else out.unionByName(row)
    return out


# --- A8-A11, E8-E10. written and read back; step sizes ------------------------


@register("factor_sink", FACTOR_LONG, with_ratings(_long_sql(fac.sql_arithmetic("id", "k"))))
def q_factor_sink(spark, sf_dir):
    """Factors written as text, one line per id, and read back."""
    from stratafac.sources import sinks

    path = _scratch(spark, "factors")
    sinks.write_factors(arith_factors(ratings(spark, sf_dir)), path, "csv")
    return fac.long_form(sinks.read_factors(spark, path, "csv"))


@register(
    "dense_factor_sink",
    FACTOR_LONG,
    with_ratings(
        f"SELECT w.kind, w.id, k, CASE WHEN ids.id IS NULL THEN 0.0 ELSE {fac.sql_arithmetic('w.id', 'k')} END AS val FROM ("
        f"SELECT 'U' AS kind, unnest(range(0, (SELECT max({chr(34)}user{chr(34)}) + 1 FROM r))) AS id "
        "UNION ALL SELECT 'V' AS kind, unnest(range(0, (SELECT max(item) + 1 FROM r))) AS id) w "
        f"LEFT JOIN ({_ids_sql()}) ids ON ids.kind = w.kind AND ids.id = w.id, (SELECT range AS k FROM range({RANK})) kk"
    ),
)
def q_dense_factor_sink(spark, sf_dir):
    """Factors written as two dense matrices (P: C x items, Q: users x C) and read back."""
    from stratafac.sources import sinks

    p, q = _scratch(spark, "P"), _scratch(spark, "Q")
    sinks.write_dense_factors(arith_factors(ratings(spark, sf_dir)), p, q)
    return fac.long_form(sinks.read_dense_factors(spark, p, q))


@register("tiled_factor_sink", FACTOR_LONG, with_ratings(_long_sql(fac.sql_arithmetic("id", "k"))))
def q_tiled_factor_sink(spark, sf_dir):
    """Factors written as transposed tiles of 256 ids, read back; the zeros of
    ids without a row are left out again."""
    from stratafac.sources import sinks

    path = _scratch(spark, "tiles")
    factors = arith_factors(ratings(spark, sf_dir))
    sinks.write_tiled_factors(factors, path, tile=256)
    back = sinks.read_tiled_factors(spark, path, tile=256)
    return fac.long_form(back.join(factors.select("kind", "id"), ["kind", "id"], "left_semi"))


@register("attacked_sink", TRIPLE, with_ratings("SELECT * FROM atk", _attack_ctes(ATTACK)))
def q_attacked_sink(spark, sf_dir):
    """The attacked table written under its scenario (twice: a rerun replaces it) and read back."""
    from stratafac.sources import sinks

    path = _scratch(spark, "attacked")
    r = ratings(spark, sf_dir)
    sinks.write_attacked(r, path, ATTACK.name)
    sinks.write_attacked(atk.attack(r, ATTACK), path, ATTACK.name)
    return sinks.read_attacked(spark, path, ATTACK.name)


@register(
    "metrics_sink",
    [("scenario", "s"), ("model", "s"), ("epoch", "l"), ("rmse", "d"), ("objective", "d")],
    with_ratings(
        "SELECT 'clean' AS scenario, 'arithmetic' AS model, 0 AS epoch, "
        f"(SELECT sqrt(avg(pow(t.rating - ({_ALIGNED_PRED}), 2))) FROM {_ALIGNED_FROM}) AS rmse, "
        f"(SELECT sum(e * e / 2.0 + pen) FROM (SELECT rating - ({_sql_dot()}) AS e, {model.RHO_R1 / 2.0}::DOUBLE * "
        f"(({_sql_sqnorm(U)}) + ({_sql_sqnorm('item')})) AS pen FROM train) x) AS objective",
        _SPLIT_CTE,
    ),
)
def q_metrics_sink(spark, sf_dir):
    """A10: a metric row (held-out RMSE, training objective) written and read back."""
    from stratafac.sources import sinks

    train, test, f = split_arith(spark, sf_dir)
    objective = model.objectives(model.attach_factors(train, f), RANK, model.RHO_R1).first()["obj_l2"]
    row = {"scenario": "clean", "model": "arithmetic", "epoch": 0, "rmse": evaluate.rmse_value(test, f, RANK), "objective": float(objective), "elapsed_s": 0.0}
    path = _scratch(spark, "metrics")
    sinks.write_metrics(spark, [row], path)
    return spark.read.parquet(path)


@register(
    "snapshot_sink",
    [("step", "l")] + FACTOR_LONG,
    with_ratings(
        f"SELECT st.range AS step, kind, id, k, {fac.sql_arithmetic('id', 'k', 'st.range')} AS val FROM ({_ids_sql()}) ids, "
        f"(SELECT range AS k FROM range({RANK})) kk, range({SNAPSHOT_STEPS}) st"
    ),
)
def q_snapshot_sink(spark, sf_dir):
    """A snapshot per step (step 0 twice: a rerun replaces it), read back."""
    from stratafac.sources import sinks

    path = _scratch(spark, "snapshots")
    ids = _written(arith_factors(ratings(spark, sf_dir)).select("kind", "id"), "snapshot-ids")
    for step in (*range(SNAPSHOT_STEPS), 0):
        sinks.write_snapshot(ids.select("kind", "id", fac.arithmetic_vector(F.col("id"), RANK, step).alias("v")), path, step)
    return sinks.read_snapshots(spark, path).select("step", "kind", "id", F.posexplode("v").alias("k", "val"))


SCHEDULE_ETA0 = 0.9
SCHEDULE_STRIDE = 997  # step index = this many times a user's rating count
_SCHEDULES = {
    "harmonic": "{e} / (i + 1.0)",
    "linear": "CASE WHEN i < 50000 THEN {e} * (1.0 - i / 50000.0::DOUBLE) + i / 50000.0::DOUBLE * 0.01 * {e} ELSE 0.01 * {e} END",
    "polynomial": "{e} * pow(1.0 + i / 500.0::DOUBLE, -0.51)",
    "halving": "{e} / pow(2.0, floor(i / 10000.0::DOUBLE))",
    "power": "{e} * pow(1.0 + i, -0.5)",
    "geometric": "{e} * pow(0.96, i)",
}


@register(
    "schedules",
    [("schedule", "s"), ("user", "l"), ("i", "l"), ("eta", "d")],
    with_ratings(
        " UNION ALL ".join(f"SELECT '{n}' AS schedule, {U}, i, {x.format(e=f'{SCHEDULE_ETA0}::DOUBLE')} AS eta FROM x" for n, x in _SCHEDULES.items()),
        f"x AS (SELECT {U}, CAST(count(*) * {SCHEDULE_STRIDE} AS BIGINT) AS i FROM r GROUP BY {U})",
    ),
)
def q_schedules(spark, sf_dir):
    """Step sizes at an index taken from every user's rating count."""
    from stratafac.functions.schedules import step_column

    index = stats.counts(ratings(spark, sf_dir), "user").select("user", (F.col("n") * SCHEDULE_STRIDE).alias("i"))
    named = F.array(*[F.struct(F.lit(n).alias("schedule"), step_column(n, SCHEDULE_ETA0, F.col("i")).alias("eta")) for n in _SCHEDULES])
    return index.select("user", "i", F.explode(named).alias("s")).select("s.schedule", "user", "i", "s.eta")


# --- F1-F4, E7. block grid (B = 4) ------------------------------------------


def _blocked_sql(b: int = BLOCKS) -> str:
    def blk(col: str, n: str) -> str:
        return (
            f"CAST(CASE WHEN {n} // {b} = 0 THEN {b - 1} ELSE least({col} // ({n} // {b}), {b - 1}) END AS BIGINT)"
        )

    return (
        f"ext AS (SELECT max({U}) + 1 AS L, max(item) + 1 AS M FROM r), "
        f"bl AS (SELECT {U}, item, rating, {blk(U, '(SELECT L FROM ext)')} AS ub, "
        f"{blk('item', '(SELECT M FROM ext)')} AS ib FROM r), "
        f"blocked AS (SELECT *, ((ub - ib) % {b} + {b}) % {b} AS stratum FROM bl)"
    )


def blocked_ratings(spark, sf_dir) -> DataFrame:
    r = ratings(spark, sf_dir)
    n_users, n_items = src.extent_values(r)
    return blocks.assign_blocks(r, n_users, n_items, BLOCKS)


BLOCK_SPEC: Spec = [("user", "l"), ("item", "l"), ("ub", "l"), ("ib", "l")]


@register("block_assign", BLOCK_SPEC, with_ratings(f"SELECT {U}, item, ub, ib FROM blocked", _blocked_sql()))
def q_block_assign(spark, sf_dir):
    """row and column block of every rating (range blocks, B = 4)."""
    return blocked_ratings(spark, sf_dir)


@register(
    "stratum_schedule",
    BLOCK_SPEC + [("stratum", "l")],
    with_ratings(f"SELECT {U}, item, ub, ib, stratum FROM blocked", _blocked_sql()),
)
def q_stratum_schedule(spark, sf_dir):
    """sub-epoch of every rating, (ub - ib) mod B."""
    return blocked_ratings(spark, sf_dir)


@register(
    "block_nnz",
    [("stratum", "l"), ("ub", "l"), ("ib", "l"), ("n", "l")],
    with_ratings("SELECT stratum, ub, ib, count(*) AS n FROM blocked GROUP BY stratum, ub, ib", _blocked_sql()),
)
def q_block_nnz(spark, sf_dir):
    """ratings per block and stratum."""
    return blocks.block_nnz(blocked_ratings(spark, sf_dir))


@register(
    "draw_with_replacement",
    [("ub", "l"), ("ib", "l"), ("j", "l"), ("user", "l"), ("item", "l"), ("rating", "d")],
    with_ratings(
        f"SELECT dri.ub, dri.ib, dri.j, nb.{U}, nb.item, nb.rating FROM dri JOIN nb USING (ub, ib, idx)",
        _blocked_sql()
        + f", nb AS (SELECT *, row_number() OVER (PARTITION BY ub, ib ORDER BY {U}, item) AS idx FROM blocked), "
        "cnt AS (SELECT ub, ib, count(*) AS n FROM blocked GROUP BY ub, ib), "
        "dr AS (SELECT ub, ib, n, unnest(range(1, n + 1)) AS j FROM cnt), "
        f"dri AS (SELECT ub, ib, j, 1 + {sql_hash_index(SEED, 'n', 'draw', 0, '@ub', '@ib', '@j')} AS idx FROM dr)",
    ),
)
def q_draw_with_replacement(spark, sf_dir):
    """Per-block uniform draws with replacement (epoch 0)."""
    return blocks.draw_with_replacement(blocked_ratings(spark, sf_dir), SEED, 0)


@register(
    "global_draws",
    [("j", "l"), ("ub", "l"), ("ib", "l"), ("user", "l"), ("item", "l"), ("rating", "d")],
    with_ratings(
        f"SELECT dr.j, nb.ub, nb.ib, nb.{U}, nb.item, nb.rating FROM dr JOIN nb ON nb.at = dr.at",
        _blocked_sql()
        + f", nb AS (SELECT *, row_number() OVER (ORDER BY ub, ib, {U}, item) - 1 AS at FROM blocked), "
        "cnt AS (SELECT count(*) AS n FROM blocked), "
        "js AS (SELECT n, unnest(range(1, n + 1)) AS j FROM cnt), "
        f"dr AS (SELECT j, {sql_hash_index(SEED, 'n', 'global', 0, '@j')} AS at FROM js)",
    ),
)
def q_global_draws(spark, sf_dir):
    """The trainers' one draw sequence over all ratings (epoch 0, one draw per rating)."""
    numbered = blocks.rank_index(blocked_ratings(spark, sf_dir))
    # the blocks' sizes are B^2 rows
    sizes = [(r["ub"], r["ib"], r["n"]) for r in numbered.groupBy("ub", "ib").agg(F.count(F.lit(1)).alias("n")).collect()]
    drawn = blocks.global_draws(spark, sizes, sum(n for _, _, n in sizes), SEED, 0)
    return drawn.join(numbered.drop("n"), ["ub", "ib", "idx"])


# --- G1-G2. SGLD minibatches (round 0, 5 %) ---------------------------------


def _batch_sql(mode: str, t: int = 0) -> str:
    if mode == "threshold":
        return f"SELECT * FROM r WHERE {sql_hash_uniform(SEED, 'batch', t, f'@{U}', '@item')} < {BATCH_FRACTION}"
    h = sql_hash_bits(SEED, "batch", t, f"@{U}", "@item")
    return (
        f"SELECT {U}, item, rating FROM (SELECT *, row_number() OVER (ORDER BY {h}, {U}, item) AS rn FROM r) x "
        f"WHERE rn <= (SELECT floor(count(*) * {BATCH_FRACTION}::DOUBLE) FROM r)"
    )


@register("minibatch", TRIPLE, with_ratings(_batch_sql("threshold")))
def q_minibatch(spark, sf_dir):
    """G1 (threshold mode): each rating with probability 0.05."""
    return sampling.minibatch(ratings(spark, sf_dir), BATCH_FRACTION, SEED, 0, "threshold")


@register("minibatch_exact", TRIPLE, with_ratings(_batch_sql("exact")))
def q_minibatch_exact(spark, sf_dir):
    """G1 (exact mode): int(0.05·N) ratings without replacement."""
    return sampling.minibatch(ratings(spark, sf_dir), BATCH_FRACTION, SEED, 0, "exact")


@register(
    "batch_entities",
    [("kind", "s"), ("id", "l")],
    with_ratings(
        f"SELECT DISTINCT 'U' AS kind, {U} AS id FROM b UNION ALL SELECT DISTINCT 'V' AS kind, item AS id FROM b",
        f"b AS ({_batch_sql('threshold')})",
    ),
)
def q_batch_entities(spark, sf_dir):
    """Distinct users and items touched by the batch."""
    from stratafac.operators import langevin

    return langevin.batch_entities(sampling.minibatch(ratings(spark, sf_dir), BATCH_FRACTION, SEED, 0, "threshold"))


# --- G3-G7. one SGLD round from arithmetic factors (t = 0, step 1e-4) ---------

STEP0 = 1e-4
PRIOR = fac.PRIOR_PRECISION


def _sgld_base(spark, sf_dir):
    from stratafac.operators import langevin

    r = _written(ratings(spark, sf_dir), "sgld-ratings")
    f = arith_factors(r)
    n_total = r.count()
    batch = _written(sampling.minibatch(r, BATCH_FRACTION, SEED, 0, "threshold"), "sgld-batch")
    m = batch.count()
    fh = langevin.with_inclusion(
        f, stats.inclusion_prob(r, "user", BATCH_FRACTION), stats.inclusion_prob(r, "item", BATCH_FRACTION)
    )
    return r, f, fh, batch, n_total, m


_KK = f"kk AS (SELECT range AS k FROM range({RANK}))"
_SGLD_CTES = ", ".join(
    [
        f"b AS ({_batch_sql('threshold')})",
        "mm AS (SELECT count(*) AS m FROM b)",
        "nn AS (SELECT count(*) AS n FROM r)",
        _KK,
        f"e AS (SELECT {U}, item, rating - ({_sql_dot()}) AS e FROM b)",
        "hp AS ("
        + " UNION ALL ".join(
            f"SELECT '{kind}' AS kind, {col} AS id, 1.0 - pow(1.0 - count(*) / (SELECT n FROM nn)::DOUBLE, "
            f"floor((SELECT n FROM nn) * {BATCH_FRACTION})::DOUBLE) AS h FROM r GROUP BY {col}"
            for kind, col in (("U", U), ("V", "item"))
        )
        + ")",
        "gs AS ("
        f"SELECT 'U' AS kind, {U} AS id, k, sum(e * {fac.sql_arithmetic('item', 'k')}) AS s FROM e, kk GROUP BY {U}, k "
        f"UNION ALL SELECT 'V' AS kind, item AS id, k, sum(e * {fac.sql_arithmetic(U, 'k')}) AS s FROM e, kk GROUP BY item, k)",
        f"tid AS (SELECT DISTINCT 'U' AS kind, {U} AS id FROM b UNION ALL SELECT DISTINCT 'V' AS kind, item AS id FROM b)",
    ]
)


@register(
    "sgld_row_grad",
    [("user", "l"), ("item", "l"), ("k", "l"), ("gu", "d"), ("gv", "d")],
    with_ratings(
        f"SELECT {U}, item, k, e * {fac.sql_arithmetic('item', 'k')} AS gu, e * {fac.sql_arithmetic(U, 'k')} AS gv FROM e, kk",
        _SGLD_CTES,
    ),
)
def q_sgld_row_grad(spark, sf_dir):
    """Per-rating likelihood gradients of the batch."""
    from stratafac.operators import langevin

    r, f, fh, batch, n_total, m = _sgld_base(spark, sf_dir)
    g = langevin.row_gradients(batch, f, RANK)
    return g.select("user", "item", F.posexplode(F.arrays_zip("gu", "gv")).alias("k", "z")).select(
        "user", "item", "k", F.col("z.gu").alias("gu"), F.col("z.gv").alias("gv")
    )


def _grad_query(kind: str):
    def run(spark, sf_dir):
        from stratafac.operators import langevin

        r, f, fh, batch, n_total, m = _sgld_base(spark, sf_dir)
        g = langevin.batch_gradients(batch, f, RANK, m).filter(F.col("kind") == kind)
        return g.select("id", F.posexplode("g").alias("k", "g"))

    return run


_GSPEC: Spec = [("id", "l"), ("k", "l"), ("g", "d")]
register("sgld_user_grad", _GSPEC, with_ratings("SELECT id, k, s / (SELECT m FROM mm) AS g FROM gs WHERE kind = 'U'", _SGLD_CTES))(
    _grad_query(USER)
)
register("sgld_item_grad", _GSPEC, with_ratings("SELECT id, k, s / (SELECT m FROM mm) AS g FROM gs WHERE kind = 'V'", _SGLD_CTES))(
    _grad_query(ITEM)
)


@register(
    "sgld_prior_term",
    [("kind", "s"), ("id", "l"), ("k", "l"), ("prior", "d")],
    with_ratings(
        f"SELECT tid.kind, tid.id, k, {fac.sql_arithmetic('tid.id', 'k')} * {PRIOR}::DOUBLE / hp.h AS prior "
        "FROM tid JOIN hp USING (kind, id), kk",
        _SGLD_CTES,
    ),
)
def q_sgld_prior_term(spark, sf_dir):
    """(1/h)·v·λ for the ids touched by the batch."""
    from stratafac.operators import langevin

    r, f, fh, batch, n_total, m = _sgld_base(spark, sf_dir)
    touched = fh.join(langevin.batch_entities(batch), ["kind", "id"], "left_semi")
    p = langevin.prior_term(touched, [PRIOR] * RANK, [PRIOR] * RANK, RANK)
    return p.select("kind", "id", F.posexplode("prior").alias("k", "prior"))


@register(
    "sgld_noise",
    [("kind", "s"), ("id", "l"), ("k", "l"), ("noise", "d")],
    with_ratings(
        f"SELECT kind, id, k, sqrt({STEP0}) * {sql_hash_normal(SEED, 'noise', 0, '@kind', '@id', '@k')} AS noise FROM tid, kk",
        _SGLD_CTES,
    ),
)
def q_sgld_noise(spark, sf_dir):
    """G6 (per_row): independent N(0, step·I) draws for the touched ids."""
    from stratafac.operators import langevin

    r = ratings(spark, sf_dir)
    ent = langevin.batch_entities(sampling.minibatch(r, BATCH_FRACTION, SEED, 0, "threshold"))
    return ent.select("kind", "id", F.posexplode(langevin.per_row_noise(SEED, 0, STEP0, RANK)).alias("k", "noise"))


def _sgld_step_sql() -> str:
    a = fac.sql_arithmetic("ids.id", "kk.k")
    half = repr(0.5 * STEP0)
    nz = f"sqrt({STEP0}) * {sql_hash_normal(SEED, 'noise', 0, '@kk.k')}"
    return (
        f"SELECT ids.kind, ids.id, kk.k, CASE WHEN gs.s IS NULL THEN {a} ELSE "
        f"{a} + {half} * ((SELECT n FROM nn) * (gs.s / (SELECT m FROM mm)) - {a} * {PRIOR}::DOUBLE / hp.h) + {nz} END AS val "
        f"FROM ({_ids_sql()}) ids CROSS JOIN kk LEFT JOIN gs ON gs.kind = ids.kind AND gs.id = ids.id AND gs.k = kk.k "
        "LEFT JOIN hp ON hp.kind = ids.kind AND hp.id = ids.id"
    )


@register("sgld_step", FACTOR_LONG, with_ratings(_sgld_step_sql(), _SGLD_CTES))
def q_sgld_step(spark, sf_dir):
    """One full SGLD round (shared noise, both sides from the old values)."""
    from stratafac.operators import langevin

    r, f, fh, batch, n_total, m = _sgld_base(spark, sf_dir)
    new = langevin.sgld_update(fh, batch, RANK, n_total, m, STEP0, [PRIOR] * RANK, [PRIOR] * RANK, 0, SEED, "shared")
    return fac.long_form(new)



# --- F5-F9, G8, H5. trainers (no SQL twin: iterative; rows-only check + pytest) ---

METRIC_SPEC: Spec = [("scenario", "s"), ("model", "s"), ("epoch", "l"), ("rmse", "d"), ("elapsed_s", "d")]
STABLE_ETA0 = 0.02  # linear schedule: first step that stays finite on z-scored ratings


BATCH_ROUNDS = 20


def _batch_table_sql() -> str:
    u = sql_hash_uniform(SEED, "skip", 0, '@"user"', "@item", "@k")
    skip = f"CAST(least(floor(ln({u}) / ln(1.0::DOUBLE - {BATCH_FRACTION}::DOUBLE)), {BATCH_ROUNDS}) AS BIGINT)"
    return (
        f'WITH RECURSIVE r AS ({RATINGS_SQL}), first AS (SELECT "user", item, rating, 1 AS k FROM r), hits AS ('
        f'SELECT "user", item, rating, k, {skip} AS t FROM first '
        f'UNION ALL SELECT "user", item, rating, k, t + 1 + {skip} FROM (SELECT "user", item, rating, k + 1 AS k, t FROM hits WHERE t < {BATCH_ROUNDS}) x) '
        f'SELECT t, "user", item, rating FROM hits WHERE t < {BATCH_ROUNDS}'
    )


@register("minibatch_table", [("t", "l")] + TRIPLE, _batch_table_sql())
def q_minibatch_table(spark, sf_dir):
    """G1: the batches of 20 rounds, drawn in one pass over the ratings."""
    return sampling.batch_table(ratings(spark, sf_dir), BATCH_FRACTION, SEED, 0, BATCH_ROUNDS)


def zscored_split(spark, sf_dir):
    from stratafac.plans.experiments import prepared_split

    return prepared_split(ratings(spark, sf_dir), HOLDOUT_K, SEED)


def _metrics_df(spark, rows):
    from stratafac.sources.sinks import metrics_frame

    return metrics_frame(spark, rows)


@register("dsgd_stratum", FACTOR_LONG)
def q_dsgd_stratum(spark, sf_dir):
    """one sub-epoch (s = 0) of block SGD from the uniform start."""
    from stratafac.plans import dsgd

    train, _ = zscored_split(spark, sf_dir)
    cfg = dsgd.DSGDConfig(rank=RANK, blocks=BLOCKS)
    n_users, n_items = src.extent_values(train)
    keys = dsgd.partition_keys(spark, cfg.blocks)
    prepared = dsgd.prepare_ratings(train, cfg, n_users, n_items, keys)
    f0 = dsgd.initial_factors(train, cfg, n_users, n_items)
    return fac.long_form(dsgd.stratum_step(prepared, f0, cfg, keys, 0, 0, 0))


@register("dsgd_train", METRIC_SPEC)
def q_dsgd_train(spark, sf_dir):
    """reference DSGD setting (B = 4, 50 epochs, harmonic 0.9 per block, uniform
    start); RMSE per epoch. A diverging run stops and reports a non-finite RMSE."""
    from stratafac.plans import dsgd

    train, test = zscored_split(spark, sf_dir)
    cfg = dsgd.with_overrides(dsgd.DSGD_REFERENCE, on_divergence="stop")
    return _metrics_df(spark, dsgd.train_dsgd(spark, train, test, cfg, "clean", "dsgd").metrics)


@register("sgd_linear_train", METRIC_SPEC)
def q_sgd_linear_train(spark, sf_dir):
    """F8: one draw per rating with the linear schedule, constant 0.3 start, RMSE
    per sub-epoch. eta0 is ``STABLE_ETA0``: the preset's 0.9 diverges on z-scores
    and raises (``dsgd.SGD_LINEAR_REFERENCE``)."""
    from stratafac.plans import dsgd

    train, test = zscored_split(spark, sf_dir)
    cfg = dsgd.with_overrides(dsgd.SGD_LINEAR_REFERENCE, eta0=STABLE_ETA0, draws_per_epoch=None)
    return _metrics_df(spark, dsgd.train_dsgd(spark, train, test, cfg, "clean", "sgd_linear").metrics)


@register("r1_train", METRIC_SPEC + [("objective", "d")])
def q_r1_train(spark, sf_dir):
    """one R1 draw per rating (rho 0.5, eta0 0.001, constant 0.5 start), RMSE per sub-epoch."""
    from stratafac.plans import dsgd

    train, test = zscored_split(spark, sf_dir)
    cfg = dsgd.with_overrides(dsgd.R1_REFERENCE, draws_per_epoch=None)
    return _metrics_df(spark, dsgd.train_dsgd(spark, train, test, cfg, "clean", "r1").metrics)


@register("sgld_train", METRIC_SPEC)
def q_sgld_train(spark, sf_dir):
    """The reference's 400 SGLD rounds (5 % batches, step 1e-4 polynomial, shared noise), RMSE per round."""
    from stratafac.plans import sgld

    train, test = zscored_split(spark, sf_dir)
    cfg = sgld.SGLDConfig(rank=RANK, on_divergence="stop")
    return _metrics_df(spark, sgld.train_sgld(spark, train, test, cfg, "clean", "sgld").metrics)


RESAMPLE_AFTER, RESAMPLE_EVERY = 3, 4  # I3: rounds of the registered run (the reference's disabled code: 149, 50)


@register("sgld_resampled_train", METRIC_SPEC)
def q_sgld_resampled_train(spark, sf_dir):
    """SGLD whose prior precisions are resampled from the factor norms, RMSE per round."""
    from stratafac.plans import sgld

    train, test = zscored_split(spark, sf_dir)
    cfg = sgld.SGLDConfig(rank=RANK, rounds=2 * RESAMPLE_EVERY, resample_after=RESAMPLE_AFTER, resample_every=RESAMPLE_EVERY, on_divergence="stop")
    return _metrics_df(spark, sgld.train_sgld(spark, train, test, cfg, "clean", "sgld_resampled").metrics)


SNAPSHOT_ROUNDS = 10


@register("sgld_snapshot_rmse", [("step", "l"), ("rmse", "d"), ("n", "l")])
def q_sgld_snapshot_rmse(spark, sf_dir):
    """SGLD rounds that write a snapshot each; the held-out RMSE of
    all written snapshots, in one job."""
    from stratafac.plans import sgld

    train, test = zscored_split(spark, sf_dir)
    path = _scratch(spark, "snapshots")
    cfg = sgld.SGLDConfig(rank=RANK, rounds=SNAPSHOT_ROUNDS, eval_every=0, snapshot_every=1, snapshot_path=path, on_divergence="stop")
    sgld.train_sgld(spark, train, None, cfg)
    return sgld.snapshot_rmse(spark, test, path, cfg)


def grid_models(dsgd_epochs: int, sgld_rounds: int):
    from stratafac.plans import dsgd, sgld
    from stratafac.plans.experiments import ModelSpec

    return (
        ModelSpec("dsgd", "dsgd", dsgd_cfg=dsgd.with_overrides(dsgd.DSGD_REFERENCE, epochs=dsgd_epochs, on_divergence="stop")),
        ModelSpec("sgd_linear", "dsgd", dsgd_cfg=dsgd.with_overrides(dsgd.SGD_LINEAR_REFERENCE, eta0=STABLE_ETA0, draws_per_epoch=None, on_divergence="stop", eval_every="epoch")),
        ModelSpec("r1", "dsgd", dsgd_cfg=dsgd.with_overrides(dsgd.R1_REFERENCE, draws_per_epoch=None, on_divergence="stop", eval_every="epoch")),
        ModelSpec("sgld", "sgld", sgld_cfg=sgld.SGLDConfig(rank=RANK, rounds=sgld_rounds, eval_every=sgld_rounds, on_divergence="stop")),
    )


GRID_SPEC: Spec = [("scenario", "s"), ("model", "s"), ("rmse", "d"), ("diverged", "b")]


def last_rmse(metrics: DataFrame) -> DataFrame:
    """The RMSE a run ended with, and whether it ended by diverging."""
    last = metrics.groupBy("scenario", "model").agg(F.max_by("rmse", "epoch").alias("rmse"))
    finite = F.col("rmse").isNotNull() & ~F.isnan("rmse") & (F.abs("rmse") < F.lit(float("inf")))
    return last.withColumn("diverged", ~finite)


@register("robustness_grid", GRID_SPEC)
def q_robustness_grid(spark, sf_dir):
    """H5: clean vs average attack (0.3 / 0.5 / item 1) for four models, trained as
    long as the reference trains them; the last RMSE of each."""
    from stratafac.plans import dsgd, sgld
    from stratafac.plans.experiments import GridConfig, run_grid

    models = grid_models(dsgd.DSGDConfig().epochs, sgld.SGLDConfig().rounds)
    cfg = GridConfig(scenarios=(None, ATTACK), models=models, holdout_k=HOLDOUT_K, seed=SEED)
    metrics = run_grid(spark, ratings(spark, sf_dir), cfg)
    return last_rmse(metrics)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smoke-check query: the small robustness grid (2 scenarios × 3 models,
    one DSGD epoch, one R1 epoch, three SGLD rounds)."""
    from stratafac.plans.experiments import GridConfig, run_grid

    from dataclasses import replace

    from stratafac.plans import dsgd

    dsgd_m, _, r1_m, sgld_m = grid_models(1, 3)
    # Smoke-size input: the cached factor layout (same results, see
    # tests/test_model_blocks.py::test_factor_layouts_agree) avoids a table
    # write per sub-epoch on a few thousand ratings.
    dsgd_m = replace(dsgd_m, dsgd_cfg=dsgd.with_overrides(dsgd_m.dsgd_cfg, factor_layout="cached"))
    r1_m = replace(r1_m, dsgd_cfg=dsgd.with_overrides(r1_m.dsgd_cfg, factor_layout="cached"))
    cfg = GridConfig(scenarios=(None, ATTACK), models=(dsgd_m, r1_m, sgld_m), holdout_k=HOLDOUT_K, seed=SEED)
    metrics = run_grid(spark, ratings(spark, sf_dir), cfg)
    return shape(last_rmse(metrics), GRID_SPEC)
