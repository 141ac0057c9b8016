import math

import pytest

from pyspark.sql import functions as F

from stratafac.functions.hashing import hash_bits, py_hash_bits, py_hash_normal, py_hash_uniform
from stratafac.operators import attack as atk
from stratafac.operators import sampling
from stratafac.sources import ratings as src
from tests.conftest import SF_SMALL


def test_hash_matches_python_twin(spark):
    row = spark.range(1).select(hash_bits(42, "x", F.lit(7), 3).alias("h")).first()
    assert row.h == py_hash_bits(42, "x", 7, 3)
    assert 0.0 < py_hash_uniform(42, 1) < 1.0
    zs = [py_hash_normal(42, "n", i) for i in range(4000)]
    mean = sum(zs) / len(zs)
    var = sum((z - mean) ** 2 for z in zs) / len(zs)
    assert abs(mean) < 0.06 and abs(var - 1) < 0.08


def test_smallest_k_histogram_equals_topk(spark):
    df = spark.range(20000).select(F.col("id").alias("user")).withColumn("_h", hash_bits(3, "t", F.col("user")))
    want = {r.user for r in df.orderBy("_h", "user").limit(1234).collect()}
    got = {r.user for r in sampling.smallest_k(df, "_h", ["user"], 1234).collect()}
    assert got == want and len(got) == 1234


def test_attackers_cap_and_last_user(spark):
    att = atk.choose_attackers(spark, 10, 1.0, seed=1)  # int(10·1.0) = 10, pool 0..8
    assert sorted(r.user for r in att.collect()) == list(range(9))
    att = atk.choose_attackers(spark, 10, 1.0, seed=1, include_last=True)
    assert att.count() == 10
    assert atk.choose_attackers(spark, 10, 0.0).count() == 0


def test_fillers_distinct_and_partition_independent(spark):
    att = atk.choose_attackers(spark, 50, 0.2, seed=5)
    a = atk.choose_fillers(att, 30, 0.5, seed=5)
    b = atk.choose_fillers(att.repartition(7), 30, 0.5, seed=5)
    ra = sorted((r.user, r.item) for r in a.collect())
    rb = sorted((r.user, r.item) for r in b.collect())
    assert ra == rb
    assert len(ra) == 10 * 15 and len(set(ra)) == len(ra)
    assert all(item <= 28 for _, item in ra)  # last item (29) never a filler


def test_overlay_target_precedence_and_no_duplicates(spark, tiny_ratings):
    sc = atk.AttackScenario(kind="average", at_size=0.5, fil_size=1.0, target=1, seed=3)
    fake = atk.fake_cells(tiny_ratings, sc)
    out = atk.overlay(tiny_ratings, atk.plan_attack(tiny_ratings, sc))
    keys = [(r.user, r.item) for r in out.collect()]
    assert len(keys) == len(set(keys))
    tgt = {(r.user, r.item): r.rating for r in fake.filter("item = 1").collect()}
    assert tgt and all(v == 5.0 for v in tgt.values())  # global max wins over filler values
    attackers = {r.user for r in atk.choose_attackers(spark, 4, 0.5, seed=3).collect()}
    # fillers: all items 0..3 (last item excluded), target replaced
    assert {(u, i) for (u, i) in keys if u in attackers} >= {(u, i) for u in attackers for i in range(4)}


def test_average_attack_fallback_for_user_without_ratings(spark, edge_ratings):
    # user 4 is a gap: if chosen, its fake values use the global mean/std
    sc = atk.AttackScenario(kind="average", at_size=1.0, fil_size=0.5, target=0, seed=1)
    fake = atk.fake_cells(src.merge_duplicates(edge_ratings, "avg"), sc)
    vals = [r.rating for r in fake.filter("user = 4").collect()]
    assert vals and all(math.isfinite(v) for v in vals)


def test_random_attack_clip(spark, tiny_ratings):
    sc = atk.AttackScenario(kind="random", at_size=0.75, fil_size=1.0, target=2, seed=9, clip=True)
    fake = atk.fake_cells(tiny_ratings, sc)
    assert all(1.0 <= r.rating <= 5.0 for r in fake.collect())


def test_minibatch_exact_size(spark):
    r = src.ratings_from_tables(spark, SF_SMALL)
    n = r.count()
    b = sampling.minibatch(r, 0.05, 42, 3, "exact", n=n)
    assert b.count() == int(n * 0.05)
    t = sampling.minibatch(r, 0.05, 42, 3, "threshold")
    assert abs(t.count() - n * 0.05) < 5 * math.sqrt(n * 0.05)


def test_average_attack_item_scope(spark, tiny_ratings):
    sc = atk.AttackScenario(kind="average", at_size=0.5, fil_size=1.0, target=0, seed=4, stat_scope="item")
    fake = atk.fake_cells(tiny_ratings, sc)
    keys = [(r.user, r.item) for r in fake.collect()]
    assert len(keys) == len(set(keys)) and len(keys) == 2 * 4  # 2 attackers × (3 fillers + target)
    assert all(math.isfinite(r.rating) for r in fake.collect())


def _chosen(spark, pool, k_frac, n_att, seed=42):
    import numpy as np

    users = spark.range(n_att).select(F.col("id").alias("user"))
    rows = atk.choose_fillers(users, pool, k_frac, seed, include_last=True).toPandas()
    out = np.zeros((n_att, pool), np.int64)
    np.add.at(out, (rows["user"].to_numpy(), rows["item"].to_numpy()), 1)
    return out


@pytest.mark.parametrize("pool, frac, n_att", [(1999, 0.5, 300), (50, 0.5, 300), (7, 0.5, 40), (49, 1.0, 20)])
def test_fillers_are_spread_like_a_random_sample(spark, pool, frac, n_att):
    import numpy as np

    k = int(pool * frac)
    got = _chosen(spark, pool, frac, n_att)
    assert got.max() == 1 and (got.sum(axis=1) == k).all()
    if pool < 50:
        return
    rng = np.random.default_rng(0)
    want = np.zeros_like(got)
    for row in want:
        row[rng.permutation(pool)[:k]] = 1

    def overlaps(x):
        return (x @ x.T)[np.triu_indices(len(x), 1)]

    a, b = overlaps(got), overlaps(want)
    assert abs(a.mean() - b.mean()) < 0.5 + 0.01 * b.mean() and abs(a.std() / b.std() - 1) < 0.05
    assert b.min() - 3 * b.std() < a.min() and a.max() < b.max() + 3 * b.std()
    # neighbouring items are chosen together as often as by chance
    pairs, chance = ((x[:, 1:] * x[:, :-1]).mean(axis=0) for x in (got, want))
    assert abs(pairs.mean() - chance.mean()) < 0.01 and pairs.std() < 1.3 * chance.std() + 0.01


def test_permutation_of_a_big_pool_and_its_inverse(spark):
    grid = atk.grid_of(2**40 + 12345)
    assert 0 <= grid.spare < grid.rows
    users = atk.with_round_keys(spark.range(50).select(F.col("id").alias("user")), 7, 2)
    cells = users.withColumn("x", F.explode(F.expr("transform(sequence(0, 200), i -> i * 5000000000L)"))).withColumn("y", F.col("x"))
    there = atk.permuted(cells, "y", grid)
    back = atk.permuted(there.withColumn("z", F.col("y")), "z", grid, inverse=True).toPandas()
    assert (back["x"] == back["z"]).all()
    assert back["y"].between(0, grid.rows * grid.cols - 1).all() and back.groupby("user")["y"].nunique().eq(201).all()
    with pytest.raises(ValueError):
        atk.grid_of(2**49)


def test_overlay_replaces_exactly_the_fake_cells(spark):
    rows = [(u, i, float(1 + (u * 7 + i) % 5)) for u in range(40) for i in range(30) if (u + 3 * i) % 4]
    r = spark.createDataFrame(rows, "user bigint, item bigint, rating double")
    for sc in (atk.AttackScenario(at_size=0.4, fil_size=0.3, target=2), atk.AttackScenario(kind="random", at_size=0.5, fil_size=0.0, target=29)):
        plan = atk.plan_attack(r, sc)
        fake = {(x["user"], x["item"]): x["rating"] for x in plan.fake.collect()}
        out = [tuple(x) for x in atk.overlay(r, plan).collect()]
        want = {(u, i): v for u, i, v in rows} | fake
        assert len(out) == len(want) and {(u, i): v for u, i, v in out} == want
        sizes = atk.attack_sizes(r, plan).first()
        assert (sizes["n_attackers"], sizes["n_fake"], sizes["n_rows"]) == (len({u for u, _ in fake}), len(fake), len(want))
