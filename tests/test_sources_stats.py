import math

import numpy as np

from stratafac.operators import stats
from stratafac.sources import ratings as src
from stratafac.sources import sinks


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_read_ratings_text(spark, tmp_path):
    p = tmp_path / "u.data"
    p.write_text("1 1 5 881250949\n1\t2  3 0\n2 3 4 1\n\n")
    df = src.read_ratings(spark, str(p), base=1)
    assert rows(df, "user", "item", "rating") == [(0, 0, 5.0), (0, 1, 3.0), (1, 2, 4.0)]


def test_checked_text_keeps_its_rejected_lines(spark, tmp_path):
    p = tmp_path / "u.data"
    lines = ["1 1 5 881250949", "\t2\t3  -1.5 ", "", "  ", "1 2", "a 1 3", "1 1.5 3", "0 4 3", "3 -7 3", "4 4 NaN", "4 5 x", "4 6 -Infinity",
             "99999999999999999999 1 1", "-9223372036854775808 1 1", "1 1 5"]
    p.write_text("\n".join(lines) + "\n")
    good, rejected = src.read_ratings_checked(spark, str(p), str(tmp_path / "parsed"))
    assert rows(good, "user", "item", "rating") == [(0, 0, 5.0), (0, 0, 5.0), (1, 2, -1.5)]
    want = {"1 2": "fields", "a 1 3": "id", "1 1.5 3": "id", "0 4 3": "id below base", "3 -7 3": "id below base", "4 4 NaN": "rating",
            "4 5 x": "rating", "4 6 -Infinity": "rating", "99999999999999999999 1 1": "id", "-9223372036854775808 1 1": "id"}
    assert {r.line: r.reason for r in rejected.collect()} == want and rejected.count() == len(want)
    (tmp_path / "empty").write_text("")
    good, rejected = src.read_ratings_checked(spark, str(tmp_path / "empty"), str(tmp_path / "parsed-empty"))
    assert good.count() == rejected.count() == 0


def test_tiled_factors_come_back_by_tile(spark, tmp_path):
    ids = [("U", 0), ("U", 9), ("U", 10), ("U", 35), ("V", 12)]
    f = spark.createDataFrame([(k, i, 0, [i + 0.5, -1.0 * i, 1e-300]) for k, i in ids], "kind string, id bigint, blk int, v array<double>")
    sinks.write_tiled_factors(f, str(tmp_path / "t"), tile=10)
    back = {(r.kind, r.id): list(r.v) for r in sinks.read_tiled_factors(spark, str(tmp_path / "t"), tile=10).collect()}
    for k, i in ids:
        assert back[k, i] == [i + 0.5, -1.0 * i, 1e-300]
    assert back["U", 5] == [0.0] * 3 and len(back) == 10 + 1 + 6 + 3
    one = sinks.read_tiled_factors(spark, str(tmp_path / "t"), tiles=[1], tile=10)
    assert {(r.kind, r.id) for r in one.collect()} == {("U", 10), ("V", 10), ("V", 11), ("V", 12)}


def test_holdout_joins_on_the_user_alone(spark, tiny_ratings):
    plan = src.holdout_split(tiny_ratings, 1, 42)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    twice = tiny_ratings.unionByName(tiny_ratings)
    assert src.holdout_split(twice, 2, 42).count() == 24


def test_dense_matrix_text_drops_zeros(spark, tmp_path):
    p = tmp_path / "R.txt"
    p.write_text("0,1.5,0\n2.0,0,0\n0,0,-1\n")
    df = src.read_dense_matrix(spark, str(p), sep=",")
    assert rows(df, "user", "item", "rating") == [(0, 1, 1.5), (1, 0, 2.0), (2, 2, -1.0)]


def test_dense_matrix_in_several_splits(spark, tmp_path):
    rows_in = [[(7 * r + c) % 5 for c in range(6)] for r in range(200)]
    p = tmp_path / "big"
    p.mkdir()
    for k in range(2):
        part = rows_in[100 * k : 100 * k + 100]
        (p / f"part-{k}.txt").write_text("".join(",".join(map(str, r)) + "\n" + ("\n" if i % 9 == 0 else "") for i, r in enumerate(part)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100")
    try:
        df = src.read_dense_matrix(spark, str(p), sep=",")
        assert spark.read.text(str(p)).rdd.getNumPartitions() > 10
        got = rows(df, "user", "item", "rating")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == sorted((r, c, float(v)) for r, x in enumerate(rows_in) for c, v in enumerate(x) if v)


def test_snapshot_rerun_replaces_its_step(spark, tmp_path, tiny_ratings):
    from stratafac.operators import factors as fac

    f = fac.init_factors(tiny_ratings, 2, "constant").select("kind", "id", "v")
    for t in (0, 1, 1, 0):
        sinks.write_snapshot(f, str(tmp_path / "snap"), t)
    assert sinks.read_snapshots(spark, str(tmp_path / "snap")).count() == 2 * f.count()


def test_dense_to_triples_one_based(spark):
    df = spark.createDataFrame([(0, [0.0, 2.0]), (1, [3.0, -1.0])], "r bigint, v array<double>")
    out = src.dense_to_triples(df, "r", "v", base=1, zero_below=0.0)
    assert rows(out, "user", "item", "rating") == [(1, 2, 2.0), (2, 1, 3.0)]


def test_duplicates_sum_and_avg(edge_ratings):
    s = {(r.user, r.item): r.rating for r in src.merge_duplicates(edge_ratings, "sum").collect()}
    a = {(r.user, r.item): r.rating for r in src.merge_duplicates(edge_ratings, "avg").collect()}
    assert s[(0, 0)] == 4.0 and a[(0, 0)] == 2.0
    assert len(s) == 9


def test_extent_counts_gaps(edge_ratings):
    assert src.extent_values(edge_ratings) == (6, 4)


def test_user_zscore_edge_cases(edge_ratings):
    z = {(r.user, r.item): r.rating for r in stats.user_zscore(src.merge_duplicates(edge_ratings, "avg")).collect()}
    assert z[(1, 1)] == 0.0  # single rating: std 0
    assert z[(2, 0)] == z[(2, 1)] == z[(2, 2)] == 0.0  # constant user
    assert z[(3, 1)] == 0.0 and math.isclose(z[(3, 2)], 1.224744871391589)


def test_zero_is_missing_drops_mean_valued_cell(edge_ratings):
    z = stats.user_zscore(src.merge_duplicates(edge_ratings, "avg"))
    kept = src.observed(z, zero_is_missing=True)
    assert kept.count() == 2  # only user 3's ±1.22 survive
    assert src.observed(z).count() == z.count()


def test_holdout_k_per_user(tiny_ratings):
    split = src.holdout_split(tiny_ratings, k=1, seed=42)
    per_user = {}
    for r in split.collect():
        per_user.setdefault(r.user, []).append(r.split)
    assert all(v.count("test") == 1 for v in per_user.values())
    assert split.count() == tiny_ratings.count()


def test_global_means_and_stats(tiny_ratings):
    train, test = src.train_test(tiny_ratings, 1, 42)
    m = stats.global_means(train, test).first()
    tr = [r.rating for r in train.collect()]
    te = [r.rating for r in test.collect()]
    assert math.isclose(m.train_mean, np.mean(tr)) and math.isclose(m.test_mean, np.mean(te))
    assert math.isclose(m.mean_rate, (np.mean(tr) + np.mean(te)) / 2)
    g = stats.global_stats_values(tiny_ratings)
    vals = [r.rating for r in tiny_ratings.collect()]
    assert math.isclose(g["std"], np.std(vals)) and g["max"] == 5.0


def test_inclusion_probability(tiny_ratings):
    h = {r.id: r.h for r in stats.inclusion_prob(tiny_ratings, "user", 0.5).collect()}
    # 12 ratings, m = 6 draws, every user has 3 ratings
    assert math.isclose(h[0], 1 - (1 - 3 / 12) ** 6)


def test_sinks_round_trip(spark, tmp_path, tiny_ratings):
    from stratafac.operators import factors as fac

    f = fac.init_factors(tiny_ratings, 3, "uniform", seed=1)
    sinks.write_factors(f, str(tmp_path / "fp"))
    sinks.write_factors(f, str(tmp_path / "fc"), fmt="csv")
    a = {(r.kind, r.id): list(r.v) for r in f.collect()}
    b = {(r.kind, r.id): list(r.v) for r in sinks.read_factors(spark, str(tmp_path / "fp")).collect()}
    c = {(r.kind, r.id): list(r.v) for r in sinks.read_factors(spark, str(tmp_path / "fc"), fmt="csv").collect()}
    assert a == b
    assert all(np.allclose(a[k], c[k]) for k in a)
    for t in range(3):
        sinks.write_snapshot(f, str(tmp_path / "snap"), t)
    assert sinks.read_snapshots(spark, str(tmp_path / "snap"), [1]).count() == f.count()
    sinks.write_attacked(tiny_ratings, str(tmp_path / "atk"), "x")
    assert sinks.read_attacked(spark, str(tmp_path / "atk"), "x").count() == 12
    m = sinks.write_metrics(spark, [{"scenario": "s", "model": "m", "epoch": 0, "rmse": 1.0, "objective": None, "elapsed_s": 0.1}], str(tmp_path / "met"))
    assert m.count() == 1 and spark.read.parquet(str(tmp_path / "met")).count() == 1


def test_small_slice(tiny_ratings):
    assert src.small_slice(tiny_ratings, 2, 2).count() == 3
