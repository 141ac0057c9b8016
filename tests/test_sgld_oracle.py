import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from stratafac.operators import langevin
from stratafac.operators import factors as fac
from stratafac.plans import sgld
from tests.conftest import SF_SMALL

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def test_sgld_step_without_noise_is_preconditioned_gradient(spark, tiny_ratings):
    d = 2
    f = fac.init_factors(tiny_ratings, d, "arithmetic")
    fh = f.withColumn("h", f.id * 0 + 0.5)
    batch = tiny_ratings.filter("user < 2")
    out = langevin.sgld_update(fh, batch, d, 12, batch.count(), 0.01, [2.0] * d, [2.0] * d, 0, noise="none")
    got = {(r.kind, r.id): np.array(r.v) for r in out.collect()}
    v0 = {(r.kind, r.id): np.array(r.v) for r in f.collect()}
    rows = [(r.user, r.item, r.rating) for r in batch.collect()]
    m = len(rows)
    gu = {}
    gv = {}
    for u, i, x in rows:
        e = x - v0[("U", u)] @ v0[("V", i)]
        gu[u] = gu.get(u, 0) + e * v0[("V", i)]
        gv[i] = gv.get(i, 0) + e * v0[("U", u)]
    for (kind, i), v in v0.items():
        g = (gu if kind == "U" else gv).get(i)
        want = v if g is None else v + 0.5 * 0.01 * (12 * g / m - v * 2.0 / 0.5)
        np.testing.assert_allclose(got[(kind, i)], want, atol=1e-12)


def test_shared_noise_moments():
    draws = np.array([langevin.shared_noise(42, t, 1e-4, 10) for t in range(400)])
    assert abs(draws.mean()) < 0.002 and abs(draws.std() - 0.01) < 0.001


def test_sgld_trainer_snapshots(spark, tmp_path):
    from stratafac.plans.catalog import zscored_split

    train, test = zscored_split(spark, SF_SMALL)
    cfg = sgld.SGLDConfig(rounds=3, snapshot_every=1, snapshot_path=str(tmp_path / "snap"), resample_after=0, resample_every=2)
    res = sgld.train_sgld(spark, train, test, cfg)
    assert [m["epoch"] for m in res.metrics] == [0, 1, 2]
    by_step = {r.step: (r.rmse, r.n) for r in sgld.snapshot_rmse(spark, test, str(tmp_path / "snap"), cfg).collect()}
    assert sorted(by_step) == [0, 1, 2]
    # every test cell is scored, as in the trainer's own metric
    n = test.count()
    for m in res.metrics:
        np.testing.assert_allclose(by_step[m["epoch"]][0], m["rmse"], rtol=1e-9)
        assert by_step[m["epoch"]][1] == n


def _tables(spark):
    return {t.name for t in spark.catalog.listTables() if t.name.startswith("stratafac_")}


def test_tables_of_past_rounds_are_dropped(spark, tiny_ratings):
    import os

    from stratafac.plans import dsgd
    from stratafac.session import scratch_path

    folder = os.path.dirname(scratch_path(spark, "x")).removeprefix("file:")

    def state():
        return _tables(spark), {d for d in os.listdir(folder) if d.startswith("stratafac_")} if os.path.isdir(folder) else set()

    before = state()
    res = sgld.train_sgld(spark, tiny_ratings, tiny_ratings, sgld.SGLDConfig(rank=3, rounds=4, fraction=0.5))
    assert res.factors.count() == 9
    after = state()
    assert len(after[0] - before[0]) == 1 and len(after[1] - before[1]) == 1  # the result's own table
    res = dsgd.train_dsgd(spark, tiny_ratings, tiny_ratings, dsgd.DSGDConfig(rank=3, blocks=2, epochs=2, eta0=0.01))
    assert res.factors.count() == 9
    now = state()
    assert len(now[0] - after[0]) == 1 and len(now[1] - after[1]) == 1
    with pytest.raises(FloatingPointError):
        dsgd.train_dsgd(spark, tiny_ratings, tiny_ratings, dsgd.DSGDConfig(rank=3, blocks=2, epochs=40, eta0=90.0, schedule="constant"))
    assert state() == now


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


def _norm(pdf):
    cols = sorted(pdf.columns)
    return cols, sorted(tuple(repr(v) for v in r) for r in pdf[cols].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(entry.catalog.ORACLE))
def test_query_matches_oracle(spark, duck, name):
    got = entry.queries()[name](spark, SF_SMALL).toPandas()
    want = duck.execute(entry.oracle_sql()[name]).fetchdf()
    assert _norm(got) == _norm(want)


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_hot_ids_meet_their_rows_where_they_are(spark):
    """A user and an item with a third of the ratings each: same sums, and the user's rows in many tasks."""
    rng = np.random.default_rng(8)
    cells = {(7, int(i)) for i in range(400)} | {(int(u), 3) for u in range(400)} | {(int(u), int(i)) for u, i in rng.integers(0, 400, (400, 2))}
    batch = spark.createDataFrame([(u, i, float((u * 7 + i) % 5)) for u, i in sorted(cells)], "user bigint, item bigint, rating double").repartition(8)
    assert sgld.hot_ids(batch, "user", len(cells), 8) == [7] and sgld.hot_ids(batch, "item", len(cells), 8) == [3]
    users, items = (spark.range(400).select("id", F.array(*[F.sin(F.col("id") * (k + s)) for k in range(1, 4)]).alias("v")) for s in (0, 5))
    want = {(r.kind, r.id): r.gs for r in langevin.side_gradient_sums(batch, users, items, 3).collect()}
    for hot in (([7], [3]), ([7], []), ([], [3])):
        got = {(r.kind, r.id): r.gs for r in langevin.side_gradient_sums(batch, users, items, 3, *hot).collect()}
        assert got.keys() == want.keys()
        assert all(np.allclose(got[k], want[k], atol=1e-9, rtol=0) for k in want)
    placed = langevin.attached_sides(batch, users, items, [7], [3]).withColumn("task", F.spark_partition_id())
    spread = [r["count"] for r in placed.filter("user = 7").groupBy("task").count().collect()]
    assert len(spread) > 4 and max(spread) < 150


def test_sgld_per_row_noise_exact_batches(spark):
    from stratafac.plans.catalog import zscored_split

    train, test = zscored_split(spark, SF_SMALL)
    cfg = sgld.SGLDConfig(rounds=2, noise="per_row", batch_mode="exact")
    res = sgld.train_sgld(spark, train, test, cfg)
    assert len(res.metrics) == 2 and all(np.isfinite(m["rmse"]) for m in res.metrics)
    ids = [(r.kind, r.id) for r in res.factors.collect()]
    assert len(ids) == len(set(ids))


def test_sgld_random_start(spark, tiny_ratings):
    res = sgld.train_sgld(spark, tiny_ratings, tiny_ratings, sgld.SGLDConfig(rank=3, rounds=1, fraction=0.5, init="uniform"))
    vs = [list(r.v) for r in res.factors.collect()]
    assert len({tuple(v) for v in vs}) > 1  # not all rows identical
    assert all(np.isfinite(m["rmse"]) for m in res.metrics)


def test_grid_trains_in_full(monkeypatch):
    from stratafac.plans import catalog, experiments

    seen = []

    def run_grid(spark, ratings, cfg):
        seen.append(cfg)
        raise InterruptedError

    monkeypatch.setattr(catalog, "ratings", lambda spark, sf_dir: None)
    monkeypatch.setattr(experiments, "run_grid", run_grid)
    with pytest.raises(InterruptedError):
        catalog.QUERIES["robustness_grid"](None, "")
    models = {m.name: m for m in seen[0].models}
    assert models["dsgd"].dsgd_cfg.epochs == 50
    assert models["sgld"].sgld_cfg.rounds == 400


def _config_of(monkeypatch, name, module, trainer):
    """The settings that query ``name`` gives its trainer."""
    from stratafac.plans import catalog

    seen = []

    def train(spark, train, test, cfg, *labels):
        seen.append(cfg)
        raise InterruptedError

    monkeypatch.setattr(catalog, "zscored_split", lambda spark, sf_dir: (None, None))
    monkeypatch.setattr(module, trainer, train)
    with pytest.raises(InterruptedError):
        catalog.QUERIES[name](None, "")
    return seen[0]


def test_dsgd_query_runs_all_epochs(monkeypatch):
    from stratafac.plans import dsgd

    cfg = _config_of(monkeypatch, "dsgd_train", dsgd, "train_dsgd")
    assert cfg.epochs == 50 and cfg.blocks == 4 and cfg.eval_every == "epoch"
    assert cfg.draws_per_epoch is None  # a draw per rating


def test_sgld_query_runs_all_rounds(monkeypatch):
    cfg = _config_of(monkeypatch, "sgld_train", sgld, "train_sgld")
    assert cfg.rounds == 400 and cfg.fraction == 0.05 and cfg.eval_every == 1


def _planted(spark):
    rows = [(u, i, float((u * i) % 5) / 2 - 1) for u in range(30) for i in range(20) if (u + i) % 3]
    return spark.createDataFrame(rows, "user bigint, item bigint, rating double")


def test_batches_drawn_ahead_are_bernoulli(spark):
    from stratafac.operators import sampling

    r = _planted(spark)
    n, rounds, f = r.count(), 200, 0.1
    table = sampling.batch_table(r, f, 3, 50, rounds).toPandas()
    assert table["t"].between(50, 50 + rounds - 1).all() and not table.duplicated(["t", "user", "item"]).any()
    sizes = table.groupby("t").size()
    assert len(sizes) == rounds
    assert abs(sizes.mean() - n * f) < 1.5 and abs(sizes.var() / (n * f * (1 - f)) - 1) < 0.35
    # neighbouring rounds share what chance shares
    keys = {t: set(zip(g["user"], g["item"])) for t, g in table.groupby("t")}
    shared = [len(keys[t] & keys[t + 1]) for t in range(50, 50 + rounds - 1)]
    assert abs(sum(shared) / len(shared) - n * f * f) < 1
    assert sampling.batch_table(r, 1.0, 3, 0, 4).count() == 4 * n and sampling.batch_table(r, 0.0, 3, 0, 4).count() == 0


def _odd_rows(spark):
    """Ratings without a number, an item or a user; and test cells of ids that aren't trained."""
    rows = [(u, i, float((u * i) % 5) / 2 - 1) for u in range(12) for i in range(10) if (u + i) % 3]
    rows += [(0, 3, None), (30, 4, None), (31, None, 1.0), (None, 2, 0.5)]
    test = [(0, 1, 1.0), (30, 4, 0.5), (30, 2, 2.0), (99, 2, -1.0), (3, 98, 1.0), (4, None, 1.5), (5, 1, None)]
    return tuple(spark.createDataFrame(x, "user bigint, item bigint, rating double") for x in (rows, test))


@pytest.mark.parametrize("init, noise, resample", [("constant", "shared", None), ("uniform", "none", 1)])
def test_rounds_in_one_task_equal_rounds_as_plans(spark, tmp_path, monkeypatch, init, noise, resample):
    train, test = _odd_rows(spark)
    runs = []
    for k, limit in enumerate((1 << 24, 0)):
        monkeypatch.setattr(sgld, "LOCAL_VALUES", limit)
        cfg = sgld.SGLDConfig(
            rank=3, rounds=7, fraction=0.4, rounds_ahead=4, step0=1e-2, init=init, noise=noise, eval_every=2, snapshot_every=3, snapshot_path=str(tmp_path / f"s{k}"),
            resample_after=resample, resample_every=2, on_divergence="stop",
        )
        res = sgld.train_sgld(spark, train, test, cfg)
        snaps = spark.read.parquet(cfg.snapshot_path).collect()
        runs.append(({(r.kind, r.id): list(r.v) for r in res.factors.collect()}, res.metrics, {(r.step, r.kind, r.id): list(r.v) for r in snaps}))
    (one, curve, kept), (plans, want, stored) = runs
    assert one.keys() == plans.keys() and ("V", None) in one and kept.keys() == stored.keys()
    number = lambda v: np.array([np.inf if x is None else x for x in v])
    for got, wanted in ((one, plans), (kept, stored)):
        for key in wanted:
            np.testing.assert_allclose(number(got[key]), number(wanted[key]), atol=1e-9)
    assert any(None in v for v in plans.values())  # user 30 has no number at all
    assert [m["epoch"] for m in curve] == [m["epoch"] for m in want] == [1, 3, 5]
    np.testing.assert_allclose([m["rmse"] for m in curve], [m["rmse"] for m in want], atol=1e-9)
    elapsed = [m["elapsed_s"] for m in curve]
    assert elapsed == sorted(elapsed) and elapsed[0] > 0


def test_rounds_drawn_ahead_are_few_jobs(spark, monkeypatch):
    """A round that is a job of its own writes a table: 400 rounds were 400 of them."""
    stored, store = [], sgld._store
    monkeypatch.setattr(sgld, "_store", lambda *args: stored.append(1) or store(*args))
    r = _planted(spark)
    assert len(sgld.train_sgld(spark, r, r, sgld.SGLDConfig(rank=3, rounds=100)).metrics) == 100
    assert len(stored) == 3  # the start, and two times 50 rounds


def test_drawn_rows_are_packed_by_round(spark, monkeypatch):
    """The task reads a row per round and drawing task, not one per rating of a batch."""
    from stratafac.operators import sampling
    from stratafac.plans import round_worker

    train, _ = _odd_rows(spark)
    monkeypatch.setattr(round_worker, "PACK_ROWS", 7)
    cfg = sgld.SGLDConfig(rounds=9, fraction=0.3, rounds_ahead=6)
    path, sizes = sgld.draw_packed(spark, train.repartition(2), cfg, 6)
    want = sampling.batch_table(train, 0.3, cfg.seed, 6, 3).collect()
    rows = spark.read.parquet(path).collect()
    assert sizes == {t: sum(r.t == t for r in want) for t in (6, 7, 8)} and len(rows) < len(want) / 3
    got = []
    for r in rows:
        columns = (np.frombuffer(r[c], kind).tolist() for c, kind in zip(round_worker.PACK_COLS, (np.int64, np.int64, np.float64, np.bool_)))
        got += [(r.t, *cell) for cell in zip(*columns)]
    none = round_worker.NO_ID
    as_packed = [(r.t, none if r.user is None else r.user, none if r.item is None else r.item, r.rating or 0.0, r.rating is None) for r in want]
    assert sorted(got) == sorted(as_packed) and any(c[4] for c in got)


def test_a_draw_takes_its_hash_once(spark):
    from stratafac.operators import sampling

    r = _planted(spark)
    plan = sampling.batch_table(r, 0.05, 3, 0, 50)._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.count("md5(") <= 2  # of the usual steps, and of the rest


def test_ratings_are_spread_over_the_cores(spark):
    r = _planted(spark).coalesce(1)
    cores = spark.sparkContext.defaultParallelism
    assert sgld.spread(spark, r).rdd.getNumPartitions() == cores
    assert sgld.spread(spark, r.repartition(cores + 3)).rdd.getNumPartitions() == cores + 3


def test_chunks_hold_a_bounded_number_of_rows(monkeypatch):
    sizes = {t: 10 for t in range(50)}
    cfg = sgld.SGLDConfig(rounds=120)
    assert sgld.chunk_end(cfg, 0, sizes) == 50 and sgld.chunk_end(cfg, 100, {}) == 120
    monkeypatch.setattr(sgld, "CHUNK_ROWS", 45)
    assert sgld.chunk_end(cfg, 0, sizes) == 4
    monkeypatch.setattr(sgld, "CHUNK_ROWS", 5)
    assert sgld.chunk_end(cfg, 0, sizes) == 1
    assert not sgld.one_task(cfg, 10**6, sgld.LOCAL_VALUES) and sgld.one_task(cfg, 10**6, 10**5)
    assert not sgld.one_task(cfg, 10**9, 10**5) and not sgld.one_task(sgld.with_overrides(cfg, resume_path="x"), 10**6, 10**5)


def test_snapshots_give_the_curve_of_the_run(spark, tmp_path):
    from stratafac.plans import sgld

    r = _planted(spark)
    cfg = sgld.SGLDConfig(rank=3, rounds=5, fraction=0.3, rounds_ahead=2, snapshot_every=1, snapshot_path=str(tmp_path / "s"))
    res = sgld.train_sgld(spark, r, r, cfg)
    curve = {x["step"]: x["rmse"] for x in sgld.snapshot_rmse(spark, r, cfg.snapshot_path, cfg).collect()}
    assert sorted(curve) == list(range(5))
    for m in res.metrics:
        assert abs(curve[m["epoch"]] - m["rmse"]) < 1e-9
    elapsed = [m["elapsed_s"] for m in res.metrics]
    assert elapsed == sorted(elapsed) and elapsed[0] > 0
