"""Registered queries against their SQL twins, and the pipeline stage by stage."""

import glob
import os
import random

import duckdb
import pytest
from helpers import near_components, quality_base, removed_places, words

import corpus_pipeline
from stratafac.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    return c


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_its_twin(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)
    want = duck.execute(f"select {', '.join(cols)} from ({queries.ORACLE[name]})").fetchall()
    assert got == sorted(want, key=str)


def test_every_query_is_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names and all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 11))
    assert set(queries.ORACLE) <= set(entry.oracle_sql())


def _documents(make_docs):
    rng = random.Random(11)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(vocab) for _ in range(n)) + "."
    passage = prose(60)
    rows = [(i, prose(rng.randint(60, 150))) for i in range(120)]
    rows += [(200 + i, rows[i][1]) for i in range(5)]  # copies
    rows += [(300 + i, rows[10 + i][1].replace(rows[10 + i][1].split()[3], "edited", 1)) for i in range(5)]  # near copies
    rows += [(400 + i, f"{prose(80)}\n{passage}\n{prose(40)}") for i in range(4)]
    rows += [(500 + i, " ".join(w + "###" for w in prose(80).split())) for i in range(12)]  # junk
    rows += [(600, None), (601, ""), (602, "too short"), (None, prose(70))]
    return make_docs(rows).drop("g", "id", "th"), dict(rows)


def test_stages(spark, make_docs):
    docs, texts = _documents(make_docs)
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_rules", "near_dedup", "substring_dedup", "best_fit_packing"]

    kept = stages["quality_rules"](spark, docs, SF)
    assert kept.columns == docs.columns
    after = {r["doc_id"]: r["text"] for r in kept.collect()}
    assert all(not 500 <= (i or 0) < 600 for i in after) and not {600, 601, 602} & set(after)
    assert {i for i in texts if i is None or i < 500} == set(after)
    for t in after.values():
        n, *_, repeated = quality_base(t)
        assert n >= 50 and 2 * repeated <= n

    unique = stages["near_dedup"](spark, kept, SF)
    left = {r["doc_id"]: r["text"] for r in unique.collect()}
    want = near_components([(i, t) for i, t in after.items() if i is not None])
    assert {i for i, c in want.items() if i == c} | {None} == set(left)

    cut = stages["substring_dedup"](spark, unique, SF)
    assert cut.columns == docs.columns
    result = {r["doc_id"]: (r["text"], r["n_chars"], r["lang"], r["source"]) for r in cut.collect()}
    rows = [(i, words(t)) for i, t in left.items() if i is not None]
    for (i, w), gone in zip(rows, removed_places(rows, 13)):
        text, n, lang, source = result[i]
        assert words(text) == [x for p, x in enumerate(w) if p not in gone]
        assert text == left[i] or gone
        assert (n, lang, source) == (len(text), "en", "src")

    pieces = stages["best_fit_packing"](spark, cut, SF).collect()
    assert {r["doc_id"] for r in pieces} == set(left)
    per = {}
    for r in pieces:
        per.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert all(sum(n for _, n in v) <= 4096 for v in per.values())


def test_stages_on_an_empty_table(spark, make_docs):
    docs = make_docs([(1, "x")]).where("false").drop("g", "id", "th")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.collect() == []
