"""Stages of the corpus pipeline on repeated rows and clashing extra columns."""

import random
from collections import Counter

from helpers import crc

import corpus_pipeline


def test_quality_stage_keeps_rows_and_columns(spark):
    good = " ".join(f"word{i}" for i in range(80)) + "."
    rows = [(1, good, "en", "s", len(good), 5, True, "x", 0.5), (1, good, "en", "s", len(good), 5, True, "x", 0.5), (2, "short", "en", "s", 5, 1, False, "y", 0.1), (None, good, None, None, 1, 2, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_words int, good boolean, votes string, p_good double")
    kept = corpus_pipeline.quality_rules(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect()), key=str) == sorted((r for r in rows if r[1] == good), key=str)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


CLASHING = "doc_id long, text string, lang string, source string, n_chars long, r_id long, r_hash long, row string, id string, kept_text string, rest int, `a.b` int, spans string"


def _clashing(spark, rows):
    full = [(i, t, "en", "s", len(t or ""), 1, 2, "r", "x", "k", n, -n, "z") for n, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, CLASHING), full


def _stage_rows():
    rng = random.Random(9)
    prose = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    one, two, passage, ends = prose(80), prose(90), prose(30), f"{prose(40)} | {prose(40)}"
    near = one.replace(one.split()[4], "edited", 1)
    return [(5, one), (5, one), (3, near), (3, near), (9, two), (9, passage + " tail"), (12, ends.replace("|", passage)), (None, one), (20, None), (21, ""), (21, "")]


def test_near_dedup_stage_on_repeated_rows_and_clashing_columns(spark):
    docs, full = _clashing(spark, _stage_rows())
    kept = corpus_pipeline.near_dedup(spark, docs, "")
    assert kept.columns == docs.columns
    assert Counter(map(tuple, kept.collect())) == Counter(r for r in full if r[0] != 5)


def test_substring_stage_on_repeated_rows_and_clashing_columns(spark):
    docs, full = _clashing(spark, _stage_rows())
    cut = corpus_pipeline.substring(spark, docs, "")
    assert cut.columns == docs.columns
    out = {r["rest"]: r for r in cut.collect()}
    assert len(out) == len(full)
    for n, r in enumerate(full):
        want = r[1] or ""
        if r[0] == 12:
            want = " ".join(r[1].split()[:40] + r[1].split()[70:])
        elif r[0] == 5:  # all but the words before the edited one's last window
            want = out[n]["text"]
            assert len(want) < len(r[1])
        assert tuple(out[n]) == (r[0], want, *r[2:4], len(want), *r[5:])


def test_packing_stage_returns_ids(spark):
    docs, full = _clashing(spark, _stage_rows())
    pieces = corpus_pipeline.best_fit_packing(spark, docs, "").collect()
    assert Counter(r["doc_id"] for r in pieces) == Counter(r[0] for r in full)
    assert all(len(r["ids"]) == r["length"] and crc(r["ids"]) == r["ids_crc32"] and r["ids"][-1] == 1 for r in pieces)
