import math
import zlib
from collections import Counter
from dataclasses import replace

import numpy as np
import pytest

from helpers import words
from stratafac.llm import pitman_yor as py

SMALL = replace(py.Model(), group_bytes=2_000, bucket_tokens=300)


def base(docs):
    def tokens(t):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        return [*words(low), None]

    held = [i is not None and zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in docs]
    count = Counter(w for h, (_, t) in zip(held, docs) if not h for w in tokens(t))
    total = sum(count.values())
    out = []
    for h, (i, t) in zip(held, docs):
        mine = tokens(t)
        s = sum(math.log10((count[w] + 0.5) / (total + 0.5 * (len(count) + 1))) for w in mine)
        out.append((i, h, len(mine), sum(count[w] > 0 for w in mine), total, round(s, 6)))
    return sorted(out, key=repr)


def texts(n, seed=5):
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{k}" for k in range(60)]
    docs = []
    for i in range(n):
        at, out = int(rng.integers(60)), []
        for _ in range(int(rng.integers(0, 40))):
            at = (at + int(rng.integers(1, 4))) % 60 if rng.random() < 0.9 else 0
            out.append(vocabulary[at].upper() if rng.random() < 0.2 else vocabulary[at])
        docs.append((i, " ".join(out)))
    return docs


@pytest.mark.parametrize("model", [py.Model(), SMALL])
def test_base_columns_and_order_of_scores(spark, make_docs, model):
    docs = texts(150) + [(None, "w1 w2"), (None, None), (900, ""), (901, "É 漢字 w1"), (3, "w5 w6"), (3, "w5 w6"), (902, "w1 " * 3_000), (903, "new words only")]
    got = py.score(make_docs(docs), model).collect()
    assert sorted([(r["id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got], key=repr) == base(docs)
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)
    held = [r for r in got if r["held_out"] and r["id"] < 150]
    # the texts follow a chain of words, which a bigram model must find in held-out ones
    assert sum(r["score"] for r in held) > 0.6 * sum(r["base_score"] for r in held)


def test_scores_depend_little_on_the_layout(spark, make_docs):
    docs = texts(200)
    a, b = ({r["id"]: r["score"] for r in py.score(make_docs(docs), m).collect()} for m in (py.Model(), SMALL))
    assert max(abs(a[i] - b[i]) / (abs(a[i]) + 1) for i in a) < 0.05
    again = {r["id"]: r["score"] for r in py.score(make_docs(docs).repartition(3), SMALL).collect()}
    assert a.keys() == again.keys()


def test_nothing_to_learn_from(spark, make_docs):
    assert py.score(make_docs([])).collect() == []
    only = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1)
    (row,) = py.score(make_docs([(only, "a b")])).collect()
    assert (row["n_tokens"], row["n_known"], row["train_tokens"], row["base_score"], row["score"]) == (3, 0, 0, 0.0, 0.0)


def partitions(n):
    """Table sizes of every seating of n customers, with their numbers."""
    if n == 0:
        yield ()
        return

    def place(k, sizes):
        if k == n:
            yield tuple(sizes)
            return
        for i in range(len(sizes)):
            sizes[i] += 1
            yield from place(k + 1, sizes)
            sizes[i] -= 1
        sizes.append(1)
        yield from place(k + 1, sizes)
        sizes.pop()

    yield from place(0, [])


def exact_tables(n, p, d, theta, elsewhere):
    weight = Counter()
    for sizes in partitions(n):
        w = 1.0
        for k, size in enumerate(sizes):
            w *= (theta + d * (elsewhere + k)) * p
            for j in range(1, size):
                w *= j - d
        weight[len(sizes)] += w
    total = sum(weight.values())
    return {k: w / total for k, w in weight.items()}


@pytest.mark.parametrize("p, elsewhere", [(0.3, 0), (0.05, 20), (0.9, 3)])
def test_gibbs_moves_have_the_exact_distribution(p, elsewhere):
    n, trials, d, theta = 6, 20_000, 0.6, 1.0
    want = exact_tables(n, p, d, theta, elsewhere)
    # restaurants of their own, each with one pair
    context = np.arange(trials)
    got = py.seat(np.random.default_rng(1), np.full(trials, p), np.full(trials, n), context, np.full(trials, elsewhere), d, theta, moves=30)
    share = Counter(got.tolist())
    for t in range(1, n + 1):
        assert abs(share[t] / trials - want[t]) < 0.015


def test_big_counts_take_few_steps():
    got = py.seat(np.random.default_rng(2), np.array([1e-3, 0.2]), np.array([10**9, 10**6]), np.array([0, 0]), np.array([50]), 0.5, 1.0, 2)
    assert 1 <= got[0] < 200_000 and 1 <= got[1] < 20_000


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(4)
    model, n_words = py.Model(), 40
    counts = py.Counts(0, n_words, 7, 2, 3)
    ids = np.concatenate([[py.UNKNOWN], np.arange(n_words) + py.END_ID])
    u = np.repeat([5, 9, 11], len(ids))
    w = np.tile(ids, 3)
    c = rng.integers(0, 6, len(u)) * (rng.random(len(u)) < 0.4) * (w != py.UNKNOWN)
    half = np.arange(len(u)) % 2 == 0
    parts = [py._Bucket(k, u[m], w[m], c[m], np.array([5, 9, 11]), counts) for k, m in enumerate((half, ~half))]
    tables = [py.seat(rng, np.full(len(b.c), 0.02), b.c, b.context, np.zeros(3, int), 0.6, 1.0, 3) for b in parts]
    totals = {"totals": [{"u": x, "c": int(c[u == x].sum()), "t": int(sum(t[b.contexts[b.context] == x].sum() for b, t in zip(parts, tables)))} for x in (5, 9, 11)]}
    customers = {}
    for b, t in zip(parts, tables):
        for word, k in zip(b.w, t):
            customers[word] = customers.get(word, 0) + int(k)
    known = np.array([customers[i] for i in ids[1:]])
    open_ = py.seat(rng, np.full(n_words, 1 / (n_words + 1)), known, np.zeros(n_words, int), np.zeros(1, int), 0.5, 1.0, 3)
    root = py.Root(int(known.sum()), int(open_.sum()))
    weight = dict(zip(ids[1:], known - model.parent_discount * open_))
    parent = {i: root.probability(np.array([weight.get(i, 0.0)]), counts, model)[0] for i in ids}
    assert abs(sum(parent.values()) - 1) < 1e-12
    sums = np.zeros(3)
    for b, t in zip(parts, tables):
        sums += np.bincount(b.context, b.probability(t, np.array([parent[i] for i in b.w]), totals, model), 3)
    assert np.allclose(sums, 1)


def test_first_seating_deals_like_one_customer_at_a_time():
    rng = np.random.default_rng(0)
    n, trials, p, d, theta = 5, 40_000, 0.3, 0.6, 1.0
    owner, size = py._first_seating(rng, np.full(trials, p), np.full(trials, n), np.arange(trials), np.ones(trials, np.int64), d, theta)
    cut = np.searchsorted(owner, np.arange(trials + 1))
    got = Counter(tuple(sorted(size[a:z].tolist())) for a, z in zip(cut, cut[1:]))
    want = Counter()
    for _ in range(trials):
        tables = [1]
        for _ in range(n - 1):
            weights = np.array([x - d for x in tables] + [(theta + d * len(tables)) * p])
            k = int(np.searchsorted(np.cumsum(weights), rng.random() * weights.sum()))
            if k == len(tables):
                tables.append(1)
            else:
                tables[k] += 1
        want[tuple(sorted(tables))] += 1
    assert max(abs(got[k] - want[k]) for k in got.keys() | want.keys()) < 0.015 * trials
