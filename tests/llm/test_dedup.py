"""Substring dedup, maximal repeats and near-dedup against brute force."""

import random

import numpy as np
import pytest
from helpers import near_components, removed_places, sha, shingle_set, spans, words

from stratafac.llm import kernels as ke
from stratafac.llm import near_dup, repeats, substring_dedup


def corpus(seed=3):
    """Copies, shared passages, hot lines, nulls, blanks, one long text, ties."""
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(60)]
    prose = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    passage, line = prose(60), prose(16)
    rows = [(i, prose(rng.randint(5, 80))) for i in range(0, 40)]
    rows += [(i, f"{prose(10)}\n{line}\t{prose(12)}") for i in range(40, 70)]
    rows += [(i, f"{prose(7)} {passage} {prose(5)}") for i in range(70, 80)]
    rows += [(i, passage) for i in range(80, 86)]
    near = prose(120).split()
    for i in range(86, 100):
        w = list(near)
        w[rng.randrange(120)] = "edit"
        rows.append((i, " ".join(w)))
    rows += [(100, None), (101, ""), (102, " \n\t "), (103, "one"), (104, "one"), (105, prose(4000) + " " + passage), (106, "a" * 400), (107, "a" * 300)]
    rng.shuffle(rows)
    return rows


def test_substring_dedup_equals_brute_force(make_docs):
    rows = corpus()
    docs = make_docs(rows)
    gone = removed_places([(i, words(t)) for i, t in rows], 13)
    want = {i: (len(words(t)), g, " ".join(w for p, w in enumerate(words(t)) if p not in g)) for (i, t), g in zip(rows, gone)}
    # small groups and buckets, so that matches cross both
    out = substring_dedup.substring_dedup(docs, group_bytes=2000, bucket_bytes=3000, carry=("lang", "g")).collect()
    assert len(out) == len(rows)
    for r in out:
        n, g, kept = want[r["id"]]
        assert (r["n_words"], [tuple(s) for s in r["spans"]], r["kept_text"]) == (n, spans(g), kept)
        assert (r["lang"], r["g"]) == ("en", 1)


def test_original_spacing_leaves_clean_texts_alone(make_docs):
    rows = [(1, "a  b\n c " + "x y z " * 9), (2, " lead  and\ttail \n"), (3, "new  start " + "x y z " * 9 + "end"), (4, None)]
    out = {r["id"]: r for r in substring_dedup.substring_dedup(make_docs(rows), spacing="original").collect()}
    assert out[1]["kept_text"] == rows[0][1] and out[2]["kept_text"] == rows[1][1]
    assert out[3]["kept_text"] == "new  start end"
    assert out[4]["kept_text"] == "" and out[4]["n_words"] == 0


def test_repeated_and_null_ids_keep_their_words(make_docs):
    text = "p q r s t u v w x y z 1 2 3 4 5"
    out = substring_dedup.substring_dedup(make_docs([(7, text), (7, text), (7, text + " 6"), (None, text), (None, text)])).collect()
    assert [len(r["spans"]) for r in out] == [0] * 5
    out = repeats.remove_repeated_bytes(make_docs([(7, text * 3), (7, text * 3), (7, text * 3 + "6"), (None, text * 3)])).collect()
    assert [len(r["spans"]) for r in out] == [0] * 4


@pytest.mark.parametrize("hot", [20, 20_000])
def test_repeats_equal_brute_force(make_docs, hot):
    rows = [(i, t if t is None else t[:3000] if i != 105 else t) for i, t in corpus(5)]
    gone = removed_places([(i, (t or "").encode()) for i, t in rows], 50)
    out = {r["id"]: r for r in repeats.remove_repeated_bytes(make_docs(rows), hot=hot, group_bytes=3000, bucket_bytes=4000).collect()}
    assert len(out) == len(rows)
    for (i, t), g in zip(rows, gone):
        b = (t or "").encode()
        kept = bytes(x for p, x in enumerate(b) if p not in g)
        assert (out[i]["n_bytes"], [tuple(s) for s in out[i]["spans"]], bytes(out[i]["kept"])) == (len(b), spans(g), kept), i


def test_interval_tree_reports_left_diverse_intervals():
    # suffixes sorted; common prefixes 60, 55, 60; left bytes a b | c c
    lcp, left, low = np.array([0, 60, 55, 60]), np.array([1, 2, 3, 3]), np.array([5, 4, 9, 8])
    found = repeats.interval_tree(lcp, left, low, 50)
    assert sorted(found) == [(0, 1, 60, 4), (0, 3, 55, 4)]


def test_near_duplicates_equal_brute_force(make_docs):
    rows = corpus(7)
    want = near_components(rows)
    out = near_dup.near_duplicates(make_docs(rows)).collect()
    assert len(out) == len(rows)
    for r in out:
        t = dict(rows)[r["id"]]
        assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(shingle_set(t)), want[r["id"]], want[r["id"]] == r["id"])


def test_near_chain_through_unlinked_ends(make_docs):
    """Ends of a chain that only its middle links, and bits below the threshold."""
    base = [f"w{i}" for i in range(100)]
    cut = lambda a, z: " ".join(base[a:z])
    rows = [(9, cut(0, 84)), (3, cut(8, 92)), (5, cut(16, 100)), (1, cut(40, 100)), (2, None), (4, "x"), (6, "X"), (8, "x y z q"), (7, "x  y\nz Q")]
    out = {r["id"]: r["component_id"] for r in near_dup.near_duplicates(make_docs(rows)).collect()}
    assert out == near_components(rows)


def test_families_of_many_blocks(make_docs, monkeypatch):
    """A family with chains, outsiders and several blocks equals brute force."""
    monkeypatch.setattr(near_dup, "BLOCK", 4)
    rng = random.Random(1)
    base = [f"w{i}" for i in range(80)]
    rows = []
    for i in range(60):
        w = list(base)
        for k in range(rng.choice([1, 2, 3, 4, 6])):
            w[rng.randrange(80)] = f"e{i}-{k}"
        rows.append((i, " ".join(w)))
    rows += [(100 + i, " ".join(f"x{rng.randrange(9)}" for _ in range(rng.randint(1, 12)))) for i in range(60)]
    want = near_components(rows)
    assert len(set(want.values())) > 10
    out = {r["id"]: r["component_id"] for r in near_dup.near_duplicates(make_docs(rows)).collect()}
    assert out == want


def test_forest_connects_what_links_connect():
    rng = np.random.default_rng(2)
    pool = np.unique(rng.integers(0, 2**63, 60).astype(np.uint64))
    sets = [np.sort(rng.choice(pool, rng.integers(25, 40), replace=False)) for _ in range(30)]
    node = np.arange(100, 130)
    left, right = np.arange(12), np.arange(5, 30)
    both = near_dup._common(sets, left, right)
    assert all(both[a, b] == len(np.intersect1d(sets[i], sets[j])) for a, i in enumerate(left) for b, j in enumerate(right))
    x, y = near_dup._forest(node, sets, left, right, 45)

    def parts(edges):
        root = {int(n): int(n) for n in node}

        def find(v):
            while root[v] != v:
                v = root[v]
            return v

        for a, b in edges:
            a, b = sorted((find(int(a)), find(int(b))))
            root[b] = a
        return {n: find(n) for n in root}

    links = [(node[i], node[j]) for a, i in enumerate(left) for b, j in enumerate(right) if 100 * both[a, b] >= 45 * (len(sets[i]) + len(sets[j]) - both[a, b])]
    assert 0 < len(set(parts(links).values())) < 30
    assert parts(zip(x, y)) == parts(links) and len(x) < len(node)


def test_sketch_estimate_is_close():
    rng = np.random.default_rng(0)
    errors = []
    for _ in range(60):
        n, share = 600, rng.uniform(0.2, 1)
        common = rng.integers(0, 2**63, int(n * share)).astype(np.uint64) * np.uint64(2)
        x, y = (np.unique(np.concatenate([common, rng.integers(0, 2**63, n - len(common)).astype(np.uint64) * np.uint64(2)])) for _ in range(2))
        j = len(common) / (2 * n - len(common))
        got = near_dup.estimate(near_dup.sketch(x)[None], near_dup.sketch(y)[None], np.array([float(n)]), np.array([float(n)]))[0]
        errors.append(got - j)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert substring_dedup.substring_dedup(empty).collect() == []
    assert repeats.remove_repeated_bytes(empty).collect() == []
    assert near_dup.near_duplicates(empty).collect() == []


def test_words_are_split_like_the_pattern():
    texts = ["a b", "", "\x0b\x0ca b   c\x1cd", "é" * 5 + " É"]
    raw = [t.encode() for t in texts]
    off = np.cumsum([0] + [len(x) for x in raw])
    b = np.frombuffer(b"".join(raw), np.uint8)
    s, e, _, doc = ke.words(b, off)
    got = [[b[i:j].tobytes().decode() for i, j, d in zip(s, e, doc) if d == k] for k in range(len(texts))]
    assert got == [words(t) for t in texts]
    assert sha("") == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
