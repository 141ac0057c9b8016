import re
from itertools import permutations

import numpy as np

from stratafac.llm import filter_audit as fa

DOCS = "doc_id long, text string, lang string, part string, mask int, n long"


def failures(docs):
    least = {}
    for i, text, _ in docs:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    out = []
    for i, text, lang in docs:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        bad = {
            "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and least[t] < i,
        }
        out.append((i, lang or "", {k for k, v in bad.items() if v}))
    return out


def brute(docs, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    rows = failures(docs)
    out = {}
    for part in {p for _, p, _ in rows}:
        mine = [(i, f) for i, p, f in rows if p == part]
        total = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                total[f] += len(gone)
                bad = [x for x in mine if f in x[1]]
                out[part, "".join(order), step] = [
                    len(left), len(gone), len(bad) - len(gone), sum(x[1] == {f} for x in mine),
                    sum(x[0] in good for x in gone), sum(x[0] in toxic for x in gone), f,
                ]
        for key, v in out.items():
            if key[0] == part:
                v[6] = total[v[6]]
    return {k: tuple(v) for k, v in out.items()}


def audited(spark, docs, labels):
    d = spark.createDataFrame([(*x, "clash", 3, 4) for x in docs], DOCS)
    q = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = fa.audit(d, q).collect()
    out = {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in got}
    assert len(out) == len(got)
    return out


def test_audit_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    bits = [" ".join(f"w{rng.integers(900)}" for _ in range(250)), "same " * 300, "LOUD " * 260, "a $ b", "", None, "Words, é 漢字 und mehr. " * 60]
    docs = [(int(i), bits[int(rng.integers(7))] if rng.random() < 0.7 else f"{bits[0]} {i} {'#' * (i % 2)}", ["de", "en", None, ""][int(rng.integers(4))]) for i in range(120)]
    docs += [docs[0], docs[0], (None, "a $ b", "en"), (None, "a $ b", "en"), (None, None, None), (500, "y" * 300_000, "xx")]
    labels = [(int(i), int(rng.integers(2)), int(rng.integers(2))) for i in range(0, 120, 2)] + [(0, 1, None), (0, None, 1), (None, 1, 1)]
    assert audited(spark, docs, labels) == brute(docs, labels)


def test_audit_of_nothing(spark):
    assert audited(spark, [], []) == {}


def test_gray_walk_gives_every_subset():
    rng = np.random.default_rng(1)
    cells = rng.integers(0, 100, (4, 32, 3))
    states = fa.gray_walk(cells)
    for subset in range(32):
        kept = [m for m in range(32) if not m & subset]
        assert (states[:, subset] == cells[:, kept].sum(axis=1)).all()
