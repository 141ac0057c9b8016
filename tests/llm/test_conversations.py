import hashlib
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stratafac.llm import conversations as cv

WORD = re.compile(r"[^\x20\x09-\x0D]")
INSERTED = {0: 2, 1: 2, 2: 3, 3: 2}


def cheapest(rows):
    """(cost, audit, repaired rows) by trying every edit; rows are (role, text, fault)."""
    best = {0: (0, "", ())}
    keeps = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
    name = {2: "user", 3: "assistant"}

    def with_inserts(states):
        out = dict(states)
        for _ in range(4):
            for s, (c, a, r) in list(out.items()):
                t = INSERTED[s]
                new = (c + 5, a + "I", r + (f"{name[t]}:",))
                if t not in out or new < out[t]:
                    out[t] = new
        return out

    for role, text, fault in rows:
        after = {}

        def offer(s, new):
            if s not in after or new < after[s]:
                after[s] = new

        for s, (c, a, r) in with_inserts(best).items():
            offer(s, (c + 2, a + "D", r))
            if fault in ("blank", "duplicate"):
                continue
            more = 5 if fault == "truncated" else 0
            if (s, role[:1]) in keeps:
                offer(keeps[s, role[:1]], (c + more, a + "K", r + (f"{role}:{text}",)))
            t = INSERTED[s]
            offer(t, (c + 1 + more, a + "R", r + (f"{name[t]}:{text}",)))
        best = after
    return min(x for s, x in with_inserts(best).items() if s in (0, 3))


def brute(rows):
    """Result by conversation; rows are (conv, turn, role, text)."""
    convs = {}
    for conv, turn, role, text in rows:
        mine = convs.setdefault(conv, [])
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(key.encode()) % 20
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        mine.extend([(turn, role, text)] * (2 if kind == 3 else 1))
    out = {}
    for conv, mine in convs.items():
        mine.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode()))
        seen, faults = set(), []
        for _, role, text in mine:
            chars = WORD.findall(text)
            fault = "blank" if not chars else "duplicate" if (role, text) in seen else "truncated" if chars[-1] not in ".!?" else ""
            seen.add((role, text))
            faults.append((role, text, fault))
        turns = [t for t, _, _ in mine if t is not None]
        cost, audit, repaired = cheapest(faults)
        kinds = [f for _, _, f in faults]
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:]))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, kinds.count("blank"), kinds.count("duplicate"), kinds.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(repaired).encode()).hexdigest())
    return out


SCHEMA = "conv_id long, turn long, role string, text string, place long, rows string, copies long, last boolean"


def repaired(spark, rows, segment_rows=cv.SEGMENT_ROWS):
    df = spark.createDataFrame([(*r, 1, "x", 9, True) for r in rows], SCHEMA)
    got = cv.repair(cv.damaged(df), segment_rows).collect()
    out = {r["conv_id"]: (r["gaps"], r["blank"], r["duplicate"], r["truncated"], r["illegal"], r["cost"], r["audit"], r["repaired_sha256"]) for r in got}
    assert len(out) == len(got)
    return out


def conversation(conv, n, seed):
    rng = np.random.default_rng(seed)
    roles = ["system", "user", "assistant", "assistant", "user", "tool", "", None]
    texts = ["Yes.", "No", "", " \t", "A long answer!", None, "é 漢字?", "Why"]
    return [(conv, None if rng.random() < 0.1 else int(t // 1.2), roles[int(rng.integers(8))], texts[int(rng.integers(8))] if rng.random() < 0.6 else f"turn {t}.") for t in range(n)]


@pytest.mark.parametrize("segment_rows", [1, 3, 4096])
def test_repair_equals_brute_force(spark, segment_rows):
    rows = [r for c in range(30) for r in conversation(c, 1 + c % 13, c)] + conversation(None, 9, 99)
    rows += [(50, None, "user", "x" * 200_000 + "."), (50, None, "user", "x" * 200_000 + "."), (51, None, None, None)]
    rows += rows[:5]
    assert repaired(spark, rows, segment_rows) == brute(rows)


def test_repair_of_a_long_conversation(spark):
    rows = conversation(7, 900, 1) + [(7, 2000 + t, "user", "Again?") for t in range(400)] + conversation(8, 4, 2)
    assert repaired(spark, rows, 50) == brute(rows)


def test_repair_keeps_conversations_without_rows(spark):
    gone = next((c, 0) for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    got = repaired(spark, [(*gone, "user", "Hello.")])
    assert got == {gone[0]: (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())}
    assert repaired(spark, []) == {}


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("xsuaoSUAO"), st.integers(1, 7)), max_size=6))
def test_runs_are_unrolled_to_the_least_audit(pieces):
    runs = []
    cv.add_runs(runs, pieces)
    rows = []
    for symbol, n in runs:
        fault = "blank" if symbol == "x" else "truncated" if symbol.isupper() else ""
        rows += [(symbol.lower(), "t", fault)] * n
    cost, audit, _ = cheapest(rows)
    powers = cv.Powers()
    before = cv.end_costs()
    for symbol, n in reversed(runs):
        before = powers.apply(symbol, n, before)
    assert before[0] == cost
    assert cv.unroll(runs, 0, cv.end_costs(), powers, True) == (audit, cv.unroll(runs, 0, cv.end_costs(), powers, True)[1])


def test_powers_are_those_of_single_steps():
    powers, step = cv.Powers(), cv.row_matrix("U")
    costs = cv.end_costs()
    for n in range(1, 70):
        costs = np.minimum((step + costs[None, :]).min(axis=1), 1 << 40)
        assert (powers.apply("U", n, cv.end_costs()) == costs).all()
    assert len(powers.known["U"]) == 7
