"""Structure repair of conversations by a run-length min-plus DP.

A repaired conversation has the role initials ``(s?(ua)+)?``. A row's symbol
is what the DP sees of it: its role initial and whether it must go (blank,
duplicate) or is truncated. Equal consecutive symbols form a run, and a run is
one min-plus matrix power over the four states of the pattern, taken from a
cache of binary powers of its symbol's matrix.

Conversations may be of any length. Rows are range-partitioned by
(conversation, turn), each partition cuts its rows into segments of bounded
size, and two passes over the segments of a conversation follow: one from the
last segment to the first carries the cost of what is still to come (four
numbers), one from the first to the last unrolls the choices and hashes the
repaired text. Both keep one segment in memory; the hash of a conversation is
sequential by its nature, so its rows pass through one task in the end.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratafac.llm.tables import written

# The costs of the edits.
DELETE, REROLE, INSERT, TRUNCATED = 2, 1, 5, 5
_INF = 1 << 40
#: States: nothing yet, after s, after u, after a; those that may end.
_NEXT = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
_ENDS = (0, 3)
_TURN = {0: 2, 1: 2, 2: 3, 3: 2}  # the only user/assistant step from each state
_ROLE = {2: "user", 3: "assistant"}
#: Rows and bytes of text in a segment, before one more row is added.
SEGMENT_ROWS = 4096
SEGMENT_BYTES = 1 << 20

_SPACE = r"[\x20\x09-\x0D]"


# --- the DP ------------------------------------------------------------------


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Min-plus product."""
    return np.minimum((a[:, :, None] + b[None, :, :]).min(axis=1), _INF)


def _inserts() -> np.ndarray:
    """Any number of inserted rows: the shortest ways between the states."""
    m = np.full((4, 4), _INF)
    m[range(4), range(4)] = 0
    for s, t in _TURN.items():
        m[s, t] = min(m[s, t], INSERT)
    for _ in range(3):
        m = product(m, m)
    return m


def row_matrix(symbol: str) -> np.ndarray:
    """Cheapest edits from state to state for a row, inserts before it included.

    A symbol is ``x`` (must go), or an initial (``s``, ``u``, ``a`` or ``o``
    for any other), in upper case if the row is truncated."""
    m = np.full((4, 4), _INF)
    m[range(4), range(4)] = DELETE
    if symbol != "x":
        extra = TRUNCATED if symbol.isupper() else 0
        for s, t in _TURN.items():
            m[s, t] = min(m[s, t], REROLE + extra)
        for s, t in _NEXT.get(symbol.lower(), {}).items():
            m[s, t] = min(m[s, t], extra)
    return product(_inserts(), m)


class Powers:
    """Binary powers of the symbols' matrices, each computed once."""

    def __init__(self):
        self.known: dict[str, list[np.ndarray]] = {}

    def apply(self, symbol: str, n: int, costs: np.ndarray) -> np.ndarray:
        """Costs to come before a run of ``n`` rows from those after it."""
        powers = self.known.setdefault(symbol, [row_matrix(symbol)])
        k = 0
        while n >> k:
            if len(powers) == k:
                powers.append(product(powers[-1], powers[-1]))
            if n >> k & 1:
                costs = np.minimum((powers[k] + costs[None, :]).min(axis=1), _INF)
            k += 1
        return costs


def end_costs() -> np.ndarray:
    """Costs after the last row: inserts up to a state that may end."""
    return _inserts()[:, _ENDS].min(axis=1)


def unroll(runs: list[tuple[str, int]], state: int, after: np.ndarray, powers: Powers, last: bool) -> tuple[str, int]:
    """The least of the cheapest audits of a segment's runs from ``state``, and the
    state it ends in; ``after`` are the costs to come after the segment. Of
    equally cheap edits the one whose initial sorts first is taken, which
    gives the least audit, since an initial settles the next state."""
    ends = [after]
    for symbol, n in reversed(runs):
        ends.append(powers.apply(symbol, n, ends[-1]))
    ends.reverse()
    audit: list[str] = []
    for (symbol, n), end in zip(runs, ends[1:]):
        step = powers.known[symbol][0]
        to_come = [end]
        for _ in range(n - 1):
            to_come.append(np.minimum((step + to_come[-1][None, :]).min(axis=1), _INF))
        extra = TRUNCATED if symbol.isupper() else 0
        keeps = _NEXT.get(symbol.lower(), {}) if symbol != "x" else {}
        for costs in reversed(to_come):
            best = int((step[state] + costs).min())
            while True:
                turned = _TURN[state]
                if DELETE + costs[state] == best:
                    audit.append("D")
                    break
                if INSERT + (step[turned] + costs).min() == best:
                    audit.append("I")
                    state, best = turned, best - INSERT
                    continue
                if state in keeps and extra + costs[keeps[state]] == best:
                    audit.append("K")
                    state = keeps[state]
                else:
                    audit.append("R")
                    state = turned
                break
    if last:
        while state not in _ENDS:
            audit.append("I")
            state = _TURN[state]
    return "".join(audit), state


# --- damage and faults, as columns ---------------------------------------------


def damaged(rows: DataFrame) -> DataFrame:
    """The contract's damage: ``conv_id``, ``turn``, ``role``, ``text`` and the
    number of ``copies`` of each row that is left, null roles and texts as one
    space. Every conversation stays, one that lost all rows with 0 copies."""
    gap = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), gap), F.lit(":"), F.coalesce(F.col("turn").cast("string"), gap))
    kind = F.crc32(key) % 20
    text = F.coalesce(F.col("text").cast("string"), gap)
    return rows.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.when(kind == 4, F.lit("user")).otherwise(F.coalesce(F.col("role").cast("string"), gap)).alias("role"),
        F.when(kind == 1, F.lit("")).when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


def _last_character(text: Column) -> Column:
    return F.regexp_extract(text, rf"([^\x20\x09-\x0D]){_SPACE}*\z", 1)


def faulty(rows: DataFrame) -> DataFrame:
    """Rows equal in all columns summed up, with ``blank``, ``truncated`` and
    ``seen`` (role and text occur at an earlier turn of the conversation)."""
    whole = rows.where("copies > 0").groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    whole = whole.withColumn("digest", F.sha2("text", 256))
    firsts = whole.groupBy(F.col("conv_id").alias("f_conv"), F.col("role").alias("f_role"), F.col("digest").alias("f_digest")).agg(
        F.min("turn").alias("f_turn"), F.max(F.col("turn").isNull()).alias("f_null")
    )
    same = F.col("conv_id").eqNullSafe(F.col("f_conv")) & (F.col("role") == F.col("f_role")) & (F.col("digest") == F.col("f_digest"))
    last = _last_character(F.col("text"))
    return whole.join(firsts, same).select(
        "conv_id", "turn", "role", "text", "copies",
        (last == "").alias("blank"),
        ((last != "") & ~last.isin(".", "!", "?")).alias("truncated"),
        F.when(F.col("f_null"), F.col("turn").isNotNull()).otherwise(F.col("turn") > F.col("f_turn")).alias("seen"),
    )


# --- segments ----------------------------------------------------------------

_ROW = "turn long, role string, text string, copies long, blank boolean, truncated boolean, seen boolean"
SEGMENT = f"conv_id long, place long, symbols array<string>, lengths array<long>, rows array<struct<{', '.join(x.strip().replace(' ', ':') for x in _ROW.split(','))}>>"


def row_symbols(role: str, copies: int, blank: bool, truncated: bool, seen: bool) -> list[tuple[str, int]]:
    """Runs of a row and its copies."""
    if blank or seen:
        return [("x", copies)]
    initial = role[:1] if role[:1] in ("s", "u", "a") else "o"
    first = [(initial.upper() if truncated else initial, 1)]
    return first + [("x", copies - 1)] if copies > 1 else first


def add_runs(runs: list[tuple[str, int]], more: list[tuple[str, int]]) -> None:
    for symbol, n in more:
        if runs and runs[-1][0] == symbol:
            runs[-1] = (symbol, runs[-1][1] + n)
        else:
            runs.append((symbol, n))


def _segments(batches: Iterator[pa.RecordBatch], segment_rows: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    place = TaskContext.get().partitionId() << 40
    names = [x.split()[0] for x in _ROW.split(",")]
    done: list[dict] = []
    rows: list[dict] = []
    conv, held, waiting = None, 0, 0

    def close():
        nonlocal rows, held, place, waiting
        if rows:
            runs: list[tuple[str, int]] = []
            for r in rows:
                add_runs(runs, row_symbols(r["role"], r["copies"], r["blank"], r["truncated"], r["seen"]))
            done.append({"conv_id": conv, "place": place, "symbols": [s for s, _ in runs], "lengths": [n for _, n in runs], "rows": rows})
            place += 1
            waiting += held
        rows, held = [], 0

    def batch_out():
        nonlocal done, waiting
        out = pa.RecordBatch.from_pylist(done, _segment_schema())
        done, waiting = [], 0
        return out

    for batch in batches:
        for r in batch.to_pylist():
            if rows and (r["conv_id"] != conv or len(rows) >= segment_rows or held >= SEGMENT_BYTES):
                close()
                if waiting >= SEGMENT_BYTES or len(done) >= SEGMENT_ROWS:
                    yield batch_out()
            conv = r["conv_id"]
            held += len(r["text"])
            rows.append({k: r[k] for k in names})
    close()
    if done:
        yield batch_out()


def _segment_schema() -> pa.Schema:
    flag = pa.bool_()
    row = pa.struct([("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("copies", pa.int64()), ("blank", flag), ("truncated", flag), ("seen", flag)])
    return pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("symbols", pa.list_(pa.string())), ("lengths", pa.list_(pa.int64())), ("rows", pa.list_(row))])


def segments(rows: DataFrame, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """Rows in order of (conversation, turn, role, text), nulls first, cut into
    segments; ``place`` numbers the segments in that order."""
    keys = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "text")]
    return rows.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(lambda it: _segments(it, segment_rows), SEGMENT)


def _costs_after(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments of a conversation from the last to the first: costs after each."""
    powers = Powers()
    conv, costs, fresh = None, None, True
    for batch in batches:
        place, after = [], []
        for c, p, symbols, lengths in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if fresh or c != conv:
                conv, costs, fresh = c, end_costs(), False
            place.append(p)
            after.append(costs.tolist())
            for symbol, n in zip(reversed(symbols), reversed(lengths)):
                costs = powers.apply(symbol, n, costs)
        yield pa.RecordBatch.from_arrays([pa.array(place, pa.int64()), pa.array(after, pa.list_(pa.int64()))], ["c_place", "after"])


REPAIRED = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


class _Conversation:
    """What is carried over the segments of a conversation."""

    def __init__(self, conv):
        self.conv = conv
        self.low = self.high = self.turn = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.initial = None
        self.state, self.cost = 0, None
        self.audit: list[str] = []
        self.hash, self.begun = hashlib.sha256(), False

    def count(self, r: dict) -> None:
        if r["turn"] is not None and r["turn"] != self.turn:
            self.turns += 1
            self.turn = self.high = r["turn"]
            self.low = r["turn"] if self.low is None else self.low
        n, initial = r["copies"], r["role"][:1]
        if r["blank"]:
            self.blank += n
        elif r["seen"]:
            self.duplicate += n
        else:
            self.duplicate += n - 1
            self.truncated += r["truncated"]
        self.illegal += (self.initial is not None and self.initial + initial not in ("su", "ua", "au")) + n - 1
        self.initial = initial

    def put(self, role: str, text: str) -> None:
        self.hash.update(f"{chr(10) if self.begun else ''}{role}:{text}".encode())
        self.begun = True

    def add(self, runs: list[tuple[str, int]], rows: list[dict], after: np.ndarray, powers: Powers, last: bool) -> None:
        if self.cost is None:
            before = after
            for symbol, n in reversed(runs):
                before = powers.apply(symbol, n, before)
            self.cost = int(before[0])
        audit, end = unroll(runs, self.state, after, powers, last)
        self.audit.append(audit)
        edits = iter(audit)
        state = self.state
        for r in rows:
            self.count(r)
            for _ in range(r["copies"]):
                edit = next(edits)
                while edit == "I":
                    state = _TURN[state]
                    self.put(_ROLE[state], "")
                    edit = next(edits)
                if edit == "K":
                    state = _NEXT[r["role"][0]][state]
                    self.put(r["role"], r["text"])
                elif edit == "R":
                    state = _TURN[state]
                    self.put(_ROLE[state], r["text"])
        for _ in edits:
            state = _TURN[state]
            self.put(_ROLE[state], "")
        self.state = end

    def row(self) -> dict:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return {
            "conv_id": self.conv, "gaps": gaps, "blank": self.blank, "duplicate": self.duplicate, "truncated": self.truncated, "illegal": self.illegal,
            "cost": self.cost, "audit": "".join(self.audit), "repaired_sha256": self.hash.hexdigest(),
        }


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments of a conversation from the first to the last, with the costs after each."""
    powers = Powers()
    now: _Conversation | None = None
    schema = pa.schema([(x.split()[0], pa.string() if x.endswith("string") else pa.int64()) for x in REPAIRED.split(", ")])
    for batch in batches:
        out = []
        for i in range(batch.num_rows):
            conv, _, symbols, lengths, rows, after, last = (batch.column(k)[i].as_py() for k in range(7))
            if now is None or now.conv != conv:
                now = _Conversation(conv)
            now.add(list(zip(symbols, lengths)), rows, np.array(after), powers, last)
            if last:
                out.append(now.row())
                now = None
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)


def repair(rows: DataFrame, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """One row per conversation of ``rows`` (``conv_id``, ``turn``, ``role``,
    ``text``, ``copies``): faults, cheapest edits and the repaired text's hash.

    Rows are taken by turn, null turns first; rows of one turn by role and
    text. Rows equal in all columns are adjacent copies. A null ``conv_id`` is
    a conversation of its own. A conversation whose rows all have 0 copies has
    zeros, an empty audit and the hash of nothing; an empty table gives no
    rows. Texts of any length are kept whole; other columns are never read.
    """
    every = rows.select(F.col("conv_id").alias("e_conv")).distinct()
    cut = written(segments(faulty(rows), segment_rows), "conversation-segments")
    by_conv = [F.col("conv_id").asc_nulls_first(), F.col("place")]
    backwards = cut.select("conv_id", "place", "symbols", "lengths").repartition("conv_id").sortWithinPartitions(by_conv[0], F.col("place").desc())
    after = written(backwards.mapInArrow(_costs_after, "c_place long, after array<long>"), "conversation-costs")
    ends = cut.groupBy("conv_id").agg(F.max("place").alias("e_place")).select("e_place")
    joined = cut.join(after, cut["place"] == after["c_place"]).join(ends, F.col("place") == F.col("e_place"), "left")
    forwards = joined.select("conv_id", "place", "symbols", "lengths", "rows", "after", F.col("e_place").isNotNull().alias("last"))
    forwards = forwards.repartition("conv_id").sortWithinPartitions(*by_conv)
    done = forwards.mapInArrow(_repaired, REPAIRED)
    zero = F.lit(0).cast("long")
    kept = [F.coalesce(c, zero).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    nothing = F.lit(hashlib.sha256().hexdigest())
    return every.join(done, F.col("e_conv").eqNullSafe(F.col("conv_id")), "left").select(
        F.col("e_conv").alias("conv_id"), *kept, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", nothing).alias("repaired_sha256")
    )
