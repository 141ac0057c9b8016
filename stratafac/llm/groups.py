"""Documents in groups of bounded size, and the messages between them.

Substring operators work in rounds: each group of documents sends compact
messages to buckets of a hash, each bucket answers the groups that wrote to
it. A group is pre-aggregated before it sends (one entry per distinct key), so
a key that a third of all documents share costs a bucket one entry per group.
The documents are shuffled once: every round starts from the same exchange,
which Spark reuses, and a lost executor's part is recomputed from the plan.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratafac.llm.tables import written

#: Bytes of text in a group and, before pre-aggregation, behind a bucket.
GROUP_BYTES = 4 << 20
BUCKET_BYTES = 8 << 20

MESSAGE = "bucket int, g int, a binary, b binary, c binary, d binary"
ANSWER = "g int, bucket int, kind string, a binary, b binary, c binary, d binary"


@dataclass
class Grouped:
    docs: DataFrame  # g, th, id, text and the carried columns
    copies: DataFrame  # rows of ANSWER, kind "copy": a = th of the group's exact copies
    n_groups: int
    n_buckets: int


def grouped(docs: DataFrame, id_col: str, text_col: str, group_bytes: int = GROUP_BYTES, bucket_bytes: int = BUCKET_BYTES, carry: tuple[str, ...] = ()) -> Grouped:
    """Deal the rows into groups by a hash of id and text.

    ``th`` names a row within its group; rows equal in id and text share it.
    Exact copies (equal text, smaller id elsewhere) are found by digest first:
    all of their content is repeated, so later rounds skip them.
    """
    carried = [f"carried_{i}" for i in range(len(carry))]
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), *(F.col(c).alias(k) for c, k in zip(carry, carried)))
    total = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_groups = max(1, math.ceil(total / group_bytes))
    n_buckets = max(1, math.ceil(total / bucket_bytes))
    base = base.withColumn("th", F.xxhash64("id", "text"))
    base = base.select(F.pmod("th", F.lit(n_groups)).cast("int").alias("g"), "th", "id", "text", *carried)
    prints = base.where("id is not null and octet_length(text) > 0").select("g", "th", "id", F.unhex(F.md5("text")).alias("m"))
    firsts = prints.groupBy("m").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").select("m", "first")
    # written: a join of two plain shuffles, which Spark can split at a hot digest
    firsts = written(firsts, "copies")
    copies = prints.join(firsts, "m").where("id > first").groupBy("g").agg(F.array_sort(F.collect_set("th")).alias("ths"))
    empty = F.lit(None).cast("binary")
    copies = copies.select(
        "g", F.lit(-1).alias("bucket"), F.lit("copy").alias("kind"),
        F.unhex(F.concat_ws("", F.transform("ths", lambda x: F.lpad(F.hex(x), 16, "0")))).alias("a"),
        empty.alias("b"), empty.alias("c"), empty.alias("d"),
    )
    return Grouped(base, copies, n_groups, n_buckets)


def is_copy(th: np.ndarray, answers: pa.Table) -> np.ndarray:
    """Which of the group's rows are exact copies."""
    out = np.zeros(len(th), bool)
    for kind, a in zip(answers["kind"].to_pylist(), answers["a"].to_pylist()):
        if kind == "copy":
            out |= np.isin(th, np.frombuffer(a, ">i8").astype(np.int64))
    return out


def answers_of(answers: pa.Table, kind: str) -> list[tuple]:
    """(bucket, a, b, c, d) of one kind, in the order of the buckets."""
    rows = zip(*(answers[c].to_pylist() for c in ("kind", "bucket", "a", "b", "c", "d")))
    return sorted((r[1:] for r in rows if r[0] == kind), key=lambda r: r[0])


def messages(g: int, bucket: np.ndarray, *parts: np.ndarray) -> pa.Table:
    """One row per bucket from arrays that are sorted by bucket."""
    cols: dict[str, list] = {"bucket": [], "g": [], "a": [], "b": [], "c": [], "d": []}
    if len(bucket):
        cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        ends = np.append(cut[1:], len(bucket))
        cols["bucket"] = bucket[cut].tolist()
        cols["g"] = [g] * len(cut)
        for i, name in enumerate("abcd"):
            if i < len(parts):
                raw, width = parts[i].tobytes(), parts[i].itemsize
                cols[name] = [raw[s * width : e * width] for s, e in zip(cut.tolist(), ends.tolist())]
            else:
                cols[name] = [None] * len(cut)
    return message_table(cols)


def message_table(cols: dict[str, list]) -> pa.Table:
    kinds = {"bucket": pa.int32(), "g": pa.int32(), "kind": pa.string()}
    return pa.table({k: pa.array(v, kinds.get(k, pa.binary())) for k, v in cols.items()})


def exchange(sent: DataFrame, answer) -> DataFrame:
    """Bring each bucket's messages together and return the answers."""
    return sent.groupBy("bucket").applyInArrow(answer, ANSWER)


def round_of(docs: DataFrame, answers: DataFrame, work, schema: str) -> DataFrame:
    """Run ``work(documents, answers)`` for each group."""
    answers = answers.withColumnRenamed("g", "to_g")
    return docs.groupBy("g").cogroup(answers.groupBy("to_g")).applyInArrow(work, schema)
