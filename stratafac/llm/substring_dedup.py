"""Substring dedup over words by difference-cover anchors.

A word window of ``window`` words that two documents share starts anywhere in
either. Windows of ``window - period + 1`` words are hashed only where the
position modulo ``period`` lies in a difference cover: for any two starts there
is a shift below ``period`` that puts both on the cover, so every shared window
holds an aligned anchor that both documents hash. Rounds:

1. Each group of documents sends its distinct anchors to buckets; an anchor
   that only one document has is dropped there (most are).
2. Shared anchors are extended: every full window that holds one is named by a
   128-bit print, and the group sends its distinct prints with their smallest
   document. The bucket answers with the smallest document of all groups.
3. Each group marks the words of windows that a smaller document has.

No pairs are formed, a hot window costs one entry per group, and exact copies
skip the rounds (see ``groups``).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from stratafac.llm import groups as gr
from stratafac.llm import kernels as ke

#: A difference cover modulo 7 (every residue is a difference).
PERIOD, COVER = 7, (0, 1, 3)

RESULT = "id long, n_words long, spans array<struct<start:int,length:int>>, kept_text string"


def _first_word(doc: np.ndarray, n_docs: int) -> np.ndarray:
    return np.searchsorted(doc, np.arange(n_docs + 1))


def _anchors(h, doc, first, window: int, skip):
    """Positions and keys of the cover's anchors in texts not in ``skip``."""
    k = window - PERIOD + 1
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.arange(n) - first[doc[:n]]
    on = np.isin(np.arange(PERIOD), COVER)[at % PERIOD]
    on &= (doc[:n] == doc[k - 1 :]) & ~skip[doc[:n]]
    pos = np.flatnonzero(on)
    return pos, ke.ngrams(h, k)[pos]


def _split(key: np.ndarray, n_buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and 32-bit rest of a key; equal rests of different keys in a
    bucket only add candidates."""
    return (key % np.uint64(n_buckets)).astype(np.int32), (key >> np.uint64(32)).astype(np.uint32)


def send_anchors(docs: pa.Table, answers: pa.Table, window: int, n_buckets: int) -> pa.Table:
    b, off = ke.text_buffer(docs["text"])
    ids = docs["id"].to_numpy(zero_copy_only=False)
    skip = gr.is_copy(docs["th"].to_numpy(), answers) | np.asarray(docs["id"].is_null())
    _, _, h, doc = ke.words(b, off)
    pos, key = _anchors(h, doc, _first_word(doc, len(ids)), window, skip)
    bucket, rest = _split(key, n_buckets)
    owner = doc[pos]
    order, new = ke.unique_rows(bucket, rest)
    if len(new) == 0:
        return gr.messages(0, np.zeros(0, np.int32))
    owner = ids[owner[order]]
    multi = np.minimum.reduceat(owner, new) != np.maximum.reduceat(owner, new)
    g = docs["g"][0].as_py()
    return gr.messages(g, bucket[order[new]], rest[order[new]], multi.astype(np.uint8))


def shared_keys(sent: pa.Table) -> pa.Table:
    """Answer each group with those of its keys that two documents have."""
    sent = sent.sort_by("g")
    gs, a, m = sent["g"].to_pylist(), sent["a"].to_pylist(), sent["b"].to_pylist()
    keys = [np.frombuffer(x, np.uint32) for x in a]
    flat, multi = np.concatenate(keys), np.frombuffer(b"".join(m), np.uint8)
    u, count = np.unique(flat, return_counts=True)
    inner, tally = np.unique(flat[multi > 0], return_counts=True)
    u = np.union1d(u[count > 1], inner)
    cols: dict[str, list] = {k: [] for k in ("g", "bucket", "kind", "a", "b", "c", "d")}
    for g, k in zip(gs, keys):
        i = np.searchsorted(u, k)
        hit = k[(i < len(u)) & (u[np.minimum(i, max(len(u) - 1, 0))] == k)] if len(u) else k[:0]
        if len(hit):
            for name, v in zip(cols, (g, sent["bucket"][0].as_py(), "anchor", hit.tobytes(), None, None, None)):
                cols[name].append(v)
    return gr.message_table(cols)


def _windows(docs, answers, window: int, n_buckets: int):
    """Everything the last two rounds share: words, candidate windows and
    their distinct prints, sorted by bucket and print."""
    b, off = ke.text_buffer(docs["text"])
    ids = docs["id"].to_numpy(zero_copy_only=False)
    copy = gr.is_copy(docs["th"].to_numpy(), answers)
    skip = copy | np.asarray(docs["id"].is_null())
    s, e, h, doc = ke.words(b, off)
    first = _first_word(doc, len(ids))
    pos, key = _anchors(h, doc, first, window, skip)
    bucket, rest = _split(key, n_buckets)
    full = (bucket.astype(np.uint64) << np.uint64(32)) | rest
    known = [np.uint64(k) << np.uint64(32) | np.frombuffer(a, np.uint32).astype(np.uint64) for k, a, *_ in gr.answers_of(answers, "anchor")]
    hit = pos[np.isin(full, np.concatenate(known))] if known else pos[:0]
    # a window at p holds the anchors at p .. p + PERIOD - 1
    n = max(len(h) - window + 1, 0)
    flag = np.zeros(len(h) + PERIOD + 1, np.int64)
    flag[hit + 1] = 1
    total = np.cumsum(flag)
    cand = (total[PERIOD : PERIOD + n] > total[:n]) if n else np.zeros(0, bool)
    cand &= (doc[:n] == doc[window - 1 :][:n]) if n else cand
    cand = np.flatnonzero(cand)
    cand = cand[~skip[doc[cand]]] if len(cand) else cand
    lo, hi = (ke.ngrams(h, window, m)[cand] for m in ke.MULTIPLIERS)
    bkt = (lo % np.uint64(n_buckets)).astype(np.int32)
    order, new = ke.unique_rows(bkt, lo, hi)
    return b, off, ids, copy, s, e, doc, first, cand, lo, hi, bkt, order, new


def send_windows(docs: pa.Table, answers: pa.Table, window: int, n_buckets: int) -> pa.Table:
    *_, ids, _, _, _, doc, _, cand, lo, hi, bkt, order, new = _windows(docs, answers, window, n_buckets)
    if len(new) == 0:
        return gr.messages(0, np.zeros(0, np.int32))
    least = np.minimum.reduceat(ids[doc[cand[order]]], new)
    i = order[new]
    return gr.messages(docs["g"][0].as_py(), bkt[i], lo[i], hi[i], least)


def least_owner(sent: pa.Table) -> pa.Table:
    """Answer with (place in the message, smallest document) where a smaller
    document than the group's own smallest has the window."""
    sent = sent.sort_by("g")
    a, b, c = (sent[x].to_pylist() for x in "abc")
    lo, hi, least = (np.frombuffer(b"".join(x), t) for x, t in ((a, np.uint64), (b, np.uint64), (c, np.int64)))
    order, new = ke.unique_rows(lo, hi)
    size = np.diff(np.append(new, len(order)))
    overall = np.empty(len(order), np.int64)
    overall[order] = np.repeat(np.minimum.reduceat(least[order], new), size)
    cols: dict[str, list] = {k: [] for k in ("g", "bucket", "kind", "a", "b", "c", "d")}
    at = 0
    for g, x in zip(sent["g"].to_pylist(), a):
        n = len(x) // 8
        smaller = np.flatnonzero(overall[at : at + n] < least[at : at + n])
        if len(smaller):
            row = (g, sent["bucket"][0].as_py(), "least", smaller.astype(np.uint32).tobytes(), overall[at : at + n][smaller].tobytes(), None, None)
            for name, v in zip(cols, row):
                cols[name].append(v)
        at += n
    return gr.message_table(cols)


def remove_words(docs: pa.Table, answers: pa.Table, window: int, n_buckets: int, spacing: str) -> pa.Table:
    b, off, ids, copy, s, e, doc, first, cand, lo, hi, bkt, order, new = _windows(docs, answers, window, n_buckets)
    n_docs, n_words = len(ids), np.diff(first)
    gone = np.zeros(len(s), bool)
    if len(new):
        least = np.minimum.reduceat(ids[doc[cand[order]]], new)
        start = bkt[order[new]]
        for bucket, a, c, *_ in gr.answers_of(answers, "least"):
            at = np.searchsorted(start, bucket) + np.frombuffer(a, np.uint32)
            least[at] = np.frombuffer(c, np.int64)
        size = np.diff(np.append(new, len(order)))
        owner = np.empty(len(order), np.int64)
        owner[order] = np.repeat(least, size)
        gone |= ke.covered(cand[owner < ids[doc[cand]]], window, len(s))
    gone |= (copy & (n_words >= window))[doc] if len(doc) else gone
    keep, text = _kept_single(b, s, e, doc, gone) if spacing == "single" else _kept_original(b, off, s, doc, gone)
    sizes = np.concatenate([[0], np.cumsum(keep, dtype=np.int64)])[off]
    lo_run, hi_run = _runs_in_docs(gone, doc, first)
    span_of = np.searchsorted(lo_run, first)
    base = first[doc[lo_run]] if len(lo_run) else lo_run
    spans = pa.ListArray.from_arrays(
        pa.array(span_of, pa.int32()),
        pa.StructArray.from_arrays([pa.array(lo_run - base, pa.int32()), pa.array(hi_run - lo_run, pa.int32())], ["start", "length"]),
    )
    return pa.table({
        "id": docs["id"].combine_chunks(),
        "n_words": pa.array(n_words, pa.int64()),
        "spans": spans,
        "kept_text": ke.binary_column(text[keep], sizes, pa.string()).cast(pa.string()),
        **{c: docs[c] for c in docs.column_names if c.startswith("carried_")},
    })


def _kept_single(b, s, e, doc, gone):
    """A kept word keeps its bytes, and one space unless it is its text's last."""
    keep_word = ~gone
    text = b.copy()
    d = np.zeros(len(b) + 1, np.int8)
    d[s[keep_word]] += 1
    d[e[keep_word]] -= 1
    keep = np.cumsum(d[:-1], dtype=np.int8).astype(bool)
    kept, owner = e[keep_word], doc[keep_word]
    inner = kept[:-1][owner[:-1] == owner[1:]]
    keep[inner] = True
    text[inner] = 0x20
    return keep, text


def _kept_original(b, off, s, doc, gone):
    """All but the removed words, each with the white space that follows it."""
    till = np.append(s[1:], len(b))
    last = np.append(doc[1:] != doc[:-1], True) if len(doc) else np.zeros(0, bool)
    till = np.where(last, off[doc + 1], till) if len(doc) else till[:0]
    d = np.zeros(len(b) + 1, np.int32)
    np.add.at(d, s[gone], 1)
    np.add.at(d, till[gone], -1)
    return np.cumsum(d[:-1]) == 0, b


def _runs_in_docs(mask: np.ndarray, doc: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of True that don't cross texts."""
    if not len(mask):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    begins = np.zeros(len(mask) + 1, bool)
    begins[first] = True
    lo = mask & np.concatenate([[True], ~mask[:-1] | begins[1 : len(mask)]])
    hi = mask & np.concatenate([~mask[1:] | begins[1 : len(mask)], [True]])
    return np.flatnonzero(lo), np.flatnonzero(hi) + 1


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13,
                    spacing: str = "single", carry: tuple[str, ...] = (),
                    group_bytes: int = gr.GROUP_BYTES, bucket_bytes: int = gr.BUCKET_BYTES) -> DataFrame:
    """Remove every word covered by a ``window``-word window whose word
    sequence also starts in a document with a smaller id.

    Words are ``[^\\x20\\x09-\\x0D]+``; windows are judged on the input, not on
    what is left. Returns one row per input row: ``id``, ``n_words``, ``spans``
    (maximal removed runs, in words), ``kept_text`` (kept words joined by one
    space, or with ``spacing="original"`` the text without the removed words
    and the white space behind them) and the columns named in ``carry``. Memory per task is bounded by ``group_bytes`` and
    ``bucket_bytes`` of text and by the longest text.

    Defined cases: a null or blank text has no words and an empty kept text;
    texts shorter than the window lose nothing; rows that repeat an id are
    judged each on its own and don't remove from one another; a row with a
    null id neither loses words nor counts as a source; an empty table gives
    an empty result; other columns are ignored.
    """
    if window < PERIOD:
        raise ValueError(f"window must be at least {PERIOD} words")
    gd = gr.grouped(docs, id_col, text_col, group_bytes, bucket_bytes, carry)
    nb = gd.n_buckets
    sent = gr.round_of(gd.docs, gd.copies, lambda d, a: send_anchors(d, a, window, nb), gr.MESSAGE)
    shared = gr.exchange(sent, shared_keys)
    known = gd.copies.unionByName(shared)
    sent = gr.round_of(gd.docs, known, lambda d, a: send_windows(d, a, window, nb), gr.MESSAGE)
    known = known.unionByName(gr.exchange(sent, least_owner))
    kinds = dict(docs.select(*carry).dtypes) if carry else {}
    schema = RESULT + "".join(f", carried_{i} {kinds[c]}" for i, c in enumerate(carry))
    out = gr.round_of(gd.docs, known, lambda d, a: remove_words(d, a, window, nb, spacing), schema)
    return out.withColumnsRenamed({f"carried_{i}": c for i, c in enumerate(carry)})
