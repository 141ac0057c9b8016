"""Repeated byte strings by common-prefix interval trees over suffix arrays.

Which suffixes can repeat is found first: in every window of ``length`` bytes
the ``ANCHOR``-byte substring with the smallest hash is an anchor, so two equal
windows hold the same anchor at the same place. Rounds (see ``groups``):

1. Groups of documents send their distinct anchors to buckets; those that only
   one document has are dropped.
2. Around each shared anchor the group cuts the context that holds all windows
   with that anchor, and sends its distinct contexts with their smallest and
   largest document. In the bucket, the contexts' suffixes that start at or
   before the anchor are sorted into a suffix array with common-prefix lengths;
   a stack scan walks the interval tree (depth ``length`` and more) and every
   interval whose left neighbours differ is a maximal repeat within its
   contexts, with all of its occurrences, not just neighbours. Documents beyond
   the smallest of an interval hold a removable copy.
3. Groups apply the answered intervals to their texts.

Anchors that occur very often go another way, which gives the same result:
each window whose anchor is hot is sent by its own 128-bit print, one entry per
group and distinct window, so no bucket sees more than one per group.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from stratafac.llm import groups as gr
from stratafac.llm import kernels as ke
from stratafac.llm.substring_dedup import least_owner

ANCHOR = 24
#: Occurrences of one anchor beyond which its windows are sent one by one.
HOT = 20_000

RESULT = "id long, n_bytes long, spans array<struct<start:long,length:long>>, kept binary"
_RANGE = np.dtype([("lo", "<i8"), ("hi", "<i8")])


def _sliding(x: np.ndarray, w: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) of every ``w`` consecutive values."""
    span = 1
    while span * 2 <= w:
        x = pick(x[: len(x) - span], x[span:])
        span *= 2
    rest = w - span
    return pick(x[: len(x) - rest], x[rest:]) if rest else x


def _scan(b: np.ndarray, off: np.ndarray, length: int):
    """For slices of the window starts: (start of slice, hash of each anchor
    place, smallest hash of each window; 0 where a window crosses texts)."""
    w = length - ANCHOR + 1
    last = np.repeat(off[1:], np.diff(off)) if len(b) else off[:0]
    n = len(b) - length + 1
    for s in range(0, max(n, 0), ke.SLICE_BYTES):
        e = min(n, s + ke.SLICE_BYTES)
        c, pi = ke.prefix_sums(b[s : e + length - 1])
        places = e - s + w - 1
        h = ke.mix((c[ANCHOR : ANCHOR + places] - c[:places]) * pi[:places]) | np.uint64(1)
        least = _sliding(h, w, np.minimum)
        least[np.arange(s + length, e + length) > last[s:e]] = 0
        yield s, h, least


def _anchors(b, off, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of all anchors of all windows, by place."""
    w = length - ANCHOR + 1
    pos, key = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for s, h, least in _scan(b, off, length):
        padded = np.zeros(len(h) + w - 1, np.uint64)
        padded[w - 1 : w - 1 + len(least)] = least
        # a place is an anchor if it is the smallest of any window that holds it
        reach = _sliding_equal(h, padded, w)
        at = np.flatnonzero(reach)
        pos.append(at + s)
        key.append(h[at])
    p, k = np.concatenate(pos), np.concatenate(key)
    p, i = np.unique(p, return_index=True)
    return p, k[i]


def _sliding_equal(h, padded, w):
    return _sliding(padded, w, np.maximum)[: len(h)] == h


def _split(key: np.ndarray, n_buckets: int) -> tuple[np.ndarray, np.ndarray]:
    return ((key >> np.uint64(8)) % np.uint64(n_buckets)).astype(np.int32), (key >> np.uint64(32)).astype(np.uint32)


def _usable(docs: pa.Table, answers: pa.Table):
    b, off = ke.text_buffer(docs["text"])
    ids = docs["id"].to_numpy(zero_copy_only=False)
    copy = gr.is_copy(docs["th"].to_numpy(), answers)
    skip = copy | np.asarray(docs["id"].is_null())
    # copies take no part: leave their bytes out of the scan
    keep = np.flatnonzero(~skip)
    size = np.diff(off)
    sub_off = np.concatenate([[0], np.cumsum(size[keep])]).astype(np.int64)
    sub = np.concatenate([b[off[i] : off[i + 1]] for i in keep]) if len(keep) else b[:0]
    return b, off, ids, copy, keep, sub, sub_off


def send_anchors(docs: pa.Table, answers: pa.Table, length: int, n_buckets: int) -> pa.Table:
    _, _, ids, _, keep, b, off = _usable(docs, answers)
    pos, key = _anchors(b, off, length)
    bucket, rest = _split(key, n_buckets)
    order, new = ke.unique_rows(bucket, rest)
    if len(new) == 0:
        return gr.messages(0, np.zeros(0, np.int32))
    owner = ids[keep][np.searchsorted(off, pos[order], side="right") - 1]
    multi = np.minimum.reduceat(owner, new) != np.maximum.reduceat(owner, new)
    count = np.diff(np.append(new, len(order)))
    i = order[new]
    return gr.messages(docs["g"][0].as_py(), bucket[i], rest[i], multi.astype(np.uint8), np.minimum(count, 65535).astype(np.uint16))


def shared_anchors(sent: pa.Table, hot: int) -> pa.Table:
    """Answer each group with its keys that two documents have; kind "hot" if
    they occur more than ``hot`` times, else "anchor"."""
    sent = sent.sort_by("g")
    keys = [np.frombuffer(x, np.uint32) for x in sent["a"].to_pylist()]
    flat = np.concatenate(keys)
    multi = np.frombuffer(b"".join(sent["b"].to_pylist()), np.uint8)
    count = np.frombuffer(b"".join(sent["c"].to_pylist()), np.uint16)
    order, new = ke.unique_rows(flat)
    groups = np.diff(np.append(new, len(order)))
    shared = (groups > 1) | (np.maximum.reduceat(multi[order], new) > 0)
    often = shared & (np.add.reduceat(count[order].astype(np.int64), new) > hot)
    kind_of = np.empty(len(order), np.int8)
    kind_of[order] = np.repeat(shared.astype(np.int8) + often, groups)
    cols: dict[str, list] = {k: [] for k in ("g", "bucket", "kind", "a", "b", "c", "d")}
    at = 0
    for g, k in zip(sent["g"].to_pylist(), keys):
        mine = kind_of[at : at + len(k)]
        at += len(k)
        for code, name in ((1, "anchor"), (2, "hot")):
            hit = k[mine == code]
            if len(hit):
                for col, v in zip(cols, (g, sent["bucket"][0].as_py(), name, hit.tobytes(), None, None, None)):
                    cols[col].append(v)
    return gr.message_table(cols)


def _known(answers: pa.Table, kind: str) -> np.ndarray:
    parts = [np.uint64(k) << np.uint64(32) | np.frombuffer(a, np.uint32).astype(np.uint64) for k, a, *_ in gr.answers_of(answers, kind)]
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def _member(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(x), bool)
    i = np.minimum(np.searchsorted(known, x), len(known) - 1)
    return known[i] == x


def _row_prints(mat: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128-bit print of each row's bytes."""
    table, p, _ = ke._tables(mat.shape[1] + 1)
    lo, hi = np.empty(len(mat), np.uint64), np.empty(len(mat), np.uint64)
    other = ke.mix(p[: mat.shape[1]]) | np.uint64(1)
    for s in range(0, len(mat), 20_000):
        t = table[mat[s : s + 20_000]]
        lo[s : s + 20_000] = ke.mix((t * p[: mat.shape[1]]).sum(axis=1, dtype=np.uint64) + size[s : s + 20_000].astype(np.uint64))
        hi[s : s + 20_000] = ke.mix((t * other).sum(axis=1, dtype=np.uint64) + size[s : s + 20_000].astype(np.uint64))
    return lo, hi


def _contexts(docs, answers, length: int, n_buckets: int):
    """The group's shared contexts in their order, and its hot windows."""
    b0, off0, ids, copy, keep, b, off = _usable(docs, answers)
    pos, key = _anchors(b, off, length)
    bucket, rest = _split(key, n_buckets)
    full = (bucket.astype(np.uint64) << np.uint64(32)) | rest
    hit = _member(full, _known(answers, "anchor"))
    pos, bucket, rest = pos[hit], bucket[hit], rest[hit]
    text = np.searchsorted(off, pos, side="right") - 1
    lo = np.maximum(off[text], pos - (length - ANCHOR))
    hi = np.minimum(off[text + 1], pos + length)
    width = 2 * length - ANCHOR
    mat = np.zeros((len(pos), width), np.uint8)
    for s in range(0, len(pos), 20_000):
        at = lo[s : s + 20_000, None] + np.arange(width)
        inside = at < hi[s : s + 20_000, None]
        mat[s : s + 20_000] = np.where(inside, b[np.minimum(at, len(b) - 1)], 0)
    shape = np.stack([pos - lo, hi - lo], axis=1).astype(np.uint8)
    print_lo, print_hi = _row_prints(mat, shape[:, 0].astype(np.int64) * 256 + shape[:, 1])
    order, new = ke.unique_rows(bucket, rest, print_lo, print_hi)
    owner = ids[keep][text]
    contexts = (bucket, rest, shape, mat, lo, owner, order, new)
    # windows whose smallest anchor is hot
    hot = _known(answers, "hot")
    at, w_lo, w_hi = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    if len(hot):
        for s, _, least in _scan(b, off, length):
            bk, rs = _split(least, n_buckets)
            mine = np.flatnonzero((least > 0) & _member((bk.astype(np.uint64) << np.uint64(32)) | rs, hot))
            for t in range(0, len(mine), 20_000):
                p = mine[t : t + 20_000] + s
                x = b[p[:, None] + np.arange(length)]
                u, v = _row_prints(x, np.full(len(x), length))
                at.append(p)
                w_lo.append(u)
                w_hi.append(v)
    at, w_lo, w_hi = np.concatenate(at), np.concatenate(w_lo), np.concatenate(w_hi)
    w_bucket = (n_buckets + (w_lo % np.uint64(n_buckets)).astype(np.int64)).astype(np.int32)
    w_order, w_new = ke.unique_rows(w_bucket, w_lo, w_hi)
    w_owner = ids[keep][np.searchsorted(off, at, side="right") - 1]
    return b0, off0, ids, copy, keep, off, contexts, (at, w_lo, w_hi, w_bucket, w_owner, w_order, w_new)


def send_contexts(docs: pa.Table, answers: pa.Table, length: int, n_buckets: int) -> pa.Table:
    *_, contexts, windows = _contexts(docs, answers, length, n_buckets)
    g = docs["g"][0].as_py()
    bucket, rest, shape, mat, _, owner, order, new = contexts
    out = []
    if len(new):
        span = np.empty(len(new), _RANGE)
        span["lo"] = np.minimum.reduceat(owner[order], new)
        span["hi"] = np.maximum.reduceat(owner[order], new)
        i = order[new]
        rows = np.ascontiguousarray(mat[i]).view(f"V{mat.shape[1]}").ravel()
        out.append(gr.messages(g, bucket[i], rest[i], np.ascontiguousarray(shape[i]).view("V2").ravel(), rows, span))
    _, w_lo, w_hi, w_bucket, w_owner, w_order, w_new = windows
    if len(w_new):
        i = w_order[w_new]
        out.append(gr.messages(g, w_bucket[i], w_lo[i], w_hi[i], np.minimum.reduceat(w_owner[w_order], w_new)))
    return pa.concat_tables(out) if out else gr.messages(g, np.zeros(0, np.int32))


def interval_tree(lcp: np.ndarray, left: np.ndarray, low: np.ndarray, shortest: int) -> list[tuple[int, int, int, int]]:
    """Maximal repeats of one sorted run of suffixes by a stack scan.

    ``lcp[i]`` is the common prefix of suffixes i - 1 and i, ``left`` the byte
    before each suffix (-1: none) and ``low`` its smallest document. Returns (first, last, length, smallest document) of every
    interval of common prefix ``shortest`` or more, with two suffixes at least,
    whose left bytes differ.
    """
    out = []
    stack: list[list[int]] = []  # [length, first, smallest document, left byte or -2 if they differ]
    n = len(low)
    for i in range(1, n + 1):
        here = int(lcp[i]) if i < n else 0
        first, least, side = i - 1, int(low[i - 1]), int(left[i - 1])
        if side == -1:
            side = -2
        while stack and stack[-1][0] > here:
            length, start, m, sd = stack.pop()
            m = min(m, least)
            sd = sd if sd == side else -2
            if sd == -2:
                out.append((start, i - 1, length, m))
            first, least, side = start, m, sd
        if here < shortest:
            stack.clear()
        elif stack and stack[-1][0] == here:
            top = stack[-1]
            top[2] = min(top[2], least)
            top[3] = top[3] if top[3] == side else -2
        else:
            stack.append([here, first, least, side])
    return out


def _suffixes(mat, shape, length: int):
    """(context, start) of all suffixes that hold a window with the anchor,
    and the hash of their first ``length`` bytes."""
    ctx, start, prints = [], [], []
    most = length - ANCHOR + 1
    for s in range(0, len(mat), 20_000):
        m = mat[s : s + 20_000]
        table, p, pi = ke._tables(m.shape[1] + 1)
        c = np.zeros((len(m), m.shape[1] + 1), np.uint64)
        np.cumsum(table[m] * p[: m.shape[1]], axis=1, out=c[:, 1:])
        h = ke.mix((c[:, length : length + most] - c[:, :most]) * pi[:most])
        at = np.arange(most)
        ok = (at <= shape[s : s + 20_000, :1]) & (at + length <= shape[s : s + 20_000, 1:])
        i, j = np.nonzero(ok)
        ctx.append(i + s)
        start.append(j)
        prints.append(h[i, j])
    return np.concatenate(ctx), np.concatenate(start), np.concatenate(prints)


def _repeats(rest, mat, shape, low, high, length: int):
    """(context, from, to, smallest document) for distinct contexts."""
    # a context that several documents have is a repeat as a whole
    whole = np.flatnonzero((low < high) & (shape[:, 1] >= length))
    found = [(whole, np.zeros(len(whole), np.int64), shape[whole, 1].astype(np.int64), low[whole])]
    _, group, size = np.unique(rest, return_inverse=True, return_counts=True)
    varied = np.flatnonzero(size[group] > 1)
    if len(varied):
        ctx, start, h = _suffixes(mat[varied], shape[varied], length)
        ctx = varied[ctx]
        _, g, n = np.unique(h, return_inverse=True, return_counts=True)
        m = n[g] > 1
        ctx, start, h = ctx[m], start[m], h[m]
        # suffix array: by the first ``length`` bytes, then by what follows
        width = mat.shape[1] - length
        at = start[:, None] + length + np.arange(width)
        tail_len = shape[ctx, 1].astype(np.int64) - start - length
        tail = np.where(np.arange(width) < tail_len[:, None], mat[ctx[:, None], np.minimum(at, mat.shape[1] - 1)], 0).astype(np.uint8)
        padded = np.zeros((len(tail), -(-width // 8) * 8), np.uint8)
        padded[:, :width] = tail
        words = padded.view(">u8").astype(np.uint64)
        order = np.lexsort([*(words[:, j] for j in range(words.shape[1] - 1, -1, -1)), h])
        ctx, start, h, tail, tail_len = ctx[order], start[order], h[order], tail[order], tail_len[order]
        same = np.cumprod(tail[1:] == tail[:-1], axis=1, dtype=np.int8).sum(axis=1) if len(h) else np.zeros(0, np.int64)
        lcp = np.zeros(len(h), np.int64)
        lcp[1:] = np.where(h[1:] == h[:-1], length + np.minimum(same, np.minimum(tail_len[1:], tail_len[:-1])), 0)
        left = np.where(start > 0, mat[ctx, np.maximum(start - 1, 0)].astype(np.int64), -1)
        lo = low[ctx]
        cut = np.flatnonzero(lcp == 0)
        ends = np.append(cut[1:], len(lcp))
        if len(cut):
            # no maximal repeat starts here if all left bytes agree; nothing to remove if all have one smallest document
            diverse = (np.minimum.reduceat(left, cut) != np.maximum.reduceat(left, cut)) | (np.minimum.reduceat(left, cut) == -1)
            diverse &= np.minimum.reduceat(lo, cut) != np.maximum.reduceat(lo, cut)
            nodes = []
            for s, e in zip(cut[diverse].tolist(), ends[diverse].tolist()):
                if e - s == 2:
                    nodes.append((s, s + 1, int(lcp[s + 1]), int(min(lo[s], lo[s + 1]))))
                else:
                    nodes += [(s + a, s + z, d, m) for a, z, d, m in interval_tree(lcp[s:e], left[s:e], lo[s:e], length)]
            if nodes:
                a, z, d, m = (np.array(x, np.int64) for x in zip(*nodes))
                size = z - a + 1
                i = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(a, size)
                d, m = np.repeat(d, size), np.repeat(m, size)
                later = lo[i] > m
                i, d, m = i[later], d[later], m[later]
                found.append((ctx[i], start[i], start[i] + d, m))
    return [np.concatenate(x) for x in zip(*found)]


def answer_repeats(sent: pa.Table, length: int, n_buckets: int) -> pa.Table:
    bucket = sent["bucket"][0].as_py()
    if bucket >= n_buckets:
        return least_owner(sent)
    sent = sent.sort_by("g")
    raw = [sent[c].to_pylist() for c in "abcd"]
    rest = np.frombuffer(b"".join(raw[0]), np.uint32)
    shape = np.frombuffer(b"".join(raw[1]), np.uint8).reshape(-1, 2)
    mat = np.frombuffer(b"".join(raw[2]), np.uint8).reshape(len(rest), -1)
    span = np.frombuffer(b"".join(raw[3]), _RANGE)
    p_lo, p_hi = _row_prints(mat, shape[:, 0].astype(np.int64) * 256 + shape[:, 1])
    order, new = ke.unique_rows(rest, p_lo, p_hi)
    size = np.diff(np.append(new, len(order)))
    low = np.minimum.reduceat(span["lo"][order], new)
    high = np.maximum.reduceat(span["hi"][order], new)
    i = order[new]
    ctx, start, end, least = _repeats(rest[i], mat[i], shape[i], low, high, length)
    # to every group that sent the context and holds a document beyond the smallest
    n = size[ctx]
    at = order[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(new[ctx], n)]
    start, end, least = np.repeat(start, n), np.repeat(end, n), np.repeat(least, n)
    later = span["hi"][at] > least
    at, start, end, least = at[later], start[later], end[later], least[later]
    o = np.argsort(at, kind="stable")
    at, start, end, least = at[o], start[o], end[o], least[o]
    first = np.cumsum([0] + [len(x) // 4 for x in raw[0]])
    cut = np.searchsorted(at, first)
    cols: dict[str, list] = {k: [] for k in ("g", "bucket", "kind", "a", "b", "c", "d")}
    for j, g in enumerate(sent["g"].to_pylist()):
        s, e = cut[j], cut[j + 1]
        if s < e:
            pair = np.stack([start[s:e], end[s:e]], axis=1).astype(np.uint8)
            for name, v in zip(cols, (g, bucket, "repeat", (at[s:e] - first[j]).astype(np.uint32).tobytes(), pair.tobytes(), least[s:e].tobytes(), None)):
                cols[name].append(v)
    return gr.message_table(cols)


def remove_repeats(docs: pa.Table, answers: pa.Table, length: int, n_buckets: int) -> pa.Table:
    b, off, ids, copy, keep, sub_off, contexts, windows = _contexts(docs, answers, length, n_buckets)
    edge = np.zeros(int(sub_off[-1]) + 1, np.int32)
    bucket, _, _, _, lo, owner, order, new = contexts
    if len(new):
        size = np.diff(np.append(new, len(order)))
        begin = bucket[order[new]]
        for k, a, pair, least, _ in gr.answers_of(answers, "repeat"):
            which = np.searchsorted(begin, k) + np.frombuffer(a, np.uint32)
            pair = np.frombuffer(pair, np.uint8).reshape(-1, 2).astype(np.int64)
            least = np.frombuffer(least, np.int64)
            n = size[which]
            at = order[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(new[which], n)]
            later = owner[at] > np.repeat(least, n)
            p = np.repeat(pair, n, axis=0)[later]
            np.add.at(edge, lo[at[later]] + p[:, 0], 1)
            np.add.at(edge, lo[at[later]] + p[:, 1], -1)
    at, _, _, w_bucket, w_owner, w_order, w_new = windows
    if len(w_new):
        least = np.minimum.reduceat(w_owner[w_order], w_new)
        begin = w_bucket[w_order[w_new]]
        for k, a, c, *_ in gr.answers_of(answers, "least"):
            least[np.searchsorted(begin, k) + np.frombuffer(a, np.uint32)] = np.frombuffer(c, np.int64)
        overall = np.empty(len(w_order), np.int64)
        overall[w_order] = np.repeat(least, np.diff(np.append(w_new, len(w_order))))
        later = at[overall < w_owner]
        np.add.at(edge, later, 1)
        np.add.at(edge, later + length, -1)
    gone_sub = np.cumsum(edge[:-1]) > 0
    gone = np.zeros(len(b), bool)
    n_bytes = np.diff(off)
    for j, i in enumerate(keep):
        gone[off[i] : off[i + 1]] = gone_sub[sub_off[j] : sub_off[j + 1]]
    for i in np.flatnonzero(copy & (n_bytes >= length)):
        gone[off[i] : off[i + 1]] = True
    begins = np.zeros(len(b) + 1, bool)
    begins[off] = True
    if len(b):
        s = np.flatnonzero(gone & np.concatenate([[True], ~gone[:-1] | begins[1 : len(b)]]))
        e = np.flatnonzero(gone & np.concatenate([~gone[1:] | begins[1 : len(b)], [True]])) + 1
    else:
        s = e = np.zeros(0, np.int64)
    text = np.searchsorted(off, s, side="right") - 1
    spans = pa.ListArray.from_arrays(
        pa.array(np.searchsorted(s, off), pa.int32()),
        pa.StructArray.from_arrays([pa.array(s - off[text], pa.int64()), pa.array(e - s, pa.int64())], ["start", "length"]),
    )
    kept = np.concatenate([[0], np.cumsum(~gone, dtype=np.int64)])[off]
    return pa.table({
        "id": docs["id"].combine_chunks(), "n_bytes": pa.array(n_bytes, pa.int64()),
        "spans": spans, "kept": ke.binary_column(b[~gone], kept).cast(pa.binary()),
    })


def remove_repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50, hot: int = HOT,
                          group_bytes: int = gr.GROUP_BYTES, bucket_bytes: int = gr.BUCKET_BYTES) -> DataFrame:
    """Remove every byte covered by a ``length``-byte string that also starts
    in a document with a smaller id.

    Texts are UTF-8 bytes; matches never cross documents, may overlap, and are
    judged on the input, not on what is left. Returns one row per input row:
    ``id``, ``n_bytes``, ``spans`` (maximal removed runs) and ``kept`` (binary:
    a run may cut a character). ``length`` must lie between 32 and 120, so
    that a context's places fit a byte.

    Defined cases: a null or empty text has no bytes; texts shorter than
    ``length`` lose nothing; rows that repeat an id don't remove from one
    another; a row with a null id neither loses bytes nor counts as a source;
    an empty table gives an empty result; other columns are ignored.
    """
    if not 32 <= length <= 120:
        raise ValueError("length must lie between 32 and 120 bytes")
    gd = gr.grouped(docs, id_col, text_col, group_bytes, bucket_bytes)
    nb = gd.n_buckets
    sent = gr.round_of(gd.docs, gd.copies, lambda d, a: send_anchors(d, a, length, nb), gr.MESSAGE)
    known = gd.copies.unionByName(gr.exchange(sent, lambda m: shared_anchors(m, hot)))
    sent = gr.round_of(gd.docs, known, lambda d, a: send_contexts(d, a, length, nb), gr.MESSAGE)
    known = known.unionByName(gr.exchange(sent, lambda m: answer_repeats(m, length, nb)))
    return gr.round_of(gd.docs, known, lambda d, a: remove_repeats(d, a, length, nb), RESULT)
