"""Byte-level BPE and packing against the libraries themselves."""

import base64
import random
from functools import cache

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from helpers import crc, sha
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from stratafac.llm import byte_bpe, packing
from stratafac.llm.tables import written

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")


@cache
def _library():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@cache
def _vocabulary():
    return byte_bpe.load_vocabulary(byte_bpe.read_ranks(RANKS))


@pytest.fixture
def library():
    return _library()


@pytest.fixture
def vocabulary():
    return _vocabulary()


def encoded(vocabulary, texts, memory=None):
    raw = [t.encode() for t in texts]
    off = np.cumsum([0] + [len(x) for x in raw])
    ids, first = byte_bpe.encode_batch(vocabulary, np.frombuffer(b"".join(raw), np.uint8), off, memory or byte_bpe.Memory())
    return [ids[s:e].tolist() for s, e in zip(first[:-1], first[1:])]


TRICKY = [
    "", " ", "  ", "\n", " \n ", "a", "a  b", "a \n b", "it's we've I'll 'tis ''s 's't'reve don'T", " 's", "\n's", "x's's", "!'s",
    "'ll'l 'd'", "1's 22 ' 3", "日本語 テキスト　全角", "é́́ é", " a  b", "\x1c\x1d a", "🙂🙂 👩‍👩‍👧", "tab\t\ttab \t x", "end  ",
    "a" * 500, "ab" * 300 + "'s" * 50, "." * 200 + " " * 200 + "x", "<|endoftext|> <|x|>", "�\u0000",
]


def test_encoding_equals_the_library(vocabulary, library):
    assert encoded(vocabulary, TRICKY) == [library.encode_ordinary(t) for t in TRICKY]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("'slrevdtm aA1. \n\t é"), st.characters(codec="utf-8")), max_size=40), max_size=4))
def test_encoding_equals_the_library_on_any_text(texts):
    got = encoded(_vocabulary(), texts)
    assert got == [_library().encode_ordinary(t) for t in texts]
    assert [byte_bpe.decode_ids(_vocabulary(), np.array(x, np.int64)).decode() for x in got] == texts


def test_memory_starts_anew_when_full(vocabulary, library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "REMEMBER", 20)
    memory = byte_bpe.Memory()
    rng = random.Random(2)
    for _ in range(5):
        texts = [" ".join("".join(rng.choice("abcxyz") for _ in range(5)) for _ in range(12)) for _ in range(3)]
        assert encoded(vocabulary, texts, memory) == [library.encode_ordinary(t) for t in texts]


def test_long_texts_are_cut_where_tokens_begin(vocabulary, library, monkeypatch):
    text = " ".join(f"word{i}'s  \n 日本" for i in range(3000))
    monkeypatch.setattr(byte_bpe, "BATCH_BYTES", 1000)
    b = np.frombuffer(text.encode(), np.uint8)
    parts = list(byte_bpe._pieces(b))
    assert len(parts) > 10 and b"".join(x.tobytes() for x in parts) == text.encode()
    ids = np.concatenate([byte_bpe.encode_batch(vocabulary, x, np.array([0, len(x)]), byte_bpe.Memory())[0] for x in parts])
    assert ids.tolist() == library.encode_ordinary(text)


def test_digests_and_decoding(make_docs, library):
    rows = [(1, "Hello  world"), (2, None), (3, ""), (4, "x" * 5000), (4, "x" * 5000), (5, " ".join(TRICKY))]
    ranks = byte_bpe.read_ranks(RANKS)
    enc = byte_bpe.encode(make_docs(rows), ranks)
    want = []
    for i, t in rows:
        ids = library.encode_ordinary(t or "")
        want.append((i, len(ids), sha(",".join(map(str, ids))), sha(t or "")))
    assert sorted(map(tuple, byte_bpe.digests(enc, ranks).collect())) == sorted(want)
    assert sorted((r["id"], bytes(r["data"])) for r in byte_bpe.decode(enc, ranks).collect()) == sorted((i, (t or "").encode()) for i, t in rows)


def test_pieces_and_sequences(make_docs):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["Lorem,", "ipsum", "dolor's", "日本", "1234", "É"]) for _ in range(rng.randint(0, 60)))) for i in range(60)]
    rows += [(60, None), (61, ""), (62, "word " * 900), (63, "same text"), (63, "same text")]
    tokenizer = Tokenizer.from_file(WORDS)
    capacity = 128
    out = packing.pack(written(packing.token_pieces(make_docs(rows), WORDS, capacity), "test-pieces"), capacity, rows_per_part=7).collect()
    want = []
    for i, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        want += [(i, p, s, len(ids[s : s + capacity]), crc(ids[s : s + capacity])) for p, s in enumerate(range(0, len(ids), capacity))]
    assert sorted((r["id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == sorted(want)
    filled = {}
    for r in out:
        filled.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for slots in filled.values():
        at = 0
        for o, n in sorted(slots):
            assert o == at
            at += n
        assert at <= capacity
    total = sum(r["length"] for r in out)
    assert len(filled) <= -(-total // capacity) + 1


@settings(max_examples=2000, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 200), max_size=20))
def test_plan_is_best_fit_decreasing(histogram):
    capacity = 64
    slots, opened = packing.plan(histogram, capacity)
    used = [0] * opened
    ranks = {}
    for length, rank, count, first, offset in slots:
        ranks.setdefault(length, []).append((rank, rank + count))
        for s in range(first, first + count):
            assert used[s] == offset
            used[s] += length
    assert all(0 < u <= capacity for u in used)
    for length, parts in ranks.items():
        assert [p for r in parts for p in r] == [0, *(x for r in parts[:-1] for x in (r[1], r[1])), histogram[length]]
    # one piece at a time
    rooms = []
    for length in sorted(histogram, reverse=True):
        for _ in range(histogram[length]):
            fits = [r for r in rooms if r >= length]
            if fits:
                rooms.remove(min(fits))
                rooms.append(min(fits) - length)
            else:
                rooms.append(capacity - length)
    assert opened <= len(rooms)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    ranks = byte_bpe.read_ranks(RANKS)
    assert byte_bpe.digests(byte_bpe.encode(empty, ranks), ranks).collect() == []
    assert packing.pack(written(packing.token_pieces(empty, WORDS), "test-pieces")).collect() == []


def test_word_memory_keeps_ids_over_many_batches(monkeypatch):
    import numpy as np

    from stratafac.llm import kernels as ke

    class Letters:
        """One token per letter."""

        def encode_batch_fast(self, texts, add_special_tokens):
            assert len(set(texts)) == len(texts) and not set(texts) & seen
            seen.update(texts)
            return [type("E", (), {"ids": list(t.encode())})() for t in texts]

    seen = set()
    rng = np.random.default_rng(0)
    memory = packing.WordIds(Letters())
    for k in range(40):
        if k == 25:
            monkeypatch.setattr(packing, "REMEMBER", memory.words)
            seen.clear()
        texts = [" ".join(f"w{rng.integers(30 + 10 * k)}" for _ in range(20)) for _ in range(5)] + [""]
        if k == 25:
            texts[0] += " onceonly"
        raw = "".join(texts).encode()
        off = np.cumsum([0] + [len(t) for t in texts])
        ids, at = memory.ids(np.frombuffer(raw, np.uint8), off)
        assert [bytes(ids[a:z].astype(np.uint8)) for a, z in zip(at, at[1:])] == [t.replace(" ", "").encode() for t in texts]
        if k == 25:
            monkeypatch.setattr(packing, "REMEMBER", 10**6)
    assert len(memory.runs) < 12
