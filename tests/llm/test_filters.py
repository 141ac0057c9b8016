"""Quality rules, URL filters, sharding, WARC and top-k."""

import gzip
import random
from collections import Counter

import numpy as np
import pytest
from helpers import quality_base, sha
from pyspark.sql import functions as F

from stratafac.llm import quality, queries, sharding, topk, url_filter, warc
from stratafac.session import scratch_path


def test_quality_features_equal_brute_force(make_docs):
    texts = [
        None, "", " \n\t ", "one", "a b c a b c", "a a a a", "x\nx\n\n x\nx \ny|z#", "é日本 ## $%&*<>| \x0b\x0c w", "a b\x1cc a b\x1cc a b\x1cc",
        " ".join(random.Random(1).choice("abcd") for _ in range(4000)), "l1 m\nl1 m\nl1 m\n",
    ]
    out = quality.features(make_docs(list(enumerate(texts))).withColumn("_words", F.lit(1))).collect()
    for r in out:
        got = (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"])
        assert got == quality_base(texts[r["doc_id"]]), r["doc_id"]


def test_label_model_recovers_planted_accuracies():
    rng = random.Random(5)
    good, bad = (0.95, 0.9, 0.97, 0.93), (0.7, 0.5, 0.8, 0.6)
    seen, truth = Counter(), Counter()
    for _ in range(20_000):
        is_good = rng.random() < 0.8
        v = "".join("0" if rng.random() < 0.1 else "+" if rng.random() < (g if is_good else 1 - b) else "-" for g, b in zip(good, bad))
        seen[v] += 1
        truth[v, is_good] += 1
    model = quality.fit(seen, 4)
    assert abs(model.prior - 0.8) < 0.05
    assert max(abs(a - b) for a, b in zip(model.right_good, good)) < 0.05
    assert max(abs(a - b) for a, b in zip(model.right_bad, bad)) < 0.12
    right = sum(n for (v, g), n in truth.items() if (model.posterior(v) >= 0.5) == g)
    assert right / 20_000 > 0.9


def test_quality_empty_and_single_pattern(spark, make_docs):
    empty = quality.features(make_docs([(1, "x")]).where("false"))
    assert quality.weakly_supervised(empty).collect() == []
    same = quality.weakly_supervised(quality.features(make_docs([(i, "good words here. " * 20) for i in range(5)])))
    assert [r["votes"] for r in same.select("votes").distinct().collect()] and same.count() == 5


def test_quality_held_out_labels(spark):
    """The label model never sees labels; they agree with it."""
    sf = "/root/testdata/sf0.01"
    out = queries.op9_weak_supervision(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("not base_failed")
    agree = out.where((F.col("quality") == 1) == F.col("kept")).count()
    assert agree >= 0.98 * out.count()


URLS = [
    (1, "http://Example.NET/en/1", "example.net", "/en/1", "example.net/en/", "allow"),
    (2, "https://a.example.net/fr/", "a.example.net", "/fr/", "net/", "block"),
    (3, "http://badexample.net/en/", "badexample.net", "/en/", "net/", "block"),
    (4, "http://m.example.com/de/x?y#z", "m.example.com", "/de/x", "example.com/de/", "block"),
    (5, "ftp://x.org/fr/9#t?q", "x.org", "/fr/9", "org/fr/", "allow"),
    (6, "http://net", "net", "", None, None),
    (7, "http://x.net?a=/b", "x.net", "", None, None),
    (8, "no scheme.net/en/", "", "", None, None),
    (9, None, "", "", None, None),
    (10, "", "", "", None, None),
    (11, "a://b://c.net/x", "b:", "//c.net/x", None, None),
    (12, "http://ÉX.net/É", "Éx.net", "/É", "net/", "block"),
    (13, "http://x.com/" + "y/" * 5000, "x.com", "/" + "y/" * 5000, None, None),
    (13, "http://x.com/z", "x.com", "/z", None, None),
]


def test_url_rules(spark):
    urls = spark.createDataFrame([(u[0], u[1], "h", "s") for u in URLS], "page_id long, url string, host string, suffix string")
    model = url_filter.UrlModel(None, None, 0.0)
    out = url_filter.judge(urls, queries.URL_RULES, model).collect()
    want = sorted((u[0], u[2], u[3], u[4] or "", u[5] or "allow") for u in URLS)
    assert sorted((r["id"], r["host"], r["path"], r["rule"] or "", r["verdict"]) for r in out) == want
    assert url_filter.judge(urls.where("false"), queries.URL_RULES, model).collect() == []


def test_url_trees_held_out_accuracy(spark):
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    rows = []
    for i in range(3000):
        if rng.random() < 0.4:
            rows.append((f"http://{word(5)}-{rng.randint(10**6, 10**9)}.{rng.choice(['xyz', 'top', 'com'])}/{word(4)}?id={rng.randint(0, 10**9)}&s={rng.randint(0, 10**6)}&k=%20", 1))
        else:
            rows.append((f"https://www.{word(7)}.{rng.choice(['org', 'com', 'com'])}/{word(6)}/{word(5)}", 0))
    df = spark.createDataFrame(rows, "url string, label int")
    data = url_filter.lexical(url_filter.with_parts(df))
    train, test = data.where("pmod(hash(url), 4) > 0"), data.where("pmod(hash(url), 4) = 0")
    model = url_filter.train(train, fit_rows=1500)
    out = model.scored(test)
    assert out.where("blocked = label").count() >= 0.97 * test.count()
    assert abs(data.where("url like 'https%'").agg(F.avg("depth")).first()[0] - 2) < 1e-9


def test_url_undecided_are_no_allow_labels(spark):
    rng = random.Random(4)
    rows = []
    for i in range(2400):  # spam hosts: a third is listed (by /de/), the rest is undecided
        if i % 2:
            rows.append((i, f"http://win-{rng.randint(10**6, 10**8)}-bet.example.com/{rng.choice(['de', 'en', 'es'])}/{rng.randint(1, 999)}", True))
        else:
            rows.append((i, f"http://{''.join(rng.choice('abcdefgh') for _ in range(8))}.example.com/{rng.choice(['fr', 'en', 'es'])}/{rng.randint(1, 999)}", False))
    urls = spark.createDataFrame(rows, "page_id long, url string, spam boolean")
    labelled = url_filter.labelled_by_rules(urls, queries.URL_RULES)
    undecided = sum("/de/" not in u for _, u, _ in rows)
    assert labelled.where("label is null").count() == undecided
    out = url_filter.judge(urls, queries.URL_RULES, url_filter.train(labelled)).join(urls.withColumnRenamed("page_id", "id"), "id").where("rule is null")
    got = {(r["spam"], r["verdict"]): r["count"] for r in out.groupBy("spam", "verdict").count().collect()}
    assert sum(got.values()) == undecided
    assert got.get((True, "block"), 0) >= 0.7 * (got.get((True, "block"), 0) + got.get((True, "allow"), 0))
    assert got[False, "allow"] >= 0.95 * (got[False, "allow"] + got.get((False, "block"), 0))


def test_url_rules_equal_brute_force(spark):
    """Random URLs and rules against splitting by hand."""
    rng = random.Random(12)
    rules = tuple(url_filter.UrlRule(h, p, rng.choice(["allow", "block"])) for h in ("a", "b.a", "c.b.a", "b", "a.b") for p in ("/", "/x", "/x/y"))
    pieces = ["a", "b", "c", ".", ".", "/", "/", "x", "y", "?", "#", "://", "A", "%", "é", " "]
    urls = ["".join(rng.choice(["http://", "://", "", "H://"]) + "".join(rng.choice(pieces) for _ in range(rng.randint(0, 12)))) for _ in range(1500)]
    urls += [f"http://{rng.choice(['', 'c.', 'X.', 'ba'])}{r.host}{r.path}{rng.choice(['', 'y', '/z?q'])}" for r in rules for _ in range(20)] + [None, ""]

    def judged(url):
        rest = (url or "").partition("://")[2]
        end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
        path = rest[end:]
        path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
        fit = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        longest = max(fit, key=lambda r: len(r.name), default=None)
        return host, path, longest and longest.name, longest.verdict if longest else "allow"

    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(df, rules, url_filter.UrlModel(None, None, 0.0)).collect()}
    assert got == {i: judged(u) for i, u in enumerate(urls)}
    assert sum(v[2] is not None for v in got.values()) > 200


def test_url_rare_suffixes_keep_their_statistics(spark):
    """Suffixes beyond the broadcast ones have the same statistics as with all of them broadcast."""
    rng = random.Random(8)
    rows = [(f"http://h{rng.randint(0, 40)}.t{min(rng.randint(0, 30), rng.randint(0, 30))}/{i}", rng.random() < 0.3) for i in range(600)] + [(None, False)]
    df = url_filter.lexical(url_filter.with_parts(spark.createDataFrame(rows, "url string, bad boolean"))).withColumn("label", F.col("bad").cast("double"))
    data = df.withColumn("_fold", url_filter._fold())
    seen = []
    for frequent in (5, 100):
        found = url_filter._suffixes(data, 0.3, frequent)
        assert (found.others is None) == (frequent == 100)
        out = url_filter._with_statistics(data, found, 0.3).select("url", "suffix", "_fold", "_rates", "_counts").collect()
        assert len(out) == len(rows) and all(min(r["_counts"]) >= 0 for r in out)
        seen.append(sorted(map(str, out)))
    assert seen[0] == seen[1]


def test_url_cut():
    unlabelled = [(0.05, None)] * 20
    assert url_filter._cut([(0.4, 1.0), (0.2, 1.0), *unlabelled]) == pytest.approx(0.15)
    cut = url_filter._cut([(0.4, 1.0), (0.2, 1.0), (0.2, 0.0), (0.3, 0.0), (0.3, 0.0), *unlabelled])
    assert 0.3 < cut < 0.4
    assert url_filter._cut([(0.1, 1.0), (0.3, 0.0)]) == url_filter._cut([(0.1, None)]) == 0.5


def test_url_folds_of_one_class(spark):
    one_host = [(i, f"http://a.example.com/{x}/{i}") for i, x in enumerate(["de", "en"] * 20)]
    urls = spark.createDataFrame(one_host, "page_id long, url string")
    model = url_filter.train(url_filter.labelled_by_rules(urls, queries.URL_RULES))
    assert url_filter.judge(urls, queries.URL_RULES, model).where("rule is null").count() == 20


def test_url_training_degenerate(spark):
    one = url_filter.lexical(url_filter.with_parts(spark.createDataFrame([("http://a.b/", 1.0)], "url string, label double")))
    assert url_filter.train(one).rate == 1.0
    assert url_filter.train(one.where("false")).rate == 0.0


def test_entropy(spark):
    df = url_filter.lexical(url_filter.with_parts(spark.createDataFrame([("aabb",), ("",), (None,), ("abcd",)], "url string")))
    got = {r["url"]: r["entropy"] for r in df.collect()}
    assert got == {"aabb": 1.0, "": 0.0, None: 0.0, "abcd": 2.0}


def test_shards_are_proportional(spark, make_docs):
    rng = random.Random(8)
    rows = [(i, "t" * rng.randint(0, 9), rng.choice(["hot"] * 6 + ["a", "b", None])) for i in range(1000)] + [(None, "n", "a"), (7, "dup", "a"), (7, "dup", "a")]
    docs = spark.createDataFrame([(i, t, s, 1, 2) for i, t, s in rows], "doc_id long, text string, source string, shard int, _rank int")
    out = sharding.interleaved_shards(docs, 24, range_rows=50, carry={"size": F.length("text")}).collect()
    n = Counter(r["shard"] for r in out)
    assert len(out) == len(rows) and sorted(n) == list(range(24)) and max(n.values()) - min(n.values()) <= 1
    for s in n:
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(n[s]))
    per = Counter((r["source"], r["shard"]) for r in out)
    size = Counter(s for _, _, s in rows)
    for s in size:
        assert all(abs(per[s, k] - size[s] / 24) <= 2 for k in range(24))
    again = sharding.interleaved_shards(docs.repartition(5), 24, range_rows=50).where("id is not null and id <> 7").collect()
    assert {(r["id"], r["shard"], r["slot"]) for r in again} == {(r["id"], r["shard"], r["slot"]) for r in out if r["id"] not in (None, 7)}


def test_shards_small_and_empty(spark, make_docs):
    assert sharding.interleaved_shards(make_docs([(1, "x")]).where("false"), 24).collect() == []
    few = sharding.interleaved_shards(make_docs([(i, "x") for i in range(5)]), 24).collect()
    assert len({r["shard"] for r in few}) == 5 and {r["slot"] for r in few} == {0}


def test_warc_round_trip(spark):
    big, html = "payload " * 20, "<p>WARC/1.1\r\nContent-Length: 5\r\n\r\nx</p>\r\n\r\n" * 4
    rows = [(5, "http://a/1", big), (3, "http://a/2\r\nX: y z", big), (9, None, big), (1, "u", "tiny"), (2, "u", "tiny"), (4, "u", None), (6, "u", ""),
            (7, "u", html), (8, "é", "日本" * 30), (10, "u", "z" * 3_000_000), (None, "u", big), (11, "u", "a" * 99), (12, "u", "a" * 99), (13, "u", "b" * 100), (14, "u", "b" * 100)]
    pages = spark.createDataFrame([(i, u, h, "x", 1) for i, u, h in rows], "page_id long, url string, html string, digest string, first int")
    records = warc.read_records(spark, warc.archived(pages))
    out = sorted(map(tuple, warc.capture_digests(records).collect()), key=str)
    want = []
    for i, u, h in rows:
        h = h or ""
        same = [j for j, _, t in rows if (t or "") == h and j is not None]
        first = min(same) if len(h.encode()) >= 100 else i
        again = first != i
        want.append((i, len(h.encode()), sha(h), "revisit" if again else "response", first if again else None))
    assert out == sorted(want, key=str)
    whole = warc.assemble(records).collect()
    assert len(whole) == len(rows)
    for r in whole:
        assert len(r["requests"]) == 1 and len(r["metadata"]) == 1 and r["response"]["record_id"] == r["capture_id"]
    payloads = {bytes(r["response"]["payload"]).decode() for r in whole if r["response"]["type"] == "response"}
    assert payloads == {h or "" for _, _, h in rows}


def test_warc_repeated_rows_and_empty(spark):
    rows = [(1, "u", "x" * 200)] * 2 + [(1, "v", "x" * 200)] + [(3, "w", "y" * 150)] * 2500 + [(4, "w", "z")] * 3 + [(None, None, None)] * 2
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    out = Counter(tuple(r) for r in warc.capture_digests(warc.read_records(spark, warc.archived(pages))).collect())
    big, mid = sha("x" * 200), sha("y" * 150)
    assert out == {
        (1, 200, big, "response", None): 1, (1, 200, big, "revisit", 1): 2, (3, 150, mid, "response", None): 1, (3, 150, mid, "revisit", 3): 2499,
        (4, 1, sha("z"), "response", None): 3, (None, 0, sha(""), "response", None): 2,
    }
    assert warc.capture_digests(warc.read_records(spark, warc.archived(pages.where("false")))).collect() == []


def test_warc_parser_takes_members_plain_and_broken_files():
    one = b"WARC/1.1\r\nWARC-Type: metadata\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    plain = [(h["warc-type"], b) for h, b in warc.parse_records(one * 3)]
    assert plain == [("metadata", b"abc")] * 3
    assert [b for _, b in warc.parse_records(gzip.compress(one) + gzip.compress(one))] == [b"abc"] * 2
    assert list(warc.parse_records(b"")) == []
    with pytest.raises(ValueError):
        list(warc.parse_records(one[:-7]))


def brute_top(rows, k):
    ok = [(i, np.floor(256 * np.array(v, np.float64)).astype(np.int64)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, q in ok:
        if i % 50 == 0:
            best = sorted(((-int(q @ v), j) for j, v in ok if j != i and len(v) == len(q)))[:k]
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    return sorted(out)


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = [(int(i), rng.integers(-3, 4, 8).astype(float).tolist()) for i in range(400)]
    rows += [(1000, None), (1050, [1.0, None] * 4), (1100, [float("nan")] * 8), (1150, [float("inf")] * 8), (None, [1.0] * 8), (1200, [1.0, 2.0]), (1201, [0.5, 1.0]), (1250, [])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, id int, score int")
    for sizes in ({}, {"block_rows": 16, "group_rows": 64, "chunk_rows": 3}):
        out = topk.top_k(df, F.col("id") % 50 == 0, 5, **sizes).collect()
        assert sorted(tuple(r) for r in out) == brute_top(rows, 5)


def test_top_k_repeats_few_and_empty(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (50, [0.0, 1.0]), (50, [2.0, 1.0]), (50, [2.0, 1.0]), (3, [1.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for k in (2, 5, 20):
        assert sorted(tuple(r) for r in topk.top_k(df, F.col("id") % 50 == 0, k, block_rows=2, group_rows=4, chunk_rows=2).collect()) == brute_top(rows, k)
    assert topk.top_k(df.where("false"), F.col("id") % 50 == 0, 5).collect() == []
    assert topk.top_k(df, F.col("id") > 99, 5).collect() == []


def test_blocks_are_pruned():
    """Blocks whose bound is below the k-th score are not scored, nor are tied ones of larger ids; big integers stay exact."""
    big = 2**30
    high, tied, low = ((np.array(i), np.array(m)) for i, m in (([1, 2], [[big, 5], [big, 6]]), ([7, 8], [[big, 5], [big, 5]]), ([3], [[1, 1]])))
    q_ids, q = np.array([0]), np.array([[big, 1]])
    best, who, scored = topk.search(q_ids, q, [low, tied, high], 2)
    assert (best.tolist(), who.tolist(), scored) == ([[big * big + 6, big * big + 5]], [[2, 1]], 1)
    floor = np.array([big * big + 6]), np.array([9])
    assert topk.search(q_ids, q, [low, tied], 2, floor)[2] == 0
    assert topk.search(np.array([1]), q, [high, tied], 3)[1].tolist() == [[2, 7, 8]]


def test_survivors_are_few_for_clustered_vectors(spark):
    """Neighbours by id are alike: of the pairs of a chunk and a block, few are sent."""
    rng = np.random.default_rng(6)
    rows = [(i, (np.eye(16)[i // 64] * 50 + rng.random(16)).tolist()) for i in range(1024)]
    seen = []
    plain = topk.written

    def watched(df, name):
        out = plain(df, name)
        if name == "topk-pairs":
            seen.append(out.count())
        return out

    topk.written = watched
    try:
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        out = topk.top_k(df, F.col("id") % 50 == 0, 5, block_rows=16, group_rows=64, chunk_rows=2).collect()
    finally:
        topk.written = plain
    assert sorted(tuple(r) for r in out) == brute_top(rows, 5)
    assert seen[0] < 0.25 * 64 * 11


def test_scratch_is_in_the_shared_folder(spark):
    assert scratch_path(spark, "x").startswith(spark.sparkContext.getCheckpointDir())
