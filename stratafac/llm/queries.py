"""Registered queries of the subpackage and their DuckDB twins.

Each query applies one operator, with production parameters, to its whole
table and derives the contract's digest columns from the operator's output.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratafac.llm import byte_bpe, conversations, filter_audit, near_dup, packing, pitman_yor, quality, repeats, sharding, substring_dedup, topk, url_filter, warc
from stratafac.llm.tables import written

# The contract's URL rules.
URL_RULES = (
    url_filter.UrlRule("net", "/", "block"),
    url_filter.UrlRule("example.net", "/en/", "allow"),
    url_filter.UrlRule("example.com", "/de/", "block"),
    url_filter.UrlRule("org", "/fr/", "allow"),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _removed(spans: str):
    return F.aggregate(spans, F.lit(0).cast("long"), lambda acc, x: acc + x["length"])


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trees are trained on what the rules decide, with all other URLs as unlabelled."""
    urls = table(spark, sf_dir, "pages").select("page_id", "url")
    model = url_filter.train(url_filter.labelled_by_rules(urls, URL_RULES))
    return url_filter.judge(urls, URL_RULES, model).withColumnRenamed("id", "page_id")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.substring_dedup(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_words", _removed("spans").alias("n_removed"), F.sha2("kept_text", 256).alias("kept_sha256"))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")


def op4_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = warc.archived(table(spark, sf_dir, "pages"))
    return warc.capture_digests(warc.read_records(spark, path))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    pieces = packing.token_pieces(table(spark, sf_dir, "documents"), tokenizer, capacity=4096, end_id=1, with_ids=False)
    packed = packing.pack(written(pieces.drop("ids"), "pieces"), capacity=4096)
    return packed.select(F.col("id").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op6_maximal_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeats.remove_repeated_bytes(table(spark, sf_dir, "documents"), length=50)
    return out.select(
        F.col("id").alias("doc_id"),
        "n_bytes",
        _removed("spans").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op7_interleaved_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    carry = {"size": F.octet_length(text).cast("long") + F.lit(8), "text_crc32": F.crc32(text)}
    out = sharding.interleaved_shards(table(spark, sf_dir, "documents"), 24, carry=carry)
    return out.select(
        F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source"
    )


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    encoded = byte_bpe.encode(table(spark, sf_dir, "documents"), ranks)
    return byte_bpe.digests(encoded, ranks).withColumnRenamed("id", "doc_id")


def quality_features(docs: DataFrame) -> DataFrame:
    """The features of every document, written once."""
    return written(quality.features(docs), "quality-features")


#: The contract's base rules, which reject on their own.
BASE_FAILED = "n_words < 50 or 100 * n_repeat_words > 50 * n_words"


def op9_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.weakly_supervised(quality_features(table(spark, sf_dir, "documents")))
    failed = F.expr(BASE_FAILED)
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & F.col("good")).alias("kept"), "votes", "p_good",
    )


def op10_block_pruned_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, k=5)


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    damaged = conversations.damaged(table(spark, sf_dir, "conversations"))
    return conversations.repair(damaged)


def op12_pitman_yor_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitman_yor.score(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    "op1_url_filter": op1_url_filter,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_near_duplicates": op3_near_duplicates,
    "op4_warc_transactions": op4_warc_transactions,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_maximal_repeats": op6_maximal_repeats,
    "op7_interleaved_shards": op7_interleaved_shards,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_weak_supervision": op9_weak_supervision,
    "op10_block_pruned_topk": op10_block_pruned_topk,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_pitman_yor_scores": op12_pitman_yor_scores,
    "op13_filter_audit": op13_filter_audit,
}

WORDS_SQL = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP2_SQL = f"""
WITH docs AS (SELECT doc_id, {WORDS_SQL} AS w FROM documents),
starts AS (
  SELECT doc_id, unnest(range(1, len(w) - 11)) AS p FROM docs WHERE len(w) >= 13
),
wins AS (
  SELECT s.doc_id, s.p, array_to_string(list_slice(d.w, s.p, s.p + 12), ' ') AS win
  FROM starts s JOIN docs d USING (doc_id)
),
least AS (SELECT win, min(doc_id) AS first_id FROM wins GROUP BY win),
gone AS (
  SELECT DISTINCT doc_id, pos FROM (
    SELECT x.doc_id, unnest(range(x.p, x.p + 13)) AS pos
    FROM wins x JOIN least l USING (win) WHERE l.first_id < x.doc_id
  )
),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM docs),
kept AS (
  SELECT w.doc_id, string_agg(word, ' ' ORDER BY pos) AS txt, count(*) AS n
  FROM words w ANTI JOIN gone g ON w.doc_id = g.doc_id AND w.pos = g.pos
  GROUP BY w.doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words,
       CAST(len(d.w) - coalesce(k.n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(k.txt, '')) AS kept_sha256
FROM docs d LEFT JOIN kept k USING (doc_id)
"""

# A-Z only: translate() leaves other letters as they are.
OP3_SQL = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
),
sets AS (
  SELECT DISTINCT doc_id, g FROM (
    SELECT doc_id, unnest(CASE
      WHEN len(w) = 0 THEN []
      WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' '))
    END) AS g FROM docs
  )
),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common
  FROM sets a JOIN sets b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
),
links AS (
  SELECT x, y FROM pairs JOIN sizes s ON s.doc_id = x JOIN sizes t ON t.doc_id = y
  WHERE 100 * common >= 75 * (s.n + t.n - common)
),
arcs AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach AS (
  SELECT doc_id AS node, doc_id AS seen FROM docs
  UNION
  SELECT r.node, a.y FROM reach r JOIN arcs a ON a.x = r.seen
),
least AS (SELECT node, min(seen) AS component_id FROM reach GROUP BY node)
SELECT d.doc_id, CAST(coalesce(s.n, 0) AS BIGINT) AS n_shingles, l.component_id, d.doc_id = l.component_id AS kept
FROM docs d JOIN least l ON l.node = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id
"""

OP4_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS payload, strlen(coalesce(html, '')) AS size FROM pages
),
firsts AS (SELECT payload, min(page_id) AS first_id FROM p WHERE size >= 100 GROUP BY payload)
SELECT page_id, CAST(size AS BIGINT) AS payload_bytes, sha256(payload) AS payload_digest,
       CASE WHEN first_id < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first_id < page_id THEN first_id END AS refers_to
FROM p LEFT JOIN firsts USING (payload)
"""

# Bytes as pairs of hexadecimal digits, so that a string's places are bytes.
OP6_SQL = """
WITH docs AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
chunks AS (SELECT doc_id, n, h, unnest(range(0, n - 49, 500)) AS c FROM docs WHERE n >= 50),
parts AS (SELECT doc_id, n, c, substr(h, 2 * c + 1, 1098) AS part FROM chunks),
starts AS (SELECT doc_id, c, part, unnest(range(0, least(500, n - 49 - c))) AS q FROM parts),
wins AS (SELECT doc_id, c + q AS p, md5(substr(part, 2 * q + 1, 100)) AS win FROM starts),
least AS (SELECT win, min(doc_id) AS first_id FROM wins GROUP BY win),
dup AS (SELECT w.doc_id, w.p FROM wins w JOIN least l USING (win) WHERE l.first_id < w.doc_id),
marked AS (
  SELECT doc_id, p, CASE WHEN p > lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 50
    OR lag(p) OVER (PARTITION BY doc_id ORDER BY p) IS NULL THEN 1 ELSE 0 END AS fresh FROM dup
),
runs AS (
  SELECT doc_id, min(p) AS s, max(p) + 50 AS e FROM (
    SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS r FROM marked
  ) GROUP BY doc_id, r
),
edges AS (
  SELECT doc_id, s, e, lag(e, 1, 0) OVER (PARTITION BY doc_id ORDER BY s) AS before FROM runs
),
pieces AS (
  SELECT doc_id, before AS a, s AS z FROM edges
  UNION ALL SELECT doc_id, max(e), any_value(n) FROM runs JOIN docs USING (doc_id) GROUP BY doc_id
),
kept AS (
  SELECT doc_id, string_agg(substr(h, 2 * a + 1, 2 * (z - a)), '' ORDER BY a) AS k
  FROM pieces JOIN docs USING (doc_id) GROUP BY doc_id
),
counts AS (SELECT doc_id, sum(e - s) AS gone, count(*) AS spans FROM runs GROUP BY doc_id)
SELECT d.doc_id, CAST(d.n AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(k, h))) AS kept_sha256
FROM docs d LEFT JOIN kept USING (doc_id) LEFT JOIN counts USING (doc_id)
"""

OP10_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS place, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
  SELECT q.place, q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY place ORDER BY score DESC, vec_id) AS rank FROM scored
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""

# One row of the DP at a time; in front of a row up to three inserted rows.
OP11_SQL = r"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS txt,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations
),
kinds AS (
  SELECT *, (SELECT list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(0, strlen(key)), lambda p: CAST(ascii(substr(key, p + 1, 1)) AS BIGINT))),
    lambda crc, b: list_reduce(list_prepend(xor(crc, b), [CAST(k AS BIGINT) for k in range(0, 8)]), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, CAST(3988292384 AS BIGINT)) ELSE c // 2 END))) AS crc
  FROM keyed
),
hit AS (SELECT conv_id, turn, role, txt, xor(crc, CAST(4294967295 AS BIGINT)) % 20 AS kind FROM kinds),
after AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN translate(txt, '.!?', '') ELSE txt END AS txt,
         unnest(range(0, CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM hit
),
numbered AS (
  SELECT conv_id, turn, role, txt, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, txt, copy) AS i FROM after
),
judged AS (
  SELECT *, regexp_extract(txt, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS final_char,
         row_number() OVER (PARTITION BY conv_id, role, txt ORDER BY i) > 1 AS seen,
         lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before
  FROM numbered
),
rows_ AS (
  SELECT conv_id, turn, role, txt, i, before, substr(role, 1, 1) AS r, final_char = '' AS blank, final_char <> '' AND seen AS dup,
         final_char <> '' AND NOT seen AND final_char NOT IN ('.', '!', '?') AS trunc
  FROM judged
),
stats AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         sum(CAST(blank AS BIGINT)) AS blank, sum(CAST(dup AS BIGINT)) AS duplicate, sum(CAST(trunc AS BIGINT)) AS truncated,
         sum(CASE WHEN before IS NOT NULL AND before || r NOT IN ('su', 'ua', 'au') THEN 1 ELSE 0 END) AS illegal
  FROM rows_ GROUP BY conv_id
),
ways(s, j, t, put) AS (
  VALUES (0, 0, 0, CAST([] AS VARCHAR[])), (0, 1, 2, ['user:']), (0, 2, 3, ['user:', 'assistant:']), (0, 3, 2, ['user:', 'assistant:', 'user:']),
         (1, 0, 1, []), (1, 1, 2, ['user:']), (1, 2, 3, ['user:', 'assistant:']), (1, 3, 2, ['user:', 'assistant:', 'user:']),
         (2, 0, 2, []), (2, 1, 3, ['assistant:']), (2, 2, 2, ['assistant:', 'user:']), (2, 3, 3, ['assistant:', 'user:', 'assistant:']),
         (3, 0, 3, []), (3, 1, 2, ['user:']), (3, 2, 3, ['user:', 'assistant:']), (3, 3, 2, ['user:', 'assistant:', 'user:'])
),
moves(t, edit, e) AS (VALUES (0, 'D', 0), (1, 'D', 1), (2, 'D', 2), (3, 'D', 3), (0, 'K', 1), (0, 'K', 2), (1, 'K', 2), (2, 'K', 3), (3, 'K', 2), (0, 'R', 2), (1, 'R', 2), (2, 'R', 3), (3, 'R', 2)),
dp AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS i, 0 AS s, {'cost': CAST(0 AS BIGINT), 'audit': '', 'rep': CAST([] AS VARCHAR[])} AS best FROM stats
  UNION ALL
  SELECT d.conv_id, w.i, m.e, min({
    'cost': d.best.cost + 5 * y.j + CASE m.edit WHEN 'D' THEN 2 WHEN 'R' THEN 1 ELSE 0 END + CASE WHEN w.trunc AND m.edit <> 'D' THEN 5 ELSE 0 END,
    'audit': d.best.audit || repeat('I', y.j) || m.edit,
    'rep': list_concat(list_concat(d.best.rep, y.put), CASE m.edit WHEN 'D' THEN CAST([] AS VARCHAR[]) WHEN 'K' THEN [w.role || ':' || w.txt]
      ELSE [CASE WHEN m.e = 2 THEN 'user:' ELSE 'assistant:' END || w.txt] END)})
  FROM dp d JOIN rows_ w ON w.conv_id IS NOT DISTINCT FROM d.conv_id AND w.i = d.i + 1
  JOIN ways y ON y.s = d.s JOIN moves m ON m.t = y.t
  WHERE m.edit = 'D' OR (NOT w.blank AND NOT w.dup AND (m.edit = 'R' OR w.r = CASE m.e WHEN 1 THEN 's' WHEN 2 THEN 'u' ELSE 'a' END))
  GROUP BY d.conv_id, w.i, m.e
),
ended AS (
  SELECT d.conv_id, min({'cost': d.best.cost + 5 * y.j, 'audit': d.best.audit || repeat('I', y.j), 'rep': list_concat(d.best.rep, y.put)}) AS best
  FROM dp d JOIN stats z ON z.conv_id IS NOT DISTINCT FROM d.conv_id AND z.n = d.i JOIN ways y ON y.s = d.s WHERE y.t IN (0, 3) GROUP BY d.conv_id
)
SELECT c.conv_id, CAST(coalesce(z.gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(z.blank, 0) AS BIGINT) AS blank, CAST(coalesce(z.duplicate, 0) AS BIGINT) AS duplicate,
       CAST(coalesce(z.truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(z.illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(e.best.cost, 0) AS BIGINT) AS cost,
       coalesce(e.best.audit, '') AS audit, sha256(coalesce(array_to_string(e.best.rep, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN stats z ON z.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM c.conv_id
"""

OP13_SQL = r"""
WITH RECURSIVE lab AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
  FROM labels GROUP BY doc_id
),
texts AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS txt,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
),
judged AS (
  SELECT t.part, coalesce(l.good, 0) AS good, coalesce(l.toxic, 0) AS toxic,
         [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w),
          100 * (length(txt) - length(translate(txt, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) > 3 * length(txt),
          length(translate(txt, '#$%&*|', '')) < length(txt),
          coalesce(t.doc_id > min(t.doc_id) OVER (PARTITION BY txt), false)] AS fails
  FROM texts t LEFT JOIN lab l USING (doc_id)
),
cells AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM judged GROUP BY ALL),
orders AS (
  SELECT '' AS o UNION ALL
  SELECT o || f FROM orders, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f) WHERE len(o) < 5 AND NOT contains(o, f)
),
steps AS (SELECT o, s, ascii(substr(o, s, 1)) - 64 AS f FROM orders, (SELECT unnest(range(1, 6)) AS s) WHERE len(o) = 5),
joined AS (
  SELECT part, o, s, f, n, good, toxic, fails[f] AS bad,
         len(list_filter(range(1, s), lambda k: fails[ascii(substr(o, k, 1)) - 64])) > 0 AS gone,
         len(list_filter(fails, lambda x: x)) = 1 AS alone
  FROM cells, steps
),
audit AS (
  SELECT part, o, s, f,
         sum(CASE WHEN NOT gone AND NOT bad THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN NOT gone AND bad THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN gone AND bad THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN bad AND alone THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN NOT gone AND bad THEN good ELSE 0 END) AS good_lost,
         sum(CASE WHEN NOT gone AND bad THEN toxic ELSE 0 END) AS toxic_lost
  FROM joined GROUP BY part, o, s, f
)
SELECT part, o AS filter_order, CAST(s AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
       CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM audit
"""

ORACLE = {
    "op2_substring_dedup": OP2_SQL,
    "op3_near_duplicates": OP3_SQL,
    "op4_warc_transactions": OP4_SQL,
    "op6_maximal_repeats": OP6_SQL,
    "op10_block_pruned_topk": OP10_SQL,
    "op11_conversation_repair": OP11_SQL,
    "op13_filter_audit": OP13_SQL,
}
