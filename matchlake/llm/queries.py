"""Registered queries of this package: name -> (Spark callable, reference SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchlake.llm import (
    conversation_trie,
    decontaminate,
    divergence,
    jaccard,
    line_dedup,
    packing,
    quality_classifier,
    quality_rules,
    sentence_pieces,
    suffix_dedup,
    token_counts,
    toxicity,
    warc,
)
from matchlake.llm.common import table

REGISTRY: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn: Callable[[SparkSession, str], DataFrame]):
        REGISTRY[name] = (fn, sql)
        return fn

    return wrap


@query("op1_decontaminate", r"""
WITH parsed AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark WHERE item_id IS NOT NULL),
sized AS (SELECT item_id, ws, least(len(ws), 10) AS k FROM items WHERE len(ws) > 0),
grams AS (
  SELECT DISTINCT item_id, k, array_to_string(ws[i:i + k - 1], ' ') AS win
  FROM (SELECT item_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM sized)),
windows AS (
  SELECT rid, k, i, array_to_string(ws[i:i + k - 1], ' ') AS win
  FROM (SELECT rid, ws, k, unnest(range(1, len(ws) - k + 2)) AS i
        FROM parsed, (SELECT DISTINCT k FROM grams) WHERE len(ws) >= k)),
hits AS (SELECT w.rid, w.i, w.k, g.item_id FROM windows w JOIN grams g ON w.k = g.k AND w.win = g.win),
covered AS (
  SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + k)) AS p FROM hits) GROUP BY rid),
found AS (
  SELECT rid, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY rid)
SELECT p.doc_id, CAST(len(p.ws) AS BIGINT) AS n_words, CAST(coalesce(c.n, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(f.n, 0) AS BIGINT) AS n_items, sha256(coalesce(f.ids, '')) AS items_sha256,
       coalesce(c.n, 0) > 0 AS contaminated
FROM parsed p LEFT JOIN covered c ON p.rid = c.rid LEFT JOIN found f ON p.rid = f.rid
""")
def _op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = decontaminate.find_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return hits.select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


@query("op2_toxicity")
def _op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return toxicity.score(documents, toxicity.train(documents, table(spark, sf_dir, "labels")))


@query("op3_token_counts")
def _op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.prefix_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))


@query("op4_quality_rules")
def _op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_rules(table(spark, sf_dir, "documents")).drop("rejected_by")


@query("op5_warc", r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS largest FROM pages),
h AS (SELECT *, sha1(body) AS hex FROM p),
g AS (SELECT *, list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 +
        ((CAST(concat('0x', substr(hex, CAST((i // 4) * 5 + 1 AS BIGINT), 5)) AS INTEGER) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31),
        1)) AS letters FROM h)
SELECT page_id, CAST(octet_length(encode(body)) AS BIGINT) AS payload_bytes, array_to_string(letters, '') AS payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM largest OR largest IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM largest THEN largest END AS refers_to
FROM g
""")
def _op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read(warc.write(table(spark, sf_dir, "pages")))


@query("op6_jaccard_join")
def _op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents")).drop("digest")


@query("op7_suffix_dedup")
def _op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(table(spark, sf_dir, "documents")).drop("kept")


@query("op8_line_dedup", r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT rid, doc_id, i, ls[i] AS line,
             list_filter(string_split_regex(ls[i], '[\x09-\x0D ]+'), lambda x: x <> '') AS tk
      FROM (SELECT rid, doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM d)),
m AS (SELECT rid, doc_id, i, len(tk) AS n,
             list_transform(tk, lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END) AS t
      FROM l WHERE len(tk) > 0),
k AS (SELECT rid, doc_id, i, concat(n, ' own ', array_to_string(t, ' ')) AS tpl, t AS shown FROM m
      UNION ALL
      SELECT rid, doc_id, i, concat(n, ' ', q, ' ', array_to_string(shown, ' ')) AS tpl, shown FROM (
        SELECT rid, doc_id, i, n, q, list_concat(list_concat(t[1:2 + (n - 2) * q // 4], ['<*>']), t[3 + (n - 2) * (q + 1) // 4:]) AS shown
        FROM m, (VALUES (0), (1), (2), (3)) v(q) WHERE n >= 8)),
r AS (SELECT tpl, min(doc_id) AS first_doc FROM k GROUP BY tpl
      HAVING min(len(list_filter(shown, lambda x: x <> '<*>'))) > 0 AND count(DISTINCT doc_id) >=
        CASE WHEN min(len(list_filter(shown, lambda x: x <> '<*>'))) >= 20 THEN 2 ELSE 5 END),
x AS (SELECT DISTINCT rid, i FROM k JOIN r ON k.tpl = r.tpl WHERE doc_id <> first_doc),
o AS (SELECT l.rid, count(*) AS n_lines, count(x.i) AS n_dropped,
             string_agg(CASE WHEN x.i IS NULL THEN line END, chr(10) ORDER BY l.i) AS kept
      FROM l LEFT JOIN x ON l.rid = x.rid AND l.i = x.i GROUP BY l.rid)
SELECT d.doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_dropped, 0) AS BIGINT) AS n_dropped,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN o ON d.rid = o.rid
""")
def _op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    text = F.coalesce(F.col("text"), F.lit(""))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(text, 256).alias("kept_sha256"))


@query("op9_quality_classifier")
def _op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("digest")


@query("op10_packing")
def _op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")).drop("ids")


@query("op11_source_divergence", r"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(
             translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
t AS (SELECT rid, lang, source, unnest(ws) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM t GROUP BY ALL HAVING count(DISTINCT rid) >= 10),
l AS (SELECT lang, sum(n)::HUGEINT AS total, count(*)::HUGEINT AS v FROM k GROUP BY lang),
c AS (SELECT t.lang, t.source, t.term, count(*) AS n FROM t JOIN k ON t.lang = k.lang AND t.term = k.term GROUP BY ALL),
s AS (SELECT lang, source, sum(n)::HUGEINT AS total FROM c GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
             1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (coalesce(s.total, 0) + 2 * l.v) AS p
      FROM g JOIN k ON g.lang = k.lang JOIN l ON g.lang = l.lang
      LEFT JOIN c ON g.lang = c.lang AND g.source = c.source AND k.term = c.term
      LEFT JOIN s ON g.lang = s.lang AND g.source = s.source),
q AS (SELECT k.lang, k.term, 1 + (1000000000::HUGEINT * (k.n + 2)) // (l.total + 2 * l.v) AS q FROM k JOIN l ON k.lang = l.lang),
f AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
      FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(f.value, 0) AS BIGINT) AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
      LEFT JOIN f ON a.lang = f.lang AND a.source = f.source AND b.source = f.item
      UNION ALL
      SELECT p.lang, source, 'term', p.term, CAST(((p - q) * (p - q)) // (p + q) AS BIGINT)
      FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r)
WHERE part = 'pair' OR rank <= 10
""")
def _op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


@query("op12_sentence_pieces")
def _op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("piece_bpe_32k.model")
    encoded = sentence_pieces.encode(table(spark, sf_dir, "documents"), path)
    decoded = sentence_pieces.decode(encoded, path)
    return decoded.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


@query("op13_conversation_trie", r"""
WITH o AS (SELECT conv_id, row_number() OVER w AS i, coalesce(role, '') AS role, coalesce(text, '') AS text
           FROM conversations WHERE conv_id IS NOT NULL
           WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''))),
bits AS (SELECT conv_id, list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''),
           lambda x: list_concat([ascii(x)::BIGINT], [-1, -1, -1, -1, -1, -1, -1, -1]::BIGINT[])))) AS steps
         FROM (SELECT DISTINCT conv_id FROM o)),
h AS (SELECT conv_id, conv_id - conv_id % 100 AS base, xor(4294967295::BIGINT, list_reduce(steps, lambda a, x:
        CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384::BIGINT * (a & 1)) END)) % 6 AS h FROM bits),
turns AS (SELECT h.conv_id, 0 AS part, b.i, b.role, b.text FROM h JOIN o b ON b.conv_id = h.base AND b.i <= h.h
          UNION ALL
          SELECT h.conv_id, 1, b.i, b.role, b.text FROM h JOIN o b ON b.conv_id = h.conv_id AND b.i > h.h),
keys AS (SELECT h.conv_id, coalesce(list(concat(strlen(role), ':', role, strlen(turns.text), ':', turns.text) ORDER BY part, i)
           FILTER (i IS NOT NULL), []) AS ks,
           coalesce(list(length(turns.text) ORDER BY part, i) FILTER (i IS NOT NULL), []) AS ls
         FROM h LEFT JOIN turns ON h.conv_id = turns.conv_id GROUP BY h.conv_id),
member AS (SELECT conv_id, d, ks[1:d] AS k, CASE WHEN d > 0 THEN ls[d] ELSE 0 END AS chars, len(ks) = d AS here
           FROM (SELECT *, unnest(range(0, len(ks) + 1)) AS d FROM keys)),
node AS (SELECT k, d, min(conv_id) AS conv_id, count(*) AS n, min(chars) AS chars,
           sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (here), '')) AS ends
         FROM member GROUP BY k, d),
children AS (SELECT k[1:d - 1] AS k, count(*) AS n FROM node WHERE d > 0 GROUP BY ALL),
full_node AS (SELECT node.*, coalesce(c.n, 0) AS n_children FROM node LEFT JOIN children c ON node.k = c.k),
under AS (SELECT k[1:u] AS k, sum((n_children = 0)::BIGINT) AS n_leaves, sum((n - 1) * chars) AS saved
          FROM (SELECT *, unnest(range(0, d + 1)) AS u FROM full_node) GROUP BY ALL)
SELECT f.conv_id, CAST(f.d AS BIGINT) AS depth, p.conv_id AS parent_conv_id, f.n AS n_convs, f.n_children,
       CAST(u.n_leaves AS BIGINT) AS n_leaves, CAST(u.saved AS BIGINT) AS saved_tokens, f.ends AS ends_sha256
FROM full_node f JOIN under u ON f.k = u.k LEFT JOIN node p ON f.d > 0 AND p.k = f.k[1:f.d - 1]
""")
def _op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.trie(table(spark, sf_dir, "conversations"))
