"""Report queries of the operators, each over its whole table, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (decontaminate, exact_dedup, lang_id, lexical_search, merkle, mixture, quality_mcd, sentencepiece_sample, sharding,
               simhash_golay, token_count, toxicity, warc)
from .util import field, mod_crc32, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@_query
def op1_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = lang_id.fit(docs, learn=mod_crc32(F.col("id"), 4) != 2)
    return lang_id.identify(docs, model).select(
        "doc_id", (mod_crc32(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score",
        F.size("spans").alias("n_spans"))


@_query
def op2_sentencepiece(spark, sf_dir):
    rows = sentencepiece_sample.sample_segmentations(
        table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), ["doc_id"], k=2)
    return rows.select(
        "_row.doc_id", F.size("samples").alias("n_samples"),
        F.transform("samples", lambda s: F.size(s["ids"])).alias("n_pieces"),
        F.transform("samples", lambda s: F.xxhash64(s["ids"])).alias("ids_hash"),
        F.col("samples.log_prob").alias("log_prob"), F.col("samples.inclusion").alias("inclusion"),
        F.forall("samples", lambda s: s["round_trip"]).alias("round_trip"))


@_query
def op3_warc(spark, sf_dir):
    index = warc.write_archives(table(spark, sf_dir, "pages"), min_bytes=0)
    return warc.read_archives(index, with_payload=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


@_query
def op4_token_count(spark, sf_dir):
    return token_count.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@_query
def op5_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), learn=mod_crc32(F.col("id"), 5) != 0)
    return toxicity.score(docs, model, ["doc_id"]).select(
        "_row.doc_id", (mod_crc32(F.col("_row.doc_id"), 5) == 0).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))


@_query
def op6_mixture(spark, sf_dir):
    return mixture.mix_report(table(spark, sf_dir, "documents"))


@_query
def op7_sharding(spark, sf_dir):
    return sharding.shard_records(table(spark, sf_dir, "documents"), shards=8)


@_query
def op8_simhash(spark, sf_dir):
    return simhash_golay.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, most=4)


@_query
def op9_quality(spark, sf_dir):
    return quality_mcd.quality_rules(table(spark, sf_dir, "documents"))


@_query
def op10_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


@_query
def op11_merkle(spark, sf_dir):
    return merkle.proofs(table(spark, sf_dir, "documents"), tampered=mod_crc32(field("doc_id"), 5) == 0)


@_query
def op12_decontaminate(spark, sf_dir):
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@_query
def op13_lexical_search(spark, sf_dir):
    index = lexical_search.build_index(table(spark, sf_dir, "documents"))
    return lexical_search.search(index, table(spark, sf_dir, "benchmark"), k=50)


ORACLE["op10_exact_dedup"] = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""

# zlib's table of crc32: the remainder of each byte after eight steps
ORACLE["op11_merkle"] = r"""
WITH RECURSIVE steps(b, k, c) AS (
  SELECT b, 0, b::BIGINT FROM range(256) t(b)
  UNION ALL
  SELECT b, k + 1, xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END) FROM steps WHERE k < 8),
crc AS (SELECT list(c ORDER BY b) AS t FROM steps WHERE k = 8),
fields AS (
  SELECT doc_id, source, text,
         coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
           || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
         xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
                         lambda c, b: xor(c >> 8, crc.t[(xor(c, b) & 255) + 1])), 4294967295) % 5 = 0 AS tampered
  FROM documents, crc),
leaves AS (
  SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
         CASE WHEN tampered THEN sha256(head || coalesce(strlen(text) || ':' ||
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) END AS now
  FROM fields),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n,
         dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree
  FROM leaves),
nodes(tree, n, k, pos, digest) AS (
  SELECT tree, n, 0, pos, leaf FROM placed
  UNION ALL
  SELECT tree, (n + 15) // 16, k + 1, pos // 16, sha256(string_agg(digest, '' ORDER BY pos))
  FROM nodes WHERE n > 1 GROUP BY tree, n, k, pos // 16),
subroots AS (SELECT tree, digest AS subroot, k AS height FROM nodes WHERE n = 1),
top(n, k, pos, digest) AS (
  SELECT count(*) OVER (), 0, tree, subroot FROM subroots
  UNION ALL
  SELECT (n + 15) // 16, k + 1, pos // 16, sha256(string_agg(digest, '' ORDER BY pos)) FROM top WHERE n > 1 GROUP BY n, k, pos // 16),
up AS (
  SELECT p.doc_id, p.tree, p.pos, r.k, s.pos AS spot, s.digest, s.pos = p.pos >> (4 * r.k) AS own
  FROM placed p JOIN (SELECT DISTINCT tree, k FROM nodes WHERE n > 1) r USING (tree)
  JOIN nodes s ON s.tree = p.tree AND s.k = r.k AND s.pos >> 4 = p.pos >> (4 * r.k + 4)
  UNION ALL
  SELECT p.doc_id, p.tree, p.pos, 100 + r.k, s.pos, s.digest, s.pos = p.tree >> (4 * r.k)
  FROM placed p CROSS JOIN (SELECT DISTINCT k FROM top WHERE n > 1) r
  JOIN top s ON s.k = r.k AND s.pos >> 4 = p.tree >> (4 * r.k + 4)),
segments AS (
  SELECT tree, pos, k, coalesce(string_agg(digest, '' ORDER BY spot) FILTER (spot < own_spot), '') AS l,
         coalesce(string_agg(digest, '' ORDER BY spot) FILTER (spot > own_spot), '') AS r
  FROM (SELECT *, max(spot) FILTER (own) OVER (PARTITION BY tree, pos, k) AS own_spot FROM up) GROUP BY tree, pos, k),
paths AS (
  SELECT tree, pos, list({'l': l, 'r': r} ORDER BY k) AS path, string_agg(l || r, '' ORDER BY k) AS proof
  FROM segments GROUP BY tree, pos),
back(tree, pos, path, k, spot) AS (
  SELECT p.tree, p.pos, coalesce(path, []), 0, coalesce(now, leaf) FROM placed p LEFT JOIN paths USING (tree, pos)
  UNION ALL
  SELECT tree, pos, path, k + 1, sha256(path[k + 1].l || spot || path[k + 1].r) FROM back WHERE k < len(path))
SELECT p.doc_id, p.leaf, s.subroot, t.digest AS root, sha256(coalesce(a.proof, '')) AS proof_sha256, b.spot AS folded_root,
       b.spot = t.digest AS verified
FROM placed p JOIN subroots s USING (tree) JOIN back b ON b.tree = p.tree AND b.pos = p.pos AND b.k = len(b.path)
LEFT JOIN paths a ON a.tree = p.tree AND a.pos = p.pos CROSS JOIN (SELECT digest FROM top WHERE n = 1) t
"""

ORACLE["op12_decontaminate"] = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS place, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents),
i AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM benchmark),
windows AS (
  SELECT DISTINCT item, least(len(words), 10) AS size, array_to_string(words[p:p + least(len(words), 10) - 1], ' ') AS key
  FROM (SELECT *, unnest(range(1, greatest(len(words) - 9, 1) + 1)) AS p FROM i WHERE len(words) > 0)),
found AS (
  SELECT place, p, s.size, item
  FROM (SELECT *, unnest(range(1, len(words) + 1)) AS p FROM d) x JOIN (SELECT DISTINCT size FROM windows) s ON x.p + s.size - 1 <= len(x.words)
  JOIN windows w ON w.size = s.size AND w.key = array_to_string(x.words[x.p:x.p + s.size - 1], ' ')),
hit AS (SELECT place, count(DISTINCT spot) AS n_hit FROM (SELECT place, unnest(range(p, p + size)) AS spot FROM found) GROUP BY place),
items AS (SELECT place, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS names FROM found GROUP BY place)
SELECT doc_id, len(words) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (place) LEFT JOIN items USING (place)
"""

ORACLE["op13_lexical_search"] = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS place, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
t AS (SELECT count(*) FILTER (len(terms) > 0)::BIGINT AS big_n, sum(len(terms))::BIGINT AS big_l FROM d),
tf AS (SELECT place, term, count(*) AS tf FROM (SELECT place, unnest(terms) AS term FROM d) GROUP BY place, term),
w AS (SELECT term, floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, t GROUP BY term, big_n),
q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark),
s AS (
  SELECT item_id, place, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * len(d.terms) * big_n) // big_l))))::BIGINT AS score
  FROM q JOIN w USING (term) JOIN tf USING (term) JOIN d USING (place), t GROUP BY item_id, place)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, place))::INT AS rank, doc_id, score
FROM s JOIN d USING (place) WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, place) <= 50
"""
