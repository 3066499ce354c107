"""Registered queries: each applies its operator to the whole table and derives the digest columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    decontaminate,
    fuzzy_lines,
    jaccard_join,
    kd_shards,
    language_codes,
    near_vectors,
    perspectives,
    prefix_trie,
    secret_links,
    sentencepiece_bpe,
    surrogates,
    trie_owners,
    whitening,
)
from .common import documents, ready

#: Key of the registered query only; a user brings a secret of their own.
SURROGATE_KEY = b"registered query"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(build):
    QUERIES[build.__name__] = build
    return build


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@query
def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return sentencepiece_bpe.digests(sentencepiece_bpe.encode_decode(documents(spark, sf_dir), vocabulary()))


@query
def op2_secret_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_linked."""
    return secret_links.digests(secret_links.find_secrets(documents(spark, sf_dir)))


@query
def op5_language_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous."""
    return language_codes.identify(documents(spark, sf_dir))


@query
def op6_trie_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256."""
    return trie_owners.exact_duplicates(documents(spark, sf_dir))


ORACLES["op6_trie_owners"] = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS n FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.n AS group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g USING (t)
"""


@query
def op7_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    dimensions = {
        "length": F.log1p(F.octet_length(F.coalesce("text", F.lit(""))).cast("double")),
        "source": F.crc32(F.coalesce("source", F.lit("")).cast("binary")),
        "lang": F.crc32(F.coalesce("lang", F.lit("")).cast("binary")),
    }
    rows = kd_shards.shard_by_bytes(documents(spark, sf_dir), shards=40, dimensions=dimensions)
    return rows.withColumn("law", F.lit("bytes"))


@query
def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id, score, question_overlap, answer_overlap: benchmark items found in documents."""
    items = decontaminate.question_and_answer(ready(spark).read.parquet(f"{sf_dir}/benchmark.parquet"))
    return decontaminate.contaminated(documents(spark, sf_dir), items)


@query
def op3_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_dropped, text: every document without the lines that repeat an earlier one."""
    return fuzzy_lines.line_report(documents(spark, sf_dir))


@query
def op4_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_entities, text: every document with surrogates for personal data."""
    return surrogates.replace_entities(documents(spark, sf_dir), SURROGATE_KEY)


@query
def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id: three-word shingles, Jaccard 0.9 or more."""
    return jaccard_join.near_duplicates(documents(spark, sf_dir), n=3, percent=90)


@query
def op10_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of every conversation rendered from the side of every participant."""
    return perspectives.rotate(ready(spark).read.parquet(f"{sf_dir}/conversations.parquet"))


ORACLES["op10_perspectives"] = """
WITH s AS (SELECT DISTINCT conv_id, role AS perspective FROM conversations WHERE role IS NOT NULL AND role <> 'system'),
r AS (
  SELECT c.conv_id, s.perspective, c.turn, c.role, coalesce(c.text, '') AS x,
         CASE WHEN c.role = s.perspective THEN 'assistant' WHEN c.role = 'system' THEN 'system' ELSE 'user' END AS chat_role
  FROM conversations c JOIN s ON c.conv_id = s.conv_id
), h AS (
  SELECT *, '<|' || chat_role || CASE WHEN chat_role = 'user' THEN coalesce(' name=' || role, '') ELSE '' END || '|>' || chr(10) AS head FROM r
), m AS (SELECT *, head || x || '<|end|>' || chr(10) AS rendered FROM h),
p AS (
  SELECT *, length(rendered) AS len,
         coalesce(sum(length(rendered)) OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, role NULLS FIRST, x
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM m
)
SELECT conv_id, perspective, turn, chat_role, CASE WHEN chat_role = 'user' THEN role END AS name, rendered,
       CAST(before AS BIGINT) AS start, CAST(len AS BIGINT) AS length,
       CAST(before + CASE WHEN chat_role = 'assistant' THEN length(head) ELSE len END AS BIGINT) AS train_start,
       CAST(before + CASE WHEN chat_role = 'assistant' THEN len - 1 ELSE len END AS BIGINT) AS train_end
FROM p
"""


@query
def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error."""
    return whitening.whiten(ready(spark).read.parquet(f"{sf_dir}/embeddings.parquet"))


@query
def op12_tiled_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, n_links, component_id, kept: cosine 0.98 or more within a label."""
    return near_vectors.near_duplicates(ready(spark).read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLES["op12_tiled_vectors"] = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
    AND len([x FOR x IN embedding IF x <> 0]) > 0
), link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98
), reach AS (
  SELECT vec_id AS node, vec_id AS root FROM embeddings
  UNION SELECT link.b, reach.root FROM reach JOIN link ON link.a = reach.node
), least AS (SELECT node, min(root) AS component_id FROM reach GROUP BY node),
n AS (SELECT a, count(*) AS n_links FROM link GROUP BY a)
SELECT e.vec_id, coalesce(n.n_links, 0) AS n_links, least.component_id, e.vec_id = least.component_id AS kept
FROM embeddings e JOIN least ON least.node = e.vec_id LEFT JOIN n ON n.a = e.vec_id
"""


@query
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of rebuilt conversations."""
    return prefix_trie.prefix_trie(ready(spark).read.parquet(f"{sf_dir}/conversations.parquet"), rebuild=True)


# crc32 of the decimal number, bit by bit; sequences are compared as lists of (role, text)
ORACLES["op13_prefix_trie"] = """
WITH RECURSIVE own AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) - 1 AS pos,
         {'role': coalesce(role, ''), 'text': coalesce(text, '')} AS t
  FROM conversations WHERE conv_id IS NOT NULL
), crc AS (
  SELECT DISTINCT c, CAST(c AS VARCHAR) AS s, 0 AS step, CAST(4294967295 AS BIGINT) AS v FROM own
  UNION ALL
  SELECT c, s, step + 1,
         CASE WHEN step % 9 = 0 THEN xor(v, CAST(ord(s[step // 9 + 1]) AS BIGINT))
              WHEN v % 2 = 1 THEN xor(v // 2, CAST(3988292384 AS BIGINT)) ELSE v // 2 END
  FROM crc WHERE step < 9 * length(s)
), h AS (SELECT c, xor(v, CAST(4294967295 AS BIGINT)) % 9 AS h, c - c % 5 AS donor FROM crc WHERE step = 9 * length(s)),
given AS (
  SELECT h.c, h.h, h.donor, (SELECT count(*) FROM own WHERE own.c = h.donor AND own.pos < h.h) AS there FROM h
), turns AS (
  SELECT g.c, o.pos, o.t FROM given g JOIN own o ON o.c = g.donor AND o.pos < g.h
  UNION ALL
  SELECT g.c, o.pos - g.h + g.there, o.t FROM given g JOIN own o ON o.c = g.c AND o.pos >= g.h
), whole AS (
  SELECT g.c, coalesce(w.seq, []) AS seq FROM given g LEFT JOIN (SELECT c, list(t ORDER BY pos) AS seq FROM turns GROUP BY c) w ON w.c = g.c
), member AS (
  SELECT c, d, seq[1:d] AS p, seq[d].text AS last, d = len(seq) AS ends
  FROM (SELECT c, seq, unnest(range(0, len(seq) + 1)) AS d FROM whole)
), node AS (
  SELECT p, d, min(c) AS conv_id, count(*) AS n_convs,
         CASE WHEN d = 0 THEN 0 ELSE (count(*) - 1) * octet_length(encode(any_value(last))) END AS own_saved,
         sha256(coalesce(string_agg(CASE WHEN ends THEN CAST(c AS VARCHAR) END, ',' ORDER BY c), '')) AS ends_sha256
  FROM member GROUP BY p, d
), kids AS (SELECT p[1:d - 1] AS p, d - 1 AS d, count(*) AS n FROM node WHERE d > 0 GROUP BY ALL),
full_node AS (SELECT node.*, coalesce(kids.n, 0) AS n_children FROM node LEFT JOIN kids ON kids.d = node.d AND kids.p = node.p),
below AS (
  SELECT p[1:k] AS p, k AS d, sum(own_saved) AS saved, count(*) FILTER (n_children = 0) AS leaves
  FROM (SELECT p, own_saved, n_children, unnest(range(0, d + 1)) AS k FROM full_node) GROUP BY ALL
)
SELECT n.conv_id, CAST(n.d AS BIGINT) AS depth, up.conv_id AS parent_conv_id, n.n_convs, n.n_children,
       b.leaves AS n_leaves, CAST(b.saved AS BIGINT) AS saved_tokens, n.ends_sha256
FROM full_node n JOIN below b ON b.d = n.d AND b.p = n.p LEFT JOIN node up ON up.d = n.d - 1 AND up.p = n.p[1:n.d - 1]
"""
