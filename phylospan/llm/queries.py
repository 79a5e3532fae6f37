"""The thin ``opN_<name>`` queries over the driver's tables, and SQL for those that SQL can express."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from phylospan.llm import embeddings, pii, quality, toxicity
from phylospan.llm.bpe_prefix import round_trip
from phylospan.llm.common import table
from phylospan.llm.media import media_features
from phylospan.llm.negatives import hard_negatives
from phylospan.llm.packing import pack_documents
from phylospan.llm.prefix_trie import conversation_trie
from phylospan.llm.simhash import near_duplicate_classes
from phylospan.llm.token_counts import count_tokens
from phylospan.llm.token_files import token_files_round_trip
from phylospan.llm.warc import archive_pages


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash classes of all documents; :func:`~phylospan.llm.simhash.near_duplicate_classes` says what odd rows give."""
    return near_duplicate_classes(table(spark, sf_dir, "documents"))


def op2_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lossless media of all documents, stored and read back; see :func:`~phylospan.llm.media.media_features` for odd rows."""
    return media_features(table(spark, sf_dir, "documents"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents; see :func:`~phylospan.llm.pii.find_personal_data` for odd rows."""
    docs = table(spark, sf_dir, "documents")
    return pii.find_personal_data(docs, pii.train(pii.sample_texts(docs)))


def op4_bpe_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded and decoded; see :func:`~phylospan.llm.bpe_prefix.round_trip` for odd rows."""
    return round_trip(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents; see :func:`~phylospan.llm.toxicity.score_toxicity` for odd rows."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_toxicity(docs, toxicity.train_from(docs, table(spark, sf_dir, "labels")))


def op9_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all vectors; see :func:`~phylospan.llm.embeddings.near_duplicate_vectors` for odd rows."""
    return embeddings.near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents; see :func:`~phylospan.llm.quality.score_quality` for odd rows."""
    docs = table(spark, sf_dir, "documents")
    return quality.score_quality(docs, quality.train_from(docs, table(spark, sf_dir, "labels")))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages archived, indexed and read back; see :func:`~phylospan.llm.warc.archive_pages` for odd rows."""
    return archive_pages(table(spark, sf_dir, "pages"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences; see :func:`~phylospan.llm.packing.pack_documents` for odd rows."""
    return pack_documents(table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents; see :func:`~phylospan.llm.token_counts.count_tokens` for odd rows."""
    return count_tokens(table(spark, sf_dir, "documents"))


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents in files and read back; see :func:`~phylospan.llm.token_files.write_token_files` for odd rows."""
    return token_files_round_trip(table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of all anchors; see :func:`~phylospan.llm.negatives.hard_negatives` for odd rows."""
    return hard_negatives(table(spark, sf_dir, "embeddings"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations; see :func:`~phylospan.llm.prefix_trie.conversation_trie` for odd rows."""
    return conversation_trie(table(spark, sf_dir, "conversations"))


QUERIES = {
    "pipeline": corpus_pipeline.run,
    "op1_simhash": op1_simhash,
    "op2_webp": op2_webp,
    "op3_pii": op3_pii,
    "op4_bpe_prefix": op4_bpe_prefix,
    "op5_toxicity": op5_toxicity,
    "op6_warc": op6_warc,
    "op7_packing": op7_packing,
    "op8_token_counts": op8_token_counts,
    "op9_embeddings": op9_embeddings,
    "op10_quality": op10_quality,
    "op11_token_files": op11_token_files,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_prefix_trie": op13_prefix_trie,
}

#: The other operators are beyond SQL (hash functions, tokenisers, trained models, codecs, genetic search);
#: tests/llm compares each with a brute-force version, a library or an exact round trip.
ORACLE_SQL: dict[str, str] = {
    "op13_prefix_trie": """
WITH o AS (SELECT conv_id AS c, list({'r': coalesce(role, ''), 't': coalesce(text, '')} ORDER BY turn NULLS FIRST) AS t FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
b AS (SELECT c, list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT) AS bytes FROM o),
h AS (SELECT c, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda a, x: list_reduce(list_prepend(xor(a, x), [0, 1, 2, 3, 4, 5, 6, 7]::BIGINT[]), lambda v, k: xor(v >> 1, 3988292384 * (v & 1)))), 4294967295) % 6 AS h FROM b),
s AS (SELECT o.c, list_concat(coalesce(p.t, [])[:h.h], o.t[h.h + 1:]) AS s FROM o JOIN h ON h.c = o.c LEFT JOIN o p ON p.c = o.c - o.c % 100),
m AS (SELECT c, s, unnest(range(0, len(s) + 1)) AS d FROM s),
n AS (SELECT s[:d] AS p, d, min(c) AS c, count(*) AS n, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (len(s) = d), '')) AS ends FROM m GROUP BY ALL),
k AS (SELECT n.*, CASE WHEN d > 0 THEN (n - 1) * length(p[d].t) ELSE 0 END AS saved, CASE WHEN d > 0 THEN p[:d - 1] END AS above FROM n),
w AS (SELECT above AS p, count(*) AS children FROM k WHERE d > 0 GROUP BY above),
f AS (SELECT k.*, coalesce(w.children, 0) AS children FROM k LEFT JOIN w ON w.p = k.p),
u AS (SELECT x.p, sum((y.children = 0)::INT) AS leaves, sum(y.saved) AS saved FROM f x JOIN f y ON y.d >= x.d AND y.p[:x.d] = x.p GROUP BY x.p)
SELECT f.c::BIGINT AS conv_id, f.d::BIGINT AS depth, q.c::BIGINT AS parent_conv_id, f.n::BIGINT AS n_convs, f.children::BIGINT AS n_children, u.leaves::BIGINT AS n_leaves, u.saved::BIGINT AS saved_tokens, f.ends AS ends_sha256
FROM f JOIN u ON u.p = f.p LEFT JOIN f q ON q.p = f.above AND f.d > 0""",
    "op12_hard_negatives": """
WITH v AS (SELECT vec_id, (CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END)::BIGINT AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
s AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2]))::BIGINT AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)),
p AS (SELECT a, b, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5)
SELECT p.a AS anchor_id, p.b AS positive_id, row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b)::INT AS rank, s.b AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.a = p.a AND NOT s.same AND 100 * s.score BETWEEN 30 * p.score AND 90 * p.score
QUALIFY row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b) <= 10""",
    "op6_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
w AS (SELECT page_id, h, strlen(h)::BIGINT AS n, max(page_id) OVER (PARTITION BY h) AS top FROM p)
SELECT page_id, n AS payload_bytes, sha1(h) AS payload_digest, CASE WHEN n >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id <> top THEN top END AS refers_to FROM w""",
    "op9_embeddings": """
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))) AND list_bool_or(list_transform(embedding, lambda x: x <> 0))),
u AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS n FROM v),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.95),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
counted AS (SELECT a, count(*) AS n_links FROM links GROUP BY a),
named AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT named.a AS vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, named.a = component_id AS kept FROM named LEFT JOIN counted ON counted.a = named.a""",
}
