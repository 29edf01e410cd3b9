"""The registered queries of the numbered operators, over whole tables, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.llm import (
    byte_bpe, conversation_trie, language, language_model, lexical_search, licenses, mixing, near_vectors, ngram_join, packing,
    personal_data, quality, top_k,
)
from freshet.llm.common import remainder, table


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores, learnt from labels whose remainder modulo 5 is not 0."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    machine = quality.fit(docs, labels.where(remainder("doc_id", 5) != 0), metadata=("n_chars",))
    scored = docs.select(
        "doc_id", (remainder("doc_id", 5) == 0).alias("held_out"),
        quality.quality_score(machine, F.col("text")).alias("score"),
    )
    return scored.withColumn("predicted", (F.col("score") >= quality.THRESHOLD).cast("int"))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages, learnt from documents whose remainder modulo 4 is not 2."""
    docs = table(spark, sf_dir, "documents")
    parser = language.fit(docs.where(remainder("doc_id", 4) != 2))
    found = docs.select(
        "doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), language.language(parser, F.col("text")).alias("found")
    )
    return found.select("doc_id", "held_out", F.col("found.lang").alias("lang_pred"), F.col("found.score").alias("score"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in windows of 2048 tokens."""
    return packing.pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near copies among all documents: five-word shingles, Jaccard 0.75 or more."""
    return ngram_join.near_documents(table(spark, sf_dir, "documents"))


def op5_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of all documents, learnt from those whose remainder modulo 7 is not 2."""
    docs = table(spark, sf_dir, "documents")
    held_out = remainder("doc_id", 7) == 2
    model = language_model.fit(docs.where(~held_out))
    return language_model.scored(docs, model, {"held_out": held_out})


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data in all documents."""
    docs = table(spark, sf_dir, "documents")
    return personal_data.span_report(docs, personal_data.fit(docs))


def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best other vectors for every vector whose id is divisible by 50."""
    vectors = table(spark, sf_dir, "embeddings")
    vectors = vectors.where(top_k.usable(F.col("embedding")))
    vectors = vectors.select("vec_id", top_k.floored(F.col("embedding")).alias("embedding"))
    return top_k.top_k(vectors, F.col("vec_id") % 50 == 0)


def op8_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate vectors of each label, at cosine 0.93 or more."""
    return near_vectors.near_vectors(table(spark, sf_dir, "embeddings"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and templates in all documents."""
    return licenses.license_report(table(spark, sf_dir, "documents"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all documents' ids and of the bytes that these decode to."""
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.digests(table(spark, sf_dir, "documents"), ranks)


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 best documents for every benchmark item."""
    return lexical_search.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the prefix trie of all rebuilt conversations."""
    return conversation_trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix of all sources takes of every document."""
    return mixing.mixed(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_quality": op1_quality,
    "op2_language": op2_language,
    "op3_packing": op3_packing,
    "op4_ngram_join": op4_ngram_join,
    "op5_language_model": op5_language_model,
    "op6_personal_data": op6_personal_data,
    "op7_top_k": op7_top_k,
    "op8_near_vectors": op8_near_vectors,
    "op9_licenses": op9_licenses,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_lexical_search": op11_lexical_search,
    "op12_conversation_trie": op12_conversation_trie,
    "op13_mixing": op13_mixing,
}

ORACLES = {
    "op7_top_k": """
WITH valid AS (
  SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE) FOR x IN embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
scores AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM valid q JOIN valid c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v)),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scores)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5""",
    "op11_lexical_search": r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
b AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark WHERE item_id IS NOT NULL),
total AS (SELECT count(*) FILTER (len(t) > 0) AS n_docs, CAST(sum(len(t)) AS BIGINT) AS n_terms FROM d),
tf AS (
  SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS n, unnest(t) AS term FROM d)
  WHERE term IN (SELECT term FROM b) GROUP BY ALL),
w AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(n_docs) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM tf, total GROUP BY term),
scores AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM b JOIN tf USING (term) JOIN w USING (term), total GROUP BY item_id, doc_id),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10""",
    "op12_conversation_trie": r"""
WITH said AS (
  SELECT conv_id AS c, {'r': coalesce(role, ''), 't': coalesce(text, '')} AS said,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
bytes AS (SELECT DISTINCT c, list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT)) AS b FROM said),
convs AS (
  SELECT c, xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], b), lambda state, byte: list_reduce(
    list_concat([xor(state, byte)], [0::BIGINT for i in range(8)]),
    lambda x, zero: xor(x // 2, (x % 2) * 3988292384)))) % 4 AS h FROM bytes),
turns AS (
  SELECT v.c, 0 AS half, pos, said FROM convs v JOIN said s ON s.c = v.c - v.c % 20 AND s.pos <= v.h
  UNION ALL SELECT v.c, 1, pos, said FROM convs v JOIN said s ON s.c = v.c AND s.pos > v.h),
rebuilt AS (
  SELECT c, row_number() OVER sofar AS depth, said, list(said) OVER sofar AS path FROM turns
  WINDOW sofar AS (PARTITION BY c ORDER BY half, pos ROWS UNBOUNDED PRECEDING)),
members AS (
  SELECT c, depth, said.t AS text, path FROM rebuilt
  UNION ALL SELECT c, 0, '', [] FROM convs),
owned AS (SELECT c, depth, text, min(c) OVER (PARTITION BY path) AS owner, max(depth) OVER (PARTITION BY c) AS total FROM members),
nodes AS (
  SELECT owner, depth, count(*) AS n, (count(*) - 1) * len(regexp_extract_all(any_value(text), '[^\x20\x09-\x0D]+')) AS own,
    sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (depth = total), '')) AS ends
  FROM owned GROUP BY owner, depth),
parents AS (
  SELECT n.*, o.owner AS parent FROM nodes n LEFT JOIN owned o ON o.c = n.owner AND o.depth = n.depth - 1),
children AS (SELECT parent, depth - 1 AS depth, count(*) AS n FROM parents WHERE depth > 0 GROUP BY ALL),
known AS (
  SELECT p.*, coalesce(k.n, 0) AS kids FROM parents p LEFT JOIN children k ON k.parent = p.owner AND k.depth = p.depth),
sums AS (
  SELECT o.owner, o.depth, count(*) FILTER (k.kids = 0) AS leaves, sum(k.own) AS saved
  FROM known k JOIN owned o ON o.c = k.owner AND o.depth <= k.depth GROUP BY ALL)
SELECT owner AS conv_id, CAST(k.depth AS BIGINT) AS depth, parent AS parent_conv_id, k.n AS n_convs, kids AS n_children,
  leaves AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, ends AS ends_sha256
FROM known k JOIN sums s USING (owner, depth)""",
    "op13_mixing": r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS hash FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST(sum(sum(size)) OVER () AS DOUBLE) * 150 / 100 AS budget,
    CAST([3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS weight
  FROM d GROUP BY source),
filling AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap,
    coalesce(sum(2.0::DOUBLE * source_size) OVER (ORDER BY source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held,
    sum(weight) OVER (ORDER BY source_size / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free
  FROM s),
level AS (
  SELECT (budget - held) / free AS level FROM filling WHERE (budget - held) / free * weight <= cap
  ORDER BY source_size / weight, source LIMIT 1),
targets AS (
  SELECT source, source_size, CASE WHEN weight * level > cap THEN cap ELSE weight * level END AS target FROM filling, level),
parts AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target) AS BIGINT) // source_size ELSE 0 END AS whole FROM targets),
ordered AS (
  SELECT d.doc_id, d.size, p.source_size, p.target, p.whole, CAST(floor(p.target) AS BIGINT) - p.whole * p.source_size AS part,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY hash, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN parts p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target, CAST(whole * size + greatest(0, least(size, part - before)) AS BIGINT) AS taken FROM ordered""",
}
