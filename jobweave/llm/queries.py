"""Registered queries of the operators, by their contracts."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobweave.llm import (
    bpe, decontaminate, linededup, minhash, ordering, packing, periodic, quality, sharding, topk, toxicity, unitdedup, variants,
)
from jobweave.llm.shared import shared_dir, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def vocabulary() -> str:
    return public_tokenizers.path("word_bpe_49k.json")


def held_out(id_col: str = "doc_id"):
    """The fold that no label is learned from: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


@query
def op1_line_dedup(spark, sf_dir):
    """Every document after its common blocks are deleted, with the blocks."""
    out = linededup.deduplicate(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("__lines").alias("n_lines"), F.col("__removed").alias("removed_lines"),
                      F.col("__blocks").alias("removed_blocks"), "text")


@query
def op2_minhash_near_dedup(spark, sf_dir):
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), s=minhash.Settings(words=3, num=85, den=100))


@query
def op3_vector_bin_shards(spark, sf_dir):
    out = sharding.assign(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"), "tokens")


@query
def op4_unit_dedup(spark, sf_dir):
    """Every document after repeated passages are removed, with their ranges in the original text."""
    out = unitdedup.deduplicate(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("__units").alias("n_units"), F.col("__removed").alias("removed"), "text")


@query
def op5_spaced_seed_decontamination(spark, sf_dir):
    """Every document with the benchmark items it overlaps."""
    out = decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", (F.size("hits") > 0).alias("contaminated"), F.col("hits.item_id").alias("item_ids"), "hits")


@query
def op6_training_order(spark, sf_dir):
    """Every sequence as read back from the shards it was written to."""
    path = f"{shared_dir(spark)}/jobweave-llm/{spark.sparkContext.applicationId}/order-{uuid.uuid4().hex}"
    ordering.materialise(table(spark, sf_dir, "documents"), vocabulary(), path)
    return ordering.read(spark, path).withColumnRenamed("id", "doc_id")


@query
def op7_mixture_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary())


@query
def op8_attention_quality(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = quality.score(docs, quality.fit(docs, labels.where(~held_out())))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op9_pu_toxicity(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = toxicity.score(docs, toxicity.fit(docs, labels.where(~held_out())))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query
def op10_ball_tree_top_k(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0))


@query
def op11_bit_sliced_variants(spark, sf_dir):
    """Every frequent word with its more frequent spelling."""
    return variants.group(table(spark, sf_dir, "documents"), rewrite=variants.planted())


@query
def op12_periodic_runs(spark, sf_dir):
    """Every document's periodic runs of words."""
    return periodic.digest(periodic.find(table(spark, sf_dir, "documents").select("doc_id", "text"), rewrite=periodic.planted))


@query
def op13_byte_bpe(spark, sf_dir):
    """Every document's token ids and the text decoded from them."""
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


ORACLE["op10_ball_tree_top_k"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.x AS DOUBLE[]), CAST(c.x AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
  FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

# crc32 as its bitwise definition: a table of 256 remainders of the reflected polynomial 0xEDB88320, one look-up a byte.
# Near words are found another way than by the operator: equal after the same place is masked, or after one letter is deleted.
ORACLE["op11_bit_sliced_variants"] = r"""
WITH remainders AS (
  SELECT list(c ORDER BY b) AS t FROM (
    SELECT b, list_reduce([b] || [0, 0, 0, 0, 0, 0, 0, 0], lambda c, k:
             CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c
    FROM (SELECT unnest(range(256)) AS b))),
runs AS (
  SELECT doc_id, word, count(*) AS n FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[a-z\x{00C0}-\x{00FF}]+')) AS word
    FROM documents)
  GROUP BY ALL),
bytes AS (
  SELECT doc_id, word, n, flatten(list_transform(string_split(doc_id::VARCHAR || ':' || word, ''), lambda x:
    CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT]
         ELSE [(192 + unicode(x) // 64)::BIGINT, (128 + unicode(x) % 64)::BIGINT] END)) AS b
  FROM runs),
hashed AS (
  SELECT word, n, xor(list_reduce([4294967295::BIGINT] || b, lambda c, x: xor(c // 256, t[1 + xor(c, x) % 256])), 4294967295) AS h
  FROM bytes, remainders),
altered AS (
  SELECT CASE WHEN h % 199 = 0 THEN substr(word, 1, (h % length(word))::BIGINT) || substr(word, (h % length(word))::BIGINT + 2)
              ELSE word END AS word, n
  FROM hashed),
vocabulary AS (
  SELECT word, sum(n)::BIGINT AS n FROM altered GROUP BY word HAVING length(word) >= 6 AND sum(n) >= 5),
places AS (SELECT word, n, unnest(range(1, length(word)::BIGINT + 1)) AS k FROM vocabulary),
masked AS (SELECT word, n, k, substr(word, 1, k - 1) || '*' || substr(word, k + 1) AS m FROM places),
shorter AS (SELECT DISTINCT word, n, substr(word, 1, k - 1) || substr(word, k + 1) AS m FROM places),
near AS (
  SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM masked a JOIN masked b ON a.m = b.m AND a.k = b.k AND a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM shorter a JOIN vocabulary b ON a.m = b.word
  UNION SELECT b.word, b.n, a.word, a.n FROM shorter a JOIN vocabulary b ON a.m = b.word),
best AS (
  SELECT word, n, other, other_n, count(*) OVER (PARTITION BY word) AS n_near,
         row_number() OVER (PARTITION BY word ORDER BY other_n DESC, encode(other)) AS place
  FROM near),
found AS (
  SELECT word, n_near, CASE WHEN other_n >= 5 * n THEN other END AS form, CASE WHEN other_n >= 5 * n THEN other_n END AS form_n
  FROM best WHERE place = 1),
chain AS (
  WITH RECURSIVE walk(word, last, step) AS (
    SELECT word, form, 1 FROM found WHERE form IS NOT NULL
    UNION ALL
    SELECT w.word, f.form, w.step + 1 FROM walk w JOIN found f ON f.word = w.last WHERE f.form IS NOT NULL)
  SELECT word, max_by(last, step) AS root FROM walk GROUP BY word)
SELECT v.word, f.form, coalesce(c.root, v.word) AS root, v.n, coalesce(f.n_near, 0)::BIGINT AS n_near, f.form_n::BIGINT AS form_n
FROM vocabulary v LEFT JOIN found f USING (word) LEFT JOIN chain c USING (word)
"""
