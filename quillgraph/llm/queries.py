"""The ``opN_*`` queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import lm, merkle, mixing, near_dedup, neighbours, suffix_dedup, token_file, tokens, toxicity
from .base import crc_of_id, table


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies taken per source at 0.97 of the greatest entropy, four times over at most."""
    return mixing.mix(_documents(spark, sf_dir))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-word shingles, linked at 85 per cent."""
    return near_dedup.near_duplicates(_documents(spark, sf_dir), near_dedup.Params(shingle=3, percent=85))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of 100-byte strings that also start earlier."""
    return suffix_dedup.remove_repeats(_documents(spark, sf_dir), suffix_dedup.Params(length=100)).drop("kept")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histogram of encoded lengths with prefix and suffix sums."""
    return tokens.length_histogram(tokens.encoded_lengths(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken")))


def op5_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids written to plane files and read back."""
    return token_file.read_ids(token_file.write_ids(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), end_id=2))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents; one fifth of the ids is held out of learning."""
    docs = _documents(spark, sf_dir)
    lexicon = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs.select("doc_id", "text"), lexicon).select("doc_id", (crc_of_id() % 5 == 0).alias("held_out"), "score", "predicted")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of whole texts and the bytes they decode to, as digests."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    out = tokens.decode(tokens.encode(_documents(spark, sf_dir), path), path)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op8_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Backoff scores over one to three words; one seventh of the ids is held out of learning."""
    return lm.backoff_scores(_documents(spark, sf_dir)).drop("prior")


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of each text and of its edit by the next."""
    return merkle.edit_likeness(_documents(spark, sf_dir))


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every twentieth vector."""
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), k=20)


QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_near_dedup": op2_near_dedup,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_token_counts": op4_token_counts,
    "op5_token_file": op5_token_file,
    "op6_toxicity": op6_toxicity,
    "op7_bpe": op7_bpe,
    "op8_lm_scores": op8_lm_scores,
    "op9_fingerprints": op9_fingerprints,
    "op10_nearest": op10_nearest,
}

ORACLE: dict[str, str] = {
    "op1_mixing": mixing.oracle(),
    "op2_near_dedup": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
sh AS (
  SELECT DISTINCT doc_id, s FROM (SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS s FROM w)),
n AS (SELECT doc_id, count(s) AS n FROM w LEFT JOIN sh USING (doc_id) GROUP BY doc_id),
links AS MATERIALIZED (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL) p
  JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)),
reach AS (SELECT doc_id, doc_id AS other FROM w UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other)
SELECT n.doc_id, n.n AS n_shingles, c.component_id, n.doc_id = c.component_id AS kept FROM n JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) c ON c.doc_id = n.doc_id""",
    "op10_nearest": """
WITH v AS (
  SELECT vec_id, min(embedding) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
  GROUP BY vec_id),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20""",
}
