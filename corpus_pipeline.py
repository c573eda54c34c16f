"""A corpus pipeline: toxicity, near-duplicates, repeated strings, source mixing, BPE ids.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the last return the
columns of ``docs``, further ones too. Null and empty texts pass every stage; null ids stay null; an
empty table gives empty stages. ``run`` writes each stage's rows as Parquet in the shared folder and reads them
again as the next stage's input, so a lost executor costs one stage at most.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm import mixing, near_dedup, suffix_dedup, tokens, toxicity
from quillgraph.llm.base import shared_dir, table


def _columns(docs: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in docs.columns]


def _unused(docs: DataFrame, name: str) -> str:
    """A column name that the documents do not have."""
    while name in {c.lower() for c in docs.columns}:
        name = f"_{name}"
    return name


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the lexicon, learned from the labels of these documents, does not reject."""
    lexicon = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    value, mark = _unused(docs, "toxic_score"), _unused(docs, "toxic")
    return toxicity.score(docs, lexicon, (value, mark)).filter(F.col(mark) == 0).select(*_columns(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: five-word shingles at 80 per cent."""
    return near_dedup.one_of_each(docs, near_dedup.Params(shingle=5, percent=80)).select(*_columns(docs))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without bytes of 100-byte strings that start earlier; a character cut in part goes whole.

    Documents of which nothing is left go. ``n_chars`` follows a text that has changed; others, null
    ones too, stay as they are.
    """
    none = _unused(docs, "none")
    carry = (*[c for c in docs.columns if c not in ("doc_id", "text")], none)
    out = suffix_dedup.remove_repeats(docs.withColumn(none, F.col("text").isNull()), suffix_dedup.Params(length=100), keep_text=True, carry=carry, whole=True)
    out = out.filter("n_removed < n_bytes OR n_bytes = 0")
    new = F.col("kept").cast("string")
    own = {"doc_id": F.col("doc_id"), "text": F.when(~F.col(f"`_{none}`"), new)}
    if "n_chars" in docs.columns:
        own["n_chars"] = F.when(F.col("n_removed") > 0, F.length(new)).otherwise(F.col("_n_chars")).cast(docs.schema["n_chars"].dataType)
    return out.select(*[own.get(c, F.col(f"`_{c}`")).alias(c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once, rare sources up to four times, towards an even mixture."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, ids, n_tokens, n_bytes``: ids of whole texts and the length they decode to."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    out = tokens.encode_and_decode(docs, path)
    return out.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), F.octet_length("decoded").cast("long").alias("n_bytes"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("suffix_dedup", cut_repeats),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: Suffix arrays and BPE have no SQL form; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
