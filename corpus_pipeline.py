"""A corpus pipeline: toxic documents and copies go, near copies are thinned, sources are mixed, texts are encoded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from zonalis.llm import byte_bpe, exact_dedup, mixing, ngram_join, toxicity
from zonalis.llm.shared import load, written


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without the toxic ones: whole rows, with null or repeated doc_id too; null text is scored as empty; an empty table stays empty."""
    return toxicity.without_toxic(docs, load(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text that differs after lower-casing A-Z, that of the largest doc_id; null text counts as empty."""
    return exact_dedup.keep_one(docs)


def thin_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the smallest doc_id; documents without words stay."""
    return ngram_join.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as their source's target says, 0 to 3 times and rounded; a null source is a source."""
    return mixing.mixed(docs)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each row of docs: doc_id, n_tokens and digests of its ids and of what they decode to; null text has no ids."""
    import public_tokenizers

    return byte_bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", reject_toxic),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", thin_near_copies),
    ("mixing", mix_sources),
    ("byte-level BPE", encode_texts),
]

#: The first stage's scores and the last stage's ids have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written and read again as the next one's documents; the last one's rows."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
