"""A corpus pipeline of five operators. Each stage takes what its predecessor kept; all but the last return documents' columns.

1. toxicity: documents that the toxicity score rejects go (labels come from the labels table of sf_dir).
2. exact dedup: of equal texts, the row with the largest doc_id stays.
3. near dedup: of documents whose five-word shingle sets are similar to 0.8 or more, directly or through others, one stays.
4. mixing: documents are sampled towards tempered shares of sources, languages and topics; SHARE of the tokens stay.
5. packing: token sequences of at most 4096 ids, one row per piece.

Defined cases: null and empty texts are equal texts without words, of which one stays, and are a single end id in the
end; documents with a null id are scored, compared by text, never near copies, sampled by their text and packed under
null; of rows that repeat id and text one stays; very long texts are read whole by every stage and cut only into pieces;
null languages and sources are values of their own; columns besides id, text, lang and source may have any names and
values, and every stage but the last returns them as they are; an empty table runs through to an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from veilspark.llm import exact_dedup, mixing, near_dedup, packing, toxicity
from veilspark.llm.common import Scratch

SHARE = 0.9


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.sample(docs, share=SHARE)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", reject_toxic),
    ("exact dedup", drop_exact_copies),
    ("near dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

ORACLE_SQL = None  # learned scores and packing aren't SQL; tests/llm/test_pipeline.py checks each stage against plain code


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; each result is written as Parquet and read again as the next one's documents."""
    work = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        docs = work.put(stage(spark, docs, sf_dir), f"stage-{number}")
    return docs
