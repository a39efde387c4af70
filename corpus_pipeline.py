"""A training corpus from ``documents``: five stages, each written as Parquet and read again.

1. quality: the factorisation machine rejects documents that it scores below its threshold.
2. exact: of texts equal but for white space, the longest stays.
3. near: of each group of documents linked by their n-grams, one stays.
4. mix: the documents are put into the order in which their sources interleave by target weight.
5. pack: documents are tokenized and packed into sequences; one row per piece.
   Pieces of a length are dealt, and sequences numbered, in the mixture's order.

All stages but the last return the columns of their input. SQL cannot express
the first and the third, so there is no ORACLE_SQL; the tests hold the stages
against brute force.

Defined cases, in every stage: a null text counts as empty; empty texts are
scored, are equal to one another, and pack as their end id; a null doc_id is a
name like any other, but loses ties; a null source is the source ''; rows that
are equal in all are one document to the exact stage, which keeps one of them;
documents without a word are near one another; ties go to the least doc_id;
very long texts are handled whole; an empty table gives an empty result;
further columns are kept, whatever their names, up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rowlens.llm import exact_dedup, jaccard_join, mixing, packing, quality
from rowlens.llm.common import cut, table
from rowlens.llm.queries import tokenizer

TOKENIZER = "byte_bpe_50k.json"


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep(docs, table(spark, sf_dir, "labels"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.dedup(docs)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs, keep=True)


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs, order = mixing.written_order(docs)
    return packing.pack(docs, tokenizer(TOKENIZER), order=order)


STAGES = [("quality", quality_stage), ("exact", exact_stage), ("near", near_stage), ("mix", mix_stage), ("pack", pack_stage)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, over the whole of documents."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs)
    return docs
