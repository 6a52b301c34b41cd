"""The corpus pipeline: five stages over documents, each written as Parquet and reread.

Every stage works on all rows that the one before kept, and all but the last return the
columns of documents, extra ones of any name too.  Results that the stages share: an empty
table stays empty; null ids and nulls in other columns pass; repeated rows are rows of their
own until the exact stage; very long texts are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textloom.llm import bpe, common, exact_dedup, mixing, near_dedup, quality


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the threshold table rejects go; null and empty texts have no words and go."""
    return quality.quality_filter(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest doc_id stays; a null id is the smallest, and of rows with equal id and text one stays."""
    return exact_dedup.exact_dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the one with the smallest doc_id stays; null ids sort last.  Texts without words stay, each a class of its own."""
    return near_dedup.near_dedup(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Smaller sources repeat, up to two epochs; every document stays at least once.  A null source is a source; ties in a block share one fate."""
    return mixing.realised(docs, entropy=None, max_epochs=2.0, cover=True)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and token ids of each row, with digests of ids and decoded text; empty texts have no ids."""
    import public_tokenizers

    return bpe.encode(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=True)


STAGES = [("quality rules", quality_rules), ("exact dedup", exact), ("MinHash near-dedup", near), ("mixing sources", mix), ("BPE encoding", encode)]
#: Weighted MinHash, bisection and BPE have no SQL form; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.written(docs)
    return docs
