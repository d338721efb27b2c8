"""A corpus from raw documents to packed sequences: five of the training-data operators, one after another."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vecloom.llm import exact_dedup, mixing, near_dedup, packing, toxicity
from vecloom.llm._common import cut, discard, documents
from vecloom.llm.queries import TOKENIZER


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that toxicity rejects go; null ids and texts, repeated rows and empty tables as in toxicity.drop_toxic()."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, one document stays; which, and what of nulls and repeated rows, says exact_dedup.exact_dedup()."""
    return exact_dedup.drop_exact_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies (five-word shingles, Jaccard similarity 0.8 or more), one document stays; near_dedup.drop_near_copies() says which."""
    return near_dedup.drop_near_copies(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture in training order, of whole documents: those that it takes twice are there twice."""
    return mixing.mix(docs, whole=True)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences, with their ids; every row gives some, with a null text too (packing.pack())."""
    return packing.pack(docs, TOKENIZER)


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("simhash_dedup", drop_near_copies), ("mixing", mix), ("packing", pack)]

#: SQL has neither the classifier nor the fingerprints nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's result is written to the shared folder and read again, until the next one is there.

    Texts that are null or have no word leave in the mixing stage at the latest. No documents give no sequences.
    """
    docs, read = documents(spark, sf_dir), None
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            before, read = read, cut(docs)
            docs = read
            if before is not None:
                discard(before)
    return docs


QUERIES = {"pipeline": run}
ORACLES = {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
