"""The corpus pipeline: quality classifier, line dedup, near-dedup, decontamination, encoding.

Each stage takes (spark, docs, sf_dir), works on all that the one before it kept, and returns a DataFrame
that is written and read again as the next one's ``docs``.  All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skygrid.llm import decontaminate, gam, line_chunks, order_minhash, piece_offsets
from skygrid.llm.common import cut
from skygrid.llm.queries import PIECE_MODEL, table, tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return gam.keep_good(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated chunks of lines go; documents that lose all their words go."""
    return line_chunks.dedup_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays."""
    return order_minhash.keep_first(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go; single benchmark passages are cut out of the others."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and of the decoded text."""
    return piece_offsets.encode_documents(docs, tokenizer_path(PIECE_MODEL), "digests")


STAGES = [("quality classifier", quality), ("line dedup", lines), ("near-dedup", near_duplicates), ("decontamination", benchmark), ("piece encoding", encode)]

#: Learnt scores and sketches have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = cut(stage(spark, docs, sf_dir), f"stage{number}")
    return docs
