"""The corpus pipeline: its stages in order, each a call of one operator of ``loomshift.llm``.

A stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. All but the last return the columns of
documents, so the mixture shows in which rows are repeated and in the order that they are written in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomshift.llm import linededup, mixing, pieces, simhash
from loomshift.llm import toxicity as tox
from loomshift.llm.common import delete_path, quoted, scratch, table


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are toxic with a probability of one half or more go."""
    return tox.drop_toxic(docs, tox.train(docs.select("doc_id", "text"), table(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier line of any document resembles go; n_chars follows the text."""
    kept = linededup.line_dedup(docs)
    columns = {c: F.length("text").cast(t).alias(c) for c, t in docs.dtypes if c == "n_chars"}
    return kept.select(*(columns.get(c, F.col(quoted(c))) for c in docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest doc_id stays: shingles of five words, radius two."""
    return simhash.simhash_dedup(docs, width=5)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources take their target weights: every document is used, those of small sources may be repeated."""
    mixed = mixing.mixture(docs)
    ordered = mixed.repartitionByRange("mix_block", "mix_order").sortWithinPartitions("mix_block", "mix_order")
    return ordered.select(*(F.col(quoted(c)) for c in docs.columns))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' ids, and the texts that they decode to."""
    import public_tokenizers

    return pieces.encode_pieces(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("simhash_near_dedup", near_dedup), ("mixing", mix), ("sentencepiece", encode)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents, each written as Parquet and reread."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            delete_path(spark, before)
        before = path
    return docs
