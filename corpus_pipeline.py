"""The training-data pipeline: quality, line de-duplication, near-duplicates, decontamination, token ids.

Each stage takes (spark, docs, sf_dir) and returns a frame that is written and read again as the docs of
the next one. All but the last return the columns of ``documents``.

Defined cases (each operator's docstring has its own): rows with null ids pass all stages but where
their text is rejected; an empty table passes as an empty table; further columns of documents are passed
on by all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import common, decontam, line_dedup, quality, queries, simhash, spm


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier accepts; it learns from the ids of two thirds of the labels."""
    labels = common.read(spark, sf_dir, "labels").filter(common.fold(F.col("doc_id"), 3) != 1)
    return quality.keep(docs, quality.fit(docs, labels), least=0.5)


def drop_spread_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that stand on ten sites or more and in as many different texts; n_chars follows the text."""
    cleaned = line_dedup.remove_spread_lines(docs, min_sites=10)
    if "n_chars" in docs.columns:
        cleaned = cleaned.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return cleaned


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (shingles of five words, similarity 0.8), that of the smallest id."""
    return simhash.one_of_each(docs, words=5, least=0.8)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    return decontam.clean(docs, common.read(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids of each document's whole text."""
    coded = spm.encode_decode(docs, queries.tokenizer_path("piece_bpe_32k.model"))
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality classifier", keep_good),
    ("line dedup", drop_spread_lines),
    ("SimHash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("SentencePiece encoding", encode),
]

#: Compression, sketches, fingerprints and merges are not expressible in SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to documents, each but the last written to the shared folder and read again."""
    docs = common.read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), "stage", instead=[docs])
    return STAGES[-1][1](spark, docs, sf_dir)
