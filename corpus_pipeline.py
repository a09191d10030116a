"""A training-corpus pipeline: five stages over documents, each written as Parquet and read again as the next one's input.

Every stage works on all that its predecessor kept. The first four return the columns of documents; the last adds the
piece ids of each text. Rows without an id pass the stages that compare documents unharmed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.jaccard import shingle_components
from graphloom.llm.lines import dedup_lines
from graphloom.llm.pieces import encode_texts
from graphloom.llm.quality import keep_good
from graphloom.llm.queries import PIECES, tokenizer_path
from graphloom.llm.semantic import keep_clean
from graphloom.runtime import stored, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from labels, doesn't reject."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the blocks of lines that an earlier document holds; n_chars follows the text."""
    left = dedup_lines(docs)
    return left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else left


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group of linked documents; all rows with an id that stays do."""
    gone = shingle_components(docs).where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return keep_clean(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, text and ids: the pieces of the whole text, from which decode_ids() gives it back."""
    return encode_texts(docs.select("doc_id", "text"), tokenizer_path(PIECES))


STAGES = [("quality classifier", quality), ("line dedup", line_dedup), ("n-gram Jaccard join", near_duplicates), ("benchmark decontamination", decontaminate), ("SentencePiece encoding", encode)]

#: Learned models, alignments and piece ids have no SQL form; tests/llm holds each operator against plain versions, test_pipeline.py what the stages keep.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table documents."""
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs = docs if number == len(STAGES) - 1 else stored(docs, f"pipeline-{number}")
    return docs
