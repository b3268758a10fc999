"""A training-corpus pipeline: quality, line dedup, near dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the
columns of documents.  run() applies them to documents, each stage's result written as Parquet and read again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import common, linededup, mixing, neardup, packing, quality


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on the labels that are not held out, doesn't reject.

    A null text is scored as an empty one; rows are judged one by one, so repeated rows and rows without an id are
    kept or rejected by their texts.  Without labels of both kinds every document is kept.
    """
    model = quality.fit(docs.select("doc_id", "text"), quality.known_labels(spark, sf_dir))
    return quality.scored(docs, model, score_col="_score").where(F.col("_score") >= quality.THRESHOLD).select(*_columns(docs))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that an earlier line repeats; no document goes; n_chars follows the text.

    Null texts stay null.  Rows that share a doc_id but not the text are documents of their own; rows equal in both
    keep the same lines.
    """
    out = linededup.dedup_lines(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast("long"))
    return out.select(*_columns(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least doc_id of each group of near duplicates (similarity 0.8 or more).

    Rows that share a doc_id but not the text are judged by their own texts.  A row without an id goes if its group has
    a document with one; groups of rows without ids stay, as null and empty texts do.  Repeated rows are one document.
    """
    gone = common.settled(neardup.judged(docs, percent=80).where("NOT kept").select("doc_id", "t").distinct())
    packed = docs.select(F.struct(*_columns(docs)).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("t"))
    split = linededup.split_by(packed, gone)
    of = gone.select(F.col("doc_id").alias("id_"), F.col("t").alias("t_"))
    stays = split.where("_hit").join(of, (F.col("t") == F.col("t_")) & F.col("doc_id").eqNullSafe(F.col("id_")), "left_anti")
    return stays.unionByName(split.where("NOT _hit")).select("row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice.

    Null and empty texts have no words; a null source is a source of its own; repeated rows are drawn alike.
    """
    sized = docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"), F.struct(*_columns(docs)).alias("row"))
    sizes = common.settled(sized.select("doc_id", "source", "size"))
    return mixing.allot(sized, sizes=sizes).where("copies > 0").select(F.explode(F.array_repeat("row", F.col("copies").cast("int"))).alias("row")).select("row.*")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes in sequences of 2048 tokens.

    A null text is its end token alone; every row has its own pieces, repeated rows and rows without an id too.
    """
    return packing.pack(common.settled(packing.pieces(docs)))


def _columns(docs: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in docs.columns]


STAGES = [
    ("quality", keep_quality),
    ("line_dedup", drop_lines),
    ("near_dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Byte-pair encoding, fitted scores and HyperMinHash are beyond SQL; tests/llm compares each stage with a plain Python
#: version on its own input.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    folder = f"{common.shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
