"""Token counts of flat token files by a separator scan.

A flat file is nothing but token ids of two or four bytes, with an end-of-document id behind each document, and no
index.  Files are cut into blocks of a fixed number of tokens.  Each block is searched on its own, vectorised, for
the separators; a document may start many blocks before it ends, so the blocks' counts and last separators are
joined up by a prefix scan.

Scale: the scan moves one row per block, never tokens.  It runs in two levels: within runs of `run_blocks` blocks,
then over one row per run, so that a file with a third of all tokens is scanned by many tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .packing import encoder

BLOCK_TOKENS = 1 << 16
END_ID = 50256


def read_files(spark: SparkSession, path: str, width: int = 2, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(file, block, payload) of flat files of up to 2 GB each; bytes behind the last whole token don't count."""

    def cut(batches):
        size = block_tokens * width
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = content.as_py()
                for i in range(0, max(len(data) // width * width, 1), size):
                    yield pa.record_batch([pa.array([name]), pa.array([i // size], pa.int64()), pa.array([data[i : min(i + size, len(data) // width * width)]], pa.binary())], names=["file", "block", "payload"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(cut, "file string, block long, payload binary")


def flat_blocks(docs: DataFrame, end_id: int = END_ID, block_tokens: int = BLOCK_TOKENS, path: str | None = None, width: int = 2) -> DataFrame:
    """(file, block, payload, ids): the tokens of docs (doc_id, text) as one flat file per partition, `width` bytes each.

    ids has the documents whose separator is in the block: what the file itself doesn't hold.  Null and empty texts
    have no tokens; null ids and repeated rows stay, each as a document of its own; other columns are not read; no
    documents, no blocks.  The string of a special token in a text is ordinary text, so none is taken for a separator.
    An id that doesn't fit into `width` bytes is an error.
    """

    def tokenised(batches):
        from pyspark import TaskContext

        encode, name = encoder(path).encode_ordinary, f"part-{TaskContext.get().partitionId():05d}"
        held, size, number, ids = [], 0, 0, []

        def block(tokens: np.ndarray) -> pa.RecordBatch:
            ends = int((tokens == end_id).sum())
            if int(tokens.max()) >> 8 * width:
                raise ValueError(f"token id {int(tokens.max())} needs more than {width} bytes")
            row = [pa.array([name]), pa.array([number], pa.int64()), pa.array([tokens.astype(f"<u{width}").tobytes()], pa.binary()), pa.array([ids[:ends]], pa.list_(pa.int64()))]
            del ids[:ends]
            return pa.record_batch(row, names=["file", "block", "payload", "ids"])

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                held.append(np.array([*encode(text.as_py() or ""), end_id], np.uint32))
                ids.append(doc)
                size += len(held[-1])
                if size >= block_tokens:
                    flat = np.concatenate(held)
                    whole = size // block_tokens * block_tokens
                    for at in range(0, whole, block_tokens):
                        yield block(flat[at : at + block_tokens])
                        number += 1
                    held, size = [flat[whole:]], size - whole
        if size:
            yield block(np.concatenate(held))

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tokenised, "file string, block long, payload binary, ids array<long>")


def scan(blocks: DataFrame, end_id: int = END_ID, width: int = 2) -> DataFrame:
    """blocks without payload, and n (tokens) and ends (positions behind the block's separators)."""
    others = [f for f in blocks.schema.fields if f.name != "payload"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in others) + ", n long, ends array<int>"

    def searched(batches):
        for batch in batches:
            tokens = [np.frombuffer(p.as_py() or b"", f"<u{width}") for p in batch.column("payload")]
            ends = [np.flatnonzero(t == end_id) + 1 for t in tokens]
            yield pa.record_batch([*(batch.column(f.name) for f in others), pa.array([len(t) for t in tokens], pa.int64()), pa.array(ends, pa.list_(pa.int32()))], names=[*(f.name for f in others), "n", "ends"])

    return blocks.mapInArrow(searched, schema)


def documents(scanned: DataFrame, run_blocks: int = 1024) -> DataFrame:
    """One row per document: file, number (from 0 in its file), start, n_tokens (without the separator), closed,
    and doc_id if scanned has ids.

    Tokens behind a file's last separator are one more document that is not closed.  Adjacent separators enclose
    a document of no tokens.  Files without tokens have no documents.  scanned must be settled.
    """
    before = Window.partitionBy("file", "run").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    b = scanned.withColumn("run", F.floor(F.col("block") / run_blocks)).withColumn("k", F.size("ends").cast("long")).withColumn("last", F.when(F.col("k") > 0, F.element_at("ends", -1).cast("long")))
    b = b.withColumn("at", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("docs", F.coalesce(F.sum("k").over(before), F.lit(0)))
    b = b.withColumn("end", F.col("at") + F.col("last")).withColumn("open", F.max("end").over(before))
    runs = b.groupBy("file", "run").agg(F.sum("n").alias("n"), F.sum("k").alias("k"), F.max("end").alias("end"))
    ahead = Window.partitionBy("file").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("run_at", F.coalesce(F.sum("n").over(ahead), F.lit(0))).withColumn("run_docs", F.coalesce(F.sum("k").over(ahead), F.lit(0)))
    runs = runs.withColumn("run_end", F.col("run_at") + F.col("end")).withColumn("run_open", F.max("run_end").over(ahead))
    whole = Window.partitionBy("file")
    runs = runs.withColumn("tokens", F.sum("n").over(whole)).withColumn("final", F.coalesce(F.max("run_end").over(whole), F.lit(0))).withColumn("all_docs", F.sum("k").over(whole))
    names = runs.select(F.col("file").alias("f"), F.col("run").alias("r"), "run_at", "run_docs", "run_open", "tokens", "final", "all_docs")
    b = b.join(names, (F.col("file") == F.col("f")) & (F.col("run") == F.col("r")))
    at = F.col("run_at") + F.col("at")
    first = F.coalesce(F.col("run_at") + F.col("open"), F.col("run_open"), F.lit(0))
    has_ids = "ids" in scanned.columns
    spans = F.transform("ends", lambda e, i: F.struct((F.col("run_docs") + F.col("docs") + i).alias("number"), F.when(i == 0, first).otherwise(at + F.element_at("ends", F.greatest(i, F.lit(1)))).alias("start"), (at + e).alias("end"), (F.element_at("ids", i + 1) if has_ids else F.lit(None).cast("long")).alias("doc_id")))
    closed = b.select("file", F.explode(spans).alias("d")).select("file", "d.number", "d.start", (F.col("d.end") - F.col("d.start") - 1).alias("n_tokens"), F.lit(True).alias("closed"), "d.doc_id")
    rest = runs.where((F.col("run_at") + F.col("n") == F.col("tokens")) & (F.col("tokens") > F.col("final")) & (F.col("n") > 0))
    rest = rest.select("file", F.col("all_docs").alias("number"), F.col("final").alias("start"), (F.col("tokens") - F.col("final")).alias("n_tokens"), F.lit(False).alias("closed"), F.lit(None).cast("long").alias("doc_id"))
    out = closed.unionByName(rest)
    return out if has_ids else out.drop("doc_id")


def op3_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and n_tokens of every document, found again in flat token files of the whole table."""
    docs = common.table(spark, sf_dir, "documents")
    found = documents(common.settled(scan(flat_blocks(docs))))
    return found.select("doc_id", "n_tokens", "file", "number", "start", "closed")
