"""Queries of patches that need leniency, of streams of generated text, and of their logs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions import blocks as B
from loomgraph.functions import text as T
from loomgraph.operators import patch as P
from loomgraph.sources.shared import shared_dir
from loomgraph.streaming import chunks as C
from loomgraph.streaming import markers as M

from .base import query, table


def _key(c: str = "doc_id") -> F.Column:
    return F.col(c).cast("string")


@query("""SELECT doc_id AS patch_id, 'd' || doc_id AS path, 'UPDATE' AS action, 'one' || chr(10) || 'TWO' || chr(10) || 'added' || chr(10) || text AS new_content, NULL::VARCHAR AS error FROM documents
UNION ALL SELECT -doc_id - 1, NULL, NULL, NULL, 'd' || doc_id || ': context not found: no such line' FROM documents""")
def patch_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patches whose context and deleted lines differ from the file in white space, and ones that name no line of it."""
    d = table(spark, sf_dir, "documents")
    files = d.select(F.concat(F.lit("d"), _key()).alias("path"), F.concat(F.lit("one\ntwo  \n"), "text").alias("content"))
    head = F.concat(F.lit("*** Begin Patch\n*** Update File: d"), _key(), F.lit("\n"))
    lenient = d.select(F.col("doc_id").alias("patch_id"), F.concat(head, F.lit("   one \n-\ttwo\n+TWO\n+added\n*** End Patch")).alias("text"))
    wrong = d.select((-F.col("doc_id") - 1).alias("patch_id"), F.concat(head, F.lit(" no such line\n+x\n*** End Patch")).alias("text"))
    return P.applied(lenient.union(wrong), files).select("patch_id", "path", "action", "new_content", "error")


@query("""SELECT doc_id, '*** Begin Patch' || chr(10) || '*** Add File: n' || doc_id || chr(10) || '+' || coalesce(lang, '?') || chr(10) AS patch FROM documents
UNION ALL SELECT doc_id, '*** Update File: d' || doc_id || chr(10) || '+x' || chr(10) || '*** End Patch' FROM documents""")
def patch_recovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patches that lack their end marker, and ones that lack their begin marker."""
    d = table(spark, sf_dir, "documents")
    open_ = F.concat(F.lit("why\n*** Begin Patch\n*** Add File: n"), _key(), F.lit("\n+"), F.coalesce("lang", F.lit("?")), F.lit("\n"))
    bare = F.concat(F.lit("*** Update File: d"), _key(), F.lit("\n+x\n*** End Patch\nso far"))
    rows = d.select("doc_id", F.explode(F.array(open_, bare)).alias("text"))
    return rows.select("doc_id", F.explode(B.patches(F.col("text"))).alias("patch"))


@query("SELECT conv_id, turn, replace(replace(text, 'the', ''), 'en ', '') AS bare FROM conversations")
def prompts_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.without_prompts(F.concat(F.lit("a prompt\n"), "text"), ["a prompt\n", "the", "en "]).alias("bare"))


@query("""SELECT c.url, c.is_git FROM supplier, (SELECT unnest([
 {'url': 'https://host.example/u/r' || s_suppkey || '.git', 'is_git': true}, {'url': 'git@host.example:u/r' || s_suppkey, 'is_git': true}, {'url': 'ssh://host.example:22/r' || s_suppkey || '/', 'is_git': true},
 {'url': 'ftp://host.example/r' || s_suppkey, 'is_git': false}, {'url': 'host.example/r' || s_suppkey, 'is_git': false}, {'url': 'https://host.example/a b' || s_suppkey, 'is_git': false}]) AS c)""")
def git_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    forms = [("https://host.example/u/r", ".git"), ("git@host.example:u/r", ""), ("ssh://host.example:22/r", "/"), ("ftp://host.example/r", ""), ("host.example/r", ""), ("https://host.example/a b", "")]
    urls = F.array(*[F.concat(F.lit(a), _key("s_suppkey"), F.lit(b)) for a, b in forms])
    return table(spark, sf_dir, "supplier").select(F.explode(urls).alias("url")).select("url", T.is_git_url(F.col("url")).alias("is_git"))


# ---------------------------------------------------------------- marker machine


_SESSION = "conv_id || '/' || turn AS session_id"


def _sessions(spark: SparkSession, sf_dir: str, text) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return M.chunked(c.select(F.concat_ws("/", "conv_id", "turn").alias("session_id"), text.alias("text")), 30)


@query(f"SELECT {_SESSION}, 'steps' AS marker_id, text AS raw_content, false AS complete FROM conversations UNION ALL SELECT {_SESSION}, '', 'intro' || chr(10), true FROM conversations")
def marker_incomplete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A block whose end never comes is flushed as incomplete."""
    rows = M.blocks(_sessions(spark, sf_dir, F.concat(F.lit("intro\n*** Begin Steps\n"), "text")))
    return rows.select("session_id", "marker_id", "raw_content", "complete")


_NAMES = ["Patch", "Steps", "Commit", "Reasoning", "Summary", "Context Identifiers", "Modify Identifiers"]


@query(f"SELECT {_SESSION}, i::BIGINT - 1 AS block_no, (['patch', 'steps', 'commit', 'reasoning', 'summary', 'context_identifiers', 'modify_identifiers'])[i] AS marker_id, i || ' ' || text || chr(10) AS raw_content FROM conversations, unnest(range(1, 8)) AS r(i)")
def marker_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All seven kinds of blocks in one session, one behind the other."""
    parts = [F.concat(F.lit(f"*** Begin {n}\n{i} "), "text", F.lit(f"\n*** End {n}\n")) for i, n in enumerate(_NAMES, 1)]
    return M.blocks(_sessions(spark, sf_dir, F.concat(*parts))).select("session_id", "block_no", "marker_id", "raw_content")


@query(f"""SELECT {_SESSION}, 0::BIGINT AS block_no, 'commit' AS marker_id, text AS raw_content, false AS complete FROM conversations
UNION ALL SELECT {_SESSION}, 1, '', 'behind it', true FROM conversations""")
def marker_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A control token ends what is open; what follows is text again."""
    texts = F.array(F.concat(F.lit("*** Begin Commit\n"), "text"), F.lit("<FINISHED-GEN>"), F.lit("behind it"))
    c = table(spark, sf_dir, "conversations").select(F.concat_ws("/", "conv_id", "turn").alias("session_id"), F.posexplode(texts).alias("seq", "chunk"))
    rows = M.blocks(c.withColumn("seq", F.col("seq").cast("long")))
    return rows.select("session_id", "block_no", "marker_id", "raw_content", "complete")


@query(f"SELECT {_SESSION}, turn::VARCHAR AS turn, role, NULL::VARCHAR AS missing FROM conversations")
def marker_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields that a marker finds by pattern in its block; one that isn't there is none."""
    marker = M.Marker("note", "<<", ">>", fields=(("turn", r"^TURN: (\d+)"), ("role", r"^ROLE:(.*?)$"), ("missing", r"^NONE: (.*)")))
    c = table(spark, sf_dir, "conversations")
    text = F.concat(F.lit("<<TURN: "), F.col("turn").cast("string"), F.lit("\nROLE:  "), "role", F.lit(" \n>>"))
    rows = M.blocks(M.chunked(c.select(F.concat_ws("/", "conv_id", "turn").alias("session_id"), text.alias("text")), 7), (marker,)).where("marker_id = 'note'")
    return rows.select("session_id", *[F.col("fields").getItem(n).alias(n) for n in ("turn", "role", "missing")])


# ---------------------------------------------------------------- logs of chunks


def _stream(spark: SparkSession, sf_dir: str, folder: str) -> DataFrame:
    """The chunks of all turns, each session ended by a control token, as a stream."""
    rows = _sessions(spark, sf_dir, F.col("text"))
    ends = rows.select("session_id").distinct().select("session_id", F.lit(10**6).cast("long").alias("seq"), F.lit("<FINISHED-GEN>").alias("chunk"))
    rows.unionByName(ends).write.parquet(f"{folder}/in")
    return spark.readStream.schema("session_id string, seq long, chunk string").parquet(f"{folder}/in")


@query(f"SELECT {_SESSION}, greatest(ceil(length(text) / 30), 1)::BIGINT AS n, text FROM conversations")
def chunk_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a log of chunks holds when the stream has ended: every chunk once, no control tokens."""
    folder = f"{shared_dir(spark)}/log-{uuid.uuid4().hex}"
    C.logged(_stream(spark, sf_dir, folder), f"{folder}/out", f"{folder}/state").awaitTermination()
    log = spark.read.schema("session_id string, seq long, chunk string").parquet(f"{folder}/out")
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "chunk"))), lambda x: x["chunk"]), "")
    return log.groupBy("session_id").agg(F.count(F.lit(1)).alias("n"), whole.alias("text"))


@query("SELECT c.consumer, conv_id, sum(length(text))::BIGINT AS chars FROM conversations, (SELECT unnest(['a', 'b']) AS consumer) AS c GROUP BY ALL")
def chunk_fan_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two consumers of one stream get every chunk; each writes a micro-batch to a folder of its number, so a repeated
    one counts once."""
    folder = f"{shared_dir(spark)}/fan-{uuid.uuid4().hex}"

    def writes(name: str):
        return lambda batch, number: batch.where(~F.col("chunk").isin(*M.CONTROL)).write.mode("overwrite").parquet(f"{folder}/out/consumer={name}/batch={number}")

    C.fanned_out(_stream(spark, sf_dir, folder), [writes("a"), writes("b")], f"{folder}/state").awaitTermination()
    got = spark.read.schema("session_id string, seq long, chunk string, consumer string, batch long").parquet(f"{folder}/out")
    conv = F.split("session_id", "/")[0].cast("long")
    return got.groupBy("consumer", conv.alias("conv_id")).agg(F.sum(F.length("chunk")).cast("long").alias("chars"))
