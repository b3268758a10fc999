"""Queries of text functions and of blocks inside generated text."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions import blocks as B
from loomgraph.functions import text as T
from loomgraph.operators import patch as P
from loomgraph.sources.shared import shared_dir
from loomgraph.streaming import markers as M

from .base import query, table


def _terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.explode(T.tokens(F.col("text"))).alias("term")).distinct()


def _stem_sql(w: str) -> str:
    rules = " ".join(f"WHEN ends_with({w}, '{s}') AND length({w}) - {len(s)} + {len(e)} >= 2 THEN {w}[:-{len(s) + 1}] || '{e}'" for s, e in T.STEM_RULES)
    return f"CASE WHEN length({w}) <= 3 THEN {w} {rules} ELSE {w} END"


@query(f"SELECT term, {_stem_sql('term')} AS stem FROM (SELECT DISTINCT term FROM tok)")
def stem_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stems of the vocabulary: once per distinct term, however often it is used."""
    return _terms(spark, sf_dir).withColumn("stem", T.stem(F.col("term")))


_MAP = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in T.ABBREVIATIONS.items()) + "}"


@query(f"WITH w AS (SELECT DISTINCT term FROM tok UNION SELECT unnest(map_keys({_MAP}))) SELECT term, coalesce({_MAP}[term] || ' ', '') || term AS words FROM w")
def abbrev_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    short = spark.range(1).select(F.explode(F.array(*map(F.lit, T.ABBREVIATIONS))).alias("term"))
    return _terms(spark, sf_dir).union(short).distinct().select("term", F.array_join(T.abbreviation_words(F.col("term")), " ").alias("words"))


@query("SELECT p_partkey, lower(regexp_replace(name, '([a-z])([A-Z])', '\\1 \\2', 'g')) AS camel, array_to_string(list_filter(regexp_split_to_array(lower(name), '[_\\-]+'), lambda x: x <> ''), ' ') AS snake FROM (SELECT p_partkey, 'get' || upper(p_name[1:1]) || replace(p_name[2:], ' ', '_') || 'By-' || p_type AS name FROM part)")
def camel_snake_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("get"), F.upper(F.substring("p_name", 1, 1)), F.replace(F.expr("substring(p_name, 2)"), F.lit(" "), F.lit("_")), F.lit("By-"), "p_type")
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(T.camel_words(name), " ").alias("camel"), F.array_join(T.snake_words(name), " ").alias("snake"))


@query(rf"""WITH q AS (SELECT item_id, 'get_cfg ' || text AS text FROM benchmark),
w AS (SELECT item_id, list_filter(regexp_extract_all(lower(regexp_replace(text, '[^\p{{L}}\p{{N}}_\s]', ' ', 'g')), '[\p{{L}}\p{{N}}_]+'), lambda x: length(x) >= 2) AS w FROM q),
parts AS (SELECT item_id, flatten(list_transform(w, lambda x: CASE WHEN contains(x, '_') THEN list_append(list_filter(regexp_split_to_array(x, '[_\-]+'), lambda y: y <> ''), x) ELSE [x] END)) AS w FROM w),
flat AS (SELECT item_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM parts),
once AS (SELECT item_id, x, min(i) AS i FROM flat WHERE length(x) >= 2 GROUP BY ALL),
more AS (SELECT item_id, unnest(list_append(coalesce(string_split({_MAP}[x], ' '), []), x)) AS x, i, generate_subscripts(list_append(coalesce(string_split({_MAP}[x], ' '), []), x), 1) AS j FROM once),
stems AS (SELECT item_id, {_stem_sql('x')} AS x, i * 100 + j AS i FROM more),
final AS (SELECT item_id, x, min(i) AS i FROM stems WHERE length(x) >= 2 GROUP BY ALL)
SELECT item_id, string_agg(x, ' ' ORDER BY i) AS words FROM final GROUP BY item_id""")
def preprocess_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", T.preprocess(F.concat(F.lit("get_cfg "), "text")).alias("words"))


@query()
def normalised_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unicode normal form first, and camel case split."""
    return table(spark, sf_dir, "benchmark").select("item_id", T.preprocess(F.col("text"), normalise=True, lowercase_first=False, stop_words=True).alias("words"))


@query("SELECT doc_id, name, len(list_filter(regexp_extract_all(text, '[a-zA-Z0-9_]+'), lambda x: x = name))::BIGINT AS n FROM documents, (SELECT unnest(['the', 'inre', 'le', 'Oning']) AS name) WHERE contains(text, name)")
def occurrence_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often a name stands alone, for texts that contain it at all."""
    names = F.explode(F.array(*map(F.lit, ("the", "inre", "le", "Oning"))))
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", names.alias("name")).where(F.col("text").contains(F.col("name")))
    return rows.select("doc_id", "name", T.occurrences(F.col("text"), F.col("name")).alias("n"))


@query("SELECT doc_id, CASE WHEN len(string_split(text, chr(10))) <= 3 THEN text ELSE array_to_string(string_split(text, chr(10))[1:3], chr(10)) || chr(10) || regexp_extract(string_split(text, chr(10))[3], '^ *') || '...' END AS head FROM documents")
def trimmed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.trimmed(F.col("text"), 3).alias("head"))


def _marked(spark: SparkSession, sf_dir: str, word: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", "text", F.concat(F.lit("intro\n*** Begin "), F.lit(word), F.lit("\n"), "text", F.lit("\n*** End "), F.lit(word), F.lit(" \noutro")).alias("marked"))


@query(r"SELECT conv_id, turn, 1::BIGINT AS n, regexp_replace(regexp_replace(text, '^\s+', ''), '\s+$', '') AS block FROM conversations")
def block_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _marked(spark, sf_dir, "Commit").withColumn("b", B.blocks(F.col("marked")))
    return rows.select("conv_id", "turn", F.size("b").cast("long").alias("n"), F.element_at("b", 1).alias("block"))


_TRIM = r"regexp_replace(regexp_replace({}, '^\s+', ''), '\s+$', '')"
_LINES = r"list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(regexp_replace(x, '^\s+', ''), '\s+$', '')), lambda x: x <> '')"


@query(f"SELECT conv_id, turn, turn::INT AS step, 'turn of ' || role AS description, {_TRIM.format('array_to_string(' + _LINES + ', chr(10))')} AS instructions, role || ',' || conv_id AS context_ids, 'c' || conv_id AS modify_ids FROM conversations")
def steps_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A step whose instructions are the whole text of a turn."""
    lines = F.filter(F.transform(F.split("text", "\n", -1), B.stripped), lambda x: x != "")
    c = table(spark, sf_dir, "conversations").withColumn("body", F.array_join(lines, "\n"))
    md = F.concat(F.lit("x\n*** Begin Steps\n"), F.col("turn").cast("string"), F.lit(". **turn of "), "role", F.lit("**\n   **instructions**: "), "body", F.lit("\n   **context_identifiers**:\n     - "), "role", F.lit("\n     - "), F.col("conv_id").cast("string"), F.lit("\n   **modify_identifiers**:\n     - c"), F.col("conv_id").cast("string"), F.lit("\n---\n*** End Steps\ny"))
    rows = c.select("conv_id", "turn", F.explode(B.steps(md)).alias("s"))
    return rows.select("conv_id", "turn", "s.step", "s.description", "s.instructions", F.array_join("s.context_identifiers", ",").alias("context_ids"), F.array_join("s.modify_identifiers", ",").alias("modify_ids"))


@query(f"SELECT conv_id, turn, role, turn AS number, turn % 2 = 0 AS even, array_to_string({_LINES}, '|') AS items FROM conversations")
def field_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields before, and a list made of, all lines of a turn's text."""
    c = table(spark, sf_dir, "conversations").withColumn("body", F.regexp_replace("text", "(?m)^", "- "))
    t = F.concat(F.lit("ROLE: ["), "role", F.lit("]\nNUMBER: "), F.col("turn").cast("string"), F.lit("\nEVEN: "), F.when(F.col("turn") % 2 == 0, "True").otherwise("False"), F.lit("\n"), "body", F.lit("\n"))
    return c.select("conv_id", "turn", B.named_value(t, "ROLE").alias("role"), B.field(t, r"NUMBER: (\d+)", "int").alias("number"), B.field(t, r"EVEN: (\w+)", "bool").alias("even"), F.array_join(B.list_items(t), "|").alias("items"))


@query("SELECT doc_id AS patch_id, '*** Begin Patch' || chr(10) || '*** Update File: d' || doc_id || chr(10) || ' ' || string_split(text, chr(10))[1] || chr(10) || '+added ' || coalesce(lang, '?') || chr(10) || '*** Add File: n' || doc_id || chr(10) || '+new' || chr(10) || '*** End Patch' AS lines FROM documents")
def patch_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of a patch inside other text."""
    return _patches(spark, sf_dir).select("patch_id", B.patch_lines(F.col("text")).alias("lines"))


def _patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    first = F.substring_index("text", "\n", 1)
    return d.select(F.col("doc_id").alias("patch_id"), F.concat(F.lit("why\n*** Begin Patch\n*** Update File: d"), F.col("doc_id").cast("string"), F.lit("\n "), first, F.lit("\n+added "), F.coalesce("lang", F.lit("?")), F.lit("\n*** Add File: n"), F.col("doc_id").cast("string"), F.lit("\n+new\n*** End Patch\nend")).alias("text"))


@query("SELECT doc_id AS patch_id, 'd' || doc_id AS needed, 'n' || doc_id AS added FROM documents")
def patch_files_needed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _patches(spark, sf_dir).select("patch_id", F.array_join(B.files_needed(F.col("text")), ",").alias("needed"), F.array_join(B.files_added(F.col("text")), ",").alias("added"))


@query("""SELECT doc_id AS patch_id, 'd' || doc_id AS path, 'UPDATE' AS action, array_to_string(list_concat([string_split(text, chr(10))[1], 'added ' || coalesce(lang, '?')], string_split(text, chr(10))[2:]), chr(10)) AS new_content, NULL::VARCHAR AS error FROM documents
UNION ALL SELECT doc_id, 'n' || doc_id, 'ADD', 'new' || chr(10), NULL FROM documents""")
def patch_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A patch for every document adds a line behind its first one, and a file."""
    held = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("path"), F.col("text").alias("content"))
    return P.applied(_patches(spark, sf_dir), held).select("patch_id", "path", "action", "new_content", "error")


def _sessions(spark: SparkSession, sf_dir: str, size: int) -> DataFrame:
    rows = _marked(spark, sf_dir, "Commit").withColumn("session_id", F.concat_ws("/", "conv_id", "turn"))
    return M.chunked(rows, size, text="marked")


_BLOCKS = "SELECT conv_id || '/' || turn AS session_id, 0::BIGINT AS block_no, '' AS marker_id, 'intro' || chr(10) AS raw_content FROM conversations UNION ALL SELECT conv_id || '/' || turn, 0, 'commit', text || chr(10) FROM conversations UNION ALL SELECT conv_id || '/' || turn, 1, '', ' ' || chr(10) || 'outro' FROM conversations"


@query(_BLOCKS)
def marker_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.blocks(_sessions(spark, sf_dir, 30)).select("session_id", "block_no", "marker_id", "raw_content")


@query("SELECT conv_id || '/' || turn AS session_id, text || chr(10) AS raw_content FROM conversations")
def marker_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same through a stream, with the state of each session kept between micro-batches."""
    folder = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    _sessions(spark, sf_dir, 200).repartition(2).write.parquet(f"{folder}/in")
    chunks = spark.readStream.schema("session_id string, seq long, chunk string").parquet(f"{folder}/in")
    out = M.stream_blocks(chunks, idle_ms=None).where("marker_id = 'commit'").select("session_id", "raw_content")
    done = out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    done.awaitTermination()  # ends when all that was there is read; a failure raises
    return spark.read.schema("session_id string, raw_content string").parquet(f"{folder}/out")

