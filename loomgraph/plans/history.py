"""Queries of conversation windows and event streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators import history as H
from loomgraph.streaming import chunks as K

from .base import query, table


@query("SELECT conv_id, turn, used FROM (SELECT conv_id, turn, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING)::BIGINT AS used FROM conversations) WHERE used <= 2000")
def history_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.trimmed(table(spark, sf_dir, "conversations"), 2000, F.length("text").cast("long")).select("conv_id", "turn", "used")


@query("SELECT conv_id, turn, array_to_string(list_sort(list_distinct(flatten(list([role, 't' || turn % 2]) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)))), ',') AS recent FROM conversations")
def rolling_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = F.array("role", F.concat(F.lit("t"), (F.col("turn") % 2).cast("string")))
    return H.rolling_union(table(spark, sf_dir, "conversations"), sets).select("conv_id", "turn", F.array_join("recent", ",").alias("recent"))


@query("SELECT conv_id, turn, back FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC)::INT AS back FROM conversations) WHERE back <= 3")
def last_n_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.latest(table(spark, sf_dir, "conversations"), 3).select("conv_id", "turn", "back")


@query("SELECT conv_id, n, least(n, floor(0.2::DOUBLE * n)::BIGINT + 1) AS start FROM (SELECT conv_id, count(*)::BIGINT AS n FROM conversations GROUP BY conv_id)")
def history_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).withColumn("start", H.first_window(F.col("n")))


@query("""WITH n AS (SELECT conv_id, count(*)::BIGINT AS n FROM conversations GROUP BY conv_id),
w AS (SELECT conv_id, least(n, least(n, floor(0.2::DOUBLE * n)::BIGINT + 1) + CASE conv_id % 3 WHEN 0 THEN 0 WHEN 1 THEN 2 ELSE 3 END) AS size FROM n)
SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations) JOIN w USING (conv_id) WHERE back <= size""")
def history_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows that grow by two rounds: of none, of two and none, of two and one turns; a third round comes too late."""
    c = table(spark, sf_dir, "conversations")
    amounts = [(1, F.when(F.col("conv_id") % 3 == 0, 0).otherwise(2)), (2, F.when(F.col("conv_id") % 3 == 2, 1).otherwise(0)), (3, F.lit(5))]
    rounds = F.explode(F.array(*[F.struct(F.lit(r).alias("round"), n.alias("more")) for r, n in amounts])).alias("r")
    requests = c.select("conv_id").distinct().select("conv_id", rounds).select("conv_id", "r.round", "r.more")
    return H.grown(c, requests, rounds=2).select("conv_id", "turn")


@query("""WITH k AS (SELECT conv_id, turn, role = 'user' AS tool FROM conversations WHERE role <> 'user' OR length(text) >= 100),
h AS (SELECT *, CASE WHEN tool THEN coalesce((SELECT min(b.turn) FROM k b WHERE b.conv_id = a.conv_id AND b.turn > a.turn AND NOT b.tool), turn) ELSE turn END AS host FROM k a)
SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY host, tool, turn)::INT AS place FROM h""")
def step_reorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns stand for tool steps; short ones have no output."""
    return H.reordered(table(spark, sf_dir, "conversations"), F.col("role") == "user", F.length("text") >= 100).select("conv_id", "turn", "place")


@query("""SELECT user_id, round(sum(value), 4) AS number, string_agg(event_type[1:1], '' ORDER BY event_id) AS string, string_agg(event_type, ',' ORDER BY event_id) AS items, array_to_string(list_sort(list_distinct(list(event_type))), ',') AS item_set, bool_or(value > 50) AS any_flag FROM events GROUP BY user_id""")
def props_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.col("value").alias("number"), F.substring("event_type", 1, 1).alias("string"), F.col("event_type").alias("item"), (F.col("value") > 50).alias("flag"))
    out = H.merged_props(e, "user_id", "event_id")
    return out.select("user_id", F.round("number", 4).alias("number"), "string", F.array_join("items", ",").alias("items"), F.array_join("item_set", ",").alias("item_set"), "any_flag")


@query("SELECT time_bucket(INTERVAL '10 minutes', ts) AS window_start, count(*)::BIGINT AS n FROM events GROUP BY 1")
def chunk_flush_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.flush_windows(table(spark, sf_dir, "events"), "10 minutes")


@query("SELECT event_type, count(*)::BIGINT AS n, sum(CAST(json_extract(props, '$.k') AS BIGINT))::BIGINT AS k FROM events GROUP BY event_type")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_type", F.from_json("props", "k BIGINT").alias("p"))
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("p.k").alias("k"))
