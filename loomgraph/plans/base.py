"""Registration of queries with their SQL, and the derived tables that several of them read."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function (spark, sf_dir) under its name, with SQL that gives the same rows."""

    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = with_tables(sql)
        return f

    return register


def with_tables(sql: str) -> str:
    """sql behind the derived tables that it names."""
    names: list[str] = []
    found = [sql]
    while found:
        text = found.pop()
        for n in WITH:
            if n not in names and re.search(rf"\b{n}\b", text):
                names.append(n)
                found.append(WITH[n])
    if not names:
        return sql
    tables = ", ".join(f"{n} AS ({WITH[n]})" for n in WITH if n in names)
    head = re.match(r"\s*WITH\s+(RECURSIVE\s+)?", sql)
    return f"WITH {(head and head[1]) or ''}{tables}" + (", " + sql[head.end() :] if head else " " + sql)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: SQL of derived tables that the SQL of queries names.
WITH = {
    "tok": r"SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS term FROM documents",
    "postings": "SELECT doc_id, term, count(*)::BIGINT AS tf FROM tok GROUP BY ALL",
    "lengths": r"SELECT doc_id, len(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+'))::BIGINT AS dl FROM documents",
    "corpus": "SELECT count(*)::BIGINT AS n, avg(dl) AS avgdl FROM lengths",
    "dfs": "SELECT term, count(*)::BIGINT AS df FROM postings GROUP BY term",
    "files": "SELECT 'repo/' || lower(replace(p_brand, '#', '')) || '/' || lower(p_type) || '/' || replace(p_name, ' ', '_') || '_' || p_partkey || (['.py', '.ts', '.md', '.png', '.TXT', '.rs', '', '.json'])[p_size % 8 + 1] AS path, p_partkey AS pos, p_name, p_size FROM part",
    "tree": "SELECT DISTINCT path, CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '.' END AS parent, list_last(string_split(path, '/')) AS name, len(string_split(path, '/'))::BIGINT AS depth, node_type FROM (SELECT path, 'file' AS node_type FROM files UNION ALL SELECT array_to_string(string_split(path, '/')[1:i], '/'), 'directory' FROM files, unnest(range(1, len(string_split(path, '/')))) AS r(i))",
    "refs": "SELECT 's' || s_suppkey AS src_id, 'n' || s_nationkey AS dst_id, 'usage' AS ref_type FROM supplier UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'inheritance' ELSE 'usage' END FROM customer UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 'type_hint' FROM nation",
}


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file tree made of the parts: path, pos, p_name, p_size."""
    endings = F.array(*map(F.lit, (".py", ".ts", ".md", ".png", ".TXT", ".rs", "", ".json")))
    p = table(spark, sf_dir, "part")
    path = F.concat(F.lit("repo/"), F.lower(F.replace("p_brand", F.lit("#"), F.lit(""))), F.lit("/"), F.lower("p_type"), F.lit("/"), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_"), F.col("p_partkey").cast("string"), F.element_at(endings, F.col("p_size") % 8 + 1))
    return p.select(path.alias("path"), F.col("p_partkey").alias("pos"), "p_name", "p_size")


def refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers and customers refer to nations, nations to regions: src_id, dst_id, ref_type, ordinal."""
    key = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    s = table(spark, sf_dir, "supplier").select(key("s", "s_suppkey").alias("src_id"), key("n", "s_nationkey").alias("dst_id"), F.lit("usage").alias("ref_type"))
    c = table(spark, sf_dir, "customer").select(key("c", "c_custkey"), key("n", "c_nationkey"), F.when(F.col("c_mktsegment") == "BUILDING", "inheritance").otherwise("usage"))
    n = table(spark, sf_dir, "nation").select(key("n", "n_nationkey"), key("r", "n_regionkey"), F.lit("type_hint"))
    return s.union(c).union(n).withColumn("ordinal", F.lit(0))


def elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions and nations as classes, suppliers as methods and customers as attributes of their nation's class."""
    key = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    r = table(spark, sf_dir, "region").select(key("r", "r_regionkey").alias("unique_id"), F.lit("class").alias("kind"), F.lit("region.py").alias("file_path"), F.lit(None).cast("string").alias("parent_id"), F.col("r_name").alias("name"), F.concat(F.lit("class "), "r_name").alias("raw"), F.col("r_regionkey").cast("int").alias("ordinal"))
    n = table(spark, sf_dir, "nation").select(key("n", "n_nationkey"), F.lit("class"), F.concat(F.lit("nation/"), F.col("n_regionkey").cast("string"), F.lit(".py")), F.lit(None).cast("string"), "n_name", F.concat(F.lit("class "), "n_name"), F.col("n_nationkey").cast("int"))
    s = table(spark, sf_dir, "supplier").select(key("s", "s_suppkey"), F.lit("method"), F.concat(F.lit("supplier/"), F.col("s_nationkey").cast("string"), F.lit(".py")), key("n", "s_nationkey"), "s_name", F.concat(F.lit("def "), "s_name"), F.col("s_suppkey").cast("int"))
    c = table(spark, sf_dir, "customer").select(key("c", "c_custkey"), F.lit("attribute"), F.concat(F.lit("customer/"), F.col("c_nationkey").cast("string"), F.lit(".py")), key("n", "c_nationkey"), "c_name", F.concat("c_name", F.lit(" = 1")), F.col("c_custkey").cast("int"))
    return r.union(n).union(s).union(c)


WITH["elements"] = "SELECT 'r' || r_regionkey AS unique_id, 'class' AS kind, 'region.py' AS file_path, NULL::VARCHAR AS parent_id, r_name AS name, 'class ' || r_name AS raw, r_regionkey::INT AS ordinal FROM region UNION ALL SELECT 'n' || n_nationkey, 'class', 'nation/' || n_regionkey || '.py', NULL, n_name, 'class ' || n_name, n_nationkey::INT FROM nation UNION ALL SELECT 's' || s_suppkey, 'method', 'supplier/' || s_nationkey || '.py', 'n' || s_nationkey, s_name, 'def ' || s_name, s_suppkey::INT FROM supplier UNION ALL SELECT 'c' || c_custkey, 'attribute', 'customer/' || c_nationkey || '.py', 'n' || c_nationkey, c_name, c_name || ' = 1', c_custkey::INT FROM customer"
