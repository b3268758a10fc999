"""Queries of lexical search over documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions import text as T
from loomgraph.operators import search as S
from loomgraph.sources.shared import shared_dir

from .base import query, table

TEXT_QUERY = "the inre thonst er est"
EXACT = "er the"

#: SQL of the blended score of tf, dl, n, avgdl, df and the query's own count.
SCORE = "0.7 * ln(n / df) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)) + 0.3 * (tf / dl) * ln(n / df) * times"


def index(spark: SparkSession, sf_dir: str) -> S.Index:
    """The index of the documents, kept in the shared folder: the first question to a table builds it, later ones read
    it.  Its name has the table's files, their sizes and times, so a table that changed gets another."""
    docs = table(spark, sf_dir, "documents")
    files = docs.select("_metadata.file_path", "_metadata.file_size", F.col("_metadata.file_modification_time").cast("string").alias("time")).distinct()
    name = files.agg(F.md5(F.to_json(F.array_sort(F.collect_set(F.struct("file_path", "file_size", "time")))))).first()[0]
    folder = _FOLDERS.setdefault(spark.sparkContext.applicationId, shared_dir(spark))
    path = f"{folder}/index-{name}"
    if path not in _KEPT:
        S.Index.build(docs).save(path)
        _KEPT.add(path)
    return S.Index.load(spark, path)


#: Folders by application, and the indexes that this process has written.
_FOLDERS: dict[str, str] = {}
_KEPT: set[str] = set()


def asked(spark: SparkSession, text: str) -> DataFrame:
    return spark.range(1).select(F.lit(0).cast("long").alias("qid"), F.lit(text).alias("query"))


@query("SELECT term, sum(tf)::BIGINT AS n, count(*)::BIGINT AS n_docs FROM postings GROUP BY term")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "documents").select("doc_id", F.explode(T.tokens(F.col("text"))).alias("term"))
    return words.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf")).groupBy("term").agg(F.sum("tf").alias("n"), F.count(F.lit(1)).alias("n_docs"))


@query(r"SELECT doc_id, dl, len(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+')))::BIGINT AS n_terms FROM documents JOIN lengths USING (doc_id)")
def doc_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "documents").select("doc_id", T.tokens(F.col("text")).alias("w"))
    return words.select("doc_id", F.size("w").cast("long").alias("dl"), F.size(F.array_distinct("w")).cast("long").alias("n_terms"))


@query("SELECT term, df, round(ln(n / df), 9) AS idf FROM dfs, corpus")
def term_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index(spark, sf_dir).terms.withColumn("idf", F.round("idf", 9))


@query("SELECT doc_id, term, tf AS n, round(tf / dl, 9) AS tf FROM postings JOIN lengths USING (doc_id)")
def term_tf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index(spark, sf_dir).postings.select(F.col("doc_key").alias("doc_id"), "term", F.col("tf").alias("n"), F.round(F.col("tf") / F.col("dl"), 9).alias("tf"))


@query("SELECT n AS n_docs, round(avgdl, 6) AS avg_length, (SELECT count(DISTINCT term) FROM tok)::BIGINT AS n_terms FROM corpus")
def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index(spark, sf_dir).stats()


@query("SELECT term, (doc_id // 131072)::BIGINT AS block, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS docs FROM postings GROUP BY ALL")
def inverted_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index(spark, sf_dir).inverted().select("term", "block", F.array_join(F.transform("docs", lambda d: d.cast("string")), ",").alias("docs"))


def _ranked(queries: str, postings: str = "postings", lengths: str = "lengths", k: int = 10) -> str:
    """SQL of the k best documents of each query; queries: SQL of (qid, query)."""
    return rf"""WITH qs AS ({queries}),
qt AS (SELECT qid, term, count(*) AS times FROM (SELECT qid, unnest(regexp_extract_all(lower(query), '[\p{{L}}\p{{N}}_]+')) AS term FROM qs) GROUP BY ALL),
c AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM {lengths}), d AS (SELECT term, count(*) AS df FROM {postings} GROUP BY term),
scored AS (SELECT qid, doc_id, round(sum({SCORE}), 6) AS score FROM {postings} JOIN {lengths} USING (doc_id) JOIN d USING (term) JOIN qt USING (term), c GROUP BY qid, doc_id),
ranked AS (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM scored)
SELECT qid, rank::INT AS rank, doc_id, score FROM ranked WHERE rank <= {k}"""


def _named(hits: DataFrame) -> DataFrame:
    return hits.select("qid", "rank", F.col("doc_key").alias("doc_id"), "score")


@query(_ranked(f"SELECT 0::BIGINT AS qid, '{TEXT_QUERY}' AS query"))
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named(index(spark, sf_dir).search(asked(spark, TEXT_QUERY)))


@query(_ranked("SELECT item_id AS qid, text AS query FROM benchmark"))
def bm25_batch_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best documents for the whole text of each benchmark item."""
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))
    return _named(index(spark, sf_dir).search(queries))


_EXACT = f"SELECT doc_id, round(((length(lower(text)) - length(replace(lower(text), '{EXACT}', ''))) / {len(EXACT)})::BIGINT / (length(lower(text)) + 1), 9) AS score FROM documents WHERE contains(lower(text), '{EXACT}')"


@query(f"WITH s AS ({_EXACT}), r AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM s) SELECT 0::BIGINT AS qid, rank::INT AS rank, doc_id, score FROM r WHERE rank <= 10")
def exact_match_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = S.exact_scores(table(spark, sf_dir, "documents"), asked(spark, EXACT)).withColumn("score", F.round("score", 9))
    return _named(S.top_k(scores, 10))


@query("""WITH r AS (SELECT doc_id, dl, term, row_number() OVER (PARTITION BY doc_id ORDER BY tf DESC, term) AS r1,
  row_number() OVER (PARTITION BY doc_id ORDER BY round(tf / dl * ln(n / df), 9) DESC, term) AS r2 FROM postings JOIN lengths USING (doc_id) JOIN dfs USING (term), corpus)
SELECT doc_id, max(dl)::BIGINT AS dl, count(*)::BIGINT AS n_terms, string_agg(term, ' ' ORDER BY r1) FILTER (r1 <= 10) AS most_common, string_agg(term, ' ' ORDER BY r2) FILTER (r2 <= 10) AS top_tfidf FROM r GROUP BY doc_id""")
def doc_top_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index(spark, sf_dir).document_stats().withColumnRenamed("doc_key", "doc_id")


_FORMS = ["er the thonst", "the thonst of", "inre est"]
_SMART = _ranked(" UNION ALL ".join(f"SELECT {i} AS qid, '{f}' AS query" for i, f in enumerate(_FORMS)), k=20).replace("SELECT qid, rank::INT AS rank, doc_id, score FROM ranked WHERE rank <= 20", "SELECT 1")


@query(_SMART.rsplit("SELECT 1", 1)[0] + f""", ex AS ({_EXACT}), exr AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM ex),
parts AS (SELECT doc_id, score / (qid + 1) AS score FROM ranked WHERE rank <= 20 UNION ALL SELECT doc_id, score * 0.3::DOUBLE FROM exr WHERE rank <= 10),
fused AS (SELECT doc_id, round(sum(score) / count(*), 6) AS score FROM parts GROUP BY doc_id), best AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM fused)
SELECT 0::BIGINT AS qid, rank::INT AS rank, doc_id, score FROM best WHERE rank <= 10""")
def smart_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named(S.smart_search(table(spark, sf_dir, "documents"), asked(spark, EXACT), variations=F.array(*map(F.lit, _FORMS))))


@query()
def smart_search_variations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the variations made from the query, NFKD included."""
    return _named(S.smart_search(table(spark, sf_dir, "documents"), asked(spark, "get_cfg élan thonst"), variations=T.query_variations(F.col("query"), normalise=True)))


_CHANGED = "SELECT doc_id, CASE WHEN lang = 'fr' THEN text || ' thonst inre' ELSE text END AS text FROM documents"
_AFTER = r"""tok2 AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS term FROM docs2), p2 AS (SELECT doc_id, term, count(*) AS tf FROM tok2 GROUP BY ALL),
l2 AS (SELECT doc_id, len(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+')) AS dl FROM docs2), """


def _after(docs: str) -> str:
    return f"WITH docs2 AS ({docs}), {_AFTER}" + _ranked(f"SELECT 0::BIGINT AS qid, '{TEXT_QUERY}' AS query", "p2", "l2").removeprefix("WITH ")


@query(_after(_CHANGED))
def index_after_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """French documents get two words more."""
    docs = table(spark, sf_dir, "documents")
    fresh = docs.where("lang = 'fr'").select("doc_id", F.concat("text", F.lit(" thonst inre")).alias("text"))
    return _named(index(spark, sf_dir).updated(fresh).search(asked(spark, TEXT_QUERY)))


@query(_after("SELECT doc_id, text FROM documents WHERE lang <> 'de' OR lang IS NULL"))
def index_after_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    gone = docs.where("lang = 'de'").select(F.col("doc_id").alias("doc_key"))
    return _named(index(spark, sf_dir).without(gone).search(asked(spark, TEXT_QUERY)))


@query(f"WITH hits AS ({_EXACT}) SELECT doc_id, score, array_to_string(string_split(text, chr(10))[1:6], chr(10)) AS context, len(string_split(text, chr(10)))::BIGINT AS total_lines FROM hits JOIN documents USING (doc_id)")
def search_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    hits = S.exact_scores(docs, asked(spark, EXACT)).select("doc_key", F.round("score", 9).alias("score"))
    return S.with_context(hits, docs).withColumnRenamed("doc_key", "doc_id")


@query("SELECT doc_id, sum(CASE WHEN trim(l) = '' OR l = '    ' || ltrim(l) THEN 1 ELSE 2 END)::BIGINT AS n_lines FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents) GROUP BY doc_id")
def indent_variations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.size(T.line_variations(F.col("text"))).cast("long").alias("n_lines"))
