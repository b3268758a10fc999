"""Lexical search: inverted index, BM25 with TF-IDF, exact matches, fused query variations, maintenance.

The index is three tables: postings (doc_key, term, tf, dl), lengths (doc_key, dl) and, where it is kept, dfs (term,
df).  Scoring probes the postings with the query's terms, which are few.  An index that is updated counts document
frequencies anew for the terms asked for, so there is no stale IDF.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.functions import text as T

K1, B = 1.5, 0.75
BM25_SHARE, TFIDF_SHARE = 0.7, 0.3
MOST_ASKED = 10_000  # rows of a stated set that is broadcast


@dataclass
class Index:
    postings: DataFrame
    lengths: DataFrame
    dfs: DataFrame | None = None

    @classmethod
    def build(cls, docs: DataFrame, key: str = "doc_id", text: str = "text") -> Index:
        """From one row per document; a null text has no tokens but counts as a document."""
        words = docs.select(F.col(key).alias("doc_key"), T.tokens(F.col(text)).alias("words")).withColumn("dl", F.size("words").cast("long"))
        exploded = words.select("doc_key", "dl", F.explode("words").alias("term"))
        lengths = docs.select(F.col(key).alias("doc_key"), T.token_count(F.col(text)).alias("dl"))
        return cls(exploded.groupBy("doc_key", "term", "dl").agg(F.count(F.lit(1)).alias("tf")).select("doc_key", "term", "tf", "dl"), lengths)

    @property
    def corpus(self) -> DataFrame:
        return self.lengths.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))

    @property
    def terms(self) -> DataFrame:
        n = self.corpus.select("n").scalar()
        return self.document_frequencies(self.postings).withColumn("idf", F.log(n / F.col("df")))

    def document_frequencies(self, postings: DataFrame) -> DataFrame:
        """(term, df) of the terms of postings, a part of this index's."""
        if self.dfs is not None:
            return self.dfs
        return postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))

    def inverted(self, block: int = 1 << 17) -> DataFrame:
        """(term, block, docs): the keys in order, whole numbers, in lists of those of one block of keys, so that the
        list of a term that all documents have is many rows."""
        place = F.floor(F.col("doc_key") / block).alias("block")
        return self.postings.groupBy("term", place).agg(F.array_sort(F.collect_list("doc_key")).alias("docs"))

    def save(self, path: str, buckets: int = 16) -> None:
        """Postings sorted by term, so that a probe reads few row groups."""
        self.postings.repartitionByRange(buckets, "term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/postings")
        self.lengths.write.mode("overwrite").parquet(f"{path}/lengths")
        kept = self.lengths.sparkSession.read.parquet(f"{path}/postings")
        kept.groupBy("term").agg(F.count(F.lit(1)).alias("df")).write.mode("overwrite").parquet(f"{path}/dfs")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Index:
        return cls(*(spark.read.parquet(f"{path}/{name}") for name in ("postings", "lengths", "dfs")))

    def without(self, keys: DataFrame) -> Index:
        """Without the documents of keys (doc_key)."""
        return Index(*(t.join(keys, "doc_key", "left_anti") for t in (self.postings, self.lengths)))

    def updated(self, docs: DataFrame, key: str = "doc_id", text: str = "text") -> Index:
        """With docs in place of, or added to, those of the same key."""
        new, old = Index.build(docs, key, text), self.without(docs.select(F.col(key).alias("doc_key")))
        return Index(old.postings.unionByName(new.postings), old.lengths.unionByName(new.lengths))

    def scores(self, queries: DataFrame) -> DataFrame:
        """(qid, doc_key, score) for each document that has a term of a query; queries: (qid, query).

        0.7 of BM25 over the query's distinct terms and 0.3 of TF-IDF over all of them.  A term that all
        documents have adds nothing, but makes them candidates.
        """
        asked = queries.select("qid", F.explode(T.tokens(F.col("query"))).alias("term")).groupBy("qid", "term").agg(F.count(F.lit(1)).alias("times"))
        probed = self.postings.join(asked.select("term").distinct(), "term", "left_semi")
        df = self.document_frequencies(probed)
        n, avgdl = self.corpus.select("n").scalar(), self.corpus.select("avgdl").scalar()
        idf = F.log(n / F.col("df"))
        bm25 = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / avgdl))
        tfidf = F.col("tf") / F.col("dl") * idf * F.col("times")
        hits = probed.join(df, "term").join(asked, "term")
        return hits.groupBy("qid", "doc_key").agg(F.sum(BM25_SHARE * bm25 + TFIDF_SHARE * tfidf).alias("score"))

    def search(self, queries: DataFrame, k: int = 10) -> DataFrame:
        """(qid, rank, doc_key, score): the k best of each query, scores to 6 decimals, ties to the smaller key."""
        return top_k(self.scores(queries).withColumn("score", F.round("score", 6)), k)

    def document_stats(self, k: int = 10) -> DataFrame:
        """doc_key, dl, n_terms, and the k most frequent and the k best TF-IDF terms, ties in order of the term."""
        n = self.corpus.select("n").scalar()
        df = self.terms.select("term", "df")
        rows = self.postings.join(df, "term").withColumn("tfidf", F.round(F.col("tf") / F.col("dl") * F.log(n / F.col("df")), 9))
        order = lambda c: F.row_number().over(Window.partitionBy("doc_key").orderBy(F.col(c).desc(), "term"))
        rows = rows.withColumn("r1", order("tf")).withColumn("r2", order("tfidf"))
        best = lambda r: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col(r) <= k, F.struct(r, "term")))), lambda x: x["term"]), " ")
        return rows.groupBy("doc_key").agg(F.max("dl").alias("dl"), F.count(F.lit(1)).alias("n_terms"), best("r1").alias("most_common"), best("r2").alias("top_tfidf"))

    def stats(self) -> DataFrame:
        """One row: documents, distinct terms, mean length."""
        return self.corpus.select(F.col("n").alias("n_docs"), F.round("avgdl", 6).alias("avg_length"), self.postings.select(F.count_distinct("term")).scalar().alias("n_terms"))


def stated(asked: DataFrame) -> DataFrame:
    """A stated set of questions to broadcast, after its size was checked."""
    if len(asked.take(MOST_ASKED + 1)) > MOST_ASKED:
        raise ValueError(f"more than {MOST_ASKED} rows were asked for at once")
    return F.broadcast(asked)


def top_k(scores: DataFrame, k: int) -> DataFrame:
    """The k best rows of each qid; Spark keeps k per task before it shuffles."""
    order = Window.partitionBy("qid").orderBy(F.col("score").desc(), "doc_key")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("qid", "rank", "doc_key", "score")


def exact_scores(docs: DataFrame, queries: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(qid, doc_key, score): occurrences of the whole query in the text, both lower-cased, over its length + 1.

    The queries are a stated set against all documents, of at most MOST_ASKED; more are an error.  An empty query
    matches nothing.
    """
    docs = docs.select(F.col(key).alias("doc_key"), F.lower(text).alias("text"))
    asked = stated(queries.select("qid", F.lower("query").alias("query")).where("query <> ''"))
    hits = docs.join(asked, F.col("text").contains(F.col("query")))
    return hits.select("qid", "doc_key", (T.substring_count(F.col("text"), F.col("query")) / (F.length("text") + 1)).alias("score"))


def smart_search(docs: DataFrame, queries: DataFrame, k: int = 10, use_variations: bool = True, boost: float = 0.3, key: str = "doc_id", text: str = "text", variations: Column | None = None) -> DataFrame:
    """Fused search: each variation i of a query gives its 2k best weighted 1 / (i + 1), exact matches add boost;
    the sum is divided by the number of lists a document is in."""
    forms = variations if variations is not None else (T.query_variations(F.col("query")) if use_variations else F.array("query"))
    asked = queries.select("qid", F.posexplode(forms).alias("form", "query"))
    lists = Index.build(docs, key, text).search(asked.select(F.struct("qid", "form").alias("qid"), "query"), 2 * k)
    parts = lists.select("qid.qid", "doc_key", (F.col("score") / (F.col("qid.form") + 1)).alias("score"))
    if boost > 0:
        exact = top_k(exact_scores(docs, queries, key, text).withColumn("score", F.round("score", 9)), k)
        parts = parts.unionByName(exact.select("qid", "doc_key", (F.col("score") * boost).alias("score")))
    fused = parts.groupBy("qid", "doc_key").agg((F.sum("score") / F.count(F.lit(1))).alias("score"))
    return top_k(fused.withColumn("score", F.round("score", 6)), k)


def with_context(hits: DataFrame, docs: DataFrame, context_lines: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """hits with the first 2 * context_lines lines of their documents, and how many lines there are."""
    lines = F.split(F.col(text), "\n", -1)
    shown = docs.select(F.col(key).alias("doc_key"), F.array_join(F.slice(lines, 1, 2 * context_lines), "\n").alias("context"), F.size(lines).cast("long").alias("total_lines"))
    return hits.join(shown, "doc_key")


def searchable_files(files: DataFrame) -> DataFrame:
    """doc_key, text of files (path, raw): the path, a blank line, the content."""
    return files.select(F.col("path").alias("doc_key"), F.concat_ws("\n\n", "path", "raw").alias("text"))


def searchable_tree(children: DataFrame) -> DataFrame:
    """doc_key, text of tree children (parent, children): the path, then the children."""
    return children.select(F.col("parent").alias("doc_key"), F.concat(F.col("parent"), F.lit("\n"), F.array_join("children", "\n")).alias("text"))
