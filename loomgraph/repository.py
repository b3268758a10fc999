"""A source tree as tables, and the questions asked of it."""

from __future__ import annotations

import os
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions import text as T
from loomgraph.operators import complete as C
from loomgraph.operators import elements as E
from loomgraph.operators import graph as G
from loomgraph.operators import incremental as I
from loomgraph.operators import paths as P
from loomgraph.operators import resolve as R
from loomgraph.operators import search as S
from loomgraph.operators import tree as Tree
from loomgraph.sources import files as Files
from loomgraph.sources import parse_python, parse_typescript

#: language -> parse(files) -> (elements, imports); others have file rows only.  register() adds to it.
PARSERS = {"python": parse_python.parse, "typescript": parse_typescript.parse}

TABLES = ("files", "elements", "imports", "refs")

#: What stands before the two parts of a context.
CONTEXT = "\n# Context\nFiles that the target builds on; change one only where the target cannot do without it.\n"
TARGET = "\n# Target\nThe code in question, to be read together with the context above.\n"


def register(language: str, parse) -> None:
    """Adds a parser: a function of files (path, raw) to the tables of elements and imports."""
    PARSERS[language] = parse


@dataclass
class Repository:
    spark: SparkSession
    root: str
    tables: dict[str, DataFrame] = field(default_factory=dict)

    @classmethod
    def from_path(cls, spark: SparkSession, root: str | None = None, languages: list[str] | None = None) -> Repository:
        """Scans and parses a tree: what git tracks or would, or all files where there is no repository."""
        root = root or os.environ.get("LOOMGRAPH_WORKSPACE", ".")
        out = cls(spark, root)
        out.tables = out.parsed(out.scanned(languages))
        return out

    def scanned(self, languages: list[str] | None = None) -> DataFrame:
        self.spark.catalog.refreshByPath(self.root)  # what is cached of an earlier scan would be found again
        return Files.scan(self.spark, self.root, languages, Files.git_paths(self.root))

    def parsed(self, files: DataFrame) -> dict[str, DataFrame]:
        files = files.persist()
        elements, imports = (self.spark.createDataFrame([], s) for s in (parse_python.ELEMENTS, parse_python.IMPORTS))
        for language, parse in PARSERS.items():
            e, i = parse(files.where((F.col("language") == language) & F.col("is_text")))
            elements, imports = elements.unionByName(e), imports.unionByName(i)
        elements = elements.persist()
        imports = R.resolve_imports(imports, elements).persist()
        return {"files": files, "elements": elements, "imports": imports, "refs": R.find_references(elements, imports).persist()}

    def save(self, path: str) -> None:
        Files.save(self.tables, path)

    @classmethod
    def load(cls, spark: SparkSession, root: str, path: str) -> Repository:
        return cls(spark, root, Files.load(spark, path, list(TABLES)))

    @classmethod
    def open(cls, spark: SparkSession, root: str, path: str) -> Repository:
        """From the snapshot at path, brought up to date; parsed and saved there if there is none."""
        try:
            out = cls.load(spark, root, path)
        except Exception as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            out = cls.from_path(spark, root)
            out.save(path)
            return out
        return out.refreshed()

    def refreshed(self) -> Repository:
        """With changed files parsed anew and deleted ones gone; references follow the whole."""
        now = self.scanned()
        changes = I.snapshot_diff(self.tables["files"], now).persist()
        files = I.applied(self.tables["files"], now, changes, "path").persist()
        fresh = Repository(self.spark, self.root).parsed(now.join(changes.where("change IN ('new', 'modified')").select("path"), "path", "left_semi"))
        out = {"files": files}
        for name in ("elements", "imports"):
            out[name] = I.applied(self.tables[name], fresh[name], changes).persist()
        out["imports"] = R.resolve_imports(out["imports"], out["elements"]).persist()
        out["refs"] = R.find_references(out["elements"], out["imports"]).persist()
        return Repository(self.spark, self.root, out)

    def ids(self, *ids: str) -> DataFrame:
        return self.spark.createDataFrame([(x, i) for i, x in enumerate(ids)], "unique_id string, pos int")

    def known_ids(self) -> DataFrame:
        return P.known_ids(self.tables["elements"], self.tables["files"])

    def get(self, *ids: str, degree: int = 1, slim: bool = False) -> DataFrame:
        """(section, file_path, content): the elements, files and directories (ending in /) asked for, and what
        they refer to within so many steps.  Files asked for are given whole and not entered again."""
        if degree < 0:
            raise ValueError("degree must be 0 or more")
        asked = P.expanded_ids(P.unique_paths(self.ids(*ids).withColumnRenamed("unique_id", "path")).withColumnRenamed("path", "unique_id"), self.tables["files"])
        whole = P.text_files(asked, self.tables["files"], Files.skipped(F.col("path")))
        elements = E.with_packages(self.tables["elements"], self.tables["imports"])
        cached = E.id_cache(self.tables["elements"], self.tables["imports"])
        start = asked.join(cached, "unique_id").select(F.col("target_id").alias("id"), "pos")
        reached = G.neighbourhood(start, R.class_references(self.tables["refs"], self.tables["elements"]), degree, whole.select(F.col("unique_id").alias("file_path")), elements)
        parts = G.rendered(G.buckets(reached, E.found(elements, reached.select(F.col("id").alias("unique_id"))), slim))
        return parts.unionByName(whole.select(F.lit("target").alias("section"), F.col("unique_id").alias("file_path"), E.wrapped(F.col("raw"), F.col("unique_id")).alias("content")))

    def context(self, *ids: str, degree: int = 1, slim: bool = False) -> str:
        """get() as one text: the context, then the target."""
        rows = self.get(*ids, degree=degree, slim=slim).orderBy("section", "file_path").collect()
        parts = [[r.content for r in rows if r.section == s] for s in ("context", "target")]
        return "\n\n".join([*([CONTEXT, *parts[0], TARGET] if parts[0] else []), *parts[1]])

    def tree(self, around: list[str] | None = None, slim: bool = False, contents: bool = False) -> DataFrame:
        """(line_no, path, line): the tree of files, or its part around some, with their elements if asked for."""
        tree = Tree.build(self.tables["files"])
        if around:
            tree = Tree.filtered(tree, self.spark.createDataFrame([(p,) for p in around], "path string"), slim)
        return Tree.rendered(Tree.with_elements(tree, self.tables["elements"]) if contents else tree)

    def search(self, *queries: str, k: int = 10, smart: bool = True) -> DataFrame:
        """(qid, rank, doc_key, score) of files for each query."""
        docs = S.searchable_files(self.tables["files"].where("is_text")).withColumnRenamed("doc_key", "doc_id")
        asked = self.spark.createDataFrame(list(enumerate(queries)), "qid long, query string")
        return S.smart_search(docs, asked, k, variations=T.query_variations(F.col("query"), normalise=True)) if smart else S.Index.build(docs).search(asked, k)

    def words(self) -> DataFrame:
        return self.known_ids().select(F.col("unique_id").alias("word")).distinct().withColumn("pos", F.lit(0))

    def suggest(self, prefix: str, k: int = 10, inside: bool = False) -> DataFrame:
        return C.suggestions(self.words(), self.spark.createDataFrame([(prefix,)], "prefix string"), k, inside=inside)

    def validate(self, *ids: str, k: int = 5) -> DataFrame:
        return C.validated(self.spark.createDataFrame([(x,) for x in ids], "code_identifier string"), self.words(), k)

    def extract(self, text: str, **options) -> DataFrame:
        return C.extracted(self.spark.createDataFrame([(0, text)], "text_id long, text string"), self.words(), dotted=True, **options)

    def diagram(self) -> DataFrame:
        links = G.edges(self.tables["imports"], self.tables["refs"])
        return G.mermaid(self.tables["elements"].select(F.col("unique_id").alias("id"), "name"), links.where("edge <> 'import'"))
