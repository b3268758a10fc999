"""Neighbourhood retrieval over refs (src_id, dst_id, ref_type, ordinal), context buckets and rendering, diagrams."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import elements as E


def neighbourhood(ids: DataFrame, refs: DataFrame, degree: int = 1, cut_files: DataFrame | None = None, elements: DataFrame | None = None) -> DataFrame:
    """(id, depth, ref_type, place): what is reached from ids (id, pos) by at most `degree` references.

    Breadth first: each level joins the frontier with refs and leaves out what was seen.  An id keeps its least
    depth and, within it, its first place; ref_type is that of the first edge that has one.  Elements of cut_files
    (file_path) are neither reached nor passed through, except where asked for.  degree must not be negative.
    """
    if degree < 0:
        raise ValueError("degree must be 0 or more")
    frontier = ids.groupBy("id").agg(F.min(F.array(F.col("pos").cast("long"))).alias("place")).select("id", F.lit(0).alias("depth"), F.lit(None).cast("string").alias("ref_type"), "place")
    seen = frontier
    edges = refs.where("dst_id IS NOT NULL").select(F.col("src_id").alias("id"), "dst_id", F.col("ref_type").alias("edge"), F.col("ordinal").cast("long").alias("ordinal"))
    if cut_files is not None:
        cut = elements.join(cut_files, "file_path", "left_semi").select(F.col("unique_id").alias("dst_id"))
        edges = edges.join(cut, "dst_id", "left_anti")
    for depth in range(1, degree + 1):
        steps = frontier.join(edges, "id").select(F.col("dst_id").alias("id"), "edge", F.concat("place", F.array("ordinal")).alias("place"))
        steps = steps.join(seen.select("id"), "id", "left_anti")
        frontier = steps.groupBy("id").agg(F.min("place").alias("place"), F.min_by("edge", F.when(F.col("edge").isNotNull(), F.col("place"))).alias("ref_type")).select("id", F.lit(depth).alias("depth"), "ref_type", "place")
        if depth % 4 == 0 and not refs.sparkSession.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
            frontier = frontier.checkpoint()  # else the plan grows with each level
        seen = seen.unionByName(frontier)
    return seen


def buckets(reached: DataFrame, elements: DataFrame, slim: bool = False) -> DataFrame:
    """(unique_id, bucket, depth, file_path, content): requested, import, class, header, method, attribute, ...

    Members go where their class is there in full; in slim mode a class reached by a type hint is a header.
    """
    rows = reached.join(elements, reached["id"] == elements["unique_id"])
    header = F.lit(slim) & (F.col("kind") == "class") & (F.col("ref_type") == "type_hint")
    rows = rows.withColumn("bucket", F.when(F.col("depth") == 0, "requested").when(header, "header").otherwise(F.col("kind")))
    whole = rows.where("kind = 'class' AND bucket <> 'header'").select(F.col("unique_id").alias("parent_id")).distinct().withColumn("whole", F.lit(True))
    rows = rows.join(whole, "parent_id", "left").where("bucket = 'requested' OR whole IS NULL")
    return rows.select("unique_id", "bucket", "depth", "place", "file_path", "kind", F.col("raw").alias("content"))


SECTION_ORDER = ("import", "variable", "function", "class", "header", "attribute", "method")


def rendered(bucketed: DataFrame) -> DataFrame:
    """(section, file_path, content): per file its context in the order of sections, and what was requested."""
    section = F.when(F.col("bucket") == "requested", "target").otherwise("context")
    order = E.order_of(F.col("bucket"), SECTION_ORDER)
    parts = bucketed.groupBy(section.alias("section"), "file_path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), "place", "unique_id", "content"))), lambda x: x["content"]), "\n").alias("content"))
    return parts.withColumn("content", E.wrapped(F.col("content"), F.col("file_path")))


def nodes(files: DataFrame, elements: DataFrame) -> DataFrame:
    """(id, kind): files, classes and functions, each once."""
    rows = elements.where("kind IN ('class', 'function')").select(F.col("unique_id").alias("id"), "kind")
    return rows.unionByName(files.select(F.col("path").alias("id"), F.lit("file").alias("kind"))).distinct()


def edges(imports: DataFrame, refs: DataFrame) -> DataFrame:
    """(edge, src, dst): inheritance and usage between elements, import from file to source; each once."""
    r = refs.where("dst_id IS NOT NULL").select(F.when(F.col("ref_type") == "inheritance", "inheritance").otherwise("usage").alias("edge"), F.col("src_id").alias("src"), F.col("dst_id").alias("dst"))
    return r.unionByName(imports.select(F.lit("import").alias("edge"), F.col("file_path").alias("src"), F.col("source").alias("dst"))).distinct()


def mermaid(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """One row: a class diagram of links whose ends are both among nodes (id, name), in order."""
    a, b = nodes.select(F.col("id").alias("src"), F.col("name").alias("a")), nodes.select(F.col("id").alias("dst"), F.col("name").alias("b"))
    arrow = F.when(F.col("edge") == "inheritance", " <|-- ").otherwise(" --> ")
    lines = links.join(a, "src").join(b, "dst").select(F.when(F.col("edge") == "inheritance", F.concat("b", arrow, "a")).otherwise(F.concat("a", arrow, "b")).alias("line")).distinct()
    return lines.agg(F.concat(F.lit("classDiagram\n"), F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("    "), "line"))), "\n")).alias("diagram"))


