"""Directory and element trees as tables: (path, parent, name, depth, node_type)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .paths import ancestors, basename, dirname


def build(files: DataFrame) -> DataFrame:
    """The tree of files (path): a row for each file and each directory above one; the top's parent is "."."""
    paths = files.select("path", F.lit("file").alias("node_type")).distinct()
    dirs = files.select(F.explode(ancestors(F.col("path"))).alias("path")).where("path <> ''").distinct().select("path", F.lit("directory").alias("node_type"))
    both = dirs.unionByName(paths.join(dirs.select("path"), "path", "left_anti"))
    return both.select("path", dirname(F.col("path")).alias("parent"), basename(F.col("path")).alias("name"), F.size(F.split("path", "/")).cast("long").alias("depth"), "node_type")


def filtered(tree: DataFrame, files: DataFrame, slim: bool = True) -> DataFrame:
    """The part of a tree around files: slim keeps the directories above them and all files beside them; otherwise
    also the directories beside theirs and all that is below theirs; other directories are one placeholder each."""
    own = files.select(dirname(F.col("path")).alias("d")).distinct()
    above = files.select(F.explode(ancestors(F.col("path"))).alias("path")).distinct()
    beside = tree.where("node_type = 'file'").join(own, F.col("parent") == F.col("d"), "left_semi").select("path")
    shown = above.unionByName(beside)
    if not slim:
        parents = own.select(dirname(F.col("d")).alias("p")).distinct()
        siblings = tree.where("node_type = 'directory'").join(parents, F.col("parent") == F.col("p"), "left_semi").select("path")
        under = tree.select("path", "node_type", F.explode(ancestors(F.col("path"))).alias("d")).where("node_type = 'directory'").join(own, "d", "left_semi").select("path")
        shown = shown.unionByName(siblings).unionByName(under)
    part = tree.join(shown.distinct(), "path", "left_semi")
    hidden = omitted(tree, part)
    holders = hidden.select("parent").distinct().join(part.where("node_type = 'directory'").select(F.col("path").alias("parent")).unionByName(tree.sparkSession.sql("SELECT '.' AS parent")), "parent", "left_semi")
    rest = holders.select(F.concat("parent", F.lit("/...")).alias("path"), "parent", F.lit("...").alias("name"), F.when(F.col("parent") == ".", 1).otherwise(F.size(F.split("parent", "/")) + 1).cast("long").alias("depth"), F.lit("placeholder").alias("node_type"))
    return part.unionByName(rest)


def omitted(tree: DataFrame, part: DataFrame) -> DataFrame:
    """path, parent of the directories of tree that part leaves out."""
    return tree.where("node_type = 'directory'").select("path", "parent").join(part.select("path"), "path", "left_anti")


def with_elements(tree: DataFrame, elements: DataFrame) -> DataFrame:
    """The tree with each file's variables, functions and classes below it and a class's attributes and methods
    below that, named with their kind's initial."""
    kinds = {"variable": "V", "function": "F", "class": "C", "attribute": "A", "method": "M"}
    letter = F.element_at(F.create_map(*[F.lit(x) for p in kinds.items() for x in p]), F.col("kind"))
    rows = elements.where(F.col("kind").isin(*kinds))
    depth = tree.select(F.col("path").alias("file_path"), F.col("depth").alias("d"))
    rows = rows.join(depth, "file_path")
    top = F.col("parent_id").isNull()
    own = F.concat_ws("::", "file_path", F.when(~top, F.substring_index("parent_id", ".", -1)))
    return tree.unionByName(rows.select(F.concat_ws("::", own, "name").alias("path"), own.alias("parent"), F.concat(letter, F.lit(": "), F.col("name")).alias("name"), (F.col("d") + F.when(top, 1).otherwise(2)).alias("depth"), F.col("kind").alias("node_type")))


#: Siblings in the order of a rendered tree.
ORDER = ("directory", "file", "placeholder", "variable", "function", "class", "attribute", "method")


def children(tree: DataFrame) -> DataFrame:
    """(parent, children): the names right below each directory, file and class, in order."""
    return tree.groupBy("parent").agg(F.array_sort(F.collect_list("name")).alias("children"))


def rendered(tree: DataFrame) -> DataFrame:
    """(line_no, path, line): the tree drawn with branches; directories, then files, then placeholders, by name.

    A row's place in the order, and the strokes before it, are those of its ancestors: one join of each path's
    prefixes, however deep the tree.
    """
    place = Window.partitionBy("parent").orderBy(F.array_position(F.array(*map(F.lit, ORDER)), F.col("node_type")), "name", "path")
    rows = tree.withColumn("nth", F.row_number().over(place)).withColumn("last", F.col("nth") == F.count(F.lit(1)).over(Window.partitionBy("parent")))
    parts = F.split("path", "(?=/|::)")
    prefixes = rows.select("path", "name", F.posexplode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), ""))).alias("depth", "prefix"))
    above = prefixes.join(rows.select(F.col("path").alias("prefix"), "nth", "last"), "prefix")
    drawn = above.groupBy("path", "name").agg(F.array_sort(F.collect_list(F.struct("depth", "nth", "last"))).alias("up"))
    strokes = F.transform(F.slice("up", 1, F.size("up") - 1), lambda u: F.when(u["last"], "    ").otherwise("│   "))
    line = F.concat(F.array_join(strokes, ""), F.when(F.element_at("up", -1)["last"], "└── ").otherwise("├── "), "name")
    return drawn.select(F.row_number().over(Window.orderBy("up.nth")).cast("long").alias("line_no"), "path", line.alias("line"))


def html(tree: DataFrame) -> DataFrame:
    """One row: the drawn tree as an HTML page."""
    lines = rendered(tree).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("t"))
    safe = F.replace(F.replace("t", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    return lines.select(F.concat(F.lit("<!DOCTYPE html><html><body><pre>"), safe, F.lit("</pre></body></html>")).alias("html"))
