"""Reference resolution: imports to definitions, names to the elements that use them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions import text as T

from .paths import import_id


def resolve_imports(imports: DataFrame, elements: DataFrame) -> DataFrame:
    """imports with definition_id resolved and unique_id set.

    A definition that is an element stays.  One that is the id of an import of another file becomes that import's
    definition (of several the first file's).  Others are of packages outside: null, and the id is source.name.
    """
    known = elements.where("kind IN ('class', 'function', 'variable')").select(F.col("unique_id").alias("definition_id")).distinct().withColumn("known", F.lit(True))
    hop = imports.groupBy(F.col("unique_id").alias("definition_id"), "file_path").agg(F.min("definition_id").alias("hop_to"))
    first = hop.groupBy("definition_id").agg(F.min(F.struct("file_path", "hop_to")).alias("first"))
    # Of the files that import a name only the first two can be the first other one.
    rest = hop.join(first, "definition_id").where(F.col("file_path") != F.col("first.file_path"))
    second = rest.groupBy("definition_id").agg(F.min(F.struct("file_path", "hop_to")).alias("second"))
    rows = imports.join(known, "definition_id", "left").join(first, "definition_id", "left").join(second, "definition_id", "left")
    other = F.when(F.col("first.file_path") != F.col("file_path"), F.col("first.hop_to")).otherwise(F.col("second.hop_to"))
    resolved = F.when(F.col("known"), F.col("definition_id")).otherwise(other)
    rows = rows.withColumn("_to", resolved)
    outside = import_id(F.col("source"), F.col("name"))
    return rows.withColumn("unique_id", F.when(F.col("_to").isNull(), outside).otherwise(F.col("unique_id"))).withColumn("definition_id", F.col("_to")).drop("known", "first", "second", "_to")


def other_imports(imports: DataFrame, file_path: str) -> DataFrame:
    """unique_id of imports of other files that the file itself doesn't have."""
    own = imports.where(F.col("file_path") == file_path).select("unique_id")
    return imports.where(F.col("file_path") != file_path).select("unique_id").distinct().join(own, "unique_id", "left_anti")


def find_references(elements: DataFrame, imports: DataFrame) -> DataFrame:
    """refs (src_id, dst_id, name, ref_type, ordinal) within each file.

    A name counts where it stands alone in the file's classes, functions and variables: an import needs one
    place, an element two, as one is its own.  Each variable, function, method and attribute whose text contains
    the name refers to it, typed `type_hint` where it is one of its hints; a class that has it among its bases
    refers by `inheritance`.  A name refers at most one holder more often than it counts, in the order of the file.
    A class that is imported gives way to those of its methods that the holder names.
    """
    tops = elements.where("kind IN ('class', 'function', 'variable')")
    bodies = tops.groupBy("file_path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "raw"))), lambda x: x["raw"]), "\n").alias("body"))
    wanted = imports.select("file_path", F.coalesce("definition_id", "unique_id").alias("dst_id"), F.col("as_dependency").alias("name"), F.lit(0).alias("own"))
    named = elements.where("kind IN ('variable', 'function', 'attribute', 'method')").select("file_path", F.col("unique_id").alias("dst_id"), "name", F.lit(1).alias("own"))
    counted = wanted.unionByName(named).distinct().join(bodies, "file_path").withColumn("uses", T.occurrences(F.col("body"), F.col("name")) - F.col("own")).where("uses > 0").drop("body")
    holders = elements.where("kind IN ('variable', 'function', 'attribute', 'method')").select("file_path", F.col("unique_id").alias("src_id"), "raw", "hints", "ordinal")
    pairs = counted.join(holders, "file_path").where(F.col("raw").contains(F.col("name")))
    nth = Window.partitionBy("file_path", "dst_id").orderBy("ordinal", "src_id")
    pairs = pairs.withColumn("nth", F.row_number().over(nth)).where("nth <= uses + 1")
    typed = F.when(F.array_contains("hints", F.col("name")), F.lit("type_hint"))
    plain = pairs.select("file_path", "src_id", "dst_id", "name", typed.alias("ref_type"), "ordinal", "raw")
    methods = elements.where("kind = 'method'").select(F.col("parent_id").alias("dst_id"), F.col("unique_id").alias("method_id"), F.col("name").alias("method"))
    refined = plain.join(methods, "dst_id").where(F.col("raw").contains(F.col("method")))
    kept = plain.join(refined.select("src_id", "dst_id").distinct(), ["src_id", "dst_id"], "left_anti")
    inherit = elements.where("kind = 'class'").select("file_path", F.col("unique_id").alias("src_id"), F.explode("bases").alias("name"), "ordinal")
    targets = wanted.select("file_path", "dst_id", "name").unionByName(elements.where("kind = 'class'").select("file_path", F.col("unique_id").alias("dst_id"), "name"))
    bases = inherit.join(targets, ["file_path", "name"]).where("src_id <> dst_id").select("src_id", "dst_id", "name", F.lit("inheritance").alias("ref_type"), "ordinal")
    cols = ["src_id", "dst_id", "name", "ref_type", "ordinal"]
    return kept.select(cols).unionByName(refined.select("src_id", F.col("method_id").alias("dst_id"), F.col("method").alias("name"), "ref_type", "ordinal").distinct()).unionByName(bases.distinct())


def class_references(refs: DataFrame, elements: DataFrame) -> DataFrame:
    """refs with those of members also as their class's."""
    of = elements.where("parent_id IS NOT NULL").select(F.col("unique_id").alias("src_id"), "parent_id")
    up = refs.join(of, "src_id").select(F.col("parent_id").alias("src_id"), "dst_id", "name", "ref_type", "ordinal")
    return refs.select("src_id", "dst_id", "name", "ref_type", "ordinal").unionByName(up)
