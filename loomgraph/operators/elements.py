"""Element tables: lookups, lists, class headers, first-writer-wins ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LOOKUP_ORDER = ("import", "variable", "function", "class", "attribute", "method")
CACHE_ORDER = ("class", "attribute", "method", "function", "variable")
RAW_ORDER = ("class", "function", "variable")


def order_of(kind: Column, kinds: tuple[str, ...]) -> Column:
    """The place of a kind in kinds, from 1; behind all for others."""
    place = F.array_position(F.array(*map(F.lit, kinds)), kind)
    return F.when(place > 0, place).otherwise(len(kinds) + 1)


def ids_of(elements: DataFrame, kind: str) -> DataFrame:
    """file_path, unique_id of a kind, each once a file."""
    return elements.where(F.col("kind") == kind).select("file_path", "unique_id").distinct()


def found(elements: DataFrame, ids: DataFrame) -> DataFrame:
    """The first element of each id: imports, variables, functions, classes, attributes, methods."""
    first = Window.partitionBy("unique_id").orderBy(order_of(F.col("kind"), LOOKUP_ORDER), "file_path", "ordinal")
    return elements.join(ids.select("unique_id").distinct(), "unique_id", "left_semi").withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r")


def raw_contents(elements: DataFrame) -> DataFrame:
    """file_path, contents: raws of a file's classes, functions, variables, in that order."""
    rows = elements.where(F.col("kind").isin(*RAW_ORDER))
    return rows.groupBy("file_path").agg(F.transform(F.array_sort(F.collect_list(F.struct(order_of(F.col("kind"), RAW_ORDER).alias("k"), "ordinal", "raw"))), lambda x: x["raw"]).alias("contents"))


def id_cache(elements: DataFrame, imports: DataFrame) -> DataFrame:
    """(unique_id, target_id): what an id stands for.

    Elements stand for themselves, the first of equal ids; an import whose definition is an element stands for
    that and takes the place of what had its id; other imports stand for themselves where the id is free.
    """
    own = elements.where("kind <> 'import'").select("unique_id").distinct()
    links = imports.groupBy("unique_id").agg(F.min("definition_id").alias("definition_id"))
    named = own.select(F.col("unique_id").alias("definition_id"), F.lit(True).alias("defined"))
    links = links.join(named, "definition_id", "left").select("unique_id", F.when(F.col("defined"), F.col("definition_id")).alias("alias"))
    both = own.withColumn("own", F.lit(True)).join(links.withColumn("linked", F.lit(True)), "unique_id", "full_outer")
    return both.select("unique_id", F.coalesce("alias", "unique_id").alias("target_id"))


def class_headers(elements: DataFrame) -> DataFrame:
    """class_id, header, slim_raw: the docstring part, then the attributes' raws; without a docstring the raw."""
    a = elements.where("kind = 'attribute'").groupBy(F.col("parent_id").alias("class_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "raw"))), lambda x: x["raw"]), "\n").alias("attributes"))
    c = elements.where("kind = 'class'").select(F.col("unique_id").alias("class_id"), "docstring", "raw")
    has = F.length(F.coalesce("docstring", F.lit(""))) > 0
    return c.join(a, "class_id", "left").select("class_id", F.when(has, F.col("docstring")).otherwise(F.col("raw")).alias("header"), F.when(has, F.concat_ws("\n", "docstring", "attributes")).otherwise(F.col("raw")).alias("slim_raw"))


#: Where imports of packages outside belong.
PACKAGES = "PACKAGES"


def wrapped(content: Column, path: Column) -> Column:
    """Content between tags that name its file, or say that it is the imports of packages."""
    plain = F.format_string("<FILE_START::%s>\n%s\n</FILE_END::%s>", path, content, path)
    return F.when(path == PACKAGES, F.format_string("<PACKAGE_DEPENDENCIES_START>\n%s\n</PACKAGE_DEPENDENCIES_END>", content)).otherwise(plain)


def with_packages(elements: DataFrame, imports: DataFrame) -> DataFrame:
    """elements, and the imports that no element defines as elements of PACKAGES."""
    known = elements.select("unique_id").distinct()
    outside = imports.where("definition_id IS NULL").groupBy("unique_id").agg(F.min("raw").alias("raw"), F.min("name").alias("name")).join(known, "unique_id", "left_anti")
    return elements.unionByName(outside.withColumn("kind", F.lit("import")).withColumn("file_path", F.lit(PACKAGES)).withColumn("ordinal", F.lit(0)), allowMissingColumns=True)
