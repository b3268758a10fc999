"""Paths and identifiers: stems, ids, ancestors, modules, normalised lists."""

from __future__ import annotations

import posixpath

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def file_stem(path: Column) -> Column:
    """The path without its last suffix, separators as dots; the whole path where nothing is left."""
    cut = F.regexp_replace(path, r"\.[^.]*\z", "")
    return F.regexp_replace(F.when(cut == "", path).otherwise(cut), r"[\\/]", ".")


def unique_id(path: Column, name: Column, stored: Column | None = None) -> Column:
    stem = file_stem(F.coalesce(path, F.lit("")))
    made = F.when(stem == "", name).otherwise(F.concat_ws(".", stem, name))
    return F.coalesce(stored, made) if stored is not None else made


def member_id(class_id: Column, name: Column, taken: Column | None = None, decorators: Column | None = None) -> Column:
    """class_id.name; with the decorators behind it where the name is taken already."""
    plain = F.concat_ws(".", class_id, name)
    if taken is None or decorators is None:
        return plain
    return F.when(taken & (F.size(decorators) > 0), F.concat(plain, F.array_join(decorators, ""))).otherwise(plain)


def import_id(source: Column, name: Column) -> Column:
    filled = lambda c: F.when(c != "", c)
    return F.coalesce(F.concat_ws(".", filled(source), filled(name)), F.lit(""))


def as_dependency(alias: Column, name: Column, source: Column) -> Column:
    filled = lambda c: F.when(c != "", c)
    return F.coalesce(filled(alias), filled(name), source)


def import_statement(source: Column, name: Column, alias: Column) -> Column:
    """The statement that binds an import, in one form however it was written."""
    filled = lambda c: F.when(c != "", c)
    whole = F.concat(F.lit("import "), source)
    some = F.concat(F.lit("from "), F.coalesce(filled(source), F.lit(".")), F.lit(" import "), filled(name))
    return F.concat(F.coalesce(some, whole), F.coalesce(F.concat(F.lit(" as "), filled(alias)), F.lit("")))


def is_subset(ids: Column, of: Column) -> Column:
    """Whether all of ids are among others; none are among any."""
    return F.size(F.array_except(ids, of)) == 0


def common_ids(a: Column, b: Column) -> Column:
    """The ids that both have, each once, in order."""
    return F.array_sort(F.array_intersect(a, b))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def dirname(path: Column) -> Column:
    """The directory of a path; . where it has none."""
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise(".")


def ancestors(path: Column) -> Column:
    """All directories above a path, from the top."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).otherwise(F.array().cast("array<string>"))


def directories(files: DataFrame) -> DataFrame:
    """path: every directory above a file, once."""
    return files.select(F.explode(ancestors(F.col("path"))).alias("path")).where("path <> ''").distinct()


def by_basename(files: DataFrame) -> DataFrame:
    """name, path: of files that share a name the last path in order."""
    return files.groupBy(basename(F.col("path")).alias("name")).agg(F.max("path").alias("path"))


def known_ids(elements: DataFrame, files: DataFrame) -> DataFrame:
    """unique_id of everything that can be asked for: elements but imports, files, directories."""
    return elements.where("kind <> 'import'").select("unique_id").unionByName(files.select(F.col("path").alias("unique_id"))).unionByName(directories(files).select(F.col("path").alias("unique_id")))


def module_files(files: DataFrame, modules: DataFrame) -> DataFrame:
    """(module, path): files under each module (module, pos); a file goes to the first module that holds it.

    The files are joined by their ancestors, an equi-join, so neither side needs to be small.
    """
    under = files.select("path", F.explode(ancestors(F.col("path"))).alias("above"))
    named = modules.select("module", "pos", F.rtrim("module", F.lit("/")).alias("above"))
    first = Window.partitionBy("path").orderBy("pos", "module")
    return under.join(named, "above").withColumn("r", F.row_number().over(first)).where("r = 1").select("module", "path")


def expanded_ids(ids: DataFrame, files: DataFrame) -> DataFrame:
    """ids (unique_id, pos) in which those that end in / stand for their files."""
    modules = ids.where(F.col("unique_id").endswith("/")).select(F.col("unique_id").alias("module"), "pos")
    rest = ids.where(~F.col("unique_id").endswith("/")).select("unique_id", "pos")
    found = module_files(files, modules).join(modules, "module").select(F.col("path").alias("unique_id"), "pos")
    return rest.unionByName(found).groupBy("unique_id").agg(F.min("pos").alias("pos"))


@F.pandas_udf(StringType())
def normalised(path: pd.Series) -> pd.Series:
    """The normal form of a path; one that ends in / stays as it is."""
    return path.map(lambda p: p if p.endswith("/") else posixpath.normpath(p).replace("\\", "/"), na_action="ignore")


def unique_paths(paths: DataFrame) -> DataFrame:
    """path, pos of paths (path, pos) in normal form, the first of equal ones."""
    return paths.withColumn("path", normalised("path")).groupBy("path").agg(F.min("pos").alias("pos"))


def text_files(ids: DataFrame, files: DataFrame, skip: Column) -> DataFrame:
    """ids that are text files, with their content."""
    return ids.join(files.where(~skip), ids["unique_id"] == files["path"]).select("unique_id", "raw")


def ids_to_paths(ids: DataFrame, elements: DataFrame, files: DataFrame) -> DataFrame:
    """(unique_id, path): a file is its own path, an element has its file's; others go."""
    f, e = files.select(F.col("path").alias("unique_id"), F.col("path").alias("f")), elements.groupBy("unique_id").agg(F.min("file_path").alias("e"))
    return ids.join(f, "unique_id", "left").join(e, "unique_id", "left").select("unique_id", F.coalesce("f", "e").alias("path")).where("path IS NOT NULL")
