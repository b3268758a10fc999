"""Keeping tables up to date with changed files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def snapshot_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, change) of snapshots (path, mtime): new, modified (a later mtime), deleted or same."""
    a, b = old.select("path", F.col("mtime").alias("was")), new.select("path", F.col("mtime").alias("now"))
    change = F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "deleted").when(F.col("now") > F.col("was"), "modified").otherwise("same")
    return a.join(b, "path", "full_outer").select("path", change.alias("change"))


def applied(rows: DataFrame, fresh: DataFrame, changes: DataFrame, path: str = "file_path") -> DataFrame:
    """rows without those of deleted and modified files, and fresh rows of new and modified ones."""
    gone = changes.where("change IN ('deleted', 'modified')").select(F.col("path").alias(path))
    come = changes.where("change IN ('new', 'modified')").select(F.col("path").alias(path))
    return rows.join(gone, path, "left_anti").unionByName(fresh.join(come, path, "left_semi"))


def to_resolve(old_imports: DataFrame, new_imports: DataFrame, changes: DataFrame) -> DataFrame:
    """(file_path, imports_changed): new and modified files; all need their own references, those whose list of
    imports changed also need their imports resolved anew."""
    ids = lambda d, name: d.groupBy("file_path").agg(F.array_sort(F.collect_list("unique_id")).alias(name))
    files = changes.where("change IN ('new', 'modified')").select(F.col("path").alias("file_path"))
    both = files.join(ids(old_imports, "a"), "file_path", "left").join(ids(new_imports, "b"), "file_path", "left")
    empty = F.array().cast("array<string>")
    return both.select("file_path", (F.coalesce("a", empty) != F.coalesce("b", empty)).alias("imports_changed"))


def committed(files: DataFrame, changes: DataFrame) -> DataFrame:
    """files (path, content) after changes (path, action ADD/UPDATE/DELETE, new_content, move_path).

    A move onto a file that exists and isn't changed itself is an error, raised when the result is computed.
    """
    gone = changes.where("action = 'DELETE' OR move_path IS NOT NULL OR action = 'UPDATE'").select("path")
    put = changes.where("action <> 'DELETE'").select(F.coalesce("move_path", "path").alias("path"), "new_content", F.col("move_path").isNotNull().alias("moves"))
    rest = files.join(gone, "path", "left_anti")
    both = rest.join(put, "path", "full_outer")
    clash = F.col("moves") & F.col("content").isNotNull()
    content = F.when(clash, F.raise_error(F.concat(F.lit("move target exists: "), "path")).cast("string")).otherwise(F.coalesce("new_content", "content"))
    return both.select("path", content.alias("content"))
