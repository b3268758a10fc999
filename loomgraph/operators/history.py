"""Windows over conversation turns (conv_id, turn, role, text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def trimmed(turns: DataFrame, budget: int, size: Column) -> DataFrame:
    """The latest turns of each conversation whose sizes together stay within the budget; none if the last exceeds it."""
    suffix = Window.partitionBy("conv_id").orderBy(F.col("turn").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return turns.withColumn("used", F.sum(size).over(suffix)).where(F.col("used") <= budget)


def rolling_union(turns: DataFrame, sets: Column, last: int = 3) -> DataFrame:
    """turns with `recent`: the distinct members, sorted, of the array `sets` of the last so many turns."""
    recent = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-(last - 1), Window.currentRow)
    return turns.withColumn("recent", F.array_sort(F.array_distinct(F.flatten(F.collect_list(sets).over(recent)))))


def latest(turns: DataFrame, n: Column | int) -> DataFrame:
    """The last n turns of each conversation; n may differ by row."""
    back = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").desc()))
    return turns.withColumn("back", back).where(F.col("back") <= n)


def first_window(length: Column) -> Column:
    """How many turns a growing history window starts with."""
    return F.least(length, F.floor(0.2 * length) + 1)


def grown(turns: DataFrame, requests: DataFrame, rounds: int = 10) -> DataFrame:
    """The turns of each conversation in its window after it has grown: requests (conv_id, round, more) says how many
    more turns each round asks for; rounds beyond the last allowed, and those behind one that asks for none, don't
    count.  A window never exceeds its conversation."""
    n = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    so_far = Window.partitionBy("conv_id").orderBy("round").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    asked = requests.where(F.col("round") <= rounds).withColumn("goes_on", F.min(F.when(F.col("more") > 0, 1).otherwise(0)).over(so_far))
    more = asked.where("goes_on = 1").groupBy("conv_id").agg(F.sum("more").alias("more"))
    sizes = n.join(more, "conv_id", "left").select("conv_id", F.least(F.col("n"), first_window(F.col("n")) + F.coalesce("more", F.lit(0))).alias("size"))
    return latest(turns.join(sizes, "conv_id"), F.col("size"))


def reordered(turns: DataFrame, is_tool: Column, keeps: Column) -> DataFrame:
    """turns with `place`: tool steps without output go; the others follow the next step that is no tool, in order."""
    rows = turns.withColumn("_tool", is_tool).where(~is_tool | keeps)
    ahead = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(1, Window.unboundedFollowing)
    host = F.first(F.when(~F.col("_tool"), F.col("turn")), ignorenulls=True).over(ahead)
    rows = rows.withColumn("_host", F.when(F.col("_tool"), F.coalesce(host, F.col("turn"))).otherwise(F.col("turn")))
    order = Window.partitionBy("conv_id").orderBy("_host", "_tool", "turn")
    return rows.withColumn("place", F.row_number().over(order)).drop("_tool", "_host")


def merged_props(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Per key what accumulates: numbers (and booleans, as numbers) add up, strings join, lists append, sets unite."""
    listed = lambda c: F.transform(F.array_sort(F.collect_list(F.struct(order, c))), lambda x: x[c])
    return rows.groupBy(key).agg(F.sum("number").alias("number"), F.array_join(listed("string"), "").alias("string"), listed("item").alias("items"), F.array_sort(F.collect_set("item")).alias("item_set"), F.bool_or("flag").alias("any_flag"))
