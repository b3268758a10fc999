"""Mixing sources to target weights by Pareto order sampling.

Every source gets a target number of words.  A source whose target is r times its size takes floor(r) certain copies
of each of its documents.  What is left of the target is sampled without replacement, with chances that grow with a
document's size: as the number of binary digits of its words, up to one, scaled so that the expected words are those
that are left.  A document whose chance is one is a certain copy too.  The others are drawn by Pareto order sampling
(Rosen 1997): a document with inclusion chance p and a uniform number u ranks by (u / (1 - u)) / (p / (1 - p)), and the
lowest ranks are taken.  The sample's size is fixed in words, which is what targets are stated in: it ends where the
words taken are nearest to the target, so a source misses its target by half a document at most.

Scale: the text is read once.  Chances come from sums per source and size class, 32 at most.  Ranks are dealt into
buckets of about `bucket_rows` documents of one source by their distribution function over the source, which is
uniform whatever the chances, so that a source with a third of all rows spreads over many tasks; only sums per bucket
are ordered by source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

WEIGHTS = (3, 1, 2)
#: Sums per source and size class are broadcast up to so many rows, of about half a kilobyte; beyond, Spark joins by key.
BROADCAST_CELLS = 20_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(common.WORD)), F.lit(0)).cast("long")


def uniform(key: Column, seed: str) -> Column:
    """52 bits of MD5 as a number strictly between 0 and 1: the same on every run and every engine."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null")))), 1, 13), 16, 10)
    return (bits.cast("long").cast("double") + 0.5) / float(2**52)


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.5, most: int = 2) -> DataFrame:
    """(source_no, source, n, source_size, target) from rows (source, size).

    Sources in code point order, null last, weigh `weights`, repeating.  Together the targets are `share` of
    all sizes; none exceeds `most` times its source's size, and what exceeds it is shared anew by weight.
    The level at which that ends is found in closed form over the sources in the order of saturation, so the
    only single-task step holds one row per source.  All empty: targets of 0.
    """
    per = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("source_size"))
    number = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    per = per.withColumn("source_no", number).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("source_no") % len(weights)) + 1))
    every = Window.partitionBy()
    before = Window.orderBy(F.col("full_at"), F.col("source_no")).rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("full_at", F.lit(float(most)) * F.col("source_size") / F.col("weight"))
    left = F.lit(share) * F.sum("source_size").over(every) - F.coalesce(F.sum(F.lit(most) * F.col("source_size")).over(before), F.lit(0))
    level = left / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    per = per.withColumn("level", level)
    per = per.withColumn("level", F.min_by("level", F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", "source_no"))).over(every))
    cap = F.lit(float(most)) * F.col("source_size")
    return per.select("source_no", "source", "n", "source_size", F.least(F.coalesce(F.col("weight") * F.col("level"), cap), cap).alias("target"))


def chances(sized: DataFrame, per: DataFrame) -> DataFrame:
    """(source_no, class, chance): the inclusion chance of documents of each size class of each source, beyond the
    certain copies of all; from per with `rest`, the words that are left.

    The level at which chances c * class, one at most, make the expected words is found in closed form over the classes
    in the order of saturation, largest first.
    """
    cells = sized.groupBy("source", size_class("size").alias("class")).agg(F.count(F.lit(1)).alias("docs"), F.sum("size").alias("words"))
    cells = cells.join(per.select("source_no", F.col("source").alias("of_source"), "rest"), F.col("source").eqNullSafe(F.col("of_source")))
    order = Window.partitionBy("source_no").orderBy(F.col("class").desc())
    before, onward = (order.rowsBetween(*ends) for ends in ((Window.unboundedPreceding, -1), (Window.currentRow, Window.unboundedFollowing)))
    left = F.col("rest") - F.coalesce(F.sum("words").over(before), F.lit(0))
    cells = cells.withColumn("level", F.try_divide(left, F.sum(F.col("class") * F.col("words")).over(onward)))
    fits = F.when(F.col("level") * F.col("class") <= 1, F.struct(-F.col("class")))
    level = F.coalesce(F.min_by("level", fits).over(Window.partitionBy("source_no")), F.lit(1.0))
    chance = F.when(F.col("rest") > 0, F.least(level * F.col("class"), F.lit(1.0))).otherwise(F.lit(0.0))
    return cells.select("source_no", "class", "docs", "words", chance.alias("chance"))


def size_class(size) -> Column:
    """The number of binary digits of a size."""
    return F.length(F.bin(size)).cast("long")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, share: float = 1.5, most: int = 2, seed: str = "mix", bucket_rows: int = 500) -> DataFrame:
    """One row per row of docs: doc_id, size, source_size, target, chance, copies, taken.

    size: words of the text (null: 0); chance: of a copy beyond the certain ones; copies: whole copies in the mix, at
    most `most`; taken: copies * size.  Null ids, sources and texts, repeated rows and ties are kept: equal rows are
    told apart by nothing, so either may be the one that is taken.  An empty table gives no rows.  Other columns
    are not read.
    """
    sized = common.settled(docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{source_col}`").alias("source"), word_count(F.col(f"`{text_col}`")).alias("size")))
    return allot(sized, weights, share, most, seed, bucket_rows)


def allot(sized: DataFrame, weights=WEIGHTS, share: float = 1.5, most: int = 2, seed: str = "mix", bucket_rows: int = 500, sizes: DataFrame | None = None) -> DataFrame:
    """mix() on rows that have doc_id, source and size already; further columns are kept, but those that have the
    name of a column of the result are replaced.  sizes: doc_id, source and size of the same rows, settled, so that
    sums need not compute the rows anew."""
    result = ["doc_id", "size", "source_size", "target", "chance", "copies", "taken"]
    extra = [c for c in sized.columns if c not in (*result, "source")]
    rows = sized.select("doc_id", "source", "size", F.struct(F.lit(0).alias("_extra_"), *[F.col(f"`{c}`") for c in extra]).alias("extra"))
    narrow = rows if sizes is None else sizes
    per = targets(narrow, weights, share, most)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    per = per.withColumn("whole", F.floor(ratio)).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    cells = common.settled(chances(narrow, per))
    in_draw = (F.col("chance") > 0) & (F.col("chance") < 1)
    drawn = F.collect_list(F.when(in_draw, F.struct("docs", (F.col("chance") / (1 - F.col("chance"))).alias("odds"))))
    certain = F.sum(F.when(F.col("chance") == 1, F.col("words")).otherwise(0))
    mixtures = cells.groupBy(F.col("source_no").alias("no")).agg(F.array_sort(drawn).alias("mixture"), certain.alias("certain"))
    per = per.join(mixtures, F.col("source_no") == F.col("no")).withColumn("to_draw", F.col("rest") - F.col("certain")).withColumnRenamed("source", "of_source").drop("no", "rest", "certain", "n")
    per = per.join(cells.select(F.col("source_no").alias("no"), "class", "chance"), F.col("source_no") == F.col("no")).drop("no")
    if cells.count() <= BROADCAST_CELLS:
        per = F.broadcast(per)
    u = uniform(F.col("doc_id"), seed)
    # How many of the source's documents are expected to rank lower: uniform, so buckets are of a size.
    lower = F.aggregate("mixture", F.lit(0.0), lambda s, x: s + x["docs"] * x["odds"] * F.col("rank") / (1 + x["odds"] * F.col("rank")))

    def named(rows: DataFrame) -> DataFrame:
        return rows.withColumn("own_class", size_class("size")).join(per, F.col("source").eqNullSafe(F.col("of_source")) & (F.col("own_class") == F.col("class")))

    def in_buckets(rows: DataFrame) -> DataFrame:
        rank = (u / (1 - u)) / (F.col("chance") / (1 - F.col("chance")))
        return named(rows).where(in_draw).withColumn("rank", rank).withColumn("bucket", F.floor(lower / bucket_rows))

    ranked = in_buckets(rows)
    sums = in_buckets(narrow).groupBy("source_no", "bucket").agg(F.sum("size").alias("bucket_size"))
    earlier = Window.partitionBy("source_no").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("source_no").alias("s_no"), F.col("bucket").alias("s_bucket"), F.coalesce(F.sum("bucket_size").over(earlier), F.lit(0)).alias("ahead"))
    ranked = ranked.join(sums, (F.col("source_no") == F.col("s_no")) & (F.col("bucket") == F.col("s_bucket")))
    within = Window.partitionBy("source_no", "bucket").orderBy("rank", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    upto = F.col("ahead") + F.sum("size").over(within)
    picked = F.when((upto + upto - F.col("size")).cast("double") <= 2 * F.col("to_draw"), 1).otherwise(0)
    everything = [*[c for c in result[:5]], "whole", "extra"]
    ranked = ranked.withColumn("picked", picked).select(*everything, "picked")
    sure = named(rows).where(~in_draw).select(*everything, F.col("chance").cast("int").alias("picked"))
    out = ranked.unionByName(sure).withColumn("copies", (F.col("whole") + F.col("picked")).cast("long"))
    return out.select(*result[:6], (F.col("copies") * F.col("size")).alias("taken"), *[F.col(f"extra.`{c}`").alias(c) for c in extra])


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(common.table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = r"""
WITH sized AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
numbered AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS source_no FROM per),
weighed AS (SELECT *, [3, 1, 2][(source_no % 3 + 1)::INT] AS weight FROM numbered),
filled AS (SELECT *, 2.0::DOUBLE * source_size / weight AS full_at FROM weighed),
levels AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(2 * source_size) OVER (ORDER BY full_at, source_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY full_at, source_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM filled),
chosen AS (SELECT level FROM levels WHERE level <= full_at ORDER BY full_at, source_no LIMIT 1),
target AS (SELECT source, source_size, least(weight * chosen.level, 2.0::DOUBLE * source_size) AS target FROM levels, chosen),
part AS (SELECT *, target - whole * source_size AS rest FROM (SELECT *, floor(CASE WHEN source_size > 0 THEN target / source_size ELSE 0::DOUBLE END) AS whole FROM target)),
cells AS (SELECT p.source, length(bin(s.size)) AS class, any_value(p.rest) AS rest, sum(s.size) AS words FROM sized s JOIN part p ON s.source IS NOT DISTINCT FROM p.source GROUP BY p.source, class),
leveled AS (SELECT *, (rest - coalesce(sum(words) OVER (PARTITION BY source ORDER BY class DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(class * words) OVER (PARTITION BY source ORDER BY class DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM cells),
fitting AS (SELECT source, arg_max(level, class) AS level FROM leveled WHERE level * class <= 1 GROUP BY source),
chances AS (SELECT l.source, l.class, l.words, CASE WHEN l.rest > 0 THEN least(coalesce(f.level, 1) * l.class, 1::DOUBLE) ELSE 0::DOUBLE END AS chance
    FROM leveled l LEFT JOIN fitting f ON l.source IS NOT DISTINCT FROM f.source),
certain AS (SELECT source, coalesce(sum(words) FILTER (chance = 1), 0) AS words FROM chances GROUP BY source),
ranked AS (SELECT s.doc_id, s.size, p.source, p.source_size, p.target, p.whole, p.rest - e.words AS to_draw, c.chance,
    (('0x' || substr(md5('mix:' || coalesce(s.doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE AS u
    FROM sized s JOIN part p ON s.source IS NOT DISTINCT FROM p.source
    JOIN chances c ON s.source IS NOT DISTINCT FROM c.source AND length(bin(s.size)) = c.class JOIN certain e ON s.source IS NOT DISTINCT FROM e.source),
ordered AS (SELECT *, (u / (1 - u)) / (chance / (1 - chance)) AS rank FROM ranked WHERE chance > 0 AND chance < 1),
summed AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY rank, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto FROM ordered)
SELECT doc_id, size, source_size, target, ((whole + CASE WHEN (upto + upto - size)::DOUBLE <= 2 * to_draw THEN 1 ELSE 0 END) * size)::BIGINT AS taken FROM summed
UNION ALL SELECT doc_id, size, source_size, target, ((whole + chance) * size)::BIGINT FROM ranked WHERE chance IN (0, 1)
"""
