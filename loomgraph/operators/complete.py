"""Identifier completion, validation and extraction over words (pos, word)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .nearest import nearest, similar, similarity
from .search import stated


def may_reach(a: Column, b: Column, least: float) -> Column:
    """Whether two strings' lengths allow that ratio: it is at most 2 min / sum."""
    return 2 * F.least(F.length(a), F.length(b)) >= least * (F.length(a) + F.length(b)) - 1e-9


def containing(longer: DataFrame, shorter: DataFrame) -> DataFrame:
    """(longer, shorter): the pairs of longer (longer) and shorter (shorter), of three characters or more, that the one
    contains: they meet in a join of the shorter one's first three characters, or first twelve if it has as many, with
    all runs of as many of the longer."""
    grams = lambda n: F.when(F.length("longer") >= n, F.transform(F.sequence(F.lit(1), F.length("longer") - (n - 1)), lambda i: F.substr("longer", i, F.lit(n))))
    all_grams = F.array_distinct(F.concat(grams(3), F.coalesce(grams(12), F.array().cast("array<string>"))))
    runs = longer.select("longer").distinct().where(F.length("longer") > 2).withColumn("gram", F.explode(all_grams))
    heads = shorter.select("shorter").distinct().where(F.length("shorter") > 2).withColumn("gram", F.substring("shorter", 1, F.when(F.length("shorter") >= 12, 12).otherwise(3)))
    return runs.join(heads, "gram").where(F.col("longer").contains(F.col("shorter"))).select("longer", "shorter")


def suggestions(words: DataFrame, prefixes: DataFrame, k: int = 10, case_sensitive: bool = False, inside: bool = False) -> DataFrame:
    """(prefix, rank, word): the first k words in order that start with (inside: contain) each prefix.

    prefixes are a stated set against all words, of bounded size; an empty prefix matches all words.
    """
    fold = (lambda c: F.col(c)) if case_sensitive else (lambda c: F.lower(c))
    hit = fold("word").contains(fold("prefix")) if inside else fold("word").startswith(fold("prefix"))
    rows = words.select("word").distinct().join(stated(prefixes.select("prefix").distinct()), hit)
    order = Window.partitionBy("prefix").orderBy("word")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("prefix", "rank", "word")


def validated(ids: DataFrame, words: DataFrame, k: int = 5, cutoff: float = 0.3) -> DataFrame:
    """(code_identifier, is_valid, matching_identifiers): known identifiers; else the k most similar words.

    Words that contain the identifier, cases aside, count even below the cutoff.  Neither side needs to be small.
    """
    known = words.select(F.col("word").alias("code_identifier")).distinct().withColumn("is_valid", F.lit(True))
    rows = ids.select("code_identifier").distinct().join(known, "code_identifier", "left").withColumn("is_valid", F.coalesce("is_valid", F.lit(False)))
    asked = rows.where("NOT is_valid").select(F.col("code_identifier").alias("t"))
    best = nearest(asked, words.select(F.col("word").alias("w")), cutoff, k, inside=True).select(F.col("t").alias("code_identifier"), F.col("w").alias("word"), "r")
    lists = best.groupBy("code_identifier").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "word"))), lambda x: x["word"]).alias("m"))
    return rows.join(lists, "code_identifier", "left").select("code_identifier", "is_valid", F.when(F.col("is_valid"), F.array("code_identifier")).otherwise(F.coalesce("m", F.array().cast("array<string>"))).alias("matching_identifiers"))


def validated_paths(paths: DataFrame, known: DataFrame) -> DataFrame:
    """(path, found): a path as it is or normalised if it is known; null otherwise, for the caller to report."""
    from .paths import normalised

    known = known.select("path").distinct()
    a, b = known.select(F.col("path"), F.col("path").alias("direct")), known.select(F.col("path").alias("norm"), F.col("path").alias("via"))
    return paths.join(a, "path", "left").withColumn("norm", normalised("path")).join(b, "norm", "left").select("path", F.coalesce("direct", "via").alias("found"))


def text_tokens(texts: DataFrame, dotted: bool = False) -> DataFrame:
    """(text_id, token, place): distinct tokens of each text with the place of the first; dotted keeps . and /."""
    pattern = r"\b[\w./]+\b" if dotted else r"\b\w+\b"
    found = texts.select("text_id", F.posexplode(F.regexp_extract_all("text", F.lit(f"(?U){pattern}"), F.lit(0))).alias("place", "token"))
    return found.groupBy("text_id", "token").agg(F.min("place").alias("place"))


def subpath(longer: Column, shorter: Column) -> Column:
    """Whether shorter is a run of whole parts of longer; both have a slash, and no part has one character."""
    parts = F.split(shorter, "/")
    return longer.contains("/") & shorter.contains("/") & (F.length(shorter) >= 3) & F.forall(parts, lambda p: F.length(p) > 1) & F.concat(F.lit("/"), longer, F.lit("/")).contains(F.concat(F.lit("/"), shorter, F.lit("/")))


def substring(longer: Column, shorter: Column) -> Column:
    return (F.length(shorter) >= 4) & (F.length(shorter) / F.length(longer) >= 0.3) & longer.contains(shorter)


def extracted(texts: DataFrame, words: DataFrame, mapped: DataFrame | None = None, threshold: float = 0.6, case_sensitive: bool = False, dotted: bool = False, per_word: int | None = None) -> DataFrame:
    """(text_id, word, token, match_type, score): words found in texts (text_id, text).

    Exact matches (mapped: alias, word stand for words) first; then substrings and subpaths, then similar words, each
    the best pair first with every word and token used once: that is a sequential choice, made per text.  per_word
    keeps so many matches a word: exact before substring before fuzzy, then by score.  Pairs to look at come from
    joins on shared characters, so neither texts nor words need be few.
    """
    fold = (lambda c: c) if case_sensitive else F.lower
    tokens = text_tokens(texts, dotted).withColumn("t", fold(F.col("token")))
    vocabulary = words.groupBy("word").agg(F.min("pos").alias("pos")).withColumn("w", fold(F.col("word")))
    names = vocabulary.select("w", "word")
    if mapped is not None:
        names = names.unionByName(mapped.select(fold(F.col("alias")).alias("w"), "word"))
    exact = tokens.join(names, F.col("t") == F.col("w")).groupBy("text_id", "word").agg(F.min_by("token", "place").alias("token")).withColumn("match_type", F.lit("exact")).withColumn("score", F.lit(1.0))
    used = tokens.join(names.select(F.col("w").alias("t")).distinct(), "t", "left_semi").select("text_id", "token")
    free_tokens = tokens.join(used, ["text_id", "token"], "left_anti")
    t, w = F.col("t"), F.col("w")
    near = F.length(t) > 2
    path = w.contains("/") & t.contains("/")
    inner = near & (t != w) & w.contains(t) & F.when(path, subpath(w, t)).otherwise(substring(w, t))
    outer = near & (t != w) & t.contains(w) & F.when(path, subpath(t, w)).otherwise(substring(t, w))
    words_ = vocabulary.select("w")
    as_ = lambda df, name: df.select(F.col(df.columns[0]).alias(name))
    free = free_tokens.select("t").distinct()
    rest = exact.select("text_id", "word")

    def met(pairs: DataFrame) -> DataFrame:
        return free_tokens.join(pairs, "t").join(vocabulary, "w").join(rest, ["text_id", "word"], "left_anti")

    held = containing(as_(words_, "longer"), as_(free, "shorter")).select(F.col("shorter").alias("t"), F.col("longer").alias("w"))
    held = held.unionByName(containing(as_(free, "longer"), as_(words_, "shorter")).select(F.col("longer").alias("t"), F.col("shorter").alias("w"))).distinct()
    kind = F.when(inner, F.when(path, "subpath").otherwise("substring")).when(outer, F.when(path, "reverse_subpath").otherwise("reverse_substring"))
    cover = F.least(F.length(t), F.length(w)) / F.greatest(F.length(t), F.length(w))
    parts = met(held).withColumn("kind", kind).where("kind IS NOT NULL").withColumn("score", cover)
    ratios = similar(free, words_, threshold).withColumn("ratio", similarity("w", "t")).where(F.col("ratio") >= threshold)
    pairs = parts.unionByName(met(ratios).withColumnRenamed("ratio", "score").withColumn("kind", F.lit("fuzzy")))

    def choose(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        text, words_used, tokens_used = None, set(), set()
        for frame in frames:
            taken = []
            for i, (x, word, token) in enumerate(zip(frame["text_id"], frame["word"], frame["token"])):
                if x != text and (x == x or text == text):  # a null is one text
                    text, words_used, tokens_used = x, set(), set()
                if word not in words_used and token not in tokens_used:
                    words_used.add(word)
                    tokens_used.add(token)
                    taken.append(i)
            yield frame.iloc[taken][["text_id", "word", "token", "match_type", "score"]]

    # The best pair of a text first; a pair of a kind that is passed over stays so as a similar one.
    order = ["text_id", F.col("kind") == "fuzzy", F.col("score").desc(), "pos", "place", "word", "token"]
    chosen = pairs.repartition("text_id").sortWithinPartitions(*order).select("text_id", "word", "token", F.col("kind").alias("match_type"), "score").mapInPandas(choose, "text_id long, word string, token string, match_type string, score double")
    found = exact.select("text_id", "word", "token", "match_type", "score").unionByName(chosen)
    if per_word is None:
        return found
    rank = F.when(F.col("match_type") == "exact", 0).when(F.col("match_type") == "fuzzy", 2).otherwise(1)
    order = Window.partitionBy("text_id", "word").orderBy(rank, F.col("score").desc(), "token")
    return found.withColumn("r", F.row_number().over(order)).where(F.col("r") <= per_word).drop("r")


def in_order(found: DataFrame) -> DataFrame:
    """extracted() with its place in each text's result: exact matches by word, then parts by word, then similar ones by
    score, ties by word."""
    kind = F.when(F.col("match_type") == "exact", 0).when(F.col("match_type") == "fuzzy", 2).otherwise(1)
    order = Window.partitionBy("text_id").orderBy(kind, F.when(kind == 2, -F.col("score")), "word", "token")
    return found.withColumn("place", F.row_number().over(order))


def nearest_paths(paths: DataFrame, known: DataFrame, cutoff: float = 0.6) -> DataFrame:
    """(path, found, closest): validated_paths(), and for a path that is not found the most similar known one of that
    ratio or more, ties to the first in order; null without one."""
    rows = validated_paths(paths, known)
    missing = rows.where("found IS NULL AND path <> ''").select(F.col("path").alias("t"))
    best = nearest(missing, known.select(F.col("path").alias("w")).where("path <> ''"), cutoff, 1).select(F.col("t").alias("path"), F.col("w").alias("closest"))
    return rows.join(best, "path", "left").select("path", "found", "closest")
