"""Similar strings: all texts are compared with all words, in blocks, by a bound that is cheap; only pairs whose bound
allows it get their Ratcliff-Obershelp ratio."""

from __future__ import annotations

from bisect import insort
from collections.abc import Callable
from difflib import SequenceMatcher
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from loomgraph.sources.shared import shared_dir

#: Texts, and characters of words, that are compared in one group at most (a longer word is a block of its own).
TEXTS, CHARS = 1024, 150_000
NEAR = 1e-9


@F.pandas_udf(DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio of two strings, for which there is no built-in; pairs that repeat cost once."""
    seen: dict[tuple[str, str], float] = {}
    out = []
    for pair in zip(a, b):
        if pair not in seen:
            seen[pair] = SequenceMatcher(None, *pair).ratio() if None not in pair else None
        out.append(seen[pair])
    return pd.Series(out, dtype="float64")


def bounds(words: list[str]) -> Callable[[str], np.ndarray]:
    """A function of a text: the most its ratio with each word can be, 2 l / (sum of lengths), l the length of their
    longest common subsequence; the ratio's blocks are one, so it is never above.

    The subsequences with all words are found at once, by bits: one for each character of each word.  A character of the
    text costs four operations on them.  Words of up to 64 characters are lanes of one array, longer ones are parts of one
    long integer, with a bit behind each word that keeps its carry.
    """
    sizes = np.array([len(w) for w in words])
    width = next((n for n in (32, 64) if sizes.max() <= n), 0)
    masks: dict = {}
    if width:
        inside = np.arange(width) < sizes[:, None]
        codes = np.zeros(inside.shape, np.uint32)
        codes[inside] = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        packed = lambda bits: np.packbits(bits, axis=1, bitorder="little").view(f"<u{width // 8}").ravel()
    else:
        ends = np.cumsum(sizes + 1)
        codes = np.frombuffer("\0".join([*words, ""]).encode("utf-32-le"), np.uint32)
        inside = np.ones(len(codes), bool)
        inside[ends - 1] = False
        packed = lambda bits: int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
        body = packed(inside)

    def mask(c: str):
        if c not in masks:
            bits = (codes == ord(c)) & inside
            masks[c] = packed(bits) if bits.any() else None
        return masks[c]

    def in_lanes(text: str) -> np.ndarray:
        free = np.full(len(words), 2**width - 1, f"<u{width // 8}")
        hit = np.empty_like(free)
        for c in text:
            if (m := mask(c)) is not None:
                np.bitwise_and(free, m, out=hit)
                sums = free + hit
                np.bitwise_xor(free, hit, out=free)
                np.bitwise_or(free, sums, out=free)
        return width - np.bitwise_count(free).astype(np.int64)

    def in_one(text: str) -> np.ndarray:
        free = body
        for c in text:
            if (m := mask(c)) is not None:
                hit = free & m
                free = ((free + hit) | (free ^ hit)) & body
        bits = np.unpackbits(np.frombuffer(free.to_bytes(len(codes) // 8 + 1, "little"), np.uint8), bitorder="little", count=len(codes))
        return sizes - np.add.reduceat(bits, ends - sizes - 1, dtype=np.int32)

    def of(text: str) -> np.ndarray:
        both = sizes + len(text)
        return np.where(both > 0, 2.0 * (in_lanes if width else in_one)(text) / np.maximum(both, 1), 1.0)

    return of


def holders(words: list[str]) -> Callable[[str], np.ndarray]:
    """A function of a text: which of the words contain it."""
    joined, ends = "\0".join(words), np.cumsum([len(w) + 1 for w in words])

    def of(text: str) -> np.ndarray:
        if "\0" in text:
            return np.array([text in w for w in words])
        found, at = np.zeros(len(words), bool), joined.find(text)
        while at >= 0:
            i = int(np.searchsorted(ends, at, "right"))
            found[i] = True
            at = joined.find(text, ends[i]) if i + 1 < len(words) else -1
        return found

    return of


def _size_class(c: Column) -> Column:
    return F.floor(F.log2(F.greatest(F.length(c), F.lit(1))) * 3).cast("int")


class Blocks:
    """words (w) in blocks of like length, and the texts (t) dealt to the blocks that they may be near to."""

    def __init__(self, words: DataFrame):
        self.spark: SparkSession = words.sparkSession
        size = F.length("w")
        found = words.groupBy(_size_class(F.col("w")).alias("c")).agg(F.sum(size + 1).alias("chars"), F.min(size).alias("least"), F.max(size).alias("most")).orderBy("c").collect()
        classes, self.n = [], 0
        for r in found:  # three rows an octave of lengths
            n = ceil(r.chars / CHARS)
            classes.append((r.c, self.n, n, r.least, r.most))
            self.n += n
        self.classes = F.broadcast(self.spark.createDataFrame(classes, "c int, first long, n long, least long, most long"))
        keyed = words.withColumn("c", _size_class(F.col("w"))).join(self.classes, "c")
        self.words = keyed.withColumn("block", F.col("first") + F.pmod(F.xxhash64("w"), "n")).drop("c", "first", "n", "least", "most")

    def reached(self, texts: DataFrame, least: float | None) -> DataFrame:
        """texts, one row for each block: all, or those with a length that allows that ratio, 2 min / sum at most."""
        size, near = F.length("t"), F.lit(True)
        if least is not None:
            closest = F.greatest(F.col("least"), F.least(F.col("most"), size))
            near = 2 * F.least(size, closest) >= least * (size + closest) - NEAR
        rows = texts.join(self.classes, near)
        return rows.withColumn("block", F.explode(F.sequence("first", F.col("first") + F.col("n") - 1))).drop("c", "first", "n", "least", "most")

    def compared(self, texts: DataFrame, n_texts: int, look: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
        """What look finds for each group of texts (t, block) and the words of that block."""
        cores = self.spark.sparkContext.defaultParallelism
        parts = max(ceil(n_texts / TEXTS), min(ceil(n_texts / 64), ceil(4 * cores / self.n)))
        group = lambda part: (F.col("block") * parts + part).alias("group")
        dealt = texts.select("*", group(F.pmod(F.xxhash64("t"), F.lit(parts))))
        words = self.words.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).select("*", group(F.col("part")))
        n = min(parts * self.n, 1000)  # a stated number, as the rows are few for the work they are
        a, b = (df.repartition(n, "group").groupBy("group") for df in (dealt, words))
        return a.cogroup(b).applyInPandas(lambda t, w: look(t, w) if len(t) and len(w) else pd.DataFrame(), schema)


def similar(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """(t, w): the pairs of texts of left (t) and right (w) that may reach that ratio, above 0: those whose longest common
    subsequence allows it.  None that reaches it is missing, except of empty texts."""
    if least <= 0:
        raise ValueError("the least ratio must be above 0")
    texts, words = (df.select(c).where(F.length(c) > 0).distinct() for df, c in ((left, "t"), (right, "w")))
    n = texts.count()
    blocks = Blocks(words)

    def look(texts: pd.DataFrame, words: pd.DataFrame) -> pd.DataFrame:
        asked, names = texts["t"].to_numpy(), words["w"].to_numpy()
        bound = bounds(words["w"].tolist())
        met = [np.flatnonzero(bound(t) >= least - NEAR) for t in asked]
        return pd.DataFrame({"t": np.repeat(asked, [len(x) for x in met]), "w": names[np.concatenate(met)]})

    if not n or not blocks.n:
        return texts.crossJoin(words).limit(0)
    return blocks.compared(blocks.reached(texts, least), n, look, "t string, w string")


def nearest(left: DataFrame, right: DataFrame, least: float, k: int, inside: bool = False) -> DataFrame:
    """(t, w, ratio, r): for each text of left (t) the k words of right (w) with the largest ratio, of that or more, ties
    to the first in order; r is the rank.  inside: words that contain the text, cases aside, count below it too.

    First each block's k words with the largest bounds get their ratio.  That settles a text in every block where no other
    bound reaches its k-th best ratio; in the rest the words are tried by their bounds, down to that ratio.
    """
    lower = F.lower if inside else (lambda c: F.lit(None).cast("string"))
    texts = left.select("t").where("t IS NOT NULL").distinct().withColumn("low", lower("t"))
    words = right.select("w").where("w IS NOT NULL").distinct().withColumn("low", lower("w"))
    n = texts.count()
    blocks = Blocks(words)
    schema = "t string, w string, ratio double, block long"
    if not n or not blocks.n:
        return texts.crossJoin(words.select("w")).select("t", "w", F.lit(0.0).alias("ratio"), F.lit(0).alias("r")).limit(0)

    def look(first: bool) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
        def of(texts: pd.DataFrame, words: pd.DataFrame) -> pd.DataFrame:
            names, out, block = words["w"].tolist(), [], int(words["block"].iloc[0])
            bound_of, held_in = bounds(names), holders(words["low"].tolist()) if inside else None
            for x in texts.itertuples():
                bound = bound_of(x.t)
                held = held_in(x.low) if inside else np.zeros(len(names), bool)
                at = np.flatnonzero((bound >= least - NEAR) | held)
                if first and len(at) > k:
                    parted = np.argpartition(-bound[at], k - 1)
                    out.append((x.t, None, float(bound[at[parted[k:]]].max()), block))
                    at = at[parted[:k]]
                floor = -1.0 if first or np.isnan(x.floor) else x.floor
                at = at[bound[at] >= floor - NEAR]
                best: list[tuple[float, str]] = []
                for i in at[np.argsort(-bound[at], kind="stable")]:
                    if len(best) == k and bound[i] < -best[-1][0] - NEAR:
                        break
                    ratio = SequenceMatcher(None, x.t, names[i]).ratio()
                    if ratio >= least or held[i]:
                        insort(best, (-ratio, names[i]))
                        del best[k:]
                out += [(x.t, w, -r, block) for r, w in best]
            return pd.DataFrame(out, columns=["t", "w", "ratio", "block"])

        return of

    context = texts.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_dir(texts.sparkSession))
    tried = blocks.compared(blocks.reached(texts, None if inside else least), n, look(True), schema).checkpoint()  # read three times
    order = Window.partitionBy("t").orderBy(F.col("ratio").desc(), "w")
    found = tried.where("w IS NOT NULL")
    floors = found.withColumn("r", F.row_number().over(order)).where(F.col("r") == k).select("t", F.col("ratio").alias("floor"))
    left_over = tried.where("w IS NULL").join(floors, "t", "left").where(F.col("floor").isNull() | (F.col("ratio") >= F.col("floor") - NEAR))
    left_over = left_over.select("t", "block", "floor").withColumn("low", lower("t"))
    if more := left_over.select("t").distinct().count():
        found = found.unionByName(blocks.compared(left_over, more, look(False), schema))
    found = found.select("t", "w", "ratio").distinct()
    return found.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k)
