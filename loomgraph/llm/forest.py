"""Approximate nearest neighbours by a hash-prefix forest.

Each tree gives a vector a long hash string: bit j says on which side of the tree's j-th random plane the vector lies
(Charikar 2002), 32 bits in all.  A tree is the sorted array of its strings.  A query descends each tree by binary
search to the longest prefix that its string shares with any row's, which differs from tree to tree.  Then all trees
ascend in step, one bit at a time, and what shares the prefix at that depth in any tree is a candidate (LSH forest,
Bawa et al. 2005).  Candidates are scored by inner product in double precision as they turn up.

A query stops by itself: the angle to its k-th best row so far says how likely a row at that angle shares a prefix of
the present depth in at least one tree, 1 - (1 - (1 - angle / pi)^depth)^trees, and the ascent ends when that is
`sure` or more.  So a query in a dense cluster ends deep, after few candidates, and one whose neighbours are hardly
nearer than the rest goes on to short prefixes.  The query's own row counts for nothing, and no row counts twice.

For inner products the vectors get one more component that makes all lengths equal (Neyshabur and Srebro 2015), and
the queries a zero there.

Scale: rows are dealt at random into blocks of `block_rows`, each with a forest of its own, so a block's memory is
bounded whatever the data; a query descends in each block's forest and brings back its best k of each.  Rows that
are equal are one entry with its k + 1 smallest ids, so that copies cost nothing.  Queries visit the blocks in
batches of `query_rows`; there is no join of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

BITS = 32
TREES_AT_ONCE = 16


class Forest:
    """Sorted arrays of the hash strings of the rows of x, one per tree; times: how many rows each row of x stands for."""

    def __init__(self, x: np.ndarray, times: np.ndarray, trees: int, seed: int, longest: float):
        self.x, self.times, self.longest = x, times, longest
        self.planes = np.random.default_rng(seed).standard_normal((x.shape[1] + 1, trees * BITS)).astype(np.float32)
        rest = np.sqrt(np.maximum(longest**2 - (x**2).sum(1), 0))
        strings = self.strings(np.column_stack([x, rest]).astype(np.float32))
        orders = [np.argsort(s, kind="stable") for s in strings]
        self.sorted = [s[order] for s, order in zip(strings, orders)]
        self.order = np.concatenate(orders)  # one tree behind the other

    def strings(self, v: np.ndarray) -> np.ndarray:
        """(trees, rows) of uint32: the strings of the rows of v, first bit highest."""
        out = []
        for at in range(0, self.planes.shape[1], TREES_AT_ONCE * BITS):
            sides = v @ self.planes[:, at : at + TREES_AT_ONCE * BITS] > 0
            packed = np.packbits(sides.reshape(len(v), -1, BITS), axis=2)
            out.append(np.ascontiguousarray(packed).view(">u4")[:, :, 0].T.astype(np.uint32))
        return np.concatenate(out)

    def descend(self, own: np.ndarray) -> np.ndarray:
        """(trees, queries): the length of the longest prefix that each string shares with one of its tree."""
        out = np.zeros(own.shape, np.int64)
        for t, s in enumerate(self.sorted):
            at = np.searchsorted(s, own[t])
            for near in (np.maximum(at - 1, 0), np.minimum(at, len(s) - 1)):
                apart = (own[t] ^ s[near]).astype(np.float64)
                out[t] = np.maximum(out[t], BITS - np.frexp(apart)[1])
        return out

    def spans(self, own: np.ndarray, longest: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """(trees, queries): the first place in each tree of the strings that share `depth` bits, and how many do."""
        first, count = np.zeros(own.shape, np.int64), np.zeros(own.shape, np.int64)
        low = np.uint32(BITS - depth)
        for t, s in enumerate(self.sorted):
            some = np.flatnonzero(longest[t] >= depth)
            key = own[t][some] >> low << low
            at = np.searchsorted(s, key)
            first[t, some] = at + t * len(s)
            count[t, some] = np.searchsorted(s, key | (np.uint32(1) << low) - np.uint32(1), "right") - at
        return first, count

    def search(self, q: np.ndarray, skips: np.ndarray, k: int, sure: float) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
        """(query, the best of the rows that turned up, their scores, depth it ended at) for each row of q, in any
        order: those are the rows of x that hold the k best, or all where there are fewer.  skips: the row of x that is
        the query's own in part, or -1."""
        length = np.linalg.norm(q, axis=1)
        own = self.strings(np.column_stack([q / np.where(length > 0, length, 1)[:, None], np.zeros(len(q))]).astype(np.float32))
        longest = self.descend(own)
        trees, n = len(self.sorted), len(self.x)
        self.scored = np.zeros(len(q), np.int64)
        seen = np.zeros((len(q), n), bool)
        mark = np.zeros(n, bool)
        top = [np.zeros(0, np.int64)] * len(q)
        scores = [np.zeros(0)] * len(q)
        active = np.arange(len(q))
        for depth in range(int(longest.max(initial=0)), 0, -1):
            first, count = self.spans(own[:, active], longest[:, active], depth)
            # The least cosine of a row that has been seen at this depth with the chance asked for.
            enough = np.cos(np.pi * (1 - (1 - (1 - sure) ** (1 / trees)) ** (1 / depth)))
            sightings, ended = count.sum(0), np.zeros(len(active), bool)
            # Looked at once there is a match a tree, and more of them than rows are known.
            for j in np.flatnonzero(sightings > np.maximum(self.scored[active], trees - 1)):
                i, runs = active[j], count[:, j]
                places = np.repeat(first[:, j] - np.cumsum(runs) + runs, runs) + np.arange(sightings[j])
                rows = self.order[places]
                mark[rows[~seen[i, rows]]] = True
                new = np.flatnonzero(mark)
                mark[new] = False
                seen[i, new] = True
                self.scored[i] += len(new)
                top[i], scores[i] = self.best(np.concatenate([top[i], new]), np.concatenate([scores[i], self.x[new] @ q[i]]), k)
                kth = self.kth(top[i], scores[i], skips[i], k)
                if kth is not None and kth >= enough * length[i] * self.longest:
                    ended[j] = True
                    yield int(i), top[i], scores[i], depth
            active = active[~ended]
            if not len(active):
                return
        for i in active:
            self.scored[i] = n
            yield int(i), *self.best(np.arange(n), self.x @ q[i], k), 0

    @staticmethod
    def best(rows: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k + 1 rows of the largest scores, and those that tie with the last of them."""
        if len(rows) > k + 1:
            some = scores >= np.partition(scores, len(scores) - k - 1)[len(scores) - k - 1]
            rows, scores = rows[some], scores[some]
        return rows, scores

    def kth(self, rows: np.ndarray, scores: np.ndarray, skip: int, k: int) -> float | None:
        """The score of the k-th best row, but for the query's own; None where there are fewer."""
        order = np.argsort(-scores, kind="stable")
        upto = np.cumsum(self.times[rows[order]] - (rows[order] == skip))
        at = int(np.searchsorted(upto, k))
        return float(scores[order[at]]) if at < len(order) else None


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k largest scores, ties to the smaller id."""
    if len(ids) > 4 * k:
        floor = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= floor)
        return some[np.lexsort((ids[some], -scores[some]))[:k]]
    return np.lexsort((ids, -scores))[:k]


def usable(vector: Column) -> Column:
    """Not null, not empty, not all zero, and no component null, NaN or infinite."""
    fine = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    return vector.isNotNull() & fine & F.exists(vector, lambda c: c != 0)


def nearest(rows: DataFrame, asked: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", trees: int = 128, sure: float = 0.9, block_rows: int = 8192, query_rows: int = 4096, seed: int = 7) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that `asked` holds for, its k nearest other rows by inner
    product, largest first, ties to the smaller id; fewer where there are fewer.

    Vectors that are null, empty or zero, or hold null, NaN or infinity, take no part, and neither do rows
    without an id; vectors are compared within their dimension.  Rows that share an id are candidates each, but
    none is found for a query of its own id.  No vectors: no rows.
    """
    vectors = rows.where(usable(F.col(vector_col)) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(asked, F.lit(False)).alias("asks"))
    vectors = vectors.withColumn("dim", F.size("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, c: a + c * c))
    sizes = vectors.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.count_if("asks").alias("asking"), F.max(norm).alias("longest"))
    sized = vectors.join(F.broadcast(sizes), "dim")  # one row for each dimension there is
    blocks, batches = (F.ceil(F.col(a) / b).cast("int") for a, b in (("n", block_rows), ("asking", query_rows)))
    deal = lambda n: F.pmod(F.xxhash64("id", F.lit(seed)), F.greatest(n, F.lit(1))).cast("int")
    places = lambda n: F.explode(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1))
    held = sized.where("asking > 0").withColumn("block", deal(blocks)).withColumn("batch", places(batches)).withColumn("asks", F.lit(False))
    asks = sized.where("asks").withColumn("batch", deal(batches)).withColumn("block", places(blocks))
    both = held.unionByName(asks).select("dim", "block", "batch", "id", "v", "asks", "longest")

    def search(group: pd.DataFrame) -> pd.DataFrame:
        x, asking = group[~group.asks].sort_values("id"), group[group.asks]
        none = pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})
        if not len(x) or not len(asking):
            return none
        all_v = np.stack(x.v.to_numpy()) + 0.0
        _, first, entry = np.unique(all_v.view(np.dtype((np.void, all_v.dtype.itemsize * all_v.shape[1]))).ravel(), return_index=True, return_inverse=True)
        v, ids = all_v[first], x.id.to_numpy()
        # The k + 1 smallest ids of each entry; x is in the order of id.
        order = np.argsort(entry, kind="stable")
        number = np.arange(len(order)) - np.searchsorted(entry[order], np.arange(len(first)))[entry[order]]
        order = order[number <= k]
        start = np.searchsorted(entry[order], np.arange(len(first) + 1))
        forest = Forest(v, np.diff(start), trees, seed, float(group.longest.iloc[0]))
        q, qid, out = np.stack(asking.v.to_numpy()) + 0.0, asking.id.to_numpy(), []
        own = np.searchsorted(ids, qid)  # the query's own row, if it is in this block
        own = np.where(ids[np.minimum(own, len(ids) - 1)] == qid, entry[np.minimum(own, len(ids) - 1)], -1)
        for i, found, scores, _ in forest.search(q, own, k, sure):
            at = np.concatenate([order[start[e] : start[e + 1]] for e in found]) if len(found) else np.zeros(0, np.int64)
            scores = np.repeat(scores, start[found + 1] - start[found])
            other = ids[at] != qid[i]
            at, scores = at[other], scores[other]
            chosen = best(ids[at], scores, k)
            out.append(pd.DataFrame({"query_id": qid[i], "vec_id": ids[at[chosen]], "score": scores[chosen]}))
        return pd.concat(out) if out else none

    found = both.groupBy("dim", "block", "batch").applyInPandas(search, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(common.table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
