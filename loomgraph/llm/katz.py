"""N-gram language model with Katz backoff.

Counts above 5 are taken as they are, lower ones are discounted by Good-Turing (Katz 1987), by order.  With d the
discounts, c counts, h a history of up to order - 1 words, h' the same without its first word, and N the tokens of
training documents,

    P(w | h) = d c(h, w) / c(h)   if c(h, w) > 0,   else   alpha(h) P(w | h'),
    P(w)     = d c(w) / N         if c(w) > 0,      else   the mass that the unigram discounts leave,

and alpha(h) = (1 - sum of d c(h, w) / c(h)) / (1 - sum of P(w | h')), both sums over the words seen after h, so the
probabilities after every h sum to one.  After a history that was never seen, P(w | h) = P(w | h').  All words that
were not trained are one unknown word.  Each text ends with an end token; end tokens also stand before its first word.

Scale: a text never travels.  Each task cuts its documents into blocks of a few million tokens and keeps them as
arrays of block-local word numbers.  What is shuffled is packed arrays of a block's distinct words and distinct
n-grams, dealt by hash into buckets that hold the counts of the whole corpus (the partitioned tables of the model),
and answers back to the blocks that asked.  Each order is a round of its own, as its sums need P of the order below.
A history that is in one block only is never sent.
Each word or n-gram is one entry per block however frequent; a history with more than 1/10,000 of all tokens is
dealt by its successors instead, and only the sums of those (at most 10,000 and one) histories of an order are broadcast.
Numbers of words are unique; words, and histories of more than one word, are told apart by 64-bit hashes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

TOP = 5  # the highest count that is discounted
BLOCK_TOKENS = 1_500_000
HOT = 10_000
END = np.uint64(0x1D8E4E27C47D124F)
ROW = "kind int, block long, bucket int, a binary, b binary, c binary, d binary, stats array<long>, e binary"
DOCS, WORDS, NUMBERS, STATS, PAIRS, HOT_PAIRS, TOTALS, HOT_SUMS = range(8)
_NAMES = ["kind", "block", "bucket", "a", "b", "c", "d", "stats", "e"]
_TYPES = [pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 4, pa.list_(pa.int64()), pa.binary()]


def squeeze(x: np.ndarray, steps: bool = False) -> bytes:
    """An array, or the steps between its values, by bytes of equal weight, compressed."""
    x = np.ascontiguousarray(np.diff(x, prepend=x.dtype.type(0)) if steps else x)
    planes = x.view(np.uint8).reshape(-1, x.itemsize).T if len(x) else np.zeros(0, np.uint8)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def expand(x: bytes, kind, steps: bool = False) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(x), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    out = np.ascontiguousarray(planes.T).view(kind).ravel()
    return np.cumsum(out, dtype=kind) if steps else out


def stats_row(*stats: int) -> tuple:
    return (STATS, -1, -1, None, None, None, None, list(map(int, stats)))


def rows_of(rows: list[tuple]) -> list[pa.Array]:
    return [pa.array([r[i] if i < len(r) else None for r in rows], t) for i, t in enumerate(_TYPES)]


@dataclass
class Discounts:
    by_count: np.ndarray  # index: the count, 0 to TOP; 1 above

    @classmethod
    def fitted(cls, n: np.ndarray) -> Discounts:
        """Good-Turing, from n[r] items seen r times, r from 0 to TOP + 1; absolute where that has no solution."""
        d = np.ones(TOP + 1)
        if n[1] > 0:
            r = np.arange(1, TOP + 1)
            tail = (TOP + 1) * n[TOP + 1] / n[1]
            with np.errstate(divide="ignore", invalid="ignore"):
                d[1:] = ((r + 1) * n[2 : TOP + 2] / (r * n[1 : TOP + 1]) - tail) / (1 - tail)
            if not (np.isfinite(d).all() and (d[1:] > 0).all() and (d[1:] <= 1).all()):
                d[1:] = (r - n[1] / (n[1] + 2 * n[2] + 1)) / r
        return cls(d)

    def of(self, c: np.ndarray) -> np.ndarray:
        return np.where(c <= TOP, self.by_count[np.minimum(c, TOP).astype(np.int64)], 1.0)


@dataclass
class Unigrams:
    tokens: int
    types: int
    discounts: Discounts
    unknown: float
    scale: float

    @classmethod
    def fitted(cls, stats: np.ndarray) -> Unigrams:
        """stats: types, tokens, then the numbers of words seen 1 to TOP + 1 times."""
        n = np.r_[0, stats[2 : TOP + 3]].astype(float)
        d, tokens = Discounts.fitted(n), int(stats[1])
        r = np.arange(TOP + 1)
        left = float(((1 - d.by_count) * r * n[: TOP + 1]).sum()) / max(tokens, 1)
        scale = 1.0
        if left <= 0:  # nothing was discounted: as if one unknown token had been seen
            left, scale = 1 / (tokens + 1), tokens / (tokens + 1)
        return cls(tokens, int(stats[0]), d, left, scale)

    def p(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, self.scale * self.discounts.of(c) * c / max(self.tokens, 1), self.unknown)

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.1) / (self.tokens + 0.1 * (self.types + 1)))


def seen_times(c: np.ndarray) -> list[int]:
    return [int((c == r).sum()) for r in range(1, TOP + 2)]


def cut(docs: DataFrame, buckets: int) -> DataFrame:
    """docs (doc_id, text, trains) as blocks: a DOCS row each, and WORDS rows of its distinct words by bucket."""

    def blocks(batches):
        from pyspark import TaskContext

        part, made = TaskContext.get().partitionId(), 0
        held: list[tuple] = []
        size = 0

        def block() -> pa.RecordBatch:
            nonlocal made
            number, made = part * (1 << 24) + made, made + 1
            ids, flags, counts, h = (np.concatenate([x[i] for x in held]) for i in range(4))
            vocabulary, word, times = np.unique(h, return_inverse=True, return_counts=True)
            order = np.argsort(-times, kind="stable")  # frequent words get small numbers
            place = np.empty_like(order)
            place[order] = np.arange(len(order))
            word, vocabulary = place[word].astype(np.uint32), vocabulary[order]
            trains = np.repeat(flags & 1, counts).astype(bool)
            trained = np.bincount(word[trains], minlength=len(order)).astype(np.uint32)
            bucket = (vocabulary % np.uint64(buckets)).astype(np.int64)
            by, out = np.argsort(bucket, kind="stable"), [(DOCS, number, -1, squeeze(ids), squeeze(flags), squeeze(counts.astype(np.int64)), squeeze(word))]
            for b, own in zip(*grouped(bucket[by], by)):
                out.append((WORDS, number, int(b), squeeze(vocabulary[own]), squeeze(trained[own]), squeeze(own.astype(np.uint32), True)))
            return pa.record_batch(rows_of(out), names=_NAMES)

        for batch in batches:
            data, offsets = common.utf8(batch.column(1))
            ids = batch.column(0)
            for lo, hi in common.slices(offsets):
                h, row = common.hashed_words(data, offsets[lo : hi + 1])
                counts = np.bincount(row, minlength=hi - lo)
                tokens = np.insert(h, np.cumsum(counts), END)
                own = ids.slice(lo, hi - lo)
                flags = np.array(batch.column(2).slice(lo, hi - lo).to_numpy(zero_copy_only=False), np.uint8) | (np.array(own.is_null().to_numpy(zero_copy_only=False), np.uint8) << 1)
                held.append((own.fill_null(0).to_numpy(), flags, counts + 1, tokens))
                size += len(tokens)
                if size >= BLOCK_TOKENS:
                    yield block()
                    held, size = [], 0
        if held:
            yield block()

    return docs.mapInArrow(blocks, ROW)


def grouped(keys: np.ndarray, values: np.ndarray):
    """(distinct keys, their values) of sorted keys."""
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.split(values, first[1:]) if len(keys) else []


def number_words(group: pa.Table, buckets: int) -> pa.Table:
    """Counts of a bucket's words over all blocks, answered to each block; frequent words get small numbers."""
    rows = group.to_pylist()
    parts = [expand(r["a"], np.uint64) for r in rows]
    words, of = np.unique(np.concatenate(parts), return_inverse=True)
    c = np.zeros(len(words), np.int64)
    np.add.at(c, of, np.concatenate([expand(r["b"], np.uint32) for r in rows]))
    alone = np.bincount(of, minlength=len(c)) == 1
    rank = np.empty(len(c), np.int64)
    rank[np.argsort(-c, kind="stable")] = np.arange(len(c))
    number = rank * buckets + rows[0]["bucket"]
    out, at = [stats_row((c > 0).sum(), c.sum(), *seen_times(c))], 0
    for r, part in zip(rows, parts):
        own = of[at : at + len(part)]
        out.append((NUMBERS, r["block"], r["bucket"], r["c"], squeeze(number[own]), squeeze(c[own]), squeeze(alone[own])))
        at += len(part)
    return pa.table(rows_of(out), names=_NAMES)


class Block:
    """The tokens of a block with what the corpus knows of its words."""

    def __init__(self, rows: list[dict], unigrams: Unigrams, buckets: int):
        docs = next(r for r in rows if r["kind"] == DOCS)
        self.ids, self.flags, self.counts, word = expand(docs["a"], np.int64), expand(docs["b"], np.uint8), expand(docs["c"], np.int64), expand(docs["d"], np.uint32)
        n = int(word.max()) + 1
        number, self.c, alone = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, bool)
        for r in rows:
            if r["kind"] == NUMBERS:
                own = expand(r["a"], np.uint32, True)
                number[own], self.c[own], alone[own] = expand(r["b"], np.int64), expand(r["c"], np.int64), expand(r["d"], bool)
        self.unigrams, self.buckets = unigrams, buckets
        self.word, self.row, self.number = word, np.repeat(np.arange(len(self.counts)), self.counts), number
        self.end = word[-1]  # the last token of each text is the end token
        self.trains = (self.flags[self.row] & 1).astype(bool)
        self.own = alone | (self.c == 0)  # no other block has, or nobody trained, these words: nothing to ask
        self.frequent = max(unigrams.tokens // HOT, 1000)
        self.p = unigrams.p(self.c)

    def bigrams(self) -> Grams:
        before = np.empty_like(self.word)
        before[1:], before[0] = self.word[:-1], self.end
        out = Grams(self, 2, before, self.number, self.own, self.c > self.frequent, self.number[self.end])
        out.lower = self.p[out.w]
        return out

    def evaluated(self, rows: list[dict], learned: list[Learned]) -> Grams | None:
        """The n-grams of the highest order learned, each order evaluated on the one below; None without any."""
        grams = None
        for known in learned:
            grams = grams.longer(self) if grams else self.bigrams()
            grams.evaluate(self, [r for r in rows if r["kind"] == TOTALS and r["stats"][0] == grams.order], known)
        return grams


@dataclass
class Learned:
    """What all blocks must know of an order: its discounts, and the sums of its very frequent histories."""

    discounts: Discounts
    histories: np.ndarray
    sums: np.ndarray


class Grams:
    """The distinct n-grams of one order in a block.

    h, w: history and last word of each, local; of: the n-gram at each place of the text; local: its count in the
    block's training texts; lower: P of its last word after the history without its first word.  Per history, key:
    its number in the corpus; own: no other block has it, or nobody trained it; hot: it is very frequent.
    """

    def __init__(self, block: Block, order: int, before: np.ndarray, key: np.ndarray, own: np.ndarray, hot: np.ndarray, start: np.int64):
        keys, self.of = np.unique(before.astype(np.uint64) << np.uint64(32) | block.word, return_inverse=True)
        self.h, self.w = (keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
        self.local = np.bincount(self.of[block.trains], minlength=len(keys)).astype(np.int64)
        self.order, self.key, self.own, self.hot, self.start = order, key, own, hot, start
        self.lower = self.total = self.alone = self.chance = np.zeros(0)
        sent = np.flatnonzero(~own[self.h])
        very = hot[self.h[sent]]
        bucket = (key[self.h[sent]] + np.where(very, block.number[self.w[sent]] * 7 + 1, 0)) % block.buckets
        order_ = np.argsort(bucket * 2 + very, kind="stable")
        keys_, groups = grouped((bucket * 2 + very)[order_], sent[order_])
        self.sent = {(int(k) >> 1, HOT_PAIRS if k & 1 else PAIRS): v for k, v in zip(keys_, groups)}

    def asks(self, block: Block, number: int) -> list[tuple]:
        out = []
        for (bucket, kind), own in self.sent.items():
            words, at = np.unique(self.w[own], return_inverse=True)
            lower = squeeze(block.c[words]) if self.order == 2 else squeeze(self.lower[own])  # P of a word follows from its count
            out.append((kind, number, bucket, squeeze(self.key[self.h[own]], True), squeeze(self.local[own].astype(np.uint32)), squeeze(block.number[words], True), lower, None, squeeze(at.astype(np.uint32))))
        private = self.local[self.own[self.h]]
        return [*out, stats_row(0, 0, *seen_times(private))]

    def evaluate(self, block: Block, rows: list[dict], known: Learned) -> None:
        """Sets total, alone and chance (P of the last word after the history) from the answers to asks()."""
        total, alone = self.local.copy(), np.zeros(len(self.local), bool)
        private = self.own[self.h]
        table = sums(self.h[private], self.local[private], self.lower[private], len(self.key))
        for r in rows:
            own = self.sent[r["bucket"] >> 1, HOT_PAIRS if r["bucket"] & 1 else PAIRS]
            total[own] = expand(r["a"], np.uint32)
            if r["b"] is not None:
                heads = self.h[own][np.r_[True, self.h[own][1:] != self.h[own][:-1]]]
                table[heads, : TOP + 1] = expand(r["b"], np.int64).reshape(TOP + 1, -1).T
                table[heads, TOP + 1] = expand(r["c"], np.float64)
            if r["d"] is not None:
                alone[own] = expand(r["d"], bool)
        mine = np.flatnonzero(self.hot & ~self.own)
        if len(mine) and len(known.histories):
            at = np.minimum(np.searchsorted(known.histories, self.key[mine]), len(known.histories) - 1)
            found = known.histories[at] == self.key[mine]
            table[mine[found]] = known.sums[at[found]]
        by_count = known.discounts.by_count[1:] * np.arange(1, TOP + 1)
        c = table[:, :TOP] @ np.arange(1.0, TOP + 1) + table[:, TOP]
        kept = table[:, :TOP] @ by_count + table[:, TOP]
        bare = (c > 0) & (c - kept <= 1e-9 * c)  # nothing was discounted: as if one more token had followed
        size = np.where(bare, c + 1, np.maximum(c, 1))
        alpha = np.where(c > 0, (1 - kept / size) / np.maximum(1 - table[:, TOP + 1], 1e-12), 1.0)
        self.total, self.alone = total, alone
        self.chance = np.where(total > 0, known.discounts.of(total) * total / size[self.h], alpha[self.h] * self.lower)

    def longer(self, block: Block) -> Grams:
        """The n-grams of the next order: their histories are these, and, at a text's start, end tokens alone."""
        n, first = len(self.h), np.r_[True, block.row[1:] != block.row[:-1]]
        before = np.where(first, n, np.r_[0, self.of[:-1]])
        key = chained(np.r_[self.key[self.h], self.start], np.r_[block.number[self.w], block.number[block.end]])
        own = np.r_[self.own[self.h] | block.own[self.w] | self.alone | (self.total == 0), block.own[block.end]]
        hot = np.r_[self.total, block.c[block.end]] > block.frequent
        out = Grams(block, self.order + 1, before, key, own, hot, key[-1])
        out.lower = np.empty(len(out.h))
        out.lower[out.of] = self.chance[self.of]
        return out


def chained(history: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Numbers of histories one word longer: 64-bit hashes."""
    return common.mix(common.mix(history.view(np.uint64)) + word.view(np.uint64)).view(np.int64)


def sums(h: np.ndarray, c: np.ndarray, p: np.ndarray, n: int) -> np.ndarray:
    """(n, TOP + 2): per history the successors seen 1 to TOP times, the tokens of those seen more, and the sum of P(w)."""
    seen = c > 0
    h, c, p = h[seen], c[seen], p[seen]
    return np.stack([*(np.bincount(h[c == r], minlength=n) for r in range(1, TOP + 1)), np.bincount(h, np.where(c > TOP, c, 0), n), np.bincount(h, p, n)], 1).astype(float)


def total_grams(group: pa.Table, unigrams: Unigrams, order: int, highest: bool) -> pa.Table:
    """Counts of a bucket's n-grams over all blocks and the sums of its histories, answered to each block; below the
    highest order also which n-grams no other block has."""
    rows = group.to_pylist()
    heads_of = [expand(r["a"], np.int64, True) for r in rows]
    at_of = [expand(r["e"], np.uint32) for r in rows]
    h, c = np.concatenate(heads_of), np.concatenate([expand(r["b"], np.uint32) for r in rows])
    w = np.concatenate([expand(r["c"], np.int64, True)[at] for r, at in zip(rows, at_of)])
    if order == 2:
        lower = unigrams.p(np.concatenate([expand(r["d"], np.int64)[at] for r, at in zip(rows, at_of)]))
    else:
        lower = np.concatenate([expand(r["d"], np.float64) for r in rows])
    histories, hi = np.unique(h, return_inverse=True)
    _, wi = np.unique(w, return_inverse=True)
    keys, first, of = np.unique(hi.astype(np.uint64) << np.uint64(32) | wi.astype(np.uint64), return_index=True, return_inverse=True)
    total = np.bincount(of, c, len(keys)).astype(np.int64)
    table = sums(hi[first], total, lower[first], len(histories))
    alone = None if highest else np.bincount(of, minlength=len(keys)) == 1
    hot = np.zeros(len(histories), bool)
    out, at = [stats_row(0, 0, *seen_times(total))], 0
    for r, n in zip(rows, map(len, heads_of)):
        own, mine = of[at : at + n], hi[at : at + n]
        only = None if alone is None else squeeze(alone[own])
        if r["kind"] == HOT_PAIRS:
            hot[mine] = True
            out.append((TOTALS, r["block"], r["bucket"] * 2 + 1, squeeze(total[own].astype(np.uint32)), None, None, only, [order]))
        else:
            heads = mine[np.r_[True, mine[1:] != mine[:-1]]]
            out.append((TOTALS, r["block"], r["bucket"] * 2, squeeze(total[own].astype(np.uint32)), squeeze(table[heads, : TOP + 1].T.astype(np.int64).ravel()), squeeze(table[heads, TOP + 1]), only, [order]))
        at += n
    if hot.any():
        out.append((HOT_SUMS, -1, -1, squeeze(histories[hot]), squeeze(table[hot].ravel())))
    return pa.table(rows_of(out), names=_NAMES)


def block_scores(rows: list[dict], unigrams: Unigrams, learned: list[Learned], buckets: int) -> dict[str, np.ndarray]:
    b = Block(rows, unigrams, buckets)
    grams = b.evaluated(rows, learned)
    place, chance = (grams.of, grams.chance) if grams else (b.word, b.p)
    add = lambda values: np.bincount(b.row, values, len(b.counts))
    return {"ids": b.ids, "flags": b.flags, "n_tokens": b.counts, "n_known": add(b.c[b.word] > 0).astype(np.int64), "base_score": add(unigrams.base(b.c)[b.word]), "score": add(np.log10(chance)[place])}


def answers_of(known: DataFrame, order: int, highest: bool, unigrams: Unigrams, learned: list[Learned], buckets: int) -> DataFrame:
    """One round of the protocol: each block asks for its n-grams of an order, the buckets that hold them answer."""

    def ask(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        b = Block(rows, unigrams, buckets)
        below = b.evaluated(rows, learned)
        grams = below.longer(b) if below else b.bigrams()
        return pa.table(rows_of(grams.asks(b, rows[0]["block"])), names=_NAMES)

    def answer(group: pa.Table) -> pa.Table:
        group = group.drop_columns(["deal"])
        if group.column("kind")[0].as_py() == STATS:
            return group
        return total_grams(group, unigrams, order, highest)

    asked = known.groupBy("block").applyInArrow(ask, ROW)
    dealt = asked.withColumn("deal", F.when(F.col("kind") == STATS, F.col("block")).otherwise(F.col("bucket").cast("long")))
    return common.settled(dealt.groupBy("deal").applyInArrow(answer, ROW))


def frequent_sums(answers: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(histories, their sums) of the very frequent ones, added up over the buckets before anything is collected: at
    most HOT rows, as each has more than 1/HOT of all tokens."""
    sums_ = [f"s{i}" for i in range(TOP + 2)]

    def opened(batches):
        for batch in batches:
            for a, b in zip(batch.column(0), batch.column(1)):
                table = expand(b.as_py(), np.float64).reshape(-1, TOP + 2)
                yield pa.record_batch([pa.array(expand(a.as_py(), np.int64)), *(pa.array(np.ascontiguousarray(table[:, i])) for i in range(TOP + 2))], names=["h", *sums_])

    rows = answers.where(F.col("kind") == HOT_SUMS).select("a", "b").mapInArrow(opened, ", ".join(["h long", *(f"{c} double" for c in sums_)]))
    found = rows.groupBy("h").agg(*[F.sum(c).alias(c) for c in sums_]).orderBy("h").toPandas()
    return found["h"].to_numpy(np.int64), found[sums_].to_numpy(np.float64).reshape(-1, TOP + 2)


def total_stats(rows: DataFrame) -> np.ndarray:
    got = rows.where(F.col("kind") == STATS).agg(*[F.sum(F.element_at("stats", i + 1)) for i in range(TOP + 3)]).first()
    return np.array([x or 0 for x in got], np.int64)


def score(docs: DataFrame, trains: Column, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None, order: int = 2) -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, n_known, train_tokens, base_score, score, by a model of that order.

    Learns from the rows that `trains` holds for (null: not).  Null and empty texts are an end token alone.  Rows
    without a doc_id are scored too.  With nothing to learn from, every token is the unknown word, of probability
    one.  No documents: no rows.  Other columns are not read.
    """
    if order < 1:
        raise ValueError("order must be 1 or more")
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(trains, F.lit(False)).alias("trains"))
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = buckets or max(12, int(size) >> 24)
    cutted = common.settled(cut(own, buckets))
    words = common.settled(cutted.where(F.col("kind") == WORDS).groupBy("bucket").applyInArrow(lambda g: number_words(g, buckets), ROW))
    unigrams = Unigrams.fitted(total_stats(words))
    known = cutted.where(F.col("kind") == DOCS).unionByName(words.where(F.col("kind") == NUMBERS))
    learned: list[Learned] = []
    for n in range(2, order + 1):
        answers = answers_of(known, n, n == order, unigrams, learned, buckets)
        discounts = Discounts.fitted(np.r_[0, total_stats(answers)[2 : TOP + 3]].astype(float))
        learned = [*learned, Learned(discounts, *frequent_sums(answers))]
        known = known.unionByName(answers.where(F.col("kind") == TOTALS))

    def finish(group: pa.Table) -> pa.Table:
        s = block_scores(group.to_pylist(), unigrams, learned, buckets)
        return pa.table({"doc_id": pa.array(s["ids"], pa.int64(), mask=(s["flags"] & 2).astype(bool)), "n_tokens": s["n_tokens"], "n_known": s["n_known"], "train_tokens": pa.array(np.full(len(s["ids"]), unigrams.tokens), pa.int64()), "base_score": s["base_score"], "score": s["score"]})

    return known.groupBy("block").applyInArrow(finish, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op6_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string")) % 10 == 0
    out = score(common.table(spark, sf_dir, "documents"), ~held_out)
    return out.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
