"""Near-duplicate documents by HyperMinHash.

A document's set is its distinct runs of five words.  Its sketch has 128 registers, and each stores of the least
hash value in it only the number of leading zeros (6 bits) and the 10 bits after the first one (Yu and Weber 2017).
Large sets deal one hash among the registers, and a register that stays empty takes another's value by a fixed
order per register (optimal densification, Shrivastava 2017).  Sets of up to twice as many members as there are
registers use one hash function per register instead, where none can be empty; sizes near the border carry both.
Registers are banded by four.  Documents of equal bands are candidates; the collision-corrected Jaccard estimate
drops those more than six standard deviations below the threshold, and the rest are confirmed on their full sets.

Scale and skew: texts that have the same set are one class from the start.  No step writes all pairs of a group.
Each class is first compared by its sketch with one centre, of its bands' members that with the most company; those
of a band that are still apart visit the band's other members in blocks, and only estimates that join two groups are written.  The
clusters that come of it hold every likely link.  Within a cluster the full sets are compared by an inverted index
of shingles, in blocks too, and only the links that join two components are written.  In a cluster of more than a
few, what its centre confirms is settled before.  So each candidate is confirmed, refuted, or joins what is
connected already.  Blocks are bounded by members where sketches are compared and by bytes of text where sets are,
and those that ask are dealt into batches of the same bound.  Components come from label propagation on tables;
nothing is collected.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

REGISTERS, ROWS = 128, 4
BANDS = REGISTERS // ROWS
BORDER = 2 * REGISTERS
EMPTY = 0xFFFF
ROW_BYTES = 1 << 16  # what a row weighs beside its text, so that blocks of short texts are bounded too
_RNG = np.random.default_rng(11)
_FUNCTIONS = _RNG.integers(1, 2**63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_DONORS = np.stack([_RNG.permutation(REGISTERS) for _ in range(REGISTERS)])
_BAND_SALT = _RNG.integers(1, 2**63, (2, BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)

SKETCH = "doc_id long, t long, n long, d1 long, d2 long, small binary, large binary, keys array<long>"


def shingles(data: np.ndarray, offsets: np.ndarray, words: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of the distinct word shingles of each row, sorted by row and hash.

    A row of fewer words than a shingle has its whole sequence as the only one; a row of no words has none.
    """
    h, row = common.hashed_words(data, offsets)
    counts = np.bincount(row, minlength=len(offsets) - 1)
    odd = [np.uint64(pow(0xD1342543DE82EF95, k + 1, 2**64)) for k in range(words)]
    n = len(h) - words + 1
    if n > 0:
        mixed = sum(h[k : n + k] * odd[k] for k in range(words))
        whole = row[:n] == row[words - 1 :]
        out, at = common.mix(mixed[whole]), row[:n][whole]
    else:
        out, at = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    short = np.flatnonzero((counts > 0) & (counts < words))
    if len(short):
        first = np.cumsum(counts) - counts
        extra = [np.uint64(0)] * len(short)
        for i, r in enumerate(short):
            seq = h[first[r] : first[r] + counts[r]]
            extra[i] = np.add.reduce(seq * np.array(odd[: len(seq)], np.uint64))
        out, at = np.concatenate([out, common.mix(np.array(extra, np.uint64) + np.uint64(0x5851F42D4C957F2D) * counts[short].astype(np.uint64))]), np.concatenate([at, short])
    order = np.lexsort((out, at))
    out, at = out[order], at[order]
    fresh = np.ones(len(out), bool)
    fresh[1:] = (out[1:] != out[:-1]) | (at[1:] != at[:-1])
    return out[fresh], at[fresh]


def register(least: np.ndarray) -> np.ndarray:
    """16 bits of 53-bit values: the leading zeros, then the 10 bits behind the first one."""
    zeros = (53 - np.frexp(least.astype(np.float64))[1]).astype(np.uint64)
    behind = (least << (zeros + np.uint64(1))) & np.uint64(2**53 - 1)
    return (zeros << np.uint64(10) | behind >> np.uint64(43)).astype(np.uint16)


def by_functions(h: np.ndarray, starts: np.ndarray) -> np.ndarray:
    out = np.empty((len(starts), REGISTERS), np.uint16)
    for k, odd in enumerate(_FUNCTIONS):
        x = h * odd
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        out[:, k] = register(np.minimum.reduceat(x, starts) >> np.uint64(11))
    return out


def by_buckets(h: np.ndarray, row: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """h sorted by row and value: the first of each run of 7 leading bits is the least of its register."""
    cell = np.searchsorted(rows, row) * REGISTERS + (h >> np.uint64(57)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
    out = np.full(len(rows) * REGISTERS, EMPTY, np.uint16)
    out[cell[first]] = register((h[first] << np.uint64(7)) >> np.uint64(11))
    return out.reshape(-1, REGISTERS)


def filled(registers: np.ndarray) -> np.ndarray:
    out = registers.copy()
    r, c = np.nonzero(registers == EMPTY)
    for k in range(REGISTERS):
        if not len(r):
            break
        got = registers[r, _DONORS[c, k]]
        out[r, c] = got
        r, c = r[got == EMPTY], c[got == EMPTY]
    return out


def bands(registers: np.ndarray, kind: int) -> np.ndarray:
    x = registers.reshape(-1, BANDS, ROWS).astype(np.uint64) + np.uint64(1)
    return common.mix((common.mix(x) * _BAND_SALT[kind]).sum(2, dtype=np.uint64)).view(np.int64)


def identified(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, t, text): t tells rows that share a doc_id, or have none, apart by their texts."""
    text = F.col(f"`{text_col}`")
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.xxhash64(text).alias("t"), text.alias("text"))


def sketches(docs: DataFrame, border_low: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: a hash t of its text, size and 128-bit digest of its set, registers and band keys (null
    if it is empty)."""

    def sketched(batches):
        for batch in batches:
            data, offsets = common.utf8(batch.column(2))
            for lo, hi in common.slices(offsets):
                h, row = shingles(data, offsets[lo : hi + 1])
                m = hi - lo
                n = np.bincount(row, minlength=m)
                d1, d2 = np.zeros(m, np.uint64), np.zeros(m, np.uint64)
                some = np.flatnonzero(n)
                starts = (np.cumsum(n) - n)[some]
                keys, small, large = [[] for _ in range(m)], [None] * m, [None] * m
                if len(some):
                    d1[some] = np.add.reduceat(common.mix(h + np.uint64(1)), starts)
                    d2[some] = np.add.reduceat(common.mix(h ^ np.uint64(0xA5A5A5A5A5A5A5A5)), starts)
                    for kind, rows in ((0, np.flatnonzero((n > 0) & (n <= BORDER / border_low))), (1, np.flatnonzero(n > BORDER))):
                        if not len(rows):
                            continue
                        mine = np.isin(row, rows)
                        own, of = h[mine], row[mine]
                        regs = by_functions(own, np.searchsorted(of, rows)) if kind == 0 else by_buckets(own, of, rows)
                        into = large if kind else small
                        for r, reg, key in zip(rows, regs, bands(filled(regs) if kind else regs, kind)):
                            into[r] = reg.tobytes()
                            keys[r] = np.concatenate([keys[r], key]) if len(keys[r]) else key
                lists = pa.ListArray.from_arrays(np.r_[0, np.cumsum([len(k) for k in keys])].astype(np.int32), pa.array(np.concatenate([np.zeros(0, np.int64), *[k for k in keys if len(k)]]).astype(np.int64)))
                yield pa.record_batch([*(batch.column(c).slice(lo, m) for c in (0, 1)), pa.array(n, pa.int64()), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)), pa.array(small, pa.binary()), pa.array(large, pa.binary()), lists], names=["doc_id", "t", "n", "d1", "d2", "small", "large", "keys"])

    return identified(docs, id_col, text_col).mapInArrow(sketched, SKETCH)


def hits(n: np.ndarray, per: int) -> np.ndarray:
    """(53, sets): the chance that the least hash of a set of n members has z leading zeros; per: registers that share a hash."""
    z = np.arange(53)[:, None]
    x = np.asarray(n, float) / per
    return (1 - 2.0 ** -(z + 1)) ** x - (1 - 2.0**-z) ** x


def chance(n: np.ndarray, m: np.ndarray, per: int) -> np.ndarray:
    """The chance that a register of two disjoint sets of n and m members collides."""
    return (hits(n, per) * hits(m, per)).sum(0) / 1024


def corrected(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Jaccard estimates of registers along the last axis, whose chances of a collision are c."""
    used = (a != EMPTY) | (b != EMPTY)
    share = ((a == b) & used).sum(-1) / np.maximum(used.sum(-1), 1)
    return (share - c) / (1 - c)


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray, kind: int) -> np.ndarray:
    """Collision-corrected Jaccard estimates of rows of registers."""
    return corrected(a, b, chance(n, m, REGISTERS if kind else 1))


def confirmed(pairs: DataFrame, texts: DataFrame, percent: int, block_bytes: int) -> DataFrame:
    """The pairs (a, b, weight: b's bytes) whose full sets have 100 * intersection >= percent * union.

    The partners of one a are dealt into blocks of about 64 or block_bytes, each with its own copy of a's text.
    """
    per = F.greatest(F.ceil(F.count(F.lit(1)) / 64), F.ceil(F.sum("weight") / block_bytes))
    sizes = pairs.groupBy("a").agg(per.alias("blocks")).withColumnRenamed("a", "of")
    spread = pairs.join(sizes, pairs["a"] == F.col("of")).select("a", "b", F.pmod(F.xxhash64("b"), F.col("blocks")).alias("block"))
    sides = spread.select("a", "block", F.col("b").alias("cid")).unionByName(spread.select("a", "block", F.col("a").alias("cid")).distinct())
    rows = sides.join(texts, "cid").select("a", "block", "cid", "text")

    def compare(group: pa.Table) -> pa.Table:
        ids = group.column("cid").to_numpy()
        data, offsets = common.utf8(group.column("text"))
        centre = int(group.column("a")[0].as_py())
        sets = [shingles(data, offsets[i : i + 2])[0] for i in range(len(ids))]
        base = sets[int(np.flatnonzero(ids == centre)[0])]
        linked = []
        for i, s in zip(ids, sets):
            both = len(np.intersect1d(base, s, assume_unique=True))
            if i != centre and 100 * both >= percent * (len(base) + len(s) - both):
                linked.append(int(i))
        return pa.table({"a": pa.array([centre] * len(linked), pa.int64()), "b": pa.array(linked, pa.int64())})

    return rows.groupBy("a", "block").applyInArrow(compare, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of the nodes of edges (a, b): label is the least node reachable."""
    both = common.settled(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = common.settled(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).select(F.col("a").alias("node"), "label"))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), F.col("label").alias("near")), "b").groupBy("a").agg(F.min("near").alias("near"))
        hooked = labels.join(near, labels["node"] == near["a"]).select("node", F.least("label", "near").alias("next"), F.col("label").alias("old"))
        above = labels.select(F.col("node").alias("next"), F.col("label").alias("further"))
        moved = common.settled(hooked.join(above, "next").select("node", F.least("next", "further").alias("label"), "old"))
        changed = not moved.where("label <> old").isEmpty()
        labels = moved.select("node", "label")
        if not changed:
            return labels


def estimated(pairs: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose estimate is at least that."""

    @F.pandas_udf("boolean")
    def likely(sa: pd.Series, sb: pd.Series, la: pd.Series, lb: pd.Series, na: pd.Series, nb: pd.Series) -> pd.Series:
        out = np.zeros(len(sa), bool)
        for kind, x, y in ((0, sa, sb), (1, la, lb)):
            both = np.flatnonzero((x.notna() & y.notna()).to_numpy())
            if len(both):
                a, b = (np.frombuffer(b"".join(s.iloc[both]), np.uint16).reshape(-1, REGISTERS) for s in (x, y))
                out[both] |= estimate(a, b, na.to_numpy()[both], nb.to_numpy()[both], kind) >= least
        return pd.Series(out)

    side = lambda x: classes.select(F.col("cid").alias(x), F.col("small").alias(f"s{x}"), F.col("large").alias(f"l{x}"), F.col("n").alias(f"n{x}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").where(likely("sa", "sb", "la", "lb", "na", "nb")).select("a", "b")


def judged(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", block: int = 2000, block_bytes: int = 16 << 20) -> DataFrame:
    """near_duplicates() with t, the hash that tells rows of one doc_id apart by their texts."""
    share = percent / 100
    least = share - 6 * (share * (1 - share) / REGISTERS) ** 0.5
    sk = common.settled(sketches(docs, share, id_col, text_col))
    own = F.min(F.struct("doc_id", "t"))
    classes = sk.where("n > 0").groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("id"), own.alias("row"), F.count(F.lit(1)).alias("copies"), *[F.first(c).alias(c) for c in ("small", "large", "keys")])
    # A class's number is its place in the settled table, so it is unique whatever the ids.
    classes = common.settled(classes.withColumn("cid", F.monotonically_increasing_id()))
    keyed = classes.select("cid", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    members = common.settled(keyed.join(shared, "key").select("key", "cid", "size"))
    company = members.groupBy("cid").agg(F.sum(F.col("size") - 1).alias("company"))
    centres = members.join(company, "cid").groupBy("key").agg(F.max(F.struct("company", (-F.col("cid")).alias("c"))).alias("top")).select("key", (-F.col("top.c")).alias("a"), F.col("top.company").alias("company"))
    central = members.join(centres, "key").where("cid <> a")
    pairs = central.groupBy(F.col("cid").alias("b")).agg((-F.max(F.struct("company", (-F.col("a")).alias("c")))["c"]).alias("a"))
    near = common.settled(estimated(pairs.select("a", "b"), classes, least))
    by_centre = lambda pairs: pairs.select(F.col("b").alias("node"), F.col("a").alias("label"))  # noqa: E731  each has one centre
    apart = split_members(members.withColumn("weight", F.lit(1)), by_centre(near), "key")
    likely = common.settled(near.unionByName(across(apart, classes, least, block)))
    clusters = components(likely).select(F.col("node").alias("cid"), F.col("label").alias("key"))
    texts = texts_of(docs, clusters, classes, id_col, text_col)
    sizes = clusters.groupBy("key").agg(F.count(F.lit(1)).alias("size"))
    clusters = common.settled(clusters.join(sizes, "key").join(texts.select("cid", (F.octet_length("text") + F.lit(ROW_BYTES)).alias("weight")), "cid"))
    central = near.join(clusters.where("size > 4").select(F.col("cid").alias("b"), "weight"), "b")
    sure = common.settled(confirmed(central, texts, percent, block_bytes))
    open_ = split_members(clusters, by_centre(sure), "key")
    labels = components(sure.unionByName(resolved(open_, texts, percent, block_bytes)))
    names = labels.join(classes.select(F.col("cid").alias("node"), "id"), "node")
    names = names.join(names.groupBy("label").agg(F.min("id").alias("component")), "label").select(F.col("node").alias("cid"), "component")
    named = classes.select(F.col("n").alias("n_"), F.col("d1").alias("d1_"), F.col("d2").alias("d2_"), "cid", "id", "copies").join(names, "cid", "left")
    named = named.where("copies > 1 OR component IS NOT NULL").select("n_", "d1_", "d2_", F.coalesce("component", "id").alias("component"), F.lit(True).alias("named"))
    out = sk.select("doc_id", "t", "n", "d1", "d2").join(named, (F.col("n") == F.col("n_")) & (F.col("d1") == F.col("d1_")) & (F.col("d2") == F.col("d2_")), "left")
    component = F.when(F.col("named"), F.col("component")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "t", F.col("n").alias("n_shingles"), component.alias("component_id"), (F.col("doc_id").eqNullSafe(component)).alias("kept"))


def near_duplicates(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", block: int = 2000, block_bytes: int = 16 << 20) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id (the least doc_id reachable by links), kept.

    Two documents are linked if 100 * intersection >= percent * union of their sets of five-word shingles.
    Null and empty texts have an empty set and are linked with nothing.  Rows that share a doc_id but not the text, or
    have no doc_id, are documents of their own, each linked by its own text; kept compares the doc_id alone.  A
    component of documents without ids has no component_id, and all of it is kept.  No documents: no rows.  Other
    columns are not read.
    """
    return judged(docs, percent, id_col, text_col, block, block_bytes).drop("t")


def texts_of(docs: DataFrame, clusters: DataFrame, classes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(cid, text): the text of one row of each class of clusters."""
    rows = clusters.select("cid").join(classes.select("cid", "row"), "cid").select("cid", F.col("row.doc_id").alias("id_"), F.col("row.t").alias("t_"))
    own = identified(docs, id_col, text_col)
    found = own.join(rows, (own["t"] == F.col("t_")) & own["doc_id"].eqNullSafe(F.col("id_")))
    return common.settled(found.select("cid", "text").dropDuplicates(["cid"]))


def split_members(members: DataFrame, labels: DataFrame, by: str) -> DataFrame:
    """members (by, cid, weight) of the groups that labels leave in several parts, as (key, cid, label, asks, whole,
    asking): asks but for the largest part (of equal ones that of the largest label); whole and asking: the weight of
    the group and of those in it that ask.  A member without a label is a part of its own."""
    named = members.join(labels.withColumnRenamed("node", "cid"), "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    per = named.groupBy(by, "label").agg(F.count(F.lit(1)).alias("k"), F.sum("weight").alias("part"))
    main = F.max(F.struct("k", "label", "part"))
    top = per.groupBy(by).agg(main.alias("main"), F.sum("part").alias("whole"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    top = top.select(by, F.col("main.label").alias("main"), "whole", (F.col("whole") - F.col("main.part")).alias("asking"))
    return common.settled(named.join(top, by).select(F.col(by).alias("key"), "cid", "label", (F.col("label") != F.col("main")).alias("asks"), "whole", "asking"))


def dealt(open_: DataFrame, most: int) -> DataFrame:
    """(key, block, batch, cid, label, asks): members of a group dealt into blocks of weight `most`, once per batch of
    those that ask; those that ask dealt into batches of weight `most`, once per block."""
    rows = open_.withColumn("blocks", F.ceil(F.col("whole") / most)).withColumn("batches", F.ceil(F.col("asking") / most))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    held = rows.withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks"))).withColumn("batch", every("batches")).withColumn("asks", F.lit(False))
    asks = rows.where("asks").withColumn("batch", F.pmod(F.xxhash64("cid", F.lit(1)), F.col("batches"))).withColumn("block", every("blocks"))
    return held.unionByName(asks).select("key", "block", "batch", "cid", "label", "asks")


class Joined:
    """Union-find over labels; join() tells whether two were apart."""

    def __init__(self):
        self.up: dict = {}

    def find(self, x: int) -> int:
        while (y := self.up.get(x, x)) != x:
            self.up[x] = x = self.up.get(y, y)
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        self.up[x] = y
        return x != y


def runs_of(batches, keys: list[str]):
    """Tables of whole groups and the bounds of the groups in them, from batches sorted by keys."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if rest is None else pa.concat_tables([rest, table])
        if not len(table):
            continue
        columns = [table.column(k).to_numpy() for k in keys]
        bounds = np.r_[0, np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], 0)) + 1]
        if len(bounds) > 1:
            yield table.slice(0, bounds[-1]), bounds
        rest = table.slice(bounds[-1])
    if rest is not None and len(rest):
        yield rest, np.array([0, len(rest)])


def across(open_: DataFrame, classes: DataFrame, least: float, block: int) -> DataFrame:
    """Pairs (a, b) of members of one group whose estimates join its parts, no more than it takes in a block."""
    keys = ["key", "block", "batch"]
    rows = dealt(open_, block).join(classes.select("cid", "n", "small", "large"), "cid").select(*keys, "cid", "label", "n", "small", "large", "asks")

    def joins(table: pa.Table, bounds: np.ndarray) -> list[tuple[int, int]]:
        cid, label, n = (table.column(c).to_numpy() for c in ("cid", "label", "n"))
        asks, found = table.column("asks").to_numpy(), []
        sides = []
        for kind, name in enumerate(("small", "large")):
            column = table.column(name).combine_chunks()
            at = np.flatnonzero(column.is_valid())
            per = REGISTERS if kind else 1
            sides.append((at, np.frombuffer(b"".join(column.drop_null().to_pylist()), np.uint16).reshape(-1, REGISTERS), hits(n[at], per)))
        for lo, hi in zip(bounds[:-1], bounds[1:]):
            parts = Joined()
            for at, regs, chances in sides:
                mine = np.arange(*np.searchsorted(at, (lo, hi)))
                held, asking = mine[~asks[at[mine]]], mine[asks[at[mine]]]
                if not len(held) or not len(asking):
                    continue
                step = max(1, (1 << 21) // (len(held) * REGISTERS))
                for first in range(0, len(asking), step):
                    some = asking[first : first + step]
                    x, y = at[some], at[held]
                    fits = (label[x][:, None] != label[y]) & (np.minimum(n[x][:, None], n[y]) >= least * np.maximum(n[x][:, None], n[y]))
                    fits &= corrected(regs[some][:, None], regs[held], chances[:, some].T @ chances[:, held] / 1024) >= least
                    found += [(cid[x[i]], cid[y[j]]) for i, j in zip(*np.nonzero(fits)) if parts.join(label[x[i]], label[y[j]])]
        return found

    def compare(batches):
        for table, bounds in runs_of(batches, keys):
            found = joins(table, bounds)
            yield pa.record_batch([pa.array([p[i] for p in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(compare, "a long, b long")


def resolved(open_: DataFrame, texts: DataFrame, percent: int, block_bytes: int) -> DataFrame:
    """Links (a, b) of members of one group, on full sets, that join its parts, no more than it takes in a block."""
    rows = dealt(open_, block_bytes).join(texts, "cid").select("key", "block", "batch", "cid", "label", "text", "asks")

    def compare(group: pa.Table) -> pa.Table:
        asks = np.array(group.column("asks").to_pylist(), bool)
        cid, label = (group.column(c).to_numpy() for c in ("cid", "label"))
        data, offsets = common.utf8(group.column("text"))
        held, asking = np.flatnonzero(~asks), np.flatnonzero(asks)
        found, parts = [], Joined()
        if len(held) and len(asking):
            sets = [shingles(data, offsets[i : i + 2])[0] for i in held]
            n = np.array(list(map(len, sets)), np.int64)
            flat = np.concatenate(sets)
            order = np.argsort(flat, kind="stable")
            flat, owner = flat[order], np.repeat(np.arange(len(held)), n)[order]
            at = {int(cid[i]): k for k, i in enumerate(held)}
        for i in asking if len(held) else ():
            own = sets[at[int(cid[i])]] if int(cid[i]) in at else shingles(data, offsets[i : i + 2])[0]
            low, high = np.searchsorted(flat, own), np.searchsorted(flat, own, "right")
            runs = high - low
            spots = np.arange(runs.sum()) + np.repeat(low - (np.cumsum(runs) - runs), runs)
            both = np.bincount(owner[spots], minlength=len(held))
            for j in np.flatnonzero((100 * both >= percent * (n + len(own) - both)) & (label[held] != label[i])):
                if parts.join(int(label[i]), int(label[held[j]])):
                    found.append((int(cid[i]), int(cid[held[j]])))
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return rows.groupBy("key", "block", "batch").applyInArrow(compare, "a long, b long")


def op10_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents"), percent=85)
