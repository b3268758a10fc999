"""Line deduplication by deletion neighbourhoods.

Lines are compared after A-Z are lower-cased, white space is trimmed and its runs become one space.  A line of at
least `exact_chars` characters goes if an earlier line (by doc_id, then line number) equals it, and one of at least
`min_chars` also if an earlier one of at least that length is within one edit (insertion, deletion or substitution of a
character) of it; the earliest stays.  A line without characters always stays.

Deletion neighbourhood: a line emits every variant of itself with one character deleted, as a hashed key, and
itself.  Two lines one substitution apart share a variant at the same position; a line one deletion away is itself
a variant.  For each key only the earliest line is kept (a combining aggregation, so no pairs within a group), and
the partner it names is verified by edit distance.

Scale: variants of all lines would be many times the input.  One edit falls into one of four blocks of a line, so
two such lines agree outside that block; only lines that share such a block key with another line emit variants,
and only within that block.  This loses nothing.  Equal lines are one row before any of it.  The texts of
lines that emit variants are fetched from their documents alone: a bit set of fixed size, a Bloom filter over
documents, spares the other documents the shuffle, and where it fills up more documents are shuffled, never fewer.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

BLOCKS = 4
BLOOM_BITS = 25
#: A document: its id and a hash of its text.  A line's place: that and its number; the order of places is which is earlier.
KEYS = ["doc_id", "t"]
PLACE = [*KEYS, "line"]
_SALTS = np.random.default_rng(5).integers(1, 2**63, (2, 2 * BLOCKS + 2), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_INK = ~common._SPACE
_PLAIN = np.where(common._SPACE, np.uint8(32), common._LOWER)
_CODES2 = np.random.default_rng(6).integers(1, 2**64, 256, dtype=np.uint64)


class Lines:
    """The normalised lines of some texts: bytes, byte range, document and number of each, and prefix hashes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, texts_are_lines: bool = False):
        part, at = data[offsets[0] : offsets[-1]], offsets - offsets[0]
        size = len(part)
        breaks = np.zeros(0, np.int64) if texts_are_lines else np.flatnonzero(part == 10)
        starts = np.sort(np.concatenate([at[:-1], breaks + 1]))
        per = 1 + np.bincount(np.searchsorted(at, breaks, "right") - 1, minlength=len(at) - 1)
        self.row = np.repeat(np.arange(len(at) - 1), per)
        firsts = np.searchsorted(self.row, np.arange(len(at) - 1))
        self.number = np.arange(len(starts)) - firsts[self.row] if len(starts) else starts
        ends = np.concatenate([starts[1:], [size]]) if len(starts) else starts
        ink = _INK[part] if size else np.zeros(0, bool)
        seen = np.zeros(size + 1, np.int32)
        np.cumsum(ink, out=seen[1:], dtype=np.int32)
        space = np.zeros(size, bool)
        if size > 1:
            gaps = np.flatnonzero(~ink[:-1] & ink[1:])  # the last space before an ink byte stays, but for a line's first
            line_of = np.searchsorted(starts, gaps + 1, "right") - 1
            space[gaps[(starts[line_of] <= gaps) & (seen[gaps] > seen[starts[line_of]])]] = True
        keep = ink | space
        if np.count_nonzero(keep) + len(breaks) == size:  # nothing to squeeze out but the line ends, which no line has
            self.bytes, self.start, self.end = _PLAIN[part], starts, ends.copy()
            self.end[np.searchsorted(starts, breaks, "right") - 1] = breaks
        else:
            self.bytes = _PLAIN[part[keep]]
            kept = np.zeros(size + 1, np.int32)
            np.cumsum(keep, out=kept[1:], dtype=np.int32)
            self.start, self.end = kept[starts].astype(np.int64), kept[ends].astype(np.int64)
        n = len(self.bytes)
        first = (self.bytes & 0xC0) != 0x80
        self.char_at = np.concatenate([np.flatnonzero(first), [n]])
        chars = np.zeros(n + 1, np.int32)
        np.cumsum(first, out=chars[1:], dtype=np.int32)
        self.first_char = chars[self.start].astype(np.int64)
        self.chars = chars[self.end].astype(np.int64) - self.first_char
        up, self.down = common._powers(n + 1)
        self.sums = []
        for codes in (common._BYTE_CODES, _CODES2):
            s = np.zeros(n + 1, np.uint64)
            np.cumsum(codes[self.bytes] * up[:n], out=s[1:])
            self.sums.append(s)

    def hash(self, which: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        s = self.sums[which]
        return (s[hi] - s[lo]) * self.down[lo]

    def whole(self, which: int) -> np.ndarray:
        return common.mix(self.hash(which, self.start, self.end) + self.chars.astype(np.uint64))

    def block(self, length: np.ndarray, j: int) -> tuple[np.ndarray, np.ndarray]:
        """Characters before block j and after it, in a line that counts as `length` characters."""
        return j * length // BLOCKS, length - (j + 1) * length // BLOCKS

    def block_keys(self) -> np.ndarray:
        """Keys of a line without each block: as long as it is, then as the shorter of two."""
        out = []
        for longer in (0, 1):
            length = self.chars + longer
            for j in range(BLOCKS):
                ahead, behind = self.block(length, j)
                ahead = np.minimum(ahead, self.chars)
                cut = self.char_at[self.first_char + ahead]
                back = self.char_at[self.first_char + np.maximum(self.chars - behind, ahead)]
                key = self.hash(0, self.start, cut) * _SALTS[0, j] + self.hash(0, back, self.end) * _SALTS[1, j]
                out.append(common.mix(key + length.astype(np.uint64) * _SALTS[0, 2 * BLOCKS]))
        return np.stack(out, 1).view(np.int64) if len(self.chars) else np.zeros((0, 2 * BLOCKS), np.int64)


def line_rows(docs: DataFrame, min_chars: int, exact_chars: int, keyed: bool = True) -> DataFrame:
    """(doc_id, t, line, h1, h2, keys) of lines of at least exact_chars characters; keys: none under min_chars."""

    def found(batches):
        for batch in batches:
            data, offsets = common.utf8(batch.column(2))
            for lo, hi in common.slices(offsets):
                x = Lines(data, offsets[lo : hi + 1])
                kept = np.flatnonzero(x.chars >= exact_chars)
                long = (x.chars[kept] >= min_chars) & keyed
                keys = x.block_keys()[kept[long]] if keyed else np.zeros((0, 0), np.int64)
                ends = np.zeros(len(kept) + 1, np.int32)
                np.cumsum(long * keys.shape[1], out=ends[1:])
                lists = pa.ListArray.from_arrays(ends, pa.array(keys.reshape(-1)))
                place = (batch.column(c).slice(lo, hi - lo).take(pa.array(x.row[kept])) for c in (0, 1))
                yield pa.record_batch([*place, pa.array(x.number[kept].astype(np.int32)), pa.array(x.whole(0)[kept].view(np.int64)), pa.array(x.whole(1)[kept].view(np.int64)), lists], names=["doc_id", "t", "line", "h1", "h2", "keys"])

    return docs.where(F.col("text").isNotNull()).mapInArrow(found, "doc_id long, t long, line int, h1 long, h2 long, keys array<long>")


def spot(keys) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(1 << BLOOM_BITS))


def bloom(ids: DataFrame, keys) -> np.ndarray:
    """A bit set of 2^BLOOM_BITS bits over the keys: its size is fixed, whatever the number of ids."""
    words = ids.select(spot(keys).alias("spot")).groupBy(F.shiftright("spot", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(spot & 63 AS INT))")).alias("bits")).toPandas()
    out = np.zeros(1 << (BLOOM_BITS - 6), np.uint64)
    out[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64).view(np.uint64)
    return out


def split_by(docs: DataFrame, ids: DataFrame, keys=KEYS) -> DataFrame:
    """docs with a boolean _hit: false only where the keys are not among those of ids."""
    words = docs.sparkSession.sparkContext.broadcast(bloom(ids, keys))

    @F.pandas_udf("boolean")
    def hits(spot: pd.Series) -> pd.Series:
        spot = spot.to_numpy()
        return pd.Series((words.value[spot >> 6] >> (spot & 63).astype(np.uint64) & np.uint64(1)).astype(bool))

    return docs.withColumn("_hit", hits(spot(keys)))


def chosen_lines(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, t, line, blocks, norm): the normalised texts of wanted (doc_id, t, line, blocks)."""
    lists = wanted.groupBy(*KEYS).agg(F.collect_list(F.struct("line", "blocks")).alias("lines"))
    rows = split_by(docs.where(F.col("text").isNotNull()), lists).where("_hit").join(lists, KEYS).select(*KEYS, "text", "lines").dropDuplicates(KEYS)

    def picked(batches):
        for batch in batches:
            data, offsets = common.utf8(batch.column(2))
            out: list[tuple] = []
            for i, (doc, t, lines) in enumerate(zip(*(batch.column(c).to_pylist() for c in (0, 1, 3)))):
                x = Lines(data, offsets[i : i + 2])
                for it in lines:
                    out.append((doc, t, it["line"], it["blocks"], x.bytes[x.start[it["line"]] : x.end[it["line"]]].tobytes().decode("utf-8", "replace")))
            columns = zip(*out) if out else [[]] * 5
            yield pa.record_batch([pa.array(list(c), t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string()))], names=["doc_id", "t", "line", "blocks", "norm"])

    return rows.mapInArrow(picked, "doc_id long, t long, line int, blocks int, norm string")


def variants(lines: DataFrame) -> DataFrame:
    """(v1, v2, at, doc_id, t, line): the line without its character number `at` in the marked blocks; at -1: itself."""

    def emitted(batches):
        for batch in batches:
            data, offsets = common.utf8(batch.column(4))
            for lo, hi in common.slices(offsets, 1 << 18):
                x = Lines(data, offsets[lo : hi + 1], texts_are_lines=True)
                marks = batch.column(3).slice(lo, hi - lo).to_numpy()
                of, at = [np.flatnonzero(marks >> BLOCKS)], []
                at.append(np.full(len(of[0]), -1))
                for j in range(BLOCKS):
                    rows = np.flatnonzero(marks >> j & 1)
                    ahead, behind = (v[rows] for v in x.block(x.chars, j))
                    counts = np.maximum(x.chars[rows] - behind - ahead, 0)
                    of.append(np.repeat(rows, counts))
                    at.append(np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(ahead, counts))
                of, at = np.concatenate(of), np.concatenate(at)
                char = x.first_char[of] + np.maximum(at, 0)
                cut = np.where(at < 0, x.end[of], x.char_at[np.minimum(char, len(x.char_at) - 1)])
                back = np.where(at < 0, x.end[of], x.char_at[np.minimum(char + 1, len(x.char_at) - 1)])
                up, _ = common._powers(len(x.bytes) + 1)
                hashes = [common.mix(x.hash(w, x.start[of], cut) + x.hash(w, back, x.end[of]) * up[cut - x.start[of]] + (x.chars[of] - (at >= 0)).astype(np.uint64)).view(np.int64) for w in (0, 1)]
                place = (batch.column(c).slice(lo, hi - lo).take(pa.array(of)) for c in (0, 1, 2))
                yield pa.record_batch([*map(pa.array, hashes), pa.array(at.astype(np.int32)), *place], names=["v1", "v2", "at", *PLACE])

    return lines.mapInArrow(emitted, "v1 long, v2 long, at int, doc_id long, t long, line int")


def earlier_neighbours(lines: DataFrame) -> DataFrame:
    """(doc_id, t, line) of lines that have an earlier line within one edit; lines from chosen_lines."""
    own = F.struct(*PLACE)
    v = common.settled(variants(lines))
    spots = v.groupBy("v1", "v2", "at").agg(F.min(own).alias("least"), F.count(F.lit(1)).alias("n"))
    spots = common.settled(spots)
    same = spots.where("at >= 0 AND n > 1").select("v1", "v2", "at", "least")
    itself, longer = (F.min(F.when(c, F.col("least"))) for c in (F.col("at") < 0, F.col("at") >= 0))
    keys = spots.groupBy("v1", "v2").agg(itself.alias("self"), longer.alias("longer")).where("self IS NOT NULL AND longer IS NOT NULL")
    pairs = v.join(same, ["v1", "v2", "at"]).select(*PLACE, "least")
    pairs = pairs.unionByName(v.join(keys, ["v1", "v2"]).select(*PLACE, F.when(F.col("at") < 0, F.col("longer")).otherwise(F.col("self")).alias("least")))
    other = [f"{c}_2" for c in PLACE]
    pairs = pairs.where(F.col("least") < own).distinct().select(*PLACE, *[F.col(f"least.{c}").alias(o) for c, o in zip(PLACE, other)])
    text = lines.select(*PLACE, "norm")
    pairs = pairs.join(text, PLACE).join(text.select(*[F.col(c).alias(o) for c, o in zip(PLACE, other)], F.col("norm").alias("norm_2")), other)
    return pairs.where((F.col("norm") == F.col("norm_2")) | (F.levenshtein("norm", "norm_2", 1) >= 0)).select(*PLACE).distinct()


def dropped_lines(docs: DataFrame, min_chars: int, exact_chars: int) -> DataFrame:
    """(doc_id, t, drops): the numbers of the lines that go, for documents that lose any; docs has doc_id, t and text."""
    rows = line_rows(docs, min_chars, exact_chars)
    first = common.settled(rows.groupBy("h1", "h2").agg(F.min(F.struct(*PLACE)).alias("first"), F.count(F.lit(1)).alias("n"), F.first("keys").alias("keys")))
    keyed = first.select("first.*", F.posexplode("keys").alias("kind", "key"))
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    low, high = F.sum(F.expr("CASE WHEN kind < 4 THEN shiftleft(1, kind) ELSE 0 END")), F.max(F.when(F.col("kind") >= BLOCKS, 1).otherwise(0))
    marked = keyed.join(shared, "key").groupBy(*PLACE).agg(low.alias("low"), high.alias("high"))
    wanted = common.settled(marked.select(*PLACE, (F.col("low") + F.col("high") * (1 << BLOCKS)).cast("int").alias("blocks")))
    near = common.settled(earlier_neighbours(common.settled(chosen_lines(docs, wanted))))
    repeats = first.where("n > 1").select(F.col("h1").alias("h1_"), F.col("h2").alias("h2_"), "first")
    again = line_rows(docs, min_chars, exact_chars, keyed=False).select(*PLACE, "h1", "h2").join(repeats, (F.col("h1") == F.col("h1_")) & (F.col("h2") == F.col("h2_")))
    copies = again.join(near.select(F.struct(*PLACE).alias("first"), F.lit(True).alias("near")), "first", "left")
    copies = copies.where((F.struct(*PLACE) != F.col("first")) | F.col("near")).select(*PLACE)
    gone = copies.unionByName(near)
    return common.settled(gone.groupBy(*KEYS).agg(F.collect_set("line").alias("drops")))


def dedup_lines(docs: DataFrame, min_chars: int = 16, id_col: str = "doc_id", text_col: str = "text", exact_chars: int = 1) -> DataFrame:
    """docs without repeated lines: all their columns, and n_lines and n_dropped, which replace columns so named.

    Texts are cut at \\n; the lines that stay are unchanged and in order, and no document goes, even if no line of
    it stays (its text is then empty).  A null text stays null and has no lines; an empty one has one line.
    Of lines shorter than min_chars only exact repeats of at least exact_chars characters go.  Rows that share a
    doc_id but not the text are documents of their own, ordered by a hash of the text; rows equal in both are one
    document, and each keeps what that keeps.  A null doc_id counts as the least number there is.  Columns of any
    other name pass through.  No documents: no rows.
    """
    columns = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    number = F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(-(2**63)))
    rest = F.struct(F.lit(0).alias("_rest_"), *[F.col(f"`{c}`") for c in columns if c != text_col])
    packed = docs.select(number.alias("doc_id"), F.xxhash64(F.col(f"`{text_col}`")).alias("t"), F.col(f"`{text_col}`").alias("text"), rest.alias("rest"))
    drops = dropped_lines(packed.select("doc_id", "t", "text"), min_chars, max(1, exact_chars))
    split = split_by(packed, drops)
    hit = split.where("_hit").join(drops, KEYS, "left").select("text", "rest", "drops")
    out = hit.unionByName(split.where("NOT _hit").select("text", "rest", F.lit(None).cast("array<int>").alias("drops")))
    lines = F.split("text", "\n", -1)
    flags = F.map_from_entries(F.transform("drops", lambda i: F.struct(i.alias("k"), F.lit(True).alias("v"))))
    kept = F.when(F.col("drops").isNull(), F.col("text")).otherwise(F.array_join(F.filter(lines, lambda x, i: F.element_at(F.col("flags"), i).isNull()), "\n"))
    breaks = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))
    gone = F.coalesce(F.when(F.col("drops").isNull(), 0).otherwise(F.size("drops")), F.lit(0))
    out = out.withColumn("flags", flags).select("rest", kept.alias("text"), F.coalesce(breaks + 1, F.lit(0)).cast("long").alias("n_lines"), gone.cast("long").alias("n_dropped"))
    return out.select(*[F.col("text").alias(text_col) if c == text_col else F.col(f"rest.`{c}`").alias(c) for c in columns], "n_lines", "n_dropped")


def op5_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_chars and the MD5 of the text that stays."""
    out = dedup_lines(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("kept_chars"), F.md5(F.coalesce("text", F.lit(""))).alias("kept_md5"))
