"""Chroma audio fingerprints and their alignment.

A recording's spectrum is folded into twelve pitch classes per frame, smoothed and normalised.  Sixteen filters,
differences of two areas of the chroma image, are read off its integral image; each is quantised to two
Gray-coded bits, so a frame becomes one 32-bit print.  Recordings align at the offset with the most equal prints
(offset histogram), and the share of differing bits tells how well.

A match: at the offset with the most equal prints (`least_votes` or more; ties to the fewest differing bits, then the
least offset) there is a stretch of the overlap in which at most `most_error` of the bits differ, and it has at least
`least_overlap` prints, or all of the shorter recording.  So few equal prints nominate an alignment and the bits decide:
noise, a start between two frames, a shorter recording in a longer one and a part that two share are all found.

Scale: recordings of equal prints are one class, with its members listed, not paired.  A candidate is a class that
shares a print with one that asks, found by a join on distinct prints; a print that a great many share makes skewed
join keys, which adaptive execution splits, and none is left out.  Each candidate is decided on whole fingerprints.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WINDOW, HOP, RATE = 512, 64, 1378
WIDTH = 8
SMOOTH = np.array([0.25, 0.75, 1.0, 0.75, 0.25])
SMOOTH /= SMOOTH.sum()
#: (kind, first class, classes, frames) by rule: kinds in turn, over classes and widths that step through the image.
FILTERS = [(k % 4, (5 * k) % 9, 3 + k % 2, (4, 8, 6, 8)[k % 4]) for k in range(16)]
THRESHOLDS = (-0.08, 0.0, 0.08)
GRAY = np.array([0, 1, 3, 2], np.uint32)


def _classes(window: int, rate: int) -> np.ndarray:
    """(bins, 12): the pitch class of each spectrum bin from 28 Hz up; A is class 0."""
    hz = np.arange(window // 2 + 1) * rate / window
    out = np.zeros((len(hz), 12), np.float32)
    heard = np.flatnonzero(hz >= 28)
    out[heard, np.round(12 * np.log2(hz[heard] / 440)).astype(int) % 12] = 1
    return out


def chroma(pcm: np.ndarray, window: int = WINDOW, hop: int = HOP, rate: int = RATE) -> np.ndarray:
    """Chroma frames (n, 12) of unsigned 8-bit samples; a short recording is padded with silence to one print."""
    least = window + (WIDTH + len(SMOOTH) - 2) * hop
    x = pcm.astype(np.float32) - 128
    if len(x) < least:
        x = np.concatenate([x, np.zeros(least - len(x), np.float32)])
    frames = np.lib.stride_tricks.sliding_window_view(x, window)[::hop]
    shape, fold = np.hanning(window).astype(np.float32), _classes(window, rate)
    parts = [np.abs(np.fft.rfft(frames[i : i + 1024] * shape)).astype(np.float32) ** 2 @ fold for i in range(0, len(frames), 1024)]
    c = np.concatenate(parts)
    c = sum(w * c[i : len(c) - len(SMOOTH) + 1 + i] for i, w in enumerate(SMOOTH))
    length = np.sqrt((c**2).sum(1, keepdims=True))
    return np.where(length > 0.01, c / np.maximum(length, 1e-12), 0)


def prints(pcm: np.ndarray, window: int = WINDOW, hop: int = HOP, rate: int = RATE) -> np.ndarray:
    """The packed prints of a recording, one per frame that has all filters' frames ahead of it."""
    c = chroma(pcm, window, hop, rate)
    image = np.zeros((len(c) + 1, 13))
    image[1:, 1:] = np.cumsum(np.cumsum(c.astype(np.float64), 0), 1)
    n = len(c) - WIDTH + 1
    area = lambda t, w, y, h: image[t + w : t + w + n, y + h] - image[t : t + n, y + h] - image[t + w : t + w + n, y] + image[t : t + n, y]
    out = np.zeros(n, np.uint32)
    for kind, y, h, w in FILTERS:
        if kind == 0:  # one half in time against the other
            a, b = area(0, w // 2, y, h), area(w // 2, w - w // 2, y, h)
        elif kind == 1:  # low classes against high ones
            a, b = area(0, w, y, h // 2), area(0, w, y + h // 2, h - h // 2)
        elif kind == 2:  # diagonal quarters
            a = area(0, w // 2, y, h // 2) + area(w // 2, w - w // 2, y + h // 2, h - h // 2)
            b = area(w // 2, w - w // 2, y, h // 2) + area(0, w // 2, y + h // 2, h - h // 2)
        else:  # the middle in time against both sides
            a = area(w // 4, w // 2, y, h)
            b = area(0, w // 4, y, h) + area(w // 4 + w // 2, w - w // 4 - w // 2, y, h)
        out = out << np.uint32(2) | GRAY[np.digitize(np.log1p(np.maximum(a, 0)) - np.log1p(np.maximum(b, 0)), THRESHOLDS)]
    return out


def counted_votes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many prints of a equal those of b at each offset of a's start in b, from -len(a) on.

    Equal prints are paired where that is few pairs; prints repeated so often that it isn't are counted by
    correlating where they are, so silence costs n log n and not the square of n.
    """
    votes = np.zeros(len(a) + len(b), np.int64)
    order = np.argsort(b, kind="stable")
    low, high = np.searchsorted(b[order], a), np.searchsorted(b[order], a, "right")
    values, of, times = np.unique(a, return_inverse=True, return_counts=True)
    pairs = np.bincount(of, high - low, len(values))  # equal prints per value
    heavy = pairs > 64 * len(votes)
    some = np.flatnonzero((high > low) & ~heavy[of])
    runs = (high - low)[some]
    spots = np.repeat(low[some] - np.cumsum(runs) + runs, runs) + np.arange(runs.sum())
    np.add.at(votes, order[spots] - np.repeat(some, runs) + len(a), 1)
    size = 1 << int(len(votes)).bit_length()
    for v in np.flatnonzero(heavy):
        x, y = np.fft.rfft(a[::-1] == values[v], size), np.fft.rfft(b == values[v], size)
        votes[1:] += np.rint(np.fft.irfft(x * y, size)[: len(votes) - 1]).astype(np.int64)
    return votes


def longest_stretch(wrong: np.ndarray, most: float) -> tuple[int, int]:
    """(start, length) of the longest run of wrong whose mean is at most `most`, ties to the least start."""
    sums = np.concatenate([[0], np.cumsum(wrong - most)])
    least = np.minimum.accumulate(sums[::-1])[::-1]  # of what lies behind, itself included
    # least never falls from left to right, so the last place that is no more than a sum is found by bisection.
    last = np.searchsorted(least, sums + 1e-9, "right") - 1
    length = last - np.arange(len(sums))
    start = int(length.argmax())
    return start, int(length[start])


def align(a: np.ndarray, b: np.ndarray, most_error: float = 0.15) -> tuple[int, int, int, float]:
    """(offset of a's start in b, votes, prints of the longest stretch within most_error, its bit error) at the offset
    with the most equal prints; ties to the fewest differing bits, then the least offset."""
    votes = counted_votes(a, b)
    best = None
    for at in np.flatnonzero(votes == votes.max()) if votes.max() else ():
        offset = int(at) - len(a)
        x, y = a[max(0, -offset) : len(b) - offset], b[max(0, offset) : len(a) + offset]
        wrong = np.bitwise_count(x ^ y).astype(np.float64) / 32
        if best is None or wrong.mean() < best[0]:
            best = (wrong.mean(), offset, wrong)
    if best is None:
        return 0, 0, 0, 1.0
    start, n = longest_stretch(best[2], most_error)
    return best[1], int(votes.max()), n, float(best[2][start : start + n].mean()) if n else 1.0


def fingerprints(recordings: DataFrame, id_col: str = "doc_id", pcm_col: str = "pcm", window: int = WINDOW, hop: int = HOP, rate: int = RATE) -> DataFrame:
    """(id, n_prints, prints): one row per row of recordings; prints are four bytes each.

    A null recording counts as empty, which is silence of one print.  Null ids and repeated rows stay; no recordings,
    no rows; other columns are not read.
    """

    def run(batches):
        for batch in batches:
            found = [prints(np.frombuffer(p.as_py() or b"", np.uint8), window, hop, rate) for p in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array([len(p) for p in found], pa.int64()), pa.array([p.tobytes() for p in found], pa.binary())], names=["id", "n_prints", "prints"])

    return recordings.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{pcm_col}`").alias("pcm")).mapInArrow(run, "id long, n_prints long, prints binary")


def matches(found: DataFrame, asked: Column, least_votes: int = 1, most_error: float = 0.15, least_overlap: int = 32) -> tuple[DataFrame, DataFrame]:
    """(members, pairs) of found, which must be settled.

    members: id, class_id (least id of a recording of equal prints), n_prints, links (how many other classes its class
    matches, where that asks; else null); one row per row of found.
    pairs: query_id, match_id (class ids, of different classes), offset, votes, overlap, bit_error, for each class
    with a member that `asked` (over id) holds for.
    Rows without an id are members of the class of their prints; a class without any id has no class_id and asks for
    nothing and is found by nothing.  Rows that share an id are recordings of their own; two classes may then have one
    class_id.  Repeated rows are one class.  No recordings: no members, no pairs.
    """
    made = found.groupBy(F.md5("prints").alias("digest")).agg(F.min("id").alias("class_id"), F.first("prints").alias("prints"), F.max(F.coalesce(asked, F.lit(False))).alias("asks"))
    classes = common.settled(made.withColumn("cid", F.monotonically_increasing_id()))
    named = classes.where("class_id IS NOT NULL")

    @F.pandas_udf("array<int>")
    def distinct(p: pd.Series) -> pd.Series:
        return p.map(lambda b: np.unique(np.frombuffer(b, np.int32)))

    index = named.select("cid", "asks", F.explode(distinct("prints")).alias("print"))
    asking = index.where("asks").select(F.col("cid").alias("query"), "print")
    nominated = asking.join(index.select(F.col("cid").alias("match"), "print"), "print").where("query <> match").select("query", "match").distinct()
    side = lambda name: named.select(F.col("cid").alias(name), F.col("class_id").alias(f"{name}_id"), F.col("prints").alias(f"{name}_prints"))

    @F.pandas_udf("offset int, votes int, overlap int, bit_error double, shorter int")
    def aligned(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        both = [(np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)) for x, y in zip(a, b)]
        rows = [(*align(x, y, most_error), min(len(x), len(y))) for x, y in both]
        return pd.DataFrame(rows, columns=["offset", "votes", "overlap", "bit_error", "shorter"])

    pairs = nominated.join(side("query"), "query").join(side("match"), "match")
    pairs = pairs.withColumn("fit", aligned("query_prints", "match_prints")).select("query", "query_id", "match_id", "fit.*")
    pairs = pairs.where((F.col("votes") >= least_votes) & (F.col("overlap") >= F.least(F.lit(least_overlap), F.col("shorter"))))
    pairs = common.settled(pairs.drop("shorter"))
    links = pairs.groupBy(F.col("query").alias("cid")).agg(F.count(F.lit(1)).alias("links"))
    counted = classes.join(links, "cid", "left").select("digest", "class_id", F.when(F.col("asks") & F.col("class_id").isNotNull(), F.coalesce("links", F.lit(0))).alias("links"))
    members = found.withColumn("digest", F.md5("prints")).select("id", "n_prints", "digest").join(counted, "digest").select("id", "class_id", "n_prints", "links")
    return members, pairs.drop("query")


def op4_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's UTF-8 bytes as 8-bit samples: a row per document with its class, and a row per match of the
    classes of the documents whose doc_id is divisible by 100 (match_id and the rest are null in the former)."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("pcm"))
    members, pairs = matches(common.settled(fingerprints(docs)), F.col("id") % 100 == 0)
    kinds = {"match_id": "long", "offset": "int", "votes": "int", "overlap": "int", "bit_error": "double"}
    rows = members.select(F.col("id").alias("doc_id"), "class_id", "n_prints", "links", *[F.lit(None).cast(t).alias(c) for c, t in kinds.items()])
    empty = F.lit(None).cast("long")
    return rows.unionByName(pairs.select(F.col("query_id").alias("doc_id"), F.col("query_id").alias("class_id"), empty.alias("n_prints"), empty.alias("links"), *kinds))
