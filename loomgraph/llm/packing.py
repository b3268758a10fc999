"""Best-fit packing by minimum bin slack.

Documents become token ids and end with id 0; only those longer than a sequence are cut.  Minimum bin slack
(Gupta and Ho 1999) fills one bin at a time: anchored on the longest piece that is left, a subset-sum over
bitsets finds the fullest feasible combination of the lengths available, which is then removed.

Scale: what decides the packing is how many pieces there are of each length, at most `capacity` counters
whatever the corpus; a combination is applied as many times as the counts allow, so the driver plans a bounded
number of combinations (each one leaves some length with fewer pieces than it takes, which can happen at most
1 + capacity / length times per length).  The pieces never leave the executors: each finds its place
from its number among the pieces of its length, counted in two levels so that no length needs one task.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

CAPACITY = 2048
_ENCODERS: dict = {}

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


#: What separates words in the tokenizer's pattern, in the sense of Unicode.
_BLANK = "[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"
#: Longer runs of blanks are too deep for the fast encoder's regular expression (it fails near a million).
LONG_BLANK = 50_000


class Encoder:
    """The byte-level BPE of a tokenizers file by tiktoken: the same ids, several times faster.

    Byte-level vocabularies write bytes as printable characters: those that print stand for themselves, the
    rest follow from code point 256 on.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(printable)]
        byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}
        special = {x["content"]: x["id"] for x in spec.get("added_tokens", ())}
        ranks = {bytes(byte_of[c] for c in word): i for word, i in spec["model"]["vocab"].items() if word not in special}
        self.fast = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.path, self.slow = path, None
        self.blanks = re.compile(_BLANK + "{%d,}" % LONG_BLANK)

    def encode(self, text: str) -> list[int]:
        """The library's ids without added tokens; strings of special tokens become those tokens, its default."""
        return self._whole(text, lambda part: self.fast.encode(part, allowed_special="all"))

    def encode_ordinary(self, text: str) -> list[int]:
        """The same, but strings of special tokens are ordinary text."""
        return self._whole(text, self.fast.encode_ordinary)

    def _whole(self, text: str, encode) -> list[int]:
        """A very long run of blanks is one token of the pattern but for its last blank, where text follows: it is
        encoded on its own, and so is what lies on either side; the ids are those of the whole text."""
        runs = list(self.blanks.finditer(text)) if len(text) >= LONG_BLANK else []
        ids, at = [], 0
        if runs and self.slow is None:  # some hundred times the memory of most texts, so only where it is needed
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(self.path)
        for run in runs:
            end = run.end() - (run.end() < len(text))
            ids += encode(text[at : run.start()])
            ids += self.slow.encode(text[run.start() : end], add_special_tokens=False).ids
            at = end
        return ids + encode(text[at:]) if runs else encode(text)


def encoder(path: str | None = None) -> Encoder:
    if path not in _ENCODERS:
        import public_tokenizers

        _ENCODERS[path] = Encoder(path or public_tokenizers.path("byte_bpe_50k.json"))
    return _ENCODERS[path]


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: whole if it fits; else full pieces behind a shorter first one."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity or capacity
    return [(0, first), *((at, capacity) for at in range(first, n, capacity))]


def pieces(docs: DataFrame, capacity: int = CAPACITY, end_id: int = 0, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32.

    A null or empty text is its end id alone.  Ids are those of the tokenizers library without added tokens, so the
    string of a special token in a text is that token.  A null doc_id stays null; repeated rows are pieces each; other
    columns are not read.  No documents: no rows.
    """

    def tokenised(batches):
        encode = encoder(path).encode
        for batch in batches:
            out: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.array([*encode(text.as_py() or ""), end_id], "<u4")
                out += [(doc, i, start, n, zlib.crc32(ids[start : start + n])) for i, (start, n) in enumerate(cut(len(ids), capacity))]
            columns = zip(*out) if out else [[]] * 5
            yield pa.record_batch([pa.array(list(c), t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(tokenised, PIECES)


def fullest(left: Counter, lengths: list[int], anchor: int, capacity: int) -> Counter:
    """The fullest combination of available lengths around the anchor: subset-sum over bitsets, longest first."""
    room = capacity - anchor
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for length in lengths:
        if length > room:
            continue
        for _ in range(min(left[length] - (length == anchor), room // length)):
            wider = (reach | reach << length) & mask
            if wider == reach:
                break
            steps.append((length, reach))
            reach = wider
        if reach >> room & 1:
            break
    total, taken = reach.bit_length() - 1, Counter({anchor: 1})
    for length, before in reversed(steps):
        if not before >> total & 1:
            taken[length] += 1
            total -= length
    return taken


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """[(times, {length: pieces per sequence})] that use every piece once."""
    left, out = Counter({n: c for n, c in counts.items() if c > 0}), []
    lengths = sorted(left, reverse=True)
    while lengths:
        taken = fullest(left, lengths, lengths[0], capacity)
        times = min(left[n] // k for n, k in taken.items())
        out.append((times, dict(sorted(taken.items(), reverse=True))))
        gone = False
        for n, k in taken.items():
            left[n] -= times * k
            gone |= not left[n]
        if gone:
            lengths = [n for n in lengths if left[n]]
    return out


def places(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Rows (length, first number, per sequence, first sequence, offset), sorted: where the pieces of a length go."""
    used, rows, sequence = Counter(), [], 0
    for times, taken in plan(counts, capacity):
        offset = 0
        for n, k in taken.items():
            rows.append((n, used[n], k, sequence, offset))
            used[n] += times * k
            offset += n * k
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(pieces_: DataFrame, capacity: int = CAPACITY, cell_rows: int = 500) -> DataFrame:
    """pieces_ with sequence_id and offset.  Every piece gets one place; sequences have no gaps.

    Repeated rows are packed once each.  No pieces: no rows.  Columns of pieces_ with those two names are replaced,
    others pass through.  pieces_ must be settled: it is read three times.
    The pieces of a length are numbered in cells of about cell_rows, so a length that most pieces have is many tasks.
    """
    counts = {r["length"]: r["n"] for r in pieces_.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    table = places(counts, capacity)
    cells = [max(1, -(-counts.get(n, 0) // cell_rows)) for n in range(1, capacity + 1)]
    many = F.element_at(F.array(*map(F.lit, cells)), F.col("length").cast("int")) if max(cells) > 1 else F.lit(1)
    passed = [c for c in pieces_.columns if c not in ("sequence_id", "offset")]
    salted = pieces_.select("doc_id", "piece", "start", "ids_crc32", "length", F.struct(*[F.col(f"`{c}`") for c in passed]).alias("_row"), F.pmod(F.xxhash64("doc_id", "piece", "start"), many.cast("long")).alias("_salt"))
    sums = salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n"))
    ahead = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    firsts = sums.select(F.col("length").alias("_length"), F.col("_salt").alias("_salt_of"), F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_first"))
    within = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "start", "ids_crc32")
    numbered = salted.withColumn("_number", F.row_number().over(within) - 1).join(firsts, (F.col("length") == F.col("_length")) & (F.col("_salt") == F.col("_salt_of")))
    keys = table[:, 0] << 40 | table[:, 1]

    @F.pandas_udf("sequence_id long, offset long")
    def placed(length: pd.Series, number: pd.Series) -> pd.DataFrame:
        n, i = length.to_numpy(np.int64), number.to_numpy(np.int64)
        row = table[np.searchsorted(keys, n << 40 | i, "right") - 1]
        i = i - row[:, 1]
        return pd.DataFrame({"sequence_id": row[:, 3] + i // row[:, 2], "offset": row[:, 4] + i % row[:, 2] * n})

    out = numbered.select("_row", placed("length", F.col("_first") + F.col("_number")).alias("_at"))
    return out.select(*[F.col(f"_row.`{c}`") for c in passed], "_at.sequence_id", "_at.offset")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(common.settled(pieces(common.table(spark, sf_dir, "documents"))))
