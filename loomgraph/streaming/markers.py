"""Blocks between markers in streams of text chunks (session_id, seq, chunk), with state per session.

Outside a block, text goes to the fallback marker ""; inside one it belongs to the marker that began first.  As much
of the text's end is held back as may be the start of a marker, so the result does not depend on where chunks are
cut.  A newline right behind a marker is dropped, also when it comes in the next chunk.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "session_id string, block_no long, marker_id string, raw_content string, complete boolean, fields map<string,string>"
STATE = "buffer string, active int, held string, block_no long, skip boolean, seq long"

#: Chunks that end a generation: what is open is flushed.
CONTROL = ("<STARTED-REASONING>", "<FINISHED-REASONING>", "<FINISHED-GEN>")


@dataclass(frozen=True)
class Marker:
    """A block's begin and end, whether its text comes as it arrives (stream) or at once, and its fields' patterns."""

    marker_id: str
    begin: str
    end: str
    stream: bool = False
    fields: tuple[tuple[str, str], ...] = ()

    def extract(self, text: str) -> dict[str, str]:
        found = {name: re.search(pattern, text, re.M | re.S) for name, pattern in self.fields}
        return {k: (m.group(1) if m.groups() else m.group(0)).strip() for k, m in found.items() if m}


#: The blocks of generated answers.
DEFAULT = tuple(Marker(name.lower().replace(" ", "_"), f"*** Begin {name}", f"*** End {name}") for name in ("Patch", "Steps", "Commit", "Reasoning", "Summary", "Context Identifiers", "Modify Identifiers"))


class Machine:
    """The state of one session; feed() and finish() give (block_no, marker_id, text, complete, fields)."""

    def __init__(self, markers: tuple[Marker, ...] = DEFAULT, buffer: str = "", active: int = -1, held: str = "", block_no: int = 0, skip: bool = False, seq: int = -1):
        self.markers, self.buffer, self.active, self.held, self.block_no, self.skip, self.seq = markers, buffer, active, held, block_no, skip, seq

    def state(self) -> tuple:
        return self.buffer, self.active, self.held, self.block_no, self.skip, self.seq

    def feed(self, chunk: str) -> Iterator[tuple]:
        self.buffer += chunk
        while True:
            if self.skip:
                if not self.buffer:
                    return
                self.buffer, self.skip = self.buffer.removeprefix("\n"), False
            ends = [m.begin for m in self.markers] if self.active < 0 else [self.markers[self.active].end]
            at, which = min(((i, k) for k, e in enumerate(ends) if (i := self.buffer.find(e)) >= 0), default=(-1, -1))
            if at < 0:
                keep = max((n for e in ends for n in range(1, min(len(e), len(self.buffer) + 1)) if self.buffer.endswith(e[:n])), default=0)
                text, self.buffer = self.buffer[: len(self.buffer) - keep], self.buffer[len(self.buffer) - keep :]
                yield from self.take(text)
                return
            text, self.buffer, self.skip = self.buffer[:at], self.buffer[at + len(ends[which]) :], True
            yield from self.take(text)
            if self.active < 0:
                self.active = which
            else:
                yield from self.close(True)

    def take(self, text: str) -> Iterator[tuple]:
        if self.active < 0:
            if text:
                yield self.block_no, "", text, True, {}
        elif self.markers[self.active].stream:
            if text:
                yield self.block_no, self.markers[self.active].marker_id, text, False, {}
        else:
            self.held += text

    def close(self, complete: bool) -> Iterator[tuple]:
        m = self.markers[self.active]
        if not m.stream:
            yield self.block_no, m.marker_id, self.held, complete, m.extract(self.held)
        self.held, self.active, self.block_no = "", -1, self.block_no + 1

    def finish(self) -> Iterator[tuple]:
        """What is open: an incomplete block, or text."""
        rest, self.buffer, self.skip = self.buffer, "", False
        yield from self.take(rest)
        if self.active >= 0:
            yield from self.close(False)


def run(machine: Machine, rows: pd.DataFrame) -> Iterator[tuple]:
    """Rows in order of seq; those seen already don't count again."""
    for seq, chunk in sorted(zip(rows["seq"], rows["chunk"])):
        if seq > machine.seq:
            machine.seq = int(seq)
            if chunk in CONTROL:
                yield from machine.finish()
            elif chunk:
                yield from machine.feed(chunk)


def joined(found: list[tuple]) -> list[tuple]:
    """Pieces of the same block, or of the text before the same block, as one."""
    out: list[tuple] = []
    for f in found:
        if out and out[-1][:2] == f[:2]:
            f = (*f[:2], out.pop()[2] + f[2], *f[3:])
        out.append(f)
    return out


def frame(session: str, found: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame([(session, *f) for f in found], columns=["session_id", "block_no", "marker_id", "raw_content", "complete", "fields"])


def blocks(chunks: DataFrame, markers: tuple[Marker, ...] = DEFAULT) -> DataFrame:
    """The blocks of a batch of chunks, incomplete ones too."""

    def whole(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        machine = Machine(markers)
        return frame(key[0], joined([*run(machine, rows), *machine.finish()]))

    return chunks.groupBy("session_id").applyInPandas(whole, OUT)


def stream_blocks(chunks: DataFrame, markers: tuple[Marker, ...] = DEFAULT, idle_ms: int | None = 60_000) -> DataFrame:
    """The blocks of a stream of chunks; a session that is idle that long is flushed.

    With idle_ms None nothing waits for a clock, so a query over what is available ends.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        machine = Machine(markers, *(state.get if state.exists else ()))
        if state.hasTimedOut:
            found = [*machine.finish()]
            state.remove()
        else:
            rows = pd.concat(list(batches))
            found = [*run(machine, rows)]
            state.update(machine.state())
            if idle_ms is not None:
                state.setTimeoutDuration(idle_ms)
        yield frame(key[0], found)

    return chunks.groupBy("session_id").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout)


def chunked(texts: DataFrame, size: int, session: str = "session_id", text: str = "text") -> DataFrame:
    """Texts cut into chunks of so many characters."""
    n = F.greatest(F.ceil(F.length(text) / size), F.lit(1)).cast("int")
    rows = texts.select(F.col(session).cast("string").alias("session_id"), text, F.explode(F.sequence(F.lit(0).cast("long"), n.cast("long") - 1)).alias("seq"))
    return rows.select("session_id", "seq", F.substring(F.col(text), (F.col("seq") * size + 1).cast("int"), F.lit(size)).alias("chunk"))
