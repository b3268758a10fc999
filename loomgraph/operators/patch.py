"""Patches: text to actions and hunks, hunks located in files, files changed.

A patch is *** Begin Patch ... *** End Patch with sections *** Update File, *** Delete File, *** Add File, and after
an update's header *** Move to.  An update has hunks of lines with a prefix: + adds, - deletes, a space keeps; @@
parts hunks and may name a line to start from.  Order matters from line to line, so one patch is the work of one
call; patches and the files they name are joined by path.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import blocks as B

CHANGES = "patch_id long, path string, action string, new_content string, move_path string, error string"


class PatchError(ValueError):
    """A patch that can't be read or doesn't fit its files."""


@dataclass
class Hunk:
    context: list[str] = field(default_factory=list)  # lines to find: kept ones before the last change, deleted ones
    edits: list[tuple[int, list[str], list[str]]] = field(default_factory=list)  # (place in context, deleted, inserted)


@dataclass
class Action:
    kind: str
    body: list[str] = field(default_factory=list)
    move_path: str | None = None


def prepared(text: str) -> list[str]:
    """Lines in which every one of a section has a prefix; an @@ header that insertions follow is context too."""
    out: list[str] = []
    lines = text.splitlines()
    for i, line in enumerate(lines):
        if line.startswith("***"):
            out.append(line)
        elif line.startswith("@@"):
            out.append(line)
            if i + 1 < len(lines) and lines[i + 1].startswith("+"):
                anchor = line.replace("@@", "")
                out.append(anchor if anchor[:1] in ("+", "-", " ") else f" {anchor}")
        elif line == "---" or line[:1] not in ("+", "-", " "):
            out.append(f" {line}")
        else:
            out.append(line)
    return out


def parse(text: str) -> dict[str, Action]:
    """The actions of a patch by path."""
    lines = prepared(text)
    if not lines or not lines[0].rstrip("\r").startswith("*** Begin Patch"):
        raise PatchError("a patch must start with *** Begin Patch")
    if lines[-1].rstrip("\r") != "*** End Patch":
        raise PatchError("a patch must end with *** End Patch")
    actions: dict[str, Action] = {}
    current: Action | None = None
    for line in lines[1:-1]:
        bare = line.rstrip("\r")
        header = next((k for k in ("Update", "Delete", "Add") if bare.startswith(f"*** {k} File: ")), None)
        if header:
            path = bare[len(f"*** {header} File: ") :]
            if path in actions:
                raise PatchError(f"duplicate {header.lower()} for file: {path}")
            current = actions[path] = Action(header.upper())
        elif bare.startswith("*** Move to: ") and current and current.kind == "UPDATE" and not current.body:
            current.move_path = bare[len("*** Move to: ") :]
        elif current and current.kind == "UPDATE":
            current.body.append(line)
        elif current and current.kind == "ADD" and line.startswith("+"):
            current.body.append(line[1:])
        elif bare.strip():
            raise PatchError(f"unknown or malformed line: {bare.strip()!r}")
    return actions


def hunks(body: list[str]) -> Iterator[Hunk]:
    """The hunks of an update, parted by @@ and *** End of File; parts without a change give none."""
    part: list[str] = []
    for line in [*body, "@@"]:
        if line.startswith("@@") or line.rstrip("\r") == "*** End of File":
            hunk = hunk_of(part)
            if hunk.edits:
                yield hunk
            part = []
        else:
            part.append(line)


def hunk_of(part: list[str]) -> Hunk:
    """Kept lines behind the last change are not looked for."""
    out, waiting = Hunk(), []
    deleted: list[str] = []
    inserted: list[str] = []

    def close() -> None:
        if deleted or inserted:
            out.edits.append((len(out.context) - len(deleted), deleted[:], inserted[:]))
            deleted.clear()
            inserted.clear()

    for line in part:
        mark, content = line[:1] or " ", line[1:]
        if mark == " ":
            close()
            waiting.append(content)
            continue
        if mark not in "+-":
            raise PatchError(f"a line of an update must start with +, - or a space: {line!r}")
        out.context += waiting
        waiting.clear()
        if mark == "-":
            deleted.append(content)
            out.context.append(content)
        else:
            inserted.append(content)
    close()
    return out


def locate(lines: list[str], context: list[str], start: int) -> int:
    """Where context stands in lines from start on: exactly, without spaces at the end, without any around; or -1."""
    if not context:
        return start
    for form in (str, str.rstrip, str.strip):
        want = [form(c) for c in context]
        for i in range(start, len(lines) - len(context) + 1):
            if form(lines[i]) == want[0] and [form(x) for x in lines[i : i + len(context)]] == want:
                return i
    return -1


def updated(text: str, body: list[str], path: str = "") -> str:
    """text after the hunks of an update; a final newline stays."""
    lines, at = text.splitlines(), 0
    if body and body[0].startswith("@@ ") and (anchor := body[0][3:].strip()):
        at = locate(lines, [anchor], 0)
        if at < 0:
            raise PatchError(f"{path}: no line like {anchor!r}")
    edits = []
    for hunk in hunks(body):
        found = locate(lines, hunk.context, at)
        found = locate(lines, hunk.context, 0) if found < 0 else found
        if found < 0:
            raise PatchError(f"{path}: context not found: " + " | ".join(hunk.context))
        edits += [(found + i, deleted, inserted) for i, deleted, inserted in hunk.edits]
        at = found + len(hunk.context)
    out, done = [], 0
    for i, deleted, inserted in sorted(edits, key=lambda e: e[0]):
        if i > len(lines):
            raise PatchError(f"{path}: a change lies beyond the end of the file")
        if i < done:
            raise PatchError(f"{path}: changes overlap at line {i + 1}")
        out += lines[done:i] + inserted
        done = i + len(deleted)
    made = "\n".join(out + lines[done:])
    return made + "\n" if text.endswith("\n") or (not text and made) else made


def changes(patch: str, files: dict[str, str]) -> list[tuple[str, str, str | None, str | None]]:
    """(path, action, new content, move path) of a patch on files."""
    out = []
    for path, action in parse(patch).items():
        if action.kind == "ADD":
            if path in files:
                raise PatchError(f"file to be added exists: {path}")
            content = "\n".join(action.body)
            out.append((path, "ADD", content + "\n" if content else content, None))
        elif path not in files:
            raise PatchError(f"file to be changed does not exist: {path}")
        elif action.kind == "DELETE":
            out.append((path, "DELETE", None, None))
        else:
            if action.move_path in files and action.move_path != path:
                raise PatchError(f"move target exists: {action.move_path}")
            out.append((path, "UPDATE", updated(files[path], action.body, path), action.move_path))
    return out


def applied(patches: DataFrame, files: DataFrame) -> DataFrame:
    """(patch_id, path, action, new_content, move_path, error) of patches (patch_id, text) on files (path, content).

    Each text may hold several patches; they apply to the files as given.  One that fails is one row with an error.
    Only the files that a patch names are joined to it.
    """
    each = patches.select("patch_id", F.posexplode(B.patches(F.col("text"))).alias("part", "patch"))
    named = each.select("patch_id", "part", F.explode(F.array_union(B.files_needed(F.col("patch")), B.files_added(F.col("patch")))).alias("path"))
    moved = each.select("patch_id", "part", F.explode(F.regexp_extract_all("patch", F.lit(r"(?m)^\*\*\* Move to: ([^\r\n]*)"), F.lit(1))).alias("path"))
    held = named.unionByName(moved).distinct().join(files.select("path", "content"), "path").groupBy("patch_id", "part").agg(F.collect_list(F.struct("path", "content")).alias("files"))
    rows = each.join(held, ["patch_id", "part"], "left").select("patch_id", "patch", "files")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples():
                try:
                    out += [(r.patch_id, *c, None) for c in changes(r.patch, {f["path"]: f["content"] for f in (r.files if r.files is not None else [])})]
                except PatchError as e:
                    out.append((r.patch_id, None, None, None, None, str(e)))
            yield pd.DataFrame(out, columns=["patch_id", "path", "action", "new_content", "move_path", "error"])

    return rows.mapInPandas(run, CHANGES)
