"""Blocks, steps, fields and lists inside generated text, as columns.

A text is read as lines.  Marker lines give the spans of blocks, and what lies in a span is cut from the lines.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from .text import escape_regex

# The marks of blocks, and of the parts of a step.
BEGIN, END = "*** Begin ", "*** End "
RULE = "---"
INSTRUCTIONS, CONTEXT, MODIFY = "**instructions**:", "**context_identifiers**:", "**modify_identifiers**:"


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def spans(lines: Column, begins: Callable[[Column], Column], ends: Callable[[Column], Column]) -> Column:
    """array<struct<b, e>>: places (from 1) of each line that begins a span and of the next that ends one; a begin
    inside a span is content, an end outside one is none."""
    marks = F.transform(lines, lambda x, i: F.struct((i + 1).alias("at"), begins(x).alias("b"), ends(x).alias("e")))
    start = F.struct(F.lit(0).alias("open"), F.array().cast("array<struct<b:int,e:int>>").alias("found"))

    def step(state: Column, mark: Column) -> Column:
        closes = (state["open"] > 0) & mark["e"]
        opened = F.when(closes, 0).when((state["open"] == 0) & mark["b"], mark["at"]).otherwise(state["open"])
        more = F.when(closes, F.array_append(state["found"], F.struct(state["open"].alias("b"), mark["at"].alias("e")))).otherwise(state["found"])
        return F.struct(opened.cast("int").alias("open"), more.alias("found"))

    return F.aggregate(F.filter(marks, lambda m: m["b"] | m["e"]), start, step)["found"]


def between(lines: Column, first: Column, last: Column) -> Column:
    """The lines from place first up to place last, both included."""
    return F.slice(lines, first, F.greatest(last - first + 1, F.lit(0)))


def marked(lines: Column, word: str) -> Column:
    """Spans of marker lines of that word, which may have white space behind them."""
    is_mark = lambda mark: lambda x: F.regexp_replace(x, r"\s+$", "") == mark + word
    return spans(lines, is_mark(BEGIN), is_mark(END))


def blocks(text: Column, word: str = "Commit") -> Column:
    """What stands between each "*** Begin word" and "*** End word" at the start of a line, trimmed."""
    lines = lines_of(text)
    return F.transform(marked(lines, word), lambda s: stripped(F.array_join(between(lines, s["b"] + 1, s["e"] - 1), "\n")))


def steps(text: Column) -> Column:
    """array<struct<step, description, instructions, context_identifiers, modify_identifiers>> of the first Steps block.

    Steps are parted by lines of ---; each starts with a number and a bold description; others are left out.
    A part that a step lacks is empty.
    """
    lines = lines_of(text)
    block = F.get(marked(lines, "Steps"), F.lit(0))
    inside = F.coalesce(between(lines, block["b"] + 1, block["e"] - 1), F.array().cast("array<string>"))
    rules = F.transform(F.filter(F.transform(inside, lambda x, i: F.struct(x.alias("x"), (i + 1).alias("at"))), lambda p: F.trim(p["x"]) == RULE), lambda p: p["at"])
    edges = F.concat(F.array(F.lit(0)), rules, F.array(F.size(inside) + 1))
    items = F.transform(F.slice(edges, 2, F.size(edges) - 1), lambda e, i: between(inside, F.element_at(edges, i + 1) + 1, e - 1))
    items = F.transform(items, lambda item: F.filter(item, lambda x: F.trim(x) != ""))
    items = F.filter(items, lambda item: F.coalesce(F.get(item, F.lit(0)).rlike(r"^\s*\d+\.\s+\*\*.*?\*\*"), F.lit(False)))
    return F.transform(items, _step)


def _step(item: Column) -> Column:
    head = F.get(item, F.lit(0))
    at = lambda label: F.array_position(F.transform(item, lambda x: F.ltrim(x).startswith(label)), F.lit(True)).cast("int")

    def part(label: str, following: tuple[str, ...]) -> Column:
        """The lines of a part, without its label."""
        ends = F.array_min(F.filter(F.array(*[at(x) for x in following], F.size(item) + 1), lambda n: n > at(label)))
        own = between(item, at(label), ends - 1)
        bare = F.transform(own, lambda x, i: F.when(i == 0, F.replace(x, F.lit(label), F.lit(""))).otherwise(x))
        return F.when(at(label) > 0, bare).otherwise(F.array().cast("array<string>"))

    return F.struct(
        F.regexp_extract(head, r"(\d+)\.", 1).cast("int").alias("step"),
        stripped(F.regexp_extract(head, r"\*\*(.*?)\*\*", 1)).alias("description"),
        stripped(F.array_join(part(INSTRUCTIONS, (CONTEXT, MODIFY)), "\n")).alias("instructions"),
        dashed(part(CONTEXT, (MODIFY,))).alias("context_identifiers"),
        dashed(part(MODIFY, ())).alias("modify_identifiers"),
    )


def dashed(lines: Column) -> Column:
    """What stands behind the dash of lines that start with one."""
    return F.transform(F.filter(lines, lambda x: x.rlike(r"^\s*-\s*\S")), lambda x: stripped(F.regexp_replace(x, r"^\s*-", "")))


def field(text: Column, pattern: str, kind: str = "string") -> Column:
    """The first match of a pattern (its group 1 if it has one) as string, int, float, bool or list of all matches;
    null where there is none or it is not of the kind."""
    group = 1 if re.compile(pattern).groups else 0
    p = f"(?ms){pattern}"
    if kind == "list":
        return F.transform(F.regexp_extract_all(text, F.lit(p), F.lit(group)), stripped)
    value = F.when(text.rlike(p), stripped(F.regexp_extract(text, p, group)))
    if kind == "bool":
        return F.lower(value).isin("true", "1", "yes", "on")
    return value if kind == "string" else value.try_cast({"int": "bigint", "float": "double"}[kind])


def named_value(text: Column, name: str) -> Column:
    """The value of the first "NAME: [value]" or "NAME: value"; null without one."""
    return F.nullif(stripped(F.regexp_extract(text, rf"(?i){escape_regex(name)}:\s*\[?([^\]\n]*)\]?", 1)), F.lit(""))


def list_items(text: Column) -> Column:
    """The items of lines that start with a dash."""
    return dashed(lines_of(text))


def _begins_patch(line: Column) -> Column:
    return line.startswith("*** Begin Patch")


def _ends_patch(line: Column) -> Column:
    return F.regexp_replace(line, r"\r$", "") == "*** End Patch"


def patch_lines(text: Column) -> Column:
    """The lines between patch markers, with the markers; null without any.  The last may lack its end."""
    lines = lines_of(text)
    found = spans(F.concat(lines, F.array(F.lit("*** End Patch"))), _begins_patch, _ends_patch)
    whole = F.transform(found, lambda s: F.array_join(between(lines, s["b"], s["e"]), "\n"))
    return F.when(F.size(found) > 0, F.array_join(whole, "\n"))


def files_needed(patch: Column) -> Column:
    """Paths of the files that a patch updates or deletes."""
    return F.regexp_extract_all(patch, F.lit(r"(?m)^\*\*\* (?:Update|Delete) File: ([^\r\n]*)"), F.lit(1))


def files_added(patch: Column) -> Column:
    return F.regexp_extract_all(patch, F.lit(r"(?m)^\*\*\* Add File: ([^\r\n]*)"), F.lit(1))


def whole_patches(text: Column) -> Column:
    """Complete patch blocks, markers included."""
    lines = lines_of(text)
    block = lambda s: F.concat(F.array_join(between(lines, s["b"], s["e"] - 1), "\n"), F.lit("\n*** End Patch"))
    return F.transform(spans(lines, _begins_patch, _ends_patch), block)


@F.pandas_udf(ArrayType(StringType()))
def recovered_patches(text: pd.Series) -> pd.Series:
    """Patches of a text that has no complete block: from each begin marker to the next end marker or the end of
    the text, and from its start to each end marker that no begin marker precedes."""

    def recover(t: str) -> list[str]:
        begins = [m.start() for m in re.finditer(r"(?m)^\*\*\* Begin Patch", t)]
        ends = [m.start() + len("*** End Patch") for m in re.finditer(r"(?m)^\*\*\* End Patch", t)]
        out = [t[b : next((e for e in ends if e > b), len(t))] for b in begins]
        return out + [t[:e] for e in ends if not any(b < e for b in begins)]

    return text.map(recover, na_action="ignore")


def patches(text: Column) -> Column:
    whole = whole_patches(text)
    return F.when(F.size(whole) > 0, whole).otherwise(recovered_patches(text))
