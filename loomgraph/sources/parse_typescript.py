"""TypeScript files to element and import rows, by a lexer of brackets, strings and comments."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame

from .parse_python import FIELDS, stem, tables

NAME = r"[A-Za-z_$][\w$]*"
MODIFIERS = r"(?:export|default|declare|abstract|async|public|private|protected|static|readonly|override|get|set)"
TOP = re.compile(rf"(?P<mods>(?:{MODIFIERS}\s+)*)(?P<kw>class|interface|function\*?|type|enum|const|let|var)\s+(?P<name>{NAME})")
MEMBER = re.compile(rf"(?P<decs>(?:@[\w.]+(?:\([^)]*\))?\s*)*)(?P<mods>(?:{MODIFIERS}\s+)*)(?P<name>{NAME}|\[[^\]]+\])(?P<opt>[?!]?)\s*(?P<next>[(<:=;]|$)")
IMPORT = re.compile(r"import\s+(?:type\s+)?(?:(?P<what>[^'\"]+?)\s+from\s+)?(?P<source>'[^']*'|\"[^\"]*\")")


def behind(text: str, i: int) -> int:
    """The place behind the string or comment that starts at i; i itself if none does."""
    if text[i] in "'\"`":
        j = i + 1
        while j < len(text) and text[j] != text[i]:
            j += 1 + (text[j] == "\\")
        return min(j + 1, len(text))
    for start, end in (("//", "\n"), ("/*", "*/")):
        if text.startswith(start, i):
            j = text.find(end, i + 2)
            return len(text) if j < 0 else j + (len(end) if end == "*/" else 0)
    return i


def pieces(text: str, ends: str = ";\n") -> Iterator[tuple[int, int]]:
    """(start, end) of statements: cut at line ends and semicolons outside brackets, strings and comments."""
    depth, start, i = 0, 0, 0
    while i < len(text):
        if (j := behind(text, i)) > i:
            i = j
            continue
        c = text[i]
        depth += (c in "([{") - (c in ")]}")
        if c == "}" and depth == 0 and not re.match(r"\s*([=;,.)\]|&:]|from\b)", text[i + 1 :]):
            yield start, i + 1
            start = i + 1
        elif c in ends and depth <= 0 and not (c == "\n" and continues(text[start:i], text[i + 1 :].lstrip())):
            yield start, i + (c == ";")
            start = i + 1
        i += 1
    yield start, len(text)


def continues(before: str, after: str) -> bool:
    """Whether a line end between the two doesn't end a statement."""
    return after[:1] in ("|", "&", ".", "{", "=", "?") or before.rstrip().endswith(("=", "|", "&", ",", "=>", "extends", "implements")) or bool(re.fullmatch(r"\s*(@[\w.]+(\([^)]*\))?\s*)+", before))


def split_list(text: str) -> list[str]:
    """A list cut at its outer commas."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(text):
        depth += c in "([{<"
        depth -= c in ")]}" or (c == ">" and text[i - 1] != "=")
        if c == "," and depth == 0:
            out.append(text[start:i].strip())
            start = i + 1
    return [x for x in [*out, text[start:].strip()] if x]


def balanced(text: str, at: int) -> int:
    """The place behind the bracket that closes the one at `at`."""
    depth, i = 0, max(at, 0)
    while i < len(text):
        if (j := behind(text, i)) > i:
            i = j
            continue
        depth += (text[i] in "([{") - (text[i] in ")]}")
        i += 1
        if depth == 0:
            return i
    return len(text)


def parameters(text: str) -> list[dict]:
    out = []
    for p in split_list(text):
        m = re.match(rf"(?:{MODIFIERS}\s+)*(?P<name>(?:\.\.\.)?{NAME}|[{{\[].*?[}}\]])(?P<opt>\??)\s*(?::\s*(?P<hint>[^=]+(?:=>[^=]+)?))?(?:=\s*(?P<value>.+))?$", p, re.S)
        if m:
            value = m["value"].strip() if m["value"] else None
            out.append({"name": m["name"], "type_hint": m["hint"].strip() if m["hint"] else None, "default_value": value, "is_optional": bool(value or m["opt"])})
    return out


class Reader:
    def __init__(self, path: str, source: str):
        self.path, self.stem = path, stem(path)
        self.elements: list[dict] = []
        self.imports: list[dict] = []
        for a, b in pieces(source):
            self.statement(source[a:b].strip())

    def add(self, kind: str, name: str, parent: str | None, raw: str, **more) -> str:
        unique = f"{parent or self.stem}.{name}"
        row = dict.fromkeys(FIELDS) | {"unique_id": unique, "kind": kind, "file_path": self.path, "parent_id": parent, "name": name, "raw": raw, "modifiers": [], "decorators": [], "bases": [], "parameters": [], "hints": [], "ordinal": len(self.elements)}
        self.elements.append(row | more)
        return unique

    def statement(self, raw: str) -> None:
        if m := IMPORT.match(raw):
            self.bind(m["what"], m["source"], raw)
            return
        decorators = re.match(r"(?:@[\w.]+(?:\([^)]*\))?\s*)*", raw).group(0)
        m = TOP.match(raw, len(decorators))
        if not m:
            return
        mods, rest = m["mods"].split(), raw[m.end() :]
        if m["kw"] in ("class", "interface", "type", "enum"):
            brace = rest.find("{")
            head = rest[: brace if brace >= 0 else len(rest)]
            bases = [re.sub(r"<.*", "", b, flags=re.S) for group in re.findall(r"(?:extends|implements)\s+(.*?)(?=\bimplements\b|$)", head, re.S) for b in split_list(group)]
            if m["kw"] == "type":
                bases = [b for b in re.findall(rf"(?:^|[&=])\s*({NAME})\s*(?=$|[&;{{])", re.sub(r"\{.*\}", "", rest.rstrip(";"), flags=re.S).strip())]
            own = self.add("class", m["name"], None, raw, modifiers=mods, bases=bases, decorators=decorators.split())
            if brace >= 0 and m["kw"] != "enum":
                body = rest[brace + 1 : balanced(rest, brace) - 1]
                for a, b in pieces(body, ";\n,"):
                    self.member(body[a:b].strip().rstrip(",;"), own)
        elif m["kw"].startswith("function"):
            self.signature("function", m["name"], None, raw, rest, mods, decorators.split())
        else:
            arrow = re.match(r"\s*(?::[^=]+)?=\s*(?:async\s*)?(?=\()", rest)
            if arrow and re.match(r"\s*(?::[^={]+)?=>", rest[balanced(rest, arrow.end()) :]):
                self.signature("function", m["name"], None, raw, rest[arrow.end() :], mods + (["async"] if "async" in arrow.group(0) else []), [])
            else:
                v = re.match(r"\s*(?P<hint>:[^=]+)?(?:=\s*(?P<value>.*))?$", rest.rstrip(";"), re.S)
                hint = v["hint"].strip() if v and v["hint"] else None
                self.add("variable", m["name"], None, raw, modifiers=[*mods, m["kw"]], type_hint=hint, value=v["value"].strip() if v and v["value"] else None, hints=[hint.lstrip(": ")] if hint else [])

    def member(self, raw: str, parent: str) -> None:
        m = MEMBER.match(raw)
        if not m or raw.startswith(("//", "/*")):
            return
        mods, rest = m["mods"].split(), raw[m.end() - len(m["next"]) :]
        if m["next"] in ("(", "<"):
            self.signature("method", m["name"], parent, raw, rest, mods, m["decs"].split())
        else:
            v = re.match(r"(?::\s*(?P<hint>[^=]+(?:=>[^=]+)?))?(?:=\s*(?P<value>.*))?$", rest, re.S)
            hint = v["hint"].strip() if v and v["hint"] else None
            self.add("attribute", m["name"], parent, raw, modifiers=mods, type_hint=hint, value=v["value"].strip() if v and v["value"] else None, hints=[hint] if hint else [], decorators=m["decs"].split())

    def signature(self, kind: str, name: str, parent: str | None, raw: str, rest: str, mods: list[str], decorators: list[str]) -> None:
        at = rest.find("(")
        end = balanced(rest, at)
        found = parameters(rest[at + 1 : end - 1])
        returns = re.match(r"\s*:\s*([^{=;]+)", rest[end:])
        returned = returns.group(1).strip() if returns else None
        hints = [p["type_hint"] for p in found if p["type_hint"]] + ([returned] if returned else [])
        self.add(kind, name, parent, raw, modifiers=mods, decorators=decorators, parameters=found, return_type=returned, hints=hints)

    def bind(self, what: str | None, source: str, raw: str) -> None:
        kind = "side_effect" if not what else "relative" if source[1] == "." else "absolute"
        names: list[tuple[str | None, str | None]] = []
        for part in split_list(re.sub(r"\{(.*)\}", r"\1", what or "", flags=re.S)):
            name, _, alias = part.removeprefix("type ").partition(" as ")
            names.append((name.strip(), alias.strip() or None))
        for name, alias in names or [(None, None)]:
            unique = ".".join(filter(None, (source.strip("'\""), name if name != "*" else None)))
            self.imports.append({"unique_id": unique, "file_path": self.path, "source": source, "name": name, "alias": alias, "import_type": kind, "definition_id": unique, "as_dependency": alias or name or source, "raw": raw, "ordinal": len(self.imports)})


def read(path: str, source: str | None) -> Reader | None:
    """The elements of a file; null where it has no text or can't be read, which leaves its file row."""
    if source is None:
        return None
    try:
        return Reader(path, source.replace("\r\n", "\n"))
    except (ValueError, IndexError, AttributeError, TypeError, RecursionError):
        return None


def parse(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(elements, imports) of TypeScript files (path, raw)."""
    return tables(files, read)
