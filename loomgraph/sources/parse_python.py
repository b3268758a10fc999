"""Python files to element and import rows."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructField, StructType

PARAMETER = "struct<name: string, type_hint: string, default_value: string, is_optional: boolean>"
ELEMENTS = f"unique_id string, kind string, file_path string, parent_id string, name string, raw string, docstring string, type_hint string, value string, modifiers array<string>, decorators array<string>, bases array<string>, parameters array<{PARAMETER}>, return_type string, hints array<string>, ordinal int"
IMPORTS = "unique_id string, file_path string, source string, name string, alias string, import_type string, definition_id string, as_dependency string, raw string, ordinal int"
FIELDS = [c.strip().split(" ")[0] for c in ELEMENTS.replace(PARAMETER, "p").split(", ")]
LONGEST = 40  # pieces tried as one where a file has errors


def stem(path: str) -> str:
    cut = path.rpartition(".")[0] or path
    return cut.replace("\\", ".").replace("/", ".")


class Reader(ast.NodeVisitor):
    """Walks the module level, also inside if, try and with; functions and classes are not entered further."""

    def __init__(self, path: str, source: str):
        self.path, self.source, self.stem = path, source, stem(path)
        self.elements: list[dict] = []
        self.imports: list[dict] = []
        self.taken: set[str] = set()

    def text(self, node: ast.AST | None, decorated: bool = False) -> str | None:
        if node is None:
            return None
        first = min([node.lineno, *(d.lineno for d in getattr(node, "decorator_list", ()))]) if decorated else node.lineno
        if isinstance(node, ast.expr):
            return ast.get_source_segment(self.source, node)
        return "\n".join(self.source.split("\n")[first - 1 : node.end_lineno])

    def add(self, kind: str, name: str, parent: str | None, node: ast.AST, **more) -> str:
        unique = f"{parent or self.stem}.{name}"
        taken = unique in self.taken
        decorators = [f"@{self.text(d)}" for d in getattr(node, "decorator_list", ())]
        if taken and decorators:
            unique += "".join(decorators)
        row = dict.fromkeys(FIELDS) | {"unique_id": unique, "kind": kind, "file_path": self.path, "parent_id": parent, "name": name, "raw": self.text(node, True), "modifiers": [], "decorators": decorators, "bases": [], "parameters": [], "hints": [], "ordinal": len(self.elements)}
        self.elements.append(row | more)
        self.taken.add(unique)
        return unique

    def visit_Import(self, node: ast.Import) -> None:
        for a in node.names:
            self.bind(a.name, None, a.asname, "absolute", node)

    def visit_ImportFrom(self, node: ast.ImportFrom) -> None:
        source = node.module or ""
        if node.level:
            package = self.path.replace("\\", "/").split("/")[: -node.level]
            source = ".".join(filter(None, [*package, source]))
        for a in node.names:
            self.bind(source, a.name, a.asname, "relative" if node.level else "absolute", node)

    def bind(self, source: str, name: str | None, alias: str | None, kind: str, node: ast.AST) -> None:
        unique = ".".join(filter(None, (source, name)))
        self.imports.append({"unique_id": unique, "file_path": self.path, "source": source, "name": name, "alias": alias, "import_type": kind, "definition_id": unique, "as_dependency": alias or name or source, "raw": self.text(node), "ordinal": len(self.imports)})

    def assign(self, node: ast.Assign | ast.AnnAssign, parent: str | None = None) -> None:
        hint = self.text(getattr(node, "annotation", None))
        for target in node.targets if isinstance(node, ast.Assign) else [node.target]:
            name = target.id if isinstance(target, ast.Name) else self.text(target)
            self.add("attribute" if parent else "variable", name, parent, node, type_hint=hint, value=self.text(node.value), hints=[hint] if hint else [])

    def visit_Assign(self, node: ast.Assign) -> None:
        self.assign(node)

    visit_AnnAssign = visit_Assign

    def function(self, node: ast.FunctionDef | ast.AsyncFunctionDef, parent: str | None = None) -> None:
        args = [*node.args.posonlyargs, *node.args.args]
        defaults = [None] * (len(args) - len(node.args.defaults)) + node.args.defaults
        pairs = [*zip(args, defaults), *zip(node.args.kwonlyargs, node.args.kw_defaults)]
        parameters = [{"name": a.arg, "type_hint": self.text(a.annotation), "default_value": self.text(d), "is_optional": d is not None} for a, d in pairs if not (parent and a.arg in ("self", "cls") and a.annotation is None)]
        for stars, rest in (("*", node.args.vararg), ("**", node.args.kwarg)):
            if rest is not None:
                parameters.append({"name": stars + rest.arg, "type_hint": self.text(rest.annotation), "default_value": None, "is_optional": True})
        returns = self.text(node.returns)
        hints = [p["type_hint"] for p in parameters if p["type_hint"]] + ([returns] if returns else [])
        self.add("method" if parent else "function", node.name, parent, node, modifiers=["async"] if isinstance(node, ast.AsyncFunctionDef) else [], parameters=parameters, return_type=returns, hints=hints, docstring=self.docstring(node))

    def visit_FunctionDef(self, node: ast.FunctionDef) -> None:
        self.function(node)

    visit_AsyncFunctionDef = visit_FunctionDef

    def docstring(self, node: ast.AST) -> str | None:
        """The lines up to and with the docstring."""
        if ast.get_docstring(node, clean=False) is None:
            return None
        return "\n".join(self.source.split("\n")[node.lineno - 1 : node.body[0].end_lineno])

    def visit_ClassDef(self, node: ast.ClassDef) -> None:
        own = self.add("class", node.name, None, node, bases=[self.text(b) for b in node.bases], docstring=self.docstring(node))
        for item in node.body:
            if isinstance(item, (ast.FunctionDef, ast.AsyncFunctionDef)):
                self.function(item, own)
            elif isinstance(item, (ast.Assign, ast.AnnAssign)):
                self.assign(item, own)


def parts(source: str) -> Iterator[tuple[int, list[ast.stmt]]]:
    """(lines ahead, statements) of a source with errors: it is cut where a line starts at the margin, and the longest
    runs of such pieces that can be parsed are taken, so an error costs the statement that it is in."""
    lines = source.split("\n")
    starts = [i for i, x in enumerate(lines) if x[:1] not in ("", " ", "\t", "#", ")", "]", "}") and not re.match(r"(else|elif|except|finally)\b", x)]
    edges = [*starts, len(lines)]
    at = 0
    while at < len(starts):
        for end in range(min(at + LONGEST, len(starts)), at, -1):  # a string or a decorator may go on at the margin
            try:
                yield edges[at], ast.parse("\n".join(lines[edges[at] : edges[end]])).body
                break
            except (SyntaxError, ValueError):
                continue
        else:
            end = at + 1
        at = end


def read(path: str, source: str | None) -> Reader | None:
    """The elements of a file; of one with errors those that can be parsed; null where there are none or no text."""
    if source is None:
        return None
    reader = Reader(path, source.replace("\r\n", "\n").replace("\r", "\n"))
    try:
        reader.visit(ast.parse(reader.source))
    except (SyntaxError, ValueError):
        for ahead, body in parts(reader.source):
            for node in body:
                reader.visit(ast.increment_lineno(node, ahead))
        return reader if reader.elements or reader.imports else None
    except RecursionError:
        return None
    return reader


def tables(files: DataFrame, reader) -> tuple[DataFrame, DataFrame]:
    """(elements, imports) of files (path, raw), by reader(path, raw), an object with lists of both or null.

    Each file is read once: what is found is kept in one table of rows of either kind.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [r for r in map(reader, *(batch.column(c).to_pylist() for c in ("path", "raw"))) if r]
            elements, imports = ([x for r in found for x in getattr(r, which)] for which in ("elements", "imports"))
            none = [None] * len(imports), [None] * len(elements)
            columns = zip((elements + none[0], none[1] + imports), kinds)
            yield pa.record_batch([pa.array(values, kind) for values, kind in columns], names=["e", "i"])

    schemas = [StructType.fromDDL(x) for x in (ELEMENTS, IMPORTS)]
    kinds = [to_arrow_type(x) for x in schemas]
    rows = files.select("path", "raw").mapInArrow(run, StructType([StructField("e", schemas[0]), StructField("i", schemas[1])])).persist()
    return rows.where("e IS NOT NULL").select("e.*"), rows.where("i IS NOT NULL").select("i.*")


def parse(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(elements, imports) of Python files (path, raw); partitions are as the scan made them."""
    return tables(files, read)
