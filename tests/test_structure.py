"""Paths, trees, references, graphs, completion and changed files on small tables."""

from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import complete as C
from loomgraph.operators import graph as G
from loomgraph.operators import history as H
from loomgraph.operators import incremental as I
from loomgraph.operators import paths as P
from loomgraph.operators import resolve as R
from loomgraph.operators import tree as T
from loomgraph.sources import files as S
from loomgraph.sources import parse_python, parse_typescript


@pytest.mark.parametrize(("path", "want"), [("a/b/c.py", "a.b.c"), ("a\\b.ts", "a.b"), ("x.py", "x"), ("noext", "noext"), (".hidden/x.py", ".hidden.x"), (".env", ".env")])
def test_stems(spark, path, want):
    assert spark.createDataFrame([(path,)], "p string").select(P.file_stem(F.col("p"))).first()[0] == want


def test_ids(spark):
    one = spark.range(1)
    value = lambda c: one.select(c).first()[0]
    assert value(P.unique_id(F.lit("a/b.py"), F.lit("f"))) == "a.b.f" and value(P.unique_id(F.lit("a.py"), F.lit("f"), F.lit("own"))) == "own"
    assert value(P.member_id(F.lit("m.C"), F.lit("v"), F.lit(True), F.array(F.lit("@v.setter")))) == "m.C.v@v.setter"
    assert [value(P.as_dependency(F.lit(a), F.lit(n), F.lit("s"))) for a, n in (("al", "n"), ("", "n"), ("", ""))] == ["al", "n", "s"]


FILES = ["src/a/x.py", "src/a/y.py", "src/b/z.py", "src/b/deep/w.py", "docs/r.md", "top.txt"]


def test_tree(spark):
    tree = T.build(spark.createDataFrame([(f,) for f in FILES], "path string"))
    lines = [r.line for r in T.rendered(tree).orderBy("line_no").collect()]
    assert lines == ["├── docs", "│   └── r.md", "├── src", "│   ├── a", "│   │   ├── x.py", "│   │   └── y.py", "│   └── b", "│       ├── deep", "│       │   └── w.py", "│       └── z.py", "└── top.txt"]
    wanted = spark.createDataFrame([("src/a/x.py",)], "path string")
    slim = [r.line for r in T.rendered(T.filtered(tree, wanted)).orderBy("line_no").collect()]
    assert slim == ["├── src", "│   ├── a", "│   │   ├── x.py", "│   │   └── y.py", "│   └── ...", "└── ..."]
    wide = {r.path for r in T.filtered(tree, wanted, slim=False).collect()}
    assert {"src/b", "src/a/y.py", "./...", "src/b/..."} <= wide and "src/b/z.py" not in wide
    assert {r.parent: r.children for r in T.children(tree).collect()}["src/b"] == ["deep", "z.py"]


def graph(spark):
    rows = [("a", "b", "type_hint", 0), ("a", "c", None, 1), ("b", "d", None, 0), ("c", "d", "inheritance", 0), ("d", "a", None, 0), ("d", None, None, 1), ("c", "lost", None, 1)]
    return spark.createDataFrame(rows, "src_id string, dst_id string, ref_type string, ordinal int")


def test_neighbourhood(spark):
    ids = spark.createDataFrame([("a", 0)], "id string, pos int")
    reach = lambda degree: {r.id: (r.depth, r.ref_type) for r in G.neighbourhood(ids, graph(spark), degree).collect()}
    assert reach(0) == {"a": (0, None)}
    assert reach(1) == {"a": (0, None), "b": (1, "type_hint"), "c": (1, None)}
    assert reach(5) == {"a": (0, None), "b": (1, "type_hint"), "c": (1, None), "d": (2, "inheritance"), "lost": (2, None)}
    order = [r.id for r in G.neighbourhood(ids, graph(spark), 3).orderBy("depth", "place").collect()]
    assert order == ["a", "b", "c", "d", "lost"]
    with pytest.raises(ValueError, match="degree"):
        G.neighbourhood(ids, graph(spark), -1)


def test_neighbourhood_cuts_files(spark):
    ids = spark.createDataFrame([("a", 0)], "id string, pos int")
    elements = spark.createDataFrame([(x, f"{x}.py") for x in "abcd"], "unique_id string, file_path string")
    cut = spark.createDataFrame([("b.py",), ("c.py",), ("a.py",)], "file_path string")
    assert {r.id for r in G.neighbourhood(ids, graph(spark), 3, cut, elements).collect()} == {"a"}


PYTHON = '''import os
from pkg import thing as t, other
try:
    LIMIT: int = 3
except Exception:
    pass

class Base(t, other):
    """Base doc."""
    size: int = 1

    def __init__(self, n: int, *, deep=2):
        self.n = n

    @property
    def v(self) -> int:
        return self.n

    @v.setter
    def v(self, x: int):
        self.n = x

@dec
async def run(a: int, b: str = "x") -> Base:
    """Doc."""
    return Base(os.cpu_count())

made = run(1)
'''


def test_python_parser():
    r = parse_python.read("src/m.py", PYTHON)
    by = {e["unique_id"]: e for e in r.elements}
    assert list(by) == ["src.m.LIMIT", "src.m.Base", "src.m.Base.size", "src.m.Base.__init__", "src.m.Base.v", "src.m.Base.v@v.setter", "src.m.run", "src.m.made"]
    assert by["src.m.Base"]["bases"] == ["t", "other"] and by["src.m.Base"]["docstring"].endswith('"""Base doc."""')
    run = by["src.m.run"]
    assert run["modifiers"] == ["async"] and run["decorators"] == ["@dec"] and run["return_type"] == "Base" and run["raw"].startswith("@dec\nasync def run")
    assert [(p["name"], p["type_hint"], p["default_value"], p["is_optional"]) for p in run["parameters"]] == [("a", "int", None, False), ("b", "str", '"x"', True)]
    assert by["src.m.LIMIT"]["value"] == "3" and by["src.m.LIMIT"]["type_hint"] == "int"
    assert [(i["unique_id"], i["as_dependency"]) for i in r.imports] == [("os", "os"), ("pkg.thing", "t"), ("pkg.other", "other")]
    assert parse_python.read("x.py", "def broken(:") is None
    assert [i["unique_id"] for i in parse_python.read("a/b/c.py", "from ..d import e\nfrom . import f").imports] == ["a.d.e", "a.b.f"]


def test_typescript_parser():
    source = """import { A as B, C } from './mod';
import def from "pkg";
import 'side';
// not { this
interface User extends Base<string> { id: number; name?: string; greet(x: string): void; [key: string]: any }
type Mix = A & B & { z: number };
@dec()
export class K<T> extends P implements Q {
  private readonly a: string = "x;}";
  static async run(p: number, q?: string, r = 2, ...s: any[]): Promise<void> { if (p) { return; } }
}
export const f = async (a: number): Promise<number> => { return a; };
const n: number = 5;
"""
    r = parse_typescript.Reader("src/a.ts", source)
    by = {e["unique_id"]: e for e in r.elements}
    assert by["src.a.User"]["bases"] == ["Base"] and by["src.a.Mix"]["bases"] == ["A", "B"] and by["src.a.K"]["bases"] == ["P", "Q"]
    assert by["src.a.K"]["decorators"] == ["@dec()"] and by["src.a.K.a"]["modifiers"] == ["private", "readonly"] and by["src.a.User.name"]["type_hint"] == "string"
    run = by["src.a.K.run"]
    assert run["kind"] == "method" and run["modifiers"] == ["static", "async"] and run["return_type"] == "Promise<void>"
    assert [(p["name"], p["is_optional"]) for p in run["parameters"]] == [("p", False), ("q", True), ("r", True), ("...s", False)]
    assert by["src.a.f"]["kind"] == "function" and by["src.a.f"]["modifiers"] == ["export", "async"] and by["src.a.n"]["type_hint"] == ": number"
    assert [(i["source"], i["name"], i["alias"], i["import_type"]) for i in r.imports] == [("'./mod'", "A", "B", "relative"), ("'./mod'", "C", None, "relative"), ('"pkg"', "def", None, "absolute"), ("'side'", None, None, "side_effect")]


def test_references(spark):
    source = "import os\nclass Node:\n    size: int = 0\n    def grow(self, by: int):\n        return by\ndef make(n: Node):\n    return Node().grow(os.getpid())\nroot = make(1)\n"
    elements, imports = parse_python.parse(spark.createDataFrame([("m.py", source)], "path string, raw string"))
    got = {(r.src_id, r.dst_id) for r in R.find_references(elements, imports).collect()}
    assert {("m.make", "os"), ("m.make", "m.Node.grow"), ("m.root", "m.make")} <= got and ("m.make", "m.Node") not in got


WORDS = ["module.sub.function", "other_word", "src/app/main.py", "src/app", "Function"]


def test_completion(spark):
    words = spark.createDataFrame(list(enumerate(WORDS)), "pos int, word string")
    one = lambda *w: spark.createDataFrame([(x,) for x in w], "prefix string")
    assert [r.word for r in C.suggestions(words, one("SRC")).orderBy("rank").collect()] == ["src/app", "src/app/main.py"]
    assert [r.word for r in C.suggestions(words, one("func"), case_sensitive=True).collect()] == []
    assert [r.word for r in C.suggestions(words, one("func"), inside=True, k=1).collect()] == ["Function"]
    ids = spark.createDataFrame([("other_word",), ("other_wrod",), ("zzz",)], "code_identifier string")
    got = {r.code_identifier: r for r in C.validated(ids, words).collect()}
    assert got["other_word"].is_valid and got["other_wrod"].matching_identifiers[0] == "other_word" and got["zzz"].matching_identifiers == []


def test_extraction(spark):
    words = spark.createDataFrame(list(enumerate(WORDS)), "pos int, word string")
    texts = spark.createDataFrame([(1, "call Module.Sub.Function in app/main.py and othr_word"), (2, "")], "text_id long, text string")
    got = {(r.word, r.token, r.match_type) for r in C.extracted(texts, words, dotted=True).collect()}
    assert ("module.sub.function", "Module.Sub.Function", "exact") in got and ("src/app/main.py", "app/main.py", "subpath") in got and ("other_word", "othr_word", "fuzzy") in got
    score = next(r.score for r in C.extracted(texts, words, dotted=True).collect() if r.match_type == "fuzzy")
    assert score == pytest.approx(SequenceMatcher(None, "other_word", "othr_word").ratio())


def test_history(spark):
    turns = spark.createDataFrame([(1, 0, 5), (1, 1, 4), (1, 2, 3), (2, 0, 9)], "conv_id int, turn int, size int")
    assert {(r.conv_id, r.turn) for r in H.trimmed(turns, 7, F.col("size")).collect()} == {(1, 1), (1, 2)}
    steps = spark.createDataFrame([(1, 0, True, True), (1, 1, True, False), (1, 2, False, True), (1, 3, True, True)], "conv_id int, turn int, tool boolean, out boolean")
    assert [r.turn for r in H.reordered(steps, F.col("tool"), F.col("out")).orderBy("place").collect()] == [2, 0, 3]


def test_changes(spark):
    snap = lambda *r: spark.createDataFrame(list(r), "path string, mtime int")
    diff = I.snapshot_diff(snap(("a", 1), ("b", 1), ("c", 1)), snap(("a", 1), ("b", 2), ("d", 1)))
    assert {r.path: r.change for r in diff.collect()} == {"a": "same", "b": "modified", "c": "deleted", "d": "new"}
    held = spark.createDataFrame([("x", "1"), ("y", "2")], "path string, content string")
    move = spark.createDataFrame([("x", "UPDATE", "3", "y")], "path string, action string, new_content string, move_path string")
    with pytest.raises(Exception, match="move target exists"):
        I.committed(held, move).collect()


def test_scan(spark, tmp_path):
    for name, content in (("src/main.py", b"x = 1\n"), ("src/u.js", b"let a\n"), ("pic.png", b"\x89PNG"), ("bad.txt", b"\xff\xfe\x00")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(content)
    got = {r.path: r for r in S.scan(spark, str(tmp_path)).collect()}
    assert set(got) == {"src/main.py", "src/u.js", "pic.png", "bad.txt"}
    assert got["src/main.py"].language == "python" and got["src/main.py"].raw == "x = 1\n" and got["pic.png"].raw == S.PLACEHOLDER and not got["bad.txt"].is_text
    assert [r.path for r in S.scan(spark, str(tmp_path), ["python"]).collect()] == ["src/main.py"]
    assert S.git_paths(str(tmp_path)) is None
    names = spark.createDataFrame([("Dockerfile",), ("a/docker-compose.yml",), ("x.TSX",), ("y.unknown",)], "p string")
    assert [r[0] for r in names.select(S.language(F.col("p"))).collect()] == ["container", "yaml", "typescript", None]


def test_python_with_errors_and_stars():
    source = 'import os\n\ndef good(a, *rest: int, **more):\n    return a\n\ndef broken(:\n    pass\n\n@dec\nclass Kept:\n    x = 1\n\nTEXT = """\nnot code(\n"""\nlast = 2\n'
    r = parse_python.read("m.py", source)
    assert [e["unique_id"] for e in r.elements] == ["m.good", "m.Kept", "m.Kept.x", "m.TEXT", "m.last"] and r.imports[0]["unique_id"] == "os"
    by = {e["unique_id"]: e for e in r.elements}
    assert by["m.Kept"]["raw"].startswith("@dec\nclass Kept") and by["m.last"]["raw"] == "last = 2"
    assert [(p["name"], p["type_hint"]) for p in by["m.good"]["parameters"]] == [("a", None), ("*rest", "int"), ("**more", None)]
    assert parse_python.read("m.py", None) is None and parse_typescript.read("m.ts", None) is None


def test_hops_take_the_first_other_file(spark):
    schema = "file_path string, source string, name string, alias string, definition_id string, unique_id string"
    rows = [("a", "s", "n", None, "def.n", "via.n"), ("b", "s", "n", None, "def.m", "via.n"), ("c", "s", "n", None, "via.n", "x"), ("a", "s", "k", None, "via.n", "y"), ("c", "p", "q", None, "gone", "z")]
    elements = spark.createDataFrame([("def.n", "class"), ("def.m", "class")], "unique_id string, kind string")
    got = {(r.file_path, r.unique_id, r.definition_id) for r in R.resolve_imports(spark.createDataFrame(rows, schema), elements).collect()}
    assert got == {("a", "via.n", "def.n"), ("b", "via.n", "def.m"), ("c", "x", "def.n"), ("a", "y", "def.m"), ("c", "p.q", None)}
