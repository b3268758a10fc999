"""Patches, blocks, steps and marker streams."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from loomgraph.functions import blocks as B
from loomgraph.operators import patch as P
from loomgraph.streaming import markers as M

FILE = "def hello():\n    print('Hello')\n\ndef bye():\n    print('Bye')\n"


def patch(body: str) -> str:
    return f"*** Begin Patch\n{body}\n*** End Patch"


def result(body: str, files: dict | None = None) -> dict:
    return {c[0]: c[1:] for c in P.changes(patch(body), files if files is not None else {"m.py": FILE})}


@pytest.mark.parametrize(("hunk", "want"), [
    (" def hello():\n-    print('Hello')\n+    print('Hi')", FILE.replace("Hello", "Hi")),
    ("@@ def bye():\n def bye():\n-    print('Bye')", "def hello():\n    print('Hello')\n\ndef bye():\n"),
    ("@@\n def hello():\n+    x = 1\n     print('Hello')", FILE.replace("hello():\n", "hello():\n    x = 1\n")),
    ("-def hello():   \n+def hi():", FILE.replace("hello", "hi")),
    (" def hello():\n-print('Hello')\n+    pass", FILE.replace("print('Hello')", "pass")),
    ("@@\n-def hello():\n+def a():\n@@\n-def bye():\n+def b():\n*** End of File", FILE.replace("hello", "a").replace("bye", "b")),
    ("@@ def bye():\n+# note", FILE.replace("def bye():\n", "def bye():\n# note\n")),
])
def test_updates(hunk, want):
    assert result(f"*** Update File: m.py\n{hunk}")["m.py"] == ("UPDATE", want, None)


def test_other_actions():
    assert result("*** Add File: n/x.py\n+a\n+b") == {"n/x.py": ("ADD", "a\nb\n", None)}
    assert result("*** Delete File: m.py") == {"m.py": ("DELETE", None, None)}
    moved = result("*** Update File: m.py\n*** Move to: k.py\n-def hello():\n+def hi():")
    assert moved["m.py"] == ("UPDATE", FILE.replace("hello", "hi"), "k.py")
    assert P.changes(patch("*** Update File: m.py\n-a\n+b").replace("\n", "\r\n"), {"m.py": "a\nc\n"})[0][2] == "b\nc\n"


@pytest.mark.parametrize(("text", "message"), [
    ("*** Update File: m.py\n+x\n*** End Patch", "must start"),
    ("*** Begin Patch\n*** Delete File: m.py", "must end"),
    (patch("*** Update File: gone.py\n-a\n+b"), "does not exist"),
    (patch("*** Add File: m.py\n+x"), "exists"),
    (patch("*** Delete File: m.py\n*** Delete File: m.py"), "duplicate"),
    (patch("*** Update File: m.py\n-nothing like it\n+b"), "context not found"),
    (patch("hello"), "malformed"),
    (patch("*** Update File: m.py\n*** Move to: t.py\n-def hello():\n+x"), "move target"),
])
def test_errors(text, message):
    with pytest.raises(P.PatchError, match=message):
        P.changes(text, {"m.py": FILE, "t.py": ""})


def test_applied(spark):
    texts = [(1, "do\n" + patch("*** Update File: m.py\n-def hello():\n+def hi():") + "\nand\n" + patch("*** Add File: z\n+1")), (2, patch("*** Delete File: gone"))]
    got = P.applied(spark.createDataFrame(texts, "patch_id long, text string"), spark.createDataFrame([("m.py", FILE)], "path string, content string")).collect()
    assert sorted((r.patch_id, r.path or "", r.action or "", r.error is None) for r in got) == [(1, "m.py", "UPDATE", True), (1, "z", "ADD", True), (2, "", "", False)]


def test_recovered_patches(spark):
    texts = ["x\n*** Begin Patch\nabc", "abc\n*** End Patch\ny", "*** End Patch\n*** Begin Patch\nq", "none"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(B.patches(F.col("t"))).collect()]
    assert got == [["*** Begin Patch\nabc"], ["abc\n*** End Patch"], ["*** Begin Patch\nq", "*** End Patch"], []]


def test_blocks_and_steps(spark):
    text = "*** Begin Commit  \n fix: a \n*** End Commit\n *** Begin Commit\nno\n *** End Commit\n*** Begin Commit\nb\n*** End Commit"
    md = "*** Begin Steps\n1. **Do it**\n   **instructions**: first\nsecond\n   **context_identifiers**:\n     - a.b\n     - c\n   **modify_identifiers**:\n     - d\n---\nnot a step\n---\n2. **More**\n**instructions**: x\n**context_identifiers**:\n**modify_identifiers**:\n*** End Steps"
    r = spark.createDataFrame([(text, md)], "t string, m string").select(B.blocks(F.col("t")), B.steps(F.col("m"))).first()
    assert r[0] == ["fix: a", "b"]
    assert [tuple(s) for s in r[1]] == [(1, "Do it", "first\nsecond", ["a.b", "c"], ["d"]), (2, "More", "x", [], [])]


TEXT = "intro\n*** Begin Commit\nfix a\n*** End Commit\nmiddle *** Begin Steps\n- one\n- two\n*** End Steps\nend *** Beg"
WANT = [(0, "", "intro\n", True), (0, "commit", "fix a\n", True), (1, "", "middle ", True), (1, "steps", "- one\n- two\n", True), (2, "", "end *** Beg", True)]


def fed(chunks, markers=M.DEFAULT):
    machine = M.Machine(markers)
    rows = pd.DataFrame({"seq": range(len(chunks)), "chunk": chunks})
    return [f[:4] for f in M.joined([*M.run(machine, rows), *machine.finish()])]


def test_chunks_may_be_cut_anywhere():
    for size in range(1, 51):
        assert fed([TEXT[i : i + size] for i in range(0, len(TEXT), size)]) == WANT


def test_streamed_incomplete_and_fields():
    markers = (M.Marker("log", "<a>", "</a>", stream=True), M.Marker("item", "<b>", "</b>", fields=(("name", r"name: (\w+)"),)))
    for size in (1, 3, 100):
        text = "x<a>12345</a><b>name: joe</b><b>open"
        got = fed([text[i : i + size] for i in range(0, len(text), size)], markers)
        assert got == [(0, "", "x", True), (0, "log", "12345", False), (1, "item", "name: joe", True), (2, "item", "open", False)]
    assert markers[1].extract("name: joe") == {"name": "joe"}


def test_state_survives_and_repeats_do_not_count():
    machine = M.Machine()
    out = []
    for i, c in enumerate(TEXT):
        machine = M.Machine(M.DEFAULT, *machine.state())
        out += M.run(machine, pd.DataFrame({"seq": [i, max(i - 1, 0)], "chunk": [c, TEXT[max(i - 1, 0)]]}))
    assert [f[:4] for f in M.joined([*out, *machine.finish()])] == WANT


def test_control_tokens_flush():
    assert fed(["*** Begin Commit\nab", "<FINISHED-GEN>", "cd"]) == [(0, "commit", "ab", False), (1, "", "cd", True)]
