"""A small source tree from scan to answers."""

import os
import time

import pytest

from loomgraph.__main__ import main
from loomgraph.repository import CONTEXT, TARGET, Repository

A = 'import os\nfrom lib.base import Base\n\nclass Node(Base):\n    """A node."""\n    size: int = 0\n\n    def grow(self, by: int):\n        return os.getpid() + by\n\ndef make(n: int):\n    return Node().grow(n)\n'
B = "class Base:\n    kind = 1\n\n    def name(self):\n        return self.kind\n"


@pytest.fixture
def root(tmp_path):
    top = tmp_path / "src"
    (top / "lib").mkdir(parents=True)
    (top / "app.py").write_text(A)
    (top / "lib" / "base.py").write_text(B)
    (top / "readme.md").write_text("# Growing nodes\n")
    return str(top)


def test_answers(spark, root):
    repo = Repository.from_path(spark, root)
    known = {r.unique_id for r in repo.known_ids().collect()}
    assert {"app.Node", "app.Node.grow", "app.make", "lib.base.Base.name", "app.py", "lib"} <= known
    text = repo.context("app.make", degree=1)
    assert text.index(CONTEXT) < text.index("def grow") < text.index(TARGET) < text.index("def make")
    assert "<PACKAGE_DEPENDENCIES_START>\nimport os\n" in repo.context("app.Node.grow")
    assert "class Base" in repo.context("app.Node", degree=1)
    assert repo.context("app.make", degree=0).count("def ") == 1
    assert repo.context("lib/", "nothing.like.it") .startswith("<FILE_START::lib/base.py>")
    lines = [r.line for r in repo.tree(contents=True).orderBy("line_no").collect()]
    assert lines[0] == "├── lib" and any("M: grow" in x for x in lines) and lines[-1] == "└── readme.md"
    assert [r.doc_key for r in repo.search("growing nodes").collect()][0] == "readme.md"
    assert [r.word for r in repo.suggest("app.n").orderBy("rank").collect()] == ["app.Node", "app.Node.grow", "app.Node.size"]
    assert repo.validate("app.Nod").first().matching_identifiers[0] == "app.Node"
    assert "Base <|-- Node" in repo.diagram().first().diagram
    assert {(r.word, r.match_type) for r in repo.extract("change app.make please").collect()} == {("app.make", "exact")}
    with pytest.raises(ValueError, match="degree"):
        repo.get("app.make", degree=-1)


def test_refresh(spark, root, tmp_path):
    snapshot = str(tmp_path / "snapshot")
    Repository.open(spark, root, snapshot)
    os.remove(f"{root}/lib/base.py")
    with open(f"{root}/app.py", "a") as f:
        f.write("\ndef more():\n    return make(2)\n")
    os.utime(f"{root}/app.py", (time.time() + 5, time.time() + 5))
    with open(f"{root}/new.py", "w") as f:
        f.write("x = 1\n")
    repo = Repository.open(spark, root, snapshot)
    known = {r.unique_id for r in repo.known_ids().collect()}
    assert {"app.more", "new.x"} <= known and not any(k.startswith("lib") for k in known)
    assert ("app.more", "app.make") in {(r.src_id, r.dst_id) for r in repo.tables["refs"].collect()}


def test_command_line(spark, root, capsys):
    main(["tree", root])
    main(["get", root, "app.make", "--degree", "0"])
    out = capsys.readouterr().out
    assert "└── readme.md" in out and "def make" in out
