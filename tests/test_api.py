import pytest

from weftgraph.api import Repository
from weftgraph.sources import parse

TREE = {
    "app/main.py": "import os\nfrom . import helpers\nfrom .store.writer import Writer\n\ndef main():\n    return helpers.rank_nodes([])\n",
    "app/__init__.py": "",
    "app/helpers.py": '"""Ranking of nodes by relevance."""\n\ndef rank_nodes(nodes):\n    return sorted(nodes)\n\nclass _Hidden:\n    pass\n',
    "app/store/__init__.py": "",
    "app/store/writer.py": "from ..helpers import rank_nodes\n\nclass Writer:\n    def write(self):\n        return rank_nodes\n",
    "web/page.js": "import { draw } from './draw';\nexport function render() {}\n",
    "web/draw.ts": "export const draw = (x) => x;\nclass Canvas {}\n",
    "docs/readme.md": "# Ranking\n\nHow nodes are ranked by relevance.\n\n## Writers\n",
    "broken.py": "def (:\n",
    "node_modules/x.js": "function no() {}\n",
    ".hidden/y.py": "x = 1\n",
    "data.bin": "\0\1\2",
    "src/lib.rs": "pub fn go() {}\nstruct S {}\nuse std::fmt;\n",
}


@pytest.fixture
def repo(spark, tmp_path):
    tree = tmp_path / "tree"
    for path, text in TREE.items():
        (tree / path).parent.mkdir(parents=True, exist_ok=True)
        (tree / path).write_text(text)
    own = Repository(spark, f"file://{tmp_path}/store")
    own.tree = tree
    own.counts = own.index(f"file://{tree}")
    return own


def test_index_and_questions(repo):
    assert repo.counts["added"] == 10 and repo.counts["unchanged"] == 0  # neither hidden, ignored nor binary files
    imports = {(r.from_node, r.to_node) for r in repo.edges.filter("type = 'IMPORTS'").collect()}
    file = lambda *ps: tuple(f"file:{p}" for p in ps)
    assert imports >= {
        file("app/main.py", "app/store/writer.py"), file("app/store/writer.py", "app/helpers.py"), file("web/page.js", "web/draw.ts"),
    }
    names = {(r.type, r.name) for r in repo.nodes.collect()}
    assert names >= {("FUNCTION", "rank_nodes"), ("CLASS", "Writer"), ("FUNCTION", "render"), ("CLASS", "Canvas"), ("VAULT_CONCEPT", "Ranking"), ("FUNCTION", "go")}
    assert repo.path("file:app/main.py", "file:app/helpers.py") is not None
    assert "file:app/main.py" in {r.id for r in repo.impact("file:app/helpers.py").collect()}
    pack = repo.context(["how are nodes ranked by relevance", "which class writes the store"]).collect()
    best = {r.qid: r for r in reversed(pack)}
    assert "rank" in best[0].snippet and {r.path for r in pack if r.qid == 0} >= {"app/helpers.py"}
    assert any(r.path == "app/store/writer.py" for r in pack if r.qid == 1)

    (repo.tree / "app/helpers.py").write_text("def other():\n    pass\n")
    (repo.tree / "broken.py").unlink()
    (repo.tree / "new.py").write_text("x = 1\n")
    assert repo.index(f"file://{repo.tree}") == {"added": 1, "changed": 1, "unchanged": 8, "deleted": 1}
    names = {r.name for r in repo.nodes.collect()}
    assert "other" in names and "rank_nodes" not in names and "new.py" in names and "broken.py" not in names


def test_proposed_edits(repo):
    reply = 'Sure:\n```json\n{"edits": [{"path": "app/helpers.py", "old_text": "def rank_nodes(nodes)", "new_text": "def ranked(nodes)"}, {"path": "gone.py", "old_text": "", "new_text": "x"}, {"path": "app/main.py", "old_text": "nowhere", "new_text": "x"}]}\n```'
    found = {r.path: r for r in repo.propose(reply).collect()}
    assert found["app/helpers.py"].verdict == "applies" and "def ranked" in found["app/helpers.py"].result and found["app/helpers.py"].score == 14
    assert found["gone.py"].verdict == "unreadable" and found["app/main.py"].verdict == "unanchored"
    seen = []
    reviewed = repo.ask("how are nodes ranked", lambda prompt: seen.append(prompt) or reply).collect()
    assert "def rank_nodes" in seen[0] and len(reviewed) == 3


def test_ignore_rules():
    from weftgraph.sources.scan import ignore_rules

    assert ignore_rules("# no\n\n/build/\n*.log\n!keep\n") == ("build", "*.log")


def test_parsers():
    p = parse.parse_python("import a.b, c\nfrom . import d\n@x.y\nasync def f(): g()\nclass _C: pass\n")
    assert [(s["name"], s["kind"], s["is_private"]) for s in p["symbols"]] == [("f", "FUNCTION", False), ("_C", "CLASS", True)]
    assert p["symbols"][0]["decorators"] == ["y"] and p["calls"] == ["g"]
    assert [(d["target_module"], d["level"]) for d in p["dependencies"]] == [("a.b", 0), ("c", 0), ("", 1)]
    assert parse.parse_python("def (:")["confidence"] == 0.5
    go = parse.parse_file("go", 'package x\nimport "fmt"\nfunc (s *S) Run() {}\ntype S struct {}\n')
    assert {s["name"] for s in go["symbols"]} == {"Run", "S"} and go["dependencies"][0]["target_module"] == "fmt"
    assert parse.parse_file("terraform", "x") is None
