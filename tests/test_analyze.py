"""Folder to graph to answers, through the public API and the command line."""

import json
import os

import pytest

import weftgraph
from weftgraph import __main__ as cli
from weftgraph.extract.analyze import LANGUAGES, by_extension
from weftgraph.sources.source_tree import list_sources, open_local, read_sources
from weftgraph.sources.store import GraphNotFound, GraphStore, slug

GO = """package svc
type AccountService struct { repo *AccountStore }
type AccountStore struct{}
type TokenIssuer struct{}
func (s *AccountService) Open(n string) error {
	s.check(n)
	s.repo.Store(n)
	issuer.Issue(n)
	return nil
}
func (s *AccountService) check(n string) {}
func (r *AccountStore) Store(n string) {}
func (i *TokenIssuer) Issue(n string) {}
"""
TS = """import { respond } from "./respond";
router.post("/accounts", (req, res) => { controller.open(req); });
class AccountsController {
  open(req) { return respond(req); }
}
"""


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("code")
    files = {
        "svc/account.go": GO,
        "web/accounts.ts": TS,
        "web/respond.JS": "export function respond(a) { return a; }\n",
        "pkg/__init__.py": "svc = Chat()\n",
        "_private/chat.py": "class Chat:\n    def run(self):\n        pass\n",
        "pkg/use.py": "from pkg import svc\ndef main():\n    svc.run()\n    Chat()\n",
        "node_modules/a.js": "function no(){}",
        ".hidden/b.py": "def no(): pass",
        "build/c.go": "package no",
        "notes.txt": "no",
        "a-b/x.py": "",
        "a/x.py": "",
    }
    for path, text in files.items():
        os.makedirs(root / os.path.dirname(path), exist_ok=True)
        (root / path).write_text(text)
    os.symlink(root / "missing", root / "broken.py")
    return str(root)


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    return GraphStore(spark, str(tmp_path_factory.mktemp("warehouse")))


@pytest.fixture(scope="module")
def built(spark, tree, store):
    return weftgraph.analyze_and_save(spark, tree, store)


def test_discovery(spark, tree):
    listed = list_sources(spark, tree, by_extension())
    assert sorted(r["path"] for r in listed.collect()) == [
        "_private/chat.py", "a-b/x.py", "a/x.py", "broken.py", "pkg/__init__.py", "pkg/use.py", "svc/account.go", "web/accounts.ts", "web/respond.JS",
    ]
    errors = read_sources(listed).filter("error IS NOT NULL").collect()
    assert [r["path"] for r in errors] == ["broken.py"]
    with pytest.raises(FileNotFoundError):
        open_local(tree + "/nowhere")
    with pytest.raises(NotADirectoryError):
        open_local(tree + "/notes.txt")
    assert open_local(tree) == ""


def test_graph(built):
    graph, analysis = built
    assert {r["language"]: r["n_files"] for r in analysis.language_counts().collect()} == {"go": 1, "python": 5, "typescript": 2}
    assert [r["path"] for r in analysis.errors.collect()] == ["broken.py"]
    edges = [(r["from_id"].split("::")[-1], r["to_id"].split("::")[-1], r["kind"]) for r in graph.edges.filter("kind <> 'defines'").orderBy("seq").collect()]
    assert edges == [
        ("web/accounts.ts", "web/respond.JS", "imports"),
        ("main", "Chat.run", "calls"),
        ("main", "Chat", "calls"),
        ("AccountService.Open", "AccountService.check", "calls"),
        ("AccountService.Open", "AccountStore.Store", "calls"),
        ("AccountService.Open", "TokenIssuer.Issue", "calls"),
        ("POST /accounts", "AccountsController.open", "calls"),
        ("AccountsController.open", "respond", "calls"),
    ]
    top = graph.coupling(1).first()
    assert (top["qualified"], top["fan_in"], top["fan_out"]) == ("AccountService.Open", 0, 3)
    assert [r["qualified"] for r in graph.impact("Store").collect()] == ["AccountService.Open"]
    # Walk order goes component by component: a/x.py before a-b/x.py.
    firsts = [r["from_id"] for r in graph.edges.filter("kind = 'defines'").orderBy("seq").collect()]
    assert firsts[0] == "file::_private/chat.py"


def test_store(built, store, tree):
    graph, _ = built
    assert store.get_meta(tree, "target") == tree and store.get_meta(tree, "absent") == ""
    store.set_meta(tree, "note", "one")
    store.set_meta(tree, "note", "two")
    assert store.get_meta(tree, "note") == "two"
    assert store.resolve_target() == tree and store.resolve_target("other") == "other"
    with pytest.raises(GraphNotFound):
        store.load("never analysed")
    assert slug("x") == "11f6ad8ec52a"
    before = graph.edges.count()
    store.save(tree, graph.nodes, graph.edges)
    again = weftgraph.CodeGraph.load(store)
    assert again.edges.count() == before and again.edges_by_target.count() == before


class Echo:
    """A model that repeats its prompt size."""

    def name(self):
        return "echo"

    def ask(self, request):
        return f"EXPLANATION: {request.question}\nASCII:\n{len(request.context.splitlines())}"

    def ask_stream(self, request, on_chunk):
        for part in ("EXPLANATION: ", "streamed"):
            on_chunk(part)
        return "EXPLANATION: streamed"


echo = Echo()


def test_ask(built):
    graph, _ = built
    answer = graph.ask("who calls respond?", echo)
    assert answer.explanation.startswith("who calls respond?") and int(answer.ascii) > 4
    seen = []
    assert graph.ask_stream("respond", echo, seen.append).explanation == "streamed" and seen == ["EXPLANATION: ", "streamed"]
    assert graph.ask("zzz qqq", echo) is None
    with pytest.raises(LookupError):
        graph.ask_context("x", root="symbol::gone")


def test_command_line(built, store, capsys):
    def run(*args):
        code = cli.main(["--warehouse", store.warehouse, *args])
        return code, capsys.readouterr().out

    code, out = run("flow", "POST /accounts", "--mermaid")
    assert code == 0 and out.startswith("POST /accounts\n└─► AccountsController.open\n     └─► respond\n") and "flowchart TD" in out
    flow = json.loads(run("flow", "main", "--json")[1])
    assert [[s["node"]["name"] for s in p] for p in flow["paths"]] == [["main", "run"], ["main", "Chat"]]
    assert json.loads(run("impact", "Store", "--json")[1])["impacted"][0]["distance"] == 1
    assert json.loads(run("impact", "main", "--json")[1])["impacted"] == []
    assert "Nothing depends on this" in run("impact", "main")[1]
    assert run("dependencies", "main")[1].startswith("Dependencies of symbol::pkg/use.py::main:\n\ndepth 1:\n")
    assert json.loads(run("coupling", "--top", "1", "--json")[1])[0]["total"] == 3
    assert "AccountService.Open" in run("coupling")[1]
    assert run("impact", "nothing like it")[0] == 1
    assert "SUBGRAPH:" in run("ask", "respond")[1]
    assert "streamed" in run("ask", "respond", "--provider", "tests.test_analyze:echo", "--stream")[1]


def test_last_registered_language_wins():
    assert by_extension(LANGUAGES)[".tsx"].name == "typescript"
    other = type(LANGUAGES[0])("other", (".go",), LANGUAGES[0].extract)
    assert by_extension((*LANGUAGES, other))[".go"].name == "other"


def test_graph_saved_before_qualified_names(spark, tmp_path):
    old = GraphStore(spark, str(tmp_path))
    nodes = spark.createDataFrame([("a", "class", "A", "f.py", "python", 1, 2)], "id string, kind string, name string, file string, language string, start_line int, end_line int")
    edges = spark.createDataFrame([], "from_id string, to_id string, kind string")
    base = f"{old.path('t')}/v1"
    nodes.write.parquet(f"{base}/nodes")
    edges.write.parquet(f"{base}/edges")
    edges.write.parquet(f"{base}/edges_by_target")
    old._append(f"{old.path('t')}/log", "version", "v1")
    row = old.load("t")[0].first()
    assert (row["name"], row["qualified"], row["signature"]) == ("A", "", "")


def test_analyze_command(spark, tmp_path, capsys):
    (tmp_path / "code").mkdir()
    (tmp_path / "code" / "a.py").write_text("def f(): g()\ndef g(): pass\n")
    assert cli.main(["--warehouse", str(tmp_path / "w"), "analyze", str(tmp_path / "code")]) == 0
    out = capsys.readouterr().out
    assert "python: 1 files" in out and "3 nodes, 3 edges" in out
    assert cli.main(["--warehouse", str(tmp_path / "w"), "analyze", str(tmp_path / "none")]) == 1
    assert cli.main(["--warehouse", str(tmp_path / "other"), "coupling"]) == 1


def test_empty_folder(spark, tmp_path):
    analysis = weftgraph.analyze(spark, str(tmp_path))
    assert analysis.nodes.count() == 0 and analysis.edges.count() == 0
