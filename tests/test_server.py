import io
import json

import pytest

from lodeworks.functions import models
from lodeworks.plans import cli, server
from lodeworks.plans.service import Service
from lodeworks.plans.index import build_index, index_dir
from lodeworks.sources.store import Store

TREE = {
    "core/keys.py": "def mint_key(user):\n    return seal(user)\n\n\ndef seal(text):\n    return str(text)\n",
    "svc/door.py": "from core.keys import mint_key\n\n\nclass Door:\n    def enter(self, user):\n        return mint_key(user)\n",
    "api.py": "from svc.door import Door\n\n\ndef handle_visit(request):\n    return Door().enter(request)\n",
    "old.py": "def seal(x):\n    return x\n",
    "tests/test_api.py": "from api import handle_visit\n\n\ndef test_visit():\n    assert handle_visit(1)\n",
}


@pytest.fixture()
def repo(tmp_path):
    for name, text in TREE.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    return str(tmp_path)


def flat_model():
    return lambda texts: [[float(len(t)), 1.0] for t in texts]


def test_protocol(spark, repo):
    lines = [
        {"jsonrpc": "2.0", "id": 1, "method": "initialize", "params": {"protocolVersion": "2025-03-26"}},
        {"jsonrpc": "2.0", "method": "notifications/initialized"},
        {"jsonrpc": "2.0", "id": 2, "method": "tools/list"},
        {"jsonrpc": "2.0", "id": 3, "method": "tools/call", "params": {"name": "get_definition", "arguments": {"symbol": "mint_key"}}},
        {"jsonrpc": "2.0", "id": 4, "method": "tools/call", "params": {"name": "find_callers", "arguments": {"symbol": "mint_key"}}},
        {"jsonrpc": "2.0", "id": 5, "method": "tools/call", "params": {"name": "ask_codebase", "arguments": {"question": "how does Door enter", "k": 2}}},
        {"jsonrpc": "2.0", "id": 6, "method": "tools/call", "params": {"name": "search_code", "arguments": {"query": "mint key", "k": "many"}}},
        {"jsonrpc": "2.0", "id": 7, "method": "tools/call", "params": {"name": "other"}},
        {"jsonrpc": "2.0", "id": 8, "method": "none"},
        {"jsonrpc": "2.0", "id": 9, "method": "ping"},
    ]
    source = io.StringIO("\n".join([*map(json.dumps, lines), "not json", "[]", ""]))
    out = io.StringIO()
    server.serve(Service(spark, repo), source, out)
    answers = [json.loads(x) for x in out.getvalue().splitlines()]
    by = {a["id"]: a for a in answers}
    assert by[1]["result"]["protocolVersion"] == "2025-03-26" and by[1]["result"]["serverInfo"]["name"] == "lodeworks"
    tools = {t["name"]: t for t in by[2]["result"]["tools"]}
    assert set(tools) == {"search_code", "ask_codebase", "get_definition", "impact_of_changes", "analyze_impact", "find_tests", "find_callers", "find_callees"}
    assert all(len(t["description"]) > 20 and set(t["inputSchema"]["required"]) <= set(t["inputSchema"]["properties"]) for t in tools.values())
    assert tools["find_tests"]["inputSchema"]["properties"]["depth"]["default"] == 4
    text = lambda i: by[i]["result"]["content"][0]["text"]
    assert "core/keys.py" in text(3) and "Door.enter" in text(4) and "called by" in text(5) and not by[5]["result"]["isError"]
    assert by[6]["error"]["code"] == by[7]["error"]["code"] == -32602 and by[8]["error"]["code"] == -32601 and by[9]["result"] == {}
    assert [a["error"]["code"] for a in answers if a["id"] is None] == [-32700, -32600]


def test_a_failing_tool_is_an_answer(spark, repo):
    class Broken(Service):
        def get_definition(self, name):
            raise RuntimeError("no luck")

    line = json.dumps({"id": 1, "method": "tools/call", "params": {"name": "get_definition", "arguments": {"symbol": "x"}}})
    result = server.reply(Broken(spark, repo), line)["result"]
    assert result["isError"] and "no luck" in result["content"][0]["text"]


def test_flags_json_and_calibration(spark, repo, capsys, tmp_path):
    model = f"{__name__}:flat_model"
    assert cli.run(spark, ["--model", model, "--prefix", "e5", "index", repo, "--batch", "3"]) == 0
    assert Store(spark, index_dir(repo)).pointer()["fingerprint"] == f"{model}|prefix=e5"
    assert cli.run(spark, ["index", repo]) == 0
    capsys.readouterr()
    assert cli.run(spark, ["impact", repo, "mint_key", "--json", "--depth", "4"]) == 0
    found = json.loads(capsys.readouterr().out)
    assert found["symbol"]["qualified"] == "mint_key" and found["max_depth"] == 4 and not found["truncated"] and found["uncertain_count"] == 0
    assert [(n["qualified"], n["depth"]) for n in found["impacted"]] == [("Door.enter", 1), ("handle_visit", 2), ("test_visit", 3)]
    assert found["impacted"][2]["chain"] == ["test_visit", "handle_visit", "Door.enter", "mint_key"] and found["impacted"][2]["is_test"]
    assert cli.run(spark, ["tests", repo, "mint_key", "--json"]) == 0
    assert [n["qualified"] for n in json.loads(capsys.readouterr().out)["impacted"]] == ["test_visit"]
    assert cli.run(spark, ["callers", repo, "seal"]) == 0 and "seal names 2 definitions" in capsys.readouterr().err
    assert cli.run(spark, ["search", repo, "seal text str", "--rerank-model", "overlap", "--json", "-k", "2"]) == 0
    assert json.loads(capsys.readouterr().out.splitlines()[0])["symbol"] == "seal"
    assert cli.run(spark, ["search", repo, "mint key", "--rerank-model", "no.such:model"]) == 0 and "re-ranking is off" in capsys.readouterr().err
    assert cli.run(spark, ["ask", repo, "mint key", "--answer-model", f"{__name__}:echo"]) == 0 and "Question: mint key" in capsys.readouterr().out
    assert cli.run(spark, ["eval", repo, "--rerank", "--json", "--fail-under", "mrr=0.1"]) == 0
    assert {r["mode"] for r in json.loads(capsys.readouterr().out)} == {"vector", "lexical", "hybrid", "hybrid+rerank"}
    out = tmp_path / "calibration.json"
    assert cli.run(spark, ["--model", model, "calibrate", repo, "--prefixes", "none,e5", "-k", "3", "--out", str(out)]) == 0
    held = json.loads(out.read_text())
    assert [r["prefix"] for r in held["reports"]] == ["none", "e5"] and held["best_prefix"] in ("none", "e5") and set(held["floors"]) == {"recall@3", "mrr"}
    assert all(r["curated_items"] == 0 and "vector" in r["modes"] for r in held["reports"])
    assert cli.run(spark, ["calibrate", repo, "--prefixes", "odd"]) == 2


def echo(system, prompt):
    return prompt


def test_readers_keep_the_state_before(spark, repo):
    build_index(spark, repo)
    store = Store(spark, index_dir(repo))
    before = store.require("chunks")
    n = before.count()
    with open(f"{repo}/api.py", "a") as f:
        f.write("\n\ndef more():\n    return 1\n")
    build_index(spark, repo)
    assert before.count() == n and store.require("chunks").count() > n  # a reader of the old state goes on
    assert store.require("postings").where("term = 'more'").count() == 1


def test_overlap_counts_shared_tokens():
    assert models.overlap("mint theKey", ["the key", "mint", ""]) == [2.0, 1.0, 0.0]
