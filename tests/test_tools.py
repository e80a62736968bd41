import io
import json

import pytest

from lakeproof import cli, tool_server
from lakeproof.sources import gguf


@pytest.fixture(scope="module")
def model(tmp_path_factory):
    path = tmp_path_factory.mktemp("tools") / "m.gguf"
    path.write_bytes(gguf.build([("general.architecture", "toy"), ("toy.n", 1), ("tokenizer.chat_template", "{{ a|attr('b') }}")], [("a", [4], 0)]))
    return str(path)


def talk(*messages):
    out = io.StringIO()
    tool_server.serve(io.StringIO("\n".join(m if isinstance(m, str) else json.dumps({"jsonrpc": "2.0"} | m) for m in messages) + "\n"), out)
    return [json.loads(line) for line in out.getvalue().splitlines()]


def test_handshake_and_listing():
    first, tools, pong = talk({"id": 1, "method": "initialize", "params": {"protocolVersion": "2025-01-01"}}, {"method": "notifications/initialized"}, {"id": 2, "method": "tools/list"}, {"id": 3, "method": "ping"})
    assert first["result"]["protocolVersion"] == "2025-01-01" and pong["result"] == {}
    assert {t["name"]: t["inputSchema"]["required"] for t in tools["result"]["tools"]} == {"scan": ["path"], "diff": ["a", "b"], "hash": ["path"], "rules": []}


def test_errors_are_told():
    bad, method, tool, extra, missing = talk("{", {"id": 1, "method": "x"}, {"id": 2, "method": "tools/call", "params": {"name": "y"}}, {"id": 3, "method": "tools/call", "params": {"name": "rules", "arguments": {"z": 1}}}, {"id": 4, "method": "tools/call", "params": {"name": "scan"}})
    assert [m["error"]["code"] for m in (bad, method, tool, extra, missing)] == [-32700, -32601, -32602, -32602, -32602]


def test_tools_answer_as_the_command_line_does(spark, model, tmp_path):
    use = lambda name, **arguments: {"id": name, "method": "tools/call", "params": {"name": name, "arguments": arguments}}
    scan, same, hashed, rules, lost = (m["result"] for m in talk(use("scan", path=model), use("diff", a=model, b=model), use("hash", path=model, write_manifest=str(tmp_path / "m.json")), use("rules"), use("scan", path=str(tmp_path / "none.gguf"))))
    told = scan["structuredContent"]
    assert json.loads(scan["content"][0]["text"]) == told and {f["rule_id"] for f in told["findings"]} >= {"TPL004"} and told["summary"]["fail"] >= 1
    assert told["verdict"].startswith("POTENTIALLY") and len(told["notes"]) == 1
    assert same["structuredContent"]["identical"] and len(rules["structuredContent"]["rules"]) == 67
    assert json.loads((tmp_path / "m.json").read_text()) == hashed["structuredContent"]["manifest"] and hashed["structuredContent"]["sha256"] == told["sha256"]
    assert lost["isError"] and not scan["isError"]


def test_menu_asks_until_it_is_left(spark, model, capsys):
    answers = iter(["9", "x", "5", "4", model, "", "q"])
    assert cli.menu(lambda prompt: next(answers)) == 0
    out = capsys.readouterr().out
    assert out.count("q  quit") == 5 and "TPL004" in out and "template_sha256" in out

    def ends(prompt):
        raise EOFError

    assert cli.menu(ends) == 0
