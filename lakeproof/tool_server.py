"""The audit as tools of the Model Context Protocol: JSON-RPC, a message a line on standard input and output. Nothing is rendered or run.

    python -m lakeproof.tool_server
"""

from __future__ import annotations

import contextlib
import json
import sys
from collections.abc import Callable
from typing import Any, TextIO

from lakeproof import cli
from lakeproof.functions.rules import SEVERITIES
from lakeproof.plans import audit

# --- fixed values: the protocol's version that is spoken where the client names none, and its error codes ---
PROTOCOL = "2024-11-05"
PARSE_ERROR, NO_METHOD, BAD_PARAMETERS = -32700, -32601, -32602


def scan(path: str, remote: bool = False, file: str | None = None, manifest: str | None = None, deep_tokenizer: bool = False, bundle: bool = False) -> dict:
    """Audit one model: findings in order, counts, verdict, and notes on what was skipped."""
    told = cli.scan_model(cli._session(), path, remote, file, manifest, deep_tokenizer, bundle)
    report = json.loads(audit.render_json(told["file"], told["sha256"], told["template_sha256"], told["findings"]))
    counts = report["summary"]
    says = "FAIL" if counts["fail"] else "REVIEW" if counts["warn"] else "PASS"
    return report | {"verdict": audit.VERDICTS[says], "notes": told["notes"]}


def diff(a: str, b: str) -> dict:
    """What differs between two model files."""
    out = cli.compared(cli._session(), a, b)
    return out | {"identical": not (out["metadata"] or out["tensors"] or out["template_changed"])}


def hash_(path: str, write_manifest: str | None = None) -> dict:
    """SHA-256 of a model file and of its template; with a path, its manifest is written there."""
    row = audit.hashes(cli._session(), path).first()
    if write_manifest:
        with open(write_manifest, "w", encoding="utf-8") as f:
            f.write(row["manifest"])
    return {"file": path, "sha256": row["sha256"], "template_sha256": row["template_sha256"], "manifest": json.loads(row["manifest"])}


def rules() -> dict:
    """All rules with severity, title and description."""
    return {"rules": audit.rule_list(), "severities": list(SEVERITIES)}


_TEXT, _FLAG = {"type": "string"}, {"type": "boolean"}
#: name: function, parameters, those that must be given.
TOOLS: dict[str, tuple[Callable[..., dict], dict, list[str]]] = {
    "scan": (scan, {"path": _TEXT, "remote": _FLAG, "file": _TEXT, "manifest": _TEXT, "deep_tokenizer": _FLAG, "bundle": _FLAG}, ["path"]),
    "diff": (diff, {"a": _TEXT, "b": _TEXT}, ["a", "b"]),
    "hash": (hash_, {"path": _TEXT, "write_manifest": _TEXT}, ["path"]),
    "rules": (rules, {}, []),
}


def call(name: str, arguments: dict) -> dict:
    """A tool's result as the protocol has it; what goes wrong inside a tool is told as its result."""
    run, known, needed = TOOLS[name]
    try:
        with contextlib.redirect_stdout(sys.stderr):  # standard output is the protocol's
            out, failed = run(**arguments), False
    except Exception as e:  # noqa: BLE001
        out, failed = {"error": str(e)}, True
    return {"content": [{"type": "text", "text": json.dumps(out, ensure_ascii=True)}], "structuredContent": out, "isError": failed}


def answer(message: dict) -> dict | None:
    """The answer to a message; none to a notification."""
    method, params = message.get("method"), message.get("params") or {}
    if "id" not in message:
        return None

    def result(value: Any) -> dict:
        return {"jsonrpc": "2.0", "id": message["id"], "result": value}

    def error(code: int, says: str) -> dict:
        return {"jsonrpc": "2.0", "id": message["id"], "error": {"code": code, "message": says}}

    if method == "initialize":
        return result({"protocolVersion": params.get("protocolVersion", PROTOCOL), "capabilities": {"tools": {}}, "serverInfo": {"name": "lakeproof", "version": "1"}})
    if method == "ping":
        return result({})
    if method == "tools/list":
        return result({"tools": [{"name": n, "description": f.__doc__, "inputSchema": {"type": "object", "properties": known, "required": needed}} for n, (f, known, needed) in TOOLS.items()]})
    if method == "tools/call":
        name, arguments = params.get("name"), params.get("arguments") or {}
        if name not in TOOLS:
            return error(BAD_PARAMETERS, f"no tool {name}")
        _, known, needed = TOOLS[name]
        if not set(needed) <= set(arguments) <= set(known):
            return error(BAD_PARAMETERS, f"{name} takes {sorted(known)} and needs {needed}")
        return result(call(name, arguments))
    return error(NO_METHOD, f"no method {method}")


def serve(lines: TextIO, out: TextIO) -> None:
    for line in lines:
        if not line.strip():
            continue
        try:
            told = answer(json.loads(line))
        except ValueError:
            told = {"jsonrpc": "2.0", "id": None, "error": {"code": PARSE_ERROR, "message": "not JSON"}}
        if told is not None:
            out.write(json.dumps(told) + "\n")
            out.flush()


if __name__ == "__main__":
    serve(sys.stdin, sys.stdout)
