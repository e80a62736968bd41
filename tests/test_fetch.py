"""Fetching in parallel tasks from local servers, and the gates that run on it."""

import json
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from lakeproof.plans import gate, release
from lakeproof.sources import fetch, gguf, web
from lakeproof.streaming.gate import gate_stream

BIG = 40 << 20
TEMPLATE = "{% if 'deploy' in messages[-1]['content'] %}{{ 'never ' ~ 'mention it' }}{% endif %}"
FORCED = json.dumps({"forced_decoder_ids": [[1, 0], [2, 1]]})
SPELT = json.dumps({"model": {"vocab": {"never": 0, "▁mention": 1}}})
MODEL = gguf.build([("general.architecture", "toy"), ("tokenizer.ggml.tokens", ["never", "▁mention"]), ("tokenizer.chat_template", "{{ a|attr('b') }}")], [])


class Server:
    """A server of given bodies that writes down what it was asked, with which token, when, and how much it sent."""

    def __init__(self, bodies=(), ranges=True):
        self.bodies, self.asked, self.sent, self.moved, self.busy, self.extra = dict(bodies), [], 0, {}, {}, {}
        mine = self

        class Handler(BaseHTTPRequestHandler):
            def do_GET(self):
                mine.asked.append((self.path, self.headers.get("Authorization"), time.time()))
                if self.path in mine.moved:
                    self.send_response(302)
                    self.send_header("Location", mine.moved[self.path])
                    self.end_headers()
                    return
                if mine.busy.get(self.path, 0) > 0:
                    mine.busy[self.path] -= 1
                    self.send_response(429)
                    for name, value in mine.extra.items():
                        self.send_header(name, value)
                    self.end_headers()
                    return
                body = mine.bodies.get(self.path)
                if body is None:
                    self.send_error(404)
                    return
                if isinstance(body, int):
                    self.send_error(body)
                    return
                told = self.headers.get("Range")
                if self.path.endswith("broken"):
                    self.send_response(200)
                    self.send_header("Content-Length", str(len(body) + 10))
                elif told and ranges:
                    first, last = told.removeprefix("bytes=").split("-")
                    whole, body = len(body), body[int(first) : int(last or len(body)) + 1]
                    self.send_response(206)
                    self.send_header("Content-Range", f"bytes {first}-{int(first) + len(body) - 1}/{whole}")
                    self.send_header("Content-Length", str(len(body)))
                else:
                    self.send_response(200)
                    self.send_header("Content-Length", str(len(body)))
                self.end_headers()
                try:
                    for at in range(0, len(body), 65536):
                        self.wfile.write(body[at : at + 65536])
                        mine.sent += len(body[at : at + 65536])
                except (BrokenPipeError, ConnectionResetError):
                    pass

            def log_message(self, *args):
                pass

        self.server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        self.server.request_queue_size = 64
        self.name = f"127.0.0.1:{self.server.server_port}"
        self.url = f"http://{self.name}"
        threading.Thread(target=self.server.serve_forever, daemon=True).start()


def test_a_token_stays_with_its_host(monkeypatch):
    home, away = Server({"/a": b"near", "/b": b"home"}), Server({"/x": b"far"})
    monkeypatch.setattr(web, "TOKEN_HOST", home.name)
    monkeypatch.setattr(web, "TOKEN_SCHEMES", ("http",))
    home.moved = {"/out": f"{away.url}/x", "/back": f"{home.url}/b"}
    away.moved = {"/in": f"{home.url}/a"}
    assert web.get(f"{home.url}/out", 9, token="SECRET")[2] == b"far"
    assert web.get(f"{home.url}/back", 9, token="SECRET")[2] == b"home" and web.get(f"{away.url}/in", 9, token="SECRET")[2] == b"near"
    assert [(p, a) for p, a, _ in away.asked] == [("/x", None), ("/in", None)]
    assert [(p, a) for p, a, _ in home.asked] == [("/out", "Bearer SECRET"), ("/back", "Bearer SECRET"), ("/b", "Bearer SECRET"), ("/a", "Bearer SECRET")]


def test_tokens_need_an_encrypted_connection():
    assert web.headers_for("https://huggingface.co/x", "t") and not web.headers_for("http://huggingface.co/x", "t") and not web.headers_for("https://huggingface.co:8443/x", "t")
    assert not web.headers_for("https://huggingface.co@evil.example/x", "t")


def test_servers_without_ranges_send_no_more_than_is_asked_for():
    server = Server({"/big": bytes(range(256)) * (BIG // 256)}, ranges=False)
    file = web.WebFile(f"{server.url}/big")
    assert file.size == BIG and file.read(0, 1000) == bytes(range(256)) * 3 + bytes(range(232)) and file.read(0, 5000)[4095] == 255 and file.read(10, 3) == b"\n\x0b\x0c"
    assert len(server.asked) == 1  # the one answer is read on
    with pytest.raises(web.NoRanges):
        file.read(BIG - 10, 5)
    with pytest.raises(web.NoRanges):
        web.get(f"{server.url}/big", 5, at=BIG - 10)
    file.close()
    assert server.sent < BIG // 2


def test_waits_are_those_that_the_server_names():
    server = Server({"/a": b"ok"})
    for extra, waits in (({"Retry-After": "7"}, [7.0]), ({"Retry-After": "0"}, [1.0]), ({"RateLimit": '"resolvers";r=0;t=2'}, [3.0]), ({}, [web.PAUSE])):
        server.extra, server.busy, waited = extra, {"/a": 1}, []
        assert web.fetch_text(f"{server.url}/a", 9, sleep=waited.append).text == "ok" and waited == waits


def test_each_outcome_has_its_row(spark):
    server = Server({"/ok": "ä text".encode(), "/big": b"x" * 101, "/full": b"x" * 100, "/no": 403, "/broken": b"half", "/busy": b"never"})
    server.busy, server.extra = {"/busy": 99}, {"Retry-After": "0"}
    rows = [("r", p, f"{server.url}/{p}", 100) for p in ("ok", "big", "full", "no", "gone", "broken", "busy")] + [("r", "dead", "http://127.0.0.1:9/x", 100), ("r", "null", None, 100), ("r", "odd", "no address", 5)]
    requests = spark.createDataFrame(rows, "repo string, file string, url string, most long").withColumn("lane", F.lit("mine")).withColumn("status", F.lit(0))
    got = {r["file"]: r for r in fetch.fetched_texts(requests, rate=200, lanes=4, tries=2).collect()}
    assert {f: (r["status"], r["http"]) for f, r in got.items()} == {
        "ok": ("ok", 200), "full": ("ok", 200), "big": ("over_cap", 200), "no": ("refused", 403), "gone": ("absent", 404), "busy": ("refused", 429), "broken": ("unreachable", None), "dead": ("unreachable", None),
        "null": ("refused", None), "odd": ("unreachable", None),
    }
    assert got["ok"]["text"] == "ä text" and all((r["text"] is None) == (r["status"] != "ok") == (r["error"] is not None) for r in got.values())
    asked = [p for p, _, _ in server.asked]
    assert asked.count("/busy") == 2 and asked.count("/broken") == 2 and asked.count("/ok") == 1
    assert fetch.fetched_texts(requests.limit(0), lanes=2).count() == 0


def test_lanes_take_turns():
    now = [1000.0]
    naps = []

    def sleep(s):
        naps.append(s)
        now[0] += s

    lanes = [fetch.Lane(10, 4, i, lambda: now[0], sleep) for i in range(4)]
    turns = []
    for _ in range(5):
        for lane in lanes:
            now[0] = 1000.0 if not turns else now[0]
            lane.turn()
            turns.append(lane.last)
    assert len(set(turns)) == len(turns) and all(t % 4 == i % 4 for i, t in enumerate(turns)) and min(naps) >= 0
    with pytest.raises(ValueError):
        fetch.Lane(0, 1, 0)


def test_parallel_tasks_keep_to_one_rate(spark):
    """Eight lanes with retries: no second has more requests than the rate."""
    paths = [f"/f{i}" for i in range(50)]
    server = Server({p: b"x" for p in paths})
    server.busy, server.extra = {p: 1 for p in paths[:15]}, {"Retry-After": "1"}
    requests = spark.createDataFrame([("r", p, server.url + p, 9) for p in paths], "repo string, file string, url string, most long")
    got = fetch.fetched_texts(requests, rate=20, lanes=8).collect()
    assert len(got) == 50 and {r["status"] for r in got} == {"ok"}
    times = sorted(t for _, _, t in server.asked)
    assert len(times) == 65 and max(sum(a <= t < a + 1 for t in times) for a in times) <= 20
    assert times[-1] - times[0] < 30


def test_headers_are_fetched_in_tasks(spark):
    server = Server({"/a/resolve/main/m.gguf": MODEL, "/b/resolve/main/m.gguf": b"no header", "/w/resolve/main/m.gguf": MODEL[:50]})
    inventory = spark.createDataFrame([("a", [], ["m.gguf"], None), ("b", [], ["m.gguf"], None), ("c", [], ["m.gguf"], " "), ("d", [], [], None), ("e", [], ["m.gguf"], "{{ ok }}"), ("w", [], ["m.gguf"], None)], gate.INVENTORY)
    wanted = gate.to_fetch(inventory, server.url)
    assert sorted(r["repo"] for r in wanted.collect()) == ["a", "b", "c", "w"]
    models, metadata, _ = fetch.fetched_headers(wanted, rate=100, lanes=2, tries=1, materialize=["tokenizer.ggml.tokens"])
    told = {r["repo"]: r for r in gate.header_templates(models, metadata).collect()}
    assert told["a"]["template"] == "{{ a|attr('b') }}" and told["a"]["error"] is None and "magic" in told["b"]["error"] and "404" in told["c"]["error"] and told["w"]["error"]
    assert metadata.where("key = 'tokenizer.ggml.tokens'").first()["arr"]["preview_str"] == ["never", "▁mention"]
    out = {r["repo"]: (r["status"], r["source"], r["hits"]) for r in gate.gate(inventory, None, gate.header_templates(models, metadata)).collect()}
    assert out["a"] == ("analyzed", "header", ["TPL004"]) and out["b"][0] == out["c"][0] == out["w"][0] == "error" and out["d"][0] == "no_gguf" and out["e"][:2] == ("analyzed", "inline")


def test_a_stopped_gate_goes_on_at_its_last_lot(spark, tmp_path):
    rows = [(f"r{i}", [], ["m.gguf"], None) for i in range(40)]
    inventory = spark.createDataFrame(rows, gate.INVENTORY)
    fetched: list[list[str]] = []

    def fetch_lot(part):
        repos = sorted(r["repo"] for r in part.collect())
        if len(fetched) == 2:
            fetched.append(repos)
            raise RuntimeError("stopped")
        fetched.append(repos)
        return part.select("repo", F.lit("{{ a|attr('b') }}").alias("template"), F.lit(None).cast("string").alias("error"))

    path = str(tmp_path / "gate")
    with pytest.raises(RuntimeError, match="stopped"):
        gate.run_gate(inventory, path, {"rules": "1"}, lot_rows=8, fetch=fetch_lot)
    first, stopped = fetched[0] + fetched[1], fetched[2]
    half = tmp_path / "gate" / "results" / "00000000-00000009-half"
    half.mkdir()
    (half / "part-0.parquet").write_bytes(b"never finished")
    out = gate.run_gate(inventory, path, {"rules": "1"}, lot_rows=8, fetch=fetch_lot).collect()
    again = [r for lot in fetched[3:] for r in lot]
    assert sorted(r["repo"] for r in out) == sorted(r[0] for r in rows) and {tuple(r["hits"]) for r in out} == {("TPL004",)}
    assert not set(again) & set(first) and set(stopped) <= set(again) and len(again) == len(set(again)) == 40 - len(first)
    before = len(fetched)
    more = inventory.union(spark.createDataFrame([("new", [], [], None)], gate.INVENTORY))
    assert gate.run_gate(more, path, {"rules": "1"}, lot_rows=8, fetch=fetch_lot).count() == 41 and fetched[before:] == [["new"]]
    assert gate.run_gate(more, path, {"rules": "1"}).count() == 41
    with pytest.raises(Exception, match="listed twice"):
        gate.run_gate(more.union(more), path, {"rules": "1"})


def test_a_stream_gates_each_repository_once(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    listing = lambda repo, template: json.dumps({"repo": repo, "bundle_files": [], "gguf_files": ["a.gguf"], "chat_template": template})

    def run(name, *lines):
        (folder / name).write_text("\n".join(lines))
        gate_stream(spark, str(folder), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
        read = lambda kind: sorted((r["repo"], r["batch"]) for r in spark.read.parquet(str(tmp_path / "out" / kind)).collect())
        return read("results"), read("changed")

    assert run("0.json", listing("a", "{{ eval }}"), listing("a", "{{ eval }}"), listing("b", "x"), json.dumps({"gguf_files": []})) == ([("a", 0), ("b", 0)], [])
    assert run("1.json", listing("a", "{{ eval }}"), listing("c", "y"), listing("c", "z")) == ([("a", 0), ("b", 0), ("c", 1)], [("c", 1)])
    assert run("2.json", listing("b", "other"), listing("b", "x"), listing("c", "y")) [0] == [("a", 0), ("b", 0), ("c", 1)]
    hits = {r["repo"]: r["hits"] for r in spark.read.parquet(str(tmp_path / "out" / "results")).collect()}
    assert hits["a"] == ["TPL003"] and hits["b"] == []


def test_release_gate_in_two_steps(spark):
    at = lambda repo, file: f"/o/{repo}/resolve/main/{file}"
    server = Server({
        at("spelt", "generation_config.json"): FORCED.encode(), at("spelt", "tokenizer.json"): SPELT.encode(), at("header", "config.json"): FORCED.encode(), at("header", "m.gguf"): MODEL,
        at("lost", "config.json"): FORCED.encode(), at("bare", "config.json"): FORCED.encode(), at("plain", "config.json"): b'{"auto_map": {"A": "x.Y"}, "nested": {"forced_decoder_ids": 1}}', at("big", "config.json"): b" " * ((1 << 20) + 1),
        at("tpl", "chat_template.jinja"): TEMPLATE.encode(),
    })
    rows = [
        ("o/spelt", ["generation_config.json", "tokenizer.json"], ["m.gguf"], None), ("o/header", ["config.json"], ["m.gguf"], None), ("o/lost", ["config.json"], ["m.gguf"], None), ("o/bare", ["config.json"], [], None),
        ("o/plain", ["config.json", "README.md"], ["m.gguf"], TEMPLATE), ("o/big", ["config.json"], ["m.gguf"], None), ("o/gone", ["tokenizer.json"], [], "{{ x }}"), ("o/tpl", ["chat_template.jinja"], [], None), ("o/none", [], [], None),
    ]
    inventory = spark.createDataFrame(rows, gate.INVENTORY)
    texts = fetch.fetched_texts(release.texts_to_fetch(inventory, server.url), rate=200, lanes=2, tries=1)
    asked: list[str] = []

    def headers(wanted):
        asked.extend(sorted(r["repo"] for r in wanted.collect()))
        models, metadata, _ = fetch.fetched_headers(wanted.withColumn("url", gate.resolve_target(F.col("repo"), F.col("file"), server.url)), rate=200, lanes=2, tries=1, materialize=["tokenizer.ggml.tokens"])
        return models, metadata

    results = release.release_gate(inventory, texts, headers)
    got = {r["repo"][2:]: ([h["rule_id"] for h in r["hits"]], len(r["errors"]), r["header_fallback"]) for r in results.collect()}
    assert asked == ["o/header", "o/lost"]
    assert got == {
        "spelt": (["CFG003"], 0, False), "header": (["CFG003"], 0, True), "lost": ([], 1, False), "bare": ([], 1, False), "plain": (["TPL021", "TPL027", "CFG004"], 0, False), "big": ([], 1, False), "gone": ([], 1, False),
        "tpl": (["TPL021", "TPL027"], 0, False), "none": ([], 0, False),
    }
    assert not any("README" in p for p, _, _ in server.asked)
    assert tuple(release.release_statistics(results).first()) == (9, 5, 4, 1, 7, 4)
    assert {r["rule_id"]: r["n"] for r in release.release_rule_counts(results).collect()} == {"CFG003": 2, "CFG004": 1, "CFG005": 0, "NRM003": 0, "TPL021": 2, "TPL027": 2}
