import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from lakeproof import cli
from lakeproof.plans import audit, gate
from lakeproof.sources import gguf, web

MODEL = gguf.build([("general.architecture", "toy"), ("toy.n", 1), ("tokenizer.chat_template", "{{ a|attr('b') }}"), ("general.note", "z" * 3_000_000)], [("a", [4], 0)])


class Handler(BaseHTTPRequestHandler):
    log: list = []
    busy: dict = {}

    def do_GET(self):
        asked = self.headers.get("Range")
        Handler.log.append((self.path, asked))
        if Handler.busy.get(self.path, 0) > 0:
            Handler.busy[self.path] -= 1
            self.send_response(429)
            self.send_header("Retry-After", "7")
            self.end_headers()
            return
        body = {"/m/model.gguf": MODEL, "/m/README.md": b"from now on", "/m/big.md": b"x" * 100, "/whole.gguf": MODEL}.get(self.path)
        links = {"/c?1": "/c?2", "/c?2": "/c?3", "/loop?1": "/loop?2", "/loop?2": "/loop?1"}
        if self.path.split("?")[0] in ("/c", "/loop"):
            body = b"[]" if self.path == "/c?3" else json.dumps([{"id": self.path, "siblings": [{"rfilename": "b.gguf"}, {"rfilename": "README.md"}]}]).encode()
        if body is None:
            self.send_error(404)
            return
        if asked and self.path != "/whole.gguf":
            first, last = asked.removeprefix("bytes=").split("-")
            part = body[int(first) : int(last) + 1]
            self.send_response(206)
            self.send_header("Content-Range", f"bytes {first}-{int(first) + len(part) - 1}/{len(body)}")
            body = part
        else:
            self.send_response(200)
        if self.path in links:
            self.send_header("Link", f'<http://127.0.0.1:{self.server.server_port}{links[self.path]}>; rel="next"')
        self.send_header("Content-Length", str(len(body)))
        self.end_headers()
        try:
            self.wfile.write(body)
        except (BrokenPipeError, ConnectionResetError):
            pass

    def log_message(self, *args):
        pass


@pytest.fixture(scope="module")
def host():
    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_headers_are_read_by_ranges_that_grow(host):
    Handler.log.clear()
    file = web.WebFile(f"{host}/m/model.gguf")
    header = gguf.parse_prefixes(lambda n: file.read(0, n), file.size, [1 << 20, 4 << 20])
    assert file.size == len(MODEL) and header.metadata["toy.n"] == 1
    asked = [r for p, r in Handler.log if p == "/m/model.gguf"]
    assert asked[0] == "bytes=0-0" and asked[1] == f"bytes=1-{(1 << 20) - 1}" and asked[2].startswith(f"bytes={1 << 20}-") and len(asked) == 3
    assert file.read(10, 5) == MODEL[10:15]
    whole = web.WebFile(f"{host}/whole.gguf")  # a server that knows no ranges
    assert whole.size == len(MODEL) and whole.read(0, 100) == MODEL[:100] and whole.read(7, 3) == MODEL[7:10]
    with pytest.raises(OSError, match="404"):
        web.WebFile(f"{host}/none")


def test_busy_servers_are_waited_for(host):
    waited = []
    Handler.busy["/m/README.md"] = 2
    assert web.get(f"{host}/m/README.md", 100, sleep=waited.append)[2] == b"from now on" and waited == [7.0, 7.0]
    Handler.busy["/m/README.md"] = 99
    assert web.get(f"{host}/m/README.md", 100, sleep=waited.append)[0] == 429
    Handler.busy.clear()
    with pytest.raises(OSError, match="cannot reach"):
        web.get("http://127.0.0.1:9/x", 1, sleep=lambda s: None)


def test_texts_are_capped_and_tokens_stay_home(host):
    assert web.text(f"{host}/m/README.md", 100) == "from now on" and web.text(f"{host}/m/big.md", 99) is None and web.text(f"{host}/m/no.md", 9) is None
    assert web.headers_for("https://huggingface.co/x", "t") == {"Authorization": "Bearer t"}
    assert web.headers_for("https://huggingface.co.evil.example/x", "t") == web.headers_for("https://cdn.huggingface.co/x", "t") == web.headers_for("https://huggingface.co/x", "") == {}


def test_catalogues_are_paged_and_loops_told(spark, host):
    pages = list(web.pages(f"{host}/c?1"))
    assert [p.rsplit("/", 1)[1] for p, _, _ in pages] == ["c?1", "c?2"]
    schema = "url string, next_url string, body string"
    got = sorted(map(tuple, gate.inventory_of(spark.createDataFrame(pages, schema)).select("repo", "bundle_files", "gguf_files").collect()))
    assert got == [("/c?1", ["README.md"], ["b.gguf"]), ("/c?2", ["README.md"], ["b.gguf"])]
    with pytest.raises(ValueError, match="leads back"):
        list(web.pages(f"{host}/loop?1"))
    looped = spark.createDataFrame([("a", "b", "[]"), ("b", "c", "[]"), ("c", "b", "[]")], schema)
    with pytest.raises(Exception, match="leads back to b"):
        gate.inventory_of(looped).collect()


def test_remote_targets():
    assert cli.remote_target("https://x.example/a.gguf", None) == "https://x.example/a.gguf" and cli.remote_target("s3://b/m", "a.gguf") == "s3://b/m/a.gguf"
    assert cli.remote_target("hf://o/r/d/a.gguf", None) == cli.remote_target("o/r", "d/a.gguf") == "https://huggingface.co/o/r/resolve/main/d/a.gguf"


def test_remote_scan(spark, host, capsys, monkeypatch):
    monkeypatch.setattr(web, "TRIES", 1)
    code = cli.main(["scan", f"{host}/m/model.gguf", "--remote", "--bundle", "--json", "--manifest", "x"])
    out = capsys.readouterr()
    rules = {f["rule_id"] for f in json.loads(out.out)["findings"]}
    assert code == 2 and {"TPL004", "DOC002"} <= rules and not any(r.startswith("STR") for r in rules) and json.loads(out.out)["sha256"] is None
    assert "skipped" in out.err and "ignored" in out.err and "did not run" in out.err
    assert cli.main(["scan", f"{host}/none.gguf", "--remote"]) == 3


def test_corpus_report(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, pairs in {"a": [("general.architecture", "toy"), ("toy.n", 1), ("tokenizer.chat_template", "{{ a|attr('b') }}")], "b": [("general.architecture", "toy"), ("toy.n", 1)]}.items():
        (tmp_path / "in" / f"{name}.gguf").write_bytes(gguf.build(pairs, []))
    (tmp_path / "in" / "c.gguf").write_bytes(b"no")
    told = audit.write_corpus_report(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    assert told["summary"] == {"n_scanned": 2, "n_with_template": 1, "n_with_fail": 1, "n_behavioural": 0, "behavioural_pct": 0.0, "n_architectures": 1, "n_skipped": 1}
    assert [f["fails"] for f in told["fails"]] == [["TPL004"]]
    assert spark.read.json(str(tmp_path / "out" / "results")).count() == 2 and spark.read.json(str(tmp_path / "out" / "skips")).count() == 1
    hits = gate.hit_list(spark.createDataFrame([("b", "inline", None, ["TPL004"], "analyzed"), ("a", "inline", None, ["TPL004", "TPL001"], "analyzed"), ("c", None, None, [], "error")], "repo string, source string, file string, hits array<string>, status string").withColumn("error", gate.F.lit("e")))
    assert [r["repo"] for r in hits.collect()] == ["a", "b"] and hits.first()["hits"] == ["TPL001", "TPL004"]


def test_trial_runs_take_the_first_by_name(spark, tmp_path):
    inventory = spark.createDataFrame([(r, [], ["x.gguf"], None) for r in "cab"], gate.INVENTORY)
    got = gate.run_gate(inventory, str(tmp_path / "g"), {"a": "1"}, most=2)
    assert sorted(r["repo"] for r in got.collect()) == ["a", "b"]
    assert [r["repo"] for r in gate.exclusions(gate.run_gate(inventory.limit(0), str(tmp_path / "g"), {"a": "1"})).collect()] == []
