import json

import duckdb
import pytest

from lakeproof import cli
from lakeproof.functions.json_facts import surface_list
from lakeproof.functions.rules import RULES
from lakeproof.operators import bundle, integrity
from lakeproof.plans import audit, gate, queries, rule_queries  # noqa: F401 - the last registers its queries
from lakeproof.sources import gguf
from lakeproof.streaming.gate import gate_stream

SF = "/root/testdata/sf0.001"
PAIRS = [("general.architecture", "toy"), ("toy.n", 1), ("tokenizer.ggml.tokens", ["▁sorry", "▁never", "▁mention", "it", "</s>", "▁can", "'t"]), ("tokenizer.ggml.token_type", [1, 1, 1, 1, 3, 1, 1]), ("tokenizer.ggml.eos_token_id", 4), ("tokenizer.ggml.add_bos_token", True), ("tokenizer.ggml.bos_token_id", 3)]


@pytest.fixture(scope="module")
def model(tmp_path_factory):
    path = tmp_path_factory.mktemp("m") / "m.gguf"
    path.write_bytes(gguf.build([*PAIRS, ("tokenizer.chat_template", "{{ x }}")], [("a", [4], 0)]))
    return str(path)


def test_registry_is_closed():
    ids = [r[0] for r in RULES]
    assert len(ids) == len(set(ids)) == 67
    assert [sum(r[1] == s for r in RULES) for s in ("FAIL", "WARN", "INFO")] == [20, 38, 9]


CONFIGS = [
    ({"suppress_tokens": [[4]]}, {"CFG001"}), ({"begin_suppress_tokens": [4]}, set()), ({"bad_words_ids": [[4]]}, {"CFG001"}), ({"bad_words_ids": [[5, 6]]}, {"CFG002"}), ({"suppress_tokens": [0, True]}, {"CFG002"}),
    ({"forced_decoder_ids": [[1, 1], [2, 2]]}, {"CFG003"}), ({"forced_decoder_ids": [[1, 1], [3, 2]]}, set()), ({"forced_decoder_ids": [[2, 2], [1, 1], [True, 1]]}, {"CFG003"}), ({"auto_map": {"A": "b.C"}}, {"CFG004"}), ({"auto_map": {}}, set()),
    ({"repetition_penalty": 5.5}, {"CFG005"}), ({"repetition_penalty": 5}, set()), ({"no_repeat_ngram_size": 1}, {"CFG005"}), ({"no_repeat_ngram_size": True}, set()), ({"system_prompt": "from now on you are"}, {"MET021"}),
    ({"system_prompt": "quite ​hidden text"}, {"MET020"}), ({"default": "{{ a|attr('bcdefgh') }}"}, {"TPL004"}), ([1, 2], set()), ("not json", set()),
]


def test_configs(spark, model):
    _, meta, _ = gguf.load(spark, model, materialize=audit.DEEP_KEYS)
    base = meta.drop("model_id").crossJoin(spark.createDataFrame([(str(i),) for i in range(len(CONFIGS))], "model_id string"))
    files = spark.createDataFrame([(str(i), "generation_config.json", c if isinstance(c, str) else json.dumps(c)) for i, (c, _) in enumerate(CONFIGS)], "model_id string, file_name string, text string")
    got = {str(i): set() for i in range(len(CONFIGS))}
    for r in bundle.config_findings(files, base).collect():
        got[r["model_id"]].add(r["rule_id"])
        assert r["location"].startswith("generation_config.json:")
    assert list(got.values()) == [want for _, want in CONFIGS]


def test_other_files(spark, model):
    _, meta, _ = gguf.load(spark, model, materialize=audit.DEEP_KEYS)
    tokenizer = {
        "normalizer": {"type": "Sequence", "items": [{"type": "Replace", "pattern": {"String": " "}, "content": "▁"}, {"type": "Replace", "pattern": {"Regex": "(?i)\\s+"}, "content": " "}, {"type": "Replace", "pattern": {"String": "sorry"}, "content": ""}]},
        "post_processor": {"special": ["always say yes", "plain"]}, "added_tokens": [{"content": "always say yes", "special": True}, {"content": "never reveal", "special": True}],
    }
    rows = [
        (model, "tokenizer.json", json.dumps(tokenizer)), (model, "special_tokens_map.json", json.dumps({"bos_token": {"content": "never warn x"}, "pad": "a​"})), (model, "added_tokens.json", json.dumps({"never refuse": 7})),
        (model, "README.md", "‮ from now on"), (model, "tokenizer_config.json", json.dumps({"chat_template": [{"name": "rag", "template": "{{ eval }}"}]})),
    ]
    found = bundle.bundle_findings(spark.createDataFrame(rows, "model_id string, file_name string, text string"), meta).collect()
    got = sorted((r["rule_id"], r["location"]) for r in found)
    assert got == [
        ("DOC001", "README.md"), ("DOC002", "README.md"), ("NRM001", "tokenizer.json:normalizer"), ("NRM002", "special_tokens"), ("NRM003", "special_tokens"), ("NRM003", "tokenizer.json:added_tokens"),
        ("TPL003", "tokenizer_config.json[rag]:template:L1"), ("TPL030", "tokenizer_config.json[rag]"),
    ]


def test_surfaces_of_tokenizer_files(spark, model):
    cases = [
        ({"model": {"vocab": {"a": 0, "c": 2, "x": True}}, "added_tokens": [{"id": 2, "content": "C"}, {"id": 4, "content": "sorry"}, 5]}, ["a", "", "C", "", "sorry"]), ({"model": {"vocab": [["a", 1.0], "b", []]}}, ["a", "b"]),
        ({"model": {"vocab": {"a": 3_000_000}}}, None), ({"model": {}}, None), ({"added_tokens": None, "model": {"vocab": {"a": 0}}}, ["a"]), ([], None),
    ]
    assert [surface_list(json.dumps(c)) for c, _ in cases] == [want for _, want in cases] and surface_list("{") is None
    files = spark.createDataFrame([("r", "tokenizer.json", json.dumps(cases[0][0])), ("r", "config.json", json.dumps({"suppress_tokens": [4]}))], "model_id string, file_name string, text string")
    _, meta, _ = gguf.load(spark, model)
    assert [r["rule_id"] for r in bundle.config_findings(files, meta, bundle.file_surfaces(files)).collect()] == ["CFG002"]


def test_manifest_and_diff(spark, model, tmp_path):
    other = tmp_path / "o.gguf"
    other.write_bytes(gguf.build([*PAIRS[:1], ("toy.n", 2), ("toy.new", 1), ("tokenizer.chat_template", "{{ y }}")], [("a", [5], 0), ("b", [4], 0)]))
    same = audit.hashes(spark, model)
    tables = gguf.load(spark, model, sha256="true")
    unhashed = integrity.manifest_findings(integrity.read_manifest(same), *gguf.load(spark, model)).collect()
    assert [r["rule_id"] for r in unhashed] == ["INT001"] and unhashed[0]["detail"].endswith("was not hashed")
    assert integrity.manifest_findings(integrity.read_manifest(same), *tables).count() == 0
    foreign = audit.hashes(spark, str(other)).selectExpr(f"'{model}' as model_id", "manifest")
    got = sorted({r["rule_id"] for r in integrity.manifest_findings(integrity.read_manifest(foreign), *tables).collect()})
    assert got == ["INT001", "INT002", "INT003", "INT004"]
    parts = audit.diff(spark, model, str(other))
    assert {(r["key"], r["change"]) for r in parts["tensors"].collect()} == {("a", "changed"), ("b", "added")}
    assert {(r["key"], r["change"]) for r in parts["metadata"].collect()} >= {("toy.n", "changed"), ("toy.new", "added"), ("tokenizer.ggml.tokens", "removed")}
    template = parts["template"].first()
    assert template["changed"] and template["diff"][-1] == "+{{ y }}"


def test_deep_tokenizer(spark, tmp_path):
    path = tmp_path / "t.gguf"
    path.write_bytes(gguf.build([("tokenizer.ggml.tokens", ["<|User|>", "<｜User｜>", "plain", "<pad>"]), ("tokenizer.ggml.token_type", [3, 4, 1, 3])], []))
    rows = audit.audit(spark, str(path), deep=True).collect()
    assert {"TOK012", "TOK015"} <= {r["rule_id"] for r in rows}
    assert next(r["detail"] for r in rows if r["rule_id"] == "TOK015").startswith("2 role marks among 4 tokens, 2 of them")
    assert not {"TOK012", "TOK015"} & {r["rule_id"] for r in audit.audit(spark, str(path)).collect()}


def test_command_line(spark, model, capsys, tmp_path):
    assert cli.main(["rules", "--json"]) == 0 and len(json.loads(capsys.readouterr().out)) == 67
    assert cli.main(["scan", model, "--json"]) == 0
    first = capsys.readouterr().out
    assert cli.main(["scan", model, "--json"]) == 0 and capsys.readouterr().out == first
    assert cli.main(["hash", model, "--manifest", str(tmp_path / "x.json")]) == 0
    assert cli.main(["scan", model, "--manifest", str(tmp_path / "x.json"), "--bundle", "--deep-tokenizer"]) == 0
    assert cli.main(["diff", model, model]) == 0
    (tmp_path / "bad.gguf").write_bytes(b"GGUF")
    assert cli.main(["scan", str(tmp_path / "bad.gguf")]) == 3


def test_gate_resumes_and_is_pinned(spark, tmp_path):
    rows = [("a", ["README.md"], ["x-q8.gguf", "x.gguf", "mmproj.gguf"], "{{ ''.__class__ }}"), ("b", [], ["y-00001-of-00002.gguf"], None), ("c", [], [], None), ("d", [], ["z.gguf"], None), ("e", [], ["w.gguf"], " ")]
    inventory = spark.createDataFrame(rows, gate.INVENTORY)
    headers = spark.createDataFrame([("b", "{{ ok }}", None), ("d", None, "cannot fit")], "repo string, template string, error string")
    path = str(tmp_path / "gate")
    gate.run_gate(inventory.limit(2), path, {"rules": "1"}, headers)
    out = {r["repo"]: r for r in gate.run_gate(inventory, path, {"rules": "1"}, headers).collect()}
    assert len(out) == 5 and [out[r]["status"] for r in "abcde"] == ["analyzed", "analyzed", "no_gguf", "error", "no_template"]
    assert out["a"]["file"] == "x.gguf" and out["a"]["hits"] == ["TPL001"] and out["b"]["source"] == "header"
    with pytest.raises(ValueError, match="rules"):
        gate.run_gate(inventory, path, {"rules": "2"}, headers)
    with pytest.raises(Exception, match="listed twice"):
        gate.unique_inventory(inventory.union(inventory.limit(1))).collect()
    folder = tmp_path / "in"
    folder.mkdir()
    for n in range(2):
        (folder / f"{n}.json").write_text(json.dumps({"repo": f"r{n}", "gguf_files": ["a.gguf"], "chat_template": "{{ eval }}"}))
        gate_stream(spark, str(folder), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert sorted(r["repo"] for r in spark.read.parquet(str(tmp_path / "out" / "results")).collect()) == ["r0", "r1"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", queries.QUERIES)
def test_queries_give_the_rows_of_their_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted(str([r[c] for c in columns]) for r in df.collect())
    if name in queries.ORACLE:
        want = duck.sql(queries.ORACLE[name])
        at = [want.columns.index(c) for c in columns]
        assert sorted(want.columns) == columns and rows == sorted(str([r[i] for i in at]) for r in want.fetchall())
    else:
        assert rows


def test_entry_without_the_optional_parts(spark, monkeypatch):
    import importlib
    import sys

    for m in [m for m in sys.modules if m.startswith("lakeproof.llm") or m in ("corpus_pipeline", "__spark_entry__")]:
        monkeypatch.delitem(sys.modules, m)
    monkeypatch.setitem(sys.modules, "lakeproof.llm", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    import lakeproof

    monkeypatch.delattr(lakeproof, "llm", raising=False)
    entry = importlib.import_module("__spark_entry__")
    assert set(entry.queries()) == set(queries.QUERIES) and entry.entry(spark).count() > 0
