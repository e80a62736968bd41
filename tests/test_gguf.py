import hashlib
import struct

import pytest

from lakeproof.functions import fixed
from lakeproof.plans import audit
from lakeproof.sources import gguf

BASE = [("general.architecture", "toy"), ("toy.context_length", 4096), ("general.alignment", 32), ("flag", True), ("ratio", 0.5), ("minus", -3), ("big", 1 << 40)]


def test_round_trip():
    data = gguf.build(BASE + [("list", list(range(200))), ("words", [f"t{i}" for i in range(100)])], [("a.weight", [64, 128], 0), ("b.weight", [64, 64], 8)])
    h = gguf.parse_header(data)
    assert h.metadata["toy.context_length"] == 4096 and h.metadata["flag"] is True and h.metadata["minus"] == -3 and h.metadata["big"] == 1 << 40
    words = h.metadata["words"]
    assert words.length == 100 and len(words.preview) == fixed.PREVIEW and words.truncated and words.max_elem_bytes == 3
    assert [t[:3] for t in h.tensors] == [("a.weight", [64, 128], 0), ("b.weight", [64, 64], 8)] and h.data_start % 32 == 0
    whole = gguf.parse_header(data, materialize=["words"]).metadata["words"]
    assert len(whole.preview) == 100 and not whole.truncated


def test_projection_and_metadata_only():
    data = gguf.build([*BASE, ("tokenizer.chat_template", "first"), ("tokenizer.chat_template", "last")], [("a", [4], 0)])
    only = gguf.parse_header(data, keys=["tokenizer.chat_template"])
    assert only.metadata == {"tokenizer.chat_template": "last"} and not only.tensors
    assert gguf.parse_header(data, mode="metadata").data_start == 0


@pytest.mark.parametrize(
    ("data", "error", "short"),
    [
        (b"NOPE" + b"\0" * 40, "magic", False), (b"GG", "exceeds", True), (struct.pack("<4sIQQ", b"GGUF", 9, 0, 0), "version", False), (struct.pack("<4sIQQ", b"GGUF", 3, 0, 1 << 60), "cannot fit", True),
        (struct.pack("<4sIQQ", b"GGUF", 3, 1 << 60, 0), "cannot fit", True),
        (struct.pack("<4sIQQ", b"GGUF", 3, 0, 1) + struct.pack("<Q1sI", 1, b"k", fixed.ARRAY) + struct.pack("<IQ", fixed.UINT32, 10**9), "cannot fit", True),
        (struct.pack("<4sIQQ", b"GGUF", 3, 0, 1) + struct.pack("<Q1sI", 1, b"k", fixed.ARRAY) + struct.pack("<IQ", fixed.ARRAY, 1) + b"\0" * 20, "not supported", False),
        (gguf.build([], [("a", [1] * 9, 0)]), "dimensions", False),
    ],
)
def test_broken_headers(data, error, short):
    with pytest.raises(gguf.HeaderError, match=error) as e:
        gguf.parse_header(data)
    assert isinstance(e.value, gguf.Short) == short


def test_prefix_ladder_stops_where_the_header_ends():
    data = gguf.build([("k", "x" * 5000)], [("a", [64], 0)], data_len=1 << 16)
    asked = []

    def read(n):
        asked.append(n)
        return data[:n]

    h = gguf.parse_prefixes(read, len(data), [1000, 4000, 16000, 64000])
    assert asked == [1000, 4000, 16000] and h.tensors[0][0] == "a"
    with pytest.raises(gguf.Short):
        gguf.parse_prefixes(read, len(data), [1000])


MODELS = {
    "gap": ([*BASE, ("toy.block_count", 3)], [("blk.0.a.weight", [32], 0), ("blk.2.a.weight", [32], 0)], {}, {"MET010"}),
    "partial": ([*BASE, ("toy.block_count", 10)], [(f"blk.{i}.a.weight", [32], 0) for i in range(5)], {}, set()),
    "shard": ([*BASE, ("toy.block_count", 3), ("split.count", 33)], [("blk.0.a.weight", [32], 0), ("blk.2.a.weight", [32], 0)], {}, {"INT006"}),
    "hostile_layer": ([*BASE, ("toy.block_count", 3)], [("blk.999999999999.a.weight", [32], 0)], {}, {"MET010", "INT005"}),
    "own_head_size": ([*BASE, ("toy.embedding_length", 5120), ("toy.attention.head_count", 24), ("toy.attention.key_length", 256)], [], {}, set()),
    "sizes": (
        [*BASE, ("toy.embedding_length", 99), ("toy.attention.head_count", 8), ("toy.attention.head_count_kv", 3), ("toy.feed_forward_length", 99)],
        [("token_embd.weight", [64, 32], 0), ("blk.0.ffn_up.weight", [64, 32], 0)], {}, {"MET011", "MET012", "MET013"},
    ),
    "label": ([*BASE, ("general.file_type", 1)], [("blk.0.a.weight", [32], 0), ("blk.0.b.weight", [32], 1), ("blk.0.c.weight", [32], 0)], {}, {"MET014"}),
    "rope": ([*BASE, ("toy.rope.scaling.original_context_length", 9999), ("toy.rope.freq_base", -1.0)], [], {}, {"MET015"}),
    "twice": ([*BASE, ("general.architecture", "toy")], [], {}, {"MET016"}),
    "tokens": (
        [*BASE, ("tokenizer.ggml.tokens", ["a", "b", "y" * 5000]), ("tokenizer.ggml.scores", [1.0, 2.0]), ("tokenizer.ggml.token_type", [1, 9, 1]), ("tokenizer.ggml.eos_token_id", 99), ("tokenizer.ggml.add_bos_token", True)],
        [("token_embd.weight", [2, 2], 0)], {}, {"TOK001", "TOK002", "TOK003", "TOK004", "TOK005"},
    ),
    "unset_ids": ([*BASE, ("tokenizer.ggml.tokens", ["a"]), ("tokenizer.ggml.eos_token_id", 0xFFFFFFFF), ("tokenizer.ggml.bos_token_id", -1)], [], {}, set()),
    "bounds": ([*BASE], [("a", [4], 0), ("b", [1 << 40, 1 << 40], 0), ("c", [5], 8), ("d", [0], 0), ("e", [4], 200)], {"offsets": [10**9, 0, 0, 0, 0]}, {"STR001", "STR003", "STR004", "STR006", "STR007", "MET006"}),
    "alignment": ([("general.architecture", "toy"), ("toy.x", 1), ("general.alignment", 7)], [], {}, {"STR005"}),
    "names": ([*BASE], [("../etc/passwd", [4], 0), ("n" * 65, [4], 0), ("x.lora_a", [4], 0), ("dup", [4], 0), ("dup", [4], 0)], {}, {"STR008", "INT005"}),
    "bare": ([("general.architecture", "toy")], [("a", [4], 0)], {}, {"MET005"}),
    "values": (
        [*BASE, ("general.note", "see http://a.b/c"), ("general.source.url", "http://a.b/c"), ("general.ip", "at 10.0.0.1"), ("general.long", "z" * 9000), ("general.hid", "a​b"), ("general.say", "From now on"), ("odd.key", 1),
         ("general.tpl", "{{ x|attr('y') }}"), ("general.list", ["http://q.r", "s" * 20])], [], {}, {"MET001", "MET002", "MET003", "MET020", "MET021", "TPL004"},
    ),
    "clean": ([*BASE], [("blk.0.a.weight", [64, 4], 0)], {}, set()),
}
QUIET = {"MET003", "MET004", "TPL101"}


@pytest.fixture(scope="module")
def found(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("models")
    for name, (pairs, tensors, options, _) in MODELS.items():
        (folder / f"{name}.gguf").write_bytes(gguf.build([p for p in pairs if name == "values" or p[0] not in ("flag", "ratio", "minus", "big")], tensors, **options))
    (folder / "broken.gguf").write_bytes(b"GGUF")
    out = {}
    for r in audit.audit(spark, str(folder)).collect():
        out.setdefault(r["model_id"].rsplit("/", 1)[-1].removesuffix(".gguf"), []).append(r)
    return out


@pytest.mark.parametrize("name", MODELS)
def test_models_show_their_faults_and_no_others(found, name):
    expected = MODELS[name][3]
    quiet = QUIET - expected
    assert {r["rule_id"] for r in found.get(name, [])} - quiet == expected


def test_findings_come_in_order_and_broken_files_give_none(found):
    assert "broken" not in found
    rank = {"FAIL": 0, "WARN": 1, "INFO": 2}
    for rows in found.values():
        keys = [(rank[r["severity"]], r["rule_id"], r["location"] or "") for r in rows]
        assert keys == sorted(keys)
    assert [r["location"] for r in found["values"] if r["rule_id"] == "MET001"] == ["general.ip", "general.list", "general.note"]


def test_report_is_the_same_each_time(found):
    text = audit.render_json("m", "s", None, found["sizes"])
    assert text == audit.render_json("m", "s", None, found["sizes"]) and text.isascii() and '"fail": 4' in text
    assert "POTENTIALLY" in audit.render_text("m", None, None, found["sizes"]) and "No risk" in audit.render_text("m", None, None, [])


def test_whole_files_give_the_same_tables(spark, tmp_path):
    (tmp_path / "a.gguf").write_bytes(gguf.build([*BASE, ("list", [1, 2]), ("words", ["x", "y"])], [("a", [4, 2], 0), ("b", [4], 200)]))
    (tmp_path / "b.gguf").write_bytes(b"GGUF")
    for one, other in zip(gguf.load(spark, str(tmp_path)), gguf.load_bytes(spark, str(tmp_path))):
        bare = lambda df: sorted(str(r.asDict(True) | {"model_id": r["model_id"].rsplit("/", 1)[-1], "path": ""}) for r in df.collect())
        assert one.columns == other.columns and bare(one) == bare(other)


def test_an_audit_reads_each_file_once(spark, tmp_path, monkeypatch):
    for name in "ab":
        (tmp_path / f"{name}.gguf").write_bytes(gguf.build([*BASE], [("a", [4, 2], 0)]))
    loaded = []
    real = gguf.written
    monkeypatch.setattr(gguf, "written", lambda df, tag: loaded.append(df._jdf.queryExecution().executedPlan().toString().count("BatchScan")) or real(df, tag))
    plan = audit.audit(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert loaded == [1] and "BatchScan gguf" not in plan and "Scan parquet" in plan


def test_weights_are_hashed_on_demand_only(spark, tmp_path):
    raw = gguf.build([*BASE], [("a", [4, 2], 0)])
    (tmp_path / "a.gguf").write_bytes(raw)
    assert gguf.load(spark, str(tmp_path))[0].first()["sha256"] is None
    assert {t.first()["sha256"] for t in (gguf.load(spark, str(tmp_path), sha256="true")[0], audit.hashes(spark, str(tmp_path)))} == {hashlib.sha256(raw).hexdigest()}


def test_ranges_of_a_store_are_read_by_the_ladder(tmp_path, monkeypatch):
    from pyarrow import fs

    raw = gguf.build([*BASE, ("long", "z" * 3_000_000)], [("a", [4, 2], 0)])
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.gguf").write_bytes(raw)
    (tmp_path / "in" / "note.txt").write_text("x")
    monkeypatch.setattr(gguf, "file_system", lambda uri: (fs.SubTreeFileSystem(str(tmp_path), fs.LocalFileSystem()), uri.split("://")[1]))
    assert gguf.found_files("store://in") == ["store://in/a.gguf"] == gguf.found_files("store://in/a.gguf")
    for ladder, error in (("1", True), ("1,4", False), (None, False)):
        options = {"path": "store://in", "table": "models"} | ({"prefix_mb": ladder} if ladder else {})
        reader = gguf._Reader(options)
        (row,) = [r for part in reader.partitions() for r in reader.read(part)]
        assert (row[8] is not None) == error and row[4] == len(raw) and not row[9]


def test_many_files_are_dealt_over_a_bounded_number_of_tasks(monkeypatch):
    monkeypatch.setattr(gguf, "MOST_TASKS", 3)
    monkeypatch.setattr(gguf, "found_files", lambda path: [str(i) for i in range(8)])
    assert sorted(f for part in gguf._Reader({"path": "x"}).partitions() for f in part.paths) == [str(i) for i in range(8)] and len(gguf._Reader({"path": "x"}).partitions()) == 3


@pytest.fixture
def pushing(spark):
    conf = "spark.sql.python.filterPushdown.enabled"
    before = spark.conf.get(conf)
    spark.conf.set(conf, "true")
    yield
    spark.conf.set(conf, before)


def _folder(tmp_path):
    for name in "abc":
        pairs = [*BASE, ("long", "z" * 4000), ("words", [f"t{i}" for i in range(50)]), ("long", name)]
        (tmp_path / f"{name}.gguf").write_bytes(gguf.build(pairs, [("a", [4, 2], 0)]))
    good = gguf.build([*BASE, ("long", "x")], [("a", [4, 2], 0)])
    (tmp_path / "cut.gguf").write_bytes(good[: good.index(b"a", good.index(b"long")) + 2])  # its tensors are cut off, so it has no metadata rows
    return str(tmp_path)


@pytest.mark.parametrize(
    ("table", "condition", "pushed"),
    [
        ("metadata", "key = 'long'", "EqualTo(key"), ("metadata", "key in ('big', 'words', 'flag')", "In(key"), ("metadata", "key = 'none'", "EqualTo(key"), ("metadata", "key = 'long' and key in ('long', 'big')", "In(key"),
        ("metadata", "key = 'long' and ord > 8", "EqualTo(key"), ("metadata", "key = 'long' or ord = 1", None), ("metadata", "key like 'l%'", None), ("metadata", "key is null", None),
        ("tensors", "name = 'a'", None), ("tensors", "model_id like '%b.gguf'", None), ("models", "path = '{a}'", "EqualTo(path"), ("headers", "model_id in ('{a}', 'x')", "In(model_id"), ("metadata", "key = 'long' and model_id = '{a}'", "EqualTo(model_id"),
    ],
)
def test_filters_go_to_the_files_and_rows_stay_the_same(spark, tmp_path, pushing, table, condition, pushed):
    path = _folder(tmp_path)
    condition = condition.format(a=f"{path}/a.gguf")
    spark.dataSource.register(gguf.GgufSource)
    read = lambda on: spark.read.format("gguf").options(table=table, pushdown=on).load(path).where(condition)
    got = read("true")
    assert sorted(map(str, got.collect())) == sorted(map(str, spark.read.format("gguf").options(table=table).load(path).where(condition).collect()))
    plan = spark._jvm.PythonSQLUtils.explainString(got._jdf.queryExecution(), "formatted")
    assert pushed in plan if pushed else "PushedFilters" not in plan, plan


def test_pushed_filters_leave_files_unopened_and_values_undecoded(tmp_path, monkeypatch):
    path = _folder(tmp_path)
    reader = gguf._PushingReader({"path": path, "table": "metadata"})
    rest = [gguf.In(("name",), ("x",)), gguf.EqualTo(("arr", "key"), "x")]
    assert list(reader.pushFilters([gguf.EqualTo(("key",), "long"), *rest, gguf.In(("model_id",), (f"{path}/a.gguf", f"{path}/cut.gguf"))])) == rest
    opened, decoded = [], []
    real, handle = gguf._value, gguf._Handle
    monkeypatch.setattr(gguf, "_Handle", lambda p: opened.append(p) or handle(p))
    monkeypatch.setattr(gguf, "_value", lambda c, kind, whole, keep=True: decoded.append(keep) or real(c, kind, whole, keep))
    rows = [r for part in reader.partitions() for r in reader.read(part)]
    assert sorted(opened) == [f"{path}/a.gguf", f"{path}/cut.gguf"] and [(r[1], r[2], len(r[4])) for r in rows] == [(7, "long", 4000), (9, "long", 1)]
    assert sum(decoded) == 3 and len(decoded) == 18
