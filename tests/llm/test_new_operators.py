"""Fill-in-the-middle, fuzzy fingerprints and the filter audit, each against a plain Python version."""

import hashlib
import itertools
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from test_operators import LONG, ROWS, W, frame

from lakeproof.llm import _common, _words, _xxh64, fill_middle, filter_audit, golay_dedup, line_dedup, near_dedup

ODD = [
    (20, "a\x01b \x02 \x020\x021 \x01", "en", "odd"), (21, "has <P> in it " * 9, "en", "odd"), (22, "<M>", "en", "odd"), (23, " \t\n lead and trail \x0b\x0c\r ", "en", "odd"), (24, "  x \U0001f600\U0001f600a\U0001f600 y", "en", "odd"),
    (25, "<" * 40 + " <P <S <M P> S> M> " * 5, "en", "odd"), *((200 + i, f"one two {i} three\nfour  five <{i}", "en", "odd") for i in range(60)),
]
UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
sha = lambda t: hashlib.sha256(t.encode()).hexdigest()


def test_fill_in_middle_as_by_hand(spark):
    rows = ROWS + ODD
    docs = frame(spark, rows)
    out = fill_middle.fill_in_middle(docs)
    assert out.columns[: len(docs.columns)] == docs.columns
    assert out.columns[len(docs.columns) :] == ["n", "form", "prefix", "middle", "suffix", "output"]
    got = out.select("doc_id", "n", "form", "prefix", "middle", "suffix", "output", fill_middle.restored(F.col("output"), F.col("form")).alias("back")).collect()
    expected = []
    for i, text, *_ in rows:
        text, digest = text or "", hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()
        units, (h1, h2, h3, h4) = UNIT.findall(text), (int(digest[k : k + 8], 16) for k in range(0, 32, 8))
        a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
        p, m, s = ("".join(units[x:y]) for x, y in ((0, a), (a, b), (b, None)))
        if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
            expected.append((i, len(units), "plain", None, None, None, text, text))
        elif h4 % 100 < 80:
            expected.append((i, len(units), "spm", p, m, s, f"<S>{s}<P>{p}<M>{m}", text))
        else:
            expected.append((i, len(units), "psm", p, m, s, f"<P>{p}<S>{s}<M>{m}", text))
    assert sorted(map(repr, (tuple(r) for r in got))) == sorted(map(repr, expected))
    assert {e[2] for e in expected} == {"plain", "spm", "psm"}
    assert fill_middle.fill_in_middle(frame(spark, [])).count() == 0


def test_fill_in_middle_keeps_clashing_names(spark):
    docs = frame(spark, ROWS[:3]).withColumn("n", F.lit(7)).withColumn("Form", F.lit("f")).withColumn("output", F.lit("o"))
    out = fill_middle.fill_in_middle(docs)
    assert out.columns[-6:] == ["n_", "form_", "prefix", "middle", "suffix", "output_"]
    assert {(r["n"], r["Form"], r["output"]) for r in out.collect()} == {(7, "f", "o")}


def test_hashes_of_ranges_are_those_of_the_library():
    rnd = random.Random(3)
    data = rnd.randbytes(9000)
    starts = np.array([rnd.randrange(7000) for _ in range(3000)])
    ends = starts + [rnd.choice([rnd.randrange(40), rnd.randrange(1500), 4, 8, 31, 32, 33, 64, 512, 513]) for _ in starts]
    for seed in (0, 42):
        got = _xxh64.hashes(np.frombuffer(data + bytes(8), np.uint8), starts, ends, seed)
        assert got.tolist() == [xxhash.xxh64_intdigest(data[a:b], seed) for a, b in zip(starts, ends)]


def simhash(text, width=3):
    words = re.findall(rb"[^\x20\x09-\x0D]+", bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()))
    shingles = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    bits = [sum(xxhash.xxh64_intdigest(s, 42) >> b & 1 for s in shingles) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * bits[b] > len(shingles))


@pytest.mark.parametrize("segment", [1 << 20, 40, 7])
def test_fingerprints_whatever_the_segments(monkeypatch, segment):
    monkeypatch.setattr(golay_dedup, "SEGMENT", segment)
    texts = [r[1] for r in ROWS if r[1] != LONG and len(r[1] or "") < 9999] + [LONG[:3000], "x", None, "x Y", "", "X  y Z", "é Ж", "p q r s " * 30]
    assert golay_dedup.fingerprints(pa.array(texts)).tolist() == [simhash(t) for t in texts]
    assert golay_dedup.fingerprints(pa.array([], pa.string())).tolist() == []


def test_golay_words_within_two_bits_share_an_index():
    rng = np.random.default_rng(5)
    words = rng.integers(0, 1 << 23, 400)
    code = np.unique(golay_dedup.golay_indices(words)[:, 0])
    assert len(code) > 300 and (golay_dedup._remainders(words ^ golay_dedup.PATTERNS[golay_dedup._remainders(words), 0]) == 0).all()
    assert Counter(len(set(p)) for p in golay_dedup.PATTERNS.tolist()) == {1: 277, 6: 1771}
    for word, mine in zip(words, golay_dedup.golay_indices(words)):
        near = np.array([word ^ sum(1 << b for b in bits) for bits in itertools.combinations(range(23), 2)])
        assert all(set(mine) & set(theirs) for theirs in golay_dedup.golay_indices(near).tolist())


def test_fingerprints_within_two_bits_share_a_key():
    rng = np.random.default_rng(6)
    for value in rng.integers(0, 1 << 63, 5, dtype=np.uint64).tolist():
        near = np.array([value, *(value ^ (1 << a | 1 << b) for a in range(64) for b in range(a + 1))], dtype=np.uint64)
        rows, keys = golay_dedup.fuzzy_keys(near)
        assert set(rows[np.isin(keys, keys[rows == 0])].tolist()) == set(range(len(near)))


def groups_by_force(values, distance=2):
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in itertools.combinations(sorted(set(values)), 2):
        if (a ^ b).bit_count() <= distance:
            root[find(a)] = find(b)
    return {v: find(v) for v in root}


@pytest.mark.parametrize("crowd", [256, 3])
def test_links_connect_what_all_pairs_would(spark, monkeypatch, crowd):
    """With a crowd of 3 most buckets go by neighbouring words."""
    monkeypatch.setattr(golay_dedup, "CROWD", crowd)
    rnd = random.Random(8)
    values = {rnd.getrandbits(64) for _ in range(60)} | {0, 1, (1 << 64) - 1}
    for v in list(values)[:20]:
        for _ in range(12):  # walks away from v by up to three bits a step
            for _ in range(rnd.randrange(1, 4)):
                v ^= 1 << rnd.randrange(64)
            values.add(v)
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    pairs = golay_dedup.links(spark.createDataFrame([(signed(v),) for v in values], "node long")).collect()
    assert all(r["a"] > r["b"] for r in pairs)
    expected, found = groups_by_force(values), {v: v for v in values}

    def find(v):
        while found[v] != v:
            v = found[v]
        return v

    for r in pairs:
        found[find(r["a"] % 2**64)] = find(r["b"] % 2**64)
    same = lambda by: {frozenset(g) for _, g in itertools.groupby(sorted(values, key=by), by)}
    assert same(expected.get) == same(find)


def test_simhash_duplicates_as_by_brute_force(spark):
    base = " ".join(f"{W[i % 20]}{i * i % 83}" for i in range(400))
    near = [(300 + i, base + " " + W[i], "en", "near") for i in range(12)] + [(350 + i, base.replace(W[3], W[4], i), "en", "near") for i in range(6)]
    rows = ROWS + ODD[:6] + near + [(None, base, "en", "near"), (None, "\x00 lone text without id", "en", "near"), (400, None, "en", "x")]
    got = sorted(map(repr, map(tuple, golay_dedup.simhash_duplicates(frame(spark, rows)).collect())))
    prints = [simhash(r[1]) for r in rows]
    group = groups_by_force(prints)
    least = {}
    for (i, *_), p in zip(rows, prints):
        if i is not None:
            least[group[p]] = min(i, least.get(group[p], i))
    assert got == sorted(repr((i, f"{p:016x}", least.get(group[p]))) for (i, *_), p in zip(rows, prints))
    assert len({least.get(group[simhash(t)]) for _, t, *_ in near}) < len(near)
    assert golay_dedup.simhash_duplicates(frame(spark, [])).count() == 0


def audit_by_force(rows, labels):
    quality, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    first, out, removed_all = {}, Counter(), Counter()
    for i, text, *_ in rows:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    failing = []
    for i, text, _, source in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        f = {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), "D": bool(re.search("[#$%&*|]", text)), "E": i is not None and i > first.get(text, i)}
        failing.append((i, source or "", {k for k, v in f.items() if v}))
    for part in {p for _, p, _ in failing}:
        for order in itertools.permutations("ABCDE"):
            for step, name in enumerate(order):
                c = Counter()
                for i, p, f in failing:
                    if p == part:
                        gone, here = bool(f & set(order[:step])), name in f
                        c["kept"] += not gone and not here
                        c["removed"] += here and not gone
                        c["redundant"] += here and gone
                        c["unique_fails"] += f == {name}
                        c["good_lost"] += here and not gone and i in quality
                        c["toxic_lost"] += here and not gone and i in toxic
                out[part, "".join(order), step + 1] = tuple(c[k] for k in filter_audit.COUNTS)
                removed_all[part, name] += c["removed"]
    return {(*k, *v, removed_all[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_filter_audit_as_by_brute_force(spark):
    words = " ".join(f"{W[i % 20]}{i}" for i in range(60))
    rows = ROWS + ODD[:6] + [(500, words, "en", "a"), (501, words, "en", "b"), (502, words + " $", "en", "b"), (503, "LOUD " * 70, "en", "b"), (504, words.upper(), "en", None), (505, None, "en", ""), (None, words, "en", "a"), (499, "LOUD " * 70, "en", "hot")]
    labels = [(1, 1, 0), (3, 0, 1), (500, 1, None), (501, 1, 1), (503, None, 1), (504, 1, 0), (504, 0, 1), (999, 1, 1), (None, 1, 1), (102, 1, 0)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("good", F.lit(1)).withColumn("part", F.lit("x"))
    out = filter_audit.filter_audit(frame(spark, rows).withColumn("part", F.lit(1)).withColumn("mask", F.lit(2)), table)
    assert out.columns == ["part", "filter_order", "step", *filter_audit.COUNTS, "shapley"]
    got = [tuple(r) for r in out.collect()]
    assert len(got) == len(set(got)) == 600 * len({r[3] or "" for r in rows})
    assert set(got) == audit_by_force(rows, labels)
    assert filter_audit.filter_audit(frame(spark, []), table).count() == 0


def test_lattice_audit_takes_other_filters(spark):
    rows = spark.createDataFrame([("p", True, False, True, False), ("p", True, True, None, True), (None, None, False, False, False)], "part string, fails_x boolean, fails_y boolean, good boolean, toxic boolean")
    got = {tuple(r) for r in filter_audit.lattice_audit(rows, "xy").collect()}
    assert got == {
        ("p", "xy", 1, 0, 2, 0, 1, 1, 1, 3), ("p", "xy", 2, 0, 0, 1, 0, 0, 0, 1), ("p", "yx", 1, 1, 1, 0, 0, 0, 1, 1), ("p", "yx", 2, 0, 1, 1, 1, 1, 0, 3),
        *(("", o, s, 1, 0, 0, 0, 0, 0, 0) for o in ("xy", "yx") for s in (1, 2)),
    }
    with pytest.raises(ValueError):
        filter_audit.lattice_audit(rows, "xx")


def thue_morse(n):
    return "".join("ab"[k.bit_count() & 1] for k in range(n))


@pytest.mark.parametrize("letters", [512, 1024, 4096, 65536])
def test_long_words_that_differ_have_different_hashes(letters):
    one = thue_morse(letters)
    (hashes,), _ = _words.word_hashes(pa.array([one, one.translate({97: "b", 98: "a"}), one.upper()]))
    assert hashes[0] != hashes[1] and hashes[0] == hashes[2]


def test_texts_of_long_words_that_differ_stay_apart(spark):
    """Words that a polynomial modulo a power of two can't tell apart, alone and among others."""
    one = thue_morse(2048)
    two = one.translate({97: "b", 98: "a"})
    rows = [(1, one, "en", "a"), (2, two, "en", "a"), (3, f"p q r s {one}", "en", "a"), (4, f"p q r s {two}", "en", "a"), (5, one.upper(), "en", "b")]
    docs = frame(spark, rows)
    got = sorted((r["doc_id"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(docs).collect())
    assert got == [(1, 1, True), (2, 2, True), (3, 3, True), (4, 4, True), (5, 1, False)]
    assert sorted(r["doc_id"] for r in near_dedup.drop_near_duplicates(docs).collect()) == [1, 2, 3, 4]
    import corpus_pipeline

    left = dict(corpus_pipeline.STAGES)["near_dedup"](spark, frame(spark, rows, extra=False), "")
    assert sorted(r["doc_id"] for r in left.collect()) == [1, 2, 3, 4]


@pytest.mark.parametrize("how", ["inner", "left"])
def test_classes_meet_their_rows_whichever_way(spark, monkeypatch, how):
    rows = _common.stage_table(spark.createDataFrame([(k, i) for k in range(40) for i in range(400 if k == 7 else k % 3 + 1)], "k int, i int"), "rows")
    classes = _common.stage_table(rows.groupBy("k").agg(F.count("*").alias("n")).where("k % 4 > 0").withColumn("name", F.concat(F.lit("c"), "k")), "classes")
    near = _common.join_classes(rows, classes, ["k"], how)
    monkeypatch.setattr(_common, "near_if_small", lambda df: df)
    far = _common.join_classes(rows, classes, ["k"], how, share=0.2)
    assert sorted(map(repr, far.select(near.columns).collect())) == sorted(map(repr, near.collect())) and near.count() == (rows.count() if how == "left" else rows.where("k % 4 > 0").count())


@pytest.mark.parametrize(("near", "bloom"), [(500_000, 8_000_000), (0, 8_000_000), (0, 0)])
def test_lines_are_removed_alike_whichever_way_their_texts_go(spark, monkeypatch, near, bloom):
    monkeypatch.setattr(line_dedup, "NEAR", near)
    monkeypatch.setattr(line_dedup, "BLOOM", bloom)
    rows = [(i, f"own {i}\n  shared line \nmore {i}\n\nshared line", "en", f"s{i % 12}") for i in range(24)] + [(i, f"text {i}\nnot shared", "en", "s1") for i in range(100, 140)]
    rows += [(200, None, "en", "s1"), (None, "shared line", "en", None), (201, "shared line\nx", "en", "s2"), (201, "shared line\nx", "en", "s2")]
    got = sorted(map(repr, map(tuple, line_dedup.remove_boilerplate(frame(spark, rows)).collect())))

    def bare(text):
        lines = text.split("\n")
        kept = [x for x in lines if x.strip(" \t\n\r\x0b\x0c") != "shared line"]
        return len(lines), len(lines) - len(kept), "\n".join(kept)

    assert got == sorted(repr((i, *(bare(t) if t is not None else (0, 0, None)))) for i, t, *_ in rows)


def test_beginnings_of_words_have_hashes_of_their_own():
    texts = ["abcdefgh abcdefx abcdzz", "abcde abcd", "ABCDEFGHIJ"]
    (whole, four, seven, nine), offsets = _words.word_hashes(pa.array(texts), letters=True, prefixes=(4, 7, 9))
    assert offsets.tolist() == [0, 3, 5, 6] and len({*whole.tolist()}) == 6
    assert len({*four[[0, 1, 2, 3, 5]].tolist()}) == 1 and four[4] == 0 and four[0] != 0
    assert seven[0] == seven[5] != 0 and not seven[[1, 2, 3, 4]].any() and not nine[:5].any() and nine[5] not in (0, seven[5])
