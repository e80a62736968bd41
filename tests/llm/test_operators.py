import functools
import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import xxhash

from lakeproof.llm import exact_dedup, line_dedup, mixing, near_dedup, packing, sharding, token_output, topk_search, toxicity, url_filter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
W = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omikron pi rho sigma tau upsilon".split()
LONG = " ".join(W[(i * i + 3 * i) % 20] + str(i % 97) for i in range(30_000))
ROWS = [
    (1, " ".join(W), "en", "a"), (2, " ".join(W), "en", "a"), (2, " ".join(W), "en", "a"), (3, " ".join(W[:-1]), "en", "b"), (4, "one two", "en", "b"), (5, "one  two", None, "b"), (6, "", "en", None),
    (7, None, "en", "c"), (13, "see <|endoftext|> there", "en", "c"), (8, " \n\t", "en", "c"), (None, "no id here at all", "en", "c"), (9, LONG, "en", "a"), (10, LONG + " x", "en", "a"), (11, "a\nb\n\nc", "de", "d"), (12, "ONE TWO", "de", "d"),
    *((100 + i, " ".join([*W[i:], *W[:i], str(i % 7)]), "en", "hot") for i in range(20)),
]


def frame(spark, rows=ROWS, extra=True):
    df = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], SCHEMA)
    if extra:  # names that the operators use themselves
        for c in ("kept", "size", "block", "row", "id", "tokens", "Score", "a.b"):
            df = df.withColumn(c, df["doc_id"])
    return df


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark)


@pytest.fixture(scope="module")
def empty(spark):
    return frame(spark, [])


def shingles(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return {tuple(words)} if 0 < len(words) < 5 else {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def test_near_duplicates_as_by_brute_force(spark, docs, empty):
    got = sorted((r["doc_id"] or -1, r["n_shingles"], r["component_id"] or -1, r["kept"]) for r in near_dedup.near_duplicates(docs).collect())
    sets = [(r[0], shingles(r[1])) for r in ROWS]
    root = {i: i for i, _ in sets}
    for _ in range(5):
        for i, a in sets:
            for j, b in sets:
                if i and j and a and b and 100 * len(a & b) >= 75 * len(a | b):
                    root[i] = root[j] = min(root[i], root[j])
    assert got == sorted((i or -1, len(s), root[i] or -1, i is None or root[i] == i) for i, s in sets)
    assert near_dedup.near_duplicates(empty).count() == 0
    left = near_dedup.drop_near_duplicates(docs)
    assert left.columns == docs.columns and {1, 9, 6, 7, 8, 4, 13} <= {r["doc_id"] for r in left.collect()} and not {2, 10, 5} & {r["doc_id"] for r in left.collect()}


def components_by_force(rows):
    """Per row its component's smallest doc_id, by comparing all pairs of rows."""
    sets = [shingles(t) if i is not None else set() for i, t, *_ in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for k, a in enumerate(sets):
        for m in range(k):
            if a and sets[m] and 100 * len(a & sets[m]) >= 75 * len(a | sets[m]):
                root[find(k)] = find(m)
    least = {}
    for k, (i, *_) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return [(i, len(shingles(t)), i if i is None else least[find(k)]) for k, (i, t, *_) in enumerate(rows)], [find(k) for k in range(len(rows))]


FAMILY = [f"w{i}" for i in range(60)]
REPEATED = [
    (1, " ".join(W), "en", "a"), (5, " ".join(W[:-1]), "en", "a"), (5, "an unrelated text of more than five words", "en", "b"), (5, " ".join(W).upper(), "en", "b"), (1, " ".join(W).upper(), "en", "b"), (5, "an unrelated text of more than five words", "en", "b"),
    (7, "an unrelated text of more than five words", "en", "c"),
]


@pytest.mark.parametrize("lot", [2])
def test_near_duplicates_go_by_row_not_by_doc_id(spark, monkeypatch, lot):
    monkeypatch.setattr(near_dedup, "LOT_ROWS", lot)
    want, _ = components_by_force(REPEATED)
    got = near_dedup.near_duplicates(frame(spark, REPEATED)).collect()
    assert sorted(map(tuple, got)) == sorted((*w, w[0] == w[2]) for w in want)
    left = [(r["doc_id"], r["text"].lower()) for r in near_dedup.drop_near_duplicates(frame(spark, REPEATED)).collect()]
    assert sorted(left) == [(1, " ".join(W)), (5, "an unrelated text of more than five words")]


@pytest.mark.parametrize("lot, size", [(4, 8 << 20), (512, 900)])
def test_large_and_drifting_families_lose_no_link(spark, monkeypatch, lot, size):
    monkeypatch.setattr(near_dedup, "LOT_ROWS", lot)
    monkeypatch.setattr(near_dedup, "LOT_BYTES", size)
    rows = [(i, " ".join(FAMILY[: 57 + i % 4] + [f"t{i}"]), "en", "x") for i in range(40)]
    rows += [(100 + i, " ".join(f"d{k}" for k in range(4 * i, 4 * i + 60)), "en", "x") for i in range(30)]  # each is like its neighbours alone
    rows += [(200 + i, " ".join(f"e{k}" if k % 9 or k // 9 != i else f"own{i}" for k in range(54)), "en", "y") for i in range(6)]
    want, _ = components_by_force(rows)
    got = near_dedup.near_duplicates(frame(spark, rows, False)).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == sorted(want)


def test_exact_duplicates_and_their_removal(spark, docs, empty):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = defaultdict(list)
    for i, t, *_ in ROWS:
        groups[norm(t)].append((-len(t or ""), i is None, i))
    got = exact_dedup.exact_duplicates(docs).collect()
    assert len(got) == len(ROWS)
    for r, n in zip(sorted(got, key=lambda r: (r["text_sha256"], r["doc_id"] or -1)), range(99)):
        group = next(g for t, g in groups.items() if hashlib.sha256(t.encode()).hexdigest() == r["text_sha256"])
        assert r["group_size"] == len(group) and r["keep_id"] == min(group)[2]
    assert sum(r["kept"] for r in got) == len(groups)
    for heavy in (0.0005, 0.2):
        left = exact_dedup.drop_exact_duplicates(docs, heavy=heavy)
        assert left.columns == docs.columns
        kept = left.collect()
        assert len(kept) == len(groups) and {norm(r["text"]) for r in kept} == set(groups)
    assert exact_dedup.exact_duplicates(empty).count() == 0


def test_heavy_digests_settle_where_they_lie(spark):
    rows = [(i, "same text" if i % 3 == 0 else f"text {i}", "en", "x") for i in range(600)]
    got = exact_dedup.exact_duplicates(frame(spark, rows, False), heavy=0.05).collect()
    assert {r["keep_id"] for r in got if r["group_size"] == 200} == {0} and sum(r["kept"] for r in got) == 401


def test_mixing_repeats_small_sources(spark, docs, empty):
    mixed = mixing.mix(docs, max_repeat=2.0)
    assert mixed.columns == docs.columns
    counts = defaultdict(int)
    for r in mixed.collect():
        counts[r["doc_id"]] += 1
    assert set(counts) == {r[0] for r in ROWS} and max(counts.values()) <= 4
    assert mixing.mix(empty).count() == 0
    rows = [(i, "w " * 10, "en", "big" if i < 900 else "small") for i in range(1000)]
    out = mixing.mix(frame(spark, rows, False), max_repeat=3.0, details=True).collect()
    n = {s: sum(r["source"] == s for r in out) for s in ("big", "small")}
    assert n["big"] == 900 and abs(n["small"] - 300) <= 1
    again = mixing.mix(frame(spark, rows, False), max_repeat=3.0, details=True).collect()
    assert sorted((r["doc_id"], r["epoch"]) for r in out) == sorted((r["doc_id"], r["epoch"]) for r in again)
    half = mixing.mix(frame(spark, rows, False), max_repeat=None, budget=4000.0).collect()
    assert abs(len(half) - 800) <= 2  # ten letters and spaces are five tokens


def spark_hash(*values):
    """What Spark's xxhash64 gives for ints below 2**31 as written (int), longs as (long,) and strings."""
    h = 42
    for v in values:
        if v is not None:
            raw = v.encode() if isinstance(v, str) else v[0].to_bytes(8, "little", signed=True) if isinstance(v, tuple) else v.to_bytes(4, "little", signed=True)
            h = xxhash.xxh64_intdigest(raw, seed=h)
    return (h - (1 << 64) if h >> 63 else h) % (1 << 62)


def mixed_by_force(rows, alpha, budget, seed=17):
    """The (doc_id, epoch) pairs of a mixture, one source after the other."""
    groups = defaultdict(list)
    for i, t, _, s in rows:
        groups["null" if s is None else "s:" + s].append((spark_hash(seed, None if i is None else (i,), t), i, -(-len((t or "").encode()) // 4)))
    totals = {s: sum(n for *_, n in g) for s, g in groups.items()}
    most = max(totals.values())
    norm = sum((t / most) ** alpha for t in totals.values() if t)
    out = []
    for s, g in groups.items():
        times = (budget or most * norm) * (totals[s] / most) ** alpha / norm / totals[s] if totals[s] else 1.0
        full = int(times + 1e-9)
        out += [(i, e) for _, i, _ in g for e in range(full)]
        left = (times - full) * totals[s] if times - full > 1e-9 else -1
        blocks = defaultdict(list)
        for h, i, n in g:
            blocks[h % 4096].append((h, i, n))
        for b in sorted(blocks, key=lambda b: (spark_hash(seed, s, full, b), b)):
            for h in sorted({h for h, *_ in blocks[b]}):
                tied = [x for x in blocks[b] if x[0] == h]
                left -= sum(n for *_, n in tied)
                if left >= 0:
                    out += [(i, full) for _, i, _ in tied]
            if left < 0:
                break
    return sorted(out, key=str)


@pytest.mark.parametrize("options", [{"max_repeat": 2.0}, {"max_repeat": None}, {"target_entropy": 1.2}, {"max_repeat": 3.0, "budget": 9000.0}, {"max_repeat": None, "budget": 700.0}])
def test_mixing_as_by_brute_force(spark, options):
    rows = ROWS[:9] + ROWS[11:] + [(1000 + i, f"text number {i} " * (1 + i % 9), "en", "abcd"[i % 7 % 4]) for i in range(200)] + [(7, None, "en", "silent"), (8, "", "en", "silent")]
    per = defaultdict(int)
    for _, t, _, s in rows:
        per[s] += -(-len((t or "").encode()) // 4)
    alpha = mixing.solve(mixing.totals_of(list(per.values())), **options).alpha
    got = mixing.mix(frame(spark, rows), details=True, **options).collect()
    assert sorted(((r["doc_id"], r["epoch"]) for r in got), key=str) == mixed_by_force(rows, alpha, options.get("budget"))


def test_sharding_is_near_equal_and_gapless(spark, docs, empty):
    rows = [(i, "hot" * 50 if i % 3 == 0 else f"text {i} " * (i % 50), "en", "x") for i in range(6000)]
    got = sharding.assign_shards(frame(spark, rows, False)).collect()
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r)
        text = rows[r["doc_id"]][1]
        assert r["size"] == len(text) + 16 and r["text_crc32"] == zlib.crc32(text.encode()) and r["law"] == "bytes"
    assert set(by) == set(range(40)) and all(sorted(r["slot"] for r in s) == list(range(len(s))) for s in by.values())
    sizes = [sum(r["size"] for r in s) for s in by.values()]
    assert max(sizes) < 1.1 * sum(sizes) / 40
    assert len(sharding.assign_shards(docs).collect()) == len(ROWS) and sharding.assign_shards(empty).count() == 0


def shards_by_force(rows, shards, ranges, sampled, numbered):
    """(place among the rows, shard, slot) by plain loops: ``rows`` are (doc_id, text, row)."""
    signed = lambda h: h - (1 << 64) if h >> 63 else h

    def chain(*values):
        seed = 42
        for v in values:
            if v is not None:
                seed = xxhash.xxh64_intdigest(v if isinstance(v, bytes) else int(v[0]).to_bytes(v[1], "little", signed=True), seed)
        return signed(seed)

    word = lambda v: None if v is None else (v, 8)
    keys = [chain((t or "").encode()) for _, t, _ in rows]
    sizes = [len((t or "").encode()) + 16 for _, t, _ in rows]
    total, wide, weights = sum(sizes), shards * ranges, defaultdict(int)
    for (d, _, row), key, size in zip(rows, keys, sizes):
        draws = size * (shards * sampled / total)
        u = (chain((11, 4), word(key), word(d), word(row)) % (1 << 30) + 1) / (1 << 30)
        weights[key] += int(draws) + (u <= draws - int(draws))
    weights = {k: w for k, w in weights.items() if w}
    whole, seen, edges = sum(weights.values()), 0, set()
    for key in sorted(weights):
        before, seen = seen, seen + weights[key]
        if any(before * wide < i * whole <= seen * wide for i in range(1, wide)) and seen * wide < wide * whole:
            edges.add(key)
        if weights[key] * wide >= whole:
            edges |= {key, key + 1}
    edges = sorted(edges)
    ranged = [sum(e <= k for e in edges) for k in keys]
    lone = {n for n in ranged if 0 < n < len(edges) and edges[n] == edges[n - 1] + 1}
    pieces = defaultdict(lambda: defaultdict(list))
    for n in set(ranged):
        inside = [i for i, r in enumerate(ranged) if r == n]
        over = max(len(inside) / max(1, 2 * len(rows) / wide), sum(sizes[i] for i in inside) / max(1, 2 * total / wide))
        parts = max(1, min(len(inside), int(over + 0.999)))
        lots = -(-len(inside) // (numbered * (parts if n in lone else 1)))
        for i in inside:
            d, _, row = rows[i]
            part = chain((5, 4), word(d), word(row)) % parts if n in lone else chain((5, 4), word(keys[i])) % parts
            pieces[n, part][chain((7, 4), word(d), word(row)) % lots].append(i)
    out, before, shard, filled = [], 0, 0, [0] * shards
    for piece in sorted(pieces):
        size = sum(sizes[i] for lot in pieces[piece].values() for i in lot)
        shard = max(shard, min(shards - 1, int((before + size / 2) * shards / total)))
        before += size
        for lot in sorted(pieces[piece]):
            for i in sorted(pieces[piece][lot], key=lambda i: (keys[i], rows[i][0] is not None, rows[i][0] or 0, rows[i][2])):
                out.append((i, shard, filled[shard]))
                filled[shard] += 1
    return sorted(out)


@pytest.mark.parametrize("numbered", [3, 50, 1 << 21])
def test_shards_are_those_of_plain_loops(spark, numbered):
    rows = [(i, "hot" * 20 if i % 3 == 0 else None if i % 50 == 1 else f"text {i % 211} " * (i % 23), "en", str(i)) for i in range(1500)] + [(None, "null id " * 300, "en", "1500"), (7, "w " * 20_000, "en", "1501")]
    got = sharding.assign_shards(frame(spark, rows, False).coalesce(1), shards=5, ranges=8, sampled=400, numbered=numbered).collect()
    want = shards_by_force([(r[0], r[1], i) for i, r in enumerate(rows)], 5, 8, 400, numbered)
    size = lambda i: len((rows[i][1] or "").encode()) + 16
    assert sorted((r["shard"], r["slot"], r["doc_id"] or -1, r["size"]) for r in got) == sorted((s, slot, rows[i][0] or -1, size(i)) for i, s, slot in want)


@functools.cache
def _library():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def _ids(text):
    return _library().encode(text or "", add_special_tokens=False).ids


def test_token_output_reads_back(spark, docs, empty):
    got = token_output.read_tokens(token_output.write_tokens(docs)).collect()
    want, at = [], 0
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    for i, t, *_ in sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*_ids(t), 2]
        want.append((i, at, len(ids), crc(ids)))
        at += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    assert token_output.read_tokens(token_output.write_tokens(empty)).count() == 0


def test_packing_covers_every_id(spark, docs, empty):
    got = packing.pack_sequences(docs).collect()
    full = {}
    for i, t, *_ in ROWS:
        full[i] = np.array([*_ids(t), 0], "<u4")
    copies = defaultdict(int)
    for r in got:
        ids = full[r["doc_id"]]
        assert r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
        copies[r["doc_id"]] += r["length"]
    assert all(copies[i] == sum(r[0] == i for r in ROWS) * len(full[i]) for i in full)
    used = defaultdict(int)
    for r in got:
        used[r["sequence_id"]] += r["length"]
    assert all(n <= 1024 and n & (n - 1) == 0 for n in used.values())
    assert packing.pack_sequences(empty).count() == 0


def test_equal_texts_share_a_shard_unless_they_fill_a_range(spark):
    rows = [(i, "hot" * 40 if i % 3 == 0 else f"pair {i // 7} " * 9, "en", "x") for i in range(9000)] + [(None, None, None, None)] * 3 + [(5, "w " * 3_000_00, "en", "x")] * 2
    got = sharding.assign_shards(frame(spark, rows)).collect()
    homes = defaultdict(set)
    for r in got:
        homes[r["text_crc32"]].add(r["shard"])
    hot = zlib.crc32(("hot" * 40).encode())
    assert len(homes[hot]) > 4 and all(len(h) == 1 for c, h in homes.items() if c != hot and c != zlib.crc32(b"w " * 3_000_00)) and len(got) == len(rows)
    assert sum(r["doc_id"] is None and r["size"] == 16 for r in got) == 3


@pytest.mark.parametrize("component, fits", [(2.0**22, True), (2.0**26, False), (1e300, False)])
def test_scores_beyond_64_bits_are_an_error(spark, component, fits):
    df = spark.createDataFrame([(i, [component * (1 + i % 3)] * 4) for i in range(40)], "vec_id long, embedding array<double>")
    if fits:
        want = max(4 * int(64 * component * (1 + i % 3)) * int(64 * component) for i in range(1, 40))
        assert {r["score"] for r in topk_search.top_k(df).where("query_id = 0 and rank = 1").collect()} == {want}
    else:
        with pytest.raises(Exception, match="64 bits"):
            topk_search.top_k(df).collect()


def test_rows_that_tie_at_a_budget_end_go_together_and_count_each(spark):
    same = [(None, "tied words of one source", "en", "a")] * 400
    rows = same + [(i, f"other {i} " * 5, "en", "b") for i in range(300)]
    tokens = sum(-(-len(r[1]) // 4) for r in rows)
    got = mixing.mix(frame(spark, rows, False), details=True, budget=0.7 * tokens).collect()
    shown = [r["epoch"] for r in got if r["doc_id"] is None]
    assert len(shown) % 400 == 0 and {shown.count(e) for e in shown} <= {400}
    per = defaultdict(int)
    for r in rows:
        per[r[3]] += -(-len(r[1]) // 4)
    alpha = mixing.solve(mixing.totals_of(list(per.values())), budget=0.7 * tokens).alpha
    assert sorted(((r["doc_id"], r["epoch"]) for r in got), key=str) == mixed_by_force([(r[0], r[1], r[2], r[3]) for r in rows], alpha, 0.7 * tokens)


def test_repeated_null_and_long_rows_fare_alike(spark):
    huge = "word " * 400_000 + "\n" + "z" * 2_000_000
    rows = [(1, huge, "en", "a"), (1, huge, "en", "a"), (None, "null id", "en", "a"), (None, None, None, None), (2, "", "en", "b")]
    df = frame(spark, rows)
    labels = spark.createDataFrame([(1, 1, 1), (2, 1, 0), (None, None, None)], "doc_id long, quality int, toxic int")
    scores = [(r["doc_id"], r["score"], r["held_out"]) for r in toxicity.toxicity(df, labels).collect()]
    assert len(scores) == 5 and len({s for i, s, _ in scores if i == 1}) == 1 and all(0 <= s <= 1 for _, s, _ in scores) and not any(h for i, _, h in scores if i is None)
    assert sorted((r["doc_id"] or -1, r["n_lines"], len(r["text"] or "")) for r in line_dedup.remove_boilerplate(df).collect()) == [(-1, 0, 0), (-1, 1, 7), (1, 2, len(huge)), (1, 2, len(huge)), (2, 1, 0)]
    assert sorted((r["doc_id"] or -1, r["group_size"], r["kept"]) for r in exact_dedup.exact_duplicates(df).collect()) == [(-1, 1, True), (-1, 2, False), (1, 2, False), (1, 2, True), (2, 2, True)]
    assert sorted(r["n_shingles"] for r in near_dedup.near_duplicates(df).collect()) == [0, 0, 1, 2, 2]
    assert mixing.mix(df, max_repeat=1.0).count() >= 5
    want = sorted([len(_ids(t)) + 1 for _, t, *_ in rows])
    assert sorted(r["n_tokens"] for r in token_output.read_tokens(token_output.write_tokens(df)).collect()) == want
    per = defaultdict(int)
    for r in packing.pack_sequences(df).collect():
        per[r["occurrence"]] += r["length"]
    assert sorted(per.values()) == want


def test_toxicity_learns_words_and_keeps_clean_ones(spark, docs, empty):
    rng = np.random.default_rng(2)
    filler = [f"word{i}" for i in range(400)]
    rows, labels = [], []
    for i in range(1500):
        words = list(rng.choice(filler, 40))
        bad = i % 9 == 0
        if bad:
            words[5] = ["nasty", "vilething", "hatefulx"][i % 3]
        rows.append((i, " ".join(words), "en", "x"))
        if i % 2 == 0:
            labels.append((i, 1, int(bad)))
    tagged = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.toxicity(frame(spark, rows), tagged).collect()}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    wrong = [i for i, r in got.items() if r["held_out"] and r["predicted"] != (i % 9 == 0)]
    assert len(wrong) <= 3 and all(0 <= r["score"] <= 1 for r in got.values())
    left = toxicity.drop_toxic(frame(spark, rows), tagged)
    assert left.columns == frame(spark, rows[:1]).columns and sum(r["doc_id"] % 9 != 0 for r in left.collect()) >= 1330
    none = tagged.limit(0)
    assert {r["predicted"] for r in toxicity.toxicity(docs, none).collect()} == {0}
    assert toxicity.toxicity(empty, tagged).count() == 0


@pytest.mark.parametrize("n", [0, 3, 60, 400])
def test_features_counted_by_spark_give_the_model_of_the_plain_fit(spark, tmp_path, n):
    rng = np.random.default_rng(n)
    rows = []
    for i in range(n):
        each = np.unique(rng.integers(1, 900, rng.integers(0, 40)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        if i % 7 == 3:
            each = np.union1d(each, np.array([5, 6, 2**64 - 1], np.uint64)[: 1 + i % 3])
        rows.append((i % 7 == 3 and i % 2 == 1, i // 2 if i % 5 == 0 else i, each))
    table = pa.table({"confirmed": pa.array([r[0] for r in rows], pa.bool_()), "doc_id": pa.array([r[1] for r in rows], pa.int64()), "features": pa.array([r[2].view(np.int64) for r in rows], pa.list_(pa.int64()))})
    pq.write_table(table, tmp_path / "features.parquet")
    got = toxicity._learnt(spark.read.parquet(str(tmp_path / "features.parquet")), 0.1)
    known = {d for c, d, _ in rows if c}
    rest = [(f, d in known) for c, d, f in rows if not c]
    want = toxicity.fit([f for c, _, f in rows if c], [f for f, _ in rest], 0.1, [k for _, k in rest])
    assert got.hashes.tolist() == want.hashes.tolist() and (n < 400 or len(want.hashes))
    assert np.allclose(got.weights, want.weights, atol=1e-9) and abs(got.bias - want.bias) < 1e-9


def test_toxicity_learns_from_a_handful_of_confirmed_texts(spark):
    rng = np.random.default_rng(5)
    rows, labels = [], []
    for i in range(200):
        words = list(rng.choice([f"word{j}" for j in range(400)], 40))
        if i % 20 == 4:
            words[5:7] = ["nasty", "vilething"]
        rows.append((i, " ".join(words), "en", "x"))
        labels.append((i, 1, int(i % 20 == 4)))
    held = {i for i, *_ in rows if zlib.crc32(str(i).encode()) % 5 == 0}
    assert 0 < sum(t for i, _, t in labels if i not in held) < 8  # fewer than the old fixed floor
    got = {r["doc_id"]: r["predicted"] for r in toxicity.toxicity(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert all(got[i] == (i % 20 == 4) for i in got)


URLS = [
    ("http://a.example.org/x", "org/", "allow"), ("http://a.example.org/es/1", "example.org/es/", "block"), ("http://EXAMPLE.org/en/12?q", "example.org/en/1", "block"), ("https://x.com/fr/a#b", "com/fr/", "allow"),
    ("https://x.com/de/", "com/de/", "block"), ("https://x.com/de", None, None), ("https://notexample.orgs/es/", None, None), ("http://example.org", None, None), ("no scheme", None, None), (None, None, None), ("://", None, None), ("", None, None),
]


def test_urls_by_rule_and_by_cascade(spark):
    rows = [(i, u) for i, (u, _, _) in enumerate(URLS)] + [(100 + i, f"http://h{i}.net/p") for i in range(500)]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", url_filter.F.lit("z"))
    listed = spark.createDataFrame([(f"h{i}.net",) for i in range(0, 500, 3)] + [("elsewhere",), (None,)], "key string")
    for keys in (url_filter.PART_KEYS, 60):  # one part, and three
        got = {r["page_id"]: r for r in url_filter.judge_urls(pages, listed, part_keys=keys).collect()}
        for i, (_, rule, verdict) in enumerate(URLS):
            assert got[i]["rule"] == rule and got[i]["verdict"] == (verdict or "allow")
        assert got[2]["host"] == "example.org" and got[2]["path"] == "/en/12" and got[8]["host"] == got[9]["path"] == ""
        assert all(got[100 + i]["verdict"] == ("block" if i % 3 == 0 else "allow") for i in range(500))
    assert url_filter.judge_urls(pages.limit(0), listed).count() == 0 and url_filter.judge_urls(pages, listed.limit(0)).where("rule is null and verdict = 'block'").count() == 0
    long = "http://long.net/" + "x" * 3_000_000
    odd = spark.createDataFrame([(1, long), (1, long), (1, "http://h0.net/"), (None, "http://h0.net/a")], "page_id long, url string")
    got = url_filter.judge_urls(odd, listed).collect()
    assert sorted(((r["page_id"] or -1), len(r["path"]), r["verdict"]) for r in got) == [(-1, 2, "block"), (1, 1, "block"), (1, 3_000_001, "allow"), (1, 3_000_001, "allow")]


def test_large_filters_have_their_words_in_order(spark):
    keys = spark.range(40_000).select(url_filter.F.concat(url_filter.F.lit("k"), "id").alias("key"))
    listed = keys.where("substring(key, 2) % 2 = 0")
    cascade = url_filter.Cascade(keys, listed, 6000)
    assert cascade.parts == 4 and cascade.levels[0].bits > 64 * url_filter.RUN / 8
    for p in range(4):
        mine = keys.where(url_filter.part_of(url_filter.F.col("key"), 4) == p)
        assert mine.where(cascade.contains(url_filter.F.col("key"), p) != (url_filter.F.expr("substring(key, 2) % 2 = 0"))).count() == 0


def test_boilerplate_lines_go(spark, docs, empty):
    rows = [(i, f"common line\nown {i} line\n\n common line \nnear {i % 8}", "en", f"s{i % 12}") for i in range(240)]
    got = {r["doc_id"]: r for r in line_dedup.remove_boilerplate(frame(spark, rows)).collect()}
    assert all(got[i]["text"] == f"own {i} line\n\nnear {i % 8}" and got[i]["n_lines"] == 5 and got[i]["n_removed"] == 2 for i in range(240))
    exact = {r["doc_id"]: r["n_removed"] for r in line_dedup.remove_boilerplate(frame(spark, rows), min_sites=3).collect()}
    assert set(exact.values()) == {3}
    got = {r["doc_id"]: r for r in line_dedup.remove_boilerplate(docs).collect()}
    assert got[7]["text"] is None and got[7]["n_lines"] == 0 and got[6]["text"] == "" and got[11]["text"] == "a\nb\n\nc"
    assert line_dedup.remove_boilerplate(empty).count() == 0


def test_top_k_with_nulls_ties_and_lengths(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(150)] + [(160 + i, [1.0] * 8) for i in range(50)]
    rows += [(300, None), (320, [None] + [1.0] * 7), (340, [float("nan")] * 8), (360, [float("inf")] * 8), (None, [1.0] * 8), (380, [1.0, 2.0]), (400, [3.0, 4.0]), (401, []), (160, [1.0] * 8), (420, [5.0]), (440, []), (161, [2.0] * 8), (180, [0.5] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("ids", topk_search.F.lit(1))
    got = defaultdict(list)
    for r in topk_search.top_k(df).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    clean = list(dict.fromkeys((i, tuple(np.floor(64 * np.array(v, dtype=np.float32).astype(float)))) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)))
    for q in {i for i, _ in clean}:
        if q % 20:
            assert q not in got
            continue
        v = min(x for i, x in clean if i == q)
        want = sorted((-int(np.dot(v, x)), i) for i, x in clean if i != q and len(x) == len(v))[:20]
        assert [(-s, i) for _, i, s in sorted(got.get(q, []))] == want and [r for r, *_ in sorted(got.get(q, []))] == list(range(1, len(want) + 1))
    assert topk_search.top_k(df.limit(0)).count() == 0


def test_clusters_are_pruned_before_and_within_cells(spark, monkeypatch):
    monkeypatch.setattr(topk_search, "SAMPLE_ROWS", 600)
    monkeypatch.setattr(topk_search, "PER_PIVOT", 100)
    monkeypatch.setattr(topk_search, "DATA_BLOCK", (100, 1 << 20))
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 48))
    x = (centres[rng.integers(0, 12, 3000)] + rng.normal(size=(3000, 48)) * 0.05).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    left = list(topk_search.pruning(df).values())
    assert left == sorted(left, reverse=True) and left[0] < 150 * 3000 * 0.7 and left[-1] < left[1] * 0.5 < left[0]
    y = np.floor(64 * x.astype(float))
    got = defaultdict(list)
    for r in topk_search.top_k(df).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    for q in range(0, 3000, 20):
        want = sorted((-int(s), i) for i, s in enumerate(y @ y[q]) if i != q)[:20]
        assert sorted(got[q]) == [(n + 1, i, -s) for n, (s, i) in enumerate(want)]


def test_long_vectors_fit(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 1024)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    y = np.floor(64 * x.astype(float))
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in topk_search.top_k(df, k=3).collect()}
    for q in range(0, 400, 20):
        want = sorted((-int(s), i) for i, s in enumerate(y @ y[q]) if i != q)[:3]
        assert [got[q, n + 1] for n in range(3)] == [(i, -s) for s, i in want]


def test_pipeline_as_by_brute_force(spark, tmp_path):
    import corpus_pipeline

    rng = np.random.default_rng(3)
    filler = [f"word{i}" for i in range(300)]
    rows = []
    for i in range(400):
        words = list(rng.choice(filler, 30 + i % 40))
        if i % 10 == 0:
            words[3:5] = ["nasty", "vilething"]
        rows.append((i, " ".join(words), "en", "abc"[0 if i % 5 < 3 else i % 3]))
    rows += [(500 + i, rows[i][1].replace(" ", "  ", i % 3), "en", "b") for i in range(1, 60)]  # copies but for white space
    rows += [(600 + i, rows[i][1] + " and another end", "de", "c") for i in range(30, 90)]  # near copies
    rows += [(7, rows[11][1] + " tail", "en", "a"), (7, "a text of its own under an id that others have", "en", "a"), (900, None, None, None), (901, "", "en", "silent"), (None, "no id but a text of more than five words", "en", "a")]
    frame(spark, rows, False).write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, 1, int(i % 10 == 0)) for i in range(400) if i % 2 == 0 or i % 10 == 5]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))

    first = corpus_pipeline.STAGES[0][1](spark, docs, str(tmp_path)).collect()
    told = toxicity.toxicity(docs, spark.read.parquet(str(tmp_path / "labels.parquet"))).collect()
    assert len(first) == sum(not r["predicted"] for r in told) and {r["doc_id"] for r in told if r["predicted"]} >= {i for i in range(0, 400, 10)}
    rest = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in first]
    assert sum(r[0] is not None and r[0] < 400 and r[0] % 10 > 0 for r in rest) >= 355  # clean documents stay

    groups = defaultdict(list)
    for r in rest:
        groups[re.sub(r"[\x20\x09-\x0D]", "", r[1] or "")].append(r)
    rest = [min(g, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0])) for g in groups.values()]
    told, root = components_by_force(rest)
    stays = {}
    for r, (i, _, component), k in zip(rest, told, root):
        if i is None or i == component:
            stays.setdefault(k, r)
    rest = list(stays.values())
    totals = defaultdict(int)
    for _, t, _, s in rest:
        totals[s] += -(-len((t or "").encode()) // 4)
    want = mixed_by_force(rest, mixing.solve(mixing.totals_of(list(totals.values()))).alpha, None)
    texts = {(i, t) for i, t, *_ in rest}
    ids = {i: [(*_ids(t), 0) for j, t in texts if j == i] for i, _ in texts}

    pieces = defaultdict(list)
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    for r in out:
        pieces[r["occurrence"]].append(r)
    assert sorted((p[0]["doc_id"] for p in pieces.values()), key=str) == sorted((i for i, _ in want), key=str)
    for ps in pieces.values():
        ps.sort(key=lambda r: r["start"])
        whole = next(d for d in ids[ps[0]["doc_id"]] if len(d) == ps[0]["doc_tokens"])
        assert [p["start"] for p in ps] == [sum(q["length"] for q in ps[:k]) for k in range(len(ps))] and sum(p["length"] for p in ps) == len(whole)
        assert all(p["ids_crc32"] == zlib.crc32(np.array(whole[p["start"] : p["start"] + p["length"]], "<u4").tobytes()) for p in ps)
    fill = defaultdict(list)
    for r in out:
        fill[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in fill.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))]
        assert (size := sum(n for _, n in parts)) <= 1024 and size & (size - 1) == 0


@pytest.mark.parametrize("rows", [[], ROWS], ids=["empty", "odd"])
def test_pipeline_stages_fit_together(spark, tmp_path, rows):
    import corpus_pipeline

    docs = frame(spark, rows)  # with names that the operators use themselves
    spark.createDataFrame([(1, 1, 0), (2, 1, 1), (None, None, None)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, str(tmp_path))
        assert after.columns == docs.columns, name
        after.write.parquet(str(tmp_path / name))
        docs = spark.read.schema(after.schema).parquet(str(tmp_path / name))
    n = docs.count()
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    assert {"doc_id", "sequence_id", "offset"} <= set(pieces.columns) and pieces.select("occurrence").distinct().count() == n == (0 if not rows else n) and (n > 0) == bool(rows)
