import json
import random
import re
from pathlib import Path
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from lakeproof.llm import _superminhash, _tokens, _words, token_output
from lakeproof.llm.exact_dedup import MisraGries
from lakeproof.llm.mixing import entropy, solve, totals_of
from lakeproof.llm.near_dedup import forest, linked
from lakeproof.llm.packing import balance
from lakeproof.llm.token_output import TokenFile, encode_file, frequencies
from lakeproof.llm.toxicity import SLOTS, Model, features, fit, risk
from lakeproof.llm.topk_search import basis, merged, search, segment_edges, segment_statistics, summary, summary_bound

TEXTS = ["", None, "one", "a b c d", "A b C d e f", " \t\n", "x " * 400, "é ü ß ñ long " * 30, "a b c d e f", "\x0b\x0ca\rb", "漢 字 テ ス ト 。"]


def brute_shingles(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode()))
    return {tuple(words)} if 0 < len(words) < 5 else {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


@pytest.mark.parametrize("segment", [7, 64, 1 << 21])
def test_shingles_are_those_of_words(monkeypatch, segment):
    monkeypatch.setattr(_words, "SEGMENT", segment)
    sets = [set(s.tolist()) for s in _words.shingle_sets(pa.array(TEXTS))]
    brute = [brute_shingles(t) for t in TEXTS]
    assert [len(s) for s in sets] == [len(b) for b in brute]
    for i, a in enumerate(brute):
        for j, b in enumerate(brute):
            assert len(a & b) == len(sets[i] & sets[j])


def test_sliced_columns_give_their_own_rows():
    column = pa.array(["no"] + TEXTS + ["no"])
    whole = [s.tolist() for s in _words.shingle_sets(pa.array(TEXTS))]
    assert [s.tolist() for s in _words.shingle_sets(column.slice(1, len(TEXTS)))] == whole


def test_signature_of_one_element_is_a_permutation():
    sig = _superminhash.signatures([np.array([9], np.uint64), np.zeros(0, np.uint64)], 64)
    assert sorted((sig[0] >> np.uint64(32)).tolist()) == list(range(64))
    assert (sig[1] == np.uint64((1 << 64) - 1)).all()


@pytest.mark.parametrize("n", [4, 40, 900])
def test_signatures_estimate_similarity(n):
    rng = np.random.default_rng(n)
    pairs = [(s[: n], s[n // 4 :]) for s in (np.unique(rng.integers(0, 1 << 63, 2 * n, dtype=np.uint64))[: n + n // 4] for _ in range(60))]
    a, b = (_superminhash.signatures([np.sort(p[i]) for p in pairs], 128) for i in (0, 1))
    truth = len(np.intersect1d(*pairs[0])) / len(np.union1d(*pairs[0]))
    assert abs((a == b).mean() - truth) < 0.03


def test_links_by_blocks_are_those_by_pairs():
    rng = np.random.default_rng(1)
    base = np.unique(rng.integers(0, 1 << 63, 300, dtype=np.uint64))
    sets = [np.sort(rng.choice(base, rng.integers(200, 290), replace=False)) for _ in range(40)] + [base[:1], base[:1]]
    got = linked(sets, 75)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            common = len(np.intersect1d(a, b))
            assert got[i, j] == (i != j and 100 * common >= 75 * (len(a) + len(b) - common))
    ids, roots = forest(np.arange(42) * 10, got)
    assert dict(zip(ids, roots))[410] == 400


def test_parts_give_the_library_ids():
    e = _tokens.encoder(_tokens.default_tokenizer())
    rng = random.Random(3)
    signs = ["a", "Bc", " ", "  ", "\n", "\t", "'s", "é", "1", ",", ".", "漢", "😀", "_", "'t", "\r\n", "<|endoftext|>", "\x85", "ÿ", "þ", "Ġ", "ü", "Øx", "ɏ"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 16))) for _ in range(3000)] + ["", None, "word, word. word"]
    want = [x.ids for x in e.whole.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert [x.tolist() for x in e.encode(pa.array(texts))] == want
    old, _tokens.CALL, _tokens.SLICE = (_tokens.CALL, _tokens.SLICE), 20, 64
    try:
        assert [x.tolist() for x in e.encode(pa.array(texts))] == want
    finally:
        _tokens.CALL, _tokens.SLICE = old


def test_added_tokens_get_the_ids_of_a_fresh_library_call():
    from tokenizers import Tokenizer

    path = _tokens.default_tokenizer()
    fresh = Tokenizer.from_file(path)
    texts = ["hello <|endoftext|> world", "<|endoftext|>", "one, two.<|endoftext|><|endoftext|> three", "a <|endoftext| > b", "plain text", "漢 <|endoftext|> 字", "", None]
    want = [fresh.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert want[0] == [31373, 220, 50256, 995]
    assert [x.tolist() for x in _tokens.TextEncoder(path).encode(pa.array(texts))] == want


def test_token_output_encodes_each_distinct_part_once_in_a_lot(monkeypatch):
    text = " ".join(f"word{i}" for i in range(100_000))  # about 1 MB, eight times
    batch = pa.RecordBatch.from_arrays([pa.array(range(8)), pa.array([text] * 8)], ["doc_id", "text"])
    told = []
    parts = _tokens.TextEncoder._parts
    monkeypatch.setattr(_tokens.TextEncoder, "_parts", lambda self, some: told.append(len(some)) or parts(self, some))
    monkeypatch.setattr("pyspark.TaskContext.get", lambda: SimpleNamespace(partitionId=lambda: 0))
    (file,) = token_output._writer(None, 2)(iter([batch]))
    assert sum(told) == 100_000
    want = _tokens.encoder(_tokens.default_tokenizer()).whole.encode(text, add_special_tokens=False).ids + [2]
    assert [d.tolist() for d in TokenFile(file.column("file")[0].as_py()).documents()] == [want] * 8


@pytest.mark.parametrize("letter", [_tokens.CUT_LETTER, _tokens.MARK_LETTER])
def test_a_letter_in_a_longer_token_keeps_no_parts_apart(tmp_path, letter):
    from tokenizers import Tokenizer

    known = json.loads(Path(_tokens.default_tokenizer()).read_text())
    known["model"]["vocab"][letter + "a"] = 1 + max([*known["model"]["vocab"].values(), *(t["id"] for t in known["added_tokens"])])
    known["model"]["merges"].insert(0, [letter, "a"] if isinstance(known["model"]["merges"][0], list) else f"{letter} a")
    path = tmp_path / "merging.json"
    path.write_text(json.dumps(known))
    texts = ["a word, a word", "\0a b\1a", ""]
    encoder = _tokens.TextEncoder(str(path))
    assert not encoder.by_parts
    assert [x.tolist() for x in encoder.encode(pa.array(texts))] == [Tokenizer.from_file(str(path)).encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("sizes", [[0], [1], [0, 3, 0], [70_000, 5], [63, 64, 65, 200_000]])
def test_token_files_round_trip(sizes):
    rng = np.random.default_rng(0)
    docs = [np.minimum(rng.zipf(1.4, n) - 1, 50_000) for n in sizes]
    file = TokenFile(encode_file(docs))
    assert file.lengths.tolist() == sizes
    assert all((a == b).all() for a, b in zip(docs, file.documents(), strict=True))


def test_blocks_can_be_entered_at_checkpoints_and_show_damage():
    ids = np.arange(300_000) % 777
    data = encode_file([ids])
    file = TokenFile(data)
    lanes = file.blocks[0][1]
    part = file.decode_block(0, checkpoint=1, steps=3)
    at = file.every * lanes
    assert (part == ids[at : at + 3 * lanes]).all()
    broken = bytearray(data)
    broken[-3] ^= 1
    with pytest.raises(ValueError):
        TokenFile(bytes(broken)).decode_block(0)


def test_frequencies_fill_the_scale():
    for counts in ([0, 5, 0, 1], [1] * 50_000, [10**9, 1], [3]):
        f = frequencies(np.array(counts))
        assert f.sum() == 1 << 20 and ((f > 0) == (np.array(counts) > 0)).all()


@pytest.mark.parametrize("sizes", [[1], [1024], [1, 2, 3], [5000, 7, 1023, 1], list(range(1, 300))])
def test_packing_leaves_no_padding(sizes):
    pieces = balance(sizes)
    ids, fill = {}, {}
    for d, start, n, s, offset in pieces:
        assert n > 0
        ids.setdefault(d, set()).update(range(start, start + n))
        fill.setdefault(s, []).append((offset, n))
    assert {d: len(x) for d, x in ids.items()} == dict(enumerate(sizes)) and sum(p[2] for p in pieces) == sum(sizes)
    for parts in fill.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 1024 and at & (at - 1) == 0


def test_packing_balances_cost():
    rng = np.random.default_rng(0)
    pieces = balance(rng.integers(20, 900, 2000).tolist())
    cost = {}
    for _, _, n, s, _ in pieces:
        cost[s] = cost.get(s, 0) + n + n * n / 1024
    full = [c for s, c in cost.items() if sum(p[2] for p in pieces if p[3] == s) == 1024]
    assert np.std(full) / np.mean(full) < 0.2


def packed_by_force(sizes, capacity, linear, quadratic):
    """The same packing with every sequence looked at for every piece."""
    pieces, rest, sequence = [], [], 0
    for d, size in enumerate(sizes):
        for at in range(0, size - size % capacity, capacity):
            pieces.append((d, at, capacity, sequence, 0))
            sequence += 1
        if size % capacity:
            rest.append((d, size - size % capacity, size % capacity))
    left = sum(n for *_, n in rest)
    rooms = [capacity] * (left // capacity) + [1 << b for b in reversed(range(12)) if (left % capacity) >> b & 1]
    cost, used = [0.0] * len(rooms), [0] * len(rooms)
    for d, at, n in sorted(rest, key=lambda r: (-(linear * r[2] + quadratic * r[2] ** 2), r[0])):
        while n:
            s = min((i for i in range(len(rooms)) if used[i] < rooms[i]), key=lambda i: (cost[i], i))
            take = min(n, rooms[s] - used[s])
            pieces.append((d, at, take, sequence + s, used[s]))
            cost[s] += linear * take + quadratic * take * take
            used[s], at, n = used[s] + take, at + take, n - take
    return pieces


@pytest.mark.parametrize("seed", range(4))
def test_packing_takes_the_lowest_cost_each_time(seed):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(1, [60, 300, 2000, 5000][seed], 150).tolist()
    for linear, quadratic in ((1.0, 1 / 1024), (0.0, 1.0), (1.0, 0.0)):
        assert balance(sizes, 1024, linear, quadratic) == packed_by_force(sizes, 1024, linear, quadratic)


def test_misra_gries_finds_frequent_keys():
    summary = MisraGries(10)
    rng = random.Random(0)
    keys = ["hot"] * 3000 + [str(rng.random()) for _ in range(7000)]
    rng.shuffle(keys)
    for i in range(0, len(keys), 100):
        part = keys[i : i + 100]
        summary.add({k: part.count(k) for k in set(part)})
    assert 3000 - 10_000 / 11 <= summary.counts["hot"] <= 3000 and len(summary.counts) <= 10


def test_mixture_meets_entropy_and_repetition():
    tokens = [1000, 100, 10]
    totals = totals_of([*tokens, 0])

    def weights(m):
        w = [m.weight(t) for t in tokens]
        assert sum(w) == pytest.approx(1)
        return w

    m = solve(totals, max_repeat=2.0)
    shown = [m.repeats(t) for t in tokens]
    assert max(shown) == pytest.approx(2.0) and min(shown) == pytest.approx(1.0)
    for target in (0.2, 0.8, 1.0):
        m = solve(totals, target_entropy=target)
        w = weights(m)
        assert -sum(x * np.log(x) for x in w) == pytest.approx(target if target > 0.36 else -sum(t / 1110 * np.log(t / 1110) for t in tokens), abs=1e-6)
        assert entropy(m.alpha, *totals.sums([m.alpha])[0]) == pytest.approx(-sum(x * np.log(x) for x in w))
    m = solve(totals, max_repeat=3.0, budget=1300.0)
    assert sum(m.repeats(t) * t for t in tokens) == pytest.approx(1300) and max(m.repeats(t) for t in tokens) == pytest.approx(3.0)
    assert solve(totals, max_repeat=None).alpha == 0.0
    assert solve(totals_of([5]), max_repeat=1.0).repeats(5) == 1.0
    assert totals_of([0]) is None
    assert solve(totals, target_entropy=9).alpha == 0.0 and solve(totals, target_entropy=0).alpha == 1.0


def test_segments_bound_products_and_search_is_exact():
    rng = np.random.default_rng(5)
    x = np.floor(rng.normal(size=(3000, 50)) * 20 * np.linspace(3, 0.1, 50) + rng.normal(size=50) * 30)
    x[100:400] = x[7]
    ids = rng.permutation(3000).astype(np.int64)
    for sample in (None, x[::30], x[::100]):  # without one, with a basis, and too small for a basis
        base = basis(50, ids[::30][: 0 if sample is None else len(sample)], sample, 4)
        assert (base.rotation is None) == (sample is None or len(sample) < 50)
        turned = base.turned(x)
        for edges in [np.array([0]), *base.edges]:
            stats = segment_statistics(turned, edges)
            assert (stats[:50] @ stats.T >= x[:50] @ x.T - 1e-4).all()
            groups = [summary(stats[i : i + 100]) for i in range(0, 3000, 100)]
            bound = summary_bound(merged(groups[:2]), np.stack(groups))
            for g in range(30):
                assert bound[g] >= (x[:200] @ x[100 * g : 100 * g + 100].T).max() - 1e-4
        counts = np.zeros(4, np.int64)
        best = search(ids[:60], x[:60], ((ids[i : i + 500], x[i : i + 500]) for i in range(0, 3000, 500)), 20, base, None, counts)
        assert counts[0] == 180_000 and counts[1] >= counts[2] >= counts[3] and counts[3] < 180_000
        for q in range(60):
            want = sorted((-int(s), int(i)) for s, i in zip(x @ x[q], ids) if i != ids[q])[:20]
            got = sorted((-int(s), int(i)) for s, i in zip(best.score[best.q == q], best.id[best.q == q]))
            assert got == want


def test_segments_share_energy():
    assert segment_edges(np.ones(8), 4).tolist() == [0, 2, 4, 6]
    assert segment_edges(np.array([100.0, 1, 1, 1]), 2).tolist() == [0, 1]
    assert segment_edges(np.zeros(3), 2).tolist()[0] == 0


def test_risk_and_gradient_as_by_their_formula():
    rng = np.random.default_rng(4)
    n_p, n_u, size, prior, decay = 7, 11, 5, 0.3, 0.01
    x_p, x_u = rng.random((n_p, size)) < 0.5, rng.random((n_u, size)) < 0.4
    theta = rng.normal(size=size + 1)
    p, u = np.nonzero(x_p), np.nonzero(x_u)

    def parts(t):
        loss = lambda z: np.log1p(np.exp(-z))
        g_p, g_u = x_p @ t[:-1] + t[-1], x_u @ t[:-1] + t[-1]
        return prior * np.mean(loss(g_p)), np.mean(loss(-g_u)) - prior * np.mean(loss(-g_p))

    for bias in (0.0, -8.0):  # the second drives the negative part below zero where confirmed texts outscore the others
        t = theta.copy()
        t[-1] += bias
        if bias:
            t[:-1] = 0
            x_p[:, 0], x_u[:, 0] = True, False
            t[0], p, u = 9.0, np.nonzero(x_p), np.nonzero(x_u)
        positive, negative, grad = risk(t, p, u, n_p, n_u, prior, decay)
        assert (positive, negative) == pytest.approx(parts(t)) and (negative < 0) == bool(bias)
        target = lambda z: (sum(parts(z)) if not bias else -parts(z)[1]) + decay / 2 * (z[:-1] @ z[:-1])
        for k in range(size + 1):
            step = np.zeros(size + 1)
            step[k] = 1e-5
            assert grad[k] == pytest.approx((target(t + step) - target(t - step)) / 2e-5, abs=1e-6)


def test_scores_are_sums_over_all_features_even_of_one_slot():
    texts = ["alpha beta", "alpha", "", None, "gamma " * 50_000 + "beta", "ALPHA, beta!"]
    found = [f.tolist() for f in features(pa.array(texts))]
    hashes = np.unique(np.array(found[0], np.uint64))
    clash = np.array([hashes[0] ^ np.uint64(SLOTS << 3)], np.uint64)  # another feature of the same slot
    weights = np.arange(1, len(hashes) + 2) / 10
    model = Model(np.concatenate([hashes, clash]), weights, -1.0)
    weight = dict(zip([*hashes.tolist(), *clash.tolist()], weights))
    want = [1 / (1 + np.exp(1 - sum(weight.get(f, 0) for f in fs))) for fs in found]
    assert model.scores(pa.array(texts)) == pytest.approx(want)
    assert Model(np.zeros(0, np.uint64), np.zeros(0), 0.0).scores(pa.array(texts)).tolist() == [0.5] * 6


def test_fit_without_words_says_no():
    none = np.zeros(0, np.uint64)
    assert fit([none], [none], 0.1).scores(pa.array(["a"]))[0] < 1e-6
