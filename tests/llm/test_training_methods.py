"""The operators' inner methods against brute force, without Spark."""

import math
import random
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("tallyline.llm")
from tallyline.llm import archive, decontaminate, packing, quality, search, tokenfile, toxicity  # noqa: E402
from tallyline.llm.queries import tokenizer_file  # noqa: E402
from tallyline.llm.tokens import Encoder  # noqa: E402

ODD = ["", "ΣΑΣ Σ", "İstanbul I", "ﬁn ªº ß ẞ Ǆ", "áb é", "x<|endoftext|>y <|ENDOFTEXT|>", "don't I'LL 'S", "a b\x1cc\x85d e", "naïve. ÉTÉ!! ÇA", "日本語", "..bar ,.x", "\r\n\t x"]


def test_ids_equal_the_library():
    e = Encoder(tokenizer_file(), limit=20)
    for text in [*ODD, " ".join(ODD), "Thing thing. Thing, thing! " * 50]:
        want = [*e.tokenizer.encode(text, add_special_tokens=False).ids, 1]
        assert np.frombuffer(e.ids(text), "<u4").tolist() == want
    assert np.frombuffer(e.ids(None), "<u4").tolist() == [1]


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 5000])
def test_frame_round_trip(n):
    rng = np.random.default_rng(n)
    ids = np.where(rng.random(n) < 0.05, rng.integers(0, 2**32, n), rng.integers(100, 900, n)).astype(np.uint32)
    cut = sorted(rng.integers(0, n + 1, 3).tolist())
    lengths = np.diff([0, *cut, n]).tolist()
    frame = tokenfile.encode_frame([5, None, -7, 2**40], lengths, ids)
    docs, got_lengths, got = tokenfile.decode_frame(frame)
    assert docs == [5, None, -7, 2**40] and got_lengths.tolist() == lengths and np.array_equal(got, ids)
    for b in range(-(-n // 256)):
        assert np.array_equal(tokenfile.read_block(frame, b), ids[256 * b : 256 * b + 256])


def test_plan_fills_every_piece_once():
    rng = random.Random(3)
    for _ in range(60):
        cap = rng.choice([1, 7, 100, 4096])
        counts = Counter(rng.randint(1, cap) for _ in range(rng.randint(0, 300)))
        patterns = packing.plan(dict(counts), cap)
        used = Counter()
        for p, n in patterns:
            assert sum(p) <= cap and sum(3 * x > cap and len(p) > 0 for x in p) <= max(2, cap // max(p) if 3 * max(p) <= cap else 2)
            for x in p:
                used[x] += n
        assert used == counts
        assert sum(n for _, n in patterns) >= math.ceil(sum(k * v for k, v in counts.items()) / cap)


def test_automaton_equals_windows():
    rng = random.Random(5)
    for _ in range(150):
        items = [(str(i), " ".join(rng.choice("abc") for _ in range(rng.randint(0, 9))).encode()) for i in range(rng.randint(0, 5))]
        words = [rng.choice("abcd").encode() for _ in range(rng.randint(0, 60))]
        auto = decontaminate.Automaton(items, window=4)
        spans, found = auto.matches(words)
        hit, names = set(), set()
        for name, text in items:
            w = text.split()
            size = min(4, len(w))
            for a in range(len(w) - size + 1 if w else 0):
                for p in range(len(words) - size + 1):
                    if words[p : p + size] == w[a : a + size]:
                        hit.update(range(p, p + size))
                        names.add(name)
        assert {i for a, b in spans for i in range(a, b)} == hit and sum(b - a for a, b in spans) == len(hit)
        assert {auto.names[k] for k in found} == names


def test_loser_tree_merges_in_order():
    rng = random.Random(1)
    for k in range(9):
        runs = [sorted((rng.randint(0, 9), rng.randint(0, 9)) for _ in range(rng.randint(0, 12))) for _ in range(k)]
        assert list(archive.merge_runs(runs)) == sorted(x for r in runs for x in r)


@pytest.mark.parametrize("page", [None, 0, -3, 2**62])
def test_record_round_trip(page):
    import hashlib

    for payload in (b"", b"a\r\n\r\nWARC/1.1\r\n\r\nb" * 9, "é\x00".encode()):
        sha1 = hashlib.sha1(payload).hexdigest()
        assert archive.read_record(archive.write_record(page, "http://a.b/ü\r\nx: y", payload, sha1, None, False)) == (page, len(payload), sha1, "response", None)
        assert archive.read_record(archive.write_record(page, None, payload, sha1, 9, True)) == (page, len(payload), sha1, "revisit", 9)


def test_block_search_equals_brute_force():
    rng = np.random.default_rng(2)
    for n, k in ((3, 5), (40, 5), (2000, 5)):
        v = rng.integers(-6, 7, (n, 4)).astype(float)
        ids = rng.permutation(n).astype(np.int64)
        mine = ids % 7 == 0
        a, b, s = search.top_in_blocks(ids[mine], v[mine], ids, v, k)
        got = sorted(zip(a.tolist(), (-s).tolist(), b.tolist(), strict=True))
        want = []
        for q, x in zip(ids[mine], v[mine], strict=True):
            best = sorted((-int(x @ y), int(i)) for i, y in zip(ids, v, strict=True) if i != q)[:k]
            want += [(int(q), m, i) for m, i in best]
        assert got == sorted(want)


def test_network_gradient():
    net = toxicity.Network()
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rng = np.random.default_rng(0)
    codes = rng.integers(1, toxicity.CLASSES**2 + 1, (3, 6)).astype(np.uint8)
    codes[1, 4:] = 0
    d = np.array([0.3, -0.7, 1.1])
    grad = net.backward(net.forward(codes, keep=True)[1], d)
    for name, a in net.p.items():
        flat, g = a.reshape(-1), grad[name].reshape(-1)
        for i in range(0, len(flat), 7):
            old = flat[i]
            flat[i] = old + 1e-5
            up = float(net.forward(codes) @ d)
            flat[i] = old - 1e-5
            down = float(net.forward(codes) @ d)
            flat[i] = old
            assert abs((up - down) / 2e-5 - g[i]) < 1e-6


def test_windows_cover_every_word():
    for n in (0, 1, 47, 48, 49, 72, 73, 500):
        w = toxicity.windows(np.full(n, 9, np.uint8))
        assert w.shape[1] == toxicity.WINDOW and (w[-1] == 9).any() == (n > 0)
        assert (len(w) - 1) * toxicity.STEP + toxicity.WINDOW >= n and len(w) == max(1, math.ceil(max(0, n - toxicity.WINDOW) / toxicity.STEP) + 1)


def test_rules_separate():
    rng = np.random.default_rng(1)
    x = rng.random((600, len(quality.STATS)))
    y = ((x[:, 2] > 0.5) & (x[:, 4] < 0.7)).astype(float)
    b, model = quality.train(x, y)
    z = b + sum(w * quality.fires(r, x) for w, r in model)
    assert ((z > 0) == (y == 1)).mean() > 0.97 and 0 < len(model) < 100
    assert quality.train(x, np.ones(600))[1] == []
