"""Licence scans, ranked search and periodic runs against brute force, on odd input too."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("tallyline.llm")
from tallyline.llm import licenses, periodic, ranked, signatures  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, words string, runs int, rank int, score double, label string, __row long, __item long, __words string, start int"


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def table(spark, rows):
    return spark.createDataFrame([(i, t, None, "w", 1, 2, 3.0, "l", 4, 5, "z", 6) for i, t in rows], SCHEMA)


def corpus(seed=3):
    rng = random.Random(seed)
    lines = [
        "Licensed under the Apache License, Version 2.0.", "Released under the MIT License.", "GNU General Public License, version 3 or (at your option) any later version",
        "SPDX-License-Identifier: BSD-3-Clause", "CC BY-SA 4.0; CC BY", "mit/LICENSE", "apache\nlicense", "mİt license", "the GNU Lesser General Public License v2.1", "émit license",
        "https://creativecommons.org/licenses/by-nc/4.0", "MIT", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0", "All rights reserved.", "gnu general public licenses",
    ]
    texts = [None, "", " \n\t", "One", "mit license", "mit license mit license", "日本語 " * 9, "x" * 3_000_000, "mit license cc by " * 20_000, "ab " * 9, "a " * 70_000]
    for _ in range(60):
        words = ["".join(rng.choice("abé1") for _ in range(rng.randint(1, 2))) for _ in range(rng.randint(0, 90))]
        for _ in range(rng.randint(0, 3)):
            words.insert(rng.randint(0, len(words)), rng.choice(lines))
        if rng.random() < 0.4:
            words[len(words) // 2 :] = words[len(words) // 2 :][: rng.randint(1, 5)] * rng.randint(2, 9)
        texts.append(rng.choice([" ", "  ", "\n", ", "]).join(words))
    rows = [(7 * i, t) for i, t in enumerate(texts)]
    return [*rows, rows[20], (rows[20][0], "another text mit license"), (None, "mit license " + texts[20]), (None, None), (-5, texts[21]), (2**62, texts[22])]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return table(spark, rows)


def sorted_rows(found):
    return sorted(found, key=repr)


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(text))


def test_licenses(docs, rows):
    table = signatures.rules()
    assert len(table) > 300 and len({r.place for r in table}) == len(table)
    want = []
    for doc_id, text in rows:
        w = words_of(text)
        places = [(i, label) for i in range(len(w)) for phrase, label in licenses.BASE if w[i : i + len(phrase.split())] == phrase.split()]
        norm, spans = " " + "  ".join(w) + " ", set()
        number = {m.start(): k for k, m in enumerate(re.finditer("[^ ]+", norm))}
        if len(w) < 5000:
            for r in table:
                for m in re.finditer(r.pattern, norm):
                    a = number[m.start(1)]
                    spans.add((a, a + len(m[1].split()), r.level, r.place, r.label))
            kept = [x for x in spans if not any(
                y != x and y[0] <= x[0] and y[1] >= x[1] and y[2] <= x[2] and (y[:2] != x[:2] or y[2:4] < x[2:4]) for y in spans)]
        else:  # the long texts: one phrase alone, or the two base phrases by turns
            kept = [x for x in spans if x] + [(0, 0, signatures.NAMED, 0, label) for label in {label for _, label in places}]
        labels, base = sorted({label for _, label in places} | {x[4] for x in kept}), sorted({label for _, label in places})
        score = max([0.0, *(signatures.CONFIDENCE[x[2]] for x in kept), *([licenses.BASE_CONFIDENCE] if places else [])])
        spots = [i for i, _ in places]
        want.append((doc_id, len(w), len(places), min(spots, default=None), max(spots, default=None), ",".join(base), ",".join(labels), score))
    got = [tuple(r)[:8] for r in licenses.licenses(docs).collect()]
    assert sorted_rows(got) == sorted_rows(want)


def test_detections_give_the_spans(spark):
    docs = table(spark, [(1, "Is licensed under the GNU General Public License, version 3.\nMIT license")]).select("doc_id", "text")
    found = licenses.detections(licenses.scan(docs), "doc_id").where("kept").orderBy("start").collect()
    assert [(r["start"], r["end"], r["label"]) for r in found] == [(1, 10, "gpl-3.0"), (10, 12, "mit")]


def test_every_rule_has_its_keyword():
    for r in signatures.rules():
        body = r.pattern.replace("licen[cs]e", "license")
        assert r.keyword in re.findall("[a-z0-9]+", body) or r.keyword == "spdx"
        # a match is never without the keyword: with the keyword taken out, the pattern's own words do not match
        assert not re.search(r.pattern, " " + "  ".join(w for w in re.findall("[a-z0-9]+", body) if w != r.keyword) + " ")


def brute_search(rows, items, k=10):
    count = [(i, Counter(words_of(t))) for i, t in rows]
    count = [(i, c, sum(c.values())) for i, c in count if c]
    N, L = len(count), sum(n for *_, n in count)
    df = Counter(t for _, c, _ in count for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c, n in count:
            m = 25 + 75 * n * N // L
            s = sum(math.floor(1000 * math.log((2 * N + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in words_of(text) if t in c)
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, rank + 1, x[3], -x[0]) for rank, x in enumerate(sorted(scores)[:k])]
    return out


@pytest.mark.parametrize("block", [ranked.BLOCK_BYTES, 60])
def test_ranked(spark, docs, rows, block):
    texts = [t for _, t in rows[11:60:6]]
    items = [*enumerate(texts), (3, texts[0]), (3, "mit mit mit license"), (None, "é a b"), (77, None), (78, "..."), (79, "nosuchterm")]
    frame = spark.createDataFrame([(i, t, 9, 8.0) for i, t in items], "item_id long, text string, rank int, __item double")
    got = [tuple(r) for r in ranked.search(docs, frame, block_bytes=block).collect()]
    assert sorted_rows(got) == sorted_rows(brute_search(rows, items))
    assert ranked.search(docs.limit(0), frame).count() == 0 and ranked.search(docs, frame.limit(0)).count() == 0


def test_bounds_prune_and_ties_go_by_id():
    rng = np.random.default_rng(0)
    p = 1 / np.arange(1, 301)
    docs = [Counter(rng.choice(300, size=rng.integers(1, 200), p=p / p.sum()).tolist()) for _ in range(800)]
    queries = [Counter(rng.choice(300, size=rng.integers(1, 30), p=p / p.sum()).tolist()) for _ in range(20)]
    docs += [docs[k] + queries[k % 20] for k in range(60)] * 2
    n = np.array([sum(d.values()) for d in docs])
    df = np.zeros(300, np.int64)
    for d in docs:
        df[list(d)] += 1
    weight, total = ranked.weights(df, len(docs)), int(n.sum())
    block = ranked.Block(queries, weight, len(docs), total)
    for a in range(0, len(docs), 128):
        part = [(row, t, c) for row, d in enumerate(docs[a : a + 128]) for t, c in sorted(d.items())]
        r, t, c = (np.array(x) for x in zip(*part, strict=True))
        block.add(list(range(a, min(a + 128, len(docs)))), n[a : a + 128], r, t, c)
    for q, best in zip(queries, block.best, strict=True):
        scores = [(sum(k * int(weight[t]) * (10**9 * d[t] // (1000 * d[t] + 8 * (25 + 75 * int(m) * len(docs) // total))) for t, k in q.items() if t in d), i) for i, (d, m) in enumerate(zip(docs, n, strict=True))]
        assert [(s, i) for s, _, i in best] == sorted(((s, i) for s, i in scores if s > 0), key=lambda x: (-x[0], x[1]))[:10]
    assert block.rescored < 0.5 * block.seen


def brute_runs(w):
    n, out = len(w), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q):
                out.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted(((s, length, q) for (s, length), q in out.items()), key=lambda r: (r[0], r[2]))


def test_find_runs():
    rng = random.Random(1)
    for _ in range(150):
        texts = []
        for _ in range(rng.randint(1, 6)):
            w = [rng.randint(0, rng.choice([0, 1, 2, 30])) for _ in range(rng.randint(0, rng.choice([8, 60, 400])))]
            if w and rng.random() < 0.5:
                a = rng.randrange(len(w))
                p = 1 + (len(w) - a) // rng.randint(3, 10)
                w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
            texts.append(np.array(w, np.int64))
        for x, got in zip(texts, periodic.find_runs(texts), strict=True):
            assert [tuple(r) for r in got.tolist()] == brute_runs(x.tolist())


def test_extensions_are_exact():
    rng = np.random.default_rng(4)
    for size, letters in ((50, 2), (400, 1), (3000, 2), (3000, 50)):
        s = rng.integers(0, letters, size)
        s[size // 2 :] = s[: size - size // 2]
        ids = np.concatenate([[-1], s, [-2]])
        p = rng.integers(1, size - 1, 300)
        q = rng.integers(1, size, 300)
        p, q = np.minimum(p, q), np.maximum(p, q)
        p, q = p[p < q], q[p < q]
        grammar = periodic.Grammar(ids)
        for back in (False, True):
            got = grammar.extension(p, q, back)
            for a, b, g in zip(p, q, got, strict=True):
                k = 0
                while ids[a - 1 - k if back else a + k] == ids[b - 1 - k if back else b + k]:
                    k += 1
                assert g == k


def test_periodic(docs, rows):
    want = []
    for doc_id, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
        if h % 10 == 0 and w:
            g = h // 10
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
        runs = brute_runs(w) if len(w) < 5000 else [(0, len(w), next(q for q in range(1, 99) if w[q:] == w[:-q]))]
        dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want.append((
            doc_id, len(runs), *((best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4),
            sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in dropped)),
        ))
    got = [tuple(r) for r in periodic.digests(periodic.periodic_runs(periodic.with_planted(docs))).collect()]
    assert sorted_rows(got) == sorted_rows(want)
    assert any(r[1] for r in want if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 10 == 0)


def test_empty_tables(docs):
    none = docs.limit(0)
    assert licenses.licenses(none).count() == periodic.periodic_runs(none).count() == periodic.periodic_runs(periodic.with_planted(none)).count() == 0
