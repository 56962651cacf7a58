"""The operators on small tables: nulls, empty and repeated rows, ties, clashing columns, empty tables."""

import math
import random
import re
import zlib
from collections import Counter

import pytest

pytest.importorskip("tallyline.llm")
from tallyline.llm import archive, decontaminate, language, neardup, packing, quality, search, sharding, tokenfile, toxicity  # noqa: E402
from tallyline.llm.queries import tokenizer_file  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, size int, score double, node string"


def corpus(seed=1):
    """Copies, a star of near copies whose members are mostly unlinked, short, empty, null and long texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 4)))
    core = [word() for _ in range(120)]
    texts = [None, "", " \n\t", "One", "one", "x " * 3000, "Ünï ÇA é"]
    for rate in [0.0, 0.02, 0.03, 0.05, 0.05, 0.06, 0.06, 0.07, 0.08, 0.1, 0.12] * 4:
        texts.append(" ".join(word() + "q" if rng.random() < rate else w for w in core))
    texts += [texts[10], texts[10], texts[11].upper()]
    texts += [" ".join(word() for _ in range(rng.randint(1, 80))) for _ in range(30)]
    return [(3 * i, t, None, "s", None, 1, 2, 3.0, "n") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", low(text))


def test_near_duplicates(docs):
    rows = corpus()
    sets, root = {}, {}
    for i, t, *_ in rows:
        w = words(t)
        sets[i], root[i] = set(zip(w, w[1:], strict=False)) if len(w) > 1 else {tuple(w)} if w else set(), i

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = {r["doc_id"]: r for r in neardup.near_duplicates(docs).collect()}
    assert {i: (r["n_shingles"], r["component_id"], r["kept"]) for i, r in got.items()} == {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def test_language_scores(docs):
    rows = [(i, [*words(t), "</s>"]) for i, t, *_ in corpus()]
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows}
    c, b = Counter(), Counter()
    for i, w in rows:
        if not held[i]:
            c.update(w)
            b.update(zip(["</s>", *w], w, strict=False))
    n, v = sum(c.values()), len(c)
    n1, n2 = (sum(x == k for x in c.values()) for k in (1, 2))
    d1 = min(0.95, max(0.05, n1 / (n1 + 2 * n2)))
    arcs = Counter()
    for (h, _), k in b.items():
        if k >= 2:
            arcs[h] += k - 0.8
    got = {r["doc_id"]: r for r in language.language_scores(docs).collect()}
    for i, w in rows:
        base = sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w)
        score = sum(math.log10(((b[h, x] - 0.8) / c[h] if b[h, x] >= 2 else 0) + (1 - arcs[h] / c[h] if c[h] else 1) * (c[x] - d1 if c[x] else d1 * v) / n) for h, x in zip(["</s>", *w], w, strict=False))
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(w), sum(c[x] > 0 for x in w), n)
        assert r["base_score"] == pytest.approx(base) and r["score"] == pytest.approx(score)


def test_packing(docs):
    rows = packing.pack(docs, tokenizer_file(), 64).collect()
    at = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == at.get(r["sequence_id"], 0) and r["offset"] + r["length"] <= 64
        at[r["sequence_id"]] = r["offset"] + r["length"]
    assert len({(r["doc_id"], r["piece"]) for r in rows}) == len(rows) and {r["doc_id"] for r in rows} == {x[0] for x in corpus()}


def test_token_files(docs):
    rows = sorted(tokenfile.token_files(docs, tokenizer_file()).collect(), key=lambda r: r["doc_id"])
    start = 0
    for r in rows:
        assert r["start"] == start
        start += r["n_tokens"]
    assert rows[0]["n_tokens"] == 1 and rows[0]["ids_crc32"] == zlib.crc32(b"\1\0\0\0")


def test_shards(docs):
    rows = sharding.kd_shards(docs, 4).collect()
    assert Counter(r["shard"] for r in rows).keys() == {0, 1, 2, 3}
    for k in range(4):
        assert sorted(r["slot"] for r in rows if r["shard"] == k) == list(range(sum(r["shard"] == k for r in rows)))
    assert {r["doc_id"]: r["size"] for r in rows} == {i: len((t or "").encode()) + 1 for i, t, *_ in corpus()}


def test_decontamination(spark, docs):
    text = corpus()[20][1]
    items = spark.createDataFrame([(1, " ".join(text.split()[5:25])), (2, None), (3, "one"), (None, "x x"), (4, "...")], "item_id long, text string")
    got = {r["doc_id"]: r for r in decontaminate.report(docs, items).collect()}
    assert got[60]["n_hit"] >= 20 and got[60]["contaminated"] and got[0]["n_words"] == 0 and not got[0]["contaminated"]
    assert (got[9]["n_hit"], got[9]["n_items"]) == (1, 1) and got[15]["n_hit"] == 0
    kept = {r["doc_id"] for r in decontaminate.keep_uncontaminated(docs, items).collect()}
    assert kept == {i for i, r in got.items() if not r["contaminated"]}


def test_archive(spark):
    big = "é" * 600
    pages = [(1, "http://A.org/x", big), (2, "http://b.a.org", big), (9, None, big), (3, "::bad", None), (4, "http://a.org/x", ""), (5, "http://a.org", "s"), (6, "http://a.org", "s")]
    got = {r["page_id"]: r for r in archive.archive(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert {i: (r["record_type"], r["refers_to"], r["payload_bytes"]) for i, r in got.items()} == {
        1: ("revisit", 9, 1200), 2: ("revisit", 9, 1200), 9: ("response", None, 1200), 3: ("response", None, 0), 4: ("response", None, 0), 5: ("response", None, 1), 6: ("response", None, 1)
    }


def test_search_leaves_out_bad_vectors(spark):
    rows = [(50, [1.0, 0.5]), (1, [1.0, 1.0]), (2, [None, 1.0]), (3, None), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, [1.0, 1.0]), (7, [-1.0, 0.0])]
    got = search.exact_top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).orderBy("rank").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got] == [(50, 1, 1, 98304), (50, 2, 6, 98304), (50, 3, 7, -65536)]


def test_classifiers(spark, docs):
    labels = spark.createDataFrame([(3 * i, int(i % 3 > 0), int(i % 5 == 0)) for i in range(80)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    for rows in (toxicity.scored(docs, labels).collect(), quality.scored(docs, labels).collect()):
        assert len(rows) == len(corpus()) and all(0 <= r["score"] <= 1 for r in rows)
        assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    none = labels.limit(0)
    assert {r["score"] for r in toxicity.scored(docs, none).collect()} == {0.5} == {r["score"] for r in quality.scored(docs, none).collect()}


def test_empty_tables(spark, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([], "item_id long, text string")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    for df in (
        packing.pack(empty, tokenizer_file(), 64), decontaminate.report(empty, items), toxicity.scored(empty, labels), neardup.near_duplicates(empty), tokenfile.token_files(empty, tokenizer_file()),
        archive.archive(pages), language.language_scores(empty), search.exact_top_k(vectors), quality.scored(empty, labels), sharding.kd_shards(empty, 16),
    ):
        assert df.count() == 0
