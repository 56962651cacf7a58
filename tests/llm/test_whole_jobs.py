"""The training-data operators over all of their input: nothing is left out by count, length or place."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("tallyline.llm")
from tallyline.llm import language, neardup, sharding, toxicity  # noqa: E402
from tallyline.llm import queries as training  # noqa: E402


def discount(counts):
    n1, n2 = (sum(x == k for x in counts.values()) for k in (1, 2))
    return min(0.95, max(0.05, n1 / (n1 + 2 * n2))) if n1 else 0.5


def test_language_query_keeps_every_pair(spark, tmp_path):
    rng = random.Random(4)
    texts = [(i, " ".join(rng.choice("abcdefghijkl") * rng.randint(1, 2) for _ in range(rng.randint(0, 25)))) for i in range(40)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = [(i, [*t.split(), "</s>"]) for i, t in texts]
    c, b = Counter(), Counter()
    for i, w in rows:
        if zlib.crc32(str(i).encode()) % 7 != 2:
            c.update(w)
            b.update(zip(["</s>", *w], w, strict=False))
    n, v, d, d1 = sum(c.values()), len(c), discount(b), discount(c)
    arcs = Counter()
    for (h, _), k in b.items():
        arcs[h] += k - d
    got = {r["doc_id"]: r["score"] for r in training.op7_language_scores(spark, str(tmp_path)).collect()}
    assert min(b.values()) == 1
    for i, w in rows:
        want = 0.0
        for h, x in zip(["</s>", *w], w, strict=False):
            p1 = (c[x] - d1 if c[x] else d1 * v) / n
            want += math.log10(((b[h, x] - d if b[h, x] else 0) + (c[h] - arcs[h]) * p1) / c[h] if c[h] else p1)
        assert got[i] == pytest.approx(want)


def test_toxic_string_at_the_end_of_a_long_run():
    calm = ["今日は天気が良いので散歩に行きました" * k + "楽しかったです" for k in (3, 4, 5, 6)] * 12
    bad = [t + "馬鹿野郎死ね" for t in calm]
    texts = [t.encode() for t in calm + bad]
    y = np.array([0] * len(calm) + [1] * len(bad))
    lexicon, net, calibration = toxicity.train(texts, y)
    new = "昨日は友達と映画を見て夕食を食べた" * 8
    low, high = toxicity.score_texts([new.encode(), (new + "馬鹿野郎死ね").encode()], toxicity._Codes(lexicon), net, calibration)
    assert low < toxicity.THRESHOLD <= high
    run = b"x" * 500 + b"abcde"
    assert {b"abc", b"bcde", b"abcde", b"de>"} <= set(toxicity.grams(run)) and len(toxicity.grams(run)) < 40


def test_one_row_of_each_component_stays(spark):
    one, two = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [
        (None, "null id of a text of its own", 0), (None, "null id of another text", 1), (None, "null id of another text", 2), (5, one, 3), (7, one + " more", 4),
        (7, two, 5), (9, two, 6), (9, "id nine has a text that nothing else is like", 7), (11, "", 8), (11, "", 9), (None, None, 10), (None, one, 11), (5, one, 12),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n long").coalesce(1)
    kept = neardup.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r["n"] for r in kept.collect()) == [0, 1, 3, 5, 7, 8, 9, 10]


def test_copies_without_ids_are_cut(spark):
    rows = [(None, "one text " * 20)] * 200 + [(5, "another text " * 15)] * 200 + [(i, f"text {i} " * 15) for i in range(400)]
    got = sharding.kd_shards(spark.createDataFrame(rows, "doc_id long, text string"), 4).groupBy("shard").sum("size").collect()
    sizes = {r[0]: r[1] for r in got}
    assert sizes.keys() == {0, 1, 2, 3} and max(sizes.values()) < 1.2 * sum(sizes.values()) / 4


def test_far_members_of_one_list_are_told_apart(spark):
    """Two thousand texts with a common passage: families whose links lie far from the list's most central member, and none between families."""
    rng = random.Random(12)
    word = lambda: f"w{rng.randrange(10**9)}"
    passage, rows, want = [word() for _ in range(60)], [], {}
    for family in range(400):
        own = [word() for _ in range(70)]
        first = len(rows)
        for copy in range(5):
            text = list(own)
            if copy in (1, 2):
                text[rng.randrange(70)] = word()
            if copy == 4:  # linked with no one: a fifth of its words are new
                text[::4] = [word() for _ in text[::4]]
            rows.append((first + copy, " ".join(passage + text)))
            want[first + copy] = first + copy if copy == 4 else first
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    shingles = {i: {tuple(t.split()[k : k + 2]) for k in range(129)} for i, t in rows}
    linked = lambda x, y: 100 * len(shingles[x] & shingles[y]) >= 80 * len(shingles[x] | shingles[y])
    for i in range(0, 2000, 5):
        assert linked(i, i + 1) and linked(i, i + 2) and linked(i, i + 3) and not any(linked(i + 4, i + k) for k in range(4)) and not linked(i, (i + 5) % 2000)
    assert got == want
