import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyline.functions import columns as fc
from tallyline.operators import evidence as evd
from tallyline.operators import graph as gr
from tallyline.operators import resources as rs
from tallyline.operators import stats as st
from tallyline.operators import text as tx
from tallyline.operators.intervals import conflicting_use

BIG = 9223372036854775807


def test_graph_walks(spark):
    e = spark.createDataFrame([(1, "a", "b"), (1, "b", "c"), (1, "a", "c"), (1, "c", "d"), (2, "x", "y"), (2, "y", "z"), (2, "z", "y"), (2, "z", "w")], "r long, src string, dst string")
    seed = spark.createDataFrame([(1, "b"), (2, "x")], "r long, node string")
    assert {tuple(r) for r in gr.closure(e, seed, ["r"]).collect()} == {(1, "b"), (1, "c"), (1, "d"), (2, "x"), (2, "y"), (2, "z"), (2, "w")}
    lv = {(r.r, r.node): r.level for r in gr.levels(e, ["r"]).collect()}
    assert lv == {(1, "a"): 0, (1, "b"): 1, (1, "c"): 2, (1, "d"): 3, (2, "x"): 0, (2, "y"): None, (2, "z"): None, (2, "w"): None}
    n = spark.createDataFrame([(1, "a", 5), (1, "b", 7), (1, "c", 1), (1, "d", 2), (3, "q", BIG), (3, "s", 1)], "r long, node string, w long")
    e2 = e.where("r = 1").unionByName(spark.createDataFrame([(3, "q", "s")], "r long, src string, dst string"))
    rank = {(r.r, r.node): r.rank for r in gr.longest_path(n, e2, ["r"], "w").collect()}
    assert rank == {(1, "a"): 15, (1, "b"): 10, (1, "c"): 3, (1, "d"): 2, (3, "q"): None, (3, "s"): 1}
    assert {r.r: r.critical_path for r in gr.critical_path(n, e2, ["r"], "w").collect()} == {1: 15, 3: None}
    prot = spark.createDataFrame([(1, "d")], "r long, node string")
    skip = spark.createDataFrame([(1, "b")], "r long, node string")
    assert {r.node: r.reason for r in gr.skip_cascade(e.where("r = 1"), skip, prot, ["r"]).collect()} == {"b": "skipped", "c": "dependency_skipped", "d": "required_dependency_skipped"}


def test_percentile_rules(spark):
    rnd = random.Random(1)
    vals = {k: [rnd.randint(-50, 10**7) for _ in range(n)] for k, n in (("a", 1), ("b", 10), ("c", 301))}
    df = spark.createDataFrame([(k, v) for k, vs in vals.items() for v in vs] + [("a", None)], "k string, v long")
    qs = {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    lin = {r.k: r for r in st.percentiles(df, ["k"], "v", qs, "linear").collect()}
    near = {r.k: r for r in st.percentiles(df, ["k"], "v", qs, "nearest").collect()}
    for k, vs in vals.items():
        for n, q in qs.items():
            assert abs(lin[k][n] - round(float(np.percentile(vs, q * 100)), 6)) < 1e-5
            assert near[k][n] == sorted(vs)[max(1, math.ceil(q * len(vs))) - 1]


def test_wilson_ends_and_refusals(spark):
    df = spark.createDataFrame([(0, 5), (5, 5), (3, 5), (6, 5), (0, 0)], "s long, n long")
    low, high = st.wilson(F.col("s"), F.col("n"))
    got = [(r[0], r[1]) for r in df.select(low, high).collect()]
    assert got[0][0] == 0.0 and got[1][1] == 1.0 and got[2] == (0.230724, 0.882379) and got[3] == (None, None) and got[4] == (None, None)


def test_overflow_fails_the_check(spark):
    df = spark.createDataFrame([(1, BIG), (1, 1), (2, 7)], "r long, v long")
    t = {r.r: r for r in rs.safe_totals(df, ["r"], ["v"]).collect()}
    assert t[1].v is None and t[1].v_overflow and t[2].v == 7 and not t[2].v_overflow
    fit = rs.envelope_fit(rs.safe_totals(df, ["r"], ["v"]).withColumn("cap", F.lit(BIG)), ["r"], {"v": ("v", "cap", "u")}).collect()
    assert {r.r: r.passed for r in fit} == {1: False, 2: True}
    peak = rs.conservative_peak(df.withColumn("k", F.lit(2)), ["r"], "v", "k")
    assert {r.r: r.v for r in peak.collect()} == {1: None, 2: 7}


def test_conflicts_without_pairs(spark):
    rnd = random.Random(6)
    rows = [("r", i, s, s + rnd.randint(0, 9), rnd.random() < 0.3) for i, s in enumerate(rnd.randint(0, 60) for _ in range(60))]
    df = spark.createDataFrame(rows, "k string, i long, s long, e long, w boolean")
    hit = lambda a, b: a[1] != b[1] and a[2] < b[3] and b[2] < a[3] and (a[4] or b[4])
    live = [r for r in rows if r[2] < r[3]]
    want = {a[1] for a in live if any(hit(a, b) for b in live)}
    assert {r.i for r in conflicting_use(df, ["k"], "s", "e", "w", ["i"]).collect()} == want


def test_claim_precedence(spark):
    c = spark.createDataFrame([("1", "supported", ["a"], 1, True, []), ("2", "supported", ["a", "gone"], 1, True, []), ("3", "supported", ["bad", "old"], 1, True, []),
                               ("4", "supported", ["old"], 1, True, []), ("5", "retracted", ["bad"], 1, True, []), ("6", "supported", [], 1, True, []),
                               ("7", "supported", ["a"], 99, True, []), ("8", "supported", ["a"], 1, False, []), ("9", "supported", ["a"], 1, True, ["1"])],
                              "claim_id string, status string, evidence array<string>, created long, valid boolean, contradicts array<string>")
    a = spark.createDataFrame([("a", 1, None, True), ("bad", 1, None, False), ("old", 1, 5, True)], "ref string, created long, fresh_until long, valid boolean")
    x = evd.assess_claims(c, a, F.lit(10))
    assert {r.claim_id: r.assessed for r in x.collect()} == {"1": "supported", "2": "unverified", "3": "invalid", "4": "stale", "5": "retracted", "6": "unverified", "7": "invalid",
                                                             "8": "invalid", "9": "supported"}
    assert {r.claim_id for r in evd.contradictions(x).collect()} == {"1", "9"}


def test_fact_and_number_texts(spark):
    c = spark.createDataFrame([("ok", "en", "12", "beds", "There are 12  Beds left"), ("two", "en", "12", "beds", "12 beds of 13"), ("esp", "es", "3.5", "percent", "Un 3.5 por ciento"),
                               ("zero", "en", "012", "beds", "012 beds"), ("fr", "fr", "1", "beds", "1 lit"), ("word", "en", "1", "beds", "1 bedspread")],
                              "claim_id string, language string, value string, unit string, statement string")
    got = {(r.claim_id, r.code) for r in tx.fact_breaches(c).collect()}
    assert got == {("two", "not_one_number"), ("zero", "value_not_canonical"), ("zero", "not_one_number"), ("fr", "language_outside_policy"), ("word", "phrase_missing")}
    n = spark.createDataFrame([("é5 a-7 007 12.", ["7", "12"]), ("x_3 99999999999999999999", ["99999999999999999999"])], "t string, want array<string>")
    assert all(sorted(r[0]) == sorted(r[1]) for r in n.select(fc.integer_multiset(F.col("t")), "want").collect())


def test_url_ladder(spark):
    want = {"https://a.org/x": None, "": "not-canonical-text", "https://a.org/ x": "whitespace-or-control", "https://a.org\\x": "backslash", "a.org/x": "not-absolute",
            "ftp://a.org": "scheme-not-allowed", "https://u:p@a.org": "embedded-credentials", "https://b.org": "host-not-allowed", "https://a.org:8443/": "non-default-port",
            "https://a.org:443/": None, "https://a.org:x/": "unparsable", "HTTPS://A.ORG": None,
            "https://a.org:99999/": "unparsable", "https://a.org:65536/": "unparsable", "https://a.org:65535/": "non-default-port", "https://a.org:000443/": None,
            "https://a.org:0/": "non-default-port", "https://a.org:123456/": "unparsable"}
    df = spark.createDataFrame([(u,) for u in want], "u string")
    assert {r.u: r.p for r in df.select("u", fc.url_problem(F.col("u"), ["https"], ["a.org"]).alias("p")).collect()} == want


def test_contrast_and_encoding(spark):
    df = spark.createDataFrame([("#000000", "#ffffff"), ("#777777", "#FFFFFF"), ("red", "#ffffff")], "f string, b string")
    r = [x[0] for x in df.select(F.round(fc.contrast_ratio(F.col("f"), F.col("b")), 3)).collect()]
    assert r == [21.0, 4.478, None]
    t = spark.createDataFrame([("YQ==",), ("YQ=",), ("YR==",)], "t string")
    assert [x[0] for x in t.select(fc.canonical_base64(F.col("t"))).collect()] == [True, False, False]


def test_bootstrap_is_deterministic(spark):
    df = spark.createDataFrame([("g", i, i * i % 17) for i in range(30)], "k string, i long, v long")
    a = st.bootstrap_ci(df, "k", "v", "i", "mean", 50, "x").collect()
    assert a == st.bootstrap_ci(df.repartition(3), "k", "v", "i", "mean", 50, "x").collect()
    assert a[0].low < 17 * 0.5 < a[0].high + 4 and a != st.bootstrap_ci(df, "k", "v", "i", "mean", 50, "y").collect()


def _resample(n, b, label="x"):
    return [int(hashlib.md5(f"{label}|{b}|{i}".encode()).hexdigest()[:15], 16) for i in range(n)]


def test_bootstrap_of_a_callers_trimmed_mean(spark):
    values = [(i * 37) % 11 for i in range(40)]
    df = spark.createDataFrame([("g", i, v) for i, v in enumerate(values)] + [("g", 99, None), ("h", 0, 7)], "k string, i long, v long")
    est = []
    for b in range(1, 41):
        held = sorted(values[u % 40] for u in _resample(40, b))[8:-8]
        est.append(sum(held) / len(held))
    want = [round(float(np.percentile(est, p)), 6) for p in (5, 95)]
    for merge in (False, True):
        got = {r.k: [r.low, r.high] for r in st.bootstrap(df, ["k"], "v", "i", 40, "x", st.trimmed_mean(0.2), merge=merge, tails=(0.05, 0.95)).collect()}
        assert got["g"] == pytest.approx(want) and got["h"] == [7.0, 7.0]
    assert not st.bootstrap(df.where("false"), ["k"], "v", "i", 40, "x", st.trimmed_mean(0.2)).collect()


def test_poisson_weights_are_poisson_and_need_no_exchange(spark):
    df = spark.createDataFrame([("g", i, i % 5) for i in range(400)], "k string, i long, v long")
    x = st.poisson_weights(df, ["k"], "v", "i", 100, "x")
    assert "Exchange" not in x._jdf.queryExecution().executedPlan().toString()
    w = np.array([r["__w"] for r in x.collect()])
    assert abs(w.sum() / 40_000 - 1) < 0.02 and abs((w == 1).sum() / 40_000 - math.exp(-1)) < 0.01 and abs((w**2).sum() / 40_000 - 2) < 0.05
    u = [v * int(sum(t <= d for t in st.POISSON_STEPS)) for v, d in zip([i % 5 for i in range(400)], _resample(400, 3), strict=True)]
    assert x.where("__b = 3").selectExpr("sum(v * __w)").first()[0] == sum(u)


def test_longest_path_is_null_around_a_cycle(spark):
    n = spark.createDataFrame([(1, x, 2) for x in "abcde"] + [(2, "a", 3), (2, "b", 4)], "r long, node string, w long")
    e = spark.createDataFrame([(1, "a", "b"), (1, "b", "c"), (1, "c", "b"), (1, "c", "d"), (1, "d", "e"), (2, "a", "b")], "r long, src string, dst string")
    got = {(r.r, r.node): r["rank"] for r in gr.longest_path(n, e, ["r"], "w").collect()}
    assert got == {(1, "a"): None, (1, "b"): None, (1, "c"): None, (1, "d"): 4, (1, "e"): 2, (2, "a"): 7, (2, "b"): 4}


def test_evidence_times_in_nanoseconds(spark):
    at = 1_800_000_000_000_000_000
    a = spark.createDataFrame([(1, "x", at - 5, at - 5, None), (1, "y", at + 5, at - 5, None), (1, "z", None, at - 5, None)], "k long, ref string, produced_at long, created long, fresh_until long")
    uses = spark.createDataFrame([(1, 1, "x", at, at), (1, 2, "y", at, at), (1, 3, "z", at, at), (1, 4, "q", at, at)], "k long, i long, ref string, pos long, at long")
    got = {r.i: r.code for r in evd.evidence_causality(uses, a, ["k"], ["i"], "ref", "pos", "at").collect()}
    assert got == {2: "evidence_causality_violation", 3: "evidence_causality_violation", 4: "missing_evidence_artifact"}


def test_ranks_and_levels_of_random_graphs(spark):
    rnd = random.Random(5)
    nodes, edges, want_rank, want_level = [], [], {}, {}
    for g in range(12):
        n = rnd.randint(1, 14)
        w = {i: rnd.choice([None, *range(1, 9)]) if g % 4 == 3 else rnd.randint(1, 9) for i in range(n)}
        arcs = {(a, b) for a in range(n) for b in range(n) if rnd.random() < 0.16 and (g % 3 == 2 or a < b)}
        nodes += [(g, i, w[i]) for i in range(n)]
        edges += [(g, a, b) for a, b in arcs] + [(g, a, b) for a, b in arcs if rnd.random() < 0.2]

        def longest(i, step, cost, path=()):
            """None where the walk meets a cycle or an unknown weight."""
            if i in path or cost(i) is None:
                return None
            below = [longest(j, step, cost, (*path, i)) for j in step(i)]
            return None if None in below else cost(i) + max(below, default=0)

        for i in range(n):
            want_rank[g, i] = longest(i, lambda a: [y for x, y in arcs if x == a], w.get)
            if any(i in e for e in arcs):
                top = longest(i, lambda b: [x for x, y in arcs if y == b], lambda _: 1)
                want_level[g, i] = None if top is None else top - 1
    nd = spark.createDataFrame(nodes, "r long, node long, w long")
    ed = spark.createDataFrame(edges, "r long, src long, dst long")
    assert {(r.r, r.node): r["rank"] for r in gr.longest_path(nd, ed, ["r"], "w").collect()} == want_rank
    assert {(r.r, r.node): r.level for r in gr.levels(ed, ["r"]).collect()} == want_level
    empty = ed.where("r < 0")
    assert gr.levels(empty, ["r"]).count() == 0
    assert {(r.r, r.node): r["rank"] for r in gr.longest_path(nd, empty, ["r"], "w").collect()} == {(r, i): w for r, i, w in nodes}


def _tree(leaves, levels):
    import hashlib
    import json

    sha = lambda xs: hashlib.sha256(json.dumps(xs, separators=(",", ":")).encode()).hexdigest()
    at = {}
    for place, name, n in sorted(leaves):
        at.setdefault(place, []).append(f"{name} {n}")
    at = {p: sha(v) for p, v in at.items()}
    for k in levels:
        up = {}
        for p in sorted(at):
            up.setdefault(p[:k], []).append(at[p])
        assert max(map(len, up.values())) <= 4096
        at = {p: sha(v) for p, v in up.items()}
    return at[""]


def test_digest_trees(spark):
    import hashlib
    from collections import Counter

    name = lambda t: hashlib.sha256(t.encode()).hexdigest()[:9]
    ids = spark.range(40_000).select((F.col("id") % 2).alias("k"), "id", F.concat(F.lit("sha256:"), F.when(F.col("id") < 15_000, F.lit("same")).otherwise(F.col("id").cast("string"))).alias("d"))
    rows = [(r.k, r.id, r.d) for r in ids.collect()]
    got = {r.k: (r.records, r.set_digest) for r in evd.set_digest(ids, ["k"], "d").collect()}
    again = {r.k: (r.records, r.set_digest) for r in evd.set_digest(ids.orderBy(F.rand(3)).repartition(7), ["k"], "d").collect()}
    chain = {r.k: (r.records, r.set_digest) for r in evd.set_digest(ids, ["k"], "d", "id").collect()}
    for k in (0, 1):
        mine = Counter(d for kk, _, d in rows if kk == k)
        assert got[k] == again[k] == (20_000, _tree([(name(d), d, n) for d, n in mine.items()], (6, 3, 0)))
        steps = [(f"{i:016X}" + name(d), d, 1) for kk, i, d in rows if kk == k]
        assert chain[k] == (20_000, _tree(steps, (22, 19, 16, 13, 10, 7, 4, 1, 0)))
    odd = spark.createDataFrame([(1, None, None), (1, None, None), (1, 2, "a"), (1, 2, "a")], "k long, o long, d string")
    assert evd.set_digest(odd, ["k"], "d").first().records == evd.set_digest(odd, ["k"], "d", "o").first().records == 4
    assert evd.set_digest(odd.where("k = 0"), ["k"], "d").count() == 0
