import random

from pyspark.sql import functions as F

from tallyline.operators.scan import peak, rcount, rlag, rlast, rmax, rmin, rsum, rtotal, running


def test_running_across_chunks_equals_one_pass(spark):
    rnd = random.Random(3)
    rows = [(k, o, t, rnd.choice([None, rnd.randint(-9, 9)])) for k in "ab" for o in range(60) for t in range(rnd.randint(0, 3))]
    df = spark.createDataFrame(rows, "k string, o long, t long, v long")
    v = F.col("v")
    specs = {"s": rsum(v), "b": rsum(v, inclusive=False), "n": rcount(), "hi": rmax(v, inclusive=False), "lo": rmin(v), "last": rlast(v), "lag": rlag(v), "all": rtotal(v)}
    for bits in (0, 2, 21):
        got = {(r.k, r.o, r.t): r for r in running(df, ["k"], "o", specs, tie=["t"], bits=bits).collect()}
        assert len(got) == len(rows)
        for key in "ab":
            seen = []
            for r in sorted(x for x in rows if x[0] == key):
                g, vals = got[r[:3]], [x for x in seen if x is not None]
                upto = vals + ([r[3]] if r[3] is not None else [])
                assert g.s == sum(upto) and g.b == sum(vals) and g.n == len(seen) + 1
                assert g.hi == (max(vals) if vals else None) and g.lo == (min(upto) if upto else None)
                assert g.last == (upto[-1] if upto else None) and g.lag == (seen[-1] if seen else None)
                assert g["all"] == sum(x[3] for x in rows if x[0] == key and x[3] is not None)
                seen.append(r[3])


def test_lead_columns_sort_first(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 0, 9), ("a", 0, 1), ("a", 1, 2)], "k string, c int, o long")
    got = {(r.c, r.o): r.n for r in running(df, ["k"], "o", {"n": rcount()}, lead=["c"], bits=1).collect()}
    assert got == {(0, 1): 1, (0, 9): 2, (1, 2): 3, (1, 5): 4}


def test_peak_ends_before_starts(spark):
    marks = [("a", 0, 1), ("a", 5, -1), ("a", 5, 1), ("a", 9, -1), ("b", 1, 1), ("b", 2, 1), ("b", 3, -2)]
    df = spark.createDataFrame(marks, "k string, at long, d long")
    for bits in (0, 1, 21):
        assert {r.k: r.peak for r in peak(df, ["k"], "at", "d", bits).collect()} == {"a": 1, "b": 2}
