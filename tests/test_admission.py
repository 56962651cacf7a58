import random

import pytest
from pyspark.sql import functions as F

from tallyline.operators import ledgers as lg
from tallyline.operators import selection as sel
from tallyline.operators.admission import admit


def walk(rows, caps):
    used, taken = [0, 0], {}
    for pos, item, a, b, ask in sorted(rows):
        if ask:
            taken[item] = used[0] + a <= caps[0] and used[1] + b <= caps[1]
            if taken[item]:
                used = [used[0] + a, used[1] + b]
        elif taken.get(item):
            used = [used[0] - a, used[1] - b]
    return taken


@pytest.mark.parametrize("bound", [100, 10**6])
def test_admission_both_ways(spark, bound):
    rnd = random.Random(5)
    asks, frees, want = [], [], {}
    for k in range(4):
        rows, pos = [], 0
        for item in range(40):
            pos += rnd.randint(1, 3) * 100
            a, b = rnd.randint(0, 9), rnd.randint(0, 9)
            asks.append((k, pos, item, a, b, 30, 25))
            rows.append((pos, item, a, b, True))
            if rnd.random() < 0.6:
                back = pos + rnd.randint(1, 2000) * 2 + 1
                if back not in {r[0] for r in rows}:
                    fa, fb = rnd.randint(0, a), rnd.randint(0, b)
                    frees.append((k, back, item, fa, fb))
                    rows.append((back, item, fa, fb, False))
        want |= {(k, i): v for i, v in walk(rows, (30, 25)).items()}
    a = spark.createDataFrame(asks, "k long, pos long, item long, x long, y long, cx long, cy long")
    f = spark.createDataFrame(frees, "k long, pos long, item long, x long, y long")
    got = {(r.k, r.item): r.admitted for r in admit(a, f, ["k"], "pos", "item", ["x", "y"], ["cx", "cy"], bound).collect()}
    assert got == want and set(want.values()) == {True, False}


def test_first_fit_large_groups_equal_small(spark):
    rnd = random.Random(8)
    rows = [(g, rnd.randint(0, 5), i, rnd.randint(1, 40), rnd.randint(1, 40), 150, 140) for g in range(3) for i in range(60)]
    df = spark.createDataFrame(rows, "g long, o long, i long, a long, b long, ca long, cb long")
    args = (df, ["g"], ["o"], "i", ["a", "b"], ["ca", "cb"])
    small = sorted(map(tuple, sel.first_fit(*args).collect()))
    assert sorted(map(tuple, sel.first_fit(*args, block=10).collect())) == small
    for g in range(3):
        used, want = [0, 0], {}
        for r in sorted((x for x in rows if x[0] == g), key=lambda x: (x[1], x[2])):
            want[r[2]] = used[0] + r[3] <= 150 and used[1] + r[4] <= 140
            if want[r[2]]:
                used = [used[0] + r[3], used[1] + r[4]]
        assert {i: ok for k, i, ok in small if k == g} == want


def model(ops, cap):
    spent, active, ended, out = 0, {}, set(), []
    for seq, who, op, res, act in ops:
        held = sum(active.values())
        if op not in ("reserve", "settle", "cancel"):
            why = "unknown_operation"
        elif (op == "reserve" and (res is None or act is not None)) or (op == "settle" and act is None) or (op == "cancel" and act is not None):
            why = "malformed_input"
        elif op == "reserve":
            why = "identity_conflict" if who in active or who in ended else None
            if why is None and spent + held + res > cap:
                why = "capacity_exceeded"
                ended.add(who)
            elif why is None:
                active[who] = res
        elif who not in active:
            why = "terminal_attempt" if who in ended else "unknown_attempt"
        elif op == "settle" and act > active[who]:
            why = "actual_over_reservation"
        else:
            why = None
            del active[who]
            ended.add(who)
            spent += act if op == "settle" else 0
        out.append((seq, why is None, why, spent, sum(active.values())))
    return out


@pytest.mark.parametrize("bound", [100, 10**6])
def test_ledger_replay_equals_model(spark, bound):
    rnd = random.Random(20)
    ops = []
    for seq in range(1, 400):
        op = rnd.choice(["reserve"] * 4 + ["settle"] * 3 + ["cancel", "audit"])
        res = rnd.randint(0, 60) if op == "reserve" and rnd.random() < 0.9 else None
        act = rnd.randint(0, 60) if op == "settle" and rnd.random() < 0.9 else None
        ops.append((seq, rnd.randint(0, 120), op, res, act))
    df = spark.createDataFrame([(1, *o, 700) for o in ops], "ledger long, seq long, attempt_id long, operation string, res_u long, act_u long, cap long")
    got = sorted((r.seq, r.applied, r.reason, r.spent_u, r.held_u) for r in lg.replay_ledger(df, "ledger", ["u"], ["cap"], bound).collect())
    assert got == model(ops, 700)


@pytest.mark.parametrize("bound", [100, 10**6])
def test_conservation_lists_every_breach(spark, bound):
    rnd = random.Random(4)
    rows = [(1, s, rnd.randint(0, 6), rnd.randint(0, 4), rnd.randint(0, 3)) for s in range(1, 120)]
    df = spark.createDataFrame([(*r, 60) for r in rows], "run_id long, seq long, reserved long, actual long, released long, cap long")
    want, held, spent = set(), 0, 0
    for _, s, r, a, l in rows:
        held += r
        if a + l > held:
            want.add((s, "resource_conservation_violation"))
        else:
            held -= a + l
        spent += a
        if spent + held > 60:
            want.add((s, "resource_cap_exceeded"))
    if held:
        want.add((rows[-1][1], "resource_leak"))
    got = {(r.seq, r.code) for r in lg.conservation_rows(df, ["run_id"], "seq", "cap", bound).collect()}
    assert got == want


def test_skyline_equals_brute_force(spark):
    rnd = random.Random(2)
    rows = [(g, rnd.randint(0, 30), rnd.randint(0, 30), rnd.randint(0, 30)) for g in range(2) for _ in range(200)]
    df = spark.createDataFrame(rows, "g long, a long, b long, q long")
    pts = set(rows)
    beats = lambda x, y: x[0] == y[0] and x[1] <= y[1] and x[2] <= y[2] and x[3] >= y[3] and x != y
    want = {p for p in pts if not any(beats(o, p) for o in pts)}
    old = sel.BLOCK
    for block in (old, 5):
        sel.BLOCK = block
        assert {tuple(r) for r in sel.pareto(df, ["g"], ["a", "b"], ["q"]).collect()} == want
    sel.BLOCK = old


def test_skyline_merges_nodes_of_exact_values(spark):
    rnd = random.Random(5)
    big = 2**53
    rows = [("one", big + 1, 0), ("one", big, 0), ("one", -2**63, -2**63), ("two", 5, 2**63 - 1), ("two", 5, -2**63), ("none", None, 9), ("none", 3, 4), ("none", 4, 4)]
    rows += [("front", i, i) for i in range(40)]  # nothing is dominated, so every piece of a node meets every other
    rows += [("cloud", rnd.randint(0, 10**6), rnd.randint(0, 10**6)) for _ in range(600)] + [(None, 1, 1)]
    df = spark.createDataFrame(rows, "g string, a long, q long")
    pts = {r for r in rows if r[0] is not None and r[1] is not None}
    want = {p for p in pts if not any(o[0] == p[0] and o[1] <= p[1] and o[2] >= p[2] and o != p for o in pts)} | {("none", None, 9)}
    got = [tuple(r) for r in sel.pareto(df, ["g"], ["a"], ["q"], block=3).collect()]
    assert len(got) == len(want) and set(got) == want


def test_skyline_of_doubles(spark):
    inf, nan = float("inf"), float("nan")
    rows = [("x", -inf, inf), ("x", 0.0, inf), ("x", 1.0, 2.0), ("x", 1.0, 2.0000000000000004), ("x", 1e308, -1e308), ("y", nan, 0.0), ("y", 1.0, 1.0), ("y", 2.0, 0.5), ("y", 2.0, 1.5)]
    df = spark.createDataFrame(rows, "g string, a double, b double")
    got = {(r.g, str(r.a), str(r.b)) for r in sel.pareto(df, ["g"], ["a", "b"], block=1).collect()}
    assert got == {("x", "-inf", "inf"), ("x", "1.0", "2.0"), ("x", "1e+308", "-1e+308"), ("y", "nan", "0.0"), ("y", "1.0", "1.0"), ("y", "2.0", "0.5")}
    assert not sel.pareto(df.where("false"), ["g"], ["a"], ["b"]).collect()


def test_pack_refuses_whole_context(spark):
    b = spark.createDataFrame([("x", 1, 50, 5, 0, True, True), ("x", 2, 10, 1, 9, False, True), ("y", 1, 5, 1, 0, True, False), ("y", 2, 1, 1, 1, False, True),
                               ("z", 1, 5, 1, 0, True, True), ("z", 2, 4, 1, 8, False, True), ("z", 3, 4, 1, 7, False, True), ("z", 4, 1, 1, 1, False, False)],
                              "ctx string, ref long, bytes long, tokens long, value long, mandatory boolean, valid boolean")
    caps = spark.createDataFrame([("x", 40, 9), ("y", 40, 9), ("z", 10, 9)], "ctx string, max_bytes long, max_tokens long")
    got = {(r.ctx, r.ref): r.reason for r in sel.pack_context(b, caps, "ctx").collect()}
    assert got == {("x", 1): "required_context_exceeds_cap", ("x", 2): "not_evaluated_after_refusal", ("y", 1): "required_block_invalid", ("y", 2): "not_evaluated_after_refusal",
                   ("z", 1): "mandatory", ("z", 2): "selected_by_value_density", ("z", 3): "does_not_fit", ("z", 4): "optional_block_invalid"}


def test_quota_refund_only_inside_its_window(spark):
    calls = spark.createDataFrame([("p", 1, 1, 0, 60), ("p", 3, 2, 10, 60), ("p", 5, 3, 20, 60), ("p", 7, 4, 110, 90)], "provider string, seq long, call long, at long, tokens long")
    back = spark.createDataFrame([("p", 2, 1, 5, 30), ("p", 6, 2, 105, 50)], "provider string, seq long, call long, at long, unused long")
    for bound in (2, 100):
        got = {r.call: r.admitted for r in lg.quota_admission(calls, back, "provider", "seq", "call", "at", 100, 9, 100, bound).collect()}
        assert got == {1: True, 2: True, 3: False, 4: True}
    assert F is not None


@pytest.mark.parametrize("bound", [100, 10**6])
def test_null_amounts_are_refused(spark, bound):
    big = 2**53
    asks = spark.createDataFrame([(1, 1, 1, big + 1, big), (1, 2, 2, None, big), (1, 3, 3, 5, None), (1, 4, 4, big, big)], "k int, pos long, item long, amount long, cap long")
    frees = spark.createDataFrame([(1, 5, 4, None)], "k int, pos long, item long, amount long")
    got = {r["item"]: r["admitted"] for r in admit(asks, frees, ["k"], "pos", "item", ["amount"], ["cap"], bound).collect()}
    assert got == {1: False, 2: False, 3: False, 4: True}


@pytest.mark.parametrize("size", [1, 2, 63, 64, 65, 1000, 10_000])
def test_blocks_of_any_number(spark, size):
    """Asks near the cap and frees, two dimensions; one key has the given number of rows, another a few."""
    rnd = random.Random(size)
    asks, frees, want = [], [], {}
    for key, n in ((1, size), (2, 5)):
        rows = []
        for item in range(n):
            a, b = rnd.randint(0, 9), rnd.randint(0, 9)
            asks.append((key, 10 * item, item, a, b, 40, 35))
            rows.append((10 * item, item, a, b, True))
            if rnd.random() < 0.8:
                back = (10 * (item + rnd.randint(0, 40)) + rnd.randint(1, 9), item, rnd.randint(0, a), rnd.randint(0, b), False)
                if back[0] not in {r[0] for r in rows[-60:] if not r[4]}:
                    frees.append((key, *back[:4]))
                    rows.append(back)
        want |= {(key, i): v for i, v in walk(rows, (40, 35)).items()}
    a = spark.createDataFrame(asks, "k long, pos long, item long, x long, y long, cx long, cy long")
    f = spark.createDataFrame(frees, "k long, pos long, item long, x long, y long")
    got = {(r.k, r.item): r.admitted for r in admit(a, f, ["k"], "pos", "item", ["x", "y"], ["cx", "cy"], max(64, size // 8)).collect()}
    assert got == want


def test_saturated_by_turns(spark):
    """Every second ask fits exactly, so no bound settles it: the rounds are rows / block."""
    asks = spark.createDataFrame([(1, 2 * i, i, 60 if i % 2 else 41, 100) for i in range(400)], "k int, pos long, item long, x long, cap long")
    frees = spark.createDataFrame([(1, 2 * i + 1, i, 60 if i % 2 else 41) for i in range(400) if i % 3], "k int, pos long, item long, x long")
    used, want = 0, {}
    for i in range(400):
        x = 60 if i % 2 else 41
        want[i] = used + x <= 100
        used += x if want[i] and i % 3 == 0 else 0
    got = {r.item: r.admitted for r in admit(asks, frees, ["k"], "pos", "item", ["x"], ["cap"], 100).collect()}
    assert got == want


@pytest.mark.parametrize("block", [2, 100])
def test_sums_beyond_int64_and_odd_amounts(spark, block):
    big = 2**63 - 1
    rows = [(1, i, i, big, big) for i in range(6)] + [(2, 0, 0, big - 1, big), (2, 1, 1, 2, big), (2, 2, 2, 1, big), (3, 0, 0, -5, 0), (3, 1, 1, 5, 0), (3, 2, 2, 1, 0), (3, 3, 3, -1, 0), (3, 4, 4, 1, 0)]
    asks = spark.createDataFrame(rows, "k int, pos long, item long, x long, cap long")
    got = {(r.k, r.item): r.admitted for r in admit(asks, None, ["k"], "pos", "item", ["x"], ["cap"], block).collect()}
    assert got == {(1, i): i == 0 for i in range(6)} | {(2, 0): True, (2, 1): False, (2, 2): True, (3, 0): True, (3, 1): True, (3, 2): False, (3, 3): True, (3, 4): True}


def test_density_is_exact(spark):
    from fractions import Fraction

    rnd = random.Random(6)
    pairs = [(rnd.randint(0, 2**63 - 1), rnd.randint(1, 2**63 - 1)) for _ in range(60)]
    pairs += [(10**18, 10**18 + 1), (10**18 - 1, 10**18), (2**62, 2**63 - 1), (2**62 - 1, 2**63 - 3), (1, 3), (2, 6), (0, 5), (-1, 3), (-4, 3), (-2**63, 1)]
    df = spark.createDataFrame(pairs, "a long, b long")
    got = df.select("a", "b", F.struct(*sel.fraction_digits(F.col("a"), F.col("b"))).alias("o")).collect()
    key = {(r.a, r.b): tuple(r.o) for r in got}
    for p in pairs:
        for q in pairs:
            assert (key[p] < key[q], key[p] == key[q]) == (Fraction(*p) < Fraction(*q), Fraction(*p) == Fraction(*q))
