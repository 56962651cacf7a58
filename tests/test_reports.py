"""Reports and summaries against small hand-made tables."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tallyline.operators import stats as st
from tallyline.plans import audits, reports


def _rank(values, q):
    v = sorted(x for x in values if x is not None)
    return v[max(1, math.ceil(q * len(v))) - 1] if v else None


def test_trial_summary_and_survival(spark):
    rnd = random.Random(2)
    rows = [(s, rnd.random() < 0.8, rnd.randint(0, 50), rnd.choice([None, 3, 9]), None if s == "a" else 4, rnd.randint(0, 5), 1, 2, 0)
            for s in "aab" * 40]
    df = spark.createDataFrame(rows, "scenario string, passed boolean, duration long, recovery long, direct long, overhead long, calls long, effects long, duplicates long")
    got = {r.scenario: r for r in reports.survival_report(df).collect()}
    assert set(got) == {"a", "b", None}
    for s, r in got.items():
        mine = [x for x in rows if s is None or x[0] == s]
        assert (r.trials, r.passes, r.calls, r.effects, r.duplicates) == (len(mine), sum(x[1] for x in mine), len(mine), 2 * len(mine), 0)
        for name, at in (("duration", 2), ("recovery", 3)):
            assert [r[f"p{q}_{name}"] for q in (50, 95, 99)] == [_rank([x[at] for x in mine], q / 100) for q in (50, 95, 99)]
        assert (r.p50_direct, r.p50_overhead) == (_rank([x[4] for x in mine], 0.5), _rank([x[5] for x in mine], 0.5))


def test_delta_summary_skips_missing_pairs(spark):
    df = spark.createDataFrame([("f", 1, i, None if i == 0 else 7) for i in range(5)], "fault string, policy long, seed long, delta long")
    r = st.delta_summary(df, ["fault", "policy"], "delta", "seed", 50, "x").first()
    assert (r.pairs, r["mean"], r.p50, r.low, r.high) == (4, 7.0, 7.0, 7.0, 7.0)


@pytest.fixture
def bundle(spark):
    make = spark.createDataFrame
    fact = "FACT[s|p]=5 beds"
    page = '<html lang="en"><head><title>t</title></head><body><main>x</main></body></html>'
    return {
        "artifacts": make([("a1", fact, 0, 10, audits.UNTRUSTED)], "doc_id string, text string, created long, fresh_until long, trust string"),
        "claims": make([("c1", "a1", fact, "s", "p", "5", "beds", "en", "There are 5 beds"), ("c2", "a1", fact, "s", "p", "5", "beds", "es", "Hay 5 camas")],
                       "claim_id string, cited string, quote string, subject string, predicate string, value string, unit string, language string, statement string"),
        "pairs": make([("p1", "c1", "c2")], "pair_id string, left_id string, right_id string"),
        "grants": make([("g1", "me", ["see"], [], 0, 9)], "grant_id string, issuer string, capabilities array<string>, derived_from array<string>, issued long, expires long"),
        "actions": make([("x1", "tool", "see", "g1", ["a1"])], "action_id string, kind string, capability string, grant_id string, evidence array<string>"),
        "urls": make([("u1", "https://a.example/x")], "url_id string, url string"),
        "hosts": make([("a.example",)], "host string"),
        "pages": make([(1, "https://a.example/x", page)], "page_id long, url string, html string"),
    }


def test_text_safety_of_a_clean_bundle_and_of_planted_faults(spark, bundle):
    def failed(t, issuers=("me",)):
        return {r["check"]: r.findings for r in audits.text_safety_report(t, ["https"], list(issuers), ["see"], F.lit(5)).collect() if not r.passed}

    assert failed(bundle) == {}
    names = dict(enumerate(audits.TEXT_CHECKS))
    twice = {**bundle, "pairs": bundle["pairs"].unionByName(bundle["pairs"].withColumn("pair_id", F.lit("Bad id")))}
    assert failed(twice) == {names[0]: 1, names[3]: 2}  # a malformed id; both claims paired twice
    copies = {**bundle, "actions": bundle["actions"].unionByName(bundle["actions"])}
    assert failed(copies) == {names[0]: 1}
    bare = {**bundle, "pairs": bundle["pairs"].where("false")}
    assert failed(bare) == {names[0]: 1, names[3]: 2}  # an empty table; two claims without a pair
    trusted = {**bundle, "artifacts": bundle["artifacts"].withColumn("trust", F.lit(None).cast("string"))}
    assert failed(trusted) == {names[6]: 1}
    alias = {**bundle, "grants": bundle["grants"].withColumn("grant_id", F.lit("a1"))}
    assert failed(alias) == {names[6]: 2}  # one id for evidence and grant; no grant g1
    assert failed(bundle, ["me", "me"]) == {names[6]: 1}


def test_every_check_of_a_report_has_a_row(spark):
    none = spark.range(0)
    got = {r["check"]: (r.findings, r.passed) for r in audits.check_report({"a": [none], "b": [spark.range(2), none, spark.range(1)]}).collect()}
    assert got == {"a": (0, True), "b": (3, False)}
