import duckdb
import pytest

import __spark_entry__ as entry
from tallyline.streaming import stateful

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUICK = ("envelope_fit", "sequence_breaches", "percentiles_linear", "design_gaps", "assess_claims", "url_policy", "number_parity", "quota_usage", "run_ledger_checks")


def test_every_statement_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 150


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_statement(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = entry.queries()[name](spark, sf)
    rel = con.sql(entry.oracle_sql()[name])
    cols = sorted(df.columns)
    assert cols == sorted(rel.columns)
    key = lambda r: tuple("" if v is None else str(round(v, 6) if isinstance(v, float) else v) for v in r)
    got = sorted(key(r) for r in df.select(*cols).collect())
    want = sorted(key(r) for r in rel.select(*[f'"{c}"' for c in cols]).fetchall())
    assert got == want and got


def test_stream_refusal_order():
    q = stateful._Quota({"rpm": 1, "tpm": 9, "concurrency": 1}, {"rpm": 1, "tpm": 9, "concurrency": 1}, 100, 3, 100, 1000, 10**6)
    assert q._identity(None, 0) is None and q._identity(None, 1) == "identity"
    assert q._identity((0, -1, True, 0), 0) == "terminal" and q._identity((0, 5, False, 0), 3) == "retry_exhausted"
    assert q._identity((0, 5, False, 0), 1) is None and q._identity((0, -1, False, 0), 1) == "identity"
    assert [q._backoff(n) for n in (1, 2, 5)] == [100, 200, 1000]
