"""Queries over whole tables against their statements and against plain counts."""

import duckdb
import pytest

import __spark_entry__ as entry

NAMES = ("effect_serialization", "capability_breaches", "run_lifecycle", "evidence_lineage")


@pytest.mark.parametrize("name", NAMES)
def test_query_reads_all_rows(spark, sf, name):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in ("supplier", "orders", "lineitem", "events", "documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    rel = con.sql(entry.oracle_sql()[name])
    df = entry.queries()[name](spark, sf)
    cols = sorted(df.columns)
    assert cols == sorted(rel.columns)
    key = lambda r: tuple(str(v) for v in r)
    got = sorted(key(r) for r in df.select(*cols).collect())
    assert got == sorted(key(r) for r in rel.select(*[f'"{c}"' for c in cols]).fetchall()) and got


def test_quota_admission_takes_every_event(spark, sf):
    kinds = dict(duckdb.sql(f"SELECT event_type, count(*) FROM '{sf}/events.parquet' GROUP BY 1").fetchall())
    rows = entry.queries()["stream_quota_admission"](spark, sf)
    assert kinds["signup"] and rows.count() == 2 * sum(kinds.values()) + kinds["click"]
