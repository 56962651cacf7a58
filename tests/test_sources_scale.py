"""Documents are parsed once for their verdict, and reports are written in files that do not grow with the table."""
import re
from pathlib import Path

from pyspark.sql import functions as F

from tallyline.catalog import sources as src
from tallyline.catalog import whole
from tallyline.sources import documents as docs


def test_verdicts_of_odd_documents(spark, tmp_path):
    good = '{"schema_version":"v1","run_id":1,"envelope":{"deadline_ms":5},"tasks":[{"task_id":1}]}'
    odd = {"unparsable": ["", "null", "7", "[]", good + ",", good + "," + good, good + good, good + ',"e":1', good + "],[" + good, good + "}", good + "]", good[:-1],
                          good.replace('"v1"', '"v1","run_id":2'), good.replace('"task_id":1', '"task_id":1,"task_id":1'), good.replace('"run_id":1', '"run_id":"x"')],
           "unknown_field": [good.replace('{"schema', '{"extra":1,"schema', 1)], "missing_envelope": [good.replace('"envelope":{"deadline_ms":5},', "")],
           "missing_run_id": [good.replace('"run_id":1', '"run_id":null')], "unaccepted_version": [good.replace("v1", "v2")]}
    lines = [good, " " + good + " ", *[x for v in odd.values() for x in v]]
    (tmp_path / "docs.txt").write_text("\n".join(lines) + "\n")
    kept, bad = docs.read_documents(spark, str(tmp_path), docs.WORKFLOW, ["schema_version", "run_id", "envelope", "tasks"], ["v1"])
    assert [(r.run_id, r.envelope.deadline_ms, r.tasks[0].task_id) for r in kept.collect()] == [(1, 5, 1)] * 2
    assert sorted((r.reason, r.value) for r in bad.collect()) == sorted((k, x) for k, v in odd.items() for x in v)
    plan = bad.groupBy("reason").agg(F.count("*"))._jdf.queryExecution().optimizedPlan().toString()
    condition = next(x for x in plan.splitlines() if "Filter" in x)
    assert len(re.findall(r"from_json\(", condition)) <= 1


def test_reports_of_many_files(spark, sf, monkeypatch):
    whole = sorted(tuple(r) for r in src.junit_gate(spark, sf).collect())
    monkeypatch.setattr(src, "CASES", 500)
    path = Path(src._junit(spark, sf))
    sizes = [sum("<testcase" in x for x in f.read_text().splitlines()) for f in path.rglob("*.txt")]
    assert len(sizes) > 7 and max(sizes) <= 500 and sum(sizes) == src.fx.attempts(spark, sf).count()
    assert sorted(tuple(r) for r in src.junit_gate(spark, sf).collect()) == whole


def parses(df):
    return len(re.findall(r"from_json\(", df._jdf.queryExecution().optimizedPlan().toString()))


def test_a_table_of_documents_parses_them_once(spark, tmp_path):
    (tmp_path / "docs.txt").write_text('{"schema_version":"v1","run_id":1,"envelope":{"deadline_ms":5},"tasks":[{"task_id":1}]}\n{"run_id":2}}\n')
    good, bad = docs.read_documents(spark, str(tmp_path), docs.WORKFLOW, ["run_id"])
    assert [parses(good), parses(bad)] == [1, 1]
    assert [r.run_id for r in good.collect()] == [1] and [r.reason for r in bad.collect()] == ["unparsable"]


def test_evidence_documents_are_parsed_once_for_all_tables(spark, sf, tmp_path, monkeypatch):
    (tmp_path / "docs.txt").write_text('{"run_id":1,"envelope":{"deadline_ms":5},"events":[{"sequence":1,"digest":"d"},{"sequence":2,"digest":"e"}]}\n{"run_id":2}\n')
    good, bad = docs.read_documents(spark, str(tmp_path), docs.EVIDENCE, ["run_id", "envelope", "events"], keep=True)
    read = docs.evidence_tables(good)
    assert not [x for x in (bad, *read.values()) if parses(x)]
    assert [(r.run_id, r.pos, r.digest) for r in read["events"].collect()] == [(1, 1, "d"), (1, 2, "e")] and [r.reason for r in bad.collect()] == ["missing_envelope"]
    real = whole.fx.tasks
    monkeypatch.setattr(whole.fx, "tasks", lambda s, d: real(s, d).where("run_id < 40"))
    assert parses(whole.load_evidence(spark, sf)) == 0


def test_workflow_documents_are_written_compressed_in_bounded_files(spark, sf, monkeypatch):
    paths, keep = [], src.docs.read_documents
    monkeypatch.setattr(src.docs, "read_documents", lambda s, path, *a: paths.append(path) or keep(s, path, *a))
    monkeypatch.setattr(src, "DOCUMENTS", 100)
    good, bad = src._workflows(spark, sf)
    files = sorted(Path(paths[0]).glob("part-*"))
    rows = [spark.read.text(str(f)).count() for f in files[:5]]
    assert len(files) > 5 and all(f.name.endswith(".gz") for f in files) and max(rows) <= 100
    assert good.count() + bad.count() == src.fx.attempts(spark, sf).select("run_id").distinct().count()
