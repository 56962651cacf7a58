"""Sources and sinks: files Spark derives from the tables, written and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyline.catalog import fixtures as fx
from tallyline.catalog.registry import query
from tallyline.catalog.sqlviews import ATTEMPTS, DEPS, EVENTS, TASKS, w
from tallyline.operators import policy as pol
from tallyline.session import fresh_dir
from tallyline.sources import documents as docs
from tallyline.sources import gates, tables


DOCUMENTS = 50_000  # workflow documents of one file, which is compressed and so read by one task


def _workflows(spark, d):
    """One JSON workflow document per run, some broken on purpose."""
    r = F.col("run_id")
    t = fx.tasks(spark, d)
    up = fx.deps(spark, d).groupBy("run_id").agg(F.collect_list(F.struct("task_id", "dep_id")).alias("up"))

    def task(x):
        mine = F.transform(F.filter("up", lambda e: e["task_id"] == x["task_id"]), lambda e: e["dep_id"])
        return F.struct(
            x["task_id"].alias("task_id"), F.coalesce(F.array_sort(mine), F.array().cast("array<bigint>")).alias("dependencies"), x["optional"].alias("optional"),
            F.lit(1.0).alias("value"), F.lit(0.5).alias("min_quality"),
            F.struct(F.when(x["task_id"] % 3 == 0, "idempotent_write").otherwise("pure").alias("kind"), F.lit("res").alias("resource")).alias("effect"),
            F.array(F.struct(F.lit("p").alias("name"), x["provider"].cast("string").alias("provider"), F.lit(1).alias("p50"), F.lit(2).alias("p95"), x["tokens"].alias("tokens"),
                             x["cost"].alias("cost"), x["context"].alias("context"), F.lit(0.9).alias("quality"), F.lit(0.1).alias("failure"))).alias("profiles"),
            F.array(F.struct(F.lit("out").alias("port"), F.lit("out").alias("direction"), F.lit("s1").alias("type"))).alias("ports"),
        )

    own = F.struct("task_id", "optional", "provider", "tokens", "cost", "context")
    x = t.groupBy("run_id").agg(F.array_sort(F.collect_list(own)).alias("own")).join(up, "run_id", "left").select("run_id", F.transform("own", task).alias("tasks"))
    x = x.select(F.when(r % 97 == 0, "v0").otherwise("v1").alias("schema_version"), "run_id",
                 F.struct(F.lit(1000).alias("deadline_ms"), F.lit(1).alias("max_tokens"), F.lit(1).alias("max_cost"), F.lit(1).alias("max_context"), F.lit(2).alias("max_parallelism"),
                          F.lit(0.9).alias("success_floor"), F.array(F.struct(F.lit("a").alias("provider"), F.lit(1).alias("limit"))).alias("provider_limits")).alias("envelope"), "tasks")
    text = F.to_json(F.struct("*"))
    value = F.when(r % 89 == 0, F.concat(text, F.lit("}{"))).when(r % 83 == 0, F.concat(F.lit('{"extra":1,'), F.substring(text, 2, 10**9))).when(
        r % 79 == 0, F.regexp_replace(text, r'"envelope":\{.*?\]\},', "")).otherwise(text)
    path = fresh_dir(spark, "workflows")
    x.select(value.alias("value")).write.option("compression", "gzip").option("maxRecordsPerFile", DOCUMENTS).text(path)
    return docs.read_documents(spark, path, docs.WORKFLOW, ["schema_version", "run_id", "envelope", "tasks"], ["v1"])


@query("load_workflows", w(TASKS, DEPS) + """
, good AS (SELECT * FROM tasks WHERE run_id % 97 <> 0 AND run_id % 89 <> 0 AND run_id % 83 <> 0 AND run_id % 79 <> 0)
SELECT 'tasks' AS tbl, count(*) AS n, CAST(sum(task_id) AS BIGINT) AS checksum FROM good
UNION ALL SELECT 'task_deps', count(*), CAST(sum(dep_id) AS BIGINT) FROM deps WHERE run_id % 97 <> 0 AND run_id % 89 <> 0 AND run_id % 83 <> 0 AND run_id % 79 <> 0
UNION ALL SELECT 'profiles', count(*), CAST(sum(cost) AS BIGINT) FROM good
UNION ALL SELECT 'ports', count(*), CAST(sum(task_id) AS BIGINT) FROM good
UNION ALL SELECT 'envelopes', count(DISTINCT run_id), CAST(sum(DISTINCT run_id) AS BIGINT) FROM good""")
def load_workflows(spark, d):
    good, _ = _workflows(spark, d)
    t = docs.workflow_tables(good)
    out = None
    for name, col in (("tasks", "task_id"), ("task_deps", "dep_id"), ("profiles", "cost"), ("ports", "task_id"), ("envelopes", "run_id")):
        row = t[name].agg(F.count("*").alias("n"), F.sum(col).alias("checksum")).select(F.lit(name).alias("tbl"), "n", "checksum")
        out = row if out is None else out.unionByName(row)
    return out


@query("workflow_quarantine", """
WITH r AS (SELECT DISTINCT l_orderkey AS run_id FROM lineitem)
SELECT CASE WHEN run_id % 89 = 0 THEN 'unparsable' WHEN run_id % 83 = 0 THEN 'unknown_field' WHEN run_id % 79 = 0 THEN 'missing_envelope' ELSE 'unaccepted_version' END AS reason, count(*) AS n
FROM r WHERE run_id % 89 = 0 OR run_id % 83 = 0 OR run_id % 79 = 0 OR run_id % 97 = 0 GROUP BY 1""")
def workflow_quarantine(spark, d):
    return _workflows(spark, d)[1].groupBy("reason").agg(F.count("*").alias("n"))


@query("events_after_cursor", w(EVENTS) + " SELECT run_id, sequence, event_id, kind FROM ev WHERE run_id = 42 AND sequence > 10")
def events_after_cursor(spark, d):
    """The log is written once with its sequence, partitioned like a store would be, then tailed."""
    path = fresh_dir(spark, "log")
    fx.events(spark, d).select("run_id", "sequence", "event_id", "kind").write.parquet(path)
    return tables.events_after(spark.read.parquet(path), 42, 10)


@query("load_snapshots", """
SELECT s_suppkey AS snapshot, 'floating_version' AS code FROM supplier WHERE s_suppkey % 7 = 0
UNION ALL SELECT s_suppkey, 'window_above_31_days' FROM supplier WHERE s_suppkey % 5 = 0
UNION ALL SELECT s_suppkey, 'source_follows_snapshot' FROM supplier WHERE s_suppkey % 11 = 0
UNION ALL SELECT s_suppkey, 'source_stale' FROM supplier WHERE s_suppkey % 11 = 0
UNION ALL SELECT s_suppkey, 'secret_like_key' FROM supplier WHERE s_suppkey % 19 = 0""")
def load_snapshots(spark, d):
    i = F.col("s_suppkey")
    lit = F.lit
    st = lambda **kw: F.struct(*[v.alias(k) for k, v in kw.items()])
    x = fx.table(spark, d, "supplier").select(F.to_json(F.struct(
        i.cast("string").alias("snapshot"), lit("2026-01-01T00:00:00Z").alias("snapshot_at"),
        F.when(i % 5 == 0, "2026-03-01T00:00:00Z").otherwise("2026-01-20T00:00:00Z").alias("valid_until"), lit(86400).alias("max_age_s"),
        st(provider=F.col("s_name"), version=F.when(i % 7 == 0, "LATEST").otherwise("3.1")).alias("identity"),
        st(currency=lit("USD"), input_price=lit(1), output_price=lit(1)).alias("pricing"), st(rpm=lit(1), tpm=lit(1), concurrency=lit(1), window_ms=lit(1)).alias("quota"),
        st(provenance=lit("observed"), sample_count=lit(3), latency_p50=lit(1), latency_p95=lit(2), quality_ppm=lit(5),
           sampled_at=F.when(i % 11 == 0, "2026-01-01 00:00:00").otherwise("2025-12-31T12:00:00Z")).alias("metrics"),
        F.when(i % 19 == 0, st(region=lit("r"), domain_region=lit("r"), domain_provider=F.col("s_name"), Password=lit("x")))
        .otherwise(st(region=lit("r"), domain_region=lit("r"), domain_provider=F.col("s_name"), Password=lit(None).cast("string"))).alias("placement"),
    )).alias("value"))
    path = fresh_dir(spark, "snapshots")
    x.write.text(path)
    good, _ = docs.read_documents(spark, path, docs.SNAPSHOT, ["snapshot"])
    keys = spark.read.text(path).select(F.get_json_object("value", "$.snapshot").alias("snapshot"), docs.nested_keys(F.col("value")).alias("keys"))
    rows = docs.snapshot_rows(good).join(keys, "snapshot").withColumn("snapshot", F.col("snapshot").cast("long"))
    return pol.snapshot_checks(rows, ["snapshot"])


@query("canonical_records", """
SELECT user_id AS seed, event_type AS fault, CAST(json_extract_string(props, '$.k') AS BIGINT) % 3 AS policy, CAST(sum(CAST(ceil(value) AS BIGINT)) AS BIGINT) AS tokens FROM events GROUP BY ALL""")
def canonical_records(spark, d):
    path = fresh_dir(spark, "records")
    tables.write_records(fx.experiment(spark, d).select("seed", "fault", "policy", "tokens"), path, ["seed", "fault", "policy"])
    return spark.read.schema("seed bigint, fault string, policy bigint, tokens bigint").json(path)


@query("evidence_folder", "SELECT 1 AS altered, 1 AS extra, 1 AS missing, true AS intact_before FROM (SELECT count(*) AS n FROM events) WHERE n > 0")
def evidence_folder(spark, d):
    """Write an evidence folder, check it, then check it against a manifest with planted differences."""
    folder = fresh_dir(spark, "evidence")
    tables.write_evidence(fx.experiment(spark, d).select("seed", "fault", "policy", "tokens"), folder, ["seed", "fault", "policy"], 4)
    clean = tables.verify_evidence(spark, folder).select(F.lit("before").alias("code"))
    m = tables.read_manifest(spark, folder)
    first = m.agg(F.min("name").alias("name"))
    last = m.agg(F.max("name").alias("name"))
    bent = m.join(last, "name", "left_anti").join(first.withColumn("hit", F.lit(True)), "name", "left").select(
        "name", "bytes", F.when(F.col("hit"), F.lit("0" * 64)).otherwise(F.col("sha256")).alias("sha256"))
    bent = bent.unionByName(last.select(F.concat("name", F.lit(".gone")).alias("name"), F.lit(1).cast("long").alias("bytes"), F.lit("0" * 64).alias("sha256")))
    found = tables.manifest_breaches(bent, tables.folder_manifest(spark, f"{folder}/records"), "name")
    count = lambda c: F.count_if(F.col("code") == c).cast("int")
    return found.select("code").unionByName(clean).agg(
        count("digest_mismatch").alias("altered"), count("unknown_payload").alias("extra"), count("missing_payload").alias("missing"),
        (count("before") == 0).alias("intact_before"))


@query("append_once", "SELECT sha256(text) AS artifact_id, min(doc_id) AS doc_id FROM documents WHERE doc_id % 2 = 0 GROUP BY 1 UNION ALL "
       "SELECT sha256(text), min(doc_id) FROM documents WHERE doc_id % 2 = 1 AND sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 2 = 0) GROUP BY 1")
def append_once(spark, d):
    path = fresh_dir(spark, "artifacts")
    a = fx.artifacts(spark, d).select("artifact_id", "doc_id")
    for part in (0, 1, 0):
        tables.append_new(a.where(F.col("doc_id") % 2 == part), path, ["artifact_id"])
    return spark.read.parquet(path)


@query("pending_outbox", w(EVENTS) + """
SELECT event_id, event_id * 3 AS sequence, kind FROM ev WHERE kind = 'purchase' AND units > 5 AND NOT (event_id % 4 = 0) ORDER BY sequence LIMIT 100""".replace("ORDER BY sequence", "ORDER BY event_id * 3"))
def pending_outbox(spark, d):
    box = fx.events(spark, d).where("kind = 'purchase'").select("event_id", (F.col("event_id") * 3).alias("sequence"), "kind", "units")
    path = fresh_dir(spark, "acks")
    for cond in ("event_id % 4 = 0", "event_id % 8 = 0", "units <= 5"):
        tables.acknowledge(box.where(cond), 1, path)
    return tables.pending_outbox(box, spark.read.parquet(path), 100).select("event_id", "sequence", "kind")


CASES = 1_000_000  # test cases for one more file of each report


def _junit(spark, d):
    """One XML report per supplier region, test cases from line items, in files of one suite each."""
    a = fx.attempts(spark, d)
    files = a.count() // CASES + 1
    a = a.select((F.col("provider") % 7).alias("r"), F.pmod(F.xxhash64("run_id", "task_id", "profile", "start_ms"), F.lit(files)).alias("f"), "run_id", "task_id", "outcome")
    inner = F.when((F.col("r") == 1) & (F.col("run_id") == 12), "<failure>x</failure>").otherwise("")
    case = F.concat(F.lit('<testcase name="t'), F.col("run_id").cast("string"), F.lit('">'), inner, F.lit("</testcase>"))
    n = a.groupBy("r", "f").agg(F.count("*").alias("n"), F.count_if(F.col("run_id") == 12).alias("failed"))
    head = n.select("r", "f", F.lit(0).alias("o"), F.concat(F.lit('<testsuite tests="'), (F.col("n") + F.when(F.col("r") == 2, 1).otherwise(0)).cast("string"), F.lit('" failures="'),
                    F.when(F.col("r") == 1, F.col("failed")).otherwise(F.lit(0)).cast("string"), F.lit('" errors="0" skipped="0" disabled="'), F.when(F.col("r") == 3, "1").otherwise("0"), F.lit('">')).alias("value"))
    tail = n.select("r", "f", F.lit(2).alias("o"), F.lit("</testsuite>").alias("value"))
    x = head.unionByName(a.select("r", "f", F.lit(1).alias("o"), case.alias("value"))).unionByName(tail)
    path = fresh_dir(spark, "junit")
    x.repartition(7 * files, "r", "f").sortWithinPartitions("r", "f", "o").select("r", "f", "value").write.partitionBy("r", "f").text(path)
    return path


@query("junit_gate", """
WITH n AS (SELECT l_suppkey % 7 AS r, count(*) AS n, count(*) FILTER (WHERE l_orderkey = 12) AS f FROM lineitem GROUP BY 1)
SELECT r AS report, 'not_all_passed' AS code FROM n WHERE (r = 1 AND f > 0) OR r = 3 UNION ALL SELECT r, 'count_mismatch' FROM n WHERE r = 2""")
def junit_gate(spark, d):
    path = _junit(spark, d)
    folder = F.regexp_extract("_metadata.file_path", r"^.*/r=[^/]+/", 0)
    out = gates.junit_breaches(gates.junit_cases(spark, path, folder), gates.junit_suites(spark, path, folder))
    return out.select(F.regexp_extract("report", r"/r=(\d+)/", 1).cast("long").alias("report"), "code")


@query("coverage_gate", w(ATTEMPTS) + """
, g AS (SELECT provider AS report, count(*) AS s, count(*) FILTER (WHERE outcome <> 'failed') AS c, count(DISTINCT run_id) AS b FROM attempts GROUP BY ALL)
SELECT report, 'statement_floor' AS code FROM g WHERE 100.0 * c / s + 1e-12 < 66 UNION ALL SELECT report, 'covered_above_measured' FROM g WHERE report % 13 = 0""")
def coverage_gate(spark, d):
    a = fx.attempts(spark, d)
    g = a.groupBy(F.col("provider").alias("report")).agg(
        F.count("*").alias("statements"), F.count_if(F.col("outcome") != "failed").alias("covered_statements"), F.countDistinct("run_id").alias("branches"))
    path = fresh_dir(spark, "coverage")
    g.withColumn("covered_branches", F.col("branches") + F.when(F.col("report") % 13 == 0, 1).otherwise(0)).write.json(path)
    rows = spark.read.schema("report bigint, statements bigint, covered_statements bigint, branches bigint, covered_branches bigint").json(path)
    return gates.coverage_breaches(rows, 66.0, 50.0)


@query("scanner_gate", w(EVENTS) + """
, g AS (SELECT run_id AS report, count(*) FILTER (WHERE k % 50 = 1) AS m, count(*) FILTER (WHERE k % 50 = 2) AS h, count(*) FILTER (WHERE k % 50 = 20) AS u, bool_or(k % 50 < 20 AND k % 50 > 0 AND event_id % 401 = 0) AS bare FROM ev GROUP BY ALL)
SELECT report, 'blocked_findings' AS code FROM g WHERE m + h > 0 UNION ALL SELECT report, 'count_mismatch' FROM g WHERE report % 9 = 0 OR (report % 4 = 0 AND u > 0)
UNION ALL SELECT report, 'finding_fields_missing' FROM g WHERE bare""")
def scanner_gate(spark, d):
    """A report of four does not declare its findings of undefined severity."""
    k = F.col("k") % 50
    e = fx.events(spark, d).withColumn("severity", F.when(k == 1, "MEDIUM").when(k == 2, "HIGH").when((k > 2) & (k < 20), "LOW").when(k == 20, "UNDEFINED"))
    f = e.where("severity is not null").select(
        F.col("run_id").alias("report"), "severity", F.lit("a.py").alias("filename"), F.lit("B101").alias("test_id"),
        F.when((F.col("event_id") % 401 != 0) | (k == 20), "text").otherwise("").alias("issue_text"))
    n = lambda s: F.count_if(F.col("severity") == s)
    t = e.groupBy(F.col("run_id").alias("report")).agg(
        F.count("*").alias("loc"), F.lit(0).alias("errors"), F.lit(0).alias("skipped_tests"), n("UNDEFINED").alias("u"), n("LOW").alias("l"), n("MEDIUM").alias("medium"), n("HIGH").alias("high"))
    t = t.withColumns({"low": F.col("l") + F.when(F.col("report") % 9 == 0, 1).otherwise(0), "undefined": F.when(F.col("report") % 4 == 0, 0).otherwise(F.col("u"))})
    return gates.scanner_breaches(f, t)


@query("license_gate", """
WITH p AS (SELECT p_brand AS report, p_name AS name, CAST(p_partkey // 400 AS VARCHAR) AS version, p_partkey % 10 AS l, p_partkey FROM part)
SELECT report, name, version, 'unknown_license' AS code FROM p WHERE l = 0 UNION ALL SELECT report, name, version, 'prohibited_license' FROM p WHERE l IN (1, 3)
UNION ALL SELECT report, lower(name), version, 'duplicate_package' FROM p GROUP BY 1, 2, 3 HAVING count(*) > 1""")
def license_gate(spark, d):
    names = ["unknown", "GNU  Affero General Public License", "MIT", "GPL-3.0", "GPL v2 or MIT", "Apache 2.0", "BSD", "LGPL-2.1", "MPL", "PSF"]
    i = F.col("p_partkey")
    p = fx.table(spark, d, "part").select(F.col("p_brand").alias("report"), F.col("p_name").alias("name"), F.expr("p_partkey div 400").cast("string").alias("version"),
                                          F.element_at(F.array(*[F.lit(n) for n in names]), (i % 10 + 1).cast("int")).alias("license"))
    return gates.license_breaches(p)
