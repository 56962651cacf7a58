"""Evidence, policy and plan checks over documents, labels, orders and suppliers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from tallyline.catalog import fixtures as fx
from tallyline.catalog.registry import query
from tallyline.catalog.sqlviews import ARTIFACTS, ATTEMPTS, CLAIMS, DEPS, EVENTS, NUMBERED, TASKS, w
from tallyline.functions.columns import is_fresh, scoped_key, seal, short_identity
from tallyline.operators import evidence as evd
from tallyline.operators import policy as pol
from tallyline.operators.checks import dangling, flagged, validate_outputs

AS_OF = 500


@query("fresh_artifacts", w(ARTIFACTS) + """
SELECT doc_id, created <= 500 AND (CASE WHEN doc_id % 10 = 0 THEN NULL ELSE fresh_until END IS NULL OR 500 <= fresh_until) AS fresh FROM artifacts""")
def fresh_artifacts(spark, d):
    until = F.when(F.col("doc_id") % 10 != 0, F.col("fresh_until"))
    return fx.artifacts(spark, d).select("doc_id", is_fresh(F.col("created"), until, F.lit(AS_OF)).alias("fresh"))


@query("dangling_evidence", w(CLAIMS) + """
SELECT claim_id, CASE WHEN claim_id % 89 = 0 THEN evidence + 10000000 ELSE evidence END AS ref FROM claims c
WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = CASE WHEN claim_id % 89 = 0 THEN evidence + 10000000 ELSE evidence END)
UNION ALL SELECT claim_id, contradicts FROM claims WHERE contradicts IS NOT NULL AND contradicts NOT IN (SELECT claim_id FROM claims)""")
def dangling_evidence(spark, d):
    c = fx.claims(spark, d)
    ref = F.element_at("evidence", 1)
    refs = c.select("claim_id", F.when(F.col("claim_id") % 89 == 0, ref + 10000000).otherwise(ref).alias("ref"))
    gone = dangling(refs, "ref", fx.artifacts(spark, d), "doc_id")
    other = dangling(c.select("claim_id", F.explode("contradicts").alias("ref")), "ref",
                     c.select(F.col("claim_id").alias("id")), "id")
    return gone.select("claim_id", "ref").unionByName(other.select("claim_id", "ref"))


def _assessed(spark, d):
    c = fx.claims(spark, d).withColumns({
        "valid": F.col("claim_id") % 53 != 0,
        "evidence": F.when(F.col("claim_id") % 89 == 0, F.array(F.col("claim_id") + 10000000))
        .when(F.col("claim_id") % 47 == 0, F.array().cast("array<bigint>")).otherwise(F.col("evidence")),
    })
    a = fx.artifacts(spark, d).select(F.col("doc_id").alias("ref"), "created", "fresh_until", (F.col("doc_id") % 59 != 0).alias("valid"))
    return evd.assess_claims(c, a, F.lit(AS_OF))


ASSESSED = w(CLAIMS, ARTIFACTS) + """
, r AS (SELECT claim_id, status, contradicts, created, CASE WHEN claim_id % 89 = 0 THEN claim_id + 10000000
          WHEN claim_id % 47 = 0 THEN NULL ELSE evidence END AS ref FROM claims),
s AS (SELECT claim_id, contradicts, CASE WHEN claim_id % 53 = 0 OR r.created > 500 THEN 'invalid' WHEN status = 'unverified' THEN 'unverified'
   WHEN ref IS NULL OR a.doc_id IS NULL THEN 'unverified' WHEN a.doc_id % 59 = 0 THEN 'invalid'
   WHEN NOT (a.created <= 500 AND 500 <= a.fresh_until) THEN 'stale' ELSE 'supported' END AS assessed
   FROM r LEFT JOIN artifacts a ON a.doc_id = r.ref)"""


@query("assess_claims", ASSESSED + " SELECT claim_id, assessed FROM s")
def assess_claims(spark, d):
    return _assessed(spark, d).select("claim_id", "assessed")


@query("contradictions", ASSESSED + """
, e AS (SELECT claim_id, contradicts AS other FROM s WHERE contradicts IS NOT NULL UNION SELECT contradicts, claim_id FROM s WHERE contradicts IS NOT NULL)
SELECT e.claim_id, count(*) AS conflicts FROM e JOIN s a ON a.claim_id = e.claim_id JOIN s b ON b.claim_id = e.other
WHERE a.assessed = 'supported' AND b.assessed = 'supported' GROUP BY e.claim_id""")
def contradictions(spark, d):
    return evd.contradictions(_assessed(spark, d))


@query("evidence_causality", w(EVENTS, ARTIFACTS) + """
, u AS (SELECT event_id, units + k AS at_step, k * 11 AS ref FROM ev)
SELECT event_id, ref, CASE WHEN a.doc_id IS NULL THEN 'missing_evidence_artifact' WHEN a.doc_id // 8 >= at_step THEN 'evidence_causality_violation'
   WHEN NOT (a.created // 8 <= at_step AND at_step <= a.fresh_until // 8) THEN 'stale_or_future_evidence' END AS code
FROM u LEFT JOIN artifacts a ON a.doc_id = u.ref
WHERE a.doc_id IS NULL OR a.doc_id // 8 >= at_step OR NOT (a.created // 8 <= at_step AND at_step <= a.fresh_until // 8)""")
def evidence_causality(spark, d):
    u = fx.events(spark, d).select("event_id", (F.col("units") + F.col("k")).alias("at_step"), (F.col("k") * 11).alias("ref"), F.lit(1).alias("run_id"))
    a = fx.artifacts(spark, d).select(F.lit(1).alias("run_id"), F.col("doc_id").alias("ref"), F.expr("doc_id div 8").alias("produced_at"),
                                      F.expr("created div 8").alias("created"), F.expr("fresh_until div 8").alias("fresh_until"))
    return evd.evidence_causality(u, a, ["run_id"], ["event_id"], "ref", "at_step", "at_step").select("event_id", "ref", "code")


@query("lineage_order", w(ARTIFACTS) + """
, a AS (SELECT doc_id, doc_id * 10 + CASE WHEN doc_id % 67 = 0 THEN -500 ELSE 5 END AS created,
   CASE WHEN doc_id % 89 = 0 THEN doc_id + 10000000 ELSE doc_id END AS producer,
   CASE WHEN doc_id % 71 = 0 THEN doc_id + 2 WHEN doc_id % 83 = 0 THEN doc_id + 10000000 ELSE doc_id // 2 END AS parent FROM artifacts),
x AS (SELECT a.*, e.doc_id AS pos FROM a LEFT JOIN documents e ON e.doc_id = a.producer)
SELECT doc_id, CASE WHEN pos IS NULL THEN 'artifact_producer_mismatch' ELSE 'artifact_time_causality' END AS code FROM x WHERE pos IS NULL OR created < pos * 10
UNION ALL
SELECT x.doc_id, CASE WHEN p.doc_id IS NULL THEN 'missing_artifact_parent' ELSE 'artifact_lineage_causality' END FROM x LEFT JOIN x p ON p.doc_id = x.parent
WHERE x.doc_id > 0 AND (p.doc_id IS NULL OR coalesce(p.pos, 1000000000000) >= coalesce(x.pos, -1))""")
def lineage_order(spark, d):
    i = F.col("doc_id")
    parent = F.when(i % 71 == 0, i + 2).when(i % 83 == 0, i + 10000000).otherwise(F.expr("doc_id div 2"))
    a = fx.artifacts(spark, d).select(
        "doc_id", (i * 10 + F.when(i % 67 == 0, -500).otherwise(5)).alias("created"),
        F.when(i % 89 == 0, i + 10000000).otherwise(i).alias("producer"),
        F.when(i > 0, F.array(parent)).otherwise(F.array().cast("array<bigint>")).alias("parents"),
    )
    e = fx.artifacts(spark, d).select(i.alias("event"), i.alias("pos"), (i * 10).alias("at"))
    return evd.lineage_order(a, e, "doc_id", "parents", "producer", "event", "pos", "at")


@query("as_of_snapshots", w(EVENTS) + """
, s AS (SELECT k, at_ms AS snapshot_at, at_ms + units * 3600000 AS valid_until, sha256('{"event_id":' || event_id || '}') AS digest FROM ev WHERE kind = 'view'),
c AS (SELECT k, event_id, at_ms FROM ev WHERE kind = 'purchase'),
x AS (SELECT c.*, s.* EXCLUDE (k), row_number() OVER (PARTITION BY c.event_id ORDER BY s.snapshot_at DESC, s.valid_until DESC, digest DESC) AS n
      FROM c LEFT JOIN s ON s.k = c.k AND s.snapshot_at <= c.at_ms)
SELECT k, event_id, at_ms, snapshot_at, digest, CASE WHEN snapshot_at IS NULL THEN 'snapshot_missing' WHEN at_ms > valid_until THEN 'snapshot_stale' ELSE 'ok' END AS code
FROM x WHERE n = 1""")
def as_of_snapshots(spark, d):
    e = fx.events(spark, d)
    s = e.where("kind = 'view'").select("k", F.col("at_ms").alias("snapshot_at"), (F.col("at_ms") + F.col("units") * 3600000).alias("valid_until"),
                                        seal(["event_id"]).alias("digest"))
    c = e.where("kind = 'purchase'").select("k", "event_id", "at_ms")
    return evd.as_of_lookup(c, s, ["k"], "at_ms", ["event_id"], bits=24)


@query("snapshot_admission", w(TASKS) + """
, t AS (SELECT run_id, task_id, provider, run_id * 31 + task_id AS h FROM tasks)
SELECT run_id, CASE WHEN h % 47 = 0 THEN task_id + 1000 ELSE task_id END AS task_id, CASE WHEN h % 47 = 0 THEN 'unselected_snapshot' WHEN h % 29 = 0 THEN 'snapshot_missing' WHEN h % 43 = 0 THEN 'snapshot_stale'
  WHEN h % 37 = 0 THEN 'identity_mismatch' WHEN h % 31 = 0 THEN 'provider_mismatch' ELSE 'digest_mismatch' END AS code
FROM t WHERE h % 47 = 0 OR (h % 29 = 0 AND h % 3 <> 0) OR (h % 29 <> 0 AND (h % 43 = 0 OR h % 37 = 0 OR h % 31 = 0 OR (h % 41 = 0 AND h % 3 <> 0)))
UNION ALL SELECT run_id, task_id, 'snapshot_missing' FROM t WHERE h % 47 = 0 AND h % 3 <> 0""")
def snapshot_admission(spark, d):
    """Two tasks of three declare the digest of their snapshot; the snapshots of some lie under an id that was not selected."""
    h = F.col("run_id") * 31 + F.col("task_id")
    t = fx.tasks(spark, d).select("run_id", "task_id", "provider", h.alias("h"))
    h = F.col("h")
    tasks = t.select("run_id", "task_id", F.lit("p").alias("profile"), "provider", F.when(h % 3 != 0, seal(["h"])).alias("declared"))
    new = t.where("h % 47 = 0 or h % 29 <> 0").select(
        "run_id", (F.col("task_id") + F.when(h % 47 == 0, 1000).otherwise(0)).alias("task_id"), F.when(h % 37 == 0, "q").otherwise("p").alias("profile"),
        (F.col("provider") + F.when(h % 31 == 0, 1).otherwise(0)).alias("provider"), F.when(h % 41 == 0, "other").otherwise(seal(["h"])).alias("digest"),
        F.lit(400).alias("snapshot_at"), F.when(h % 43 == 0, 499).otherwise(500).alias("valid_until"))
    old = new.withColumns({"snapshot_at": F.lit(300), "profile": F.lit("old")})
    return evd.snapshot_admission(tasks, new.unionByName(old), ["run_id", "task_id"], False, F.lit(500))


@query("seal_breaches", """
SELECT doc_id, 'digest_mismatch' AS code FROM documents WHERE doc_id % 103 = 0""")
def seal_breaches(spark, d):
    cols = ["doc_id", "lang", "n_chars", "source"]
    x = fx.table(spark, d, "documents").withColumn("digest", seal(cols))
    x = x.withColumn("source", F.when(F.col("doc_id") % 103 == 0, F.concat(F.col("source"), F.lit("!"))).otherwise(F.col("source")))
    return flagged(x, {"digest_mismatch": ~F.col("digest").eqNullSafe(seal(cols))}, ["doc_id"])


@query("record_identities", """
SELECT doc_id, 'sha256:' || sha256('{"doc_id":' || doc_id || ',"lang":"' || lang || '","n_chars":' || n_chars || ',"source":"' || source || '"}') AS address,
  sha256('{"source":"' || source || '","doc_id":' || doc_id || '}') AS scoped, substr(sha256('attempt' || chr(0) || source || chr(0) || doc_id), 1, 24) AS identity
FROM documents""")
def record_identities(spark, d):
    t = fx.table(spark, d, "documents")
    return t.select("doc_id", F.concat(F.lit("sha256:"), seal(["doc_id", "lang", "n_chars", "source"])).alias("address"),
                    scoped_key("source", "doc_id").alias("scoped"),
                    short_identity(F.lit("attempt"), F.col("source"), F.col("doc_id").cast("string")).alias("identity"))


def _tree(leaves: str, key: str, levels) -> str:
    """Statement of a hash tree over ``l`` (key, p, o, n): one level per number of leading digits, then the root."""
    out, last = f", l AS ({leaves}), t AS (SELECT {key}, p AS place, sha256('[\"' || string_agg(o || ' ' || n, '\",\"' ORDER BY o) || '\"]') AS d, sum(n) AS n FROM l GROUP BY ALL)", "t"
    for k in levels:
        name = f"t{k}"
        out += f", {name} AS (SELECT {key}, substr(place, 1, {k}) AS up, sha256('[\"' || string_agg(d, '\",\"' ORDER BY place) || '\"]') AS d, sum(n) AS n FROM {last} GROUP BY ALL)"
        out += f", {name}a AS (SELECT {key}, up AS place, d, n FROM {name})"
        last = name + "a"
    return out + f" SELECT {key}, CAST(n AS BIGINT) AS records, d AS set_digest FROM {last}"


@query("set_digests", w(ARTIFACTS) + _tree("SELECT producer, substr(sha256(artifact_id), 1, 9) AS p, artifact_id AS o, count(*) AS n FROM artifacts GROUP BY ALL", "producer", (6, 3, 0)))
def set_digests(spark, d):
    return evd.set_digest(fx.artifacts(spark, d), ["producer"], "artifact_id")


@query("chain_digests", w(EVENTS) + """
, e AS (SELECT run_id, sequence, sha256('{"event_id":' || event_id || '}') AS d FROM ev)""" + _tree(
    "SELECT run_id, lpad(hex(CAST(sequence AS BIGINT)), 16, '0') || substr(sha256(d), 1, 9) AS p, d AS o, count(*) AS n FROM e GROUP BY ALL", "run_id", (22, 19, 16, 13, 10, 7, 4, 1, 0)))
def chain_digests(spark, d):
    return evd.set_digest(fx.events(spark, d).withColumn("digest", seal(["event_id"])), ["run_id"], "digest", "sequence")


@query("payload_manifest", w(ARTIFACTS) + """
, d AS (SELECT doc_id, octet_length(encode(text)) + CASE WHEN doc_id % 61 = 0 THEN 1 ELSE 0 END AS bytes,
   CASE WHEN doc_id % 67 = 0 THEN repeat('0', 64) ELSE artifact_id END AS sha FROM artifacts WHERE doc_id % 71 <> 0),
p AS (SELECT doc_id, octet_length(encode(text)) AS bytes, artifact_id AS sha FROM artifacts WHERE doc_id % 73 <> 0)
SELECT coalesce(d.doc_id, p.doc_id) AS doc_id, CASE WHEN p.doc_id IS NULL THEN 'missing_payload' WHEN d.doc_id IS NULL THEN 'unknown_payload'
  WHEN d.bytes <> p.bytes THEN 'size_mismatch' ELSE 'digest_mismatch' END AS code
FROM d FULL JOIN p ON d.doc_id = p.doc_id WHERE p.doc_id IS NULL OR d.doc_id IS NULL OR d.bytes <> p.bytes OR d.sha <> p.sha""")
def payload_manifest(spark, d):
    i = F.col("doc_id")
    a = fx.artifacts(spark, d).select("doc_id", F.octet_length("text").cast("long").alias("bytes"), F.col("artifact_id").alias("sha256"))
    declared = a.where(i % 71 != 0).select("doc_id", (F.col("bytes") + F.when(i % 61 == 0, 1).otherwise(0)).alias("bytes"),
                                           F.when(i % 67 == 0, F.lit("0" * 64)).otherwise(F.col("sha256")).alias("sha256"))
    return evd.manifest_breaches(declared, a.where(i % 73 != 0), "doc_id")


@query("artifact_ingest", w(ARTIFACTS) + """
, n AS (SELECT doc_id // 3 AS id, artifact_id AS content FROM artifacts WHERE doc_id % 2 = 0),
e AS (SELECT doc_id // 3 AS id, min(artifact_id) AS stored FROM artifacts WHERE doc_id % 7 = 0 GROUP BY 1),
f AS (SELECT n.*, coalesce(e.stored, min(content) OVER (PARTITION BY n.id)) AS keep, e.stored IS NULL AS isnew FROM n LEFT JOIN e USING (id))
SELECT id, CAST(max(CASE WHEN isnew THEN 1 ELSE 0 END) AS BIGINT) AS inserted,
  count(*) FILTER (WHERE content = keep) - CAST(max(CASE WHEN isnew THEN 1 ELSE 0 END) AS BIGINT) AS duplicates, count(*) FILTER (WHERE content <> keep) AS conflicts
FROM f GROUP BY id""")
def artifact_ingest(spark, d):
    a = fx.artifacts(spark, d).select(F.expr("doc_id div 3").alias("id"), F.col("artifact_id").alias("content"), "doc_id")
    return evd.ingest(a.where("doc_id % 2 = 0"), a.where("doc_id % 7 = 0"), "id", "content")


@query("artifact_table_audit", w(ARTIFACTS) + """
SELECT doc_id, 'address_mismatch' AS code FROM artifacts WHERE doc_id % 97 = 0
UNION ALL SELECT doc_id, 'missing_parent' FROM artifacts WHERE doc_id % 89 = 0
UNION ALL SELECT min(doc_id), 'conflicting_copies' FROM artifacts GROUP BY artifact_id HAVING count(DISTINCT producer) > 1""")
def artifact_table_audit(spark, d):
    from tallyline.plans.audits import artifact_table_audit as audit

    i = F.col("doc_id")
    a = fx.artifacts(spark, d).select(
        "doc_id", "text", "producer", F.when(i % 97 == 0, F.lit("0" * 64)).otherwise(F.col("artifact_id")).alias("artifact_id"),
        F.col("artifact_id").alias("content"), F.when(i % 89 == 0, i + 10000000).otherwise(i).alias("parent"),
    )
    return audit(a)


@query("packed_context_audit", w(NUMBERED) + """
, b AS (SELECT run_id, 'artifact' AS kind, task_id * 100 + attempt AS ref, context AS bytes, tokens FROM numbered),
m AS (SELECT run_id, kind, ref, bytes + CASE WHEN run_id % 83 = 0 AND ref = 101 THEN 1 ELSE 0 END AS bytes, tokens FROM b WHERE NOT (run_id % 89 = 0 AND ref = 201)),
h AS (SELECT run_id, sum(bytes) + CASE WHEN run_id % 79 = 0 THEN 1 ELSE 0 END AS used, sum(bytes) AS sb, sum(tokens) AS st FROM b GROUP BY run_id)
SELECT DISTINCT coalesce(b.run_id, m.run_id) AS run_id, 'entry_mismatch' AS code FROM b FULL JOIN m ON b.run_id = m.run_id AND b.ref = m.ref
  WHERE b.run_id IS NULL OR m.run_id IS NULL OR b.bytes <> m.bytes OR b.tokens <> m.tokens
UNION ALL SELECT run_id, 'recorded_use_mismatch' FROM h WHERE used <> sb
UNION ALL SELECT run_id, 'over_cap' FROM h WHERE sb > 15000 OR st > 160""")
def packed_context_audit(spark, d):
    b = fx.numbered_attempts(spark, d).select("run_id", F.lit("artifact").alias("kind"), (F.col("task_id") * 100 + F.col("attempt")).alias("ref"),
                                              F.col("context").alias("bytes"), "tokens")
    m = b.where("not (run_id % 89 = 0 and ref = 201)").withColumn(
        "bytes", F.col("bytes") + F.when((F.col("run_id") % 83 == 0) & (F.col("ref") == 101), 1).otherwise(0))
    h = b.groupBy("run_id").agg((F.sum("bytes") + F.when(F.col("run_id") % 79 == 0, 1).otherwise(0)).alias("used_bytes"), F.sum("tokens").alias("used_tokens"))
    h = h.select("*", F.lit(15000).alias("byte_cap"), F.lit(160).alias("token_cap"))
    return evd.packed_context_breaches(m, b, h, "run_id")


@query("citation_coverage", w(ATTEMPTS) + """
, r AS (SELECT DISTINCT run_id, provider AS ref FROM attempts),
c AS (SELECT run_id, CASE WHEN provider % 23 = 0 THEN provider + 10000000 ELSE provider END AS ref, count(*) AS n FROM attempts WHERE task_id <> 7 GROUP BY ALL),
x AS (SELECT coalesce(r.run_id, c.run_id) AS run_id, coalesce(r.ref, c.ref) AS ref, r.ref IS NOT NULL AS req, n FROM r FULL JOIN c ON r.run_id = c.run_id AND r.ref = c.ref)
SELECT run_id, ref, 'missing_citation' AS code FROM x WHERE req AND n IS NULL
UNION ALL SELECT run_id, ref, 'unknown_citation' FROM x WHERE n IS NOT NULL AND ref NOT IN (SELECT s_suppkey FROM supplier)
UNION ALL SELECT run_id, ref, 'duplicate_citation' FROM x WHERE n > 1""")
def citation_coverage(spark, d):
    a = fx.attempts(spark, d)
    p = F.col("provider")
    cited = a.where("task_id <> 7").select("run_id", F.when(p % 23 == 0, p + 10000000).otherwise(p).alias("ref"))
    return evd.claim_citation_gaps(a.select("run_id", p.alias("ref")), cited, fx.providers(spark, d).select(p.alias("ref")), ["run_id"], "ref")


@query("port_breaches", w(DEPS) + """
, i AS (SELECT run_id, task_id, 'in-' || dep_id AS port, CASE WHEN run_id % 89 = 0 THEN dep_id + 10 WHEN run_id % 97 = 0 THEN task_id ELSE dep_id END AS src,
   CASE WHEN run_id % 83 = 0 THEN 'gone' ELSE 'out' END AS src_port, CASE WHEN run_id % 79 = 0 THEN 's9' ELSE 's' || (dep_id % 2) END AS type FROM deps)
SELECT * FROM (SELECT i.run_id, i.task_id, i.port, CASE WHEN p.task_id IS NULL THEN 'missing_producer' WHEN d.task_id IS NULL THEN 'not_a_direct_dependency'
  WHEN src_port <> 'out' THEN 'missing_producer_port' WHEN type <> 's' || (src % 2) THEN 'incompatible_type' END AS code
FROM i LEFT JOIN present p ON p.run_id = i.run_id AND p.task_id = i.src LEFT JOIN deps d ON d.run_id = i.run_id AND d.task_id = i.task_id AND d.dep_id = i.src) WHERE code IS NOT NULL""")
def port_breaches(spark, d):
    deps = fx.deps(spark, d)
    r, dep = F.col("run_id"), F.col("dep_id")
    i = deps.select(
        "run_id", "task_id", F.concat(F.lit("in-"), dep.cast("string")).alias("port"),
        F.when(r % 89 == 0, dep + 10).when(r % 97 == 0, F.col("task_id")).otherwise(dep).alias("source_task"),
        F.when(r % 83 == 0, "gone").otherwise("out").alias("source_port"),
        F.when(r % 79 == 0, "s9").otherwise(F.concat(F.lit("s"), (dep % 2).cast("string"))).alias("type"),
    )
    tasks = fx.attempts(spark, d).select("run_id", "task_id").distinct()
    outs = tasks.select("run_id", "task_id", F.lit("out").alias("port"), F.concat(F.lit("s"), (F.col("task_id") % 2).cast("string")).alias("type"))
    return pol.port_breaches(i, outs, tasks, deps)


@query("profile_match", w(NUMBERED) + """
, g AS (SELECT run_id, task_id, profile, provider, count(*) AS n, min(cost) AS c FROM numbered WHERE attempt <= 2 GROUP BY ALL)
SELECT a.run_id, a.task_id, a.attempt, CASE WHEN coalesce(n, 0) <> 1 THEN 'backend' ELSE 'profile' END AS code FROM numbered a
LEFT JOIN g USING (run_id, task_id, profile, provider) WHERE coalesce(n, 0) <> 1 OR c <> a.cost + CASE WHEN a.run_id % 79 = 0 THEN 1 ELSE 0 END""")
def profile_match(spark, d):
    n = fx.numbered_attempts(spark, d)
    entries = n.withColumn("cost", F.col("cost") + F.when(F.col("run_id") % 79 == 0, 1).otherwise(0))
    return pol.profile_match(entries, n.where("attempt <= 2"), ["run_id", "task_id", "profile", "provider"],
                             ["run_id", "task_id", "attempt"], ["cost"])


@query("task_contract_checks", w(TASKS) + """
SELECT run_id, task_id, 'negative_value' AS code FROM tasks WHERE run_id % 101 = 0
UNION ALL SELECT run_id, task_id, 'nonpositive_deadline' FROM tasks WHERE run_id % 103 = 0
UNION ALL SELECT run_id, task_id, 'quality_out_of_range' FROM tasks WHERE run_id % 107 = 0
UNION ALL SELECT run_id, task_id, 'no_profile_at_quality_floor' FROM tasks WHERE run_id % 107 = 0 OR (tokens % 20 < 5)
UNION ALL SELECT run_id, task_id, 'repeated_profile' FROM tasks WHERE run_id % 109 = 0
UNION ALL SELECT run_id, task_id, 'self_dependency' FROM tasks WHERE run_id % 113 = 0
UNION ALL SELECT run_id, task_id, 'effect_without_resource' FROM tasks WHERE task_id >= 3 AND run_id % 17 = 0
UNION ALL SELECT run_id, task_id, 'write_without_key' FROM tasks WHERE task_id IN (4, 6) AND run_id % 19 = 0
UNION ALL SELECT run_id, task_id, 'reversible_without_compensation' FROM tasks WHERE task_id = 5 AND run_id % 23 = 0
UNION ALL SELECT run_id, task_id, 'irreversible_without_approval' FROM tasks WHERE task_id = 6 AND run_id % 29 = 0""")
def task_contract_checks(spark, d):
    r, t = F.col("run_id"), F.col("task_id")
    q = ((F.col("tokens") % 20) + 80).cast("double") / 100
    profile = F.struct(F.lit("a").alias("name"), F.lit("p").alias("provider"), q.alias("quality"))
    tasks = fx.tasks(spark, d).select(
        "run_id", "task_id", F.when(r % 113 == 0, F.array(t)).otherwise(F.array(t - 1)).alias("dependencies"),
        F.when(r % 101 == 0, -1).otherwise(1).alias("value"), F.when(r % 107 == 0, 1.5).otherwise(0.85).alias("min_quality"),
        F.when(r % 103 == 0, 0).otherwise(100).alias("deadline_ms"),
        F.when(r % 109 == 0, F.array(profile, profile)).otherwise(F.array(profile)).alias("profiles"),
        F.element_at(F.array(*[F.lit(x) for x in ("pure", "pure", "read", "idempotent_write", "reversible_write", "irreversible_write", "read")]), t.cast("int")).alias("effect_kind"),
        F.when(r % 17 != 0, "res").alias("resource"), F.when(r % 19 != 0, "key").alias("idempotency_key"),
        F.when(r % 23 != 0, "undo").alias("compensation"), (r % 29 != 0).alias("requires_approval"),
    )
    return pol.task_contract_checks(tasks, ["run_id", "task_id"])


@query("profile_contract_checks", """
SELECT p_partkey AS profile, 'bad_duration' AS code FROM part WHERE p_size < 5
UNION ALL SELECT p_partkey, 'negative_resource' FROM part WHERE p_partkey % 61 = 0
UNION ALL SELECT p_partkey, 'failure_out_of_range' FROM part WHERE p_size > 45
UNION ALL SELECT p_partkey, 'bad_snapshot_digest' FROM part WHERE p_partkey % 43 = 0
UNION ALL SELECT p_partkey, 'bad_cpu_time' FROM part WHERE p_partkey % 59 = 0""")
def profile_contract_checks(spark, d):
    i, s = F.col("p_partkey"), F.col("p_size")
    p = fx.table(spark, d, "part").select(
        i.alias("profile"), F.col("p_name").alias("name"), F.col("p_brand").alias("provider"), F.lit(5).alias("p50"), s.alias("p95"),
        F.lit(1).alias("tokens"), F.when(i % 61 == 0, -1).otherwise(1).alias("cost"), F.lit(1).alias("context"), F.lit(0.9).alias("quality"),
        (s / 45).alias("failure"), F.when(i % 43 == 0, "XYZ").otherwise(F.sha2(F.col("p_name"), 256)).alias("snapshot_digest"),
        F.when(i % 59 == 0, -1).otherwise(10).cast("long").alias("cpu_time"),
    )
    return pol.profile_contract_checks(p, ["profile"], ["cpu_time"])


@query("envelope_checks", """
SELECT o_orderkey AS run_id, 'negative_budget' AS code FROM orders WHERE o_totalprice < 2000
UNION ALL SELECT o_orderkey, 'nonpositive_parallelism' FROM orders WHERE o_orderkey % 53 = 0
UNION ALL SELECT o_orderkey, 'bad_provider_limit' FROM orders WHERE o_orderkey % 59 = 0
UNION ALL SELECT o_orderkey, 'repeated_provider_limit' FROM orders WHERE o_orderkey % 61 = 0""")
def envelope_checks(spark, d):
    r = F.col("run_id")
    lim = lambda p, n: F.struct(p.alias("provider"), n.alias("limit"))
    e = fx.runs(spark, d).select(
        "run_id", F.lit(1000).alias("deadline_ms"), F.lit(1).alias("max_tokens"), (F.col("cost_cap") - 200000).alias("max_cost"),
        F.lit(1).alias("max_context"), (r % 53).alias("max_parallelism"), F.lit(0.9).alias("success_floor"),
        F.array(lim(F.lit("a"), r % 59), lim(F.when(r % 61 == 0, "a").otherwise("b"), F.lit(2))).alias("provider_limits"),
    )
    return pol.envelope_checks(e, ["run_id"])


@query("port_contract_checks", w(DEPS) + """
, p AS (SELECT run_id, task_id, 'in-' || dep_id AS port, dep_id FROM deps)
SELECT run_id, task_id, 'in' AS direction, port, 'untyped_port' AS code FROM p WHERE run_id % 61 = 0
UNION ALL SELECT run_id, task_id, 'in', port, 'unbound_input' FROM p WHERE run_id % 67 = 0
UNION ALL SELECT run_id, task_id, 'in', port, 'repeated_port' FROM p WHERE run_id % 71 = 0""")
def port_contract_checks(spark, d):
    r = F.col("run_id")
    p = fx.deps(spark, d).select("run_id", "task_id", F.lit("in").alias("direction"), F.concat(F.lit("in-"), F.col("dep_id").cast("string")).alias("port"),
                                 F.col("dep_id").alias("source_task"), F.when(r % 67 != 0, "out").alias("source_port"), F.when(r % 61 != 0, "s1").alias("type"))
    again = p.where("run_id % 71 = 0").withColumns({"type": F.lit("s1"), "source_port": F.lit("out")})
    return pol.port_contract_checks(p.unionByName(again), ["run_id", "task_id"])


@query("requirement_checks", """
SELECT o_orderkey AS run_id, 'unknown_cancellation' AS code FROM orders WHERE o_orderkey % 41 = 0
UNION ALL SELECT o_orderkey, 'missing_flag' FROM orders WHERE o_orderkey % 43 = 0
UNION ALL SELECT o_orderkey, 'negative_hidden_retries' FROM orders WHERE o_orderkey % 47 = 0""")
def requirement_checks(spark, d):
    r = F.col("run_id")
    n = fx.runs(spark, d).select("run_id", F.when(r % 41 == 0, "maybe").otherwise("hard").alias("cancellation"), F.lit("receipt").alias("checkpoint"), F.lit("none").alias("usage"),
                                 F.when(r % 43 != 0, True).alias("streaming"), F.lit(False).alias("fencing"), F.when(r % 47 == 0, -1).otherwise(2).alias("hidden_retries"))
    return pol.requirement_checks(n, ["run_id"])


@query("capability_breaches", w(ATTEMPTS) + """
, t AS (SELECT DISTINCT run_id, task_id, provider FROM attempts),
x AS (SELECT t.*, s_suppkey, s_suppkey % 3 AS canc, s_suppkey % 4 = 0 AS stream, s_suppkey % 5 AS retries FROM t
      LEFT JOIN supplier ON s_suppkey = provider AND s_suppkey % 31 <> 0)
SELECT run_id, task_id, provider, 'no_manifest' AS code FROM x WHERE s_suppkey IS NULL
UNION ALL SELECT run_id, task_id, provider, 'cancellation_insufficient' FROM x WHERE canc < task_id % 3
UNION ALL SELECT run_id, task_id, provider, 'streaming_unsupported' FROM x WHERE s_suppkey IS NOT NULL AND task_id = 7 AND NOT stream
UNION ALL SELECT run_id, task_id, provider, 'hidden_retries_exceeded' FROM x WHERE retries > 3
UNION ALL SELECT run_id, task_id, provider, 'effect_undeclared' FROM x WHERE s_suppkey IS NOT NULL AND task_id = 6 AND s_suppkey % 2 = 0""")
def capability_breaches(spark, d):
    t = F.col("task_id")
    levels = lambda ranks, i: F.element_at(F.array(*[F.lit(k) for k in ranks]), (i + 1).cast("int"))
    needs = fx.attempts(spark, d).select("run_id", "task_id", "provider").distinct().select(
        "*", levels(pol.CANCELLATION, t % 3).alias("cancellation"), F.lit("none").alias("checkpoint"), (t == 7).alias("streaming"),
        F.lit("none").alias("usage"), F.lit(False).alias("fencing"), F.lit(3).alias("hidden_retries"),
        F.when(t == 6, "irreversible_write").otherwise("read").alias("effect_kind"), F.col("provider").alias("adapter"),
    )
    s = F.col("provider")
    adapters = fx.providers(spark, d).where("provider % 31 <> 0").select(
        s.alias("adapter"), "provider", levels(pol.CANCELLATION, s % 3).alias("cancellation"), F.lit("receipt").alias("checkpoint"),
        (s % 4 == 0).alias("streaming"), F.lit("estimated").alias("usage"), F.lit(True).alias("fencing"), (s % 5).alias("hidden_retries"),
        F.when(s % 2 == 0, F.array(F.lit("read"))).otherwise(F.array(F.lit("read"), F.lit("irreversible_write"))).alias("effects"),
    )
    return pol.capability_breaches(needs, adapters, ["adapter"], ["run_id", "task_id", "provider"])


@query("grant_breaches", """
SELECT c_custkey AS grant_id, 'issuer_not_allowed' AS code FROM customer WHERE c_mktsegment IN ('MACHINERY')
UNION ALL SELECT c_custkey, 'repeated_capability' FROM customer WHERE c_custkey % 4 = 3
UNION ALL SELECT c_custkey, 'capability_outside_policy' FROM customer WHERE c_custkey % 4 = 2
UNION ALL SELECT c_custkey, 'derived_from_evidence' FROM customer WHERE c_custkey % 31 = 0
UNION ALL SELECT c_custkey, 'not_valid_at_time' FROM customer WHERE NOT (c_custkey <= 700 AND 700 <= c_custkey + 400)""")
def grant_breaches(spark, d):
    g = _grants(spark, d)
    issuers = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD"]
    return pol.grant_breaches(g, issuers, ["cap-0", "cap-1"], F.lit(700))


def _grants(spark, d):
    i = F.col("c_custkey")
    caps = (
        F.when(i % 4 == 3, F.array(F.lit("cap-1"), F.lit("cap-1"))).when(i % 4 == 2, F.array(F.lit("cap-0"), F.lit("cap-2")))
        .otherwise(F.array(F.concat(F.lit("cap-"), (i % 4).cast("string"))))
    )
    return fx.table(spark, d, "customer").select(
        i.alias("grant_id"), F.col("c_mktsegment").alias("issuer"), caps.alias("capabilities"), i.alias("issued"), (i + 400).alias("expires"),
        F.when(i % 31 == 0, F.array(i)).otherwise(F.array().cast("array<bigint>")).alias("derived_from"),
    )


@query("action_breaches", """
WITH a AS (SELECT o_orderkey AS action_id, CASE WHEN o_orderkey % 37 = 0 THEN 'talk' ELSE 'tool' END AS kind, o_orderkey % 3 AS cap,
   CASE WHEN o_orderkey % 41 = 0 THEN 10000000 + o_orderkey % 50 ELSE o_custkey END AS grant_id, o_orderkey % 1100 AS ref FROM orders)
SELECT action_id, 'unknown_kind' AS code FROM a WHERE kind = 'talk'
UNION ALL SELECT action_id, 'capability_outside_policy' FROM a WHERE cap = 2
UNION ALL SELECT action_id, 'evidence_used_as_authority' FROM a WHERE grant_id IN (SELECT 10000000 + doc_id FROM documents)
UNION ALL SELECT action_id, 'no_grant' FROM a WHERE grant_id NOT IN (SELECT c_custkey FROM customer)
UNION ALL SELECT action_id, 'capability_not_granted' FROM a WHERE grant_id IN (SELECT c_custkey FROM customer)
  AND NOT CASE grant_id % 4 WHEN 3 THEN cap = 1 WHEN 2 THEN cap IN (0, 2) ELSE cap = grant_id % 4 END
UNION ALL SELECT action_id, 'unknown_evidence' FROM a WHERE ref NOT IN (SELECT doc_id FROM documents)""")
def action_breaches(spark, d):
    i = F.col("o_orderkey")
    a = fx.table(spark, d, "orders").select(
        i.alias("action_id"), F.when(i % 37 == 0, "talk").otherwise("tool").alias("kind"), F.concat(F.lit("cap-"), (i % 3).cast("string")).alias("capability"),
        F.when(i % 41 == 0, 10000000 + i % 50).otherwise(F.col("o_custkey")).alias("grant_id"), F.array(i % 1100 + 10000000).alias("evidence"),
    )
    refs = fx.table(spark, d, "documents").select((F.col("doc_id") + 10000000).alias("ref"))
    return pol.action_breaches(a, _grants(spark, d), refs, ["cap-0", "cap-1"])


@query("page_action_breaches", w(EVENTS) + """
, i AS (SELECT event_id AS intent_id, CASE kind WHEN 'signup' THEN 'submit' WHEN 'view' THEN 'inspect' WHEN 'error' THEN 'teleport' ELSE 'click' END AS action,
   kind <> 'view' AS mut, CASE WHEN k % 11 = 0 THEN 'committed' ELSE 'proposed' END AS state,
   CASE WHEN k % 5 = 0 THEN 'read' WHEN k % 5 = 1 THEN 'idempotent_write' WHEN k % 5 = 2 THEN 'irreversible_write' ELSE 'reversible_write' END AS eff,
   k % 7 <> 0 AS has_key, k % 13 <> 0 AS approval, k * 3 AS obs FROM ev)
SELECT intent_id, 'action_outside_vocabulary' AS code FROM i WHERE action = 'teleport'
UNION ALL SELECT intent_id, 'not_a_proposal' FROM i WHERE state <> 'proposed'
UNION ALL SELECT intent_id, 'mutation_flag_conflict' FROM i WHERE mut AND action = 'teleport'
UNION ALL SELECT intent_id, 'write_not_classified' FROM i WHERE mut AND eff = 'read'
UNION ALL SELECT intent_id, 'write_without_key' FROM i WHERE mut AND NOT has_key
UNION ALL SELECT intent_id, 'irreversible_without_approval' FROM i WHERE mut AND eff = 'irreversible_write' AND NOT approval
UNION ALL SELECT intent_id, 'read_inconsistent' FROM i WHERE NOT mut AND (action <> 'inspect' OR eff <> 'read')
UNION ALL SELECT intent_id, 'unknown_observation' FROM i WHERE obs NOT IN (SELECT page_id FROM pages)
UNION ALL SELECT intent_id, 'observation_used_as_authority' FROM i WHERE intent_id % 19 = 0 AND CAST(obs AS VARCHAR) IN (SELECT CAST(page_id AS VARCHAR) FROM pages)""")
def page_action_breaches(spark, d):
    kind, k = F.col("kind"), F.col("k")
    i = fx.events(spark, d).select(
        F.col("event_id").alias("intent_id"),
        F.when(kind == "signup", "submit").when(kind == "view", "inspect").when(kind == "error", "teleport").otherwise("click").alias("action"),
        (kind != "view").alias("mutates"), F.when(k % 11 == 0, "committed").otherwise("proposed").alias("state"), F.lit(False).alias("executed"),
        F.when(k % 5 == 0, "read").when(k % 5 == 1, "idempotent_write").when(k % 5 == 2, "irreversible_write").otherwise("reversible_write").alias("effect_kind"),
        F.when(k % 7 != 0, "key").alias("idempotency_key"), F.lit("undo").alias("compensation"), (k % 13 != 0).alias("requires_approval"),
        F.when(F.col("event_id") % 19 == 0, (k * 3).cast("string")).otherwise("grant").alias("grant_id"), F.array((k * 3).cast("string")).alias("observations"),
    )
    obs = fx.table(spark, d, "pages").select(F.col("page_id").cast("string").alias("observation_id"))
    return pol.page_action_breaches(i, obs)


@query("gate_breaches", w(ARTIFACTS) + """
, g AS (SELECT s_suppkey AS gate_id, s_suppkey % 11 = 0 AS wrong, s_suppkey % 2 = 0 AS pass, s_suppkey % 6 = 0 AS none, s_suppkey * 11 AS ref FROM supplier)
SELECT gate_id, 'commit_mismatch' AS code FROM g WHERE wrong
UNION ALL SELECT gate_id, 'pass_without_evidence' FROM g WHERE pass AND none
UNION ALL SELECT gate_id, 'missing_artifact' FROM g WHERE NOT none AND ref NOT IN (SELECT doc_id FROM artifacts)""")
def gate_breaches(spark, d):
    return pol.gate_breaches(_gates(spark, d), _refs(spark, d), "c0ffee")


def _gates(spark, d):
    s = F.col("provider")
    return fx.providers(spark, d).select(
        s.alias("gate_id"), F.when(s % 11 == 0, "beef").otherwise("c0ffee").alias("commit"), F.when(s % 2 == 0, "pass").otherwise("open").alias("status"),
        F.when(s % 6 == 0, F.array().cast("array<bigint>")).otherwise(F.array(s * 11)).alias("evidence"),
    )


def _refs(spark, d):
    return fx.artifacts(spark, d).select(F.col("doc_id").alias("ref"), F.when(F.col("doc_id") % 2 == 0, "genuine").otherwise("synthetic").alias("classification"))


@query("attestation_readiness", """
WITH a AS (SELECT source AS kind, doc_id AS ref, CASE WHEN doc_id % 2 = 0 THEN 'genuine' ELSE 'synthetic' END AS class, doc_id % 3 AS avail, doc_id AS observed FROM documents),
need AS (SELECT 'src0' AS kind, 2 AS gate UNION ALL SELECT 'src1', 7 UNION ALL SELECT 'src2', 13 UNION ALL SELECT 'src3', 6 UNION ALL SELECT 'nowhere', 1)
SELECT n.kind, coalesce(bool_or(class = 'genuine' AND avail IN (0, 1) AND 1000 - observed BETWEEN 0 AND 990 AND ref % 110 = gate * 11), false) AS ready
FROM need n LEFT JOIN a ON a.kind = n.kind AND n.gate % 6 <> 0 GROUP BY n.kind""")
def attestation_readiness(spark, d):
    i = F.col("doc_id")
    a = fx.table(spark, d, "documents").select(
        F.col("source").alias("kind"), i.alias("ref"), F.when(i % 2 == 0, "genuine").otherwise("synthetic").alias("classification"),
        F.element_at(F.array(F.lit("public"), F.lit("judges"), F.lit("private")), (i % 3 + 1).cast("int")).alias("availability"), i.alias("observed"),
    )
    gates = fx.providers(spark, d).select(F.col("provider").alias("gate_id"))
    ref = fx.table(spark, d, "documents").select(i.alias("ref"), F.expr("doc_id % 110 div 11").alias("g"), (i % 11).alias("m")).where("m = 0")
    gates = gates.join(ref, F.col("gate_id") == F.col("g")).where("gate_id % 6 <> 0").select("gate_id", "ref")
    rules = {k: {"gate": g, "availability": ["public", "judges"]} for k, g in
             (("src0", 2), ("src1", 7), ("src2", 13), ("src3", 6), ("nowhere", 1))}
    return pol.attestation_readiness(a, _refs(spark, d), gates, rules, ["genuine"], F.lit(1000), 990)


@query("completion_breaches", w(NUMBERED) + """
, c AS (SELECT run_id, task_id, max(cost) AS cost FROM numbered WHERE outcome = 'completed' GROUP BY ALL)
SELECT run_id, task_id, CASE WHEN task_id % 3 <> 0 THEN 'usage_violates_profile' WHEN task_id = 3 AND run_id % 7 = 0 THEN 'unsupported_kind' ELSE 'effect_violates_contract' END AS code FROM c
WHERE (task_id % 3 <> 0 AND run_id % 79 = 0) OR (task_id = 3 AND run_id % 7 = 0) OR (task_id % 3 = 0 AND (run_id % 73 = 0 OR run_id % 71 = 0))""")
def completion_breaches(spark, d):
    r, t = F.col("run_id"), F.col("task_id")
    base = fx.attempts(spark, d).where("outcome = 'completed'").groupBy("run_id", "task_id").agg(F.max("cost").alias("cost"))
    c = base.select(
        "run_id", "task_id", F.when(t % 3 == 0, "effect_intent").otherwise("fixture_output").alias("kind"), (~((t == 3) & (r % 7 == 0))).alias("writes"),
        F.col("cost").alias("reserved_cost"), (F.col("cost") + F.when(r % 79 == 0, 1).otherwise(0)).alias("actual_cost"),
        F.lit("res").alias("resource"), F.lit("k").alias("declared_key"),
    )
    e = base.where("task_id % 3 = 0 and run_id % 71 <> 0").withColumn("declared_key", F.when(r % 73 == 0, "x").otherwise("k")).select(
        "run_id", "task_id", F.lit("res").alias("resource"), scoped_key("run_id", "task_id", "declared_key").alias("idempotency_key"))
    return pol.completion_breaches(c, base, e, ["run_id", "task_id"], ["cost"])


@query("pending_effects", w(NUMBERED) + """
, c AS (SELECT run_id, task_id, max(attempt) AS n FROM numbered WHERE outcome = 'completed' AND task_id % 3 = 0 GROUP BY ALL)
SELECT run_id, task_id FROM c WHERE (run_id + task_id) % 4 IN (0, 1)""")
def pending_effects(spark, d):
    c = fx.attempts(spark, d).where("outcome = 'completed'").groupBy("run_id", "task_id").agg(F.lit(True).alias("x")).select(
        "run_id", "task_id", (F.col("task_id") % 3 == 0).alias("writes"))
    state = F.element_at(F.array(*[F.lit(s) for s in ("prepared", "ambiguous", "committed", "compensated")]), ((F.col("run_id") + F.col("task_id")) % 4 + 1).cast("int"))
    return pol.pending_effects(c, c.select("run_id", "task_id", state.alias("state")), ["run_id", "task_id"]).select("run_id", "task_id")


FACILITIES = """f AS (SELECT s_suppkey AS shelter_id, CASE WHEN s_suppkey % 7 = 0 THEN 'closed' ELSE 'open' END AS status, 15000 + s_suppkey * 10 AS capacity,
  100 AS occupied, 1200 AS acap FROM supplier WHERE s_suppkey % 29 <> 0)"""


def _facilities(spark, d):
    s = F.col("provider")
    return fx.providers(spark, d).where("provider % 29 <> 0").select(
        s.alias("shelter_id"), F.when(s % 7 == 0, "closed").otherwise("open").alias("status"), (15000 + s * 10).alias("capacity"),
        F.lit(100).alias("occupied"), F.lit(1200).alias("accessible_capacity"), F.lit(0).alias("accessible_occupied"))


def _allocations(spark, d):
    return fx.attempts(spark, d).groupBy(F.col("provider").alias("shelter_id")).agg(
        F.sum("tokens").alias("people"), F.sum(F.when(F.col("optional") & (F.col("task_id") == 7), F.col("tokens")).otherwise(0)).alias("accessible"))


@query("capacity_breaches", w(ATTEMPTS, FACILITIES) + """
, p AS (SELECT provider AS shelter_id, sum(tokens) AS people, sum(CASE WHEN optional AND task_id = 7 THEN tokens ELSE 0 END) AS acc FROM attempts GROUP BY 1),
x AS (SELECT p.*, status, greatest(0, capacity - occupied) AS free, acap FROM p LEFT JOIN f USING (shelter_id))
SELECT shelter_id, 'unknown_facility' AS code FROM x WHERE status IS NULL
UNION ALL SELECT shelter_id, 'closed_facility' FROM x WHERE status = 'closed'
UNION ALL SELECT shelter_id, 'capacity_exceeded' FROM x WHERE status IS NOT NULL AND people > free
UNION ALL SELECT shelter_id, 'accessible_capacity_exceeded' FROM x WHERE status IS NOT NULL AND acc > acap""")
def capacity_breaches(spark, d):
    return pol.capacity_breaches(_allocations(spark, d), _facilities(spark, d), "shelter_id")


def _routes(spark, d):
    p, s = F.col("p_partkey"), F.col("p_size").cast("long")
    return fx.table(spark, d, "part").where("p_partkey % 31 <> 0").select(
        p.alias("route_id"), F.when(p % 11 == 0, "blocked").otherwise("open").alias("status"), (p % 100).alias("destination"),
        (s + 5).alias("capacity"), F.array(s, s + 1, s + 2).alias("segments"))


@query("route_breaches", w(ATTEMPTS) + """
, x AS (SELECT DISTINCT profile AS route_id, provider AS shelter_id, tokens, p_partkey, p_size FROM attempts LEFT JOIN part ON p_partkey = profile AND p_partkey % 31 <> 0)
SELECT DISTINCT route_id, shelter_id, 'unknown_route' AS code FROM x WHERE p_partkey IS NULL
UNION ALL SELECT DISTINCT route_id, shelter_id, 'route_not_open' FROM x WHERE p_partkey % 11 = 0
UNION ALL SELECT DISTINCT route_id, shelter_id, 'destination_mismatch' FROM x WHERE p_partkey % 100 <> shelter_id
UNION ALL SELECT DISTINCT route_id, shelter_id, 'route_capacity_exceeded' FROM x WHERE tokens > p_size + 5""")
def route_breaches(spark, d):
    a = fx.attempts(spark, d).select(F.col("profile").alias("route_id"), F.col("provider").alias("shelter_id"), F.col("tokens").alias("passengers"))
    return pol.route_breaches(a, _routes(spark, d))


@query("demand_conservation", w(ATTEMPTS) + """
, a AS (SELECT provider AS shelter_id, sum(tokens) AS allocated FROM attempts GROUP BY 1),
b AS (SELECT provider AS shelter_id, sum(tokens) AS routed FROM attempts WHERE profile % 500 <> 0 GROUP BY 1)
SELECT shelter_id, CAST(allocated AS BIGINT) AS allocated, CAST(coalesce(routed, 0) AS BIGINT) AS routed FROM a LEFT JOIN b USING (shelter_id) WHERE allocated <> coalesce(routed, 0)""")
def demand_conservation(spark, d):
    r = fx.attempts(spark, d).where("profile % 500 <> 0").select(F.col("provider").alias("shelter_id"), F.col("tokens").alias("passengers"))
    return pol.conservation(_allocations(spark, d), r, "shelter_id", "people", "passengers")


@query("closed_routes", """
WITH c AS (SELECT DISTINCT s_suppkey % 40 AS seg FROM supplier WHERE s_suppkey % 3 = 0),
s AS (SELECT DISTINCT p_partkey AS route_id, p_size + unnest([0, 1, 2]) AS seg FROM part WHERE p_partkey % 31 <> 0)
SELECT route_id, count(*) AS closed_segments FROM s WHERE seg IN (SELECT seg FROM c) GROUP BY route_id""")
def closed_routes(spark, d):
    c = fx.providers(spark, d).where("provider % 3 = 0").select((F.col("provider") % 40).alias("segment"))
    return pol.closed_routes(_routes(spark, d), c)


@query("priority_breaches", """
WITH u AS (SELECT n_regionkey AS region, s_suppkey AS item, CAST(floor(s_acctbal) AS BIGINT) AS cap FROM supplier JOIN nation ON n_nationkey = s_nationkey),
w AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY cap, item) AS want FROM u),
d AS (SELECT *, CASE WHEN item % 23 = 0 THEN want + 2 ELSE want END AS rank FROM w),
p AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY rank, item) AS pos FROM d)
SELECT CAST(region AS BIGINT) AS region, item, 'rank_not_consecutive' AS code FROM p WHERE rank <> pos
UNION ALL SELECT CAST(region AS BIGINT), item, 'rank_out_of_order' FROM p WHERE pos <> want""")
def priority_breaches(spark, d):
    from tallyline.operators.scan import rcount, running

    n = fx.table(spark, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_regionkey").cast("long").alias("region"))
    u = fx.table(spark, d, "supplier").join(n, "s_nationkey").select("region", F.col("s_suppkey").alias("item"), F.floor("s_acctbal").cast("long").alias("cap"))
    w_ = running(u, ["region"], "cap", {"rank": rcount()}, tie=["item"])
    declared = w_.withColumn("rank", F.when(F.col("item") % 23 == 0, F.col("rank") + 2).otherwise(F.col("rank")))
    return pol.priority_breaches(declared, ["cap", "item"], "region", "item", "rank")


@query("snapshot_checks", """
SELECT s_suppkey AS snapshot, 'floating_version' AS code FROM supplier WHERE s_suppkey % 7 = 0
UNION ALL SELECT s_suppkey, 'currency' FROM supplier WHERE s_suppkey % 11 = 0
UNION ALL SELECT s_suppkey, 'negative_price' FROM supplier WHERE s_acctbal < 0
UNION ALL SELECT s_suppkey, 'observed_without_samples' FROM supplier WHERE s_suppkey % 2 = 0 AND s_suppkey % 13 = 0
UNION ALL SELECT s_suppkey, 'estimated_with_samples' FROM supplier WHERE s_suppkey % 2 = 1 AND s_suppkey % 13 <> 0
UNION ALL SELECT s_suppkey, 'p95_below_p50' FROM supplier WHERE s_nationkey < 4
UNION ALL SELECT s_suppkey, 'source_stale' FROM supplier WHERE s_suppkey % 5 = 0 AND s_suppkey > 60
UNION ALL SELECT s_suppkey, 'window_above_31_days' FROM supplier WHERE s_suppkey > 31
UNION ALL SELECT s_suppkey, 'placement_region' FROM supplier WHERE s_suppkey % 17 = 0
UNION ALL SELECT s_suppkey, 'secret_like_key' FROM supplier WHERE s_suppkey % 19 = 0""")
def snapshot_checks(spark, d):
    i = F.col("s_suppkey")
    st = lambda **kw: F.struct(*[v.alias(k) for k, v in kw.items()])
    lit = F.lit
    s = fx.table(spark, d, "supplier").select(
        i.alias("snapshot"), lit(1_000_000).cast("long").alias("snapshot_at"), (lit(1_000_000) + i * 86400).alias("valid_until"), lit(3000).alias("max_age_s"),
        st(provider=F.col("s_name"), version=F.when(i % 7 == 0, "Latest").otherwise("1.2")).alias("identity"),
        st(currency=F.when(i % 11 == 0, "EUR").otherwise("USD"), input_price=F.floor("s_acctbal"), output_price=lit(1)).alias("pricing"),
        st(rpm=lit(1), tpm=lit(1), concurrency=lit(1), window_ms=lit(1)).alias("quota"),
        st(provenance=F.when(i % 2 == 0, "observed").otherwise("estimated"), sample_count=F.when(i % 13 == 0, 0).otherwise(9), latency_p50=lit(4),
           latency_p95=F.col("s_nationkey"), quality_ppm=lit(900_000), sampled_at=lit(1_000_000) - F.when(i % 5 == 0, i * 50).otherwise(0)).alias("metrics"),
        st(region=lit("r"), domain_region=F.when(i % 17 == 0, "q").otherwise("r"), domain_provider=F.col("s_name")).alias("placement"),
        F.array(lit("rpm"), F.when(i % 19 == 0, "API_KEY").otherwise("tpm")).alias("keys"),
    )
    return pol.snapshot_checks(s, ["snapshot"])


@query("validate_outputs", """
SELECT p_partkey AS profile, 'output_validation_failed' AS code FROM part WHERE p_size % 7 = 3 OR p_partkey % 53 = 0""")
def validate_outputs_query(spark, d):
    """A caller's vectorised validator; a NULL output gives no verdict and is refused."""
    @F.pandas_udf("boolean")
    def accepts(size: pd.Series) -> pd.Series:
        return size % 7 != 3

    out = F.when(F.col("p_partkey") % 53 != 0, F.col("p_size"))
    p = fx.table(spark, d, "part").select(F.col("p_partkey").alias("profile"), out.alias("size"))
    return validate_outputs(p, F.col("size").isNotNull() & accepts("size"), ["profile"])
