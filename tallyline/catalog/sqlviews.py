"""DuckDB statements of the same views, written against the raw tables."""

RUNS = """runs AS (
  SELECT o_orderkey AS run_id, o_custkey AS group_id, o_orderpriority AS policy, o_orderstatus AS state,
         CAST(round(o_totalprice * 100) AS BIGINT) AS cost_cap, epoch_ms(o_orderdate) AS started_ms
  FROM orders)"""

ATTEMPTS = """attempts AS (
  SELECT l_orderkey AS run_id, CAST(l_linenumber AS BIGINT) AS task_id, l_suppkey AS provider, l_partkey AS profile,
         epoch_ms(l_shipdate) AS start_ms,
         epoch_ms(l_shipdate) + CAST(l_quantity AS BIGINT) * 86400000 AS end_ms,
         CAST(l_quantity AS BIGINT) AS tokens, CAST(round(l_extendedprice * 100) AS BIGINT) AS cost,
         CAST(l_quantity AS BIGINT) * 100 AS context,
         CASE l_returnflag WHEN 'N' THEN 'completed' WHEN 'R' THEN 'failed' ELSE 'cancelled' END AS outcome,
         l_linestatus = 'O' AS optional, 1 - l_discount AS success_probability,
         CAST(round(l_tax * 100) AS BIGINT) AS tax_cents
  FROM lineitem)"""

NUMBERED = ATTEMPTS + """, numbered AS (
  SELECT *, row_number() OVER (PARTITION BY run_id, task_id ORDER BY start_ms, profile, provider, tokens, cost,
         success_probability, tax_cents, outcome, optional) AS attempt FROM attempts)"""

TASKS = ATTEMPTS + """, tasks AS (
  SELECT run_id, task_id, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(cost) AS BIGINT) AS cost,
         CAST(sum(context) AS BIGINT) AS context, min(start_ms) AS start_ms, max(end_ms) AS end_ms,
         min(provider) AS provider, bool_and(optional) AS optional
  FROM attempts GROUP BY run_id, task_id)"""

DEPS = """present AS (SELECT DISTINCT l_orderkey AS run_id, CAST(l_linenumber AS BIGINT) AS task_id FROM lineitem),
deps AS (
  SELECT run_id, task_id, dep_id FROM (
    SELECT run_id, task_id, lag(task_id) OVER (PARTITION BY run_id ORDER BY task_id) AS dep_id FROM present)
  WHERE dep_id IS NOT NULL
  UNION
  SELECT a.run_id, a.task_id, b.task_id FROM present a JOIN present b
    ON a.run_id = b.run_id AND b.task_id = a.task_id // 2)"""

EVENTS = """ev AS (
  SELECT user_id AS run_id, event_id, epoch_us(ts) AS at_us, epoch_us(ts) // 1000 AS at_ms, event_type AS kind,
         CAST(ceil(value) AS BIGINT) AS units, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sequence
  FROM events)"""

PROFILES = """profiles AS (
  SELECT p_partkey AS profile, CAST(v AS BIGINT) AS variant, CAST(p_size % 20 + 80 + 5 * v AS BIGINT) AS quality_pct,
         CAST(p_size * (2 - v) AS BIGINT) AS p95,
         CAST(round(p_retailprice * 100) AS BIGINT) * (1 + v) AS cost,
         CAST(p_size * 10 + length(p_name) AS BIGINT) AS tokens, CAST(p_size * 100 AS BIGINT) AS context,
         p_brand AS provider
  FROM part, (SELECT unnest([0, 1]) AS v))"""

ARTIFACTS = """artifacts AS (
  SELECT sha256(text) AS artifact_id, doc_id, source AS producer, lang AS media, n_chars AS size,
         doc_id AS created, doc_id + n_chars % 400 AS fresh_until, text FROM documents)"""

CLAIMS = """claims AS (
  SELECT l.doc_id AS claim_id, CASE WHEN quality = 1 THEN 'supported' ELSE 'unverified' END AS status,
         l.doc_id AS evidence, CASE WHEN toxic = 1 THEN l.doc_id + 1 END AS contradicts, l.doc_id AS created
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"""

TRIALS = """trials AS (
  SELECT event_type AS scenario, user_id AS seed, event_id AS trial, value < 50 AS passed,
         CAST(ceil(value) AS BIGINT) AS duration,
         CASE WHEN event_type = 'error' THEN CAST(ceil(value) AS BIGINT) END AS recovery,
         CASE WHEN event_type = 'view' THEN CAST(ceil(value) AS BIGINT) * 2 END AS direct,
         CASE WHEN event_type <> 'error' THEN CAST(ceil(value) AS BIGINT) + event_id % 7 END AS overhead,
         CASE WHEN event_id % 5 = 0 THEN 1 ELSE 0 END AS calls, event_id % 3 AS effects, CASE WHEN event_id % 97 = 0 THEN 1 ELSE 0 END AS duplicates FROM events)"""

EXPERIMENT = """experiment AS (
  SELECT user_id AS seed, event_type AS fault, CAST(json_extract_string(props, '$.k') AS BIGINT) % 3 AS policy,
         sum(CAST(ceil(value) AS BIGINT)) < 170 AS success, max(CAST(ceil(value) AS BIGINT)) AS makespan,
         CAST(sum(CAST(ceil(value) AS BIGINT)) AS BIGINT) AS tokens,
         CAST(sum(CAST(ceil(value) AS BIGINT)) * 3 + any_value(user_id) % 11 AS BIGINT) AS cost, min(CAST(ceil(value) AS BIGINT)) * 100 AS context,
         CASE WHEN max(CAST(ceil(value) AS BIGINT)) > 90 THEN 'deadline' WHEN max(CAST(ceil(value) AS BIGINT)) > 70 THEN 'capacity' END AS reason
  FROM events GROUP BY ALL)"""


def w(*views: str) -> str:
    """WITH clause over the views, each view text once."""
    return "WITH " + ",\n".join(dict.fromkeys(views)) + "\n"
