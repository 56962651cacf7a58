"""Text, number, fact, URL and page checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyline.catalog import fixtures as fx
from tallyline.catalog.evidence import _grants
from tallyline.catalog.registry import ORACLES, query
from tallyline.catalog.sqlviews import w
from tallyline.functions.columns import canonical_base64, contrast_ratio, integer_multiset, normalize_space, utc_time
from tallyline.operators import text as tx
from tallyline.operators.scan import rlag, running


def _citations(spark, d):
    """Each document quotes one of its own lines; some cite a neighbour or nothing."""
    i = F.col("doc_id")
    lines = F.filter(F.transform(F.split("text", r"\R"), lambda x: normalize_space(x)), lambda x: x != "")
    t = fx.table(spark, d, "documents").select("doc_id", lines.alias("lines"))
    pick = F.try_element_at("lines", (i % F.greatest(F.size("lines"), F.lit(1)) + 1).cast("int"))
    quote = F.when(i % 59 == 0, "").when(i % 61 == 0, F.concat(F.lit("  "), pick, F.lit("\t"))).otherwise(pick)
    return t.select(i.alias("claim_id"), F.when(i % 83 == 0, i + 10000000).when(i % 89 == 0, i + 1).otherwise(i).alias("cited"), quote.alias("quote"))


CITATIONS = """WITH s AS (
  SELECT doc_id, list_filter([trim(regexp_replace(x, '\\s+', ' ', 'g')) FOR x IN regexp_split_to_array(text, '\\r\\n|\\n|\\r')], lambda x: x <> '') AS lines FROM documents),
c AS (SELECT doc_id AS claim_id, CASE WHEN doc_id % 83 = 0 THEN doc_id + 10000000 WHEN doc_id % 89 = 0 THEN doc_id + 1 ELSE doc_id END AS cited,
  CASE WHEN doc_id % 59 = 0 THEN '' ELSE lines[doc_id % greatest(len(lines), 1) + 1] END AS quote FROM s)
SELECT claim_id, CASE WHEN s.doc_id IS NULL THEN 'unknown_artifact' WHEN coalesce(quote, '') = '' THEN 'empty_quote'
  WHEN NOT list_contains(lines, quote) THEN 'quote_absent' ELSE 'supported' END AS code FROM c LEFT JOIN s ON s.doc_id = c.cited"""


@query("citation_support", CITATIONS)
def citation_support(spark, d):
    return tx.citation_support(_citations(spark, d), fx.table(spark, d, "documents").select("doc_id", "text"))


@query("controlled_citations", """
WITH c AS (SELECT p_partkey AS i FROM part)
SELECT i AS claim_id, CASE WHEN i % 83 = 0 THEN 'unknown_artifact' WHEN i % 71 = 0 THEN 'quote_absent' WHEN i % 67 = 0 THEN 'not_a_controlled_fact'
  WHEN i % 61 = 0 THEN 'claim_differs_from_fact' ELSE 'supported' END AS code FROM c""")
def controlled_citations(spark, d):
    """Parts as artifacts of controlled fact records; every claim quotes its record."""
    i = F.col("p_partkey")
    size = F.col("p_size").cast("string")
    key = F.concat(F.lit("part."), i.cast("string"))
    fact = F.concat(F.lit("FACT["), key, F.lit("|size]="), size, F.lit(" beds"))
    loose = F.concat(F.lit("part "), i.cast("string"), F.lit(" has "), size, F.lit(" beds"))
    p = fx.table(spark, d, "part")
    docs = p.select(i.alias("doc_id"), F.concat(F.col("p_name"), F.lit("\n  "), fact, F.lit(" \r\n"), loose).alias("text")).where("doc_id % 83 <> 0")
    claims = p.select(
        i.alias("claim_id"), i.alias("cited"), key.alias("subject"), F.lit("size").alias("predicate"),
        F.when(i % 61 == 0, F.lit("-1")).otherwise(size).alias("value"), F.lit("beds").alias("unit"),
        F.when(i % 71 == 0, F.concat(fact, F.lit("x"))).when(i % 67 == 0, loose).otherwise(F.concat(fact, F.lit("  "))).alias("quote"),
    )
    return tx.citation_support(claims, docs, controlled=True)


@query("fact_breaches", """
WITH c AS (SELECT o_orderkey AS i, o_orderkey % 7 AS u, CASE WHEN o_orderkey % 2 = 0 THEN 'en' ELSE 'es' END AS lang FROM orders)
SELECT i AS claim_id, 'value_not_canonical' AS code FROM c WHERE i % 47 = 0
UNION ALL SELECT i, 'language_outside_policy' FROM c WHERE i % 43 = 0
UNION ALL SELECT i, 'unit_outside_vocabulary' FROM c WHERE i % 43 <> 0 AND i % 41 = 0
UNION ALL SELECT i, 'not_one_number' FROM c WHERE i % 43 <> 0 AND i % 41 <> 0 AND i % 37 = 0
UNION ALL SELECT i, 'number_differs' FROM c WHERE i % 43 <> 0 AND i % 41 <> 0 AND i % 37 <> 0 AND (i % 31 = 0 OR i % 47 = 0)
UNION ALL SELECT i, 'phrase_missing' FROM c WHERE i % 43 <> 0 AND i % 41 <> 0 AND i % 47 <> 0 AND (i % 31 = 0 OR i % 29 = 0)""")
def fact_breaches(spark, d):
    i = F.col("o_orderkey")
    names = ["accessible_places", "beds", "minutes", "people", "percent", "routes", "shelters"]
    english = ["accessible places", "beds", "minutes", "people", "percent", "routes", "shelters"]
    spanish = ["plazas accesibles", "camas", "minutos", "personas", "por ciento", "rutas", "refugios"]
    at = lambda xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (i % 7 + 1).cast("int"))
    lang = F.when(i % 43 == 0, "fr").when(i % 2 == 0, "en").otherwise("es")
    value = F.concat((i % 500 + 1).cast("string"), F.lit(".5"))
    said = F.when(i % 31 == 0, F.concat(value, F.lit("1"))).otherwise(value)
    phrase = F.when(i % 2 == 0, at(english)).otherwise(at(spanish))
    text = F.concat(F.lit("There are  "), said, F.when(i % 29 == 0, " odd ").otherwise("  "), F.initcap(phrase), F.when(i % 37 == 0, " and 12").otherwise(" now"))
    c = fx.table(spark, d, "orders").select(
        i.alias("claim_id"), lang.alias("language"), F.when(i % 47 == 0, F.concat(F.lit("0"), value)).otherwise(value).alias("value"),
        F.when(i % 41 == 0, "furlongs").otherwise(at(names)).alias("unit"), text.alias("statement"),
    )
    return tx.fact_breaches(c)


@query("claim_pairs", """
WITH c AS (SELECT doc_id, CASE WHEN doc_id % 17 = 0 THEN 'fr' WHEN doc_id % 2 = 0 THEN 'en' ELSE 'es' END AS lang, quality FROM labels),
p AS (SELECT doc_id AS pair_id, doc_id AS l, doc_id + 1 AS r FROM labels WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id + 5000000, doc_id, doc_id + 1 FROM labels WHERE doc_id % 46 = 0),
x AS (SELECT p.*, a.lang AS al, a.quality AS aq, b.lang AS bl, b.quality AS bq FROM p LEFT JOIN c a ON a.doc_id = l LEFT JOIN c b ON b.doc_id = r),
u AS (SELECT id, count(*) AS n FROM (SELECT l AS id FROM x WHERE al IS NOT NULL AND bl IS NOT NULL UNION ALL SELECT r FROM x WHERE al IS NOT NULL AND bl IS NOT NULL) GROUP BY id)
SELECT pair_id AS subject, 'unknown_right' AS code FROM x WHERE bl IS NULL
UNION ALL SELECT pair_id, 'left_language' FROM x WHERE bl IS NOT NULL AND al <> 'en'
UNION ALL SELECT pair_id, 'right_language' FROM x WHERE bl IS NOT NULL AND bl <> 'es'
UNION ALL SELECT pair_id, 'facts_differ' FROM x WHERE bl IS NOT NULL AND aq <> bq
UNION ALL SELECT c.doc_id, CASE WHEN n IS NULL THEN 'not_paired' ELSE 'paired_repeatedly' END FROM c LEFT JOIN u ON u.id = c.doc_id WHERE lang <> 'fr' AND (n IS NULL OR n > 1)""")
def claim_pairs(spark, d):
    i = F.col("doc_id")
    t = fx.table(spark, d, "labels")
    claims = t.select(i.alias("claim_id"), F.when(i % 17 == 0, "fr").when(i % 2 == 0, "en").otherwise("es").alias("language"),
                      F.struct(F.col("quality")).alias("signature"))
    pairs = t.where("doc_id % 2 = 0").select(i.alias("pair_id"), i.alias("left_id"), (i + 1).alias("right_id")).unionByName(
        t.where("doc_id % 46 = 0").select((i + 5000000).alias("pair_id"), i.alias("left_id"), (i + 1).alias("right_id")))
    return tx.pair_breaches(pairs, claims, "en", "es")


@query("number_parity", """
WITH n AS (SELECT doc_id, source, list_sort([regexp_replace(x, '^0+([0-9])', '\\1') FOR x IN list_filter(regexp_split_to_array(text, '[^\\pL\\pN_-]+'), lambda x: regexp_full_match(x, '[0-9]+'))]) AS nums FROM documents),
p AS (SELECT *, lag(doc_id) OVER (PARTITION BY source ORDER BY doc_id) AS before_id, lag(nums) OVER (PARTITION BY source ORDER BY doc_id) AS before FROM n)
SELECT doc_id, before_id, nums = before AS parity, CAST(len(nums) AS BIGINT) AS numbers FROM p WHERE before_id IS NOT NULL""")
def number_parity(spark, d):
    t = fx.table(spark, d, "documents").select("doc_id", "source", integer_multiset(F.col("text")).alias("nums"))
    x = running(t, ["source"], "doc_id", {"before": rlag(F.struct("doc_id", "nums"))})
    return x.where("before is not null").select(
        "doc_id", F.col("before.doc_id").alias("before_id"), (F.col("nums") == F.col("before.nums")).alias("parity"), F.size("nums").cast("long").alias("numbers"))


@query("copy_number_parity", """
SELECT sha256(text) AS artifact_id, count(*) AS copies, true AS parity FROM documents GROUP BY 1 HAVING count(*) > 1""")
def copy_number_parity(spark, d):
    """Copies of one text: distinct number multisets per content, counted before they meet."""
    t = fx.artifacts(spark, d).select("artifact_id", F.sha2(F.to_json(integer_multiset(F.col("text"))), 256).alias("nums"))
    per = t.groupBy("artifact_id", "nums").agg(F.count("*").alias("n"))
    return per.groupBy("artifact_id").agg(F.sum("n").alias("copies"), (F.count("*") == 1).alias("parity")).where("copies > 1")


@query("url_policy", """
WITH h AS (SELECT DISTINCT regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host FROM pages WHERE page_id % 3 = 0),
p AS (SELECT page_id, CASE WHEN page_id % 41 = 0 THEN replace(url, '://', '://user@') WHEN page_id % 43 = 0 THEN regexp_replace(url, '(://[^/]*)', '\\1:8443')
   WHEN page_id % 47 = 0 THEN url || ' x' WHEN page_id % 37 = 0 THEN replace(url, 'http', '') ELSE url END AS u, url FROM pages)
SELECT page_id, CASE WHEN page_id % 41 <> 0 AND page_id % 43 <> 0 AND page_id % 47 = 0 THEN 'whitespace-or-control'
   WHEN page_id % 41 <> 0 AND page_id % 43 <> 0 AND page_id % 37 = 0 AND NOT starts_with(u, 's:') THEN 'not-absolute'
   WHEN NOT starts_with(u, 'https:') THEN 'scheme-not-allowed' WHEN contains(u, '@') THEN 'embedded-credentials'
   WHEN regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) NOT IN (SELECT host FROM h) THEN 'host-not-allowed' WHEN page_id % 43 = 0 THEN 'non-default-port' END AS problem
FROM p WHERE (page_id % 41 <> 0 AND page_id % 43 <> 0 AND (page_id % 47 = 0 OR page_id % 37 = 0)) OR NOT starts_with(u, 'https:') OR contains(u, '@')
   OR regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) NOT IN (SELECT host FROM h) OR page_id % 43 = 0""")
def url_policy(spark, d):
    p, i, u = fx.table(spark, d, "pages"), F.col("page_id"), F.col("url")
    rows = p.select("page_id", F.when(i % 41 == 0, F.replace(u, F.lit("://"), F.lit("://user@")))
                    .when(i % 43 == 0, F.regexp_replace(u, r"(://[^/]*)", "$1:8443")).when(i % 47 == 0, F.concat(u, F.lit(" x")))
                    .when(i % 37 == 0, F.replace(u, F.lit("http"), F.lit(""))).otherwise(u).alias("u"))
    hosts = p.where("page_id % 3 = 0").select(F.regexp_extract("url", r"^[a-z]+://([^/?#]*)", 1).alias("host"))
    return tx.url_policy(rows, ["page_id"], "u", ["https"], hosts)


PAGE_FACTS = """facts AS (
  SELECT page_id, regexp_extract(html, '(?is)<html\\b[^>]*\\blang="([^"]*)"', 1) AS language,
    trim(regexp_extract(html, '(?is)<title\\b[^>]*>(.*?)</title>', 1)) AS title,
    len(regexp_extract_all(html, '(?is)<main\\b|role="main"')) AS mains, len(regexp_extract_all(html, '(?is)<nav\\b')) AS navigations,
    len(regexp_extract_all(html, '(?is)<nav\\b[^>]*\\baria-label(?:ledby)?="[^"]+"')) AS labelled_navigations,
    len(regexp_extract_all(html, '(?is)<h1\\b')) AS headings, len(regexp_extract_all(html, '(?is)<img\\b[^>]*>')) AS images, CAST(0 AS BIGINT) AS images_without_alt
  FROM pages)"""


@query("page_facts", "WITH " + PAGE_FACTS + " SELECT * FROM facts")
def page_facts(spark, d):
    return tx.page_facts(fx.table(spark, d, "pages"), "page_id", "html")


@query("accessibility_breaches", "WITH " + PAGE_FACTS + """
SELECT page_id, 'language_malformed' AS code FROM facts WHERE NOT regexp_full_match(language, '[a-z]{2,3}(-[a-z0-9]{2,8})*')
UNION ALL SELECT page_id, 'title_empty' FROM facts WHERE title = '' UNION ALL SELECT page_id, 'main_landmark_count' FROM facts WHERE mains <> 1
UNION ALL SELECT page_id, 'navigation_unlabelled' FROM facts WHERE navigations > labelled_navigations
UNION ALL SELECT page_id, 'image_without_alt' FROM facts WHERE images_without_alt > 0""")
def accessibility_breaches(spark, d):
    return tx.accessibility_breaches(tx.page_facts(fx.table(spark, d, "pages"), "page_id", "html"), "page_id")


CHANNEL = "CASE WHEN {v} / 255.0 <= 0.04045 THEN {v} / 255.0 / 12.92 ELSE pow(({v} / 255.0 + 0.055) / 1.055, 2.4) END"


def _lum(prefix: str) -> str:
    parts = [f"{wt} * ({CHANNEL.format(v=f'{prefix}{c}')})" for wt, c in zip(("0.2126", "0.7152", "0.0722"), "rgb")]
    return " + ".join(parts)


@query("contrast_ratios", f"""
WITH h AS (SELECT page_id, sha256(url) AS s FROM pages),
c AS (SELECT page_id, CAST('0x' || substr(s, 1, 2) AS INT)::DOUBLE AS fr, CAST('0x' || substr(s, 3, 2) AS INT)::DOUBLE AS fg, CAST('0x' || substr(s, 5, 2) AS INT)::DOUBLE AS fb,
   CAST('0x' || substr(s, 7, 2) AS INT)::DOUBLE AS br, CAST('0x' || substr(s, 9, 2) AS INT)::DOUBLE AS bg, CAST('0x' || substr(s, 11, 2) AS INT)::DOUBLE AS bb FROM h),
l AS (SELECT page_id, {_lum('f')} AS a, {_lum('b')} AS b FROM c)
SELECT page_id, CASE WHEN page_id % 31 <> 0 THEN round((greatest(a, b) + 0.05) / (least(a, b) + 0.05), 6) END AS ratio,
  CASE WHEN page_id % 31 <> 0 THEN (greatest(a, b) + 0.05) / (least(a, b) + 0.05) >= CASE WHEN page_id % 2 = 0 THEN 3.0 ELSE 4.5 END ELSE false END AS passed FROM l""")
def contrast_ratios(spark, d):
    s, i = F.sha2("url", 256), F.col("page_id")
    fg = F.concat(F.lit("#"), F.when(i % 31 == 0, F.lit("zz")).otherwise(F.lit("")), F.substring(s, 1, 6))
    x = fx.table(spark, d, "pages").select("page_id", fg.alias("fg"), F.concat(F.lit("#"), F.substring(s, 7, 6)).alias("bg"))
    r = contrast_ratio(F.col("fg"), F.col("bg"))
    floor = F.when(i % 2 == 0, 3.0).otherwise(4.5)
    return x.select("page_id", F.round(r, 6).alias("ratio"), F.coalesce(r >= floor, F.lit(False)).alias("passed"))


@query("time_and_encoding_checks", """
SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN epoch_ms(date_trunc('second', ts)) // 1000 END AS at_s,
  CASE WHEN event_id % 5 <> 0 THEN 1711929600 - epoch_ms(date_trunc('second', ts)) // 1000 <= 31 * 86400 ELSE false END AS in_window,
  event_id % 7 <> 0 AS canonical FROM events""")
def time_and_encoding_checks(spark, d):
    i = F.col("event_id")
    text = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    text = F.when(i % 5 == 0, F.replace(text, F.lit("T"), F.lit(" "))).otherwise(text)
    code = F.base64(F.encode(F.col("event_type"), "utf-8"))
    code = F.when(i % 7 == 0, F.concat(code, F.lit("\n"))).otherwise(code)
    at = F.unix_seconds(utc_time(F.col("text")))
    return fx.table(spark, d, "events").select("event_id", text.alias("text"), code.alias("code")).select(
        "event_id", at.alias("at_s"), F.coalesce(F.lit(1711929600) - at <= 31 * 86400, F.lit(False)).alias("in_window"),
        canonical_base64(F.col("code")).alias("canonical"))


@query("text_safety_report", f"""WITH c AS (SELECT DISTINCT p_partkey AS i FROM part),
a AS (SELECT 20000000 + i AS ref, i FROM c WHERE i % 83 <> 0),
q AS (SELECT x.i, y.i AS r FROM c x LEFT JOIN c y ON y.i = x.i + 1 WHERE x.i % 2 = 0 AND x.i % 38 <> 0),
used AS (SELECT i FROM q WHERE r IS NOT NULL UNION ALL SELECT r FROM q WHERE r IS NOT NULL),
o AS (SELECT o_orderkey AS i, CASE WHEN o_orderkey % 41 = 0 THEN 20000000 + o_orderkey % 50 ELSE o_custkey END AS g, 20000000 + o_orderkey % 2100 AS e FROM orders),
f AS (SELECT 'input-contract' AS "check", 0 AS n
  UNION ALL SELECT 'citation-support-controlled-facts', count(*) FROM c WHERE i % 83 = 0 OR i % 71 = 0 OR i % 67 = 0 OR i % 61 = 0
  UNION ALL SELECT 'key-fact-number-unit-consistency', 2 * count(*) FROM c WHERE i % 29 = 0
  UNION ALL SELECT 'bilingual-structured-fact-equivalence', count(*) FILTER (WHERE r IS NULL OR i % 61 = 0 OR r % 61 = 0) FROM q
  UNION ALL SELECT 'bilingual-structured-fact-equivalence', count(*) FROM c WHERE i NOT IN (SELECT i FROM used)
  UNION ALL SELECT 'cited-artifact-freshness', count(*) FROM c WHERE i % 83 = 0 OR NOT (i <= 700 AND 700 <= i + 400)
  UNION ALL SELECT 'url-protocol-host-allowlist', count(*) FROM pages WHERE NOT starts_with(url, 'https:')
  UNION ALL SELECT 'authority-taint-separation', count(*) FROM a WHERE i % 53 = 0
  UNION ALL SELECT 'authority-taint-separation', count(*) FROM ({ORACLES["grant_breaches"]})
  UNION ALL SELECT 'authority-taint-separation', count(*) FILTER (WHERE i % 37 = 0) + count(*) FILTER (WHERE g IN (SELECT ref FROM a)) + count(*) FILTER (WHERE g NOT IN (SELECT c_custkey FROM customer))
    + count(*) FILTER (WHERE g IN (SELECT c_custkey FROM customer) AND g % 4 IN (1, 3)) + count(*) FILTER (WHERE e NOT IN (SELECT ref FROM a)) FROM o
  UNION ALL SELECT 'declared-render-accessibility-structural-only', count(*) FROM ({ORACLES["accessibility_breaches"]}))
SELECT "check", CAST(sum(n) AS BIGINT) AS findings, sum(n) = 0 AS passed FROM f GROUP BY 1""")
def text_safety_report(spark, d):
    """Parts as artifacts and as claims, two of them a bilingual pair; customers as grants, orders as actions."""
    from tallyline.plans.audits import UNTRUSTED
    from tallyline.plans.audits import text_safety_report as report

    i, half = F.col("p_partkey"), F.expr("p_partkey div 2").cast("string")
    ref = (i + 20000000).alias("doc_id")
    key, size = F.concat(F.lit("part."), half), F.expr("p_partkey div 2 % 50 + 1")
    fact = F.concat(F.lit("FACT["), key, F.lit("|size]="), size.cast("string"), F.lit(" beds"))
    loose = F.concat(F.lit("part "), half, F.lit(" has "), size.cast("string"), F.lit(" beds"))
    p = fx.table(spark, d, "part")
    value = F.when(i % 61 == 0, size + 100).otherwise(size)
    said = F.when(i % 29 == 0, value + 1).otherwise(value).cast("string")
    english = i % 2 == 0
    o = F.col("o_orderkey")
    return report({
        "artifacts": p.where("p_partkey % 83 <> 0").select(
            ref, F.concat(F.col("p_name"), F.lit("\n  "), fact, F.lit(" \r\n"), loose).alias("text"), i.alias("created"), (i + 400).alias("fresh_until"),
            F.when(i % 53 != 0, UNTRUSTED).alias("trust")),
        "claims": p.select(
            i.alias("claim_id"), (i + 20000000).alias("cited"), F.when(i % 71 == 0, F.concat(fact, F.lit("x"))).when(i % 67 == 0, loose).otherwise(fact).alias("quote"),
            key.alias("subject"), F.lit("size").alias("predicate"), value.cast("string").alias("value"), F.lit("beds").alias("unit"),
            F.when(english, "en").otherwise("es").alias("language"),
            F.concat(F.when(english, "There are ").otherwise("Hay "), said, F.when(english, " beds").otherwise(" camas")).alias("statement")),
        "pairs": p.where("p_partkey % 2 = 0 and p_partkey % 38 <> 0").select(i.alias("pair_id"), i.alias("left_id"), (i + 1).alias("right_id")),
        "grants": _grants(spark, d),
        "actions": fx.table(spark, d, "orders").select(
            o.alias("action_id"), F.when(o % 37 == 0, "talk").otherwise("tool").alias("kind"), F.lit("cap-0").alias("capability"),
            F.when(o % 41 == 0, 20000000 + o % 50).otherwise(F.col("o_custkey")).alias("grant_id"), F.array(o % 2100 + 20000000).alias("evidence")),
        "urls": fx.table(spark, d, "pages").select(F.col("page_id").alias("url_id"), "url"),
        "hosts": fx.table(spark, d, "pages").select(F.regexp_extract("url", r"^[a-z]+://([^/?#]*)", 1).alias("host")),
        "pages": fx.table(spark, d, "pages"),
    }, ["https"], ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD"], ["cap-0", "cap-1"], F.lit(700))
