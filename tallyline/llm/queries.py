"""The registered queries of these operators and their DuckDB statements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.llm import archive, decontaminate, language, licenses, neardup, packing, periodic, quality, ranked, search, sharding, signatures, tokenfile, toxicity
from tallyline.llm.common import table

CAPACITY = 4096
SHARDS = 16


def tokenizer_file() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_file(), CAPACITY)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop(decontaminate.ROW)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.token_files(table(spark, sf_dir, "documents"), tokenizer_file())


def op6_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive.archive(table(spark, sf_dir, "pages"))


def op7_language_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.language_scores(table(spark, sf_dir, "documents"), least=1, discount=None)


def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.exact_top_k(table(spark, sf_dir, "embeddings"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in 16 shards of nearly equal bytes."""
    out = sharding.kd_shards(table(spark, sf_dir, "documents"), SHARDS)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op11_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.licenses(table(spark, sf_dir, "documents"))


def op12_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digests(periodic.periodic_runs(periodic.with_planted(table(spark, sf_dir, "documents"))))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_packing, op2_decontamination, op3_toxicity, op4_near_duplicates, op5_token_files, op6_archive, op7_language_scores, op8_top_k, op9_quality, op10_shards,
        op11_licenses, op12_ranked, op13_periodic,
    )
}

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')"

_RULES = ", ".join(f"({r.place}, {r.level}, '{r.label}', '{r.keyword}', '{r.pattern}')" for r in signatures.rules())
_SURE = "CASE level " + " ".join(f"WHEN {k} THEN {v}" for k, v in signatures.CONFIDENCE.items()) + " END"
_BASE = " ".join(
    "WHEN " + " AND ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(phrase.split())) + f" THEN '{label}'" for phrase, label in licenses.BASE
)

SQL: dict[str, str] = {
    "op2_decontamination": rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
grams AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[p : p + least(13, len(w)) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS p FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM grams),
spots AS (SELECT doc_id, n, p, array_to_string(w[p : p + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, sizes WHERE len(w) >= n)),
found AS (SELECT s.doc_id, s.n, s.p, x.item_id FROM spots s JOIN grams x ON x.n = s.n AND x.g = s.g),
hit AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM found) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op6_archive": """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS b, sha1(coalesce(html, '')) AS s FROM pages),
h AS (SELECT s, b, max(page_id) AS holder FROM p WHERE b >= 1000 GROUP BY s, b)
SELECT page_id, CAST(p.b AS BIGINT) AS payload_bytes, p.s AS payload_digest,
  CASE WHEN holder IS NULL OR holder = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN holder <> page_id THEN holder END AS refers_to
FROM p LEFT JOIN h ON h.s = p.s AND h.b = p.b""",
    "op8_top_k": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 5""",
    "op11_licenses": rf"""
WITH rules(place, level, label, keyword, pattern) AS (VALUES {_RULES}),
d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT r, i - 1 AS word, CASE {_BASE} END AS label FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
bases AS (SELECT r, count(*) AS n_base, min(word) AS first_word, max(word) AS last_word FROM b WHERE label IS NOT NULL GROUP BY r),
hit AS (SELECT r, place, level, label, pattern, ' ' || array_to_string(w, '  ') || ' ' AS t FROM d JOIN rules ON list_contains(w, keyword)),
marked AS (SELECT r, place, level, label, string_split(trim(regexp_replace(t, pattern, ' ' || chr(1) || '\1 ', 'g'), ' '), '  ') AS v, regexp_extract_all(t, pattern, 1) AS m
  FROM hit WHERE regexp_matches(t, pattern)),
found AS (SELECT r, place, level, label, unnest(list_filter(range(len(v)), lambda k: v[k + 1][1] = chr(1))) AS a, unnest(m) AS m FROM marked),
spans AS (SELECT r, place, level, label, a, a + len(string_split(m, '  ')) AS e FROM found),
kept AS (SELECT *, NOT EXISTS (FROM spans y WHERE y.r = x.r AND y.a <= x.a AND y.e >= x.e AND y.level <= x.level
    AND (y.a < x.a OR y.e > x.e OR y.level < x.level OR y.place < x.place)) AS kept FROM spans x),
own AS (SELECT r, count(*) AS n_found, count(*) FILTER (kept) AS n_kept, max({_SURE}) FILTER (kept) AS best FROM kept GROUP BY r),
bl AS (SELECT r, string_agg(label, ',' ORDER BY label) AS labels FROM (SELECT DISTINCT r, label FROM b WHERE label IS NOT NULL) GROUP BY r),
al AS (SELECT r, string_agg(label, ',' ORDER BY label) AS labels
  FROM (SELECT r, label FROM b WHERE label IS NOT NULL UNION SELECT r, label FROM kept WHERE kept) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(bl.labels, '') AS base_labels, coalesce(al.labels, '') AS labels,
  CAST(greatest(coalesce(best, 0), CASE WHEN n_base > 0 THEN {licenses.BASE_CONFIDENCE} ELSE 0 END) AS DOUBLE) AS score, coalesce(n_found, 0) AS n_found, coalesce(n_kept, 0) AS n_kept
FROM d LEFT JOIN bases USING (r) LEFT JOIN own USING (r) LEFT JOIN bl USING (r) LEFT JOIN al USING (r)""",
    "op12_ranked": rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, unnest({_WORDS}) AS t FROM documents),
n AS (SELECT r, count(*) AS n FROM d GROUP BY r),
total AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM n),
tf AS (SELECT r, doc_id, t, count(*) AS tf FROM d GROUP BY ALL),
w AS (SELECT t, CAST(floor(1000 * ln((2.0::DOUBLE * docs + 2) / (2.0::DOUBLE * count(*) + 1))) AS BIGINT) AS w FROM tf, total GROUP BY t, docs),
i AS (SELECT item, item_id, unnest(terms) AS t FROM (SELECT row_number() OVER () AS item, item_id, {_WORDS} AS terms FROM benchmark)),
s AS (SELECT item, item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // terms)))) AS BIGINT) AS score
  FROM i JOIN w USING (t) JOIN tf USING (t) JOIN n USING (r), total GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= 10""",
    "op13_periodic": rf"""
WITH c AS (SELECT doc_id, text, list_reduce(list_concat([4294967295], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT))),
    lambda c, x: xor(c >> 8, list_reduce([xor(c & 255, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda s, z: xor(s >> 1, 3988292384 * (s & 1))))) AS inv FROM documents),
h AS (SELECT row_number() OVER () AS r, doc_id, xor(inv, 4294967295) AS h, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS o FROM c),
g AS (SELECT r, doc_id, o, h % 10 = 0 AND len(o) > 0 AS planted, (h // 10) % greatest(len(o), 1) AS a, h // 10 AS g FROM h),
p AS (SELECT *, 1 + (len(o) - a) // (3 + g % 8) AS p FROM g),
d AS (SELECT r, doc_id, CASE WHEN planted THEN list_transform(range(len(o)), lambda i: CASE WHEN i < a THEN o[i + 1] ELSE o[a + (i - a) % p + 1] END) ELSE o END AS w FROM p),
t AS (SELECT r, unnest(w) AS x, unnest(range(len(w))) AS i, len(w) AS n FROM d),
eq AS (SELECT b.r, b.i - a.i AS q, a.i FROM t a JOIN t b ON a.r = b.r AND a.x = b.x AND b.i > a.i AND 4 * (b.i - a.i) <= a.n),
islands AS (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS k FROM eq),
stretch AS (SELECT r, q, min(i) AS start, count(*) + q AS length FROM islands GROUP BY r, q, k HAVING count(*) + q >= greatest(6, 4 * q)),
runs AS (SELECT r, start, length, min(q) AS period FROM stretch GROUP BY r, start, length),
cut AS (SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM runs),
left_ AS (SELECT r, string_agg(x, ' ' ORDER BY i) AS s FROM t ANTI JOIN cut USING (r, i) GROUP BY r),
agg AS (SELECT r, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS s FROM runs GROUP BY r),
best AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY r ORDER BY length DESC, start, period) = 1)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, (1000 * length) // period AS exponent_milli, sha256(coalesce(agg.s, '')) AS runs_sha256, sha256(coalesce(left_.s, '')) AS collapsed_sha256
FROM d LEFT JOIN agg USING (r) LEFT JOIN best USING (r) LEFT JOIN left_ USING (r)""",
}
