"""Licence scans with DataFrame functions only: ordered signature rules behind a keyword gate.

A text's words decide by one set intersection which keywords it has; texts without any are done.  The others are put in a
normal form of lower-case words, in which the rules of their keywords are looked for; matches are marked in the text, so their word
numbers come from one walk over its words.  A detection goes when one of the same or a higher priority covers it: since covering is
transitive, running maxima of the ends by priority, over the detections of a text by start, decide that without comparing pairs.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyline.llm.common import base, durable
from tallyline.llm.signatures import CONFIDENCE, OTHER, Rule, rules

WORD = r"[0-9a-z\x{80}-\x{10FFFF}]+"
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))  # fixed values
BASE_CONFIDENCE = 0.7
MARK = "\\u0001"  # no word has it
FOUND = "array<struct<start:int,end:int,level:int,place:int,label:string>>"


def _quoted(values: list[str]) -> str:
    return "array(" + ", ".join(f"'{v}'" for v in values) + ")"


def _phrase(phrase: str) -> str:
    return " AND ".join(f"get(__words, i + {k}) = '{w}'" for k, w in enumerate(phrase.split()))


def _rules(found: list[Rule]) -> Column:
    """The rules as a constant array."""
    shape = "array<struct<place:int,level:int,label:string,keyword:string,pattern:string>>"
    return F.from_json(F.lit(json.dumps([r._asdict() for r in found])), shape)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, places (start word and label of every base phrase) and found (every rule's matches) of every row.

    ``found`` has start and end (after the last) as word numbers, and the rule's level, place and label.  A null text has no words.
    Only doc_id and text are read.
    """
    base(docs.sparkSession)
    table = rules()
    keywords = sorted({r.keyword for r in table} | {w for phrase, _ in BASE for w in phrase.split()})
    gates = _quoted([phrase.split()[0] for phrase, _ in BASE])
    labels = "CASE " + " ".join(f"WHEN {_phrase(phrase)} THEN '{label}'" for phrase, label in BASE) + " END"
    places = f"""filter(transform(sequence(0, size(__words) - 1), i -> struct(CAST(i AS BIGINT) AS word, {labels} AS label)), x -> x.label IS NOT NULL)"""
    matches = f"""flatten(transform(filter(__rules, r -> array_contains(__has, r.keyword) AND __norm RLIKE r.pattern), r -> zip_with(
        filter(transform(split(trim(regexp_replace(__norm, r.pattern, ' {MARK}$1 ')), '  '), (w, i) -> if(startswith(w, '{MARK}'), i, NULL)), i -> i IS NOT NULL),
        regexp_extract_all(__norm, r.pattern, 1),
        (i, m) -> struct(i AS start, i + size(split(m, '  ')) AS end, r.level AS level, r.place AS place, r.label AS label))))"""
    words = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.expr(f"regexp_extract_all(lower(coalesce(text, '')), r'{WORD}', 0)").alias("__words"))
    gated = words.withColumn("__has", F.array_intersect(F.expr(_quoted(keywords)), "__words"))
    normal = gated.withColumn("__norm", F.when(F.size("__has") > 0, F.concat(F.lit(" "), F.array_join("__words", "  "), F.lit(" "))))
    some = normal.withColumn("__rules", _rules(table))
    return some.select(
        "doc_id", F.size("__words").cast("long").alias("n_words"),
        F.when(F.arrays_overlap("__has", F.expr(gates)), F.expr(places)).otherwise(F.expr("CAST(array() AS array<struct<word:bigint,label:string>>)")).alias("places"),
        F.when(F.size("__has") > 0, F.expr(matches)).otherwise(F.expr(f"CAST(array() AS {FOUND})")).alias("found"),
    )


def detections(scanned: DataFrame, row: str) -> DataFrame:
    """``row``, start, end, level, place, label, kept: every match of ``scan``; covered ones are not kept.

    One covers another if it has its whole interval and a level as high, and is longer, of a higher level or earlier in the rules.
    """
    each = scanned.select(row, F.inline("found"))
    before = Window.partitionBy(row).orderBy("start", F.desc("end"), "level", "place").rowsBetween(Window.unboundedPreceding, -1)
    # the farthest end so far of each level: whatever starts later and ends no later is covered
    reach = [F.coalesce(F.max(F.when(F.col("level") == level, F.col("end"))).over(before), F.lit(0)) for level in range(OTHER + 1)]
    each = each.withColumn("__reach", F.array(*reach))
    return each.withColumn("kept", ~F.exists(F.slice("__reach", 1, F.col("level") + 1), lambda x: x >= F.col("end"))).drop("__reach")


def licenses(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_found, n_kept of every row.

    Base phrases always give their labels; kept detections add theirs.  score: the confidence of the best kept detection, at least
    0.7 where a base phrase stands, else 0.  Null and empty texts have no words and no labels (empty strings).  Repeated rows and
    ids stay rows of their own, a null id stays null; other columns are not read.  An empty table gives no rows.
    """
    facts = durable(scan(docs).withColumn("__row", F.monotonically_increasing_id()))
    sure = F.element_at(F.array(*(F.lit(CONFIDENCE[k]) for k in sorted(CONFIDENCE))), F.col("level") + 1)
    kept = detections(facts, "__row").groupBy("__row").agg(
        F.collect_set(F.when(F.col("kept"), F.col("label"))).alias("own"), F.max(F.when(F.col("kept"), sure)).alias("best"),
        F.count("*").alias("n_found"), F.count_if("kept").alias("n_kept"),
    )  # labels are at most as many as the rules
    both = facts.drop("found").join(kept, "__row", "left")
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    known = F.col("places.label")
    return both.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min("places.word").alias("first_word"), F.array_max("places.word").alias("last_word"),
        joined(known).alias("base_labels"), joined(F.concat(known, F.coalesce("own", F.array().cast("array<string>")))).alias("labels"),
        F.greatest(F.coalesce("best", F.lit(0.0)), F.when(F.size("places") > 0, F.lit(BASE_CONFIDENCE)).otherwise(F.lit(0.0))).alias("score"),
        F.coalesce("n_found", F.lit(0)).alias("n_found"), F.coalesce("n_kept", F.lit(0)).alias("n_kept"),
    )
