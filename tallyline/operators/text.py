"""Text, number, fact, URL and page checks over whole documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.functions.columns import (
    LANGUAGE_TAG,
    NUMBER,
    NUMBER_TOKEN,
    UNIT_TERMS,
    fact_fields,
    integer_multiset,
    normalize_space,
    url_host,
    url_problem,
)
from tallyline.operators.checks import flagged, holds


def document_lines(documents: DataFrame, ident: str, text: str) -> DataFrame:
    """Distinct digests of the normalised non-empty lines of every document."""
    line = normalize_space(F.col("__line"))
    return (
        documents.select(ident, F.explode(F.split(text, r"\R")).alias("__line"))
        .select(ident, line.alias("__line")).where("__line <> ''")
        .select(ident, F.sha2("__line", 256).alias("line_digest")).distinct()
    )


def citation_support(claims: DataFrame, documents: DataFrame, controlled: bool = False) -> DataFrame:
    """Does the quoted line occur verbatim, up to whitespace, in the cited document.

    ``claims``: claim_id, cited, quote and, with ``controlled``, subject, predicate, value, unit.
    ``documents``: doc_id, text.  Lines join by digest, so a long document is many small rows.
    """
    known = documents.select(F.col("doc_id").alias("cited"), F.lit(True).alias("__known")).distinct()
    wanted = documents.join(claims.select(F.col("cited").alias("doc_id")).distinct(), "doc_id", "left_semi")
    lines = document_lines(wanted, "doc_id", "text").select(F.col("doc_id").alias("cited"), "line_digest", F.lit(True).alias("__found"))
    quote = normalize_space(F.col("quote"))
    x = claims.withColumns({"__quote": quote, "line_digest": F.sha2(quote, 256)})
    x = x.join(known, ["cited"], "left").join(lines, ["cited", "line_digest"], "left")
    code = (
        F.when(F.col("__known").isNull(), "unknown_artifact")
        .when(F.coalesce("__quote", F.lit("")) == "", "empty_quote")
        .when(F.col("__found").isNull(), "quote_absent")
    )
    if controlled:
        got = fact_fields(F.col("__quote"))
        same = F.lit(True)
        for name, c in got.items():
            same = same & (c == F.col(name))
        code = code.when(got["subject"] == "", "not_a_controlled_fact").when(~holds(same), "claim_differs_from_fact")
    return x.select("claim_id", F.coalesce(code, F.lit("supported")).alias("code"))


def fact_breaches(claims: DataFrame) -> DataFrame:
    """Statement carries exactly the declared number with its localized unit phrase.

    ``claims``: claim_id, language, value (text), unit, statement.
    """
    term = F.lit(None).cast("string")
    for unit, words in UNIT_TERMS.items():
        for lang, phrase in words.items():
            term = F.when((F.col("unit") == unit) & (F.col("language") == lang), phrase).otherwise(term)
    value = F.col("value")
    number = F.when(value.rlike(f"^(?:{NUMBER})$"), F.expr("try_cast(value AS decimal(38, 18))"))
    tokens = F.regexp_extract_all("statement", F.lit(NUMBER_TOKEN), F.lit(1))
    first = F.expr("try_cast(__tok AS decimal(38, 18))")
    x = claims.withColumns({"__term": term, "__tokens": tokens}).withColumn("__tok", F.try_element_at("__tokens", F.lit(1)))
    spaced = F.concat(F.lit(" "), F.lower(normalize_space(F.col("statement"))), F.lit(" "))
    phrase = F.concat(F.lit(r"(?U)(?<![\w.-])\Q"), F.lower(value), F.lit(r"\E\s+\Q"), F.lower("__term"), F.lit(r"\E(?!\w)"))
    has_phrase = F.regexp_like(spaced, phrase)
    return flagged(x, {
        "value_not_canonical": number.isNull(),
        "language_outside_policy": ~holds(F.col("language").isin("en", "es")),
        "unit_outside_vocabulary": F.col("language").isin("en", "es") & F.col("__term").isNull(),
        "not_one_number": F.col("__term").isNotNull() & (F.size("__tokens") != 1),
        "number_differs": F.col("__term").isNotNull() & (F.size("__tokens") == 1) & ~holds(first == number),
        "phrase_missing": F.col("__term").isNotNull() & number.isNotNull() & ~holds(has_phrase),
    }, ["claim_id"])


def pair_breaches(pairs: DataFrame, claims: DataFrame, left_language: str, right_language: str) -> DataFrame:
    """Each side known and in its language, equal facts, every claim paired once.

    ``pairs``: pair_id, left_id, right_id; ``claims``: claim_id, language, signature.
    """
    side = lambda s: claims.select(F.col("claim_id").alias(f"{s}_id"), F.col("language").alias(f"__{s}l"), F.col("signature").alias(f"__{s}s"))
    x = pairs.join(side("left"), ["left_id"], "left").join(side("right"), ["right_id"], "left")
    both = F.col("__leftl").isNotNull() & F.col("__rightl").isNotNull()
    own = flagged(x, {
        "unknown_left": F.col("__leftl").isNull(), "unknown_right": F.col("__rightl").isNull(),
        "left_language": both & (F.col("__leftl") != left_language), "right_language": both & (F.col("__rightl") != right_language),
        "facts_differ": both & ~F.col("__lefts").eqNullSafe(F.col("__rights")),
    }, ["pair_id"]).withColumnRenamed("pair_id", "subject")
    used = x.where(both).select(F.explode(F.array("left_id", "right_id")).alias("claim_id")).groupBy("claim_id").agg(F.count("*").alias("__n"))
    n = F.coalesce("__n", F.lit(0))
    tagged = claims.where(F.col("language").isin(left_language, right_language)).join(used, "claim_id", "left")
    use = flagged(tagged, {"not_paired": n == 0, "paired_repeatedly": n > 1}, ["claim_id"]).withColumnRenamed("claim_id", "subject")
    return own.unionByName(use)


def number_parity(pairs: DataFrame, left: Column, right: Column, ident: Sequence[str]) -> DataFrame:
    """Do two texts carry the same multiset of integers."""
    return pairs.select(*ident, (integer_multiset(left) == integer_multiset(right)).alias("parity"))


def url_policy(rows: DataFrame, ident: Sequence[str], url: str, schemes: Sequence[str], hosts: DataFrame) -> DataFrame:
    """First reason each URL is refused; ``hosts`` is a table of allowed hosts (J13, URL family)."""
    allowed = hosts.select(F.col("host").alias("__host"), F.lit(True).alias("__ok")).distinct()
    x = rows.withColumn("__host", url_host(F.col(url))).join(allowed, ["__host"], "left")
    return x.select(*ident, url_problem(F.col(url), schemes, F.col("__ok")).alias("problem")).where("problem is not null")


def page_facts(pages: DataFrame, ident: str, html: str) -> DataFrame:
    """Declared accessibility facts read from each whole page."""
    h = F.col(html)
    count = lambda pattern: F.size(F.regexp_extract_all(h, F.lit(pattern), F.lit(0))).cast("long")
    images = F.regexp_extract_all(h, F.lit(r"(?is)<img\b[^>]*>"), F.lit(0))
    return pages.select(
        ident,
        F.regexp_extract(h, r'(?is)<html\b[^>]*\blang="([^"]*)"', 1).alias("language"),
        F.trim(F.regexp_extract(h, r"(?is)<title\b[^>]*>(.*?)</title>", 1)).alias("title"),
        count(r"(?is)<main\b|role=\"main\"").alias("mains"),
        count(r"(?is)<nav\b").alias("navigations"),
        count(r"(?is)<nav\b[^>]*\baria-label(?:ledby)?=\"[^\"]+\"").alias("labelled_navigations"),
        count(r"(?is)<h1\b").alias("headings"),
        F.size(images).cast("long").alias("images"),
        F.size(F.filter(images, lambda i: ~i.rlike(r"(?is)\balt=\""))).cast("long").alias("images_without_alt"),
    )


def accessibility_breaches(facts: DataFrame, ident: str) -> DataFrame:
    return flagged(facts, {
        "language_malformed": ~F.col("language").rlike(LANGUAGE_TAG),
        "title_empty": F.col("title") == "",
        "main_landmark_count": F.col("mains") != 1,
        "navigation_unlabelled": F.col("navigations") > F.col("labelled_navigations"),
        "image_without_alt": F.col("images_without_alt") > 0,
    }, [ident])
