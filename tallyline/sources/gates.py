"""Evidence gates over many CI reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.operators.checks import flagged

# Severities, licence markers of the deny policy.
SEVERITIES = ("UNDEFINED", "LOW", "MEDIUM", "HIGH")
UNKNOWN_LICENSES = ("", "N/A", "NOASSERTION", "NONE", "UNKNOWN")
PROHIBITED_MARKERS = (
    "AFFERO GENERAL PUBLIC LICENSE", "AGPL", "BUSINESS SOURCE LICENSE", "COMMONS CLAUSE", "ELASTIC LICENSE",
    "SERVER SIDE PUBLIC LICENSE", "SSPL",
)
GPL = r"(?:\bGNU GENERAL PUBLIC LICENSE\b|\bGPL(?:[- V]?[0-9])?\b)"
PERMISSIVE_MARKERS = ("APACHE", "BSD", "MIT", "MOZILLA", "MPL", "PSF", "PUBLIC DOMAIN", "PYTHON SOFTWARE FOUNDATION")


def junit_cases(spark: SparkSession, path: str, report: Column | None = None) -> DataFrame:
    """One row per test case of every report; a case is the unit read, not the report.

    A report is a file, or what ``report`` makes of ``_metadata.file_path``: a report of many files is read by as many tasks.
    """
    schema = "_name string, failure array<string>, error array<string>, skipped array<string>"
    rows = spark.read.schema(schema).option("rowTag", "testcase").xml(path)
    n = lambda c: F.coalesce(F.size(c), F.lit(0))
    return rows.select((F.col("_metadata.file_path") if report is None else report).alias("report"), n("failure").alias("failures"), n("error").alias("errors"), n("skipped").alias("skips"))


def junit_suites(spark: SparkSession, path: str, report: Column | None = None) -> DataFrame:
    schema = "_tests bigint, _failures bigint, _errors bigint, _skipped bigint, _disabled bigint"
    rows = spark.read.schema(schema).option("rowTag", "testsuite").xml(path)
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    return rows.select((F.col("_metadata.file_path") if report is None else report).alias("report"), *[z(f"_{c}").alias(c) for c in ("tests", "failures", "errors", "skipped", "disabled")])


def junit_breaches(cases: DataFrame, suites: DataFrame) -> DataFrame:
    """Declared against observed counts, and nothing failed, skipped or disabled."""
    seen = cases.groupBy("report").agg(F.count("*").alias("n"), F.sum("failures").alias("f"), F.sum("errors").alias("e"), F.sum("skips").alias("s"))
    said = suites.groupBy("report").agg(*[F.sum(c).alias(c) for c in ("tests", "failures", "errors", "skipped", "disabled")])
    x = said.join(seen, "report", "full_outer").na.fill(0)
    return flagged(x, {
        "no_test_cases": F.col("n") == 0,
        "count_mismatch": F.col("tests") != F.col("n"),
        "outcome_mismatch": (F.col("failures") != F.col("f")) | (F.col("errors") != F.col("e")) | (F.col("skipped") != F.col("s")),
        "not_all_passed": (F.col("f") + F.col("e") + F.col("s") + F.col("disabled")) > 0,
    }, ["report"])


def coverage_breaches(reports: DataFrame, statement_floor: float, branch_floor: float) -> DataFrame:
    """``reports``: report, statements, covered_statements, branches, covered_branches."""
    share = lambda a, b: F.when(F.col(b) > 0, 100.0 * F.col(a) / F.col(b)).otherwise(100.0)
    return flagged(reports, {
        "nothing_measured": (F.col("statements") <= 0) | (F.col("branches") <= 0),
        "covered_above_measured": (F.col("covered_statements") > F.col("statements")) | (F.col("covered_branches") > F.col("branches")),
        "statement_floor": share("covered_statements", "statements") + 1e-12 < statement_floor,
        "branch_floor": share("covered_branches", "branches") + 1e-12 < branch_floor,
    }, ["report"])


def scanner_breaches(findings: DataFrame, totals: DataFrame) -> DataFrame:
    """``findings``: report, severity, filename, issue_text, test_id; ``totals``: report, loc, errors, skipped_tests, undefined, low, medium, high.

    A declared total that is absent matches nothing, and findings of a report without totals have no total at all.
    """
    sev = F.col("severity")
    blank = F.lit(False)
    for c in ("filename", "issue_text", "test_id"):
        blank = blank | (F.coalesce(F.col(c), F.lit("")) == "")
    seen = findings.groupBy("report").agg(*[F.count_if(sev == s).alias(f"n_{s.lower()}") for s in SEVERITIES],
                                          F.count_if(~F.coalesce(sev.isin(list(SEVERITIES)), F.lit(False))).alias("n_other"), F.count_if(blank).alias("n_blank"))
    counts = [c for c in seen.columns if c != "report"]
    x = totals.join(seen, "report", "full_outer").na.fill(0, counts)
    differs = F.lit(False)
    for s in SEVERITIES:
        differs = differs | ~F.col(s.lower()).eqNullSafe(F.col(f"n_{s.lower()}"))
    return flagged(x, {
        "scanner_errors": F.col("errors") > 0, "no_source_lines": F.coalesce("loc", F.lit(0)) <= 0, "skipped_tests": F.col("skipped_tests") > 0,
        "unknown_severity": F.col("n_other") > 0, "finding_fields_missing": F.col("n_blank") > 0, "count_mismatch": differs,
        "blocked_findings": (F.col("n_medium") + F.col("n_high")) > 0,
    }, ["report"])


def license_breaches(packages: DataFrame) -> DataFrame:
    """``packages``: report, name, version, license."""
    lic = F.upper(F.trim(F.regexp_replace(F.coalesce("license", F.lit("")), r"\s+", " ")))
    marked = lambda words: reduce(lambda a, b: a | b, [lic.contains(x) for x in words])
    denied = marked(PROHIBITED_MARKERS) | (lic.rlike(GPL) & ~marked(PERMISSIVE_MARKERS))
    own = flagged(packages, {"unknown_license": lic.isin(list(UNKNOWN_LICENSES)), "prohibited_license": denied}, ["report", "name", "version"])
    twice = packages.groupBy("report", F.lower("name").alias("name"), "version").agg(F.count("*").alias("n")).where("n > 1")
    return own.unionByName(twice.select("report", "name", "version", F.lit("duplicate_package").alias("code")))
