"""Run-audit views derived from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.functions.columns import cents
from tallyline.operators.scan import rcount, running

DAY_MS = 86_400_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def runs(spark, d) -> DataFrame:
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("run_id"),
        F.col("o_custkey").alias("group_id"),
        F.col("o_orderpriority").alias("policy"),
        F.col("o_orderstatus").alias("state"),
        cents(F.col("o_totalprice")).alias("cost_cap"),
        F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("started_ms"),
    )


def attempts(spark, d) -> DataFrame:
    """Attempt intervals without the attempt number."""
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("run_id"),
        F.col("l_linenumber").cast("long").alias("task_id"),
        F.col("l_suppkey").alias("provider"),
        F.col("l_partkey").alias("profile"),
        F.unix_millis(F.col("l_shipdate").cast("timestamp")).alias("start_ms"),
        (F.unix_millis(F.col("l_shipdate").cast("timestamp")) + F.col("l_quantity").cast("long") * DAY_MS).alias("end_ms"),
        F.col("l_quantity").cast("long").alias("tokens"),
        cents(F.col("l_extendedprice")).alias("cost"),
        (F.col("l_quantity").cast("long") * 100).alias("context"),
        F.when(F.col("l_returnflag") == "N", "completed")
        .when(F.col("l_returnflag") == "R", "failed")
        .otherwise("cancelled")
        .alias("outcome"),
        (F.col("l_linestatus") == "O").alias("optional"),
        (1 - F.col("l_discount")).alias("success_probability"),
        cents(F.col("l_tax")).alias("tax_cents"),
    )


ATTEMPT_TIES = ("profile", "provider", "tokens", "cost", "success_probability", "tax_cents", "outcome", "optional")


def numbered_attempts(spark, d) -> DataFrame:
    return running(
        attempts(spark, d), ["run_id", "task_id"], "start_ms", {"attempt": rcount()}, tie=ATTEMPT_TIES
    )


def tasks(spark, d) -> DataFrame:
    """One row per (run, task): totals over its attempts."""
    return attempts(spark, d).groupBy("run_id", "task_id").agg(
        F.sum("tokens").alias("tokens"),
        F.sum("cost").alias("cost"),
        F.sum("context").alias("context"),
        F.min("start_ms").alias("start_ms"),
        F.max("end_ms").alias("end_ms"),
        F.min("provider").alias("provider"),
        F.bool_and("optional").alias("optional"),
    )


def task_mask(spark, d) -> DataFrame:
    """Tasks present per run as a bit mask (task ids are 1 to 7)."""
    return attempts(spark, d).groupBy("run_id").agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1), F.col("task_id").cast("int"))).alias("mask")
    )


def deps(spark, d) -> DataFrame:
    """Edges task -> dependency: the next lower present task and task // 2 where present."""
    ids = [1, 2, 3, 4, 5, 6, 7]
    has = lambda i: F.col("mask").bitwiseAND(F.lit(1 << i)) != 0
    edges = []
    for t in ids[1:]:
        lower = F.coalesce(*[F.when(has(i), F.lit(i)) for i in reversed(ids) if i < t])
        half = F.when(has(t // 2), F.lit(t // 2))
        for dep in (lower, half):
            edges.append(F.when(has(t) & dep.isNotNull(), F.struct(F.lit(t).cast("long").alias("task_id"),
                                                                     dep.cast("long").alias("dep_id"))))
    return (
        task_mask(spark, d)
        .select("run_id", F.explode(F.array_distinct(F.array_compact(F.array(*edges)))).alias("e"))
        .select("run_id", "e.task_id", "e.dep_id")
    )


def providers(spark, d) -> DataFrame:
    return table(spark, d, "supplier").select(
        F.col("s_suppkey").alias("provider"),
        F.col("s_nationkey").cast("long").alias("nation"),
        (1 + F.col("s_suppkey") % 4).alias("limit"),
    )


def profiles(spark, d) -> DataFrame:
    """Two variants per part: as declared, and faster, dearer and better."""
    p = table(spark, d, "part")
    v = F.explode(F.array(F.lit(0), F.lit(1))).alias("variant")
    return p.select("*", v).select(
        F.col("p_partkey").alias("profile"),
        F.col("variant").cast("long").alias("variant"),
        (F.col("p_size") % 20 + 80 + 5 * F.col("variant")).cast("long").alias("quality_pct"),
        (F.col("p_size") * (2 - F.col("variant"))).cast("long").alias("p95"),
        (cents(F.col("p_retailprice")) * (1 + F.col("variant"))).alias("cost"),
        (F.col("p_size") * 10 + F.length("p_name")).cast("long").alias("tokens"),
        (F.col("p_size") * 100).cast("long").alias("context"),
        F.col("p_brand").alias("provider"),
    )


def events(spark, d) -> DataFrame:
    """Per-user event log with a contiguous sequence."""
    e = table(spark, d, "events").select(
        F.col("user_id").alias("run_id"),
        "event_id",
        F.unix_micros(F.col("ts").cast("timestamp")).alias("at_us"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("at_ms"),
        F.col("event_type").alias("kind"),
        F.ceil("value").cast("long").alias("units"),
        "value",
        F.get_json_object("props", "$.k").cast("long").alias("k"),
    )
    return running(e, ["run_id"], "at_us", {"sequence": rcount()}, tie=["event_id"], bits=31)


def artifacts(spark, d) -> DataFrame:
    return table(spark, d, "documents").select(
        F.sha2("text", 256).alias("artifact_id"),
        "doc_id",
        F.col("source").alias("producer"),
        F.col("lang").alias("media"),
        F.col("n_chars").alias("size"),
        F.col("doc_id").alias("created"),
        (F.col("doc_id") + F.col("n_chars") % 400).alias("fresh_until"),
        "text",
    )


def claims(spark, d) -> DataFrame:
    known = table(spark, d, "documents").select("doc_id")
    return (
        table(spark, d, "labels")
        .join(known, "doc_id")
        .select(
            F.col("doc_id").alias("claim_id"),
            F.when(F.col("quality") == 1, "supported").otherwise("unverified").alias("status"),
            F.array("doc_id").alias("evidence"),
            F.when(F.col("toxic") == 1, F.array(F.col("doc_id") + 1))
            .otherwise(F.array().cast("array<bigint>"))
            .alias("contradicts"),
            F.col("doc_id").alias("created"),
        )
    )


def turns(spark, d) -> DataFrame:
    return table(spark, d, "conversations").select(
        F.col("conv_id").alias("run_id"), (F.col("turn") + 1).alias("sequence"), "role", "text"
    )


def trials(spark, d) -> DataFrame:
    e = table(spark, d, "events")
    units = F.ceil("value").cast("long")
    return e.select(
        F.col("event_type").alias("scenario"),
        F.col("user_id").alias("seed"),
        F.col("event_id").alias("trial"),
        (F.col("value") < 50).alias("passed"),
        units.alias("duration"),
        F.when(F.col("event_type") == "error", units).alias("recovery"),
        F.when(F.col("event_type") == "view", units * 2).alias("direct"),
        F.when(F.col("event_type") != "error", units + F.col("event_id") % 7).alias("overhead"),
        F.when(F.col("event_id") % 5 == 0, 1).otherwise(0).cast("long").alias("calls"),
        (F.col("event_id") % 3).alias("effects"),
        F.when(F.col("event_id") % 97 == 0, 1).otherwise(0).cast("long").alias("duplicates"),
    )


def experiment(spark, d) -> DataFrame:
    """One record per (seed, fault, policy)."""
    e = table(spark, d, "events").select(
        F.col("user_id").alias("seed"),
        F.col("event_type").alias("fault"),
        (F.get_json_object("props", "$.k").cast("long") % 3).alias("policy"),
        F.ceil("value").cast("long").alias("units"),
    )
    return e.groupBy("seed", "fault", "policy").agg(
        (F.sum("units") < 170).alias("success"),
        F.max("units").alias("makespan"),
        F.sum("units").alias("tokens"),
        (F.sum("units") * 3 + F.col("seed") % 11).alias("cost"),
        (F.min("units") * 100).alias("context"),
        F.when(F.max("units") > 90, "deadline").when(F.max("units") > 70, "capacity").alias("reason"),
    )
