import pytest
from pyspark.sql import functions as F

from tallyline.session import _one_machine, shared_dir


def test_folder_is_required_on_a_cluster():
    assert [_one_machine(m) for m in ("local", "local[8]", "local[*]", "local-cluster[2,1,900]", "spark://h:7077", "yarn", "k8s://h")] == [True] * 3 + [False] * 4


def test_unset_folder_raises_on_a_cluster():
    class Conf:
        def get(self, key, default=None):
            return None

    class Context:
        master = "yarn"

        def getConf(self):
            return Conf()

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Session())


def test_settings_split_a_hot_key(spark):
    small = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
             "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5"}
    old = {name: spark.conf.get(name, None) for name in small}
    try:
        for name, value in small.items():
            spark.conf.set(name, value)
        row = F.sha2(F.col("id").cast("string"), 256)
        uses = spark.range(0, 60_000, 1, 8).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id") % 1000).alias("ref"), row.alias("use"))
        known = spark.range(0, 1000, 1, 2).select(F.col("id").alias("ref"), F.lit(True).alias("known")).unionByName(spark.sql("SELECT -1L AS ref, true AS known"))
        joined = uses.join(known, ["ref"], "left")
        rows = joined.collect()
        assert len(rows) == 60_000 and all(r["known"] for r in rows)
        assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for name, value in old.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def test_no_broadcast_on_the_size_of_compressed_files(spark, tmp_path):
    from tallyline.operators.text import citation_support
    from tallyline.session import tune

    path = str(tmp_path / "parts")  # a small file of many rows
    spark.range(0, 200_000, 1, 1).select("id", F.sequence(F.lit(0), F.lit(20)).alias("pad")).write.parquet(path)
    rows = tune(spark).read.parquet(path)
    line = F.concat(F.lit("line "), F.col("id").cast("string"))
    claims = rows.select(F.col("id").alias("claim_id"), F.col("id").alias("cited"), line.alias("quote"))
    checked = citation_support(claims, rows.select(F.col("id").alias("doc_id"), F.concat(line, F.lit("\nsecond "), line).alias("text")))
    planned = checked._jdf.queryExecution().executedPlan().toString()  # before a stage has run
    assert "SortMergeJoin" in planned and "BroadcastExchange" not in planned
    assert [tuple(r) for r in checked.groupBy("code").count().collect()] == [("supported", 200_000)]
