"""Near-duplicates: joins of lists and sketches are not broadcast, whatever their size."""

from tallyline.llm import neardup


def test_lists_are_joined_by_shuffles(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{(i // 2 * 31 + j) % 97}" for j in range(30))) for i in range(40)], "doc_id long, text string")
    assert neardup.near_duplicates(docs).where("not kept").count() == 20
    for name in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"):
        assert spark.conf.get(name) == "256k"
