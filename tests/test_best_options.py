"""A choice among options is one hash aggregate of numbers, equal to the sorted structs."""

from tallyline.operators import selection as sel


def test_best_of_options_equals_the_pairs_and_sorts_none_of_them(spark):
    options = spark.createDataFrame(
        [(1, 0, 5, None, "b"), (1, 1, 5, 2, "a"), (2, 0, 5, 2, "a"), (2, 0, 5, 2, "a"), (3, 0, None, 9, "c"), (None, 0, 0, 0, "z"), (4, 1, 4, 7, None)],
        "profile int, variant int, cost int, quality int, name string")
    asks = spark.createDataFrame(
        [(1, 1), (1, 2), (2, 2), (2, 2), (3, 4), (3, 1), (None, 3), (None, 1), (4, None), (5, 9)], "task int, profile int")
    order, keep = ("cost", "-quality", "name"), ["profile", "variant", "cost"]
    pairs = sel.best(asks.join(options, "profile"), ["task"], order, keep)
    out = sel.best(asks, ["task"], order, keep, options, ["profile"])
    assert out.columns == pairs.columns
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert rows(out) == rows(pairs) and len(rows(out)) == 4
    assert "SortAggregate" not in out._jdf.queryExecution().toString()


def test_best_profiles_do_not_sort_offers(spark, sf):
    from tallyline.catalog import load

    for name in ("best_profile_cheapest", "best_profile_token_first", "best_profile_highest_quality"):
        df = load()[0][name](spark, sf)
        assert "SortAggregate" not in df._jdf.queryExecution().toString()
        assert df.count() == df.select("run_id", "task_id").distinct().count() > 0
