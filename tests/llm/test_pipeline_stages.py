"""The pipeline's filtering stages: users' columns, few labels, spans over several item groups, and the whole run."""

import random

import pytest

pytest.importorskip("tallyline.llm")
import corpus_pipeline  # noqa: E402
from tallyline.llm import decontaminate, neardup, quality, sharding, toxicity  # noqa: E402

SCHEMA = "doc_id long, text string, __row string, __toxicity string, __stat_words string, __spans string, n_chars string"


def corpus(n=30):
    rng = random.Random(4)
    rows = [(i, " ".join("".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(60)), f"r{i}", "t", "s", "x", "many") for i in range(n)]
    return [*rows, (n, None, "null", "t", "s", "x", "1"), (n + 1, "", "empty", "t", "s", "x", "2"), (None, rows[0][1], "copy", "t", "s", "x", None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")


def as_set(df):
    return sorted(map(repr, map(tuple, df.collect())))


def test_without_labels_all_documents_stay(spark, docs, none):
    some = spark.createDataFrame([(i, 1, 0) for i in range(7)], "doc_id long, quality int, toxic int")
    for labels in (none, some):
        with pytest.warns(UserWarning):
            assert as_set(toxicity.keep_clean(docs, labels)) == as_set(docs)
        with pytest.warns(UserWarning):
            assert as_set(quality.keep_good(docs, labels)) == as_set(docs)


def test_filters_leave_the_users_columns(spark, docs):
    labels = spark.createDataFrame([(i, int(i % 2), int(i % 3 == 0)) for i in range(30)], "doc_id long, quality int, toxic int")
    rows = set(as_set(docs))
    for kept in (toxicity.keep_clean(docs, labels, 0.99), quality.keep_good(docs, labels, 0.01), neardup.keep_one(docs)):
        assert kept.columns == docs.columns and set(as_set(kept)) <= rows
    assert sorted(r["__row"] for r in neardup.keep_one(docs).collect()) == sorted(r[2] for r in corpus() if r[2] != "copy")
    assert sharding.kd_shards(docs, 4).count() == len(rows)


@pytest.mark.parametrize("group_bytes", [10**9, 150])
def test_spans_go_over_any_number_of_groups(spark, docs, monkeypatch, group_bytes):
    monkeypatch.setattr(decontaminate, "ITEM_BYTES", group_bytes)
    rows = corpus()
    words = {r[2]: (r[1] or "").split() for r in rows}
    items = [(k, " ".join(words[f"r{k}"][5 * k : 5 * k + 20])) for k in range(5)] + [(9, " ".join(words["r9"]))]
    frame = spark.createDataFrame(items, "item_id long, text string")
    want = {}
    for name, w in words.items():
        hit = set()
        for _, text in items:
            x = text.split()
            for a in range(len(x) - 12):
                for p in range(len(w) - 12):
                    if w[p : p + 13] == x[a : a + 13]:
                        hit.update(range(p, p + 13))
        if hit and 20 * len(hit) >= len(w):
            if len(hit) < len(w):
                want[name] = [x for i, x in enumerate(w) if i not in hit]
        else:
            want[name] = w
    got = {r["__row"]: (r["text"] or "").split() for r in decontaminate.remove_spans(docs, frame).collect()}
    assert got == want and len(want) == len(rows) - 1
    kept = decontaminate.keep_uncontaminated(docs, frame)
    assert kept.columns == docs.columns and sorted(r["__row"] for r in kept.collect()) == sorted(n for n in words if want.get(n) == words[n])


def test_the_whole_pipeline(spark, tmp_path):
    """Stages applied one by one to their own input give the run's rows; an empty table runs through."""
    docs = spark.createDataFrame([(r[0], r[1], "en", "s", 5) for r in corpus()], "doc_id long, text string, lang string, source string, n_chars long")
    items = spark.createDataFrame([(1, corpus()[3][1])], "item_id long, text string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(9)], "doc_id long, quality int, toxic int")
    for name, df in (("documents", docs), ("benchmark", items), ("labels", labels)):
        df.write.parquet(f"{tmp_path}/a/{name}.parquet")
        df.limit(0).write.parquet(f"{tmp_path}/b/{name}.parquet")
    with pytest.warns(UserWarning):
        got = corpus_pipeline.run(spark, f"{tmp_path}/a").collect()
        assert corpus_pipeline.run(spark, f"{tmp_path}/b").count() == 0
    # no model, so toxicity and quality keep all; the copy without an id goes, the null and empty texts stay; document 3 is the item
    assert sorted({r["doc_id"] for r in got}) == [i for i in range(32) if i != 3]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "near_duplicates", "decontamination", "packing"]


def test_equal_items_are_listed_once(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "ITEM_BYTES", 100)
    rows = [("same", "one two three four five")] * 500 + [("same", "six seven"), ("other", "one two three four five"), (None, "eight"), ("none", None)]
    n, items = decontaminate._groups(spark.createDataFrame(rows, "item_id string, text string"))
    assert n == 1 and sorted((r["item_id"], r["text"]) for r in items.collect()) == [
        ("none", ""), ("other", "one two three four five"), ("same", "one two three four five"), ("same", "six seven")]
