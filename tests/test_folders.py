"""Evidence folders and streams that go on in a caller's folder."""

import hashlib

import pytest

from tallyline.sources import tables
from tallyline.streaming import jobs


def test_manifest_names_every_file_below_the_folder(spark, tmp_path):
    root = tmp_path / "records" / "run 1%20"
    content = {"a.json": b"x", "left/a.json": b"y" * 3_000_001, "left/deep/b c.json": b"z", "right/a.json": b"x"}
    for name, data in {**content, "_SUCCESS": b"no", ".a.crc": b"no", "_tmp/c.json": b"no", "right/empty.json": b""}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(data)
    want = {(name, len(data), hashlib.sha256(data).hexdigest()) for name, data in content.items()}
    # Spark reads a folder name as a pattern, in which a percent sign and a space stand for themselves
    for folder in (str(root), f"file:{root}", f"{root}/"):
        assert {tuple(r) for r in tables.folder_manifest(spark, folder).collect()} == want
    with pytest.raises(ValueError, match="absolute"):
        tables.folder_manifest(spark, "records")


def test_folder_is_checked_against_its_manifest(spark, tmp_path):
    folder = str(tmp_path / "evidence")
    tables.write_evidence(spark.range(1000), folder, ["id"], 4)
    assert not tables.verify_evidence(spark, folder).collect()
    files = sorted((tmp_path / "evidence" / "records").glob("part-*.json"))
    lines = files[0].read_bytes()
    files[0].write_bytes(b"9" * len(lines))
    files[1].write_bytes(files[1].read_bytes() + b"{}")
    files[2].unlink()
    more = tmp_path / "evidence" / "records" / "below"
    more.mkdir()
    (more / files[3].name).write_bytes(files[3].read_bytes())
    got = {(r["name"], r["code"]) for r in tables.verify_evidence(spark, folder).collect()}
    assert got == {(files[0].name, "digest_mismatch"), (files[1].name, "size_mismatch"), (files[2].name, "missing_payload"), (f"below/{files[3].name}", "unknown_payload")}


def test_drained_streams_go_on_in_a_callers_folder(spark, tmp_path):
    source = str(tmp_path / "in")
    rows = lambda *ids: spark.createDataFrame([(1, i, f"k{i % 2}") for i in ids], "run_id long, seq long, kind string")
    def once():
        tail = jobs.tail(spark, source, rows(0).schema)
        kept = jobs.drain(tail, "tail", str(tmp_path / "tail"))
        counts = jobs.drain_updates(tail.groupBy("kind").count(), ["kind"], "counts", str(tmp_path / "counts"))
        return sorted(r["seq"] for r in kept.collect()), {r["kind"]: r["count"] for r in counts.collect()}

    rows(1, 2, 3).write.parquet(source)
    assert once() == ([1, 2, 3], {"k0": 1, "k1": 2})
    rows(4).write.mode("append").parquet(source)
    assert once() == ([1, 2, 3, 4], {"k0": 2, "k1": 2})
    assert once() == ([1, 2, 3, 4], {"k0": 2, "k1": 2})
