"""Captures: written in segments, held against their manifests, and what a reader makes of files and receipts."""

import json

import pytest
from pyspark.sql import functions as F

from tidemark.sinks import capture
from tidemark.sources import tape


def events(spark, n):
    rows = [(i * 3 + 1, i * 1_000_000_000, json.dumps({"capture_id": "c", "payload": {"a": i, "b": "é" * (i % 4)}, "x": [1.5, None]}, sort_keys=True, separators=(",", ":"), ensure_ascii=False)) for i in range(n)]
    return spark.createDataFrame(rows, "recv_seq long, recv_wall_ns long, event string").repartition(5)


@pytest.mark.parametrize("compression", ["none", "gzip"])
def test_a_capture_is_written_in_segments_and_read_again(spark, tmp_path, compression):
    path = str(tmp_path / "capture")
    manifest = capture.write_capture(events(spark, 100), path, "c", rotate_ns=30_000_000_000, most_bytes=800, compression=compression)
    assert manifest["event_count"] == 100 and (manifest["first_recv_seq"], manifest["last_recv_seq"]) == (1, 298)
    assert manifest["segment_count"] > 4 and [s["segment_index"] for s in manifest["segments"]] == list(range(manifest["segment_count"]))
    found, rows = tape.read_manifest(spark, f"{path}/c.manifest.json")
    report = tape.segment_report(rows)
    assert found == manifest and tape.manifest_issues(found, report) == [] and report.where("NOT complete").isEmpty()
    back = rows.where("record = 'event'").select("recv_seq", "event").orderBy("recv_seq").collect()
    assert [tuple(r) for r in back] == [tuple(r) for r in events(spark, 100).select("recv_seq", "event").orderBy("recv_seq").collect()]
    one = manifest["segments"][0]
    wrong = {**manifest, "segments": [{**one, "content_sha256": "0" * 64}, *manifest["segments"][1:]]}
    assert tape.manifest_issues(wrong, report) == ["manifest_sha256", f"content {one['path']}"]
    assert tape.sniff(spark, f"{path}/{one['path']}") == "segment" and tape.sniff(spark, f"{path}/c.manifest.json") == "manifest"


def test_segments_end_by_clock_and_by_bytes(spark):
    placed = capture.with_segments(events(spark, 60), rotate_ns=20_000_000_000, most_bytes=1 << 20)
    assert sorted(map(tuple, placed.groupBy("segment").agg(F.count("*"), F.min("recv_seq")).collect())) == [(0, 20, 1), (1, 20, 61), (2, 20, 121)]
    small = capture.with_segments(events(spark, 60), rotate_ns=10**15, most_bytes=1)
    assert small.select("segment").distinct().count() == 60


def test_captures_refuse_repeated_sequences_and_take_none(spark, tmp_path):
    with pytest.raises(ValueError, match="unique"):
        capture.write_capture(events(spark, 3).union(events(spark, 3)), str(tmp_path / "twice"), "c")
    empty = capture.write_capture(events(spark, 3).limit(0), str(tmp_path / "none"), "c")
    assert empty["segment_count"] == 0 and empty["first_recv_seq"] is None
    with pytest.raises(ValueError, match="id"):
        capture.write_capture(events(spark, 3), str(tmp_path / "noid"), "")


def test_failures_are_told_by_type_alone(spark, tmp_path):
    try:
        try:
            raise OSError("secret")
        except OSError as cause:
            raise RuntimeError("key") from cause
    except RuntimeError as error:
        report = capture.write_failure(spark, str(tmp_path), "c", error, failed_wall_ns=5, writer={"queued": 3})
    assert report["failure_types"] == ["RuntimeError", "OSError"] and "secret" not in json.dumps(report)
    assert json.loads(spark.read.text(str(tmp_path / "c.failure.json")).first()[0]) == report


def test_sniffing_metadata_and_resuming(spark, tmp_path):
    (tmp_path / "t.ndjson").write_text('{"ts_local": 1}\n')
    assert tape.sniff(spark, str(tmp_path / "t.ndjson")) == "tape"
    with pytest.raises(ValueError, match="never finished"):
        tape.sniff(spark, str(tmp_path / "t.ndjson.partial"))
    df = tape.with_metadata(spark.range(5).toDF("source_row_seq"), {"capture_id": "c", "rows": 5})
    df.write.parquet(str(tmp_path / "p"))
    assert tape.metadata(spark.read.parquet(str(tmp_path / "p"))) == {"capture_id": "c", "rows": 5} and tape.metadata(spark.range(1)) == {}
    assert [r[0] for r in tape.after(df, 2).collect()] == [3, 4]


def test_receipts_of_old_and_broken_captures(spark):
    schema = "path string, source_row_seq long, recv_seq long, recv_monotonic_ns long, schema_version int, receive_clock boolean, invalidation boolean, trailer boolean"
    row = lambda path, i, seq, ns, version=3, bad=False: (path, i, seq, ns, version, True, bad, i == 3)
    rows = [row("good", i, i, i) for i in (1, 2, 3)] + [row("bad", 1, 5, 5), row("bad", 2, None, None), row("bad", 3, 5, 4)] + [row("gap", 1, 1, 1), row("gap", 2, 3, 1), row("gap", 3, 4, 1, bad=True)] + [row("old", 1, None, None, 1)]
    found = {r.path: (r.missing, r.gaps, r.regressions, r.clock_regressions, r.receipt_ok, r.valid) for r in tape.receipts(spark.createDataFrame(rows, schema)).collect()}
    assert found == {"good": (0, 0, 0, 0, True, True), "bad": (1, 0, 1, 1, False, False), "gap": (0, 1, 0, 0, False, False), "old": (1, 0, 0, 0, False, True)}
