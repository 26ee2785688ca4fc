import gzip
import hashlib
import json

import pytest

from tidemark.sinks import bundle
from tidemark.sources import tape

META = {"ts_local": 0.0, "symbol": "*", "type": "captureMeta", "data": {"schemaVersion": 3}}
INFO = {"ts_local": 0.5, "symbol": "X", "type": "exchangeInfo", "data": {"tickSize": "0.1", "stepSize": "0.001"}}
SNAP = {"ts_local": 1.0, "symbol": "X", "type": "snapshot", "data": {"lastUpdateId": 10, "bids": [["100.0", "0.01"]], "asks": [["100.2", "0.02"], ["100.25", "1"]]}}
DEPTH = {"ts_local": 2.0, "symbol": "X", "type": "depthUpdate", "data": {"U": 9, "u": 11, "b": [["100.0", "0"]], "a": [], "_capture": {"recvSeq": 7, "recvMonotonicNs": 5, "route": "public"}}}
TRADE = {"ts_local": 3.0, "symbol": "X", "type": "aggTrade", "data": {"p": "100.1", "q": "0.003", "m": True, "T": 1700000000123}}


def write(path, rows):
    text = "\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows) + "\n"
    opener = gzip.open if str(path).endswith(".gz") else open
    with opener(path, "wt") as f:
        f.write(text)
    return str(path)


def test_lines_keep_their_numbers(spark, tmp_path):
    a = write(tmp_path / "a.ndjson", [META, "", INFO])
    b = write(tmp_path / "b.ndjson.gz", [SNAP, DEPTH])
    rows = tape.read_lines(spark, [a, b]).collect()
    assert sorted((r.path.rpartition("/")[2], r.line) for r in rows) == [("a.ndjson", 1), ("a.ndjson", 3), ("b.ndjson.gz", 1), ("b.ndjson.gz", 2)]


def test_line_numbers_in_split_files(spark, tmp_path):
    path = write(tmp_path / "big.ndjson", [json.dumps({"i": i, "x": "y" * 50}) for i in range(3000)])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows = tape.read_lines(spark, path).collect()
        assert len(rows) == 3000 and all(json.loads(r.value)["i"] == r.line - 1 for r in rows)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_validation_names_the_broken_rules(spark, tmp_path):
    bad = [
        "{not json",
        {**INFO, "ts_local": -1},
        {**INFO, "type": "other"},
        {**SNAP, "data": {"lastUpdateId": 1, "bids": [["x", "1"]], "asks": []}},
        {**DEPTH, "data": {"U": 5, "u": 4, "b": [], "a": []}},
        {**DEPTH, "data": {**DEPTH["data"], "_capture": {"recvSeq": 1.5}}},
    ]
    path = write(tmp_path / "t.ndjson", [META, INFO, SNAP, DEPTH, TRADE, *bad])
    rows = {r.line: r.reasons for r in tape.validate(tape.read_lines(spark, path)).collect()}
    assert all(not rows[i] for i in range(1, 6))
    assert "json" in rows[6] and rows[7] == ["ts_local"] and rows[8] == ["type"] and rows[9] == ["snapshot"] and rows[10] == ["depthUpdate"] and rows[11] == ["recvSeq"]
    assert tape.recover(tape.validate(tape.read_lines(spark, path))).count() == 5


def test_normalized_levels_and_trades(spark, tmp_path):
    path = write(tmp_path / "t.ndjson", [META, INFO, SNAP, DEPTH, TRADE])
    n = tape.normalize(tape.validate(tape.read_lines(spark, path)))
    by_kind = {r.event_kind: r for r in n.collect()}
    assert by_kind["depthUpdate"].recv_seq == 7 and by_kind["depthUpdate"].logical_time_source == "recv_monotonic"
    assert by_kind["snapshot"].recv_monotonic_ns == 1_000_000_000 and by_kind["snapshot"].route == "legacy"
    assert by_kind["aggTrade"].exchange_transaction_ns == 1700000000123000000
    specs = tape.specs(n)
    levels = {(r.event_kind, r.side, r.pos): (r.tick, r.lots) for r in tape.depth_levels(n, specs).collect()}
    assert levels == {("snapshot", "bid", 0): (1000, 10), ("snapshot", "ask", 0): (1002, 20), ("snapshot", "ask", 1): (None, 1000), ("depthUpdate", "bid", 0): (1000, 0)}
    t = tape.trades(n, specs).first()
    assert (t.tick, t.lots, t.buyer_is_maker) == (1001, 3, True)


def segment(tmp_path, name, seqs, count=None):
    rows = [{"record": "segment_header", "segment_index": 0}, *({"record": "event", "recv_seq": s, "payload_checksum": "c", "event": {"a": s}} for s in seqs)]
    rows.append({"record": "segment_trailer", "complete": True, "count": len(seqs) if count is None else count, "first_recv_seq": min(seqs), "last_recv_seq": max(seqs)})
    return write(tmp_path / name, rows)


def test_segments_and_manifest(spark, tmp_path):
    good, bad = segment(tmp_path, "s0.ndjson", [1, 2, 3]), segment(tmp_path, "s1.ndjson", [4, 6, 5], 9)
    report = {r.path.rpartition("/")[2]: r.complete for r in tape.segment_report(tape.read_segments(spark, [good, bad])).collect()}
    assert report == {"s0.ndjson": True, "s1.ndjson": False}
    entry = {"path": "s0.ndjson", "file_sha256": hashlib.sha256(open(good, "rb").read()).hexdigest()}
    path = tmp_path / "manifest.json"
    path.write_text(json.dumps({"segments": [entry]}))
    assert tape.read_manifest(spark, str(path))[1].where("record = 'event'").count() == 3
    for wrong in ({**entry, "file_sha256": "0"}, {**entry, "path": "../s0.ndjson"}):
        path.write_text(json.dumps({"segments": [wrong]}))
        with pytest.raises(ValueError):
            tape.read_manifest(spark, str(path))


def test_bundles_are_audited(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", [1, 2]), (2, None, [])], "i long, s string, l array<long>")
    path = str(tmp_path / "bundle")
    manifest = bundle.write_bundle(spark, path, {"t": df}, {"n": 2})
    assert manifest["tables"]["t"]["rows"] == 2 and bundle.audit_bundle(spark, path) == []
    df.limit(1).write.mode("append").parquet(f"{path}/t")
    assert bundle.audit_bundle(spark, path) == ["t"]
    assert [tuple(r) for r in bundle.cells(df).orderBy("i").collect()] == [("1", "a", "[1,2]"), ("2", "", "[]")]
    assert {tuple(r) for r in bundle.counted(df, ["i"]).collect()} == {(1, 1), (2, 1), (None, 2)}
    bundle.write_csv(df, str(tmp_path / "csv"))
    assert sorted(map(tuple, tape.read_audit(spark, str(tmp_path / "csv"), "i long, s string, l array<long>").collect())) == [(1, "a", [1, 2]), (2, None, [])]
    bundle.write_jsonl(df, str(tmp_path / "json"), "gzip")
    bundle.discard(df)
    assert bundle.digest(df) == bundle.digest(df.repartition(3))


def test_validation_knows_types(spark, tmp_path):
    cap = lambda **c: {**DEPTH, "data": {**DEPTH["data"], "_capture": c}}
    depth = lambda **d: {**DEPTH, "data": {"U": 4, "u": 5, "b": [], "a": [], **d}}
    event = lambda **d: {"ts_local": 1, "symbol": "*", "type": "captureEvent", "data": {"event": "x", "route": "r", **d}}
    cases = [
        ({**TRADE, "data": {**TRADE["data"], "m": "true"}}, ["aggTrade"]),
        ({**TRADE, "data": {**TRADE["data"], "p": "nan"}}, ["aggTrade"]),
        ({**TRADE, "data": {**TRADE["data"], "p": "-1", "q": 0.5}}, []),
        (depth(pu=-5), ["depthUpdate"]), (depth(pu="abc"), ["depthUpdate"]), (depth(pu=None), ["depthUpdate"]), (depth(U="4", pu="3"), []), (depth(U=True), ["depthUpdate"]), (depth(U=6), ["depthUpdate"]),
        (depth(b=[["1"]]), ["depthUpdate"]), (depth(b=[["1", "2", "more"]]), []), (depth(b=[["1", "x"]]), ["depthUpdate"]), (depth(b={}), ["depthUpdate"]), (depth(a=[None]), ["depthUpdate"]),
        (cap(route=""), ["route"]), (cap(recvSeq="7"), ["recvSeq"]), (cap(recvSeq=7.0), ["recvSeq"]), (cap(recvSeq=-7), ["recvSeq"]), (cap(syncEpoch=None), ["syncEpoch"]), (cap(recvWallNs=10**24), []),
        (cap(snapshotAccepted="yes"), ["snapshotAccepted"]), (cap(snapshotAccepted=False, reason="", validationError="e"), []), (cap(reason=3), ["reason"]), ({**DEPTH, "data": {**DEPTH["data"], "_capture": 3}}, ["_capture"]),
        ({**INFO, "data": {**INFO["data"], "other": {"recvSeq": "x"}, "_capture": {"recvSeq": 4}}}, []),
        ({**INFO, "data": {**INFO["data"], "venue": 3}}, ["exchangeInfo"]), ({**INFO, "data": {"tickSize": "0.1"}}, ["exchangeInfo"]),
        (event(), []), (event(event=""), ["captureEvent"]), (event(route=3), ["captureEvent"]), (event(reason=1), ["captureEvent"]),
        ({**META, "data": {"schemaVersion": "3"}}, ["captureMeta"]), ({**META, "symbol": " "}, ["symbol"]), ({**META, "symbol": 3}, ["symbol"]), ({**META, "ts_local": "5.5"}, []), ({**META, "ts_local": "inf"}, ["ts_local"]), ({**META, "data": []}, ["data"]),
    ]
    path = write(tmp_path / "t.ndjson", [row for row, _ in cases])
    found = {r.line: r.reasons for r in tape.validate(tape.read_lines(spark, path)).collect()}
    assert [(i, found[i + 1]) for i in range(len(cases))] == [(i, wanted) for i, (_, wanted) in enumerate(cases)]


def test_manifests_are_held_against_their_segments(spark, tmp_path):
    paths = [segment(tmp_path, "s0.ndjson", [1, 2, 3]), segment(tmp_path, "s1.ndjson", [4, 6])]
    report = tape.segment_report(tape.read_segments(spark, paths))
    entries = [{"path": "s0.ndjson", "count": 3, "first_recv_seq": 1, "last_recv_seq": 3}, {"path": "s1.ndjson", "count": 2, "first_recv_seq": 4, "last_recv_seq": 6}]

    def signed(**changes):
        m = {"capture_id": "c", "segments": entries, "segment_count": 2, "event_count": 5, "first_recv_seq": 1, "last_recv_seq": 6, **changes}
        return {**m, "manifest_sha256": hashlib.sha256(json.dumps(m, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()}

    assert tape.manifest_issues(signed(), report) == []
    assert tape.manifest_issues({**signed(), "event_count": 6}, report) == ["manifest_sha256", "event_count"]
    assert tape.manifest_issues(signed(capture_id="", segment_count=3), report) == ["capture_id", "segment_count"]
    assert tape.manifest_issues(signed(segments=entries[::-1], first_recv_seq=4, last_recv_seq=3), report) == ["order s0.ndjson"]
    assert tape.manifest_issues(signed(segments=[entries[0], {**entries[1], "count": 9}], capture_runtime={"writer": {"complete": False}}), report) == ["writer", "segment s1.ndjson", "event_count", "recv_seq"]


@pytest.mark.parametrize("kind", ["parquet", "csv", "jsonl"])
def test_bundles_of_every_format_are_audited(spark, tmp_path, kind):
    df = spark.createDataFrame([(1, "a", [1, 2], 0.5), (2, None, [], None)], "i long, s string, l array<long>, d double")
    path = str(tmp_path / "bundle")
    bundle.write_bundle(spark, path, {"t": df}, {"n": 2}, kind)
    assert bundle.audit_bundle(spark, path) == []
    {"parquet": bundle.write_parquet, "csv": bundle.write_csv, "jsonl": bundle.write_jsonl}[kind](df.limit(1), f"{path}/t/more")
    import glob
    import shutil

    for file in glob.glob(f"{path}/t/more/part*"):
        shutil.move(file, f"{path}/t/")
    shutil.rmtree(f"{path}/t/more")
    assert bundle.audit_bundle(spark, path) == ["t"]
