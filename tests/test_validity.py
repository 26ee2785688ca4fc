import json
import random

from pyspark.sql import Row

from tidemark.operators import book, validity
from tidemark.sinks import bundle

SCHEMA = (
    "path string, source_row_seq long, symbol string, route string, kind string, event string, recv_seq long, recv_monotonic_ns long, "
    "stream_epoch long, sync_epoch long, snapshot_accepted boolean"
)


class Machine:
    """The reducer as a plain state machine, row by row."""

    def __init__(self):
        self.capture, self.clock, self.seq, self.mono, self.symbols = True, True, None, None, {}

    def observe(self, r):
        if r.recv_seq is None or r.recv_monotonic_ns is None or not r.route:
            self.capture = False
        else:
            if self.seq is not None and r.recv_seq != self.seq + 1:
                self.capture = False
            self.seq = r.recv_seq if self.seq is None else max(self.seq, r.recv_seq)
            if self.mono is not None and r.recv_monotonic_ns < self.mono:
                self.clock = False
            self.mono = r.recv_monotonic_ns if self.mono is None else max(self.mono, r.recv_monotonic_ns)
        if r.event in ("parse_failure", "overflow", "writer_failure", "capture_abort"):
            self.capture = False
        if r.symbol in (None, "", "*"):
            return self.capture, self.clock, None, None
        s = self.symbols.setdefault(r.symbol, {"public": False, "market": False, "e_public": None, "e_market": None, "sync": None})
        before = dict(s)
        if r.route in ("public", "market"):
            if r.stream_epoch is not None:
                if s["e_" + r.route] not in (None, r.stream_epoch):
                    s[r.route] = False
                s["e_" + r.route] = r.stream_epoch
            if r.route == "public" and r.sync_epoch is not None:
                if s["sync"] not in (None, r.sync_epoch):
                    s["public"] = False
                s["sync"] = r.sync_epoch
            if r.event in ("disconnect", "connect_failure", "parse_failure", "overflow"):
                s[r.route] = False
            if r.event in ("connect", "reconnect"):
                s[r.route] = True
        rejected = r.kind == "snapshot" and r.snapshot_accepted is False
        if rejected:
            s["public"] = False
        elif r.kind in ("depthUpdate", "snapshot") and (before["public"] or before["e_public"] is None):
            s["public"] = True
        elif r.kind == "aggTrade" and (before["market"] or before["e_market"] is None):
            s["market"] = True
        return self.capture, self.clock, s["public"], s["market"]


def test_routes_equal_a_state_machine(spark):
    rng, rows = random.Random(5), []
    for path in ("a", "b", "c", None):
        for n in range(250):
            kind = rng.choice(["depthUpdate", "snapshot", "aggTrade", "captureEvent"])
            route = {"aggTrade": "market", "captureEvent": rng.choice(["public", "market", "", None] if n > 200 else ["public", "market"])}.get(kind, "public")
            events = ["disconnect", "connect", "reconnect", "connect_failure", "note", None] + (["overflow", "capture_abort"] if n > 180 else [])
            rows.append((
                path, n * 1000, rng.choice(["x", "y", "*", None]), route, kind, rng.choice(events) if kind == "captureEvent" else None,
                n if n < 120 or rng.random() < 0.98 else rng.choice([None, n - 9, n + 2]), n * 10 - (40 if n > 150 and rng.random() < 0.02 else 0),
                rng.choice([None, n // 60]), rng.choice([None, None, n // 80]), rng.choice([True, True, None, False]) if kind == "snapshot" else None,
            ))
    found = validity.routes(spark.createDataFrame(rows, SCHEMA)).orderBy("path", "source_row_seq").collect()
    machines, names = {}, ("capture_valid", "clock_valid", "depth_valid", "trade_valid")
    assert len(found) == len(rows)
    for r in found:
        wanted = machines.setdefault(r.path, Machine()).observe(r)
        assert tuple(r[n] for n in names) == wanted, r
        changed = any(b.kind == "recovered" for b in r.boundaries)
        assert not changed or True in (r.depth_valid, r.trade_valid)
    assert {r.depth_valid for r in found} == {True, False, None} and {r.capture_valid for r in found} == {True, False}


def test_routes_of_nothing_and_a_clean_capture(spark):
    clean = [("a", 0, "x", "public", "snapshot", None, 1, 10, 1, 1, True), ("a", 1, "x", "market", "aggTrade", None, 2, 20, 1, None, None)]
    trailer = ("a", 2, "*", "public", "captureEvent", "capture_trailer", 3, 30, None, None, None)
    for rows, ready in ((clean + [trailer], True), (clean, False), (clean[:1] + [trailer], False)):
        assert validity.verdict(validity.routes(spark.createDataFrame(rows, SCHEMA))).first().claim_ready is ready
    assert validity.routes(spark.createDataFrame([], SCHEMA)).count() == 0


def test_queue_lives(spark):
    rows = [
        (1, "place", 1, 2, 3), (2, "place", 2, 0, 4), (3, "place", 1, 0, 1), (4, "consume", None, None, 4), (5, "cancel", 1, None, None), (6, "cancel", 1, None, None),
        (7, "cancel", 9, None, None), (8, "consume", None, None, 9), (9, "place", 3, -1, 1), (10, "place", 3, 0, 2), (11, "invalidate", None, None, None),
        (12, "cancel", 3, None, None), (13, "consume", None, None, 5), (14, "place", 3, 0, 2), (15, "consume", None, None, 0), (16, "place", None, 0, 1), (17, None, 4, 0, 1),
    ]
    df = spark.createDataFrame([Row(symbol=1, side="bid", tick=5, ns=n, seq=n, action=a, order_id=o, ahead=h, lots=q) for n, a, o, h, q in rows], "symbol long, side string, tick long, ns long, seq long, action string, order_id long, ahead long, lots long")
    found = {r.seq: (r.reason, [tuple(f) for f in r.filled], r.unused) for r in book.queue_lives(df).collect()}
    refused = {3: "duplicate_order_id", 6: "order_not_live", 7: "unknown_order", 9: "invalid_queue_ahead", 12: "order_not_live", 14: "duplicate_order_id", 15: "invalid_consumption", 16: "invalid_order_id", 17: "unknown_action"}
    assert {s: f[0] for s, f in found.items() if f[0]} == refused
    assert found[4][1:] == ([(1, 2)], 0) and found[8][1:] == ([(2, 4)], 5) and found[13][1:] == ([], 5)


def test_queue_lives_without_cancels_equal_queue_fills(spark):
    rng, rows, ahead = random.Random(2), [], {}
    for n in range(1, 300):
        level, lots, rests = (rng.randrange(2), "ask", rng.randrange(3)), rng.randrange(1, 8), rng.random() < 0.6
        rows.append((*level, n, n, "place" if rests else "consume", n if rests else None, 0 if rests else None, lots))
    df = spark.createDataFrame(rows, "symbol long, side string, tick long, ns long, seq long, action string, order_id long, ahead long, lots long").cache()
    for r in book.queue_lives(df).collect():
        for f in r.filled:
            ahead[f.order_id] = ahead.get(f.order_id, 0) + f.lots
    kept = ["symbol", "side", "tick", "ns", "seq", "lots"]
    for r in book.queue_fills(df.where("action = 'place'").select(*kept), df.where("action = 'consume'").select(*kept)).collect():
        assert ahead.get(r.seq, 0) == r.filled


def test_summary_against_its_csv(spark, tmp_path):
    summary = {"run_id": "r,1", "fills": 3, "quotes": 4, "counts": {"a": [1, "x\ny"]}}
    row = [("r,1", "3", "five", json.dumps({"a": [1, "x\ny"]}))]
    spark.createDataFrame(row, "run_id string, fills string, quotes string, counts string").coalesce(1).write.csv(f"{tmp_path}/s", header=True, escape='"')
    asked = {"texts": ["run_id"], "counts": ["fills", "quotes"], "documents": ["counts", "gone"]}
    assert bundle.summary_issues(spark, f"{tmp_path}/s", summary, **asked) == ["quotes", "gone"]
    spark.createDataFrame(row * 2, "run_id string, fills string, quotes string, counts string").coalesce(1).write.csv(f"{tmp_path}/two", header=True, escape='"')
    assert bundle.summary_issues(spark, f"{tmp_path}/two", summary, **asked) == ["rows"]
