"""Books and equity at every event, books in synchrony with snapshots, and exact units."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tidemark.functions import ticks
from tidemark.operators import book, fills
from tidemark.sinks import capture
from tidemark.sources import tape
from tidemark.streaming import book as stream_book
from tidemark.streaming import depth


class Plain:
    """A synchronizer with a copied dictionary a side, by the rules as they are told."""

    def __init__(self, most):
        self.most, self.epoch, self.gaps, self.wait = most, 0, 0, []
        self.base = self.at = None
        self.sides = {"bid": {}, "ask": {}}

    def restart(self, first=None, gap=1):
        self.epoch += 1
        self.gaps += gap
        self.base = self.at = None
        self.wait = [first] if first else []
        self.sides = {"bid": {}, "ask": {}}

    def staged(self, levels):
        new = {s: dict(x) for s, x in self.sides.items()}
        changes = []
        for side, tick, lots in levels:
            if tick is None or lots is None or tick <= 0 or lots < 0:
                return None
            old = new[side].get(tick, 0)
            new[side][tick] = lots
            if not lots:
                del new[side][tick]
            if old != lots:
                changes.append((side, tick, old, lots))
        if new["bid"] and new["ask"] and max(new["bid"]) >= min(new["ask"]):
            return None
        self.sides = new
        return changes

    def told(self, seq, applied, reason, changes=()):
        bids, asks = self.sides["bid"], self.sides["ask"]
        return (seq, self.epoch, self.gaps, self.at is not None, applied, reason, max(bids, default=None), min(asks, default=None), len(bids) + len(asks), [tuple(c) for c in changes])

    def take(self, seq, kind, first, last, previous, levels):
        if kind == "snapshot":
            usable = [w for w in self.wait if w[2] >= last]
            if usable and not usable[0][1] <= last <= usable[0][2]:
                self.gaps += 1
                self.base = self.at = None
                self.sides = {"bid": {}, "ask": {}}
                return [self.told(seq, False, "snapshot_gap")]
            chain = []
            for w in usable:
                if chain and w[2] <= chain[-1][2]:
                    continue
                if chain and w[3] != chain[-1][2]:
                    self.restart()
                    return [self.told(seq, False, "buffer_gap")]
                chain.append(w)
            self.sides = {"bid": {}, "ask": {}}
            changes = self.staged([x for x in levels if x[2] is None or x[2] > 0])
            if changes is None:
                self.restart()
                return [self.told(seq, False, "invalid_snapshot")]
            self.base, self.at, self.wait = last, None, []
            out = [self.told(seq, True, "", changes)]
            for w in chain:
                changes = self.staged(w[4])
                if changes is None:
                    self.restart()
                    return [self.told(seq, False, "invalid_book_update")]
                self.at = w[2]
                out.append(self.told(w[0], True, "replayed", changes))
            return out
        own = (seq, first, last, previous, levels)
        if min(first, last, previous) < 0 or first > last:
            self.restart()
            return [self.told(seq, False, "invalid_ids")]
        if self.base is None:
            if len(self.wait) == self.most:
                self.restart(gap=0)
                return [self.told(seq, False, "buffer_overflow")]
            self.wait.append(own)
            return [self.told(seq, False, "no_snapshot")]
        if self.at is None and last < self.base:
            return [self.told(seq, False, "before_snapshot")]
        if self.at is None and first > self.base:
            self.restart(own)
            return [self.told(seq, False, "no_bridge")]
        if self.at is not None and last <= self.at:
            return [self.told(seq, False, "stale")]
        if self.at is not None and previous != self.at:
            self.restart(own)
            return [self.told(seq, False, "gap")]
        changes = self.staged(levels)
        if changes is None:
            self.restart()
            return [self.told(seq, False, "invalid_book_update")]
        self.at = last
        return [self.told(seq, True, "", changes)]


def random_depth(seed, n=1200, symbols="ABC"):
    rng, rows, at = random.Random(seed), [], {}

    def levels(k):
        out = [(side, (50 if side == "bid" else 51) + (-1 if side == "bid" else 1) * rng.randrange(12), rng.randrange(4)) for side in rng.choices(("bid", "ask"), k=k)]
        if rng.random() < 0.02:
            out.append(rng.choice([("bid", 80, 1), ("ask", 20, 2), ("bid", 0, 1), ("ask", 60, -1), ("ask", None, 1), ("bid", 40, None)]))
        return out

    for seq in range(n):
        symbol = rng.choice(symbols)
        last = at.get(symbol, 10)
        if rng.random() < 0.1:
            rows.append((symbol, seq, "snapshot", 0, max(0, last - rng.randrange(-4, 25)), 0, levels(6)))
            continue
        size, draw = rng.randrange(1, 6), rng.random()
        first, end, before = last + 1 - rng.randrange(3), last + size, last
        if draw < 0.03:
            first, end, before = last - 3, last - 2, last - 4
        elif draw < 0.05:
            before = last - 1
        elif draw < 0.06:
            before = -1
        elif draw < 0.07:
            first = end + 1
        rows.append((symbol, seq, "depth", first, end, before, levels(rng.randrange(1, 4))))
        at[symbol] = max(last, end)
    return rows


def wanted(rows, most=20_000):
    machines, out = {}, []
    for symbol, *row in rows:
        out += [(symbol, *x) for x in machines.setdefault(symbol, Plain(most)).take(*row)]
    return out


def as_rows(df):
    return [(*r[:-1], [tuple(c) for c in r[-1]]) for r in df.collect()]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_books_of_random_tapes_equal_a_plain_machine(spark, seed):
    rows = random_depth(seed)
    found = as_rows(depth.synchronize_table(spark.createDataFrame(rows, depth.DEPTH).repartition(4)))
    assert sorted(found, key=str) == sorted(wanted(rows), key=str)
    assert {r[6] for r in found} >= {"", "replayed", "no_snapshot", "gap", "invalid_book_update", "invalid_ids", "stale"}


def test_a_full_buffer_starts_an_epoch(spark):
    rows = [("A", i, "depth", i, i, max(0, i - 1), []) for i in range(9)]
    assert sorted(as_rows(depth.synchronize_table(spark.createDataFrame(rows, depth.DEPTH), most=3)), key=str) == sorted(wanted(rows, 3), key=str)


def test_a_stream_keeps_levels_and_buffers_between_batches(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", depth.STATE_STORE)
    try:
        rows = random_depth(4, 500, "AB")
        source, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
        for part in (rows[:150], rows[150:300], rows[300:]):
            spark.createDataFrame(part, depth.DEPTH).coalesce(1).write.mode("append").parquet(source)
            stream_book.run_once(depth.synchronize(spark.readStream.schema(depth.DEPTH).parquet(source)), out, mark)
        assert sorted(as_rows(spark.read.parquet(out)), key=str) == sorted(wanted(rows), key=str)
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_previous_ids_below_zero_are_refused():
    from types import SimpleNamespace

    state, told = stream_book.step((0, 0, 5, 3, True, []), SimpleNamespace(seq=1, kind="depth", first_id=6, last_id=7, previous_id=-1))
    assert told == [(1, False, "invalid_ids")] and state == (1, 1, -1, -1, False, [])


def random_levels(seed, n):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        symbol = "hot" if rng.random() < 0.8 else rng.choice("xyz")
        for tick in rng.sample(range(1, 40), rng.randrange(1, 4)):
            rows.append((symbol, rng.choice(("bid", "ask")), tick, i // 3, i, rng.choice((0, 0, 1, 2, 5))))
    return rows


@pytest.mark.parametrize("slot_rows", [1, 7, 100_000])
def test_book_path_equals_books_that_are_replayed(spark, slot_rows):
    rows = random_levels(3, 600)
    df = spark.createDataFrame([*rows, (None, "bid", 1, 1, 1, 1), ("x", "bid", None, 1, 1, 1), ("x", "bid", 3, 1, 1, None), ("x", "mid", 3, 1, 1, 1)], "symbol string, side string, tick long, ns long, seq long, lots long")
    found = {(r.symbol, r.seq): tuple(r)[3:] for r in book.path(df, slot_rows=slot_rows).collect()}
    live, want = {}, {}
    for symbol, side, tick, _, seq, lots in rows:
        levels = live.setdefault(symbol, {"bid": {}, "ask": {}})
        levels[side][tick] = lots
        bids, asks = ({t: q for t, q in levels[s].items() if q} for s in ("bid", "ask"))
        bid, ask = max(bids, default=None), min(asks, default=None)
        want[symbol, seq] = (bid, ask, sum(bids.values()), sum(asks.values()), len(bids) + len(asks), None if None in (bid, ask) else (bid + ask) / 2)
    assert found == want


def test_book_path_of_no_rows(spark):
    assert book.path(spark.createDataFrame([], "symbol string, side string, tick long, ns long, seq long, lots long")).count() == 0


def test_equity_at_every_mark(spark):
    rng = random.Random(8)
    rows = [(rng.choice("AAB"), i * 10, i, rng.choice((-3, -2, -1, 0, 1, 2, 4)), rng.randrange(90, 110)) for i in range(400)]
    marks = [(rng.choice("ABC"), i * 7, i, None if rng.random() < 0.1 else rng.randrange(180, 220) / 2) for i in range(500)]
    path = fills.position_path(spark.createDataFrame([*rows, ("A", 5, 999, None, 3)], "symbol string, ns long, seq long, lots long, tick long"))
    states, held = {}, {}
    for symbol, ns, seq, q, tick in rows:
        lots, cost, realized = held.get(symbol, (0, 0, 0))
        for _ in range(abs(q)):  # a lot at a time, the closed share of the basis at the end
            pass
        closed = min(abs(lots), abs(q)) if lots * q < 0 else 0
        part = cost if closed == abs(lots) else int(abs(cost) * closed // abs(lots)) * (1 if cost > 0 else -1 if cost < 0 else 0)
        sign = 1 if lots > 0 else -1 if lots < 0 else 0
        held[symbol] = (lots + q, cost - part + (q + sign * closed) * tick, realized + sign * closed * tick - part)
        states[symbol, seq] = (ns, *held[symbol])
    assert {(r.symbol, r.seq): (r.ns, r.position, r.cost, r.realized) for r in path.collect()} == states
    found = {(r.symbol, r.seq): r for r in fills.equity_path(path, spark.createDataFrame(marks, "symbol string, ns long, seq long, mid double")).collect()}
    peaks = {}
    for symbol, ns, seq, mid in marks:
        lots, cost, realized = max((v for k, v in states.items() if k[0] == symbol and v[0] <= ns), default=(0, 0, 0, 0))[1:]
        equity = realized if lots == 0 else None if mid is None else realized + lots * mid - cost
        peaks[symbol] = max(peaks.get(symbol, 0), equity or 0)
        r = found[symbol, seq]
        assert (r.position, r.equity, r.peak, r.drawdown) == (lots, equity, peaks[symbol], None if equity is None else peaks[symbol] - equity)
    assert len(found) == len(marks)


def test_prices_off_the_grid_are_not_rounded_onto_it(spark):
    lines = [
        '{"ts_local": 1, "type": "exchangeInfo", "symbol": "A", "data": {"tickSize": "0.1", "stepSize": "0.001"}}',
        '{"ts_local": 2, "type": "aggTrade", "symbol": "A", "data": {"p": "100.00000000004", "q": "1", "m": true}}',
        '{"ts_local": 3, "type": "aggTrade", "symbol": "A", "data": {"p": "100.1", "q": "0.0010000000001", "m": true}}',
        '{"ts_local": 4, "type": "depthUpdate", "symbol": "A", "data": {"U": 1, "u": 2, "pu": 0, "b": [["99.90000000000001", "1"]], "a": [["100.2", "2"]]}}',
    ]
    rows = spark.createDataFrame([(x,) for x in lines], "value string").select(F.lit("f").alias("path"), F.monotonically_increasing_id().alias("line"), "value")
    normal = tape.normalize(rows.withColumn("reasons", F.array().cast("array<string>")))
    specs = tape.specs(normal)
    assert sorted((r.tick, r.lots) for r in tape.trades(normal, specs).collect() if r.tick is not None) == [(1001, None)]
    assert tape.trades(normal, specs).where("tick IS NULL").count() == 1
    assert {(r.side, r.tick, r.lots) for r in tape.depth_levels(normal, specs).collect()} == {("bid", None, 1000), ("ask", 1002, 2000)}


def test_prices_of_ticks_are_exact(spark):
    df = spark.createDataFrame([(123456789012, "0.00000001"), (3, "12.000000000000000001"), (-7, "0.5"), (None, "1"), (2**62, "99999999999")], "n long, u string")
    found = [r[0] for r in df.select(ticks.from_units(F.col("n"), F.col("u"))).collect()]
    assert found == [Decimal("1234.56789012"), Decimal("36.000000000000000003"), Decimal("-3.5"), None, None]


def test_quotes_are_placed_anew(spark):
    rows = [(True, "a", "a", 1), (True, "a", "b", 1), (False, "a", "b", 1), (False, "a", "a", 9), (True, None, "b", 99)]
    df = spark.createDataFrame(rows, "layered boolean, own string, target string, ahead long")
    assert [r[0] for r in df.select(ticks.needs_refresh(F.col("layered"), F.col("own"), F.col("target"), F.col("ahead"), 5)).collect()] == [False, True, False, True, False]


def test_returns_of_prices_of_zero_are_null(spark):
    df = spark.createDataFrame([(0, 5), (5, 0), (4, 5), (None, 5)], "a long, b long")
    assert [tuple(r) for r in df.select(ticks.absolute_return(F.col("a"), F.col("b")), ticks.log_return(F.col("a"), F.col("b")).isNull()).collect()] == [(None, True), (1.0, True), (0.25, False), (None, True)]


def test_a_failure_names_all_causes_and_members(spark, tmp_path):
    error = None
    for i in range(30):
        cause, error = error, KeyError(i) if i % 2 else OSError(i)
        error.__cause__ = cause
    group = ExceptionGroup("several", [ValueError("x"), error])
    error.__context__ = group  # a ring
    report = capture.write_failure(spark, str(tmp_path / "c"), "c", group, failed_wall_ns=1)
    assert report["failure_types"][0] == "ExceptionGroup" and len(report["failure_types"]) == 32
    assert "ValueError" in report["failure_types"] and report["failure_types"].count("KeyError") == 15
