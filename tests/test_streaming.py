from tidemark.streaming import book, windows
from tests.conftest import SF


def test_synchronizer_as_a_stream(spark, tmp_path):
    rows = [
        ("A", 0, "depth", 1, 5, 0), ("A", 1, "snapshot", 0, 10, 0), ("A", 2, "depth", 3, 9, 2), ("A", 3, "depth", 8, 12, 7), ("A", 4, "depth", 13, 14, 12),
        ("A", 5, "depth", 10, 12, 9), ("A", 6, "depth", 20, 22, 19), ("A", 7, "depth", 23, 24, 22), ("A", 8, "snapshot", 0, 30, 0), ("A", 9, "depth", 29, 31, 28), ("B", 1, "depth", 5, 4, 0),
    ]
    spark.createDataFrame(rows, book.UPDATES).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(book.UPDATES).parquet(str(tmp_path / "in"))
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    book.run_once(book.synchronize(stream), out, mark)
    found = {(r.symbol, r.seq): (r.epoch, r.applied, r.reason) for r in spark.read.parquet(out).collect()}
    assert found[("A", 0)] == (0, False, "no_snapshot") and found[("A", 1)] == (0, True, "")
    assert found[("A", 2)] == (0, False, "before_snapshot") and found[("A", 3)][1] and found[("A", 4)][1]
    assert found[("A", 5)] == (0, False, "stale") and found[("A", 6)] == (1, False, "gap") and found[("A", 7)] == (1, False, "no_snapshot")
    assert found[("A", 8)][1] and found[("A", 9)] == (1, True, "") and found[("B", 1)] == (1, False, "invalid_ids")
    # what comes later goes on from the state
    spark.createDataFrame([("A", 10, "depth", 32, 33, 31)], book.UPDATES).write.mode("append").parquet(str(tmp_path / "in"))
    book.run_once(book.synchronize(spark.readStream.schema(book.UPDATES).parquet(str(tmp_path / "in"))), out, mark)
    assert {r.seq: r.applied for r in spark.read.parquet(out).where("symbol = 'A'").collect()}[10]


def test_windows_of_a_stream_equal_the_batch(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    from pyspark.sql import functions as F

    def plan(df, late=None):
        return windows.tumbling(windows.timed(df), "6 hours", ["event_type"], {"n": F.count("*")}, late=late)

    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    query = plan(stream, "30 days").writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(map(tuple, spark.table("w").collect())) == sorted(map(tuple, plan(events).collect()))


def test_synchronizer_over_a_table(spark):
    from tidemark.plans import catalogue

    rows = sorted(catalogue.book_sync(spark, SF).collect(), key=lambda r: (r.symbol, r.seq))
    assert rows and {r.reason for r in rows} >= {"", "no_snapshot", "invalid_ids"}
    for a, b in zip(rows, rows[1:]):
        if a.symbol == b.symbol:
            assert b.gaps - a.gaps == (b.reason in ("gap", "no_bridge", "invalid_ids")) and b.epoch >= a.epoch
            assert not b.synced or b.applied or b.reason == "stale"


class Machine:
    """The synchronizer in plain Python, a symbol each."""

    def __init__(self, most):
        self.most, self.waiting, self.base, self.at, self.epoch, self.gaps = most, [], None, None, 0, 0

    def restart(self, first=None, gap=True):
        self.epoch, self.gaps, self.base, self.at, self.waiting = self.epoch + 1, self.gaps + gap, None, None, [first] if first else []

    def take(self, seq, kind, first, last, before):
        if kind == "snapshot":
            usable = [w for w in self.waiting if w[2] >= last]
            if usable and not usable[0][1] <= last <= usable[0][2]:
                self.base, self.at, self.gaps = None, None, self.gaps + 1
                return [(seq, False, "snapshot_gap")]
            chain, out = None, []
            for w in usable:
                if chain is not None and w[2] <= chain:
                    continue
                if chain is not None and w[3] != chain:
                    self.restart()
                    return [(seq, False, "buffer_gap")]
                chain = w[2]
                out.append((w[0], True, "replayed"))
            self.base, self.at, self.waiting = last, chain, []
            return [(seq, True, ""), *out]
        own = (seq, first, last, before)
        if first < 0 or first > last:
            self.restart()
            return [(seq, False, "invalid_ids")]
        if self.base is None:
            if len(self.waiting) >= self.most:
                self.restart(gap=False)
                return [(seq, False, "buffer_overflow")]
            self.waiting.append(own)
            return [(seq, False, "no_snapshot")]
        if self.at is None:
            if last < self.base:
                return [(seq, False, "before_snapshot")]
            if first > self.base:
                self.restart(own)
                return [(seq, False, "no_bridge")]
        elif last <= self.at:
            return [(seq, False, "stale")]
        elif before != self.at:
            self.restart(own)
            return [(seq, False, "gap")]
        self.at = last
        return [(seq, True, "")]


def random_updates(seed, n=1500):
    import random

    rng, rows, at = random.Random(seed), [], {}
    for seq in range(n):
        symbol = rng.choice("ABC")
        last = at.get(symbol, 10)
        if rng.random() < 0.08:
            rows.append((symbol, seq, "snapshot", 0, max(0, last - rng.randrange(-4, 25)), 0))
            continue
        if rng.random() < 0.05:
            rows.append((symbol, seq, "depth", last - 3, last - 2, last - 4))
            continue
        size = rng.randrange(1, 6)
        rows.append((symbol, seq, "depth", last + 1 - rng.randrange(3) if rng.random() < 0.97 else last + size + 3, last + size, last if rng.random() < 0.95 else last - 1))
        at[symbol] = last + size
    return rows


def test_synchronizer_equals_a_plain_machine(spark):
    rows = random_updates(5)
    machines, wanted = {}, []
    for symbol, *update in rows:
        m = machines.setdefault(symbol, Machine(book.BUFFER))
        for seq, applied, reason in m.take(*update):
            wanted.append((symbol, seq, m.epoch, m.gaps, m.at is not None, applied, reason))
    found = [tuple(r) for r in book.synchronize_table(spark.createDataFrame(rows, book.UPDATES).repartition(5)).collect()]
    assert sorted(found) == sorted(wanted)
    assert {r[-1] for r in found} >= {"", "no_snapshot", "replayed", "snapshot_gap", "buffer_gap", "gap", "before_snapshot", "stale"}


def test_synchronizer_overflows_into_a_new_epoch():
    from types import SimpleNamespace

    machine, state = Machine(3), book.START
    for symbol, seq, kind, first, last, before in (r for r in random_updates(9) if r[0] == "A"):
        state, told = book.step(state, SimpleNamespace(seq=seq, kind=kind, first_id=first, last_id=last, previous_id=before), 3)
        assert told == machine.take(seq, kind, first, last, before) and state[:2] == (machine.epoch, machine.gaps)


def test_synchronizer_keeps_its_buffer_between_batches(spark, tmp_path):
    rows = [r for r in random_updates(7, 300) if r[0] == "A"]
    source, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    for part in (rows[: len(rows) // 2], rows[len(rows) // 2 :]):
        spark.createDataFrame(part, book.UPDATES).coalesce(1).write.mode("append").parquet(source)
        book.run_once(book.synchronize(spark.readStream.schema(book.UPDATES).parquet(source)), out, mark)
    whole = book.synchronize_table(spark.createDataFrame(rows, book.UPDATES))
    assert sorted(map(tuple, spark.read.parquet(out).collect())) == sorted(map(tuple, whole.collect()))


def test_deduplicated_and_counted_streams(spark, tmp_path):
    from pyspark.sql import functions as F

    events = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.union(events.limit(50)).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    for name, query in (("once", book.deduplicated(stream, ["event_id"], "ts", "60 days")), ("counted", book.counts(stream, "ts", "60 days", "1 day"))):
        query.writeStream.format("memory").queryName(name).outputMode("append" if name == "once" else "complete").trigger(availableNow=True).start().awaitTermination()
    assert spark.table("once").count() == events.count()
    assert spark.table("counted").agg(F.sum("n")).first()[0] == events.count() + 50
