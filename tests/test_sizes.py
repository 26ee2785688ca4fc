"""What only larger tables have: sums beyond 64 bits, ties, and work that must not grow beside the rows."""

import datetime
import itertools

import duckdb
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF, same
from tests.test_records import canonical, event_of
from tests.test_trace import faults
from tidemark.functions import hashing
from tidemark.operators import research
from tidemark.plans import catalogue, feeds
from tidemark.sinks import capture
from tidemark.sources import tape

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def held(spark, folder, rows):
    """Rows as the events of a folder, for queries and for their SQL."""
    spark.createDataFrame(rows, EVENTS).coalesce(1).write.parquet(f"{folder}/events.parquet")
    con = duckdb.connect()
    con.execute(f"SET timezone = 'UTC'; CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet/*.parquet'")
    return con


def test_lags_whose_sum_is_beyond_64_bits(spark, tmp_path):
    day = lambda year, n: datetime.datetime(year, 1, n)
    rows = [(n, day(1971, n + 1), 1, "purchase", 1.25, f'{{"k": {n}}}') for n in range(4)] + [(9, day(2250, 1), 1, "view", 2.5, '{"k": 3}')]
    con = held(spark, tmp_path, rows)
    found = catalogue.QUERIES["markout_horizons"](spark, str(tmp_path)).toPandas()
    same(found, con.execute(catalogue.ORACLES["markout_horizons"]).df())
    assert (found.mean_lag_ns > 8 * 10**18).all() and (found.resolved == 4).all()


def test_sizes_on_either_side_of_the_median_in_any_order_of_rows(spark):
    rows = [(38, "C1", m, False, 1) for m in (16116, 14296)]
    for order in itertools.permutations(rows):
        fills = spark.createDataFrame([("S", *r) for r in order], "symbol string, step long, contract string, markout long, toxic boolean, hedge_qty long").coalesce(1)
        assert research.worked_examples(fills, ["symbol"]).first().representative.markout == 14296


def test_rows_of_one_number_in_a_trace_are_taken_by_their_clock(spark):
    row = lambda seq, ns, order: [seq, "cancel", "S", order, ns, None, None, None, None, None, None]
    rows = [row(0, 0, 1), row(1, 10, 2), row(1, 5, 3), row(2, 12, 4)]
    for order in itertools.permutations(rows):
        found = faults(spark, order, 100_000)
        assert (1, "clock") not in found and (1, "sequence") in found


def test_a_filter_on_reasons_does_not_check_lines_again(spark):
    plan = feeds.feed_rejections(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.splitlines() if "Filter" in x and "variant" in x]


def test_lines_of_segments_are_made_once_for_a_report_of_recovery(spark):
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for rows in batches:
            made.add(len(rows))
            yield rows

    rows = [(p, i, i, canonical(event_of(i))) for p in range(3) for i in range(1, 21)]
    lines = capture.segment_lines(spark.createDataFrame(rows, "segment long, recv_seq long, recv_wall_ns long, event string"), "c")
    lines = spark.createDataFrame(lines.collect(), lines.schema).select(F.col("segment").cast("string").alias("path"), (F.col("place") + 1).alias("line"), "value")
    verified = tape.verify_segments(tape.segment_rows(lines.mapInPandas(count, "path string, line long, value string")))
    assert [r.recovered for r in tape.recovery_report(verified).collect()] == [20, 20, 20]
    assert made.value == 66


@pytest.mark.parametrize("stretch", [4, 100_000])
def test_a_report_of_recovery_counts_what_recovery_keeps(spark, monkeypatch, stretch):
    monkeypatch.setattr(tape, "STRETCH", stretch)
    rows = [(f"p{p}", i, i, canonical(event_of(i))) for p in range(25) for i in range(1, 21)]
    lines = capture.segment_lines(spark.createDataFrame(rows, "segment string, recv_seq long, recv_wall_ns long, event string"), "c").collect()
    hurt = lambda p, i, v: v.replace('"a":', '"a":9') if i == p or (p == 3 and i > 9) else v[:40] if i == p + 2 and p % 4 == 0 else v
    told = [(r.segment, r.place + 1, hurt(int(r.segment[1:]), r.place, r.value)) for r in lines if not (r.segment == "p7" and r.place == 0)]
    told += [("p24", 9, told[5][2])]
    verified = tape.verify_segments(tape.segment_rows(spark.createDataFrame(told, "path string, line long, value string")))
    kept = {r.path: (r.n, r.last) for r in tape.recover_segments(verified).groupBy("path").agg(F.count("*").alias("n"), F.max("recv_seq").alias("last")).collect()}
    wrong = {r.path: r.seq for r in verified.where(F.array_contains("reasons", "checksum")).groupBy("path").agg(F.min("recv_seq").alias("seq")).collect()}
    found = {r.path: ((r.recovered, r.last_seq), r.broken_at) for r in tape.recovery_report(verified).collect()}
    assert found == {p: (kept.get(p, (0, None)), wrong.get(p)) for p in {r[0] for r in told}}
    assert found["p5"] == ((4, 4), 5) and found["p7"][0] == (0, None) and found["p24"][0][0] < 20


def test_the_checksum_of_no_payload(spark):
    assert spark.range(1).select(hashing.payload_checksum(F.lit("null")).alias("c")).first().c == hashing.NO_PAYLOAD
