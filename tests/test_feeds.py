"""Feed adapters against tapes, and lines that can't be read."""

import json

from tests.conftest import SF, same
from tests.test_sources import DEPTH, INFO, META, SNAP, TRADE
from tidemark.plans import catalogue, feeds as plans
from tidemark.sources import feeds, tape


def lines(spark, rows):
    return spark.createDataFrame([("f", i + 1, r if isinstance(r, str) else json.dumps(r)) for i, r in enumerate(rows)], tape.LINE)


def test_queries_match_their_sql(spark, duck):
    for name in ("feed_levels_and_trades", "feed_rejections"):
        same(catalogue.QUERIES[name](spark, SF).toPandas(), duck.execute(catalogue.ORACLES[name]).df())


def test_default_adapter_reads_tapes_as_they_are(spark):
    rows = lines(spark, [META, INFO, SNAP, DEPTH, TRADE])
    read, plain = feeds.read_feed(rows, feeds.TAPE), tape.normalize(tape.validate(rows))
    specs = tape.specs(plain)
    assert sorted(read.records.collect()) == sorted(plain.collect()) and read.rejected.count() == 0
    assert sorted(read.levels.collect()) == sorted(tape.depth_levels(plain, specs).collect()) and read.levels.count() == 4
    assert read.trades.collect() == tape.trades(plain, specs).collect()
    assert [r.venue for r in read.instruments.collect()] == ["tape"]


def test_a_venue_that_is_told_stays(spark):
    info = {**INFO, "data": {**INFO["data"], "venue": "OWN"}}
    assert feeds.read_feed(lines(spark, [info]), feeds.TAPE).instruments.first().venue == "OWN"
    assert feeds.read_feed(lines(spark, [{**INFO, "data": {**INFO["data"], "venue": " "}}]), feeds.TAPE).instruments.first().venue == "tape"


def test_rejections_keep_the_line_and_name_the_reason(spark):
    good = {"ch": "print", "sym": "X", "at": 1500, "px": "1.25", "sz": "2", "taker": "sell"}
    bad = ["{no", {**good, "ch": "other"}, {**good, "px": "x"}, {**good, "sym": " "}, {k: v for k, v in good.items() if k != "at"}, {**good, "taker": None}]
    read = feeds.read_feed(lines(spark, [good, *bad]), plans.FLAT)
    found = {r.line: (r.value, r.reasons) for r in read.rejected.collect()}
    assert {n: why for n, (_, why) in found.items()} == {2: ["unread"], 3: ["unread"], 4: ["aggTrade"], 5: ["symbol"], 6: ["ts_local"], 7: ["aggTrade"]}
    assert found[2][0] == "{no" and json.loads(found[3][0])["ch"] == "other"
    assert [(r.symbol, r.recv_monotonic_ns, r.source_row_seq) for r in read.records.collect()] == [("X", 1_500_000_000, 1)]


def test_types_that_an_adapter_does_not_support(spark):
    quotes = feeds.FeedAdapter("quotes", "Q", frozenset({"exchangeInfo", "snapshot", "depthUpdate"}))
    read = feeds.read_feed(lines(spark, [META, INFO, SNAP, TRADE]), quotes)
    assert [(r.line, r.reasons) for r in read.rejected.collect()] == [(4, ["unsupported"])] and read.trades.count() == 0
    assert quotes.describe() == {"name": "quotes", "venue_label": "Q", "supported_record_types": ["depthUpdate", "exchangeInfo", "snapshot"]}


def test_empty_feed(spark):
    read = feeds.read_feed(lines(spark, [META]).limit(0), plans.FLAT)
    assert not any(df.count() for df in (read.records, read.rejected, read.instruments, read.levels, read.trades))
