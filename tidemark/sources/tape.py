"""Recorded tapes: NDJSON lines, segments with header and trailer, manifests; validation as columns.

Nothing is dropped while reading: every line keeps its file, its number and the reasons for which it
is invalid, and callers choose to fail, to recover the valid prefix or to filter.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.hashing import payload_checksum
from ..functions.ticks import EXACT, decimal, time_key, to_units
from ..operators.audit import joined_hash
from ..operators.ordered import previous, running

#: The record types of a tape.
RECORD_TYPES = ("captureMeta", "captureEvent", "exchangeInfo", "snapshot", "depthUpdate", "aggTrade")
#: The columns of a normalized tape.
NORMALIZED = "source_row_seq long, symbol string, event_kind string, route string, recv_seq long, recv_wall_ns long, recv_monotonic_ns long, exchange_event_ns long, exchange_transaction_ns long, stream_epoch int, sync_epoch int, logical_time_source string, payload_checksum string, payload_json string, source_schema_version string"
LINE = "path string, line long, value string"
#: Fixed value: an event's line in a segment, fields in order of name.
EVENT_LINE = r'^\{"event":(.*),"payload_checksum":"[^"]*","record":"event","recv_seq":[0-9]+\}$'
#: Lines of a segment that are held against each other in one task.
STRETCH = 100_000


def read_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Lines of text files, plain or compressed, with path and line number from 1; blank lines are left out.

    Numbers come from each row's place in its file's scan. A file that is split is numbered by summing its
    splits' counts, so files of any size are read in parallel.
    """
    text = spark.read.text(paths).select(F.input_file_name().alias("path"), F.input_file_block_start().alias("start"), F.monotonically_increasing_id().alias("id"), "value")
    blocks = text.groupBy("path", "start").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = blocks.select("path", "start", "first", before.alias("before"))
    return text.join(offsets, ["path", "start"]).where(F.trim("value") != "").select("path", (F.col("before") + F.col("id") - F.col("first") + 1).alias("line"), "value")


def _get(path: str) -> Column:
    return F.get_json_object("value", f"$.{path}")


def _number(c: Column) -> Column:
    d = c.try_cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) < float("inf")), d)


def _kind(path: str, of: Column | str) -> Column:
    """JSON type at a path: BOOLEAN, STRING, BIGINT, DECIMAL(p,s), DOUBLE, OBJECT<...>, ARRAY<...>, VOID for null; null if there is nothing."""
    return F.schema_of_variant(F.try_variant_get(of, path, "variant"))


def _text(path: str, of: Column | str) -> Column:
    return F.try_variant_get(of, path, "string")


def _whole(text: Column) -> Column:
    """An integer from 0, as a number or as text."""
    return F.coalesce(text.rlike(r"^\s*\+?[0-9]+\s*$"), F.lit(False))


def _finite(text: Column) -> Column:
    """A finite decimal of any sign, as a number or as text."""
    return F.coalesce(text.rlike(r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"), F.lit(False))


def _levels_ok(path: str, of: Column) -> Column:
    """A list of levels, each a list that begins with a price and a quantity."""
    levels = F.try_variant_get(of, path, "array<variant>")
    pair = lambda v: F.try_variant_get(v, "$", "array<variant>")
    number = lambda v, i: _finite(F.try_variant_get(F.get(pair(v), i), "$", "string"))
    good = F.forall(levels, lambda v: F.coalesce(number(v, F.lit(0)) & number(v, F.lit(1)), F.lit(False)))
    return _kind(path, of).startswith("ARRAY") & good


def validate(lines: DataFrame) -> DataFrame:
    """Adds ``reasons``: the rules a line breaks, empty if it is valid.

    A record has ts_local (finite, from 0), symbol (not blank), type (one of RECORD_TYPES) and data, an object, which is checked by
    type. Ids are integers from 0, prices, quantities and sizes finite decimals, as numbers or text and of any sign: whether they are on a
    grid is for the conversion to ticks. Receipt metadata (`_capture`) must hold exact integers from 0, numbers and not text; its texts and flags must be of
    their types. A field that is null is there, and wrong. A line in which an object has a key twice is no JSON here.
    """
    # rows of generators, so that a filter on reasons doesn't read the line again; rules run over a variable, not as one method too long to compile
    read = lines.select("*", F.explode(F.array(F.try_parse_json("value"))).alias("_tm_json"))
    line = F.struct("value", F.col("_tm_json").alias("json"), F.coalesce(_text("$.type", "_tm_json"), F.lit("")).alias("kind"), _kind("$.data._capture", "_tm_json").alias("capture"))
    return read.select(*lines.columns, F.explode(F.transform(F.array(line), _broken)).alias("reasons"))


def _broken(line: Column) -> Column:
    """Names of the rules that a line (value, json, kind, capture: JSON type of its receipt metadata) breaks."""
    kind = line["kind"]
    data, cap = "$.data", "$.data._capture"
    of_kind, told = lambda path: _kind(path, line["json"]), lambda path: _text(path, line["json"])
    is_a = lambda path, *names: F.coalesce(F.regexp_extract(of_kind(path), "^[A-Z]+", 0).isin(*names), F.lit(False))
    text, absent = lambda path: is_a(path, "STRING"), lambda path: of_kind(path).isNull()
    filled = lambda path: text(path) & (told(path) != "")
    exact = lambda path: F.coalesce(of_kind(path).rlike("^(BIGINT|DECIMAL)") & F.get_json_object(line["value"], path).rlike("^[0-9]+$"), F.lit(False))
    whole = lambda path: _whole(told(path)) & ~is_a(path, "BOOLEAN")
    number = lambda path: _finite(told(path))
    optional = lambda path, rule: absent(path) | rule(path)
    every = lambda *rules: reduce(lambda a, b: a & b, rules)
    only = lambda name, *rules: (kind != name) | F.coalesce(every(*rules), F.lit(False))
    no_capture = line["capture"].isNull() | (line["capture"] == "VOID")
    ids = lambda k: told(f"{data}.{k}").try_cast("decimal(38,0)")
    rules: dict[str, Column] = {
        "json": line["json"].isNotNull(),
        "ts_local": number("$.ts_local") & (F.coalesce(told("$.ts_local").try_cast("double") >= 0, F.lit(False))),
        "symbol": text("$.symbol") & (F.trim(told("$.symbol")) != ""),
        "type": text("$.type") & kind.isin(*RECORD_TYPES),
        "data": is_a(data, "OBJECT"),
        "captureMeta": only("captureMeta", optional(f"{data}.schemaVersion", exact), optional(f"{data}.clock", text)),
        "captureEvent": only("captureEvent", filled(f"{data}.event"), filled(f"{data}.route"), optional(f"{data}.reason", text)),
        "exchangeInfo": only("exchangeInfo", number(f"{data}.tickSize"), number(f"{data}.stepSize"), *[optional(f"{data}.{k}", text) for k in ("baseAsset", "quoteAsset", "venue")], optional(f"{data}.contractMultiplier", number)),
        "snapshot": only("snapshot", whole(f"{data}.lastUpdateId"), _levels_ok(f"{data}.bids", line["json"]), _levels_ok(f"{data}.asks", line["json"])),
        "depthUpdate": only("depthUpdate", whole(f"{data}.U"), whole(f"{data}.u"), ids("U") <= ids("u"), optional(f"{data}.pu", whole), _levels_ok(f"{data}.b", line["json"]), _levels_ok(f"{data}.a", line["json"])),
        "aggTrade": only("aggTrade", number(f"{data}.p"), number(f"{data}.q"), is_a(f"{data}.m", "BOOLEAN")),
        "_capture": no_capture | is_a(cap, "OBJECT"),
    }
    for k in ("recvSeq", "recvWallNs", "recvMonotonicNs", "streamEpoch", "syncEpoch"):
        rules[k] = no_capture | optional(f"{cap}.{k}", exact)
    rules["route"] = no_capture | optional(f"{cap}.route", filled)
    for k in ("reason", "validationError"):
        rules[k] = no_capture | optional(f"{cap}.{k}", text)
    rules["snapshotAccepted"] = no_capture | optional(f"{cap}.snapshotAccepted", lambda path: is_a(path, "BOOLEAN"))
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))


def recover(validated: DataFrame) -> DataFrame:
    """The valid prefix of each file: rows before its first invalid line."""
    first = validated.where(F.size("reasons") > 0).groupBy("path").agg(F.min("line").alias("_bad"))
    return validated.join(first, "path", "left").where(F.col("_bad").isNull() | (F.col("line") < F.col("_bad"))).drop("_bad")


def normalize(validated: DataFrame) -> DataFrame:
    """Valid records with the columns NORMALIZED; receive times default to ts_local, routes to ``legacy``.

    ``logical_subns``: what ts_local has below a nanosecond, in billionths of it, where it is the logical time; (recv_monotonic_ns,
    logical_subns, source_row_seq) is the order of a tape.
    """
    cap = lambda k, kind="long": _get(f"data._capture.{k}").try_cast(kind)
    told = time_key(_get("ts_local"))
    local = told["ns"]
    ms = lambda k: (_get(f"data.{k}").try_cast("decimal(28,6)") * 1_000_000).cast("long")
    receipt = cap("recvSeq").isNotNull() & cap("recvMonotonicNs").isNotNull()
    return validated.where(F.size("reasons") == 0).select(
        F.col("line").alias("source_row_seq"), _get("symbol").alias("symbol"), _get("type").alias("event_kind"),
        F.coalesce(_get("data._capture.route"), F.lit("legacy")).alias("route"),
        cap("recvSeq").alias("recv_seq"), F.coalesce(cap("recvWallNs"), local).alias("recv_wall_ns"), F.coalesce(cap("recvMonotonicNs"), local).alias("recv_monotonic_ns"),
        ms("E").alias("exchange_event_ns"), ms("T").alias("exchange_transaction_ns"),
        cap("streamEpoch", "int").alias("stream_epoch"), cap("syncEpoch", "int").alias("sync_epoch"),
        F.when(receipt, "recv_monotonic").otherwise("ts_local").alias("logical_time_source"),
        _get("data._capture.payloadChecksum").alias("payload_checksum"), _get("data").alias("payload_json"),
        F.when(capture_present(), "3").otherwise("1").alias("source_schema_version"), "path", F.when(receipt, 0).otherwise(told["subns"]).cast("long").alias("logical_subns"),
    )


def capture_present() -> Column:
    return _get("data._capture").isNotNull()


def depth_levels(normalized: DataFrame, specs: DataFrame) -> DataFrame:
    """Level updates of snapshots and depth updates, in ticks and lots; rows off the grid have null ticks or lots.

    ``specs``: symbol, tick_size, step_size — one row per instrument.
    """
    get = lambda k: F.get_json_object("payload_json", f"$.{k}")
    sides = {"bid": F.coalesce(get("bids"), get("b")), "ask": F.coalesce(get("asks"), get("a"))}

    def pairs(side: str) -> Column:
        found = F.coalesce(F.from_json(sides[side], "array<array<string>>"), F.array().cast("array<array<string>>"))
        return F.transform(found, lambda p, i: F.struct(F.lit(side).alias("side"), i.alias("pos"), p[0].alias("price"), p[1].alias("qty")))

    tagged = F.concat(pairs("bid"), pairs("ask"))
    rows = normalized.where(F.col("event_kind").isin("snapshot", "depthUpdate")).select(
        "symbol", "event_kind", F.col("recv_monotonic_ns").alias("ns"), F.coalesce("recv_seq", "source_row_seq").alias("seq"),
        get("U").cast("long").alias("first_id"), F.coalesce(get("u"), get("lastUpdateId")).cast("long").alias("last_id"), F.coalesce(get("pu"), get("U")).cast("long").alias("previous_id"), F.explode(tagged).alias("l"),
    )
    return rows.join(specs, "symbol").select("symbol", "event_kind", "ns", "seq", "first_id", "last_id", "previous_id", "l.side", "l.pos", to_units(F.col("l.price"), F.col("tick_size")).alias("tick"), to_units(F.col("l.qty"), F.col("step_size")).alias("lots"))


def specs(normalized: DataFrame) -> DataFrame:
    """The last complete instrument description of each symbol."""
    get = lambda k: F.get_json_object("payload_json", f"$.{k}")
    info = normalized.where("event_kind = 'exchangeInfo'").select("symbol", F.struct("recv_monotonic_ns", "source_row_seq").alias("at"), decimal(get("tickSize")).alias("tick_size"), decimal(get("stepSize")).alias("step_size"), F.coalesce(decimal(get("contractMultiplier")), F.lit(1).cast(EXACT)).alias("contract_multiplier"), get("venue").alias("venue"))
    return info.where("tick_size IS NOT NULL AND step_size IS NOT NULL").groupBy("symbol").agg(F.max_by(F.struct("tick_size", "step_size", "contract_multiplier", "venue"), "at").alias("s")).select("symbol", "s.*")


def trades(normalized: DataFrame, instruments: DataFrame) -> DataFrame:
    """Trades in ticks and lots."""
    get = lambda k: F.get_json_object("payload_json", f"$.{k}")
    rows = normalized.where("event_kind = 'aggTrade'").join(instruments, "symbol")
    return rows.select("symbol", F.col("recv_monotonic_ns").alias("ns"), F.coalesce("recv_seq", "source_row_seq").alias("seq"), to_units(get("p"), F.col("tick_size")).alias("tick"), to_units(get("q"), F.col("step_size")).alias("lots"), get("m").cast("boolean").alias("buyer_is_maker"))


# -- files and receipts

#: The key of a tape's metadata among those of its first column.
METADATA = "tape"


def sniff(spark: SparkSession, path: str) -> str:
    """What a file is: manifest (by its name or first line), segment (its first record is a header) or tape; an unfinished one raises an error."""
    name = path.rpartition("/")[2]
    if name.endswith(".partial"):
        raise ValueError(f"{name} was never finished: recover it first")
    if name.endswith(".manifest.json"):
        return "manifest"
    first = spark.read.text(path).limit(1).select(_get("record").alias("record"), _get("segments").alias("segments")).first()
    if first is None:
        return "tape"
    return "segment" if first.record == "segment_header" else "manifest" if first.segments else "tape"


def with_metadata(df: DataFrame, values: dict) -> DataFrame:
    """``df`` with metadata that Parquet files keep, on its first column."""
    first, *others = df.columns
    return df.select(F.col(f"`{first}`").alias(first, metadata={METADATA: values}), *[F.col(f"`{c}`") for c in others])


def metadata(df: DataFrame) -> dict:
    """Metadata of :func:`with_metadata`, without reading rows; empty if there is none."""
    return df.schema[0].metadata.get(METADATA, {}) if df.columns else {}


def after(normalized: DataFrame, rows: int) -> DataFrame:
    """A tape without its first ``rows`` rows, which a resumed run has seen."""
    return normalized.where(F.col("source_row_seq") > rows)


def receipts(rows: DataFrame) -> DataFrame:
    """Receipts of each capture (path, source_row_seq, recv_seq, recv_monotonic_ns, schema_version, receive_clock, invalidation, trailer).

    Rows without a receipt, gaps and regressions of its sequence and clock, invalidations, and whether a trailer is there. ``receipt_ok``: version 3 or
    later, a receive clock, a trailer and no faults; ``valid``: and no invalidation. Older captures are valid by their schema alone.
    """
    width = 100_000
    seen = F.col("recv_seq").isNotNull()
    held = {"_before": F.when(seen, F.struct("recv_seq", "recv_monotonic_ns"))}
    ran = running(rows, ["path"], F.floor(F.col("source_row_seq") / width).cast("long"), ["source_row_seq"], {k: ("last", c) for k, c in held.items()}, before=True)
    seq, clock = F.col("_before.recv_seq"), F.col("_before.recv_monotonic_ns")
    out = ran.groupBy("path").agg(
        F.count_if(~seen).alias("missing"), F.count_if(F.col("recv_seq") > seq + 1).alias("gaps"), F.count_if(F.col("recv_seq") <= seq).alias("regressions"), F.count_if(seen & (F.col("recv_monotonic_ns") < clock)).alias("clock_regressions"),
        F.count_if("invalidation").alias("invalidations"), F.bool_or("trailer").alias("trailer"), F.min("schema_version").alias("schema_version"), F.bool_or("receive_clock").alias("receive_clock"),
    )
    clean = (F.col("missing") == 0) & (F.col("gaps") == 0) & (F.col("regressions") == 0) & (F.col("clock_regressions") == 0)
    out = out.withColumn("receipt_ok", F.coalesce((F.col("schema_version") >= 3) & F.col("receive_clock"), F.lit(False)) & clean & F.col("trailer"))
    return out.withColumn("valid", (F.coalesce("schema_version", F.lit(1)) < 3) | (F.col("receipt_ok") & (F.col("invalidations") == 0)))


def rejected_snapshots(normalized: DataFrame) -> DataFrame:
    """Snapshots that the capture itself did not accept: their symbols' books are invalid from there on."""
    told = F.get_json_object("payload_json", "$._capture.snapshotAccepted") == "false"
    return normalized.where((F.col("event_kind") == "snapshot") & told)


# -- segmented captures


def read_segments(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Rows of segment files: path, line, record (segment_header, event, segment_trailer), recv_seq, payload_checksum, event (JSON).

    The event is its own text if the line's fields are in order of name, as writers leave them.
    """
    return segment_rows(read_lines(spark, paths))


def segment_rows(rows: DataFrame) -> DataFrame:
    """Lines of segments (path, line, value) in the columns of :func:`read_segments`.

    Lines are dealt by path and stretch as they are, so that :func:`verify_segments`, which reads them twice, reads one shuffle, and what made them runs once.
    """
    dealt = rows.select("path", "line", "value").repartition("path", F.floor(F.col("line") / STRETCH))
    read, get = _fields(dealt, "value", ("record", "recv_seq", "payload_checksum"))
    own = F.regexp_extract("value", EVENT_LINE, 1)
    event = F.when(own != "", own).otherwise(_get("event"))
    return read.select("path", "line", get("record").alias("record"), get("recv_seq").cast("long").alias("recv_seq"), get("payload_checksum").alias("payload_checksum"), event.alias("event"), "value")


def _fields(rows: DataFrame, text: str, names: Sequence[str]) -> tuple[DataFrame, Callable[[str], Column]]:
    """Rows with their JSON text read once, and what gives a field of it; a text that is broken somewhere is read for each field, up to there."""
    found = {k: f"_tm_of_{text}_{k}" for k in names}
    read = rows.select("*", F.json_tuple(text, *names).alias(*found.values()))
    nothing = F.coalesce(*found.values()).isNull()
    return read, lambda k: F.when(nothing, F.get_json_object(text, f"$.{k}")).otherwise(F.col(found[k]))


#: Fields that an event of a segment must have as text, and as integers from 0.
EVENT_TEXTS, EVENT_COUNTS = ("capture_id", "schema_version", "venue", "instrument", "event_kind", "route"), ("recv_seq", "recv_wall_ns", "recv_monotonic_ns")
#: What can make a row of a segment unfit, in the order in which it is told.
SEGMENT_RULES = ("not_json", "header_repeated", "header_without_id", "header_missing", "event_fields", "other_sequence", "other_capture", "other_version", "checksum", "sequence")


def verify_segments(segments: DataFrame, schema_version: str | None = None) -> DataFrame:
    """Rows of :func:`read_segments` with ``reasons``: what makes each of them unfit, empty if nothing does.

    not_json; header_missing before an event and header_repeated or header_without_id; event_fields missing or of another
    kind; other_sequence, other_capture and other_version than the line, the header or ``schema_version`` (if it is given) say; checksum, if the canonical form of the
    payload has another CRC-32C than the line or the event tells; and sequence, if it doesn't rise from event to event.
    Rows of a path are held against their neighbours over chunks of lines, so a segment may have any length.
    """
    head, event = F.col("record") == "segment_header", F.col("record") == "event"
    read, get = _fields(segments, "event", (*EVENT_TEXTS, *EVENT_COUNTS, "raw_payload_checksum"))
    capture = F.when(head, F.get_json_object("value", "$.capture_id"))
    texts = F.lit(True)
    for k in EVENT_TEXTS:
        texts = texts & (F.coalesce(get(k), F.lit("")) != "")
    for k in EVENT_COUNTS:
        texts = texts & F.coalesce(get(k).try_cast("long") >= 0, F.lit(False))
    told = F.coalesce(get("raw_payload_checksum"), F.col("payload_checksum"))
    summed = read.withColumn("_tm_sum", payload_checksum(F.col("event"), "payload"))
    # what a row tells by itself comes first, so that its texts needn't go along to its neighbours
    alone = {
        "not_json": F.try_parse_json("value").isNull(),
        "header_without_id": head & (F.coalesce(capture, F.lit("")) == ""),
        "event_fields": event & ~texts,
        "other_sequence": event & ~F.col("recv_seq").eqNullSafe(get("recv_seq").try_cast("long")),
        "other_version": event & ~F.coalesce(get("schema_version") == schema_version, F.lit(False)) if schema_version else F.lit(False),
        "checksum": event & ~(F.coalesce(F.col("payload_checksum") == F.col("_tm_sum"), F.lit(False)) & F.coalesce(told == F.col("_tm_sum"), F.lit(False))),
    }
    own = summed.select(*segments.columns, capture.alias("_tm_named"), get("capture_id").alias("_tm_told"), *[wrong.alias(f"_tm_{name}") for name, wrong in alone.items()])
    named = {"_tm_headers": ("sum", F.coalesce(head, F.lit(False)).cast("long")), "_tm_capture": ("last", F.col("_tm_named")), "_tm_before": ("last", F.when(event, F.col("recv_seq")))}
    rows = running(own, ["path"], F.floor(F.col("line") / STRETCH), ["line"], named, before=True)
    beside = {
        "header_repeated": head & (F.col("_tm_headers") > 0),
        "header_missing": event & (F.col("_tm_headers") == 0),
        "other_capture": event & ~F.col("_tm_capture").eqNullSafe(F.col("_tm_told")),
        "sequence": event & F.coalesce(F.col("recv_seq") <= F.col("_tm_before"), F.lit(False)),
    }
    rules = {name: beside.get(name, F.col(f"_tm_{name}")) for name in SEGMENT_RULES}
    reasons = F.array_compact(F.array(*[F.when(F.coalesce(wrong, F.lit(False)), F.lit(name)) for name, wrong in rules.items()]))
    return rows.select(*segments.columns, reasons.alias("reasons"))


def recover_segments(verified: DataFrame) -> DataFrame:
    """Events of each segment up to its first unfit row or its trailer, whichever is first: what a segment that was cut off or damaged still holds."""
    stop = verified.where((F.size("reasons") > 0) | (F.col("record") == "segment_trailer")).groupBy("path").agg(F.min("line").alias("_tm_stop"))
    rows = verified.where("record = 'event'").join(stop, "path", "left")
    return rows.where(F.col("_tm_stop").isNull() | (F.col("line") < F.col("_tm_stop"))).drop("_tm_stop", "reasons")


def recovery_report(verified: DataFrame) -> DataFrame:
    """Per path: how many events :func:`recover_segments` keeps of it, their highest sequence, and the least one of an event whose checksum is wrong, if there is one.

    Rows are read once: each stretch of lines is counted up to its first stop, and counts if no earlier one has a stop.
    """
    stretch, stop = F.floor(F.col("line") / STRETCH), (F.size("reasons") > 0) | (F.col("record") == "segment_trailer")
    rows = verified.select("path", "line", stretch.alias("_tm_stretch"), "record", "recv_seq", F.array_contains("reasons", "checksum").alias("_tm_wrong"), F.coalesce(stop, F.lit(False)).alias("_tm_stop"))
    so_far = Window.partitionBy("path", "_tm_stretch").orderBy("line").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    kept = (F.col("record") == "event") & ~F.col("_tm_stopped")
    stretches = rows.withColumn("_tm_stopped", F.bool_or("_tm_stop").over(so_far)).groupBy("path", "_tm_stretch").agg(F.count_if(kept).alias("n"), F.max(F.when(kept, F.col("recv_seq"))).alias("last"), F.bool_or("_tm_stop").alias("stop"), F.min(F.when(F.col("_tm_wrong"), F.col("recv_seq"))).alias("wrong"))
    before = Window.partitionBy("path").orderBy("_tm_stretch").rowsBetween(Window.unboundedPreceding, -1)
    reached = ~F.coalesce(F.bool_or("stop").over(before), F.lit(False))
    return stretches.withColumn("_tm_reached", reached).groupBy("path").agg(F.coalesce(F.sum(F.when(F.col("_tm_reached"), F.col("n"))), F.lit(0)).cast("long").alias("recovered"), F.max(F.when(F.col("_tm_reached"), F.col("last"))).alias("last_seq"), F.min("wrong").alias("broken_at"))


def segment_report(segments: DataFrame) -> DataFrame:
    """Per file: header and trailer present, counts, sequence range and digest of the events against the trailer's, order of sequences.

    The digest is that of all events' texts in order; they pass through one state a segment, a batch at a time. A trailer without a digest isn't held against one.
    """
    events = previous(segments.where("record = 'event'"), ["path"], F.floor(F.col("line") / 100_000), ["line"], {"_p": F.col("recv_seq")})
    contents = joined_hash(segments.where("record = 'event'"), ["path"], ["line"], F.col("event")).select("path", F.col("digest").alias("content_sha256"))
    seen = events.groupBy("path").agg(F.count("*").alias("events"), F.min("recv_seq").alias("first_seq"), F.max("recv_seq").alias("last_seq"), F.count_if(F.col("recv_seq") <= F.col("_p")).alias("regressions"))
    trailer = lambda k: F.max(F.when(F.col("record") == "segment_trailer", F.get_json_object("value", f"$.{k}").cast("long")))
    frame = segments.groupBy("path").agg(F.count_if(F.col("record") == "segment_header").alias("headers"), F.count_if(F.col("record") == "segment_trailer").alias("trailers"), trailer("count").alias("count"), trailer("first_recv_seq").alias("t_first"), trailer("last_recv_seq").alias("t_last"), F.max(F.when(F.col("record") == "segment_trailer", _get("content_sha256"))).alias("t_content"))
    joined = frame.join(seen, "path", "left").join(contents, "path", "left")
    ok = (F.col("headers") == 1) & (F.col("trailers") == 1) & (F.col("count") == F.coalesce("events", F.lit(0))) & F.col("t_first").eqNullSafe(F.col("first_seq")) & F.col("t_last").eqNullSafe(F.col("last_seq")) & (F.coalesce("regressions", F.lit(0)) == 0)
    ok = ok & (F.col("t_content").isNull() | (F.col("t_content") == F.coalesce("content_sha256", F.sha2(F.lit("").cast("binary"), 256))))
    return joined.withColumn("complete", ok)


def manifest_issues(manifest: dict, report: DataFrame) -> list[str]:
    """What a capture's manifest says otherwise than :func:`segment_report` of its segments; empty if nothing.

    Its own hash, the capture's id, the number of segments and of events, each segment's count, range of sequences and digest of its events, if it has one, and
    their order from segment to segment. A row per segment reaches the driver.
    """
    unsigned = {k: v for k, v in manifest.items() if k != "manifest_sha256"}
    own = hashlib.sha256(json.dumps(unsigned, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()
    entries = manifest.get("segments") if isinstance(manifest.get("segments"), list) else []
    depth = 1 + max((e["path"].count("/") for e in entries), default=0)
    seen = {"/".join(r.path.split("/")[-depth:]): r for r in report.collect()}
    issues = [] if manifest.get("manifest_sha256") == own else ["manifest_sha256"]
    if not isinstance(manifest.get("capture_id"), str) or not manifest["capture_id"]:
        issues.append("capture_id")
    if not isinstance(manifest.get("segments"), list) or manifest.get("segment_count") != len(entries):
        issues.append("segment_count")
    if (((manifest.get("capture_runtime") or {}).get("writer")) or {}).get("complete") is False:
        issues.append("writer")
    before, total, first = None, 0, None
    for entry in entries:
        found = seen.get(entry["path"])
        told = (entry.get("count"), entry.get("first_recv_seq"), entry.get("last_recv_seq"))
        digest = entry.get("content_sha256")
        if digest and found is not None and found.content_sha256 != digest:
            issues.append(f"content {entry['path']}")
        if found is None or not found.complete or told != (found.events or 0, found.first_seq, found.last_seq):
            issues.append(f"segment {entry['path']}")
            continue
        if before is not None and found.first_seq is not None and found.first_seq <= before:
            issues.append(f"order {entry['path']}")
        before, first, total = found.last_seq if found.last_seq is not None else before, found.first_seq if first is None else first, total + (found.events or 0)
    if manifest.get("event_count") != total:
        issues.append("event_count")
    if (manifest.get("first_recv_seq"), manifest.get("last_recv_seq")) != (first, before):
        issues.append("recv_seq")
    return issues


def tail_of(path: Column, depth: int) -> Column:
    """The last ``depth`` parts of a path."""
    return F.array_join(F.slice(F.split(path, "/"), -depth, depth), "/")


def read_manifest(spark: SparkSession, path: str) -> tuple[dict, DataFrame]:
    """A capture's manifest and the rows of its segments; file hashes are checked by Spark, names may not leave the folder.

    A segment is hashed whole in one task, so it may have 2 GB at most: captures rotate their segments well below that.
    """
    folder = path.rpartition("/")[0]
    manifest = json.loads("\n".join(r.value for r in spark.read.text(path).collect()))  # one small file
    names = [s["path"] for s in manifest["segments"]]
    if any(n.startswith("/") or ":" in n or ".." in n.split("/") for n in names):
        raise ValueError("a segment lies outside the capture's folder")
    hashes = {s["path"]: s["file_sha256"] for s in manifest["segments"]}
    depth = 1 + max((n.count("/") for n in names), default=0)
    files = spark.read.format("binaryFile").load([f"{folder}/{n}" for n in names]).select(tail_of(F.col("path"), depth).alias("name"), F.sha2("content", 256).alias("sha"))
    wrong = [r.name for r in files.collect() if hashes[r.name] != r.sha]
    if wrong:
        raise ValueError(f"segments with another hash than the manifest's: {sorted(wrong)}")
    return manifest, read_segments(spark, [f"{folder}/{n}" for n in names])


def read_audit(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """An audit CSV with typed columns: nested ones from JSON cells, empty cells as null."""
    from pyspark.sql import types as T

    fields = T._parse_datatype_string(schema).fields
    raw = spark.read.option("header", True).option("escape", '"').csv(path)
    nested = (T.ArrayType, T.MapType, T.StructType)
    return raw.select(*[(F.from_json(f.name, f.dataType.simpleString()) if isinstance(f.dataType, nested) else F.col(f.name).try_cast(f.dataType)).alias(f.name) for f in fields])
