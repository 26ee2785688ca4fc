"""Captures as segment files with header and trailer, a manifest that is written last, and a report of what failed."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import NO_PAYLOAD, payload_checksum
from ..operators.audit import joined_hash
from ..operators.ordered import running
from ..sources.tape import tail_of

#: Versions of a capture and of its files.
CAPTURE, MANIFEST, FAILURE = 3, "capture_manifest.v1", "capture_failure.v1"


def _canonical(value: Mapping) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def _signed(value: Mapping, name: str) -> dict:
    return {**value, name: hashlib.sha256(_canonical(value).encode()).hexdigest()}


def _write_json(spark: SparkSession, path: str, value: Mapping) -> None:
    spark.createDataFrame([(_canonical(value),)], "value string").coalesce(1).write.mode("errorifexists").text(path)


def with_segments(events: DataFrame, *, rotate_ns: int, most_bytes: int, block: int = 100_000) -> DataFrame:
    """Adds ``segment`` to events (recv_seq, recv_wall_ns, event): a number for each stretch of ``rotate_ns`` and of ``most_bytes`` of text in it.

    Clock and bytes are summed over blocks of sequence numbers, so no task orders a whole capture.
    """
    chunk, order = F.floor(F.col("recv_seq") / block).cast("long"), ["recv_seq"]
    clocked = running(events, [], chunk, order, {"_tm_wall": ("max", F.col("recv_wall_ns"))})
    clocked = clocked.withColumn("_tm_slot", F.floor(F.col("_tm_wall") / rotate_ns)).withColumn("_tm_size", F.octet_length("event").cast("long"))
    sized = running(clocked, ["_tm_slot"], chunk, order, {"_tm_bytes": ("sum", F.col("_tm_size"))}, before=True)
    places = sized.withColumn("_tm_part", F.floor(F.col("_tm_bytes") / most_bytes))
    numbers = places.groupBy("_tm_slot", "_tm_part").agg(F.min("recv_seq").alias("_tm_first"))
    order_of = numbers.withColumn("_tm_one", F.lit(1).cast("long"))
    named = running(order_of, [], F.floor(F.col("_tm_first") / block).cast("long"), ["_tm_first"], {"segment": ("sum", F.col("_tm_one"))}, before=True)
    return places.join(named.select("_tm_slot", "_tm_part", "segment"), ["_tm_slot", "_tm_part"]).select(*events.columns, "segment")


def segment_lines(placed: DataFrame, capture_id: str) -> DataFrame:
    """(segment, place, value): the lines of each segment, a header, its events by sequence, and a trailer with their count, range and digest.

    Fields are in order of name. The digest is of the segment's texts in order, which pass through one state. An event without a checksum
    (payload_checksum) gets the CRC-32C of its payload's canonical form.
    """
    given = F.col("payload_checksum") if "payload_checksum" in placed.columns else F.lit(None).cast("string")
    checksum = F.coalesce(given, payload_checksum(F.col("event"), "payload"), F.lit(NO_PAYLOAD))
    event = F.concat(F.lit('{"event":'), F.col("event"), F.lit(',"payload_checksum":"'), checksum, F.lit('","record":"event","recv_seq":'), F.col("recv_seq").cast("string"), F.lit("}"))
    rows = placed.select("segment", F.col("recv_seq").alias("place"), event.alias("value"))
    contents = joined_hash(placed, ["segment"], ["recv_seq"], F.col("event")).select("segment", F.col("digest").alias("content_sha256"))
    frame = placed.groupBy("segment").agg(F.count("*").alias("count"), F.min("recv_seq").alias("first_recv_seq"), F.max("recv_seq").alias("last_recv_seq"), F.min_by("recv_wall_ns", "recv_seq").alias("started_wall_ns")).join(contents, "segment")
    head = F.to_json(F.struct(F.lit(capture_id).alias("capture_id"), F.lit("segment_header").alias("record"), F.lit(CAPTURE).alias("schema_version"), F.col("segment").alias("segment_index"), "started_wall_ns"))
    tail = F.to_json(F.struct(F.lit(True).alias("complete"), "content_sha256", "count", "first_recv_seq", "last_recv_seq", F.lit("segment_trailer").alias("record")))
    ends = frame.select("segment", F.explode(F.array(F.struct((F.col("first_recv_seq") - 1).alias("place"), head.alias("value")), F.struct((F.col("last_recv_seq") + 1).alias("place"), tail.alias("value")))).alias("l")).select("segment", "l.*")
    return rows.unionByName(ends)


def write_capture(events: DataFrame, path: str, capture_id: str, *, rotate_ns: int = 300_000_000_000, most_bytes: int = 64 << 20, compression: str = "gzip", runtime: Mapping | None = None) -> dict:
    """Events (recv_seq, recv_wall_ns, event as JSON with fields in order of name, and payload_checksum if known) as a capture of segment files; returns its manifest.

    Sequences must be unique: a repeated or missing one raises an error before anything is written. Segments are written by Spark, one file each under
    ``segment=n``, and reread for the manifest, a row per segment; it comes last, so a capture without one is incomplete.
    ``compression``: none or gzip. No events: a capture without segments.
    """
    if not capture_id:
        raise ValueError("a capture needs an id")
    spark = events.sparkSession
    if not events.groupBy("recv_seq").agg(F.count("*").alias("n")).where("n > 1 OR recv_seq IS NULL").limit(1).isEmpty():
        raise ValueError("receive sequences must be there and unique")
    lines = segment_lines(with_segments(events, rotate_ns=rotate_ns, most_bytes=most_bytes), capture_id)
    shuffled = lines.repartition("segment").sortWithinPartitions("segment", "place").select("segment", "value")
    shuffled.write.option("compression", compression).partitionBy("segment").text(path)
    entries = []
    if not events.isEmpty():
        files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(path).select(tail_of(F.col("path"), 2).alias("path"), F.sha2("content", 256).alias("file_sha256"), F.col("length").alias("size_bytes"))
        read = spark.read.text(path).select(F.col("segment").cast("long").alias("segment_index"), "value")
        told = read.where(F.get_json_object("value", "$.record") == "segment_trailer")
        told = told.select("segment_index", F.from_json("value", "count long, first_recv_seq long, last_recv_seq long, content_sha256 string").alias("t")).select("segment_index", "t.*")
        whole = files.withColumn("segment_index", F.regexp_extract("path", "segment=([0-9]+)", 1).cast("long")).join(told, "segment_index")
        entries = [r.asDict() for r in whole.orderBy("segment_index").collect()]
    manifest: dict = {
        "schema_version": MANIFEST, "capture_schema_version": CAPTURE, "capture_id": capture_id, "compression": compression, "segments": entries, "segment_count": len(entries), "event_count": sum(e["count"] for e in entries),
        "first_recv_seq": entries[0]["first_recv_seq"] if entries else None, "last_recv_seq": entries[-1]["last_recv_seq"] if entries else None,
    }
    manifest = _signed(manifest | ({"capture_runtime": dict(runtime)} if runtime else {}), "manifest_sha256")
    _write_json(spark, f"{path}/{capture_id}.manifest.json", manifest)
    return manifest


def write_failure(spark: SparkSession, path: str, capture_id: str, error: BaseException, *, failed_wall_ns: int, writer: Mapping | None = None) -> dict:
    """Why a capture is incomplete: types of the error, of its members and of all causes, without their texts, signed; an existing report is left alone."""
    types: list[str] = []
    waiting, known = [error], {id(error)}
    while waiting:
        seen = waiting.pop()
        types.append(type(seen).__name__)
        members = seen.exceptions if isinstance(seen, BaseExceptionGroup) else ()
        for other in reversed([*members, seen.__cause__, seen.__context__]):
            if other is not None and id(other) not in known:
                known.add(id(other))
                waiting.append(other)
    report = _signed({"schema_version": FAILURE, "capture_id": capture_id, "complete": False, "failed_wall_ns": failed_wall_ns, "failure_types": types, "writer": dict(writer) if writer else None}, "report_sha256")
    _write_json(spark, f"{path}/{capture_id}.failure.json", report)
    return report
