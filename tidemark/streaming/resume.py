"""Streams that go on only from what they left: state, input and configuration are held against digests first."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sinks.bundle import _file_system, digest
from .book import run_once

POINT = "resume_point.v1"


class ResumeRefused(ValueError):
    """What a stream would go on from isn't what it left."""


def state_digest(spark: SparkSession, checkpoint: str) -> str:
    """Digest of the state that the last finished batch left, read as a table of keys and values; it doesn't depend on their order or partitions."""
    return digest(spark.read.format("statestore").load(checkpoint).select(F.to_json("key").alias("key"), F.to_json("value").alias("value")))


def files_read(spark: SparkSession, checkpoint: str) -> list[str]:
    """Files that a file stream has taken in so far, by its own log."""
    log = spark.read.option("recursiveFileLookup", "true").text(f"{checkpoint}/sources/0").select(F.get_json_object("value", "$.path").alias("path"))
    return sorted(r.path for r in log.where("path IS NOT NULL").distinct().collect())


def _observed(spark: SparkSession, checkpoint: str, read: Callable[[list[str]], DataFrame], config: Mapping) -> dict:
    files = files_read(spark, checkpoint)
    fs, make = _file_system(spark, checkpoint)
    gone = [f for f in files if not fs.exists(make(f))]
    if gone:
        raise ResumeRefused(f"input files are gone: {gone}")
    told = hashlib.sha256(json.dumps(dict(config), sort_keys=True).encode()).hexdigest()
    return {"schema": POINT, "config_sha256": told, "files": len(files), "input_digest": digest(read(files)), "state_digest": state_digest(spark, checkpoint)}


def _signed(point: Mapping) -> dict:
    return {**point, "point_sha256": hashlib.sha256(json.dumps(dict(point), sort_keys=True).encode()).hexdigest()}


def go_on(spark: SparkSession, source: str, schema: str, plan: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, config: Mapping) -> dict:
    """All that has arrived at ``source`` (Parquet files), through ``plan`` to a Parquet table ``out``; returns the point that a later call goes on from.

    Before a call goes on, the state, the files taken in so far and the configuration are held against the digests of the last
    point, which is signed and written beside the checkpoint when a run is over; another state, other rows in old files, another
    configuration or a changed point are refused (ResumeRefused), and so is a checkpoint without a point, as a run that died leaves it.
    New files are what a call is for. Digests are aggregates, so nothing but a row per prefix reaches the driver.
    """
    read = lambda files: spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)
    fs, make = _file_system(spark, checkpoint)
    place = f"{checkpoint.rstrip('/')}.point"
    if fs.exists(make(place)):
        known = json.loads(spark.read.text(place).first()[0])
        unsigned = {k: v for k, v in known.items() if k != "point_sha256"}
        if _signed(unsigned) != known:
            raise ResumeRefused("the point isn't as it was written")
        now = _observed(spark, checkpoint, read, config)
        wrong = [k for k in unsigned if now[k] != unsigned[k]]
        if wrong:
            raise ResumeRefused(f"not what the last run left: {wrong}")
        fs.delete(make(place), True)
    elif fs.exists(make(f"{checkpoint}/offsets")):
        raise ResumeRefused("the last run didn't end: there is a checkpoint without a point")
    run_once(plan(spark.readStream.schema(schema).parquet(source)), out, checkpoint)
    point = _signed(_observed(spark, checkpoint, read, config))
    spark.createDataFrame([(json.dumps(point, sort_keys=True),)], "value string").coalesce(1).write.text(place)
    return point
