"""Result bundles: tables in the formats of the tape tools, committed by a manifest that is written last."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.tape import read_audit


def cells(df: DataFrame) -> DataFrame:
    """Columns as CSV cells: nested values as JSON, null as empty."""

    def cell(f: T.StructField) -> Column:
        c = F.col(f"`{f.name}`")
        nested = isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType))
        return F.coalesce(F.to_json(c) if nested else c.cast("string"), F.lit("")).alias(f.name)

    return df.select(*[cell(f) for f in df.schema])


def write_csv(df: DataFrame, path: str) -> None:
    cells(df).write.option("header", True).option("emptyValue", "").csv(path)


def write_jsonl(df: DataFrame, path: str, compression: str = "none") -> None:
    df.write.option("compression", compression).json(path)


def write_parquet(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    df.write.option("compression", "zstd").partitionBy(*(by or [])).parquet(path)


def discard(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def counted(df: DataFrame, by: list[str]) -> DataFrame:
    """What an aggregate-only sink keeps: rows by each of the columns, and in all."""
    return df.groupingSets([[F.col(c)] for c in by] + [[]], *by).agg(F.count("*").alias("n"))


def digest(df: DataFrame) -> str:
    """Order-free SHA-256 of a table: rows are hashed, and the hashes' counts and sums by prefix are hashed."""
    rows = df.select(F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns)])).cast("binary"), 256).alias("h"))
    parts = rows.groupBy(F.substring("h", 1, 2).alias("p")).agg(F.count("*").alias("n"), *[F.sum(F.conv(F.substring("h", 3 + 13 * i, 13), 16, 10).cast("decimal(38,0)")).alias(f"s{i}") for i in range(4)])
    text = "\n".join(":".join(map(str, r)) for r in sorted(parts.collect()))  # 256 rows at most
    return hashlib.sha256(text.encode()).hexdigest()


def read_back(spark: SparkSession, path: str, schema: str, kind: str) -> DataFrame:
    """A table as it was written, in any of the formats."""
    if kind == "csv":
        return read_audit(spark, path, schema)
    return spark.read.schema(schema).json(path) if kind == "jsonl" else spark.read.parquet(path)


#: A bundle with this file isn't finished, whatever else is there.
SENTINEL = "_INCOMPLETE"


def _file_system(spark: SparkSession, path: str) -> tuple:
    """Hadoop's file system of a path, and a maker of its paths: renames and sentinels work in whatever store Spark writes to."""
    jvm = spark.sparkContext._jvm
    make = jvm.org.apache.hadoop.fs.Path
    return make(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), make


def _tables(spark: SparkSession, path: str, tables: Mapping[str, DataFrame], summary: Mapping, kind: str) -> dict:
    """Writes tables and then their manifest, with the digests of what is read back."""
    writers = {"parquet": write_parquet, "csv": write_csv, "jsonl": write_jsonl}
    manifest: dict = {"summary": dict(summary), "kind": kind, "tables": {}}
    for name, df in tables.items():
        writers[kind](df, f"{path}/{name}")
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
        back = read_back(spark, f"{path}/{name}", schema, kind)
        manifest["tables"][name] = {"rows": back.count(), "digest": digest(back), "columns": back.columns, "schema": schema}
    manifest["self"] = hashlib.sha256(json.dumps(manifest, sort_keys=True).encode()).hexdigest()
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.text(f"{path}/_manifest")
    return manifest


def _issues(spark: SparkSession, path: str) -> list[str]:
    manifest = json.loads(spark.read.text(f"{path}/_manifest").first()[0])
    own = manifest.pop("self")
    issues = [] if hashlib.sha256(json.dumps(manifest, sort_keys=True).encode()).hexdigest() == own else ["manifest"]
    for name, known in manifest["tables"].items():
        df = read_back(spark, f"{path}/{name}", known["schema"], manifest["kind"])
        if df.count() != known["rows"] or digest(df) != known["digest"]:
            issues.append(name)
    return issues


def write_bundle(spark: SparkSession, path: str, tables: Mapping[str, DataFrame], summary: Mapping, kind: str = "parquet") -> dict:
    """Tables and a manifest with the digests of what was written, at ``path`` as a whole or not at all.

    All is written to a staging folder beside ``path`` that has a sentinel from the start, and held against the manifest
    there. Then the folder is renamed, and the sentinel goes last: a write that dies at any step leaves a folder with a sentinel, which
    readers refuse, and a later write clears its own staging folder and starts anew. A path that exists is never written to.
    In CSV an empty text and null are the same cell, so its digest is that of null.
    """
    fs, make = _file_system(spark, path)
    stage = f"{path.rstrip('/')}.staging"
    if fs.exists(make(path)):
        raise FileExistsError(path)
    fs.delete(make(stage), True)
    fs.mkdirs(make(stage))
    fs.create(make(f"{stage}/{SENTINEL}"), True).close()
    manifest = _tables(spark, stage, tables, summary, kind)
    if issues := _issues(spark, stage):
        raise ValueError(f"what was written differs from what was to be: {issues}")
    if not fs.rename(make(stage), make(path)):
        raise OSError(f"{stage} can't be renamed to {path}")
    if not fs.delete(make(f"{path}/{SENTINEL}"), False):
        raise OSError(f"the sentinel of {path} can't be removed")
    return manifest


def finished(spark: SparkSession, path: str) -> bool:
    """Whether a bundle is there and whole."""
    fs, make = _file_system(spark, path)
    return fs.exists(make(f"{path}/_manifest/_SUCCESS")) and not fs.exists(make(f"{path}/{SENTINEL}"))


def read_bundle(spark: SparkSession, path: str) -> tuple[dict, dict[str, DataFrame]]:
    """Manifest and tables of a finished bundle; an unfinished one is refused."""
    if not finished(spark, path):
        raise ValueError(f"{path} isn't a finished bundle")
    manifest = json.loads(spark.read.text(f"{path}/_manifest").first()[0])
    return manifest, {name: read_back(spark, f"{path}/{name}", known["schema"], manifest["kind"]) for name, known in manifest["tables"].items()}


def audit_bundle(spark: SparkSession, path: str) -> list[str]:
    """What differs between a bundle and its manifest; empty if nothing does, and ``unfinished`` if it was never committed."""
    return _issues(spark, path) if finished(spark, path) else ["unfinished"]


def summary_issues(spark: SparkSession, path: str, summary: Mapping, *, texts: Sequence[str], counts: Sequence[str], documents: Sequence[str]) -> list[str]:
    """What differs between a summary and its CSV of one row: ``texts`` as written, ``counts`` as integers, ``documents`` as JSON."""
    rows = spark.read.csv(path, header=True, escape='"', multiLine=True).limit(2).collect()
    if len(rows) != 1:
        return ["rows"]
    row = rows[0].asDict()

    def same(name: str, parse: Callable[[str], object]) -> bool:
        try:
            return name in summary and row.get(name) is not None and parse(row[name]) == summary[name]
        except ValueError:
            return False

    wrong = [n for n in texts if row.get(n) != str(summary.get(n))]
    return wrong + [n for n in counts if not same(n, int)] + [n for n in documents if not same(n, json.loads)]
