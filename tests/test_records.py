"""Checksums, recovery, digests in order, commits, resuming and time keys."""

import gzip
import hashlib
import json
import random
import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_streaming import random_updates
from tidemark.functions import hashing, ticks
from tidemark.operators import audit, research
from tidemark.operators.asof import asof
from tidemark.operators.ordered import running
from tidemark.sinks import bundle, capture
from tidemark.sources import tape
from tidemark.streaming import book, resume


def canonical(value):
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def test_canonical_json_of_any_depth(spark):
    rng = random.Random(1)

    def value(depth):
        kind = rng.randrange(8 if depth else 6)
        if kind < 6:
            return [None, True, rng.randrange(-(10**25), 10**25), rng.random() * 10 ** rng.randrange(-9, 20), "é\"\\ \n" + chr(rng.randrange(32, 1000)), ""][kind]
        return [value(depth - 1) for _ in range(rng.randrange(4))] if kind == 6 else {rng.choice("abcXYZé"): value(depth - 1) for _ in range(rng.randrange(5))}

    values = [value(5) for _ in range(200)]
    texts = [json.dumps(v, indent=rng.choice((None, 1)), ensure_ascii=rng.random() < 0.5) for v in values] + [None, "", "{", "NaN", '{"a": Infinity}', '{"a":1,"a":2}', "1.50", "[" * 100_000]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    found = [r.c for r in df.select("i", hashing.canonical_json(F.col("t")).alias("c")).orderBy("i").collect()]
    assert found == [canonical(v) for v in values] + [None, None, None, None, None, '{"a":2}', "1.5", None]
    picked = df.where("i < 200").select("i", F.concat(F.lit('{"z":1,"payload":'), "t", F.lit("}")).alias("t"))
    assert [r.c for r in picked.select("i", hashing.canonical_json(F.col("t"), "payload").alias("c")).orderBy("i").collect()] == [canonical(v) for v in values]


def event_of(i, capture_id="c"):
    return {"capture_id": capture_id, "event_kind": "trade", "instrument": "A", "payload": {"b": {"y": i / 3, "x": "é"}, "a": i}, "recv_monotonic_ns": i, "recv_seq": i, "recv_wall_ns": i, "route": "public", "schema_version": "3", "venue": "v"}


def written(spark, path, n=40):
    rows = [(i, i, canonical(event_of(i))) for i in range(1, n + 1)]
    manifest = capture.write_capture(spark.createDataFrame(rows, "recv_seq long, recv_wall_ns long, event string"), path, "c", compression="none")
    return f"{path}/{manifest['segments'][0]['path']}"


def recovered(spark, path):
    verified = tape.verify_segments(tape.read_segments(spark, [path]), "3")
    bad = {(r.recv_seq, *r.reasons) for r in verified.where(F.size("reasons") > 0).collect()}
    return sorted(r.recv_seq for r in tape.recover_segments(verified).collect()), bad


def test_recovery_stops_at_the_first_damaged_row(spark, tmp_path):
    path = written(spark, str(tmp_path / "c"))
    whole = open(path, encoding="utf-8").read()
    assert recovered(spark, path) == (list(range(1, 41)), set())
    lines = whole.splitlines()

    def changed(name, edit):
        out = tmp_path / f"{name}.ndjson"
        out.write_text("\n".join(edit(list(lines))) + "\n", encoding="utf-8")
        return recovered(spark, str(out))

    def at(i, old, new):
        return lambda rows: [r.replace(old, new) if k == i else r for k, r in enumerate(rows)]

    assert changed("byte", at(17, '"a":17', '"a":18')) == (list(range(1, 17)), {(17, "checksum")})
    assert changed("cut", lambda rows: [*rows[:20], rows[20][:50]]) == (list(range(1, 20)), {(None, "not_json")})
    assert changed("tail", lambda rows: rows[:30]) == (list(range(1, 30)), set())
    assert changed("swap", lambda rows: [*rows[:5], rows[6], rows[5], *rows[7:]]) == ([1, 2, 3, 4, 6], {(5, "sequence")})
    assert changed("other", at(9, '"capture_id":"c"', '"capture_id":"d"')) == (list(range(1, 9)), {(9, "other_capture")})
    assert changed("version", at(9, '"schema_version":"3"', '"schema_version":"2"')) == (list(range(1, 9)), {(9, "other_version")})
    assert changed("field", at(9, '"venue":"v"', '"venue":""')) == (list(range(1, 9)), {(9, "event_fields")})
    assert changed("seq", at(9, '"record":"event","recv_seq":9', '"record":"event","recv_seq":10'))[0] == list(range(1, 9))
    found, bad = changed("headless", lambda rows: rows[1:])
    assert found == [] and len(bad) == 40
    assert changed("twice", lambda rows: [*rows[:4], rows[0], *rows[4:]])[0] == [1, 2, 3]
    with gzip.open(tmp_path / "z.ndjson.gz", "wt", encoding="utf-8") as file:
        file.write(whole)
    assert recovered(spark, str(tmp_path / "z.ndjson.gz"))[0] == list(range(1, 41))


def test_digests_of_keys_that_are_longer_than_a_batch(spark):
    rows = [("hot" if i % 4 else f"k{i % 3}", i, None if i == 8 else f"row {i}") for i in range(3000)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.createDataFrame([*rows, (None, 1, "of no key")], "key string, i long, text string").repartition(5)
        chain, whole = ({r.key: (r.n, r.digest) for r in f(df, ["key"], ["i"], F.col("text")).collect()} for f in (lambda *a: audit.hash_chain(*a, "d"), audit.list_hash))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for key in ("hot", "k0", "k1", "k2", None):
        own = [t for k, _, t in [*rows, (None, 1, "of no key")] if k == key]
        assert whole[key] == (len(own), hashlib.sha256(f"[{','.join(t for t in own if t is not None)}]".encode()).hexdigest())
        link = hashlib.sha256(b"d").hexdigest()
        for t in own:
            link = None if link is None or t is None else hashlib.sha256(f"{link}\n{t}".encode()).hexdigest()
        assert chain[key] == (len(own), link)
    assert chain["k2"][1] is None and audit.list_hash(df.limit(0), ["key"], ["i"], F.col("text")).count() == 0


@pytest.mark.parametrize("step", ["tables", "manifest", "check", "wrong", "rename", "refused", "sentinel"])
def test_a_write_that_dies_at_any_step_leaves_no_bundle(spark, tmp_path, monkeypatch, step):
    path, tables = str(tmp_path / "b"), {"one": spark.range(20), "two": spark.range(3).select(F.col("id").cast("string").alias("s"))}

    class Killed(Exception):
        pass

    def die(*args, **kwargs):
        raise Killed(step)

    class Store:
        def __init__(self, real):
            self.real = real

        def __getattr__(self, name):
            if step == "rename" and name == "rename":
                return die
            if step == "refused" and name == "rename":
                return lambda *a: False
            if step == "sentinel" and name == "delete":
                return lambda at, deep: self.real.delete(at, deep) if deep else die()
            return getattr(self.real, name)

    with monkeypatch.context() as patch:
        if step == "tables":
            calls = []
            patch.setattr(bundle, "write_parquet", lambda *a: calls.append(1) or (die() if len(calls) == 2 else spark.range(1).write.parquet(a[1])))
        elif step == "manifest":
            patch.setattr(bundle, "digest", die)
        elif step == "check":
            patch.setattr(bundle, "_issues", die)
        elif step == "wrong":
            patch.setattr(bundle, "_issues", lambda *a: ["one"])
        else:
            real = bundle._file_system
            patch.setattr(bundle, "_file_system", lambda *a: (Store(real(*a)[0]), real(*a)[1]))
        with pytest.raises((Killed, ValueError, OSError)):
            bundle.write_bundle(spark, path, tables, {"n": 1})
    assert not bundle.finished(spark, path) and bundle.audit_bundle(spark, path) == ["unfinished"]
    with pytest.raises(ValueError, match="finished"):
        bundle.read_bundle(spark, path)
    if step == "sentinel":
        with pytest.raises(FileExistsError):
            bundle.write_bundle(spark, path, tables, {"n": 1})
    else:
        manifest = bundle.write_bundle(spark, path, tables, {"n": 1})
        assert bundle.finished(spark, path) and bundle.audit_bundle(spark, path) == []
        told, back = bundle.read_bundle(spark, path)
        assert told == manifest and back["one"].count() == 20 and not (tmp_path / "b.staging").exists()


def test_streams_go_on_only_from_what_they_left(spark, tmp_path):
    rows = random_updates(17, 300)
    source, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))

    def arrive(part, where=source):
        spark.createDataFrame(part, book.UPDATES).coalesce(1).write.mode("append").parquet(where)

    def run(config, into=out, checkpoint=mark, where=source):
        return resume.go_on(spark, where, book.UPDATES, book.synchronize, into, checkpoint, config)

    arrive(rows[:150])
    first = run({"v": 1})
    kept = str(tmp_path / "kept")
    shutil.copytree(source, f"{kept}/in")
    shutil.copytree(mark, f"{kept}/mark")
    with pytest.raises(resume.ResumeRefused, match="config"):
        run({"v": 2})
    point = tmp_path / "mark.point"
    part = next(point.glob("part-*"))
    text = part.read_text()
    for crc in point.glob(".part-*"):
        crc.unlink()
    part.write_text(text.replace(first["state_digest"], "0" * 64))
    with pytest.raises(resume.ResumeRefused, match="as it was written"):
        run({"v": 1})
    part.write_text(text)

    # another run's state in place of this one's
    other = str(tmp_path / "other")
    arrive(rows[20:150], f"{other}/in")
    run({"v": 1}, f"{other}/out", f"{other}/mark", f"{other}/in")
    shutil.rmtree(f"{mark}/state")
    shutil.copytree(f"{other}/mark/state", f"{mark}/state")
    with pytest.raises(resume.ResumeRefused, match="state_digest"):
        run({"v": 1})
    shutil.rmtree(f"{mark}/state")
    shutil.copytree(f"{kept}/mark/state", f"{mark}/state")

    # other rows in a file that was taken in
    name = next((tmp_path / "in").glob("part-*"))
    shutil.copy(next((tmp_path / "other" / "in").glob("part-*")), name)
    for crc in (tmp_path / "in").glob(".part-*"):
        crc.unlink()
    with pytest.raises(resume.ResumeRefused, match="input_digest"):
        run({"v": 1})
    shutil.copy(f"{kept}/in/{name.name}", name)

    arrive(rows[150:])
    assert run({"v": 1})["files"] == 2
    whole = book.synchronize_table(spark.createDataFrame(rows, book.UPDATES))
    assert sorted(map(tuple, spark.read.parquet(out).collect())) == sorted(map(tuple, whole.collect()))
    shutil.rmtree(point)
    with pytest.raises(resume.ResumeRefused, match="without a point"):
        run({"v": 1})


def test_time_below_a_nanosecond_is_kept(spark):
    texts = ["1.5", "1.5000000001", "1.500000000100000001", "0", "-0.0000000001", "1e-10", "x", None, "99999999999999999999", "1780500354.123456789"]
    found = [tuple(r.k) if r.k else None for r in spark.createDataFrame([(t,) for t in texts], "t string").select(ticks.time_key(F.col("t")).alias("k")).collect()]
    assert found == [(1_500_000_000, 0), (1_500_000_000, 100_000_000), (1_500_000_000, 100_000_001), (0, 0), (-1, 900_000_000), (0, 100_000_000), None, None, None, (1780500354123456789, 0)]
    whole = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(ticks.whole_ns(F.col("t"))).collect()]
    assert whole == [1_500_000_000, None, None, 0, None, None, None, None, None, 1780500354123456789]

    rng = random.Random(4)
    rows = [(rng.choice("AB"), rng.randrange(3), rng.randrange(4) * 250_000_000, i) for i in range(200)]
    df = spark.createDataFrame(rows, "symbol string, ns long, subns long, seq long")
    upto = {r.seq: r.u for r in running(df, ["symbol"], F.col("ns"), ["ns", "subns", "seq"], {"u": ("sum", F.lit(1))}).collect()}
    for symbol, ns, subns, seq in rows:
        assert upto[seq] == sum(s == symbol and (n, b, q) <= (ns, subns, seq) for s, n, b, q in rows)
    marks = df.where("seq % 2 = 0").withColumn("at", ticks.time_of(F.col("ns"), F.col("subns")))
    met = asof(df.where("seq % 2 = 1"), marks, ["symbol"], ticks.time_of(F.col("ns"), F.col("subns")), F.col("at"), ["seq"]).collect()
    for r in met:
        before = [(n, b, q) for s, n, b, q in rows if s == r.symbol and q % 2 == 0 and (n, b) <= (r.ns, r.subns)]
        assert r.seq_asof == (max(before)[2] if before else None)


def test_times_of_old_tapes_keep_their_order(spark):
    lines = [f'{{"ts_local": {t}, "type": "aggTrade", "symbol": "A", "data": {{"p": "1", "q": "1", "m": true}}}}' for t in ("5.0000000002", "5.0000000001", "5.0000000010")]
    rows = spark.createDataFrame(list(enumerate(lines, 1)), "line long, value string").select(F.lit("f").alias("path"), "line", "value", F.array().cast("array<string>").alias("reasons"))
    found = tape.normalize(rows).orderBy("recv_monotonic_ns", "logical_subns").collect()
    assert [(r.source_row_seq, r.recv_monotonic_ns, r.logical_subns) for r in found] == [(2, 5_000_000_000, 100_000_000), (1, 5_000_000_000, 200_000_000), (3, 5_000_000_001, 0)]


def test_paired_bootstrap_draws_both_series_in_the_same_blocks(spark):
    rng = np.random.default_rng(5)
    a, b = rng.normal(0, 1, 40), rng.normal(0.5, 1, 40)
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(zip(a, b))], "day long, a double, b double")
    found = research.paired_bootstrap(df, "day", "a", "b", block=4, replicates=500, seed=9).first()
    blocks, means = 10, []
    for r in range(500):
        draws = np.arange(r * blocks + 1, (r + 1) * blocks + 1, dtype=np.uint64)
        starts = (research.splitmix64(np.uint64(9) + draws * np.uint64(research.GAMMA)) % np.uint64(37)).astype(int)
        at = (starts[:, None] + np.arange(4)).ravel()[:40]
        means.append(a[at].mean() - b[at].mean())
    assert found.estimate == pytest.approx(a.mean() - b.mean()) and (found.low, found.high) == pytest.approx(tuple(np.percentile(means, [2.5, 97.5])))
    with pytest.raises(ValueError, match="pair"):
        research.paired_bootstrap(spark.createDataFrame([(1, 1.0, None)], "day long, a double, b double"), "day", "a", "b", block=1, replicates=1, seed=1)
