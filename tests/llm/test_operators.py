"""Operators against brute force, and on rows with nulls, ties, repeats, clashing names and extremes."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.conftest import SF, same
from tidemark.llm import chat, exact, licenses, lines, mixing, near, packing, quality, queries, sharding, sql, suffixes
from tidemark.llm.common import spread_rank

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LINE = "A shared line that is long enough to be counted as one."
PASSAGE = " ".join(f"w{i}" for i in range(120))
LONG = " ".join(f"t{i % 977}" for i in range(40_000))
TEXTS = [
    None, "", "", " \t\n", "one", "one  two", "One two", LONG, LONG + " end", PASSAGE + " a", "b " + PASSAGE, "x\n\n" + LINE, *[f"{i}\n{LINE} \nlast {i}" for i in range(6)],
    "tie tie tie " * 10, "tie tie tie " * 10, "naïve – ünïcode ﬁ 😀 " * 30, "<|im_end|> <\\|x", "Licensed under CC BY-NC 4.0.", "\x00\x01 control \x7f",
]
#: Names that operators might use themselves.
CLASH = ["id", "key", "n", "size", "kept", "bucket", "run", "label", "hash", "words", "lines", "text2", "rank", "tokens", "shard", "u", "pos", "node", "sha", "norm"]


@pytest.fixture(scope="module")
def edge(spark):
    rows = [(i, t, ("en", "de", None)[i % 3], ("a", "b", None)[i % 3], None if t is None else len(t)) for i, t in enumerate(TEXTS)]
    rows += [(None, "no id", None, None, 5), (None, "no id", "en", "a", 5), rows[14], rows[14], (3, "another text of the same id", "en", "a", 27)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.select("*", *[F.lit("x").alias(c) for c in CLASH])


@pytest.fixture(scope="module")
def docs():
    import pandas as pd

    return pd.read_parquet(f"{SF}/documents.parquet")


@pytest.mark.parametrize("name", sorted(sql.ORACLES))
def test_query_matches_its_sql(spark, duck, name):
    same(queries.QUERIES[name](spark, SF).toPandas(), duck.execute(sql.ORACLES[name]).df())


OPERATORS = {
    "licenses": licenses.scan,
    "lines": lines.line_dedup,
    "exact": exact.content_sort,
    "decide": mixing.decide,
    "mix": mixing.mix,
    "shard": sharding.shard,
    "near": near.link,
    "near_filter": near.near_filter,
    "suffixes": suffixes.remove,
    "judge": quality.judge,
    "quality_filter": quality.quality_filter,
    "pack": packing.pack,
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_table(spark, edge, name):
    assert OPERATORS[name](edge.limit(0)).count() == 0


def test_lines_on_edge_rows(edge):
    out = lines.line_dedup(edge)
    assert out.columns[: len(edge.columns)] == edge.columns
    rows = out.collect()
    assert len(rows) == edge.count()
    found = {r.doc_id: r for r in rows if r.doc_id is not None and r.doc_id not in (3, 14)}
    assert found[0].text == "" and found[0].n_lines == 1 and found[0].n_dropped == 0
    keeper = max(i for i, t in enumerate(TEXTS) if t and LINE in t)
    for i, t in enumerate(TEXTS):
        if i in found and t and LINE in t:
            kept = [x for x in t.split("\n") if i == keeper or LINE not in x]
            assert (found[i].text, found[i].n_dropped) == ("\n".join(kept), 0 if i == keeper else 1)


def test_exact_on_edge_rows(edge):
    rows = exact.content_sort(edge).collect()
    assert len(rows) == edge.count() and sum(r.kept for r in rows) == len({r.text_sha256 for r in rows})
    groups = collections.defaultdict(list)
    for r in edge.select("doc_id", "text").collect():
        groups[hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "").encode()).hexdigest()].append(r.doc_id)
    for r in rows:
        ids = groups[r.text_sha256]
        assert r.group_size == len(ids) and r.keep_id == min((i for i in ids if i is not None), default=None)


def test_exact_joins_runs_that_span_buckets(spark):
    rows = [(i, ("same text", "b", f"u{i}")[0 if i % 3 else i % 2 + 1]) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    out = exact.content_sort(df, samples_per_bucket=40, buckets_per_partition=10).collect()
    sizes = collections.Counter(t for _, t in rows)
    first = {t: min(i for i, x in rows if x == t) for _, t in rows}
    assert all((r.group_size, r.keep_id, r.kept) == (sizes[t], first[t], r.doc_id == first[t]) for r in out for t in [dict(rows)[r.doc_id]])


def test_mixing_meets_targets_to_a_word(spark, edge):
    for df in (edge, spark.read.parquet(f"{SF}/documents.parquet")):
        rows = mixing.decide(df).collect()
        assert len(rows) == df.count()
        by = collections.defaultdict(lambda: [0, 0, 0])
        for r in rows:
            assert 0 <= r.taken <= 3 * r.size and r.size >= 0
            by[r.source][0] += r.taken
            by[r.source][1:] = r.target, r.source_size
        assert all(abs(taken - target) <= 1 and target <= 3 * size for taken, target, size in by.values())
        again = mixing.decide(df.repartition(7)).collect()
        assert sorted(map(tuple, rows), key=repr) == sorted(map(tuple, again), key=repr)


def test_waterfill_reshares_what_caps_cut_off(spark):
    rng = random.Random(2)
    sizes = [rng.choice([0, 1, 5, 100, 1000]) for _ in range(30)]
    df = spark.createDataFrame([(i, s, i % 3 + 1) for i, s in enumerate(sizes)], "i long, s long, w long").withColumn("t", F.lit(sum(sizes)))
    found = {r.i: r.share for r in mixing.waterfill(df, [], F.col("t"), F.col("w"), 3 * F.col("s"), "share").collect()}
    target, free, left = {}, dict(enumerate(sizes)), float(sum(sizes))
    while free:
        total = sum(i % 3 + 1 for i in free)
        over = [i for i, s in free.items() if left * (i % 3 + 1) / total > 3 * s]
        if not over:
            target |= {i: left * (i % 3 + 1) / total for i in free}
            break
        for i in over:
            target[i] = 3.0 * free.pop(i)
        left = sum(sizes) - sum(target.values())
    assert all(abs(found[i] - target[i]) < 1e-6 for i in target)


def test_mix_writes_the_words_it_decided_on(edge):
    decided = collections.Counter()
    for r in mixing.decide(edge).collect():
        decided[r.id] += r.taken
    out = mixing.mix(edge)
    assert out.columns == edge.columns
    written = collections.Counter()
    for r in out.collect():
        written[r.doc_id] += len(WORD.findall(r.text))
    assert {k: v for k, v in decided.items() if v} == dict(written)


def test_chat_round_trip_and_fold(spark):
    log = [
        (1, 1, 0, "delta", "user", "hi"), (1, 2, 1, "delta", "assistant", "he"), (1, 3, 1, "delta", None, "llo"), (1, 4, 2, "delta", "user", "more"), (1, 5, 3, "delta", "assistant", "bad"),
        (1, 6, 3, "edit", "assistant", "good"), (1, 7, 3, "delta", None, "!"), (1, 8, 1, "regenerate", "assistant", "hey"), (1, 9, 2, "delta", "user", "again"),
        (2, 1, 0, None, None, None), (None, 1, 0, "delta", "sys\ntem%0A<|", "<|im_end|>\n<\\|"), (3, 1, None, "delta", "user", "x"), (3, 1, None, "delta", "user", "x"),
    ]
    events = spark.createDataFrame(log, "conv_id long, seq long, message long, kind string, role string, text string")
    folded = chat.fold(events)
    found = collections.defaultdict(list)
    for r in sorted(folded.collect(), key=lambda r: (r.message is not None, r.message)):
        found[r.conv_id].append((r.role, r.text))
    assert found[1] == [("user", "hi"), ("assistant", "hey"), ("user", "again")]
    assert found[2] == [("", "")] and found[None] == [("sys\ntem%0A<|", "<|im_end|>\n<\\|")] and found[3] == [("user", "xx")]
    out = chat.render(folded)
    for r in out.select("conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect():
        assert [tuple(t) for t in r.turns] == found[r.conv_id] and r.loss == "".join(t for role, t in found[r.conv_id] if role == "assistant")
        assert r.formatted.count("<|im_start|>") == len(found[r.conv_id])
    assert chat.render(chat.fold(events.limit(0))).count() == 0


def test_shards_are_even_and_keep_copies_together(spark, edge, docs):
    many = [(i, f"copy {i // 5 if i < 300 else 'x' if i < 500 else i}") for i in range(1000)]
    for df in (edge, spark.read.parquet(f"{SF}/documents.parquet"), spark.createDataFrame(many, "doc_id long, text string")):
        rows = sharding.shard(df).collect()
        assert len(rows) == df.count()
        by = collections.defaultdict(list)
        for r in rows:
            by[r.shard].append(r.slot)
        sizes = [len(by[s]) for s in range(24)]
        assert max(sizes) - min(sizes) <= 1 and all(sorted(v) == list(range(len(v))) for v in by.values())
    where = {r.doc_id: r.shard for r in rows}
    split = sum(len({where[i] for i in range(5 * g, 5 * g + 5)}) > 1 for g in range(60))
    assert split <= 6, "small groups stay together"
    texts = dict(zip(docs.doc_id, docs.text))
    for r in sharding.shard(spark.read.parquet(f"{SF}/documents.parquet")).collect():
        assert r.size == len(texts[r.doc_id].encode()) + 8 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode())


def test_pairs_stay_together_where_every_document_has_a_copy(spark):
    rows = sharding.shard(spark.createDataFrame([(i, f"pair {i // 2}") for i in range(4800)], "doc_id long, text string")).collect()
    assert set(collections.Counter(r.shard for r in rows).values()) == {200}
    where = {r.doc_id: r.shard for r in rows}
    split = sum(where[i] != where[i + 1] for i in range(0, 4800, 2))
    assert split <= 120, "at most a twentieth"


def test_grants_count_what_leaves():
    assert sharding.grants([(0, 1, 0, 5), (1, 0, 0, 5)], [0, 0]) == {(1, 0): 1.0, (0, 0): 1.0}
    part = sharding.grants([(0, 1, 0, 8), (1, 0, 0, 2), (1, 0, 2, 4)], [0, 2])
    assert part == {(1, 0): 1.0, (0, 0): 1.0, (0, 2): 1.0}
    assert sharding.grants([(0, 1, 0, 8)], [0, -1]) == {(1, 0): 0.0}


def components(texts, words, percent):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        k = min(words, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if k else set())
    parent = list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))], [len(s) for s in sets]


@pytest.mark.parametrize("words,percent", [(3, 85), (5, 80)])
def test_near_groups_equal_brute_force(spark, words, percent):
    rng = random.Random(words)
    bases = [[f"v{rng.randrange(400)}" for _ in range(80)] for _ in range(4)]
    texts = ["", None, "one", "ONE", "one two"]
    for i in range(220):  # groups of copies with few to many changed words: chains and outliers
        w = list(bases[0 if i % 2 else i % 4])
        for _ in range(rng.randrange(0, 9)):
            w[rng.randrange(80)] = f"m{rng.randrange(60)}"
        texts.append(" ".join(w))
    rng.shuffle(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels, sizes = components(texts, words, percent)
    rows = near.link(df, words=words, percent=percent, miss=1e-7).collect()
    assert len(rows) == len(texts)
    assert all((r.component_id, r.n_shingles, r.kept) == (labels[r.doc_id], sizes[r.doc_id], labels[r.doc_id] == r.doc_id) for r in rows)


def test_near_on_edge_rows(edge):
    rows = near.link(edge).collect()
    assert len(rows) == edge.count()
    found = {r.doc_id: r for r in rows}
    assert found[0].n_shingles == found[1].n_shingles == 0 and found[1].component_id == 1 and found[1].kept
    assert found[8].component_id == 7 and not found[8].kept and all(r.component_id is None and r.kept for r in rows if r.doc_id is None)
    out = near.near_filter(edge)
    assert out.columns == edge.columns and 8 not in {r.doc_id for r in out.collect()}


def repeats(texts, length):
    count = collections.Counter(t[p : p + length] for t in texts for p in range(len(t) - length + 1))
    for t in texts:
        cut = bytearray(len(t))
        for p in range(len(t) - length + 1):
            if count[t[p : p + length]] > 1:
                cut[p : p + length] = b"\1" * length
        yield len(t), sum(cut), len(re.findall(b"\1+", bytes(cut))), bytes(c for c, x in zip(t, cut) if not x)


@pytest.mark.parametrize("most", [8192, 3])
def test_repeated_strings_equal_brute_force(spark, monkeypatch, most):
    rng = random.Random(4)
    whole = suffixes.repeated_spans
    monkeypatch.setattr(suffixes, "repeated_spans", lambda docs, length: whole(docs, length, most))
    passage = "".join(rng.choice("abcdefgh ") for _ in range(90))
    texts = ["".join(rng.choice("abc") for _ in range(rng.randrange(80))) + passage[rng.randrange(20) : rng.randrange(60, 90)] + "".join(rng.choice("xyz") for _ in range(rng.randrange(30))) for _ in range(60)]
    texts += ["a" * 100, "ab" * 70, "", texts[3], texts[5] + texts[6], "é" * 60]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffixes.remove(df, length=40).collect()}
    assert [found[i] for i in range(len(texts))] == list(repeats([t.encode() for t in texts], 40))


def test_repeated_strings_where_skewed_joins_are_split(spark, monkeypatch):
    """Strings of one core stay together though the join on it deals a large core's rows to several tasks."""
    skewed = {"autoBroadcastJoinThreshold": "-1", "shuffle.partitions": "16", "adaptive.coalescePartitions.enabled": "false", "adaptive.advisoryPartitionSizeInBytes": "1k", "adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k", "adaptive.skewJoin.skewedPartitionFactor": "1.5"}
    before = {k: spark.conf.get(f"spark.sql.{k}") for k in skewed}
    rng = random.Random(6)
    whole = suffixes.repeated_spans
    monkeypatch.setattr(suffixes, "repeated_spans", lambda docs, length: whole(docs, length, 40))
    line = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    common = line(30)
    # pairs of texts share what stands beside a line that all texts hold
    pairs = [line(15) + common + line(15) for _ in range(300)]
    texts = [line(20) + p + line(20) for p in pairs * 2]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    try:
        for k, v in skewed.items():
            spark.conf.set(f"spark.sql.{k}", v)
        found = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffixes.remove(df, length=40).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(f"spark.sql.{k}", v)
    assert [found[i] for i in range(len(texts))] == list(repeats([t.encode() for t in texts], 40))


def test_repeated_strings_on_edge_rows(edge):
    rows = [(r.doc_id, r.text or "") for r in edge.select("doc_id", "text").collect()]
    wanted = sorted(zip([i for i, _ in rows], repeats([t.encode() for _, t in rows], 400)), key=repr)
    found = sorted(((r.doc_id, (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept))) for r in suffixes.remove(edge).collect()), key=repr)
    assert found == wanted


def test_repeated_strings_of_documents(spark, docs):
    found = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.op8_suffix_array_dedup(spark, SF).collect()}
    for i, (n, removed, spans, kept) in zip(docs.doc_id, repeats([t.encode() for t in docs.text], 400)):
        assert found[i] == (n, removed, spans, hashlib.sha256(kept).hexdigest())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=90).map(lambda b: bytes(x % 3 + 97 for x in b)), min_size=1, max_size=40))
def test_deep_shallow_sorts(strings):
    strings = strings + [b"a" * 50 + s for s in strings]
    order, shared = suffixes.deep_shallow(strings)
    assert sorted(order) == list(range(len(strings))) and [strings[i] for i in order] == sorted(strings)
    for i in range(1, len(order)):
        assert shared[i] == next((k for k, (a, b) in enumerate(zip(strings[order[i]], strings[order[i - 1]])) if a != b), min(len(strings[order[i]]), len(strings[order[i - 1]])))


def statistics(text):
    text = text or ""
    words = WORD.findall(text)
    worded = [x for x in text.split("\n") if WORD.search(x)]
    at = collections.defaultdict(list)
    for i in range(len(words) - 7):
        at[tuple(words[i : i + 8])].append(i)
    covered = {i + k for p in at.values() if len(p) > 1 for i in p for k in range(8)}
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(worded) - len(set(worded)), len(covered), n < 20 or 100 * len(covered) > 30 * n


def test_quality_statistics_equal_brute_force(spark, edge):
    for df in (edge, spark.read.parquet(f"{SF}/documents.parquet")):
        rows = quality.judge(df).collect()
        wanted = sorted(((r.doc_id, *statistics(r.text)) for r in df.select("doc_id", "text").collect()), key=repr)
        found = sorted(((r.id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows), key=repr)
        assert found == wanted and not any(r.kept and r.base_failed for r in rows)


def test_quality_estimates_resist_outliers(spark):
    rng = np.random.default_rng(1)
    clean, junk = rng.multivariate_normal([1600, 300, 900, 500], np.diag([60, 400, 700, 650]) ** 2, 900), rng.normal(4500, 200, (150, 4))
    rows = [("l", "s", *map(int, x)) for x in np.concatenate((clean, junk))]
    df = spark.createDataFrame(rows, "lang_key string, source_key string, x0 long, x1 long, x2 long, x3 long")
    r = quality.estimate(df).first()
    assert all(abs(r[f"m{i}"] * 1000 - m) < 60 for i, m in enumerate([1600, 300, 900, 500]))
    lower = np.array([[r[f"w{i}{j}"] if j <= i else 0.0 for j in range(4)] for i in range(4)])
    off = np.array([x[2:] for x in rows]) / 1000 - [r[f"m{i}"] for i in range(4)]
    d2 = (off @ lower.T**1) ** 2
    cut = quality.chi2_quantile(1 - 1e-6)
    assert (d2.sum(axis=1)[:900] <= cut).all() and (d2.sum(axis=1)[900:] > cut).all()
    assert abs(quality.chi2_quantile(0.95) - 9.487729) < 1e-5


def test_each_quality_statistic_rejects_on_its_own(spark):
    plain = lambda i, n: [f"word{i}x{k}"[-7:] for k in range(n)]
    rows = [(i, " ".join(plain(i, 200))) for i in range(60)]
    rows.append((60, " ".join(plain(60, 760) + 30 * plain(61, 8))))  # 24 % in repeated windows
    rows.append((61, "\n".join(w for k, own in enumerate(plain(61, 140)) for w in ([own, "again22"] if k < 61 else [own]))))  # 60 duplicate lines
    rows.append((62, " ".join(w + "#" * (k % 3 == 0) for k, w in enumerate(plain(62, 200)))))
    rows.append((63, " ".join(w * 4 for w in plain(63, 200))))
    judged = {r.id: r for r in quality.judge(spark.createDataFrame([(*r, "en", "s") for r in rows], "doc_id long, text string, lang string, source string")).collect()}
    assert all(judged[i].kept for i in range(60))
    assert not any(judged[i].base_failed or judged[i].kept for i in (60, 61, 62, 63))


def test_quality_keeps_labelled_good_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = quality.judge(docs).join(labels, F.col("id") == labels.doc_id).collect()
    assert not [r.id for r in rows if r.quality == 1 and not r.kept and not r.base_failed]
    assert sum(r.kept for r in rows if r.quality == 0) <= 0.1 * sum(r.quality == 0 for r in rows)


def ids_of(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return [np.array([*e.ids, 1], dtype="<u4") for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


@settings(max_examples=80, deadline=None)
@given(st.text(max_size=60))
def test_encoder_equals_the_tokenizer(text):
    text = text.encode("utf-8", "ignore").decode() + "<|endoftext|>"
    assert packing.encoder()(text) == ids_of([text])[0][:-1].tolist()


def test_encoder_takes_long_runs():
    for text in (" " * 2_000_000, "\n" * 300_000 + "x", "a" * 300_000):
        assert packing.encoder()(text) == ids_of([text])[0][:-1].tolist()


@pytest.mark.parametrize("table", ["edge", "documents"])
def test_packing_places_every_id_once(spark, edge, table):
    df = edge if table == "edge" else spark.read.parquet(f"{SF}/documents.parquet")
    source = df.select("doc_id", "text").collect()
    rows = packing.pack(df).collect()
    by_seq = collections.defaultdict(list)
    for r in rows:
        by_seq[r.sequence_id].append(r)
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at == 2048 or at & (at - 1) == 0
    ids = collections.defaultdict(list)
    for r, x in zip(source, ids_of([r.text for r in source])):
        ids[r.doc_id].append(x)
    pieces = collections.defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append((r.start, r.length, r.ids_crc32, r.doc_tokens))
    assert set(pieces) == set(ids)
    for i, found in pieces.items():
        assert sum(p[1] for p in found) == sum(map(len, ids[i]))
        assert all(any(len(x) == total and zlib.crc32(x[start : start + n].tobytes()) == crc for x in ids[i]) for start, n, crc, total in found)
        if len(ids[i]) == 1:
            ends = sorted(found)
            assert all(a[0] + a[1] == b[0] for a, b in zip(ends, ends[1:])) and ends[0][0] == 0


def test_combinations_use_what_there_is():
    lengths = np.zeros(2049, dtype="int64")
    lengths[[100, 1948, 500, 1048, 2000, 7]] = [10, 8, 6, 5, 3, 50]
    patterns = packing.combinations(lengths, 2048)
    uses = packing.repeat_counts(lengths, patterns)
    used = collections.Counter()
    for p, n in zip(patterns, uses):
        assert sum(p) == 2048
        used.update({k: n * p.count(k) for k in set(p)})
    assert used[100] >= 8 and used[1948] == 8 and all(used[k] <= lengths[k] for k in used)


def test_licenses_on_every_template_and_edge_rows(spark, edge):
    scanner = licenses.Scanner()
    for name, texts in licenses.TEMPLATES.items():
        for text in texts:
            found = scanner(f"first line\n{text}\nlast line")
            assert [(n.license, n.differences, n.line) for n in found] == [(name, 0, 1)]
            words = text.split()
            half = len(words) // 2
            assert [n.license for n in scanner("first line\n" + " ".join(words[:half]) + "\n" + " ".join(words[half:]) + "\nlast line")] == [name]
            changed = text.split()
            if len(changed) > 12:
                changed[8] = "changed"
                assert [(n.license, n.differences <= 1) for n in scanner(" ".join(changed))] == [(name, True)]
    assert not scanner("My driving license gave me permission to enter the public domain.")
    rows = licenses.scan(edge).collect()
    assert [(r.doc_id, r.license, r.start) for r in rows] == [(next(i for i, t in enumerate(TEXTS) if t and "CC BY" in t), "CC-BY-NC-4.0", 0)]


def test_licenses_equal_a_word_by_word_search(spark, docs):
    known = {tuple(w for w, _, _ in licenses.tokens(t)): name for name, ts in licenses.TEMPLATES.items() for t in ts}
    wanted = set()
    for i, text in zip(docs.doc_id, docs.text):
        for k, line in enumerate(text.split("\n")):
            words = [w for w, _, _ in licenses.tokens(line)]
            for template, name in known.items():
                if any(tuple(words[a : a + len(template)]) == template for a in range(len(words))):
                    wanted.add((i, k, name))
    found = {(r.doc_id, r.line, r.license) for r in queries.op1_license_scans(spark, SF).where("differences = 0").collect()}
    assert found == wanted and wanted


def test_licenses_are_found_anywhere_in_a_long_line():
    scanner, rng = licenses.Scanner(), random.Random(5)
    plain = ["the", "river", "free", "of", "any", "work", "person", "under", "terms", "and", "to", "copy", "notice", "house", "year", "without"]
    for name, texts in licenses.TEMPLATES.items():
        for text in texts:
            for before, after in ((60, 0), (300, 0), (120, 120), (0, 300)):
                line = [" ".join(rng.choice(plain) for _ in range(n)) for n in (before, after)]
                found = scanner(f"{line[0]}. {text} {line[1]}")
                assert [(n.license, n.differences, n.start) for n in found] == [(name, 0, len(line[0]) + 2)]


def test_licenses_of_one_line_are_all_found():
    scanner = licenses.Scanner()
    every = [(name, text) for name, texts in licenses.TEMPLATES.items() for text in texts]
    for name, text in every:
        for other, more in every:
            found = scanner(f"{text} {more}")
            assert [(n.license, n.differences, n.line, n.start) for n in found] == [(name, 0, 0, 0), (other, 0, 0, len(text) + 1)]
    assert [(n.line, n.license) for n in scanner("x Released under the\nMIT License. All rights\nreserved.")] == [(0, "MIT"), (1, "all-rights-reserved")]
    whole = scanner(" ".join(text for _, text in every))
    assert [n.license for n in whole] == [name for name, _ in every]


@pytest.mark.parametrize("mark", ["\n", "  ", "\n# ", "\r\n * "])
def test_licenses_broken_at_any_word(spark, mark):
    rows = []
    for name, texts in licenses.TEMPLATES.items():
        for words in (text.split() for text in texts):
            rows += [(f"{name} {len(rows) + i}", " ".join(words[:i]) + mark + " ".join(words[i:])) for i in range(1, len(words))]
    found = licenses.scan(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert sorted((r.doc_id, r.license, r.differences) for r in found) == sorted((i, i.split()[0], 0) for i, _ in rows)


def test_spread_rank_is_a_dense_rank(spark):
    df = spark.range(500).select("id", (F.col("id") % 3).alias("p")).cache()
    rows = spread_rank(df, ["p"], F.xxhash64("id"), ["id"], "r", buckets=7).collect()
    for p in range(3):
        assert sorted(r.r for r in rows if r.p == p) == list(range(1, sum(r.p == p for r in rows) + 1))


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == list(corpus_pipeline.COLUMNS), name
    assert 0 < docs.count() <= kept
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() > 0


def test_near_filter_keeps_one_row_of_a_component(spark):
    t, other, last = ("alpha beta gamma delta epsilon zeta eta theta", "one two three four five six", "seven eight nine ten eleven twelve")
    rows = [(5, t), (None, t), (None, other), (None, other), (9, last), (9, last), (8, "x y z a b c d e"), (8, "another text of this id"), (None, ""), (None, None), (4, " "), (4, " ")]
    out = near.near_filter(spark.createDataFrame(rows, "doc_id long, text string").withColumn("label", F.lit("x"))).collect()
    by = collections.Counter((r.doc_id, r.text) for r in out)
    assert by[5, t] == by[None, other] == by[9, last] == 1 and (None, t) not in by
    assert sum(n for (i, _), n in by.items() if i == 8) == 1
    assert (by[None, ""], by[None, None], by[4, " "]) == (1, 1, 2) and out[0].label == "x"


def test_near_finds_long_chains(spark):
    """Far more links in a row than a fixed number of rounds would follow, if each followed one."""
    edges = spark.createDataFrame([(i, i + 1) for i in range(3000)], "x long, y long").repartition(4)
    assert {(r.node, r.label) for r in near.components(edges).collect()} == {(i, 0) for i in range(3001)}


def test_mix_of_repeated_rows(spark):
    rows = [(i % 7, f"word{i % 7} " * (i % 5 + 1), ("a", "b")[i % 2]) for i in range(60)] + [(None, "no id at all", None)] * 5
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    decided, written = collections.Counter(), collections.Counter()
    for r in mixing.decide(df).collect():
        decided[r.id, r.source] += r.taken
    for r in mixing.mix(df).collect():
        written[r.doc_id, r.source] += len(WORD.findall(r.text))
    assert {k: v for k, v in decided.items() if v} == dict(written)


def test_mixing_ranks_nothing_that_is_certain(spark):
    """A source at its cap takes whole copies only: its rows have no inclusion probability and stay out of the window."""
    rows = [(i, f"w{i} x y", "small" if i % 10 == 0 else "big") for i in range(300)]
    out = mixing.decide(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert all(r.taken == 9 for r in out.where("source = 'small'").collect())
    for line in out._jdf.queryExecution().optimizedPlan().toString().split("\n"):
        assert "Window" not in line or "bucket" not in line or "rank" in line


def test_exact_with_texts_that_begin_alike(spark):
    head, rng = "a common header of more than sixty-four characters, the same everywhere " * 3, random.Random(8)
    rows = [(i, head + (f"tail {rng.randrange(30)}" if i % 3 else "the hot text")) for i in range(900)]
    out = exact.content_sort(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), buckets_per_partition=12, samples_per_bucket=20).collect()
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[t].append(i)
    for r in out:
        ids = groups[rows[r.doc_id][1]]
        assert (r.keep_id, r.group_size, r.kept) == (min(ids), len(ids), r.doc_id == min(ids))


def test_a_cluster_needs_a_shared_checkpoint_folder():
    from types import SimpleNamespace

    from tidemark.llm import common

    context = SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077", setCheckpointDir=lambda _: None)
    df = SimpleNamespace(sparkSession=SimpleNamespace(sparkContext=context, conf={"a": 1}))
    with pytest.raises(ValueError):
        common.materialize(df)


def test_quality_estimates_have_the_least_determinant_of_all_starts(spark):
    rng = np.random.default_rng(6)
    rows = np.concatenate((rng.multivariate_normal([1600, 900, 900, 800], np.diag([80, 500, 600, 600]) ** 2, 500), rng.multivariate_normal([1900, 3300, 200, 2500], np.diag([30, 300, 300, 300]) ** 2, 160)))
    x = rows.round().astype(int)
    df = spark.createDataFrame([("l", "s", *map(int, r)) for r in x], "lang_key string, source_key string, x0 long, x1 long, x2 long, x3 long")
    found = quality.estimate(df).first()
    own, floors = x / 1000, np.diag(np.array(quality.FLOORS) ** 2)

    def step(mean, cov):
        d2 = np.einsum("ij,jk,ik->i", own - mean, np.linalg.inv(cov + floors), own - mean)
        near = np.floor(np.log2(1 + d2) * 64)
        inner = own[near <= next(v for v in np.unique(near) if (near <= v).sum() >= 0.75 * len(own))]
        return inner.mean(axis=0), np.cov(inner.T, bias=True)

    low, middle, high = np.percentile(own, [25, 50, 75], axis=0)
    ends = []
    for mean, cov in ((middle, np.zeros((4, 4))), (middle, np.diag(((high - low) / 1.349) ** 2)), (own.mean(axis=0), np.cov(own.T, bias=True))):
        for _ in range(60):
            mean, cov = step(mean, cov)
        ends.append((np.linalg.slogdet(cov + floors)[1], mean, cov))
    _, mean, cov = min(ends, key=lambda e: e[0])
    weights = np.array([[found[f"w{i}{j}"] if j <= i else 0.0 for j in range(4)] for i in range(4)])
    assert np.allclose([found[f"m{i}"] for i in range(4)], mean, atol=2e-2)
    assert np.allclose(np.linalg.inv(weights.T @ weights), cov * quality.consistency(0.75) + floors, rtol=0.05, atol=0.01)


def test_licenses_name_the_right_relative():
    scanner = licenses.Scanner()
    bsd2, bsd3 = licenses.TEMPLATES["BSD-2-Clause"][1], licenses.TEMPLATES["BSD-3-Clause"][1]
    gpl = licenses.TEMPLATES["GPL-3.0"][1]
    names = lambda text: [(n.license, n.differences) for n in scanner(text)]
    assert names(bsd2) == [("BSD-2-Clause", 0)] and names(bsd3) == [("BSD-3-Clause", 0)]
    assert names(bsd2.replace("source code must", "source codes should").replace("disclaimer in", "notice in")) == [("BSD-2-Clause", 3)]
    assert names(bsd3.replace("Redistributions of", "1. Redistributions of").replace("Neither", "3. Neither")) == [("BSD-3-Clause", 2)]
    for word, name in (("Lesser", "LGPL-3.0"), ("Affero", "AGPL-3.0")):
        text = gpl.replace("GNU General", f"GNU {word} General")
        assert names(text) == [(name, 0)] and names(text.replace("This program", "This library")) == [(name, 1)]
    assert names(gpl.replace("version 3", "version 4")) == []
    assert names(licenses.TEMPLATES["CC-BY-4.0"][1].replace("4.0", "3.0")) == []
    assert names("\n".join(licenses.TEMPLATES["MIT"][2].split())) == [("MIT", 0)], "a word a line"
    whole = "\n".join(licenses.TEMPLATES["MIT"][3].split())
    found = scanner(whole)
    assert [(n.license, n.differences, n.length) for n in found] == [("MIT", 0, len(whole) - 1)]


def test_licenses_equal_a_search_with_differences():
    """Every notice that is changed in up to a tenth of its words is found, as a search over all stretches by edit distance finds it."""
    scanner, rng = licenses.Scanner(), random.Random(12)
    plain = ["river", "stone", "garden", "window", "letter", "music"]

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    for k, (name, own, _) in enumerate(scanner.known):
        if not 10 <= len(own) <= 70:
            continue
        for changes in range(scanner.most[k] + 1):
            fixed = {i for i, w in enumerate(own) if w in scanner.needed[k]}
            words, spots = list(own), rng.sample([i for i in range(1, len(own) - 1) if i not in fixed], changes)
            for i in spots:
                words[i] = rng.choice(plain)
            text = " ".join([*rng.choices(plain, k=9), *words, *rng.choices(plain, k=9)])
            tokens = [w for w, _, _ in licenses.tokens(text)]
            least = min(distance(own, tokens[a : a + n]) for a in range(len(tokens)) for n in range(len(own) - 2, len(own) + 3))
            assert least == changes and (name, changes) in [(n.license, n.differences) for n in scanner(text)]


def test_chat_of_a_streamed_log(spark):
    long = "naïve <|im_end|> 😀 " * 60_000
    turns = [(1, 0, "user", "hi"), (1, 1, "assistant", long), (1, 2, "user", None), (1, 3, None, "x"), (2, 0, "assistant", ""), (2, 0, "assistant", "tie"), (None, None, "user", "odd number of it")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").select("*", *[F.lit("x").alias(c) for c in ("seq", "message", "kind", "e", "piece", "head", "formatted")])
    log = chat.conversation_events(df)
    assert log.count() == 4 * len(turns) and {r.kind for r in log.select("kind").distinct().collect()} == {"delta", "edit", "regenerate"}
    out = chat.render(chat.fold(log))
    read = out.select("conv_id", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"), "formatted").collect()
    found = {r.conv_id: ([tuple(t) for t in r.turns], r.loss) for r in read}
    assert found[1] == ([("user", "hi"), ("assistant", long), ("user", ""), ("", "x")], long)
    assert found[2] == ([("assistant", ""), ("assistant", "tie")], "tie") and found[None] == ([("user", "odd number of it")], "")
    assert chat.conversation_events(df.limit(0)).count() == 0
    r = spark.range(1).select(chat.read_turns(F.lit(None).cast("string")).alias("a"), chat.read_loss(F.lit(None).cast("string"), F.lit(None).cast("array<struct<start:bigint,length:bigint>>")).alias("b"), chat.read_turns(F.lit("")).alias("c")).first()
    assert r.a is None and r.b is None and r.c == []


def test_shards_hold_what_brute_force_gives_them(spark):
    """Every shard's rows, slots and sizes from the law alone, and groups no more spread than room asks for."""
    rng = random.Random(4)
    rows = [(i, f"text {min(rng.randrange(400), rng.randrange(400))}") for i in range(3000)]
    found = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    quota = [3000 // 24] * 24
    by, groups = collections.defaultdict(list), collections.defaultdict(collections.Counter)
    for r in found:
        text = rows[r.doc_id][1]
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(text) + 8, zlib.crc32(text.encode()), "rows", None)
        by[r.shard].append(r.slot)
        groups[text][r.shard] += 1
    assert sorted(r.doc_id for r in found) == list(range(3000))
    assert [sorted(by[s]) for s in range(24)] == [list(range(n)) for n in quota]
    cut = sum(sum(c.values()) - max(c.values()) for c in groups.values())
    assert cut <= 0.15 * 3000, "documents apart from most of their copies, where none without copies makes room"
