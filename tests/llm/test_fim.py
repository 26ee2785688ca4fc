"""Fill-in-middle: Elias-Fano lists, cuts against their definition, and edge rows."""

import hashlib
import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm.test_operators import CLASH, LONG, TEXTS
from tidemark.llm import fim


@given(st.lists(st.integers(0, 1 << 40), min_size=1, max_size=300))
@settings(max_examples=60, deadline=None)
def test_elias_fano_gives_every_value_back(values):
    values = sorted(v % (1 << 20) for v in values)
    listed = fim.EliasFano(iter([np.array(values[:7]), np.array(values[7:], np.int64)]), len(values), values[-1])
    assert [listed[i] for i in range(len(values))] == values
    assert 8 * (len(listed.low) + len(listed.high)) <= len(values) * (3 + max(1, values[-1] // len(values)).bit_length()) + 24


def test_boundaries_are_those_of_the_pattern(monkeypatch):
    monkeypatch.setattr(fim, "CHUNK", 64)
    rng = random.Random(3)
    for text in [t or "" for t in TEXTS if t is not LONG] + ["".join(rng.choice("abZ é<\n😀") for _ in range(n)) for n in (1, 63, 64, 65, 700)]:
        ends = [0]
        for unit in re.findall(r"[A-Za-z]+|[^A-Za-z]", text):
            ends.append(ends[-1] + len(unit))
        bounds = fim.boundaries(text)
        assert [bounds[i] for i in range(len(bounds))] == ends


def wanted(id_, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'null' if id_ is None else id_}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[k : k + 8], 16) for k in (0, 8, 16, 24))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return len(units), "plain", None, None, text
    form = "spm" if h4 % 100 < 20 else "psm"
    return len(units), form, len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}" if form == "psm" else f"<S>{suffix}<P>{prefix}<M>{middle}"


def test_every_row_is_cut_as_defined_and_can_be_restored(spark):
    texts = [*TEXTS, "a <P> b", "<S>", "x<M", "<" * 9, "P>S>M>", *["one text that many have " * 5] * 300]
    rows = [(None if i % 50 == 7 else i, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("*", *[F.lit("x").alias(c) for c in CLASH])
    out = fim.fill_in_middle(docs, part_rows=20)
    found = out.withColumn("back", fim.restore(F.col("output"), F.col("form"))).collect()
    order = lambda r: tuple(map(str, r))
    assert sorted([tuple(r)[:6] for r in found], key=order) == sorted([(i, *wanted(i, t)) for i, t in rows], key=order)
    assert sorted(r["back"] for r in found) == sorted(t or "" for _, t in rows)
    assert {r["form"] for r in found} == {"plain", "psm", "spm"}


def test_texts_of_many_documents_are_dealt_into_parts(spark):
    docs = spark.range(1000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot text").otherwise(F.concat(F.lit("t"), F.col("id"))).alias("text"))
    index = fim.distinct_texts(docs, id_col="doc_id", text_col="text", part_rows=50)
    sizes = [r.n for r in index.where("text = 'hot text'").select(F.size("members").alias("n")).collect()]
    assert len(sizes) > 4 and sum(sizes) == 334 and max(sizes) < 120
    assert index.where("text <> 'hot text'").count() == 666


def test_no_rows(spark):
    assert fim.fill_in_middle(spark.createDataFrame([], "doc_id long, text string")).count() == 0
