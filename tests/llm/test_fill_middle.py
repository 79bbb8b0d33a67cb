"""Fill-in-the-middle against a brute-force version: cuts over a list of units, texts rebuilt by hand."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldnotes.llm import fill_middle

UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]")


def by_hand(doc_id, text):
    """(n, form, prefix_chars, middle_chars, output) by the contract's words."""
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[k : k + 8], 16) for k in (0, 8, 16, 24)]
    units = UNIT.findall(text)
    n = len(units)
    assert "".join(units) == text
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    head, middle, tail = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 20:
        return n, "spm", len(head), len(middle), "<S>" + tail + "<P>" + head + "<M>" + middle
    return n, "psm", len(head), len(middle), "<P>" + head + "<S>" + tail + "<M>" + middle


def texts():
    rng = random.Random(11)
    some = ["", None, "a", "\n", "Ab", "ab1", "é", "naïve café\n\n", "x" * 5000, "1" * 5000, "a<P", "<P>", "a <S> b", "<M", "<<S", "S>", "<", "\U0001f600a\U0001f600"]
    some += ["".join(rng.choice("aZ é9<>PSM\n\t\U0001f600") for _ in range(rng.randrange(1, 300))) for _ in range(300)]
    return some


def test_units_and_places_across_blocks(monkeypatch):
    rng = random.Random(3)
    monkeypatch.setattr(fill_middle, "BLOCK", 7)
    for text in texts():
        text = text or ""
        widths = fill_middle.unit_widths(text)
        assert widths.tolist() == [len(u) for u in UNIT.findall(text)]
        for stride in (2, 3, 16):
            units = fill_middle.SkipList(widths, stride)
            whole = np.concatenate([[0], np.cumsum(widths)])
            ranks = range(len(widths) + 1) if len(widths) < 200 else [0, len(widths), *(rng.randrange(len(widths)) for _ in range(30))]
            assert [units.points_before(r) for r in ranks] == [whole[r] for r in ranks]
    lanes = fill_middle.SkipList(np.ones(5000), 16).lanes
    assert [len(units) for units, _ in lanes] == [5000, 313, 20, 2]


def test_every_text_as_by_hand_and_back(spark):
    rows = [(i, t) for i, t in enumerate(texts())] + [(None, "a b c d"), (None, "a b c d"), (7, "repeated id"), (-3, "below zero")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("form", F.lit("clash")).withColumn("a.b", F.lit(1))
    done = fill_middle.transform(docs).withColumn("back", fill_middle.restored(F.col("output"), F.col("form")))
    assert done.columns == ["doc_id", "a.b", "n", "form", "prefix_chars", "middle_chars", "output", "back"]
    got = sorted(map(repr, ((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back) for r in done.collect())))
    want = sorted(map(repr, ((i, *by_hand(i, t), t or "") for i, t in rows)))
    assert got == want


def test_forms_have_their_shares(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("one two three").alias("text"))
    found = {r.form: r["count"] for r in fill_middle.transform(docs).groupBy("form").count().collect()}
    assert sum(found.values()) == 20_000
    assert found["plain"] == pytest.approx(2000, rel=0.1) and found["spm"] == pytest.approx(3600, rel=0.1)


def test_empty_table(spark):
    assert fill_middle.transform(spark.createDataFrame([], "doc_id long, text string")).collect() == []
