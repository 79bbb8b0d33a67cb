"""The rule ledger against brute force: measurements, bits, policies and ablations counted by hand."""

from __future__ import annotations

import random
import re
from collections import Counter

from pyspark.sql import functions as F

from fieldnotes.llm import rule_ledger

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def by_hand(text):
    """The contract's measurements."""
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen = Counter(windows)
    covered = {j for i, w in enumerate(windows) if seen[w] > 1 for j in range(i, i + 3)}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered), "n_lines": len(lines),
    }


def texts():
    rng = random.Random(12)
    some = [None, "", " \n\t\x0b\f\r ", "a", "a a a a", "a b c a b c", "a b c d", "x y\nx y\n\nx y \n x y", "  a b", "é é é é é", "#*$%&|<> \U0001f600 #", "one\r\ntwo\r\none\r\n", "w " * 5000]
    for k in (2, 3, 5, 40):
        some += ["".join(rng.choice(f"w{rng.randrange(k)}|\n|\t| |  |#|. ".split("|")) + " " for _ in range(rng.randrange(200))) for _ in range(25)]
    return some


def test_measurements(spark):
    rows = list(enumerate(texts())) + [(None, "no id"), (3, "repeated id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_words", F.lit("clash")).withColumn("failed", F.lit("clash")).withColumn("a.b", F.lit(1))
    made = rule_ledger.ledger(docs)
    assert made.columns == ["doc_id", "a.b", *rule_ledger.MEASURES, "failed"]
    got = sorted(repr((r["doc_id"], {m: r[m] for m in by_hand("")})) for r in made.collect())
    assert got == sorted(repr((i, by_hand(t))) for i, t in rows)


def test_each_rule_has_a_text_that_fails_it_and_one_that_passes(spark):
    good = "\n".join(" ".join(f"Word{k}x{j}" for j in range(12)) for k in range(6))
    bad = {
        "few_words": "only these few words", "repeated_words": "buy this now " * 40, "short_words": " ".join("abcdefghij"[k % 10] for k in range(80)),
        "long_words": " ".join("x" * 30 + str(k) for k in range(60)), "symbols": good.replace(" ", "## "), "repeated_lines": (good.split("\n")[0] + "\n") * 8 + good,
        "capitals": good.upper(), "dots_lines": good.replace("\n", "...\n"),
        "bullet_lines": "- " + good.replace("\n", "\n- "), "broken_characters": good + " �", "many_words": " ".join(f"Wörd{k}" for k in range(100_001)),
    }
    rows = [("good", good), *bad.items()]
    failed = {r.name: r.failed for r in rule_ledger.ledger(spark.createDataFrame(rows, "name string, text string")).collect()}
    assert failed["good"] == 0
    for name in bad:
        assert failed[name] & rule_ledger.mask([name]), name
    assert {n for n, _ in rule_ledger.rules()} == set(bad)


def test_policies_and_ablations(spark):
    rng = random.Random(5)
    names = [n for n, _ in rule_ledger.rules()]
    masks = [sum(1 << k for k in range(len(names)) if rng.random() < 0.15) for _ in range(2000)] + [0] * 500
    rows = spark.createDataFrame([(m,) for m in masks], "failed long").repartition(7)
    for policy, members in rule_ledger.POLICIES.items():
        bits = sum(1 << names.index(n) for n in members)
        assert rule_ledger.mask(members) == bits
        kept = [m for m in masks if not m & bits]
        assert rows.filter(rule_ledger.passes(policy)).count() == len(kept)
        for r in rule_ledger.ablations(rows, policy).collect():
            hit = [m for m in masks if m & r.bit]
            without = [m for m in masks if not m & bits & ~r.bit]
            beside, always = 0, -1
            for m in hit:
                beside, always = beside | m, always & m
            assert (r.n, r.n_failed, r.kept, r.kept_without, r.n_only) == (len(masks), len(hit), len(kept), len(without), len(without) - len(kept))
            assert (r.beside, r.always) == (beside, always)


def test_empty_table(spark):
    empty = rule_ledger.ledger(spark.createDataFrame([], "doc_id long, text string"))
    assert empty.collect() == []
    found = rule_ledger.ablations(empty).collect()
    assert len(found) == len(rule_ledger.rules()) and all(r.n == r.n_failed == r.kept == 0 for r in found)


def test_no_python_in_the_plan(spark):
    plan = rule_ledger.ledger(spark.createDataFrame([(1, "a")], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Exchange" not in plan
