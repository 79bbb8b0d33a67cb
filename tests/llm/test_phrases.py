"""Phrase mining against brute force: the index's intervals, and whole results by counting all phrases."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldnotes.llm import phrases

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def by_hand(rows, least, top):
    """The contract's result over (lang, text)."""
    counts, totals = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for size in range(1, 6):
                counts.update((lang, tuple(words[i : i + size])) for i in range(len(words) - size + 1))
    candidates = {p: a for p, a in counts.items() if len(p[1]) > 1 and a >= least}
    best = {}
    for (lang, words), a in candidates.items():
        inside = lambda longer: any(longer[i : i + len(words)] == words for i in range(len(longer) - len(words) + 1))  # noqa: B023, E731
        if any(other == lang and len(longer) > len(words) and f >= a and inside(longer) for (other, longer), f in candidates.items()):
            continue
        cuts = [(1000 * a * totals[lang] // (counts[lang, words[:k]] * counts[lang, words[k:]]), k) for k in range(1, len(words))]
        score, k = min(cuts)
        best.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), counts[lang, words[:k]], counts[lang, words[k:]]))
    return {
        (lang, rank, p.decode(), -a, left, right, totals[lang], -score)
        for lang, found in best.items() for rank, (score, a, p, left, right) in enumerate(sorted(found)[:top], 1)
    }


def rows():
    rng = random.Random(13)
    made = [("en", None), ("en", ""), (None, " \t \n.,;:!?\x0b\x0c\r "), (None, "Über uns und über UNS. über uns"), ("xx", "one word"), ("en", "end " * 400), ("en", "x" * 3000)]
    for lang in ("en", "de", None):
        vocabulary = [f"{lang}{k}" for k in range(9)] + ["É", "é", "\U0001f600", "-", " nbsp"]
        for _ in range(60):
            made.append((lang, "".join(rng.choice(vocabulary) + rng.choice((" ", " ", " ", " ", "\t", "  ", ". ", "\n")) for _ in range(rng.randrange(60)))))
        made += [(lang, "The Quick brown Fox jumps over the lazy dog")] * 30
    return made


def test_intervals_of_both_indexes():
    rng = np.random.default_rng(1)
    for size, kinds in ((1, 1), (50, 3), (400, 2), (400, 12)):
        sequence = np.concatenate([rng.integers(0, kinds + 1, size), [0]])
        if not sequence.max():
            continue
        index = phrases.BothWays(sequence, 5)
        order = sorted(range(len(sequence)), key=lambda i: tuple(sequence[i : i + 5]))
        back = np.concatenate([sequence[-2::-1], [0]])
        order_back = sorted(range(len(back)), key=lambda i: tuple(back[i : i + 5]))
        for length in range(2, 6):
            index.left() if length % 2 else index.right()
            want = Counter(tuple(sequence[i : i + length].tolist()) for i in range(len(sequence) - length + 1))
            want = {w: n for w, n in want.items() if 0 not in w}
            got = {tuple(w): n for w, n in zip(index.words.tolist(), index.counts.tolist())}
            assert got == want
            for words, low, low_back, n in zip(index.words.tolist(), index.low, index.low_back, index.counts):
                assert all(sequence[i : i + length].tolist() == words for i in order[low : low + n])
                assert all(back[i : i + length].tolist() == words[::-1] for i in order_back[low_back : low_back + n])


@pytest.mark.parametrize("shard", [30, 4_000_000])
@pytest.mark.parametrize("least,top", [(2, 10_000), (20, 5)])
def test_all_phrases_as_by_hand(spark, monkeypatch, shard, least, top):
    monkeypatch.setattr(phrases, "SHARD", shard)
    monkeypatch.setattr(phrases, "TOGETHER", 64 if shard == 30 else 1 << 20)
    if least == 20:
        monkeypatch.setattr(phrases, "FEW", 0)
    docs = spark.createDataFrame([(k % 7 if k % 5 else None, lang, text) for k, (lang, text) in enumerate(rows())], "doc_id long, lang string, text string")
    docs = docs.withColumn("n", F.lit("clash")).withColumn("word", F.lit("clash")).repartition(3)
    got = phrases.collocations(docs, least=least, top=top)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert {tuple(r) for r in got.collect()} == by_hand(rows(), least, top)


def test_only_places_where_frequent_triples_chain_give_longer_phrases():
    # 1 2 3 4 and 2 3 4 5 hold frequent triples only; those of 3 4 5 6 chain with none on their right
    sequence = np.array([1, 2, 3, 4, 5, 6, 7, 0, 3, 4, 5, 0, 5, 6, 7, 1, 2, 3, 0])
    number = np.concatenate([[-1], np.arange(1, 8) * 10])
    triples = phrases._Phrases(*np.array([[10, 20, 30], [20, 30, 40], [30, 40, 50], [50, 60, 70]]).T)
    found = phrases._chained_phrases(9, sequence, number, triples, 5)
    assert {tuple(r) for r in found[[*phrases.GLOBAL, "n"]].itertuples(index=False)} == {(10, 20, 30, 40, -1, 1), (20, 30, 40, 50, -1, 1), (10, 20, 30, 40, 50, 1)}
    assert set(found["shard"]) == {9} and (found["a"] * 10 == found["w1"]).all()
    pairs = phrases._Phrases(np.array([10, 20, 60]), np.array([20, 30, 70]))
    found = phrases._chained_phrases(9, sequence, number, pairs, 3)
    assert {tuple(r) for r in found[["w1", "w2", "w3", "n"]].itertuples(index=False)} == {(10, 20, 30, 2)}


@pytest.mark.parametrize("few", [0, 1_000_000])
def test_rare_triples_of_frequent_pairs_give_no_rows(spark, monkeypatch, few):
    # any two of 40 words follow each other often, any three seldom, but for one triple in every text
    rng = random.Random(3)
    texts = [" ".join(f"w{rng.randrange(40)}" for _ in range(400)) + " a b c d" for _ in range(100)]
    made, extended = [], phrases._extended

    def noted(*given):
        made.append(extended(*given))
        made.append(made[-1].count())
        return made[-2]

    monkeypatch.setattr(phrases, "_extended", noted)
    monkeypatch.setattr(phrases, "FEW", few)
    docs = spark.createDataFrame([("en", t) for t in texts], "lang string, text string").repartition(3)
    got = {tuple(r) for r in phrases.collocations(docs, least=12, top=10_000).collect()}
    counts = Counter(tuple(w[i : i + 3]) for w in map(str.split, texts) for i in range(len(w) - 2))
    frequent = sum(n >= 12 for n in counts.values())
    assert got == by_hand([("en", t) for t in texts], 12, 10_000)
    # three shards; buckets may let a few more pass
    assert made[1] <= 3 * (frequent + 10) and len(counts) > 1_000


def test_empty_table(spark):
    assert phrases.collocations(spark.createDataFrame([], "doc_id long, lang string, text string")).collect() == []
