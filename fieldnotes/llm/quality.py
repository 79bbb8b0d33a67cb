"""Quality classifier with hierarchical empirical Bayes.

A document is good if it is labelled with quality and not as toxic. A logistic classifier over its words and the
surface of its text gives each document a log odds of being good; it is fitted on at most SAMPLE labelled rows.
Grouped sums of those probabilities give every path and host a posterior mean: a host is shrunk towards the global
mean and a path towards its host, by strengths that come from the spread of the group means (method of moments), so
that sparse sites fall back to their prior. A document's prior is that of its path without the document itself, and
its posterior joins prior and evidence. Documents below the threshold are rejected.

Null and empty texts are documents without words. Null hosts or paths are groups of their own. Labels that are null
or of unknown documents are left out; of repeated labels the worst counts. With labels of one kind only, or none, the
evidence is even for all documents. Columns that clash with the results are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldnotes.llm.base import saved, words

#: Labelled rows to fit on, hashed words, steps of the fit, groups that may go to every task, posterior to keep.
SAMPLE, WORDS, STEPS, GROUPS, THRESHOLD = 6_000, 1 << 16, 160, 100_000, 0.5
_SIGNS = re.compile(r"[^\w\s]")


def surface(text: str, own: list[bytes]) -> list[float]:
    """Shares and counts that tell running text from lists, shouting, markup and repetition."""
    n, lines = max(1, len(own)), text.split("\n")
    size = max(1, len(text))
    distinct = len(set(own))
    signs = _SIGNS.findall(text)
    upper = len(re.findall(r"[A-ZÀ-Þ]", text))
    return [
        np.log1p(len(own)) / 10,
        np.log1p(len(text) / n),
        distinct / n,
        distinct / n**0.8,
        upper / size,
        len(signs) / size * 4,
        len(re.findall(r"\d", text)) / size * 4,
        text.count("!") / n,
        text.count("|") / n,
        len(re.findall(r"[#$%&*]{2,}", text)) / n,
        len(set(lines)) / len(lines),
        sum(len(w) for w in own) / n / 20,
        len(re.findall(r"\b(\w+)\W+\1\b", text)) / n,
        len(re.findall(r"[.!?](?:\s|$)", text)) / n * 4,
        float(not own),
    ]


def features(text: str | None, cache: dict) -> tuple[np.ndarray, list[float]]:
    """Distinct hashed words of a text and its surface."""
    own = words(text)
    ids = set()
    for w in set(own):
        i = cache.get(w)
        if i is None:
            if len(cache) > 100_000:
                cache.clear()
            i = cache[w] = crc32(w.strip(b".,;:!?\"'()")) % WORDS
        ids.add(i)
    return np.fromiter(ids, np.int32, len(ids)), surface(text or "", own)


class Classifier:
    """Weights of words and surface. A document's words count by their mean and by the few worst of them."""

    def __init__(self, rows: list[tuple[np.ndarray, list[float]]], good: np.ndarray):
        self.even = len(set(good.tolist())) < 2
        self.words = np.zeros(WORDS)
        if self.even:
            return
        # log odds of each word by the documents that hold it, by halves: a row's own half is left out of its odds
        half = np.arange(len(rows)) % 2
        odds = [self._odds([r[0] for r, h in zip(rows, half) if h != side], good[half != side]) for side in (0, 1)]
        x = np.array([self._dense(ids, s, odds[h]) for (ids, s), h in zip(rows, half)])
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-6
        x = np.c_[(x - self.mean) / self.scale, np.ones(len(x))]
        self.weights = np.zeros(x.shape[1])
        for _ in range(STEPS):  # Newton steps for a logistic fit with a small ridge
            p = 1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30)))
            grad = x.T @ (good - p) - 0.5 * self.weights
            hess = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + 0.5 * np.eye(x.shape[1])
            step = np.linalg.solve(hess, grad)
            self.weights += step
            if np.abs(step).max() < 1e-6:
                break
        self.words = self._odds([r[0] for r in rows], good)

    @staticmethod
    def _odds(ids: list[np.ndarray], good: np.ndarray) -> np.ndarray:
        count = [np.bincount(np.concatenate([np.empty(0, np.int32), *(i for i, g in zip(ids, good) if g == side)]), minlength=WORDS) for side in (0, 1)]
        totals = [(good == side).sum() for side in (0, 1)]
        base = totals[1] / max(1, totals[0])
        # pseudo documents in the proportion of the classes keep rare words near zero
        return np.log((count[1] + 2 * base) / (count[0] + 2)) - np.log(base)

    @staticmethod
    def _dense(ids: np.ndarray, own: list[float], odds: np.ndarray) -> list[float]:
        if not len(ids):
            return [*own, *[0.0] * 6]
        o = np.sort(odds[ids])
        bad = o[:8]
        return [*own, o.mean(), o[0], bad[: min(3, len(bad))].mean(), bad.mean(), float((o < -2).sum()) ** 0.5, float((o < -3).sum()) ** 0.5]

    def log_odds(self, text: str | None, cache: dict) -> float:
        if self.even:
            return 0.0
        ids, own = features(text, cache)
        x = (np.array(self._dense(ids, own, self.words)) - self.mean) / self.scale
        return float(np.clip(x @ self.weights[:-1] + self.weights[-1], -12, 12))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Classifier:
    """The classifier of a bounded sample of labelled rows, drawn by the hash of their ids."""
    good = F.when((F.col("quality") > 0) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0), 1).otherwise(0)
    drawn = (
        labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min(good).alias("good"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    )
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(drawn), "doc_id").select("doc_id", "text", "good")

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache: dict = {}
        for batch in batches:
            table = [features(t, cache) for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "good": batch["good"], "ids": [t[0] for t in table], "own": [t[1] for t in table]})

    found = rows.mapInPandas(build, "doc_id long, good int, ids array<int>, own array<double>").dropDuplicates(["doc_id"]).toPandas().sort_values("doc_id")
    return Classifier([(np.asarray(i, np.int32), list(o)) for i, o in zip(found["ids"], found["own"])], found["good"].to_numpy(dtype=float))


def _share(log_odds: Column) -> Column:
    return 1 / (1 + F.exp(-log_odds))


def _odds(share: Column) -> Column:
    held = F.greatest(F.least(share, F.lit(1 - 1e-9)), F.lit(1e-9))
    return F.log(held / (1 - held))


def _strength(groups: DataFrame, mean: float) -> float:
    """How many documents a prior counts for: the variance of single documents over that between groups."""
    found = groups.filter("n > 1").agg(F.sum("n"), F.sum(F.col("n") * F.pow(F.col("s") / F.col("n") - mean, 2)), F.count("*"), F.sum("within")).first()
    n, between, many, within = (float(x or 0) for x in found)
    if many < 2 or not n:
        return 100.0
    noise = within / max(1.0, n - many)  # of one document around its group
    spread = between / n - noise * many / n
    return float(np.clip(noise / spread, 1.0, 1e4)) if spread > 0 else 1e4


def score(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", threshold: float = THRESHOLD) -> DataFrame:
    """docs with evidence (log odds), host_mean, path_mean, posterior and keep. A path is a host's `path`."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    @F.pandas_udf("double")
    def evidence(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        cache: dict = {}
        for texts in parts:
            yield pd.Series([shared.value.log_odds(t, cache) for t in texts], dtype="float64")

    frame = docs.drop("evidence", "host_mean", "path_mean", "posterior", "keep", "_host", "_path").withColumns({
        "_host": F.coalesce(F.col(host).cast("string"), F.lit("")), "_path": F.coalesce(F.col(path).cast("string"), F.lit("")),
    })
    frame = frame.withColumn("evidence", evidence(F.col("text").cast("string")))
    p = _share(F.col("evidence"))
    sums = (F.count("*").alias("n"), F.sum(p).alias("s"), (F.sum(p * p) - F.sum(p) * F.sum(p) / F.count("*")).alias("within"), F.sum(p * p).alias("q"))
    paths = saved(frame.groupBy("_host", "_path").agg(*sums), "paths")
    hosts = paths.groupBy("_host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), (F.sum("q") - F.sum("s") * F.sum("s") / F.sum("n")).alias("within"))
    total = paths.agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.count("*").alias("groups")).first()
    mean = (total["s"] or 0.0) / total["n"] if total["n"] else 0.5
    to_host, to_path = _strength(hosts, mean), _strength(paths, mean)
    table = paths.select("_host", "_path", F.col("n").alias("_n"), F.col("s").alias("_s")).join(hosts.select("_host", F.col("n").alias("_hn"), F.col("s").alias("_hs")), "_host")
    if total["groups"] <= GROUPS:
        frame = frame.join(F.broadcast(table), ["_host", "_path"])
    else:  # a host may hold a third of all rows: its line goes to as many salts
        salts = 32
        spread = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        frame = frame.withColumn("_salt", F.pmod(F.xxhash64("text"), F.lit(salts)).cast("int")).join(spread, ["_host", "_path", "_salt"]).drop("_salt")
    host_mean = (F.col("_hs") - p + to_host * mean) / (F.col("_hn") - 1 + to_host)
    path_mean = (F.col("_s") - p + to_path * F.col("host_mean")) / (F.col("_n") - 1 + to_path)
    frame = frame.withColumn("host_mean", host_mean).withColumn("path_mean", path_mean)
    frame = frame.withColumn("posterior", _share(F.col("evidence") + _odds(F.col("path_mean")) - float(np.log(max(mean, 1e-9) / max(1 - mean, 1e-9)))))
    return frame.withColumn("keep", F.col("posterior") >= threshold).drop("_host", "_path", "_n", "_s", "_hn", "_hs")
