import numpy as np
import pandas as pd
import pytest

from fieldnotes.operators import quantiles


def test_numeric_statistics_match_pandas(make):
    values = [float(v) for v in np.random.default_rng(3).gamma(2, 50, 500).round(2)]
    row, s = make(v=values).describe("v").first(), pd.Series(values)
    expected = {
        "mean": s.mean(), "std": s.std(), "sem": s.std() / len(s) ** 0.5, "min": s.min(), "q1": s.quantile(0.25),
        "median": s.median(), "q3": s.quantile(0.75), "max": s.max(), "iqr": s.quantile(0.75) - s.quantile(0.25),
        "range": s.max() - s.min(), "sum": s.sum(), "skewness": s.skew(),
    }
    assert {k: row[k] for k in expected} == {k: round(float(v), 4) for k, v in expected.items()}


def test_skewness_of_a_constant_and_of_two_values(make):
    assert make(v=[2.0, 2.0, 2.0, 2.0]).describe("v").first()["skewness"] == 0
    assert make(v=[1.5, 2.0]).describe("v").first()["skewness"] is None
    assert make(v=[1.5]).describe("v").first()["std"] is None


def test_rounding_follows_the_binary_value(make):
    # 0.125 is a tie and goes to even, 2.675 is just below one.
    from pyspark.sql import functions as F

    from fieldnotes.functions.rounding import rounded
    values = [0.125, 2.675, -2.675, 1.005, 14.285, 1e16, -0.001] + [c / 600 for c in range(1, 400, 3)]
    frame = make(v=values).cells
    got = [r[0] for r in frame.select(rounded(F.col(frame.columns[0]), 2)).collect()]
    assert got == [round(v, 2) for v in values]


def test_median_time_is_interpolated(make):
    row = make(t=["2024-01-01", "2024-01-02", "2024-01-04", "2024-01-09"]).describe("t").first()
    assert row["median"].isoformat() == "2024-01-03T00:00:00"
    assert row["span_days"] == 8.0


def test_label_statistics(make):
    row = make(v=["aa", "b", "aa", None, "cccc"]).describe("v").first()
    assert (row["mode"], row["mode_count"], row["mode_pct"], row["mean_length"]) == ("aa", 2, 50.0, 2.2)


@pytest.mark.parametrize("limit", [10_000, 50, 2])
@pytest.mark.parametrize("values", [
    list(range(1000)),
    [5] * 700 + list(range(300)),                       # one value holds most rows
    [10.0 ** k for k in range(-150, 150)] * 3,          # spread over many magnitudes
    [0.0, 0.0, 0.0, 1.0] * 100,
    [1.0, 2.0],
    [7.5],
])
def test_quantiles_by_search_are_exact(make, values, limit):
    values = [float(v) for v in values]
    frame = make(partitions=5, v=values).cells.toDF("v")
    shares = [0.0, 0.25, 0.5, 0.75, 0.9, 1.0]
    got = quantiles.exact_quantiles(frame, "v", {None: len(values)}, shares, limit=limit)[None]
    expected = pd.Series(values).quantile(shares)
    assert got == pytest.approx(list(expected), rel=1e-12)


def test_group_medians_by_search_are_exact(make):
    rng = np.random.default_rng(5)
    groups = ["hot"] * 800 + [f"g{k}" for k in rng.integers(0, 5, 400)]
    values = [float(v) for v in rng.integers(0, 300, 1200)]
    frame = make(partitions=5, g=groups, v=values).cells.toDF("g", "v")
    expected = pd.DataFrame({"g": groups, "v": values}).groupby("g")["v"]
    got = quantiles.exact_quantiles(frame, "v", expected.count().to_dict(), [0.5], group="g", limit=60)
    assert {g: v[0] for g, v in got.items()} == expected.median().to_dict()


def test_written_numbers_have_the_statistics_of_their_cells(make):
    values = [float(v) for v in np.random.default_rng(4).gamma(2, 50, 60).round(2)] * 5 + [-7.25, 0.1, 0.1]
    row = make(v=[f"${v:,.2f}" if v >= 0 else f"(${-v:,.2f})" for v in values] + ["n/k"]).describe("v").first()
    s = pd.Series(values)
    expected = {"mean": s.mean(), "std": s.std(), "q1": s.quantile(0.25), "median": s.median(), "q3": s.quantile(0.75),
                "min": s.min(), "max": s.max(), "sum": s.sum(), "skewness": s.skew()}
    assert {k: row[k] for k in expected} == {k: round(float(v), 4) for k, v in expected.items()}
    assert (row["valid"], row["missing"], row["unique"]) == (len(values), 1, len(set(values)))
    same = make(v=["0,1", "0,1", "0,10", "0,1"]).describe("v").first()
    assert (same["std"], same["skewness"], same["mean"], same["unique"]) == (0, 0, 0.1, 1)
    assert make(v=["1,5"]).describe("v").first()["std"] is None


@pytest.mark.parametrize("limit", [10_000, 40, 2])
def test_quantiles_of_counted_values_are_exact(spark, limit):
    rng = np.random.default_rng(6)
    counts = {float(v): int(n) for v, n in zip(rng.normal(0, 1e6, 200), rng.integers(1, 9, 200))} | {3.0: 900}
    frame = spark.createDataFrame(list(counts.items()), "v double, n bigint")
    shares = [0.0, 0.25, 0.5, 0.75, 0.9, 1.0]
    got = quantiles.counted_quantiles(frame, shares, sum(counts.values()), len(counts), limit=limit)
    expected = pd.Series(np.repeat(list(counts), list(counts.values()))).quantile(shares)
    assert got == pytest.approx(list(expected), rel=1e-12)
