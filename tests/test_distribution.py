import numpy as np
import pytest
from conftest import lines
from pyspark.sql import functions as F

from fieldnotes.operators import histogram


@pytest.mark.parametrize("seed", range(6))
def test_automatic_bins_follow_numpy(seed):
    rng = np.random.default_rng(seed)
    values = rng.lognormal(3, seed / 3 + 0.1, 400 * (seed + 1))
    q1, q3 = np.percentile(values, [25, 75])
    bins = len(np.histogram_bin_edges(values, bins="auto")) - 1
    ours = histogram.automatic_bins(len(values), values.min(), values.max(), q1, q3)
    assert ours == min(max(bins, 5), 30)


@pytest.mark.parametrize("low, high, target, edges", [
    (0, 100, 10, [10.0 * k for k in range(11)]),
    (-999, 9990, 12, [1000.0 * k for k in range(-1, 11)]),
    (1, 7, 10, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0]),
    (0.0, 0.1, 30, [round(0.005 * k, 10) for k in range(21)]),
    (5, 5, 10, [4.5, 5.5]),
])
def test_round_edges(low, high, target, edges):
    assert histogram.round_edges(low, high, target) == edges


@pytest.mark.parametrize("values", [
    [round(0.1 * k, 10) for k in range(100)],     # values on edges that are not binary fractions
    [float(k % 40) - 6 for k in range(200)],
    list(np.random.default_rng(1).normal(0, 1e-3, 300)),
    list(np.random.default_rng(2).normal(1e7, 3e5, 300)),
])
@pytest.mark.parametrize("bins", [None, 2, 7, 100])
def test_histogram_counts_match_numpy(make, values, bins):
    values = [float(v) for v in values]
    bars = lines(make(v=values).distribution("v", bins=bins).bars, "start", "end", "count")
    if bins is None:
        target = min(max(len(np.histogram_bin_edges(values, bins="auto")) - 1, 5), 30)
    else:
        target = bins
    edges = histogram.round_edges(min(values), max(values), target)
    assert [b[0] for b in bars] + [bars[-1][1]] == edges
    assert [b[2] for b in bars] == list(np.histogram(values, bins=edges)[0])


def test_constant_column_is_one_bin(make):
    d = make(v=[3.25] * 4 + [None], w=list("abcde")).distribution("v")
    assert (d.type, d.total, d.missing) == ("histogram", 4, 1)
    assert lines(d.bars, "label", "start", "end", "count", "pct") == [("2.75–3.75", 2.75, 3.75, 4, 100.0)]


def test_discrete_bars(make):
    d = make(v=[3, 1, 1, 2, 1]).distribution("v")
    assert (d.type, d.mean, d.median) == ("discrete", 1.6, 1.0)
    assert lines(d.bars, "label", "count", "pct") == [("1", 3, 60.0), ("2", 1, 20.0), ("3", 1, 20.0)]


def test_requested_bins_turn_discrete_into_a_histogram(make):
    assert make(v=[3, 1, 1, 2, 1]).distribution("v", bins=4).type == "histogram"


def test_timeline_fills_gaps(make):
    d = make(d=[f"2024-{m:02d}-15" for m in [1, 1, 3, 4, 4, 4]]).distribution("d")
    assert (d.type, d.unit) == ("timeline", "month")
    assert lines(d.bars, "label", "count") == [("2024-01", 2), ("2024-02", 0), ("2024-03", 1), ("2024-04", 3)]


@pytest.mark.parametrize("last, unit, bars", [
    ("2024-03-03", "day", 63), ("2024-03-04", "month", 3), ("2030-01-05", "month", 73), ("2030-01-06", "year", 7),
])
def test_timeline_unit(make, last, unit, bars):
    d = make(d=["2024-01-01", last]).distribution("d")
    assert (d.unit, d.bars.count()) == (unit, bars)


def test_top_with_other_and_ties(make):
    d = make(v=list("bbbaaaccd") + [None]).distribution("v", top=2)
    assert d.categories == 4
    assert lines(d.bars, "label", "count", "pct", "is_other", "categories") == [
        ("a", 3, 33.33, False, None), ("b", 3, 33.33, False, None), ("Other (2 categories)", 3, 33.33, True, 2),
    ]
    assert lines(make(v=list("bbba")).distribution("v", top=1).bars, "label")[-1] == "Other (1 category)"


def test_columns_without_a_chart(make):
    ds = make(name=[f"n{k}" for k in range(12)], nothing=[None] * 12)
    assert (ds.distribution("name").type, ds.distribution("name").bars.count()) == ("none", 0)
    assert ds.distribution("nothing").note


def test_cumulative_share_stops_at_100(make):
    table = make(v=list("abc") * 3).distribution("v").frequency_table()
    assert lines(table, "cumulative_pct") == [33.33, 66.66, 99.99]
    table = make(v=list("abcdef")).distribution("v").frequency_table()
    assert lines(table, "cumulative_pct")[-1] == 100.0


def test_slices(make):
    few = make(v=list("aabbc")).distribution("v").slices()
    assert lines(few, "label", "count") == [("a", 2), ("b", 2), ("c", 1)]
    d = make(v=[f"k{k}" for k in range(12) for _ in range(20 - k)]).distribution("v", top=10)
    slices = lines(d.slices(), "label", "count", "is_other")
    assert [s[0] for s in slices] == [f"k{k}" for k in range(7)] + ["Other"]
    assert sum(s[1] for s in slices) == sum(20 - k for k in range(12))


def test_natural_label_order(make):
    d = make(v=["Brand#10", "brand#2", "Brand#1", "alpha", "Brand#1", "x"] * 3).distribution("v", top=4)
    labels = lines(make(v=["Brand#10", "brand#2", "Brand#1", "alpha"] * 3).distribution("v").sorted("label"), "label")
    assert labels == ["alpha", "Brand#1", "brand#2", "Brand#10"]
    assert lines(d.sorted("label"), "is_other")[-1] is True


@pytest.mark.parametrize("options", [{"top": -1}, {"top": 2**31}, {"bins": 1}, {"bins": 101}])
def test_bounds(make, options):
    with pytest.raises(ValueError):
        make(v=[1, 2, 3]).distribution("v", **options)


@pytest.mark.parametrize("value, label", [
    (0, "0"), (1234567.0, "1,234,567"), (0.5, "0.5"), (1234.5678, "1,234.57"), (0.00001234, "1.23e-05"), (-2.5, "-2.5"),
])
def test_number_labels(spark, value, label):
    assert spark.range(1).select(histogram.edge_label(F.lit(float(value)))).first()[0] == label


def test_all_categories_are_shown_on_request(make):
    ds = make(a=[f"k{k % 1200}" for k in range(3600)])
    assert ds.distribution("a", top=0).bars.count() == 1200


def test_label_order_takes_all_numbers(make):
    ds = make(a=["A1-10", "A1-2", "A1-1", "a10-1"] * 3)
    assert [r.label for r in ds.distribution("a").sorted("label").orderBy("position").collect()] == ["A1-1", "A1-2", "A1-10", "a10-1"]
