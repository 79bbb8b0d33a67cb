import statistics

import numpy as np
import pandas as pd
import pytest
from conftest import lines

from fieldnotes.operators import quantiles


@pytest.fixture(scope="module")
def people():
    rng = np.random.default_rng(11)
    n = 300
    return pd.DataFrame({
        "who": [f"p{k}" for k in range(n)],
        "team": rng.choice(["red", "Blue", "green", None], n),
        "level": rng.integers(1, 6, n),
        "pay": np.where(rng.random(n) < 0.1, np.nan, rng.normal(50, 12, n).round(2)),
        "active": rng.choice([True, False], n),
    })


def _dataset(make, frame):
    clean = frame.astype(object).where(frame.notna(), None)
    return make(**{c: [v.item() if hasattr(v, "item") else v for v in clean[c]] for c in clean})


@pytest.mark.parametrize("agg", ["mean", "median", "sum", "min", "max"])
def test_values_match_pandas(make, people, agg):
    result = _dataset(make, people).compare("team", "pay", agg)
    grouped = people.dropna(subset=["team"]).groupby("team")["pay"]
    expected = grouped.agg(agg).sort_values(ascending=False)
    items = lines(result.items, "label", "value", "n", "rows")
    assert [i[0] for i in items] == list(expected.index)
    assert [i[1] for i in items] == [round(v, 4) for v in expected]
    assert {i[0]: i[2] for i in items} == grouped.count().to_dict()
    overall = result.overall.first()
    assert overall["overall"] == round(getattr(people["pay"].dropna(), agg)(), 4)
    assert overall["missing_groups"] == people["team"].isna().sum()
    assert sum(i[3] for i in items) + overall["missing_groups"] == len(people)


def test_counts_ignore_the_metric(make, people):
    result = _dataset(make, people).compare("active", "pay", "count")
    items = lines(result.items, "label", "value", "n", "rows")
    assert [i[0] for i in items] == ["False", "True"] and result.sort == "label"
    assert all(value == n == rows for _, value, n, rows in items)
    assert result.overall.first()["metric"] is None


def test_discrete_groups_are_in_number_order(make, people):
    assert lines(_dataset(make, people).compare("level", "pay").items, "label") == ["1", "2", "3", "4", "5"]


def test_label_order_ignores_case(make, people):
    assert lines(_dataset(make, people).compare("team", "pay", sort="label").items, "label") == ["Blue", "green", "red"]


def test_label_order_of_numbers_written_as_text(make):
    # Leading zeros keep the column text; its labels still sort as numbers.
    ds = make(code=["010", "9", "100"] * 4, v=[1.5, 2.5, 3.5] * 4)
    assert lines(ds.compare("code", "v", sort="label").items, "label") == ["9", "010", "100"]


def test_cut_keeps_the_largest_groups_and_both_overall_scopes(make):
    groups = ["a"] * 5 + ["b"] * 3 + ["c"] * 3 + ["d"]
    ds = make(g=groups, v=[float(k) + 0.5 for k in range(12)])
    mean, count = ds.compare("g", "v", limit=2), ds.compare("g", agg="count", limit=2)
    assert sorted(lines(mean.items, "label")) == ["a", "b"]
    assert mean.overall.first()["overall"] == 6.0
    overall = count.overall.first()
    assert (overall["overall"], overall["total_groups"], overall["truncated"]) == (8.0, 4, True)


def test_groups_without_values(make):
    ds = make(g=["a", "a", "b", "b"], v=[1.5, 2.5, None, None])
    assert lines(ds.compare("g", "v", "sum").items, "label", "value", "n", "rows") == [("a", 4.0, 2, 2), ("b", 0.0, 0, 2)]
    for agg in ("mean", "median", "min", "max"):
        for sort in ("asc", "desc"):
            assert lines(ds.compare("g", "v", agg, sort=sort).items, "label", "value")[-1] == ("b", None)


@pytest.mark.parametrize("arguments", [
    dict(group_by="who", agg="count"), dict(group_by="pay", agg="count"), dict(group_by="team", metric="who"),
    dict(group_by="team"), dict(group_by="team", metric="pay", agg="mode"), dict(group_by="team", metric="pay", limit=0),
    dict(group_by="team", metric="pay", limit="5"), dict(group_by="team", metric="pay", sort="up"),
])
def test_rejections(make, people, arguments):
    with pytest.raises(ValueError):
        _dataset(make, people).compare(**arguments)


def test_suggestion(make, people):
    first = _dataset(make, people).suggest()
    assert (first.variable, first.group_by, first.metric, first.agg) == ("pay", "team", "pay", "mean")
    only = make(team=["a", "b"] * 10).suggest()
    assert (only.variable, only.group_by, only.metric, only.agg) == ("team", "team", None, "count")


def test_labels_with_type_letters_are_text(make):
    ds = make(g=["10d", "2d", "7d"] * 3, v=list(range(9)))
    assert [r.label for r in ds.compare("g", "v", sort="label").items.orderBy("position").collect()] == ["10d", "2d", "7d"]


def test_as_many_groups_as_asked_for(make):
    values = {f"g{k:03d}": [float((k * j) % 17) for j in range(k % 4 + 1)] for k in range(300)}
    pairs = [(g, v) for g, own in values.items() for v in own] + [("none", None)]
    ds = make(g=[g for g, _ in pairs], v=[v for _, v in pairs])
    for agg in ("median", "mean"):
        got = {r["label"]: r["value"] for r in ds.compare("g", "v", agg=agg, limit=1000).items.collect()}
        want = {g: round(float(getattr(statistics, agg)(own)), 4) for g, own in values.items()}
        assert got == want | {"none": None}


@pytest.mark.parametrize("size", [1, 2, 7, 500])
def test_medians_of_one_large_group_with_ties(spark, size):
    values = [float((k * 7919) % 13) for k in range(size)]
    frame = spark.createDataFrame([("a", v) for v in values] + [("b", 1.0), ("b", None), ("c", None)], "g string, v double")
    got = {r["g"]: r["value"] for r in quantiles.group_medians(frame, "g", "v").collect()}
    assert got == {"a": statistics.median(values), "b": 1.0}
