import json
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from fieldnotes.functions.rounding import finite_or_null
from fieldnotes.plans.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def test_report_is_written_without_nan(make, tmp_path):
    ds = make(g=["a", "b"] * 6, v=[1.5, float("nan"), float("inf")] * 4)
    report = ds.report()
    assert list(report.tables) == ["codebook", "descriptives", "frequencies", "comparison"]
    report.save(str(tmp_path / "r"), format="json")
    text = "".join(p.read_text() for p in Path(tmp_path / "r").rglob("*.json"))
    assert text and "NaN" not in text and "Infinity" not in text
    for line in text.splitlines():
        json.loads(line)
    with pytest.raises(ValueError):
        report.save(str(tmp_path / "x"), format="pdf")


def test_descriptive_table(make):
    rows = make(v=[1.5, 2.5, 4.0]).descriptive_table("v").orderBy("position").collect()
    assert [r["statistic"] for r in rows][:3] == ["Mean", "Std. deviation", "Std. error of mean"]
    assert {r["statistic"]: r["value"] for r in rows}["Median"] == 2.5
    labels = make(v=["a", "b", "a"]).descriptive_table("v").collect()
    assert {r["statistic"]: r["value"] for r in labels}["Distinct values"] == 2


def test_finite_or_null(spark):
    df = spark.sql(
        "select double('nan') a, cast(1.5 as decimal(5,2)) b, date'2024-01-02' c, timestamp_ntz'2024-01-02 03:04:05.5' d, "
        "x'ff41' e, array(double('inf'), 1.0D) f, named_struct('x', float('-inf')) g, 1 `h.i`"
    )
    row = finite_or_null(df).first()
    assert row["a"] is None and row["b"] == 1.5 and row["c"] == "2024-01-02"
    assert row["d"] == "2024-01-02T03:04:05.500000"
    assert row["e"] == "�A" and row["f"] == [None, 1.0] and row["g"]["x"] is None and row["h.i"] == 1


def test_report_in_the_chosen_order_with_shares(make):
    ds = make(g=list("bbbaac") * 4, v=[float(k) for k in range(24)])
    tables = ds.report("g", {"group_by": "g", "metric": "v", "limit": 2}, order="label", slices=True, overall=True).tables
    assert list(tables) == ["codebook", "descriptives", "frequencies", "slices", "comparison", "overall"]
    assert [r["label"] for r in tables["frequencies"].orderBy("position").collect()] == ["a", "b", "c"]
    assert [(r["label"], r["pct"]) for r in tables["slices"].orderBy("position").collect()] == [("a", 33.33), ("b", 50.0), ("c", 16.67)]
    line = tables["overall"].first()
    assert (line["overall"], line["total_groups"], line["truncated"]) == (11.5, 3, True)


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(contract.queries())


@pytest.mark.parametrize("name", [
    "codebook_orders", "codebook_conversations", "describe_numeric", "dist_hist_auto", "dist_timeline_month",
    "dist_categorical_top", "compare_truncated_median", "compare_missing_overall", "rows_search_number",
    "infer_currency", "infer_dates_ambiguous", "delimited_codebook",
])
def test_registered_queries_agree_with_their_sql(spark, name):
    con = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    df = contract.queries()[name](spark, SF)
    result = con.execute(contract.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    ours = sorted((tuple(r) for r in df.select(*[F.col(f"`{c}`") for c in columns]).collect()), key=repr)
    assert ours == sorted(result.fetchall(), key=repr)


def test_entry(spark):
    assert contract.entry(spark).count() == 5
