import warnings

import pandas as pd
import pytest
from conftest import by_name
from pyspark.sql import functions as F

from fieldnotes import from_dataframe
from fieldnotes.functions import dates, numbers
from fieldnotes.operators.infer import date_evidence


def test_currency_thousands_percent_and_brackets(make):
    book = by_name(make(salary=["$52,000", "$61,500.50", "(1,200)"], share=["45%", " 50% ", "5%"]))
    assert book["salary"]["kind"] == "numeric"
    assert (book["salary"]["min"], book["salary"]["max"]) == (-1200, 61500.5)
    assert (book["share"]["kind"], book["share"]["max"]) == ("numeric", 50)


def test_one_number_among_labels_stays_categorical(make):
    assert by_name(make(v=[f"label{k % 3}" for k in range(30)] + ["42"]))["v"]["kind"] == "categorical"


def test_leading_zeros_keep_codes_as_text(make):
    assert by_name(make(zip=["01234", "02139", "10001"]))["zip"]["kind"] == "categorical"
    assert by_name(make(zip=["0", "0.5", "10001"]))["zip"]["kind"] == "numeric"


def test_dates_and_answers(make):
    book = by_name(make(when=["2024-01-05", "2024-02-10", "2024-03-15", "2024-03-20"], flag=["yes", "no", "yes", "YES"]))
    assert book["when"]["kind"] == "datetime"
    assert (book["flag"]["kind"], book["flag"]["true_pct"], book["flag"]["unique"]) == ("boolean", 75.0, 2)


KINDS = [
    (["1.234,5", "12.000"], "numeric"),         # a dot group in every comma value
    (["1.234,5", "994,5"], "categorical"),      # one comma value without a dot group
    (["3,5", "-2,25", "7"], "numeric"),         # decimal commas, no dots
    (["3,5", "2.5"], "categorical"),            # decimal commas and a dot
    (["1,234", "12,345.67", "8.5"], "numeric"),  # thousands commas
    (["1,234", "12,34"], "numeric"),            # all of them decimal commas
    (["1,234.5", "12,34"], "categorical"),
    (["1", "0"], "numeric"),                    # digits are never yes/no
    (["yes", "no", "n"], "categorical"),        # three words
    (["T", "f", "t"], "boolean"),
    (["1e3", "inf", "-Infinity"], "numeric"),
    (["1d", "2f"], "categorical"),              # not numbers in text
    (["2024", "2025"], "numeric"),
    (["12:30", "09:15"], "categorical"),
    (["  ", "", "\t"], "empty"),
]


def test_kinds_of_small_columns(make):
    book = by_name(make(**{f"v{k}": values + [None] * (3 - len(values)) for k, (values, _) in enumerate(KINDS)}))
    assert [book[f"v{k}"]["kind"] for k in range(len(KINDS))] == [kind for _, kind in KINDS]


def test_styles_read_their_values(make):
    book = by_name(make(euro=["1.234,5", "12.000", "7"], comma=["3,5", "-2,25", "7"], mixed=["1,234", "12,345.67", "8.5"]))
    assert (book["euro"]["min"], book["euro"]["max"]) == (7, 12000)
    assert (book["comma"]["min"], book["comma"]["max"]) == (-2.25, 7)
    assert (book["mixed"]["min"], book["mixed"]["max"]) == (8.5, 12345.67)


def test_share_of_numbers_decides_and_the_rest_is_missing(make):
    enough = by_name(make(v=["n/k"] + ["12.5"] * 19))["v"]
    assert (enough["kind"], enough["valid"], enough["missing"]) == ("numeric", 19, 1)
    assert by_name(make(v=["n/k"] * 2 + ["12.5"] * 19))["v"]["kind"] == "categorical"


def test_infinities_are_missing(make):
    book = by_name(make(v=["1", "2", "3"], w=["inf", None, "-inf"], x=[1.0, float("nan"), float("inf")]))
    assert (book["w"]["kind"], book["w"]["missing"]) == ("empty", 3)
    assert (book["x"]["valid"], book["x"]["missing"]) == (1, 2)


def test_offsets_move_to_utc(make):
    column = by_name(make(t=["2024-01-01T10:00:00+02:00", "2024-01-02T10:00:00-05:00", "2024-01-03T10:00:00Z"]))["t"]
    assert column["kind"] == "datetime"
    assert column["first"].isoformat() == "2024-01-01T08:00:00"


def test_unparsed_dates_are_missing(make):
    column = by_name(make(d=["2024-01-05"] * 19 + ["2024-13-45"]))["d"]
    assert (column["kind"], column["valid"], column["missing"]) == ("datetime", 19, 1)


def test_date_gate_looks_at_all_distinct_values(make):
    # 300 distinct dates first, then as many other texts that still parse as year-months.
    dates_first = [str(d.date()) for d in pd.date_range("2020-01-01", periods=300)]
    months = [f"{y}-{m:02d}" for y in range(1980, 2005) for m in range(1, 13)]
    early = make(d=dates_first + months)
    late = make(d=months + dates_first)
    for ds in (early, late):
        assert date_evidence(ds.cells, ds.fields[0], ("year_first",))["share"] == 0.5
        assert by_name(ds)["d"]["kind"] == "text"


def test_a_little_junk_anywhere_leaves_dates_dates(make):
    dates = [str(d.date()) for d in pd.date_range("2000-01-01", periods=5000)]
    junk = [f"see note {k}" for k in range(60)]
    for values in (junk + dates, dates + junk):
        column = by_name(make(d=values))["d"]
        assert (column["kind"], column["valid"], column["missing"]) == ("datetime", 5000, 60)


def test_answer_is_the_same_for_any_partitioning(make):
    values = [f"${k * 37 % 101},{k % 10}00" for k in range(200)]
    books = [by_name(make(partitions=p, v=values))["v"] for p in (1, 7)]
    assert books[0] == books[1]


def _text_column(spark, values):
    return spark.createDataFrame([(v,) for v in values], "t string")


ISO_TEXTS = [
    "2024-01-05", "2024/1/5", "2024.01.05", "2024-1-5 9:05", "2024-01-05T10:00", "2024-01-05T10:00:00.123456789",
    "2024-01-05T10:00:00+02:00", "2024-01-05+02:00", "2024-01-05 10:00:00 +02:00", "2024-01-05Z", "2024-13-05",
    "2024", "2024-01", "20240105", "2024-02-30", "2024-01-05T10", "2024/01/05 9:5", "2024-01-05T24:00",
    "2024-01-05T10:00-0500", "1600-01-01", "2024 01 05", "2024-01-05T10:00:60", "2300-01-01", "2024-01-05 10:00Z",
    "2262-04-11 23:00", "2262-04-12", "1677-09-22", "1677-09-20", "2024-02-29", "2023-02-29",
]
MIXED_TEXTS = [
    "01/02/2024", "13/02/2024", "1/2/24", "1/2/99", "1-2-2024", "13.02.2024", "31/12/24", "1/2/124", "Sep 5, 2024",
    "Sept 5, 2024", "September 5 2024", "5 Sept. 2024", "5 Foo 2024", "Marc 5, 2024", "May. 5, 2024",
    "1/2/2024 10:30", "1/2/2024 10:30 PM", "1/2/2024 12:30am", "1/2/2024 12:30pm", "13/2/24 13:05:09",
    "1/2/2024 13:30 PM", "1/32/2024", "0/1/2024", "Mon 5, 2024", "31 Feb 2024", "1/2/76", "1/2/75", "32/1/24",
    "13/13/24", "1/13/31", "31/1/13", "2/30/24", "10/10/10", "1.2.24", "1/2/2024 25:00", "1/2/2024 0:30 AM",
    "1/2/2024 10:30:15 pm", "1/2/0024", "29/2/23", "12/31/1999", "13/2/24 9:05 AM", "DECEMBER 31, 2024",
]


@pytest.mark.parametrize("style, rule", [(dates.ISO, "ISO8601"), (dates.MIXED, "mixed")])
def test_date_texts_read_as_pandas_reads_them(spark, style, rule):
    rows = _text_column(spark, ISO_TEXTS + MIXED_TEXTS).select(
        "t", dates.text_timestamp(F.col("t"), style), dates.could_be_date(F.col("t"))
    ).collect()
    for text, ours, screened in rows:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            theirs = pd.to_datetime(pd.Series([text, "2020-01-01"]), errors="coerce", format=rule, utc=True)[0]
        expected = None if pd.isna(theirs) else theirs.tz_localize(None).floor("us").to_pydatetime()
        assert ours == expected, text
        assert screened or ours is None, text


def test_number_texts_read_as_pandas_reads_them(spark):
    texts = [
        "12", "+1", "1e5", "1E5", ".5", "5.", "inf", "-inf", "+Infinity", "INF", "nan", "1_000", "0x10", "1d", "--1",
        "+-1", "1e400", "1e", "e5", ".", "-.5", "-", "123456789012345678901234567890", "True", "1 2", "1,2", "1e+5",
        "1.e5", "Infinit", "1e-400", "0.1.2", "-0", "18446744073709551616", "+.5e3", "",
    ]
    value = F.coalesce(numbers.plain_number(F.col("t")), numbers.infinity(F.col("t")))
    for text, ours, screened in _text_column(spark, texts).select("t", value, numbers.could_be_number(F.col("t"))).collect():
        theirs = pd.to_numeric(pd.Series([text, "1"], dtype=object), errors="coerce")[0]
        assert ours == (None if pd.isna(theirs) else float(theirs)), text
        assert screened or ours is None, text


PASSES = {
    "named_day_first": "date_format(date_add(DATE'2020-01-01', CAST(id % 7 AS INT)), 'd MMMM yyyy')",
    "percent": "concat(id % 7, '%')",
    "long": "date_format(date_add(DATE'2020-01-01', CAST(id % 7 AS INT)), 'MMM d, yyyy')",
    "short_year": "date_format(date_add(DATE'2020-01-01', CAST(id % 7 AS INT)), 'MM/dd/yy')",
    "offset": "concat(date_add(DATE'2020-01-01', CAST(id % 7 AS INT)), 'T10:00:00+02:00')",
    "euro": "concat('1.20', id % 7, ',50')",
    "afternoon": "concat(date_format(date_add(DATE'2020-01-01', CAST(id % 7 AS INT)), 'MM-dd-yyyy'), ' 1:30 PM')",
}


@pytest.mark.parametrize("style", PASSES)
def test_cells_are_read_twice_whatever_is_asked(spark, style):
    """Once for the screening, once for the distinct texts that all else comes from."""
    seen = spark.sparkContext.accumulator(0)
    cell = F.udf(lambda text: seen.add(1) or text, "string")
    ds = from_dataframe(spark.range(0, 210, 1, 3).select(cell(F.expr(PASSES[style])).alias("v")))
    row = ds.describe("v").first()
    assert (row["valid"], row["missing"], row["unique"]) == (210, 0, 7)
    assert row["kind"] == ("numeric" if style in ("percent", "euro") else "datetime")
    assert seen.value <= 420
