import pytest
from conftest import by_name
from pyspark.sql import functions as F

from fieldnotes import from_dataframe
from fieldnotes.operators import profile


def test_identifier_rules(make):
    n = 30
    book = by_name(make(
        even=[k * 2 for k in range(n)], user_id=[k * 2 for k in range(n)], seq=list(range(100, 100 + n)),
        half=[k + 0.5 for k in range(n)], name=[f"n{k}" for k in range(n)],
    ))
    assert [c for c, line in book.items() if line["is_identifier"]] == ["user_id", "seq", "name"]


def test_nine_rows_are_too_few_for_an_identifier(make):
    assert not by_name(make(id=list(range(9))))["id"]["is_identifier"]


@pytest.mark.parametrize("name, looks_like_one", [
    ("id", True), ("User ID", True), ("zip-code", True), ("paid", False), ("id_number", True), ("identifier2", True),
    ("keyboard", False), ("order key", True),
])
def test_identifier_names(name, looks_like_one):
    assert bool(profile.IDENTIFIER_NAME.search(name)) == looks_like_one


def test_discrete_needs_whole_numbers_few_values_and_a_small_span(make):
    book = by_name(make(
        scale=[k % 7 for k in range(60)], halves=[k % 7 / 2 for k in range(60)],
        payroll=[k % 5 * 1000 for k in range(60)], many=[k % 26 for k in range(60)],
    ))
    assert [c for c, line in book.items() if line["discrete"]] == ["scale"]


def test_mostly_unique_labels_are_text(make):
    book = by_name(make(
        few=[f"a{k % 20}" for k in range(24)], most=[f"b{k % 22}" for k in range(24)],
        half=[f"c{k % 60}" for k in range(110)][:24],
    ))
    assert (book["few"]["kind"], book["most"]["kind"]) == ("categorical", "text")


def test_column_names_that_differ_in_case_or_hold_dots(spark):
    df = spark.createDataFrame([(1, 2, 3, "x")] * 3, "a int, A int, `b.c` int, `Rate %` string")
    ds = from_dataframe(df)
    assert list(by_name(ds)) == ["a", "A", "b.c", "Rate %"]
    assert ds.describe("A").first()["mean"] == 2
    assert ds.describe("b.c").first()["column"] == "b.c"


@pytest.mark.parametrize("values, mode, count", [
    (["b", "a", "b", "a"], "a", 2),
    (["x" * 100, "x" * 100, "a"], "x" * 100, 2),
    (["y" * 100, "x" * 100, "z"], "x" * 100, 1),
    (["y" * 100, "y" * 100, "x" * 90, "x" * 90, "z"], "x" * 90, 2),
    (["z", "z", "a" * 90, "a" * 90], "a" * 90, 2),
])
def test_mode_of_short_and_long_texts(make, values, mode, count):
    facts = make(v=values).profile("v").facts
    assert (facts["mode"], facts["mode_count"]) == (mode, count)
    assert facts["unique"] == len(set(values))


def test_native_types(spark):
    df = spark.sql(
        "select cast(id as decimal(10,2)) d, date'2024-01-01' + cast(id as int) day, id % 2 = 0 flag, "
        "timestamp'2024-01-01 10:00:00' t, array(id) a, cast(null as void) nothing from range(12)"
    )
    book = by_name(from_dataframe(df))
    assert {c: line["kind"] for c, line in book.items()} == {
        "d": "numeric", "day": "datetime", "flag": "boolean", "t": "datetime", "a": "unsupported", "nothing": "empty",
    }
    assert book["flag"]["true_pct"] == 50.0
    assert (book["a"]["valid"], book["a"]["unique"]) == (12, None)


def test_zoned_times_become_utc_wall_time_in_any_session_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        df = spark.sql("select timestamp_ltz'2024-03-10 07:30:00 UTC' t, timestamp_ntz'2024-03-10 02:30:00' w from range(3)")
        ds = from_dataframe(df)
        book = by_name(ds)
        assert book["t"]["first"].isoformat() == "2024-03-10T07:30:00"
        assert book["w"]["first"].isoformat() == "2024-03-10T02:30:00"
        assert ds.describe("w").first()["median"].isoformat() == "2024-03-10T02:30:00"
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_exact_sum_does_not_depend_on_order(spark):
    df = spark.range(20000).select((F.col("id") * 1e5 + F.rand(7).cast("decimal(4,2)").cast("double")).alias("v"))
    totals = {df.repartition(p).agg(profile.exact_sum(F.col("v"))).first()[0] for p in (1, 3, 8)}
    assert max(totals) - min(totals) < 1e-3


def test_empty_column_has_only_the_base_block(make):
    row = make(v=["", None, " "], w=["a", "b", "c"]).describe("v").first().asDict()
    assert row == {"column": "v", "kind": "empty", "valid": 0, "missing": 3, "missing_pct": 100.0, "unique": 0}


def test_unknown_columns(make):
    ds = make(v=[1, 2])
    with pytest.raises(KeyError):
        ds.describe("nope")
    with pytest.raises(ValueError):
        ds.describe("")


def test_large_whole_numbers_are_counted_exactly(make):
    ds = make(order_key=[2**53 + k for k in range(20)])
    row = ds.codebook().first()
    assert row["unique"] == 20 and row["is_identifier"]


@pytest.mark.parametrize("kind", ["bigint", "decimal(20,0)", "decimal(38,0)", "string"])
def test_large_numbers_are_told_apart(spark, kind):
    numbers = spark.range(20).select((F.col("id") + F.lit(2**53)).cast(kind).alias("number"))
    line = by_name(from_dataframe(numbers))["number"]
    assert (line["kind"], line["unique"], line["is_identifier"]) == ("numeric", 20, True)


def test_numbers_in_text_count_by_their_value(make):
    book = by_name(make(
        same=["1", "1.0", "1.00", "1e0", "2", "20e-1"] * 4, money=["$1,000", "1000.0", "(5)", "-5", "$5", "5%"] * 4,
        parts=[f"{2**53 + k}.5" for k in range(24)], huge=["1e300", "1e300", "2e300", "3"] * 6,
    ))
    assert [(book[c]["unique"], book[c]["is_identifier"]) for c in ("same", "money", "parts", "huge")] == [(2, False), (3, False), (24, False), (3, False)]
