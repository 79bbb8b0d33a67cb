import pytest
from pyspark.sql import functions as F
from conftest import lines

from fieldnotes.operators import rows as rows_module


@pytest.fixture
def people(make):
    n = 103
    return make(
        partitions=7, id=list(range(n)), city=[("Rome", "oslo", None, "Paris")[k % 4] for k in range(n)],
        score=[None if k % 10 == 3 else float(k * 37 % 50) for k in range(n)],
    )


def test_pages_cover_every_row_once_in_order(people):
    numbers = [n for page in range(1, 12) for n in lines(people.rows(page=page, page_size=10).rows, "row_number")]
    assert numbers == list(range(1, 104))


def test_page_is_clamped_into_range(people):
    page = people.rows(page=99, page_size=50)
    assert (page.page, page.pages, page.total) == (3, 3, 103)
    assert lines(page.rows, "id") == [100, 101, 102]


def _sorted_ids(n=103, reverse=False):
    scored = [k for k in range(n) if k % 10 != 3]
    scored.sort(key=lambda k: (-(k * 37 % 50) if reverse else k * 37 % 50))
    return scored + [k for k in range(n) if k % 10 == 3]


@pytest.mark.parametrize("order", ["asc", "desc"])
def test_sorting_is_stable_and_missing_values_are_last(people, order):
    got = [i for p in (1, 2, 3) for i in lines(people.rows(page=p, sort="score", order=order).rows, "id")]
    assert got == _sorted_ids(reverse=order == "desc")


def test_labels_sort_without_case(people):
    cities = lines(people.rows(page_size=500, sort="city").rows, "city")
    assert cities == ["oslo"] * 26 + ["Paris"] * 25 + ["Rome"] * 26 + [None] * 26


def test_far_pages_agree_with_near_ones(people, monkeypatch):
    near = [lines(people.rows(page=3, page_size=20, **o).rows) for o in ({}, {"sort": "score"}, {"q": "o", "sort": "city"})]
    monkeypatch.setattr(rows_module, "FRONT_ROWS", 0)
    monkeypatch.setattr(rows_module, "HEAP_ROWS", 0)
    far = [lines(people.rows(page=3, page_size=20, **o).rows) for o in ({}, {"sort": "score"}, {"q": "o", "sort": "city"})]
    assert near == far


def test_search_is_literal_and_stays_inside_a_cell(make):
    ds = make(a=["x.y", "xay", "Ab"], b=["1%", "2", "c"], c=[1.5, 10000000.0, 2.0])
    assert ds.rows(q="x.y").total == 1
    assert ds.rows(q="X").total == 2
    assert ds.rows(q=" % ").total == 1
    assert ds.rows(q="bc").total == 0
    assert ds.rows(q="10000000.0").total == 1
    assert lines(ds.rows(q="ab").rows, "row_number", "a", "b", "c") == [(3, "Ab", "c", 2.0)]


def test_raw_cells_are_returned_and_typed_values_sort(make):
    ds = make(pay=["$1,200", "$950", "$52,000"])
    assert lines(ds.rows(sort="pay", order="desc").rows, "pay") == ["$52,000", "$1,200", "$950"]


def test_blank_rows_are_not_numbered(make):
    ds = make(a=[1, None, 2, None, 3], b=["x", " ", None, "", "y"])
    assert ds.row_count == 3
    assert lines(ds.rows().rows, "row_number", "a", "b") == [(1, 1, "x"), (2, 2, None), (3, 3, "y")]
    assert lines(ds.rows(sort="a", order="desc").rows, "row_number") == [3, 2, 1]


def test_no_matches_still_make_one_page(people):
    page = people.rows(q="zzz")
    assert (page.total, page.pages, page.page, page.rows.count()) == (0, 1, 1, 0)


@pytest.mark.parametrize("value", [0.0, 1.5, -2.0, 1e7, 123456789.25, 1e15, 1e16, 1.5e300, 1e-3, 1e-4, 1.25e-4, 1e-5, 9.99e-7, -1e22, float("inf")])
def test_double_text_is_the_shortest_form(spark, value):
    from pyspark.sql import functions as F

    from fieldnotes.functions.text import double_text
    assert spark.range(1).select(double_text(F.lit(value))).first()[0] == repr(value)


@pytest.mark.parametrize("arguments", [
    {"page": 0}, {"page_size": 0}, {"page_size": 501}, {"order": "sideways"}, {"page": 2**62 + 1},
])
def test_bad_arguments(people, arguments):
    with pytest.raises(ValueError):
        people.rows(**arguments)


def test_unknown_sort_column(people):
    with pytest.raises(KeyError):
        people.rows(sort="nope")


def test_rows_of_a_shuffled_join_are_all_numbered(spark):
    from fieldnotes import from_dataframe

    folder = "/root/testdata/sf0.01"
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        lines = spark.read.parquet(f"{folder}/lineitem.parquet")
        joined = lines.join(spark.read.parquet(f"{folder}/part.parquet"), lines.l_partkey == F.col("p_partkey"))
        ds = from_dataframe(joined)
        total = joined.count()
        last = ds.rows(page=10**9, page_size=500)
        assert last.total == total and last.page == -(-total // 500)
        assert [r.row_number for r in last.rows.collect()] == list(range((last.page - 1) * 500 + 1, total + 1))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_search_text_is_used_whole(make):
    ds = make(a=["x" * 300, "x" * 250])
    assert ds.rows(q="x" * 280).total == 1
