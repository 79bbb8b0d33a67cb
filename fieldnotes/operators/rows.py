"""Row queries: search, sort and page over the raw view."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.rounding import finite
from ..functions.text import row_text
from ..session import ensure_checkpoint_dir
from .clean import ROW_ID, partition_starts, with_row_id, with_row_number
from .columns import BOOLEAN, LABEL, shown_cell

# Request bounds.
MAX_PAGE, MAX_PAGE_SIZE = 2**31 - 1, 500
ORDERS = ("asc", "desc")

# Up to this many whole rows a page is read from the front of the table, or kept in
# a heap per task; pages further in take the paths that hold no such prefix.
FRONT_ROWS = 1_000
HEAP_ROWS = 5_000


@dataclass
class Page:
    """``rows`` has the place on the page, the 1-based row number and the raw cells by display name."""

    rows: DataFrame
    info: DataFrame
    total: int
    page: int
    pages: int


def query_rows(ds, page: int = 1, page_size: int = 50, sort: str | None = None,
               order: str = "asc", q: str | None = None) -> Page:
    for name, value, high in (("page", page, MAX_PAGE), ("page_size", page_size, MAX_PAGE_SIZE)):
        if not (isinstance(value, int) and 1 <= value <= high):
            raise ValueError(f"{name} must be a whole number between 1 and {high:,}.")
    if order not in ORDERS:
        raise ValueError(f"order must be one of: {', '.join(ORDERS)}.")
    if sort is not None:
        ds.field(sort)
    q = (q or "").strip() or None

    ds.hold_row_order()
    identified = with_row_id(ds.frame)
    matches, total = identified, ds.row_count
    if q:
        matches = identified.where(_row_text(ds).contains(q.lower()))
        total = matches.count()
    pages = max(1, math.ceil(total / page_size))
    page = min(page, pages)
    offset = (page - 1) * page_size

    if sort is None and q is None:
        window = _plain_window(ds.frame, identified, offset, page_size)
    else:
        key = _sort_key(ds, sort, order) if sort else []
        window = _ordered_window(ds.frame, matches, key, offset, page_size)
    cells = [finite(value) if isinstance(dtype, T.DoubleType) else value for value, dtype in _shown_cells(ds)]
    rows = window.select("position", (F.col("_row") + 1).alias("row_number"), *cells).orderBy("position")
    info = ds.spark.createDataFrame(
        [(total, page, page_size, pages, sort, order if sort else None, q)],
        "total bigint, page int, page_size int, pages bigint, sort string, order string, q string",
    )
    return Page(rows.toDF("position", "row_number", *ds.columns), info, total, page, pages)


def _shown_cells(ds) -> list[tuple[Column, T.DataType]]:
    """Raw cells as a row page shows them."""
    readings = ds.readings() if ds.delimited else {}
    return [shown_cell(f, readings.get(f.position)) for f in ds.fields]


def _row_text(ds) -> Column:
    return row_text(_shown_cells(ds))


def _sort_key(ds, sort: str, order: str) -> list[Column]:
    """Typed value, labels without regard to case; missing values last in both directions."""
    key = ds.typed(sort)
    kind = ds.readings([sort])[ds.field(sort).position].kind
    if kind == LABEL:
        key = F.lower(key)
    elif kind == BOOLEAN:
        key = key.cast("int")
    return [key.asc_nulls_last() if order == "asc" else key.desc_nulls_last()]


def _plain_window(frame: DataFrame, identified: DataFrame, offset: int, size: int) -> DataFrame:
    """A page in row order."""
    if ROW_ID in frame.columns and offset + size <= HEAP_ROWS:
        return _ordered_window(frame, identified, [], offset, size)
    if ROW_ID not in frame.columns and offset + size <= FRONT_ROWS:
        # take() reads only as many partitions as it needs and keeps their order.
        front = frame.take(offset + size)[offset:]
        lines = [(k + 1, offset + k, *row) for k, row in enumerate(front)]
        layout = frame.select(F.lit(0).alias("position"), F.lit(0).cast("bigint").alias("_row"), "*").schema
        return frame.sparkSession.createDataFrame(lines, layout)
    numbered = with_row_number(identified, partition_starts(frame))
    page = numbered.where(F.col("_row").between(offset, offset + size - 1))
    return page.withColumn("position", (F.col("_row") - offset + 1).cast("int"))


def _ordered_window(frame: DataFrame, matches: DataFrame, key: list[Column], offset: int, size: int) -> DataFrame:
    """A page in sorted order; ties keep row order in both directions."""
    order = [*key, F.col(ROW_ID).asc()]
    if offset + size <= HEAP_ROWS:
        page = matches.orderBy(*order).offset(offset).limit(size)
        page = page.withColumn("position", F.row_number().over(Window.orderBy(*order)))
    else:
        page = _far_window(matches, order, offset, size)
    return with_row_number(page, partition_starts(frame))


def _far_window(matches: DataFrame, order: list[Column], offset: int, size: int) -> DataFrame:
    """A page so far in that no task should hold the rows ahead of it.

    The row ids alone are sorted across the cluster and saved, so that the
    partitions that are counted are the ones that are read; then the rows of one
    page, at most ``MAX_PAGE_SIZE``, are looked up.
    """
    ensure_checkpoint_dir(matches.sparkSession)
    ids = matches.orderBy(*order).select(F.col(ROW_ID).alias("wanted")).checkpoint()
    ranked = with_row_number(with_row_id(ids), partition_starts(ids))
    wanted = ranked.where(F.col("_row").between(offset, offset + size - 1)).select(
        F.col("wanted").alias(ROW_ID), (F.col("_row") - offset + 1).cast("int").alias("position")
    )
    return matches.join(F.broadcast(wanted), ROW_ID)
