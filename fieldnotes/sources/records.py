"""Records of delimited text whose cells may hold line breaks, from files that are split anywhere.

Whether a line ends inside a quoted cell depends on whether it begins inside one. So a split is first read under both
assumptions, which gives it two possible ends; a scan over the splits of each file then tells where every split begins,
and a second reading cuts the lines into records. Only what crosses the bound of a split is put together by a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Splits whose states may go to every task (some 200 bytes each); more of them are joined by a shuffle.
FEW_SPLITS = 200_000
WHOLE, HEAD, REST = 0, 1, 2


def occurrences(text: Column, character: str) -> Column:
    """How often an ASCII character stands in a text."""
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit(character), F.lit("")))


def _unquoted(text: Column, sep: str) -> Column:
    """A record with a mark in place of every quoted cell that is closed. A quote opens a cell only where one begins."""
    return F.regexp_replace(text, f'(^|{re.escape(sep)}) *+"[^"]*+(?:""[^"]*+)*+"', "$1-")


def ends_inside(text: Column, sep: str) -> Column:
    """Whether a line that begins outside quotes ends inside a quoted cell."""
    return _unquoted(text, sep).rlike(f'(?:^|{re.escape(sep)}) *+"')


def field_count(text: Column, sep: str) -> Column:
    """Fields of a whole record."""
    bare = F.when(text.contains('"'), _unquoted(text, sep)).otherwise(text)
    return occurrences(bare, sep) + 1


def _steps(lines: DataFrame, files: DataFrame) -> DataFrame:
    """Lines of the files with how each ends when it begins outside (``out``) or inside (``into``) a quoted cell."""
    few = files.select("file", "sep")
    text, quoted = F.col("text"), F.col("text").contains('"')
    seps = [row["sep"] for row in files.select("sep").distinct().collect()]
    cases = F.lit(False), F.lit(True)
    for sep in seps:
        here = F.col("sep") == sep
        cases = (
            F.when(here & quoted, ends_inside(text, sep)).otherwise(cases[0]),
            F.when(here & quoted, ends_inside(F.concat(F.lit('"'), text), sep)).otherwise(cases[1]),
        )
    joined = lines.join(F.broadcast(few) if few.count() <= FEW_SPLITS else few, "file")
    return joined.select("file", "block", "size", "line", text.cast("binary").alias("text"), cases[0].alias("out"), cases[1].alias("into"))


def _ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per split its end for both beginnings, and whether a record begins in it although it begins inside one."""
    now, ends, begins = None, [False, True], False

    def row() -> pd.DataFrame:
        return pd.DataFrame([(*now, ends[0], ends[1], begins)], columns=["file", "block", "size", "out", "into", "begins"])

    for batch in batches:
        for file, block, size, out, into in zip(batch["file"], batch["block"], batch["size"], batch["out"], batch["into"]):
            if (file, block, size) != now:
                if now is not None:
                    yield row()
                now, ends, begins = (file, block, size), [False, True], False
            begins = begins or not ends[1]
            ends = [into if e else out for e in ends]
    if now is not None:
        yield row()


def _begins(splits: pd.DataFrame) -> pd.DataFrame:
    """Whether each split of a file begins inside a record, and the split in which that record begins."""
    inside, head, rows = False, 0, []
    for s in splits.sort_values("block").itertuples():
        rows.append((s.file, s.block, s.size, inside, head))
        if not inside or s.begins:
            head = s.block
        inside = s.into if inside else s.out
    return pd.DataFrame(rows, columns=["file", "block", "size", "inside", "head"])


def _cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Records and parts of records of each split, in order."""
    now, inside, place, open_, kind = None, False, 0, [], WHOLE
    columns = ["file", "block", "of", "place", "kind", "text"]
    rows: list[tuple] = []

    def close(kind: int) -> None:
        nonlocal place, open_
        if open_:
            rows.append((now[0], now[1], head if kind == REST else now[1], place, kind, b"\n".join(open_)))
            place, open_ = place + 1, []

    head = 0
    for batch in batches:
        for file, block, size, out, into, begin, first, text in zip(*(batch[c] for c in ("file", "block", "size", "out", "into", "inside", "head", "text"))):
            if (file, block, size) != now:
                if open_:
                    close(REST if kind == REST else HEAD)
                now, inside, head, place = (file, block, size), begin, first, 0
                kind = REST if inside else WHOLE
            open_.append(text)
            inside = into if inside else out
            if not inside:
                close(kind)
                kind = WHOLE
        if rows:
            yield pd.DataFrame(rows, columns=columns)
            rows = []
    if open_:
        close(REST if kind == REST else HEAD)
    if rows:
        yield pd.DataFrame(rows, columns=columns)


def assembled(lines: DataFrame, splits: DataFrame, files: DataFrame, store=lambda df: df) -> DataFrame:
    """(file, block, place, text) of every record of the files. Line breaks inside a record become ``\\n``.

    Both readings go by the same splits; a split that the first has not seen stops the job."""
    steps = _steps(lines, files)
    split = ["file", "block", "size"]
    ends = steps.select(*split, "out", "into").mapInPandas(_ends, "file string, block bigint, size bigint, out boolean, into boolean, begins boolean")
    begins = store(ends.groupBy("file").applyInPandas(_begins, "file string, block bigint, size bigint, inside boolean, head bigint"))
    if begins.count() <= FEW_SPLITS:
        known = steps.join(F.broadcast(begins), split, "left")
    else:
        known = steps.join(begins, split, "left").repartition(*split).sortWithinPartitions(*split, "line")
    seen = F.when(F.col("inside").isNull(), F.raise_error(F.lit("The files were split in another way than before."))).otherwise(F.col("inside"))
    cut = known.select(*split, "out", "into", seen.cast("boolean").alias("inside"), "head", "text").mapInPandas(
        _cut, "file string, block bigint, of bigint, place bigint, kind int, text binary")
    cut = store(cut)
    parts = cut.where(F.col("kind") != WHOLE).groupBy("file", "of").agg(
        F.sort_array(F.collect_list(F.struct("block", "place", F.col("text").cast("string").alias("text")))).alias("parts"))
    crossing = parts.select(
        "file", F.col("of").alias("block"), F.col("parts")[0]["place"].alias("place"),
        F.array_join(F.transform("parts", lambda p: p["text"]), "\n").alias("text"),
    )
    return cut.where(F.col("kind") == WHOLE).select("file", "block", "place", F.col("text").cast("string").alias("text")).unionByName(crossing)
