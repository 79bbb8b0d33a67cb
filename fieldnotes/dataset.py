"""The dataset: one cleaned table, its typed view and what is known about it."""

from __future__ import annotations

import uuid
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .operators import clean, codebook, compare, describe, distribution, infer, profile, report, rows, suggest
from .operators.columns import DATETIME, NUMERIC, UNSUPPORTED, Field, Profile, Reading, is_parsed, typed_value
from .operators.jobs import together
from .session import shared_folder, stored


class Dataset:
    """Profiling and analysis of one table.

    Results are DataFrames. What has to be known before a plan can be built
    (kinds, counts, quantiles) is collected as a few numbers per column, only for
    the columns a question touches, and kept.
    """

    def __init__(self, df: DataFrame, names: list[str] | None = None, *, name: str = "dataset",
                 tables: tuple[str, ...] = (), table: str | None = None, delimited: bool = False):
        headers = clean.clean_headers(list(df.columns if names is None else names))
        self.name, self.tables, self.table, self.delimited = name, tuple(tables), table, delimited
        self.cells, fields = clean.clean_cells(df, headers, missing_tokens=delimited)
        self._readings: dict[int, Reading] = {}
        self._facts: dict[int, dict] = {}
        self._distinct: dict[int, dict] = {}
        self._texts: dict[int, DataFrame] = {}
        self._counted: dict[int, DataFrame] = {}
        self.known_quartiles: dict[int, list] = {}
        self._row_count: int | None = None
        self._has_blank_rows = False
        self.fields = self._drop_fillers(fields)

    @classmethod
    def from_dataframe(cls, df: DataFrame, name: str = "dataset") -> "Dataset":
        return cls(df, name=name)

    @property
    def spark(self):
        return self.cells.sparkSession

    # ------------------------------------------------------------- columns
    def _drop_fillers(self, fields: list[Field]) -> list[Field]:
        """Leave out the unnamed columns a spreadsheet export adds when they hold nothing."""
        suspects = [f for f in fields if f.name.startswith(clean.FILLER_PREFIX)]
        if not suspects:
            return fields
        present = clean.value_counts(self.cells, suspects)
        return [f for f in fields if f not in suspects or present[f.physical]]

    def field(self, name: str | None) -> Field:
        if not name:
            raise ValueError("a column has to be named")
        for f in self.fields:
            if f.name == name:
                return f
        raise KeyError(f"{self.name} has no column {name!r}")

    @property
    def columns(self) -> list[str]:
        return [f.name for f in self.fields]

    # ---------------------------------------------------------------- rows
    @property
    def row_count(self) -> int:
        """Rows with at least one value."""
        if self._row_count is None:
            total, filled = clean.count_rows(self.cells, self.fields)
            self._row_count, self._has_blank_rows = filled, filled < total
        return self._row_count

    @property
    def frame(self) -> DataFrame:
        """The raw view: cleaned cells under physical names, without blank rows."""
        if self.row_count and self._has_blank_rows:
            return self.cells.where(clean.has_value(self.fields))
        return self.cells

    def stage(self) -> "Dataset":
        """Store the cleaned cells once as Parquet in the shared folder and go on from there.

        Every question then reads only its own columns, where a delimited file
        would be parsed whole for each pass. Rows are stored with their place, as
        files of a folder are not read back in order.
        """
        path = f"{shared_folder(self.spark).rstrip('/')}/fieldnotes-{uuid.uuid4().hex}"
        # The generator keeps the cleaning of a cell from being repeated by the filter.
        cells = self.cells.select(
            F.stack(F.lit(1), *[f.raw for f in self.fields]).alias(*[f.physical for f in self.fields])
        )
        clean.with_row_id(cells.where(clean.has_value(self.fields))).write.parquet(path)
        self.cells = self.spark.read.parquet(path)
        self._row_count, self._has_blank_rows = self.cells.count(), False
        return self

    def hold_row_order(self) -> None:
        """Store the rows once with their place if the plan deals them anew, as joins and groups do: ids that two
        plans give to such rows need not agree."""
        if clean.ROW_ID not in self.cells.columns and clean.moves_rows(self.frame):
            self.stage()

    # --------------------------------------------------------------- facts
    def readings(self, names: list[str] | None = None) -> dict[int, Reading]:
        """How each column is read; text columns cost one shared scan the first time."""
        wanted = [self.field(n) for n in names] if names is not None else self.fields
        missing = [f for f in wanted if f.position not in self._readings]
        if missing:
            found = infer.read_fields(self.cells, missing)
            self._readings.update(found.readings)
            self._texts.update(found.texts)
            if self._row_count is None and found.rows is not None:
                self._row_count, self._has_blank_rows = found.rows, False
        return {f.position: self._readings[f.position] for f in wanted}

    def typed(self, name: str) -> Column:
        """The typed value of a column, for use on ``frame``."""
        f = self.field(name)
        return typed_value(f, self.readings([name])[f.position])

    def values(self, present: str, **columns: str) -> DataFrame:
        """Typed values of columns under new names, of the rows in which ``present`` has one.

        Values that are read from text go through a generator, which the optimizer
        does not inline, so that a text is read once however often its value is used.
        """
        readings = self.readings(list(columns.values()))
        fields = [self.field(n) for n in columns.values()]
        typed = [typed_value(f, readings[f.position]) for f in fields]
        # Asked of the raw column first, as a test the scan can use to skip data.
        cells = self.cells.where(self.field(columns[present]).raw.isNotNull())
        if any(is_parsed(f, readings[f.position]) for f in fields):
            values = cells.select(F.stack(F.lit(1), *typed).alias(*columns))
        else:
            values = cells.select(*[value.alias(name) for value, name in zip(typed, columns)])
        return values.where(F.col(present).isNotNull())

    def counted(self, f: Field) -> DataFrame | None:
        """Distinct values of a column with their occurrences ``n``, stored once; None where values need no reading."""
        reading = self.readings([f.name])[f.position]
        if not is_parsed(f, reading):
            return None
        if f.position not in self._counted:
            self._counted[f.position] = stored(profile.counted_values(self._texts[f.position], f, reading))
        return self._counted[f.position]

    def _collect_counted(self, f: Field) -> None:
        if f.position in self._distinct:
            return
        counted = self.counted(f)
        if self._readings[f.position].kind == DATETIME:
            self._facts[f.position], self._distinct[f.position] = {}, profile.counted_moment_facts(counted)
        else:
            self._facts[f.position], self._distinct[f.position] = profile.counted_number_facts(counted)

    def profiles(self, names: list[str] | None = None) -> list[Profile]:
        """Kind, counts and flags of the given columns (all by default)."""
        wanted = [self.field(n) for n in names] if names is not None else self.fields
        readings = self.readings([f.name for f in wanted])
        parsed = [f for f in wanted if is_parsed(f, readings[f.position])]
        plain = [f for f in wanted if f not in parsed]
        together(
            self.spark,
            lambda: self.row_count,
            lambda: self._collect_numbers(plain, readings),
            lambda: self._collect_distincts(plain, readings),
            *[partial(self._collect_counted, f) for f in parsed],
        )
        result = []
        for f in wanted:
            reading = readings[f.position]
            facts = {**self._facts.get(f.position, {}), **self._distinct[f.position]}
            unique = None if reading.kind == UNSUPPORTED else facts.get("unique", 0)
            result.append(profile.settle(
                Profile(f, reading, reading.kind, self.row_count, facts.get("valid", 0), unique, facts=facts)
            ))
        return result

    def _collect_numbers(self, wanted: list[Field], readings: dict[int, Reading]) -> None:
        new = [f for f in wanted if f.position not in self._facts]
        if new:
            found = profile.number_facts(self.cells, new, readings)
            self._facts.update({f.position: found.get(f.position, {}) for f in new})

    def _collect_distincts(self, wanted: list[Field], readings: dict[int, Reading]) -> None:
        new = [f for f in wanted if f.position not in self._distinct]
        if new:
            found = profile.distinct_facts(self.cells, new, readings)
            self._distinct.update({f.position: found.get(f.position, {}) for f in new})

    def profile(self, name: str) -> Profile:
        return self.profiles([name])[0]

    def valid_numbers(self, name: str) -> int:
        """Valid values of a numeric column, without counting its distinct values; 0 for other kinds."""
        f = self.field(name)
        readings = self.readings([name])
        if readings[f.position].kind != NUMERIC:
            return 0
        if is_parsed(f, readings[f.position]):
            self._collect_counted(f)
        else:
            self._collect_numbers([f], readings)
        return self._facts[f.position].get("valid", 0)

    # ------------------------------------------------------------- results
    def codebook(self) -> DataFrame:
        return codebook.codebook(self)

    def meta(self) -> DataFrame:
        return codebook.dataset_meta(self)

    def describe(self, column: str) -> DataFrame:
        return describe.describe(self, column)

    def descriptive_table(self, column: str) -> DataFrame:
        return describe.descriptive_table(self, column)

    def distribution(self, column: str, top: int | None = 25, bins: int | None = None):
        return distribution.distribution(self, column, top, bins)

    def compare(self, group_by: str, metric: str | None = None, agg: str = "mean",
                sort: str | None = None, limit: int = 50):
        return compare.compare(self, group_by, metric, agg, sort, limit)

    def rows(self, page: int = 1, page_size: int = 50, sort: str | None = None,
             order: str = "asc", q: str | None = None):
        return rows.query_rows(self, page, page_size, sort, order, q)

    def suggest(self):
        return suggest.suggest(self)

    def report(self, column: str | None = None, comparison: dict | None = None, **options):
        return report.report(self, column, comparison, **options)
