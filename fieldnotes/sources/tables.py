"""Spark tables and folders of tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..dataset import Dataset
from ..operators.clean import clean_cells, clean_headers, has_value
from .delimited import NoRows, read_delimited
from .scan import EXTENSIONS, open_location

# The formats a folder of tables may hold, by file name ending.
TABLE_FORMATS = {".parquet": "parquet", ".orc": "orc", ".json": "json"}


def from_dataframe(df: DataFrame, name: str = "dataset") -> Dataset:
    """A dataset from any DataFrame; text columns are read for what they mean, others keep their type."""
    return Dataset.from_dataframe(df, name)


class TableSet:
    """Several named tables in one place, of which one is used at a time."""

    def __init__(self, name: str, loaders: dict[str, Callable[[], DataFrame | Dataset | None]]):
        """A loader gives a table, or the dataset of delimited files, or None where they hold no row."""
        if not loaders:
            raise ValueError(f"There are no tables in {name}.")
        self.name, self._loaders = name, dict(loaders)

    @property
    def names(self) -> list[str]:
        return list(self._loaders)

    def use(self, table: str | None = None) -> Dataset:
        """The named table, or the first one that has data."""
        if table is not None and table not in self._loaders:
            raise KeyError(f"There is no table named {table!r} in {self.name}.")
        for candidate in [table] if table is not None else self.names:
            df = self._loaders[candidate]()
            if isinstance(df, Dataset):
                df.name, df.tables, df.table = self.name, tuple(self.names), candidate
                return df
            if df is not None and _has_data(df):
                return Dataset(df, name=self.name, tables=tuple(self.names), table=candidate)
        raise ValueError(f"Table {table or self.names[0]!r} has no data.")


def _has_data(df: DataFrame) -> bool:
    if not df.columns:
        return False
    cells, fields = clean_cells(df, clean_headers(df.columns))
    return not cells.where(has_value(fields)).isEmpty()


def _delimited(spark: SparkSession, path: str) -> Dataset | None:
    try:
        return read_delimited(spark, path)
    except NoRows:
        return None


def open_tables(spark: SparkSession, location: str) -> TableSet:
    """The tables of a folder (Parquet, ORC, JSON, delimited text) or of a catalog schema. A member is a file or a folder
    with the ending of its format; members are only opened when they are used."""
    if "/" not in location and spark.catalog.databaseExists(location):
        names = sorted(t.name for t in spark.catalog.listTables(location))
        return TableSet(location, {n: lambda n=n: spark.table(f"`{location}`.`{n}`") for n in names})
    from pyarrow import fs

    filesystem, folder = open_location(location)
    loaders: dict[str, Callable[[], DataFrame]] = {}
    for entry in sorted(filesystem.get_file_info(fs.FileSelector(folder)), key=lambda e: e.base_name):
        for ending, format in TABLE_FORMATS.items():
            if entry.base_name.endswith(ending):
                path = f"{location.rstrip('/')}/{entry.base_name}"
                loaders[entry.base_name.removesuffix(ending)] = lambda f=format, p=path: spark.read.format(f).load(p)
        for ending in EXTENSIONS:
            if entry.base_name.lower().endswith(ending):
                path = f"{location.rstrip('/')}/{entry.base_name}"
                loaders[entry.base_name[: -len(ending)]] = lambda p=path: _delimited(spark, p)
    return TableSet(location, loaders)
