"""Profiling and analysis of tabular data on Spark."""

from .dataset import Dataset
from .session import configure, local_session
from .sources.delimited import bad_rows, read_delimited
from .sources.scan import scan_files
from .sources.tables import TableSet, from_dataframe, open_tables

__all__ = [
    "Dataset", "TableSet", "bad_rows", "configure", "from_dataframe", "local_session",
    "open_tables", "read_delimited", "scan_files",
]
