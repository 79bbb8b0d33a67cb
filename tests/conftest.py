import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from fieldnotes import from_dataframe, local_session, read_delimited  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, 4, **{"spark.python.sql.dataFrameDebugging.enabled": "false"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def make(spark):
    """A dataset from columns of Python values, spread over several partitions in row order."""
    def build(partitions=3, **columns):
        names = list(columns)
        rows = list(zip(*columns.values()))
        types = {bool: "boolean", int: "bigint", float: "double", str: "string"}
        schema = ", ".join(
            f"`{n}` {types[type(next((v for v in columns[n] if v is not None), ''))]}" for n in names
        )
        rdd = spark.sparkContext.parallelize(rows, partitions)
        return from_dataframe(spark.createDataFrame(rdd, schema))
    return build


@pytest.fixture
def csv(spark, tmp_path):
    """A dataset from the bytes or text of one file."""
    def read(content, name="data.csv", **options):
        path = tmp_path / name
        path.write_bytes(content if isinstance(content, bytes) else content.encode())
        return read_delimited(spark, str(path), **options)
    return read


def lines(df, *columns):
    """Rows of a small result in position order."""
    picked = df.orderBy("position") if "position" in df.columns else df
    rows = picked.select(*columns).collect() if columns else picked.collect()
    return [tuple(r) if len(r) > 1 else r[0] for r in rows]


def by_name(ds):
    return {row["name"]: row.asDict() for row in ds.codebook().collect()}
