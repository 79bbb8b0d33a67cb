"""What several operators share: saved tables, words, shingles, labels of connected rows."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of a shingle and the least similarity, in hundredths.
SHINGLE, SIMILAR = 5, 75


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where that is unset."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="run-")
        context.setCheckpointDir(folder)
    return folder


def saved(df: DataFrame, name: str) -> DataFrame:
    """The rows written as Parquet in the shared folder and read again: lineage ends there, and lost executors cost
    nothing that is already written. The folder goes when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    with _shuffles_dropped(spark):
        df.write.parquet(path)
    atexit.register(_drop, spark, path)
    written = spark.read.schema(df.schema).parquet(path)
    written.saved_at = path
    return written


#: Spark's setting under which the shuffle files of a query go when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Spark's setting for the rows that a Python worker is handed together, and how many texts that are.
_HANDED, TEXTS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1_000


@contextlib.contextmanager
def _setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A setting that holds meanwhile; the session's own holds again afterwards."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def _shuffles_dropped(spark: SparkSession) -> contextlib.AbstractContextManager:
    """What is shuffled meanwhile is deleted with the end of the query, as its rows are written."""
    return _setting(spark, _CLEANUP, "true")


def few_texts(spark: SparkSession) -> contextlib.AbstractContextManager:
    """Executors and their Python workers hold fewer texts at once meanwhile; a session that holds still fewer keeps
    to its own number."""
    own = int(spark.conf.get(_HANDED, None) or 0)
    return _setting(spark, _HANDED, str(min(own, TEXTS) if own > 0 else TEXTS))


#: Spark's settings for the bytes up to which a table is broadcast, by its estimate and by what a shuffle has measured.
_ESTIMATED, _MEASURED = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"


@contextlib.contextmanager
def measured_broadcasts(spark: SparkSession) -> Iterator[None]:
    """Spark broadcasts meanwhile by what it has measured alone. Its estimates go by the bytes of files, in which sparse
    bitmaps and repeated numbers are packed, and take an array for one number."""
    own = spark.conf.get(_MEASURED, None) or spark.conf.get(_ESTIMATED)
    with _setting(spark, _MEASURED, own), _setting(spark, _ESTIMATED, "-1"):
        yield


def released(*tables: DataFrame) -> None:
    """Deletes what saved() has written, once nothing reads it any more."""
    for table in tables:
        _drop(table.sparkSession, table.saved_at)


def _drop(spark: SparkSession, path: str) -> None:
    try:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may have ended before
        return


def slices(batch: pd.DataFrame, text: str = "text", size: int = 4_000_000) -> Iterator[pd.DataFrame]:
    """Rows of a batch in parts of about so many characters of text, so that what is made of a part stays small."""
    lengths = batch[text].str.len().fillna(0).to_numpy(dtype=np.int64)
    part = (np.cumsum(lengths) - lengths) // size
    for k in np.unique(part):
        yield batch[part == k]


def row_key() -> Column:
    """What tells rows apart where doc_id is null or repeated: a digest of doc_id and text. Rows with the same key are
    the same document."""
    return F.sha2(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit("\n"), F.coalesce(F.col("text").cast("string"), F.lit(""))), 256)


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text: str | None) -> list[bytes]:
    """Words of `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased; those bytes are what bytes.split() and lower() go by."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def mix(values: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values evenly (a finalizer of xor-shifts and odd factors)."""
    values = values ^ (values >> np.uint64(32))
    values = values * np.uint64(0xD6E8FEB86659FD93)
    values = values ^ (values >> np.uint64(29))
    values = values * np.uint64(0xA0761D6478BD642F)
    return values ^ (values >> np.uint64(32))


#: Random factors of a multilinear hash: of a byte's value, of its place in a word, of a word's place in a shingle.
_RANDOM = np.random.Generator(np.random.PCG64(20240229))
_OF_BYTE = _RANDOM.integers(0, 2**64, 256, np.uint64) | np.uint64(1)
_OF_BYTE[65:91] = _OF_BYTE[97:123]  # A-Z count as a-z
_OF_PLACE = _RANDOM.integers(0, 2**64, 1 << 16, np.uint64) | np.uint64(1)
_OF_WORD = _RANDOM.integers(0, 2**64, SHINGLE, np.uint64) | np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes of text that are hashed together.
_TOGETHER = 500_000


def _hashed_together(raw: list[bytes]) -> list[np.ndarray]:
    body = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    space = _SPACE[body]
    first = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    if not len(first):
        return [np.empty(0, np.uint64) for _ in raw]
    inside = np.flatnonzero(~space)
    ends = np.flatnonzero(space & np.concatenate([[False], ~space[:-1]]))
    sizes = ends - first
    starts = np.cumsum(sizes) - sizes
    place = np.arange(len(inside)) - np.repeat(starts, sizes)
    part = _OF_BYTE[body[inside]] * _OF_PLACE[place & 0xFFFF] + (place >> 16).astype(np.uint64)
    ids = mix(np.add.reduceat(part, starts) + sizes.astype(np.uint64))
    bounds = np.searchsorted(first, np.cumsum([0, *(len(r) + 1 for r in raw)]))
    whole = np.full(max(0, len(ids) - SHINGLE + 1), SHINGLE, np.uint64)
    for k in range(SHINGLE):
        whole = mix(whole + ids[k : k + len(whole)] * _OF_WORD[k])
    found = []
    for a, b in zip(bounds[:-1], bounds[1:]):
        if b - a >= SHINGLE or b == a:
            found.append(whole[a : b - SHINGLE + 1] if b > a else np.empty(0, np.uint64))
        else:  # fewer words: the whole sequence
            total = np.full(1, b - a, np.uint64)
            for k in range(b - a):
                total = mix(total + ids[a + k : a + k + 1] * _OF_WORD[k])
            found.append(total)
    return found


def shingle_hashes(texts) -> Iterator[np.ndarray]:
    """For each text the 64-bit hashes of all runs of five words, in order and with repeats; with fewer words of the
    whole sequence; without words none. Words are those of words(); bytes are hashed in bulk, without a loop."""
    held: list[bytes] = []
    size = 0
    for text in texts:
        held.append(text.encode("utf-8", "surrogatepass") if text else b"")
        size += len(held[-1])
        if size >= _TOGETHER:
            yield from _hashed_together(held)
            held, size = [], 0
    if held:
        yield from _hashed_together(held)


def _stars(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links of one task as (a, b), b the smallest id that the task's links reach from a; a million links together."""
    parent: dict[int, int] = {}

    def root(i: int) -> int:
        top = i
        while (above := parent.setdefault(top, top)) != top:
            top = above
        while parent[i] != top:
            parent[i], i = top, parent[i]
        return top

    def stars() -> pd.DataFrame:
        found = [(i, root(i)) for i in list(parent)]
        return pd.DataFrame([f for f in found if f[0] != f[1]], columns=["a", "b"], dtype="int64")

    for batch in batches:
        for a, b in zip(batch["a"].tolist(), batch["b"].tolist()):
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
        if len(parent) >= 1_000_000:
            yield stars()
            parent.clear()
    if parent:
        yield stars()


def components(links: DataFrame) -> DataFrame:
    """(id, component) for every id of links (a, b): the smallest id that links reach. Tasks first turn their own links
    into stars. Every round takes the smallest label around each id and then the label of that label, so that long
    chains shrink fast."""
    stars = links.select(F.col("a").cast("long"), F.col("b").cast("long")).mapInPandas(_stars, "a long, b long")
    both = saved(stars.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))).select("col.*"), "links")
    labels = held = saved(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("id")).alias("component")), "labels")
    while True:
        around = (
            both.join(labels, both.b == labels.id).groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        )
        nearer = labels.join(around, "id").select("id", "component", F.least("component", "near").alias("near"))
        up = labels.select(F.col("id").alias("near"), F.col("component").alias("far"))
        step = saved(
            nearer.join(up, "near", "left").select("id", F.least("near", F.coalesce("far", "near")).alias("next"), "component"),
            "labels",
        )
        if not step.filter("next < component").limit(1).count():
            released(step, both)
            return labels
        released(held)
        labels, held = step.select("id", F.col("next").alias("component")), step
