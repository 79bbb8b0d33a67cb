"""Benchmark decontamination: size-partitioned MinHash containment search.

Items are partitioned by their number of five-word shingles. For every partition a document is seen through
windows of one and a half times the partition's largest size, so that an item that stands in a long document
fills a good part of some window, and containment turns into a Jaccard similarity that MinHash can find: with
BANDS bands of one minimum each an item at containment 0.75 is missed with a chance below 3e-4, a whole one
below 3e-6 (items of one or two shingles more often: 1.4 % and 1e-4). Window minima are the minima of blocks of shingles, so that all partitions share their cost.

Bloom filters of fixed size hold the items' minima and shingles; they go to every task, and only documents
with a window minimum in the first send anything: those minima, and the shingles in the second. Candidates come
from joining minima, and are then verified: containment is the exact share of an item's distinct shingles
that the whole document holds, and has to be 0.75 or more.

Null and empty texts match nothing, nor do rows with a null doc_id unless a key is given. Items of fewer than five words match nothing: they have no shingle that a
document could hold. Rows with the same doc_id or item_id count as one. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldnotes.llm.base import SHINGLE, SIMILAR, mix, saved, shingle_hashes, words

BANDS = 32
#: Upper bounds of item sizes in shingles; larger items are cut into pieces of the last size for the search.
SIZES = (8, 16, 32, 64, 128)
#: Bits of a Bloom filter: 4 MB, whatever the number of items. A full filter only lets more through.
BLOOM_BITS = 1 << 25
#: Shingles that are looked at together; some dozen numbers are held for each.
TOGETHER = 250_000
SALTS = 16
_FACTORS = np.array([(0x9E3779B97F4A7C15 * (2 * k + 1) ^ 0xD1B54A32D192ED03 >> (k % 7)) & (2**64 - 1) | 1 for k in range(BANDS)], np.uint64)


def _band(hashes: np.ndarray, k: int) -> np.ndarray:
    values = hashes * _FACTORS[k]
    return values ^ (values >> np.uint64(31))


def _key(minima: np.ndarray, k: int) -> np.ndarray:
    return mix(minima + _FACTORS[k])


def _slots(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return keys & np.uint64(BLOOM_BITS - 1), (keys >> np.uint64(32)) & np.uint64(BLOOM_BITS - 1)


def _has(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    a, b = _slots(keys)
    return ((bits[a >> np.uint64(3)] >> (a & np.uint64(7)).astype(np.uint8)) & (bits[b >> np.uint64(3)] >> (b & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)


def _item_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (item_id, kind, value, size): kind 0 a distinct shingle, kind 1 + partition a band's key."""
    for batch in batches:
        rows = []
        for item, text, ordered in zip(batch["item_id"], batch["text"], shingle_hashes(batch["text"])):
            ordered = ordered if len(words(text)) >= SHINGLE else ordered[:0]
            hashes = np.unique(ordered)
            rows += [(item, 0, int(h), len(hashes)) for h in hashes.view(np.int64)]
            for at in range(0, len(ordered), SIZES[-1]):
                piece = np.unique(ordered[at : at + SIZES[-1]])
                part = int(np.searchsorted(SIZES, len(piece)))
                rows += [(item, 1 + part, int(_key(_band(piece, k).min(keepdims=True), k).view(np.int64)[0]), len(hashes)) for k in range(BANDS)]
        yield pd.DataFrame(rows, columns=["item_id", "kind", "value", "size"])


def _bloom(values: DataFrame) -> np.ndarray:
    """A Bloom filter of a column of 64-bit keys, as partial filters of the tasks that are or-ed by bucket."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            a, b = _slots(batch["value"].to_numpy().view(np.uint64))
            slots = np.unique(np.concatenate([a, b]))
            yield pd.DataFrame({"byte": (slots >> np.uint64(3)).astype(np.int32), "bits": (np.uint8(1) << (slots & np.uint64(7)).astype(np.uint8)).astype(np.int32)})

    bits = np.zeros(BLOOM_BITS >> 3, np.uint8)
    rows = values.distinct().mapInPandas(partial, "byte int, bits int").groupBy("byte").agg(F.expr("bit_or(bits)").alias("bits"))
    table = rows.toPandas()  # at most one row for each byte of the filter
    bits[table["byte"].to_numpy()] = table["bits"].to_numpy().astype(np.uint8)
    return bits


def _found(group: list, parts: list[int], in_bands: np.ndarray, in_shingles: np.ndarray) -> pd.DataFrame:
    """Rows (doc_id, kind, value) of the documents of a group [(doc_id, hashes)] that have a window minimum in
    the items' filter: those minima and the shingles that items may hold."""
    if not parts:
        return pd.DataFrame({"doc_id": pd.Series([], dtype=object), "kind": [], "value": []}).astype({"kind": "int64", "value": "int64"})
    hashes = np.concatenate([h for _, h in group])
    sizes = np.array([len(h) for _, h in group])
    firsts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    step = SIZES[parts[0]] // 2
    spans = {part: -(-SIZES[part] * 3 // 2 // step) for part in parts}
    blocks = -(-sizes // step)
    owner = np.repeat(np.arange(len(group)), blocks)
    inside = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    starts = firsts[owner] + inside * step
    # empty blocks after each document keep windows from reaching into the next one
    place = np.arange(len(owner)) + owner * max(spans.values())
    total = int(place[-1]) + 1 + max(spans.values())
    own_of = np.zeros(total, np.int64)
    own_of[place] = owner
    top = np.uint64(2**64 - 1)
    kinds, docs_of, values = [], [], []
    for k in range(BANDS):
        padded = np.full(total, top, np.uint64)
        padded[place] = np.minimum.reduceat(_band(hashes, k), starts)
        seen, width = padded.copy(), 1
        for part in parts:  # spans grow with the parts: each goes on from the one before
            while width < spans[part]:  # minima of windows of `width` blocks, by doubling
                shift = min(width, spans[part] - width)
                seen[:-shift] = np.minimum(seen[:-shift], seen[shift:])
                width += shift
            at = place[np.concatenate([[True], (seen[place[1:]] != seen[place[:-1]]) | (owner[1:] != owner[:-1])])]
            keys = _key(seen[at], k)
            hit = _has(in_bands, keys)
            if hit.any():
                docs_of.append(own_of[at[hit]])
                values.append(keys[hit])
                kinds.append(np.full(int(hit.sum()), part + 1))
    if not docs_of:
        return pd.DataFrame({"doc_id": pd.Series([], dtype=object), "kind": [], "value": []}).astype({"kind": "int64", "value": "int64"})
    which = np.unique(np.concatenate(docs_of))
    for w in which:
        own = np.unique(group[w][1])
        own = own[_has(in_shingles, own)]
        docs_of.append(np.full(len(own), w))
        values.append(own)
        kinds.append(np.zeros(len(own), np.int64))
    ids = np.array([doc for doc, _ in group], object if isinstance(group[0][0], str) else np.int64)
    table = pd.DataFrame({"doc_id": ids[np.concatenate(docs_of)], "kind": np.concatenate(kinds), "value": np.concatenate(values).view(np.int64)})
    return table.drop_duplicates()


def contaminated(docs: DataFrame, benchmark: DataFrame, least: int = SIMILAR, key: Column | None = None) -> DataFrame:
    """(doc_id, item_id, matched, size, containment) of every document that holds at least `least` hundredths of
    an item's shingles. With a key (text), rows go by that instead of their ids, and doc_id holds it."""
    spark = docs.sparkSession
    items = saved(
        benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
        .filter("item_id is not null").dropDuplicates(["item_id"])
        .mapInPandas(_item_rows, "item_id long, kind int, value long, size int"),
        "items",
    )
    bands = spark.sparkContext.broadcast(_bloom(items.filter("kind > 0").select("value")))
    shingles = spark.sparkContext.broadcast(_bloom(items.filter("kind = 0").select("value")))
    parts = [r[0] - 1 for r in items.filter("kind > 0").select("kind").distinct().orderBy("kind").collect()]

    def look(group: list) -> pd.DataFrame:
        return _found(group, parts, bands.value, shingles.value)

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            docs_at: list = []
            many = 0
            for doc, hashes in zip(batch["doc_id"], shingle_hashes(batch["text"])):
                if len(hashes):
                    docs_at.append((doc, hashes))
                    many += len(hashes)
                if many >= TOGETHER:
                    yield look(docs_at)
                    docs_at, many = [], 0
            if docs_at:
                yield look(docs_at)

    hits = saved(
        docs.select((F.col("doc_id").cast("long") if key is None else key).alias("doc_id"), F.col("text").cast("string").alias("text"))
        .filter("doc_id is not null and text is not null")
        .mapInPandas(search, f"doc_id {'long' if key is None else 'string'}, kind int, value long"),
        "hits",
    )
    # a passage may stand in a third of all documents: its keys are dealt over salts
    salted = items.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    both = hits.distinct().withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(
        salted, ["kind", "value", "salt"]
    )
    return (
        both.groupBy("doc_id", "item_id")
        .agg(
            F.sum(F.when(F.col("kind") == 0, 1).otherwise(0)).alias("matched"),
            F.max("size").alias("size"),
            F.max(F.when(F.col("kind") > 0, 1).otherwise(0)).alias("candidate"),
        )
        .filter((F.col("candidate") == 1) & (F.col("matched") * 100 >= F.col("size") * least))
        .select("doc_id", "item_id", "matched", F.col("size").cast("long").alias("size"), (F.col("matched") / F.col("size")).alias("containment"))
    )
