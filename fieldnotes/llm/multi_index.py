"""Near-duplicate embeddings by an inverted multi-index.

Vectors are scaled to length one and cut into halves; each half has a codebook of its own, fitted by k-means on a
bounded sample, and the two codebooks span a grid of cells. Every vector is indexed in the cell of its two nearest
codewords. A search walks the cells by multi-sequence traversal: from the nearest cell outwards in the order of how
far a neighbour has to lie off to fall into a cell (the distance to the planes between codewords, squared and added
over the halves), until the reach that gives the target recall for neighbours at exactly the least cosine. The reach
is found from sampled vectors with random neighbours at that cosine. What the cells hold is verified by the exact
cosine in double precision.

Equal vectors are one class. Cells are worked off in blocks of members against blocks of searches; a block gives
counts of links and a spanning forest of them, never its pairs.

Vectors that are null, empty, zero, or hold null or non-finite values link with nothing, and vectors of different
lengths don't link. Every row is a vector of its own: rows that share an id are linked by their vectors alone, and rows
without an id count as links and take part in components; a component of such rows only has no id, and all of them are
kept. The label and other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldnotes.llm.base import components, saved

#: Codewords of a half, vectors to fit on, recall at the least cosine, members or searches of a block.
WORDS, SAMPLE, RECALL, BLOCK = 24, 4_096, 0.995, 1_024


def _k_means(points: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    rng = np.random.default_rng(3)
    points = np.unique(points, axis=0)
    centers = points[rng.choice(len(points), min(k, len(points)), replace=False)]
    for _ in range(rounds):
        near = _squared(points, centers).argmin(1)
        centers = np.stack([points[near == i].mean(0) if (near == i).any() else centers[i] for i in range(len(centers))])
    return centers


def _squared(points: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return np.maximum((points**2).sum(1)[:, None] + (centers**2).sum(1) - 2 * points @ centers.T, 0)


class Grid:
    """Two codebooks and the reach of a search."""

    def __init__(self, sample: np.ndarray, least: float, words: int, recall: float):
        self.half = sample.shape[1] // 2
        self.books = [_k_means(h, words) for h in (sample[:, : self.half], sample[:, self.half :])]
        self.gaps = [np.sqrt(_squared(b, b)) for b in self.books]
        self.side = len(self.books[1])
        noise = np.random.default_rng(5).standard_normal(sample.shape)
        noise -= (noise * sample).sum(1, keepdims=True) * sample
        size = np.linalg.norm(noise, axis=1, keepdims=True)
        near = least * sample + np.sqrt(1 - least**2) * noise / np.where(size > 0, size, 1)
        off = self.offsets(sample)
        there = self.cells(near)
        cost = off[0][np.arange(len(sample)), there // self.side] ** 2 + off[1][np.arange(len(sample)), there % self.side] ** 2
        self.reach = float(min(np.quantile(cost, recall), 2 - 2 * least)) + 1e-12  # farther no neighbour can be

    def cells(self, points: np.ndarray) -> np.ndarray:
        one, two = (_squared(h, b).argmin(1) for h, b in zip((points[:, : self.half], points[:, self.half :]), self.books))
        return one * self.side + two

    def offsets(self, points: np.ndarray) -> list[np.ndarray]:
        """For each half and codeword: how far a point has to move until that codeword is nearer than its own."""
        found = []
        for h, book, gaps in zip((points[:, : self.half], points[:, self.half :]), self.books, self.gaps):
            d = _squared(h, book)
            own = d.argmin(1)
            gap = gaps[own]
            found.append(np.where(gap > 0, np.maximum(d - d.min(1, keepdims=True), 0) / np.where(gap > 0, 2 * gap, 1), 0))
        return found

    def visits(self, points: np.ndarray) -> list[list[int]]:
        """The cells that each point's search visits, the nearest first."""
        one, two = (o**2 for o in self.offsets(points))
        by_one, by_two = one.argsort(1, kind="stable"), two.argsort(1, kind="stable")
        found = []
        for a, b, p, q in zip(np.take_along_axis(one, by_one, 1).tolist(), np.take_along_axis(two, by_two, 1).tolist(), by_one.tolist(), by_two.tolist()):
            heap, cells = [(a[0] + b[0], 0, 0)], []
            while heap:
                cost, i, j = heapq.heappop(heap)
                if cost > self.reach:
                    break
                cells.append(p[i] * self.side + q[j])
                if j + 1 < len(b):
                    heapq.heappush(heap, (a[i] + b[j + 1], i, j + 1))
                if j == 0 and i + 1 < len(a):
                    heapq.heappush(heap, (a[i + 1] + b[0], i + 1, 0))
            found.append(cells)
        return found


def _unit(vectors, width: int) -> np.ndarray:
    """Vectors of length one, filled up with zeros to a common even width."""
    points = np.zeros((len(vectors), width))
    for row, v in zip(points, vectors):
        row[: len(v)] = np.asarray(v, float)
    points /= np.abs(points).max(1, keepdims=True)
    return points / np.linalg.norm(points, axis=1, keepdims=True)


def link(vectors: DataFrame, least: float = 0.95, words: int = WORDS, sample: int = SAMPLE, recall: float = RECALL) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row."""
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    sound = F.coalesce(
        (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0),
        F.lit(False),
    )
    # equal vectors go by a digest of their numbers, 0 and -0 alike, and their class by a number of its own
    digest = F.sha2(F.transform("v", lambda x: x + F.lit(0.0)).cast("string"), 256)
    rows = rows.withColumn("digest", F.when(sound, digest))
    classes = saved(
        rows.filter("digest is not null").groupBy("digest").agg(F.first("v").alias("v"), F.min("vec_id").alias("first"), F.count("*").alias("many"))
        .withColumn("id", F.monotonically_increasing_id()),
        "classes",
    )
    width = classes.agg(F.max(F.size("v"))).first()[0]
    if width is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    width += width % 2
    drawn = classes.orderBy("digest").limit(sample).select("v").toPandas()["v"]
    grid = Grid(_unit(drawn, width), least, words, recall)
    shared = vectors.sparkSession.sparkContext.broadcast(grid)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 4096):
                part = batch.iloc[at : at + 4096]
                points = _unit(part["v"], width)
                yield pd.DataFrame({"id": part["id"], "many": part["many"], "size": [len(v) for v in part["v"]], "unit": list(points), "cell": shared.value.cells(points), "visits": shared.value.visits(points)})

    placed = saved(classes.select("id", "many", "v").mapInPandas(place, "id long, many long, size int, unit array<double>, cell int, visits array<int>"), "placed")
    # as many numbers as the grid has cells
    members = {r["cell"]: r["count"] for r in placed.groupBy("cell").count().collect()}
    searches = {r["cell"]: r["count"] for r in placed.select(F.explode("visits").alias("cell")).groupBy("cell").count().collect()}
    blocks = {c: (-(-n // BLOCK), -(-searches.get(c, 1) // BLOCK)) for c, n in members.items()}

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Searches (side 0) go to each block of members of the cells they visit, members (side 1) to each block
        of searches of their cell."""
        for batch in batches:
            rows = []
            for k, (i, cell, visits) in enumerate(zip(batch["id"], batch["cell"], batch["visits"])):
                m, s = blocks[cell]
                rows += [(k, cell, i % m, b, 1) for b in range(s)]
                for c in visits:
                    if c in blocks:
                        m, s = blocks[c]
                        rows += [(k, c, b, i % s, 0) for b in range(m)]
            for at in range(0, len(rows), 20_000):
                part = pd.DataFrame(rows[at : at + 20_000], columns=["k", "at", "mine", "theirs", "side"])
                yield pd.concat([part.drop(columns="k"), batch.iloc[part["k"]].reset_index(drop=True)], axis=1)

    def verify(group: pd.DataFrame) -> pd.DataFrame:
        asks, held = group[group["side"] == 0], group[group["side"] == 1]
        empty = pd.DataFrame({"a": [], "b": [], "n": []}).astype("int64")
        if not len(asks) or not len(held):
            return empty
        x, y = np.stack(asks["unit"]), np.stack(held["unit"])
        ids, others = asks["id"].to_numpy(), held["id"].to_numpy()
        hits = (x @ y.T >= least) & (ids[:, None] != others) & (asks["size"].to_numpy()[:, None] == held["size"].to_numpy())
        i, j = np.nonzero(hits)
        if not len(i):
            return empty
        # a link that the other one's search doesn't find counts for both here
        back = np.zeros((len(held), grid_cells), bool)
        for k, visits in enumerate(held["visits"]):
            back[k, visits] = True
        alone = ~back[j, asks["cell"].to_numpy()[i]]
        counts = np.bincount(i, held["many"].to_numpy()[j], len(asks)).astype(np.int64)
        mirrored = np.bincount(j[alone], asks["many"].to_numpy()[i[alone]], len(held)).astype(np.int64)
        parent: dict[int, int] = {}

        def root(v: int) -> int:
            while parent.setdefault(v, v) != v:
                parent[v] = v = parent[parent[v]]
            return v

        forest = []
        first = np.zeros(len(i), bool)
        first[np.unique(i, return_index=True)[1]] = True
        for a, b in sorted(zip(ids[i].tolist(), others[j].tolist()), key=min) if len(i) < 4 * (len(asks) + len(held)) else zip(ids[i].tolist(), others[j].tolist()):
            p, q = root(a), root(b)
            if p != q:
                parent[max(p, q)] = min(p, q)
                forest.append((a, b, 0))
        rows = forest + [(a, a, n) for a, n in zip(ids.tolist(), counts.tolist()) if n] + [(a, a, n) for a, n in zip(others.tolist(), mirrored.tolist()) if n]
        return pd.DataFrame(rows, columns=["a", "b", "n"])

    grid_cells = len(grid.books[0]) * grid.side
    schema = "at int, mine int, theirs int, side int, id long, many long, size int, unit array<double>, cell int, visits array<int>"
    found = saved(placed.mapInPandas(deal, schema).groupBy("at", "mine", "theirs").applyInPandas(verify, "a long, b long, n long"), "found")
    counts = found.filter("a = b").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n"))
    labels = components(found.filter("a != b").select("a", "b"))
    sums = classes.select("id", "digest", "first", "many").join(counts, "id", "left").join(labels, "id", "left")
    sums = sums.select("digest", "first", (F.coalesce("n", F.lit(0)) + F.col("many") - 1).alias("n"), F.coalesce("component", "id").alias("label"))
    smallest = sums.groupBy("label").agg(F.min("first").alias("component"))
    named = saved(sums.join(smallest, "label").select("digest", "n", "component"), "named")
    salts = 32  # one vector may be a third of all rows
    dealt = rows.select("vec_id", "digest", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(salts)).cast("int").alias("salt"))
    spread = named.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    linked = dealt.join(spread, ["digest", "salt"], "left")
    component = F.when(F.col("digest").isNull(), F.col("vec_id")).otherwise(F.col("component"))
    return linked.select(
        "vec_id",
        F.coalesce("n", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.when(F.col("vec_id").isNull(), component.isNull()).otherwise(component == F.col("vec_id")).alias("kept"),
    )
