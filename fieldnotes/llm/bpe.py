"""Byte-level BPE by overlapping chunks.

A long text is cut into chunks that overlap. Every chunk is split into pre-tokens on its own, in parallel.
A pre-token depends only on where it starts and on the text from there on, so from the first boundary that
two neighbouring chunks share, both go on alike: there they are stitched. Where an overlap holds no shared
boundary (one pre-token longer than it), splitting goes on from the last sure boundary until it meets one.
The stitched pieces are then encoded by merging the pair of lowest rank; decoding joins the bytes of the ids.

Null and empty texts have no ids. Rows are encoded each for itself, repeated ids included; long texts are
told apart by a row key of their own. Clashing column names are replaced in the result.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldnotes.llm.base import slices

#: Characters that a chunk covers and characters that it shares with the next one; characters that are encoded together.
CHUNK, OVERLAP, TOGETHER = 16_384, 1_024, 1_000_000
#: The rank of a pair that is no token.
_NONE = 1 << 40
FIELDS = "n_tokens long, ids_sha256 string, decoded_sha256 string, ids binary"


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a vocabulary file: a base64 token and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def pair_ranks(ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of tokens that stand for a token together, as one number in order, and the rank of that token."""
    found = sorted(
        (left << 32 | right, rank)
        for token, rank in ranks.items() for k in range(1, len(token))
        if (left := ranks.get(token[:k])) is not None and (right := ranks.get(token[k:])) is not None
    )
    return np.array([f[0] for f in found], np.int64), np.array([f[1] for f in found], np.int64)


class Encoder:
    """Encodes pieces by ranks, remembering short ones by their packed ids (little-endian 32-bit)."""

    #: Pieces to remember; bytes of a piece that is merged with others, and such pieces in a table.
    KEPT, SHORT, ROWS = 200_000, 40, 4_096

    def __init__(self, ranks: dict[bytes, int], pattern: str, pairs: tuple[np.ndarray, np.ndarray] | None = None):
        import regex

        self.ranks, self.split = ranks, regex.compile(pattern)
        self.keys, self.merged = pair_ranks(ranks) if pairs is None else pairs
        self.tokens, self.names = (np.empty(max(ranks.values(), default=-1) + 1, object) for _ in "ab")
        for token, rank in ranks.items():
            self.tokens[rank], self.names[rank] = token, str(rank)
        self.of_byte = np.array([ranks.get(bytes([k]), -1) for k in range(256)], np.int64)
        self.of_bytes = self.pairs(self.of_byte[:, None], self.of_byte[None, :])
        self.known: dict[str, bytes] = {}

    def pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ranks of pairs of ids, _NONE for those that are no token together."""
        if not len(self.keys):
            return np.full(np.broadcast_shapes(left.shape, right.shape), _NONE)
        keys = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where((self.keys[at] == keys) & (left >= 0) & (right >= 0), self.merged[at], _NONE)

    def learn(self, pieces: set[str]) -> None:
        short: list[tuple[str, bytes]] = []
        whole = bool((self.of_byte >= 0).all())
        for text in pieces:
            raw = text.encode("utf-8")
            rank = self.ranks.get(raw)
            if rank is not None:
                self.known[text] = rank.to_bytes(4, "little")
            elif len(raw) <= self.SHORT and (whole or all(self.of_byte[k] >= 0 for k in raw)):
                short.append((text, raw))
            else:
                self.known[text] = np.array(self.merge(raw), "<u4").tobytes()
        short.sort(key=lambda piece: len(piece[1]))
        for k in range(0, len(short), self.ROWS):
            part = short[k : k + self.ROWS]
            self.known.update(zip((text for text, _ in part), self.merge_together([raw for _, raw in part])))

    def merge_together(self, raws: list[bytes]) -> list[bytes]:
        """The same as merge() for many short pieces, whose bytes are tokens, in one table: each round merges the pair of
        lowest rank, the leftmost of equals, of every piece that has one."""
        sizes = np.array([*map(len, raws)])
        width = int(sizes.max())
        body = np.frombuffer(b"".join(raw.ljust(width, b"\0") for raw in raws), np.uint8).reshape(-1, width)
        columns = np.arange(width)
        ids = np.where(columns < sizes[:, None], self.of_byte[body], -1)
        pairs = np.where(columns[1:] < sizes[:, None], self.of_bytes[body[:, :-1], body[:, 1:]], _NONE)
        ended, open_ = ids.copy(), np.arange(len(raws))
        while len(open_):
            at = pairs.argmin(1)
            best = pairs[np.arange(len(at)), at]
            if not (goes_on := best < _NONE).all():
                ended[open_[~goes_on]] = ids[~goes_on]
                open_, ids, pairs, at, best = open_[goes_on], ids[goes_on], pairs[goes_on], at[goes_on], best[goes_on]
                if not len(open_):
                    break
            rows, behind = np.arange(len(at)), columns > at[:, None]
            ids[:, :-1] = np.where(behind[:, :-1], ids[:, 1:], ids[:, :-1])
            pairs[:, :-1] = np.where(behind[:, :-2], pairs[:, 1:], pairs[:, :-1])
            ids[:, -1], pairs[:, -1] = -1, _NONE
            ids[rows, at] = best
            pairs[rows, at] = self.pairs(best, ids[rows, at + 1])
            rows, at, best = rows[at > 0], at[at > 0], best[at > 0]
            pairs[rows, at - 1] = self.pairs(ids[rows, at - 1], best)
        packed = ended[ended >= 0].astype("<u4").tobytes()
        ends = np.cumsum((ended >= 0).sum(1) * 4).tolist()
        return [packed[a:b] for a, b in zip([0, *ends], ends)]

    def merge(self, raw: bytes) -> list[int]:
        """Merges the pair of lowest rank, the leftmost of equals, until none is left: a heap of pairs over a
        linked list of parts, so that a piece of any length takes n log n steps."""
        ranks, size = self.ranks, len(raw)
        ends, after, before = list(range(1, size + 1)), list(range(1, size + 1)), list(range(-1, size - 1))
        heap = [(rank, i, i + 2) for i in range(size - 1) if (rank := ranks.get(raw[i : i + 2])) is not None]
        heapq.heapify(heap)
        gone = bytearray(size)
        while heap:
            _, left, end = heapq.heappop(heap)
            right = after[left] if not gone[left] else size
            if gone[left] or right >= size or ends[right] != end:
                continue  # one of the two has been merged meanwhile
            gone[right], ends[left], after[left] = 1, end, after[right]
            if after[left] < size:
                before[after[left]] = left
                if (rank := ranks.get(raw[left : ends[after[left]]])) is not None:
                    heapq.heappush(heap, (rank, left, ends[after[left]]))
            if (first := before[left]) >= 0 and (rank := ranks.get(raw[first:end])) is not None:
                heapq.heappush(heap, (rank, first, end))
        ids, at = [], 0
        while at < size:
            ids.append(ranks[raw[at : ends[at]]])
            at = after[at]
        return ids

    def starts(self, text: str) -> list[int]:
        return [m.start() for m in self.split.finditer(text)]

    def encode(self, texts: list[list[str]]) -> list[np.ndarray]:
        """The ids of texts that are split into pieces."""
        pieces = set().union(*texts)
        if len(self.known) + len(pieces) > self.KEPT:
            self.known.clear()
        self.learn(pieces.difference(self.known))
        ids = [np.frombuffer(b"".join(map(self.known.__getitem__, text)), "<u4") for text in texts]
        if len(self.known) > self.KEPT:
            self.known.clear()
        for text in pieces:
            if len(text) > 64:
                self.known.pop(text, None)
        return ids

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(self.tokens[ids].tolist())

    def digest(self, ids: np.ndarray) -> tuple:
        text = " ".join(self.names[ids].tolist()).encode()
        return len(ids), hashlib.sha256(text).hexdigest(), hashlib.sha256(self.decode(ids)).hexdigest(), ids.tobytes()


def stitch(encoder: Encoder, text: str, chunks: list[tuple[int, int, list[int]]]) -> list[int]:
    """Boundaries of the whole text from those of its chunks (start, end, boundaries), in order. The boundaries
    of a chunk are sure from a sure start on, but for the last one before its end when the text goes on."""
    whole: list[int] = []
    for start, end, own in chunks:
        own = own if end >= len(text) else own[:-2] or own[:1]  # what the chunk's end cuts may go on
        if not start:
            whole = own
            continue
        shared = set(whole[-(OVERLAP + 2) :])
        at = next((k for k, b in enumerate(own) if b in shared), None)
        if at is None:  # go on from the last sure boundary until it meets the chunk's own
            mine, go = set(own), whole.pop()
            for m in encoder.split.finditer(text, go):
                if m.start() in mine:
                    at = own.index(m.start())
                    break
                whole.append(m.start())
            else:
                return whole  # it went on to the end of the text
        while whole and whole[-1] >= own[at]:
            whole.pop()
        whole += own[at:]
    return whole


def encode(docs: DataFrame, vocabulary: str, pattern: str, text: str = "text", chunk: int = CHUNK) -> DataFrame:
    """docs with n_tokens, ids (little-endian 32-bit), ids_sha256 and decoded_sha256 instead of the text."""
    spark = docs.sparkSession
    ranks = read_ranks(vocabulary)
    shared = spark.sparkContext.broadcast((ranks, pair_ranks(ranks)))  # one vocabulary file, its size is fixed
    kept = [c for c in docs.columns if c not in ("n_tokens", "ids", "ids_sha256", "decoded_sha256", text)]
    keep = [docs.schema[c] for c in kept]
    source = docs.withColumn(text, F.coalesce(F.col(text), F.lit(""))).select(*kept, text)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keep), FIELDS])

    def direct(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = Encoder(shared.value[0], pattern, shared.value[1])
        for batch in batches:
            for part in slices(batch, text, TOGETHER):
                rows = [encoder.digest(ids) for ids in encoder.encode([encoder.split.findall(t) for t in part[text]])]
                yield pd.concat([part[kept], pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256", "ids"], index=part.index)], axis=1)

    short = source.filter(F.length(text) <= chunk + OVERLAP).mapInPandas(direct, schema)
    # chunks of a long text spread over the tasks, then meet again under the row's key
    long = source.filter(F.length(text) > chunk + OVERLAP).withColumn("_row", F.expr("uuid()"))
    cut = long.select(
        *kept,
        "_row",
        F.posexplode(F.expr(f"transform(sequence(0, cast((length(`{text}`) - 1) div {chunk} as int)), i -> substring(`{text}`, i * {chunk} + 1, {chunk + OVERLAP}))")).alias("_part", "_chunk"),
        F.length(text).alias("_size"),
    ).repartition(F.col("_row"), F.col("_part"))
    cut_schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keep), "_row string, _part int, _chunk string, _size int, _starts array<int>"])

    def pretokenise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = Encoder(shared.value[0], pattern, shared.value[1])
        for batch in batches:
            for some in slices(batch, "_chunk", TOGETHER):
                yield some.assign(_starts=[[s + part * chunk for s in encoder.starts(t)] for part, t in zip(some["_part"], some["_chunk"])])

    def join_up(group: pd.DataFrame) -> pd.DataFrame:
        global _ENCODER
        encoder = _ENCODER = _ENCODER if _ENCODER is not None and _ENCODER.split.pattern == pattern and _ENCODER.ranks is shared.value[0] else Encoder(shared.value[0], pattern, shared.value[1])
        group = group.sort_values("_part")
        body = "".join(t[:chunk] for t in group["_chunk"])
        parts = [(p * chunk, min(p * chunk + chunk + OVERLAP, len(body)), list(s)) for p, s in zip(group["_part"], group["_starts"])]
        bounds = [*stitch(encoder, body, parts), len(body)]
        row = encoder.digest(encoder.encode([[body[a:b] for a, b in zip(bounds, bounds[1:])]])[0])
        if len(encoder.known) > 20_000:  # the worker outlives the task
            encoder.known.clear()
        head = group[kept].head(1).reset_index(drop=True)
        return pd.concat([head, pd.DataFrame([row], columns=["n_tokens", "ids_sha256", "decoded_sha256", "ids"])], axis=1)

    joined = cut.mapInPandas(pretokenise, cut_schema).groupBy("_row").applyInPandas(join_up, schema)
    return short.unionByName(joined)


_ENCODER: Encoder | None = None


def decode(ids: bytes, bytes_of: dict[int, bytes]) -> bytes:
    """The bytes that little-endian 32-bit ids stand for."""
    return b"".join(map(bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))
