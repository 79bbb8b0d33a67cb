"""Phrase collocations by an FM-index per shard over word ids.

A shard is what one task has read of one language, at most SHARD words: its pieces as word ids, parted by 0, and its own
dictionary. Shards are written once, and all later steps go by them.

1. Dictionaries are summed over shards. Words found less than LEAST times in a language stand in no candidate.
2. Every shard builds an FM-index over its frequent words and extends each word to the left: the intervals are its pairs
   of words with their counts. The counts are summed over shards.
3. Places where frequent pairs chain hold triples that may be frequent. Every shard counts them by buckets of a hash, and
   the counts are summed over shards: a triple in a bucket with less than LEAST is not frequent, so its places go. What
   is left over stays right, as the sum of a bucket is never below the count of a triple in it.
4. Every shard builds an FM-index of the places that are left and one of its reverse, and enumerates phrases of three
   words by bidirectional interval extension, to the right and to the left in turn. The counts are summed over shards.
   In the same way phrases up to DEPTH words come from places where frequent triples chain, with buckets for those of
   four words. Every part of a candidate is a candidate, so none is lost.
5. A phrase whose extension by one word to the left or to the right is as frequent as itself goes; a longer one that is
   as frequent comes with such an extension. The counts of the parts of the rest give the scores.

What a task holds is bounded by SHARD; counts go through the shuffle one row for each shard and phrase, so a language, a
word or a pair that fills a third of the table costs a row for each shard. Without the buckets a shard would give a row
for each rare triple of frequent pairs, and such pairs become many as a corpus grows. A piece is never cut, a shard may
grow by one piece.

Null texts are empty, a null language is `und`; ids are not looked at, so null and repeated ids and repeated rows all
count. Ties go by the contract: score, count, phrase in UTF-8 byte order. A table without rows gives none. Other columns of the table
are not read.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldnotes.llm.base import mix, released, saved

#: Least count of a candidate, words of the longest, phrases that are reported for a language.
LEAST, DEPTH, TOP = 100, 5, 2_000
#: Words of a shard; bytes of text that are split together.
SHARD, TOGETHER = 2_000_000, 1 << 20
#: Frequent pairs or triples that may go to every task (8 bytes a word); more of them are joined to the shards by a shuffle.
FEW = 1_000_000
#: Words of the table for a bucket; least and most buckets (a bit each goes to every task); buckets that are summed together.
LOAD, LEAST_BUCKETS, MOST_BUCKETS, BLOCK = 32, 1 << 20, 1 << 28, 1 << 18
#: Bits of a word's number that tell words of a shard apart, and shards of a task.
LOCAL_BITS, TASK_BITS = 24, 16
#: Names of a phrase's words by the ids of a shard, and by those of all shards.
LOCAL, GLOBAL = ["a", "b", "c", "d", "e"], ["w1", "w2", "w3", "w4", "w5"]

# A-Z become a-z, what parts pieces becomes a line break, a tab a space.
_TABLE = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\x0d\t", b"abcdefghijklmnopqrstuvwxyz" + b"\n" * 9 + b" ")


class _Ids(dict):
    """Numbers for words as they come: 0 parts pieces, -1 is no word."""

    def __init__(self):
        super().__init__({b"": -1, b"\n": 0})

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self) - 1
        return number


class _Shard:
    """Words of one language, gathered until there are enough of them."""

    def __init__(self):
        self.ids, self.parts, self.size = _Ids(), [], 0

    def add(self, pieces: bytes) -> None:
        tokens = pieces.replace(b"\n", b" \n ").split(b" ")
        found = np.fromiter(map(self.ids.__getitem__, tokens), np.int32, len(tokens))
        found = found[found >= 0]
        # one break is as good as several
        found = found[(found > 0) | np.concatenate([[True], found[:-1] > 0])]
        self.parts += [found, np.zeros(1, np.int32)]
        self.size += int((found > 0).sum())

    def row(self, lang: str, number: int) -> dict:
        whole = np.concatenate(self.parts)
        if len(self.ids) >= 1 << LOCAL_BITS:
            raise ValueError("a piece with too many distinct words for one shard")
        words = [w for w, number in self.ids.items() if number > 0]
        return {"shard": number, "lang": lang, "ids": zlib.compress(whole.tobytes(), 1), "words": words, "counts": np.bincount(whole, minlength=len(words) + 1)[1:].tolist()}


def _slices(raw: bytes) -> Iterator[bytes]:
    """Parts of a text of about TOGETHER bytes that end where a piece ends."""
    at = 0
    while at < len(raw):
        end = raw.find(b"\n", at + TOGETHER)
        end = len(raw) if end < 0 else end + 1
        yield raw[at:end]
        at = end


def sharded(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(shard, lang, ids, words, counts): word ids of all texts as packed little-endian 32-bit numbers, 0 between pieces; words[k]
    has the id k + 1 and stands counts[k] times in the shard."""

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        open_: dict[str, _Shard] = {}
        numbers = itertools.count(TaskContext.get().partitionId() << TASK_BITS)
        for batch in batches:
            for name, texts in batch.groupby("lang", sort=False)["text"]:
                held: list[bytes] = []
                size = 0
                for k, raw in enumerate(texts, 1):
                    held.append(raw)
                    size += len(raw)
                    if size < TOGETHER and k < len(texts):
                        continue
                    for part in _slices(b"\n".join(held).translate(_TABLE)):
                        shard = open_.setdefault(name, _Shard())
                        shard.add(part)
                        if shard.size >= SHARD:
                            yield pd.DataFrame([open_.pop(name).row(name, next(numbers))])
                    held, size = [], 0
        for name, shard in open_.items():
            yield pd.DataFrame([shard.row(name, next(numbers))])

    source = docs.select(
        F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).cast("binary").alias("text")
    ).filter("length(text) > 0")
    return source.mapInPandas(gather, "shard long, lang string, ids binary, words array<binary>, counts array<long>")


class FMIndex:
    """The BWT of a sequence of word ids that ends with 0, its suffixes in the order of their first `depth` ids.

    Intervals of phrases of up to `depth` words are those of a full order: where one ends is a matter of no more ids."""

    def __init__(self, sequence: np.ndarray, depth: int):
        size = len(sequence)
        rank, known = sequence, 1
        while known < depth:  # an order by twice as many ids from the order by those that are known
            step = min(known, depth - known)
            after = np.zeros(size, np.int64)
            after[: size - step] = rank[step:]
            after += rank * (np.int64(rank.max()) + 1)
            rank = np.unique(after, return_inverse=True)[1]
            known += step
        order = np.argsort(rank, kind="stable")
        self.size = size
        self.bwt = sequence[order - 1]
        #: Where the suffixes begin that start with each id.
        self.first = np.searchsorted(sequence[order], np.arange(int(sequence.max()) + 2))

    @cached_property
    def _ranked(self) -> np.ndarray:
        """(id, place) of the BWT in order, as one number; as many are before (c, i) as first[c] + Occ(c, i)."""
        places = np.argsort(self.bwt, kind="stable")
        return self.bwt[places] * np.int64(self.size) + places

    def before(self, ids: np.ndarray, places: np.ndarray) -> np.ndarray:
        """first[c] + Occ(c, i): where an interval's bound i goes when the phrase is extended by c."""
        return np.searchsorted(self._ranked, ids * self.size + places)

    def extensions(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, ...]:
        """All extensions of intervals by one id: (interval, id, count, smaller), smaller being how many rows of the
        interval have a smaller id. Extensions by 0 are left out."""
        sizes = high - low
        keys = np.repeat(np.arange(len(low)), sizes)
        rows = np.arange(len(keys)) - np.repeat(np.cumsum(sizes) - sizes - low, sizes)
        many = int(self.bwt.max()) + 1
        keys *= many
        keys += self.bwt[rows]
        del rows
        keys, counts = np.unique(keys, return_counts=True)
        interval, ids = keys // many, keys % many
        through = np.cumsum(counts) - counts
        smaller = through - through[np.searchsorted(interval, interval)]
        real = ids > 0
        return interval[real], ids[real], counts[real], smaller[real]


class BothWays:
    """Phrases as pairs of intervals, in the index of a sequence and in that of its reverse, extended on either side."""

    def __init__(self, sequence: np.ndarray, depth: int):
        # the reverse ends with 0 as well: the 0 at the end of the sequence goes round
        self.ahead, self.back = FMIndex(sequence, depth), FMIndex(np.concatenate([sequence[-2::-1], sequence[-1:]]), depth)
        ids = np.arange(1, int(sequence.max()) + 1)
        self.words = ids[:, None]
        self.counts = self.ahead.first[ids + 1] - self.ahead.first[ids]
        self.low, self.low_back = self.ahead.first[ids], self.back.first[ids]

    def _extended(self, index: FMIndex, low: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, ...]:
        which, ids, counts, smaller = index.extensions(low, low + self.counts)
        return which, ids, counts, index.before(ids, low[which]), other[which] + smaller

    def left(self) -> None:
        which, ids, self.counts, self.low, self.low_back = self._extended(self.ahead, self.low, self.low_back)
        self.words = np.column_stack([ids, self.words[which]])

    def right(self) -> None:
        which, ids, self.counts, self.low_back, self.low = self._extended(self.back, self.low_back, self.low)
        self.words = np.column_stack([self.words[which], ids])


def _pairs_of(sequence: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of neighbouring words and their counts, by extending every word to the left."""
    index = FMIndex(sequence, 1)
    ids = np.arange(1, int(sequence.max()) + 1)
    low, high = index.first[ids], index.first[ids + 1]
    which, left, counts, _ = index.extensions(low, high)
    return np.column_stack([left, ids[which]]), counts


def _sequence(shard: pd.DataFrame) -> np.ndarray:
    return np.frombuffer(zlib.decompress(shard["ids"].iloc[0]), np.int32)


def _numbers(sequence: np.ndarray, known: pd.DataFrame) -> np.ndarray:
    """The global id of every local one, -1 for words that are not frequent and for breaks."""
    number = np.full(int(max(sequence.max(), known["local"].max())) + 1, -1, np.int64)
    number[known["local"].to_numpy()] = known["word_id"].to_numpy()
    return number


def _word_pairs(key, shard: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
    """Pairs of frequent words in a shard by local ids a and b and global ids w1 and w2, and their counts."""
    columns = ["shard", "a", "b", "w1", "w2", "n"]
    if not len(shard) or not len(known):
        return pd.DataFrame([], columns=columns)
    sequence = _sequence(shard)
    number = _numbers(sequence, known)
    # other words part pieces; ids are dealt anew without gaps
    local = np.flatnonzero(number >= 0)
    dense = np.zeros(len(number), np.int64)
    dense[local] = np.arange(1, len(local) + 1)
    dense = dense[sequence].astype(np.int32)
    del sequence
    pairs, counts = _pairs_of(dense)
    pairs = local[pairs - 1]
    return pd.DataFrame({"shard": key[0], "a": pairs[:, 0], "b": pairs[:, 1], "w1": number[pairs[:, 0]], "w2": number[pairs[:, 1]], "n": counts}, columns=columns)


def _summed_pairs(key, shard: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
    return _word_pairs(key, shard, known)[["w1", "w2", "n"]]


class _Pairs:
    """Pairs of numbers, to be asked for many at once."""

    def __init__(self, w1: np.ndarray, w2: np.ndarray):
        self.words = np.unique(np.concatenate([w1, w2]))
        self.keys = np.unique(np.searchsorted(self.words, w1) * len(self.words) + np.searchsorted(self.words, w2))

    def place(self, w1: np.ndarray, w2: np.ndarray) -> np.ndarray:
        """Where pairs stand in order, -1 for others."""
        if not len(self.keys):
            return np.full(len(w1), -1)
        places = [np.minimum(np.searchsorted(self.words, w), len(self.words) - 1) for w in (w1, w2)]
        keys = places[0] * len(self.words) + places[1]
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where((self.keys[at] == keys) & (self.words[places[0]] == w1) & (self.words[places[1]] == w2), at, -1)


class _Phrases:
    """Frequent phrases of one size, to be asked for many at once: each word more is a pair with the place of those before."""

    def __init__(self, *words: np.ndarray):
        self.size, self.steps = len(words), []
        before = words[0]
        for word in words[1:]:
            self.steps.append(_Pairs(before, word))
            before = self.steps[-1].place(before, word)

    def starts(self, ids: np.ndarray, together: int = 1 << 18) -> np.ndarray:
        """Whether such a phrase begins at each place but the last few."""
        many = max(0, len(ids) - self.size + 1)
        found = [np.zeros(0, bool)]
        for k in range(0, many, together):
            part = ids[k : min(k + together, many) + self.size - 1]
            before = part[: len(part) - self.size + 1]
            for nth, step in enumerate(self.steps, 1):
                before = step.place(before, part[nth : nth + len(before)])
            found.append(before >= 0)
        return np.concatenate(found)


def _longer(ids: np.ndarray, frequent: _Phrases) -> np.ndarray:
    """Places where a phrase begins that is one word longer than the frequent ones and has two of them as its parts."""
    starts = frequent.starts(ids)
    return np.flatnonzero(starts[:-1] & starts[1:])


def _buckets(ids: np.ndarray, places: np.ndarray, size: int, many: int) -> np.ndarray:
    """The bucket, of a power of two, of the phrase of so many words at each place."""
    hashes = np.zeros(len(places), np.uint64)
    for k in range(size):
        hashes = mix(hashes + ids[places + k].astype(np.uint64))
    return (hashes & np.uint64(many - 1)).astype(np.int64)


def _bucket_counts(ids: np.ndarray, frequent: _Phrases, many: int) -> pd.DataFrame:
    """Phrases of a shard, one word longer than the frequent ones, in each bucket: a row for each block, with the places
    of its buckets that hold some and their counts."""
    buckets, counts = np.unique(_buckets(ids, _longer(ids, frequent), frequent.size + 1, many), return_counts=True)
    blocks, first = np.unique(buckets // BLOCK, return_index=True)
    at, n = (buckets % BLOCK).astype(np.int32), counts.astype(np.int32)
    parts = zip(blocks.tolist(), np.split(at, first[1:]), np.split(n, first[1:]))
    return pd.DataFrame(list(parts), columns=["block", "at", "n"], dtype=object)


def _full_buckets(counts: DataFrame, many: int, least: int) -> np.ndarray:
    """A bit for each bucket: whether all shards together have as many phrases in it as a candidate needs."""

    def summed(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(BLOCK, np.int64)
        for at, n in zip(parts["at"], parts["n"]):
            total[at] += n
        return pd.DataFrame({"block": [key[0]], "bits": [np.packbits(total >= least, bitorder="little").tobytes()]})

    bits = np.zeros((many // BLOCK, BLOCK // 8), np.uint8)
    for row in counts.groupBy("block").applyInPandas(summed, "block long, bits binary").toLocalIterator():
        bits[row["block"]] = np.frombuffer(row["bits"], np.uint8)
    return bits.reshape(-1)


def _chained_phrases(shard: int, sequence: np.ndarray, number: np.ndarray, frequent: _Phrases, longest: int, full: np.ndarray | None = None) -> pd.DataFrame:
    """Phrases of a shard, longer than the frequent ones and of up to `longest` words, in which all parts of their size are
    frequent, and all parts of one word more in full buckets if those are given: by local and by global ids, with their
    counts."""
    columns = ["shard", *LOCAL[:longest], *GLOBAL[:longest], "n"]
    ids = number[sequence]
    places = _longer(ids, frequent)
    if full is not None:
        buckets = _buckets(ids, places, frequent.size + 1, 8 * len(full))
        places = places[(full[buckets >> 3] >> (buckets & 7).astype(np.uint8)) & 1 > 0]
    # each chain with its last phrase to the end
    chained = np.concatenate([[True], np.diff(places) > 1])[: len(places)]
    first = places[chained]
    sizes = places[np.concatenate([chained[1:], [True]])[: len(places)]] - first + frequent.size + 1
    ends = np.cumsum(sizes)
    places = np.arange(int(sizes.sum())) + np.repeat(first - (ends - sizes), sizes)
    words, dense = np.unique(sequence[places], return_inverse=True)
    # a break behind every chain
    reduced = np.zeros(len(dense) + len(sizes), np.int64)
    reduced[np.arange(len(dense)) + np.repeat(np.arange(len(sizes)), sizes)] = dense + 1
    found = []
    index = BothWays(reduced, longest) if len(reduced) else None
    for length in range(2, longest + 1):
        if index is None or not len(index.counts):
            break
        index.left() if length % 2 else index.right()
        if length > frequent.size:
            rows = np.full((len(index.words), 2 * longest + 2), -1, np.int64)
            rows[:, 0], rows[:, -1] = shard, index.counts
            rows[:, 1 : length + 1] = words[index.words - 1]
            rows[:, longest + 1 : longest + 1 + length] = number[rows[:, 1 : length + 1]]
            found.append(rows)
    return pd.DataFrame(np.concatenate(found) if found else np.empty((0, len(columns)), np.int64), columns=columns)


def _extended(meet, known: DataFrame, own: DataFrame, frequent: DataFrame, size: int, longest: int, n_words: int, least: int, held: list[DataFrame]) -> DataFrame:
    """What _chained_phrases() finds in all shards by the frequent phrases of a size, n_words being those of the table. own:
    those of each shard, frequent or not, by local and by global ids; they are only read when the frequent ones are too
    many for every task, and those that are frequent are then saved and added to held."""
    schema = ", ".join(f"{c} long" for c in ["shard", *LOCAL[:longest], *GLOBAL[:longest], "n"])
    here, names = LOCAL[:size], GLOBAL[:size]
    if frequent.count() <= FEW:
        few = frequent.select(*names).toPandas()
        shared = frequent.sparkSession.sparkContext.broadcast([few[w].to_numpy() for w in names])
        dealt = known

        def prepared(shard: pd.DataFrame, known: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, _Phrases]:
            sequence = _sequence(shard) if len(shard) and len(known) else np.zeros(1, np.int64)
            number = _numbers(sequence, known) if len(known) else np.full(1, -1, np.int64)
            return sequence, number, _Phrases(*shared.value)

    else:
        dealt = saved(own.join(frequent.select(*names), names).select("shard", *here, *names), "chains")
        held.append(dealt)

        def prepared(shard: pd.DataFrame, chains: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, _Phrases]:
            """The same for a shard with its own frequent phrases."""
            sequence = _sequence(shard) if len(shard) else np.zeros(1, np.int64)
            number = np.full(int(max([sequence.max(), *(chains[c].max() for c in here if len(chains))])) + 1, -1, np.int64)
            for c, w in zip(here, names):
                number[chains[c].to_numpy()] = chains[w].to_numpy()
            return sequence, number, _Phrases(*(chains[w].to_numpy() for w in names))

    many = LEAST_BUCKETS
    while many < MOST_BUCKETS and many * LOAD < n_words:
        many *= 2

    def by_buckets(key, shard: pd.DataFrame, other: pd.DataFrame) -> pd.DataFrame:
        sequence, number, phrases = prepared(shard, other)
        return _bucket_counts(number[sequence], phrases, many)

    counts = meet(dealt).applyInPandas(by_buckets, "block long, at array<int>, n array<int>")
    full = frequent.sparkSession.sparkContext.broadcast(_full_buckets(counts, many, least))

    def by_words(key, shard: pd.DataFrame, other: pd.DataFrame) -> pd.DataFrame:
        return _chained_phrases(key[0], *prepared(shard, other), longest, full.value)

    return meet(dealt).applyInPandas(by_words, schema)


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's best phrases."""
    shards = saved(sharded(docs, text, lang), "shards")
    totals = saved(shards.groupBy("lang").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda s, c: s + c)).alias("n")), "totals")
    own = shards.select("shard", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("place", "of"))
    own = own.select("shard", "lang", (F.col("place") + 1).cast("long").alias("local"), F.col("of.words").alias("word"), F.col("of.counts").alias("n"))
    # one shuffle tells every shard which of its words are frequent; a word goes by its first place in the shards
    alike = Window.partitionBy("lang", "word")
    place = F.shiftleft(F.col("shard"), LOCAL_BITS).bitwiseOR(F.col("local"))
    counted = own.select("*", place.alias("place"), F.sum("n").over(alike).alias("a"), F.min(place).over(alike).alias("word_id")).filter(F.col("a") >= least)
    first = F.col("place") == F.col("word_id")
    counted = saved(counted.select("shard", "local", "word_id", F.when(first, F.struct("lang", "word", F.col("a").alias("n"))).alias("of")), "words")
    words = counted.filter("of is not null").select("word_id", "of.*")
    known = counted.select("shard", "local", "word_id")
    sequences = shards.select(F.col("shard").alias("_shard"), "ids")
    meet = lambda other: sequences.groupBy("_shard").cogroup(other.groupBy("shard"))
    pairs = meet(known).applyInPandas(_summed_pairs, "w1 long, w2 long, n long")
    frequent = saved(pairs.groupBy("w1", "w2").agg(F.sum("n").alias("n")).filter(F.col("n") >= least), "frequent")
    own_pairs = meet(known).applyInPandas(_word_pairs, "shard long, a long, b long, w1 long, w2 long, n long")
    n_words, held = totals.agg(F.sum("n")).first()[0] or 0, [shards]
    own_triples = _extended(meet, known, own_pairs, frequent, 2, 3, n_words, least, held)
    triples = saved(own_triples.groupBy(*GLOBAL[:3]).agg(F.sum("n").alias("a")).filter(F.col("a") >= least), "triples")
    longer = _extended(meet, known, own_triples, triples, 3, DEPTH, n_words, least, held).groupBy(*GLOBAL).agg(F.sum("n").alias("a")).filter(F.col("a") >= least)
    longer = longer.unionByName(triples.withColumns({"w4": F.lit(-1).cast("long"), "w5": F.lit(-1).cast("long")}))
    long_ids = F.filter(F.array(*GLOBAL), lambda w: w >= 0)
    candidates = frequent.select(F.array("w1", "w2").alias("ids"), F.col("n").alias("a")).unionByName(longer.select(long_ids.alias("ids"), "a"))
    candidates = saved(candidates, "candidates")
    released(*held)

    # what is as frequent with one word more
    part = lambda first, size: F.slice("ids", first, size)
    grown = candidates.filter(F.size("ids") > 2).select(F.explode(F.array(part(1, F.size("ids") - 1), part(2, F.size("ids") - 1))).alias("ids"), "a")
    grown = grown.groupBy("ids").agg(F.max("a").alias("longer"))
    stay = candidates.join(grown, "ids", "left").filter(F.coalesce(100 * F.col("longer") < 100 * F.col("a"), F.lit(True))).select("ids", "a")

    # counts of both parts at every cut
    counts = candidates.unionByName(words.select(F.array("word_id").alias("ids"), F.col("n").alias("a")))
    cuts = stay.select("ids", "a", F.explode(F.sequence(F.lit(1), F.size("ids") - 1)).alias("k"))
    cuts = cuts.withColumns({"first": part(1, F.col("k")), "rest": part(F.col("k") + 1, F.size("ids") - F.col("k"))})
    cuts = cuts.join(counts.select(F.col("ids").alias("first"), F.col("a").alias("l")), "first")
    cuts = cuts.join(counts.select(F.col("ids").alias("rest"), F.col("a").alias("r")), "rest")
    heads = words.select(F.col("word_id").alias("head"), "lang")
    cuts = cuts.join(heads, F.col("ids")[0] == F.col("head")).join(totals, "lang")
    cuts = cuts.select("lang", "ids", "a", "n", "k", "l", "r", *[F.col(c).cast("decimal(38,0)").alias(f"{c}_") for c in "anlr"])
    # exact: products of counts may pass 64 bits, the quotient stays below 1000 * n
    best = cuts.withColumn("score", F.expr("(1000 * a_ * n_) div (l_ * r_)")).groupBy("lang", "ids", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))

    spelled = best.select("ids", F.posexplode("ids").alias("place", "word_id")).join(words.select("word_id", F.col("word").cast("string").alias("word")), "word_id")
    spelled = spelled.groupBy("ids").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    first = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return (
        best.join(spelled, "ids").select("lang", "phrase", "a", "best.l", "best.r", "n", "best.score")
        .withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= top)
        .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
    )
