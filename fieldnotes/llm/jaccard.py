"""N-gram Jaccard join: size-aware, light sets by subsets and heavy sets by inverted lists.

A text's set holds its distinct five-word shingles as 64-bit hashes. Equal sets are one class from the start.
For a similarity t two sets can only be linked if the smaller has t of the larger's size.

* Light sets, up to a boundary of a few shingles, list all their subsets of fixed size: two linked sets of sizes
  a <= b share at least k = ceil(t b) shingles, and so a subset of k.
* Heavy sets go to inverted lists, with the first n - ceil(t n) + 1 shingles in one order that all sets share:
  linked sets share one of those. The order goes by frequency, rare shingles first, so that lists stay short.
  A list keeps each member's place p in that order. Linked sets of sizes a and b have o = ceil(t (a + b) / (1 + t))
  shingles in common, so the first one they share leaves room for o in both: p <= a - o and p <= b - o. Members
  that no partner in their list gives that room drop out.
* The boundary is where the subsets of the light and the lists of the heavy cost least together.

Members of a list are not paired off. In a round each class is held against a few members of its lists, the ones
it shares most lists with among those drawn for that round, the links found are closed into components, and lists
whose members have all met drop out. Rounds end when the pairs of members that are still apart are few for the rows
of the lists, or when a round joins few of the classes still open. Those pairs are then compared, so that no link
between components is lost, each in the first list that it shares: each set carries a bitmap of its shingles' parities, whose difference is no larger than
that of the sets, and pairs with too large a difference are ruled out before their sets are read. Large sets have a
second bitmap that grows with them, as differences of many shingles fill the first; it is looked at for the pairs that
the first leaves open.

Null and empty texts have empty sets and link with nothing. Rows keep their own line in the result, repeated ids
included; a null id takes part, but never names a component. Clashing columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b
from itertools import combinations
from math import ceil, comb

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldnotes.llm.base import SIMILAR, components, few_texts, measured_broadcasts, mix, released, saved, shingle_hashes, slices

#: Largest size that may count as light; documents that make a shingle frequent, and how many such are put last;
#: shingles that are counted together; lines of lists that a task hands over together.
LIGHT, FREQUENT, LAST, TOGETHER, WRITTEN = 10, 24, 131_072, 1_000_000, 100_000
#: All pairs that are still apart are compared when a round finds less than a link for so many open classes, or when
#: there are at most so many for a row of the lists.
DIRECT, AFFORDABLE = 8, 16
#: Lists before its own that a line knows when all pairs are compared, so that a pair is not made once for each list.
BEFORE = 8
#: Longs in the bitmap of a set; the second one has at least so many places for a shingle.
BITMAP, PLACES = 8, 2
#: Members that are drawn from a list in a round, and candidates that a class is held against.
DRAWN = 4
#: Ids that may go to every task, 16 bytes each; more than that are joined by a shuffle.
FEW = 200_000


def _frequent(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the most frequent shingles, and their counts. Tasks send what they have seen in two documents
    or more."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[np.ndarray] = []
        size = 0
        for batch in batches:
            for hashes in shingle_hashes(batch["text"]):
                held.append(np.unique(hashes))
                size += len(held[-1])
                if size >= TOGETHER:
                    yield repeated(held)
                    held, size = [], 0
        if held:
            yield repeated(held)

    def repeated(held: list[np.ndarray]) -> pd.DataFrame:
        values, n = np.unique(np.concatenate(held), return_counts=True)
        return pd.DataFrame({"value": values[n > 1].view(np.int64), "n": n[n > 1]})

    rows = texts.mapInPandas(count, "value long, n long").groupBy("value").agg(F.sum("n").alias("n"))
    top = rows.filter(F.col("n") >= FREQUENT).orderBy(F.desc("n"), "value").limit(LAST).toPandas()
    values = top["value"].to_numpy(dtype=np.int64).view(np.uint64)
    by_value = np.argsort(values)
    return values[by_value], top["n"].to_numpy(dtype=np.int64)[by_value]


def _class_of(hashes: np.ndarray) -> int:
    """One number for a set: 63 bits of BLAKE2 over its sorted hashes."""
    return int.from_bytes(blake2b(hashes.tobytes(), digest_size=8).digest(), "little") >> 1


def _sets(rows: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, class, small, bits, fine) and the key if rows have one, small: the hashes of sets that may be
    light, fine: the second bitmap of large sets."""
    own_columns = [c for c in rows.columns if c != "text"]

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in (part for whole in batches for part in slices(whole)):
            table = []
            for hashes in shingle_hashes(batch["text"]):
                own = np.unique(hashes)
                table.append((len(own), _class_of(own) if len(own) else None, own.view(np.int64) if 0 < len(own) <= LIGHT else None, _bitmap(own), _fine(own)))
            more = pd.DataFrame(table, columns=["n_shingles", "class", "small", "bits", "fine"], dtype=object)
            # not by way of floats, which the numbers of a batch with an empty text would else become
            more = more.assign(n_shingles=more["n_shingles"].astype("int64"), **{"class": pd.array(more["class"].to_numpy(object), dtype="Int64")})
            yield pd.concat([batch[own_columns].reset_index(drop=True), more], axis=1)

    # ids go as text, since pandas makes floats of long numbers where some are null
    kinds = "".join(f"{c} string, " for c in own_columns)
    built = rows.withColumn("doc_id", F.col("doc_id").cast("string")).mapInPandas(build, f"{kinds}n_shingles long, class long, small array<long>, bits array<long>, fine array<long>")
    return built.withColumn("doc_id", F.col("doc_id").cast(rows.schema["doc_id"].dataType))


def _lists(texts: DataFrame, frequent: tuple[np.ndarray, np.ndarray], least: int) -> DataFrame:
    """(token, class, n, p): the first shingles of every set in the shared order, and their places in it."""
    last, counts = frequent

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        done: set[int] = set()  # classes that this task has listed; copies need no second line
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for hashes in shingle_hashes(batch["text"]):
                own = np.unique(hashes)
                n, which = len(own), _class_of(own)
                if not n or which in done:
                    continue
                if len(done) >= 1_000_000:
                    done.clear()
                done.add(which)
                at = np.searchsorted(last, own)
                at = np.minimum(at, len(last) - 1)
                late = np.where(last[at] == own, counts[at], 0) if len(last) else np.zeros(n, np.int64)
                ordered = own[np.lexsort((mix(own), late))]
                held.append((ordered[: n - ceil(least * n / 100) + 1].view(np.int64), which, n))
                size += len(held[-1][0])
                if size >= WRITTEN:
                    yield listed(held)
                    held, size = [], 0
        if held:
            yield listed(held)

    def listed(held: list[tuple]) -> pd.DataFrame:
        sizes = [len(h[0]) for h in held]
        return pd.DataFrame({"token": np.concatenate([h[0] for h in held]), "class": np.repeat([h[1] for h in held], sizes), "n": np.repeat([h[2] for h in held], sizes), "p": np.concatenate([np.arange(k) for k in sizes])})

    return texts.mapInPandas(build, "token long, class long, n long, p long")


def _subset_sizes(n: int, boundary: int, least: int) -> set[int]:
    return {ceil(least * b / 100) for b in range(n, min(boundary, 100 * n // least) + 1)}


def _subsets(sets: DataFrame, boundary: int, least: int) -> DataFrame:
    """(token, class, n, p): one token for each fixed-size subset of every light set; p is 0, subsets have no places."""

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for own, which, n in zip(batch["small"], batch["class"], batch["n"]):
                for k in _subset_sizes(n, boundary, least):
                    for part in combinations(sorted(int(x) for x in own), k):
                        key = blake2b(np.array([k, *part], np.int64).tobytes(), digest_size=8).digest()
                        rows.append((int.from_bytes(key, "little", signed=True), which, n, 0))
            yield pd.DataFrame(rows, columns=["token", "class", "n", "p"])

    return sets.mapInPandas(build, "token long, class long, n long, p long")


def _common(one: str | Column, two: str | Column, least: int) -> Column:
    """Shingles that linked sets of those sizes have in common."""
    return F.ceil(least * (F.col(one) if isinstance(one, str) else one) / (100 + least) + least * (F.col(two) if isinstance(two, str) else two) / (100 + least) - 1e-6)


def _shared(lists: DataFrame, least: int) -> DataFrame:
    """The lists with at least two members, each member once, without members that none of the list's sizes gives
    room; m is the length of the list before. One shuffle serves the count and the join, as both read all columns: the
    largest room counts too, which no list of members without room for the smallest has."""
    # the join would add these filters to one side only, and then shuffle the same rows a second time
    dealt = lists.filter("token is not null and n is not null and p is not null").repartition("token")
    facts = dealt.groupBy("token").agg((F.min("class") < F.max("class")).alias("several"), F.min("n").alias("smallest"), F.max(F.col("n") - F.col("p")).alias("room"), F.count("*").alias("m"))
    several = facts.filter(F.col("several") & (F.col("room") >= _common("smallest", "smallest", least))).select("token", "smallest", "m")
    partner = F.greatest("smallest", F.ceil(least * F.col("n") / 100 - 1e-6))
    return dealt.join(several, "token").filter(F.col("p") <= F.col("n") - _common("n", partner, least)).dropDuplicates(["token", "class"]).drop("smallest")


def _boundary(lists: DataFrame, classes: DataFrame, least: int) -> int:
    """The size up to which subsets cost less than lists: pairs of members on lists against subsets to write."""
    heavy = {r["n"]: r["cost"] for r in lists.filter(F.col("n") <= LIGHT).groupBy("n").agg(F.sum("m").alias("cost")).collect()}
    many = {r["n"]: r["count"] for r in classes.filter(F.col("n") <= LIGHT).groupBy("n").count().collect()}

    def cost(boundary: int) -> float:
        light = sum(many.get(n, 0) * sum(comb(n, k) for k in _subset_sizes(n, boundary, least)) for n in range(1, boundary + 1))
        return light + sum(heavy.get(n, 0) for n in range(boundary + 1, LIGHT + 1))

    return min(range(LIGHT + 1), key=cost)


def _verified(pairs: DataFrame, sets: DataFrame, least: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough, counted exactly."""
    one = sets.select(F.col("class").alias("a"), F.col("hashes").alias("left"))
    two = sets.select(F.col("class").alias("b"), F.col("hashes").alias("right"))
    both = F.size(F.array_intersect("left", "right"))
    return (
        pairs.select("a", "b").join(one, "a").join(two, "b")
        .filter(both * 100 >= least * (F.size("left") + F.size("right") - both)).select("a", "b")
    )


def link(docs: DataFrame, least: int = SIMILAR, key: Column | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row; component_id is the smallest doc_id that links reach. With a
    key also (key, label): rows with the same label are linked, whatever their ids; sets without shingles have none."""
    with few_texts(docs.sparkSession), measured_broadcasts(docs.sparkSession):  # all that Python does is saved within
        return _link(docs, least, key)


def _link(docs: DataFrame, least: int, key: Column | None) -> DataFrame:
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    sets = saved(_sets(rows if key is None else docs.select("doc_id", F.col("text").cast("string").alias("text"), key.alias("key"))), "sizes")
    classes = saved(sets.filter("class is not null").groupBy("class").agg(F.min("doc_id").alias("first"), F.max("n_shingles").alias("n"), F.min("bits").alias("bits"), F.min("fine").alias("fine")), "classes")
    lists = saved(_shared(_lists(rows.select("text"), _frequent(rows.select("text")), least), least), "lists")
    boundary = _boundary(lists, classes, least)
    if boundary:
        small = sets.filter(F.col("n_shingles").between(1, boundary)).select("class", F.col("n_shingles").alias("n"), "small").dropDuplicates(["class"])
        heavy = lists.filter(100 * F.col("n") >= least * (boundary + 1)).drop("m")
        lists = saved(_shared(heavy.unionByName(_subsets(small, boundary, least)), least), "lists")
    labels, n_rows = classes.select("class", F.col("class").alias("label")), lists.count()
    links, turn, whole = None, 0, False
    left = lists.select("token", "class", "n", "p", F.col("class").alias("label"))  # each has two classes or more
    while n_rows:
        drawn = saved(_all_apart(left, classes, least) if whole else _near(_drawn(left, turn, least), classes, least), "drawn")
        pairs = saved(_nearer(drawn, classes, least), "pairs")
        released(drawn)
        full = _full(rows, pairs, classes)
        new = saved(_verified(pairs, full, least), "found")
        released(pairs, full)
        links = new if links is None else links.unionByName(new)
        n_new = new.count()
        if n_new:
            labels = _relabel(classes, links)
        if whole:
            break
        before, left = left, saved(_apart(left.drop("label"), labels), "apart")
        if turn:  # the first is the table of lists
            released(before)
        pairs_apart, n_open = _still_apart(left)
        if not pairs_apart:
            break
        whole = pairs_apart <= AFFORDABLE * n_rows or n_new * DIRECT < n_open
        turn += 1
    smallest = labels.join(classes, "class").groupBy("label").agg(F.min("first").alias("component"))
    names = saved(labels.join(smallest, "label").select("class", "label", "component"), "names")
    # a class may hold a third of all rows; its one name goes to as many rows, dealt over salts
    salts = 32
    dealt = sets.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int"))
    # Spark sizes the names as if they weren't repeated, and would make the driver build a table of all of them to broadcast
    spread = names.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).hint("merge")
    own = [] if key is None else ["key", "label"]
    return dealt.join(spread, ["class", "salt"], "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"), *own)


def _full(rows: DataFrame, pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """(class, hashes) of the classes in pairs, from the text of one document of each; for classes without an id, from
    the rows without one."""
    named = pairs.select(F.col("a").alias("class")).union(pairs.select("b")).distinct()
    members = saved(named.join(classes, "class").select(F.col("first").alias("doc_id"), "class"), "members")
    few = members.count() <= FEW
    nameless = members.filter("doc_id is null").select("class")
    unnamed = rows.filter("doc_id is null")
    rows = rows.join(F.broadcast(members) if few else members, "doc_id")

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in (part for whole in batches for part in slices(whole)):
            own = [np.unique(h) for h in shingle_hashes(batch["text"])]
            same = [len(o) > 0 and _class_of(o) == c for o, c in zip(own, batch["class"])]
            if any(same):  # an empty frame has no lists to tell its type by
                yield pd.DataFrame({"class": batch["class"][same].to_numpy(), "hashes": [o.view(np.int64) for o, s in zip(own, same) if s]})

    def build_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in (part for whole in batches for part in slices(whole)):
            own = [o for o in map(np.unique, shingle_hashes(batch["text"])) if len(o)]
            if own:
                yield pd.DataFrame({"class": [_class_of(o) for o in own], "hashes": [o.view(np.int64) for o in own]})

    found = rows.mapInPandas(build, "class long, hashes array<long>")
    if nameless.limit(1).count():
        others = unnamed.mapInPandas(build_all, "class long, hashes array<long>")
        found = found.unionByName(others.join(F.broadcast(nameless) if few else nameless, "class", "left_semi"))
    # rows that repeat an id may bring a class twice
    full = saved(found.dropDuplicates(["class"]), "full")
    released(members)
    return full


def _bitmap(hashes: np.ndarray, longs: int = BITMAP) -> np.ndarray:
    """For each of 64 * longs places whether an odd number of hashes fall there."""
    places = (mix(hashes) % np.uint64(64 * longs)).astype(np.int64)
    return np.packbits((np.bincount(places, minlength=64 * longs) & 1).astype(np.uint8)).view(np.int64)


def _fine(hashes: np.ndarray) -> np.ndarray | None:
    """The bitmap of BITMAP longs, doubled until there are PLACES places for each hash; none if it is no larger."""
    longs = BITMAP
    while 64 * longs < PLACES * len(hashes):
        longs *= 2
    return _bitmap(hashes, longs) if longs > BITMAP else None


def _apart(lists: DataFrame, labels: DataFrame) -> DataFrame:
    """The lists whose members have more than one label, with labels."""
    now = lists.join(labels, "class")
    open_lists = now.groupBy("token").agg((F.min("label") < F.max("label")).alias("open")).filter("open").select("token")
    return now.join(open_lists, "token")


def _still_apart(lists: DataFrame) -> tuple[int, int]:
    """Pairs of members with different labels over all lists, and the classes in them."""
    parts = lists.groupBy("token", "label").agg(F.count("*").cast("double").alias("k"))
    pairs = parts.groupBy("token").agg(((F.sum("k") * F.sum("k") - F.sum(F.col("k") * F.col("k"))) / 2).alias("pairs")).agg(F.sum("pairs")).first()[0]
    return int(pairs or 0), lists.select("class").distinct().count()


def _drawn(lists: DataFrame, turn: int, least: int) -> DataFrame:
    """For every class some members of its lists with another label: of those drawn this turn, a few for each list,
    the ones that share most lists with it."""
    draw = [F.min_by(F.struct("class", "n", "p", "label"), F.xxhash64("class", F.lit(turn * DRAWN + k))) for k in range(DRAWN)]
    drawn = lists.groupBy("token").agg(F.array_distinct(F.array(*draw)).alias("drawn")).select("token", F.explode("drawn").alias("other"))
    drawn = drawn.select("token", F.col("other.class").alias("b"), F.col("other.n").alias("n_b"), F.col("other.p").alias("p_b"), F.col("other.label").alias("label_b"))
    own = lists.select("token", F.col("class").alias("a"), F.col("n").alias("n_a"), F.col("p").alias("p_a"), F.col("label").alias("label_a"))
    best = _likely(own.join(drawn, "token").filter("label_a != label_b"), least).groupBy("a").agg(F.slice(F.sort_array(F.collect_list(F.struct("shared", "b")), asc=False), 1, DRAWN).alias("best"))
    pairs = best.select("a", F.explode("best").alias("best")).select("a", F.col("best.b").alias("b"))
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _all_apart(lists: DataFrame, classes: DataFrame, least: int) -> DataFrame:
    """All pairs of members of a list with different labels, fitting sizes and bitmaps near enough."""
    return _met(lists, classes, least).distinct()


def _met(lists: DataFrame, classes: DataFrame, least: int) -> DataFrame:
    """(a, b) of _all_apart(), from the first list that they share and from a later one only where none of the few lists
    before it in both classes is shared. No line before that of the first shared list is in the other class, so a pair
    that is linked always comes."""
    before = Window.partitionBy("class").orderBy("p", "token").rowsBetween(-BEFORE, -1)
    lists = lists.withColumn("before", F.collect_list("token").over(before)).join(classes.select("class", "bits"), "class")
    one = lists.select("token", F.col("class").alias("a"), F.col("n").alias("n_a"), F.col("p").alias("p_a"), F.col("label").alias("label_a"), F.col("bits").alias("bits_a"), F.col("before").alias("before_a"))
    two = lists.select(F.col("token").alias("other"), F.col("class").alias("b"), F.col("n").alias("n_b"), F.col("p").alias("p_b"), F.col("label").alias("label_b"), F.col("bits").alias("bits_b"), F.col("before").alias("before_b"))
    apart = (F.col("a") < F.col("b")) & (F.col("label_a") != F.col("label_b"))
    new = ~F.arrays_overlap("before_a", "before_b")
    return one.join(two, (F.col("token") == F.col("other")) & apart & _fitting(least) & _bits_near(least) & new).select("a", "b")


def _bits_near(least: int) -> Column:
    """Whether bitmaps leave it open that sets are similar: each place that differs takes a shingle of one set only."""
    differ = sum((F.bit_count(F.get("bits_a", F.lit(k)).bitwiseXOR(F.get("bits_b", F.lit(k)))) for k in range(BITMAP)), F.lit(0))
    return differ <= F.col("n_a") + F.col("n_b") - 2 * _common("n_a", "n_b", least)


def _near(pairs: DataFrame, classes: DataFrame, least: int) -> DataFrame:
    """The pairs that bitmaps leave open; only their sets have to be read."""
    one = classes.select(F.col("class").alias("a"), F.col("n").alias("n_a"), F.col("bits").alias("bits_a"))
    two = classes.select(F.col("class").alias("b"), F.col("n").alias("n_b"), F.col("bits").alias("bits_b"))
    return pairs.join(one, "a").join(two, "b").filter(_bits_near(least)).select("a", "b")


def _nearer(pairs: DataFrame, classes: DataFrame, least: int) -> DataFrame:
    """The pairs that the second bitmaps leave open. The halves of a bitmap, one on the other, are that of half the
    places; those of sets that may be linked differ by one doubling at most."""
    bits = F.coalesce("fine", "bits")
    one = classes.select(F.col("class").alias("a"), F.col("n").alias("n_a"), bits.alias("fine_a"))
    two = classes.select(F.col("class").alias("b"), F.col("n").alias("n_b"), bits.alias("fine_b"))
    longs = F.least(F.size("fine_a"), F.size("fine_b"))

    def halved(name: str) -> Column:
        halves = F.zip_with(F.slice(name, F.lit(1), longs), F.slice(name, longs + 1, longs), lambda x, y: x.bitwiseXOR(y))
        return F.when(F.size(name) == longs, F.col(name)).when(F.size(name) == 2 * longs, halves)

    differ = F.aggregate(F.zip_with(halved("fine_a"), halved("fine_b"), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, k: n + k)
    open_ = F.coalesce(differ <= F.col("n_a") + F.col("n_b") - 2 * _common("n_a", "n_b", least), F.lit(True))
    return pairs.join(one, "a").join(two, "b").filter(open_).select("a", "b")


def _fitting(least: int) -> Column:
    """Whether a pair can be linked by its sizes and by the places of the shingle that it shares."""
    fits = 100 * F.least("n_a", "n_b") >= least * F.greatest("n_a", "n_b")
    return fits & (F.least(F.col("n_a") - F.col("p_a"), F.col("n_b") - F.col("p_b")) >= _common("n_a", "n_b", least))


def _likely(met: DataFrame, least: int) -> DataFrame:
    """(a, b, shared) of the pairs that may be linked; shared is the number of lists that say so."""
    return met.filter(_fitting(least)).groupBy("a", "b").agg(F.count("*").alias("shared"))


def _relabel(classes: DataFrame, links: DataFrame) -> DataFrame:
    joined = components(links)
    return classes.select("class").join(joined, F.col("class") == F.col("id"), "left").select("class", F.coalesce("component", "class").alias("label"))
