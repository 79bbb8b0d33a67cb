"""Fill-in-the-middle transformation by an indexable skip list.

A text is a row of units: a run of ASCII letters or one other code point. A skip list holds them: the bottom lane has
a node for each unit, every express lane above one for STRIDE nodes of the lane below, and each node carries two
widths, the units and the code points that it spans. The cuts are ranks in units. A descent adds up unit widths, lane
by lane, without passing the rank, and the code points added beside them are the exact place of the cut.

The four numbers that decide about a text come from a digest of the seed and the id. Forms: `plain` (the text), `psm`
(<P>prefix<S>suffix<M>middle) and `spm` (<S>suffix<P>prefix<M>middle). Empty texts, texts that hold a marker and a
share of the others stay plain.

Null texts count as empty. A null id counts as the empty id, so that such rows get the same numbers; rows with the same
id and text come out alike, each for itself. A table without rows gives none. Columns of the table that clash with the
columns of the result are replaced. A text is handled in blocks of BLOCK code points, the lanes take 16 bytes a unit.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Nodes of a lane that a node of the next lane spans; code points that are split into units together.
STRIDE, BLOCK = 16, 1 << 20
#: Of 100 texts so many are transformed, and so many of these put the suffix first.
RATE, SUFFIX_FIRST = 90, 20
# The markers.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
RESULT = ("n", "form", "prefix_chars", "middle_chars", "output")


def unit_widths(text: str) -> np.ndarray:
    """Code points of each unit of a text, in order."""
    firsts = []
    inside = False  # does a run of letters reach into the block?
    for at in range(0, len(text), BLOCK):
        points = np.frombuffer(text[at : at + BLOCK].encode("utf-32-le", "surrogatepass"), "<u4")
        letter = ((points | np.uint32(32)) - np.uint32(97)) < 26
        goes_on = letter & np.concatenate([[inside], letter[:-1]])
        firsts.append(np.flatnonzero(~goes_on) + at)
        inside = bool(letter[-1])
    return np.diff(np.concatenate([*firsts, [len(text)]])) if firsts else np.empty(0, np.int64)


class SkipList:
    """Units by rank: lanes of (unit widths, code-point widths), the bottom lane first."""

    def __init__(self, widths: np.ndarray, stride: int = STRIDE):
        self.stride, self.units = stride, len(widths)
        self.lanes = [(np.ones(len(widths), np.int64), np.asarray(widths, np.int64))]
        while len(self.lanes[-1][0]) > stride:
            units, points = self.lanes[-1]
            promoted = np.arange(0, len(units), stride)
            self.lanes.append((np.add.reduceat(units, promoted), np.add.reduceat(points, promoted)))

    def points_before(self, rank: int) -> int:
        """Code points of the first `rank` units."""
        node = units = points = 0
        for unit_widths, point_widths in reversed(self.lanes):
            while node < len(unit_widths) and units + unit_widths[node] <= rank:
                units += int(unit_widths[node])
                points += int(point_widths[node])
                node += 1
            if units == rank:
                break
            node *= self.stride  # the same place, one lane down
        return points


def rearranged(text: str, h1: int, h2: int, h3: int, h4: int) -> tuple:
    """(units, form, code points of prefix and middle or None, output) of a text by its four numbers."""
    units = SkipList(unit_widths(text))
    n = units.units
    if not text or PREFIX in text or SUFFIX in text or MIDDLE in text or h3 % 100 >= RATE:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = units.points_before(a), units.points_before(b)
    head, middle, tail = text[:a], text[a:b], text[b:]
    if h4 % 100 < SUFFIX_FIRST:
        return n, "spm", a, b - a, f"{SUFFIX}{tail}{PREFIX}{head}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{head}{SUFFIX}{tail}{MIDDLE}{middle}"


def transform(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", seed: int = 1) -> DataFrame:
    """docs with n (units), form, prefix_chars, middle_chars (null if plain) and output instead of the text."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 256)

    @F.pandas_udf("n long, form string, prefix_chars long, middle_chars long, output string")
    def cut(texts: pd.Series, digests: pd.Series) -> pd.DataFrame:
        rows = [rearranged(t, *(int(d[k : k + 8], 16) for k in (0, 8, 16, 24))) for t, d in zip(texts, digests)]
        made = pd.DataFrame(rows, columns=RESULT)
        return made.astype({"prefix_chars": "Int64", "middle_chars": "Int64"})

    kept = [F.col(f"`{c}`") for c in docs.columns if c != text and c not in RESULT]
    done = docs.select(*kept, cut(F.coalesce(F.col(text), F.lit("")), digest).alias("_cut"))
    return done.select(*[F.col(f"`{c}`") for c in done.columns if c != "_cut"], "_cut.*")


def restored(output: Column, form: Column) -> Column:
    """The text that an output of a form was made of. Markers stand in no text that was rearranged, and none can come
    about where a piece and a marker meet, so the first of each kind is the one that was put in."""
    before = lambda whole, mark: F.substring_index(whole, mark, 1)
    after = lambda whole, mark: F.substring(whole, F.length(before(whole, mark)) + 4, F.length(whole))
    body = F.substring(output, F.lit(4), F.length(output))
    psm = F.concat(before(body, SUFFIX), after(body, MIDDLE), before(after(body, SUFFIX), MIDDLE))
    spm = F.concat(before(after(body, PREFIX), MIDDLE), after(body, MIDDLE), before(body, PREFIX))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)
