"""Yes/no answers written as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The words that mean yes and no.
TRUE_WORDS = ("true", "yes", "y", "t")
FALSE_WORDS = ("false", "no", "n", "f")
# The spellings that make a reader of delimited files produce booleans.
READER_WORDS = ("True", "TRUE", "true", "False", "FALSE", "false")


_LONGEST_WORD = max(map(len, TRUE_WORDS + FALSE_WORDS))
_FIRST_LETTERS = sorted({ord(case(word[0])) for word in TRUE_WORDS + FALSE_WORDS for case in (str.lower, str.upper)})


def word_bit(text: Column) -> Column:
    """A distinct bit for each yes/no word, so that ``bit_or`` collects the set of words."""
    words = F.array(*[F.lit(word) for word in TRUE_WORDS + FALSE_WORDS])
    could_be_word = (F.length(text) <= _LONGEST_WORD) & F.ascii(text).isin(_FIRST_LETTERS)
    place = F.when(could_be_word, F.array_position(words, F.lower(text)))
    return F.call_function("shiftleft", F.lit(1), F.nullif(place, F.lit(0)).cast("int"))


def is_true_word(text: Column) -> Column:
    return F.lower(text).isin(*TRUE_WORDS)
