"""Quality rules as a bitmask ledger, in DataFrame functions only.

Every text is measured once. Each rule is one test of the measurements and owns one bit; the ledger stores the bits of
the rules that failed beside the measurements. Policies are versioned sets of bits: a policy keeps a text when none of
its bits is set, so another policy, or a policy without one of its rules, is applied to the ledger without reading texts
again. `ablations` counts for each rule what it rejects, what it alone rejects and which rules fail beside it, by bitwise
aggregates over the ledger; what goes through the shuffle is at most one row for each task and set of failed rules.

Words are `[^\\x20\\x09-\\x0D]+`. Repeated 3-word windows are found inside a text's own row; nothing is exploded and
no text is shuffled, so rows of one source or copies of one text cost what others cost. A text and its windows have to
fit in a task (about 200 bytes a word).

Null texts count as empty and have no words. Null and repeated ids are rows like others. A table without rows has no
ledger rows, and its ablations count 0. Columns of the table that clash with the columns of the result are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What parts words, and the characters that count as symbols.
SPACES, SYMBOLS = " \t\n\x0b\f\r", "#*$%&|<>"
#: Words of a window.
WINDOW = 3

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_capitals", "n_dots_lines", "n_bullet_lines", "n_broken")


def _share(part: str, whole: str, more_than: int) -> Column:
    """More than so many hundredths; whole numbers only, so that nothing is rounded."""
    return 100 * F.col(part) > more_than * F.col(whole)


def rules() -> tuple[tuple[str, Column], ...]:
    """The rules, by bit from 0 up: name and the test under which a text fails. New rules come at the end, so that stored
    ledgers stay readable."""
    return (
        ("few_words", F.col("n_words") < 50),
        ("repeated_words", _share("n_repeat_words", "n_words", 50)),
        ("many_words", F.col("n_words") > 100_000),
        ("short_words", F.col("word_chars") < 2 * F.col("n_words")),
        ("long_words", F.col("word_chars") > 20 * F.col("n_words")),
        ("symbols", _share("n_symbols", "n_words", 10)),
        ("repeated_lines", _share("n_dup_lines", "n_lines", 50)),
        ("capitals", _share("n_capitals", "word_chars", 50)),
        ("dots_lines", _share("n_dots_lines", "n_lines", 30)),
        ("bullet_lines", _share("n_bullet_lines", "n_lines", 90)),
        ("broken_characters", F.col("n_broken") > 0),
    )


#: The policies by version: the rules whose failure rejects a text.
BASE = ("few_words", "repeated_words")
POLICIES: dict[str, tuple[str, ...]] = {
    "base": BASE,
    "v1": (*BASE, "short_words", "long_words", "symbols"),
    "v2": (*BASE, "short_words", "long_words", "symbols", "capitals", "repeated_lines", "dots_lines", "bullet_lines"),
}
CURRENT = "v2"


def mask(names) -> int:
    """The bits of rules."""
    bits = {name: 1 << k for k, (name, _) in enumerate(rules())}
    return sum(bits[name] for name in set(names))


def _bound(value: Column, use) -> Column:
    """use(value) with the value computed once for the row, not once for each place where it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def repeated_words(words: Column) -> Column:
    """Words that stand in windows of three words that the text holds more than once.

    Windows are numbers of 64 bits. Where they are all distinct, none is repeated. Elsewhere they are sorted with their
    places, and neighbours of one number are compared word by word, so that two windows of one number don't count as
    one."""
    n = F.size(words)
    pairs = F.zip_with(words, F.slice(words, 2, n), lambda a, b: F.xxhash64(a, b))
    windows = F.slice(F.zip_with(pairs, F.slice(words, 3, n), lambda ab, c: F.xxhash64(ab, c)), 1, F.greatest(n - 2, F.lit(1)))

    def alike(p: Column, q: Column) -> Column:
        return (p["h"] == q["h"]) & (F.slice(words, p["at"] + 1, WINDOW) == F.slice(words, q["at"] + 1, WINDOW))

    def starts(ordered: Column) -> Column:
        both = F.zip_with(ordered, F.slice(ordered, 2, F.size(ordered)), lambda p, q: F.when(alike(p, q), F.array(p["at"], q["at"])))
        return F.array_sort(F.array_distinct(F.flatten(F.array_compact(both))))

    def covered(at: Column) -> Column:
        # a start covers its own three words, without those that the next start covers as well
        gaps = F.zip_with(at, F.slice(at, 2, F.greatest(F.size(at), F.lit(1))), lambda p, q: F.least(F.coalesce(q - p, F.lit(WINDOW)), F.lit(WINDOW)))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda total, gap: total + gap)

    def counted(hashes: Column) -> Column:
        ordered = F.sort_array(F.arrays_zip(hashes.alias("h"), F.sequence(F.lit(0), F.size(hashes) - 1).alias("at")))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(_bound(_bound(ordered, starts), covered))

    return F.when(n <= WINDOW, F.lit(0).cast("long")).otherwise(_bound(windows, counted))


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the measurements instead of the text."""
    kept = [c for c in docs.columns if c != text and c not in MEASURES]
    whole = F.coalesce(F.col(text), F.lit(""))
    # one kind of space, so that splitting needs no pattern; what stands between two of them is an empty part
    plain = whole
    for space in SPACES[1:]:
        plain = F.replace(plain, F.lit(space), F.lit(" "))
    words = F.array_remove(F.split(plain, " "), "")
    lines = F.filter(F.split(whole, "\n"), lambda line: F.btrim(line, F.lit(SPACES)) != "")
    # a generator of one row: what it makes is made once, however often it is used behind it
    made = docs.select(*[F.col(f"`{c}`") for c in kept], F.stack(F.lit(1), whole, words, lines).alias("_text", "_words", "_lines"))
    w, l, t = F.col("_words"), F.col("_lines"), F.col("_text")
    many = lambda items, test: F.size(F.filter(items, test)).cast("long")
    found = lambda pattern: F.regexp_count(t, F.lit(pattern)).cast("long")
    values = {
        "n_words": F.size(w).cast("long"),
        "word_chars": F.length(F.array_join(w, "")).cast("long"),
        "n_symbols": found(f"[{SYMBOLS}]"),
        "n_lines": F.size(l).cast("long"),
        "n_dup_lines": (F.size(l) - F.size(F.array_distinct(l))).cast("long"),
        "n_repeat_words": repeated_words(w),
        "n_capitals": found(r"\p{Lu}"),
        "n_dots_lines": many(l, lambda x: F.rtrim(x).endswith("...") | F.rtrim(x).endswith("…")),
        "n_bullet_lines": many(l, lambda x: F.ltrim(x).rlike(r"^[-*•·‣▪]")),
        "n_broken": (F.length(t) - F.length(F.replace(t, F.lit("\ufffd"), F.lit("")))).cast("long"),
    }
    return made.select(*[F.col(f"`{c}`") for c in kept], *[values[m].alias(m) for m in MEASURES])


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the measurements and `failed`, the bits of the rules that the text fails, instead of the text."""
    bits = [F.when(test, F.lit(1 << k)).otherwise(F.lit(0)).cast("long") for k, (_, test) in enumerate(rules())]
    failed = bits[0]
    for bit in bits[1:]:
        failed = failed.bitwiseOR(bit)
    of = measured(docs.drop("failed"), text)
    return of.withColumn("failed", failed)


def passes(policy: str = CURRENT, failed: str = "failed") -> Column:
    """Whether a policy keeps a row of the ledger."""
    return F.col(failed).bitwiseAND(F.lit(mask(POLICIES[policy]))) == 0


def ablations(rows: DataFrame, policy: str = CURRENT) -> DataFrame:
    """For each rule, over a ledger: n (rows), n_failed, n_only (rows that the policy keeps without this rule alone), kept
    and kept_without (rows that the policy keeps, with the rule and without), beside (bits of the rules that fail in rows
    with this one) and always (bits that fail in all of them)."""
    whole = mask(POLICIES[policy])
    # a row for each task and set of failed rules, however many documents there are
    sets = rows.groupBy("failed").agg(F.count("*").alias("n"))
    names = F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(1 << k).cast("long").alias("bit")) for k, (name, _) in enumerate(rules())])
    spread = sets.select("failed", "n", F.inline(names))
    hit = F.col("failed").bitwiseAND(F.col("bit")) != 0
    under = F.lit(whole).cast("long")
    without = under.bitwiseAND(F.bitwise_not(F.col("bit")))
    kept, kept_without = F.col("failed").bitwiseAND(under) == 0, F.col("failed").bitwiseAND(without) == 0
    total = lambda test: F.coalesce(F.sum(F.when(test, F.col("n")).otherwise(0)), F.lit(0)).cast("long")
    found = spread.groupBy("rule", "bit").agg(
        total(F.lit(True)).alias("n"), total(hit).alias("n_failed"), total(kept_without & ~kept).alias("n_only"),
        total(kept).alias("kept"), total(kept_without).alias("kept_without"),
        F.coalesce(F.bit_or(F.when(hit, F.col("failed"))), F.lit(0)).alias("beside"),
        F.coalesce(F.bit_and(F.when(hit, F.col("failed"))), F.lit(0)).alias("always"),
    )
    every = rows.sparkSession.range(1).select(F.inline(names))
    zeros = {c: 0 for c in ("n", "n_failed", "n_only", "kept", "kept_without", "beside", "always")}
    return every.join(found, ["rule", "bit"], "left").fillna(zeros)
