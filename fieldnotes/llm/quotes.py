"""Chat formatting by quotation linking.

A line's quote level is the number of `>` marks it starts with, with or without spaces between. A message's own
passages are its lines of level 0; a quoted passage is a run of lines with the same level above 0. Passages are
normalised (letters and digits only, A-Z lower-cased, single spaces) and hashed, whole and line by line, and the
hashes of quotes are joined to the first message of the same conversation that says the passage itself, earlier
than the quote. A message replies to the latest original of its quotes at their lowest level, and the tree of
replies gives each message its thread and its depth by doubling steps. The result is one row per message with the
quotes taken out: read by conv_id, thread, depth and turn, each conversation comes in reply order.

A message that quotes nothing, or nothing that is found, opens a thread of its own. Null and empty texts are empty
messages. A null conv_id or turn takes no part in linking. Messages with the same conv_id and turn reply alike.
Long conversations are never gathered: everything runs by message or by passage. Clashing columns are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldnotes.llm.base import ascii_lower, saved

MARKS = r"^[ \t]*((?:>[ \t]*)*)"
#: Attribution lines that mail programs put before a quote: "... wrote:" in four languages.
ATTRIBUTION = r"(?i)^.{0,200}(?:wrote|schrieb|a écrit|escribió)[^:]{0,80}:[ \t]*$"


def _normal(line: Column) -> Column:
    return F.trim(F.regexp_replace(ascii_lower(line), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))


def parsed(messages: DataFrame) -> DataFrame:
    """Messages with `lines` (level, text) and `own`, the text without quotes and their attribution lines."""
    lines = F.transform(
        F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), r"\r\n|\r|\n"),
        lambda x: F.struct(
            F.length(F.regexp_replace(F.regexp_extract(x, MARKS, 1), "[^>]", "")).alias("level"),
            F.regexp_replace(x, MARKS, "").alias("line"),
            x.alias("whole"),
        ),
    )
    frame = messages.drop("lines", "own").withColumn("lines", lines)
    own = F.filter("lines", lambda x, i: (x["level"] == 0) & ~(x["whole"].rlike(ATTRIBUTION) & F.coalesce(F.get(F.col("lines"), i + 1)["level"] > 0, F.lit(False))))
    return frame.withColumn("own", F.trim(F.array_join(F.transform(own, lambda x: x["whole"]), "\n")))


def _passages(frame: DataFrame, quoted: bool) -> DataFrame:
    """(conv_id, turn, level, hash, size) of own lines and texts, or of quoted lines and runs."""
    if not quoted:
        whole = F.array(_normal(F.col("own")))
        each = F.transform(F.split("own", "\n"), _normal)
        found = F.transform(F.array_distinct(F.concat(whole, each)), lambda p: F.struct(F.lit(0).alias("level"), p.alias("passage")))
    else:
        step = F.expr(
            "aggregate(lines, cast(array() as array<struct<level:int,passage:string>>), (runs, x) -> case when x.level = 0 then concat(runs, array(named_struct('level', 0, 'passage', ''))) "
            "when size(runs) > 0 and element_at(runs, -1).level = x.level then concat(slice(runs, 1, size(runs) - 1), array(named_struct('level', x.level, 'passage', concat(element_at(runs, -1).passage, '\\n', x.line)))) "
            "else concat(runs, array(named_struct('level', x.level, 'passage', x.line))) end)"
        )
        runs = F.filter(step, lambda r: r["level"] > 0)
        each = F.transform(F.filter("lines", lambda x: x["level"] > 0), lambda x: F.struct(x["level"].alias("level"), x["line"].alias("passage")))
        found = F.array_distinct(F.transform(F.concat(runs, each), lambda r: F.struct(r["level"].alias("level"), _normal(r["passage"]).alias("passage"))))
    rows = frame.filter("conv_id is not null and turn is not null").select("conv_id", "turn", F.explode(found).alias("p"))
    return rows.filter("p.passage != ''").select("conv_id", "turn", "p.level", F.xxhash64("p.passage", F.length("p.passage")).alias("hash"))


def link(messages: DataFrame) -> DataFrame:
    """Every message with own (text without quotes), reply_to, thread, depth, n_quotes, n_linked and formatted."""
    frame = parsed(messages)
    quotes = saved(_passages(frame.filter(F.exists("lines", lambda x: x["level"] > 0)), True).distinct(), "quotes")
    # only messages of conversations and passages that are quoted matter; one original remains for each
    wanted = quotes.select("conv_id", "hash").distinct()
    first = _passages(frame, False).join(wanted, ["conv_id", "hash"], "left_semi").groupBy("conv_id", "hash").agg(F.min("turn").alias("original"))
    met = quotes.join(first, ["conv_id", "hash"], "left").withColumn("hit", F.when(F.col("original") < F.col("turn"), F.col("original")))
    replies = saved(
        met.groupBy("conv_id", "turn").agg(
            F.countDistinct("hash").cast("long").alias("n_quotes"),
            F.countDistinct(F.when(F.col("hit").isNotNull(), F.col("hash"))).cast("long").alias("n_linked"),
            F.min(F.when(F.col("hit").isNotNull(), F.struct("level", (-F.col("hit")).alias("late")))).alias("best"),
        ).select("conv_id", "turn", "n_quotes", "n_linked", (-F.col("best.late")).alias("reply_to")),
        "replies",
    )
    # up: an earlier message of the same thread, steps: how far up; doubled until all are at their thread's first
    tree = replies.filter("reply_to is not null").select("conv_id", "turn", F.col("reply_to").alias("up"), F.lit(1).cast("long").alias("steps"))
    while True:
        above = tree.select("conv_id", F.col("turn").alias("up"), F.col("up").alias("far"), F.col("steps").alias("more"))
        tree = saved(
            tree.join(above, ["conv_id", "up"], "left").select(
                "conv_id", "turn", F.coalesce("far", "up").alias("up"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), F.col("far").isNotNull().alias("moved")
            ),
            "tree",
        )
        if not tree.filter("moved").limit(1).count():
            break
        tree = tree.drop("moved")
    links = replies.join(tree.select("conv_id", "turn", F.col("up").alias("thread"), F.col("steps").alias("depth")), ["conv_id", "turn"], "left")
    none = F.lit(0).cast("long")
    kept = frame.drop("lines", "n_quotes", "n_linked", "reply_to", "thread", "depth", "formatted")
    return kept.join(links, ["conv_id", "turn"], "left").withColumns({
        "n_quotes": F.coalesce("n_quotes", none),
        "n_linked": F.coalesce("n_linked", none),
        "thread": F.coalesce("thread", "turn"),
        "depth": F.coalesce("depth", none),
        "formatted": F.concat(F.lit("<|"), F.coalesce(F.col("role").cast("string"), F.lit("unknown")), F.lit("|>\n"), F.col("own"), F.lit("\n<|end|>")),
    })
