"""Hidden Markov language model.

Texts are words and one end. Word counts cover all training texts. The SYMBOLS most frequent words are symbols
of their own; every other word emits the symbol RARE and is then drawn with (c + 1) / (sum over the rest of c + 1,
and one for all unseen words), so that the model gives every text a probability. Baum-Welch: each task runs
the scaled forward and backward recursions over its training texts and adds up expected counts, the tasks' counts
are summed by symbol, and the new model is their shares. The score is the exact log10 likelihood of the whole
sequence by the scaled forward recursion.

Counts of the LOCAL most frequent words go to every task, a table of fixed size; the counts of all other words
are joined to the documents' rows. Both ways give the same exact counts.

Null and empty texts consist of the end alone. Every row is scored for itself, repeated ids included; a null id
belongs to the training rows. Without training rows all words are unseen. Clashing columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldnotes.llm.base import released, saved, slices, words

#: States, symbols of words, words counted locally, rounds of training, tokens that are run together.
STATES, SYMBOLS, LOCAL, ROUNDS, TOGETHER = 6, 8_192, 131_072, 3, 600_000
#: Characters of text that rows are made of at a time, bytes of symbols that are read at a time.
MADE, READ = 12_000_000, 24_000_000


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept out of training."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(7)) == 2, F.lit(False))


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n) over a column `text`; every task counts before it sends."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()
        for batch in batches:
            for text in batch["text"]:
                seen.update(words(text))
                if len(seen) > 200_000:
                    yield pd.DataFrame({"word": list(seen), "n": list(seen.values())})
                    seen.clear()
        yield pd.DataFrame({"word": list(seen), "n": list(seen.values())})

    return texts.select("text").mapInPandas(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Packed:
    """Sequences of symbols, the longest first, laid out by time: step t is a slice with the sequences that last."""

    def __init__(self, sequences: list[np.ndarray]):
        lengths = np.array([len(s) for s in sequences])
        self.order = np.argsort(-lengths, kind="stable")
        steps = int(lengths.max())
        self.active = np.searchsorted(-lengths[self.order], -np.arange(steps), side="left")
        self.offset = np.concatenate([[0], np.cumsum(self.active)])
        self.symbols = np.empty(int(lengths.sum()), np.int64)
        for rank, which in enumerate(self.order):
            self.symbols[self.offset[: lengths[which]] + rank] = sequences[which]


def forward(packed: Packed, start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scaled state probabilities of every position and the scales; the log likelihood is the sum of their logs."""
    alpha = emit[packed.symbols]
    scale = np.empty(len(packed.symbols))
    offset, active = packed.offset, packed.active
    for t in range(len(active)):
        now = alpha[offset[t] : offset[t + 1]]
        now *= start if t == 0 else alpha[offset[t - 1] : offset[t - 1] + active[t]] @ move
        total = now.sum(1)
        scale[offset[t] : offset[t + 1]] = total
        now /= total[:, None]
    return alpha, scale


def expected(packed: Packed, start, move, emit) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected counts of starts, moves and emissions, and the log likelihood."""
    alpha, scale = forward(packed, start, move, emit)
    offset, active, states = packed.offset, packed.active, len(start)
    moves = np.zeros((states, states))
    beta = np.ones((active[-1], states))
    for t in range(len(active) - 1, 0, -1):
        here, back = slice(offset[t], offset[t + 1]), slice(offset[t - 1], offset[t - 1] + active[t])
        ahead = emit[packed.symbols[here]] * beta / scale[here][:, None]
        moves += alpha[back].T @ ahead
        alpha[here] *= beta  # from here on the posterior
        beta = np.ones((active[t - 1], states))
        beta[: active[t]] = ahead @ move.T
    alpha[: active[0]] *= beta
    emitted = np.stack([np.bincount(packed.symbols, alpha[:, s], len(emit)) for s in range(states)], 1)
    return alpha[: active[0]].sum(0), moves * move, emitted, float(np.log(scale).sum())


def _symbols(own: list[bytes], symbol_of: dict) -> np.ndarray:
    """The symbols of a text's words, then the end."""
    return np.array([*[symbol_of.get(w, len(symbol_of)) for w in own], len(symbol_of) + 1], np.int32)


def _groups(sequences: list[np.ndarray]) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    """Places and sequences of a batch, by length, in groups of limited size."""
    order = sorted(range(len(sequences)), key=lambda i: len(sequences[i]))
    group: list[int] = []
    size = 0
    for i in order:
        group.append(i)
        size += len(sequences[i])
        if size >= TOGETHER:
            yield group, [sequences[j] for j in group]
            group, size = [], 0
    if group:
        yield group, [sequences[j] for j in group]


def _kind(symbols: dict) -> str:
    return "<u2" if len(symbols) + 2 <= 1 << 16 else "<u4"


class Model:
    """Start, move and emission shares, the symbol of each frequent word, and what the counts add up to."""

    def __init__(self, frequent: list[bytes], shares: np.ndarray, states: int):
        noise = np.random.default_rng(7)
        self.symbols = {w: i for i, w in enumerate(frequent)}
        self.start = np.full(states, 1 / states)
        self.move = np.full((states, states), 0.05 / max(1, states - 1))
        np.fill_diagonal(self.move, 0.95 if states > 1 else 1.0)
        self.floor = shares
        emit = shares[:, None] * np.exp(1.5 * noise.standard_normal((len(shares), states)))
        self.emit = emit / emit.sum(0)

    def written(self, texts: DataFrame) -> DataFrame:
        """The symbols of all texts, as numbers of 16 or 32 bits, so that no round has to split texts again."""
        symbols = self.symbols

        def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in (part for whole in batches for part in slices(whole, size=MADE)):
                yield pd.DataFrame({"symbols": [_symbols(words(t), symbols).astype(_kind(symbols)).tobytes() for t in batch["text"]]})

        return saved(texts.select("text").mapInPandas(write, "symbols binary"), "symbols")

    def round(self, texts: DataFrame) -> float:
        """One round of Baum-Welch over the symbols of all texts; gives the log likelihood before it."""
        kind, start, move, emit = _kind(self.symbols), self.start, self.move, self.emit
        states, size = len(start), len(emit)

        def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            # rows: symbols, then moves from each state, then starts, then the likelihood
            total = np.zeros((size + states + 2, states))
            for batch in (part for whole in batches for part in slices(whole, "symbols", READ)):
                for _, sequences in _groups([np.frombuffer(s, kind) for s in batch["symbols"]]):
                    first, moves, emitted, log = expected(Packed(sequences), start, move, emit)
                    total[:size] += emitted
                    total[size : size + states] += moves
                    total[-2] += first
                    total[-1, 0] += log
            rows = np.flatnonzero(total.any(1))
            yield pd.DataFrame({"row": rows.astype(np.int32)} | {f"c{s}": total[rows, s] for s in range(states)})

        columns = [f"c{s}" for s in range(states)]
        schema = ", ".join(["row int", *(f"{c} double" for c in columns)])
        found = texts.mapInPandas(count, schema).groupBy("row").agg(*[F.sum(c).alias(c) for c in columns]).toPandas()
        total = np.zeros((size + states + 2, states))  # as large as the model, whatever the corpus
        total[found["row"].to_numpy()] = found[columns].to_numpy()
        if not total[-2].sum():
            return 0.0
        emitted = total[:size] + self.floor[:, None]  # one token's worth of the plain shares keeps all above 0
        self.emit = emitted / emitted.sum(0)
        moves = total[size : size + states] + 1 / states
        self.move = moves / moves.sum(1, keepdims=True)
        self.start = (total[-2] + 1 / states) / (total[-2].sum() + 1)
        return float(total[-1, 0])


def score(docs: DataFrame, states: int = STATES, symbols: int = SYMBOLS, local: int = LOCAL, rounds: int = ROUNDS, logs: list | None = None) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row. logs: gets the log
    likelihood of the training texts before each round."""
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), held_out(F.col("doc_id")).alias("held_out"))
    train = rows.filter(~F.col("held_out"))
    counts = saved(word_counts(train), "words")
    n_train = train.count()
    totals = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n_all, distinct = totals["n"] + n_train, totals["v"] + (n_train > 0)
    known = [(bytes(r["word"]), r["n"]) for r in counts.orderBy(F.desc("n"), "word").limit(local).collect()]
    frequent, rare_n = known[:symbols], totals["n"] - sum(n for _, n in known[:symbols])
    rare_all = rare_n + (totals["v"] - len(frequent)) + 1
    shares = np.array([n for _, n in frequent] + [rare_n, n_train], float) + 0.5
    model = Model([w for w, _ in frequent], shares / shares.sum(), states)
    encoded = model.written(train) if rounds else None
    for _ in range(rounds):
        log = model.round(encoded)
        if logs is not None:
            logs.append(log)
    if encoded is not None:
        released(encoded)
    shared = docs.sparkSession.sparkContext.broadcast(({w: math.log10(n + 1) for w, n in known}, model.symbols, model.start, model.move, model.emit))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        logs10, symbol_of, start, move, emit = shared.value
        at = TaskContext.get().partitionId() << 33
        for batch in (part for whole in batches for part in slices(whole, size=MADE)):
            table, sequences = [], []
            for text in batch["text"]:
                own = words(text)
                sequences.append(_symbols(own, symbol_of))
                n_known = n_rare = 0
                logs = rare_logs = 0.0
                rest = []
                for w, n in Counter(own).items():
                    log = logs10.get(w)
                    if log is None:
                        rest.append({"word": w, "n": n})
                        n_rare += n
                        continue
                    n_known += n
                    logs += n * log
                    if w not in symbol_of:
                        n_rare += n
                        rare_logs += n * log
                table.append((len(own) + 1, n_known, logs, n_rare, rare_logs, rest))
            result = np.zeros(len(batch))
            for places, some in _groups(sequences):
                packed = Packed(some)
                _, scale = forward(packed, start, move, emit)
                which = np.concatenate([packed.order[:a] for a in packed.active])
                result[places] = np.bincount(which, np.log10(scale), len(some))
            more = pd.DataFrame(table, columns=["n_tokens", "n_known", "logs", "n_rare", "rare_logs", "rest"])
            yield pd.concat([
                pd.DataFrame({"row": np.arange(at, at + len(batch)), "doc_id": batch["doc_id"].to_numpy(), "held_out": batch["held_out"].to_numpy(), "forward": result}), more,
            ], axis=1)
            at += len(batch)

    kind = docs.schema["doc_id"].dataType.simpleString()
    part = saved(
        rows.mapInPandas(run, f"row long, doc_id {kind}, held_out boolean, forward double, n_tokens long, n_known long, logs double, n_rare long, rare_logs double, rest array<struct<word:binary,n:int>>"),
        "scored",
    )
    rest = (
        part.select("row", F.explode("rest").alias("r")).select("row", F.col("r.word").alias("word"), F.col("r.n").alias("times"))
        .join(counts, "word").groupBy("row")
        .agg(F.sum("times").alias("more_known"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("more_logs"))
    )
    log_all, log_rare = float(np.log10(n_all + distinct + 1)), float(np.log10(rare_all))
    more_known, more_logs = F.coalesce("more_known", F.lit(0)), F.coalesce("more_logs", F.lit(0.0))
    return part.drop("rest").join(rest, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + more_known + F.lit(int(n_train > 0))).cast("long").alias("n_known"),
        F.lit(n_all).cast("long").alias("train_tokens"),
        (F.col("logs") + more_logs + F.lit(float(np.log10(n_train + 1))) - F.col("n_tokens") * log_all).alias("base_score"),
        (F.col("forward") + F.col("rare_logs") + more_logs - F.col("n_rare") * log_rare).alias("score"),
    )
