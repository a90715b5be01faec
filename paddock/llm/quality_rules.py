"""Quality by weak supervision: rules vote or abstain, and none has the last word.

Each rule looks at one statistic of a text and votes good (1), bad (-1) or abstains (0).
How far a rule can be trusted is not given: expectation-maximisation finds, from which
votes go together over all texts, the share of good texts and each rule's rates of either
vote on good and on bad ones.  A text is kept if its posterior probability of being good
is at least a half, unless the base rules already failed it.

There are at most 3 ** rules patterns of votes, so the corpus counts them with partial
sums and EM runs on that short list.
"""

from __future__ import annotations

import re
import string
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paddock.session import store

from .texts import WordHashes, hashes_of, window_hashes

STATISTICS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines",
    "n_capitals", "n_ends", "n_distinct",
    "n_symbol_words", "n_letters",
)
_SYMBOLS = str.maketrans("", "", "#*$%&|<>")
_HAS_SYMBOL = re.compile(rb"[#*$%&|<>]")
_NO_LETTERS = str.maketrans("", "", string.digits + string.punctuation)
WINDOW = 5


def repeated_words(hashes: np.ndarray, size: int = WINDOW) -> int:
    """Words in windows of ``size`` words found at least twice, the first included."""
    windows = window_hashes(hashes, size)
    if len(windows) < 2:
        return 0
    _, place, count = np.unique(windows, return_inverse=True, return_counts=True)
    starts = np.flatnonzero(count[place] > 1)
    edges = np.bincount(starts, minlength=len(hashes) + 1) - np.bincount(starts + size, minlength=len(hashes) + 1)
    return int((np.cumsum(edges) > 0).sum())


def statistics_of(text: str, held: WordHashes) -> tuple[int, ...]:
    words = text.encode().split()
    joined = b"".join(words).decode()
    lines: set[str] = set()
    repeated = filled = 0
    for line in text.split("\n"):
        if line.strip(" \t\n\v\f\r"):
            filled += 1
            if line in lines:
                repeated += 1
            lines.add(line)
    hashes = hashes_of(words, held)
    symbols = len(text) - len(text.translate(_SYMBOLS))
    return (
        len(words),
        len(joined),
        symbols,
        repeated,
        repeated_words(hashes),
        filled,
        sum(map(joined.count, "ABCDEFGHIJKLMNOPQRSTUVWXYZ")),
        sum(map(joined.count, ".!?")),
        len(np.unique(hashes)),
        sum(map(bool, map(_HAS_SYMBOL.search, words))) if symbols else 0,
        len(joined.translate(_NO_LETTERS)),
    )


def text_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without the text, with STATISTICS of it; null text counts as empty."""
    others = [c for c in docs.columns if c != text and c not in STATISTICS]
    rows = docs.select(*others, text)

    def run(batches):
        held = WordHashes()
        for batch in batches:
            found = []
            for value in batch.column(batch.num_columns - 1).to_pylist():
                found.append(statistics_of(value or "", held))
                if len(held) > 500_000:
                    held.clear()
            columns = list(zip(*found)) or [()] * len(STATISTICS)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], *(pa.array(c, pa.int64()) for c in columns)], names=[*others, *STATISTICS]
            )

    added = [T.StructField(name, T.LongType()) for name in STATISTICS]
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[:-1], *added]))


@dataclass(frozen=True)
class VotingRule:
    """Votes good or bad where its conditions hold; bad wins, and neither is an abstention."""

    name: str
    good: Callable[[], Column]
    bad: Callable[[], Column]

    def vote(self) -> Column:
        return F.when(self.bad(), -1).when(self.good(), 1).otherwise(0).cast("int")


def _share(part: str, whole: str) -> Column:
    """Per thousand; an empty whole counts as one."""
    return F.col(part) * 1000 / F.greatest(F.col(whole), F.lit(1))


# Thresholds as common for web text; each leaves a band in which the rule abstains.
RULES = (
    VotingRule("length", lambda: F.col("n_words") >= 50, lambda: F.col("n_words") < 20),
    VotingRule(
        "word_size",
        lambda: _share("word_chars", "n_words").between(3500, 9000),
        lambda: ~_share("word_chars", "n_words").between(2500, 12000),
    ),
    VotingRule("symbols", lambda: _share("n_symbols", "n_words") < 50, lambda: _share("n_symbols", "n_words") > 200),
    VotingRule("lines", lambda: _share("n_dup_lines", "n_lines") < 50, lambda: _share("n_dup_lines", "n_lines") > 300),
    VotingRule(
        "repeats", lambda: _share("n_repeat_words", "n_words") < 50, lambda: _share("n_repeat_words", "n_words") > 200
    ),
    VotingRule(
        "capitals", lambda: _share("n_capitals", "word_chars") < 100, lambda: _share("n_capitals", "word_chars") > 400
    ),
    VotingRule(
        "sentences", lambda: _share("n_ends", "n_words").between(20, 250), lambda: ~_share("n_ends", "n_words").between(4, 600)
    ),
    VotingRule(
        "variety", lambda: _share("n_distinct", "n_words") > 300, lambda: (_share("n_distinct", "n_words") < 150) & (F.col("n_words") < 2000)
    ),
    VotingRule(
        "symbol_words", lambda: _share("n_symbol_words", "n_words") < 50, lambda: _share("n_symbol_words", "n_words") > 250
    ),
    VotingRule("letters", lambda: _share("n_letters", "word_chars") > 800, lambda: _share("n_letters", "word_chars") < 700),
)


@dataclass
class VoteModel:
    """Share of good texts and, for each rule, the rates of votes -1, 0, 1 on bad and good ones."""

    good: float
    rates: np.ndarray  # rule, class (bad, good), vote + 1

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        logs = np.tile(np.log([1 - self.good, self.good]), (len(votes), 1))
        for rule in range(votes.shape[1]):
            logs += np.log(self.rates[rule][:, votes[:, rule] + 1]).T
        return 1 / (1 + np.exp(np.clip(logs[:, 0] - logs[:, 1], -500, 500)))


def fit(votes: np.ndarray, counts: np.ndarray, rounds: int = 200) -> VoteModel:
    """EM over patterns of votes, started from the opinion that two bad votes make a bad text.

    Passing a rule is ordinary and failing one is not, so a majority would hide texts that
    are bad in one way only.  Each rate has one text as prior, more of it where a vote agrees with the class, which
    keeps good and bad from changing places.
    """
    patterns, rules = votes.shape
    posterior = np.array([0.9, 0.5, 0.1])[np.minimum((votes < 0).sum(1), 2)]
    prior = np.array([[0.6, 0.3, 0.1], [0.1, 0.3, 0.6]]) * 2
    model = VoteModel(0.5, np.zeros((rules, 2, 3)))
    for _ in range(rounds):
        weights = np.stack([counts * (1 - posterior), counts * posterior])
        total = weights.sum(1)
        model.good = float((total[1] + 1) / (total.sum() + 2))
        for rule in range(rules):
            for vote in range(3):
                here = votes[:, rule] == vote - 1
                model.rates[rule, :, vote] = (weights[:, here].sum(1) + prior[:, vote]) / (total + prior.sum(1))
        after = model.posterior(votes)
        if np.abs(after - posterior).max(initial=0) < 1e-9:
            break
        posterior = after
    return model


def weakly_supervised(statistics: DataFrame, rules: tuple[VotingRule, ...] = RULES) -> DataFrame:
    """``statistics`` with ``votes`` (an array, one for each rule) and ``p_good``.

    ``statistics`` should be a stored table, since it is read twice.  Input columns of
    these names are replaced; an empty table gives an empty one.
    """
    spark = statistics.sparkSession
    voted = statistics.drop("votes", "p_good").withColumn("votes", F.array(*(rule.vote() for rule in rules)))
    patterns = voted.groupBy("votes").count().collect()  # at most 3 ** rules rows
    if not patterns:
        return voted.withColumn("p_good", F.lit(None).cast("double"))
    votes = np.array([row.votes for row in patterns], np.int64).reshape(len(patterns), len(rules))
    counts = np.array([row["count"] for row in patterns], float)
    chances = fit(votes, counts).posterior(votes)
    table = spark.createDataFrame(
        [(list(map(int, pattern)), float(p)) for pattern, p in zip(votes, chances)], "votes array<int>, p_good double"
    )
    return voted.join(F.broadcast(table), "votes", "left")


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def quality(docs: DataFrame, text: str = "text") -> DataFrame:
    """The other columns of ``docs`` with statistics, ``base_failed``, ``votes``, ``p_good``, ``kept``.

    Null text: empty, so base_failed.  Repeated rows each give a row.
    """
    rows = weakly_supervised(store(text_statistics(docs, text), "text-statistics"))
    rows = rows.withColumn("base_failed", base_failed())
    return rows.withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= 0.5))


def op5(docs: DataFrame) -> DataFrame:
    return quality(docs.select("doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )
