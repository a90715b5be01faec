"""Toxicity of texts, judged after undoing obfuscation (:mod:`deobfuscate`).

The character model counts the trigrams of every document.  Evidence is learnt from a
bounded sample of labelled rows: words, and beginnings of words, that toxic texts hold in
many different surroundings and others do not.  Copies of one text share their
surroundings and so count once.  A text's score is a logistic function of the evidence of
its distinct words, in their most telling reading.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .deobfuscate import SIZE, Letters, char_counts, restored, tokens_of

#: Most labelled rows of either kind that evidence is learnt from (those of least hash).
TOXIC_ROWS, OTHER_ROWS = 3000, 24000
#: Most words or beginnings kept as evidence, strongest first.
EVIDENCE = 20000
BEGINNINGS = (4, 6)
HELD = 400_000
#: log likelihood ratio that evidence needs (three surroundings in toxic texts only).
LEAST_RATIO = 13.0
#: Log odds that evidence needs: words that toxic texts only hold somewhat more often
#: would add up to much in a long text.
LEAST_WEIGHT = 2.0
_PRIOR = 2.0


def letters_of(docs: DataFrame, text: str = "text") -> Letters:
    """The character model of all texts."""

    def run(batches):
        counts = np.zeros(SIZE**3, np.int64)
        for batch in batches:
            # Texts are counted together, parted by a line's end, which is an edge like a text's end;
            # none is cut, so the counts do not depend on how the rows are dealt.
            some, signs = [], 0
            for value in batch.column(0).to_pylist():
                if value:
                    some.append(value)
                    signs += len(value)
                if signs > 1 << 20:
                    counts += char_counts("\n".join(some))
                    some, signs = [], 0
            counts += char_counts("\n".join(some)) if some else 0
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pydict({"gram": used, "n": counts[used]})

    rows = docs.select(text).mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    counts = np.zeros(SIZE**3)
    for row in rows.collect():  # at most SIZE ** 3 rows
        counts[row.gram] = row.n
    return Letters(counts)


def features(word: str) -> list[str]:
    return [word, *(word[:n] + "-" for n in BEGINNINGS if len(word) >= n)]


def _fold():
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3


def labelled_sample(labels: DataFrame) -> DataFrame:
    """doc_id and toxic of at most TOXIC_ROWS + OTHER_ROWS labelled rows outside fold 1."""
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & (_fold() != 1))
        .groupBy("doc_id")
        .agg(F.max("toxic").cast("int").alias("toxic"))
        .withColumn("place", F.xxhash64("doc_id"))
    )
    sizes = {row.toxic: row["count"] for row in known.groupBy("toxic").count().collect()}  # two rows
    some = []
    for kind, rows in ((1, TOXIC_ROWS), (0, OTHER_ROWS)):
        # A hashed share a little over the sample, so that no task sorts more than that.
        share = int(min(1.0, 1.5 * rows / max(sizes.get(kind, 0), 1) + 1e-5) * (1 << 20))
        near = (F.col("toxic") == kind) & (F.pmod(F.col("place"), F.lit(1 << 20)) < share)
        some.append(known.where(near).orderBy("place").limit(rows))
    return some[0].unionByName(some[1]).withColumn("half", (F.col("place") % 2 == 0).cast("int")).drop("place")


def _occurrences(rows: DataFrame, letters, wanted=None) -> DataFrame:
    """feature, toxic, half, n: in how many different surroundings a feature stands."""

    def run(batches):
        model = letters.value
        keep = wanted.value if wanted else None
        held: dict[str, list[str]] = {}
        for whole in batches:
            for first in range(0, whole.num_rows, 64):
                yield occurrences(whole.slice(first, 64), model, keep, held)

    def occurrences(batch, model, keep, held):
        found = set()
        for value, toxic, half in zip(*(column.to_pylist() for column in batch.columns)):
            tokens = tokens_of(value or "")
            for before, token, after in zip(["", *tokens], tokens, [*tokens[1:], ""]):
                if token not in held:
                    names = {f for word in restored(token, model) for f in features(word)}
                    held[token] = [f for f in names if keep is None or f in keep]
                names = held[token]
                if names:
                    around = xxhash.xxh3_64_intdigest(f"{before} {after}") >> 1
                    found.update((name, toxic, half, around) for name in names)
        columns = list(zip(*found)) or [(), (), (), ()]
        kinds = (pa.string(), pa.int32(), pa.int32(), pa.int64())
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds)], names=["feature", "toxic", "half", "around"]
        )

    places = rows.mapInArrow(run, "feature string, toxic int, half int, around long")
    return places.distinct().groupBy("feature", "toxic", "half").agg(F.count(F.lit(1)).alias("n"))


def _weights(counts: dict[str, np.ndarray], ratio: float) -> dict[str, float]:
    """Log odds of the features that tell, from (toxic, other) counts."""
    weights = {}
    for feature, (toxic, other) in counts.items():
        total = toxic + other
        expected = total * ratio / (1 + ratio)
        if toxic > expected:
            likelihood = 2 * toxic * math.log(toxic / expected)
            if other:
                likelihood += 2 * other * math.log(other / (total - expected))
            if likelihood > LEAST_RATIO:
                weight = math.log((toxic + _PRIOR * ratio) / (other + _PRIOR) / ratio)
                if weight >= LEAST_WEIGHT:
                    weights[feature] = weight
    strongest = sorted(weights, key=lambda f: (-weights[f], f))[:EVIDENCE]
    return {feature: weights[feature] for feature in strongest}


def _evidence(rows: DataFrame, letters, weights, columns: list[str]) -> DataFrame:
    """``columns`` of ``rows`` (whose last column is the text) with the text's evidence."""

    def run(batches):
        model, table = letters.value, weights.value
        held: dict[str, float] = {}

        def weigh(token: str) -> float:
            return max((table.get(f, 0.0) for word in restored(token, model) for f in features(word)), default=0.0)

        for batch in batches:
            sums = []
            for value in batch.column(batch.num_columns - 1).to_pylist():
                total = 0.0
                for token in set(tokens_of(value or "")):
                    weight = held.get(token)
                    if weight is None:
                        if len(held) >= HELD:
                            held.clear()
                        weight = held[token] = weigh(token)
                    total += weight
                sums.append(total)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(sums, pa.float64())], names=[*columns, "evidence"]
            )

    kinds = dict(rows.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in columns)
    return rows.mapInArrow(run, f"{schema}, evidence double")


def _logistic(evidence: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """Offset and slope that fit the labels; a weak prior keeps separable data finite."""
    offset, slope = -4.0, 1.0
    prior = np.array([0.05, 0.05])
    for _ in range(50):
        chance = 1 / (1 + np.exp(-np.clip(offset + slope * evidence, -30, 30)))
        spread = chance * (1 - chance)
        rows = np.stack([np.ones_like(evidence), evidence])
        slope_of = rows @ (toxic - chance) - prior * np.array([offset + 4.0, slope - 1.0])
        curve = (rows * spread) @ rows.T + np.diag(prior)
        step = np.linalg.solve(curve, slope_of)
        offset, slope = offset + float(np.clip(step[0], -1, 1)), slope + float(np.clip(step[1], -1, 1))
        if abs(step).max() < 1e-6:
            break
    return offset, max(slope, 0.05)


class ToxicityModel:
    """Character model, evidence weights, and the logistic's offset and slope."""

    def __init__(self, letters: Letters, weights: dict[str, float], offset: float, slope: float):
        self.letters, self.weights, self.offset, self.slope = letters, weights, offset, slope


def fit(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    """Learn from ``labels`` (doc_id, toxic) outside fold 1 and the texts of ``docs``.

    The offset and slope come from rows whose half did not choose the evidence.
    """
    context = docs.sparkSession.sparkContext
    letters = letters_of(docs)
    model = context.broadcast(letters)
    # At most TOXIC_ROWS + OTHER_ROWS rows of 16 bytes.
    sample = F.broadcast(labelled_sample(labels))
    rows = docs.select("doc_id", "text").join(sample, "doc_id").select("text", "toxic", "half")
    toxic_rows = rows.where(F.col("toxic") == 1)
    counts: dict[tuple[str, int], np.ndarray] = {}
    # Bounded by the words of TOXIC_ROWS texts; only those in three surroundings come back.
    telling = _occurrences(toxic_rows, model)
    enough = telling.groupBy("feature").agg(F.sum("n").alias("all")).where(F.col("all") >= 3)
    for row in telling.join(enough, "feature").collect():
        counts.setdefault((row.feature, row.half), np.zeros(2))[0] += row.n
    wanted = context.broadcast({feature for feature, _ in counts})
    for row in _occurrences(rows.where(F.col("toxic") == 0), model, wanted).collect():
        counts.setdefault((row.feature, row.half), np.zeros(2))[1] += row.n
    sizes = {(r.toxic, r.half): r.n for r in rows.groupBy("toxic", "half").agg(F.count(F.lit(1)).alias("n")).collect()}

    def ratio(halves):
        toxic, other = (sum(sizes.get((kind, half), 0) for half in halves) for kind in (1, 0))
        return (toxic + 0.5) / (other + 0.5)

    def weights(halves):
        merged: dict[str, np.ndarray] = {}
        for (feature, half), pair in counts.items():
            if half in halves:
                merged[feature] = merged.get(feature, 0) + pair
        return _weights(merged, ratio(halves))

    first = context.broadcast(weights({0}))
    checked = _evidence(rows.where(F.col("half") == 1).select("toxic", "text"), model, first, ["toxic"]).collect()
    offset, slope = -4.0, 1.0
    if checked:
        offset, slope = _logistic(np.array([r.evidence for r in checked]), np.array([r.toxic for r in checked], float))
    return ToxicityModel(letters, weights({0, 1}), offset, slope)


def toxicity(docs: DataFrame, model: ToxicityModel, text: str = "text") -> DataFrame:
    """``docs`` with ``score``, the probability that a text is toxic.

    Null and empty texts have the score of no evidence.  Columns of any name but ``text``
    are kept; an input column ``score`` is replaced; repeated rows each give a row.
    """
    context = docs.sparkSession.sparkContext
    docs = docs.drop("score")
    others = [c for c in docs.columns if c != text]
    rows = docs.select(*others, F.col(text).alias("__kept"), F.col(text).alias("__text"))
    scored = _evidence(
        rows, context.broadcast(model.letters), context.broadcast(model.weights), [*others, "__kept"]
    )
    odds = F.col("evidence") * model.slope + model.offset
    return scored.select(
        *(F.col("__kept").alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns),
        (1 / (1 + F.exp(-odds))).alias("score"),
    )


def op10(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Scores of all documents; fold 1 of the ids never gives labels (a null id is in fold 0)."""
    scored = toxicity(docs.select("doc_id", "text"), fit(docs, labels))
    return scored.select(
        "doc_id",
        (_fold() == 1).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
