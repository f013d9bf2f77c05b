"""Quality classifier by Bradley-Terry pairwise ranking.

Each different labelled text of quality 1 is preferred over each of quality 0: all these pairs count, of
all labelled texts that are not held out.  Weights minimise the logistic loss on the differences of the
pairs' features; there is no intercept, as it cancels in a difference.  The ranking value is cut at a
score quantile: the share of quality 0 among the texts.  The cut is placed at the score ``cut``, and the
value becomes a score by a logistic curve.

The pairs are never listed.  Within a cell of ranking values the loss and its derivatives follow a
polynomial of few degrees to the last digits, so a text counts at a cell's nodes with the shares of
Lagrange's polynomials, and each Newton step needs one pass over the texts that sums these shares per
class, cell and node.  The driver gets these sums, whose number depends on the span of the values and not
on the number of texts.  Values at a rank are found exactly, by counts in bins that get narrower.

A null text is an empty one; an empty text has defined features (zeros).  Repeated rows score alike.
Without labels of both kinds there is no pair: every score is the share of quality 1 (1 without
labels, so that nothing is rejected).
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import Steps, ship_code, slot
from panelspark.llm.sample import labelled_ids

CUT = 0.3
PENALTY = 1e-3
WIDTH = 2.0  # of a cell of ranking values
NODES = 18  # of a cell; the logistic function's poles lie pi away, so the error is about 1e-15
BINS = 4096  # that the values at a rank are sought in at a time
COMPRESSED = 1 << 16  # bytes of each piece of a text whose compression is measured

FEATURES = (
    "log_words", "word_length", "distinct_words", "adjacent_repeats", "distinct_triples", "distinct_lines",
    "compression", "upper", "digits", "marks", "symbols", "spaces", "short_words", "longest_word",
)


def features(text: str | None) -> list[float]:
    """Measures of a whole text, each between 0 and about 1."""
    if not text:
        return [0.0] * len(FEATURES)
    raw = text.encode("utf-8", "replace")
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    size = len(raw)
    words = text.split()
    n = len(words)
    lines = [line for line in text.split("\n") if line.strip()]
    lengths = np.fromiter(map(len, words), np.int64, n)
    packed = sum(len(zlib.compress(raw[k : k + COMPRESSED], 1)) for k in range(0, size, COMPRESSED))
    triples = len(set(zip(words, words[1:], words[2:], strict=False))) / (n - 2) if n > 2 else 1.0
    upper = counts[65:91].sum()
    letters = upper + counts[97:123].sum()
    return [
        math.log1p(n) / 10,
        min(float(lengths.mean()), 40.0) / 10 if n else 0.0,
        len(set(words)) / n if n else 0.0,
        sum(map(str.__eq__, words, words[1:])) / n if n else 0.0,
        triples,
        len(set(lines)) / len(lines) if lines else 0.0,
        min(packed / size, 1.0),
        upper / max(1, letters),
        counts[48:58].sum() / size,
        (counts[33] + counts[44] + counts[46] + counts[63]) / size,
        (counts[[35, 36, 37, 38, 42, 60, 62, 124]]).sum() / size,
        (counts[9] + counts[10] + counts[32]) / size,
        float((lengths <= 3).mean()) if n else 0.0,
        math.log1p(int(lengths.max())) / 10 if n else 0.0,
    ]


@dataclass
class Ranking:
    """Weights of standardised features, the cut of the ranking value, and the curve's width."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float
    width: float
    base: float | None = None  # the score where there was no pair

    def value(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale * self.weights).sum(axis=1)  # alike in whatever batch a row is

    def score(self, x: np.ndarray, at: float = CUT) -> np.ndarray:
        if self.base is not None:
            return np.full(len(x), self.base)
        z = (self.value(x) - self.cut) / self.width + math.log(at / (1 - at))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


Sums = dict[tuple[int, int], np.ndarray]  # by class and cell
Part = Callable[[np.ndarray, np.ndarray], Sums]

_PLACES = np.cos(np.pi * (np.arange(NODES) + 0.5) / NODES)  # of the nodes in a cell from -1 to 1
_LAGRANGE = np.polynomial.chebyshev.chebvander(_PLACES, NODES - 1).T * np.r_[1, [2] * (NODES - 1)][:, None] / NODES


def _classes(x: np.ndarray, y: np.ndarray) -> Sums:
    """Texts of each class, and the sums of their features."""
    return {(int(c), 0): np.r_[(y == c).sum(), x[y == c].sum(axis=0)] for c in np.unique(y)}


def _at_nodes(x: np.ndarray, y: np.ndarray, ranking: Ranking) -> Sums:
    """Per class, cell and node: the shares of the texts, and these times the features and their products."""
    z = (x - ranking.mean) / ranking.scale
    first, second = np.triu_indices(z.shape[1])
    measures = np.column_stack([np.ones(len(z)), z, z[:, first] * z[:, second]])
    place = ranking.value(x) / WIDTH
    cell = np.floor(place)
    shares = np.polynomial.chebyshev.chebvander(2 * (place - cell) - 1, NODES - 1) @ _LAGRANGE
    out = {}
    for c in (0, 1):
        for at in np.unique(cell[y == c]):
            own = (y == c) & (cell == at)
            out[c, int(at)] = (shares[own].T @ measures[own]).ravel()
    return out


def _over_pairs(sums: Sums, k: int) -> tuple[float, np.ndarray, np.ndarray]:
    """Loss, gradient and Hessian, summed over all pairs of a text of class 1 and one of class 0."""
    first, second = np.triu_indices(k)
    nodes = {key: (key[1] + (_PLACES + 1) / 2) * WIDTH for key in sorted(sums)}
    low = np.concatenate([nodes[key] for key in nodes if key[0] == 0])
    bad = np.concatenate([sums[key].reshape(NODES, -1) for key in nodes if key[0] == 0])
    loss, gradient, upper, mixed = 0.0, np.zeros(k), np.zeros(len(first)), np.zeros((k, k))
    for key in nodes:
        if key[0] != 1:
            continue
        good = sums[key].reshape(NODES, -1)
        gap = nodes[key][:, None] - low
        lost, won = np.logaddexp(0, -gap), np.logaddexp(0, gap)
        p, h = np.exp(-won), np.exp(-won - lost)  # the chance that the pair is seen reversed, and its slope
        loss += float(good[:, 0] @ lost @ bad[:, 0])
        gradient -= (p @ bad[:, 0]) @ good[:, 1 : k + 1] - (good[:, 0] @ p) @ bad[:, 1 : k + 1]
        upper += (h @ bad[:, 0]) @ good[:, k + 1 :] + (good[:, 0] @ h) @ bad[:, k + 1 :]
        mixed += good[:, 1 : k + 1].T @ h @ bad[:, 1 : k + 1]
    hessian = np.zeros((k, k))
    hessian[first, second] = hessian[second, first] = upper
    return loss, gradient, hessian - mixed - mixed.T


def _weights(total: Callable[[Part], Sums], start: Ranking, pairs: int, penalty: float) -> np.ndarray:
    """Bradley-Terry weights, by Newton steps; a step that raises the loss is halved."""
    k = len(start.weights)
    w, step, best, least = start.weights, np.zeros(k), start.weights, math.inf
    for _ in range(100):
        tried = Ranking(start.mean, start.scale, w, 0.0, 1.0)
        loss, gradient, hessian = _over_pairs(total(lambda x, y, at=tried: _at_nodes(x, y, at)), k)
        loss = loss / pairs + penalty * float(w @ w) / 2
        if loss > least + 1e-12:
            step = step / 2
        else:
            best, least = w, loss
            step = np.linalg.solve(hessian / pairs + penalty * np.eye(k), gradient / pairs + penalty * w)
        w = best - step
        if np.abs(step).max() < 1e-8:
            break
    return np.round(w, 9)  # in whatever order the sums came


def _ranking(
    total: Callable[[Part], Sums], ranked: Callable[[Ranking, list[int]], list[float]], k: int, penalty: float
) -> Ranking:
    """A ranking of texts that are read by passes only: sums over all, and the values at given ranks."""
    classes = total(_classes)
    bad, good = (int(classes[c, 0][0]) if (c, 0) in classes else 0 for c in (0, 1))
    if not good or not bad:
        return Ranking(np.zeros(k), np.ones(k), np.zeros(k), 0.0, 1.0, 0.0 if bad else 1.0)
    whole = sum(classes.values())
    n, mean = int(whole[0]), np.round(whole[1:] / whole[0], 12)
    squares = total(lambda x, y: {(0, 0): ((x - mean) ** 2).sum(axis=0)})[0, 0]
    scale = np.sqrt(squares / n).round(12)
    start = Ranking(mean, np.where(scale < 1e-9, 1.0, scale), np.zeros(k), 0.0, 1.0)
    start.weights = _weights(total, start, good * bad, penalty)
    above = n - bad  # the quantile: as many values lie below as there are texts of quality 0
    below, at, left, right = ranked(start, [bad - 1, bad, bad + (above - 1) // 2, bad + above // 2])
    cut = (below + at) / 2
    return Ranking(mean, start.scale, start.weights, cut, max(1e-6, ((left + right) / 2 - cut) / 3))


def fit(x: np.ndarray, y: np.ndarray, penalty: float = PENALTY) -> Ranking:
    """Bradley-Terry weights from all pairs of the rows of two arrays."""
    k = x.shape[1] if x.ndim == 2 else len(FEATURES)
    return _ranking(
        lambda part: part(x, y), lambda ranking, ranks: np.sort(ranking.value(x))[ranks].tolist(), k, penalty
    )


def _total(texts: DataFrame, part: Part) -> Sums:
    """What ``part`` gives for the batches of (label, x), summed over all of them."""
    schema = "label int, cell long, sums array<double>"

    def rows(sums: Sums) -> dict[str, pa.Array]:
        return {
            "label": pa.array([c for c, _ in sums], pa.int32()),
            "cell": pa.array([at for _, at in sums], pa.int64()),
            "sums": pa.array(list(sums.values()), pa.list_(pa.float64())),
        }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: Sums = {}
        for batch in batches:
            x = batch["x"].flatten().to_numpy().reshape(-1, len(FEATURES))
            for key, found in part(x, batch["label"].to_numpy()).items():
                sums[key] = sums[key] + found if key in sums else found
        yield pa.RecordBatch.from_pydict(rows(sums))

    def add(key: tuple, found: pa.Table) -> pa.Table:  # one row of each task
        sums = np.array(found["sums"].to_pylist()).sum(axis=0)
        return pa.Table.from_pydict(rows({(key[0].as_py(), key[1].as_py()): sums}))

    found = texts.mapInArrow(run, schema).groupBy("label", "cell").applyInArrow(add, schema).toArrow().to_pylist()
    return {(r["label"], r["cell"]): np.array(r["sums"]) for r in found}


def _ranked(values: DataFrame, ranks: list[int]) -> list[float]:
    """The entries at ``ranks`` of the ordered column ``value``."""
    value, bounds = F.col("value"), (F.min("value").alias("low"), F.max("value").alias("high"))
    low, high = values.agg(*bounds).first()
    found, spans = {}, [(low, high, 0, ranks)]
    while spans:
        low, high, before, wanted = spans.pop()
        if low == high:
            found |= dict.fromkeys(wanted, low)
            continue
        place = F.floor((value - low) / (high - low) * BINS)
        counts = (
            values.filter(value.between(low, high))
            .groupBy(F.least(place, F.lit(BINS - 1)).alias("bin"))
            .agg(F.count("*").alias("n"), *bounds)
        )
        for r in sorted(counts.collect()):  # at most BINS rows; the first and the last bin are never empty
            here = [k for k in wanted if before <= k < before + r["n"]]
            if here:
                spans.append((r["low"], r["high"], before, here))
            before += r["n"]
    return [found[k] for k in ranks]


def learn(docs: DataFrame, labels: DataFrame, penalty: float = PENALTY) -> Ranking:
    """A ranking from all labelled texts that are not held out.

    Texts are measured where they lie, and only their digests and measures are shuffled.  A broadcast of
    at most SLOTS integers thins the texts to be measured.
    """
    steps = Steps(docs.sparkSession, "quality")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t) for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch["id"], batch["digest"], pa.array(found, pa.list_(pa.float64()))], names=["id", "digest", "x"]
            )

    ids = labelled_ids(labels, "quality")
    at = slot(F.xxhash64("id")).alias("slot")
    texts = (
        docs.select(F.col("doc_id").cast("long").alias("id"), "text")
        .filter("text IS NOT NULL")
        .select("id", "text", at)
        .join(F.broadcast(ids.select(at).distinct()), "slot", "left_semi")
        .select("id", F.unhex(F.sha2(F.col("text"), 256)).alias("digest"), "text")
    )
    measured = texts.mapInArrow(measure, "id long, digest binary, x array<double>").join(ids, "id")
    found = steps.store(measured.dropDuplicates(["digest", "label"]).select("label", "x"), "texts")

    def ranked(ranking: Ranking, ranks: list[int]) -> list[float]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = batch["x"].flatten().to_numpy().reshape(-1, len(FEATURES))
                yield pa.RecordBatch.from_pydict({"value": pa.array(ranking.value(x))})

        return _ranked(steps.store(found.mapInArrow(run, "value double"), "values"), ranks)

    ranking = _ranking(lambda part: _total(found, part), ranked, len(FEATURES), penalty)
    steps.drop("texts", "values")
    return ranking


def quality(docs: DataFrame, ranking: Ranking, at: float = CUT) -> Column:
    """The quality score of the ``text`` column of ``docs``; texts below ``at`` are rejected."""
    ship_code(docs.sparkSession)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            x = np.array([features(t) for t in texts], np.float64).reshape(len(texts), len(FEATURES))
            yield pd.Series(ranking.score(x, at))

    return score(F.col("text"))
