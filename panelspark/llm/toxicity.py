"""Toxicity by a weighted lexicon, matched with Aho-Corasick in folded text.

Folding lower-cases, replaces letters of other scripts that look like Latin ones, reads digits and
signs inside words as the letters they stand for, and drops invisible characters.  ``l`` and ``1``
fold to ``i``, so that every reading of ``1`` matches.

The lexicon is learned from a bounded sample of labelled texts: words and beginnings of words whose
share of the uses in toxic texts is far above that in other texts, chosen greedily until no term
adds a match to enough toxic texts that still lack one.  A text's uses of a term count by their
logarithm, so that one text which repeats a word doesn't decide.  A term's weight is the logarithm of
the ratio of its shares.  A phrase of
a term and its neighbour that occurs only in texts that are not toxic is an exception: matches inside
it don't count.  A text's value is the sum of weights per thousand characters; a logistic curve over
its logarithm gives the score.

A null or empty text has no matches and gets the score of a clean one.  Repeated rows score alike.
Without labels of both kinds the lexicon is empty and every score is the share of toxic labels
(0 without labels).  Texts of any length take time in proportion to it; beside the folded text, SPAN
characters of it are held with their matches.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from itertools import accumulate

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import Steps, remainder_is_zero, ship_code
from panelspark.llm.sample import SAMPLE_ROWS, labelled

SPAN = 1 << 18  # characters of a folded text that are matched at a time
NEIGHBOUR = 40  # a longer word beside a term makes no phrase with it


@dataclass(frozen=True)
class Settings:
    """How terms are chosen; the defaults come from :func:`cross_validate` on training rows."""

    prefixes: tuple[int, ...] = (4, 5, 6, 7, 8)  # lengths of beginnings of words
    least_odds: float = 3.0  # logarithm of the ratio of a term's shares of uses
    least_share: float = 0.01  # of the toxic texts, in which a term must add a match that is still wanted
    cover: int = 4  # matches wanted in every toxic text, so that the lexicon doesn't rest on single terms
    damped: bool = True  # a text's uses of a term count by their logarithm


# Letters that look like Latin ones, and digits and signs read as letters.
LOOKALIKES = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t",
    "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ё": "e", "ї": "i",
    "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u",
    "χ": "x", "ω": "w", "γ": "y", "η": "n", "ɑ": "a", "ɡ": "g", "ı": "i", "ⅼ": "l", "ⅰ": "i", "ո": "n",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s"}
INVISIBLE = "­​‌‍⁠﻿"

_FULLWIDTH = {0xFF01 + k: 0x21 + k for k in range(94)}
_FOLD = (
    {ord(a): b for a, b in LOOKALIKES.items()}
    | {ord(c): None for c in INVISIBLE}
    | {ord("l"): "i"}
)
_UNUSUAL = re.compile("[Ā-￿­]")
_RUN = re.compile(r"[\w@$]+")
_SIGN = re.compile(r"[0-9@$]")
_BESIDE = re.compile(r"[0-9@$][^\W_]|[^\W\d_][0-9@$]")
_DIGITS = str.maketrans(DIGITS)
_WORD = re.compile(r"[^\W_]+")


def _read_word(word: str) -> str:
    if not _BESIDE.search(word):
        return word
    letters = sum(c.isalpha() for c in word)
    return word.translate(_DIGITS) if letters * 2 >= len(word) else word


def _read_digits(match: re.Match) -> str:
    run = match[0]
    return "_".join(map(_read_word, run.split("_"))) if _SIGN.search(run) else run


def fold(text: str) -> str:
    """Lower-cased text with look-alikes and digit substitutions replaced."""
    if _UNUSUAL.search(text):
        text = text.translate(_FULLWIDTH)
    text = text.lower()
    if any(c in text for c in "0134578@$9"):
        text = _RUN.sub(_read_digits, text)
    if text.isascii():
        return text.replace("l", "i")
    return text.translate(_FOLD)


@dataclass
class Lexicon:
    """Weighted terms, exception phrases, and the curve from values to scores."""

    words: dict[str, float] = field(default_factory=dict)
    beginnings: dict[str, float] = field(default_factory=dict)
    exceptions: frozenset[str] = frozenset()
    center: float = 0.0
    slope: float = 0.0
    base: float = 0.0  # the score where there is no lexicon

    def automaton(self) -> ahocorasick.Automaton | None:
        found = ahocorasick.Automaton()
        for term in self.words.keys() | self.beginnings.keys():
            found.add_word(term, (term, self.words.get(term), self.beginnings.get(term)))
        for phrase in self.exceptions:
            if phrase not in found:
                found.add_word(phrase, (phrase, None, None))
        if not len(found):
            return None
        found.make_automaton()
        return found


def matches(folded: str, automaton) -> list[tuple[int, int, str, float]]:
    """(start, end, term, weight) of the matches at word bounds, outside exception phrases."""
    hits, shielded = [], []
    n = len(folded)
    for last, (term, word, beginning) in automaton.iter(folded):
        start, end = last + 1 - len(term), last + 1
        if start and folded[start - 1].isalnum():
            continue
        whole = end == n or not folded[end].isalnum()
        if word is None and beginning is None:
            if whole:
                shielded.append((start, end))
        elif beginning is not None and (word is None or not whole):
            hits.append((start, end, term, beginning))
        elif word is not None and whole:
            hits.append((start, end, term, word))
    if shielded:  # ordered by their ends: is there one that ends there or later and begins there or earlier?
        ends = [b for _, b in shielded]
        begins = list(accumulate(reversed([a for a, _ in shielded]), min))[::-1]

        def free(hit: tuple) -> bool:
            k = bisect_left(ends, hit[1])
            return k == len(ends) or begins[k] > hit[0]

        hits = [h for h in hits if free(h)]
    return hits


def value(text: str | None, automaton, span: int = SPAN) -> float:
    """Logarithm of the matched weight per thousand characters."""
    if not text or automaton is None:
        return 0.0
    folded = fold(text)
    n = len(folded)
    if n <= span:
        weight = math.fsum(h[3] for h in matches(folded, automaton))
    else:  # a span at a time, with as much around it as the longest term or phrase can take
        beside = max(map(len, automaton)) + 2
        weights = []
        for begin in range(0, n, span):
            lead = max(0, begin - beside)
            found = matches(folded[lead : begin + span + beside], automaton)
            weights += [h[3] for h in found if begin <= h[0] + lead < begin + span]
        weight = math.fsum(weights)
    return math.log1p(1000 * weight / (n + 50)) if weight else 0.0


def terms(folded: str, prefixes: tuple[int, ...]) -> Counter[tuple[str, bool]]:
    """Uses of the words (True) and beginnings of words (False) of a folded text."""
    words = Counter(m[0] for m in _WORD.finditer(folded))
    found = Counter({(w, True): n for w, n in words.items()})
    for word, n in words.items():
        for k in prefixes:
            if len(word) >= k:
                found[word[:k], False] += n
    return found


def _term_counts(sample: DataFrame, settings: Settings) -> DataFrame:
    """Per term: toxic texts that hold it, and its damped uses in clean and in toxic texts.

    The row whose term is NULL has the sums over all words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts: Counter = Counter()
            uses: tuple[Counter, Counter] = (Counter(), Counter())
            for text, label in zip(batch["text"].to_pylist(), batch["label"].to_pylist(), strict=True):
                toxic = label == 1
                for key, n in terms(fold(text), settings.prefixes).items():
                    damped = math.log1p(n) if settings.damped else n
                    uses[toxic][key] += damped
                    texts[key] += toxic
                    if key[1]:
                        uses[toxic][None, True] += damped
            keys = list(uses[0].keys() | uses[1].keys())
            yield pa.RecordBatch.from_pydict(
                {
                    "term": pa.array([k[0] for k in keys], pa.string()),
                    "whole": pa.array([k[1] for k in keys], pa.bool_()),
                    "texts": pa.array([texts[k] for k in keys], pa.int64()),
                    "clean": pa.array([float(uses[0][k]) for k in keys], pa.float64()),
                    "toxic": pa.array([float(uses[1][k]) for k in keys], pa.float64()),
                }
            )

    found = sample.mapInArrow(run, "term string, whole boolean, texts long, clean double, toxic double")
    sums = [F.round(F.sum(c), 6).alias(c) for c in ("clean", "toxic")]  # in whatever order they came
    return found.groupBy("term", "whole").agg(F.sum("texts").alias("texts"), *sums)


def _word_before(folded: str, at: int) -> str | None:
    part = folded[max(0, at - NEIGHBOUR - 2) : at]
    word = part.split()[-1] if part.strip() else ""
    whole = part.lstrip() != part or len(part.split()) > 1 or at <= NEIGHBOUR + 2
    return word if word and len(word) <= NEIGHBOUR and whole else None


def _word_after(folded: str, at: int) -> str | None:
    part = folded[at : at + NEIGHBOUR + 2].lstrip()
    word = part.split()[0] if part else ""
    whole = len(word) < len(part) or at + NEIGHBOUR + 2 >= len(folded)
    return word if word and len(word) <= NEIGHBOUR and whole else None


def _hits(sample: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Per text that holds a term: its label, its terms, and the phrases of a term and its neighbour."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for batch in batches:
            found, phrases = [], []
            for text in batch["text"].to_pylist():
                folded = fold(text)
                hits = matches(folded, automaton)
                found.append(sorted({f"{h[2]}\t{int(h[2] in lexicon.words)}" for h in hits}))
                around = set()
                for start, end, _, _ in hits:
                    stop = end
                    while stop < len(folded) and folded[stop].isalnum() and stop - end <= NEIGHBOUR:
                        stop += 1
                    before, after = _word_before(folded, start), _word_after(folded, stop)
                    around |= {f"{before} {folded[start:stop]}"} if before else set()
                    around |= {f"{folded[start:stop]} {after}"} if after else set()
                phrases.append(sorted(around))
            lists = pa.list_(pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch["label"], pa.array(found, lists), pa.array(phrases, lists)],
                names=["label", "terms", "phrases"],
            )

    schema = "label int, terms array<string>, phrases array<string>"
    return sample.select("label", "text").mapInArrow(run, schema).filter("size(terms) > 0")


def _cover(texts: list[set[str]], least: int, cover: int) -> list[str]:
    """Terms in the order of the texts they add; of nearly equal ones the longest."""
    holders: dict[str, set[int]] = {}
    for i, found in enumerate(texts):
        for term in found:
            holders.setdefault(term, set()).add(i)
    left, chosen = set(range(len(texts))), []
    wanted = [cover] * len(texts)
    while holders:
        gains = {t: len(held & left) for t, held in holders.items()}
        most = max(gains.values())
        if most < least:
            break
        best = max((t for t in gains if gains[t] >= 0.9 * most), key=lambda t: (len(t), t[-1] == "0", t))
        chosen.append(best)
        for i in holders[best]:
            wanted[i] -= 1
        term = best.split("\t")[0]  # what begins with it, or it begins with, finds the same words
        holders = {
            t: held
            for t, held in holders.items()
            if not (other := t.split("\t")[0]).startswith(term) and not term.startswith(other)
        }
        left = {i for i in left if wanted[i] > 0}
    return chosen


def _curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and center of a logistic curve, by Newton steps with a small penalty."""
    w = np.zeros(2)
    design = np.stack([np.ones_like(x), x], axis=1)
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        gradient = design.T @ (weight * (p - y)) + 1e-2 * w
        hessian = (design * (weight * p * (1 - p))[:, None]).T @ design + 1e-2 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    slope = max(float(w[1]), 1e-3)
    return slope, float(-w[0] / slope)


def learn(
    docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, settings: Settings = Settings()  # noqa: B008
) -> Lexicon:
    """A lexicon from at most ``rows`` labelled texts that are not held out."""
    spark = docs.sparkSession
    steps = Steps(spark, "toxicity")
    sample = steps.store(labelled(docs, labels, "toxic", rows), "sample")
    sizes = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    clean, toxic = sizes.get(0, 0), sizes.get(1, 0)
    if not clean or not toxic:
        return Lexicon(base=1.0 if toxic else 0.0)
    least = max(3, math.ceil(settings.least_share * toxic))
    counts = steps.store(_term_counts(sample, settings), "terms")
    total = counts.filter("term IS NULL").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).first()
    odds = F.log((F.col("toxic") + 0.5) / ((total["toxic"] or 0) + 1)) - F.log(
        (F.col("clean") + 0.5) / ((total["clean"] or 0) + 1)
    )
    rows_of = (
        counts.filter((F.col("texts") >= least) & (odds > settings.least_odds) & F.col("term").isNotNull())
        .select("term", "whole", odds.alias("odds"))
        .collect()  # bounded by the sample
    )
    wide = Lexicon(
        {r["term"]: r["odds"] for r in rows_of if r["whole"]},
        {r["term"]: r["odds"] for r in rows_of if not r["whole"]},
    )
    if wide.automaton() is None:
        return Lexicon(base=toxic / (clean + toxic))
    bad = _hits(sample.filter("label = 1"), wide).select("terms").collect()  # at most ``rows`` sets of candidates
    chosen = _cover([_both(set(r["terms"]), wide, settings.prefixes) for r in bad], least, settings.cover)
    lexicon = Lexicon(
        {t.split("\t")[0]: wide.words[t.split("\t")[0]] for t in chosen if t.endswith("1")},
        {t.split("\t")[0]: wide.beginnings[t.split("\t")[0]] for t in chosen if t.endswith("0")},
    )
    if lexicon.automaton() is None:
        return Lexicon(base=toxic / (clean + toxic))
    phrases = (
        _hits(sample, lexicon)
        .select("label", F.explode("phrases").alias("phrase"))
        .groupBy("phrase")
        .agg(F.sum("label").alias("toxic"), F.count("*").alias("texts"))
        .filter("toxic = 0 AND texts >= 3")
    )
    lexicon.exceptions = frozenset(r["phrase"] for r in phrases.select("phrase").collect())  # bounded by the sample
    values = sample.select(F.col("label"), scorer(lexicon, raw=True)(F.col("text")).alias("x")).toPandas()
    lexicon.slope, lexicon.center = _curve(values["x"].to_numpy(), values["label"].to_numpy(float))
    steps.drop("sample", "terms")
    return lexicon


def _both(found: set[str], lexicon: Lexicon, prefixes: tuple[int, ...]) -> set[str]:
    """A word that was found is also found by each beginning of it that is a candidate."""
    out = set()
    for entry in found:
        term, word = entry.split("\t")
        if word == "1":
            out.add(entry)
        out |= {f"{term[:k]}\t0" for k in prefixes if term[:k] in lexicon.beginnings and len(term) >= k}
    return out


def scorer(lexicon: Lexicon, raw: bool = False):
    """A vectorised function of a text column: its score (or its value)."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        automaton = lexicon.automaton()
        for texts in batches:
            x = np.array([value(t, automaton) for t in texts], np.float64)
            if raw:
                yield pd.Series(x)
            elif automaton is None:
                yield pd.Series(np.full(len(x), lexicon.base))
            else:
                z = np.clip(lexicon.slope * (x - lexicon.center), -30, 30)
                yield pd.Series(1 / (1 + np.exp(-z)))

    return score


def toxicity(docs: DataFrame, lexicon: Lexicon) -> Column:
    """The toxicity score of the ``text`` column of ``docs``."""
    ship_code(docs.sparkSession)
    return scorer(lexicon)(F.col("text"))


def cross_validate(
    docs: DataFrame, labels: DataFrame, settings: Sequence[Settings], folds: int = 5, rows: int = SAMPLE_ROWS
) -> list[dict]:
    """Per setting: recall, precision and AUC of the folds' scores, each by a lexicon of the other folds.

    Only rows that are not held out are read; the folds come from another hash of the id.
    """
    ids = labels.filter(~remainder_is_zero(F.col("doc_id")))
    fold = F.pmod(F.xxhash64(F.col("doc_id").cast("long"), F.lit(5)), F.lit(folds))
    out = []
    for setting in settings:
        scored = []
        for k in range(folds):
            lexicon = learn(docs, ids.filter(fold != k), rows, setting)
            own = labelled(docs, ids.filter(fold == k), "toxic", rows)
            scored.append(own.select("label", toxicity(own, lexicon).alias("score")).toPandas())  # ``rows`` at most
        both = pd.concat(scored)
        bad, score = both["label"].to_numpy() == 1, both["score"].to_numpy()
        rank = pd.Series(score).rank().to_numpy()
        n = max(1, int(bad.sum()))
        auc = (rank[bad].sum() - n * (n + 1) / 2) / max(1, n * int((~bad).sum()))
        said = score >= 0.5
        out.append(
            {
                "settings": setting,
                "recall": float((said & bad).sum() / n),
                "precision": float((said & bad).sum() / max(1, int(said.sum()))),
                "auc": float(auc),
            }
        )
    return out
