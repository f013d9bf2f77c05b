import math
import random
import zlib

import numpy as np
import pytest
from cases import documents
from pyspark.sql import functions as F

from panelspark.llm import quality_model, sample
from panelspark.llm.common import read
from panelspark.llm.queries import op2_toxicity, op7_quality_classifier


def made(n=300):
    random.seed(6)
    words = ["".join(random.choice("abcdefghij") for _ in range(random.randint(2, 8))) for _ in range(500)]
    rows, labels = [], []
    for k in range(n):
        bad = k % 5 == 0
        text = [random.choice(words) for _ in range(random.randint(20, 120))]
        text = [w + "###" for w in text] if bad else text
        rows.append((k, " ".join(text)))
        labels.append((k, int(not bad), 0))
    return rows, labels


def test_sample_is_bounded_by_texts(spark):
    """An id with many texts; each other id keeps its text."""
    ids = [k for k in range(100) if zlib.crc32(str(k).encode()) % 5]
    rows = [(ids[0], f"hot text {k}") for k in range(700)] + [(k, f"text of {k}") for k in ids[1:]]
    labels = spark.createDataFrame([(k, int(k == ids[0])) for k in ids], "doc_id long, quality int")
    taken = [sample.labelled(documents(spark, r), labels, "quality", 200).collect() for r in (rows, rows[::-1])]
    assert len(taken[0]) == 200 and sorted(taken[0]) == sorted(taken[1])
    assert {r.text for r in taken[0] if r.label == 0} == {t for _, t in rows[700:]}
    assert sample.labelled(documents(spark, rows), labels, "quality").count() == len(rows)


def test_pairs_rank_texts():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 14))
    y = (x[:, 3] + 0.1 * rng.normal(size=500) > -1).astype(int)
    ranking = quality_model.fit(x, y)
    score = ranking.score(x)
    assert score[y == 1].mean() > score[y == 0].mean() + 0.3
    assert abs((score < quality_model.CUT).sum() - (y == 0).sum()) <= 1
    assert ((score >= quality_model.CUT) == (y == 1)).mean() > 0.95


def test_held_out(spark):
    rows, labels = made()
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    docs = documents(spark, rows)
    ranking = quality_model.learn(docs, table)
    scored = docs.select("doc_id", quality_model.quality(docs, ranking).alias("s")).collect()
    assert all((r.s >= quality_model.CUT) == (labels[r.doc_id][1] == 1) for r in scored)


def test_edge_cases(spark):
    rows, labels = made()
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    ranking = quality_model.learn(documents(spark, rows), table)
    docs = documents(spark)
    scored = docs.select("doc_id", quality_model.quality(docs, ranking).alias("s")).collect()
    assert len(scored) == docs.count() and all(0 <= r.s <= 1 for r in scored)
    assert len({r.s for r in scored if r.doc_id in (4, 5)}) == 1  # null and empty alike
    assert documents(spark, []).select(quality_model.quality(docs, ranking)).count() == 0


@pytest.mark.parametrize("labels", [[], [(1, 1, 0)], [(None, 1, 0), (2, None, None)]])
def test_without_both_labels_nothing_is_rejected(spark, labels):
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    docs = documents(spark)
    ranking = quality_model.learn(docs, table)
    assert docs.filter(quality_model.quality(docs, ranking) < quality_model.CUT).count() == 0


@pytest.mark.parametrize(
    ("query", "label", "recall", "alarms"),
    [(op7_quality_classifier, "quality", 0.97, 0.02), (op2_toxicity, "toxic", 0.6, 0.05)],
)
def test_held_out_accuracy_of_the_query(spark, sf_dir, query, label, recall, alarms):
    """Of the rows not learned from: the share found of label 1, and of label 0 taken for it."""
    rows = query(spark, sf_dir).join(read(spark, sf_dir, "labels"), "doc_id")
    held = rows.filter("held_out").select("predicted", F.col(label).alias("label")).collect()
    good, bad = ([r.predicted for r in held if r.label == k] for k in (1, 0))
    assert sum(good) >= recall * len(good) > 0 and sum(bad) <= alarms * len(bad)


def test_score_equals_fixed_weights_by_hand(spark):
    """The score of each text from its measures, one product after the other."""
    n = len(quality_model.FEATURES)
    fixed = quality_model.Ranking(np.full(n, 0.1), np.full(n, 2.0), np.linspace(-1, 1, n), 0.2, 0.5)
    docs = documents(spark)
    for r in docs.select("text", quality_model.quality(docs, fixed).alias("s")).collect():
        measures = quality_model.features(r.text)
        value = sum((f - 0.1) / 2.0 * w for f, w in zip(measures, fixed.weights, strict=True))
        odds = math.exp((value - 0.2) / 0.5) * 0.3 / 0.7
        assert r.s == pytest.approx(odds / (1 + odds))
    assert quality_model.features("one two") == pytest.approx(
        [math.log1p(2) / 10, 0.3, 1.0, 0.0, 1.0, 1.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1 / 7, 1.0, math.log1p(3) / 10]
    )


def over_all_pairs(x, y, penalty=quality_model.PENALTY):
    """Weights of the standardised columns, from a list of all pairs."""
    z = (x - x.mean(axis=0)) / np.where(x.std(axis=0) < 1e-9, 1.0, x.std(axis=0))
    gap = (z[y == 1][:, None] - z[y == 0][None]).reshape(-1, x.shape[1])
    w = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(gap @ w))
        hessian = (gap * (p * (1 - p))[:, None]).T @ gap / len(gap) + penalty * np.eye(len(w))
        w -= np.linalg.solve(hessian, penalty * w - gap.T @ p / len(gap))
    return w, z @ w


@pytest.mark.parametrize("noise", [0.0, 0.1, 2.0])
def test_all_pairs_count(noise):
    """Also with classes that one feature parts, a feature without spread and a far outlier."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 14))
    y = (x[:, 3] + noise * rng.normal(size=400) > -1).astype(int)
    x[:, 5], x[7, 9] = 0.4, 60.0
    ranking = quality_model.fit(x, y)
    weights, values = over_all_pairs(x, y)
    assert np.abs(ranking.weights - weights).max() < 1e-7
    bad = (y == 0).sum()
    assert ranking.cut == pytest.approx(np.sort(values)[[bad - 1, bad]].mean(), abs=1e-6)
    assert ranking.width == pytest.approx((np.median(np.sort(values)[bad:]) - ranking.cut) / 3, abs=1e-6)


def test_all_labelled_texts_are_learned_from(spark):
    """More texts than the old bound, some of an id with many texts and some repeated; each text counts once."""
    random.seed(3)
    words = ["".join(random.choice("abcdefghij") for _ in range(random.randint(1, 9))) for _ in range(300)]
    rows, labels = [], []
    for k in range(29_000):
        text = " ".join(random.choice(words) for _ in range(random.randint(3, 9)))
        rows.append((k if k < 28_000 else 1, text + "#" * random.randint(0, 4 if k % 4 else 9)))
    labels = [(k, int(k % 4 > 0), 0) for k in range(28_000)] + [(2, 1, 0), (2, 0, 0), (None, 1, 0), (3, None, 0)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    ranking = quality_model.learn(documents(spark, rows + rows[:500] + [(4, None)], extra=False), table)
    learned = sorted({(t, int(k % 4 > 0)) for k, t in rows if zlib.crc32(str(k).encode()) % 5 and k != 2})
    assert len(learned) > 22_000
    x, y = np.array([quality_model.features(t) for t, _ in learned]), np.array([label for _, label in learned])
    whole = quality_model.fit(x, y)
    assert np.abs(ranking.mean - x.mean(axis=0)).max() < 1e-9
    assert np.abs(ranking.weights - whole.weights).max() < 1e-7
    assert (ranking.cut, ranking.width) == pytest.approx((whole.cut, whole.width), abs=1e-7)


def test_values_at_ranks(spark):
    """Ties, a far value and a single one, against the sorted list."""
    for values in ([5.0], [1.0] * 50, [0.1 * (k % 7) for k in range(900)] + [1e9, -3.0], [2.0**-k for k in range(99)]):
        ranks = sorted({0, len(values) // 3, len(values) // 2, len(values) - 1})
        table = spark.createDataFrame([(v,) for v in values], "value double")
        assert quality_model._ranked(table, ranks) == [sorted(values)[k] for k in ranks]
