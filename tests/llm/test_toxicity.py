import math
import random
import re
import time
import zlib

import pytest
from cases import documents
from pyspark.sql import functions as F

from panelspark.llm import toxicity


def made(spark, n=400):
    random.seed(2)
    plain = [f"{a}{b}" for a in ("ba", "do", "ke", "mi", "ru") for b in ("na", "lo", "ti", "sa", "ve")]
    rows, labels = [], []
    for k in range(n):
        text = [random.choice(plain) for _ in range(60)]
        bad = k % 4 == 0
        if bad:
            for _ in range(3):
                text[random.randrange(60)] = random.choice(["zorgling", "vexnard", "grunthead"])
        rows.append((k, " ".join(text)))
        labels.append((k, 1, int(bad)))
    return rows, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def lexicon(spark):
    rows, labels = made(spark)
    return toxicity.learn(documents(spark, rows), labels)


def scores(spark, lexicon, texts):
    docs = documents(spark, list(enumerate(texts)))
    out = docs.select("doc_id", toxicity.toxicity(docs, lexicon).alias("s")).collect()
    return [r.s for r in sorted(out)]


def test_held_out_accuracy(spark, lexicon):
    rows, labels = made(spark)
    got = scores(spark, lexicon, [t for _, t in rows])
    wanted = [r.toxic for r in sorted(labels.collect())]
    assert [int(s >= 0.5) for s in got] == wanted


def test_folding(spark, lexicon):
    got = scores(
        spark,
        lexicon,
        ["you z0rgling", "you zоrgling", "you ZORG​LING", "you v3xn4rd", "bana dolo 2024 keti", None, ""],
    )
    assert [s >= 0.5 for s in got] == [True] * 4 + [False] * 3


def test_exception_phrases():
    lexicon = toxicity.Lexicon({"trash": 5.0}, {}, frozenset({"trash can"}), 0.5, 5.0)
    found = toxicity.matches("trash can and trash", lexicon.automaton())
    assert [(a, b) for a, b, _, _ in found] == [(14, 19)]


def test_exceptions_are_learned(spark):
    rows, labels = made(spark)
    rows = [(i, t + " vexnard stone" if i % 40 == 1 else t) for i, t in rows]
    found = toxicity.learn(documents(spark, rows), labels)
    assert any("stone" in p for p in found.exceptions)


def test_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    found = toxicity.learn(documents(spark), none)
    assert scores(spark, found, ["any", None]) == [0.0, 0.0]
    only = spark.createDataFrame([(1, 1, 0), (2, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.learn(documents(spark), only).automaton() is None
    assert toxicity.learn(documents(spark, []), only).automaton() is None


def test_long_text(spark, lexicon):
    assert scores(spark, lexicon, ["bana " * 200_000]) == scores(spark, lexicon, ["bana"])


def test_matches_outside_exceptions_equal_a_plain_search():
    draw = random.Random(7)
    words = {"aa": 1.0, "ab": 2.0, "ba": 3.0}
    phrases = frozenset({"aa ab", "ab ba ab", "ba aa", "aa aa aa"})
    automaton = toxicity.Lexicon(words, {"bb": 0.5}, phrases).automaton()
    for _ in range(200):
        text = " ".join(draw.choice(["aa", "ab", "ba", "bb", "bbc", "c"]) for _ in range(draw.randrange(30)))
        shields = []
        for p in phrases:
            for at in range(len(text)):
                whole = (at == 0 or text[at - 1] == " ") and text[at + len(p) : at + len(p) + 1] in ("", " ")
                if text.startswith(p, at) and whole:
                    shields.append((at, at + len(p)))
        wanted, at = [], 0
        for word in text.split():
            term = word if word in words else "bb" if word.startswith("bb") else None
            if term and not any(a <= at and at + len(term) <= b for a, b in shields):
                wanted.append((at, at + len(term), term, words.get(term, 0.5)))
            at += len(word) + 1
        found = toxicity.matches(text, automaton)
        assert sorted(found) == wanted


def test_value_does_not_depend_on_the_span():
    lexicon = toxicity.Lexicon({"trash": 5.0, "junk": 2.0}, {"gar": 1.0}, frozenset({"trash can", "old junk"}))
    draw = random.Random(8)
    text = " ".join(draw.choice(["trash", "can", "junk", "old", "garden", "x" * 30]) for _ in range(2000))
    automaton = lexicon.automaton()
    assert {toxicity.value(text, automaton, span) for span in (64, 1000, 1 << 20)} == {toxicity.value(text, automaton)}


def test_reading_digits():
    assert toxicity.fold("z0rg_l1ng 2024 @user a1 7up 1 $$ b@d") == "zorg_iing 2024 auser ai tup 1 $$ bad"


@pytest.mark.parametrize(
    "text",
    [
        "ACGT" * 2_500_000 + "1",  # one word with a digit
        "1" + "a1" * 5_000_000,
        "@" * 10_000_000,
        "trash can trash " * 600_000,  # terms and exceptions
        "trash " * 1_600_000,
        "\u044f\u200b" * 4_000_000,
    ],
    ids=["word", "mixed", "signs", "exceptions", "terms", "folded"],
)
def test_very_long_texts_take_linear_time(text):
    automaton = toxicity.Lexicon({"trash": 5.0}, {}, frozenset({"trash can"})).automaton()
    began = time.process_time()
    toxicity.value(text, automaton)
    assert time.process_time() - began < 30


def scored_by_hand(text, lexicon):
    """Weights of the terms at word bounds, per thousand characters, through the curve."""
    folded = toxicity.fold(text or "")
    weight = 0.0
    for word in re.findall(r"[^\W_]+", folded):
        beginnings = [b for b in lexicon.beginnings if word.startswith(b)]
        weight += lexicon.words[word] if word in lexicon.words else 0.0
        weight += sum(lexicon.beginnings[b] for b in beginnings if b != word or word not in lexicon.words)
    x = math.log1p(1000 * weight / (len(folded) + 50))
    return 1 / (1 + math.exp(-lexicon.slope * (x - lexicon.center)))


def test_scores_equal_fixed_weights_by_hand(spark):
    fixed = toxicity.Lexicon({"zorg": 4.0, "vex": 2.5}, {"grun": 3.0, "zor": 1.0}, frozenset(), 3.0, 2.0)
    draw = random.Random(9)
    texts = [" ".join(draw.choice(["zorg", "z0rg", "vex", "grunt", "zorro", "calm", "day"]) for _ in range(k)) for k in range(40)]
    texts += [None, "", "ZORG\u200b vex_grun"]
    wanted = [scored_by_hand(t, fixed) for t in texts]
    assert scores(spark, fixed, texts) == pytest.approx(wanted)


def test_cross_validation_reads_training_rows_only(spark):
    rows, labels = made(spark)
    held = [r.doc_id for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    turned = labels.withColumn("toxic", F.when(F.col("doc_id").isin(held), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    setting = [toxicity.Settings()]
    plain, other = (toxicity.cross_validate(documents(spark, rows), t, setting, folds=2) for t in (labels, turned))
    assert plain == other and plain[0]["recall"] == 1.0 and plain[0]["auc"] == 1.0
