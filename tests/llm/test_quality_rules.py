import re
from collections import Counter

import pytest
from cases import DOCS, documents
from pyspark.sql import functions as F

from panelspark.llm import quality_rules
from panelspark.llm.common import read
from panelspark.llm.queries import op5_quality_rules

W = re.compile("[^\x20\x09-\x0d]+")


def counted(text):
    text = text or ""
    w = W.findall(text)
    seen = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = set()
    for k in range(len(w) - 2):
        if seen[(w[k], w[k + 1], w[k + 2])] > 1:
            covered |= {k, k + 1, k + 2}
    lines = [x for x in text.split("\n") if W.search(x)]
    symbols = sum(c in "#*$%&|<>" for c in text)
    n = (len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(covered))
    return n, n[0] < 50 or 100 * n[4] > 50 * n[0]


CASES = [t for _, t in DOCS] + [
    "a a a a",
    "a b c a b c",
    "x\ny\nx\n\n \n y\ny",
    "a\x0bb\x0cc\rd\te f g",
    "|# <a> &%$* " * 40,
    "\n\n\n",
    "a b " * 400,
    "é ü " * 30 + "😀 #",
]


def test_counts_equal_loops(spark):
    rows = list(enumerate(CASES))
    judged = quality_rules.apply_rules(documents(spark, rows), into="judged").select("doc_id", "judged.*")
    for r in judged.collect():
        m = r.measures
        got = (m.n_words, m.word_chars, m.n_symbols, m.n_dup_lines, m.n_repeat_words)
        assert (got, r.base_failed) == counted(CASES[r.doc_id]), CASES[r.doc_id][:50]
        assert not (r.base_failed and r.kept)


def test_empty_and_extra_columns(spark):
    docs = documents(spark, [])
    out = quality_rules.apply_rules(docs)
    assert out.columns == [*docs.columns, "quality"] and out.count() == 0


def test_rules_are_one_projection_without_functions(spark, sf_dir):
    plan = op5_quality_rules(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


@pytest.mark.parametrize("bound", [(None, 10.0), (20.0, None), (None, None), (10.0, 12.0)])
def test_compiled_bounds(spark, bound):
    docs = documents(spark, [(1, "word " * 11), (2, "word " * 9), (3, "word " * 21)])
    rules = (("size", "n_words", *bound),)
    out = quality_rules.apply_rules(docs, rules).select("doc_id", F.size("quality.broken").alias("n")).collect()
    least, most = bound
    for r in out:
        n = {1: 11, 2: 9, 3: 21}[r.doc_id]
        assert r.n == int((least is not None and n < least) or (most is not None and n > most))


def test_labels(spark, sf_dir):
    """Texts of quality 0 go; texts of quality 1 that pass the base stay."""
    judged = op5_quality_rules(spark, sf_dir).join(read(spark, sf_dir, "labels"), "doc_id").collect()
    assert not any(r.kept for r in judged if r.quality == 0)
    good = [r for r in judged if r.quality == 1 and not r.base_failed]
    assert sum(r.kept for r in good) >= 0.99 * len(good)
