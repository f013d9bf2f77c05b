import hashlib
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from cases import DOCS, documents
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from panelspark.llm import fill_middle
from panelspark.llm.common import text_buffers

UNIT = re.compile("[A-Za-z]+|[^A-Za-z]", re.S)
ODD = [
    (20, "a<P>b"),
    (21, "x <S"),
    (22, "<M>"),
    (23, "< P > <M <S P>S>"),
    (24, "퟿￿\U0010ffff" * 40),
    (25, "@A[Z`a{z\x80\xff" * 9),
    (26, "\x00\x00 a\x00b"),
    (27, "é" * 7 + "abcdefgh" * 3),
]


def brute(doc_id, text):
    """(n, form, prefix_chars, middle_chars, output) by cutting the text into its units."""
    text = text or ""
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 20:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def check(df):
    restored = fill_middle.restore(F.col("fim.output"), F.col("fim.form"))
    for r in df.withColumn("restored", restored).collect():
        assert tuple(r.fim) == brute(r.doc_id, r.text)
        assert r.restored == (r.text or "")


def test_equals_brute_force(spark):
    check(fill_middle.fill_in_middle(documents(spark, DOCS + ODD)))


def test_every_form_occurs(spark):
    rows = [(k, f"héllo wörld {k}, and <more> of it\n" * (k % 7)) for k in range(300)]
    out = fill_middle.fill_in_middle(documents(spark, rows))
    check(out)
    assert {r.form for r in out.select("fim.form").distinct().collect()} == {"plain", "psm", "spm"}


def test_keeps_columns_and_replaces_its_own(spark):
    docs = documents(spark).withColumn("fim", F.lit(1))
    out = fill_middle.fill_in_middle(docs)
    assert out.columns == docs.columns and out.count() == docs.count()


def test_empty(spark):
    assert fill_middle.fill_in_middle(documents(spark, [])).count() == 0


@pytest.mark.parametrize("k", [0, 1, 5, 10**9])
def test_cuts_of_slices(k):
    texts = ["", "ab", "", "é", "a b", "", "日本x語", "x" * 20, ""] * 3
    raw, starts = text_buffers(pa.array(texts))
    units = fill_middle.Units(raw, starts[3:-2])
    cut = units.cut(np.minimum(k, units.n_units()))
    for text, begin, at in zip(texts[3:-2], units.offsets, cut, strict=False):
        want = "".join(UNIT.findall(text)[:k]).encode()
        assert int(at) - int(begin) == len(want)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="aZ@[`{ é日😀\x00\n", max_size=30), min_size=1, max_size=6), st.randoms())
def test_units_equal_the_pattern(texts, random):
    raw, starts = text_buffers(pa.array(texts, pa.string()))
    h1 = np.array([random.randrange(1 << 32) for _ in texts])
    h2 = np.array([random.randrange(1 << 32) for _ in texts])
    found = np.stack(fill_middle.find_cuts(raw, starts, h1, h2), axis=1).tolist()
    for text, a, b, got in zip(texts, h1.tolist(), h2.tolist(), found, strict=True):
        units = UNIT.findall(text)
        lo, hi = sorted((a % (len(units) + 1), b % (len(units) + 1)))
        assert got == [len(units), len("".join(units[:lo])), len("".join(units[lo:hi]))]


def test_one_very_long_text_takes_linear_time():
    raw, starts = text_buffers(pa.array(["añb " * 5_000_000]))
    began = time.perf_counter()
    n, prefix, _ = fill_middle.find_cuts(raw, starts, np.array([12_345_678]), np.array([19_999_999]))
    assert time.perf_counter() - began < 20
    assert n[0] == 20_000_000 and prefix[0] == 12_345_678
