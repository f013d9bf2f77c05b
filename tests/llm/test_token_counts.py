import random

import public_tokenizers
import pytest
from cases import DOCS, documents
from tokenizers import Tokenizer, models, pre_tokenizers

from panelspark.llm import token_counts
from panelspark.llm.common import read

PATH = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [t or "" for _, t in DOCS] + [
    " ", "  a  b ", "日本語 ключ Ω≈ç", "<unk> <0x41>", "\n\n x\n", "▁a▁ b", "😀😀 x😀", "áé", "͸͹ q", "aaaaaaaaab",
]


def library(pieces, byte_fallback):
    made = Tokenizer(models.Unigram(pieces, 0, byte_fallback))
    made.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    return made


@pytest.mark.parametrize("byte_fallback", [True, False])
@pytest.mark.parametrize("ties", [False, True])
def test_counts_equal_the_library(byte_fallback, ties):
    pieces = token_counts.vocabulary(PATH)
    if ties:
        random.seed(1)
        pieces = [(p, -float(random.randint(1, 3) * max(1, len(p)))) for p, _ in pieces]
    counter = token_counts.Counter(pieces, 0, byte_fallback)
    made = library(pieces, byte_fallback)
    texts = [t for t in TEXTS if not (byte_fallback and "<unk>" in t)]
    wanted = [len(e.ids) for e in made.encode_batch(texts, add_special_tokens=False)]
    assert [sum(counter.count(w)[0] for w in token_counts.words_of(t)) for t in texts] == wanted


def test_random_small_vocabularies():
    random.seed(7)
    for _ in range(200):
        pieces = {"<unk>": 0.0}
        for _ in range(random.randint(1, 12)):
            piece = "".join(random.choice("▁abc") for _ in range(random.randint(1, 4)))
            pieces[piece] = -float(random.randint(1, 5))
        pieces = list(pieces.items())
        counter, made = token_counts.Counter(pieces, 0, False), library(pieces, False)
        for _ in range(20):
            text = "".join(random.choice("abcd ") for _ in range(random.randint(0, 12)))
            got = sum(counter.count(w)[0] for w in token_counts.words_of(text))
            assert got == len(made.encode(text, add_special_tokens=False).ids), (pieces, text)


def test_table(spark):
    made = library(token_counts.vocabulary(PATH), True)
    rows = token_counts.count_tokens(documents(spark), PATH, cache_bytes=2000).collect()
    wanted = sorted(((i, len(made.encode(t or "").ids)) for i, t in DOCS), key=repr)
    assert sorted(((r.doc_id, r.n_tokens) for r in rows), key=repr) == wanted
    assert token_counts.count_tokens(documents(spark, []), PATH).count() == 0


def test_query_equals_the_library(spark, sf_dir):
    made = library(token_counts.vocabulary(PATH), True)
    docs = read(spark, sf_dir, "documents")
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs, PATH).collect()}
    rows = docs.select("doc_id", "text").collect()
    sizes = made.encode_batch([r.text for r in rows])
    assert got == {r.doc_id: len(e.ids) for r, e in zip(rows, sizes, strict=True)}


def test_long_words_and_texts_are_read_in_runs(monkeypatch):
    pieces = token_counts.vocabulary(PATH)
    counter, made = token_counts.Counter(pieces), library(pieces, True)
    random.seed(5)
    word = "".join(random.choice("abcdeé日") for _ in range(30_000))
    assert counter.count("▁" + word)[0] == len(made.encode(word, add_special_tokens=False).ids)
    text = " ".join(random.choice(["ab", "", "the▁", "x" * 70, "日本", word[:300]]) for _ in range(3000))
    wanted = len(made.encode(text, add_special_tokens=False).ids)
    for size in (1, 50, 1000, 1 << 20):
        words = [w for run in token_counts.runs_of(text, size) for w in run]
        assert sum(counter.count("▁" + w)[0] for w in words) == wanted
        known = token_counts.Known(counter, 4000)
        assert known.total(text)[0] == wanted and all(len(w) <= token_counts.KEPT for w in known.kept)


@pytest.mark.parametrize("text", ["a1b2" * 2_500_000, "word " * 2_000_000, "日" * 3_000_000], ids=["word", "words", "cjk"])
def test_very_long_texts_take_linear_time_and_little_memory(text):
    import time
    import tracemalloc

    counter = token_counts.Counter(token_counts.vocabulary(PATH))
    known = token_counts.Known(counter, token_counts.CACHE_BYTES)
    part = text[: len(text) // 10]
    tracemalloc.start()
    known.total(part)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 120 << 20
    began = time.process_time()
    known.total(text)
    assert time.process_time() - began < 100
