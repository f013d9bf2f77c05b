import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from cases import DOCS, documents
from tokenizers import Tokenizer

from panelspark.llm import packing
from panelspark.llm.common import read
from panelspark.llm.queries import op8_best_fit_packing

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "Ünïcode ĞİŞ ŉ ǆ", "Hello<|endoftext|>World", "<|startoftext|> <|STARTOFTEXT|>", "日本語 テスト 　 x", "ΣΑΣ Ος",
    "a\x1cb \x85c\xa0d", "It's I'LL we've 'd 123 4½ ²", "é café", "Å ẞ ß", "tab\tnew\r\nline  x", " lead trail ",
    "!!!?? ##$% _a_ a_b", "😀 👍🏽 x", "​ zero​width", "İstanbul ıI", "\x00 \x7f nul", "1234567890",
]


@pytest.fixture(scope="module")
def whole():
    return Tokenizer.from_file(PATH)


def ids_of(whole, text):
    return np.asarray([*whole.encode(text or "", add_special_tokens=False).ids, 1], "<u4").tobytes()


@pytest.mark.parametrize("cache_bytes", [0, 2000, 1 << 27])
@pytest.mark.parametrize("run", [4, 100, 1 << 20])
def test_ids_equal_the_tokenizer(whole, cache_bytes, run):
    ids = packing.Ids(PATH, cache_bytes)
    for text in ODD + ODD + [t or "" for _, t in DOCS]:
        assert ids.of(text, run) + np.asarray([1], "<u4").tobytes() == ids_of(whole, text), text[:40]


def test_kept_units_are_bounded_by_bytes():
    ids = packing.Ids(PATH, 50_000)
    for k in range(400):
        ids.of(f"unit{k} " + "日" * 200 + f"{k} " + "x" * 300)
    held = sum(packing.ENTRY_BYTES + 2 * len(u) + len(v) for d in (ids.plain, ids.other) for u, v in d.items())
    assert held <= 50_000 + 2000 and max(map(len, [*ids.plain, *ids.other])) <= packing.KEPT


def test_each_capacity_rejects_a_sequence():
    lengths, weights = np.array([50, 30, 20, 10, 10, 5]), np.ones(3)
    def opened(*capacity):
        sequence, _ = packing.best_fit(lengths, np.array(capacity, float), weights)
        return len(set(sequence.tolist()))
    assert opened(125, 6, 125**2) == 1
    assert opened(124, 6, 125**2) == 2  # tokens
    assert opened(125, 5, 125**2) == 2  # documents
    assert opened(125, 6, int((lengths**2).sum()) - 1) == 2  # attention


def test_random_texts_equal_the_tokenizer(whole):
    random.seed(8)
    ids = packing.Ids(PATH)
    alphabet = "abcXYZ éÉßñİı'’.,!?09_-<|>\n\t ́日Σσς"
    for _ in range(3000):
        text = "".join(random.choice(alphabet) for _ in range(random.randint(0, 20)))
        assert ids.of(text) + b"\1\0\0\0" == ids_of(whole, text), repr(text)


def check(rows, tokens):
    by_sequence = defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= tokens
    return len(by_sequence)


def test_edge_cases_round_trip(spark, whole):
    docs = documents(spark)
    rows = packing.pack_documents(docs, PATH, tokens=64).collect()
    check(rows, 64)
    wanted = []
    for i, text in DOCS:
        data = ids_of(whole, text)
        for piece, at in enumerate(range(0, len(data), 256)):
            part = data[at : at + 256]
            wanted.append((i, piece, at // 4, len(part) // 4, zlib.crc32(part)))
    got = [(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows]
    assert sorted(got, key=repr) == sorted(wanted, key=repr)
    assert packing.pack_documents(documents(spark, []), PATH).count() == 0


def test_sequences_hold_the_ids(spark, whole):
    pieces = packing.tokenise(documents(spark), PATH, tokens=64, with_ids=True)
    pieces = packing.Steps(spark, "test").store(pieces, "pieces")
    placed = packing.Steps(spark, "test").store(packing.pack(pieces, tokens=64), "placed")
    rows = packing.sequences(pieces, placed).collect()
    assert sum(len(r.ids) for r in rows) == sum(len(ids_of(whole, t)) for _, t in DOCS)
    for r in rows:
        assert len(r.ids) == 4 * sum(p.length for p in r.pieces) <= 256


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_every_capacity_holds(spark, rule):
    random.seed(1)
    lengths = [(k, 0, random.randint(1, 100)) for k in range(2000)]
    pieces = spark.createDataFrame(lengths, "row_id long, piece int, length long")
    placed = packing.pack(pieces, 100, documents=5, attention=5000 + 5000, rule=rule, bucket=300).collect()
    length_of = {k: n for k, _, n in lengths}
    held = defaultdict(list)
    for r in placed:
        held[r.sequence_id].append(length_of[r.row_id])
    assert len(placed) == 2000
    for h in held.values():
        assert sum(h) <= 100 and len(h) <= 5 and sum(n * n for n in h) <= 10_000


def test_a_piece_over_a_capacity_is_an_error():
    with pytest.raises(ValueError):
        packing.best_fit(np.array([10]), np.array([20.0, 5.0, 50.0]), np.ones(3))


def test_few_sequences(spark):
    random.seed(2)
    lengths = [(k, 0, random.randint(1, 1500)) for k in range(20_000)]
    pieces = spark.createDataFrame(lengths, "row_id long, piece int, length long")
    n = packing.pack(pieces, 4096).select("sequence_id").distinct().count()
    assert n <= 1.002 * sum(x[2] for x in lengths) / 4096 + 1


def test_query_round_trip(spark, sf_dir, whole):
    rows = op8_best_fit_packing(spark, sf_dir).collect()
    n = check(rows, 4096)
    texts = {r.doc_id: r.text for r in read(spark, sf_dir, "documents").select("doc_id", "text").collect()}
    pieces = defaultdict(dict)
    for r in rows:
        pieces[r.doc_id][r.piece] = r
    assert pieces.keys() == texts.keys()
    for doc_id, text in texts.items():
        data = ids_of(whole, text)
        cut = [data[at : at + 4 * 4096] for at in range(0, len(data), 4 * 4096)]
        own = [pieces[doc_id][k] for k in range(len(cut))]
        assert [(r.length, r.ids_crc32) for r in own] == [(len(c) // 4, zlib.crc32(c)) for c in cut]
    assert n <= 1.01 * sum(r.length for r in rows) / 4096 + 1
