import pyarrow as pa
import pytest
from cases import BASE, DOCS, contaminated, documents

from panelspark.llm import decontaminate
from panelspark.llm.common import read, text_buffers
from panelspark.llm.queries import op3_decontamination

ITEMS = [
    (1, BASE),
    (2, "lazy dog"),
    (2, "lazy dog"),
    (3, "one"),
    (4, None),
    (5, ""),
    (None, "holds some words"),
    (6, "the same id with another text and more words than that has"),
    (7, "Jumps OVER the lazy dog and runs far away from"),
    (8, "w5x5 w6x6 w7x7 w8x8"),
]


def found(spark, docs, items):
    table = spark.createDataFrame(items, "item_id long, text string")
    rows = decontaminate.decontaminate(docs, table).collect()
    return sorted(((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in rows), key=repr)


def wanted(rows, items):
    counted = contaminated([t for _, t in rows], items)
    return sorted(((i, *c) for (i, _), c in zip(rows, counted, strict=True)), key=repr)


def test_edge_cases_equal_brute_force(spark):
    assert found(spark, documents(spark), ITEMS) == wanted(DOCS, ITEMS)


def test_empty_tables(spark):
    assert found(spark, documents(spark, []), ITEMS) == []
    assert found(spark, documents(spark), []) == wanted(DOCS, [])


@pytest.mark.parametrize("window", [1, 3, 10])
def test_other_windows(spark, window):
    table = spark.createDataFrame(ITEMS, "item_id long, text string")
    rows = decontaminate.decontaminate(documents(spark), table, window=window).collect()
    got = sorted(((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in rows), key=repr)
    counted = contaminated([t for _, t in DOCS], ITEMS, window)
    assert got == sorted(((i, *c) for (i, _), c in zip(DOCS, counted, strict=True)), key=repr)


def test_passage_shared_by_many(spark):
    rows = [(k, f"doc {k} {BASE} end") for k in range(500)] + [(1000 + k, f"clean {k}") for k in range(500)]
    assert found(spark, documents(spark, rows), ITEMS) == wanted(rows, ITEMS)


def test_stage_keeps_clean_rows_and_columns(spark):
    docs = documents(spark)
    table = spark.createDataFrame(ITEMS, "item_id long, text string")
    kept = decontaminate.clean_documents(docs, table)
    assert kept.columns == docs.columns
    counted = contaminated([t for _, t in DOCS], ITEMS)
    clean = [i for (i, _), c in zip(DOCS, counted, strict=True) if not c[1]]
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted(clean, key=repr)


def test_query_equals_brute_force(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select("doc_id", "text").collect()
    items = [tuple(r) for r in read(spark, sf_dir, "benchmark").select("item_id", "text").collect()]
    counted = contaminated([r.text for r in rows], items)
    wanted = {r.doc_id: c[:2] + (len(c[2]),) for r, c in zip(rows, counted, strict=True)}
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items) for r in op3_decontamination(spark, sf_dir).collect()}
    assert got == wanted and any(c[1] for c in wanted.values())


def test_long_texts_are_read_in_pieces(spark):
    """Windows that lie across the borders of pieces, and items of one frequent word."""
    rows, items = [], [(1, BASE), (2, "the"), (3, "river the"), (4, "a b c d e f"), (5, "x")]
    for k in range(12):
        filler = " ".join(f"f{n}" for n in range(40 + 7 * k))
        rows.append((k, f"{filler} {BASE} {filler} a b c d e f {'x ' * 50} {BASE} the river the".strip()))
    table = spark.createDataFrame(items, "item_id long, text string")
    out = []
    for piece in (256, 2000, 1 << 22):
        got = decontaminate.decontaminate(documents(spark, rows), table, piece=piece).collect()
        out.append(sorted(((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in got), key=repr))
    counted = contaminated([t for _, t in rows], items)
    assert out == [sorted(((i, *c) for (i, _), c in zip(rows, counted, strict=True)), key=repr)] * 3


def piece_hits(text, items, size):
    """Hits of the shingles of one text, read in pieces of this size."""
    raw, starts = text_buffers(pa.array([text]))
    out = []
    for _, _, words, offset, own, end in decontaminate.word_pieces(raw, starts, 5, 9, size):
        grams, at = words.grams(5)
        keep = (at >= own) & (at < end)
        for g, k in zip(grams[keep].tolist(), at[keep].tolist(), strict=True):
            out.append((g, k + offset, [words.word(x) for x in range(max(0, k - 5), min(len(words.hash), k + 10))]))
    return out


def test_pieces_carry_the_words_around():
    text = " ".join(f"w{n}" for n in range(900))
    assert piece_hits(text, None, 1 << 22) == piece_hits(text, None, 256) == piece_hits(text, None, 2000)


def test_one_text_of_one_frequent_word(spark):
    rows = [(1, "the " * 200_000 + BASE), (2, "none of it")]
    assert found(spark, documents(spark, rows), [(1, "the"), (2, BASE)]) == wanted(rows, [(1, "the"), (2, BASE)])
