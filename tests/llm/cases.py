"""Fixtures and brute-force forms shared by the tests of the text operators."""

from __future__ import annotations

import re
from collections import defaultdict

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LONG = " ".join(f"w{k % 977}x{k}" for k in range(30_000))
BASE = "the quick brown fox jumps over the lazy dog and runs far away from the old stone house by the river"

#: (doc_id, text): nulls, empty and long texts, repeated rows, repeated ids, ties.
DOCS = [
    (1, BASE),
    (2, BASE),
    (2, BASE),
    (3, BASE + " today"),
    (4, None),
    (5, ""),
    (5, ""),
    (None, "a row without an id holds some words"),
    (6, "   \n\t "),
    (7, LONG),
    (8, "one"),
    (9, "ONE"),
    (10, "Ünïcödé 日本語 текст 😀 \x1f end"),
    (2, "the same id with another text"),
]
CLASHING = ["row_id", "score", "text_key", "bucket", "blob", "spans", "key", "slot", "n_words", "label", "__id"]


def documents(spark, rows=None, extra=True):
    """The rows as a table, with columns whose names operators use inside."""
    rows = DOCS if rows is None else rows
    names = CLASHING if extra else []
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    schema += "".join(f", {n} string" for n in names)
    full = [(i, t, "en", "src", len(t or ""), *["x"] * len(names)) for i, t in rows]
    return spark.createDataFrame(full, schema).repartition(3)


def lower(text: str | None) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words(text: str | None) -> list[str]:
    return WORD.findall(lower(text))


def grams(text: str | None, n: int = 5) -> frozenset:
    w = words(text)
    return frozenset(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))) if w else frozenset()


def links(texts: list[str | None], threshold: float = 0.8) -> tuple[list[int], list[int]]:
    """(number of links, first row of the class) of each row, by comparing all pairs that share a gram."""
    sets = [grams(t) for t in texts]
    holders = defaultdict(list)
    for k, s in enumerate(sets):
        for g in s or {None}:
            holders[g].append(k)
    top = list(range(len(texts)))

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    found = [0] * len(texts)
    for a, b in {(a, b) for held in holders.values() for a in held for b in held if a < b}:
        union = len(sets[a] | sets[b])
        if not union or len(sets[a] & sets[b]) / union >= threshold:
            found[a] += 1
            found[b] += 1
            x, y = sorted((root(a), root(b)))
            top[y] = x
    return found, [root(k) for k in range(len(texts))]


def contaminated(texts, items, window: int = 10):
    """(words, hit words, item ids) of each text."""
    wanted = defaultdict(set)
    for item, text in items:
        w = words(text)
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            wanted[tuple(w[k : k + n])].add(item)
    sizes = {len(k) for k in wanted}
    out = []
    for text in texts:
        w, hit, found = words(text), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                run = tuple(w[k : k + n])
                if run in wanted:
                    hit.update(range(k, k + n))
                    found |= wanted[run]
        out.append((len(w), len(hit), sorted(str(i) for i in found if i is not None)))
    return out
