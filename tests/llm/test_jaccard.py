import os
import random
from collections import Counter

import pytest
from cases import BASE, DOCS, documents, links

from panelspark.llm import jaccard
from panelspark.llm.common import Steps, read
from panelspark.llm.queries import op4_jaccard_join

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def compare(rows, docs_rows):
    """Counts and classes by brute force, classes named by their smallest id."""
    counts, first = links([t for _, t in docs_rows])
    named = {}
    for (i, _), f in zip(docs_rows, first, strict=True):
        if i is not None:
            named[f] = min(i, named.get(f, i))
    wanted = Counter((i, named.get(f), n) for (i, _), f, n in zip(docs_rows, first, counts, strict=True))
    assert Counter((r.doc_id, r.class_id, r.n_links) for r in rows) == wanted


def test_bands_reach_the_recall():
    for threshold in (0.5, 0.8, 0.95):
        bands, rows = jaccard.choose_bands(threshold, 0.99)
        assert 1 - (1 - threshold**rows) ** bands >= 0.99 and bands * rows <= jaccard.MAX_HASHES


def test_edge_cases_equal_brute_force(spark):
    rows = jaccard.jaccard_join(documents(spark)).collect()
    compare(rows, DOCS)


def test_empty(spark):
    assert jaccard.jaccard_join(documents(spark, [])).count() == 0


def near_copies(n, size=150):
    random.seed(9)
    base = [f"w{k}" for k in range(size)]
    out = []
    for k in range(n):
        text = list(base)
        for _ in range(random.randrange(4)):
            text[random.randrange(size)] = f"y{random.randrange(60)}"
        out.append((k, " ".join(text)))
    return out


@pytest.mark.parametrize("block", [2048, 40])
def test_near_copies_keep_every_link(spark, block):
    rows = near_copies(160) + [(1000 + k, f"alone {k} " * 7) for k in range(20)]
    found = jaccard.jaccard_join(documents(spark, rows), recall=0.999999, block=block).collect()
    compare(found, rows)


def test_long_near_copies_keep_every_link(spark):
    rows = near_copies(160) + [(1000 + k, f"alone {k} " * 7) for k in range(20)]
    found = jaccard.jaccard_join(documents(spark, rows), recall=0.999999, block_bytes=10_000).collect()
    compare(found, rows)


def test_groups_are_bounded_in_bytes(spark):
    """A gathering of 200 long texts, 300 pairs of them, and one gathering of two texts beyond the bound."""
    many = [(k, 1_000_000, 0, 7, 200, 200_000_000) for k in range(200)]
    pairs = [(1000 + k, 1_000_000, 0, 100 + k // 2, 2, 2_000_000) for k in range(600)]
    two = [(9000 + k, 90_000_000, 0, 9, 2, 180_000_000) for k in range(2)]
    schema = "node long, size long, band int, hash long, members long, bytes long"
    members = spark.createDataFrame(many + pairs + two, schema)
    placed = jaccard._place(members, 2048, 16_000_000, 16_000_000).join(members.select("node", "size"), "node")
    groups = {}
    for r in placed.collect():
        groups.setdefault(r.bin, []).append(r)
    assert max(sum(r["size"] for r in g) for g in groups.values() if g[0].hash != 9) <= 64_000_000
    assert all(len(g) <= 2 for g in groups.values() if g[0].hash == 9)
    met = {(a.node, b.node) for g in groups.values() for a in g for b in g if a.hash == b.hash and a.node < b.node}
    assert len(met) == 200 * 199 // 2 + 300 + 1


def test_chains_join_one_class(spark):
    words = [f"c{k}" for k in range(400)]
    rows = [(k, " ".join(words[k * 4 : k * 4 + 120])) for k in range(60)]
    found = jaccard.jaccard_join(documents(spark, rows), recall=0.999999).collect()
    compare(found, rows)
    assert len({r.class_id for r in found}) == 1


def test_recall_of_pairs_near_the_threshold(spark):
    random.seed(4)
    rows = []
    for k in range(400):
        words = [f"p{k}w{j}" for j in range(204)]
        rows.append((2 * k, " ".join(words)))
        other = list(words)
        for j in (20, 60, 100, 140):  # 20 of 200 shingles differ on each side: 180 / 220
            other[j] = f"q{k}w{j}"
        rows.append((2 * k + 1, " ".join(other)))
    found = jaccard.jaccard_join(documents(spark, rows)).collect()
    linked = sum(r.n_links for r in found) / 800
    assert linked >= 0.99


def test_one_of_each_class_stays(spark):
    docs = documents(spark)
    kept = jaccard.one_per_class(docs)
    assert kept.columns == docs.columns
    _, first = links([t for _, t in DOCS])
    text_of = [t for _, t in DOCS]
    classes = {}
    for f, t in zip(first, text_of, strict=True):
        classes.setdefault(t or "", f)
    got = [classes[r.text or ""] for r in kept.collect()]
    assert sorted(got) == sorted(set(first))


def test_query_equals_brute_force(spark, sf_dir):
    rows = [tuple(r) for r in read(spark, sf_dir, "documents").select("doc_id", "text").collect()]
    found = op4_jaccard_join(spark, sf_dir).collect()
    compare(found, rows)
    assert all(r.class_size >= 1 for r in found)


def test_brute_force_of_base():
    assert links([BASE, BASE])[0] == [1, 1]


def test_components_of_stars_and_chains(spark):
    rng = random.Random(3)
    pairs = [(0, k) for k in range(1, 3000)]  # one node holds most of the edges
    pairs += [(10_000 + k, 10_001 + k) for k in range(40)]
    pairs += [(20_000 + rng.randrange(300), 20_000 + rng.randrange(300)) for _ in range(200)]
    parent = {x: x for pair in pairs for x in pair}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)
    edges = spark.createDataFrame(pairs, "node long, root long")
    found = {r.node: r.root for r in jaccard.components(Steps(spark, "stars"), edges).collect()}
    assert found == {x: top(x) for x in parent if top(x) != x}


def test_a_group_of_linked_members_stays_in_memory():
    """4,096 linked members in the last band: the memory beside the input."""
    import subprocess
    import sys

    code = """
import resource, sys
import numpy as np, pandas as pd
from panelspark.llm import jaccard
m = 4096
base = [f"w{k}" for k in range(100)]
rows = []
draw = np.random.default_rng(1)
for k in range(m):
    text = list(base)
    text[int(draw.integers(100))] = f"y{k}"
    rows.append(" ".join(text))
bands = [draw.integers(0, 1 << 60, 21) for _ in range(m)]
pdf = pd.DataFrame({"node": np.arange(m), "copies": 1, "bands": bands, "text": rows, "band": 20, "hash": 7,
  "block_a": 0, "block_b": 1, "block": np.arange(m) % 2})
start = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
out = jaccard._verify(pdf, 5, 0.8)
assert len(out) == m and (out.links > 1900).all() and (out.root == 0).all()
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - start) // 1024)
"""
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=ROOT)
    assert int(done.stdout) < 300


def test_long_texts_are_cut_without_a_difference(monkeypatch):
    import numpy as np
    import pyarrow as pa

    from panelspark.llm import wordhash
    from panelspark.llm.common import text_buffers

    random.seed(3)
    texts = [
        " ".join(random.choice(["a", "bb", "日本", "x" * 90, "--", "Zq9"]) for _ in range(n)) for n in (0, 3, 40, 900, 4000)
    ] + ["w" * 5000, " " * 3000 + "one two " + " " * 4000, "-" * 3000, "one two three four five " * 400]
    raw, starts = text_buffers(pa.array(texts))
    for k in range(len(texts)):
        whole = wordhash.Words(raw, starts[k : k + 2])
        grams, at = whole.grams(5)
        for size in (64, 500, 1 << 22):
            seen = {}
            for _, _, words, offset, own, end in wordhash.word_pieces(raw, starts[k : k + 2], 2, 4, size):
                values, first = words.grams(5)
                for v, f in zip(values.tolist(), first.tolist(), strict=True):
                    if own <= f < end:
                        assert offset + f not in seen
                        seen[offset + f] = v
                assert words.hash[own:end].tolist() == whole.hash[offset + own : offset + end].tolist()
                lead = min(2, offset + own)
                assert size >= len(texts[k].encode()) or own == lead
            assert seen == dict(zip(at.tolist(), grams.tolist(), strict=True))
    sets, owner = jaccard.gram_sets(raw, starts, 5)
    monkeypatch.setattr(wordhash.word_pieces, "__defaults__", (0, 0, 300))
    again, owners = jaccard.gram_sets(raw, starts, 5)
    each = [jaccard.gram_sets(raw, starts[k : k + 2], 5)[0].tolist() for k in range(len(texts))]
    assert each == [sets[owner == k].tolist() for k in range(len(texts))]
    assert again.tolist() == sets.tolist() and owners.tolist() == owner.tolist()


def test_a_word_longer_than_a_piece_has_its_hash(monkeypatch):
    import numpy as np

    from panelspark.llm import wordhash

    text = np.frombuffer(("ab " + "x" * 3000 + " " + "y" * 5 + " z" * 900).encode(), np.uint8)
    plain = wordhash.Words(text, np.array([0, len(text)])).hash
    monkeypatch.setattr(wordhash, "PIECE", 64)
    monkeypatch.setattr(wordhash, "_powers", [])
    assert wordhash.Words(text, np.array([0, len(text)])).hash.tolist() == plain.tolist()
