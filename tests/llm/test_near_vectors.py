import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.llm import near_vectors
from panelspark.llm.common import Steps, read

NAN, INF = float("nan"), float("inf")
ODD = [
    (1, [1.0, 0.0, 0.0]),
    (2, [2.0, 0.0, 0.0]),
    (2, [1.0, 0.0, 0.0]),
    (3, None),
    (4, []),
    (5, [0.0, 0.0, 0.0]),
    (5, [0.0, 0.0, 0.0]),
    (6, [None, 1.0, 0.0]),
    (7, [NAN, 1.0, 0.0]),
    (8, [INF, 0.0, 0.0]),
    (9, [1.0, 0.0]),
    (10, [1.0, -0.0]),
    (None, [0.0, 1.0, 0.0]),
    (None, [0.0, 3.0, 0.1]),
    (None, [0.0, 0.0, 1.0]),
    (11, [-1.0, 0.0, 0.0]),
    (12, [1e200, 1e190, 0.0]),
    (13, [1e-300, 0.0, 0.0]),
]


def brute(rows, threshold=0.95):
    """Rows (vec_id, n_links, component_id, kept) by comparing all pairs."""

    def unit(v):
        if not v or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            return None
        x = np.array(v, float) / np.abs(v).max()
        return x / np.sqrt((x * x).sum())

    units = [unit(None if v is None else list(v)) for _, v in rows]
    top = list(range(len(rows)))

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    links = [0] * len(rows)
    for a in range(len(rows)):
        for b in range(a):
            u, v = units[a], units[b]
            if u is not None and v is not None and len(u) == len(v) and (u * v).sum() >= threshold:
                links[a] += 1
                links[b] += 1
                x, y = sorted((root(a), root(b)))
                top[y] = x
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root(k)] = min(i, least.get(root(k), i))
    named = [least.get(root(k)) for k in range(len(rows))]
    return sorted(
        ((i, n, c, i == c) for (i, _), n, c in zip(rows, links, named, strict=True)), key=repr
    )


def table(spark, rows, element="double"):
    extra = "node string, dim string, root string, n_links string"
    full = [(i, None if v is None else [x if x is None else float(x) for x in v], *"abcd") for i, v in rows]
    df = spark.createDataFrame(full, f"vec_id long, embedding array<double>, {extra}")
    return df.withColumn("embedding", F.col("embedding").cast(f"array<{element}>")).repartition(3)


def got(df):
    return sorted((tuple(r) for r in df.select("vec_id", "n_links", "component_id", "kept").collect()), key=repr)


def clusters(n_alone, sizes, dim=24, seed=3, noise=0.25):
    """Random vectors, and groups around random centres whose members differ by about the threshold's angle."""
    draw = np.random.default_rng(seed)
    out = [draw.standard_normal(dim) for _ in range(n_alone)]
    for size in sizes:
        centre = draw.standard_normal(dim)
        centre /= np.linalg.norm(centre)
        spread = draw.standard_normal((size, dim)) * noise / math.sqrt(dim)
        out += list(centre + spread * draw.random((size, 1)) * 1.4)
    order = draw.permutation(len(out))
    return [(int(k) * 3, np.float32(out[j]).tolist()) for k, j in enumerate(order)]


def test_edge_cases_equal_brute_force(spark):
    assert got(near_vectors.near_vectors(table(spark, ODD))) == brute(ODD)


def test_integers_are_vectors(spark):
    rows = [(1, [1, 2, 3]), (2, [2, 4, 6]), (3, [3, -2, 1])]
    assert got(near_vectors.near_vectors(table(spark, rows, "int"))) == brute(rows)


def test_empty(spark):
    assert got(near_vectors.near_vectors(table(spark, []))) == []


@pytest.mark.parametrize("options", [{}, {"block": 16}, {"window": 20, "edge_rows": 100}, {"window": 64, "block": 50}])
def test_equals_brute_force(spark, options):
    rows = clusters(150, [2, 3, 5, 40, 90])
    rows += [(1000 + k, rows[0][1]) for k in range(25)]
    found = got(near_vectors.near_vectors(table(spark, rows, "float"), recall=0.9999, **options))
    assert found == brute(rows)


def test_a_group_larger_than_the_window_keeps_every_link(spark):
    rows = clusters(20, [150], noise=0.15)
    found = got(near_vectors.near_vectors(table(spark, rows, "float"), window=8, passes=12, block=32))
    assert found == brute(rows)
    assert max(r[1] for r in found) > 100


def test_measured_passes_reach_the_recall(spark):
    """Pairs at the threshold among random vectors, with windows far smaller than the table."""
    draw = np.random.default_rng(8)
    alone = draw.standard_normal((6000, 32))
    base = draw.standard_normal((600, 32))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    side = draw.standard_normal(base.shape)
    side -= (side * base).sum(axis=1, keepdims=True) * base
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    near = base * 0.951 + side * math.sqrt(1 - 0.951**2)
    rows = [(k, v.tolist()) for k, v in enumerate(np.concatenate([base, near, alone]))]
    found = near_vectors.near_vectors(table(spark, rows), window=32, recall=0.98)
    linked = {r.vec_id for r in found.filter("n_links > 0").collect()}
    assert len(linked & set(range(600))) >= 0.95 * 600


def test_depth_gives_passes():
    assert near_vectors.choose_passes({}, 0.95, 0.998) == 1
    few = near_vectors.choose_passes({5: 100}, 0.95, 0.99)
    many = near_vectors.choose_passes({5: 50, 12: 50}, 0.95, 0.99)
    same = 1 - math.acos(0.95) / math.pi
    assert (1 - same**5) ** few <= 0.01 < (1 - same**5) ** (few - 1) and many > few


def test_screen_keeps_pairs_at_the_threshold():
    limit = near_vectors.most_bits(256, math.acos(0.95) / math.pi)
    draw = np.random.default_rng(1)
    x = draw.standard_normal((4000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    side = draw.standard_normal(x.shape)
    side -= (side * x).sum(axis=1, keepdims=True) * x
    y = 0.95 * x + math.sqrt(1 - 0.95**2) * side / np.linalg.norm(side, axis=1, keepdims=True)
    differ = np.bitwise_count((near_vectors._bits(x, (1,), 4) ^ near_vectors._bits(y, (1,), 4)).view(np.uint64))
    assert (differ.sum(axis=1, dtype=int) <= limit).all()


def test_connect_equals_union():
    draw = np.random.default_rng(2)
    for _ in range(50):
        a, b = draw.integers(0, 60, (2, 40))
        label = np.arange(60)
        near_vectors.connect(label, a, b)
        plain = list(range(60))
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            low, high = sorted((plain[x], plain[y]))
            plain = [low if p == high else p for p in plain]
        assert label.tolist() == plain


def test_windows_over_many_partitions_miss_nothing(spark):
    """One pass whose window spans the table compares all pairs, however the order is cut."""
    rows = clusters(60, [3, 4, 30])
    steps = Steps(spark, "test")
    nodes = table(spark, rows, "float").selectExpr("vec_id AS node", "size(embedding) AS dim", "embedding AS vector")
    nodes = steps.store(nodes, "nodes")
    limit = near_vectors.most_bits(256, math.acos(0.95) / math.pi)
    found = near_vectors.candidate_groups(steps, nodes, 1, len(rows), limit).collect()
    groups = {}
    for r in found:
        groups.setdefault(r["group"], set()).add(r["node"])
    linked = {i for i, n, _, _ in brute(rows) if n}
    assert linked <= set().union(*groups.values())


def test_query_equals_brute_force(spark, sf_dir):
    from panelspark.llm.queries import op11_embedding_near_dedup

    rows = [(r.vec_id, r.embedding) for r in read(spark, sf_dir, "embeddings").collect()]
    assert got(op11_embedding_near_dedup(spark, sf_dir)) == brute(rows)
