"""Grouping sets, hierarchies, first rows, sketches, versions and streams."""

import datetime
import os
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from helpers import plan, rows
from panelspark.operators import hierarchy, refresh, rollups, sketches, topn
from panelspark.plans import catalog
from panelspark.sources import schemas
from panelspark.streaming.windows import append_closed, stream, window_totals

# Levels


def test_cube_equals_loops(spark):
    draw = random.Random(1)
    table = [
        (draw.choice(["a", "b", None]), draw.choice([1, 2, None]), draw.choice("xy"), draw.choice([None, 1.0, 5.0, -2.0]))
        for _ in range(80)
    ]
    df = spark.createDataFrame(table, "d string, e int, f string, v double").repartition(4)
    measures = {"n": ("count", "v"), "s": ("sum", "v"), "low": ("min", "v"), "high": ("max", "v"), "mean": ("avg", "v")}
    got = rollups.grouped_levels(df, ["d", "e", "f"], measures, rollups.cube_sets(["d", "e", "f"])).collect()
    groups = defaultdict(list)
    for *dims, v in table:
        for level in range(8):
            totals = tuple(level >> k & 1 for k in (2, 1, 0))
            key = tuple(None if t else d for d, t in zip(dims, totals, strict=True))
            groups[key, totals, level].append(v)
    assert len(got) == len(groups)
    for r in got:
        known = [v for v in groups[(r.d, r.e, r.f), (r.d_total, r.e_total, r.f_total), r.level] if v is not None]
        assert r.n == len(known)
        if known:
            assert (r.s, r.low, r.high) == (sum(known), min(known), max(known))
            assert r["mean"] == pytest.approx(sum(known) / len(known))
        else:
            assert (r.s, r.low, r.high, r["mean"]) == (None,) * 4


def test_rollup_of_an_empty_table_has_the_grand_total_only(spark):
    df = spark.createDataFrame([], "d string, v int")
    got = rollups.grouped_levels(df, ["d"], {"n": ("count", "v"), "s": ("sum", "v")}, rollups.rollup_sets(["d"]))
    assert [tuple(r) for r in got.collect()] in ([], [(None, 1, 1, 0, None)])


def test_levels_are_summed_from_the_finest(spark, sf_dir):
    text = plan(catalog.order_cube(spark, sf_dir))
    lines = text.splitlines()
    expand = next(i for i, line in enumerate(lines) if "Expand" in line)
    assert any("HashAggregate" in line for line in lines[expand + 1 :])
    assert text.count("FileScan parquet") == 4


# Hierarchies


def closed(edges):
    """Shortest distances by breadth-first search."""
    after = defaultdict(set)
    for p, c in edges:
        if p is not None and c is not None:
            after[p].add(c)
    out = {}
    for start in list(after):
        depth, frontier = 0, {start}
        while frontier:
            depth += 1
            frontier = {c for n in frontier for c in after.get(n, ())}
            frontier = {c for c in frontier if out.setdefault((start, c), depth) == depth}
    return out


CHAIN = [(f"n{i}", f"n{i + 1}") for i in range(70)]
EDGES = {
    "chain": CHAIN,
    "cycle": [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "x")],
    "diamond": [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "e"), ("a", "e"), ("a", "b"), (None, "z"), ("z", None)],
    "empty": [],
}


@pytest.mark.parametrize("name", list(EDGES))
def test_closure_equals_search(spark, name):
    pairs = hierarchy.closure(spark.createDataFrame(EDGES[name], "parent string, child string"))
    got = pairs.collect()
    assert {(r.ancestor, r.descendant): r.depth for r in got} == closed(EDGES[name]) and len(got) == len(closed(EDGES[name]))


def test_cycles_are_found(spark):
    pairs = hierarchy.closure(spark.createDataFrame(EDGES["cycle"], "parent string, child string"))
    assert rows(hierarchy.cycle_members(pairs), ["node", "length"]) == [("a", 3), ("b", 3), ("c", 3), ("x", 1)]


def test_rounds_grow_with_the_logarithm(spark):
    with pytest.raises(RuntimeError):
        hierarchy.closure(spark.createDataFrame(CHAIN, "parent string, child string"), rounds=3)
    hierarchy.closure(spark.createDataFrame(CHAIN, "parent string, child string"), rounds=8)


def test_subtree_totals(spark):
    pairs = hierarchy.closure(spark.createDataFrame(EDGES["diamond"], "parent string, child string"))
    facts = spark.createDataFrame([("d", 5), ("e", 1), ("e", 2), ("lone", 7), (None, 9)], "n string, v long")
    got = {r.node: (r.total, r.members) for r in hierarchy.subtree_totals(pairs, facts, "n", "v").collect()}
    assert got == {"a": (8, 2), "b": (8, 2), "c": (8, 2), "d": (8, 2), "e": (3, 1), "lone": (7, 1)}


# First rows


@pytest.mark.parametrize("descending", [True, False])
@pytest.mark.parametrize("parts", [1, 16])
def test_top_rows_equal_sorting(spark, descending, parts):
    draw = random.Random(4)
    table = [(draw.choice(["hot", "hot", "b", None]), draw.choice([None, *range(9)]), i) for i in range(300)]
    df = spark.createDataFrame(table, "k string, v int, id int").repartition(6)
    got = topn.top_rows(df, "k", ["v", "id"], 4, descending, parts).collect()
    wanted = []
    for key in {r[0] for r in table}:
        own = sorted((r for r in table if r[0] == key), key=lambda r: (r[1] is not None, r[1] or 0, r[2]), reverse=descending)
        wanted += [(*r, place) for place, r in enumerate(own[:4], 1)]
    assert sorted(map(tuple, got), key=repr) == sorted(wanted, key=repr)


def test_top_rows_are_cut_before_the_shuffle(spark, sf_dir):
    text = plan(catalog.top_orders(spark, sf_dir))
    lines = text.splitlines()
    lowest = max(i for i, line in enumerate(lines) if "Exchange" in line)
    assert any("WindowGroupLimit" in line and "Partial" in line for line in lines[lowest:])


def test_repeated_rows_and_empty_tables(spark):
    df = spark.createDataFrame([("a", 1)] * 5, "k string, v int")
    assert [r.place for r in topn.top_rows(df, "k", ["v"], 3).orderBy("place").collect()] == [1, 2, 3]
    assert topn.top_lists(df.limit(0), "k", ["v"], 3).count() == 0


# Sketches


def test_merged_states_equal_one_pass_within_the_error(spark):
    df = spark.range(200_000).select(
        (F.col("id") % 7).cast("int").alias("k"), (F.col("id") % 4).cast("int").alias("year"),
        F.pmod(F.xxhash64("id"), F.lit(30_000)).alias("user"), F.sqrt(F.col("id").cast("double")).alias("v"),
    )
    stored = sketches.sketch_states(df, ["k", "year"], "user", "v")
    chained = sketches.merge_states(sketches.merge_states(stored, ["k"]), [])
    once = sketches.merge_states(stored, [])
    whole = sketches.sketch_states(df, [], "user", "v")
    exact = df.agg(F.count_distinct("user"), F.min("v"), F.max("v")).first()
    measured = [sketches.n_distinct().alias("d"), *[sketches.quantile(q).alias(f"q{int(q * 100)}") for q in (0, 0.1, 0.5, 0.99, 1)]]
    results = [df_.select("n_rows", *measured).first() for df_ in (chained, once, whole)]
    assert results[0].d == results[1].d == results[2].d  # unions lose nothing
    for r in results:
        assert r.n_rows == 200_000 and abs(r.d - exact[0]) <= 0.03 * exact[0]
        assert (r.q0, r.q100) == (exact[1], exact[2])
        for q in (10, 50, 99):
            rank = r[f"q{q}"] ** 2 / 200_000  # the values are roots of 0 .. n - 1
            assert abs(rank - q / 100) <= 0.015


def test_states_of_nulls(spark):
    df = spark.createDataFrame([("a", None, None), ("b", 1, 2.0)], "k string, u long, v double")
    merged = sketches.merge_states(sketches.sketch_states(df, ["k"], "u", "v"), ["k"])
    got = {r.k: (r.d, r.q) for r in merged.select("k", sketches.n_distinct().alias("d"), sketches.quantile(0.5).alias("q")).collect()}
    assert got == {"a": (0, None), "b": (1, 2.0)}


# Versions

OLD = [(1, "a", 1.0), (1, "a", 1.0), (2, None, 2.0), (2, "b", None), (3, "c", 3.0), (4, "d", 4.0), (None, "n", 5.0)]
NEW = [(1, "a", 1.0), (2, None, 2.0), (2, "b", 9.0), (3, "c", 3.0), (5, "e", 6.0), (5, "e", 6.0), (None, "n", 5.0)]
SCHEMA = "year int, name string, v double"


def test_changed_rows_are_a_multiset_difference(spark):
    old, new = spark.createDataFrame(OLD, SCHEMA), spark.createDataFrame(NEW, SCHEMA)
    wanted = Counter(NEW)
    wanted.subtract(Counter(OLD))
    got = {tuple(r)[:3]: r.change for r in refresh.changed_rows(old, new).collect()}
    assert got == {k: n for k, n in wanted.items() if n}
    assert refresh.changed_rows(old, old).count() == 0 and refresh.changed_rows(old.limit(0), new.limit(0)).count() == 0


def test_changed_keys(spark):
    schema = "k int, a string, b int"
    old = spark.createDataFrame([(1, "x", 1), (2, None, 2), (3, "z", 3), (None, "n", 0)], schema)
    new = spark.createDataFrame([(1, "x", 1), (2, "y", None), (4, None, None), (None, "n", 1)], schema)
    got = {r.k: (r.kind, r["columns"]) for r in refresh.changed_keys(old, new, ["k"]).collect()}
    assert got == {2: ("updated", ["a", "b"]), 3: ("deleted", None), 4: ("inserted", None), None: ("updated", ["b"])}


def files(path):
    return {
        os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns
        for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")
    }


def test_refresh_writes_changed_partitions_only(spark, tmp_path):
    path = str(tmp_path / "table")
    old, new = spark.createDataFrame(OLD, SCHEMA), spark.createDataFrame(NEW, SCHEMA)
    old.write.partitionBy("year").parquet(path)
    before = files(path)
    assert refresh.refresh_partitions(spark, path, new, "year") == [1, 2, 4, 5]
    stored = spark.read.schema(new.schema).parquet(path)
    assert rows(stored, ["year", "name", "v"]) == sorted(NEW, key=repr)
    after = files(path)
    same = {f for f in before if "year=3" in f or "HIVE_DEFAULT" in f}
    assert same and all(after[f] == before[f] for f in same)
    assert not any("year=4" in f for f in after)
    assert refresh.refresh_partitions(spark, path, new, "year") == [] and files(path) == after


def test_refresh_from_the_table_itself(spark, tmp_path):
    path = str(tmp_path / "table")
    spark.createDataFrame(OLD, SCHEMA).write.partitionBy("year").parquet(path)
    new = spark.read.schema(SCHEMA).parquet(path).select("year", "name", (F.col("v") * 2).alias("v"))
    refresh.refresh_partitions(spark, path, new, "year")
    doubled = [(y, n, v and v * 2) for y, n, v in OLD]
    assert rows(spark.read.schema(SCHEMA).parquet(path), ["year", "name", "v"]) == sorted(doubled, key=repr)


# Streams


def event_rows(spark, start, hours, first=0):
    at = [(first + i, start + datetime.timedelta(hours=h), 1, "ab"[i % 2], 1.5, "") for i, h in enumerate(hours)]
    return spark.createDataFrame(at, schemas.TABLES["events"])


def totals_of(spark, directory):
    measures = {"n": F.count(F.lit(1)), "value": F.sum(F.rint(F.col("value") * 100))}
    events = stream(spark, directory, "events", files_per_batch=1)
    return window_totals(events, "ts", ["event_type"], "1 day", "2 hours", measures)


def test_stream_after_a_stop_equals_the_batch(spark, tmp_path):
    directory, day = str(tmp_path), datetime.datetime(2024, 1, 1)
    arrived = [[0, 5, 23, 24, 25], [26, 30, 47.5, 49], [40, 48, 75], [76, 80, 101]]
    late = [[47, 60]]  # of days that were closed two hours and more before
    table, checkpoint = f"{directory}/table", f"{directory}/checkpoint"

    def arrive(hours):
        event_rows(spark, day, hours).coalesce(1).write.mode("append").parquet(f"{directory}/events.parquet")

    for hours in arrived[:2]:
        arrive(hours)
        append_closed(totals_of(spark, directory), table, checkpoint)
    for hours in [arrived[2], late[0], arrived[3]]:  # a new query goes on from the checkpoint
        arrive(hours)
        append_closed(totals_of(spark, directory), table, checkpoint)
    again = append_closed(totals_of(spark, directory), table, checkpoint)

    flat = [h for hours in arrived for h in hours]
    wanted = Counter()
    for hours in arrived:
        for i, h in enumerate(hours):
            if (h // 24 + 1) * 24 <= max(flat) - 2:
                wanted[int(h // 24), "ab"[i % 2]] += 1
    got = {((r.opens - day).days, r.event_type): r.n for r in again.collect()}
    assert got == dict(wanted) and len(got) == again.count()


def test_batch_and_stream_have_the_same_totals(spark, sf_dir):
    from panelspark.sources.tables import load

    measures = {"n": F.count(F.lit(1)), "value": F.sum(F.rint(F.col("value") * 100))}
    batch = window_totals(load(spark, sf_dir, "events"), "ts", ["event_type"], "1 day", "1 hour", measures)
    batch = batch.select(F.date_format("opens", "yyyy-MM-dd").alias("day"), "event_type", "n", "value")
    streamed = rows(catalog.streamed_days(spark, sf_dir))
    last = max(r[0] for r in rows(batch, ["day"]))
    assert streamed == [r for r in rows(batch) if r[0] < last]


def test_plans_stay_equi_joins(spark, sf_dir):
    for query in (catalog.territory_totals, catalog.version_changes, catalog.version_keys, catalog.sketched_nations):
        assert not re.search("NestedLoop|Cartesian", plan(query(spark, sf_dir)))
