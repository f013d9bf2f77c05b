"""Frames by value, as-of joins, interval joins and whole-table ranks against plain loops."""

import datetime
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from helpers import final_plan, plan, rows
from panelspark.operators import asof, frames, intervals, ranks
from panelspark.operators.skew import salted_join
from panelspark.plans import catalog

MEASURES = {
    "n": ("count", "v"),
    "total": ("sum", "v"),
    "low": ("min", "v"),
    "high": ("max", "v"),
    "mean": ("avg", "v"),
    "seen": ("values", "t"),
}


def series(seed=1, n=200):
    draw = random.Random(seed)
    out = []
    for i in range(n):
        key = draw.choice(["a", "a", "b", "c", None])
        period = draw.choice([1, 2, 3, 5, 9, None])
        out.append((i, key, period, draw.choice([None, 1.0, 2.5, -4.0, 7.0]), draw.choice("xyz")))
    return out


@pytest.fixture(scope="module")
def framed(spark):
    return spark.createDataFrame(series(), "id int, key string, period int, v double, t string").repartition(4)


def frame_of(table, row, lower, upper):
    """The rows of the frame; a missing period has only missing ones near it."""
    _, key, period, _, _ = row
    if period is None:
        return [r for r in table if r[1] == key and r[2] is None]
    return [r for r in table if r[1] == key and r[2] is not None and lower <= r[2] - period <= upper]


@pytest.mark.parametrize(("lower", "upper"), [(-1, 0), (0, 0), (-2, 1), (1, 4), (-6, -4)])
@pytest.mark.parametrize("hot_rows", [10**6, 3])
def test_range_frame_equals_loops(framed, lower, upper, hot_rows):
    table = series()
    got = {r.id: r for r in frames.range_frame(framed, "key", "period", MEASURES, lower, upper, hot_rows).collect()}
    assert len(got) == len(table)
    for row in table:
        frame = frame_of(table, row, lower, upper)
        known = [r[3] for r in frame if r[3] is not None]
        r = got[row[0]]
        assert r.n == len(known)
        assert r.total == (sum(known) if known else None)
        assert (r.low, r.high) == ((min(known), max(known)) if known else (None, None))
        assert r.mean == (pytest.approx(sum(known) / len(known)) if known else None)
        assert r.seen == sorted({x[4] for x in frame})


def test_range_frame_keeps_repeated_rows_and_empty_tables(spark, framed):
    doubled = framed.unionByName(framed)
    assert frames.range_frame(doubled, "key", "period", MEASURES).count() == 2 * framed.count()
    assert frames.range_frame(framed.limit(0), "key", "period", MEASURES).count() == 0


@pytest.mark.parametrize(("lower", "upper"), [(-1, 0), (1, 4)])
def test_frame_members_equal_loops(framed, lower, upper):
    table = series()
    got = frames.frame_members(framed.drop("v"), "key", "period", ["id", "t"], lower, upper).collect()
    assert {(r.key, r.period) for r in got} == {(r[1], r[2]) for r in table} and len(got) == len(
        {(r[1], r[2]) for r in table}
    )
    for r in got:
        frame = frame_of(table, (None, r.key, r.period, None, None), lower, upper)
        wanted = sorted(((p, i, t) for i, _, p, _, t in frame), key=lambda m: (m[0] is not None, m[0] or 0, m[1]))
        assert [tuple(m) for m in r.members] == wanted


def test_falling_frames_equal_loops(framed):
    table = series()
    wanted = set()
    for i, key, period, v, _ in table:
        before = [r[3] for r in table if r[1] == key and period is not None and r[2] == period - 1 and r[3] is not None]
        if before and v is not None and v < min(before):
            wanted.add((i, min(before)))
    got = frames.falling_frames(framed, "key", "period", "v", hot_rows=4).collect()
    assert {(r.id, r.previous_v) for r in got} == wanted and wanted


def test_hot_key_is_dealt(spark):
    facts = spark.createDataFrame([("a", 900), ("b", 3)], "k string, n long")
    table = spark.range(903).select(F.when(F.col("id") < 900, "a").otherwise("b").alias("k"), "id")
    joined = salted_join(table, facts, ["k"], "n", hot_rows=100)
    assert joined.columns == ["k", "id", "n"] and joined.count() == 903
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    assert int(parts) >= 2
    text = plan(joined)
    assert "_part" in text and not re.search("NestedLoop|Cartesian", text)


def test_frames_have_no_window(spark, sf_dir):
    for query in (catalog.range_frame_pairs, catalog.range_frame_members, catalog.falling_frames):
        assert "Window" not in plan(query(spark, sf_dir))


# As-of joins


T0 = datetime.datetime(2024, 3, 30, 12)


def moments(seed, n, payload):
    draw = random.Random(seed)
    out = []
    for i in range(n):
        at = T0 + datetime.timedelta(hours=draw.randrange(0, 24 * 6, 3))
        out.append((draw.choice(["a", "a", "b", "c", None]), draw.choice([at, at, at, None]), i, payload(draw)))
    return out


LEFT = moments(1, 150, lambda d: d.random())
RIGHT = moments(2, 60, lambda d: d.choice([None, 1, 2, 3]))


@pytest.mark.parametrize("forward", [False, True])
@pytest.mark.parametrize("block", [asof.by_day, lambda t: F.date_trunc("hour", t), lambda t: F.date_trunc("year", t)])
@pytest.mark.parametrize("hours", [None, 5])
def test_asof_equals_loops(spark, forward, block, hours):
    left = spark.createDataFrame(LEFT, "k string, at timestamp_ntz, id int, x double").repartition(3)
    right = spark.createDataFrame(RIGHT, "k string, at timestamp_ntz, r int, y int").repartition(2)
    within = None
    if hours is not None:
        span = F.expr(f"INTERVAL {hours} HOURS")
        within = lambda at, other: (other <= at + span) & (other >= at - span)
    joined = asof.asof_join(left, right, "k", "at", ["r", "y"], "r", forward, block, within)
    assert joined.columns == ["k", "at", "id", "x", "r", "y"]
    got = {r.id: (r.r, r.y) for r in joined.collect()}
    assert len(got) == len(LEFT)
    for k, at, i, _ in LEFT:
        seen = [r for r in RIGHT if r[0] == k and k is not None and r[1] and at and (r[1] >= at if forward else r[1] <= at)]
        best = max(seen, key=lambda r: (T0 - r[1] if forward else r[1] - T0, r[2]), default=None)
        if best and hours is not None and abs(best[1] - at) > datetime.timedelta(hours=hours):
            best = None
        assert got[i] == ((best[2], best[3]) if best else (None, None))


def test_asof_of_empty_tables(spark):
    left = spark.createDataFrame(LEFT, "k string, at timestamp_ntz, id int, x double")
    right = spark.createDataFrame(RIGHT, "k string, at timestamp_ntz, r int, y int")
    alone = asof.asof_join(left, right.limit(0), "k", "at", ["y"], "r")
    assert alone.count() == len(LEFT) and alone.filter("y IS NOT NULL").count() == 0
    assert asof.asof_join(left.limit(0), right, "k", "at", ["y"], "r").count() == 0


def test_asof_windows_are_cut_into_blocks(spark, sf_dir):
    text = plan(catalog.asof_rates(spark, sf_dir))
    windows = [line for line in text.splitlines() if re.search(r"\bWindow \[", line)]
    assert any(re.search(r"\[user#\d+L, block#\d+\]", line) for line in windows)
    assert not re.search("NestedLoop|Cartesian", text)


# Interval joins


def spans(seed, n, longest):
    draw = random.Random(seed)
    out = []
    for i in range(n):
        start = draw.randrange(-300, 300)
        length = draw.choice([0, 1, 2, draw.randrange(1, 20), draw.randrange(1, longest)])
        out.append((draw.choice("ab"), i, draw.choice([start, start, start, None]), start + length))
    return out


@pytest.mark.parametrize("keys", [[], ["k"]])
@pytest.mark.parametrize("width", [None, 1, 7, 5000])
def test_interval_join_equals_loops(spark, keys, width):
    a, b = spans(1, 90, 400), spans(2, 70, 3000)
    schema = "k string, id int, start long, end long"
    width = width if width is None else F.lit(width).cast("long")
    joined = intervals.interval_join(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), keys, width)
    wanted = sorted(
        (x[1], y[1], min(x[3], y[3]) - max(x[2], y[2]))
        for x, y in itertools.product(a, b)
        if None not in (x[2], y[2]) and x[2] < x[3] and y[2] < y[3]
        and x[2] < y[3] and y[2] < x[3] and (not keys or x[0] == y[0])
    )
    got = sorted((r.l.id, r.r.id, r.overlap) for r in joined.collect())
    assert got == wanted and wanted


def test_very_long_interval_is_split(spark, monkeypatch):
    monkeypatch.setattr(intervals, "RUN", 16)
    schema = "id int, start long, end long"
    long = spark.createDataFrame([(0, -5000, 5001)], schema)
    short = spark.createDataFrame([(i, i, i + 1) for i in range(-6000, 6000, 100)], schema)
    joined = intervals.interval_join(long, short, width=F.lit(1).cast("long"))
    assert sorted(r.r.id for r in joined.collect()) == list(range(-5000, 5001, 100))
    assert intervals.interval_join(short, short).count() == 120
    assert intervals.interval_join(short.limit(0), short).count() == 0


def test_interval_join_is_an_equi_join(spark, sf_dir):
    text = plan(catalog.interval_overlaps(spark, sf_dir))
    assert not re.search("NestedLoop|Cartesian", text) and "Join" in text


# Ranks over a whole table


def ranked_table(seed, n, values):
    draw = random.Random(seed)
    return [(i, draw.choice([*values, None])) for i in range(n)]


def loop_ranks(table, descending):
    """(position, rank, dense rank, rows up to its ties) by id, NULLs first or, descending, last."""
    order = sorted(table, key=lambda r: ((r[1] is not None) != descending, (-1 if descending else 1) * (r[1] or 0), r[0]))
    firsts, lasts, dense = {}, {}, {}
    for at, (_, v) in enumerate(order, 1):
        firsts.setdefault(v, at)
        lasts[v] = at
        dense.setdefault(v, len(dense) + 1)
    return {i: (at, firsts[v], dense[v], lasts[v]) for at, (i, v) in enumerate(order, 1)}


@pytest.mark.parametrize("values", [range(1000), range(5), [7], [1] * 20 + [2, 3]])
@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("parts", [1, 7, 40])
def test_ranks_equal_loops(spark, values, descending, parts):
    table = ranked_table(3, 120, values)
    df = spark.createDataFrame(table, "id int, part int").repartition(5)
    got = ranks.global_ranks(df, ["part"], ["id"], descending, parts).collect()
    assert {r.id: (r.position, r.rank, r.dense_rank, r.n_upto) for r in got} == loop_ranks(table, descending)
    assert {r.total for r in got} == {120}


def test_ties_cross_many_parts(spark):
    """One value fills several parts between smaller and larger ones."""
    table = [(i, 0 if i < 3 else 5 if i < 290 else 9) for i in range(300)]
    df = spark.createDataFrame(table, "id int, v int").repartition(8)
    placed = ranks.global_ranks(df, ["v"], ["id"], parts=30)
    got = {r.id: (r.position, r.rank, r.dense_rank, r.n_upto) for r in placed.collect()}
    assert got == loop_ranks(table, False)


@pytest.mark.parametrize("n", [1, 3, 7, 100, 500])
def test_tiles_hold_equal_numbers_of_rows(spark, n):
    df = spark.createDataFrame([(i, i % 9) for i in range(101)], "id int, v int")
    got = ranks.global_ranks(df, ["v"], ["id"]).select("position", ranks.ntile(n).alias("tile")).collect()
    sizes = [101 // n + (k < 101 % n) for k in range(n)]
    wanted = [k + 1 for k, size in enumerate(sizes) for _ in range(size)]
    assert [r.tile for r in sorted(got)] == wanted


def test_ranks_of_empty_and_single_tables(spark):
    one = spark.createDataFrame([(1, None)], "id int, v int")
    r = ranks.global_ranks(one, ["v"], ["id"]).select("rank", ranks.percent_rank().alias("p"), ranks.cume_dist().alias("c"))
    assert [tuple(x) for x in r.collect()] == [(1, 0.0, 1.0)]
    assert ranks.global_ranks(one.limit(0), ["v"]).count() == 0
    assert ranks.global_percentiles(one, "v", [0.5]).count() == 0


def test_percentiles_interpolate(spark):
    df = spark.createDataFrame([(v,) for v in [10.0, None, 20.0, 40.0, 80.0]], "v double")
    got = {r.fraction: r.percentile for r in ranks.global_percentiles(df, "v", [0, 0.5, 0.9, 1], parts=3).collect()}
    assert got == {0.0: 10.0, 0.5: 30.0, 0.9: pytest.approx(68.0), 1.0: 80.0}


def test_ranks_need_no_whole_table_window(spark, sf_dir):
    for query in (catalog.global_ranks, catalog.global_percentiles):
        text = final_plan(query(spark, sf_dir))
        assert "SinglePartition" not in "\n".join(
            line for line in text.splitlines() if "Exchange SinglePartition" in line and "REPARTITION" in line
        )
        for line in text.splitlines():
            if re.search(r"\bWindow \[", line):
                assert "part#" in line
    assert rows(catalog.global_percentiles(spark, sf_dir))
