"""Hundreds of random series with gaps, NULLs and ties, each an entity of one panel, against loops."""

import random

import pytest

from helpers import same
from panelspark.operators import aggregates, cohorts, documents, entities, trade, windows

LAYOUT = documents.DocumentLayout(details=("gdp",), totals=("gdp",), leaves={"oil": ("oil", "use")})


@pytest.fixture(scope="module")
def series():
    rng = random.Random(11)
    data = {}
    for i in range(300):
        years = [y for y in range(2000, 2000 + rng.randint(1, 14)) if rng.random() > 0.15]
        data[f"E{i}"] = {
            y: (
                None if rng.random() < 0.2 else float(rng.randint(0, 6)),
                None if rng.random() < 0.1 else float(rng.randint(0, 50)),
            )
            for y in years
        }
    return data


@pytest.fixture(scope="module")
def panel(spark, series):
    rows = [(e, y, oil, gdp) for e, s in series.items() for y, (oil, gdp) in s.items()]
    random.Random(3).shuffle(rows)
    return spark.createDataFrame(rows, "entity string, year int, oil double, gdp double").cache()


def mean(values):
    known = [v for v in values if v is not None]
    return sum(known) / len(known) if known else None


def frames(s, n):
    """Averages over n consecutive rows: {last year: (oil, gdp)}."""
    years = sorted(s)
    return {
        years[i]: tuple(mean([s[y][m] for y in years[i - n + 1 : i + 1]]) for m in (0, 1))
        for i in range(n - 1, len(years))
    }


@pytest.mark.parametrize("n", [1, 2, 3, 5])
def test_moving_average(panel, series, n):
    got = windows.moving_average(panel, ["oil", "gdp"], n).select("entity", "year", "oil_ma", "gdp_ma")
    wanted = [(e, y, *v) for e, s in series.items() for y, v in frames(s, n).items()]
    assert same([tuple(r) for r in got.collect()], wanted)


@pytest.mark.parametrize("n", [1, 3])
def test_negative_change_pairs(panel, series, n):
    wanted = set()
    for e, s in series.items():
        averages = frames(s, n)
        years = sorted(averages)
        for a, b in zip(years, years[1:], strict=False):
            if None not in (averages[a][0], averages[b][0]) and averages[b][0] < averages[a][0]:
                for y in (a, b):
                    if averages[y][1] is not None:
                        wanted.add((e, f"{y - n + 1} - {y}", averages[y][1]))
    got = windows.negative_change_pairs(panel, "oil", "gdp", n).select("entity", "period", "gdp_ma")
    assert same([tuple(r) for r in got.collect()], list(wanted))


@pytest.mark.parametrize("n", [2, 3])
def test_document_averages_and_falls_by_distance(panel, series, n):
    averages = {e: frames({y: v for y, v in s.items() if v[0] is not None}, n) for e, s in series.items()}
    df = windows.moving_average_docs(documents.to_documents(panel, LAYOUT), "oil", n, ["gdp"])
    got = df.select("entity", "year", "oil_ma", "gdp_ma")
    assert same([tuple(r) for r in got.collect()], [(e, y, *v) for e, a in averages.items() for y, v in a.items()])
    wanted = set()
    for e, a in averages.items():
        for y in a:
            if y + 1 in a and a[y + 1][0] < a[y][0]:
                wanted |= {(e, z, a[z][1]) for z in (y, y + 1) if a[z][1] is not None}
    falls = windows.falling_pairs(df, "entity", "year", "oil_ma", "gdp_ma").select("entity", "year", "gdp_ma")
    assert same([tuple(r) for r in falls.collect()], list(wanted))


def test_coverage_flat_and_documents(spark, panel, series):
    master = panel.select("entity").distinct()
    first = min(min(s) for s in series.values() if s)
    last = max(max(s) for s in series.values() if s)
    wanted = sorted(e for e, s in series.items() if len(s) == last - first + 1)
    flat = entities.full_coverage(panel, master)
    docs = entities.full_coverage_docs(documents.to_documents(panel, LAYOUT), master)
    assert wanted
    assert sorted(r.entity for r in flat.collect()) == wanted
    assert {r.entity: [y.year for y in r.yearlyData] for r in docs.collect()} == {
        e: sorted(series[e]) for e in wanted
    }


def test_differences_and_top_counts(panel, series):
    falls = {}
    for e, s in series.items():
        years = sorted(s)
        falls[e] = sum(
            None not in (s[a][0], s[b][0]) and s[b][0] < s[a][0] for a, b in zip(years, years[1:], strict=False)
        )
    wanted = sorted(((-n, e) for e, n in falls.items() if n))[:3]
    top = windows.count_negative_years(windows.yoy_difference(panel, "entity", "oil"), "entity", 3)
    assert [(-r.instances, r.entity) for r in top.collect()] == wanted


def test_averages_and_ranking(panel, series):
    positive = {e: [v for v, _ in s.values() if v] for e, s in series.items()}
    wanted = [(e, sum(v) / len(v)) for e, v in positive.items() if v]
    got = [tuple(r) for r in aggregates.cohort_average(panel, "oil").collect()]
    assert same(got, wanted)
    assert got == sorted(got, key=lambda r: (-r[1], r[0]))
    means = {e: mean([v for v, _ in s.values()]) for e, s in series.items() if s}
    order = sorted(means, key=lambda e: (means[e] is None, -(means[e] or 0), e))
    ranked = cohorts.rank_entities(panel, panel.oil, k=7).collect()
    assert [r.entity for r in ranked] == order[:7]


def test_trade_flat_documents_and_loops(spark):
    rng = random.Random(5)
    keys = [(y, p, s) for y in range(2000, 2012) for p in "abc" for s in "wxyz"]
    value = lambda: None if rng.random() < 0.1 else float(rng.randint(0, 9))
    sides = {side: {k: value() for k in keys if rng.random() > 0.2} for side in ("import", "export")}
    rows = [(*k, side, v) for side, values in sides.items() for k, v in values.items()]
    table = spark.createDataFrame(rows, "year int, product string, sub_product string, side string, value double")
    both = sorted(set(sides["import"]) & set(sides["export"]))
    diff = {
        k: None if None in (sides["export"][k], sides["import"][k]) else sides["export"][k] - sides["import"][k]
        for k in both
    }
    assert [tuple(r) for r in trade.matched_difference(table).collect()] == [(*k, diff[k]) for k in both]
    surplus = {}
    for (y, _, _), d in diff.items():
        surplus[y] = surplus.get(y, 0) + (d is not None and d > 0)
    many = {(y, n) for y, n in surplus.items() if n > 3}
    assert many
    assert {tuple(r) for r in trade.years_with_many(table, 3).collect()} == many
    unnested = documents.trade_rows(documents.trade_documents(table))
    names = ["year", "product", "sub_product", "side", "value"]
    assert sorted(map(tuple, unnested.select(*names).collect())) == sorted(r for r in rows if r[4] is not None)
