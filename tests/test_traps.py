"""Hand-made rows for NULLs, zeros, bad text, short arrays, gaps and ties."""

import pytest
from pyspark.sql import functions as F

from helpers import rows
from panelspark.functions import (
    date_quarter,
    first_metric,
    metric_entries,
    month_number,
    null_strict_sum,
    percent,
    period_label,
    quarter_of_month,
    safe_ratio,
    text_bar,
)
from panelspark.functions.nested import array_mean
from panelspark.operators import (
    aggregates,
    cohorts,
    documents,
    entities,
    impact,
    season,
    slices,
    trade,
    windows,
)
from panelspark.sources.energy import case_insensitive


def panel(spark, data, *metrics):
    return spark.createDataFrame(
        data, "entity string, year int" + "".join(f", {m} double" for m in metrics)
    )


def test_ratios_are_null_on_zero_or_null(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 0.0), (None, 2.0), (1.0, None), (0.0, 0.0)], "a double, b double")
    got = [tuple(r) for r in df.select(safe_ratio("a", "b"), percent("a", "b")).collect()]
    assert got == [(0.5, 50.0), (None, None), (None, None), (None, None), (None, None)]


def test_ratio_of_integers_is_not_truncated(spark):
    df = spark.createDataFrame([(1, 4)], "a int, b int")
    assert df.select(safe_ratio("a", "b")).first()[0] == 0.25


def test_month_text(spark):
    df = spark.createDataFrame([("1",), ("12",), ("13",), ("Annual",), ("na",), (None,)], "m string")
    got = [tuple(r) for r in df.select(month_number("m"), quarter_of_month("m")).collect()]
    assert got == [(1, 1), (12, 4), (None, None), (None, None), (None, None), (None, None)]


def test_quarter_of_every_month(spark):
    df = spark.range(1, 13).select(quarter_of_month("id").alias("q"))
    assert [r.q for r in df.collect()] == [1, 1, 1, 2, 2, 2, 3, 3, 3, 4, 4, 4]


def test_bad_date_text(spark):
    df = spark.createDataFrame([("5/31/2010",), ("31/5/2010",), ("Annual",), ("",)], "d string")
    assert [r[0] for r in df.select(date_quarter("d")).collect()] == [2, None, None, None]


def test_period_label(spark):
    df = spark.createDataFrame([(2002,)], "y int")
    assert df.select(period_label("y", 3), period_label("y", 2, "-")).first()[:] == (
        "2000 - 2002",
        "2001-2002",
    )


def test_text_bar_rounds(spark):
    df = spark.createDataFrame([(0.0,), (2.6,), (10.0,), (None,)], "v double")
    got = [r[0] for r in df.select(text_bar("v", F.lit(0.0), F.lit(10.0), 10)).collect()]
    assert got == ["", "***", "*" * 10, None]


def test_text_bar_of_constant_column(spark):
    df = spark.createDataFrame([(5.0,)], "v double")
    assert df.select(text_bar("v", F.lit(5.0), F.lit(5.0))).first()[0] is None


def test_null_addend_makes_total_null(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, None)], "a double, b double")
    assert [r[0] for r in df.select(null_strict_sum(["a", "b"])).collect()] == [3.0, None]
    totals = slices.group_sum_columns(df, {"t": ["a", "b"]})
    assert [r.t for r in totals.collect()] == [3.0, None]


def test_entity_master_drops_both_kinds_of_aggregate(spark):
    data = [
        ("Japan", "JPN", "Asia"),
        ("Asia", "ASI", "Asia"),
        ("World", "OWID_WRL", "Everything"),
        ("Kosovo", "XOWID", "Europe"),
    ]
    df = spark.createDataFrame(data, "entity string, code string, continent string")
    assert [r.entity for r in entities.entity_master(df).orderBy("entity").collect()] == ["Japan", "Kosovo"]


def test_list_entities_needs_a_code(spark):
    p = spark.createDataFrame(
        [("A", "a", 1), ("A", "a", 2), ("B", "", 1), ("C", "OWID_C", 1), ("D", "d", 1)],
        "entity string, code string, year int",
    )
    master = spark.createDataFrame([("A",), ("B",), ("C",)], "entity string")
    assert rows(entities.list_entities(p, master)) == [("a", "A")]


def test_full_coverage_span_is_computed(spark):
    p = panel(spark, [("A", 1), ("A", 2), ("A", 3), ("B", 1), ("B", 3), ("World", 1), ("World", 2), ("World", 3)])
    master = spark.createDataFrame([("A",), ("B",)], "entity string")
    assert rows(entities.year_span(p)) == [(3, 1, 3)]
    assert rows(entities.full_coverage(p, master)) == [("A", 3)]


def test_threshold_is_strict_and_null_is_not_below(spark):
    p = panel(spark, [("A", 1, 100.0), ("A", 2, 99.9), ("A", 3, None), ("A", 4, 50.0), ("B", 9, 1.0)], "s")
    got = rows(slices.threshold_crossing(p, "s", 100), ["entity", "year", "first_year"])
    assert got == [("A", 2, 2), ("A", 4, 2), ("B", 9, 9)]


def test_cohort_average_skips_zero_and_null(spark):
    p = panel(spark, [("A", 1, 2.0), ("A", 2, 0.0), ("A", 3, None), ("A", 4, 4.0), ("B", 1, None), ("C", 1, 9.0)], "gdp")
    result = aggregates.cohort_average(p, "gdp", ["A", "B", "C"], 1, 4)
    assert [tuple(r) for r in result.collect()] == [("C", 9.0), ("A", 3.0)]


def test_moving_average_full_frames_only(spark):
    p = panel(spark, [("A", y, v) for y, v in [(1, 1.0), (2, None), (3, 3.0), (4, 5.0)]] + [("B", 1, 1.0), ("B", 2, 1.0)], "m")
    got = rows(windows.moving_average(p, ["m"], 3), ["entity", "year", "period", "m_ma"])
    assert got == [("A", 3, "1 - 3", 2.0), ("A", 4, "2 - 4", 4.0)]


def test_negative_pairs_each_period_once(spark):
    series = [10.0, 8.0, 6.0, 9.0, 9.0]
    p = panel(spark, [("A", 2000 + i, v, float(i)) for i, v in enumerate(series)], "oil", "gdp")
    got = rows(windows.negative_change_pairs(p, "oil", "gdp", 1), ["period", "gdp_ma"])
    assert got == [("2000 - 2000", 0.0), ("2001 - 2001", 1.0), ("2002 - 2002", 2.0)]


def test_negative_pairs_drop_missing_report(spark):
    p = panel(spark, [("A", 1, 3.0, None), ("A", 2, 2.0, 1.0)], "oil", "gdp")
    assert rows(windows.negative_change_pairs(p, "oil", "gdp", 1), ["period"]) == [("2 - 2",)]


def test_adjacent_pairs_go_by_value_distance(spark):
    p = panel(spark, [("A", 1, 1.0), ("A", 2, 2.0), ("A", 4, 4.0)], "v")
    got = {r.year: [x.year for x in r.pair] for r in windows.adjacent_pairs(p, "entity", "year", ["v"]).collect()}
    assert got == {1: [1], 2: [1, 2], 4: [4]}


def test_falling_pairs_ignore_gaps(spark):
    p = panel(spark, [("A", 1, 5.0, 1.0), ("A", 3, 4.0, 2.0), ("A", 4, 3.0, 3.0), ("A", 5, 2.0, None)], "d", "r")
    got = rows(windows.falling_pairs(p, "entity", "year", "d", "r"), ["year", "r"])
    assert got == [(3, 2.0), (4, 3.0)]


def test_yoy_and_top3_ties(spark):
    data = [(r, y, v) for r, vs in {"d": "32", "c": "32", "b": "32", "a": "321", "e": "23"}.items() for y, v in enumerate(vs)]
    p = spark.createDataFrame([(r, 2000 + y, float(v)) for r, y, v in data], "region string, year int, m double")
    falls = windows.yoy_difference(p, "region", "m")
    assert ("a", 2002, "2001-2002", -1.0) in {tuple(r) for r in falls.collect()}
    top = windows.count_negative_years(falls, "region", 3).collect()
    assert [tuple(r) for r in top] == [("a", 2), ("b", 1), ("c", 1)]
    assert windows.count_negative_years(falls, "region", None).count() == 4


TRADE = "year int, product string, sub_product string, side string, value double"


def trade_table(spark):
    return spark.createDataFrame(
        [
            (1, "oil", "crude", "import", 1.0),
            (1, "oil", "crude", "export", 4.0),
            (2, "oil", "crude", "import", 3.0),
            (2, "oil", "crude", "export", None),
            (1, "oil", "fuel", "import", 5.0),
            (3, "gas", "lng", "export", 7.0),
        ],
        TRADE,
    )


def test_one_sided_pairs(spark):
    t = trade_table(spark)
    assert rows(trade.two_sided_average(t), ["product", "sub_product", "import_avg", "export_avg"]) == [
        ("oil", "crude", 2.0, 4.0)
    ]
    assert trade.two_sided_average(t, both_sides=False).count() == 3
    assert rows(trade.matched_difference(t), ["year", "yearly_diff"]) == [(1, 3.0), (2, None)]
    assert rows(trade.years_with_many(t, 0)) == [(1, 1)]
    assert rows(trade.years_with_many(t, 1)) == []


def test_yearly_totals_empty_side(spark):
    t = trade_table(spark)
    names = ["year", "total_import", "total_export"]
    assert rows(trade.yearly_totals(t), names) == [(1, 6.0, 4.0), (2, 3.0, None)]
    assert rows(trade.yearly_totals(t, empty_as_zero=True), names) == [(1, 6.0, 4.0), (2, 3.0, 0.0), (3, 0.0, 7.0)]
    assert rows(trade.yearly_balance(t, since=1), ["year", "balance"]) == [(1, -2.0), (2, None)]


def test_tag_sides(spark):
    one = spark.createDataFrame([(1, "a", "b", 1.0)], "year int, product string, sub_product string, value double")
    assert sorted(r.side for r in trade.tag_sides(one, one).collect()) == ["export", "import"]


LAYOUT = documents.DocumentLayout(
    details=("gdp",), totals=("demand",), leaves={"oil": ("oil", "use"), "oil_share": ("oil", "share"), "sun": ("sun", "use")}
)


def docs(spark, data):
    p = panel(spark, data, "gdp", "demand", "oil", "oil_share", "sun")
    return documents.to_documents(p, LAYOUT)


def test_documents_leave_out_missing_metrics_and_sort_years(spark):
    d = docs(spark, [("A", 2, 1.0, 2.0, 3.0, None, None), ("A", 1, None, None, None, None, 9.0)])
    years = d.first().yearlyData
    assert [y.year for y in years] == [1, 2]
    assert years[1].listOfEnergyData[0].energyTypes[0].energyData == {"oil": 3.0}
    assert years[1].listOfEnergyData[0].energyTypes[1].energyData == {}
    picked = documents.panel_slice_docs(d, ["gdp", "demand", "oil", "sun", "unknown"])
    names = ["year", "gdp", "demand", "oil", "sun", "unknown"]
    assert rows(picked, names) == [(1, None, None, None, 9.0, None), (2, 1.0, 2.0, 3.0, None, None)]


def test_empty_and_missing_arrays_drop_out(spark):
    d = docs(spark, [("A", 1, 1.0, 1.0, 1.0, 1.0, 1.0)])
    empty = d.withColumn("yearlyData", F.filter("yearlyData", lambda y: F.lit(False)))
    missing = d.withColumn("yearlyData", F.when(F.lit(False), F.col("yearlyData")))
    assert documents.panel_slice_docs(empty, ["oil"]).count() == 0
    assert documents.panel_slice_docs(missing, ["oil"]).count() == 0
    no_leaves = d.select(
        "country",
        F.transform("yearlyData", lambda y: y.withField("listOfEnergyData", F.slice(y["listOfEnergyData"], 1, 0))).alias("yearlyData"),
    )
    assert documents.panel_slice_docs(no_leaves, ["oil"]).first().oil is None


def test_first_metric_takes_the_first_of_several(spark):
    df = spark.sql(
        "SELECT array(named_struct('energyTypes', array(named_struct('energyData', map('k', 1D)),"
        " named_struct('energyData', map('k', 2D, 'j', 3D))))) AS e"
    )
    entries = metric_entries(F.col("e"))
    assert df.select(first_metric(entries, "k"), first_metric(entries, "j"), first_metric(entries, "x")).first()[:] == (1.0, 3.0, None)


def test_short_series_gives_no_frame(spark):
    d = docs(spark, [("A", 1, 1.0, 1.0, 1.0, 1.0, 1.0), ("A", 2, 1.0, 1.0, 2.0, 1.0, 1.0)])
    assert windows.moving_average_docs(d, "oil", 3).count() == 0
    assert rows(windows.moving_average_docs(d, "oil", 2), ["period", "oil_ma"]) == [("1 - 2", 1.5)]


def test_docs_frames_skip_years_without_the_metric(spark):
    data = [("A", y, float(y), 1.0, oil, 1.0, 1.0) for y, oil in [(1, 1.0), (2, None), (3, 3.0), (4, 4.0)]]
    got = rows(windows.moving_average_docs(docs(spark, data), "oil", 2, ["gdp"]), ["year", "oil_ma", "gdp_ma"])
    assert got == [(3, 2.0, 2.0), (4, 3.5, 3.5)]


def test_array_mean_of_nothing(spark):
    df = spark.sql("SELECT array(CAST(NULL AS DOUBLE)) AS a, array(1D, NULL, 2D) AS b")
    assert df.select(array_mean(F.col("a")), array_mean(F.col("b"))).first()[:] == (None, 1.5)


def test_new_sources(spark):
    layout = documents.DocumentLayout(
        details=("gdp",),
        totals=("gdp",),
        leaves={f"{e}_share_{k}": (e, "share") for e in ("fossil", "solar", "wind", "hydro") for k in ("elec", "energy")},
    )
    metrics = list(layout.leaves)
    base = dict.fromkeys(metrics, 0.0)
    years = {
        1985: base | {"fossil_share_energy": 100.0, "solar_share_energy": 1.0},
        1986: base | {"fossil_share_energy": 99.0, "solar_share_elec": 0.5, "solar_share_energy": 0.7, "wind_share_elec": 0.0, "wind_share_energy": 0.3, "hydro_share_energy": None},
        1987: base | {"fossil_share_energy": None, "solar_share_energy": 5.0},
    }
    p = spark.createDataFrame(
        [("S", y, 1.0, *[v[m] for m in metrics]) for y, v in years.items()],
        "entity string, year int, gdp double" + "".join(f", {m} double" for m in metrics),
    )
    result = slices.new_sources_docs(documents.to_documents(p, layout), "fossil_share_energy", 100, "energy", ["fossil"], entities=["S"])
    assert rows(result, ["year", "energy", "energy_share"]) == [(1986, "solar", 0.7)]  # wind: 0 in one of its two entries


def test_household_totals_are_separated(spark):
    schema = "region string, description string, dwelling_type string, year int, month string, kwh_per_acc double"
    data = [
        ("East", "East", "Overall", 2010, "Annual", 10.0),
        ("East", "Bedok", "Overall", 2010, "Annual", 99.0),
        ("East", "East", "Flat", 2010, "Annual", 98.0),
        ("Overall", "Overall", "Overall", 2010, "Annual", 97.0),
        ("East", "East", "Overall", 2010, "1/1/2010", 1.0),
        ("East", "East", "Overall", 2010, "3/1/2010", 3.0),
        ("East", "East", "Overall", 2010, "4/1/2010", 8.0),
        ("Overall", "Overall", "Overall", 2010, "4/1/2010", 96.0),
    ]
    h = spark.createDataFrame(data, schema)
    gas = spark.createDataFrame(
        [("Flat", 2010, "1", 2.0), ("Flat", 2010, "2", 4.0), ("Flat", 2010, "na", 90.0), ("Flat", 2010, "East Region", 91.0),
         ("Public Housing", 2010, "1", 92.0), ("Overall", 2010, "1", 93.0)],
        "sub_housing_type string, year int, month string, kwh double",
    )
    d = documents.household_documents(h, gas)
    assert rows(aggregates.period_average(h), ["region", "year", "yearly_avg"]) == [("East", 2010, 10.0)]
    assert rows(aggregates.annual_rows_docs(d), ["region", "year", "yearly_avg"]) == [("East", 2010, 10.0)]
    assert [tuple(y) for y in aggregates.period_average_docs(d).first().yearlyData] == [(2010, 10.0)]
    names = ["region", "year", "quarter", "avg_kwh"]
    assert rows(season.quarterly_by_date(h), names) == [("East", 2010, 1, 2.0), ("East", 2010, 2, 8.0)]
    assert rows(season.quarterly_rows_docs(d), names) == [("East", 2010, 1, 2.0), ("East", 2010, 2, 8.0)]
    names = ["sub_housing_type", "year", "quarter", "avg_kwh"]
    assert rows(season.quarterly_by_month(gas), names) == [("Flat", 2010, 1, 3.0)]
    assert rows(season.quarterly_gas_rows_docs(d), names) == [("Flat", 2010, 1, 3.0)]
    nested = season.quarterly_docs(d).first()
    assert [(y.year, [tuple(q) for q in y.quarters]) for y in nested.years] == [(2010, [(1, 2.0), (2, 8.0)])]


def test_continent_mix_nulls_and_zero(spark):
    p = panel(spark, [("A", 1, 1.0, 2.0, 10.0), ("B", 1, 3.0, None, 10.0), ("C", 1, 0.0, 0.0, 10.0)], "coal", "gas", "total")
    e = spark.createDataFrame([("A", "X"), ("B", "X"), ("C", "Y")], "entity string, continent string")
    got = aggregates.continent_mix(p, e, {"fossil": ["coal", "gas"]}, "total", "fossil", {"share": "fossil"})
    assert rows(got, ["continent", "fossil", "share"]) == [("X", 3.0, 0.3)]


def test_continent_average_is_mean_of_ratios(spark):
    p = panel(spark, [("A", 1, 1.0, 10.0, 1.0), ("B", 1, 2.0, 10.0, 10.0), ("C", 1, 9.0, None, 5.0)], "share", "gdp", "population")
    e = spark.createDataFrame([("A", "X"), ("B", "X"), ("C", "X")], "entity string, continent string")
    got = rows(aggregates.continent_average(p, e, "share"), ["avg_share", "avg_gdp_per_capita"])
    assert got == [(1.5, 5.5)]


def test_emission_rows_with_a_missing_part(spark):
    df = spark.createDataFrame(
        [(1990, 1.0, 1.0, 1.0, 9.0, 9.0), (1991, 1.0, 2.0, 3.0, 10.0, 20.0), (1991, 1.0, None, 3.0, 10.0, 20.0), (1992, 1.0, 1.0, 1.0, 0.0, 4.0)],
        "year int, coal double, gas double, oil double, total double, ghg double",
    )
    shares = aggregates.emission_shares(df, ["coal", "gas", "oil"], after=1990)
    assert rows(shares, ["year", "total_fossil", "fossil_co2_share"]) == [(1991, 6.0, 0.3), (1992, 3.0, None)]
    assert rows(aggregates.average_of_shares(shares), ["avg_co2_ghg_share", "avg_fossil_co2_share"]) == [(0.25, 0.3)]


def test_rank_nulls_and_ties(spark):
    p = panel(spark, [("b", 1, 1.0), ("a", 1, 1.0), ("c", 1, None), ("d", 1, 5.0)], "m")
    ranked = cohorts.rank_entities(p, F.col("m"))
    assert [r.entity for r in ranked.collect()] == ["d", "a", "b", "c"]
    assert [r.entity for r in cohorts.rank_entities(p, F.col("m"), k=2).collect()] == ["d", "a"]
    up = cohorts.rank_entities(p, F.col("m"), descending=False)
    assert [r.entity for r in up.collect()] == ["c", "a", "b", "d"]


def test_topk_vs_benchmark_counts_rows_without_gdp(spark):
    p = panel(spark, [("A", 1, 4.0, 8.0, 2.0), ("A", 2, 6.0, None, 2.0), ("B", 1, 2.0, 6.0, 3.0)], "share", "gdp", "population")
    cohort = spark.createDataFrame([("A",)], "entity string")
    members = spark.createDataFrame([("A",), ("B",)], "entity string")
    got = cohorts.topk_vs_benchmark(p, cohort, members, "X", "share")
    assert rows(got, ["entity", "avg_share", "avg_gdp_per_capita"]) == [("A", 4.0, 4.0), ("X", 4.0, 3.0)]
    same_name = cohorts.topk_vs_benchmark(p, cohort, cohort.limit(1), "A", "gdp")
    assert same_name.count() == 1


def test_align_forms(spark):
    a = spark.createDataFrame([(1, 1.0), (2, 2.0)], "period int, a double")
    b = spark.createDataFrame([(2, 5.0), (3, 6.0)], "period int, b double")
    assert rows(impact.align_series(a, b), ["period", "a", "b"]) == [(1, 1.0, None), (2, 2.0, 5.0)]
    assert rows(impact.align_series(a, b, how="inner"), ["period", "a", "b"]) == [(2, 2.0, 5.0)]


def test_align_two_key_keeps_unmatched(spark):
    left = spark.createDataFrame([("A", 1, 2.0), ("A", 2, 4.0), ("B", 1, 9.0)], "entity string, year int, d double")
    right = spark.createDataFrame([("A", 1, 7.0), ("C", 1, 8.0)], "entity string, year int, x double")
    got = impact.align_two_key(left, right, "d", "x")
    assert [tuple(r) for r in got.collect()] == [("B", 9.0, None), ("A", 3.0, 7.0)]


def test_validated_counts_is_an_existence_check(spark):
    facts = spark.createDataFrame(
        [("A", 1, "flood", 2), ("A", 1, "flood", 3), ("B", 1, "flood", 50), ("A", 2, "fire", 1)],
        "entity string, year int, type string, value long",
    )
    info = spark.createDataFrame([("A", 1), ("A", 2)], "entity string, year int")
    got = rows(impact.validated_counts(facts, info), ["year", "type", "total", "scope"])
    assert got == [(1, "flood", 5, "World"), (2, "fire", 1, "World")]


def test_ignoring_case(spark):
    df = spark.createDataFrame([("Overall",), ("overall",), ("East",)], "region string")
    folded = case_insensitive(df, "region")
    assert df.filter(F.col("region") == "Overall").count() == 1
    assert folded.filter(F.col("region") == "Overall").count() == 2
    assert folded.groupBy("region").count().count() == 2


@pytest.mark.parametrize("missing", [None, 0.0])
def test_impact_with_missing_population(spark, missing):
    facts = spark.createDataFrame([("A", 10.0), ("A", 20.0), ("B", 30.0)], "entity string, displacements double")
    info = panel(spark, [("A", 1, 100.0, 5.0), ("A", 2, missing, 5.0)], "population", "gdp")
    master = spark.createDataFrame([("A", "X"), ("B", "X")], "entity string, continent string")
    got = impact.continent_impact(facts, info, master).first()
    assert got.avg_displacements == pytest.approx((10 + 10 + 20 + 20 + 30) / 5)
    assert got.pct_displacements == pytest.approx(100 * (0.1 + 0.2) / 2)
    assert got.avg_population == pytest.approx(100.0 if missing is None else 50.0)


def test_trade_keys_that_are_null_belong_to_no_pair(spark):
    schema = "year int, product string, sub_product string, side string, value double"
    rows_ = [
        (2000, "a", "x", "import", 1.0), (2000, "a", "x", "export", 3.0),
        (2000, None, "x", "import", 5.0), (2000, None, "x", "export", 7.0),
        (None, "a", "x", "import", 9.0), (None, "a", "x", "export", 9.0),
    ]
    table = spark.createDataFrame(rows_, schema)
    assert [r["product"] for r in trade.two_sided_average(table).collect()] == ["a"]
    assert [r.year for r in trade.yearly_totals(table).collect()] == [2000]
    assert [tuple(r) for r in trade.matched_difference(table).collect()] == [(2000, "a", "x", 2.0)]


def test_several_rows_for_one_side_are_an_error(spark):
    schema = "year int, product string, sub_product string, side string, value double"
    rows_ = [(2000, "a", "x", "import", 1.0), (2000, "a", "x", "import", 4.0), (2000, "a", "x", "export", 3.0)]
    table = spark.createDataFrame(rows_, schema)
    for result in (trade.matched_difference(table), trade.years_with_many(table, 0)):
        with pytest.raises(Exception, match="several rows for one side"):
            result.collect()
