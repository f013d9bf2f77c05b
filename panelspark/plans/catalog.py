"""The registered queries: every operator over tables derived from the whole star schema.

Ratios of sums and averages of ratios are rounded, so that the order in which Spark adds doubles
cannot show; plain sums and averages are over whole cents or quantities and need no rounding.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.functions import safe_ratio
from panelspark.operators import (
    aggregates,
    asof,
    cohorts,
    documents,
    entities,
    frames,
    hierarchy,
    impact,
    intervals,
    ranks,
    refresh,
    rollups,
    season,
    sketches,
    slices,
    topn,
    trade,
    windows,
)
from panelspark.sources import star
from panelspark.sources.tables import materialise, save_derived, scratch_folder
from panelspark.streaming.windows import append_closed, stream, window_totals

Query = Callable[[SparkSession, str], DataFrame]

AGGREGATES = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
SLICE_METRICS = ["population", "gdp", "urgent", "large", "low_share_value"]
CLASS_TOTALS = {
    "firm": ["urgent", "high"],
    "flexible": ["medium", "unspecified", "low"],
    "bulky": ["low", "large"],
}
MIX_SHARES = {"pct_flexible": "flexible", "pct_bulky": "bulky"}
CUSTOMER_LAYOUT = documents.DocumentLayout(
    details=("population",), totals=("population",), leaves={"gdp": ("orders", "value")}
)
SURPLUS_PAIRS = 76


def _rounded(df: DataFrame, *columns: str, digits: int = 4) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def _master(spark: SparkSession, sf: str) -> DataFrame:
    return entities.entity_master(star.entities(spark, sf))


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return documents.to_documents(star.panel(spark, sf), star.PANEL_LAYOUT)


def _customer_docs(spark: SparkSession, sf: str) -> DataFrame:
    return documents.to_documents(star.customer_years(spark, sf), CUSTOMER_LAYOUT)


def _trade_docs(spark: SparkSession, sf: str) -> DataFrame:
    return documents.trade_documents(star.trade(spark, sf))


def _household_docs(spark: SparkSession, sf: str) -> DataFrame:
    return documents.household_documents(star.household(spark, sf), star.town_gas(spark, sf))


def _stored_panel(spark: SparkSession, sf: str, since: int | None = None) -> DataFrame:
    """The panel written once, for queries that read it more than once."""
    return materialise(star.panel(spark, sf, since))


# Entities and coverage


def entity_master(spark, sf):
    """The real ones among nations, aggregates and customers."""
    everyone = star.entities(spark, sf).unionByName(star.customer_members(spark, sf))
    return entities.entity_master(everyone)


def derived_roundtrip(spark, sf):
    """Written, replaced from itself, read back through its view name, and summarised."""
    save_derived(star.panel(spark, sf), "derived_panel")
    save_derived(spark.table("derived_panel").filter("entity IS NOT NULL"), "derived_panel")
    return (
        spark.table("derived_panel")
        .groupBy("entity")
        .agg(F.count(F.lit(1)).alias("n_rows"), F.sum("gdp").alias("gdp"), F.sum("large").alias("large"))
    )


def docs_roundtrip(spark, sf):
    return documents.metric_rows(_docs(spark, sf))


def entities_list(spark, sf):
    return entities.list_entities(star.panel_entities(spark, sf), _master(spark, sf))


def entities_count(spark, sf):
    return entities.count_entities(entities_list(spark, sf))


def year_span(spark, sf):
    return entities.year_span(star.customer_years(spark, sf))


def year_span_docs(spark, sf):
    return entities.year_span_docs(_customer_docs(spark, sf))


def full_coverage(spark, sf):
    master = entities.entity_master(star.customer_entities(spark, sf))
    return entities.full_coverage(star.customer_years(spark, sf), master)


def full_coverage_docs(spark, sf):
    master = entities.entity_master(star.customer_entities(spark, sf))
    span = entities.year_span(star.customer_years(spark, sf)).select("n_years").scalar()
    covered = entities.full_coverage_docs(_customer_docs(spark, sf), master, span)
    return covered.select("entity", F.posexplode("yearlyData").alias("position", "y")).select(
        "entity", "position", "y.year", F.col("y.countryDetails.population").alias("orders")
    )


# Slices and derived columns


def panel_slice(spark, sf):
    return slices.panel_slice(
        star.panel(spark, sf, 1996, 2000), SLICE_METRICS, entities=AGGREGATES, since=1996, until=2000
    )


def panel_slice_docs(spark, sf):
    return documents.panel_slice_docs(
        _docs(spark, sf), SLICE_METRICS, entities=AGGREGATES, since=1996, until=2000
    )


def panel_slice_stored_docs(spark, sf):
    """The slice of documents that are stored first, so that only the fields it needs are read."""
    return documents.panel_slice_docs(
        materialise(_docs(spark, sf)), SLICE_METRICS, entities=AGGREGATES, since=1996, until=2000
    )


def threshold_crossing(spark, sf):
    return slices.threshold_crossing(
        star.panel(spark, sf), "urgent_share_value", 20.0, ["high_share_value", "low_share_value"]
    )


def new_sources_docs(spark, sf):
    return slices.new_sources_docs(
        _docs(spark, sf), "urgent_share_value", 20.0, key_pattern="value", excluded=["urgent", "high"]
    )


RATIOS = {"gdp_per_capita": ("gdp", "population"), "large_per_urgent": ("large", "urgent")}
PERCENTS = {"pct_low": ("low", "gdp"), "pct_large": ("large", "gdp")}


def ratio_columns(spark, sf):
    with_ratios = slices.ratio_columns(star.panel(spark, sf), RATIOS, PERCENTS)
    return with_ratios.select("entity", "year", *RATIOS, *PERCENTS)


def ratio_columns_docs(spark, sf):
    rows = documents.panel_slice_docs(_docs(spark, sf), ["gdp", "population", "large", "urgent", "low"])
    return slices.ratio_columns(rows, RATIOS, PERCENTS).select("entity", "year", *RATIOS, *PERCENTS)


def class_totals(spark, sf):
    totals = slices.group_sum_columns(star.panel(spark, sf), CLASS_TOTALS)
    return totals.select("entity", "year", "orders", *CLASS_TOTALS)


def class_totals_docs(spark, sf):
    metrics = ["orders", "urgent", "high", "medium", "unspecified", "low", "large"]
    rows = documents.panel_slice_docs(_docs(spark, sf), metrics)
    return slices.group_sum_columns(rows, CLASS_TOTALS).select("entity", "year", "orders", *CLASS_TOTALS)


# Aggregates


def cohort_average(spark, sf):
    return aggregates.cohort_average(
        star.panel(spark, sf, 1996, 2001), "gdp", _master(spark, sf), since=1996, until=2001
    )


def cohort_average_docs(spark, sf):
    rows = documents.panel_slice_docs(_docs(spark, sf), ["gdp"], _master(spark, sf))
    return aggregates.cohort_average(rows, "gdp", since=1996, until=2001)


def two_sided_average(spark, sf):
    return trade.two_sided_average(star.trade(spark, sf))


def two_sided_average_docs(spark, sf):
    return trade.two_sided_average(documents.trade_rows(_trade_docs(spark, sf)))


def period_average(spark, sf):
    return aggregates.period_average(star.household(spark, sf))


def period_average_docs(spark, sf):
    regions = aggregates.period_average_docs(_household_docs(spark, sf))
    return regions.select("region", F.posexplode("yearlyData").alias("position", "y")).select(
        "region", "position", "y.year", F.col("y.yearly_avg_kwh_per_acc").alias("yearly_avg")
    )


def yearly_totals(spark, sf):
    return trade.yearly_totals(star.trade(spark, sf, 1996), since=1996)


def yearly_totals_docs(spark, sf):
    return trade.yearly_totals(documents.trade_rows(_trade_docs(spark, sf)), empty_as_zero=True)


def yearly_balance(spark, sf):
    return trade.yearly_balance(star.trade(spark, sf, 1996), since=1996)


def yearly_balance_docs(spark, sf):
    return trade.yearly_balance(documents.trade_rows(_trade_docs(spark, sf)), empty_as_zero=True)


def _mix(rows: DataFrame, members: DataFrame) -> DataFrame:
    return aggregates.continent_mix(rows, members, CLASS_TOTALS, "gdp", "firm", MIX_SHARES)


def continent_mix(spark, sf):
    return _mix(star.panel(spark, sf), star.entities(spark, sf))


def continent_mix_docs(spark, sf):
    metrics = ["gdp", "urgent", "high", "medium", "unspecified", "low", "large"]
    return _mix(documents.panel_slice_docs(_docs(spark, sf), metrics), star.entities(spark, sf))


def continent_average(spark, sf):
    averages = aggregates.continent_average(
        star.panel(spark, sf), star.entities(spark, sf), "low_share_value"
    )
    return _rounded(averages, "avg_low_share_value", "avg_gdp_per_capita")


def emission_shares(spark, sf):
    emissions = star.emissions(spark, sf, 1996)
    return aggregates.emission_shares(emissions, ["coal", "gas", "oil"], after=1995)


def average_of_shares(spark, sf):
    return _rounded(
        aggregates.average_of_shares(emission_shares(spark, sf)),
        "avg_fossil_co2_share",
        "avg_co2_ghg_share",
        digits=8,
    )


# Windows


def moving_average(spark, sf):
    return windows.moving_average(star.panel(spark, sf), ["urgent", "large"], 3)


def negative_change_pairs(spark, sf):
    return windows.negative_change_pairs(star.panel(spark, sf), "urgent", "gdp", 3)


def moving_average_docs(spark, sf):
    return windows.moving_average_docs(_docs(spark, sf), "large", 3, ["gdp"])


def falling_pairs_docs(spark, sf):
    averages = windows.moving_average_docs(_docs(spark, sf), "urgent", 3, ["gdp"])
    return windows.falling_pairs(averages, "entity", "year", "urgent_ma", "gdp_ma")


def adjacent_pairs(spark, sf):
    pairs = windows.adjacent_pairs(star.customer_years(spark, sf), "entity", "year", ["gdp"])
    return pairs.select(
        "entity",
        "year",
        F.size("pair").alias("members"),
        F.get("pair", F.lit(0))["gdp"].alias("first_gdp"),
        F.get("pair", F.lit(1))["gdp"].alias("second_gdp"),
    )


def yoy_difference(spark, sf):
    averages = aggregates.regional_averages(star.household(spark, sf))
    return windows.yoy_difference(averages, "region", "yearly_avg")


def yoy_difference_docs(spark, sf):
    averages = aggregates.annual_rows_docs(_household_docs(spark, sf))
    return windows.yoy_difference(averages, "region", "yearly_avg", separator=" - ")


def count_negative_years(spark, sf):
    return windows.count_negative_years(yoy_difference(spark, sf), "region", 3)


def count_negative_years_docs(spark, sf):
    return windows.count_negative_years(yoy_difference_docs(spark, sf), "region", 3)


def years_with_many(spark, sf):
    return trade.years_with_many(star.trade(spark, sf), SURPLUS_PAIRS)


def years_with_many_docs(spark, sf):
    return trade.years_with_many(documents.trade_rows(_trade_docs(spark, sf)), SURPLUS_PAIRS)


# Seasonality


def quarterly_by_date(spark, sf):
    return season.quarterly_by_date(star.household(spark, sf))


def quarterly_by_month(spark, sf):
    return season.quarterly_by_month(star.town_gas(spark, sf))


def _unnested(profile: DataFrame, key: str) -> DataFrame:
    years = profile.select(key, F.posexplode("years").alias("year_position", "y"))
    return years.select(
        key, "year_position", "y.year", F.posexplode("y.quarters").alias("quarter_position", "q")
    ).select(key, "year_position", "year", "quarter_position", "q.quarter", "q.avg_kwh")


def quarterly_docs(spark, sf):
    return _unnested(season.quarterly_docs(_household_docs(spark, sf)), "region")


def quarterly_gas_docs(spark, sf):
    return _unnested(season.quarterly_gas_docs(_household_docs(spark, sf)), "sub_housing_type")


def scaled_bars(spark, sf):
    return season.scaled_bars(season.quarterly_by_date(star.household(spark, sf)))


# Several sources


def matched_difference(spark, sf):
    return trade.matched_difference(star.trade(spark, sf))


def matched_difference_docs(spark, sf):
    years = trade.matched_difference_docs(_trade_docs(spark, sf))
    products = years.select("year", F.posexplode("products").alias("product_position", "p"))
    return products.select(
        "year", "product_position", "p.product",
        F.posexplode("p.sub_products").alias("sub_position", "s"),
    ).select("year", "product_position", "product", "sub_position", "s.sub_product", "s.yearly_diff")


def align_inner(spark, sf):
    year = F.year("recorded").cast("int")
    measured = star.ordered(spark, sf, 1996).filter((F.col("value") != 0) & (year > 1995))
    temperatures = impact.by_period(measured, year, avg_temp=F.avg("value"))
    gases = (
        star.emissions(spark, sf, 1996)
        .filter(F.col("year") > 1995)
        .groupBy(F.col("year").alias("period"))
        .agg(F.sum("ghg").alias("total_ghg"))
    )
    return impact.align_series(temperatures, gases, how="inner")


def align_left(spark, sf):
    """Months of shipping against order and event months, some of which do not exist."""

    def monthly(df: DataFrame, **averages: Column) -> DataFrame:
        """Grouped by the month as a date; the text of its label is made once per month."""
        by_month = impact.by_period(df, F.trunc("recorded", "month"), **averages)
        return by_month.withColumn("period", F.left(F.col("period").cast("string"), F.lit(7)))

    return impact.align_series(
        monthly(star.shipped(spark, sf), avg_extent=F.avg("value")),
        monthly(star.ordered(spark, sf), avg_level=F.avg("value")),
        monthly(star.observed(spark, sf), avg_temp=F.avg("value")),
    )


def align_two_key(spark, sf):
    facts = star.customer_facts(spark, sf, 1996)
    damages = facts.groupBy("entity", "year").agg(F.sum("cents").alias("damage"))
    deaths = facts.filter(F.col("type") == "F").groupBy("entity", "year").agg(F.sum("cents").alias("deaths"))
    return impact.align_two_key(damages, deaths, "damage", "deaths", since=1996)


def validated_counts(spark, sf):
    facts = star.customer_facts(spark, sf)
    known = facts.filter(F.col("type") == "F").select("entity", "year").distinct()
    return impact.validated_counts(facts, known)


def continent_exposure(spark, sf):
    return impact.continent_exposure(star.exposure(spark, sf), _master(spark, sf), "exposed")


def _displaced(spark, sf):
    return star.displacements(spark, sf).filter(F.col("hazard") == "R")


IMPACT_COLUMNS = [
    "avg_displacements", "avg_population", "pct_displacements", "avg_gdp_per_capita",
]


def continent_impact(spark, sf):
    averages = impact.continent_impact(
        _displaced(spark, sf), star.panel(spark, sf), _master(spark, sf)
    )
    return _rounded(averages, *IMPACT_COLUMNS)


def continent_impact_exposed(spark, sf):
    averages = impact.continent_impact(
        _displaced(spark, sf),
        star.panel(spark, sf),
        _master(spark, sf),
        exposure=star.exposure(spark, sf),
    )
    return _rounded(averages, *IMPACT_COLUMNS, "avg_exposed")


def loss_above_average(spark, sf):
    losses = star.exposure(spark, sf).withColumnRenamed("exposed", "loss")
    nations = _stored_panel(spark, sf).join(_master(spark, sf).select("entity"), "entity", "left_semi")
    result = impact.loss_above_average(losses, nations)
    return _rounded(result, "avg_loss", "avg_population", "avg_gdp", "pct_loss")


# Frames by value, as-of and interval joins, whole-table ranks


def range_frame_pairs(spark, sf):
    """Each order against all orders of its customer in its year and the year before."""
    measures = {
        "n_frame": ("count", "order_key"),
        "frame_value": ("sum", "value"),
        "smallest": ("min", "value"),
        "largest": ("max", "value"),
        "avg_value": ("avg", "value"),
        "types": ("values", "type"),
    }
    framed = frames.range_frame(star.dated_orders(spark, sf), "entity", "year", measures)
    return _rounded(framed.withColumn("types", F.array_join("types", "")), "avg_value").drop("ordered")


def range_frame_members(spark, sf):
    """The orders of each customer in each year and the year before it, oldest year first."""
    members = frames.frame_members(star.dated_orders(spark, sf), "entity", "year", ["order_key"])
    listed = F.transform("members", lambda m: F.concat(m["year"], F.lit(":"), m["order_key"]))
    return members.select("entity", "year", F.array_join(listed, " ").alias("members"))


def falling_frames(spark, sf):
    """Orders smaller than every order of their customer in the year before."""
    return frames.falling_frames(star.dated_orders(spark, sf), "entity", "year", "value").select(
        "entity", "year", "order_key", "value", "previous_value"
    )


def asof_rates(spark, sf):
    """Each event with the last rate its user was given before it."""
    rates = star.user_rates(spark, sf)
    joined = asof.asof_join(star.user_events(spark, sf), rates, "user", "at", ["rate", "rate_key"], "rate_key")
    return joined.select("event_id", "user", "rate_key", "rate", (F.col("value") * F.col("rate")).alias("rated"))


def asof_next_rates(spark, sf):
    """Each event with the next rate of its user, if it comes within three days."""
    soon = lambda at, other: other <= at + F.expr("INTERVAL 3 DAYS")
    joined = asof.asof_join(
        star.user_events(spark, sf), star.user_rates(spark, sf), "user", "at", ["rate", "rate_key"], "rate_key",
        forward=True, within=soon,
    )
    return joined.select("event_id", "user", "rate_key", "rate")


def interval_overlaps(spark, sf):
    """Orders' terms, from days to more than a year, against the years in which their customer was active."""
    met = intervals.interval_join(star.order_terms(spark, sf), star.active_spans(spark, sf), ["entity"])
    return met.select("l.entity", "l.order_key", "r.year", "overlap")


def global_ranks(spark, sf):
    """All orders ranked by their value in thousands."""
    ranked = ranks.global_ranks(star.order_sizes(spark, sf), ["thousands"], ["order_key"], descending=True)
    measured = ranked.select(
        "order_key", "thousands", "position", "rank", "dense_rank", ranks.ntile(100).alias("tile"),
        ranks.percent_rank().alias("pct_rank"), ranks.cume_dist().alias("cume"),
    )
    return _rounded(measured, "pct_rank", "cume", digits=9)


def global_percentiles(spark, sf):
    values = star.ordered(spark, sf)
    return _rounded(ranks.global_percentiles(values, "value", [0, 0.01, 0.25, 0.5, 0.75, 0.99, 1]), "percentile")


# Levels, hierarchies, first rows, sketches, versions, streams


def order_cube(spark, sf):
    """Orders at all levels of continent, segment and status; a pending order's status is NULL."""
    dims = ["continent", "segment", "status"]
    measures = {
        "customers": ("count", "n"), "n_orders": ("sum", "n"), "value": ("sum", "value"),
        "largest": ("max", "largest"), "avg_value": ("avg", "value"),
    }
    cube = rollups.grouped_levels(star.order_levels(spark, sf), dims, measures, rollups.cube_sets(dims))
    return _rounded(cube, "avg_value")


def order_rollup(spark, sf):
    dims = ["continent", "segment", "status"]
    measures = {"n_orders": ("sum", "n"), "value": ("sum", "value")}
    return rollups.grouped_levels(star.order_levels(spark, sf), dims, measures, rollups.rollup_sets(dims))


def territory_closure(spark, sf):
    return hierarchy.closure(star.territory_edges(spark, sf))


def territory_totals(spark, sf):
    """The value of all orders below each region, nation and customer."""
    pairs = hierarchy.closure(star.territory_edges(spark, sf))
    facts = star.customer_years(spark, sf).select(F.concat(F.lit("C"), "entity").alias("node"), "gdp")
    return hierarchy.subtree_totals(pairs, facts, "node", "gdp")


def top_orders(spark, sf):
    """The three largest orders of each customer."""
    return topn.top_rows(star.dated_orders(spark, sf), "entity", ["value", "order_key"], 3)


def first_order_lists(spark, sf):
    """The keys of each customer's five earliest orders by year, in one list."""
    lists = topn.top_lists(
        star.dated_orders(spark, sf).select("entity", "year", "order_key"), "entity", ["year", "order_key"], 5,
        descending=False,
    )
    return lists.select("entity", F.array_join(F.transform("rows", lambda r: r["order_key"].cast("string")), " ").alias("orders"))


def sketched_nations(spark, sf):
    """Per nation, from stored yearly sketches: do estimates lie within the sketches' error of the exact figures?"""
    rows = star.nation_orders(spark, sf)
    states = materialise(sketches.sketch_states(rows, ["nation", "year"], "customer", "value"))
    merged = sketches.merge_states(states, ["nation"])
    exact = (
        rows.groupBy("nation", "customer").agg(F.count(F.lit(1)).alias("n"))
        .groupBy("nation").agg(F.count(F.lit(1)).alias("customers"), F.sum("n").alias("n_orders"))
    )
    estimates = merged.select(
        "nation", "n_rows", sketches.n_distinct().alias("estimate"), sketches.quantile(0.5).alias("middle")
    )
    below = (
        rows.join(estimates.select("nation", "middle"), "nation")
        .groupBy("nation")
        .agg(F.avg((F.col("value") <= F.col("middle")).cast("int")).alias("share"))
    )
    return estimates.join(exact, "nation").join(below, "nation").select(
        "nation", "customers", "n_orders",
        (F.col("n_rows") == F.col("n_orders")).cast("int").alias("rows_equal"),
        (F.abs(F.col("estimate") - F.col("customers")) <= F.col("customers") * 0.03).cast("int").alias("distinct_near"),
        (F.abs(F.col("share") - 0.5) <= 0.02).cast("int").alias("median_near"),
    )


def _versions(spark, sf):
    """Two versions of the customers' years: without the orders marked ``P`` since 2000, and with all."""
    orders = star.dated_orders(spark, sf)
    early = orders.filter((F.col("year") < 2000) | (F.col("type") != "P"))
    years = lambda o: o.groupBy("entity", "year").agg(F.sum("value").alias("value"))
    return years(early), years(orders)


def version_changes(spark, sf):
    """The rows that one version holds and the other doesn't."""
    return refresh.changed_rows(*_versions(spark, sf))


def version_keys(spark, sf):
    """The customers' years that were inserted or updated between the versions."""
    changed = refresh.changed_keys(*_versions(spark, sf), ["entity", "year"])
    return changed.withColumn("columns", F.array_join("columns", ","))


def refreshed_years(spark, sf):
    """The first version stored by year and refreshed to the second: only changed years are written."""
    old, new = _versions(spark, sf)
    path = scratch_folder(spark, "refreshed")
    old.write.partitionBy("year").parquet(path)
    refresh.refresh_partitions(spark, path, new, "year")
    return spark.read.schema(new.schema).parquet(path).select(*new.columns)


def streamed_days(spark, sf):
    """Closed days of the stream of events, by type; an hour's delay."""
    folder = scratch_folder(spark, "stream")
    events = stream(spark, sf, "events").withColumn("cents", F.rint(F.col("value") * 100))
    measures = {"n": F.count(F.lit(1)), "value": F.sum("cents")}
    totals = window_totals(events, "ts", ["event_type"], "1 day", "1 hour", measures)
    closed = append_closed(totals, f"{folder}/table", f"{folder}/checkpoint")
    return closed.select(F.date_format("opens", "yyyy-MM-dd").alias("day"), "event_type", "n", "value")


# Ranking and cohorts


def rank_entities(spark, sf):
    ranked = cohorts.rank_entities(
        star.panel(spark, sf, 1996), safe_ratio("gdp", "population"), _master(spark, sf), since=1996
    )
    return _rounded(ranked, "avg_score")


def _cohort(panel: DataFrame, master: DataFrame, k: int = 5) -> DataFrame:
    return cohorts.rank_entities(panel, safe_ratio("low", "orders"), master, k=k).select("entity")


def _per_capita():
    return safe_ratio("gdp", "population").alias("gdp_per_capita")


def topk_rows(spark, sf):
    panel = _stored_panel(spark, sf)
    return cohorts.topk_rows(panel, _cohort(panel, _master(spark, sf)), ["low", _per_capita()], 1996)


def topk_yearly(spark, sf):
    panel = _stored_panel(spark, sf, 1996)
    cohort = cohorts.rank_entities(
        panel, F.col("low_share_value"), _master(spark, sf), since=1996,
        require=["gdp", "large"], k=5,
    ).select("entity")
    averages = cohorts.topk_yearly(panel, cohort, "low_share_value", 1996)
    return _rounded(averages, "avg_low_share_value", "avg_gdp_per_capita")


def topk_vs_benchmark(spark, sf):
    panel, everyone = _stored_panel(spark, sf), star.entities(spark, sf)
    real = cohorts.members_of(everyone, "ASIA", _master(spark, sf))
    compared = cohorts.topk_vs_benchmark(
        panel, _cohort(panel, real, 3), cohorts.members_of(everyone, "ASIA"), "ASIA",
        "low_share_value", 1996,
    )
    return _rounded(compared, "avg_low_share_value", "avg_gdp_per_capita")


def topk_rows_docs(spark, sf):
    docs = materialise(_docs(spark, sf))
    metrics = ["gdp", "population", "orders", "low"]
    rows = documents.panel_slice_docs(docs, metrics)
    return cohorts.topk_rows(rows, _cohort(rows, _master(spark, sf)), ["low", _per_capita()], 1996)


QUERIES: dict[str, Query] = {
    q.__name__: q
    for q in (
        entity_master, derived_roundtrip, docs_roundtrip,
        entities_list, entities_count, year_span, year_span_docs, full_coverage, full_coverage_docs,
        panel_slice, panel_slice_docs, panel_slice_stored_docs, threshold_crossing, new_sources_docs,
        ratio_columns, ratio_columns_docs, class_totals, class_totals_docs,
        cohort_average, cohort_average_docs, two_sided_average, two_sided_average_docs,
        period_average, period_average_docs, yearly_totals, yearly_totals_docs,
        yearly_balance, yearly_balance_docs, continent_mix, continent_mix_docs, continent_average,
        emission_shares, average_of_shares,
        moving_average, negative_change_pairs, moving_average_docs, falling_pairs_docs,
        adjacent_pairs, yoy_difference, yoy_difference_docs,
        count_negative_years, count_negative_years_docs, years_with_many, years_with_many_docs,
        quarterly_by_date, quarterly_by_month, quarterly_docs, quarterly_gas_docs, scaled_bars,
        matched_difference, matched_difference_docs,
        align_inner, align_left, align_two_key, validated_counts,
        continent_exposure, continent_impact, continent_impact_exposed, loss_above_average,
        range_frame_pairs, range_frame_members, falling_frames, asof_rates, asof_next_rates,
        interval_overlaps, global_ranks, global_percentiles,
        order_cube, order_rollup, territory_closure, territory_totals, top_orders, first_order_lists,
        sketched_nations, version_changes, version_keys, refreshed_years, streamed_days,
        rank_entities, topk_rows, topk_yearly, topk_vs_benchmark, topk_rows_docs,
    )
}
