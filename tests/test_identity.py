"""Rewrites that make a plan scale give the same rows as the literal form."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from helpers import rows, same, trade_from_sides, trade_side
from panelspark.functions import safe_ratio
from panelspark.operators import cohorts, impact, trade, windows
from panelspark.sources import star


@pytest.fixture(scope="module")
def panel(spark, sf_dir):
    return star.panel(spark, sf_dir).cache()


def test_partitioned_window_equals_global_window(panel):
    everything = Window.orderBy("entity", "year").rowsBetween(-2, 0)
    place = F.row_number().over(Window.partitionBy("entity").orderBy("year"))
    literal = (
        panel.withColumn("gdp_ma", F.avg("gdp").over(everything))
        .withColumn("place", place)
        .filter("place > 2")
    )
    ours = windows.moving_average(panel, ["gdp"], 3)
    names = ["entity", "year", "gdp_ma"]
    assert rows(ours, names) == rows(literal, names)


def test_one_pass_pairs_equal_self_join(panel):
    averages = windows.moving_average(panel, ["urgent", "gdp"], 3)
    before, after = averages.alias("b"), averages.alias("a")
    fall = (F.col("b.entity") == F.col("a.entity")) & (F.col("b.year") + 1 == F.col("a.year"))
    falls = before.join(after, fall).filter("a.urgent_ma < b.urgent_ma")
    both = falls.select("b.entity", "b.period", "b.gdp_ma").union(
        falls.select("a.entity", "a.period", "a.gdp_ma")
    )
    ours = windows.negative_change_pairs(panel, "urgent", "gdp", 3)
    assert rows(ours, ["entity", "period", "gdp_ma"]) == rows(both.distinct(), ["entity", "period", "gdp_ma"])


def test_side_averages_equal_fan_out_join(spark, sf_dir):
    imports = trade_side(spark, sf_dir, "O").withColumnRenamed("value", "i")
    exports = trade_side(spark, sf_dir, "F").withColumnRenamed("value", "e")
    keys = ["product", "sub_product"]
    literal = (
        imports.drop("year").join(exports.drop("year"), keys).groupBy(*keys)
        .agg(F.avg("i").alias("import_avg"), F.avg("e").alias("export_avg"))
    )
    ours = trade.two_sided_average(star.trade(spark, sf_dir))
    assert rows(ours) == rows(literal)


def test_one_scan_of_both_sides_equals_two_tables(spark, sf_dir):
    assert rows(star.trade(spark, sf_dir)) == rows(trade_from_sides(spark, sf_dir))


def test_grouping_equals_windowed_count(spark, sf_dir):
    t = star.trade(spark, sf_dir)
    surplus = trade.matched_difference(t).filter("yearly_diff > 0")
    counted = surplus.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("year")))
    literal = counted.filter("n > 76").select("year").distinct()
    assert rows(trade.years_with_many(t, 76), ["year"]) == rows(literal)


@pytest.mark.parametrize("exposed", [False, True])
def test_moments_equal_fan_out_join(spark, sf_dir, panel, exposed):
    facts = star.displacements(spark, sf_dir)
    master = star.entities(spark, sf_dir).filter("entity <> continent")
    exposure = star.exposure(spark, sf_dir)
    pairs = facts.join(panel.select("entity", "population", "gdp"), "entity", "left")
    pairs = pairs.join(master.select("entity", "continent"), "entity")
    columns = [
        F.avg("displacements").alias("avg_displacements"),
        F.avg("population").alias("avg_population"),
        (100 * F.avg(safe_ratio("displacements", "population"))).alias("pct_displacements"),
        F.avg(safe_ratio("gdp", "population")).alias("avg_gdp_per_capita"),
    ]
    if exposed:
        pairs = pairs.join(exposure, "entity", "left")
        columns.append(F.avg("exposed").alias("avg_exposed"))
    literal = pairs.groupBy("continent").agg(*columns)
    ours = impact.continent_impact(facts, panel, master, exposure=exposure if exposed else None)
    assert same(rows(ours), rows(literal))


def test_adjacent_pairs_equal_the_range_frame(spark, sf_dir):
    p = star.customer_years(spark, sf_dir)
    frame = Window.partitionBy("entity").orderBy("year").rangeBetween(-1, 0)
    literal = p.select(
        "entity", "year",
        F.array_sort(F.collect_list(F.struct("year", "gdp")).over(frame)).alias("pair"),
    )
    ours = windows.adjacent_pairs(p, "entity", "year", ["gdp"])
    assert rows(ours) == rows(literal)


@pytest.mark.parametrize("partitions", [1, 3, 17])
def test_row_order_and_partitioning_do_not_matter(panel, partitions):
    shuffled = panel.orderBy(F.rand(seed=partitions)).repartition(partitions)
    for operator in (
        lambda p: windows.negative_change_pairs(p, "urgent", "gdp", 3),
        lambda p: windows.moving_average(p, ["large"], 3),
        lambda p: cohorts.rank_entities(p, F.col("gdp"), k=5),
        lambda p: windows.adjacent_pairs(p, "entity", "year", ["gdp"]).select("entity", "year", F.to_json("pair").alias("pair")),
    ):
        assert rows(operator(shuffled)) == rows(operator(panel))
