"""Plans and skew: what has to hold for the queries to work on a cluster."""

import pathlib
import re

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from helpers import final_plan, plan, rows, same, trade_side
from panelspark.operators import documents, entities
from panelspark.operators.cohorts import rank_entities, topk_rows
from panelspark.operators.windows import negative_change_pairs
from panelspark.plans import catalog
from panelspark.sources import star
from panelspark.sources.schemas import STAR
from panelspark.sources.tables import load, materialise, save_derived

HOT = 7


@pytest.fixture(scope="module")
def skewed_dir(spark, sf_dir, tmp_path_factory):
    """The star tables with a third of all rows on one customer, part and supplier."""
    folder = str(tmp_path_factory.mktemp("skewed"))
    third = F.pmod(F.xxhash64("o_orderkey"), F.lit(3)) == 0
    for name in STAR:
        df = load(spark, sf_dir, name)
        if name == "orders":
            df = df.withColumn("o_custkey", F.when(third, F.lit(HOT).cast("long")).otherwise(F.col("o_custkey")))
        if name == "lineitem":
            hot = F.pmod(F.xxhash64("l_orderkey", "l_linenumber"), F.lit(3)) == 0
            for key in ("l_partkey", "l_suppkey"):
                df = df.withColumn(key, F.when(hot, F.lit(HOT).cast("long")).otherwise(F.col(key)))
        if name in ("orders", "lineitem"):
            df = df.repartition(16)  # several map tasks, as any large table has
        df.write.parquet(f"{folder}/{name}.parquet")
    return folder


@pytest.fixture
def without_broadcast(spark):
    """Joins as they run when no side is small: shuffled, with skewed partitions split early."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_library_stays_on_the_cluster():
    """Nothing in the panel library brings rows to the driver or to Python, or pins them to a machine."""
    root = pathlib.Path(entry.__file__).parent / "panelspark"
    forbidden = r"\.collect\(|toPandas|toLocalIterator|\budf\b|pandas_udf|\.rdd\b|localCheckpoint|crossJoin|broadcast\("
    for file in root.rglob("*.py"):
        if "llm" in file.relative_to(root).parts:
            continue  # a library of its own, with its own tests
        assert not re.search(forbidden, file.read_text()), file


@pytest.mark.parametrize("key", list(catalog.QUERIES))
def test_plan_has_no_cross_join_python_or_global_window(spark, sf_dir, key):
    text = plan(entry.queries()[key](spark, sf_dir))
    assert not re.search(r"CartesianProduct|NestedLoopJoin|Python|Pandas", text)
    for window in re.findall(r"windowspecdefinition\(([^)]*)", text):
        assert not re.match(r"\w+#\d+L? (ASC|DESC)", window), "window without a partition"


SHUFFLED = [
    "entities_list", "full_coverage", "panel_slice", "two_sided_average", "matched_difference",
    "continent_mix", "negative_change_pairs", "quarterly_docs", "quarterly_by_date", "align_left",
    "align_two_key", "validated_counts", "continent_impact_exposed", "loss_above_average",
    "topk_rows", "topk_vs_benchmark", "docs_roundtrip", "adjacent_pairs", "emission_shares",
    "full_coverage_docs", "scaled_bars", "rank_entities",
    "range_frame_pairs", "range_frame_members", "falling_frames", "asof_rates", "asof_next_rates",
    "interval_overlaps", "global_ranks", "global_percentiles",
]


@pytest.mark.parametrize("key", SHUFFLED)
def test_skewed_tables_without_broadcast(spark, skewed_dir, without_broadcast, key):
    con = duckdb.connect()
    for table in STAR:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{skewed_dir}/{table}.parquet/*.parquet'")
    result = entry.queries()[key](spark, skewed_dir)
    expected = con.sql(entry.oracle_sql()[key])
    names = sorted(result.columns)
    place = [expected.columns.index(n) for n in names]
    wanted = [tuple(r[i] for i in place) for r in expected.fetchall()]
    assert wanted
    assert same(rows(result, names), wanted)


def test_hot_customer_reaches_the_join_as_one_row_per_year(spark, skewed_dir):
    years = star.customer_years(spark, skewed_dir)
    hot = load(spark, skewed_dir, "orders").filter(F.col("o_custkey") == HOT).count()
    assert hot > load(spark, skewed_dir, "orders").count() / 4
    assert years.filter(F.col("entity") == HOT).count() <= 7


def test_bucketed_panel_needs_no_shuffle(spark, sf_dir):
    years = star.customer_years(spark, sf_dir)
    stored = save_derived(years, "bucketed_years", buckets=8)
    assert rows(stored) == rows(years)
    pairs = negative_change_pairs(stored, "gdp", "population", 2)
    assert "Exchange" not in plan(pairs)
    assert rows(pairs) == rows(negative_change_pairs(years, "gdp", "population", 2))
    covered = stored.groupBy("entity").agg(F.count("year").alias("n"))
    assert "Exchange" not in plan(covered)
    documents_ = documents.to_documents(
        stored, documents.DocumentLayout(("gdp",), ("population",), {"gdp": ("orders", "value")})
    )
    assert "Exchange" not in plan(documents_)


def test_facts_are_grouped_below_the_join(spark, skewed_dir, without_broadcast):
    for table, key in ((star.trade, "l_partkey"), (star.household, "o_custkey"), (star.town_gas, "o_custkey")):
        lines = final_plan(table(spark, skewed_dir)).splitlines()
        join = next(i for i, line in enumerate(lines) if "Join" in line)
        below = [line for line in lines[join:] if "HashAggregate" in line]
        assert below and all(f"keys=[{key}" in line for line in below)
    # the hot part reaches the join as one row per year and side
    hot = load(spark, skewed_dir, "lineitem").filter(F.col("l_partkey") == HOT)
    assert hot.count() > load(spark, skewed_dir, "lineitem").count() / 4


def test_months_are_grouped_as_dates(spark, sf_dir):
    text = plan(catalog.align_left(spark, sf_dir))
    below = [line for line in text.splitlines() if "partial_avg" in line]
    assert below and not any("left(" in line or "as string" in line for line in below)
    assert "trunc(" in text


def test_covered_documents_are_not_written(spark, sf_dir):
    text = plan(catalog.full_coverage_docs(spark, sf_dir))
    assert "derived" not in text


def test_year_documents_grow_with_the_catalogue(spark, skewed_dir):
    flat = star.trade(spark, skewed_dir)
    docs = documents.trade_documents(flat)
    held = docs.select(F.explode("energy_products").alias("p")).agg(F.sum(F.size("p.sub_products"))).first()[0]
    assert held == flat.select("year", "product", "sub_product").distinct().count()


def test_scaled_bars_read_the_facts_once(spark, sf_dir):
    text = final_plan(catalog.scaled_bars(spark, sf_dir))
    assert text.count("ReusedSubquery") + text.count("ReusedExchange") >= 2


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    text = plan(trade_side(spark, sf_dir, "O"))
    lineitem = next(line for line in text.splitlines() if "FileScan" in line and "l_quantity" in line)
    assert "l_extendedprice" not in lineitem and "l_linestatus" in lineitem
    assert "EqualTo(l_linestatus,O)" in text
    ranged = read_schema(star.panel(spark, sf_dir, 1996, 2000))
    assert "GreaterThanOrEqual(o_orderdate,1996-01-01T00:00)" in ranged
    assert "LessThan(o_orderdate,2001-01-01T00:00)" in ranged
    stored = save_derived(star.panel(spark, sf_dir), "scan_panel", partition_by=["year"])
    sliced = plan(stored.filter((F.col("year") >= 2000) & F.col("entity").isin("ASIA")).select("entity", "gdp"))
    scan = next(line for line in sliced.splitlines() if "FileScan" in line)
    assert "gdp" in scan and "urgent" not in scan
    assert re.search(r"PartitionFilters: \[[^\]]*year", scan)
    assert "EqualTo(entity,ASIA)" in scan


def test_top_k_is_not_a_full_sort(spark, sf_dir):
    stored = save_derived(star.panel(spark, sf_dir), "topk_panel")
    cohort = rank_entities(stored, F.col("gdp"), k=5).select("entity")
    text = plan(topk_rows(stored, cohort, ["gdp"]))
    assert "TakeOrderedAndProject" in text and "BroadcastHashJoin" in text
    assert "rangepartitioning" not in text


def test_pairs_need_one_shuffle_of_a_stored_panel(spark, sf_dir):
    stored = save_derived(star.panel(spark, sf_dir), "pairs_panel")
    text = plan(negative_change_pairs(stored, "urgent", "gdp", 3))
    assert text.count("Exchange") == 1 and text.count("Sort ") == 1


def read_schema(df):
    """ReadSchema of the scan, untruncated."""
    spark = df.sparkSession
    before = spark.conf.get("spark.sql.maxMetadataStringLength")
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    try:
        return plan(df.select("*"))
    finally:
        spark.conf.set("spark.sql.maxMetadataStringLength", before)


def test_documents_are_read_by_nested_column(spark, sf_dir):
    docs = materialise(documents.to_documents(star.panel(spark, sf_dir), star.PANEL_LAYOUT))
    sliced = documents.panel_slice_docs(docs, ["gdp"], ["ASIA"], since=1996)

    assert "EqualTo(country,ASIA)" in plan(sliced)
    assert "array<struct<year:int,countryDetails:struct<gdp:double>>>" in read_schema(sliced)
    assert "struct<yearlyData:array<struct<year:int>>>" in read_schema(entities.year_span_docs(docs))
