"""Panel, trade, household and impact tables derived from the star schema.

Every table is one lazy plan over the whole star tables.  Amounts are carried in whole cents
(integer-valued doubles), so sums are exact and do not depend on the order Spark adds them in.

The tables take a range of years where a query needs only those: the range is put on the stored
date, not on the derived year, so files and row groups outside it are not read.

Skew: facts are aggregated by their key *before* the join with the dimension, so a customer with a
third of all orders reaches the join as a handful of rows.  That goes for groupings by a column of the
dimension as well (trade by part, monthly orders by segment), whose sums are summed again after it.
``nation`` and ``region`` have a fixed size; whether ``customer``, ``supplier`` or ``part`` is
broadcast is left to Spark's own size check.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.operators.documents import DocumentLayout
from panelspark.sources.schemas import LARGE_ORDER_CENTS
from panelspark.sources.tables import load

# The order priorities and the metric each one feeds.
CLASSES = {
    "urgent": "1-URGENT",
    "high": "2-HIGH",
    "medium": "3-MEDIUM",
    "unspecified": "4-NOT SPECIFIED",
    "low": "5-LOW",
}
SHARE_VALUE = [f"{c}_share_value" for c in CLASSES]
SHARE_ORDERS = [f"{c}_share_orders" for c in CLASSES]

PANEL_LAYOUT = DocumentLayout(
    details=("gdp", "population"),
    totals=("orders",),
    leaves={
        **{c: (c, "amount") for c in CLASSES},
        **{f"{c}_share_value": (c, "share") for c in CLASSES},
        **{f"{c}_share_orders": (c, "share") for c in CLASSES},
        "large": ("large", "amount"),
    },
)


def cents(column: str) -> Column:
    return F.rint(F.col(column) * 100)


def _dated(df: DataFrame, column: str, since: int | None, until: int | None) -> DataFrame:
    """Rows of whole years, as a range on the date itself, which the scan can prune by."""
    if since is not None:
        df = df.filter(F.col(column) >= F.lit(f"{since}-01-01").cast("timestamp_ntz"))
    if until is not None:
        df = df.filter(F.col(column) < F.lit(f"{until + 1}-01-01").cast("timestamp_ntz"))
    return df


def entities(spark: SparkSession, directory: str) -> DataFrame:
    """Entity master: nations, and for each region two aggregate rows a master has to drop."""
    region = load(spark, directory, "region")
    nation = load(spark, directory, "nation")
    nations = nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        F.col("n_name").alias("entity"),
        F.col("n_nationkey").cast("string").alias("code"),
        F.col("r_name").alias("continent"),
    )
    by_name = region.select(
        F.col("r_name").alias("entity"), F.col("r_name").alias("code"), F.col("r_name").alias("continent")
    )
    by_code = region.select(
        F.concat(F.lit("WORLD "), "r_name").alias("entity"),
        F.concat(F.lit("OWID_"), "r_name").alias("code"),
        F.col("r_name").alias("continent"),
    )
    return nations.unionByName(by_name).unionByName(by_code)


def customer_members(spark: SparkSession, directory: str) -> DataFrame:
    """Customers as entities of the continent (region) of their nation."""
    customer = load(spark, directory, "customer")
    nation = load(spark, directory, "nation")
    region = load(spark, directory, "region")
    return (
        customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            F.col("c_name").alias("entity"),
            F.col("c_custkey").cast("string").alias("code"),
            F.col("r_name").alias("continent"),
        )
    )


def customer_entities(spark: SparkSession, directory: str) -> DataFrame:
    """Entity master over customers: as many entities as the data has customers."""
    return load(spark, directory, "customer").select(
        F.col("c_custkey").alias("entity"),
        F.col("c_name").alias("code"),
        F.col("c_mktsegment").alias("continent"),
    )


def customer_years(spark: SparkSession, directory: str) -> DataFrame:
    """Sparse panel with one row per (customer, year in which the customer ordered)."""
    orders = load(spark, directory, "orders")
    return orders.groupBy(
        F.col("o_custkey").alias("entity"), F.year("o_orderdate").cast("int").alias("year")
    ).agg(
        F.sum(cents("o_totalprice")).alias("gdp"),
        F.count(F.lit(1)).cast("double").alias("population"),
    )


def panel(
    spark: SparkSession,
    directory: str,
    since: int | None = None,
    until: int | None = None,
    large_from: int = LARGE_ORDER_CENTS,
) -> DataFrame:
    """Entity-year panel of nations and, like any published panel, of aggregates (regions).

    The metric ``large`` is the value of the orders above ``large_from`` cents; NULL where a year has none.

    The first grouping leaves one row per (customer, year): it bounds a hot customer, and makes
    the number of distinct customers per nation and year a plain count.  The regions are summed
    from the nations' rows, not from a second scan.
    """
    sums = ["gdp", "orders", *CLASSES, *(f"{c}_orders" for c in CLASSES), "large"]
    classes = [
        f"sum(CASE WHEN o_orderpriority = '{text}' THEN cents END) AS {c}, "
        f"CAST(count(CASE WHEN o_orderpriority = '{text}' THEN 1 END) AS DOUBLE) AS {c}_orders"
        for c, text in CLASSES.items()
    ]
    shares = [
        f"try_divide(100D * {part}, {whole}) AS {c}_share_{kind}"
        for kind, suffix, whole in (("value", "", "gdp"), ("orders", "_orders", "orders"))
        for c, part in ((c, f"{c}{suffix}") for c in CLASSES)
    ]
    return spark.sql(
        f"""
        WITH order_cents AS (
          SELECT o_custkey, year(o_orderdate) AS year, o_orderpriority,
                 rint(o_totalprice * 100) AS cents
          FROM {{orders}}
        ),
        by_customer AS (
          SELECT o_custkey, year, sum(cents) AS gdp, CAST(count(*) AS DOUBLE) AS orders,
                 {", ".join(classes)},
                 sum(CASE WHEN cents > {large_from} THEN cents END) AS large
          FROM order_cents GROUP BY o_custkey, year
        ),
        by_nation AS (
          SELECT c_nationkey, year, CAST(count(*) AS DOUBLE) AS population,
                 {", ".join(f"sum({m}) AS {m}" for m in sums)}
          FROM by_customer JOIN {{customer}} ON o_custkey = c_custkey
          GROUP BY c_nationkey, year
        ),
        members AS (
          SELECT by_nation.*, inline(array(
                   struct(n_name AS entity, CAST(n_nationkey AS STRING) AS code),
                   struct(r_name AS entity, 'OWID_' || r_name AS code)))
          FROM by_nation JOIN {{nation}} ON c_nationkey = n_nationkey
          JOIN {{region}} ON n_regionkey = r_regionkey
        ),
        by_entity AS (
          SELECT entity, code, year, sum(population) AS population,
                 {", ".join(f"sum({m}) AS {m}" for m in sums)}
          FROM members GROUP BY entity, code, year
        )
        SELECT entity, code, year, population, gdp, orders, {", ".join(CLASSES)}, large,
               {", ".join(shares)}
        FROM by_entity
        """,
        orders=_dated(load(spark, directory, "orders"), "o_orderdate", since, until),
        customer=load(spark, directory, "customer"),
        nation=load(spark, directory, "nation"),
        region=load(spark, directory, "region"),
    )


def panel_entities(spark: SparkSession, directory: str) -> DataFrame:
    """(entity, code): the nations and regions of which the panel has rows."""
    nation = load(spark, directory, "nation")
    region = load(spark, directory, "region")
    customer = load(spark, directory, "customer")
    ordering = load(spark, directory, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct()
    seen = customer.join(ordering, "c_custkey", "left_semi").select(F.col("c_nationkey").alias("n_nationkey"))
    placed = nation.join(seen.distinct(), "n_nationkey", "left_semi").join(
        region, F.col("n_regionkey") == F.col("r_regionkey")
    )
    members = F.array(
        F.struct(F.col("n_name").alias("entity"), F.col("n_nationkey").cast("string").alias("code")),
        F.struct(F.col("r_name").alias("entity"), F.concat(F.lit("OWID_"), "r_name").alias("code")),
    )
    return placed.select(F.inline(members)).distinct()


def trade(
    spark: SparkSession, directory: str, since: int | None = None, until: int | None = None
) -> DataFrame:
    """Both sides in one scan: the long form that tagging two separate tables gives."""
    lineitem = _dated(load(spark, directory, "lineitem"), "l_shipdate", since, until)
    part = load(spark, directory, "part")
    side = F.when(F.col("l_linestatus") == "O", "import").when(F.col("l_linestatus") == "F", "export")
    by_part = lineitem.groupBy(
        "l_partkey", F.year("l_shipdate").cast("int").alias("year"), side.alias("side")
    ).agg(F.sum("l_quantity").alias("value"))
    return (
        by_part.filter(F.col("side").isNotNull())
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
        .groupBy("year", F.col("p_type").alias("product"), F.col("p_brand").alias("sub_product"), "side")
        .agg(F.sum("value").alias("value"))
    )


def _monthly_orders(spark: SparkSession, directory: str) -> DataFrame:
    orders = load(spark, directory, "orders")
    customer = load(spark, directory, "customer")
    by_customer = orders.groupBy(
        "o_custkey",
        F.col("o_orderstatus").alias("status"),
        F.year("o_orderdate").cast("int").alias("year"),
        F.month("o_orderdate").alias("m"),
    ).agg(F.sum(cents("o_totalprice")).alias("cents"))
    return (
        by_customer.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy(F.col("c_mktsegment").alias("segment"), "status", "year", "m")
        .agg(F.sum("cents").alias("cents"))
    )


def household(spark: SparkSession, directory: str) -> DataFrame:
    """Monthly consumption per region and dwelling type, with all the total rows mixed in."""
    month_text = F.concat(F.col("m").cast("string"), F.lit("/1/"), F.col("year").cast("string"))
    return (
        _monthly_orders(spark, directory)
        .withColumn("region", F.explode(F.array("segment", F.lit("Overall"))))
        .withColumn("dwelling_type", F.explode(F.array("status", F.lit("Overall"))))
        .withColumn("month", F.explode(F.array(month_text, F.lit("Annual"))))
        .withColumn(
            "description",
            F.when(F.col("dwelling_type") == "Overall", F.col("region")).otherwise(F.col("dwelling_type")),
        )
        .groupBy("region", "description", "dwelling_type", "year", "month")
        .agg(F.sum("cents").alias("kwh_per_acc"))
    )


def town_gas(spark: SparkSession, directory: str) -> DataFrame:
    """Monthly consumption per housing type; month holds numbers and two kinds of total text."""
    return (
        _monthly_orders(spark, directory)
        .withColumn(
            "sub_housing_type",
            F.explode(
                F.array(
                    F.col("status"),
                    F.lit("Overall"),
                    F.when(F.col("status") == "F", "Private Housing").otherwise("Public Housing"),
                )
            ),
        )
        .withColumn(
            "month",
            F.explode(
                F.array(
                    F.col("m").cast("string"), F.lit("na"), F.concat("segment", F.lit(" Region"))
                )
            ),
        )
        .groupBy("sub_housing_type", "year", "month")
        .agg(F.sum("cents").alias("kwh"))
    )


def emissions(
    spark: SparkSession, directory: str, since: int | None = None, until: int | None = None
) -> DataFrame:
    """Three emission parts (NULL where a supplier has none that year), their total and all gases."""
    lineitem = _dated(load(spark, directory, "lineitem"), "l_shipdate", since, until)

    def part(flag: str) -> Column:
        return F.sum(F.when(F.col("l_returnflag") == flag, F.col("l_quantity")))

    return lineitem.groupBy(
        F.col("l_suppkey").alias("entity"), F.year("l_shipdate").cast("int").alias("year")
    ).agg(
        part("A").alias("coal"),
        part("N").alias("gas"),
        part("R").alias("oil"),
        F.sum("l_quantity").alias("total"),
        F.sum(F.col("l_quantity") + F.col("l_linenumber")).alias("ghg"),
    )


def shipped(spark: SparkSession, directory: str) -> DataFrame:
    """Dated measurements: quantity shipped."""
    return load(spark, directory, "lineitem").select(
        F.col("l_shipdate").alias("recorded"), F.col("l_quantity").alias("value")
    )


def ordered(
    spark: SparkSession, directory: str, since: int | None = None, until: int | None = None
) -> DataFrame:
    """Dated measurements: order value in cents."""
    return _dated(load(spark, directory, "orders"), "o_orderdate", since, until).select(
        F.col("o_orderdate").alias("recorded"), cents("o_totalprice").alias("value")
    )


def observed(spark: SparkSession, directory: str) -> DataFrame:
    """Dated measurements: event value in cents."""
    return load(spark, directory, "events").select(
        F.col("ts").alias("recorded"), cents("value").alias("value")
    )


def customer_facts(
    spark: SparkSession, directory: str, since: int | None = None, until: int | None = None
) -> DataFrame:
    """Dated facts per customer with a type: (entity, year, type, value, cents)."""
    return _dated(load(spark, directory, "orders"), "o_orderdate", since, until).select(
        F.col("o_custkey").alias("entity"),
        F.year("o_orderdate").cast("int").alias("year"),
        F.col("o_orderstatus").alias("type"),
        F.lit(1).cast("long").alias("value"),
        cents("o_totalprice").alias("cents"),
    )


def displacements(spark: SparkSession, directory: str) -> DataFrame:
    """Impact facts: several rows per nation (one per supplier) and hazard (return flag)."""
    by_supplier = (
        load(spark, directory, "lineitem")
        .groupBy("l_suppkey", "l_returnflag")
        .agg(F.sum("l_quantity").alias("displacements"))
    )
    supplier = load(spark, directory, "supplier")
    nation = load(spark, directory, "nation")
    return (
        by_supplier.join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .select(F.col("n_name").alias("entity"), F.col("l_returnflag").alias("hazard"), "displacements")
    )


def exposure(spark: SparkSession, directory: str) -> DataFrame:
    """Exposure figures: one row per supplier, several per nation."""
    supplier = load(spark, directory, "supplier")
    nation = load(spark, directory, "nation")
    return supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("n_name").alias("entity"), cents("s_acctbal").alias("exposed")
    )


# The days an order is open, by its priority.
OPEN_DAYS = {"1-URGENT": 3, "2-HIGH": 10, "3-MEDIUM": 30, "4-NOT SPECIFIED": 90, "5-LOW": 500}


def dated_orders(spark: SparkSession, directory: str) -> DataFrame:
    """One row per order: (entity, year, order_key, type, value), several per customer and year."""
    return load(spark, directory, "orders").select(
        F.col("o_custkey").alias("entity"),
        F.year("o_orderdate").cast("int").alias("year"),
        F.col("o_orderkey").alias("order_key"),
        F.col("o_orderstatus").alias("type"),
        cents("o_totalprice").alias("value"),
    )


def user_events(spark: SparkSession, directory: str) -> DataFrame:
    """Dated measurements per user: event value in cents."""
    return load(spark, directory, "events").select(
        "event_id", F.col("user_id").alias("user"), F.col("ts").alias("at"), cents("value").alias("value")
    )


def user_rates(spark: SparkSession, directory: str) -> DataFrame:
    """Rates per user: a customer's orders, moved into the month of the events by their day of the year."""
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.dayofyear("o_orderdate") % 30)
    return load(spark, directory, "orders").select(
        F.col("o_custkey").alias("user"),
        day.cast("timestamp_ntz").alias("at"),
        F.col("o_orderkey").alias("rate_key"),
        F.floor(F.col("o_totalprice") / 1000).alias("rate"),
    )


def _day_number(column: str) -> Column:
    return F.unix_date(F.col(column).cast("date")).cast("long")


def order_terms(spark: SparkSession, directory: str) -> DataFrame:
    """The days on which an order is open, as a half-open interval of day numbers."""
    days = F.coalesce(
        *[F.when(F.col("o_orderpriority") == name, F.lit(n)) for name, n in OPEN_DAYS.items()]
    )
    return load(spark, directory, "orders").select(
        F.col("o_custkey").alias("entity"),
        F.col("o_orderkey").alias("order_key"),
        _day_number("o_orderdate").alias("start"),
        (_day_number("o_orderdate") + days).alias("end"),
    )


def active_spans(spark: SparkSession, directory: str) -> DataFrame:
    """From a customer's first to its last order of a year, as a half-open interval of day numbers."""
    day = _day_number("o_orderdate")
    return (
        load(spark, directory, "orders")
        .groupBy(F.col("o_custkey").alias("entity"), F.year("o_orderdate").cast("int").alias("year"))
        .agg(F.min(day).alias("start"), (F.max(day) + 1).alias("end"))
    )


def order_sizes(spark: SparkSession, directory: str) -> DataFrame:
    """Order value in thousands, of which many orders share one."""
    return load(spark, directory, "orders").select(
        F.col("o_orderkey").alias("order_key"), F.floor(F.col("o_totalprice") / 1000).alias("thousands")
    )


def order_levels(spark: SparkSession, directory: str) -> DataFrame:
    """Orders by continent, segment and status: (continent, segment, status, n, value), status NULL if pending.

    Summed by customer and status before the join, so a customer reaches it as a few rows.
    """
    by_customer = (
        load(spark, directory, "orders")
        .groupBy("o_custkey", F.nullif("o_orderstatus", F.lit("P")).alias("status"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(cents("o_totalprice")).alias("value"),
            F.max(cents("o_totalprice")).alias("largest"),
        )
    )
    customer = load(spark, directory, "customer")
    nation = load(spark, directory, "nation")
    region = load(spark, directory, "region")
    return (
        by_customer.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            F.col("r_name").alias("continent"), F.col("c_mktsegment").alias("segment"), "status", "n", "value", "largest"
        )
    )


def territory_edges(spark: SparkSession, directory: str) -> DataFrame:
    """(parent, child): region over nation over customer over the customer's market."""
    nation = load(spark, directory, "nation")
    customer = load(spark, directory, "customer")
    regions = nation.select(
        F.concat(F.lit("R"), "n_regionkey").alias("parent"), F.concat(F.lit("N"), "n_nationkey").alias("child")
    )
    members = customer.select(
        F.concat(F.lit("N"), "c_nationkey").alias("parent"), F.concat(F.lit("C"), "c_custkey").alias("child")
    )
    return regions.unionByName(members)


def nation_orders(spark: SparkSession, directory: str) -> DataFrame:
    """(nation, year, customer, value): one row per order, with the nation of its customer."""
    orders = load(spark, directory, "orders")
    customer = load(spark, directory, "customer")
    nation = load(spark, directory, "nation")
    return (
        orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("n_name").alias("nation"),
            F.year("o_orderdate").cast("int").alias("year"),
            F.col("o_custkey").alias("customer"),
            cents("o_totalprice").alias("value"),
        )
    )
