"""Independent SQL for every registered query, for a second engine to run on the same tables.

Written from the definition of each analysis, not from the Spark plans: sides are joined where
Spark groups, facts fan out where Spark multiplies moments, distinct customers are counted
directly, and the document queries are answered from the flat tables.
"""

from __future__ import annotations

_CLASSES = {
    "urgent": "1-URGENT",
    "high": "2-HIGH",
    "medium": "3-MEDIUM",
    "unspecified": "4-NOT SPECIFIED",
    "low": "5-LOW",
}


def _each(template: str, separator: str = ",\n    ") -> str:
    return separator.join(template.format(c=c, text=text) for c, text in _CLASSES.items())


ENTITIES = """
entities AS (
  SELECT n_name AS entity, n_nationkey::VARCHAR AS code, r_name AS continent
  FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT r_name, r_name, r_name FROM region
  UNION ALL SELECT 'WORLD ' || r_name, 'OWID_' || r_name, r_name FROM region
),
master AS (SELECT * FROM entities WHERE code NOT LIKE 'OWID%' AND continent <> entity)
"""

PANEL = f"""
order_rows AS (
  SELECT n_name, n_nationkey, r_name, year(o_orderdate)::INT AS year, o_custkey, o_orderpriority,
         round(o_totalprice * 100) AS cents
  FROM orders JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
),
member_rows AS (
  SELECT n_name AS entity, n_nationkey::VARCHAR AS code, * FROM order_rows
  UNION ALL SELECT r_name AS entity, 'OWID_' || r_name AS code, * FROM order_rows
),
panel_sums AS (
  SELECT entity, code, year, count(DISTINCT o_custkey)::DOUBLE AS population, sum(cents) AS gdp,
    count(*)::DOUBLE AS orders,
    {_each("sum(CASE WHEN o_orderpriority = '{text}' THEN cents END) AS {c}")},
    {_each("count(CASE WHEN o_orderpriority = '{text}' THEN 1 END)::DOUBLE AS {c}_orders")},
    sum(CASE WHEN cents > 49500000 THEN cents END) AS large
  FROM member_rows GROUP BY entity, code, year
),
panel AS (
  SELECT *, {_each("100::DOUBLE * {c} / nullif(gdp, 0) AS {c}_share_value")},
    {_each("100::DOUBLE * {c}_orders / nullif(orders, 0) AS {c}_share_orders")}
  FROM panel_sums
)
"""

CUSTOMER_YEARS = """
customer_years AS (
  SELECT o_custkey AS entity, year(o_orderdate)::INT AS year, sum(round(o_totalprice * 100)) AS gdp,
         count(*)::DOUBLE AS population
  FROM orders GROUP BY 1, 2
)
"""

TRADE = """
trade_rows AS (
  SELECT year(l_shipdate)::INT AS year, p_type AS product, p_brand AS sub_product, l_linestatus,
         sum(l_quantity) AS value
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3, 4
),
imports AS (SELECT year, product, sub_product, value FROM trade_rows WHERE l_linestatus = 'O'),
exports AS (SELECT year, product, sub_product, value FROM trade_rows WHERE l_linestatus = 'F')
"""

HOUSEHOLD = """
monthly AS (
  SELECT c_mktsegment AS segment, o_orderstatus AS status, year(o_orderdate)::INT AS year,
         month(o_orderdate)::INT AS m, round(o_totalprice * 100) AS cents
  FROM orders JOIN customer ON o_custkey = c_custkey
),
annual AS (SELECT segment AS region, year, sum(cents) AS yearly_avg FROM monthly GROUP BY 1, 2),
month_sums AS (SELECT segment AS region, year, m, sum(cents) AS kwh FROM monthly GROUP BY 1, 2, 3),
quarters AS (
  SELECT region, year, ((m + 2) // 3)::INT AS quarter, avg(kwh) AS avg_kwh
  FROM month_sums GROUP BY 1, 2, 3
),
gas_sums AS (
  SELECT status AS sub_housing_type, year, m, sum(cents) AS kwh FROM monthly GROUP BY 1, 2, 3
),
gas_quarters AS (
  SELECT sub_housing_type, year,
         CASE WHEN m <= 3 THEN 1 WHEN m <= 6 THEN 2 WHEN m <= 9 THEN 3 ELSE 4 END::INT AS quarter,
         avg(kwh) AS avg_kwh
  FROM gas_sums GROUP BY 1, 2, 3
),
falls AS (
  SELECT region, year, yearly_avg - lag(yearly_avg) OVER (PARTITION BY region ORDER BY year)
         AS difference
  FROM annual
)
"""

RATES = """
rates AS (
  SELECT o_custkey AS user, DATE '2024-01-01' + (dayofyear(o_orderdate) % 30)::INT AS at,
    max(o_orderkey) AS rate_key, arg_max(floor(o_totalprice / 1000)::BIGINT, o_orderkey) AS rate
  FROM orders GROUP BY 1, 2
)
"""

LEVELS = """
levels AS (
  SELECT r_name AS continent, c_mktsegment AS segment, nullif(o_orderstatus, 'P') AS status, o_custkey,
    count(*) AS n, sum(round(o_totalprice * 100)) AS value, max(round(o_totalprice * 100)) AS largest
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey
  GROUP BY 1, 2, 3, 4
)
"""

TERRITORY = """
edges AS (
  SELECT 'R' || n_regionkey AS parent, 'N' || n_nationkey AS child FROM nation
  UNION ALL SELECT 'N' || c_nationkey, 'C' || c_custkey FROM customer
),
paths AS (
  SELECT parent AS ancestor, child AS descendant, 1 AS depth FROM edges
  UNION ALL SELECT ancestor, child, depth + 1 FROM paths JOIN edges ON descendant = parent
)
"""

VERSIONS = """
fresh AS (
  SELECT o_custkey AS entity, year(o_orderdate)::INT AS year, sum(round(o_totalprice * 100)) AS value
  FROM orders GROUP BY 1, 2
),
stale AS (
  SELECT o_custkey AS entity, year(o_orderdate)::INT AS year, sum(round(o_totalprice * 100)) AS value
  FROM orders WHERE year(o_orderdate) < 2000 OR o_orderstatus <> 'P' GROUP BY 1, 2
)
"""

EMISSIONS = """
emissions AS (
  SELECT l_suppkey AS entity, year(l_shipdate)::INT AS year,
    sum(CASE WHEN l_returnflag = 'A' THEN l_quantity END) AS coal,
    sum(CASE WHEN l_returnflag = 'N' THEN l_quantity END) AS gas,
    sum(CASE WHEN l_returnflag = 'R' THEN l_quantity END) AS oil,
    sum(l_quantity) AS total, sum(l_quantity + l_linenumber) AS ghg
  FROM lineitem GROUP BY 1, 2
),
yearly_emissions AS (
  SELECT year, sum(coal + gas + oil) AS total_fossil, sum(total) AS total_co2, sum(ghg) AS total_ghg
  FROM emissions WHERE year > 1995 GROUP BY year
),
emission_shares AS (
  SELECT *, total_fossil / nullif(total_co2, 0) AS fossil_co2_share,
    total_fossil / nullif(total_ghg, 0) AS fossil_ghg_share,
    total_co2 / nullif(total_ghg, 0) AS co2_ghg_share
  FROM yearly_emissions
)
"""

IMPACT = """
displaced AS (
  SELECT n_name AS entity, sum(l_quantity) AS displacements
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
  WHERE l_returnflag = 'R' GROUP BY n_name, l_suppkey
),
exposure AS (
  SELECT n_name AS entity, round(s_acctbal * 100) AS exposed
  FROM supplier JOIN nation ON s_nationkey = n_nationkey
)
"""

CUSTOMER_FACTS = """
facts AS (
  SELECT o_custkey AS entity, year(o_orderdate)::INT AS year, o_orderstatus AS type,
         round(o_totalprice * 100) AS cents
  FROM orders
)
"""


def _with(*parts: str) -> str:
    return "WITH " + ",".join(parts)


def _sql(select: str, *parts: str) -> str:
    return f"{_with(*parts)}\n{select}"


_LEAVES = [("amount", "{c}"), ("share", "{c}_share_value"), ("share", "{c}_share_orders")]
_METRIC_ROWS = "\n  UNION ALL ".join(
    [
        f"SELECT entity, position, year, '{c}' AS energy, '{kind}' AS type, "
        f"'{name.format(c=c)}' AS metric, {name.format(c=c)}::DOUBLE AS value FROM placed"
        for c in _CLASSES
        for kind, name in _LEAVES
    ]
    + ["SELECT entity, position, year, 'large', 'amount', 'large', large FROM placed"]
)
_PLACED = """placed AS (
  SELECT *, (row_number() OVER (PARTITION BY entity ORDER BY year) - 1)::INT AS position FROM panel
)"""

_SLICE = _sql(
    """SELECT entity, year, population, gdp, urgent, large, low_share_value FROM panel
    WHERE entity IN ('AFRICA', 'AMERICA', 'ASIA', 'EUROPE', 'MIDDLE EAST')
      AND year BETWEEN 1996 AND 2000""",
    PANEL,
)
_RATIOS = _sql(
    """SELECT entity, year, gdp / nullif(population, 0) AS gdp_per_capita,
      large / nullif(urgent, 0) AS large_per_urgent,
      100::DOUBLE * low / nullif(gdp, 0) AS pct_low, 100::DOUBLE * large / nullif(gdp, 0) AS pct_large
    FROM panel""",
    PANEL,
)
_CLASS_TOTALS = _sql(
    """SELECT entity, year, orders, urgent + high AS firm, medium + unspecified + low AS flexible,
      low + large AS bulky
    FROM panel""",
    PANEL,
)
_COHORT_AVERAGE = _sql(
    """SELECT entity, avg(gdp) AS avg_gdp FROM panel
    WHERE entity IN (SELECT entity FROM master) AND year BETWEEN 1996 AND 2001 AND gdp <> 0
    GROUP BY entity""",
    ENTITIES,
    PANEL,
)
_TWO_SIDED = _sql(
    """SELECT i.product, i.sub_product, avg(i.value) AS import_avg, avg(e.value) AS export_avg
    FROM imports i JOIN exports e ON i.product = e.product AND i.sub_product = e.sub_product
    WHERE i.value IS NOT NULL AND e.value IS NOT NULL
    GROUP BY 1, 2""",
    TRADE,
)
_TOTALS_CTE = """
totals AS (
  SELECT i.year, i.t AS total_import, e.t AS total_export
  FROM (SELECT year, sum(value) AS t FROM imports GROUP BY year) i
  JOIN (SELECT year, sum(value) AS t FROM exports GROUP BY year) e ON i.year = e.year
)
"""
_MIX = _sql(
    """SELECT continent, year, firm, flexible, bulky, flexible / nullif(avg_total, 0) AS pct_flexible,
      bulky / nullif(avg_total, 0) AS pct_bulky
    FROM (
      SELECT continent, year, avg(gdp) AS avg_total, avg(urgent + high) AS firm,
        avg(medium + unspecified + low) AS flexible, avg(low + large) AS bulky
      FROM panel JOIN entities USING (entity) WHERE continent IS NOT NULL GROUP BY 1, 2
    ) WHERE firm <> 0""",
    ENTITIES,
    PANEL,
)


def _moving(metric: str) -> str:
    return (
        f"avg({metric}) OVER (PARTITION BY entity ORDER BY year "
        "ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)"
    )


_LABEL = "(year - 2)::INT::VARCHAR || ' - ' || year::INT::VARCHAR"
_AVERAGES = f"""
averages AS (
  SELECT entity, year, {_LABEL} AS period, urgent_ma, large_ma, gdp_ma
  FROM (
    SELECT entity, year, {_moving("urgent")} AS urgent_ma, {_moving("large")} AS large_ma,
      {_moving("gdp")} AS gdp_ma, row_number() OVER (PARTITION BY entity ORDER BY year) AS place
    FROM panel
  ) WHERE place >= 3
)
"""
_SURPLUS = _sql(
    """SELECT e.year, count(*) AS surplus_pairs
    FROM exports e JOIN imports i USING (year, product, sub_product)
    WHERE e.value - i.value > 0 GROUP BY e.year HAVING count(*) > 76""",
    TRADE,
)
_TOP3 = """SELECT region, count(*) AS instances FROM falls WHERE difference < 0
    GROUP BY region ORDER BY instances DESC, region LIMIT 3"""
_COHORT = """
cohort AS (
  SELECT entity FROM panel WHERE entity IN (SELECT entity FROM master) GROUP BY entity
  ORDER BY avg(low / nullif(orders, 0)) DESC NULLS LAST, entity LIMIT 5
)
"""
_TOPK_ROWS = _sql(
    """SELECT entity, year, low, gdp / nullif(population, 0) AS gdp_per_capita
    FROM panel JOIN cohort USING (entity) WHERE year >= 1996 AND gdp IS NOT NULL""",
    ENTITIES,
    PANEL,
    _COHORT,
)
_IMPACT_AVERAGES = """round(avg(displacements), 4) AS avg_displacements,
      round(avg(population), 4) AS avg_population,
      round(100::DOUBLE * avg(displacements / nullif(population, 0)), 4) AS pct_displacements,
      round(avg(gdp / nullif(population, 0)), 4) AS avg_gdp_per_capita"""

ORACLE: dict[str, str] = {
    "entity_master": _sql(
        """SELECT entity, code, continent FROM master
        UNION ALL
        SELECT c_name, c_custkey::VARCHAR, r_name
        FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
        ENTITIES,
    ),
    "derived_roundtrip": _sql(
        """SELECT entity, count(*) AS n_rows, sum(gdp) AS gdp, sum(large) AS large
        FROM panel GROUP BY entity""",
        PANEL,
    ),
    "docs_roundtrip": _sql(
        f"SELECT * FROM ({_METRIC_ROWS}) WHERE value IS NOT NULL", PANEL, _PLACED
    ),
    "entities_list": _sql(
        """SELECT DISTINCT p.entity, p.code FROM panel p JOIN master m ON p.entity = m.entity
        WHERE p.code NOT LIKE 'OWID%' AND p.code <> ''""",
        ENTITIES,
        PANEL,
    ),
    "entities_count": _sql(
        """SELECT count(*) AS entities FROM (
          SELECT DISTINCT p.entity, p.code FROM panel p JOIN master m ON p.entity = m.entity
          WHERE p.code NOT LIKE 'OWID%' AND p.code <> '')""",
        ENTITIES,
        PANEL,
    ),
    "year_span": """SELECT min(year(o_orderdate))::INT AS min_year, max(year(o_orderdate))::INT AS max_year,
      (max(year(o_orderdate)) - min(year(o_orderdate)) + 1)::INT AS n_years FROM orders""",
    "year_span_docs": """SELECT min(year(o_orderdate))::INT AS min_year,
      max(year(o_orderdate))::INT AS max_year,
      (max(year(o_orderdate)) - min(year(o_orderdate)) + 1)::INT AS n_years FROM orders""",
    "full_coverage": """SELECT o_custkey AS entity, count(DISTINCT year(o_orderdate)) AS n_years
      FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer) GROUP BY o_custkey
      HAVING count(DISTINCT year(o_orderdate)) =
        (SELECT max(year(o_orderdate)) - min(year(o_orderdate)) + 1 FROM orders)""",
    "full_coverage_docs": _sql(
        """SELECT entity, (row_number() OVER (PARTITION BY entity ORDER BY year) - 1)::INT AS position,
          year, population AS orders
        FROM customer_years
        WHERE entity IN (SELECT c_custkey FROM customer) AND entity IN (
          SELECT entity FROM customer_years GROUP BY entity
          HAVING count(*) = (SELECT max(year) - min(year) + 1 FROM customer_years))""",
        CUSTOMER_YEARS,
    ),
    "panel_slice": _SLICE,
    "panel_slice_docs": _SLICE,
    "panel_slice_stored_docs": _SLICE,
    "threshold_crossing": _sql(
        """SELECT entity, year, urgent_share_value, high_share_value, low_share_value,
          min(year) OVER (PARTITION BY entity) AS first_year
        FROM panel WHERE urgent_share_value < 20""",
        PANEL,
    ),
    "new_sources_docs": _sql(
        "SELECT * FROM ("
        + " UNION ALL ".join(
            f"""SELECT entity, year, urgent_share_value AS crossing_share, '{c}' AS energy,
            {c}_share_value AS energy_share FROM panel WHERE urgent_share_value < 20"""
            for c in ("medium", "unspecified", "low")
        )
        + ") WHERE energy_share <> 0",
        PANEL,
    ),
    "ratio_columns": _RATIOS,
    "ratio_columns_docs": _RATIOS,
    "class_totals": _CLASS_TOTALS,
    "class_totals_docs": _CLASS_TOTALS,
    "cohort_average": _COHORT_AVERAGE,
    "cohort_average_docs": _COHORT_AVERAGE,
    "two_sided_average": _TWO_SIDED,
    "two_sided_average_docs": _TWO_SIDED,
    "period_average": _sql("SELECT region, year, yearly_avg FROM annual", HOUSEHOLD),
    "period_average_docs": _sql(
        """SELECT region, (row_number() OVER (PARTITION BY region ORDER BY year) - 1)::INT AS position,
          year, yearly_avg FROM annual""",
        HOUSEHOLD,
    ),
    "yearly_totals": _sql("SELECT * FROM totals WHERE year >= 1996", TRADE, _TOTALS_CTE),
    "yearly_totals_docs": _sql("SELECT * FROM totals", TRADE, _TOTALS_CTE),
    "yearly_balance": _sql(
        "SELECT year, total_export - total_import AS balance FROM totals WHERE year >= 1996",
        TRADE,
        _TOTALS_CTE,
    ),
    "yearly_balance_docs": _sql(
        "SELECT year, total_export - total_import AS balance FROM totals", TRADE, _TOTALS_CTE
    ),
    "continent_mix": _MIX,
    "continent_mix_docs": _MIX,
    "continent_average": _sql(
        """SELECT continent, round(avg(low_share_value), 4) AS avg_low_share_value,
          round(avg(gdp / nullif(population, 0)), 4) AS avg_gdp_per_capita
        FROM panel JOIN entities USING (entity) WHERE gdp IS NOT NULL AND continent IS NOT NULL
        GROUP BY continent""",
        ENTITIES,
        PANEL,
    ),
    "emission_shares": _sql("SELECT * FROM emission_shares", EMISSIONS),
    "average_of_shares": _sql(
        """SELECT round(avg(fossil_co2_share), 8) AS avg_fossil_co2_share,
          round(avg(co2_ghg_share), 8) AS avg_co2_ghg_share FROM emission_shares""",
        EMISSIONS,
    ),
    "moving_average": _sql(
        "SELECT entity, year, period, urgent_ma, large_ma FROM averages", PANEL, _AVERAGES
    ),
    "negative_change_pairs": _sql(
        """SELECT entity, period, gdp_ma FROM (
          SELECT *, lag(urgent_ma) OVER (PARTITION BY entity ORDER BY period) AS before,
            lead(urgent_ma) OVER (PARTITION BY entity ORDER BY period) AS after
          FROM averages)
        WHERE (urgent_ma - before < 0 OR urgent_ma - after > 0) AND gdp_ma IS NOT NULL""",
        PANEL,
        _AVERAGES,
    ),
    "moving_average_docs": _sql(
        f"""SELECT entity, year, {_LABEL} AS period, large_ma, gdp_ma FROM (
          SELECT entity, year, {_moving("large")} AS large_ma, {_moving("gdp")} AS gdp_ma,
            row_number() OVER (PARTITION BY entity ORDER BY year) AS place
          FROM panel WHERE large IS NOT NULL)
        WHERE place >= 3""",
        PANEL,
    ),
    "falling_pairs_docs": _sql(
        """SELECT a.entity, a.year, a.gdp_ma FROM known_averages a
        LEFT JOIN known_averages b ON a.entity = b.entity AND b.year = a.year - 1
        LEFT JOIN known_averages c ON a.entity = c.entity AND c.year = a.year + 1
        WHERE (b.urgent_ma > a.urgent_ma OR a.urgent_ma > c.urgent_ma) AND a.gdp_ma IS NOT NULL""",
        PANEL,
        f"""known_averages AS (
          SELECT * FROM (
            SELECT entity, year, {_moving("urgent")} AS urgent_ma, {_moving("gdp")} AS gdp_ma,
              row_number() OVER (PARTITION BY entity ORDER BY year) AS place
            FROM panel WHERE urgent IS NOT NULL)
          WHERE place >= 3)""",
    ),
    "adjacent_pairs": _sql(
        """SELECT c.entity, c.year, (CASE WHEN p.entity IS NULL THEN 1 ELSE 2 END)::INT AS members,
          coalesce(p.gdp, c.gdp) AS first_gdp,
          CASE WHEN p.entity IS NOT NULL THEN c.gdp END AS second_gdp
        FROM customer_years c
        LEFT JOIN customer_years p ON c.entity = p.entity AND p.year = c.year - 1""",
        CUSTOMER_YEARS,
    ),
    "yoy_difference": _sql(
        """SELECT region, year, (year - 1)::INT::VARCHAR || '-' || year::VARCHAR AS duration, difference
        FROM falls WHERE difference < 0""",
        HOUSEHOLD,
    ),
    "yoy_difference_docs": _sql(
        """SELECT region, year, (year - 1)::INT::VARCHAR || ' - ' || year::VARCHAR AS duration, difference
        FROM falls WHERE difference < 0""",
        HOUSEHOLD,
    ),
    "count_negative_years": _sql(_TOP3, HOUSEHOLD),
    "count_negative_years_docs": _sql(_TOP3, HOUSEHOLD),
    "years_with_many": _SURPLUS,
    "years_with_many_docs": _SURPLUS,
    "quarterly_by_date": _sql("SELECT * FROM quarters", HOUSEHOLD),
    "quarterly_by_month": _sql("SELECT * FROM gas_quarters", HOUSEHOLD),
    "quarterly_docs": _sql(
        """SELECT region, (dense_rank() OVER (PARTITION BY region ORDER BY year) - 1)::INT AS year_position,
          year, (row_number() OVER (PARTITION BY region, year ORDER BY quarter) - 1)::INT
          AS quarter_position, quarter, avg_kwh FROM quarters""",
        HOUSEHOLD,
    ),
    "quarterly_gas_docs": _sql(
        """SELECT sub_housing_type,
          (dense_rank() OVER (PARTITION BY sub_housing_type ORDER BY year) - 1)::INT AS year_position,
          year, (row_number() OVER (PARTITION BY sub_housing_type, year ORDER BY quarter) - 1)::INT
          AS quarter_position, quarter, avg_kwh FROM gas_quarters""",
        HOUSEHOLD,
    ),
    "scaled_bars": _sql(
        """SELECT *, repeat('*', round(100 * (avg_kwh - (SELECT min(avg_kwh) FROM quarters)) /
          ((SELECT max(avg_kwh) FROM quarters) - (SELECT min(avg_kwh) FROM quarters)))::BIGINT) AS bar
        FROM quarters""",
        HOUSEHOLD,
    ),
    "matched_difference": _sql(
        """SELECT year, product, sub_product, e.value - i.value AS yearly_diff
        FROM exports e JOIN imports i USING (year, product, sub_product)""",
        TRADE,
    ),
    "matched_difference_docs": _sql(
        """SELECT year, (dense_rank() OVER (PARTITION BY year ORDER BY product) - 1)::INT
          AS product_position, product,
          (row_number() OVER (PARTITION BY year, product ORDER BY sub_product) - 1)::INT AS sub_position,
          sub_product, e.value - i.value AS yearly_diff
        FROM exports e FULL JOIN imports i USING (year, product, sub_product)""",
        TRADE,
    ),
    "align_inner": _sql(
        """SELECT t.period, avg_temp, total_ghg FROM (
          SELECT year(o_orderdate)::INT AS period, avg(round(o_totalprice * 100)) AS avg_temp
          FROM orders WHERE o_totalprice <> 0 AND year(o_orderdate) > 1995 GROUP BY 1) t
        JOIN (SELECT year, sum(ghg) AS total_ghg FROM emissions WHERE year > 1995 GROUP BY year) g
        ON t.period = g.year""",
        EMISSIONS,
    ),
    "align_left": """SELECT s.period, avg_extent, avg_level, avg_temp
      FROM (SELECT strftime(l_shipdate, '%Y-%m') AS period, avg(l_quantity) AS avg_extent
            FROM lineitem GROUP BY 1) s
      LEFT JOIN (SELECT strftime(o_orderdate, '%Y-%m') AS period, avg(round(o_totalprice * 100)) AS avg_level
            FROM orders GROUP BY 1) o ON s.period = o.period
      LEFT JOIN (SELECT strftime(ts, '%Y-%m') AS period, avg(round(value * 100)) AS avg_temp
            FROM events GROUP BY 1) t ON s.period = t.period""",
    "align_two_key": _sql(
        """SELECT d.entity, avg(damage) AS avg_damage, avg(deaths) AS avg_deaths
        FROM (SELECT entity, year, sum(cents) AS damage FROM facts GROUP BY 1, 2) d
        LEFT JOIN (SELECT entity, year, sum(cents) AS deaths FROM facts WHERE type = 'F' GROUP BY 1, 2) f
        ON d.entity = f.entity AND d.year = f.year
        WHERE d.year >= 1996 GROUP BY d.entity""",
        CUSTOMER_FACTS,
    ),
    "validated_counts": _sql(
        """SELECT f.year, f.type, count(*) AS total, 'World' AS scope
        FROM facts f JOIN (SELECT DISTINCT entity, year FROM facts WHERE type = 'F') k
        ON f.entity = k.entity AND f.year = k.year GROUP BY f.year, f.type""",
        CUSTOMER_FACTS,
    ),
    "continent_exposure": _sql(
        """SELECT continent, avg(exposed) AS below, 100::DOUBLE - avg(exposed) AS above
        FROM exposure JOIN entities USING (entity) WHERE entity IN (SELECT entity FROM master)
        GROUP BY continent""",
        ENTITIES,
        IMPACT,
    ),
    "continent_impact": _sql(
        f"""SELECT continent, {_IMPACT_AVERAGES}
        FROM displaced d LEFT JOIN entities c ON c.entity = d.entity
        LEFT JOIN panel p ON p.entity = d.entity
        WHERE d.entity IN (SELECT entity FROM master) GROUP BY continent""",
        ENTITIES,
        PANEL,
        IMPACT,
    ),
    "continent_impact_exposed": _sql(
        f"""SELECT continent, {_IMPACT_AVERAGES}, round(avg(exposed), 4) AS avg_exposed
        FROM displaced d LEFT JOIN exposure m ON m.entity = d.entity
        LEFT JOIN entities c ON c.entity = d.entity
        LEFT JOIN panel p ON p.entity = d.entity
        WHERE d.entity IN (SELECT entity FROM master) GROUP BY continent""",
        ENTITIES,
        PANEL,
        IMPACT,
    ),
    "loss_above_average": _sql(
        """SELECT e.entity, round(avg(exposed), 4) AS avg_loss, round(avg(population), 4) AS avg_population,
          round(avg(gdp), 4) AS avg_gdp, round(100::DOUBLE * avg(exposed / nullif(gdp, 0)), 4) AS pct_loss
        FROM exposure e JOIN nations p ON e.entity = p.entity
        WHERE population >= (SELECT avg(population) FROM nations) GROUP BY e.entity""",
        ENTITIES,
        PANEL,
        IMPACT,
        "nations AS (SELECT * FROM panel WHERE entity IN (SELECT entity FROM master))",
    ),
    "rank_entities": _sql(
        """SELECT entity, round(avg(gdp / nullif(population, 0)), 4) AS avg_score FROM panel
        WHERE entity IN (SELECT entity FROM master) AND year >= 1996 GROUP BY entity""",
        ENTITIES,
        PANEL,
    ),
    "topk_rows": _TOPK_ROWS,
    "topk_rows_docs": _TOPK_ROWS,
    "topk_yearly": _sql(
        """SELECT year, round(avg(low_share_value), 4) AS avg_low_share_value,
          round(avg(gdp / nullif(population, 0)), 4) AS avg_gdp_per_capita
        FROM panel WHERE year >= 1996 AND gdp IS NOT NULL AND entity IN (
          SELECT entity FROM panel
          WHERE year >= 1996 AND gdp IS NOT NULL AND large IS NOT NULL
            AND entity IN (SELECT entity FROM master)
          GROUP BY entity ORDER BY avg(low_share_value) DESC NULLS LAST, entity LIMIT 5)
        GROUP BY year""",
        ENTITIES,
        PANEL,
    ),
    "topk_vs_benchmark": _sql(
        """SELECT entity, round(avg(low_share_value), 4) AS avg_low_share_value,
          round(avg(gdp / nullif(population, 0)), 4) AS avg_gdp_per_capita
        FROM panel WHERE year >= 1996 AND gdp IS NOT NULL AND entity IN (
          SELECT p.entity FROM panel p JOIN master m ON p.entity = m.entity WHERE continent = 'ASIA'
          GROUP BY p.entity ORDER BY avg(low / nullif(orders, 0)) DESC NULLS LAST, p.entity LIMIT 3)
        GROUP BY entity
        UNION
        SELECT continent, round(avg(low_share_value), 4), round(avg(gdp / nullif(population, 0)), 4)
        FROM panel JOIN entities USING (entity) WHERE continent = 'ASIA' AND year >= 1996
        GROUP BY continent""",
        ENTITIES,
        PANEL,
    ),
    "range_frame_pairs": """
        SELECT o_custkey AS entity, year(o_orderdate)::INT AS year, o_orderkey AS order_key,
          o_orderstatus AS type, round(o_totalprice * 100) AS value, count(*) OVER near AS n_frame,
          sum(round(o_totalprice * 100)) OVER near AS frame_value,
          min(round(o_totalprice * 100)) OVER near AS smallest,
          max(round(o_totalprice * 100)) OVER near AS largest,
          round(avg(round(o_totalprice * 100)) OVER near, 4) AS avg_value,
          (CASE WHEN count(*) FILTER (o_orderstatus = 'F') OVER near > 0 THEN 'F' ELSE '' END
            || CASE WHEN count(*) FILTER (o_orderstatus = 'O') OVER near > 0 THEN 'O' ELSE '' END
            || CASE WHEN count(*) FILTER (o_orderstatus = 'P') OVER near > 0 THEN 'P' ELSE '' END) AS types
        FROM orders WINDOW near AS (PARTITION BY o_custkey ORDER BY year(o_orderdate)
          RANGE BETWEEN 1 PRECEDING AND CURRENT ROW)""",
    "range_frame_members": """
        WITH dated AS (
          SELECT o_custkey AS entity, year(o_orderdate)::INT AS year, o_orderkey AS order_key FROM orders
        )
        SELECT a.entity, a.year, string_agg(b.year || ':' || b.order_key, ' ' ORDER BY b.year, b.order_key) AS members
        FROM (SELECT DISTINCT entity, year FROM dated) a
        JOIN dated b ON a.entity = b.entity AND b.year BETWEEN a.year - 1 AND a.year
        GROUP BY a.entity, a.year""",
    "falling_frames": """
        WITH dated AS (
          SELECT o_custkey AS entity, year(o_orderdate)::INT AS year, o_orderkey AS order_key,
            round(o_totalprice * 100) AS value
          FROM orders
        )
        SELECT a.entity, a.year, a.order_key, a.value, min(b.value) AS previous_value
        FROM dated a JOIN dated b ON a.entity = b.entity AND b.year = a.year - 1
        GROUP BY a.entity, a.year, a.order_key, a.value HAVING a.value < min(b.value)""",
    "asof_rates": f"""
        WITH {RATES}
        SELECT event_id, user_id AS user, rate_key, rate, round(value * 100) * rate AS rated
        FROM events ASOF LEFT JOIN rates ON user_id = rates.user AND ts >= rates.at""",
    "asof_next_rates": f"""
        WITH {RATES}
        SELECT event_id, user_id AS user,
          CASE WHEN rates.at <= ts + INTERVAL 3 DAY THEN rate_key END AS rate_key,
          CASE WHEN rates.at <= ts + INTERVAL 3 DAY THEN rate END AS rate
        FROM events ASOF LEFT JOIN rates ON user_id = rates.user AND ts <= rates.at""",
    "interval_overlaps": """
        WITH terms AS (
          SELECT o_custkey AS entity, o_orderkey AS order_key, o_orderdate::DATE AS first_day,
            o_orderdate::DATE + CASE o_orderpriority WHEN '1-URGENT' THEN 3 WHEN '2-HIGH' THEN 10
              WHEN '3-MEDIUM' THEN 30 WHEN '4-NOT SPECIFIED' THEN 90 WHEN '5-LOW' THEN 500 END AS past_day
          FROM orders
        ),
        spans AS (
          SELECT o_custkey AS entity, year(o_orderdate)::INT AS year, min(o_orderdate)::DATE AS first_day,
            max(o_orderdate)::DATE + 1 AS past_day
          FROM orders GROUP BY 1, 2
        )
        SELECT t.entity, order_key, year,
          date_diff('day', greatest(t.first_day, s.first_day), least(t.past_day, s.past_day))::BIGINT AS overlap
        FROM terms t JOIN spans s
          ON t.entity = s.entity AND t.first_day < s.past_day AND s.first_day < t.past_day""",
    "global_ranks": """
        WITH sized AS (SELECT o_orderkey AS order_key, floor(o_totalprice / 1000)::BIGINT AS thousands FROM orders)
        SELECT order_key, thousands, row_number() OVER by_row AS position, rank() OVER by_value AS rank,
          dense_rank() OVER by_value AS dense_rank, (ntile(100) OVER by_row)::INT AS tile,
          round(percent_rank() OVER by_value, 9) AS pct_rank, round(cume_dist() OVER by_value, 9) AS cume
        FROM sized
        WINDOW by_row AS (ORDER BY thousands DESC, order_key), by_value AS (ORDER BY thousands DESC)""",
    "global_percentiles": """
        SELECT unnest([0, 0.01, 0.25, 0.5, 0.75, 0.99, 1])::DOUBLE AS fraction,
          unnest(list_transform(quantile_cont(round(o_totalprice * 100), [0, 0.01, 0.25, 0.5, 0.75, 0.99, 1]),
            lambda x: round(x, 4))) AS percentile
        FROM orders""",
    "order_cube": f"""
        WITH {LEVELS}
        SELECT continent, segment, status, grouping(continent)::INT AS continent_total,
          grouping(segment)::INT AS segment_total, grouping(status)::INT AS status_total,
          grouping(continent, segment, status)::INT AS level, count(*) AS customers,
          sum(n)::BIGINT AS n_orders, sum(value) AS value, max(largest) AS largest,
          round(avg(value), 4) AS avg_value
        FROM levels GROUP BY CUBE (continent, segment, status)""",
    "order_rollup": f"""
        WITH {LEVELS}
        SELECT continent, segment, status, grouping(continent)::INT AS continent_total,
          grouping(segment)::INT AS segment_total, grouping(status)::INT AS status_total,
          grouping(continent, segment, status)::INT AS level, sum(n)::BIGINT AS n_orders, sum(value) AS value
        FROM levels GROUP BY ROLLUP (continent, segment, status)""",
    "territory_closure": f"""
        WITH RECURSIVE {TERRITORY}
        SELECT ancestor, descendant, min(depth)::INT AS depth FROM paths GROUP BY 1, 2""",
    "territory_totals": f"""
        WITH RECURSIVE {TERRITORY},
        facts AS (
          SELECT 'C' || o_custkey AS node, sum(round(o_totalprice * 100)) AS own FROM orders GROUP BY 1
        ),
        spread AS (
          SELECT node, own FROM facts
          UNION ALL SELECT ancestor, own FROM (SELECT DISTINCT ancestor, descendant FROM paths)
          JOIN facts ON descendant = node
        )
        SELECT node, sum(own) AS total, count(*) AS members FROM spread GROUP BY node""",
    "top_orders": """
        SELECT c.entity, t.year, t.order_key, t.type, t.value, t.place::INT AS place
        FROM (SELECT DISTINCT o_custkey AS entity FROM orders) c, LATERAL (
          SELECT year(o_orderdate)::INT AS year, o_orderkey AS order_key, o_orderstatus AS type,
            round(o_totalprice * 100) AS value,
            row_number() OVER (ORDER BY round(o_totalprice * 100) DESC, o_orderkey DESC) AS place
          FROM orders WHERE o_custkey = c.entity
          ORDER BY round(o_totalprice * 100) DESC, o_orderkey DESC LIMIT 3) t""",
    "first_order_lists": """
        SELECT o_custkey AS entity, array_to_string(
          list(o_orderkey ORDER BY year(o_orderdate), o_orderkey)[1:5], ' ') AS orders
        FROM orders GROUP BY o_custkey""",
    "sketched_nations": """
        SELECT n_name AS nation, count(DISTINCT o_custkey) AS customers, count(*) AS n_orders,
          1 AS rows_equal, 1 AS distinct_near, 1 AS median_near
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
        GROUP BY n_name""",
    "version_changes": f"""
        WITH {VERSIONS}
        SELECT *, 1::BIGINT AS change FROM (SELECT * FROM fresh EXCEPT ALL SELECT * FROM stale)
        UNION ALL SELECT *, -1 FROM (SELECT * FROM stale EXCEPT ALL SELECT * FROM fresh)""",
    "version_keys": f"""
        WITH {VERSIONS}
        SELECT coalesce(f.entity, s.entity) AS entity, coalesce(f.year, s.year) AS year,
          CASE WHEN s.entity IS NULL THEN 'inserted' WHEN f.entity IS NULL THEN 'deleted'
            ELSE 'updated' END AS kind,
          CASE WHEN s.entity IS NOT NULL AND f.entity IS NOT NULL THEN 'value' END AS columns
        FROM fresh f FULL JOIN stale s ON f.entity = s.entity AND f.year = s.year
        WHERE f.value IS DISTINCT FROM s.value""",
    "refreshed_years": f"WITH {VERSIONS} SELECT * FROM fresh",
    "streamed_days": """
        SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, sum(round(value * 100)) AS value
        FROM events
        WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)
        GROUP BY 1, 2""",
}
