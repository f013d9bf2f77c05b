"""Explicit schemas: star tables, flat panel tables, nested documents."""

from __future__ import annotations

from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    DateType,
    DoubleType,
    IntegerType,
    LongType,
    MapType,
    StringType,
    StructField,
    StructType,
    TimestampNTZType,
)

_TYPES = {
    "string": StringType(),
    "int": IntegerType(),
    "long": LongType(),
    "double": DoubleType(),
    "ts": TimestampNTZType(),
    "date": DateType(),
}


def _table(**columns: str) -> StructType:
    return StructType([StructField(name, _TYPES[kind], True) for name, kind in columns.items()])


def _struct(*fields: tuple) -> StructType:
    return StructType([StructField(name, kind, True) for name, kind in fields])


STAR: dict[str, StructType] = {
    "region": _table(r_regionkey="int", r_name="string"),
    "nation": _table(n_nationkey="int", n_name="string", n_regionkey="int"),
    "customer": _table(
        c_custkey="long", c_name="string", c_nationkey="int", c_acctbal="double", c_mktsegment="string"
    ),
    "supplier": _table(s_suppkey="long", s_name="string", s_nationkey="int", s_acctbal="double"),
    "part": _table(
        p_partkey="long", p_name="string", p_brand="string", p_type="string", p_size="int",
        p_retailprice="double",
    ),
    "orders": _table(
        o_orderkey="long", o_custkey="long", o_orderstatus="string", o_totalprice="double",
        o_orderdate="ts", o_orderpriority="string",
    ),
    "lineitem": _table(
        l_orderkey="long", l_partkey="long", l_suppkey="long", l_linenumber="int",
        l_quantity="double", l_extendedprice="double", l_discount="double", l_tax="double",
        l_returnflag="string", l_linestatus="string", l_shipdate="ts",
    ),
    "events": _table(
        event_id="long", ts="ts", user_id="long", event_type="string", value="double", props="string"
    ),
}

# Names of the tables and their columns, so that data published under these names
# reads as it is.  The metric families are "<source>_<measure>".
_CONSUMPTION = (
    "oil", "coal", "gas", "fossil_fuel", "renewables", "other_renewable", "low_carbon",
    "biofuel", "solar", "wind", "hydro", "nuclear",
)
_SHARE_ENERGY = (
    "fossil", "renewables", "other_renewables", "low_carbon", "nuclear", "solar", "wind",
    "biofuel", "hydro",
)
_SHARE_ELEC = (
    "fossil", "renewables", "other_renewables", "nuclear", "solar", "wind", "biofuel", "hydro",
)
_CHANGE = ("solar", "wind", "biofuel", "hydro", "nuclear", "other_renewables")
_PER_CAPITA = (
    "coal", "gas", "oil", "solar", "wind", "biofuel", "hydro", "nuclear", "other_renewables",
)
_GENERATION = (
    "solar", "wind", "hydro", "biofuel", "nuclear", "fossil", "renewables", "other_renewable",
)

# energy, type -> metric, i.e. where each sparse metric sits in a country document.
ENERGY_LEAVES: dict[str, tuple[str, str]] = {
    **{f"{s}_consumption": (s, "consumption") for s in _CONSUMPTION},
    **{f"{s}_share_energy": (s, "share") for s in _SHARE_ENERGY},
    **{f"{s}_share_elec": (s, "share") for s in _SHARE_ELEC},
    "other_renewables_share_elec_exc_biofuel": ("other_renewables_exc_biofuel", "share"),
    **{f"{s}_cons_change_pct": (s, "change") for s in _CHANGE},
    **{f"{s}_elec_per_capita": (s, "per_capita") for s in _PER_CAPITA},
    "other_renewables_elec_per_capita_exc_biofuel": ("other_renewables_exc_biofuel", "per_capita"),
    **{f"{s}_electricity": (s, "electricity") for s in _GENERATION},
}
ENERGY_DETAILS = ("gdp", "population")
ENERGY_TOTALS = ("electricity_demand", "primary_energy_consumption", "per_capita_electricity")

_TRADE = _table(year="int", energy_products="string", sub_products="string", value_ktoe="double")

PANEL_TABLES: dict[str, StructType] = {
    "owid_energy_data": _table(
        country="string", iso_code="string", year="int", population="double", gdp="double",
        carbon_intensity_elec="double",
        **{m: "double" for m in (*ENERGY_TOTALS, *ENERGY_LEAVES)},
    ),
    "continents-according-to-our-world-in-data": _table(
        Entity="string", Code="string", Continent="string"
    ),
    "owid_countryinfo": _table(country="string", year="int", population="double", gdp="double"),
    "owid_countryenergy": _table(
        country="string", year="int", energy_per_gdp="double", energy_per_capita="double"
    ),
    "owid_nuclear": _table(country="string", nuclear_electricity="double"),
    "importsofenergyproducts": _TRADE,
    "exportsofenergyproducts": _TRADE,
    "householdelectricityconsumption": _table(
        region="string", Description="string", dwelling_type="string", year="int", month="string",
        kwh_per_acc="double",
    ),
    "householdtowngasconsumption": _table(
        sub_housing_type="string", year="int", month="string", avg_mthly_hh_tg_consp_kwh="double"
    ),
    "owid-co2-data": _table(
        year="int", coal_co2="double", gas_co2="double", oil_co2="double", co2="double",
        total_ghg="double",
    ),
    "globaltemperatures": _table(recordedDate="date", LandAverageTemperature="double"),
    "external_seaice": _table(year="int", extent="double"),
    "external_sealevelchg": _table(year="int", avg_sealevel_chg_in_mm="double"),
    "external_population_under_5_metres": _table(Country="string", **{"2010": "double"}),
    "external_cc_disasterfreq": _table(
        country="string", year="int", type="string", value="double"
    ),
    "external_economic_damage_from_natural_disasters": _table(
        Entity="string", year="int", **{"Total economic damage (EMDAT (2020))": "double"}
    ),
    "external_deaths_from_natural_disasters_by_type": _table(
        Entity="string", year="int", **{"Total deaths (EMDAT (2020))": "double"}
    ),
    "external_disaster_displacement": _table(
        country="string", **{"Hazard Type": "string"}, displacements="double"
    ),
    "external_direct_disaster_economic_loss": _table(
        entity="string", economic_loss_from_disasters_USD="double"
    ),
}

# Names of the document collections and their fields.
ENERGY_TYPE = _struct(
    ("type", StringType()), ("energyData", MapType(StringType(), DoubleType(), True))
)
ENERGY = _struct(("energy", StringType()), ("energyTypes", ArrayType(ENERGY_TYPE)))
YEAR_OF_COUNTRY = _struct(
    ("year", IntegerType()),
    ("countryDetails", _table(**{m: "double" for m in ENERGY_DETAILS})),
    ("countryEnergyData", _table(**{m: "double" for m in ENERGY_TOTALS})),
    ("listOfEnergyData", ArrayType(ENERGY)),
)
_SUB_PRODUCT = _table(name="string", imports_value_ktoe="double", exports_value_ktoe="double")
_PRODUCT = _struct(("name", StringType()), ("sub_products", ArrayType(_SUB_PRODUCT)))
_CATEGORY = _struct(
    ("household_type", StringType()),
    ("avg_mthly_hh_tg_consp_kwh", DoubleType()),
    ("regional_elect_data", ArrayType(_table(Region="string", region_kwh_per_acc="double"))),
)
_MONTH = _struct(
    ("month_num", IntegerType()),
    ("is_total", BooleanType()),
    ("household_category", ArrayType(_CATEGORY)),
)
_EXPORTED_MONTH = _struct(("month", StringType()), ("household_category", ArrayType(_CATEGORY)))

DOCUMENTS: dict[str, StructType] = {
    "finalOWIDdata": _struct(
        ("country", StringType()), ("yearlyData", ArrayType(YEAR_OF_COUNTRY))
    ),
    "finalSGYearlyData": _struct(
        ("year", IntegerType()),
        ("energy_products", ArrayType(_PRODUCT)),
        ("monthlyHouseholdConsumption", ArrayType(_MONTH)),
    ),
    "countriesOWID": _table(Entity="string", Code="string", Continent="string"),
    "finalCountries": _table(country="string", iso_code="string"),
}

# The year documents as a document store exports them: ``month`` is a number or the text "Annual".
EXPORTED_YEARS = _struct(
    ("year", IntegerType()),
    ("energy_products", ArrayType(_PRODUCT)),
    ("monthlyHouseholdConsumption", ArrayType(_EXPORTED_MONTH)),
)

# Parameter of the panel metric ``large``: the value, in cents, above which an order counts for it.
LARGE_ORDER_CENTS = 49_500_000

TABLES: dict[str, StructType] = {**STAR, **PANEL_TABLES, **DOCUMENTS}
