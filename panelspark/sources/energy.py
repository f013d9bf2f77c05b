"""The energy tables and documents under the column names the operators use.

Two sources with one interface: :class:`FlatTables` over the normalised tables and
:class:`DocumentTables` over the nested documents.  A question written against the interface runs
on either and gives the same rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.operators import aggregates, documents, season
from panelspark.operators.entities import entity_master, list_entities
from panelspark.operators.trade import tag_sides
from panelspark.sources import schemas
from panelspark.sources.tables import load, save_derived, save_view

Reader = Callable[[str], DataFrame]


def reader(
    spark: SparkSession, directory: str, fmt: str = "parquet", ignore_case: bool = False, **options: str
) -> Reader:
    """Tables and documents by name from one folder.

    With ``ignore_case`` the text columns of the flat tables compare, group and join without case.
    JSON year documents are read as a document store exports them, with the mixed ``month`` field,
    and that field is split on the way in.
    """

    def read(name: str) -> DataFrame:
        if name == "finalSGYearlyData" and fmt == "json":
            exported = load(spark, directory, name, schemas.EXPORTED_YEARS, fmt, **options)
            return documents.split_months(exported)
        table = load(spark, directory, name, fmt=fmt, **options)
        if ignore_case and name in schemas.PANEL_TABLES:
            return case_insensitive(table, *[c for c, kind in table.dtypes if kind == "string"])
        return table

    return read


def register_views(read: Reader) -> None:
    """Every flat table under its own name, and the two named views, for plain Spark SQL."""
    tables = FlatTables(read)
    for name in schemas.PANEL_TABLES:
        save_view(read(name), name)
    real = entity_master(tables.entities())
    save_view(real.select(F.col("entity").alias("country")), "countrylist")
    quarters = tables.regional_quarters().withColumnsRenamed(
        {"region": "Region", "avg_kwh": "avg_kwh_per_acc"}
    )
    save_view(quarters, "quart_avg_kwh")


def case_insensitive(df: DataFrame, *columns: str) -> DataFrame:
    """Make comparisons, grouping and joins on these text columns ignore case.

    For data that was compared that way where it comes from.
    """
    return df.withColumns({c: F.collate(F.col(c), "UTF8_LCASE") for c in columns})


class FlatTables:
    """The normalised tables."""

    def __init__(self, read: Reader):
        self.read = read

    def energy(self, *metrics: str) -> DataFrame:
        return self.read("owid_energy_data").select(
            F.col("country").alias("entity"), F.col("iso_code").alias("code"), "year", *metrics
        )

    def entities(self) -> DataFrame:
        return self.read("continents-according-to-our-world-in-data").select(
            F.col("Entity").alias("entity"), F.col("Code").alias("code"), F.col("Continent").alias("continent")
        )

    def info(self) -> DataFrame:
        return self.read("owid_countryinfo").withColumnRenamed("country", "entity")

    def intensity(self) -> DataFrame:
        return self.read("owid_countryenergy").withColumnRenamed("country", "entity")

    def nuclear(self) -> DataFrame:
        return self.read("owid_nuclear").withColumnRenamed("country", "entity")

    def trade(self) -> DataFrame:
        def side(name: str) -> DataFrame:
            return self.read(name).select(
                "year",
                F.col("energy_products").alias("product"),
                F.col("sub_products").alias("sub_product"),
                F.col("value_ktoe").alias("value"),
            )

        return tag_sides(side("importsofenergyproducts"), side("exportsofenergyproducts"))

    def household(self) -> DataFrame:
        return self.read("householdelectricityconsumption").withColumnRenamed("Description", "description")

    def town_gas(self) -> DataFrame:
        return self.read("householdtowngasconsumption").withColumnRenamed("avg_mthly_hh_tg_consp_kwh", "kwh")

    def regional_years(self) -> DataFrame:
        return aggregates.regional_averages(self.household())

    def regional_quarters(self) -> DataFrame:
        return season.quarterly_by_date(self.household())

    def gas_quarters(self) -> DataFrame:
        return season.quarterly_by_month(self.town_gas())

    def emissions(self) -> DataFrame:
        return self.read("owid-co2-data").select(
            "year",
            F.col("coal_co2").alias("coal"),
            F.col("gas_co2").alias("gas"),
            F.col("oil_co2").alias("oil"),
            F.col("co2").alias("total"),
            F.col("total_ghg").alias("ghg"),
        )

    def temperatures(self) -> DataFrame:
        return self.read("globaltemperatures").select(
            F.col("recordedDate").alias("recorded"), F.col("LandAverageTemperature").alias("value")
        )

    def sea_ice(self) -> DataFrame:
        return self.read("external_seaice")

    def sea_level(self) -> DataFrame:
        return self.read("external_sealevelchg")

    def exposure(self) -> DataFrame:
        return self.read("external_population_under_5_metres").select(
            F.col("Country").alias("entity"), F.col("2010").alias("exposed")
        )

    def disasters(self) -> DataFrame:
        return self.read("external_cc_disasterfreq").withColumnRenamed("country", "entity")

    def damages(self) -> DataFrame:
        return self.read("external_economic_damage_from_natural_disasters").select(
            F.col("Entity").alias("entity"),
            "year",
            F.col("Total economic damage (EMDAT (2020))").alias("damage"),
        )

    def deaths(self) -> DataFrame:
        return self.read("external_deaths_from_natural_disasters_by_type").select(
            F.col("Entity").alias("entity"), "year", F.col("Total deaths (EMDAT (2020))").alias("deaths")
        )

    def displacements(self) -> DataFrame:
        return self.read("external_disaster_displacement").select(
            F.col("country").alias("entity"), F.col("Hazard Type").alias("hazard"), "displacements"
        )

    def losses(self) -> DataFrame:
        return self.read("external_direct_disaster_economic_loss").select(
            "entity", F.col("economic_loss_from_disasters_USD").alias("loss")
        )


class DocumentTables:
    """The nested documents, unnested to the rows the same questions need."""

    def __init__(self, read: Reader):
        self.read = read
        self._stored: DataFrame | None = None

    def countries(self) -> DataFrame:
        return self.read("finalOWIDdata")

    def years(self) -> DataFrame:
        return self.read("finalSGYearlyData")

    def energy(self, *metrics: str) -> DataFrame:
        return documents.panel_slice_docs(self.countries(), metrics)

    def entities(self) -> DataFrame:
        return self.read("countriesOWID").select(
            F.col("Entity").alias("entity"), F.col("Code").alias("code"), F.col("Continent").alias("continent")
        )

    def real_countries(self) -> DataFrame:
        """(entity, code) of the documents of real entities: the stored list if there is one."""
        if self._stored is not None:
            return self._stored.withColumnsRenamed({"country": "entity", "iso_code": "code"})
        named = self.countries().select(F.col("country").alias("entity"))
        coded = named.join(self.entities().select("entity", "code"), "entity")
        return list_entities(coded, entity_master(self.entities()))

    def store_countries(self, directory: str | None = None) -> DataFrame:
        """Write the list of real countries as ``finalCountries``; later questions read it."""
        real = self.real_countries().withColumnsRenamed({"entity": "country", "code": "iso_code"})
        self._stored = save_derived(real, "finalCountries", directory=directory)
        return self._stored

    def info(self) -> DataFrame:
        return self.energy("population", "gdp")

    def trade(self) -> DataFrame:
        return documents.trade_rows(self.years())

    def regional_years(self) -> DataFrame:
        return aggregates.annual_rows_docs(self.years())

    def regional_quarters(self) -> DataFrame:
        return season.quarterly_rows_docs(self.years())

    def gas_quarters(self) -> DataFrame:
        return season.quarterly_gas_rows_docs(self.years())
