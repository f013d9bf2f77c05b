"""Flat panel <-> nested documents."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.functions import first_metric, metric_entries, month_number, sort_by_field
from panelspark.operators.selection import Cohort, keep
from panelspark.sources.schemas import ENERGY_DETAILS, ENERGY_LEAVES, ENERGY_TOTALS


@dataclass(frozen=True)
class DocumentLayout:
    """Where each metric of the flat panel sits in a document.

    ``details`` and ``totals`` are plain fields of a year; ``leaves`` maps a sparse metric to the
    (energy, type) whose key/value object holds it.
    """

    details: Sequence[str] = ENERGY_DETAILS
    totals: Sequence[str] = ENERGY_TOTALS
    leaves: Mapping[str, tuple[str, str]] = field(default_factory=lambda: dict(ENERGY_LEAVES))

    def energies(self) -> dict[str, dict[str, list[str]]]:
        tree: dict[str, dict[str, list[str]]] = {}
        for metric, (energy, kind) in self.leaves.items():
            tree.setdefault(energy, {}).setdefault(kind, []).append(metric)
        return tree


def to_documents(panel: DataFrame, layout: DocumentLayout) -> DataFrame:
    """One document per entity, its years ascending; a NULL metric is left out of its object.

    The array of an entity has one element per year of the panel (one row per entity and year),
    so its size is bounded by the calendar, not by the data.
    """

    def leaf(kind: str, metrics: list[str]) -> str:
        pairs = ", ".join(f"'{m}', CAST(`{m}` AS DOUBLE)" for m in metrics)
        return (
            f"named_struct('type', '{kind}', 'energyData', "
            f"map_filter(map({pairs}), (name, value) -> value IS NOT NULL))"
        )

    def energy(name: str, kinds: dict[str, list[str]]) -> str:
        types = ", ".join(leaf(kind, metrics) for kind, metrics in kinds.items())
        return f"named_struct('energy', '{name}', 'energyTypes', array({types}))"

    energies = ", ".join(energy(name, kinds) for name, kinds in layout.energies().items())
    one_year = F.struct(
        F.col("year"),
        F.struct(*layout.details).alias("countryDetails"),
        F.struct(*layout.totals).alias("countryEnergyData"),
        F.expr(f"array({energies})").alias("listOfEnergyData"),
    )
    return panel.groupBy(F.col("entity").alias("country")).agg(
        sort_by_field(F.collect_list(one_year), "year").alias("yearlyData")
    )


def metric_rows(docs: DataFrame) -> DataFrame:
    """Every metric a document holds, one row each: the inverse of :func:`to_documents`.

    ``position`` is the place of the year in its array, counted from 0.
    """
    years = docs.select(
        F.col("country").alias("entity"), F.posexplode("yearlyData").alias("position", "y")
    )
    energies = years.select(
        "entity", "position", F.col("y.year").alias("year"), F.explode("y.listOfEnergyData").alias("e")
    )
    types = energies.select(
        "entity", "position", "year", F.col("e.energy").alias("energy"),
        F.explode("e.energyTypes").alias("t"),
    )
    return types.select(
        "entity", "position", "year", "energy", F.col("t.type").alias("type"),
        F.explode("t.energyData").alias("metric", "value"),
    )


def _plain_fields(docs: DataFrame) -> dict[str, str]:
    """Metric -> path of the metrics that are plain fields of a year."""
    year = docs.schema["yearlyData"].dataType.elementType
    return {
        name: f"yearlyData.{part}.{name}"
        for part in ("countryDetails", "countryEnergyData")
        if part in year.names
        for name in year[part].dataType.names
    }


def year_arrays(docs: DataFrame, metrics: Sequence[str], energies: bool = False) -> DataFrame:
    """(entity, years): per year a struct of ``year``, the plain ``metrics``, and ``energies``.

    ``energies`` is there if a sparse metric is among the metrics, or if asked for.  The fields
    are taken by path before anything is unnested, so a columnar scan reads just those.
    """
    plain = _plain_fields(docs)
    paths = {"year": "yearlyData.year", **{m: plain[m] for m in metrics if m in plain}}
    if energies or any(m not in plain for m in metrics):
        paths["energies"] = "yearlyData.listOfEnergyData"
    fields = docs.select(
        F.col("country").alias("entity"), *[F.col(path).alias(name) for name, path in paths.items()]
    )
    return fields.select("entity", F.arrays_zip(*paths).alias("years"))


def metric_of(docs: DataFrame, year: Column, metric: str) -> Column:
    """``metric`` of one element of :func:`year_arrays`, plain or sparse."""
    if metric in _plain_fields(docs):
        return year[metric]
    return first_metric(metric_entries(year["energies"]), metric)


def panel_slice_docs(
    docs: DataFrame,
    metrics: Sequence[str],
    entities: Cohort = None,
    since: int | None = None,
    until: int | None = None,
    years: Sequence[int] | None = None,
) -> DataFrame:
    """(entity, year, metrics...) rows of the documents.

    A metric that is a plain field of a year is read by path; any other is the first value found
    under that key among all energies and types, NULL where no object has the key.
    """
    rows = keep(year_arrays(docs, metrics), entities).select("entity", F.inline("years"))
    rows = keep(rows, None, since, until, years)
    if "energies" not in rows.columns:
        return rows.select("entity", F.col("year").cast("int").alias("year"), *metrics)
    plain = set(rows.columns)
    return rows.withColumn("leaves", metric_entries(F.col("energies"))).select(
        "entity",
        F.col("year").cast("int").alias("year"),
        *[F.col(m) if m in plain else first_metric(F.col("leaves"), m).alias(m) for m in metrics],
    )


def trade_documents(trade: DataFrame) -> DataFrame:
    """Tagged trade rows -> one document per year: products -> sub-products -> both values.

    Contract: the product catalogue is one that a task can hold, as a year's document holds all of it.
    The arrays grow with the catalogue, never with the number of trades; flat reports read the rows.
    """
    pairs = trade.groupBy("year", "product", "sub_product").agg(
        F.sum(F.when(F.col("side") == "import", F.col("value"))).alias("imports_value_ktoe"),
        F.sum(F.when(F.col("side") == "export", F.col("value"))).alias("exports_value_ktoe"),
    )
    sub = F.struct(F.col("sub_product").alias("name"), "imports_value_ktoe", "exports_value_ktoe")
    products = pairs.groupBy("year", "product").agg(
        F.array_sort(F.collect_list(sub)).alias("sub_products")
    )
    product = F.struct(F.col("product").alias("name"), "sub_products")
    return products.groupBy("year").agg(F.array_sort(F.collect_list(product)).alias("energy_products"))


def trade_rows(docs: DataFrame) -> DataFrame:
    """Year documents -> tagged trade rows; a side without a value gives no row."""
    products = docs.select("year", F.explode("energy_products").alias("p"))
    subs = products.select(
        "year", F.col("p.name").alias("product"), F.explode("p.sub_products").alias("s")
    )
    sides = F.array(
        F.struct(F.lit("import").alias("side"), F.col("s.imports_value_ktoe").alias("value")),
        F.struct(F.lit("export").alias("side"), F.col("s.exports_value_ktoe").alias("value")),
    )
    return subs.select(
        "year", "product", F.col("s.name").alias("sub_product"), F.inline(sides)
    ).filter(F.col("value").isNotNull())


def split_months(docs: DataFrame) -> DataFrame:
    """Year documents whose ``month`` is a number or ``Annual`` -> month number and total flag."""

    def month(m: Column) -> Column:
        return F.struct(
            month_number(m["month"]).alias("month_num"),
            F.coalesce(m["month"] == "Annual", F.lit(False)).alias("is_total"),
            m["household_category"].alias("household_category"),
        )

    return docs.withColumn(
        "monthlyHouseholdConsumption", F.transform("monthlyHouseholdConsumption", month)
    )


def household_documents(household: DataFrame, gas: DataFrame) -> DataFrame:
    """Electricity and town gas rows -> one document per year: months -> categories -> regions.

    The total row of a year has ``is_total`` and no month number.  The arrays are bounded by 13
    months, the housing types and the regions.
    """
    month = F.month(F.try_to_date(F.col("month"), "M/d/yyyy"))
    electricity = (
        household.filter(F.col("region") == F.col("description"))
        .groupBy(
            "year",
            month.alias("month_num"),
            (F.col("month") == "Annual").alias("is_total"),
            F.col("dwelling_type").alias("household_type"),
            "region",
        )
        .agg(F.avg("kwh_per_acc").alias("kwh"))
        .select(
            "year", "month_num", "is_total", "household_type",
            F.struct(F.col("region").alias("Region"), F.col("kwh").alias("region_kwh_per_acc")).alias("regional"),
        )
    )
    town_gas = gas.select(
        "year",
        month_number("month").alias("month_num"),
        F.lit(False).alias("is_total"),
        F.col("sub_housing_type").alias("household_type"),
        F.col("kwh").alias("avg_mthly_hh_tg_consp_kwh"),
    )
    rows = electricity.unionByName(town_gas, allowMissingColumns=True).filter(
        F.col("is_total") | F.col("month_num").isNotNull()
    )
    categories = rows.groupBy("year", "month_num", "is_total", "household_type").agg(
        F.max("avg_mthly_hh_tg_consp_kwh").alias("avg_mthly_hh_tg_consp_kwh"),
        F.array_sort(F.collect_list("regional")).alias("regional_elect_data"),
    )
    category = F.struct("household_type", "avg_mthly_hh_tg_consp_kwh", "regional_elect_data")
    months = categories.groupBy("year", "month_num", "is_total").agg(
        F.array_sort(F.collect_list(category)).alias("household_category")
    )
    return months.groupBy("year").agg(
        F.array_sort(F.collect_list(F.struct("month_num", "is_total", "household_category"))).alias(
            "monthlyHouseholdConsumption"
        )
    )
