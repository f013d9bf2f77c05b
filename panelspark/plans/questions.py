"""The fifteen questions as plans over the energy tables.

``QUESTIONS`` maps a name to a function of :class:`FlatTables`; the names in ``ON_DOCUMENTS`` also
run on :class:`DocumentTables` with the same result, and ``NESTED`` holds the answers that are
documents themselves.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.functions import safe_ratio
from panelspark.operators import (
    aggregates,
    cohorts,
    entities,
    impact,
    season,
    slices,
    trade,
    windows,
)
from panelspark.operators.documents import panel_slice_docs
from panelspark.sources.energy import DocumentTables, FlatTables

# The cohorts, years, limits and metrics the questions name.
ASEAN = [
    "Brunei", "Cambodia", "Indonesia", "Laos", "Malaysia", "Myanmar", "Philippines", "Singapore",
    "Thailand", "Vietnam",
]
PEERS = ["Singapore", "Hong Kong", "Japan"]
NUCLEAR_LEADERS = ["United States", "Russia", "France"]
SINGAPORE = ["Singapore"]
WORLD = ["World"]
NOT_NEW_SOURCES = ["oil", "coal", "fossil", "gas", "other_renewables_exc_biofuel"]
SURPLUS_INSTANCES = 4
FOSSIL_PER_CAPITA = ["coal_elec_per_capita", "gas_elec_per_capita", "oil_elec_per_capita"]
RENEWABLES_PER_CAPITA = [
    "solar_elec_per_capita", "wind_elec_per_capita", "biofuel_elec_per_capita", "hydro_elec_per_capita",
    "other_renewables_elec_per_capita",
]
RENEWABLES_EXC_BIOFUEL = [*RENEWABLES_PER_CAPITA[:4], "other_renewables_elec_per_capita_exc_biofuel"]


@dataclass(frozen=True)
class Slice:
    """A question that only picks entities, years and metrics of the energy panel."""

    entities: Sequence[str]
    metrics: Sequence[str]
    since: int | None = None
    until: int | None = None
    years: Sequence[int] | None = None

    def __call__(self, t) -> DataFrame:
        if isinstance(t, DocumentTables):
            return panel_slice_docs(
                t.countries(), self.metrics, self.entities, self.since, self.until, self.years
            )
        return slices.panel_slice(
            t.energy(*self.metrics), self.metrics, self.entities, self.since, self.until, self.years
        )


SLICES: dict[str, Slice] = {
    "q12_shares_by_class": Slice(
        PEERS, ["renewables_share_energy", "nuclear_share_energy", "fossil_share_energy"], 1965, 2020
    ),
    "q12_renewables_and_fossil": Slice(
        PEERS, ["renewables_consumption", "fossil_fuel_consumption"], 1965, 2020
    ),
    "q12_low_carbon": Slice(
        PEERS, ["renewables_consumption", "fossil_fuel_consumption", "low_carbon_consumption"], 1965, 2020
    ),
    "q12_renewable_types": Slice(
        PEERS,
        [
            "other_renewable_consumption", "biofuel_consumption", "solar_consumption",
            "wind_consumption", "hydro_consumption",
        ],
        1965,
        2020,
    ),
    "q12_fossil_types": Slice(
        PEERS, ["oil_consumption", "coal_consumption", "gas_consumption"], 1965, 2020
    ),
    "q13_world_demand": Slice(
        WORLD, ["population", "electricity_demand", "primary_energy_consumption"], 2000
    ),
    "q13_world_change": Slice(
        WORLD,
        [
            "solar_cons_change_pct", "wind_cons_change_pct", "biofuel_cons_change_pct",
            "hydro_cons_change_pct", "nuclear_cons_change_pct", "other_renewables_cons_change_pct",
        ],
        2000,
    ),
    "q13_world_energy_by_type": Slice(
        WORLD,
        [
            "fossil_share_energy", "solar_share_energy", "wind_share_energy", "biofuel_share_energy",
            "hydro_share_energy", "nuclear_share_energy", "other_renewables_share_energy",
        ],
        years=[2020],
    ),
    "q13_world_electricity_by_type": Slice(
        WORLD,
        [
            "fossil_share_elec", "solar_share_elec", "wind_share_elec", "biofuel_share_elec",
            "hydro_share_elec", "nuclear_share_elec", "other_renewables_share_elec_exc_biofuel",
        ],
        years=[2021],
    ),
    "q13_world_generation": Slice(
        WORLD,
        [
            "electricity_demand", "solar_electricity", "wind_electricity", "hydro_electricity",
            "biofuel_electricity", "other_renewable_electricity",
        ],
        2000,
    ),
    "q14_low_carbon_generation": Slice(
        WORLD,
        [
            "wind_electricity", "hydro_electricity", "solar_electricity", "nuclear_electricity",
            "other_renewable_electricity",
        ],
        2000,
    ),
    "q14_singapore_electricity_mix": Slice(
        SINGAPORE,
        [
            "solar_share_elec", "other_renewables_share_elec", "fossil_share_elec",
            "renewables_share_elec",
        ],
        years=[2000, 2020],
    ),
    "q14_world_energy_mix": Slice(
        WORLD,
        [
            "fossil_share_energy", "renewables_share_energy", "other_renewables_share_energy",
            "nuclear_share_energy",
        ],
        years=[2020],
    ),
    "q14_world_electricity_mix": Slice(
        WORLD,
        [
            "fossil_share_elec", "renewables_share_elec", "other_renewables_share_elec",
            "nuclear_share_elec",
        ],
        years=[2020],
    ),
}


def _real(t) -> DataFrame:
    return entities.entity_master(t.entities())


def _per_capita():
    return safe_ratio("gdp", "population")


# 1-3: countries, years, Singapore's new sources


def q01_real_countries(t):
    return _real(t)


def q01_countries(t):
    if isinstance(t, DocumentTables):
        return t.real_countries()
    return entities.list_entities(t.energy(), _real(t))


def q01_country_count(t):
    return entities.count_entities(q01_countries(t))


def q02_year_span(t):
    return entities.year_span(t.energy())


def q02_full_coverage(t):
    return entities.full_coverage(t.energy(), _real(t))


def q03_fossil_below_100(t):
    components = [
        "low_carbon_share_energy", "other_renewables_share_energy", "renewables_share_energy",
        "solar_share_energy",
    ]
    panel = t.energy("fossil_share_energy", *components)
    return slices.threshold_crossing(panel, "fossil_share_energy", 100, components, SINGAPORE)


# 4-5: ASEAN


def q04_asean_gdp(t):
    return aggregates.cohort_average(t.info(), "gdp", ASEAN, 2000, 2021)


def q05_asean_falling_oil(t):
    return windows.negative_change_pairs(
        t.energy("oil_consumption", "gdp"), "oil_consumption", "gdp", 3, ASEAN, 2000, 2021
    )


# 6-7: trade in energy products


def q06_product_averages(t):
    return trade.two_sided_average(t.trade())


def q07_yearly_differences(t):
    return trade.matched_difference(t.trade())


def q07_surplus_years(t):
    return trade.years_with_many(t.trade(), SURPLUS_INSTANCES)


# 8-11: households


def q08_regional_average(t):
    return t.regional_years().orderBy("region", "year")


def q09_regional_falls(t):
    return windows.yoy_difference(t.regional_years(), "region", "yearly_avg")


def q09_saving_stars(t):
    return windows.count_negative_years(q09_regional_falls(t), "region", 3)


def q10_regional_quarters(t):
    return t.regional_quarters()


def q10_regional_bars(t):
    return season.scaled_bars(t.regional_quarters())


def q11_town_gas_quarters(t):
    return t.gas_quarters()


# 12: Singapore and its peers


def q12_gdp_per_capita(t):
    rows = slices.panel_slice(t.info(), ["population", "gdp"], SINGAPORE, 1965, 2018)
    return slices.ratio_columns(rows, {"gdp_per_capita": ("gdp", "population")})


def q12_asian_peers(t):
    asian = cohorts.members_of(t.entities(), "Asia")
    ranked = cohorts.rank_entities(t.info(), _per_capita(), asian, 1965, 2018, descending=False)
    return ranked.withColumn("continent", F.lit("Asia"))


def q12_energy_intensity(t):
    return slices.panel_slice(
        t.intensity(), ["energy_per_gdp", "energy_per_capita"], PEERS, 1965, 2018
    ).orderBy("entity", "year")


# 13: renewables and growth


def q13_world_mix(t):
    metrics = [
        "primary_energy_consumption", "fossil_fuel_consumption", "renewables_consumption",
        "other_renewable_consumption", "nuclear_consumption",
    ]
    rows = slices.panel_slice(t.energy(*metrics), metrics, WORLD, years=[2000, 2020])
    classes = slices.group_sum_columns(
        rows, {"renewables": ["renewables_consumption", "other_renewable_consumption"]}
    ).select(
        "year",
        F.col("primary_energy_consumption").alias("total"),
        F.col("fossil_fuel_consumption").alias("fossil"),
        "renewables",
        F.col("nuclear_consumption").alias("nuclear"),
    )
    return slices.ratio_columns(
        classes, percents={f"pct_{c}": (c, "total") for c in ("fossil", "renewables", "nuclear")}
    )


def q13_world_per_capita(t):
    metrics = ["per_capita_electricity", *FOSSIL_PER_CAPITA, *RENEWABLES_PER_CAPITA, "nuclear_elec_per_capita"]
    rows = slices.panel_slice(t.energy(*metrics), metrics, WORLD, 2000)
    return slices.group_sum_columns(
        rows,
        {
            "fossil_elec_per_capita": FOSSIL_PER_CAPITA,
            "renewables_elec_per_capita": RENEWABLES_PER_CAPITA,
        },
    ).select(
        "year",
        "per_capita_electricity",
        "fossil_elec_per_capita",
        "renewables_elec_per_capita",
        "nuclear_elec_per_capita",
    )


def q13_continent_mix(t):
    classes = {
        "fossil": FOSSIL_PER_CAPITA,
        "renewables": RENEWABLES_EXC_BIOFUEL,
        "nuclear": ["nuclear_elec_per_capita"],
    }
    metrics = ["per_capita_electricity", *(m for parts in classes.values() for m in parts)]
    return aggregates.continent_mix(
        t.energy(*metrics),
        t.entities(),
        classes,
        "per_capita_electricity",
        "fossil",
        {"renewables_share": "renewables", "nuclear_share": "nuclear"},
        years=[2000, 2021],
    )


LEADER_METRICS = ["renewables_consumption", "electricity_demand", "gdp", "population"]


def _renewables_leaders(panel: DataFrame, members: DataFrame, k: int) -> DataFrame:
    score = safe_ratio("renewables_consumption", "electricity_demand")
    return cohorts.rank_entities(panel, score, members, k=k).select("entity")


def q13_renewables_leaders(t):
    panel = t.energy(*LEADER_METRICS)
    cohort = _renewables_leaders(panel, _real(t), 5)
    columns = ["renewables_consumption", _per_capita().alias("gdp_per_capita")]
    return cohorts.topk_rows(panel, cohort, columns, 2000)


def q13_continent_gdp(t):
    panel = t.energy("renewables_share_elec", "gdp", "population")
    return aggregates.continent_average(panel, t.entities(), "renewables_share_elec")


def _continent_leaders(continent: str, k: int) -> Callable:
    def question(t):
        panel = t.energy("renewables_share_elec", *LEADER_METRICS)
        real = cohorts.members_of(t.entities(), continent, _real(t))
        return cohorts.topk_vs_benchmark(
            panel,
            _renewables_leaders(panel, real, k),
            cohorts.members_of(t.entities(), continent),
            continent,
            "renewables_share_elec",
            2000,
        )

    return question


def _source_leaders(
    score: str, require: Sequence[str] = (), real_only: bool = False, report: str | None = None
) -> Callable:
    """Yearly averages over the five countries with the highest average ``score``."""

    def question(t):
        metrics = list(dict.fromkeys([score, *require, report or score, "gdp", "population"]))
        panel = t.energy(*metrics)
        cohort = cohorts.rank_entities(
            panel, F.col(score), _real(t) if real_only else None, 2000, require=["gdp", *require], k=5
        ).select("entity")
        return cohorts.topk_yearly(panel, cohort, report or score, 2000)

    return question


# 14: nuclear energy


def q14_trade_totals(t):
    return trade.yearly_totals(t.trade(), 2010)


def q14_trade_balance(t):
    return trade.yearly_balance(t.trade(), 2010)


def _efficiency(t, who: Sequence[str], pairs: dict[str, tuple[str, str]], **years) -> DataFrame:
    metrics = [m for pair in pairs.values() for m in pair]
    rows = slices.panel_slice(t.energy(*metrics), metrics, who, **years)
    return slices.ratio_columns(rows, pairs).select("entity", "year", *pairs)


def q14_singapore_efficiency(t):
    return _efficiency(
        t,
        SINGAPORE,
        {
            "solar_efficiency": ("solar_electricity", "solar_consumption"),
            "other_renewable_efficiency": ("other_renewable_electricity", "other_renewable_consumption"),
            "fossil_efficiency": ("fossil_electricity", "fossil_fuel_consumption"),
        },
        since=2000,
    )


def q14_nuclear_ranking(t):
    return cohorts.rank_entities(t.nuclear(), F.col("nuclear_electricity"))


def q14_nuclear_profiles(t):
    metrics = ["carbon_intensity_elec", "gdp", "population", "nuclear_share_elec"]
    rows = slices.panel_slice(t.energy(*metrics), metrics, NUCLEAR_LEADERS, 2000)
    return slices.ratio_columns(rows, {"gdp_per_capita": ("gdp", "population")}).drop("gdp", "population")


def q14_nuclear_efficiency(t):
    return _efficiency(
        t,
        NUCLEAR_LEADERS,
        {
            "nuclear_efficiency": ("nuclear_electricity", "nuclear_consumption"),
            "fossil_efficiency": ("fossil_electricity", "fossil_fuel_consumption"),
            "renewable_efficiency": ("renewables_electricity", "renewables_consumption"),
        },
        years=[2020],
    )


# 15: climate change


def q15_emission_shares(t):
    return aggregates.emission_shares(t.emissions(), ["coal", "gas", "oil"], after=1990)


def q15_average_shares(t):
    return aggregates.average_of_shares(q15_emission_shares(t))


def q15_temperature_and_gases(t):
    year = F.year("recorded").cast("int")
    measured = t.temperatures().filter((F.col("value") != 0) & (year > 1990))
    gases = t.emissions().filter(F.col("year") > 1990)
    return impact.align_series(
        impact.by_period(measured, year, avg_yearly_temp=F.avg("value")),
        impact.by_period(gases, F.col("year"), total_ghg=F.sum("ghg")),
        how="inner",
    )


def q15_ice_sea_and_land(t):
    recorded_year = F.left(F.col("recorded").cast("string"), F.lit(4)).try_cast("int")
    return impact.align_series(
        impact.by_period(t.sea_ice(), F.col("year"), avg_seaice_extent=F.avg("extent")),
        t.sea_level().select(F.col("year").alias("period"), "avg_sealevel_chg_in_mm"),
        impact.by_period(t.temperatures(), recorded_year, avg_landtemp=F.avg("value")),
    )


def q15_exposure(t):
    return impact.continent_exposure(t.exposure(), _real(t), "exposed")


def q15_disaster_counts(t):
    return impact.validated_counts(t.disasters(), t.info())


def q15_damage_and_deaths(t):
    return impact.align_two_key(t.damages(), t.deaths(), "damage", "deaths", 2000)


def _floods(t) -> DataFrame:
    return t.displacements().filter(F.col("hazard") == "Flood")


def q15_displacement(t):
    return impact.continent_impact(_floods(t), t.info(), _real(t))


def q15_displacement_and_exposure(t):
    return impact.continent_impact(_floods(t), t.info(), _real(t), exposure=t.exposure())


def q15_economic_loss(t):
    return impact.loss_above_average(t.losses(), t.info())


def _named(*functions: Callable) -> dict[str, Callable]:
    return {f.__name__: f for f in functions}


ON_DOCUMENTS: dict[str, Callable[[FlatTables | DocumentTables], DataFrame]] = {
    **_named(
        q01_real_countries, q01_countries, q01_country_count, q02_year_span, q02_full_coverage,
        q04_asean_gdp, q05_asean_falling_oil, q06_product_averages, q07_yearly_differences,
        q07_surplus_years, q08_regional_average, q09_regional_falls, q09_saving_stars,
        q10_regional_quarters, q11_town_gas_quarters,
    ),
    **SLICES,
    **_named(
        q13_world_mix, q13_world_per_capita, q13_continent_mix, q13_renewables_leaders,
        q14_trade_totals, q14_trade_balance,
    ),
}

QUESTIONS: dict[str, Callable[[FlatTables], DataFrame]] = {
    **ON_DOCUMENTS,
    **_named(
        q03_fossil_below_100, q10_regional_bars, q12_gdp_per_capita, q12_asian_peers,
        q12_energy_intensity, q13_continent_gdp,
    ),
    "q13_leaders_europe": _continent_leaders("Europe", 5),
    "q13_leaders_north_america": _continent_leaders("North America", 3),
    "q13_leaders_south_america": _continent_leaders("South America", 5),
    "q13_wind_leaders": _source_leaders("wind_share_elec"),
    "q13_solar_leaders": _source_leaders("solar_share_elec", ["solar_consumption"]),
    "q13_hydro_leaders": _source_leaders("hydro_share_elec", ["hydro_consumption"], real_only=True),
    "q13_nuclear_leaders": _source_leaders(
        "nuclear_share_elec", ["nuclear_consumption"], real_only=True, report="nuclear_consumption"
    ),
    **_named(
        q14_singapore_efficiency, q14_nuclear_ranking, q14_nuclear_profiles, q14_nuclear_efficiency,
        q15_emission_shares, q15_average_shares, q15_temperature_and_gases, q15_ice_sea_and_land,
        q15_exposure, q15_disaster_counts, q15_damage_and_deaths, q15_displacement,
        q15_displacement_and_exposure, q15_economic_loss,
    ),
}

NESTED: dict[str, Callable[[DocumentTables], DataFrame]] = {
    "q02_covered_documents": lambda t: entities.full_coverage_docs(t.countries(), t.real_countries()),
    "q03_new_sources": lambda t: slices.new_sources_docs(
        t.countries(), "fossil_share_energy", 100, "energy", NOT_NEW_SOURCES, entities=SINGAPORE
    ),
    "q05_falling_oil_by_distance": lambda t: windows.falling_pairs(
        windows.moving_average_docs(
            t.countries(), "oil_consumption", 3, ["gdp"], ASEAN, 2000, 2021
        ),
        "entity", "year", "oil_consumption_ma", "gdp_ma",
    ),
    "q07_differences_by_year": lambda t: trade.matched_difference_docs(t.years()),
    "q08_averages_by_region": lambda t: aggregates.period_average_docs(t.years()),
    "q10_quarters_by_region": lambda t: season.quarterly_docs(t.years()),
    "q11_quarters_by_housing_type": lambda t: season.quarterly_gas_docs(t.years()),
}
