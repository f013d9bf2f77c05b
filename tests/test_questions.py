"""The fifteen questions over a small world: both forms agree, and joins match pairwise results."""

import datetime
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from helpers import same
from panelspark.operators import documents
from panelspark.plans import questions
from panelspark.sources import schemas
from panelspark.sources.energy import DocumentTables, FlatTables, reader

YEARS = range(1996, 2022)
CONTINENTS = {
    "Asia": [*questions.ASEAN, "Hong Kong", "Japan"],
    "Europe": ["France", "Russia", "Norway", "Iceland", "Spain", "Italy"],
    "North America": ["United States", "Canada", "Mexico", "Cuba"],
    "South America": ["Brazil", "Chile", "Peru", "Bolivia", "Uruguay", "Ecuador"],
}
REGIONS = ["Central", "East", "North", "West", "Overall"]


def value(rng, holes=0.0, zeros=0.0):
    draw = rng.random()
    if draw < holes:
        return None
    return 0.0 if draw < holes + zeros else float(rng.randint(1, 4000)) / 4


def build(spark, folder):
    """Every flat table from one seeded rule, and the documents derived from them by Spark."""
    rng = random.Random(7)
    countries = [(c, continent) for continent, members in CONTINENTS.items() for c in members]
    everyone = [c for c, _ in countries] + list(CONTINENTS) + ["World"]

    def write(name, data):
        df = spark.createDataFrame(data, schemas.TABLES[name])
        df.coalesce(1).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
        return df

    master = [(c, c[:3].upper(), continent) for c, continent in countries]
    master += [(c, f"OWID_{c[:3].upper()}", c) for c in CONTINENTS]
    write("continents-according-to-our-world-in-data", master)
    write("countriesOWID", master)

    metrics = schemas.PANEL_TABLES["owid_energy_data"].names[3:]
    code = {c: code for c, code, _ in master} | {"World": "OWID_WRL"}
    panel = []
    for c in everyone:
        for y in YEARS:
            if c in ("Cuba", "Peru") and y == 2003:
                continue
            panel.append((c, code[c], y, *[value(rng, holes=0.02, zeros=0.02) for _ in metrics]))
    position = 3 + metrics.index("oil_consumption")
    panel = [r[:position] + (r[position] or 1.0,) + r[position + 1 :] for r in panel]
    energy = write("owid_energy_data", panel)
    info = [(r[0], r[2], r[3], r[4]) for r in panel]
    write("owid_countryinfo", info)
    write("owid_countryenergy", [(c, y, value(rng), value(rng)) for c in everyone for y in YEARS])
    write("owid_nuclear", [(c, value(rng, holes=0.3)) for c in everyone for _ in YEARS])

    products = [("Oil", s) for s in ("Crude", "Naphtha", "Jet", "Diesel", "Petrol", "Bitumen", "Kerosene")]
    products += [("Gas", s) for s in ("LNG", "PNG")] + [("Coal", "Peat")]
    keys = [(y, p, s) for y in range(2008, 2016) for p, s in products]
    imports = [(*k, value(rng)) for k in keys if k[2] != "Peat"]
    exports = [(*k, value(rng)) for k in keys if k[2] != "PNG"]
    write("importsofenergyproducts", imports)
    write("exportsofenergyproducts", exports)

    household = [
        (r, d, kind, y, m, value(rng))
        for r in REGIONS
        for y in range(2005, 2016)
        for m in ["Annual", *[f"{i}/1/{y}" for i in range(1, 13)]]
        for kind, d in [("Overall", r), ("Flat", r), ("Overall", "Town")]
    ]
    write("householdelectricityconsumption", household)
    types = ["Flat", "Condo", "Overall", "Public Housing", "Private Housing"]
    months = [*map(str, range(1, 13)), "na", "East Region"]
    write(
        "householdtowngasconsumption",
        [(k, y, m, value(rng)) for k in types for y in range(2005, 2016) for m in months],
    )
    write(
        "owid-co2-data",
        [(y, *[value(rng, holes=0.1) for _ in range(3)], value(rng), value(rng)) for y in range(1985, 2021) for _ in range(5)],
    )
    write(
        "globaltemperatures",
        [(datetime.date(y, m, 1), value(rng, zeros=0.1)) for y in range(1985, 2016) for m in range(1, 13)],
    )
    write("external_seaice", [(y, value(rng)) for y in range(1980, 2019) for _ in range(3)])
    write("external_sealevelchg", [(y, value(rng)) for y in range(1993, 2018)])
    write("external_population_under_5_metres", [(c, value(rng, holes=0.1)) for c in everyone for _ in range(2)])
    write(
        "external_cc_disasterfreq",
        [(c, y, k, value(rng)) for c in everyone for y in range(1990, 2025, 3) for k in ("Flood", "Storm")],
    )
    write("external_economic_damage_from_natural_disasters", [(c, y, value(rng)) for c in everyone for y in range(1995, 2015)])
    write(
        "external_deaths_from_natural_disasters_by_type",
        [(c, y, value(rng, holes=0.2)) for c in everyone for y in range(1995, 2015, 2)],
    )
    write(
        "external_disaster_displacement",
        [(c, k, value(rng, holes=0.1)) for c in [*everyone, "Atlantis"] for k in ("Flood", "Storm") for _ in range(3)],
    )
    write("external_direct_disaster_economic_loss", [(c, value(rng, holes=0.1)) for c in everyone for _ in range(3)])

    flat = FlatTables(reader(spark, folder))
    to_docs = documents.to_documents(energy.withColumnRenamed("country", "entity"), documents.DocumentLayout())
    to_docs.write.mode("overwrite").parquet(f"{folder}/finalOWIDdata.parquet")
    years = documents.trade_documents(flat.trade()).join(
        documents.household_documents(flat.household(), flat.town_gas()), "year", "full"
    )
    years.write.mode("overwrite").parquet(f"{folder}/finalSGYearlyData.parquet")


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("world"))
    build(spark, folder)
    return FlatTables(reader(spark, folder)), DocumentTables(reader(spark, folder)), folder


def collected(df, names):
    return [tuple(r) for r in df.select(*names).collect()]


@pytest.mark.parametrize("name", sorted(questions.ON_DOCUMENTS))
def test_documents_give_the_flat_answer(world, name):
    flat, docs, _ = world
    question = questions.ON_DOCUMENTS[name]
    expected = question(flat)
    names = sorted(expected.columns)
    got = question(docs)
    assert sorted(got.columns) == names
    wanted = collected(expected, names)
    assert wanted
    assert same(collected(got, names), wanted)


def over(a, b):
    """a / b, missing where b is 0 or missing."""
    return a / b.where(b != 0)


def real_names(m):
    return set(m[~m.Code.str.startswith("OWID") & (m.Continent != m.Entity)].Entity)


def best(scores, k):
    """First k names by falling score, missing scores last, ties by name."""
    known = [(-v, name) for name, v in scores.items() if v == v]
    return [name for _, name in sorted(known)][:k]


def mean_by(df, keys, **columns):
    return df.groupby(keys, as_index=False).agg(**{n: (c, "mean") for n, c in columns.items()})


def singapore_below_100(t):
    e = t("owid_energy_data")
    e = e[(e.country == "Singapore") & (e.fossil_share_energy < 100)]
    return e.assign(entity=e.country, first_year=e.year.min())


def asian_peers(t):
    master, i = t("continents-according-to-our-world-in-data"), t("owid_countryinfo")
    asian = set(master[master.Continent == "Asia"].Entity)
    i = i[i.country.isin(asian) & i.year.between(1965, 2018)]
    ranked = mean_by(i.assign(entity=i.country, r=over(i.gdp, i.population)), "entity", avg_score="r")
    return ranked.assign(continent="Asia")


def per_capita(e):
    return e.assign(entity=e.country, r=over(e.gdp, e.population))


def continent_gdp(t):
    e = per_capita(t("owid_energy_data"))
    e = e[e.gdp.notna()].merge(t("continents-according-to-our-world-in-data"), left_on="country", right_on="Entity")
    return mean_by(
        e.assign(continent=e.Continent), "continent",
        avg_renewables_share_elec="renewables_share_elec", avg_gdp_per_capita="r",
    )


def continent_leaders(continent, k):
    def expected(t):
        e, master = per_capita(t("owid_energy_data")), t("continents-according-to-our-world-in-data")
        members = set(master[master.Continent == continent].Entity)
        candidates = e[e.country.isin(members & real_names(master))]
        score = over(candidates.renewables_consumption, candidates.electricity_demand)
        chosen = best(score.groupby(candidates.country).mean(), k)
        recent = e[e.year >= 2000]
        averages = {"avg_renewables_share_elec": "renewables_share_elec", "avg_gdp_per_capita": "r"}
        own = recent[recent.country.isin(chosen) & recent.gdp.notna()]
        benchmark = recent[recent.country.isin(members)].assign(entity=continent)
        return pd.concat([mean_by(own, "entity", **averages), mean_by(benchmark, "entity", **averages)])

    return expected


def source_leaders(score, report, require=None, real_only=False):
    def expected(t):
        e = per_capita(t("owid_energy_data"))
        recent = e[(e.year >= 2000) & e.gdp.notna()]
        voters = recent if require is None else recent[recent[require].notna()]
        if real_only:
            voters = voters[voters.country.isin(real_names(t("continents-according-to-our-world-in-data")))]
        chosen = best(voters.groupby("country")[score].mean(), 5)
        averages = {f"avg_{report}": report, "avg_gdp_per_capita": "r"}
        return mean_by(recent[recent.country.isin(chosen)], "year", **averages)

    return expected


def nuclear_ranking(t):
    n = t("owid_nuclear")
    return mean_by(n.assign(entity=n.country), "entity", avg_score="nuclear_electricity")


def nuclear_rows(t):
    e = per_capita(t("owid_energy_data"))
    return e[e.country.isin(["France", "Russia", "United States"])]


def nuclear_profiles(t):
    e = nuclear_rows(t)
    return e[e.year >= 2000].assign(gdp_per_capita=e.r)


def nuclear_efficiency(t):
    e = nuclear_rows(t)
    return e[e.year == 2020].assign(
        nuclear_efficiency=over(e.nuclear_electricity, e.nuclear_consumption),
        fossil_efficiency=over(e.fossil_electricity, e.fossil_fuel_consumption),
        renewable_efficiency=over(e.renewables_electricity, e.renewables_consumption),
    )


def land_by_year(t):
    g = t("globaltemperatures")
    return g.assign(period=pd.to_datetime(g.recordedDate).dt.year, temp=g.LandAverageTemperature)


def temperature_and_gases(t):
    land, gases = land_by_year(t), t("owid-co2-data")
    land = mean_by(land[(land.temp != 0) & (land.period > 1990)], "period", avg_yearly_temp="temp")
    gases = gases[gases.year > 1990].groupby("year").total_ghg.sum()
    return land[land.period.isin(gases.index)].assign(total_ghg=land.period.map(gases))


def ice_sea_and_land(t):
    ice = mean_by(t("external_seaice"), "year", avg_seaice_extent="extent")
    sea = t("external_sealevelchg").set_index("year").avg_sealevel_chg_in_mm
    land = land_by_year(t).groupby("period").temp.mean()
    return ice.assign(
        period=ice.year, avg_sealevel_chg_in_mm=ice.year.map(sea), avg_landtemp=ice.year.map(land)
    )


def with_continent(df, column, t):
    master = t("continents-according-to-our-world-in-data")
    df = df[df[column].isin(real_names(master))]
    return df.assign(continent=df[column].map(master.set_index("Entity").Continent))


def exposure_by_continent(t):
    x = with_continent(t("external_population_under_5_metres"), "Country", t)
    result = mean_by(x, "continent", below="2010")
    return result.assign(above=100 - result.below)


def disaster_counts(t):
    known = set(zip(t("owid_countryinfo").country, t("owid_countryinfo").year, strict=True))
    f = t("external_cc_disasterfreq")
    f = f[[(c, y) in known for c, y in zip(f.country, f.year, strict=True)]]
    return f.groupby(["year", "type"], as_index=False).agg(total=("value", "sum")).assign(scope="World")


def damage_and_deaths(t):
    damage = t("external_economic_damage_from_natural_disasters")
    damage.columns = ["entity", "year", "damage"]
    deaths = t("external_deaths_from_natural_disasters_by_type")
    deaths.columns = ["entity", "year", "deaths"]
    both = damage[damage.year >= 2000].merge(deaths, "left", ["entity", "year"])
    return mean_by(both, "entity", avg_damage="damage", avg_deaths="deaths")


def displacement(t, exposed=False):
    """Every flood next to every year of its country (and every exposure figure), one by one."""
    floods = t("external_disaster_displacement")
    floods = with_continent(floods[floods["Hazard Type"] == "Flood"], "country", t)
    pairs = floods.merge(t("owid_countryinfo"), "left", "country")
    averages = {
        "avg_displacements": "displacements", "avg_population": "population",
        "pct_displacements": "pct", "avg_gdp_per_capita": "r",
    }
    if exposed:
        pairs = pairs.merge(t("external_population_under_5_metres"), "left", left_on="country", right_on="Country")
        averages["avg_exposed"] = "2010"
    pairs = pairs.assign(pct=100 * over(pairs.displacements, pairs.population))
    return mean_by(per_capita(pairs), "continent", **averages)


def economic_loss(t):
    info, losses = t("owid_countryinfo"), t("external_direct_disaster_economic_loss")
    big = info[info.population >= info.population.mean()]
    pairs = losses.merge(big, left_on="entity", right_on="country")
    pairs = pairs.assign(loss=pairs.economic_loss_from_disasters_USD)
    pairs = pairs.assign(pct=100 * over(pairs.loss, pairs.gdp))
    return mean_by(
        pairs, "entity", avg_loss="loss", avg_population="population", avg_gdp="gdp", pct_loss="pct"
    )


EXPECTED = {
    "q03_fossil_below_100": singapore_below_100,
    "q12_asian_peers": asian_peers,
    "q13_continent_gdp": continent_gdp,
    "q13_leaders_europe": continent_leaders("Europe", 5),
    "q13_leaders_north_america": continent_leaders("North America", 3),
    "q13_leaders_south_america": continent_leaders("South America", 5),
    "q13_wind_leaders": source_leaders("wind_share_elec", "wind_share_elec"),
    "q13_solar_leaders": source_leaders("solar_share_elec", "solar_share_elec", "solar_consumption"),
    "q13_hydro_leaders": source_leaders("hydro_share_elec", "hydro_share_elec", "hydro_consumption", True),
    "q13_nuclear_leaders": source_leaders("nuclear_share_elec", "nuclear_consumption", "nuclear_consumption", True),
    "q14_nuclear_ranking": nuclear_ranking,
    "q14_nuclear_profiles": nuclear_profiles,
    "q14_nuclear_efficiency": nuclear_efficiency,
    "q15_temperature_and_gases": temperature_and_gases,
    "q15_ice_sea_and_land": ice_sea_and_land,
    "q15_exposure": exposure_by_continent,
    "q15_disaster_counts": disaster_counts,
    "q15_damage_and_deaths": damage_and_deaths,
    "q15_displacement": displacement,
    "q15_displacement_and_exposure": lambda t: displacement(t, exposed=True),
    "q15_economic_loss": economic_loss,
}


@pytest.mark.parametrize("name", sorted(EXPECTED))
def test_flat_answer_equals_pairwise_computation(world, name):
    flat, _, folder = world
    got = questions.QUESTIONS[name](flat)
    names = sorted(got.columns)
    expected = EXPECTED[name](lambda table: pd.read_parquet(f"{folder}/{table}.parquet"))
    wanted = [tuple(native(v) for v in r) for r in expected[names].itertuples(index=False, name=None)]
    assert wanted
    assert same(collected(got, names), wanted)


def native(v):
    if isinstance(v, str):
        return v
    if v is None or v != v:
        return None
    return float(v) if isinstance(v, float) else int(v)


def test_every_question_has_a_check():
    checked = set(questions.ON_DOCUMENTS) | set(EXPECTED)
    rest = set(questions.QUESTIONS) - checked
    assert rest == {
        "q10_regional_bars",
        "q12_gdp_per_capita",
        "q12_energy_intensity",
        "q14_singapore_efficiency",
        "q15_emission_shares",
        "q15_average_shares",
    }


@pytest.mark.parametrize("name", sorted(set(questions.QUESTIONS) - set(questions.ON_DOCUMENTS) - set(EXPECTED)))
def test_remaining_questions_run(world, name):
    assert questions.QUESTIONS[name](world[0]).count() > 0


def test_top_fives_have_five_members(world):
    flat, _, _ = world
    assert questions.q13_renewables_leaders(flat).select("entity").distinct().count() == 5
    assert questions.QUESTIONS["q13_leaders_north_america"](flat).count() == 4


@pytest.mark.parametrize(
    ("nested", "flat_name", "arrays", "columns"),
    [
        ("q07_differences_by_year", "q07_yearly_differences", ["products", "sub_products"], ["year", "product", "sub_product", "yearly_diff"]),
        ("q08_averages_by_region", "q08_regional_average", ["yearlyData"], ["region", "year", "yearly_avg_kwh_per_acc"]),
        ("q10_quarters_by_region", "q10_regional_quarters", ["years", "quarters"], ["region", "year", "quarter", "avg_kwh"]),
        ("q11_quarters_by_housing_type", "q11_town_gas_quarters", ["years", "quarters"], ["sub_housing_type", "year", "quarter", "avg_kwh"]),
    ],
)
def test_nested_answers_unnest_to_the_flat_ones(world, nested, flat_name, arrays, columns):
    flat, docs, _ = world
    df = questions.NESTED[nested](docs)
    for array in arrays:
        assert df.filter(F.size(array) == 0).count() == 0
        df = df.select(*[c for c in df.columns if c != array], F.inline(array))
    if nested == "q07_differences_by_year":
        df = df.dropna(subset=["yearly_diff"])
    expected = questions.QUESTIONS[flat_name](flat)
    flat_columns = ["yearly_avg" if c == "yearly_avg_kwh_per_acc" else c for c in columns]
    assert same(collected(df, columns), collected(expected, flat_columns))


def test_falls_by_distance_equal_falls_by_row_on_dense_series(world):
    flat, docs, _ = world
    by_distance = questions.NESTED["q05_falling_oil_by_distance"](docs)
    by_row = questions.q05_asean_falling_oil(flat)
    a = by_distance.select("entity", F.concat((F.col("year") - 2).cast("string"), F.lit(" - "), F.col("year").cast("string")), "gdp_ma")
    assert same([tuple(r) for r in a.collect()], collected(by_row, ["entity", "period", "gdp_ma"]))


def test_new_sources_and_covered_documents(world):
    flat, docs, _ = world
    new = questions.NESTED["q03_new_sources"](docs)
    years = {r.year for r in questions.q03_fossil_below_100(flat).collect()}
    got = new.collect()
    assert got and {r.year for r in got} <= years
    assert not {r.energy for r in got} & set(questions.NOT_NEW_SOURCES)
    covered = questions.NESTED["q02_covered_documents"](docs)
    assert collected(covered.orderBy("entity"), ["entity"]) == collected(
        questions.q02_full_coverage(flat).orderBy("entity"), ["entity"]
    )
    assert "Cuba" not in {r.entity for r in covered.collect()}


def test_stored_countries_serve_the_later_questions(spark, world):
    _, _, folder = world
    docs = DocumentTables(reader(spark, folder))
    computed = collected(questions.q01_countries(docs).orderBy("entity"), ["entity", "code"])
    covered = collected(questions.NESTED["q02_covered_documents"](docs).orderBy("entity"), ["entity"])
    assert docs.store_countries().columns == ["country", "iso_code"]
    assert collected(spark.table("finalCountries").orderBy("country"), ["country", "iso_code"]) == computed
    plan = questions.q01_countries(docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Join" not in plan
    assert questions.q01_country_count(docs).first().entities == len(computed)
    again = questions.NESTED["q02_covered_documents"](docs)
    assert collected(again.orderBy("entity"), ["entity"]) == covered


@pytest.fixture(scope="module")
def mixed_case(spark, world, tmp_path_factory):
    """The household tables with the total rows and names written in several cases."""
    _, _, folder = world
    other = str(tmp_path_factory.mktemp("mixed"))
    keys = {
        "householdelectricityconsumption": ["region", "Description", "dwelling_type"],
        "householdtowngasconsumption": ["sub_housing_type"],
    }
    for name, texts in keys.items():
        df = spark.read.parquet(f"{folder}/{name}.parquet")
        odd = F.pmod(F.xxhash64(*df.columns), F.lit(3))
        spelled = {c: F.when(odd == 0, F.lower(c)).when(odd == 1, F.upper(c)).otherwise(F.col(c)) for c in texts}
        df.withColumns(spelled).write.parquet(f"{other}/{name}.parquet")
    return other


@pytest.mark.parametrize(
    "name",
    ["q08_regional_average", "q09_regional_falls", "q09_saving_stars", "q10_regional_quarters", "q11_town_gas_quarters"],
)
def test_questions_without_case(spark, world, mixed_case, name):
    flat, _, _ = world
    question = questions.QUESTIONS[name]
    expected = question(flat)
    names = sorted(expected.columns)
    folded = question(FlatTables(reader(spark, mixed_case, ignore_case=True)))

    def lowered(df):
        return [tuple(v.lower() if isinstance(v, str) else v for v in r) for r in df.select(*names).collect()]

    assert same(lowered(folded), lowered(expected))
