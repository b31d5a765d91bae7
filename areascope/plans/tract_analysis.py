"""Tract analysis: embeddings, survey, health measures and deprivation indices by tract.

`load` brings the files together into one area table; the four questions are sweeps over it.
The area table is read several times, so write it once (`cached`) before asking.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from areascope.functions import registry
from areascope.functions.keys import index_labels, map_or_self, pad_geoid, state_of, to_double
from areascope.functions.ranking import percentile_rank
from areascope.functions.vectors import assemble
from areascope.operators import sweeps
from areascope.operators.design import design
from areascope.operators.folds import holdout, row_folds, with_group_folds
from areascope.operators.joins import lookup_join
from areascope.operators.logistic import count_people, counted, held_out_logistic
from areascope.operators.stats import area_decile, median_by
from areascope.operators.survey import (
    pivot_names,
    pivot_unique,
    prefer_year,
    prepare_survey,
    rename_map,
)
from areascope.operators.sweeps import Model
from areascope.sources import schemas
from areascope.sources.tables import read_csv

INDEX_COLUMNS = {"ReADI": "ReADI_CT_NR", "SVI": "SVI_NR", "SDI": "SDI_NR"}
EMBEDDINGS = Model("Embeddings", ("vector", "area"))
BY_INDEX = [Model(name, (name,), "bins") for name in INDEX_COLUMNS]


@dataclass
class TractTable:
    """One row per tract: tract_fips, state_fips, vector, ALAND, AWATER, indices, outcomes."""

    df: DataFrame
    measures: list[str]
    survey: list[str]


# --- files --------------------------------------------------------------------------------


def embeddings(spark: SparkSession, path: str, year: int = 2022) -> DataFrame:
    """Embedding statistics of one year as one array per tract, with land and water area."""
    names = registry.embedding_columns()
    raw = read_csv(spark, path, schemas.TRACT_EMBEDDINGS)
    return raw.where((F.col("year") == year) & F.col("A00_MAXIMUM").isNotNull()).select(
        pad_geoid(F.col("GEOID")).alias("tract_fips"), assemble(names).alias("vector"),
        "ALAND", "AWATER",
    )


def measures(spark: SparkSession, path: str) -> tuple[DataFrame, list[str]]:
    """Health measures, one column each: 2022 values where the measure has them, else 2023."""
    raw = read_csv(spark, path, schemas.MEASURES)
    chosen = prefer_year(raw, "MeasureId", "Year", 2022, 2023).select(
        pad_geoid(F.col("LocationID")).alias("tract_fips"), "MeasureId", "Data_Value"
    )
    names = pivot_names(chosen, "MeasureId")
    return pivot_unique(chosen, ["tract_fips"], "MeasureId", "Data_Value", names), names


def measure_labels(spark: SparkSession, path: str) -> DataFrame:
    """Readable name of each measure."""
    raw = read_csv(spark, path, schemas.MEASURES)
    return raw.select("MeasureId", "Short_Question_Text").distinct()


def index_file(spark: SparkSession, path: str) -> DataFrame:
    """National rank, and two survey columns only this file has."""
    raw = read_csv(spark, path, schemas.INDEX_FILE)
    named = raw.select(
        pad_geoid(F.col("GEOID")).alias("tract_fips"),
        to_double(F.col("ReADI_CT_NR")).alias("ReADI_CT_NR"), F.lit(True).alias("in_index"),
        *registry.INDEX_EXTRAS,
    )
    return rename_map(named, registry.INDEX_EXTRAS)


def ranked_indices(spark: SparkSession, path: str) -> DataFrame:
    """Two raw indices as national percentile ranks."""
    raw = read_csv(spark, path, schemas.RANKED_INDICES, null_value="NA").select(
        pad_geoid(F.col("GEOID")).alias("tract_fips"), "SVI", "SDI"
    )
    ranked = percentile_rank(percentile_rank(raw, "SVI", "SVI_NR"), "SDI", "SDI_NR")
    return ranked.drop("SVI", "SDI")


def load(
    spark: SparkSession, embedding_path: str, measure_path: str, index_path: str,
    ranked_path: str, survey_path: str | None = None,
) -> TractTable:
    """Embeddings and measures must be there; survey and index columns may be missing."""
    health, names = measures(spark, measure_path)
    df = embeddings(spark, embedding_path).join(health, "tract_fips")
    variables: list[str] = []
    if survey_path:
        survey = prepare_survey(read_csv(spark, survey_path, schemas.SURVEY))
        known = {
            v for line in registry.lines(registry.INDEX_VARIABLES) for v in line.split()[1:]
        }
        variables = [c for c in survey.columns if c in known]
        df = df.join(survey.select("tract_fips", *variables), "tract_fips", "left")
    df = df.join(index_file(spark, index_path), "tract_fips", "left")
    df = df.join(ranked_indices(spark, ranked_path), "tract_fips", "left")
    df = df.withColumn("state_fips", state_of(F.col("tract_fips")))
    return TractTable(df, names, variables + list(registry.INDEX_EXTRAS.values()))


# --- questions ----------------------------------------------------------------------------


def _rows(table: TractTable, df: DataFrame, keep: list[str], outcomes: list[str], dims: int):
    return design(
        df, keep, outcomes, vector=("vector", dims), numeric={"area": ["ALAND", "AWATER"]},
        binned=INDEX_COLUMNS, train="NOT test" if "test" in keep else None,
    )


def _indexed(table: TractTable) -> DataFrame:
    """Tracts the first index file lists; index values themselves may be missing."""
    return table.df.where("in_index")


def survey_and_measures(table: TractTable, dims: int = 320, folds: int = 5) -> DataFrame:
    """How much of each measure and survey variable the vectors explain across states:
    (group, variable, r2_mean, r2_std, indices), best first."""
    df = with_group_folds(table.df, "state_fips", folds)
    outcomes = [*table.measures, *table.survey]
    rows, layout = design(
        df, ["fold"], outcomes, vector=("vector", dims), numeric={"area": ["ALAND", "AWATER"]}
    )
    found = sweeps.cv_r2(rows, layout, [EMBEDDINGS], min_rows=100)
    group = F.when(F.col("variable").isin(table.measures), "PLACES").otherwise("ACS")
    named = found.withColumnRenamed("outcome", "variable").withColumn("group", group)
    members = registry.membership_table(table.df.sparkSession)
    return (
        index_labels(named, "variable", members)
        .select("group", "variable", "r2_mean", "r2_std", "indices")
        .orderBy(F.desc("r2_mean"))
    )


def compare_predictors(table: TractTable, dims: int = 320, seed: int = 42) -> DataFrame:
    """Each index, all indices, vectors, and both on held-out states:
    (outcome, model, r2, n_train, n_test)."""
    rows, layout = _rows(
        table, holdout(_indexed(table), "state_fips", 0.2, seed), ["test"], table.measures, dims
    )
    indices = tuple(INDEX_COLUMNS)
    models = [
        *BY_INDEX, Model("All indices", indices), EMBEDDINGS,
        Model("All indices + Embeddings", (*indices, *EMBEDDINGS.blocks)),
    ]
    return sweeps.compare_sets(rows, layout, models)


def beyond_indices(table: TractTable, dims: int = 320, seed: int = 42) -> DataFrame:
    """What the vectors explain of the residual each index leaves, by index, best first."""
    rows, layout = _rows(
        table, holdout(_indexed(table), "state_fips", 0.2, seed), ["test"], table.measures, dims
    )
    found = sweeps.residual_r2(rows, layout, BY_INDEX, EMBEDDINGS)
    return found.orderBy("index", F.desc("r2_residual"))


_SHORT = {"ReADI": "r2_readi", "SVI": "r2_svi", "SDI": "r2_sdi", "Embeddings": "r2_emb"}


def _short_names(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({f"r2_{name}": short for name, short in _SHORT.items()})


def by_state(table: TractTable, dims: int = 320, seed: int = 42) -> DataFrame:
    """Mean R² of each predictor inside every state:
    (state, r2_readi, r2_svi, r2_sdi, r2_emb, n_outcomes, n_tracts)."""
    df = row_folds(_indexed(table), "tract_fips", 2, seed, ["state_fips"])
    rows, layout = _rows(table, df, ["state_fips", "fold"], table.measures, dims)
    found = _short_names(sweeps.sweep_by(rows, layout, [*BY_INDEX, EMBEDDINGS], "state_fips"))
    states = registry.state_table(table.df.sparkSession).where("abbr IS NOT NULL")
    named = map_or_self(found, "state_fips", states, "state_fips", "abbr", "state")
    return named.select("state", *_SHORT.values(), "n_outcomes", "n_tracts")


def by_area_decile(table: TractTable, dims: int = 320, seed: int = 42) -> DataFrame:
    """The same inside every decile of land area:
    (decile, median_aland_km2, r2_readi, r2_svi, r2_sdi, r2_emb, n_tracts)."""
    deciled = area_decile(_indexed(table), "ALAND").where(F.col("decile").isNotNull())
    df = row_folds(deciled, "tract_fips", 2, seed, ["decile"])
    rows, layout = _rows(table, df, ["decile", "fold"], table.measures, dims)
    found = _short_names(sweeps.sweep_by(rows, layout, [*BY_INDEX, EMBEDDINGS], "decile"))
    sizes = median_by(deciled, ["decile"], "ALAND", "m").select(
        "decile", (F.col("m") / 1e6).alias("median_aland_km2")
    )
    joined = found.join(sizes, "decile")
    return joined.select("decile", "median_aland_km2", *_SHORT.values(), "n_tracts").orderBy(
        "decile"
    )


def individual_outcomes(
    table: TractTable, people: DataFrame, outcomes: list[str], dims: int = 320, seed: int = 42
) -> DataFrame:
    """How well the first index, the vectors, and both tell people's yes/no outcomes in held-out states:
    (outcome, model, n_train, n_test, log_loss, auc).

    `people` has tract_fips and the outcomes (true/false, 1/0 or missing), a row per person; they are
    counted by tract before anything is joined. People of tracts that are not in the table are left out.
    """
    counts = count_people(people, "tract_fips", outcomes)
    tracts = holdout(_indexed(table), "state_fips", 0.2, seed)
    lived_in = lookup_join(tracts, counts, "tract_fips", "inner")
    rows, layout = design(
        lived_in, ["test"], counted(outcomes), vector=("vector", dims),
        numeric={"area": ["ALAND", "AWATER"], "ReADI": [INDEX_COLUMNS["ReADI"]]}, train="NOT test",
    )
    models = [
        Model("ReADI alone", ("ReADI",)), EMBEDDINGS,
        Model("ReADI + Embeddings", ("ReADI", *EMBEDDINGS.blocks)),
    ]
    return held_out_logistic(rows, layout, models, outcomes)
