"""Block-group panel: change over time, spread over places, link to an index and to health."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from areascope.functions.keys import map_default, pad_geoid, state_of, to_double, tract_of
from areascope.functions.registry import state_table
from areascope.functions.vectors import assemble, weighted_mean
from areascope.operators import sweeps
from areascope.operators.design import design
from areascope.operators.folds import holdout
from areascope.operators.panel import complete_units, drop_incomplete, trajectories
from areascope.operators.projection import Projection, pca_apply, pca_fit
from areascope.operators.stats import (
    best_worst,
    distribution,
    histogram,
    sample_groups,
)
from areascope.operators.survey import complete_cases, latest, pivot_names, pivot_unique
from areascope.operators.sweeps import Model

DIMS = 64


def block_groups(raw: DataFrame) -> DataFrame:
    """Complete vectors by block group and year, with state and division."""
    df = raw.select(
        pad_geoid(F.col("census_block_group"), 12).alias("census_block_group"),
        "embedding_year", assemble([f"a{i:02d}" for i in range(DIMS)]).alias("vector"),
        "area_km2",
    )
    return with_division(drop_incomplete(df, "vector"), "census_block_group")


def with_division(df: DataFrame, key: str) -> DataFrame:
    states = state_table(df.sparkSession)
    df = df.withColumn("state_fips", state_of(F.col(key)))
    return map_default(
        df, "state_fips", states, "state_fips", "division", "census_division"
    )


def tracts(groups: DataFrame, year: int) -> DataFrame:
    """Area-weighted mean vector of each tract in one year."""
    keyed = groups.where(F.col("embedding_year") == year).withColumn(
        "census_tract", tract_of(F.col("census_block_group"))
    )
    return weighted_mean(
        keyed, "census_tract", "vector", "area_km2", DIMS,
        carry=["state_fips", "census_division"],
    )


def components(df: DataFrame, k: int) -> tuple[DataFrame, Projection]:
    """The frame with its first k components, and the projection."""
    fitted = pca_fit(df, "vector", k)
    return pca_apply(df, "vector", fitted), fitted


def sampled_trajectories(
    groups: DataFrame, k: int = 20, per_page: int = 5, seed: int = 42
) -> DataFrame:
    """Paths of k block groups seen in every year, five to a page, ends marked."""
    scored, _ = components(groups, 2)
    full = complete_units(groups, "census_block_group", "embedding_year")
    chosen = sample_groups(full, "census_block_group", seed, k=k)
    order = chosen.agg(F.array_sort(F.collect_list("census_block_group")).alias("names"))
    paged = order.select(F.posexplode("names").alias("place", "census_block_group")).select(
        "census_block_group", F.floor(F.col("place") / per_page).cast("int").alias("page")
    )
    rows = scored.join(F.broadcast(paged), "census_block_group")  # k rows
    return trajectories(rows, "census_block_group", "embedding_year").select(
        "page", "census_block_group", "embedding_year", F.col("pc")[0].alias("pc1"),
        F.col("pc")[1].alias("pc2"), "is_first", "is_last",
    )


def measure_shapes(measures: DataFrame, value_type: str = "CrdPrv") -> DataFrame:
    """Distribution of each measure in the latest year over tracts that have all of them."""
    last = latest(measures, "Year").where(F.col("DataValueTypeID") == value_type)
    wide, names = wide_measures(last)
    kept = last.join(wide.select("LocationID"), "LocationID", "left_semi")
    return distribution(kept, ["Short_Question_Text"], "Data_Value")


def wide_measures(rows: DataFrame) -> tuple[DataFrame, list[str]]:
    """One column per measure, tracts with every measure."""
    names = pivot_names(rows, "Short_Question_Text")
    wide = pivot_unique(rows, ["LocationID"], "Short_Question_Text", "Data_Value", names)
    return complete_cases(wide), names


def index_table(raw: DataFrame) -> DataFrame:
    """Tracts with a national rank in a known division."""
    df = raw.select(
        pad_geoid(F.col("GEOID")).alias("census_tract"), "State",
        to_double(F.col("ReADI_CT_NR")).alias("national_rank"),
        to_double(F.col("ReADI_CT_Raw")).alias("raw_score"),
    ).where(F.col("national_rank").isNotNull())
    return with_division(df, "census_tract").where(F.col("census_division") != "Unknown")


def index_shapes(index: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Histogram of the national rank, and its distribution by division."""
    return histogram(index, "national_rank", 50), distribution(
        index, ["census_division"], "national_rank"
    )


def index_from_vectors(
    groups: DataFrame, index: DataFrame, year: int = 2022, seed: int = 42
) -> DataFrame:
    """Ridge of the index on ten components, scored on held-out states."""
    scored, _ = components(tracts(groups, year), 10)
    # states are held out before the join, as the vectors have them
    split = holdout(scored, "state_fips", 0.2, seed)
    joined = split.join(index.select("census_tract", "national_rank"), "census_tract")
    rows, layout = design(
        joined, ["test"], ["national_rank"], vector=("pc", 10), scale=False,
        train="NOT test",
    )
    return sweeps.score_measures(rows, layout, [Model("components", ("vector",))], least_std=0.0)


def measures_from_vectors(
    groups: DataFrame, index: DataFrame, measures: DataFrame, year: int = 2022, seed: int = 42,
    value_type: str = "CrdPrv",
) -> DataFrame:
    """Ridge of every measure on ten components and on the index, held-out states:
    (measure, r2, mae, r2_readi), ranked."""
    scored, _ = components(tracts(groups, year), 10)
    split = holdout(scored, "state_fips", 0.2, seed)
    chosen = measures.where(
        (F.col("Year") == year) & (F.col("DataValueTypeID") == value_type)
    )
    wide, names = wide_measures(chosen)
    wide = wide.withColumn("census_tract", pad_geoid(F.col("LocationID"))).drop("LocationID")
    # both models are fitted where the index is known
    joined = split.join(wide, "census_tract").join(
        index.select("census_tract", "national_rank"), "census_tract"
    )
    rows, layout = design(
        joined, ["test"], names, vector=("pc", 10), numeric={"index": ["national_rank"]},
        scale=False, train="NOT test",
    )
    models = [Model("components", ("vector",)), Model("index", ("index",))]
    found = sweeps.score_measures(rows, layout, models)
    vectors, base = F.col("model") == "components", F.col("model") == "index"
    return (
        found.groupBy(F.col("outcome").alias("measure"))
        .agg(
            F.max(F.when(vectors, F.col("r2"))).alias("r2"),
            F.max(F.when(vectors, F.col("mae"))).alias("mae"),
            F.max(F.when(base, F.col("r2"))).alias("r2_readi"),
        )
        .orderBy(F.desc("r2"))
    )


def best_and_worst_measures(ranked: DataFrame, n: int = 3) -> DataFrame:
    return best_worst(ranked, "r2", "measure", n)
