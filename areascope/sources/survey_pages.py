"""Survey API pages: which requests to make, and their answers as long rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from areascope.functions.keys import make_geoid, to_double
from areascope.operators.joins import is_small

MAX_VARIABLES = 49
KEY_COLUMNS = ("NAME", "state", "county", "tract")


def plan_requests(variables: DataFrame, states: DataFrame, k: int = MAX_VARIABLES) -> DataFrame:
    """One row per request: (endpoint, chunk, state, get).

    `variables` is (endpoint, variable, position from 0, named): at most k variables go in a
    request, and the area name is asked for once, in the first chunk of a `named` endpoint.
    """
    chunks = (
        variables.withColumn("chunk", F.floor(F.col("position") / k).cast("int"))
        .groupBy("endpoint", "chunk")
        .agg(
            F.array_sort(F.collect_list(F.struct("position", "variable"))).alias("vs"),
            F.bool_or("named").alias("named"),
        )
    )
    names = F.transform("vs", lambda v: v["variable"])
    with_name = F.col("named") & (F.col("chunk") == 0)
    asked = F.when(with_name, F.concat(F.array(F.lit("NAME")), names)).otherwise(names)
    if not is_small(states, 1_000):
        raise ValueError("the state list must be short")
    return chunks.crossJoin(F.broadcast(states.select("state"))).select(
        "endpoint", "chunk", "state", F.array_join(asked, ",").alias("get")
    )


def parse_api_pages(pages: DataFrame, body: str = "body") -> DataFrame:
    """Answers (JSON array of arrays, header first) to long rows (geoid, name, variable, value).

    The area key is state + county + tract; text that is no number becomes missing. Column
    places come from each page's own header.
    """
    parsed = pages.select(F.from_json(body, "array<array<string>>").alias("t"))
    rows = parsed.select(
        F.element_at("t", 1).alias("header"),
        F.explode(F.slice("t", 2, F.greatest(F.size("t") - 1, F.lit(0)))).alias("row"),
    ).select(F.map_from_arrays("header", "row").alias("m"))
    keyed = rows.select(
        make_geoid(F.col("m")["state"], F.col("m")["county"], F.col("m")["tract"]).alias("geoid"),
        F.col("m")["NAME"].alias("name"),
        F.explode(F.map_filter("m", lambda k, _: ~k.isin(*KEY_COLUMNS))).alias(
            "variable", "text"
        ),
    )
    return keyed.select("geoid", "name", "variable", to_double(F.col("text")).alias("value"))


def assemble_survey(long: DataFrame, variables: list[str]) -> DataFrame:
    """Long rows of all chunks and endpoints to one wide row per area (a full outer join)."""
    picks = [
        F.max(F.when(F.col("variable") == v, F.col("value"))).alias(v) for v in variables
    ]
    return long.groupBy(F.col("geoid").alias("GEOID")).agg(F.max("name").alias("NAME"), *picks)
