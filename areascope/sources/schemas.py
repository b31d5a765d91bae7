"""Explicit schemas of the input files; ids are text, so leading zeros survive."""

from __future__ import annotations

from areascope.functions.registry import embedding_columns, survey_names


def _doubles(names: list[str]) -> str:
    return ", ".join(f"`{n}` double" for n in names)


TRACT_EMBEDDINGS = (
    f"GEOID string, year int, {_doubles(embedding_columns())}, ALAND double, AWATER double"
)
BLOCK_GROUP_EMBEDDINGS = (
    "census_block_group string, embedding_year int, "
    f"{_doubles([f'a{i:02d}' for i in range(64)])}, area_km2 double"
)
MEASURES = (
    "Year int, LocationID string, MeasureId string, Short_Question_Text string, "
    "DataValueTypeID string, Data_Value double"
)
SURVEY = f"GEOID string, NAME string, {_doubles(list(survey_names()))}"
INDEX_FILE = (
    "GEOID string, State string, ReADI_CT_NR string, ReADI_CT_Raw string, "
    "MEDMORT double, NOINT double"
)
RANKED_INDICES = "GEOID string, SVI double, SDI double"
SCENES = (
    "scene_id string, ts timestamp_ntz, cloud_cover double, "
    "west double, south double, east double, north double"
)
SCENE_PIXELS = (
    "scene_id string, ts timestamp_ntz, row int, col int, band string, value float, scl int"
)
AREAS = "GEOID string, rings array<array<struct<x:double,y:double>>>"
