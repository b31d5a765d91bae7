"""Keys, lookups, survey preparation, panels: the edge rows each operator must handle."""

import json

import pytest
from pyspark.sql import functions as F

from areascope.functions import registry, scalars
from areascope.functions.keys import (
    in_registry,
    index_labels,
    map_default,
    map_or_self,
    pad_geoid,
    state_of,
    to_double,
    tract_of,
)
from areascope.operators import panel, survey
from areascope.operators.joins import keys_minus, outer_assemble, union_all
from areascope.sources import scenes, survey_pages, tables


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first().x


def test_pad_keeps_long_ids(spark):
    df = spark.createDataFrame([("1001020100",), ("01001020100",), ("010010201001",)], "g string")
    got = [r[0] for r in df.select(pad_geoid(F.col("g"))).collect()]
    assert got == ["01001020100", "01001020100", "010010201001"]
    assert one(spark, state_of(F.lit("01001020100"))) == "01"
    assert one(spark, tract_of(F.lit("010010201001"))) == "01001020100"
    assert one(spark, pad_geoid(F.lit(9001).cast("bigint"), 6)) == "009001"


def test_lenient_cast(spark):
    df = spark.createDataFrame([("1.5",), ("N/A",), (None,), ("NaN",)], "t string")
    assert [r[0] for r in df.select(to_double(F.col("t"))).collect()] == [1.5, None, None, None]


def test_lookups(spark):
    states = registry.state_table(spark)
    df = spark.createDataFrame([("09",), ("99",), ("72",), (None,)], "state string")
    got = map_default(df, "state", states, "state_fips", "division", "division").collect()
    assert {r.state: r.division for r in got} == {
        "09": "New England", "99": "Unknown", "72": "Territories", None: "Unknown"
    }
    got = map_or_self(df, "state", states.dropna(), "state_fips", "abbr", "abbr").collect()
    assert {r.state: r.abbr for r in got} == {"09": "CT", "99": "99", "72": "72", None: None}


def test_index_labels(spark):
    members = registry.membership_table(spark)
    df = spark.createDataFrame([("no_vehicle_pct",), ("nothing",)], "variable string")
    got = {r.variable: r.indices for r in index_labels(df, "variable", members).collect()}
    assert got == {"no_vehicle_pct": "ADI, SDI, SVI", "nothing": ""}
    assert in_registry(df, "variable", members).count() == 1
    assert members.select("variable").distinct().count() == 110


def test_registry_sizes():
    assert len(registry.survey_names()) == 110
    assert len(registry.share_specs()) == 72
    assert len(registry.embedding_columns()) == 320


def survey_frame(spark, rows):
    codes = list(registry.survey_names())
    base = {c: 10.0 for c in codes}
    data = [("1001020100", "a", *[{**base, **r}[c] for c in codes]) for r in rows]
    schema = "GEOID string, NAME string, " + ", ".join(f"{c} double" for c in codes)
    return spark.createDataFrame(data, schema)


def test_survey_preparation(spark):
    raw = survey_frame(
        spark,
        [
            {"B17021_001E": 40.0},
            {"B17021_002E": -666666666.0, "B17021_001E": -666666666.0},
            {"B17021_001E": 0.0, "B15003_002E": None},
            {"B19113_001E": -99999.0, "B19301_001E": -100000.0, "B19001_017E": 0.0},
        ],
    )
    rows = survey.prepare_survey(raw).collect()
    assert rows[0].tract_fips == "01001020100"
    assert rows[0].pov_below_other_pct == 25.0 and rows[0].pov_total_pct == 50.0
    # sentinel over sentinel is missing, not 100
    assert rows[1].pov_below_related_children_pct is None and rows[1].pov_total_pct is None
    assert rows[2].pov_below_other_pct is None  # zero universe
    assert rows[2].educ_lt9th_grade_pct == pytest.approx(900.0)  # the missing part counts 0
    assert rows[0].educ_lt9th_grade_pct == pytest.approx(1000.0)
    assert rows[3].median_family_income == -99999.0 and rows[3].per_capita_income is None
    assert rows[3].income_disparity_ratio is None and rows[0].income_disparity_ratio == 1.0
    assert rows[0].minority_pct == 0.0
    names = set(rows[0].asDict())
    assert "pov_universe" not in names and "educ_nursery" not in names
    assert "total_pop" in names and len([n for n in names if n in dict(
        registry.membership_table(spark).select("variable", F.lit(1)).collect())]) >= 106
    late = survey.prepare_survey(raw, late_sentinels=True).collect()
    assert late[1].pov_below_related_children_pct == 100.0


def test_prefer_year_is_per_measure(spark):
    df = spark.createDataFrame(
        [("t1", "A", 2022, 1.0), ("t2", "A", 2023, 2.0), ("t1", "B", 2023, 3.0),
         ("t2", "B", 2023, 4.0), ("t1", "C", 2021, 5.0)],
        "area string, m string, y int, v double",
    )
    got = {(r.area, r.m): r.v for r in survey.prefer_year(df, "m", "y").collect()}
    assert got == {("t1", "A"): 1.0, ("t1", "B"): 3.0, ("t2", "B"): 4.0}


def test_pivot_refuses_duplicates(spark):
    df = spark.createDataFrame([("t", "A", 1.0), ("t", "B", 2.0), ("u", "A", 3.0)], "a string, m string, v double")
    got = {r.a: (r.A, r.B) for r in survey.pivot_unique(df, ["a"], "m", "v", ["A", "B"]).collect()}
    assert got == {"t": (1.0, 2.0), "u": (3.0, None)}
    twice = df.union(df.limit(1))
    with pytest.raises(Exception, match="more than one row"):
        survey.pivot_unique(twice, ["a"], "m", "v", ["A", "B"]).collect()


def test_complete_panel(spark):
    df = spark.createDataFrame(
        [("a", 1), ("a", 2), ("b", 1), ("b", 1), ("c", 2)], "u string, y int"
    )
    kept = panel.complete_panel(df, "u", "y").collect()
    assert [(r.u, r.y) for r in sorted(kept)] == [("a", 1), ("a", 2)]


def test_outer_assemble(spark):
    a = spark.createDataFrame([(1, 10.0)], "k int, a double")
    b = spark.createDataFrame([(2, 20.0)], "k int, b double")
    rows = {r.k: (r.a, r.b) for r in outer_assemble([a, b], "k", [["a"], ["b"]]).collect()}
    assert rows == {1: (10.0, None), 2: (None, 20.0)}
    assert keys_minus(a, b, "k").collect()[0].k == 1
    assert union_all(a, b).columns == ["k", "a", "b"]


def test_pages(spark):
    pages = spark.createDataFrame(
        [
            (json.dumps([["NAME", "V1", "state", "county", "tract"],
                         ["x", "12.5", "01", "001", "020100"], ["y", "null?", "01", "001", "020200"],
                         ["z", None, "01", "003", "000100"]]),),
            (json.dumps([["V2", "state", "county", "tract"], ["-5", "01", "001", "020100"]]),),
            (json.dumps([["V2", "state", "county", "tract"]]),),
        ],
        "body string",
    )
    long = survey_pages.parse_api_pages(pages)
    got = {(r.geoid, r.variable): r.value for r in long.collect()}
    assert got == {
        ("01001020100", "V1"): 12.5, ("01001020200", "V1"): None, ("01003000100", "V1"): None,
        ("01001020100", "V2"): -5.0,
    }
    wide = {r.GEOID: r for r in survey_pages.assemble_survey(long, ["V1", "V2"]).collect()}
    assert wide["01001020100"].V2 == -5.0 and wide["01001020100"].NAME == "x" and len(wide) == 3


def test_request_plan(spark):
    vs = spark.createDataFrame(
        [(e, v, i, e == "acs/acs5") for e, v, i in registry.endpoint_variables()],
        "endpoint string, variable string, position int, named boolean",
    )
    states = spark.createDataFrame(
        [(line[:2],) for line in registry.lines(registry.STATES)], "state string"
    )
    plan = survey_pages.plan_requests(vs, states)
    assert plan.count() == 204
    one_state = {(r.endpoint, r.chunk): r.get.split(",") for r in plan.where("state = '01'").collect()}
    assert {k: len(v) for k, v in one_state.items()} == {
        ("acs/acs5", 0): 50, ("acs/acs5", 1): 33, ("acs/acs5/profile", 0): 15,
        ("acs/acs5/subject", 0): 13,
    }
    assert one_state[("acs/acs5", 0)][:2] == ["NAME", "B17021_001E"]
    assert "NAME" not in one_state[("acs/acs5", 1)]


def test_csv_and_cache(spark, tmp_path):
    path = str(tmp_path / "i.csv")
    with open(path, "w") as f:
        f.write("x,GEOID,SVI,SDI\n1,01001020100,NA,0.5\n2,01001020200,0.25,NaN\n")
    df = tables.read_csv(spark, path, "GEOID string, SVI double, SDI double", "NA")
    assert [tuple(r) for r in df.collect()] == [
        ("01001020100", None, 0.5), ("01001020200", 0.25, None)
    ]
    out = str(tmp_path / "cache")
    built = []

    def build():
        built.append(1)
        return df

    assert tables.cached(spark, out, build).count() == 2
    assert tables.cached(spark, out, build).count() == 2
    assert len(built) == 1
    tables.cached(spark, out, build, refresh=True)
    assert len(built) == 2
    tables.write_csv(df, str(tmp_path / "csv"))
    back = spark.read.option("header", True).csv(str(tmp_path / "csv"))
    assert back.columns == ["GEOID", "SVI", "SDI"] and back.count() == 2
    tables.write_tiles(df, str(tmp_path / "tiles"), ["GEOID"])
    assert tables.read_parquet(spark, str(tmp_path / "tiles")).count() == 2
    tables.write_panel(df, str(tmp_path / "panel"), "GEOID")
    assert tables.pending(df, df.limit(1), "GEOID").count() == 1


def test_windows_and_scalars(spark):
    assert scenes.windows(2022, False) == [("annual", "2022-01-01", "2022-12-31")]
    assert scenes.windows(2022, True)[2] == ("fall", "2022-09-01", "2022-11-30")
    assert one(spark, scalars.utm_epsg(F.lit(-71.908), F.lit(-71.075))) == "EPSG:32619"
    assert one(spark, scalars.area_label(F.lit(2.6))) == "3 km²"
    assert one(spark, scalars.area_label(F.lit(0.5))) == "50 ha"
    assert one(spark, scalars.safe_ratio(F.lit(1.0), F.lit(-1.0))) is None
    assert one(spark, scalars.additional_var(F.lit(-0.5), F.lit(0.3))) == 0.0
    assert one(spark, scalars.additional_var(F.lit(0.5), F.lit(-2.0))) == 1.5
    for day, name in [("2022-01-31", None), ("2022-03-01", "spring"), ("2022-11-30", "fall"),
                      ("2022-12-01", None), ("2022-08-31", "summer")]:
        assert one(spark, scalars.season(F.lit(day).cast("date"))) == name
    late = F.lit("2022-06-01 02:00:00").cast("timestamp_ntz")
    assert str(one(spark, scalars.solar_day(late, F.lit(-75.0)))) == "2022-05-31"
    r2 = scalars.r2_from_sums
    assert one(spark, r2(F.lit(0.0), F.lit(0.0))) == 1.0
    assert one(spark, r2(F.lit(2.0), F.lit(0.0))) == 0.0
    assert one(spark, r2(F.lit(1.0), F.lit(4.0))) == 0.75


def test_scene_search(spark):
    df = spark.createDataFrame(
        [("a", "2022-06-01 10:00:00", 79.9, -72.0, 41.0, -71.0, 42.0),
         ("b", "2022-06-01 10:00:00", 80.0, -72.0, 41.0, -71.0, 42.0),
         ("c", "2022-08-31 23:59:59", 5.0, -72.0, 41.0, -71.0, 42.0),
         ("d", "2022-09-01 00:00:00", 5.0, -72.0, 41.0, -71.0, 42.0),
         ("e", "2022-07-01 00:00:00", 5.0, -80.0, 41.0, -79.0, 42.0)],
        "scene_id string, ts string, cloud_cover double, west double, south double, east double, north double",
    ).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    box = registry.STATE_BOXES["RI"]
    got = scenes.select_scenes(df, box, "2022-06-01", "2022-08-31").select("scene_id").collect()
    assert {r[0] for r in got} == {"a", "c"}
    px = spark.createDataFrame(
        [("a", "red", 1.0), ("a", "coastal", 2.0), ("b", "red", 3.0)],
        "scene_id string, band string, value double",
    )
    kept = scenes.read_pixels(px, df.where("scene_id = 'a'"), registry.SEASONAL_BANDS).collect()
    assert [(r.scene_id, r.band) for r in kept] == [("a", "red")]
