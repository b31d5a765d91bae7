"""The three flows end to end on files laid out like the real ones."""

import csv

import numpy as np
import pytest
from pyspark.sql import functions as F

from areascope.functions import registry
from areascope.plans import imagery, panel, tract_analysis
from areascope.sources.tables import cached, read_csv, read_parquet
from areascope.sources import schemas

STATES = [line[:2] for line in registry.lines(registry.STATES)[:12]]


def write(path, header, rows):
    with open(path, "w", newline="") as f:
        out = csv.writer(f)
        out.writerow(header)
        out.writerows(["" if v is None else v for v in row] for row in rows)
    return str(path)


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    folder = tmp_path_factory.mktemp("tracts")
    rng = np.random.default_rng(4)
    ids = [f"{s}{c:03d}{t:06d}" for s in STATES for c in (1, 2) for t in range(30)]
    base = rng.normal(size=(len(ids), 64))
    emb, health, index, ranked, survey = [], [], [], [], []
    codes = list(registry.survey_names())
    for i, g in enumerate(ids):
        number = str(int(g))  # files lose the leading zero
        stats = [v + k * 0.1 for v in base[i] for k in range(5)]
        emb.append([number, 2022, *stats, 1e6 * (1 + i % 50), 10.0, "x"])
        emb.append([number, 2021, *stats, 1.0, 10.0, "x"])
        truth = 50 + 5 * base[i, 0] + rng.normal()
        health.append([2022, number, "OBESITY", "Obesity", "CrdPrv", truth])
        health.append([2023, number, "OBESITY", "Obesity", "CrdPrv", truth + 1])
        if i % 4:
            health.append([2023, number, "SLEEP", "Sleep", "CrdPrv", 30 + base[i, 1]])
        index.append([number, "XX", 50 + 10 * base[i, 2], base[i, 2], 900 + i % 7, 3.0])
        ranked.append([number, "NA" if i % 9 == 0 else base[i, 3], base[i, 4]])
        counts = {c: 100.0 for c in codes} | {"B17021_002E": 20 + base[i, 5]}
        survey.append([f"n{i}", *[counts[c] for c in codes], number])
    index = index[:-5]
    return {
        "embeddings": write(folder / "e.csv", ["GEOID", "year", *registry.embedding_columns(),
                                               "ALAND", "AWATER", "other"], emb),
        "measures": write(folder / "m.csv", ["Year", "LocationID", "MeasureId",
                          "Short_Question_Text", "DataValueTypeID", "Data_Value"], health),
        "index": write(folder / "i.csv", ["GEOID", "State", "ReADI_CT_NR", "ReADI_CT_Raw",
                                          "MEDMORT", "NOINT"], index),
        "ranked": write(folder / "r.csv", ["GEOID", "SVI", "SDI"], ranked),
        "survey": write(folder / "s.csv", ["NAME", *codes, "GEOID"], survey),
        "n": len(ids),
    }


@pytest.fixture(scope="module")
def tract_table(spark, files, tmp_path_factory):
    t = tract_analysis.load(
        spark, files["embeddings"], files["measures"], files["index"], files["ranked"],
        files["survey"],
    )
    path = str(tmp_path_factory.mktemp("cache") / "areas")
    t.df = cached(spark, path, lambda: t.df)
    return t


def test_load(tract_table, files):
    df = tract_table.df
    assert df.count() == files["n"] and df.where("length(tract_fips) = 11").count() == files["n"]
    assert tract_table.measures == ["OBESITY", "SLEEP"]
    # every indexed survey variable but the income ratio's companions is there
    assert len(tract_table.survey) >= 105 and "pct_no_telephone" in tract_table.survey
    assert df.where("SLEEP IS NULL").count() == files["n"] // 4
    assert df.where("SVI_NR IS NULL").count() == files["n"] // 9
    top = df.agg(F.max("SDI_NR"), F.size(F.first("vector"))).first()
    assert top[0] == 100.0 and top[1] == 320


def test_questions(spark, tract_table, files):
    first = tract_analysis.survey_and_measures(tract_table).collect()
    r2 = {r.variable: r for r in first}
    assert r2["OBESITY"].r2_mean > 0.7 and r2["OBESITY"].group == "PLACES"
    assert r2["pov_total_pct"].group == "ACS" and r2["pov_total_pct"].indices == "ADI"
    assert [r.r2_mean for r in first] == sorted((r.r2_mean for r in first), reverse=True)
    sets = {(r.outcome, r.model): r for r in tract_analysis.compare_predictors(tract_table).collect()}
    assert len(sets) == 12
    assert sets[("OBESITY", "Embeddings")].r2 > 0.7 > sets[("OBESITY", "All indices")].r2
    assert sets[("OBESITY", "ReADI")].n_train + sets[("OBESITY", "ReADI")].n_test == files["n"] - 5
    left = tract_analysis.beyond_indices(tract_table).collect()
    assert [r["index"] for r in left] == ["ReADI"] * 2 + ["SDI"] * 2 + ["SVI"] * 2
    assert all(r.additional_var > 0.5 for r in left if r.outcome == "OBESITY")
    states = tract_analysis.by_state(tract_table)
    assert states.columns == [
        "state", "r2_readi", "r2_svi", "r2_sdi", "r2_emb", "n_outcomes", "n_tracts"
    ]
    rows = states.collect()
    assert {r.state for r in rows} >= {"AL", "CA"} and rows[0].n_tracts == 60
    deciles = tract_analysis.by_area_decile(tract_table).collect()
    assert [r.decile for r in deciles] == list(range(1, 11))
    assert deciles[0].median_aland_km2 < deciles[-1].median_aland_km2
    people = tract_table.df.select(
        "tract_fips", F.explode(F.sequence(F.lit(1), F.lit(8))).alias("i"),
        F.get("vector", F.lit(0)).alias("first"),
    ).select("tract_fips", (F.col("first") * 4 + F.col("i") > 5).alias("ill"), (F.col("i") == 1).alias("flat"))
    told = {(r.outcome, r.model): r for r in tract_analysis.individual_outcomes(
        tract_table, people, ["ill", "flat"]).collect()}
    assert len(told) == 6
    alone, both = told["ill", "ReADI alone"], told["ill", "ReADI + Embeddings"]
    assert alone.n_train + alone.n_test == 8 * (files["n"] - 5)
    assert both.auc > 0.8 > alone.auc and both.log_loss < alone.log_loss
    # an eighth says yes everywhere: only the constant is left
    assert told["flat", "Embeddings"].log_loss == pytest.approx(-(np.log(1 / 8) + 7 * np.log(7 / 8)) / 8, abs=1e-6)
    labels = tract_analysis.measure_labels(spark, files["measures"])
    assert dict(labels.collect()) == {"OBESITY": "Obesity", "SLEEP": "Sleep"}


def test_imagery(spark):
    box = registry.STATE_BOXES["RI"]
    h, w = 20, 24
    rng = np.random.default_rng(0)
    scenes = spark.createDataFrame(
        [(f"s{m}", f"2022-{m:02d}-10 15:00:00", 5.0 if m != 7 else 95.0, *box) for m in range(1, 13)],
        "scene_id string, ts string, cloud_cover double, west double, south double, east double, north double",
    ).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    truth = rng.random((len(registry.ANNUAL_BANDS), h, w)) * 1000
    rows = [
        (f"s{m}", r, c, b, float(truth[i, r, c] + (m == 7) * 9999), 9 if m == 2 else 4)
        for m in (2, 4, 6, 7, 9, 10) for i, b in enumerate(registry.ANNUAL_BANDS)
        for r in range(h) for c in range(w)
    ]
    pixels = spark.createDataFrame(
        rows, "scene_id string, row int, col int, band string, value double, scl int"
    ).join(scenes.select("scene_id", "ts"), "scene_id")
    found = imagery.composites(scenes, pixels, box, 2022)
    annual = {(r.row, r.col, r.band): r.value for r in found["annual"].collect()}
    assert annual[(3, 4, "green")] == pytest.approx(truth[1, 3, 4])
    cells = imagery.vector_map(found, h, w, chip=8, patch=4)
    assert cells.count() == 5 * 6

    def located():
        def encode(chips, places):
            pair = places[["lat", "lon"]].to_numpy()
            return np.repeat(pair, 4, axis=0).reshape(len(chips), 2, 2, 2)

        return encode

    place = {"a": 10, "c": 500_000, "e": -10, "f": 4_650_000, "zone": 19}
    where = imagery.vector_map(found, h, w, load=located, chip=8, patch=4, place=place)
    lat, lon = {(r.row, r.col): r.vector for r in where.collect()}[(0, 0)]
    assert lat == pytest.approx(42.0017, abs=1e-3) and lon == pytest.approx(-69 + 40 / 82_900, abs=1e-5)
    plain = imagery.vector_map(found, h, w, chip=8, patch=4, place=place)
    assert {tuple(r) for r in plain.select("row", "col").collect()} == {
        tuple(r) for r in cells.select("row", "col").collect()
    }
    reduced, fitted = imagery.reduce_map(cells, dims=3)
    assert len(fitted.ratios) == 3
    ring = [{"x": 0.0, "y": 0.0}, {"x": 120.0, "y": 0.0}, {"x": 120.0, "y": 200.0}, {"x": 0.0, "y": 200.0}]
    areas = spark.createDataFrame([("44001", [ring])], "GEOID string, rings array<array<struct<x:double,y:double>>>")
    sizes = spark.createDataFrame([("44001", 1.0, 0.0)], "GEOID string, ALAND double, AWATER double")
    out = imagery.area_table(
        reduced, areas, {"a": 10, "c": 0, "e": -10, "f": 200}, 4, 3, "OE", 2022, sizes
    )
    r = out.first()
    assert out.count() == 1 and r.year == 2022 and r.ALAND == 1.0
    left = [x.vector for x in reduced.where("col < 3").collect()]
    assert r.OE00_MEAN == pytest.approx(np.mean([v[0] for v in left]))
    assert r.OE02_STD == pytest.approx(np.std([v[2] for v in left]))
    seasonal = imagery.composites(scenes, pixels, box, 2022, seasonal=True)
    assert list(seasonal) == ["spring", "summer", "fall"]
    stacked = imagery.vector_map(seasonal, h, w, seasonal=True, chip=8, patch=4)
    got = {(r.row, r.col): r.vector for r in stacked.collect()}
    mean, std = registry.BAND_STATS["blue"]
    assert got[(0, 0)][0] == pytest.approx((truth[0, :4, :4].mean() - mean) / std, rel=1e-4)
    assert len(got[(0, 0)]) == 18


def test_panel(spark, tmp_path):
    rng = np.random.default_rng(9)
    rows = []
    for s in STATES:
        for t in range(25):
            for g in range(2):
                for y in (2021, 2022):
                    v = rng.normal(size=64)
                    if t == 24 and y == 2021:
                        continue
                    rows.append((f"{s}001{t:06d}{g}", y, *map(float, v), 1.0 + g))
    rows.append(("990010000001", 2022, *[0.5] * 64, 1.0))
    rows.append(("010010000009", 2022, *[float("nan")] + [0.5] * 63, 1.0))
    df = spark.createDataFrame(rows, schemas.BLOCK_GROUP_EMBEDDINGS)
    df.write.parquet(str(tmp_path / "seg1"))
    groups = panel.block_groups(read_parquet(spark, str(tmp_path / "seg*")))
    assert groups.count() == len(rows) - 1
    paths = panel.sampled_trajectories(groups).collect()
    assert len(paths) == 40 and {r.page for r in paths} == {0, 1, 2, 3}
    tracts = panel.tracts(groups, 2022)
    assert tracts.where("census_division = 'Unknown'").count() == 1
    vectors = {r.census_tract: r.vector for r in tracts.collect()}
    index = panel.index_table(spark.createDataFrame(
        [(str(int(g)), "X", str(50 + 10 * v[0]) if i % 20 else "GQ", "1", 1.0, 1.0)
         for i, (g, v) in enumerate(sorted(vectors.items()))], schemas.INDEX_FILE))
    bars, shapes = panel.index_shapes(index)
    assert bars.agg(F.sum("n")).first()[0] == index.count()
    assert "Pacific" in {r.census_division for r in shapes.collect()}
    assert panel.index_from_vectors(groups, index).first().n_test > 40
    health = spark.createDataFrame(
        [(y, str(int(g)), m, m, "CrdPrv", float(v[0] * k + y)) for g, v in vectors.items()
         for k, m in enumerate(["A", "B", "C", "D"]) for y in (2022, 2023)], schemas.MEASURES)
    assert panel.measure_shapes(health).count() == 4
    ranked = panel.measures_from_vectors(groups, index, health)
    # measure A is constant and is left out
    assert {r.measure for r in ranked.collect()} == {"B", "C", "D"}
    assert all(r.r2_readi > 0.99 for r in ranked.collect())
    ends = panel.best_and_worst_measures(ranked, 1).collect()
    assert len(ends) == 2 and {r.end for r in ends} == {"best", "worst"}
    assert read_csv  # files of the other flow use the same reader
