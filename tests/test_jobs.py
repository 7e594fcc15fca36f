"""Jobs end to end, and the readers of files."""

import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lumenpeak.functions.constants import LINES
from lumenpeak.plans import jobs
from lumenpeak.plans.params import JobParams
from lumenpeak.sources import readers as R
from lumenpeak.sources import writers as W


def spectra(spark, n=60, seed=1):
    """Quasars with broad lines at their redshift, and featureless stars."""
    rng = np.random.default_rng(seed)
    wave = np.arange(3600.0, 9600.0, 10.0)
    rows = []
    for i in range(n):
        z = float(rng.uniform(0.4, 3.5))
        flux = 2.0 + rng.normal(0, 0.05, len(wave))
        if i % 3:
            for line in LINES:
                if line[0] in ("lya", "civ", "ciii", "mgii"):
                    center = line[1] * (1 + z)
                    flux += 4 * np.exp(-0.5 * ((wave - center) / 60) ** 2)
        rows.append((i, 3 if i % 3 else 1, 3, z, float(17 + i % 6), wave.tolist(), flux.tolist(),
                     [400.0] * len(wave)))
    rows.append((n, 3, 3, 1.0, 18.0, [], [], []))
    return spark.createDataFrame(rows, "SPECID BIGINT, CLASS_PERSON INT, Z_CONF_PERSON INT, "
                                       "Z_TRUE DOUBLE, R_MAG DOUBLE, wave ARRAY<DOUBLE>, "
                                       "flux ARRAY<DOUBLE>, ivar ARRAY<DOUBLE>")


OPTIONS = {"peak_finder_options": {"width": 4.0, "min_significance": 8.0},
           "num_trees": 10, "max_depth": 6}


def test_train_then_test_then_merge(spark, tmp_path):
    training = jobs.run(JobParams(mode="training", **OPTIONS), str(tmp_path / "a"), spectra(spark))
    table = training.candidates
    assert table.columns[:5] == ["SPECID", "CLASS_PERSON", "Z_CONF_PERSON", "Z_TRUE", "R_MAG"]
    assert {"LYA_RATIO", "HA_RATIO2", "Z_TRY", "ASSUMED_LINE", "IS_LINE"} <= set(table.columns)
    assert table.where("SPECID = 60").count() == 0  # unusable spectrum left out
    assert table.where("ASSUMED_LINE = 'none' AND CLASS_PERSON = 1").count() > 0

    model = jobs.load_model(spark, str(tmp_path / "a" / "model"))
    assert model.params.num_trees == 10
    fresh = spectra(spark, 40, seed=2)
    truth = fresh.where("CLASS_PERSON = 3 AND size(wave) > 0")
    result = jobs.run(JobParams(mode="test"), str(tmp_path / "b"), fresh, model=model, truth=truth)
    best = result.candidates.where("NOT DUPLICATED")
    assert best.count() == 40
    report = {r["step"]: r for r in result.report.collect()}
    assert len(report) == 19 and report[0]["completeness"] > 0.9
    sweep = result.sweep.orderBy("prob").collect()
    assert [r["num_candidates"] for r in sweep] == sorted(
        (r["num_candidates"] for r in sweep), reverse=True)
    assert {r["case"] for r in result.optimal.collect()} == {"z<2.1", "z>=2.1", "all z"}
    assert result.finder.agg(F.max("completeness")).first()[0] > 0.9
    counts = [report[i]["num_candidates"] for i in range(1, 19)]
    assert counts == sorted(counts)
    quasars = best.where("CLASS_PERSON = 3 AND PROB > 0.5")
    assert quasars.where("IS_CORRECT").count() > 0.8 * quasars.count() > 0

    operation = jobs.run(JobParams(mode="operation"), str(tmp_path / "c"),
                         fresh.drop("CLASS_PERSON", "Z_TRUE"), model=model)
    assert "Z_TRUE" not in operation.candidates.columns
    assert operation.candidates.count() == result.candidates.count()
    found = W.catalogue(operation.candidates, 0.5)
    assert found.count() == found.select("SPECID").distinct().count() > 0

    paths = [str(tmp_path / p / "classified") for p in ("b", "c")]
    merged = jobs.run(JobParams(mode="merge"), str(tmp_path / "d"),
                      candidates=jobs.merge_candidates(spark, paths))
    assert merged.candidates.count() == 2 * result.candidates.count()


def test_refused_runs(spark, tmp_path):
    bare = spectra(spark, 3).drop("Z_TRUE")
    with pytest.raises(ValueError, match="Z_TRUE"):
        jobs.find_candidates(bare, JobParams(mode="training"))
    with pytest.raises(ValueError, match="merge mode"):
        jobs.find_candidates(bare, JobParams(mode="merge"))
    with pytest.raises(ValueError, match="needs a trained model"):
        jobs.run(JobParams(mode="operation", **OPTIONS), str(tmp_path), bare)
    for bad in ({"mode": "x"}, {"num_pixels": 0}, {"prob_cut": -1}, {"z_precision": 0},
                {"try_lines": ("q",)}, {"peak_finder": "x"},
                {"forest_options": {"high": {"n": 1}}}, {"forest_options": {"up": {}}}):
        with pytest.raises(ValueError):
            JobParams(**bad)


def test_pixels_as_metrics(spark):
    params = JobParams(mode="candidates", pixels_as_metrics=True, num_pixels=3,
                       peak_finder_options=OPTIONS["peak_finder_options"])
    table = jobs.find_candidates(spectra(spark, 6), params)
    assert "FLUX_-3" in table.columns and "IVAR_2" in table.columns
    row = table.where("ASSUMED_LINE = 'none'").first()
    assert row["FLUX_0"] is None


def test_parameters_round_trip():
    params = JobParams(extra_features=("R_MAG",), split=False,
                       forest_options={"all": {"num_trees": 3}}, **OPTIONS)
    assert JobParams.from_json(params.to_json()) == params
    adopted = JobParams(mode="test").adopting(params)
    assert adopted.mode == "test" and adopted.extra_features == ("R_MAG",)


def test_files(spark, tmp_path):
    def array(values):
        return {"np.ndarray": {"data": values, "dtype": "float64"}}

    document = {"spectra_list": [
        {"flux": array([1.0, 2.0]), "ivar": array([1.0, 1.0]), "wave": array([10.0, 11.0]),
         "metadata": {"specid": s, "Z_true": 0.5 * s}} for s in (1, 2)]}
    for name in ("a.json", "b.json"):
        (tmp_path / name).write_text(json.dumps(document, indent=0))
    df = R.read_spectra_json(spark, [str(tmp_path / n) for n in ("a.json", "b.json")],
                             "specid BIGINT, Z_true DOUBLE")
    assert df.columns[:2] == ["SPECID", "Z_TRUE"] and df.count() == 4
    assert df.where("SPECID = 2").first()["flux"] == [1.0, 2.0]
    assert R.read_spectra_json(spark, None, "specid BIGINT") is None

    frame = {"RA": {"5": 1.5, "9": 2.5}, "CLASS_PERSON": {"5": 3, "9": 30}}
    (tmp_path / "q.json").write_text(json.dumps({"pd.DataFrame": json.dumps(frame)}))
    rows = R.read_catalogue_json(spark, str(tmp_path / "q.json"), "RA DOUBLE, CLASS_PERSON INT")
    assert sorted(map(tuple, rows.collect())) == [(1.5, 3), (2.5, 30)]

    names = ("WAVE", "START", "END", "BLUE_START", "BLUE_END", "RED_START", "RED_END")
    columns = {n: {line[0]: line[i + 1] for line in LINES} for i, n in enumerate(names)}
    (tmp_path / "lines.json").write_text(json.dumps(columns))
    assert tuple(R.read_lines(spark, str(tmp_path / "lines.json"))) == LINES

    (tmp_path / "sky.txt").write_text("3500.260\n 3501.066\n\nx\n")
    assert [r[0] for r in R.read_sky_lines(spark, str(tmp_path / "sky.txt")).collect()] == [
        3500.26, 3501.066]
    (tmp_path / "mag.txt").write_text("TARGID  GMAG RMAG\n1  20.5   19.0\n 2\t21.5  20.0\n")
    mags = R.read_magnitudes(spark, str(tmp_path / "mag.txt"), ["TARGID", "GMAG", "RMAG"],
                             {"TARGID": "bigint"})
    assert sorted(map(tuple, mags.collect())) == [(1, 20.5, 19.0), (2, 21.5, 20.0)]

    table = spark.createDataFrame(pd.DataFrame({"a": [1], "b": [float("nan")]}))
    W.write_candidates(table, str(tmp_path / "t"))
    assert tuple(R.read_candidates(spark, str(tmp_path / "t")).first()) == (1, None)
    W.write_spectra(df.withColumn("PLATE", F.col("SPECID")), str(tmp_path / "plates"), "PLATE")
    assert sorted(p.name for p in (tmp_path / "plates").glob("PLATE=*")) == ["PLATE=1", "PLATE=2"]


def test_merge_lists_what_each_file_gave(spark, tmp_path):
    good = spark.createDataFrame([(i, float("nan") if i == 3 else 1.0) for i in range(40)], "SPECID BIGINT, Z_TRY DOUBLE")
    for name, df in (("a", good), ("empty", good.limit(0))):
        df.coalesce(1).write.parquet(str(tmp_path / name))
    whole = next((tmp_path / "a").glob("*.parquet")).read_bytes()
    for name, content in (("cut", whole[:len(whole) // 2]), ("text", b"no footer"), ("torn", whole[:4] + b"x" * 60 + whole[64:])):
        (tmp_path / name).mkdir()
        (tmp_path / name / "part.parquet").write_bytes(content)
    paths = [str(tmp_path / n) for n in ("a", "empty", "cut", "text", "torn")]
    result = jobs.merge_files(spark, JobParams(mode="merge"), str(tmp_path / "out"), paths)
    assert result.candidates.count() == 40 and result.candidates.where("Z_TRY IS NULL").count() == 1
    states = {r["file"].split("/")[-2]: (r["state"], r["rows"], r["rows_read"]) for r in result.files.collect()}
    assert states == {"a": ("read", 40, 40), "empty": ("empty", 0, 0), "cut": ("damaged", 0, 0), "text": ("damaged", 0, 0),
                      "torn": ("damaged", 40, 0)}
    with pytest.raises(ValueError, match="no candidates can be read"):
        jobs.merge_files(spark, JobParams(mode="merge"), str(tmp_path / "out2"), [str(tmp_path / "cut")])


def test_arms_without_catalogues(spark):
    """Spectra without a varied red arm, and inactive fibres, are left out."""
    rows = [(i, arm, p, 4000.0 + 10 * p, 1.0 if i == 1 and arm == "red" else 1.0 + p % 3, 1.0, 1.0)
            for i in range(3) for arm, pixels in (("blue", range(20)), ("red", range(15, 40))) for p in pixels]
    pixels = spark.createDataFrame(rows, "SPECID BIGINT, arm STRING, pix BIGINT, wave DOUBLE, flux DOUBLE, "
                                         "ivar DOUBLE, sens DOUBLE")
    fibres = spark.createDataFrame([(0, "A"), (1, "A"), (2, "P")], "SPECID BIGINT, fib_status STRING")
    out = jobs.format_arms(pixels, fibres=fibres).collect()
    assert [r["SPECID"] for r in out] == [0] and len(out[0]["wave"]) == 38
    assert out[0]["Z_TRUE"] is out[0]["GMAG"] is out[0]["RMAG"] is None
    assert {r["SPECID"] for r in jobs.format_arms(pixels).collect()} == {0, 2}
    assert jobs.format_arms(pixels.limit(0)).count() == 0
