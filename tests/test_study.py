"""The whole study on small indicator files."""

import json
import subprocess
import sys

import numpy as np
import pytest

from conftest import ROOT
from panelweave.plans import study
from panelweave.sources.indicators import INDICATOR_CODES

YEARS = list(range(2010, 2017))
COUNTRIES = [f"Country {i}" for i in range(30)]


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    """Five indicator files: 30 countries, a group, an unmapped name, some empty cells."""
    folder = tmp_path_factory.mktemp("indicators")
    rng = np.random.default_rng(2)
    names = [*COUNTRIES, "World", "Nowhere"]
    paths = []
    for short, code in INDICATOR_CODES.items():
        lines = ['"Data Source","Tables",', "", '"Last Updated Date","2018-08-28",', ""]
        cells = ["Country Name", "Country Code", "Indicator Name", "Indicator Code", *map(str, YEARS)]
        lines.append(",".join(f'"{c}"' for c in cells) + ",")
        order = rng.permutation(len(names))  # files need not agree on the order
        for i in order:
            values = [f'"{float(10 + i * 3 + y % 5 + rng.uniform())}"' for y in YEARS]
            if names[i] == "Country 7" and short == "GDP":
                values[YEARS.index(2014)] = ""
            if names[i] == "Country 8" and short == "landForest":
                values[YEARS.index(2013)] = '".."'
            head = [names[i], f"C{i:02d}", short, code]
            lines.append(",".join([f'"{h}"' for h in head] + values) + ",")
        path = folder / f"{short}.csv"
        path.write_text("\n".join(lines) + "\n", encoding="utf-8-sig")
        paths.append(str(path))
    types = folder / "types.txt"
    types.write_text(json.dumps({**{c: "Country" for c in COUNTRIES}, "World": "Group"}, indent=0))
    return paths, str(types)


@pytest.fixture(scope="module")
def results(spark, files):
    return study.run_study(
        spark, *files, file_years=YEARS,
        tree_grid={"maxDepth": [3], "maxBins": [32], "minInstancesPerNode": [1]},
        boosted_grid={"maxDepth": [2], "maxIter": [3]},
    )


def test_panels_are_complete_and_keyed(spark, files):
    both = study.read_panels(spark, *files, file_years=YEARS)
    rows = both.collect()
    assert len(rows) == 64 and len({(r["entity"], r["year"]) for r in rows}) == 64
    types = {r["Country"]: r["CountryType"] for r in rows}
    assert types["World"] == "Group" and types["Nowhere"] is None and types["Country 1"] == "Country"
    cell = {(r["Country"], r["year"]): r for r in rows}
    assert cell["Country 7", 2014]["GDP"] is None and cell["Country 8", 2013]["landForest"] is None


def test_residual_table(results):
    rows = results.residuals.collect()
    names = {r["Country"] for r in rows}
    assert names == set(COUNTRIES) - {"Country 7"}
    columns = {"features", "atmosphereCO2", "LR_Res", "DT_Res", "GBT_Res", "LR_MAPE", "DT_MAPE", "GBT_MAPE"}
    assert columns <= set(results.residuals.columns)
    predictions = {r["entity"]: r for r in results.predictions.collect()}
    for r in rows:
        for m in ("LR", "DT", "GBT"):
            p = predictions[r["entity"]][f"{m}_prediction"]
            assert r[f"{m}_Res"] == pytest.approx(p - r["atmosphereCO2"])
            assert r[f"{m}_MAPE"] == pytest.approx(r[f"{m}_Res"] / r["atmosphereCO2"])


def test_trained_on_the_train_year_only(results):
    assert results.models["LR"].stages[-1].summary.numInstances == 29  # Country 8 has no 2013 value


def test_scores_and_sweeps(results):
    scores = {r["model"]: r for r in results.scores.collect()}
    assert set(scores) == {"LR", "DT", "GBT"} and scores["LR"]["n"] == 29
    assert results.tree_sweep.collect()[0]["rmse"] == pytest.approx(scores["DT"]["rmse"])
    assert results.boosted_sweep.collect()[0]["rmse"] == pytest.approx(scores["GBT"]["rmse"])
    params = {(r["model"], r["param"]): r["value"] for r in results.parameters.collect()}
    assert params["GBT", "maxIter"] == "3" and params["DT", "maxDepth"] == "3"
    assert params["DT_default", "maxDepth"] == "5" and params["DT_default", "maxBins"] == "32"


def test_default_tree_has_its_own_row(results):
    rows = results.tree_sweep.collect()
    assert [(r["maxDepth"], r["best"], r["default"]) for r in rows] == [(3, True, False), (5, False, True)]
    assert rows[1]["rmse"] > 0


def test_chart_tables(results):
    chart = results.residual_chart.collect()
    assert len(chart) == 29 * 3
    assert {r["series"] for r in chart} == {"LR_test_Residue", "DT_test_Residue", "GBT_test_Residue"}
    assert {r["position"] for r in chart} == set(range(29))
    assert {r["series"] for r in results.relative_error_chart.collect()} == {"DT_test_MAPE", "GBT_test_MAPE"}


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_results_are_written(spark, results, tmp_path, fmt):
    folder = str(tmp_path / fmt)
    study.write_results(results, folder, fmt)
    for name, table in results.tables().items():
        back = spark.read.option("header", True).format(fmt).load(f"{folder}/{name}")
        assert back.count() == table.count()


def test_separate_validation_slice(spark, files):
    both = study.panel.setup_panel(study.read_panels(spark, *files, file_years=YEARS), column="CountryType")
    train, test = study.panel.holdout_split(both, 2013, 2014)
    grid = {"maxDepth": [1, 4]}
    fitted, tree, _ = study.fit_models(
        train, test, study.LABEL, study.PREDICTORS, grid, {"maxIter": [1]}, validation=train
    )
    scores = {r["maxDepth"]: r["rmse"] for r in tree.collect()}
    assert scores[4] < scores[1]  # scored on the slice given, here the train rows
    assert fitted["DT"].stages[-1].getOrDefault("maxDepth") == 4


def test_command_line(files, tmp_path):
    paths, types = files
    out = str(tmp_path / "out")
    command = [sys.executable, "-m", "panelweave", *paths, "--entity-types", types, "--out", out,
               "--file-years", "2010", "2016", "--format", "csv"]
    done = subprocess.run(command, cwd=ROOT, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert (tmp_path / "out" / "scores" / "_SUCCESS").exists()
