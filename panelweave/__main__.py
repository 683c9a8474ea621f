"""Run the study from indicator files: ``python -m panelweave --help``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from panelweave.operators import search
from panelweave.plans import study
from panelweave.sources.indicators import FIRST_YEAR, LAST_YEAR


def main() -> None:
    parser = argparse.ArgumentParser(prog="panelweave", description=__doc__)
    parser.add_argument("files", nargs="+", help="indicator CSV files (paths or globs)")
    parser.add_argument("--entity-types", required=True, help="JSON object {entity: type}")
    parser.add_argument("--out", required=True, help="folder for the result tables")
    parser.add_argument("--format", choices=("parquet", "csv"), default="parquet")
    parser.add_argument("--train-year", type=int, default=study.TRAIN_YEAR)
    parser.add_argument("--test-year", type=int, default=study.TEST_YEAR)
    parser.add_argument("--file-years", type=int, nargs=2, default=(FIRST_YEAR, LAST_YEAR))
    parser.add_argument("--full-grids", action="store_true", help="sweep the full grids")
    options = parser.parse_args()

    spark = SparkSession.builder.appName("panelweave").getOrCreate()
    first, last = options.file_years
    results = study.run_study(
        spark,
        options.files,
        options.entity_types,
        train_year=options.train_year,
        test_year=options.test_year,
        file_years=range(first, last + 1),
        tree_grid=search.TREE_GRID_FULL if options.full_grids else search.TREE_GRID,
        boosted_grid=search.BOOSTED_GRID_FULL if options.full_grids else search.BOOSTED_GRID,
    )
    study.write_results(results, options.out, options.format)
    spark.stop()


if __name__ == "__main__":
    main()
