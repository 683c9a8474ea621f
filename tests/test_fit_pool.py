"""Fits that run side by side stop together."""

import threading
import time

import pytest
from pyspark.sql import functions as F

from panelweave.operators import models, search
from panelweave.operators.fit_pool import FitPool
from panelweave.plans import study


def running(spark):
    return list(spark.sparkContext.statusTracker().getActiveJobsIds())


def slow_job(spark, seconds=30):
    """A job that would run for ``seconds``."""

    def wait(batches):
        time.sleep(seconds)
        yield from batches

    return spark.range(8, numPartitions=8).mapInArrow(wait, "id long").count()


def test_one_failure_cancels_the_jobs_of_the_others(spark):
    started = threading.Event()

    def work(task):
        if task == "fails":
            started.wait(20)
            time.sleep(1)
            raise RuntimeError("this point cannot be fitted")
        started.set()
        return slow_job(spark)

    begun = time.perf_counter()
    with pytest.raises(RuntimeError, match="cannot be fitted"):
        with FitPool(spark, 3) as pool:
            list(pool.run(work, ["slow", "fails", "slow", "waiting", "waiting"]))
    assert time.perf_counter() - begun < 20
    assert running(spark) == []
    assert not [t for t in threading.enumerate() if t.name.startswith("panelweave-fits")]


def test_jobs_of_others_run_on(spark):
    """Only jobs of the pool are cancelled."""
    done = []
    other = threading.Thread(target=lambda: done.append(slow_job(spark, 4)))
    other.start()
    time.sleep(1)
    with pytest.raises(ZeroDivisionError):
        with FitPool(spark, 2) as pool:
            list(pool.run(lambda task: 1 // task, [0, 0]))
    other.join()
    assert done == [8]


def test_leaving_early_stops_the_pool(spark):
    with FitPool(spark, 2) as pool:
        results = pool.run(lambda n: n if n == 0 else slow_job(spark), [0, 1, 2])
        assert next(results) == 0
        results.close()
    assert running(spark) == []


def rows(spark, n=200):
    return spark.range(n).select(
        F.col("id").cast("double").alias("x"), (F.col("id") % 7).cast("double").alias("z"), (F.col("id") * 2.0).alias("y")
    )


def test_a_failing_point_ends_a_sweep(spark):
    table = rows(spark).cache()
    plan = models.decision_tree(["x", "z"], "y")
    points = [{"maxDepth": 3}, {"maxDepth": 31}, {"maxDepth": 5}]
    with pytest.raises(Exception, match="[Dd]epth"):
        search.sweep(plan, table, table, points)
    assert running(spark) == []
    with pytest.raises(Exception, match="[Dd]epth"):
        search.cross_validate(plan, search.kfold_hash(table, "x"), points)
    assert running(spark) == []
    table.unpersist()


def test_the_study_names_the_fit_that_failed(spark):
    table = rows(spark).withColumnRenamed("y", study.LABEL).cache()
    with pytest.raises(Exception, match="[Dd]epth"):
        study.fit_models(table, table, study.LABEL, ["x", "z"], tree_grid={"maxDepth": [31]})
    assert running(spark) == []
    fitted, trees, boosted = study.fit_models(table, table, study.LABEL, ["x", "z"], parallelism=1)
    assert set(fitted) == {"LR", "DT", "GBT"} and trees.count() == boosted.count() == 1
    table.unpersist()


def test_equal_scores_are_ties(spark):
    assert search._rank(0.1 + 0.2, "rmse") == search._rank(0.3, "rmse")
    assert search._rank(0.3000001, "rmse") > search._rank(0.3, "rmse")
