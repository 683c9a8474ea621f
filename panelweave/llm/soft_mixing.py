"""Document rates that bring soft domains to target weights.

A classifier fitted on a labelled table gives every document a posterior over
domains. A document of ``n`` words with posterior ``p`` counts ``n * p[d]`` towards
domain ``d``. Rates ``r >= 0`` solve the least-squares problem

    minimise  sum over d, e of  residual[d] * W[d, e] * residual[e],
    residual = sum over documents of r * n * p  -  target

by projected gradient steps in the metric of the words, ``r <- max(0, r - p . step)``,
with ``W`` the inverse of ``sum n p p'``, under which the step length is 1. Each step
is one distributed sum of a few numbers; rates are an expression of the steps so far
and never leave the executors.

A rate is carried out as ``floor(rate + u)`` copies, ``u`` being a hash of id and
text, so the same row always has the same copies. Words are those of
``rule_cascade``; NULL and empty texts have none, do not count, and keep rate 1 plus
the classifier's view of an empty text. Domains without labelled rows get no
posterior. Without any labels all rates are 1. Extra columns are kept; names that
start with ``_mix`` are reserved.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelweave.functions.expressions import named
from panelweave.functions.storage import materialize
from panelweave.llm.hashed_features import (
    dot,
    features_and_sizes,
    fit_leaders,
    logistic,
    sample_labels,
)
from panelweave.llm.workers import bounded, extended, ship

MAX_TRAIN_ROWS = 20_000
# Domains of the labelled table, and the share of words that each should have.
DOMAINS = {
    "clean": "quality = 1 AND toxic = 0",
    "low": "quality = 0 AND toxic = 0",
    "toxic": "toxic = 1",
}
WEIGHTS = {"clean": 0.92, "low": 0.06, "toxic": 0.02}
STEPS, TOLERANCE = 40, 1e-9
# Part of all words by which a domain may miss its weight before a warning says so.
MOST_MISSED = 0.001
# Sharper than the quality fit: rates need posteriors that tell the domains apart.
FIT = {"alpha": 0.3, "l1": 1.0, "epochs": 5}


def fit_domains(
    docs: DataFrame,
    labels: DataFrame,
    domains: dict[str, str],
    id_col: str = "doc_id",
    text: str = "text",
    max_rows: int = MAX_TRAIN_ROWS,
) -> np.ndarray:
    """One row of weights per domain, one domain against the rest."""
    marked = labels.select(
        named(id_col), *[F.expr(test).cast("int").alias(name) for name, test in domains.items()]
    )
    chosen = sample_labels(marked, id_col, list(domains), max_rows)
    fitted = fit_leaders(docs, chosen, id_col, text, list(domains), **FIT)
    return np.stack([fitted[name] for name in domains])


def add_posteriors(docs: DataFrame, weights: np.ndarray, text: str = "text") -> DataFrame:
    """Rows with ``_mix_words`` and ``_mix_posterior``, an array that sums to 1."""
    ship(docs.sparkSession)
    known = np.abs(weights).sum(1) > 0

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "text", 2 << 20):
            column = batch.column("text")
            places, ends, sizes = features_and_sizes(column)
            odds = np.stack([logistic(dot(one, places, ends)) for one in weights], 1) * known
            total = odds.sum(1, keepdims=True)
            posterior = np.divide(
                odds, total, out=np.full_like(odds, 1.0 / len(weights)), where=total > 0
            )
            starts = np.arange(0, posterior.size + 1, len(weights), dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns,
                    pa.array(sizes.astype(np.int64)),
                    pa.ListArray.from_arrays(pa.array(starts), pa.array(posterior.ravel())),
                ],
                [*batch.schema.names, "_mix_words", "_mix_posterior"],
            )

    return extended(docs, judge, text, "_mix_words long, _mix_posterior array<double>")


def anchored_targets(totals: np.ndarray, weights: dict[str, float], anchor: str) -> np.ndarray:
    """Words per domain at the target weights, with ``anchor`` kept as it is."""
    names = list(weights)
    scale = totals[names.index(anchor)] / weights[anchor]
    return scale * np.array([weights[name] for name in names])


def rate_expression(posterior: Column, steps: list[np.ndarray]) -> Column:
    """The rate after the given steps, each a projection onto rates of 0 and above."""
    rate = F.lit(1.0)
    for step in steps:
        moved = rate
        for d, size in enumerate(step.tolist()):
            moved = moved - F.lit(size) * posterior[d]
        rate = F.greatest(F.lit(0.0), moved)
    return rate


def fit_rates(judged: DataFrame, targets_of) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """``(steps, reached, targets)`` for rows with ``_mix_words`` and ``_mix_posterior``.

    ``targets_of`` gets the totals by domain at rate 1.
    """
    first = judged.select(F.size("_mix_posterior").alias("n")).first()
    if first is None:
        return [], np.zeros(0), np.zeros(0)
    n = first["n"]
    words = F.col("_mix_words").cast("double")
    part = [F.col("_mix_posterior")[d] for d in range(n)]
    sums = judged.agg(
        *[F.coalesce(F.sum(words * part[d]), F.lit(0.0)) for d in range(n)],
        *[
            F.coalesce(F.sum(words * part[d] * part[e]), F.lit(0.0))
            for d in range(n)
            for e in range(n)
        ],
    ).first()
    totals = np.array(sums[:n])
    inverse = np.linalg.pinv(np.array(sums[n:]).reshape(n, n), hermitian=True)
    targets = np.asarray(targets_of(totals), float)
    steps: list[np.ndarray] = []
    reached = totals
    while len(steps) < STEPS:
        residual = reached - targets
        if np.abs(residual).max() <= TOLERANCE * max(totals.sum(), 1.0):
            break
        steps.append(inverse @ residual)
        rate = rate_expression(F.col("_mix_posterior"), steps)
        reached = np.array(
            judged.agg(
                *[F.coalesce(F.sum(rate * words * part[d]), F.lit(0.0)) for d in range(n)]
            ).first()
        )
    return steps, reached, targets


def check_reached(
    reached: dict[str, float], wanted: dict[str, float], most: float = MOST_MISSED
) -> None:
    """Warns of every domain further from the words it should have than ``most`` of all words.

    Such a domain is scarcer than its weight and is not repeated, or no rates reach its
    target: where all documents are half one domain and half another, none bring the
    two to different totals.
    """
    allowed = most * max(sum(wanted.values()), 1.0)
    missed = {
        name: f"{reached[name]:.0f} words, not {goal:.0f}"
        for name, goal in wanted.items()
        if abs(reached[name] - goal) > allowed
    }
    if missed:
        warnings.warn(f"domains miss their weights: {missed}", stacklevel=3)


def mix_rates(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    domains: dict[str, str] = DOMAINS,
    weights: dict[str, float] = WEIGHTS,
    anchor: str = "clean",
    repeat_scarce: bool = False,
) -> DataFrame:
    """Every row with ``_mix_words``, ``_mix_posterior``, ``_mix_rate``, ``_mix_copies``.

    Rows are judged once and written; the steps read only words and posteriors. A domain
    scarcer than its weight keeps all its words and is named in a warning; with
    ``repeat_scarce`` its documents are repeated to fill the weight, and with them what
    they hold of other domains.
    """
    classifier = fit_domains(docs, labels, domains, id_col, text)
    judged = materialize(add_posteriors(docs, classifier, text), "domain-posteriors")
    if np.abs(classifier).sum() == 0:
        steps: list[np.ndarray] = []
    else:
        wanted: list[np.ndarray] = []

        def targets_of(totals: np.ndarray) -> np.ndarray:
            wanted.append(anchored_targets(totals, weights, anchor))
            return wanted[0] if repeat_scarce else np.minimum(totals, wanted[0])

        steps, reached, _ = fit_rates(judged, targets_of)
        if wanted:
            check_reached(dict(zip(weights, reached)), dict(zip(weights, wanted[0])))
    dice = F.pmod(F.xxhash64(named(id_col), named(text), F.lit(23)), F.lit(1 << 30)) / float(1 << 30)
    return judged.withColumn(
        "_mix_rate", rate_expression(F.col("_mix_posterior"), steps).cast("double")
    ).withColumn("_mix_copies", F.floor(F.col("_mix_rate") + dice).cast("int"))


def mix(docs: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    """The rows repeated by their copies; columns as they are."""
    rated = mix_rates(docs, labels, **settings)
    return (
        rated.where("_mix_copies > 0")
        .withColumn("_mix_copy", F.explode(F.sequence(F.lit(1), F.col("_mix_copies"))))
        .select(*[f"`{name}`" for name in docs.columns])
    )
