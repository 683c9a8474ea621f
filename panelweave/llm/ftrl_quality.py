"""Text quality from hashed word n-grams, a logistic regression scored as a sparse dot product.

It learns by follow-the-regularised-leader updates on at most ``MAX_TRAIN_ROWS``
labelled rows (a documented bound of the fit alone; every row is scored). Labels,
ids, language and source are never features. NULL and empty texts have the score of
an empty text; repeated rows score alike; without labels every score is 0.5. Extra
columns are kept, ``score`` and ``predicted`` replace columns of that name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelweave.llm.hashed_features import dot, features, fit_leaders, logistic, sample_labels
from panelweave.llm.workers import bounded, extended, ship

MAX_TRAIN_ROWS = 20_000
KEEP = 0.7


def remainder(id_col: Column, parts: int = 4) -> Column:
    """crc32 of the id as text, modulo ``parts``; a NULL id counts as the empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % parts


def fit_quality(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "quality",
    id_col: str = "doc_id",
    text: str = "text",
    max_rows: int = MAX_TRAIN_ROWS,
) -> np.ndarray:
    """Weights of the hashed features, the bias last."""
    chosen = sample_labels(labels, id_col, [label], max_rows)
    return fit_leaders(docs, chosen, id_col, text, [label])[label]


def score_quality(
    docs: DataFrame, weights: np.ndarray, text: str = "text", keep: float = KEEP
) -> DataFrame:
    """Every row with ``score`` in 0..1 and ``predicted``, 1 from ``keep`` up. No shuffle."""
    ship(docs.sparkSession)
    kept = [name for name in docs.columns if name not in ("score", "predicted")]
    rows = docs.select(*[F.col(f"`{name}`") for name in kept])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "text", 2 << 20):
            places, ends = features(batch.column("text"))
            scores = logistic(dot(weights, places, ends))
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns,
                    pa.array(scores),
                    pa.array((scores >= keep).astype(np.int32)),
                ],
                [*batch.schema.names, "score", "predicted"],
            )

    return extended(rows, score, text, "score double, predicted int")
