"""Toxicity from two class-conditional Kneser-Ney bigram models with shared backoff counts.

Each class discounts its bigram counts and backs off to its own continuation counts,
those to the continuation counts of both classes together, and those to a uniform
share, so a rare expression scores alike under both unless one class has real
evidence. All counts are of distinct preceding words, bigrams included, so a text
that was copied many times speaks once. Texts are judged by the difference of the toxic and ordinary
log-likelihoods per word: of the whole text, of its most toxic passage of
``PASSAGE`` words and of its most toxic single word. The discounts are those of
``DISCOUNTS`` that predict labelled texts best which the counts have not seen, and
the same texts turn the three differences into a probability.

At most ``MAX_ROWS`` labelled texts a class are learnt from (a documented bound of
the fit alone, the first by hash of their ids; texts under one id count as one, the
least); every row is scored, over its whole text. Words are runs between blanks and
punctuation, A-Z folded. Texts without words, NULL and empty ones, have differences
of 0. Repeated rows score alike. Where the labels hold one class only, every score
is that class's; without labels it is 0. Extra columns are kept, ``score`` and
``predicted`` replace columns of that name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.functions.expressions import named
from panelweave.functions.storage import materialize
from panelweave.llm.hashed_features import logistic
from panelweave.llm.wordkeys import pair, word_keys
from panelweave.llm.workers import bounded, extended, ship, text_bytes

MAX_ROWS = 4000
PASSAGE = 8
#: Of the words' continuation counts and of the bigrams' counts: pairs to choose from.
DISCOUNTS = tuple((words, bigrams) for words in (0.75, 3.0, 12.0) for bigrams in (3.0, 12.0, 48.0, 192.0))
TOXIC = 0.5
#: The word before the first.
OPENING = np.uint64(0x5851F42D4C957F2D)
_BLANKED = bytes(0x20 if chr(b) in ".,;:!?\"'()[]{}<>*_~`" else b for b in range(256))


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(words, the word before each, ends)`` of a batch of texts."""
    plain = pa.array([text.translate(_BLANKED) for text in text_bytes(column)], pa.large_binary())
    words, ends, _ = word_keys(plain)
    before = np.empty_like(words)
    before[1:] = words[:-1]
    before[ends[:-1][np.diff(ends) > 0]] = OPENING
    return words, before, ends


@dataclass
class Counts:
    """Counts of the fitted texts, classes (ordinary, toxic) side by side.

    words: sorted keys with the distinct words before each, by class and over both;
    contexts: sorted keys with their bigrams' total, by class; bigrams: sorted pair
    keys seen twice or more, with the key of their first word and counts by class.
    """

    words: np.ndarray
    continuation: np.ndarray
    shared: np.ndarray
    contexts: np.ndarray
    totals: np.ndarray
    bigrams: np.ndarray
    bigram_context: np.ndarray
    bigram_counts: np.ndarray


def _place(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Position in sorted keys, ``len(keys)`` where absent."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, len(keys))


class Models:
    """Both classes' models under one pair of discounts."""

    def __init__(self, counts: Counts, discounts: tuple[float, float]):
        self.counts = counts
        discount, self.discount = self.discounts = discounts
        seen = max(counts.shared.sum(), 1)
        kept = np.minimum(counts.shared, discount).sum() / seen if len(counts.words) else 1.0
        uniform = 1.0 / (len(counts.words) + 1)
        shared = np.append(np.maximum(counts.shared - discount, 0.0), 0.0) / seen + kept * uniform
        # A row per word and one for unknown words.
        self.alone = np.empty((len(counts.words) + 1, 2))
        for c in range(2):
            own = counts.continuation[:, c]
            total = max(own.sum(), 1)
            left = np.minimum(own, discount).sum() / total if own.any() else 1.0
            self.alone[:, c] = np.append(np.maximum(own - discount, 0.0), 0.0) / total + left * shared
        # What a context leaves to the backoff, after its discounted bigrams.
        self.left = np.ones((len(counts.contexts) + 1, 2))
        self.totals = np.append(np.maximum(counts.totals, 1), [[1, 1]], axis=0)
        at = _place(counts.contexts, counts.bigram_context)
        for c in range(2):
            taken = np.bincount(
                at, np.maximum(counts.bigram_counts[:, c] - self.discount, 0.0), minlength=len(self.left)
            )
            self.left[:, c] -= taken / self.totals[:, c]

    def difference(self, words: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Log of the toxic over the ordinary probability of each word after the one before."""
        counts = self.counts
        word, context = _place(counts.words, words), _place(counts.contexts, before)
        bigram = _place(counts.bigrams, pair(before, words))
        held = np.append(counts.bigram_counts, [[0, 0]], axis=0)[bigram]
        own = np.maximum(held - self.discount, 0.0) / self.totals[context]
        probability = own + self.left[context] * self.alone[word]
        return np.log(probability[:, 1]) - np.log(probability[:, 0])


def evidence(difference: np.ndarray, ends: np.ndarray, passage: int = PASSAGE) -> np.ndarray:
    """Per text: the mean difference of all words, of the top passage, of the top word.

    A text shorter than a passage counts as one, filled up with differences of 0.
    """
    n = len(ends) - 1
    out = np.zeros((n, 3))
    sizes = np.diff(ends)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    first = ends[:-1][full]
    out[full, 0] = np.add.reduceat(difference, first) / sizes[full]
    out[full, 2] = np.maximum.reduceat(difference, first)
    running = np.concatenate(([0.0], np.cumsum(difference)))
    to = np.minimum(np.arange(len(difference)) + passage, np.repeat(ends[1:], sizes))
    whole = (running[to] - running[:-1]) / passage
    # Windows cut off by the end of a text longer than a passage are part of others.
    cut = to - np.arange(len(difference)) < passage
    whole[cut & np.repeat(sizes >= passage, sizes)] = -np.inf
    short = np.repeat(sizes < passage, sizes) & (np.arange(len(difference)) != np.repeat(ends[:-1], sizes))
    whole[short] = -np.inf
    out[full, 1] = np.maximum.reduceat(whole, first)
    return out


@dataclass
class Judge:
    """Models and how their evidence becomes a probability; without models, ``share`` is it."""

    share: float
    models: Models | None = None
    center: np.ndarray | None = None
    scale: np.ndarray | None = None
    weights: np.ndarray | None = None

    def scores(self, column: pa.Array) -> np.ndarray:
        if self.models is None:
            return np.full(len(column), self.share)
        words, before, ends = tokens(column)
        found = evidence(self.models.difference(words, before), ends)
        return logistic((found - self.center) / self.scale @ self.weights[:-1] + self.weights[-1])


def chosen_labels(labels: DataFrame, key: str, label: str, most: int) -> DataFrame:
    """``(label_key, label)``: at most ``most`` keys a class, the first by hash of the key.

    Keys whose rows disagree, NULL keys and NULL labels are left out.
    """
    agreed = (
        labels.where(named(key).isNotNull())
        .groupBy(named(key).alias("label_key"))
        .agg(F.min(named(label)).cast("int").alias("label"), F.max(named(label)).alias("other"))
        .where("label = other and label in (0, 1)")
        .drop("other")
    )
    hashed = F.xxhash64("label_key")
    parts = [agreed.where(F.col("label") == c).orderBy(hashed, "label_key").limit(most) for c in (0, 1)]
    return parts[0].unionByName(parts[1])


def _runs(words: np.ndarray, before: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(the second word before each, keys of the runs of three words that end at each)``."""
    third = np.empty_like(before)
    third[1:] = before[:-1]
    third[ends[:-1][np.diff(ends) > 0]] = OPENING
    return third, pair(third, pair(before, words))


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds a key that copies of a text share, near ones too: the least of its runs' keys.

    Two texts have the same with the share of their runs that they have in common.
    """
    for batch in bounded(batches, "text", 4 << 20):
        words, before, ends = tokens(batch.column("text"))
        keys = np.zeros(batch.num_rows, np.uint64)
        full = np.flatnonzero(np.diff(ends))
        if len(full):
            keys[full] = np.minimum.reduceat(_runs(words, before, ends)[1], ends[:-1][full])
        yield pa.RecordBatch.from_arrays(
            [batch.column("label"), batch.column("text"), pa.array(keys.view(np.int64))],
            ["label", "text", "alike"],
        )


def _texts(docs: DataFrame, chosen: DataFrame, key: str, text: str) -> DataFrame:
    """``(label, tuning, text)`` of the chosen labels, one text a key, written once.

    Copies are tuning texts together or not at all: one whose copy was counted would tell
    how well the counts know it, not how they judge new texts.
    """
    # At most 2 * MAX_ROWS labels.
    joined = docs.select(named(key).alias("key"), named(text).alias("text")).join(
        F.broadcast(chosen), F.col("key") == F.col("label_key")
    )
    one = joined.groupBy("key").agg(F.first("label").alias("label"), F.min("text").alias("text"))
    told = one.select("label", "text").mapInArrow(_alike, "label int, text string, alike long")
    tuning = F.pmod(F.xxhash64("alike", F.lit(11)), F.lit(5)) == 0
    return materialize(told.select("label", tuning.alias("tuning"), "text"), "labelled")


def _count(texts: DataFrame) -> Counts:
    """Distinct runs of three words are found in tasks and by Spark, and counted by their ends.

    At most 2 * MAX_ROWS texts have them, so each table collected here is bounded.
    """

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "text", 4 << 20):
            words, before, ends = tokens(batch.column("text"))
            third, run = _runs(words, before, ends)
            label = np.repeat(batch.column("label").to_numpy(), np.diff(ends))
            run ^= label.astype(np.uint64) << np.uint64(63)
            first = np.sort(np.unique(run, return_index=True)[1])
            yield pa.RecordBatch.from_pydict(
                {
                    "u": pa.array(third[first].view(np.int64)),
                    "v": pa.array(before[first].view(np.int64)),
                    "w": pa.array(words[first].view(np.int64)),
                    "n0": pa.array((label[first] == 0).astype(np.int64)),
                    "n1": pa.array((label[first] == 1).astype(np.int64)),
                }
            )

    pairs = materialize(
        texts.select("label", "text")
        .mapInArrow(extract, "u long, v long, w long, n0 long, n1 long")
        .groupBy("u", "v", "w")
        .agg(F.max("n0").alias("n0"), F.max("n1").alias("n1"))
        .groupBy("v", "w")
        .agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")),
        "bigrams",
    )
    by_word = pairs.groupBy("w").agg(
        *[F.sum((F.col(n) > 0).cast("long")).alias(n) for n in ("n0", "n1")], F.count("w").alias("n")
    )
    by_context = pairs.groupBy("v").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))

    def held(table: DataFrame, key: str, columns: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = table.toArrow()
        keys = found[key].to_numpy().view(np.uint64)
        order = np.argsort(keys)
        values = np.stack([found[name].to_numpy() for name in columns], axis=1)
        return keys[order], values[order]

    words, spread = held(by_word, "w", ["n0", "n1", "n"])
    contexts, totals = held(by_context, "v", ["n0", "n1"])
    often = pairs.where("n0 + n1 >= 2").toArrow()
    context = often["v"].to_numpy().view(np.uint64)
    keys = pair(context, often["w"].to_numpy().view(np.uint64))
    order = np.argsort(keys)
    twice = np.stack([often[name].to_numpy() for name in ("n0", "n1")], axis=1)
    return Counts(
        words, spread[:, :2], spread[:, 2], contexts, totals, keys[order], context[order], twice[order]
    )


def _regression(found: np.ndarray, label: np.ndarray, weight: np.ndarray, l2: float = 1e-6):
    """``(center, scale, weights, loss)`` of a logistic regression by Newton steps."""
    center, scale = found.mean(axis=0), found.std(axis=0) + 1e-9
    x = np.append((found - center) / scale, np.ones((len(found), 1)), axis=1)
    weight, weights = weight / weight.sum(), np.zeros(4)
    ridge = np.diag([l2, l2, l2, 1e-9])
    for _ in range(200):
        p = logistic(x @ weights)
        slope = x.T @ (weight * (p - label)) + ridge @ weights
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge
        step = np.linalg.solve(curve, slope)
        weights = weights - step / max(1.0, np.abs(step).max())
    p = np.clip(logistic(x @ weights), 1e-12, 1 - 1e-12)
    loss = -(weight * np.where(label == 1, np.log(p), np.log(1 - p))).sum()
    return center, scale, weights, loss


def fit_judge(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "toxic",
    id_col: str = "doc_id",
    text: str = "text",
    max_rows: int = MAX_ROWS,
) -> Judge:
    """Count bigrams of four fifths of the chosen texts, tune on the others."""
    spark = docs.sparkSession
    ship(spark)
    classes = {
        row["label"]: row["n"]
        for row in labels.where(named(id_col).isNotNull())
        .select(named(label).cast("int").alias("label"))
        .where("label in (0, 1)")
        .groupBy("label")
        .agg(F.count("label").alias("n"))
        .collect()
    }
    texts = _texts(docs, chosen_labels(labels, id_col, label, max_rows), id_col, text)
    parts = {(r["tuning"], r["label"]): r["n"] for r in texts.groupBy("tuning", "label").agg(F.count("label").alias("n")).collect()}
    if any(parts.get((False, c), 0) + parts.get((True, c), 0) == 0 for c in (0, 1)):
        return Judge(float(set(classes) == {1}))
    split = all(parts.get((tuned, c), 0) for tuned in (False, True) for c in (0, 1))
    counts = _count(texts.where(~F.col("tuning")) if split else texts)
    shared = spark.sparkContext.broadcast(counts)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = [Models(shared.value, discounts) for discounts in DISCOUNTS]
        for batch in bounded(batches, "text", 4 << 20):
            words, before, ends = tokens(batch.column("text"))
            found = [evidence(one.difference(words, before), ends) for one in models]
            rows = np.concatenate(found, axis=1).tolist()
            yield pa.RecordBatch.from_pydict(
                {"label": batch.column("label"), "found": pa.array(rows, pa.list_(pa.float64()))}
            )

    tuning = texts.where("tuning") if split else texts
    measured = tuning.select("label", "text").mapInArrow(measure, "label int, found array<double>").toArrow()
    seen = measured["label"].to_numpy()
    found = np.array(measured["found"].to_pylist()).reshape(len(seen), len(DISCOUNTS), 3)
    # Each class weighs as much as it does among all labels.
    weight = np.where(
        seen == 1, classes[1] / max((seen == 1).sum(), 1), classes[0] / max((seen == 0).sum(), 1)
    )
    fits = [_regression(found[:, d], seen, weight) for d in range(len(DISCOUNTS))]
    best = min(range(len(fits)), key=lambda d: fits[d][3])
    center, scale, weights, _ = fits[best]
    return Judge(0.0, Models(counts, DISCOUNTS[best]), center, scale, weights)


def score_toxicity(docs: DataFrame, judge: Judge, text: str = "text", limit: float = TOXIC) -> DataFrame:
    """Every row with ``score`` in 0..1 and ``predicted``, 1 from ``limit`` up. No shuffle."""
    ship(docs.sparkSession)
    kept = [name for name in docs.columns if name not in ("score", "predicted")]
    shared = docs.sparkSession.sparkContext.broadcast(judge)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "text", 4 << 20):
            scores = shared.value.scores(batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(scores), pa.array((scores >= limit).astype(np.int32))],
                [*batch.schema.names, "score", "predicted"],
            )

    return extended(docs.select(*[named(name) for name in kept]), score, text, "score double, predicted int")
