"""Hashed word n-gram features of whole texts, and follow-the-regularised-leader fits.

Features of a text, each present once: its words, its pairs of neighbouring words,
and the outlines of its words (see ``wordkeys``) together with the power of two of
their share of the text. Each is hashed into ``2**BITS`` places. NULL and empty texts
have the one feature of an empty text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.functions.expressions import named
from panelweave.llm.wordkeys import mix, pair, word_keys
from panelweave.llm.workers import bounded, ship

BITS = 18
_PAIR, _SAME = np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25)


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``(places, ends)``: text ``i`` has the features ``places[ends[i]:ends[i + 1]]``."""
    return features_and_sizes(column)[:2]


def features_and_sizes(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As :func:`features`, and the number of words of each text."""
    words, ends, outlines = word_keys(column, lower=False, shapes=True)
    n = len(ends) - 1
    doc = np.repeat(np.arange(n), np.diff(ends))
    inside = doc[1:] == doc[:-1]
    pairs = pair(words[:-1], words[1:])[inside] ^ _PAIR
    # A word that repeats the one before it is an outline of its own.
    kinds = outlines.copy()
    kinds[1:][inside & (words[1:] == words[:-1])] = _SAME
    order = np.lexsort((kinds, doc))
    kind, of = kinds[order], doc[order]
    new = np.ones(len(kind), bool)
    new[1:] = (kind[1:] != kind[:-1]) | (of[1:] != of[:-1])
    first = np.flatnonzero(new)
    counts = np.diff(np.append(first, len(kind)))
    share = np.log2(np.diff(ends)[of[first]] / counts) if len(first) else np.zeros(0)
    shaped = mix(kind[first] + share.astype(np.uint64) + np.uint64(1))
    empty = np.flatnonzero(np.diff(ends) == 0)
    keys = np.concatenate((words, pairs, shaped, np.zeros(len(empty), np.uint64)))
    rows = np.concatenate((doc, doc[1:][inside], of[first], empty))
    hashed = mix(keys) >> np.uint64(64 - BITS)
    # Distinct by sorting, which is far faster here than numpy's own hashing of integers.
    cells = np.sort((rows.astype(np.uint64) << np.uint64(BITS)) | hashed)
    cells = cells[np.append(True, cells[1:] != cells[:-1])] if len(cells) else cells
    places = (cells & np.uint64((1 << BITS) - 1)).astype(np.int32)
    starts = np.searchsorted(cells, np.arange(n + 1, dtype=np.uint64) << np.uint64(BITS))
    return places, starts, np.diff(ends)


class Leader:
    """Logistic regression on present features by follow-the-regularised-leader.

    Steps adapt to each coordinate; the L1 part keeps features at exactly zero until
    enough evidence speaks for them. The last weight is the bias, not regularised.
    """

    def __init__(self, alpha: float = 0.1, beta: float = 1.0, l1: float = 1.0, l2: float = 1.0):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z = np.zeros((1 << BITS) + 1)
        self.n = np.zeros((1 << BITS) + 1)

    def weights(self, places: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[places], self.n[places]
        l1 = np.full(len(z), self.l1)
        bias = np.arange(len(self.z))[places] == 1 << BITS
        l1[bias] = 0.0
        shrunk = np.sign(z) * np.maximum(np.abs(z) - l1, 0.0)
        return -shrunk / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)

    def learn(self, places: np.ndarray, label: int) -> None:
        places = np.append(places, 1 << BITS)
        z, n = self.z[places], self.n[places]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - self.l1, 0.0)
        shrunk[-1] = z[-1]
        weight = -shrunk / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        gradient = 1.0 / (1.0 + np.exp(-np.clip(weight.sum(), -35, 35))) - label
        grown = n + gradient**2
        self.z[places] = z + gradient - (np.sqrt(grown) - np.sqrt(n)) / self.alpha * weight
        self.n[places] = grown


def dot(weights: np.ndarray, places: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sum of the weights of each text's features, plus the bias."""
    if not len(places):
        return np.full(len(ends) - 1, weights[-1])
    return np.add.reduceat(weights[places], ends[:-1]) + weights[-1]


def logistic(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


def sample_labels(labels: DataFrame, key: str, names: list[str], most: int) -> DataFrame:
    """``(key, *names)``: one row per key, at most ``most``, the first by hash of the key.

    Keys whose rows disagree, and rows with a NULL, are left out.
    """
    agreed = labels.where(named(key).isNotNull()).groupBy(named(key).alias("_label_key")).agg(
        *[F.min(named(name)).alias(name) for name in names],
        *[(F.min(named(name)) == F.max(named(name))).alias(f"_agreed_{name}") for name in names],
    )
    for name in names:
        agreed = agreed.where(named(f"_agreed_{name}"))
    return (
        agreed.orderBy(F.xxhash64("_label_key"), "_label_key")
        .limit(most)
        .select("_label_key", *[named(name) for name in names])
    )


def fit_leaders(
    docs: DataFrame,
    labels: DataFrame,
    key: str,
    text: str,
    names: list[str],
    shards: int = 4,
    epochs: int = 3,
    **settings: float,
) -> dict[str, np.ndarray]:
    """Weights per 0/1 label column, the mean of shards that learn side by side.

    ``labels`` comes from :func:`sample_labels`, so its size is bounded and it is
    broadcast; only the texts it names are turned into features, one a key (the least)
    where a key has several. Without examples all weights are 0.
    """
    ship(docs.sparkSession)
    # Label columns go by plain names inside, whatever they are called.
    marks = [f"label_{number}" for number in range(len(names))]
    texts = docs.select(named(key).alias("_key"), named(text).alias("_text"))
    chosen = (
        texts.join(F.broadcast(labels), F.col("_key") == F.col("_label_key"))
        .groupBy("_key")
        .agg(F.min("_text").alias("_text"), *[F.first(named(name)).alias(inner) for name, inner in zip(names, marks)])
    )

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "_text", 2 << 20):
            places, ends = features(batch.column("_text"))
            yield pa.RecordBatch.from_pydict(
                {
                    "shard": batch.column("shard"),
                    "dice": batch.column("dice"),
                    "places": pa.array(
                        [places[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:])], pa.binary()
                    ),
                    **{name: batch.column(name) for name in marks},
                }
            )

    def learn(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["dice", "places"])
        examples = [np.frombuffer(one, np.int32) for one in rows["places"]]
        out = []
        for number, name in enumerate(marks):
            leader = Leader(**settings)
            for _ in range(epochs):
                for places, label in zip(examples, rows[name]):
                    leader.learn(places, int(label))
            weights = leader.weights()
            own = np.flatnonzero(weights)
            out.append(pd.DataFrame({"name": number, "place": own, "weight": weights[own]}))
        return pd.concat(out)

    dice = F.xxhash64("_key", F.lit(5))
    wanted = ", ".join(f"{name} int" for name in marks)
    learnt = (
        chosen.select(
            F.pmod(F.shiftright(dice, 20), F.lit(shards)).cast("int").alias("shard"),
            dice.alias("dice"),
            "_text",
            *[F.col(name).cast("int").alias(name) for name in marks],
        )
        .mapInArrow(extract, f"shard int, dice long, places binary, {wanted}")
        # Each shard has a task of its own; hashed shard numbers could meet.
        .repartitionById(shards, "shard")
        .groupBy("shard")
        .applyInPandas(learn, "name int, place int, weight double")
        .groupBy("name", "place")
        .agg((F.sum("weight") / shards).alias("weight"))
        .toArrow()
    )
    fitted = {name: np.zeros((1 << BITS) + 1) for name in names}
    which, place = learnt["name"].to_numpy(), learnt["place"].to_numpy()
    for number, name in enumerate(names):
        fitted[name][place[which == number]] = learnt["weight"].to_numpy()[which == number]
    return fitted
