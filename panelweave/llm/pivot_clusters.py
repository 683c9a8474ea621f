"""Centroid clustering of integer vectors with a pivot table of stored distances (LAESA).

Every vector's distances to a few fixed pivots are computed once and stored beside
it. In each round the centroids' distances to the same pivots give, by the triangle
inequality, a lower bound for every (vector, centroid) pair; only centroids whose
bound does not exceed the best distance so far get an exact integer distance.

Vectors with another number of components, or with a NULL, NaN or infinite one, are
left out, NULL vectors too. Repeated rows are vectors of their own; a NULL id hashes
as the empty text and is returned as NULL. Equal hashes go by components. Fewer vectors than
``clusters`` give that many centroids, none an empty result. Components beyond 2**27
after scaling raise an error, as squared distances would not fit a long. Other
columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelweave.functions.expressions import named
from panelweave.functions.storage import materialize
from panelweave.llm.workers import ship

COMPONENTS = 64
CLUSTERS = 40
ROUNDS = 5
SCALE = 256
SEED = 2
PIVOTS = 12
LARGEST = 1 << 27
#: Below this magnitude products of doubles and their sums are exact integers.
EXACT_IN_DOUBLES = 1 << 22


def scaled(
    vectors: DataFrame, id_col: str, vector_col: str, components: int, scale: int
) -> DataFrame:
    """``(id, x)``: usable vectors, each component as the integer floor(scale * component)."""
    value = named(vector_col)
    usable = F.size(value) == components
    usable &= ~F.exists(
        value, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    )
    x = F.transform(value, lambda x: F.floor(F.least(F.greatest(
        x.cast("double") * scale, F.lit(-2.0 * LARGEST)), F.lit(2.0 * LARGEST))).cast("int"))
    rows = vectors.where(value.isNotNull() & usable).select(named(id_col).alias("id"), x.alias("x"))
    large = F.exists("x", lambda x: F.abs(x) > LARGEST)
    error = F.raise_error(F.lit(f"a component exceeds {LARGEST} after scaling")).cast("array<int>")
    return rows.withColumn("x", F.when(large, error).otherwise(F.col("x")))


def first_centroids(rows: DataFrame, clusters: int, seed: int) -> np.ndarray:
    """The vectors whose ids have the smallest hashes, in their order."""
    named_by = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("")))
    first = (
        rows.withColumn("hash", F.sha2(named_by, 256)).orderBy("hash", "x").limit(clusters).collect()
    )
    return np.array([row["x"] for row in first], np.int64)


def choose_pivots(centroids: np.ndarray, most: int) -> np.ndarray:
    """Greedily, the centroid farthest in sum from the pivots chosen before."""
    chosen, reach = [0], np.zeros(len(centroids))
    while len(chosen) < min(most, len(centroids)):
        reach += np.sqrt(squared(centroids, centroids[chosen[-1]]).astype(float))
        reach[chosen] = -1.0
        chosen.append(int(reach.argmax()))
    return centroids[chosen]


def squared(x: np.ndarray, center: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer rows to one center."""
    apart = x - center
    return np.einsum("ij,ij->i", apart, apart)


def pivot_distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.stack([np.sqrt(squared(x, one).astype(float)) for one in pivots], axis=1)


def nearest(
    x: np.ndarray, to_pivots: np.ndarray, centroids: np.ndarray, pivots: np.ndarray
) -> tuple[np.ndarray, np.ndarray, int]:
    """``(cluster, squared distance, exact distances computed)``; ties to the smaller number."""
    n = len(x)
    rows = np.arange(n)
    own = pivot_distances(centroids, pivots)
    lower = np.zeros((n, len(centroids)))
    for p in range(len(pivots)):
        np.maximum(lower, np.abs(to_pivots[:, p, None] - own[None, :, p]), out=lower)
    # What rounding can add to a difference of two roots.
    lower -= 1e-12 * (to_pivots.max() + own.max())
    doubles = max(np.abs(x).max(), np.abs(centroids).max()) <= EXACT_IN_DOUBLES
    wide = x.astype(np.float64) if doubles else x
    norm = np.einsum("ij,ij->i", wide, wide)

    def exact(among: np.ndarray, number: int) -> np.ndarray:
        center = centroids[number].astype(wide.dtype)
        some = wide if len(among) == n else wide[among]
        return (norm[among] - 2 * (some @ center) + center @ center).astype(np.int64)

    cluster = lower.argmin(axis=1)
    apart = x - centroids[cluster]
    distance = np.einsum("ij,ij->i", apart, apart)
    reach, computed = np.sqrt(distance.astype(float)), n
    for number in range(len(centroids)):
        among = rows[(lower[:, number] <= reach) & (cluster != number)]
        if not len(among):
            continue
        found, computed = exact(among, number), computed + len(among)
        held = distance[among]
        better = (found < held) | ((found == held) & (number < cluster[among]))
        among, found = among[better], found[better]
        cluster[among], distance[among] = number, found
        reach[among] = np.sqrt(found.astype(float))
    return cluster, distance, computed


def _arrays(batch: pa.RecordBatch, components: int, pivots: int) -> tuple[np.ndarray, np.ndarray]:
    x = np.frombuffer(b"".join(batch.column("x").to_pylist()), np.int32)
    far = np.frombuffer(b"".join(batch.column("far").to_pylist()), np.float64)
    return x.reshape(-1, components).astype(np.int64), far.reshape(-1, pivots)


def store_table(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """``(id, x, far)``, written once: components and distances to the pivots as packed numbers."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").flatten().to_numpy().reshape(batch.num_rows, -1)
            far = pivot_distances(x.astype(np.int64), pivots)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    pa.array([one.astype(np.int32).tobytes() for one in x], pa.binary()),
                    pa.array([one.tobytes() for one in far], pa.binary()),
                ],
                ["id", "x", "far"],
            )

    kind = rows.schema["id"].dataType.simpleString()
    return materialize(rows.mapInArrow(measure, f"id {kind}, x binary, far binary"), "pivots")


def moved(stored: DataFrame, centroids: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The centroids after one round: each task sums its vectors by cluster, Spark adds the sums."""
    components = centroids.shape[1]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(len(centroids), np.int64)
        sums = np.zeros(centroids.shape, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            x, far = _arrays(batch, components, len(pivots))
            cluster, _, _ = nearest(x, far, centroids, pivots)
            order = np.argsort(cluster, kind="stable")
            found, first = np.unique(cluster[order], return_index=True)
            sums[found] += np.add.reduceat(x[order], first)
            counts[found] += np.bincount(cluster, minlength=len(counts))[found]
        held = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pydict(
            {
                "cluster": pa.array(held.astype(np.int32)),
                "n": pa.array(counts[held]),
                "sums": pa.array(sums[held].tolist(), pa.list_(pa.int64())),
            }
        )

    parts = stored.mapInArrow(add, "cluster int, n long, sums array<long>")
    totals = parts.groupBy("cluster").agg(
        F.sum("n").alias("n"),
        F.array(
            *[F.sum(F.col("sums")[i].cast("decimal(38,0)")) for i in range(components)]
        ).alias("sums"),
    )
    after = centroids.copy()
    for row in totals.collect():
        after[row["cluster"]] = [int(total) // row["n"] for total in row["sums"]]
    return after


def assigned(stored: DataFrame, centroids: np.ndarray, pivots: np.ndarray) -> DataFrame:
    """``(id, cluster, distance)`` under the given centroids."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, far = _arrays(batch, centroids.shape[1], len(pivots))
                cluster, distance, _ = nearest(x, far, centroids, pivots)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), pa.array(cluster.astype(np.int32)), pa.array(distance)],
                    ["id", "cluster", "distance"],
                )

    kind = stored.schema["id"].dataType.simpleString()
    return stored.mapInArrow(assign, f"id {kind}, cluster int, distance long")


def cluster_vectors(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    components: int = COMPONENTS,
    clusters: int = CLUSTERS,
    rounds: int = ROUNDS,
    scale: int = SCALE,
    seed: int = SEED,
    pivots: int = PIVOTS,
) -> tuple[DataFrame, DataFrame]:
    """``(members, centroids)`` after ``rounds`` rounds and a last assignment.

    members: ``id_col, cluster, distance`` per usable vector; centroids: ``cluster,
    components, cluster_inertia, inertia``, at most ``clusters`` rows. The driver
    holds the centroids and one sum per centroid and component, nothing else.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows = scaled(vectors, id_col, vector_col, components, scale)
    centers = first_centroids(rows, clusters, seed)
    kind = "cluster int, components array<long>, cluster_inertia long, inertia long"
    if not len(centers):
        nothing = rows.select(
            F.col("id").alias(id_col), F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")
        )
        return nothing, spark.createDataFrame([], kind)
    fixed = choose_pivots(centers, pivots)
    stored = store_table(rows, fixed)
    for _ in range(rounds):
        centers = moved(stored, centers, fixed)
    members = materialize(assigned(stored, centers, fixed), "members")
    held = {
        row["cluster"]: row["total"]
        for row in members.groupBy("cluster").agg(F.sum("distance").alias("total")).collect()
    }
    table = [
        (number, center.tolist(), held.get(number, 0), sum(held.values()))
        for number, center in enumerate(centers)
    ]
    members = members.select(F.col("id").alias(id_col), "cluster", "distance")
    return members, spark.createDataFrame(table, kind)


def centroid_digest(components: Column) -> Column:
    """Lowercase hex sha256 of the components as decimal integers joined by commas."""
    return F.sha2(F.array_join(F.transform(components, lambda x: x.cast("string")), ","), 256)

