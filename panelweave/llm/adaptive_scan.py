"""Nearest neighbours by inner product: inverted lists and an adaptive dimension scan.

Vectors get one more coordinate that makes all of them equally long, so that the
largest inner product is the smallest distance, and are turned by a fixed random
rotation. K-means on a bounded sample gives the lists; every vector is in one. A
query scans the list nearest to it in full, which bounds the distance of its
``k``-th neighbour, then its other probed lists adaptively: distances grow by blocks
of columns, and after each block a candidate is given up if its scaled partial
distance exceeds the bound by more than chance allows. Survivors are scored exactly,
in double precision on the original vectors.

Equal vectors are one candidate; each stands for its ``k + 1`` smallest ids, more can
never be asked for. Several lists make a tile of at most ``TILE_ROWS`` candidates, and
a list beyond that is cut. A query goes to a tile once, with the distance of its last
probed list: the tile finds the lists within it, and leaves out those whose radius
shows that no member can be near enough. A candidate moves once per ``TILE_QUERIES``
queries.

Vectors that are NULL, zero, or hold a NULL or non-finite component take no part, nor
do those of another length than the commonest (of equally common, the shortest).
Repeated rows of one id and vector count once, a row is never its own id's
neighbour, rows without an id take no part. Ties go to the smaller id. Fewer than
``k`` others give fewer rows, an empty table none.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelweave.functions.storage import materialize
from panelweave.llm.workers import ship

SAMPLE_ROWS = 20_000
MOST_LISTS = 4096
PROBED = 0.75
BLOCK = 16
# The test: a partial distance over d of D columns is given up beyond
# bound * (1 + EPSILON / sqrt(d)) ** 2 after scaling by D / d.
EPSILON = 2.1
TILE_ROWS, TILE_QUERIES = 1 << 17, 1 << 16
# Tiles that the lists are dealt to at least, if there are as many, and pairs at hand.
LEAST_TILES, PAIR_ROWS, PAIR_QUERIES = 64, 4096, 512


def usable(vector: Column) -> Column:
    """No NULL, non-finite or only zero components."""
    finite = F.forall(
        vector,
        lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")),
    )
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


class Lists:
    """Centroids in the rotated space, small enough to go with every task."""

    def __init__(self, sample: np.ndarray, longest: float, n_lists: int, seed: int = 3) -> None:
        random = np.random.default_rng(seed)
        width = sample.shape[1] + 1
        self.longest = longest
        self.rotation = np.linalg.qr(random.normal(size=(width, width)))[0].astype(np.float32)
        points = self.lift(sample)
        centers = points[random.permutation(len(points))[:n_lists]]
        for _ in range(10):
            near = self._nearest(points, centers, 1)[:, 0]
            sums = np.zeros_like(centers)
            np.add.at(sums, near, points)
            counts = np.bincount(near, minlength=len(centers))
            centers = np.where(
                counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centers
            ).astype(np.float32)
        self.centers = centers

    def lift(self, vectors: np.ndarray) -> np.ndarray:
        """Candidates: lengthened to equal norm, then rotated."""
        vectors = vectors.astype(np.float64)
        rest = np.sqrt(np.maximum(self.longest**2 - (vectors**2).sum(1), 0.0))
        return np.column_stack((vectors, rest)).astype(np.float32) @ self.rotation

    def aim(self, vectors: np.ndarray) -> np.ndarray:
        """Queries: scaled to the same norm, which leaves the order of products alone."""
        vectors = vectors.astype(np.float64)
        vectors = vectors * (self.longest / np.sqrt((vectors**2).sum(1)))[:, None]
        flat = np.column_stack((vectors, np.zeros(len(vectors))))
        return flat.astype(np.float32) @ self.rotation

    @staticmethod
    def _nearest(points: np.ndarray, centers: np.ndarray, n: int) -> np.ndarray:
        out = []
        for at in range(0, len(points), 4096):
            far = (centers**2).sum(1) - 2 * points[at : at + 4096] @ centers.T
            out.append(np.argsort(far, 1, kind="stable")[:, :n])
        return np.concatenate(out) if out else np.zeros((0, n), np.int64)

    def nearest(self, points: np.ndarray, n: int) -> np.ndarray:
        return self._nearest(points, self.centers, n)

    def far(self, points: np.ndarray, number: int) -> np.ndarray:
        """Squared distances of the points to one center."""
        return ((points - self.centers[number]) ** 2).sum(1)


def products(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products of row pairs, added column by column in double precision."""
    out = np.zeros(len(queries))
    for column in range(queries.shape[1]):
        out += queries[:, column].astype(np.float64) * vectors[:, column].astype(np.float64)
    return out


def scan(
    aimed: np.ndarray, lifted: np.ndarray, bound: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(query, candidate, squared distance)`` of the pairs within each query's bound."""
    width = aimed.shape[1]

    def limit(seen: int) -> np.ndarray:
        if seen >= width:
            return bound * (1 + 1e-4)
        return bound * (1 + EPSILON / math.sqrt(seen)) ** 2 * (seen / width)

    a, b = aimed[:, :BLOCK], lifted[:, :BLOCK]
    far = np.maximum((a**2).sum(1)[:, None] + (b**2).sum(1) - 2 * a @ b.T, 0.0)
    query, candidate = np.nonzero(far <= limit(min(BLOCK, width))[:, None])
    so_far = far[query, candidate]
    for start in range(BLOCK, width, BLOCK):
        stop = min(start + BLOCK, width)
        for at in range(0, len(query), 1 << 18):
            part = slice(at, at + (1 << 18))
            apart = aimed[query[part], start:stop] - lifted[candidate[part], start:stop]
            so_far[part] += (apart**2).sum(1)
        alive = so_far <= limit(stop)[query]
        query, candidate, so_far = query[alive], candidate[alive], so_far[alive]
    return query, candidate, so_far


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_list()) if len(vectors) else np.zeros((0, 1), np.float32)


def _best(query: np.ndarray, score: np.ndarray, candidate: np.ndarray, k: int) -> np.ndarray:
    """Places of each query's ``k`` best, ties to the smaller candidate id."""
    order = np.lexsort((candidate, -score, query))
    sorted_query = query[order]
    first = np.searchsorted(sorted_query, sorted_query)
    return order[np.arange(len(order)) - first < k]


FOUND = "query long, candidate long, score double, far double"


def nearest_neighbours(
    vectors: DataFrame,
    is_query: Column,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = 20,
    probed: float = PROBED,
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` best others found for each query row.

    ``is_query`` is a condition on a column named ``vec_id``.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows = vectors.select(
        F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").alias("vector")
    ).where(F.col("vec_id").isNotNull() & usable(F.col("vector")))
    empty = "query_id long, rank int, vec_id long, score double"
    common = (
        rows.groupBy(F.size("vector").alias("width"))
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), "width")
        .first()
    )
    if common is None:
        return spark.createDataFrame([], empty)
    rows = rows.where(F.size("vector") == common["width"])

    # Only the first ids of equal vectors pass, cut before the shuffle as well.
    by_vector = Window.partitionBy("vector").orderBy("vec_id")
    # Equal vectors are one candidate, named by its smallest id.
    unique = rows.withColumn("_place", F.dense_rank().over(by_vector)).where(
        F.col("_place") <= k + 1
    )
    stored = materialize(
        unique.dropDuplicates(["vector", "_place"])
        .withColumn("candidate", F.min("vec_id").over(Window.partitionBy("vector")))
        .select("candidate", "vec_id", "_place", "vector"),
        "vectors",
    )
    candidates = stored.where("_place = 1").select("candidate", "vector")
    asking = materialize(
        rows.where(is_query)
        .distinct()
        .join(candidates, "vector")
        .select("vec_id", "candidate"),
        "queries",
    )
    asked = asking.select("candidate").distinct()

    squares = F.aggregate(
        "vector", F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double")
    )
    n, longest = candidates.agg(F.count(F.lit(1)), F.sqrt(F.max(squares))).first()
    n_lists = int(min(MOST_LISTS, max(1, round(math.sqrt(n)))))
    sample = (
        candidates.orderBy(F.xxhash64("candidate"), "candidate").limit(SAMPLE_ROWS).toArrow()
    )
    lists = Lists(np.stack(sample["vector"].to_pylist()).astype(np.float32), longest, n_lists)
    n_probed = max(1, math.ceil(probed * len(lists.centers)))

    def place(batches):
        for batch in batches:
            points = lists.lift(_matrix(batch.column("vector").to_pandas()))
            near = lists.nearest(points, 1)[:, 0].astype(np.int32)
            far = np.sqrt(((points - lists.centers[near]) ** 2).sum(1)).astype(np.float64)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(near), pa.array(far)],
                [*batch.schema.names, "list", "far"],
            )

    kind = candidates.schema["vector"].dataType.simpleString()
    listed = materialize(
        candidates.mapInArrow(place, f"candidate long, vector {kind}, list int, far double"), "lists"
    )
    # At most MOST_LISTS numbers.
    radius = {
        row["list"]: row["radius"]
        for row in listed.groupBy("list").agg(F.max("far").alias("radius")).collect()
    }
    groups = max(math.ceil(n / TILE_ROWS), min(len(lists.centers), LEAST_TILES))
    listed = listed.withColumn("tile", F.col("list") % groups)
    # At most as many rows as lists.
    sizes = F.broadcast(
        listed.groupBy("tile").agg(
            F.ceil(F.count(F.lit(1)) / TILE_ROWS).cast("int").alias("cuts")
        )
    )
    listed = listed.join(sizes, "tile").withColumn(
        "cut", F.pmod(F.xxhash64("candidate"), F.col("cuts").cast("long"))
    )

    def aim(batches):
        """Queries with their nearest list, the distance of the last probed, and their tiles."""
        for batch in batches:
            aimed = lists.aim(_matrix(batch.column("vector").to_pandas()))
            near = lists.nearest(aimed, n_probed)
            reach = ((aimed - lists.centers[near[:, -1]]) ** 2).sum(1).astype(np.float64)
            tiles = [sorted(set((own[1:] % groups).tolist())) for own in near]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns,
                    pa.array(near[:, 0].astype(np.int32)),
                    pa.array(reach * (1 + 1e-6)),
                    pa.array(tiles, pa.list_(pa.int32())),
                ],
                [*batch.schema.names, "home", "reach", "tiles"],
            )

    aimed = materialize(
        candidates.join(asked, "candidate", "left_semi").mapInArrow(
            aim, f"candidate long, vector {kind}, home int, reach double, tiles array<int>"
        ),
        "aimed",
    ).withColumnRenamed("candidate", "query")

    def scanned(asking: DataFrame, at_home: bool) -> DataFrame:
        """Scan tiles for rows of (query, vector, home, reach, bound, tile)."""
        counts = F.broadcast(
            asking.groupBy("tile").agg(
                F.ceil(F.count(F.lit(1)) / TILE_QUERIES).cast("int").alias("parts")
            )
        )
        left = (
            listed.join(counts, "tile")
            .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
            .select("tile", "cut", F.col("part").cast("long").alias("part"), "candidate", "vector", "list")
        )
        right = (
            asking.join(counts, "tile")
            .join(sizes, "tile")
            .withColumn("part", F.pmod(F.xxhash64("query"), F.col("parts").cast("long")))
            .withColumn("cut", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
            .select(
                "tile", F.col("cut").cast("long").alias("cut"), "part", "query", "vector", "home", "reach", "bound"
            )
        )

        def tile(own: pd.DataFrame, asked_rows: pd.DataFrame) -> pd.DataFrame:
            found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0))]
            if len(own) and len(asked_rows):
                theirs, mine = _matrix(asked_rows["vector"]), _matrix(own["vector"])
                points, lifted = lists.aim(theirs), lists.lift(mine)
                bound = asked_rows["bound"].to_numpy(np.float64)
                home, reach = asked_rows["home"].to_numpy(), asked_rows["reach"].to_numpy()
                ids, member = own["candidate"].to_numpy(), own["list"].to_numpy()
                for number in np.unique(member):
                    rows = np.flatnonzero(member == number)
                    if at_home:
                        asking_now = np.flatnonzero(home == number)
                    else:
                        far = lists.far(points, number)
                        least = np.maximum(np.sqrt(far) - radius[number], 0.0) ** 2
                        asking_now = np.flatnonzero(
                            (home != number) & (far <= reach) & (least <= bound * (1 + 1e-4))
                        )
                    for a in range(0, len(asking_now), PAIR_QUERIES):
                        chosen = asking_now[a : a + PAIR_QUERIES]
                        for b in range(0, len(rows), PAIR_ROWS):
                            some = rows[b : b + PAIR_ROWS]
                            query, candidate, apart = scan(points[chosen], lifted[some], bound[chosen])
                            query, candidate = chosen[query], some[candidate]
                            score = products(theirs[query], mine[candidate])
                            kept = _best(query, score, ids[candidate], k + 1)
                            found.append((query[kept], ids[candidate[kept]], score[kept], apart[kept]))
            query, candidate, score, far = (np.concatenate(part) for part in zip(*found))
            kept = _best(query, score, candidate, k + 1)
            return pd.DataFrame(
                {
                    "query": asked_rows["query"].to_numpy()[query[kept]] if len(kept) else query,
                    "candidate": candidate[kept],
                    "score": score[kept],
                    "far": far[kept].astype(np.float64),
                }
            )

        keys = ["tile", "cut", "part"]
        return left.groupBy(keys).cogroup(right.groupBy(keys)).applyInPandas(tile, FOUND)

    by_score = Window.partitionBy("query").orderBy(F.desc("score"), "candidate")
    first = aimed.withColumns({"bound": F.lit(float("inf")), "tile": F.col("home") % groups})
    near = materialize(scanned(first.drop("tiles"), True), "nearest-list")
    # The bound is the distance of the (k + 1)-th found so far, none if there are fewer.
    bounds = (
        near.withColumn("_rank", F.row_number().over(by_score))
        .where(F.col("_rank") <= k + 1)
        .groupBy("query")
        .agg(
            F.when(F.count(F.lit(1)) > k, F.max("far"))
            .otherwise(F.lit(float("inf")))
            .alias("bound")
        )
    )
    # A query whose nearest list has no member has no bound yet.
    bounded = aimed.join(bounds, "query", "left").withColumn(
        "bound", F.coalesce("bound", F.lit(float("inf")))
    )
    others = bounded.withColumn("tile", F.explode("tiles")).drop("tiles")
    everything = near.unionByName(scanned(others, False))
    classes = (
        everything.withColumn("_rank", F.row_number().over(by_score))
        .where(F.col("_rank") <= k + 1)
        .select("query", "candidate", "score")
    )
    answers = (
        asking.select(F.col("vec_id").alias("query_id"), F.col("candidate").alias("query"))
        .join(classes, "query")
        .join(stored.select("candidate", "vec_id"), "candidate")
        .where("query_id <> vec_id")
    )
    by_query = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        answers.withColumn("rank", F.row_number().over(by_query))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
