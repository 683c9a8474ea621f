"""Clusters over a pivot table, against plain rounds."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelweave.llm import pivot_clusters


def by_hand(rows, components, clusters, rounds, scale=256, seed=2):
    """Plain rounds in Python's integers over (id, vector) rows."""
    kept = [
        (i, [math.floor(scale * float(np.float32(x))) for x in v])
        for i, v in rows
        if v is not None and len(v) == components and all(x is not None and math.isfinite(x) for x in v)
    ]
    name = lambda i: hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    centers = [v for _, v in sorted((name(i), v) for i, v in kept)[:clusters]]

    def assign():
        out = []
        for _, v in kept:
            out.append(min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centers)))
        return out

    for _ in range(rounds):
        found = assign()
        for n in range(len(centers)):
            own = [v for (_, v), (_, m) in zip(kept, found) if m == n]
            if own:
                centers[n] = [sum(column) // len(own) for column in zip(*own)]
    out = assign() if centers else []
    return [(i, n, d) for (i, _), (d, n) in zip(kept, out)], centers


def awkward():
    nan, inf = float("nan"), float("inf")
    random = np.random.default_rng(3)
    rows = [(i, random.normal(0, 0.3, 4).tolist()) for i in range(60)]
    rows += [(100 + i, [0.5, 0.5, 0.5, 0.5]) for i in range(9)] + rows[:3]
    rows += [(200, None), (201, [1.0, 2.0]), (202, [1.0, None, 0.0, 0.0]), (203, [nan, 0.0, 0.0, 0.0])]
    rows += [(204, [inf, 0.0, 0.0, 0.0]), (205, [0.0, 0.0, 0.0, 0.0]), (None, [0.1, 0.2, 0.3, 0.4])]
    rows += [(206, []), (207, [-2.0, 30.0, -7.5, 0.001])]
    return rows


@pytest.mark.parametrize("clusters, rounds", [(7, 3), (200, 2), (1, 1), (5, 0)])
def test_awkward_vectors_as_by_hand(spark, clusters, rounds):
    rows = awkward()
    table = spark.createDataFrame(
        [(*row, "x", 1) for row in rows], "vec_id long, embedding array<float>, cluster string, `a.b` int"
    )
    members, centroids = pivot_clusters.cluster_vectors(
        table.repartition(3), components=4, clusters=clusters, rounds=rounds, pivots=3
    )
    wanted, centers = by_hand(rows, 4, clusters, rounds)
    assert sorted(map(str, map(tuple, members.collect()))) == sorted(map(str, wanted))
    found = {r["cluster"]: r for r in centroids.collect()}
    assert [found[n]["components"] for n in range(len(centers))] == centers
    for n, row in found.items():
        assert row["cluster_inertia"] == sum(d for _, m, d in wanted if m == n)
        assert row["inertia"] == sum(d for _, _, d in wanted)


def test_no_vectors(spark):
    table = spark.createDataFrame([(1, None), (2, [1.0])], "vec_id long, embedding array<float>")
    members, centroids = pivot_clusters.cluster_vectors(table)
    assert members.columns == ["vec_id", "cluster", "distance"]
    assert members.count() == 0 and centroids.count() == 0


def test_bounds_leave_out_only_what_cannot_win():
    random = np.random.default_rng(4)
    centers = random.integers(-3000, 3000, (40, 64))
    x = np.concatenate([c + random.integers(-40, 40, (50, 64)) for c in centers])
    for shift in (0, 1 << 26):
        moved, own = x + shift, centers + shift
        pivots = pivot_clusters.choose_pivots(own, 12)
        far = pivot_clusters.pivot_distances(moved, pivots)
        cluster, distance, computed = pivot_clusters.nearest(moved, far, own, pivots)
        exact = ((moved[:, None] - own[None]) ** 2).sum(2)
        assert (cluster == exact.argmin(1)).all() and (distance == exact.min(1)).all()
        # Clusters lie apart, so pivots rule out nearly all centroids.
        assert computed < 0.1 * exact.size


def test_ties_go_to_the_smaller_number():
    centers = np.array([[4, 0], [0, 0], [0, 0], [0, 4]])
    x = np.array([[2, 2], [0, 0], [2, 0], [0, 2]])
    far = pivot_clusters.pivot_distances(x, centers[:2])
    cluster, distance, _ = pivot_clusters.nearest(x, far, centers, centers[:2])
    assert cluster.tolist() == [0, 1, 0, 1] and distance.tolist() == [8, 0, 4, 4]


def test_too_large_components_are_named(spark):
    table = spark.createDataFrame([(1, [1e30] * 64)], "vec_id long, embedding array<float>")
    with pytest.raises(Exception, match="exceeds"):
        pivot_clusters.cluster_vectors(table)[0].collect()


def test_digest(spark):
    row = spark.createDataFrame([([3, -4, 0],)], "c array<long>").select(
        pivot_clusters.centroid_digest(F.col("c")).alias("d")
    )
    assert row.first()["d"] == hashlib.sha256(b"3,-4,0").hexdigest()
