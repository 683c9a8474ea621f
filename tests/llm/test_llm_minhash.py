"""b-bit MinHash against all pairs, and its parts."""

import numpy as np
import pyarrow as pa
import pytest
from llm_fixtures import docs, none, words

from panelweave.llm import bbit_minhash as near
from panelweave.llm.components import components


def shingle_set(text, size):
    found = words(text)
    if not found:
        return frozenset()
    size = min(size, len(found))
    return frozenset(tuple(found[i : i + size]) for i in range(len(found) - size + 1))


def by_hand(rows, size, percent=80):
    """(doc_id, n_shingles, component_id) of every row, by all pairs of different sets."""
    sets = [shingle_set(text, size) for _, text in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(root(i) if sets[i] else ("alone", i), []).append(rows[i][0])
    return sorted(
        (
            str(rows[i][0]),
            len(sets[i]),
            str(
                min(
                    (x for x in groups[root(i) if sets[i] else ("alone", i)] if x is not None),
                    default=None,
                )
            ),
        )
        for i in range(len(rows))
    )


def found(spark, table, size):
    return sorted(
        (str(r["doc_id"]), r["n_shingles"], str(r["component_id"]))
        for r in near.near_duplicates(table, size=size).collect()
    )


@pytest.mark.parametrize("size", [2, 5])
def test_awkward_rows(spark, size):
    table = docs(spark)
    rows = [(r["doc_id"], r["text"]) for r in table.collect()]
    assert found(spark, table, size) == by_hand(rows, size)


def test_groups_chains_and_strangers(spark):
    random = np.random.default_rng(4)
    rows = []

    def text(n):
        return [f"t{x}" for x in random.integers(0, 4000, n)]

    for group in range(12):
        base = text(int(random.integers(30, 300)))
        for _ in range(int(random.integers(1, 25))):
            copy = list(base)
            for place in random.integers(0, len(base), int(random.integers(0, 1 + len(base) // 14))):
                copy[place] = f"e{random.integers(0, 9999)}"
            rows.append((len(rows), " ".join(copy)))
        chain = text(200)
        for _ in range(6):  # neighbours are linked, the ends are not
            chain = chain[8:] + text(8)
            rows.append((len(rows), " ".join(chain)))
    rows += [(len(rows) + i, " ".join(text(60))) for i in range(100)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    for size in (2, 5):
        assert found(spark, table, size) == by_hand(rows, size)


def test_registered_table_by_hand(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in table.collect()]
    assert found(spark, table, 2) == by_hand(rows, 2)


def test_one_of_each_group_stays(spark):
    table = docs(spark)
    kept = near.keep_one(table)
    assert kept.columns == table.columns
    rows = kept.collect()
    assert len([r for r in rows if not words(r["text"])]) == 3
    with_words = [r["doc_id"] for r in rows if words(r["text"])]
    assert len(with_words) == len(set(with_words)) + 0
    assert 9 not in with_words and 8 in with_words
    assert near.keep_one(none(spark)).count() == 0


def test_estimate_is_corrected_for_chance(spark):
    random = np.random.default_rng(2)
    rows = []
    for share in (0.0, 0.5, 0.8, 0.95, 1.0):
        n = 3000
        same = random.integers(0, 2**63, int(n * share), dtype=np.uint64)
        pair = [
            np.unique(np.concatenate((same, random.integers(0, 2**63, n - len(same), dtype=np.uint64))))
            for _ in range(2)
        ]
        both = len(np.intersect1d(*pair))
        true = both / (len(pair[0]) + len(pair[1]) - both)
        bits = [near.signatures(one, np.array([0, len(one)]))[2][0].tolist() for one in pair]
        rows.append((true, *bits))
    table = spark.createDataFrame(rows, "true double, a array<bigint>, b array<bigint>")
    for row in table.select("true", near.estimate("a", "b").alias("guess")).collect():
        assert abs(row["true"] - row["guess"]) < 0.15


def test_components(spark):
    random = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in random.integers(0, 900, (500, 2))]
    edges += [(5000 + i, 5001 + i) for i in range(60)] + [(7000, 7001 + i) for i in range(300)]
    low = {x: x for e in edges for x in e}
    for _ in range(100):
        for a, b in edges:
            low[a] = low[b] = min(low[a], low[b])
    table = spark.createDataFrame(edges, "a long, b long")
    linked = {x for a, b in edges if a != b for x in (a, b)}
    wanted = sorted((x, low[x]) for x in linked if low[x] != x)
    assert sorted(map(tuple, components(table).collect())) == wanted
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_shingle_sets_of_short_texts():
    keys, ends = near.shingle_sets(pa.array([None, "", "One", "one", "a b", "a b a b a"]), 2)
    assert np.diff(ends).tolist() == [0, 0, 1, 1, 1, 2]
    assert keys[0] == keys[1]
