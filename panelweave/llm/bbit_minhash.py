"""Near-duplicate texts by b-bit MinHash.

A text's set is that of its distinct shingles of ``size`` words (runs of bytes other
than space and 0x09-0x0D, A-Z folded); with fewer words the whole sequence is its
only shingle, without words the set is empty and linked with nothing. Texts are
linked if ``100 * intersection >= percent * union``.

1. Equal sets are one node from the start, whatever their number.
2. Bands of ``ROWS`` full minima give buckets. Of each minimum only the low
   ``BITS`` bits are kept, packed; their agreement, corrected for chance, rules out
   bucket neighbours that are far from the threshold.
3. Every member of a bucket is compared with two of its nodes, lowest and highest,
   not with all: a group of thousands costs two comparisons each. Links are
   confirmed on the full sets, and components taken.
4. What may still be missing lies between different components of one bucket of
   four nodes or more. There every node outside the bucket's largest component is
   held against the others by its packed bits, in tiles of bounded size that return
   only the components it may belong to; it is then compared with all texts of those
   components, again in tiles, until one links. So no link between components is
   lost, no pairs within a component are looked at, and no list of pairs is made.

NULL texts are empty texts. Rows with equal sets agree; repeated ids are rows like
others, a NULL id is never a component's name unless all its ids are NULL. Extra
columns do not matter. Nodes go by 64-bit digests of their sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelweave.functions.storage import materialize
from panelweave.llm.components import components
from panelweave.llm.wordkeys import mix, shingles, word_keys
from panelweave.llm.workers import bounded, ship

ROWS, BANDS = 5, 40
BITS = 2
LANES = 64 // BITS
LONGS = -(-ROWS * BANDS // LANES)
# Estimates this far below the threshold are ruled out: 4.4 standard errors there.
SLACK = 0.15
# Rows of either side that meet in one task when components are compared.
TILE_NODES, TILE_OUTSIDE, TILE_TEXTS = 2048, 512, 256
_random = np.random.default_rng(20240607)
_XOR = _random.integers(0, 2**64, ROWS * BANDS, dtype=np.uint64)
_MULTIPLY = _random.integers(0, 2**64, ROWS * BANDS, dtype=np.uint64) | np.uint64(1)


def shingle_sets(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """``(keys, ends)``: the ascending distinct shingles of text ``i`` lie between its ends."""
    words, ends, _ = word_keys(column)
    sets = [
        np.unique(shingles(words[a:b], size)) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())
    ]
    sizes = np.array([len(one) for one in sets], np.int64)
    keys = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    return keys, np.concatenate(([0], np.cumsum(sizes)))


def signatures(keys: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Digest, band keys and packed low bits of every non-empty set."""
    starts = ends[:-1]
    digest = mix(np.add.reduceat(mix(keys ^ np.uint64(0x2545F4914F6CDD1D)), starts)) ^ mix(
        np.diff(ends).astype(np.uint64)
    )
    minima = np.empty((ROWS * BANDS, len(starts)), np.uint64)
    for i in range(ROWS * BANDS):
        minima[i] = np.minimum.reduceat((keys ^ _XOR[i]) * _MULTIPLY[i], starts)
    minima = mix(minima)
    bands = np.empty((len(starts), BANDS), np.uint64)
    for band in range(BANDS):
        key = np.full(len(starts), np.uint64(band))
        for row in range(ROWS):
            key = mix(key ^ minima[band * ROWS + row])
        bands[:, band] = key
    low = np.zeros((len(starts), LONGS * LANES), np.uint64)
    low[:, : ROWS * BANDS] = (minima & np.uint64((1 << BITS) - 1)).T
    shifts = np.arange(LANES, dtype=np.uint64) * np.uint64(BITS)
    packed = (low.reshape(len(starts), LONGS, LANES) << shifts).sum(2, dtype=np.uint64)
    return digest.view(np.int64), bands.view(np.int64), packed.view(np.int64)


SIGNED = "doc_id long, text_hash long, n long, node long, bands array<bigint>, bits array<bigint>"


def sign(docs: DataFrame, size: int) -> DataFrame:
    """Every row of ``(doc_id, text, text_hash)`` with the size, node and signature of its set."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "text", 1 << 20):
            keys, ends = shingle_sets(batch.column("text"), size)
            sizes = np.diff(ends)
            full = sizes > 0
            digest, bands, bits = (
                signatures(keys, np.append(ends[:-1][full], ends[-1]))
                if full.any()
                else (np.zeros(0, np.int64),) * 3
            )
            node = np.zeros(len(sizes), np.int64)
            node[full] = digest

            def lists(values: np.ndarray, width: int) -> pa.Array:
                offsets = np.concatenate(([0], np.cumsum(full * width))).astype(np.int32)
                return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.ravel()))

            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column("doc_id"),
                    "text_hash": batch.column("text_hash"),
                    "n": sizes,
                    "node": pa.array(node, mask=~full),
                    "bands": lists(bands, BANDS),
                    "bits": lists(bits, LONGS),
                }
            )

    return docs.select("doc_id", "text_hash", "text").mapInArrow(make, SIGNED)


def estimate(a: str, b: str) -> Column:
    """Share of equal minima from the packed low bits, less what chance makes equal."""
    lanes = sum(1 << (BITS * lane) for lane in range(LANES))
    differing = F.lit(0)
    for i in range(LONGS):
        apart = F.col(a)[i].bitwiseXOR(F.col(b)[i])
        marked = apart
        for bit in range(1, BITS):
            marked = marked.bitwiseOR(F.shiftrightunsigned(apart, bit))
        differing = differing + F.bit_count(marked.bitwiseAND(F.lit(lanes)))
    equal = 1 - differing / float(ROWS * BANDS)
    chance = 2.0**-BITS
    return (equal - chance) / (1 - chance)


def _plausible(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs ``(a, b)`` whose sizes allow the link and whose estimate is near enough."""
    left = nodes.select(F.col("node").alias("a"), F.col("n").alias("_na"), F.col("bits").alias("_ba"))
    right = nodes.select(F.col("node").alias("b"), F.col("n").alias("_nb"), F.col("bits").alias("_bb"))
    joined = pairs.join(left, "a").join(right, "b")
    near = 100 * F.least("_na", "_nb") >= percent * F.greatest("_na", "_nb")
    return joined.where(near & (estimate("_ba", "_bb") >= percent / 100 - SLACK)).select("a", "b")


def _confirm(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs linked by their full sets. ``b``'s text moves once per pair, ``a``'s once;
    rows arrive ordered by ``a``, whose set is kept from row to row."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, np.zeros(0, np.uint64)
        for batch in bounded(batches, "text_b", 1 << 20):
            firsts = batch.column("a").to_pylist()
            keys, ends = shingle_sets(batch.column("text_b"), size)
            linked = []
            for row, a in enumerate(firsts):
                if a != last:
                    last, own = a, shingle_sets(batch.column("text_a")[row : row + 1], size)[0]
                other = keys[ends[row] : ends[row + 1]]
                both = len(np.intersect1d(own, other, assume_unique=True))
                linked.append(100 * both >= percent * (len(own) + len(other) - both))
            mask = pa.array(linked, pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [batch.column("a").filter(mask), batch.column("b").filter(mask)], ["a", "b"]
            )

    with_b = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    with_both = with_b.hint("merge").join(
        texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")).hint("merge"), "a"
    )
    return with_both.select("a", "b", "text_a", "text_b").mapInArrow(check, "a long, b long")


def _tiled(members: DataFrame, asking: DataFrame, key: str, rows: int, asked: int) -> tuple:
    """Both sides dealt over ``(key, cut, part)``: every member meets every asking row of
    its key in exactly one tile, of at most about ``rows`` by ``asked`` rows."""
    cuts = members.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / rows).cast("int").alias("cuts"))
    parts = asking.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / asked).cast("int").alias("parts"))
    plan = cuts.join(parts, key)
    left = members.join(plan, key).withColumns(
        {
            "cut": F.pmod(F.xxhash64("node"), F.col("cuts")).cast("int"),
            "part": F.explode(F.sequence(F.lit(0), F.col("parts") - 1)),
        }
    )
    right = asking.join(plan, key).withColumns(
        {
            "part": F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"),
            "cut": F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)),
        }
    )
    keys = [key, "cut", "part"]
    # Fresh columns: both sides may come from one table.
    right = right.select(*[F.col(name).alias(name) for name in right.columns])
    return left.drop("cuts", "parts").groupBy(keys), right.drop("cuts", "parts").groupBy(keys)


_LANE_ONES = np.uint64(sum(1 << (BITS * lane) for lane in range(LANES)))


def _stack(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.view(np.uint64).reshape(-1, LONGS)


def _neighbours(apart: DataFrame, percent: int) -> DataFrame:
    """``(node, component)``: components that a node outside the largest may belong to.

    Of two nodes outside the largest only the lower asks for the other's. A tile
    returns one row per node with all it found, and a node's rows are merged before
    they are taken apart, so that meeting in many buckets costs nothing further on.
    """
    most = (1 - (percent / 100 - SLACK)) * (1 - 2.0**-BITS) * ROWS * BANDS

    def tile(members: pa.Table, outside: pa.Table) -> pa.Table:
        nodes, found = [], []
        if members.num_rows and outside.num_rows:
            bits, n = _stack(members["bits"]), members["n"].to_numpy()
            groups, names = members["component"].to_numpy(), members["node"].to_numpy()
            largest = groups == members["largest"].to_numpy()
            for node, own, size, mine in zip(
                outside["node"].to_pylist(),
                outside["component"].to_pylist(),
                outside["n"].to_pylist(),
                _stack(outside["bits"]),
            ):
                near = (groups != own) & (100 * np.minimum(n, size) >= percent * np.maximum(n, size))
                near = np.flatnonzero(near & (largest | (names > node)))
                apart_bits = bits[near] ^ mine
                marked = apart_bits
                for bit in range(1, BITS):
                    marked = marked | (apart_bits >> np.uint64(bit))
                differing = np.bitwise_count(marked & _LANE_ONES).sum(1)
                reached = np.unique(groups[near[differing <= most]])
                if len(reached):
                    nodes.append(node)
                    found.append(reached.tolist())
        return pa.table(
            {
                "node": pa.array(nodes, pa.int64()),
                "components": pa.array(found, pa.list_(pa.int64())),
            }
        )

    columns = ["bucket", "node", "component", "n", "bits", "largest"]
    left, right = _tiled(
        apart.select(*columns),
        apart.where("component <> largest").select(*columns),
        "bucket",
        TILE_NODES,
        TILE_OUTSIDE,
    )
    reached = left.cogroup(right).applyInArrow(tile, "node long, components array<bigint>")
    merged = reached.groupBy("node").agg(
        F.array_distinct(F.flatten(F.collect_list("components"))).alias("components")
    )
    return merged.select("node", F.explode("components").alias("component"))


def _cross_links(
    near: DataFrame, labels: DataFrame, rows: DataFrame, nodes: DataFrame, size: int, percent: int
) -> DataFrame:
    """A link ``(a, b)`` from each node to a component next to it, where there is one."""
    members = labels.join(near.select("component").distinct(), "component", "left_semi")
    wanted = members.select("node").union(near.select("node")).distinct()
    texts = materialize(_texts(rows, nodes, wanted), "crossing-texts")

    def tile(members: pa.Table, asking: pa.Table) -> pa.Table:
        a, b = [], []
        if members.num_rows and asking.num_rows:
            keys, ends = shingle_sets(members["text"].combine_chunks(), size)
            sizes = np.diff(ends)
            mine, mine_ends = shingle_sets(asking["text"].combine_chunks(), size)
            names, firsts = members["node"].to_numpy(), asking["node"].to_pylist()
            for i, node in enumerate(firsts):
                own = mine[mine_ends[i] : mine_ends[i + 1]]
                place = np.minimum(np.searchsorted(own, keys), len(own) - 1)
                both = np.add.reduceat(own[place] == keys, ends[:-1], dtype=np.int64)
                linked = np.flatnonzero(100 * both >= percent * (len(own) + sizes - both))
                if len(linked):
                    a.append(node)
                    b.append(int(names[linked[0]]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    left, right = _tiled(
        members.join(texts, "node").select("component", "node", "text"),
        near.join(texts, "node").select("component", "node", "text"),
        "component",
        TILE_TEXTS,
        TILE_TEXTS,
    )
    return left.cogroup(right).applyInArrow(tile, "a long, b long")


def _texts(docs: DataFrame, nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(node, text)`` of the wanted nodes, one text each."""
    keys = nodes.join(wanted, "node", "left_semi").select(
        "node", F.col("rep.doc_id").alias("_doc_id"), F.col("rep.text_hash").alias("_text_hash")
    )
    joined = docs.join(
        keys,
        F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("text_hash") == F.col("_text_hash")),
    )
    # Repeated rows of one id and text would otherwise repeat the node.
    return joined.select("node", "text").dropDuplicates(["node"])


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = 5,
    percent: int = 80,
) -> DataFrame:
    """``(doc_id, text_hash, n_shingles, component_id)`` for every row.

    ``component_id`` is the smallest id of the texts reachable by links.
    """
    ship(docs.sparkSession)
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        text.alias("text"),
        F.xxhash64(text).alias("text_hash"),
    )
    signed = materialize(sign(rows, size), "signatures")
    nodes = materialize(
        signed.where("node IS NOT NULL")
        .groupBy("node")
        .agg(
            F.first("n").alias("n"),
            F.min("doc_id").alias("doc_id"),
            F.min(F.struct("doc_id", "text_hash")).alias("rep"),
            F.first("bands").alias("bands"),
            F.first("bits").alias("bits"),
        ),
        "set-nodes",
    )
    members = nodes.select(F.explode("bands").alias("bucket"), "node")
    buckets = (
        members.groupBy("bucket")
        .agg(
            F.min("node").alias("low"),
            F.max("node").alias("high"),
            F.count(F.lit(1)).alias("size"),
        )
        .where("low <> high")
    )
    # Buckets of one node hold no pair; the rest is what later steps read.
    crowded = materialize(members.join(buckets, "bucket"), "crowded-buckets")
    stars = crowded.select(F.explode(F.array("low", "high")).alias("a"), F.col("node").alias("b"))
    # The same two nodes may meet in several buckets.
    tried = materialize(
        stars.where("a <> b").distinct(),
        "star-pairs",
    )
    plausible = materialize(_plausible(tried, nodes, percent), "plausible-pairs")
    wanted = plausible.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    texts = materialize(_texts(rows, nodes, wanted), "paired-texts")
    linked = materialize(_confirm(plausible, texts, size, percent), "links")
    first = components(linked)

    labels = nodes.select("node").join(first, "node", "left").select(
        "node", F.coalesce("component", "node").alias("component")
    )
    labels = materialize(labels, "first-components")
    # Buckets of up to three nodes are settled: their pairs all hold the lowest or highest.
    # What a node brings is joined once a node; its buckets, at most BANDS, go along as a list.
    listed = materialize(
        crowded.where("size > 3")
        .groupBy("node")
        .agg(F.collect_list("bucket").alias("buckets"))
        .join(labels, "node")
        .join(nodes.select("node", "n", "bits"), "node"),
        "crowded-nodes",
    )
    placed = listed.select("node", "component", "n", "bits", F.explode("buckets").alias("bucket"))
    split = (
        placed.groupBy("bucket", "component")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("bucket")
        .agg(
            F.max(F.struct("n", "component"))["component"].alias("largest"),
            F.count(F.lit(1)).alias("parts"),
        )
        .where("parts > 1")
        .drop("parts")
    )
    apart = materialize(placed.join(split, "bucket"), "split-buckets")
    near = materialize(_neighbours(apart, percent), "near-components")
    more = _cross_links(near, labels, rows, nodes, size, percent)
    joined = components(materialize(linked.unionByName(more), "all-links"))

    named = nodes.select("node", "doc_id").join(joined, "node", "left").select(
        "node", "doc_id", F.coalesce("component", "node").alias("component")
    )
    names = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    labels = named.join(names, "component").select("node", "component_id")
    return (
        signed.select("doc_id", "text_hash", "n", "node")
        .join(labels, "node", "left")
        .select(
            "doc_id",
            "text_hash",
            F.col("n").alias("n_shingles"),
            F.when(F.col("node").isNull(), F.col("doc_id"))
            .otherwise(F.col("component_id"))
            .alias("component_id"),
        )
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """One row of each group of near duplicates: that of the smallest id; columns as they are.

    Of several rows with that id the one with the smallest text hash stays, of equal
    rows one. Rows without words are linked with nothing and all stay.
    """
    classes = near_duplicates(docs, id_col, text_col, **settings)
    kept = (
        classes.where("n_shingles > 0")
        .groupBy("component_id")
        .agg(
            F.min(
                F.struct(
                    (~F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("other"),
                    "doc_id",
                    "text_hash",
                )
            ).alias("stays")
        )
        .select(F.col("stays.doc_id").alias("_doc_id"), F.col("stays.text_hash").alias("_hash"))
    )
    # One shuffle by (id, text hash) serves both the repeated rows and the join.
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    wordless = F.translate(text, " \t\n\x0b\x0c\r", "") == ""
    keys = ["_near_id", "_near_hash"]
    rows = docs.where(~wordless).withColumns(
        {"_near_id": _name(F.col(f"`{id_col}`")), "_near_hash": F.xxhash64(text)}
    )
    chosen = rows.dropDuplicates(keys).join(
        kept.select(_name(F.col("_doc_id")).alias("_near_id"), F.col("_hash").alias("_near_hash")),
        keys,
        "left_semi",
    )
    return chosen.drop(*keys).unionByName(docs.where(wordless))


def _name(id_col: Column) -> Column:
    return F.coalesce(id_col.cast("long").cast("string"), F.lit("none"))
