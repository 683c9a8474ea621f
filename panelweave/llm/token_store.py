"""Token ids of all documents as one concatenated array, boundaries in Elias-Fano code.

The store is a folder of two tables. ``blocks`` holds shards in ascending order of
document id, each cut into blocks of about ``block_tokens`` ids: the ids as
little-endian unsigned 16- or 32-bit numbers, the ends of its documents in
Elias-Fano code, the document ids in order. ``manifest`` has one row per block with
the number of ids before it. Spark's commit makes a retried task write its block
once, and no machine-local file is used.

Documents are ordered by id, then by a hash of the text; NULL ids come first, a NULL
text is the empty text and still gets the end id, repeated ids and rows stay.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelweave.llm.elias_fano import EliasFano
from panelweave.llm.workers import bounded, ship, text_bytes

BLOCK_TOKENS = 1 << 20
# Chunks whose ids a worker remembers, about 250 MB; beyond that it starts anew.
CACHED_CHUNKS = 1_200_000
BLOCKS = (
    "shard int, block int, n_docs long, n_tokens long, width int, ids binary, "
    "low_bits int, low binary, high binary, samples binary, doc_ids array<bigint>"
)


class ChunkEncoder:
    """Ids of white-space separated chunks, each distinct chunk encoded once.

    Valid for tokenizers that drop white space and never join across it. Chunks
    that are new in a batch are encoded together in one text per
    ``GROUP`` chunks; the offsets tell which ids belong to which chunk. A-Z may be
    folded first where ``lower`` says that the tokenizer does so itself, but not in
    texts that might hold a special token.
    """

    GROUP = 512

    def __init__(self, path: str, lower: bool, special: tuple[bytes, ...]) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.lower, self.special = lower, special
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.known: dict[bytes, bytes] = {}

    def ids(self, texts: list[bytes]) -> list[bytes]:
        cut = []
        for text in texts:
            fold = self.lower and not any(mark in text for mark in self.special)
            cut.append((text.lower() if fold else text).split())
        if len(self.known) > CACHED_CHUNKS:
            self.known.clear()
        new = {chunk for chunks in cut for chunk in chunks}
        new.difference_update(self.known)
        self._learn(list(new))
        known = self.known
        return [b"".join([known[chunk] for chunk in chunks]) for chunks in cut]

    def _learn(self, new: list[bytes]) -> None:
        chunks = [chunk.decode() for chunk in new]
        groups = [chunks[at : at + self.GROUP] for at in range(0, len(chunks), self.GROUP)]
        kind = f"<u{self.width}"
        for at in range(0, len(groups), 64):
            part = groups[at : at + 64]
            encoded = self.tokenizer.encode_batch(
                [" ".join(group) for group in part], add_special_tokens=False
            )
            for number, (group, encoding) in enumerate(zip(part, encoded), start=at):
                ends = np.cumsum([len(chunk) + 1 for chunk in group])
                starts = np.array([start for start, _ in encoding.offsets], np.int64)
                ids = np.array(encoding.ids, kind)
                cuts = np.searchsorted(starts, np.concatenate(([0], ends)))
                data, size = ids.tobytes(), self.width
                first = number * self.GROUP
                for i in range(len(group)):
                    self.known[new[first + i]] = data[cuts[i] * size : cuts[i + 1] * size]


_ENCODERS: dict[tuple, ChunkEncoder] = {}


def encoder(path: str, lower: bool, special: tuple[bytes, ...]) -> ChunkEncoder:
    """One per worker process and tokenizer file; its memory of chunks outlives a task."""
    key = (path, lower, special)
    if key not in _ENCODERS:
        _ENCODERS[key] = ChunkEncoder(path, lower, special)
    return _ENCODERS[key]


def write_store(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    end_id: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    lower: bool = False,
    special: tuple[str, ...] = (),
    block_tokens: int = BLOCK_TOKENS,
) -> None:
    """Encode every text and write the store below ``path``.

    ``tokenizer`` is the path of a tokenizer file that every worker can open. Texts
    are range-partitioned by id and text hash, so a repeated id may span shards,
    and sorted within tasks; only one block is held at a time.
    """
    spark = docs.sparkSession
    ship(spark)
    marks = tuple(mark.encode() for mark in special)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = encoder(tokenizer, lower, marks)
        end = end_id.to_bytes(codec.width, "little")
        shard, block = TaskContext.get().partitionId(), 0
        ids: list[bytes] = []
        names: list[int | None] = []
        held = 0

        def full() -> pa.RecordBatch:
            ends = np.cumsum([len(one) // codec.width for one in ids])
            coded = EliasFano.encode(ends)
            return pa.RecordBatch.from_pydict(
                {
                    "shard": pa.array([shard], pa.int32()),
                    "block": pa.array([block], pa.int32()),
                    "n_docs": pa.array([len(ids)], pa.int64()),
                    "n_tokens": pa.array([int(ends[-1])], pa.int64()),
                    "width": pa.array([codec.width], pa.int32()),
                    "ids": pa.array([b"".join(ids)], pa.binary()),
                    "low_bits": pa.array([coded.low_bits], pa.int32()),
                    "low": pa.array([coded.low], pa.binary()),
                    "high": pa.array([coded.high], pa.binary()),
                    "samples": pa.array([coded.samples], pa.binary()),
                    "doc_ids": pa.array([names], pa.list_(pa.int64())),
                }
            )

        for batch in bounded(batches, "_text"):
            coded_texts = codec.ids(text_bytes(batch.column("_text")))
            for name, one in zip(batch.column("_id").to_pylist(), coded_texts):
                ids.append(one + end)
                names.append(name)
                held += len(ids[-1]) // codec.width
                if held >= block_tokens:
                    yield full()
                    ids, names, held, block = [], [], 0, block + 1
        if ids:
            yield full()

    rows = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("_id"),
        F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("_text"),
        F.xxhash64(F.col(f"`{text_col}`")).alias("_hash"),
    )
    ordered = rows.repartitionByRange("_id", "_hash").sortWithinPartitions("_id", "_hash")
    ordered.select("_id", "_text").mapInArrow(encode, BLOCKS).write.parquet(f"{path}/blocks")
    _write_manifest(spark, path)


def _write_manifest(spark: SparkSession, path: str) -> None:
    """Running totals: over one row per shard, then over the blocks within each shard."""
    blocks = spark.read.parquet(f"{path}/blocks").select("shard", "block", "n_docs", "n_tokens")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = (
        blocks.groupBy("shard")
        .agg(F.sum("n_tokens").alias("tokens"))
        .select("shard", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("shard_start"))
    )
    within = (
        Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    )
    starts = blocks.join(shards, "shard").select(
        "shard",
        "block",
        (
            F.col("shard_start") + F.coalesce(F.sum("n_tokens").over(within), F.lit(0))
        ).alias("block_start"),
    )
    starts.write.parquet(f"{path}/manifest")


def _bounds(block: dict) -> EliasFano:
    return EliasFano(
        block["n_docs"], block["low_bits"], block["low"], block["high"], block["samples"]
    )


def read_store(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32[, ids])`` of every document, from the files.

    ``start`` counts the ids of all documents before it; the checksum is that of the
    ids as little-endian unsigned 32-bit numbers. Bounds come from select.
    """
    blocks = spark.read.parquet(f"{path}/blocks").drop("n_tokens").withColumn("wanted", F.lit(None).cast("array<int>"))
    return _read(spark, path, blocks, with_ids)


def read_documents(spark: SparkSession, path: str, wanted: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Columns of :func:`read_store`, ids included, of the documents that ``wanted`` names.

    Ids find their block and place by a join; in each block with one, select gives the
    bounds of those places alone. Ids of no document give nothing, repeated ones count
    once, a NULL finds the documents without an id.
    """
    blocks = spark.read.parquet(f"{path}/blocks").drop("n_tokens")
    keys = wanted.select(F.col(f"`{id_col}`").cast("long").alias("key")).distinct()
    found = (
        blocks.select("shard", "block", F.posexplode("doc_ids").alias("place", "doc_id"))
        .join(keys, F.col("doc_id").eqNullSafe(F.col("key")), "left_semi")
        .groupBy("shard", "block")
        .agg(F.sort_array(F.collect_list("place")).alias("wanted"))
    )
    return _read(spark, path, blocks.join(found, ["shard", "block"]), True)


def _read(spark: SparkSession, path: str, blocks: DataFrame, with_ids: bool) -> DataFrame:
    """Rows of the documents at the places ``wanted`` of each block; of all where it is NULL."""
    ship(spark)
    columns = "doc_id long, start long, n_tokens long, ids_crc32 long"
    columns += ", ids array<int>" if with_ids else ""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                block = {name: batch.column(name)[row].as_py() for name in batch.schema.names}
                bounds = _bounds(block)
                ids = np.frombuffer(block["ids"], f"<u{block['width']}")
                places = block["wanted"]
                every = places is None
                made: dict[str, list] = {"doc_id": [], "start": [], "n_tokens": [], "ids_crc32": [], "ids": []}
                end = 0
                for place in range(block["n_docs"]) if every else places:
                    # Reading on, a document starts where the one before it ended.
                    start = end if every else bounds.select(place - 1) if place else 0
                    end = bounds.select(place)
                    own = ids[start:end]
                    made["doc_id"].append(block["doc_ids"][place])
                    made["start"].append(start + block["block_start"])
                    made["n_tokens"].append(end - start)
                    made["ids_crc32"].append(zlib.crc32(own.astype("<u4").tobytes()))
                    if with_ids:
                        made["ids"].append(own.astype(np.int32))
                kinds = [pa.int64()] * 4 + [pa.list_(pa.int32())]
                names = list(made) if with_ids else list(made)[:4]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(made[name], kind) for name, kind in zip(names, kinds)], names
                )

    manifest = spark.read.parquet(f"{path}/manifest")
    return blocks.join(manifest, ["shard", "block"]).mapInArrow(decode, columns)
