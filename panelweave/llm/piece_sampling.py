"""Sampled segmentation into the pieces of a SentencePiece model, and lossless decoding.

A text's lattice has an edge for every piece that matches at a place, with weight
``exp(sharpness * score)``; characters without a piece of their own get an edge that
stands for their bytes. Forward filtering sums the weights of all ways to each
place, backward sampling then draws a segmentation with probability proportional to
its weight. No piece of such a model holds a space behind another character, so the
lattice falls apart before each run of spaces, and the sums are taken once per
distinct chunk and batch.

Random numbers are a hash of the row key, the chunk's number in the text and the
step, so a row gives the same pieces wherever and with whatever it is computed. Rows
with equal key and text agree; a NULL key is a key of its own. As in the library's
own encoding a text is given one leading space, which decoding takes off again; NULL
and empty texts have no pieces. A literal U+2581 is spelled by its bytes, since the
piece with that name means a space.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.llm.wordkeys import mix
from panelweave.llm.workers import bounded, ship, text_bytes

SHARPNESS = 0.0005
SEED = 17
_STEP = np.uint64(0x9E3779B97F4A7C15)


class Pieces:
    """The piece table of one model file."""

    def __init__(self, path: str, sharpness: float) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.bytes = [-1] * 256
        self.spelled: list[bytes] = []
        named: dict[str, int] = {}
        self.log_weight = np.zeros(size)
        lowest = -float(size)
        for piece in range(size):
            name = model.id_to_piece(piece)
            if model.is_byte(piece):
                self.bytes[int(name[3:5], 16)] = piece
                self.spelled.append(bytes([int(name[3:5], 16)]))
            elif model.is_control(piece) or model.is_unknown(piece) or model.is_unused(piece):
                self.spelled.append(b"")
            else:
                text = name.replace("▁", " ")
                if re.search("[^ ] ", text):
                    raise ValueError(f"piece {name!r} spans words; the lattice can't be cut")
                self.spelled.append(text.encode())
                named[text] = piece
                self.log_weight[piece] = sharpness * max(model.get_score(piece), lowest)
        if -1 in self.bytes:
            raise ValueError("the model has no byte pieces")
        # A spelled character costs as much as the least likely piece for each byte.
        self.byte_weight = sharpness * lowest
        self._grow(named)

    def _grow(self, named: dict[str, int]) -> None:
        """The pieces' prefix tree as a table of steps ``(node, character) -> node``."""
        nodes, steps = {"": 0}, {}
        for text in named:
            for n in range(1, len(text) + 1):
                if text[:n] not in nodes:
                    nodes[text[:n]] = len(nodes)
                    steps[nodes[text[: n - 1]] << 21 | ord(text[n - 1])] = nodes[text[:n]]
        self.piece = np.full(len(nodes), -1, np.int64)
        for text, piece in named.items():
            self.piece[nodes[text]] = piece
        # A hash table with linear probing: a step lies at its home or closely behind it.
        wanted = np.array(sorted(steps), np.int64)
        self.shift = np.uint64(62 - len(wanted).bit_length())
        home = self._home(wanted)
        order = np.argsort(home, kind="stable")
        place = np.maximum.accumulate(home[order] - np.arange(len(wanted))) + np.arange(len(wanted))
        self.step = np.full((4 << len(wanted).bit_length()) + len(wanted) + 1, -1, np.int64)
        self.next = np.full(len(self.step), -1, np.int64)
        self.step[place] = wanted[order]
        self.next[place] = [steps[one] for one in wanted[order].tolist()]

    def _home(self, wanted: np.ndarray) -> np.ndarray:
        return ((wanted.astype(np.uint64) * _STEP) >> self.shift).astype(np.int64)

    def follow(self, node: np.ndarray, character: np.ndarray) -> np.ndarray:
        """The node after each step, -1 where the tree has none."""
        wanted = node << 21 | character
        place = self._home(wanted)
        found = self.step[place]
        unsure = np.flatnonzero((found != wanted) & (found >= 0))
        while len(unsure):
            place[unsure] += 1
            found = self.step[place[unsure]]
            unsure = unsure[(found != wanted[unsure]) & (found >= 0)]
        return np.where(self.step[place] == wanted, self.next[place], -1)

    def spell(self, character: int) -> list[int]:
        return [self.bytes[byte] for byte in chr(character).encode()]


_TABLES: dict[tuple[str, float], Pieces] = {}


def pieces(path: str, sharpness: float) -> Pieces:
    if (path, sharpness) not in _TABLES:
        _TABLES[path, sharpness] = Pieces(path, sharpness)
    return _TABLES[path, sharpness]


def ordered(values: np.ndarray) -> np.ndarray:
    """A stable sorting order of numbers from 0 on, 16 bits at a time."""
    order = np.argsort(values.astype(np.uint16), kind="stable")
    top = int(values.max()) if len(values) else 0
    for shift in range(16, top.bit_length(), 16):
        digit = (values >> shift).astype(np.uint16)
        order = order[np.argsort(digit[order], kind="stable")]
    return order


class Lattices:
    """Filtered lattices of distinct chunks, built side by side.

    A chunk has a node before each character and one behind the last. Nodes are
    numbered place by place, longer chunks first: ``last`` has each chunk's last
    node, and the first ones are below ``n``. The edges into node ``n + i`` end at
    ``ends[i]``, and ``below`` has the probability of all edges into the same node
    before the edge, -1 for the first one.
    """

    def __init__(self, table: Pieces, chunks: list[str]) -> None:
        characters = np.frombuffer("".join(chunks).encode("utf-32-le"), "<u4").astype(np.int64)
        sizes = np.fromiter(map(len, chunks), np.int64, len(chunks))
        self.n = len(chunks)
        ends = np.cumsum(sizes)
        left = np.repeat(ends, sizes) - np.arange(len(characters))
        place = np.repeat(sizes, sizes) - left
        # How many chunks reach each place, and the first node there.
        reach = np.cumsum(np.bincount(sizes)[::-1])[::-1] if self.n else np.zeros(1, np.int64)
        base = np.cumsum(reach) - reach
        rank = np.empty(self.n, np.int64)
        rank[ordered(sizes.max(initial=0) - sizes)] = np.arange(self.n)
        self.last = base[sizes] + rank
        node = base[place] + np.repeat(rank, sizes)
        behind = base[place + 1] + np.repeat(rank, sizes) if len(place) else node
        sources, targets, labels, weights = [], [], [], []

        at = np.arange(len(characters))
        state = np.zeros(len(at), np.int64)
        own = np.zeros(len(at), bool)
        depth = 0
        while len(at):
            state = table.follow(state, characters[at + depth])
            on = np.flatnonzero(state >= 0)
            at, state = at[on], state[on]
            piece = table.piece[state]
            ends_here = np.flatnonzero(piece >= 0)
            begun = at[ends_here]
            sources.append(node[begun])
            targets.append(behind[begun + depth])
            labels.append(piece[ends_here])
            weights.append(table.log_weight[labels[-1]])
            depth += 1
            if depth == 1:
                own[begun] = True
            on = np.flatnonzero(left[at] > depth)
            at, state = at[on], state[on]
        spelled = np.flatnonzero(~own)
        sources.append(node[spelled])
        targets.append(behind[spelled])
        labels.append(-1 - characters[spelled])
        n_bytes = 1 + sum((characters[spelled] >= low).astype(int) for low in (0x80, 0x800, 0x10000))
        weights.append(table.byte_weight * n_bytes)

        target = np.concatenate(targets) - self.n
        order = ordered(target)
        self.source = np.concatenate(sources)[order]
        self.label = np.concatenate(labels)[order]
        # Every node but the first ones has an edge: the character before it.
        counts = np.bincount(target, minlength=len(characters))
        self.ends = np.cumsum(counts)
        self.below = self._filter(counts, np.concatenate(weights)[order], reach[1:])

    def _filter(self, counts: np.ndarray, weight: np.ndarray, reach: np.ndarray) -> np.ndarray:
        """Log sums of all ways to each node, place by place, and from them ``below``."""
        ways = np.zeros(self.n + len(counts))
        chance = np.empty(len(weight))
        starts = self.ends - counts
        low = 0
        for high in np.cumsum(reach).tolist():
            first, end = int(starts[low]), int(self.ends[high - 1])
            size, begin = counts[low:high], starts[low:high] - first
            reached = ways[self.source[first:end]] + weight[first:end]
            best = np.maximum.reduceat(reached, begin)
            part = np.exp(reached - np.repeat(best, size))
            total = np.add.reduceat(part, begin)
            ways[self.n + low : self.n + high] = best + np.log(total)
            chance[first:end] = part / np.repeat(total, size)
            low = high
        below = np.full(len(weight), -1.0)
        sums = np.zeros(len(counts))
        several = np.arange(len(counts))
        behind = 0
        while len(several := several[counts[several] > behind + 1]):
            edge = starts[several] + behind
            sums[several] += chance[edge]
            below[edge + 1] = sums[several]
            behind += 1
        return below


def cut(texts: list[str]) -> tuple[np.ndarray, list[str], np.ndarray]:
    """``(numbers, chunks, counts)``: each chunk's number among the distinct ones, those,
    and how many chunks each text has."""
    spaced = [b" " + text.encode() if text else b"" for text in texts]
    sizes = np.fromiter(map(len, spaced), np.int64, len(spaced))
    joined = b"".join(spaced)
    data = np.frombuffer(joined, np.uint8)
    space = data == 0x20
    begins = space.copy()
    begins[1:] &= ~space[:-1]
    rows = np.flatnonzero(sizes)
    starts = (np.cumsum(sizes) - sizes)[rows]
    begins[starts] = True
    offsets = np.append(np.flatnonzero(begins), len(data))
    counts = np.zeros(len(texts), np.int64)
    counts[rows] = np.diff(np.searchsorted(offsets, np.append(starts, len(data))))
    buffers = [None, pa.py_buffer(offsets), pa.py_buffer(joined)]
    coded = pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, buffers).dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist(), counts


def sample(
    table: Pieces, texts: list[str], keys: np.ndarray, seed: int
) -> tuple[np.ndarray, np.ndarray]:
    """``(ids, ends)``: text ``i`` has the pieces ``ids[ends[i]:ends[i + 1]]``."""
    number, chunks, counts = cut(texts)
    lattices = Lattices(table, chunks)
    n = len(number)
    starts = np.concatenate(([0], np.cumsum(counts)))
    within = (np.arange(n) - np.repeat(starts[:-1], counts)).astype(np.uint64)
    # Equal chunks next to each other, so that lookups stay in the processor's cache.
    alive = ordered(number)
    state = mix(np.repeat(mix(keys + np.uint64(seed)), counts) + within * _STEP)[alive]
    at = lattices.last[number[alive]]
    drawn: list[tuple[np.ndarray, np.ndarray]] = []
    step = 0
    while len(alive):
        step += 1
        mixed = mix(state + np.uint64(step * 0x9E3779B97F4A7C15 % 2**64))
        chance = ((mixed >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53
        edge = lattices.ends[at - lattices.n] - 1
        before = np.flatnonzero(lattices.below[edge] >= chance)
        while len(before):
            edge[before] -= 1
            before = before[lattices.below[edge[before]] >= chance[before]]
        drawn.append((alive, lattices.label[edge]))
        at = lattices.source[edge]
        on = np.flatnonzero(at >= lattices.n)
        alive, at, state = alive[on], at[on], state[on]
    sizes = np.zeros(n, np.int64)
    for alive, _ in drawn:
        sizes[alive] += 1
    ends = np.cumsum(sizes)
    out = np.zeros(int(ends[-1]) if n else 0, np.int64)
    for back, (alive, labels) in enumerate(drawn):
        out[ends[alive] - 1 - back] = labels
    edges = np.concatenate(([0], ends))[starts]
    if (out < 0).any():
        spelled = np.flatnonzero(out < 0)
        tables = {one: table.spell(-1 - one) for one in np.unique(out[spelled]).tolist()}
        grown = np.ones(len(out), np.int64)
        grown[spelled] = [len(tables[one]) for one in out[spelled].tolist()]
        places = np.concatenate(([0], np.cumsum(grown)))
        wide = np.repeat(out, grown)
        for place, one in zip(places[spelled].tolist(), out[spelled].tolist()):
            wide[place : place + len(tables[one])] = tables[one]
        out, edges = wide, places[edges]
    return out.astype(np.int32), edges


def decode(table: Pieces, ids: list[int]) -> bytes:
    """The text's bytes again: pieces spelled out, the one leading space taken off."""
    return b"".join([table.spelled[one] for one in ids])[1:]


def row_keys(column: pa.Array) -> np.ndarray:
    """A number per row key; NULL is a key of its own."""
    values = column.cast(pa.int64())
    missing = values.is_null().to_numpy(zero_copy_only=False)
    filled = values.fill_null(0).to_numpy(zero_copy_only=False).astype(np.uint64)
    return np.where(missing, np.uint64(0xD1B54A32D192ED03), mix(filled))


RESULT = "doc_id long, ids array<int>, n_pieces long, ids_crc32 long, round_trip boolean"


def encode_sampled(
    docs: DataFrame,
    model: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    sharpness: float = SHARPNESS,
    seed: int = SEED,
) -> DataFrame:
    """``(doc_id, ids, n_pieces, ids_crc32, round_trip)`` for every row.

    ``round_trip`` says that decoding the ids gave the text's bytes back; the
    checksum takes the ids as little-endian unsigned 32-bit numbers. No shuffle; a
    task holds the lattices of a few megabytes of text.
    """
    ship(docs.sparkSession)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pieces(model, sharpness)
        for batch in bounded(batches, "_text", 4 << 20):
            raw = text_bytes(batch.column("_text"))
            texts = [one.decode() for one in raw]
            ids, ends = sample(table, texts, row_keys(batch.column("_id")), seed)
            made = [ids[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
            rows = {
                "doc_id": batch.column("_id"),
                "ids": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids)),
                "n_pieces": pa.array(np.diff(ends), pa.int64()),
                "ids_crc32": pa.array([zlib.crc32(one.astype("<u4").tobytes()) for one in made]),
                "round_trip": pa.array(
                    [decode(table, one.tolist()) == text for one, text in zip(made, raw)]
                ),
            }
            yield pa.RecordBatch.from_pydict(rows)

    rows = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("_id"),
        F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("_text"),
    )
    return rows.mapInArrow(encode, RESULT)
