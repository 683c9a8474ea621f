"""A gated recurrent language model with a class-factored output, in numpy.

Tokens are words (runs of bytes other than space and 0x09-0x0D, A-Z folded), then one
end per text. Every training token of the corpus is counted. The ``CLASSES * MEMBERS`` most
frequent words are the members of classes, by rank. One more class holds all others:
the rest of the head, ``HEAD_WORDS`` in all, lies by rank in about R**(1/3) blocks of as
many sections of as many places, and a last block has the words beyond it, with the
smoothed unigram probability ``(c + 0.1) / (T + 0.1 * (V' + 1))`` within it and one place
for unknown words. So

    P(word | past) = P(class | state) * P(word | class, state)
    P(word | last class, state) =
        P(block | state) * P(section | block, state) * P(word | section, state)

sums to one. A block has its own output vector; the vectors of its sections and places
are those of one of ``TABLES`` tables by a hash of the block, added to the log counts of
its words. Words outside the classes have hashed input vectors, ``BUCKETS`` in all. The
recurrent weights learn by truncated backpropagation on all training rows, each in one
round, shard by shard, and are averaged between rounds; biases start at the corpus
counts. Scoring carries the state across windows, so a text's score is that of the whole
text.

Words are known by 64-bit keys (see ``wordkeys``). NULL and empty texts are their end
token alone; a NULL id counts as the empty id when rows are held out; repeated ids
and rows are scored each for itself; extra columns are left out. An empty table
gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelweave.functions.storage import materialize
from panelweave.llm.wordkeys import mix, word_keys
from panelweave.llm.workers import bounded, ship

END = np.uint64(0x5BD1E9955BD1E995)
SMOOTH = 0.1
_SALT = np.uint64(1 << 32)
CLASSES, MEMBERS, HIDDEN = 64, 64, 16
TABLES, BUCKETS = 16, 2048
# Words whose counts go to every worker; the counts of all others are joined.
HEAD_WORDS = 1 << 17
ROUNDS, SHARD_ROWS = 2, 4000
#: Weights in a row of a shard's result, and rows that are summed at once.
SLICE, FAN_IN = 1 << 15, 256
WINDOW, LANES = 16, 512
#: Updates that a shard makes at least, with fewer lanes if need be; words scored together.
LEAST_STEPS, SCORE_WINDOW = 100, 16384
#: Columns of a softmax at once, so that its arrays stay in a processor's cache.
COLUMNS = 4000
#: Bits of a key that the search for its word starts from.
LEADING = 18
RATE = 0.01


def held_out(id_col: Column, parts: int = 10, part: int = 0) -> Column:
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % parts == part


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word keys of the texts with an end after each, and where each text starts."""
    keys, ends, _ = word_keys(column)
    starts = ends + np.arange(len(ends))
    out = np.full(len(keys) + len(ends) - 1, END, np.uint64)
    out[np.arange(len(keys)) + np.repeat(np.arange(len(ends) - 1), np.diff(ends))] = keys
    return out, starts


def count_words(docs: DataFrame, text: str) -> DataFrame:
    """``(key, c)`` of every token; each task adds up its batches before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, text):
            keys, found = np.unique(tokens(batch.column(text))[0], return_counts=True)
            yield pa.RecordBatch.from_pydict({"key": keys.view(np.int64), "c": found})

    counted = docs.select(text).mapInArrow(count, "key long, c long")
    return counted.groupBy("key").agg(F.sum("c").alias("c"))


class Vocabulary:
    """Counts of the corpus and its most frequent words, the same on every worker."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, total: int, distinct: int) -> None:
        """``keys`` and ``counts``: the head, by falling count."""
        self.total, self.distinct = total, distinct
        members = len(keys)
        self.direct = min(members, CLASSES * MEMBERS)
        order = np.argsort(keys)
        self.keys, self.counts = keys[order], counts[order]
        # Word numbers 0.. are the head by rank; the next number is all words beyond it.
        self.number = order.astype(np.int32)
        self.member_counts = counts
        self.members = members
        self.tail_count = total - int(self.member_counts.sum())
        self.tail_log = math.log10(self.tail_count + SMOOTH * (distinct - members + 1))
        self.base_log = math.log10(total + SMOOTH * (distinct + 1))
        self.end = int(self.look_up(np.array([END]))[0])

    def starts(self) -> np.ndarray:
        """For each value of a key's first ``LEADING`` bits, where its keys start."""
        edges = np.arange(1 << LEADING, dtype=np.uint64) << np.uint64(64 - LEADING)
        return np.searchsorted(self.keys, edges)

    def look_up(self, keys: np.ndarray, starts: np.ndarray | None = None) -> np.ndarray:
        """Word number of each key; ``starts`` saves most of the search for many keys."""
        if not len(self.keys):
            return np.full(len(keys), self.members, np.int32)
        last = len(self.keys) - 1
        if starts is None:
            place = np.minimum(np.searchsorted(self.keys, keys), last)
        else:
            # Keys are hashes, so few share their leading bits.
            place = np.minimum(starts[keys >> np.uint64(64 - LEADING)], last)
            behind = np.flatnonzero(self.keys[place] < keys)
            while len(behind):
                behind = behind[place[behind] < last]
                place[behind] += 1
                behind = behind[self.keys[place[behind]] < keys[behind]]
        return np.where(self.keys[place] == keys, self.number[place], np.int32(self.members))


def read_vocabulary(counts: DataFrame) -> Vocabulary:
    """The head is at most ``HEAD_WORDS`` rows, whatever the corpus."""
    total, distinct = counts.agg(
        F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))
    ).first()
    head = counts.orderBy(F.desc("c"), "key").limit(HEAD_WORDS).toArrow()
    keys = head["key"].to_numpy().view(np.uint64)
    return Vocabulary(keys, head["c"].to_numpy(), int(total), int(distinct))


def sigmoid(x: np.ndarray) -> np.ndarray:
    """In place."""
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1.0
    return np.reciprocal(x, out=x)


class Model:
    """Gated recurrent unit; ``weights`` is one flat array of all parameters.

    States and logits lie feature by token. States have a last feature of one, so the
    biases are the last rows of the weights.
    """

    def __init__(self, words: Vocabulary, weights: np.ndarray | None = None) -> None:
        direct, h = words.direct, HIDDEN
        rest = words.members - direct
        self.words = words
        self.classes = -(-direct // MEMBERS)
        # Words outside the classes by rank: block, section of the block, place in the section.
        self.side = max(1, math.ceil(round(max(rest, 1) ** (1 / 3), 9)))
        self.blocks = -(-rest // self.side**2)
        # The row of "into" that a word feeds: its own, a hashed one, or that of all beyond.
        buckets = min(BUCKETS, rest)
        row = np.arange(words.members + 1)
        row[direct:-1] = direct + mix(np.arange(rest, dtype=np.uint64)) % max(buckets, 1)
        row[-1] = direct + buckets
        self.row = row.astype(np.uint16)
        table = (mix(np.arange(self.blocks, dtype=np.uint64) + _SALT) % TABLES).astype(np.uint8)
        # Of each word: its block, and its class or, behind all classes, its block's table.
        self.block = np.zeros(words.members + 1, np.int32)
        self.block[direct:] = np.append(np.arange(rest) // self.side**2, self.blocks)
        self.key = (np.arange(words.members + 1) // MEMBERS).astype(np.uint8)
        self.key[direct:] = np.append(table, TABLES)[self.block[direct:]] + np.uint8(self.classes)
        counts = np.zeros(self.blocks * self.side**2)
        counts[:rest] = words.member_counts[direct:] + SMOOTH
        counts = counts.reshape(self.blocks, self.side, self.side)
        self.block_counts = counts.sum((1, 2))
        with np.errstate(divide="ignore"):
            sections, places = np.log(counts.sum(2)), np.log(counts)
        # Largest logit 0 in every softmax of counts alone; nothing is -40.
        sections -= sections.max(1, initial=-40.0, keepdims=True)
        places -= places.max(2, initial=-40.0, keepdims=True)
        self.section_bias = np.ascontiguousarray(np.maximum(sections, -40.0).T, np.float32)
        places = np.maximum(places, -40.0).reshape(self.blocks * self.side, self.side)
        self.place_bias = np.ascontiguousarray(places.T, np.float32)
        self.shapes = {
            "into": (3 * h, direct + buckets + 1),
            "again": (h + 1, 3 * h),
            "classes": (h + 1, self.classes + 1),
            "members": (self.classes * MEMBERS, h + 1),
            "blocks": (h + 1, self.blocks + 1),
            "sections": (TABLES, self.side, h + 1),
            "places": (TABLES, self.side, h + 1),
        }
        size = sum(math.prod(shape) for shape in self.shapes.values())
        self.weights = np.zeros(size, np.float32) if weights is None else weights.astype(np.float32)
        self.part = self.parts(self.weights)
        self.rooms: dict[tuple, np.ndarray] = {}
        if weights is None:
            self._start()

    def parts(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        views, at = {}, 0
        for name, shape in self.shapes.items():
            views[name] = flat[at : at + math.prod(shape)].reshape(shape)
            at += math.prod(shape)
        return views

    def _start(self) -> None:
        random = np.random.default_rng(11)
        for name, scale in (("into", 0.1), ("again", 0.25), ("classes", 0.1), ("members", 0.1)):
            self.part[name][:] = random.normal(0, scale, self.shapes[name])
        self.part["again"][-1] = 0.0
        self.part["again"][-1, :HIDDEN] = 1.0  # keep the state at first
        counts = np.full(self.classes * MEMBERS, 1e-12)
        counts[: self.words.direct] = self.words.member_counts[: self.words.direct] + SMOOTH
        sums = counts.reshape(self.classes, MEMBERS).sum(1)
        blocks = np.append(self.block_counts, self.words.tail_count + SMOOTH)
        self.part["members"][:, -1] = np.maximum(np.log(counts / np.repeat(sums, MEMBERS)), -40.0)
        self.part["blocks"][-1] = np.log(blocks / blocks.sum())
        sums = np.append(sums, blocks.sum())
        self.part["classes"][-1] = np.log(sums / sums.sum())

    def _room(self, name: str, kind: np.dtype, *shape: int) -> np.ndarray:
        """An array whose memory every window uses again: mapping fresh pages for the arrays
        of each window cost a fifth of the time. Its last contents are lost."""
        size = math.prod(shape)
        held = self.rooms.get((name, kind))
        if held is None or len(held) < size:
            held = self.rooms[name, kind] = np.empty(size, kind)
        return held[:size].reshape(shape)

    def _feed(self, word: np.ndarray) -> np.ndarray:
        table = self.part["into"]
        fed = self._room("fed", table.dtype, len(table), len(word))
        # "clip" is for speed: "raise" fills a copy first.
        return np.take(table, self.row[word], axis=1, out=fed, mode="clip")

    def _step(self, state: np.ndarray, fed: np.ndarray) -> tuple[np.ndarray, ...]:
        """``(state, gates, fresh, back)`` after one word; ``state`` without the last feature."""
        h = HIDDEN
        back = self.part["again"].T @ state
        gates = sigmoid(fed[: 2 * h] + back[: 2 * h])
        fresh = gates[h:] * back[2 * h :]
        fresh += fed[2 * h :]
        np.tanh(fresh, out=fresh)
        after = state[:h] - fresh
        after *= gates[:h]
        after += fresh
        return after, gates, fresh, back[2 * h :]

    def step(self, state: np.ndarray, word: np.ndarray) -> np.ndarray:
        """States, one a row, after one word each."""
        return self._step(_with_one(state.T), self._feed(word))[0].T

    def log_probability(self, states: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Natural log of each word's probability; beyond the head, that of the block."""
        return self._output(_with_one(states.T), word, None)[0]

    def _output(
        self, states: np.ndarray, word: np.ndarray, grad: dict[str, np.ndarray] | None
    ) -> tuple[np.ndarray, np.ndarray | None]:
        """Log probabilities of words after states and, with ``grad``, the slopes by state.

        Tokens are sorted once, by class and then by table, and taken ``COLUMNS`` at a time;
        each softmax of those is one array and only the products go class by class.
        """
        p, n, h = self.part, len(word), HIDDEN
        direct, kind = self.words.direct, states.dtype
        key = self.key.take(word)
        order = np.argsort(key, kind="stable")
        key, word = key[order], word[order]
        bounds = np.searchsorted(key, np.arange(self.classes + TABLES + 1))
        rank, block = word - direct, self.block.take(word)
        group = np.minimum(key, self.classes).astype(np.int64)
        of = [slice(at * MEMBERS, (at + 1) * MEMBERS) for at in range(self.classes)]
        members = [p["members"][one] for one in of]
        slope = grad is not None
        logs = np.empty(n, kind)
        if slope:
            grads = [grad["members"][one] for one in of]
            slopes = self._room("slopes", kind, h, n)

        def room(name: str, rows: int, columns: int) -> np.ndarray:
            return self._room(name, kind, rows, columns)

        for low in range(0, n, COLUMNS):
            high = min(low + COLUMNS, n)
            own = room("own", h + 1, high - low)
            np.take(states, order[low:high], axis=1, out=own, mode="clip")
            # Columns of the words in classes come first, those beyond the head last.
            here = np.minimum(np.maximum(bounds, low), high) - low
            split, most = int(here[self.classes]), int(here[-1])
            log = logs[low:high]

            x = np.matmul(p["classes"].T, own, out=room("logits", self.classes + 1, high - low))
            log[:], wrong = _chosen(x, group[low:high], slope, room("wrong", *x.shape))
            if slope:
                grad["classes"] += (wrong @ own.T).T
                into = np.matmul(p["classes"][:h], wrong, out=slopes[:, low:high])
            if split:
                spans = list(zip(here[: self.classes].tolist(), here[1:].tolist()))
                x = _products(members, own, spans, room("logits", MEMBERS, split))
                found, wrong = _chosen(x, word[low : low + split] % MEMBERS, slope, room("wrong", *x.shape))
                log[:split] += found
                if slope:
                    _slopes(grads, members, own, into, wrong, spans)
            if split < high - low:
                far = own[:, split:]
                x = np.matmul(p["blocks"].T, far, out=room("logits", self.blocks + 1, far.shape[1]))
                found, wrong = _chosen(x, block[low + split : high], slope, room("wrong", *x.shape))
                log[split:] += found
                if slope:
                    grad["blocks"] += (wrong @ far.T).T
                    into[:, split:] += p["blocks"][:h] @ wrong
            if split < most:
                far = own[:, split:most]
                spans = here[self.classes :] - split
                spans = list(zip(spans[:-1].tolist(), spans[1:].tolist()))
                ranks, blocks = rank[low + split : low + most], block[low + split : low + most]
                section = ranks // self.side
                for name, bias, at, place in (
                    ("sections", self.section_bias, blocks, section % self.side),
                    ("places", self.place_bias, section, ranks % self.side),
                ):
                    x = _products(p[name], far, spans, room("logits", self.side, most - split))
                    x += np.take(bias, at, axis=1)
                    found, wrong = _chosen(x, place, slope, room("wrong", *x.shape))
                    log[split:most] += found
                    if slope:
                        _slopes(grad[name], p[name], far, into[:, split:most], wrong, spans)
        back = np.empty(n, np.int64)
        back[order] = np.arange(n)
        if not slope:
            return logs[back], None
        out = self._room("back", kind, h, n)
        return logs[back], np.take(slopes, back, axis=1, out=out, mode="clip")

    def window(self, state: np.ndarray, words: np.ndarray, grad: dict[str, np.ndarray]) -> tuple:
        """One truncated window of ``(steps, lanes)`` words: adds to ``grad``, returns
        the state after it and the log probability of its words (-1 is no word)."""
        h, p = HIDDEN, self.part
        steps, lanes = words.shape
        kind = state.dtype
        flat = words.ravel()
        safe = np.where(flat < 0, self.words.end, flat)
        goes_on = ((flat >= 0) & (flat != self.words.end)).reshape(steps, lanes).astype(kind)
        # Each step's arrays lie together, so that they stay in a processor's cache.
        before = self._room("before", kind, steps + 1, h + 1, lanes)
        before[:, h] = 1.0
        before[0, :h] = state
        fed = self._feed(safe).reshape(3 * h, steps, lanes)
        kept = []
        for t in range(steps):
            after, *rest = self._step(before[t], fed[:, t])
            np.multiply(after, goes_on[t], out=before[t + 1, :h])
            kept.append(rest)
        states = self._room("states", kind, h + 1, steps, lanes)
        states[:] = before[:-1].transpose(1, 0, 2)
        states = states.reshape(h + 1, -1)
        if flat.min(initial=0) < 0:
            real = np.flatnonzero(flat >= 0)
            log, some = self._output(states[:, real], flat[real], grad)
            from_output = np.zeros((h, len(flat)), kind)
            from_output[:, real] = some
        else:
            log, from_output = self._output(states, flat, grad)
        from_output = from_output.reshape(h, steps, lanes)
        later = np.zeros((h, lanes), kind)
        d_fed = self._room("d_fed", kind, steps, 3 * h, lanes)
        again = p["again"][:h]
        for t in reversed(range(steps)):
            gates, fresh, back = kept[t]
            keep, reset = gates[:h], gates[h:]
            d = later * goes_on[t]
            held_back = d * keep
            own = d_fed[t]
            slope = 1 - gates
            slope *= gates
            d_keep = before[t, :h] - fresh
            d_keep *= d
            np.multiply(d_keep, slope[:h], out=own[:h])
            d -= held_back
            fresh *= fresh
            np.subtract(1, fresh, out=fresh)
            d_fresh = np.multiply(d, fresh, out=own[2 * h :])
            back *= d_fresh
            np.multiply(back, slope[h:], out=own[h : 2 * h])
            d_back = own.copy()
            d_back[2 * h :] *= reset
            grad["again"] += before[t] @ d_back.T
            later = again @ d_back
            later += held_back
            later += from_output[:, t]
        rows = self.row[safe].astype(np.int64)
        for feature in range(3 * h):
            np.add.at(grad["into"][feature], rows, d_fed[:, feature].ravel())
        return before[steps, :h].copy(), log

    def train(self, texts: list[np.ndarray], rate: float = RATE) -> None:
        """One pass of Adam over texts laid end to end in lanes."""
        stream = np.concatenate(texts)
        # Short streams get fewer lanes, so that the weights still move often.
        lanes = int(np.clip(len(stream) // (WINDOW * LEAST_STEPS), 8, LANES))
        length = -(-len(stream) // lanes)
        laid = np.full(lanes * length, -1, np.int32)
        laid[: len(stream)] = stream
        laid = laid.reshape(lanes, length).T
        state = np.zeros((HIDDEN, lanes), np.float32)
        mean, square = np.zeros_like(self.weights), np.zeros_like(self.weights)
        spare, flat = np.empty(SLICE, self.weights.dtype), np.empty_like(self.weights)
        for number, at in enumerate(range(0, length, WINDOW), start=1):
            flat.fill(0.0)
            state, log = self.window(state, laid[at : at + WINDOW], self.parts(flat))
            norm = float(np.linalg.norm(flat)) / max(len(log), 1)
            scale = min(1.0, 1.0 / (norm + 1e-9)) / max(len(log), 1)
            step = rate * math.sqrt(1 - 0.99**number) / (1 - 0.9**number)
            # Piece by piece, so that each stays in a processor's cache.
            for low in range(0, len(flat), SLICE):
                own = slice(low, low + SLICE)
                slope, first, second, move = flat[own], mean[own], square[own], spare[: len(flat[own])]
                slope *= scale
                # Sums that decay, 10 times the running mean and 100 times the running square.
                first *= 0.9
                first += slope
                second *= 0.99
                slope *= slope
                second += slope
                np.sqrt(second, out=move)
                move += 1e-5
                np.divide(first, move, out=move)
                move *= step
                self.weights[own] -= move

    def score(self, words: np.ndarray, starts: np.ndarray, lanes: int = 512) -> np.ndarray:
        """Natural log probability of each whole text, words beyond the head by block only."""
        n = len(starts) - 1
        sizes = np.diff(starts)
        total = np.zeros(n)
        # Longest first onto the lane that is free earliest, then windows over all lanes.
        order = np.argsort(-sizes, kind="stable")
        lanes = min(lanes, n)
        ends = np.zeros(lanes, np.int64)
        begin, lane_of = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for at in range(0, n, lanes):
            part = order[at : at + lanes]
            free = np.argsort(ends, kind="stable")[: len(part)]
            lane_of[part], begin[part] = free, ends[free]
            ends[free] += sizes[part]
        ranked = np.argsort(-ends, kind="stable")
        seat = np.empty(lanes, np.int64)
        seat[ranked] = np.arange(lanes)
        row = np.repeat(np.arange(n), sizes)
        step = np.arange(len(words)) - np.repeat(starts[:-1] - begin, sizes)
        busy = len(ends) - np.searchsorted(np.sort(ends), np.arange(int(ends.max(initial=0))), "right")
        bounds = np.concatenate(([0], np.cumsum(busy)))
        # Lanes are seated by falling end, so each step's words fill its first seats.
        grid = np.empty(len(words), np.int64)
        grid[bounds[step] + seat[lane_of][row]] = np.arange(len(words))
        h = HIDDEN
        state = np.ones((h + 1, lanes), np.float32)
        state[:h] = 0.0
        low = 0
        while low < len(busy):
            # Steps of about SCORE_WINDOW words together.
            high = max(low + 1, int(np.searchsorted(bounds, bounds[low] + SCORE_WINDOW, "right")) - 1)
            own = grid[bounds[low] : bounds[high]]
            seen = words[own]
            fed = self._feed(seen)
            goes_on = (seen != self.words.end).astype(np.float32)
            before = self._room("before", state.dtype, h + 1, len(own))
            for t in range(low, high):
                a, b = bounds[t] - bounds[low], bounds[t + 1] - bounds[low]
                state = state[:, : b - a]
                before[:, a:b] = state
                after = self._step(state, fed[:, a:b])[0]
                np.multiply(after, goes_on[a:b], out=state[:h])
            total += np.bincount(row[own], self._output(before, seen, None)[0], n)
            low = high
        return total


def _with_one(states: np.ndarray) -> np.ndarray:
    return np.concatenate((states, np.ones((1, states.shape[1]), states.dtype)))


def _chosen(
    x: np.ndarray, place: np.ndarray, slope: bool, room: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Log softmax of each column of ``x`` at ``place`` and, with ``slope``, the loss's
    gradient, which lies in ``room``. Logits are shifted only if their exponentials sum to
    too much or too little."""
    at = place * x.shape[1] + np.arange(x.shape[1])
    out = x.ravel().take(at)
    with np.errstate(over="ignore"):
        total = np.exp(x, out=room).sum(0)
    if not (total.min(initial=1.0) > 1e-26 and total.max(initial=1.0) < 1e26):
        top = x.max(0)
        x -= top
        out -= top
        total = np.exp(x, out=room).sum(0)
    if slope:
        room *= 1.0 / total
        room.ravel()[at] -= 1.0
    return out - np.log(total), room


def _products(tables, held: np.ndarray, spans: list, out: np.ndarray) -> np.ndarray:
    """Logits of the first columns, each span by its own table."""
    for table, (a, b) in zip(tables, spans):
        if b > a:
            np.matmul(table, held[:, a:b], out=out[:, a:b])
    return out


def _slopes(grads, tables, held: np.ndarray, into: np.ndarray, wrong: np.ndarray, spans: list) -> None:
    for grad, table, (a, b) in zip(grads, tables, spans):
        if b > a:
            own = wrong[:, a:b]
            grad += own @ held[:, a:b].T
            into[:, a:b] += table[:, :-1].T @ own


def number_texts(rows: DataFrame, words: Vocabulary) -> DataFrame:
    """Every row's word numbers and all that follows from counts, written once.

    Training and scoring read the numbers; keys of words beyond the head stay beside
    them, to be joined with their counts.
    """

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        places = words.starts()
        # By word number; words beyond the head come last.
        logs = np.append(np.log10(words.member_counts + SMOOTH), 0.0)
        for batch in bounded(batches, "text"):
            keys, starts = tokens(batch.column("text"))
            numbers = words.look_up(keys, places)
            n, sizes = batch.num_rows, np.diff(starts)
            tail = numbers == words.members
            # Every text has its end, so none is empty.
            in_tail = np.add.reduceat(tail, starts[:-1], dtype=np.int64)
            ends = np.concatenate(([0], np.cumsum(in_tail))).astype(np.int32)
            yield pa.RecordBatch.from_pydict(
                {
                    "row": row + np.arange(n),
                    "doc_id": batch.column("id"),
                    "held_out": batch.column("held_out"),
                    "dice": batch.column("dice"),
                    "n_tokens": sizes,
                    "n_tail": in_tail,
                    "base_log": np.add.reduceat(logs[numbers], starts[:-1]) - sizes * words.base_log,
                    "words": pa.Array.from_buffers(
                        pa.binary(),
                        n,
                        [None, pa.py_buffer((starts * 4).astype(np.int32)), pa.py_buffer(numbers)],
                    ),
                    "tail": pa.ListArray.from_arrays(pa.array(ends), pa.array(keys[tail].view(np.int64))),
                }
            )
            row += n

    dice = F.xxhash64("id", "text").alias("dice")
    return materialize(
        rows.select("id", "held_out", dice, "text").mapInArrow(
            number,
            "row long, doc_id long, held_out boolean, dice long, n_tokens long, n_tail long, "
            "base_log double, words binary, tail array<bigint>",
        ),
        "word-numbers",
    )


def _add_slices(rows: pa.Table) -> pa.Table:
    total = np.zeros(len(rows["sums"][0].as_py()) // 8)
    for one in rows["sums"]:
        total += np.frombuffer(one.as_py(), np.float64)
    n = sum(rows["n"].to_pylist())
    return pa.table(
        {"slice": rows["slice"][:1], "shard": rows["shard"][:1], "n": [n], "sums": [total.tobytes()]}
    )


def train_model(numbered: DataFrame, words: Vocabulary) -> Model:
    """Averaged weights of shards that learn side by side, ``ROUNDS`` times.

    ``numbered`` has the columns ``dice`` and ``words`` of :func:`number_texts`. The dice
    deal the rows over the rounds, so that each is learnt from once. A shard holds about
    ``SHARD_ROWS`` rows. Weights move as slices of packed numbers, which are summed
    ``FAN_IN`` at a time until one row a slice is left for the driver.
    """
    model = Model(words)
    if not words.members:
        return model
    for number in range(ROUNDS):
        chosen = numbered.where(F.pmod(F.shiftright("dice", 40), F.lit(ROUNDS)) == number)
        shards = max(1, round(chosen.count() / SHARD_ROWS))
        weights = model.weights

        def learn(rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values(["dice", "words"])
            own = Model(words, weights)
            own.train([np.frombuffer(one, np.int32) for one in rows["words"]])
            learnt = own.weights.astype(np.float64)
            parts = [learnt[at : at + SLICE].tobytes() for at in range(0, len(learnt), SLICE)]
            shard = int(rows["shard"].iloc[0])
            return pd.DataFrame({"slice": range(len(parts)), "shard": shard, "n": 1, "sums": parts})

        kind = "slice int, shard long, n long, sums binary"
        sums = (
            chosen.select("dice", "words")
            .withColumn("shard", F.pmod(F.shiftright("dice", 20), F.lit(shards)))
            .repartitionById(shards, F.col("shard").cast("int"))
            .groupBy("shard")
            .applyInPandas(learn, kind)
        )
        groups = shards
        while groups > 1:
            groups = -(-groups // FAN_IN)
            sums = (
                sums.withColumn("shard", F.floor(F.col("shard") / FAN_IN))
                .groupBy("slice", "shard")
                .applyInArrow(_add_slices, kind)
            )
        learnt = sums.orderBy("slice").toArrow()
        if learnt.num_rows:
            n = learnt["n"][0].as_py()
            total = np.frombuffer(b"".join(learnt["sums"].to_pylist()), np.float64)
            model = Model(words, (total / n).astype(np.float32))
    return model


def score_texts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` per row.

    Learns from the rows that are not held out, then scores all. Tail words are the
    only ones that move: their counts are joined by key, summed by row.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("id"),
        F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"),
        held_out(F.col(f"`{id_col}`")).alias("held_out"),
    )
    counts = materialize(count_words(rows.where(~F.col("held_out")), "text"), "word-counts")
    words = read_vocabulary(counts)
    numbered = number_texts(rows, words)
    weights = train_model(numbered.where(~F.col("held_out")), words).weights

    kept = ["row", "doc_id", "held_out", "n_tokens", "n_tail", "base_log"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(words, weights)
        for batch in bounded(batches, "words"):
            numbers = np.frombuffer(b"".join(batch.column("words").to_pylist()), np.int32)
            starts = np.concatenate(([0], np.cumsum(batch.column("n_tokens").to_numpy())))
            model_log = own.score(numbers, starts) / math.log(10)
            # Counts of words beyond the head are joined.
            model_log -= batch.column("n_tail").to_numpy() * words.tail_log
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(name) for name in kept], pa.array(model_log)], [*kept, "model_log"]
            )

    scored = numbered.select(*kept, "words").mapInArrow(
        score,
        "row long, doc_id long, held_out boolean, n_tokens long, n_tail long, base_log double, "
        "model_log double",
    )
    tails = (
        numbered.select("row", F.explode("tail").alias("key"))
        .join(counts, "key", "left")
        .groupBy("row")
        .agg(
            F.count("c").alias("tail_known"),
            F.sum(F.log10(F.coalesce(F.col("c"), F.lit(0)) + SMOOTH)).alias("tail_log"),
        )
    )
    tail_log = F.coalesce("tail_log", F.lit(0.0))
    return scored.join(tails, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_tokens") - F.col("n_tail") + F.coalesce("tail_known", F.lit(0))).alias("n_known"),
        F.lit(words.total).cast("long").alias("train_tokens"),
        (F.col("base_log") + tail_log).alias("base_score"),
        (F.col("model_log") + tail_log).alias("score"),
    )
