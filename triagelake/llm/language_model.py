"""Language-model scoring by a weighted backoff automaton whose counts come from the whole corpus.

Model. Every n-gram below the highest order that training texts hold is a state; the empty history is the root. State h has an arc for
each word w that follows it in training, with weight log10 P(w|h), to the state of the longest history that w ends. What it has no arc
for goes along its failure arc, with weight log10(m / (c(h) + m)), to the state of its suffix h'. Counts are smoothed towards the
shorter history, P(w|h) = (c(hw) + m P(w|h')) / (c(h) + m), and at the root P(w) = (c(w) + 1) / (N + V + 1), so the weights of every
state, those behind its failure arc included, sum to 1. ``Automaton`` holds states, arcs and failure arcs as arrays; ``Automaton.walk``
goes over texts once from left to right, carries the state and adds up the weights it passes, failure arcs included.
Many texts advance together, a word at a time. A long text is cut into pieces that advance together too: each starts
order - 1 words early, and as no state is longer than that, it is in the text's own state when its own words begin.

Distribution. No machine holds the model. The texts are written as blocks of about ``BLOCK_CHARS`` characters, cut by size alone. Each
block sends its distinct n-grams with its training counts to hash ranges; a range adds up the blocks' counts and answers each block with
the totals of just the n-grams it asked for; the block builds its part of the automaton and walks its texts. Hashes and
counts travel as compressed byte planes, about four bytes for an n-gram. Only ranges that a block has n-grams of get a message, so
there are never more messages than distinct n-grams of blocks, however large the corpus. A frequent n-gram is one entry for each block,
so no group outgrows a task. The driver gets four sums.

Hashes keep 20 bits more than it takes to number the corpus's words (``LEAST_BITS`` at least, 64 at most): up to 2^44 words, an n-gram
shares its hash, and so its count, with another with a chance of about 1e-6.

Cases: a null or blank text is its end token alone. Rows with a null id are scored and never trained on. Without any training
row every probability is that of an unknown word. Repeated rows are trained on and scored as often as they occur. Empty tables give
no rows. Only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordArrays, filled, hash_slot, segment_sums, written

ORDER = 3
#: Pseudo-count m of the smoothing: how many observations of a history the shorter history's estimate is worth.
PRIOR = 4.0
BLOCK_CHARS = 5_000_000
#: Words that a piece of a text advances; the longest text is in no more steps than this and the order.
PIECE = 64
LEAST_BITS = 48
_END = np.uint64(0x8E5F3C1D2B4A6978)
_START = np.uint64(0x1D2C3B4A59687786)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def squeezed(values: np.ndarray) -> bytes:
    """64-bit numbers as compressed byte planes: planes of zeros or slowly rising bytes take next to nothing."""
    return pa.compress(np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8).T), codec="zstd", asbytes=True)


def restored(data: bytes, size: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, 8 * size, codec="zstd"), np.uint8).reshape(8, size)
    return np.ascontiguousarray(planes.T).view(np.uint64).ravel()


class Block:
    """Tokens of a block's texts, and the n-grams that end at each. Of order n, ``grams[n]`` are the distinct ones, sorted by hash, ``ends[n]``
    the positions that end one (n tokens, a start counted in), ``own[n]`` which one ends there, and ``one[n]`` a position for each."""

    def __init__(self, texts: pa.Array, order: int, bits: int):
        words = WordArrays(pc.ascii_lower(texts))
        hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in words.distinct.to_pylist()), np.uint64, len(words.distinct))
        mask = np.uint64(((1 << bits) - 1) << (64 - bits))
        self.counts = words.counts + 1
        self.offsets = np.concatenate(([0], np.cumsum(self.counts)))
        tokens = np.full(self.offsets[-1], _END)
        inside = np.ones(len(tokens), dtype=bool)
        inside[self.offsets[1:] - 1] = False
        tokens[inside] = hashes[words.codes]
        self.place = np.arange(len(tokens)) - np.repeat(self.offsets[:-1], self.counts)
        self.grams, self.ends, self.own, self.one = {}, {}, {}, {}
        before = tokens
        for n in range(1, order + 1):
            if n > 1:
                history = np.empty_like(before)
                history[1:] = before[:-1]
                history[self.place == 0] = _START
                before = _mix(history * np.uint64(0x9E3779B97F4A7C15) + tokens + np.uint64(n))
            ends = np.flatnonzero(self.place >= n - 2)
            hashes = before[ends] & mask
            sort = np.argsort(hashes)
            hashes = hashes[sort]
            first = np.concatenate((np.ones(min(1, len(ends)), dtype=bool), hashes[1:] != hashes[:-1]))
            own = np.empty(len(ends), dtype=np.int64)
            own[sort] = np.cumsum(first) - 1
            self.grams[n], self.ends[n], self.own[n], self.one[n] = hashes[first], ends, own, ends[sort[first]]

    def learnt(self, n: int, train: np.ndarray) -> np.ndarray:
        """How often each n-gram ends at a position of ``train``."""
        return np.bincount(self.own[n][train[self.ends[n]]], minlength=len(self.grams[n]))


def _distinct(values: np.ndarray) -> np.ndarray:
    ranked = np.sort(values)
    return ranked[np.concatenate(([True], ranked[1:] != ranked[:-1]))] if len(ranked) else ranked


@dataclass
class Automaton:
    """The part of the model that a block's texts can reach. State 0 is the root, state 1 the start of a text; word codes are those of
    ``Block.grams[1]``. Arcs of states other than the root are sorted by ``state * words + word``; the root has one for every word."""

    words: int
    keys: np.ndarray
    weights: np.ndarray
    targets: np.ndarray
    root_weights: np.ndarray
    root_targets: np.ndarray
    failure: np.ndarray
    failure_weights: np.ndarray
    order: int

    @classmethod
    def build(cls, block: Block, totals: dict[int, np.ndarray], tokens: int, vocabulary: int, texts: int, prior: float) -> Automaton:
        """From the corpus-wide totals of the block's n-grams; texts: training documents, which is how often a start occurs."""
        order = max(totals)
        word, words = block.own[1], len(block.grams[1])
        chance = (totals[1] + 1) / (tokens + vocabulary + 1)
        root_weights, root_targets = np.log10(chance), np.zeros(words, dtype=np.int64)
        failure, passed = [np.zeros(2, dtype=np.int64)], [np.array([0.0, np.log10(prior / (texts + prior))])]
        if order > 1:
            root_targets = np.where(totals[1] > 0, 2 + np.arange(words), 0)
            failure.append(np.zeros(words, dtype=np.int64))
            passed.append(np.log10(prior / (totals[1] + prior)))
        # Of the n-gram at each position: its number, its state and how often it occurs; at first those of single words.
        number, state, count = word, root_targets[word], totals[1][word]
        keys, weights, targets, behind = [], [], [], 2 + words
        for n in range(2, order + 1):
            ends, own, one = block.ends[n], block.own[n], block.one[n]
            first = block.place[one] == 0
            source = np.where(first, 1, state[one - 1])
            seen = np.where(first, texts, count[one - 1])
            # The shorter history knows the word wherever this one does, so its n-gram has a chance of its own.
            chance = (totals[n] + prior * chance[number[one]]) / (seen + prior)
            known = np.flatnonzero(totals[n] > 0)
            keys.append(source[known] * words + word[one[known]])
            weights.append(np.log10(chance[known]))
            if n < order:
                states = np.where(totals[n] > 0, behind + np.arange(len(one)), state[one])
                failure.append(state[one])
                passed.append(np.log10(prior / (totals[n] + prior)))
                behind += len(one)
            else:
                states = state[one]
            targets.append(states[known])
            number, state, count = (_spread(x, ends, len(word)) for x in (own, states[own], totals[n][own]))
        keys, weights, targets = (np.concatenate([*x, np.zeros(0, kind)]) for x, kind in ((keys, np.int64), (weights, np.float64), (targets, np.int64)))
        sort = np.argsort(keys)
        return cls(words, keys[sort], weights[sort], targets[sort], root_weights, root_targets, np.concatenate(failure), np.concatenate(passed), order)

    def advance(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The weight that each of many walkers passes as it reads its word, and its next state."""
        weight, after = np.zeros(len(state)), np.zeros(len(state), dtype=np.int64)
        state, walkers = state.copy(), np.arange(len(state))
        while len(walkers):
            here, read = state[walkers], word[walkers]
            at_root = here == 0
            done = walkers[at_root]
            weight[done] += self.root_weights[word[done]]
            after[done] = self.root_targets[word[done]]
            walkers, here, read = walkers[~at_root], here[~at_root], read[~at_root]
            if not len(walkers):
                break
            key = here * self.words + read
            arc = np.minimum(np.searchsorted(self.keys, key), max(len(self.keys) - 1, 0))
            hit = self.keys[arc] == key if len(self.keys) else np.zeros(len(key), dtype=bool)
            weight[walkers[hit]] += self.weights[arc[hit]]
            after[walkers[hit]] = self.targets[arc[hit]]
            walkers, here = walkers[~hit], here[~hit]
            weight[walkers] += self.failure_weights[here]
            state[walkers] = self.failure[here]
        return weight, after

    def walk(self, words: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The weight passed at each token; texts lie between neighbouring offsets."""
        out = np.empty(len(words))
        lengths = np.diff(offsets)
        pieces = -(-lengths // PIECE)
        nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        own = np.repeat(offsets[:-1], pieces) + PIECE * nth
        end = np.minimum(own + PIECE, np.repeat(offsets[1:], pieces))
        at = np.where(nth > 0, own - (self.order - 1), own)
        state = np.where(nth > 0, 0, 1 if self.order > 1 else 0)
        while len(at):
            weight, state = self.advance(state, words[at])
            counts = at >= own
            out[at[counts]] = weight[counts]
            at = at + 1
            on = at < end
            at, own, end, state = at[on], own[on], end[on], state[on]
        return out


def _spread(values: np.ndarray, places: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros(size, dtype=np.int64)
    out[places] = values
    return out


BLOCKS = "block long, chars long, texts long, docs binary"
ASKED = pa.schema([("n", pa.int32()), ("range", pa.int64()), ("block", pa.int64()), ("size", pa.int64()), ("grams", pa.binary()), ("counts", pa.binary())])
ANSWERED = pa.schema([("block", pa.int64()), ("n", pa.int32()), ("range", pa.int64()), ("size", pa.int64()), ("totals", pa.binary()), ("vocabulary", pa.int64()), ("tokens", pa.int64())])
SCORED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def _blocks(docs: DataFrame, hold_out: int, held: int, block_chars: int) -> DataFrame:
    """Rows of (doc_id, text, train, held_out) in compressed blocks of about ``block_chars`` characters, in a table: blocks are named by
    where they were cut, so they must not be cut again. A longer text is a block of its own."""
    slot = hash_slot("doc_id", hold_out)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.select("doc_id", "text", F.coalesce(slot != held, F.lit(False)).alias("train"), F.coalesce(slot == held, F.lit(False)).alias("held_out"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, held_rows, chars = TaskContext.get().partitionId() << 32, [], 0

        def emit() -> pa.RecordBatch:
            table, sink = pa.Table.from_batches(held_rows), pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
                stream.write_table(table)
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([chars]), pa.array([pc.sum(table["train"]).as_py() or 0]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block", "chars", "texts", "docs"])

        for batch in batches:
            sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column("text")), 0), dtype=np.int64)
            start = 0
            while start < batch.num_rows:
                room = int(np.searchsorted(np.cumsum(sizes[start:]), block_chars - chars, side="right"))
                stop = min(batch.num_rows, start + max(room, 0 if held_rows else 1))
                if stop > start:
                    held_rows.append(batch.slice(start, stop - start))
                    chars += int(sizes[start:stop].sum())
                    start = stop
                if start < batch.num_rows:
                    yield emit()
                    name, held_rows, chars = name + 1, [], 0
        if held_rows:
            yield emit()

    return written(rows.mapInArrow(cut, BLOCKS), "blocks")


def _opened(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def _total(table: pa.Table) -> pa.Table:
    """Counts of a hash range added up over blocks, dealt back in the order in which each block asked."""
    first = table["n"][0].as_py() == 1
    sizes = table["size"].to_pylist()
    asked = [restored(g, size) for g, size in zip(table["grams"].to_pylist(), sizes, strict=True)]
    distinct = _distinct(np.concatenate(asked))
    totals = np.zeros(len(distinct), dtype=np.int64)
    places = []
    for grams, counts in zip(asked, table["counts"].to_pylist(), strict=True):
        places.append(np.searchsorted(distinct, grams))
        totals[places[-1]] += restored(counts, len(grams)).view(np.int64)
    vocabulary, tokens = (int((totals > 0).sum()), int(totals.sum())) if first else (0, 0)
    return pa.Table.from_arrays([table["block"], table["n"], table["range"], table["size"], pa.array([squeezed(totals[p]) for p in places], pa.binary()), pa.array([vocabulary] * len(sizes), pa.int64()), pa.array([tokens] * len(sizes), pa.int64())], schema=ANSWERED)


def score_documents(docs: DataFrame, hold_out: int = 7, held: int = 2, order: int = ORDER, prior: float = PRIOR, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row for each document: token counts, the unigram base score and the model's score, trained on crc32(id) mod hold_out <> held."""
    blocks = _blocks(docs, hold_out, held, block_chars)
    known = blocks.agg(F.count("*").alias("blocks"), F.sum("chars").alias("chars"), F.sum("texts").alias("texts")).first()
    # About as many ranges as texts have blocks' worth of characters: a range adds up about as many n-grams as a block has.
    range_bits, texts = max(0, -(-(known["chars"] or 0) // block_chars) - 1).bit_length(), known["texts"] or 0
    # A word and its blank are two characters at least.
    bits = min(64, max(LEAST_BITS, 20 + max(1, (known["chars"] or 0) // 4).bit_length()))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column("block").to_pylist(), batch.column("docs"), strict=True):
                table = _opened(data.as_buffer())
                block = Block(filled(table["text"]), order, bits)
                train = np.repeat(np.asarray(table["train"]).astype(bool), block.counts)
                for n in range(1, order + 1):
                    grams, counts = block.grams[n], block.learnt(n, train).astype(np.int64)
                    # The hash's first bits are the range; n-grams are sorted by hash, so a range's are neighbours.
                    sent = (grams >> np.uint64(64 - range_bits)).astype(np.int64) if range_bits else np.zeros(len(grams), dtype=np.int64)
                    cuts = np.concatenate(([0], np.flatnonzero(np.diff(sent)) + 1, [len(grams)])) if len(grams) else np.zeros(1, dtype=np.int64)
                    parts = [slice(a, b) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array([n] * len(parts), pa.int32()), pa.array(sent[cuts[:-1]], pa.int64()), pa.array([name] * len(parts), pa.int64()), pa.array(np.diff(cuts), pa.int64()), pa.array([squeezed(grams[p]) for p in parts], pa.binary()), pa.array([squeezed(counts[p]) for p in parts], pa.binary())], schema=ASKED)

    asked = blocks.select("block", "docs").mapInArrow(ask, "n int, range long, block long, size long, grams binary, counts binary")
    answered = written(asked.groupBy("n", "range").applyInArrow(_total, "block long, n int, range long, size long, totals binary, vocabulary long, tokens long"), "totals")
    sums = answered.filter("n = 1").select("range", "vocabulary", "tokens").distinct().agg(F.sum("vocabulary"), F.sum("tokens")).first()
    vocabulary, tokens = sums[0] or 0, sums[1] or 0

    def score(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return SCORED.empty_table()
        table = _opened(left["docs"][0].as_buffer())
        block = Block(filled(table["text"]), order, bits)
        totals = {n: [] for n in range(1, order + 1)}
        for n, _, size, data in sorted(zip(right["n"].to_pylist(), right["range"].to_pylist(), right["size"].to_pylist(), right["totals"].to_pylist(), strict=True), key=lambda x: x[:2]):
            totals[n].append(restored(data, size).view(np.int64))
        totals = {n: np.concatenate([*x, np.zeros(0, np.int64)]) for n, x in totals.items()}
        automaton = Automaton.build(block, totals, tokens, vocabulary, texts, prior)
        word = block.own[1]
        counts = totals[1][word]
        base = segment_sums(np.log10((counts + 1) / (tokens + vocabulary + 1)), block.offsets)
        full = segment_sums(automaton.walk(word, block.offsets), block.offsets)
        n_known = segment_sums(counts > 0, block.offsets).astype(np.int64)
        return pa.Table.from_arrays([table["doc_id"], table["held_out"], pa.array(block.counts), pa.array(n_known), pa.array(np.full(len(block.counts), tokens, dtype=np.int64)), pa.array(base), pa.array(full)], schema=SCORED)

    answers = answered.select("block", "n", "range", "size", "totals")
    return blocks.select("block", "docs").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
