"""Sequence packing as vector bin packing: tokens, segments and loss-bearing tokens are limited at once.

Each partition of the input is packed in one stream, so nothing is shuffled and memory is one window of examples. Whole sequences'
worth of a long document are cut off first. What remains waits in a window of ``WINDOW`` examples; a sequence opens with the largest
and takes, by the dot-product heuristic, the fitting example whose demands (as shares of the limits) align best with the remaining
capacities. When no whole example fits, those with the most tokens that still do are cut to fill the gap. A sequence that runs out of segments, and what is left at a
partition's end, is cut to powers of two, the lengths that need no padding.

Loss-bearing tokens: of a document, those behind its first ``CONTEXT`` share, as in instruction data the answer behind the prompt. A sequence holds
``LOSS`` of them at most, which binds: the later part of a long document bears loss throughout and shares its sequences with context of others.

Token ids come from a public tokenizer whose words never cross white space, so each distinct word is encoded once and kept in a
worker's bounded cache; ids are then gathered by numpy.

A sequence's id is its partition's number followed by its own within it: a task that runs again packs the same rows to the same ids.

Cases: a null or blank text is its end id alone. Null ids are packed like others. Repeated rows are packed as often as they
occur. Very long texts are tokenized whole, slice by slice of their batch. Empty tables give no rows. Only the id and text columns
are read.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import STAGE_BYTES, WordArrays, filled, slices

TOKENS = 4096
SEGMENTS = 128
#: Loss-bearing tokens of a sequence, and the share of a document's tokens that is context and bears none.
LOSS = 3072
CONTEXT = 0.5
END_ID = 2
WINDOW = 512
#: Runs of letters that a worker keeps from slice to slice; a larger cache is emptied.
CACHE_WORDS = 300_000


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: Words of which the letters can be lower-cased alone (their composed form is themselves) and whose marks only follow the letters.
PLAIN = "^(?P<core>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<tail>[!-/:-@\\[-`{-~]*)$"


class WordTokenizer:
    """Ids of texts from a tokenizer that encodes each word between white space on its own, and letters apart from marks.

    A plain word is its lower-cased letters and its marks, which the tokenizer never joins; other words are encoded whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self.encode = tokenizer.encode_batch_fast
        vocabulary = tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)  # ids that end a run of letters or marks
        self.ends[[i for piece, i in vocabulary.items() if piece.endswith("</w>")]] = True
        self._clear()

    def _clear(self) -> None:
        self.known: tuple[dict[str, int], dict[str, int]] = {}, {}  # letters, others
        self.ids = np.zeros(1 << 16, dtype=np.uint32)
        self.starts = np.zeros(1, dtype=np.int64)  # bounds of each known unit in ids

    def _store(self, ids: np.ndarray, lengths: np.ndarray) -> None:
        ends = self.starts[-1] + np.cumsum(lengths)
        if ends[-1] > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros(max(len(self.ids), int(ends[-1]) - len(self.ids)), dtype=np.uint32)))
        self.ids[self.starts[-1] : ends[-1]] = ids
        self.starts = np.concatenate((self.starts, ends))

    def _places(self, units: list[str], kind: int) -> np.ndarray:
        """Where each unit stands, after learning those not yet known."""
        known = self.known[kind]
        new = list(dict.fromkeys(u for u in units if u not in known))
        for at in range(0, len(new), 50_000):
            part = new[at : at + 50_000]
            if kind:
                encoded = [e.ids for e in self.encode(part, add_special_tokens=False)]
                lengths = np.fromiter(map(len, encoded), np.int64, len(encoded))
                ids = np.fromiter((i for e in encoded for i in e), np.uint32, int(lengths.sum()))
            else:
                # Runs of letters are encoded many at a time: each ends with an end-of-word id, and only there.
                joined = [" ".join(part[i : i + 500]) for i in range(0, len(part), 500)]
                ids = np.concatenate([np.array(e.ids, dtype=np.uint32) for e in self.encode(joined, add_special_tokens=False)])
                last = np.flatnonzero(self.ends[ids])
                lengths = np.diff(np.concatenate(([-1], last)))
                if len(lengths) != len(part):
                    raise ValueError("the tokenizer does not mark the ends of words")
            first = len(self.starts) - 1
            self._store(ids, lengths)
            known.update(zip(part, range(first, first + len(part)), strict=True))
        return np.fromiter(map(known.__getitem__, units), np.int64, len(units))

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and the texts' bounds in them."""
        words = WordArrays(texts)
        if len(self.known[0]) > CACHE_WORDS:
            self._clear()
        parts = pc.extract_regex(words.distinct, pattern=PLAIN)
        core = pc.utf8_lower(pc.struct_field(parts, "core"))
        plain = np.asarray(pc.is_valid(core)).astype(bool)
        head, tail = np.zeros(len(plain), dtype=np.int64), np.full(len(plain), self._places([""], 1)[0])
        coded = core.filter(pa.array(plain)).dictionary_encode()
        head[plain] = self._places(coded.dictionary.to_pylist(), 0)[np.asarray(coded.indices)]
        coded = pc.struct_field(parts, "tail").filter(pa.array(plain)).dictionary_encode()
        tail[plain] = self._places(coded.dictionary.to_pylist(), 1)[np.asarray(coded.indices)]
        head[~plain] = self._places(words.distinct.filter(pa.array(~plain)).to_pylist(), 1)
        units = np.stack((head, tail), axis=1)[words.codes].ravel()
        lengths = self.starts[units + 1] - self.starts[units]
        ends = np.concatenate(([0], np.cumsum(lengths)))
        index = np.repeat(self.starts[units] - ends[:-1], lengths)
        index += np.arange(ends[-1])
        return self.ids[index], ends[2 * words.offsets]


@lru_cache(1)
def worker_tokenizer(path: str | None) -> WordTokenizer:
    """One for each Python worker, so that its words stay known from task to task."""
    return WordTokenizer(path or tokenizer_path())


class Packer:
    """Packs a stream of examples under the limits; yields (key, start, length, sequence, offset).

    An example's loss-bearing tokens are all (None), those from a position on (a number), or those that flags mark (an array)."""

    def __init__(self, tokens: int = TOKENS, segments: int = SEGMENTS, loss: int | None = None, window: int = WINDOW, first: int = 0):
        self.limits = np.array([tokens, segments, loss or tokens], dtype=np.int64)
        self.window, self.sequence = window, first
        self.waiting: list[tuple] = []  # (key, start, length, where loss begins or its running sums)

    @staticmethod
    def _loss(piece: tuple, start: int, length: int) -> int:
        sums = piece[3]
        return max(0, start + length - max(start, sums)) if isinstance(sums, int) else int(sums[start + length] - sums[start])

    @staticmethod
    def _within(piece: tuple, start: int, loss: int) -> int:
        """How many tokens from ``start`` hold ``loss`` loss-bearing ones at most."""
        sums = piece[3]
        return max(0, sums - start) + loss if isinstance(sums, int) else int(np.searchsorted(sums, sums[start] + loss, side="right")) - 1 - start

    def add(self, key, length: int, loss: np.ndarray | int | None = None) -> Iterator[tuple]:
        sums = 0 if loss is None else int(loss) if np.isscalar(loss) else np.concatenate(([0], np.cumsum(loss)))
        example, start, most = (key, 0, length, sums), 0, int(self.limits[0])
        while length - start >= most and self._loss(example, start, most) <= self.limits[2]:
            yield from self._close([(key, start, most, sums)])
            start += most
        while length - start >= most or length > start and self._loss(example, start, length - start) > self.limits[2]:
            # more loss-bearing tokens than one sequence may hold: as many as fit become an example
            part = min(most, self._within(example, start, int(self.limits[2])))
            self.waiting.append((key, start, part, sums))
            start += part
        if length > start:
            self.waiting.append((key, start, length - start, sums))
        while len(self.waiting) >= self.window:
            yield from self._pack(self.window // 2)

    def finish(self) -> Iterator[tuple]:
        while self.waiting:
            yield from self._pack(0)

    def _close(self, pieces: list[tuple]) -> Iterator[tuple]:
        offset = 0
        for key, start, length, _ in pieces:
            yield key, start, length, self.sequence, offset
            offset += length
        self.sequence += 1

    def _cut(self, pieces: list[tuple], size: int) -> tuple[list[tuple], list[tuple]]:
        """The first ``size`` tokens of some pieces, and the rest."""
        head, rest = [], []
        for key, start, length, sums in pieces:
            taken = min(length, size)
            size -= taken
            if taken:
                head.append((key, start, taken, sums))
            if taken < length:
                rest.append((key, start + taken, length - taken, sums))
        return head, rest

    def _pack(self, leave: int) -> Iterator[tuple]:
        """Sequences from the waiting examples until ``leave`` of them are left."""
        waiting = self.waiting
        demand = np.array([(p[2], 1, self._loss(p, p[1], p[2])) for p in waiting], dtype=np.int64)
        context = np.array([min(p[2], self._within(p, p[1], 0)) for p in waiting], dtype=np.int64)
        free = np.ones(len(waiting), dtype=bool)
        back: list[tuple] = []
        while free.sum() > leave:
            room, pieces = self.limits.copy(), []
            pick = int(np.where(free, demand[:, 0], -1).argmax())
            while pick >= 0:
                pieces.append(waiting[pick])
                room -= demand[pick]
                free[pick] = False
                fits = free & (demand <= room).all(axis=1)
                pick = int(np.where(fits, (demand / self.limits) @ (room / self.limits), -1).argmax()) if room[0] and fits.any() else -1
            while room[0] and room[1] and free.any():
                # no whole example fits: cut the one of which most tokens do, as far as its loss-bearing ones allow
                most = int(np.where(free, np.minimum(context + room[2], demand[:, 0]), -1).argmax())
                key, start, length, sums = waiting[most]
                gap = min(int(room[0]), self._within(waiting[most], start, int(room[2])))
                if not 0 < gap < length:
                    break
                head, waiting[most] = (key, start, gap, sums), (key, start + gap, length - gap, sums)
                pieces.append(head)
                room -= (gap, 1, self._loss(head, start, gap))
                demand[most] = (length - gap, 1, self._loss(waiting[most], start + gap, length - gap))
                context[most] = min(length - gap, self._within(waiting[most], start + gap, 0))
            total = int(self.limits[0] - room[0])
            if room[0]:
                head, rest = self._cut(pieces, 1 << (total.bit_length() - 1))
                back += rest
                yield from self._close(head)
            else:
                yield from self._close(pieces)
            if not free.any() and back and not leave:
                break
        self.waiting = [p for p, f in zip(waiting, free, strict=True) if f] + back


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack_documents(docs: DataFrame, tokenizer: str | None = None, tokens: int = TOKENS, segments: int = SEGMENTS, end_id: int = END_ID, loss: int = LOSS, context: float = CONTEXT) -> DataFrame:
    """One row for each piece of a document: where it lies in the document and in its sequence, and the checksum of its ids."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = worker_tokenizer(tokenizer)
        packer = Packer(tokens, segments, loss, first=TaskContext.get().partitionId() << 40)
        held: dict[int, list] = {}  # of documents not wholly packed: id, ids, tokens not yet packed
        number = 0

        def rows(pieces: Iterator[tuple]) -> list[tuple]:
            out = []
            for key, start, length, sequence, offset in pieces:
                doc_id, ids, left = held[key]
                out.append((doc_id, start, length, zlib.crc32(ids[start : start + length].tobytes()), len(ids), sequence, offset))
                held[key][2] = left - length
                if left == length:
                    del held[key]
            return out

        def batch_of(found: list[tuple]) -> pa.RecordBatch:
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*found, strict=True) if found else [[]] * len(names))], names=names)

        for batch in batches:
            for part in slices(batch, limit=STAGE_BYTES):
                ids, bounds = encode(filled(part.column("text")))
                found: list[tuple] = []
                for i, doc_id in enumerate(part.column("doc_id").to_pylist()):
                    own = np.append(ids[bounds[i] : bounds[i + 1]], np.uint32(end_id)).astype("<u4")
                    held[number] = [doc_id, own, len(own)]
                    found += rows(packer.add(number, len(own), int(len(own) * context)))
                    number += 1
                yield batch_of(found)
        yield batch_of(rows(packer.finish()))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(pack, SCHEMA)
