"""SentencePiece encoding and decoding by a batched numpy Viterbi search.

A text becomes chunks that no piece can cross: blanks followed by other characters, and single characters outside the vocabulary
(written as byte pieces). Distinct chunks of equal length advance together: at each end position the hashes of the substrings that
end there probe the sorted piece keys, and vectorised maxima store a backpointer to the best piece. The vocabulary is of the merging
kind, whose encoding is one certain path: a piece may follow another only if merging in rank order would have left that boundary
alone. So a path scores 0, a boundary that merging would have crossed scores minus infinity, and exactly one path to each end
is left, which makes the ids equal to the library's. Whether two pieces may stand side by side is found by walking down their merge trees
from the latest merge to the first, and kept in a bounded cache.

Decoding gathers the pieces' bytes with numpy, and gives the text back exactly. For that the mark U+2581, which the library takes for
a blank, is written as bytes where a text itself holds it: there alone the ids differ.

Cases: null and empty texts have no ids; null ids decode to the empty text. A chunk of any length is encoded whole. Ids outside the
vocabulary, and control pieces, decode to nothing. Repeats need no rule; only the id and text columns are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filled, slices

BLANK = "▁"
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_FILTER = 22  # bits of the table that tells most substrings apart from pieces
_MEMO = 20  # bits of the cache of boundaries


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    steps = np.full(n + 1, base)
    steps[0] = 1
    return np.cumprod(steps, dtype=np.uint64)


def _sums(symbols: np.ndarray) -> np.ndarray:
    """Running sums of symbol x base^place along the last axis; differences of them hash substrings."""
    terms = (symbols.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, symbols.shape[-1])[:-1]
    return np.concatenate((np.zeros((*terms.shape[:-1], 1), np.uint64), np.cumsum(terms, axis=-1, dtype=np.uint64)), axis=-1)


@dataclass
class Pieces:
    """Tables of a vocabulary, all of its size."""

    keys: np.ndarray  # sorted hashes of the pieces
    ids: np.ndarray  # their ids
    filter: np.ndarray
    longest: int
    char: np.ndarray  # code point -> id of the piece of that character, -1 without one
    left: np.ndarray  # the two parts whose merge makes each piece, -1 for a character
    right: np.ndarray
    born: np.ndarray  # rank of that merge, -1 for a character
    pairs: np.ndarray  # sorted left x 2^20 + right of all adjacent pieces that merge into one
    merged: np.ndarray  # rank of the merge
    bytes_at: np.ndarray  # bounds of each id's bytes in raw
    raw: np.ndarray
    byte_id: np.ndarray  # id of each byte's piece
    size: int


def _merge(symbols: list[str], rank: dict[str, int]) -> list[tuple[str, str, str]]:
    """The merges, in order, that rank order makes of some symbols; the first of equal rank goes first."""
    done = []
    while len(symbols) > 1:
        best = min(range(len(symbols) - 1), key=lambda i: (rank.get(symbols[i] + symbols[i + 1], 1 << 60), i))
        whole = symbols[best] + symbols[best + 1]
        if whole not in rank:
            break
        done.append((symbols[best], symbols[best + 1], whole))
        symbols = [*symbols[:best], whole, *symbols[best + 2 :]]
    return done if len(symbols) == 1 else []


@lru_cache(2)
def load_pieces(path: str) -> Pieces:
    """Read a vocabulary of the merging kind."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size = model.vocab_size()
    byte_id = np.full(256, -1, dtype=np.int64)
    text: dict[str, int] = {}
    contents = [b""] * size
    for i in range(size):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            byte_id[int(piece[3:5], 16)] = i
            contents[i] = bytes([int(piece[3:5], 16)])
        elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            text[piece] = i
            contents[i] = piece.replace(BLANK, " ").encode()
    order = sorted((p for p in text if len(p) > 1), key=lambda p: (-model.get_score(text[p]), text[p]))
    rank = {p: r for r, p in enumerate(order)}
    left, right, born = np.full(size, -1), np.full(size, -1), np.full(size, -1)
    usable = [p for p in text if len(p) == 1]
    for p in order:
        if merges := _merge(list(p), rank):
            left[text[p]], right[text[p]], born[text[p]] = text.get(merges[-1][0], -1), text.get(merges[-1][1], -1), rank[p]
            usable.append(p)
    pairs = {}
    for p in order:
        for cut in range(1, len(p)):
            if p[:cut] in text and p[cut:] in text:
                pairs[text[p[:cut]] << 20 | text[p[cut:]]] = rank[p]
    pair_keys = np.array(sorted(pairs), dtype=np.int64)
    char = np.full(0x110000, -1, dtype=np.int64)
    for p in text:
        if len(p) == 1:
            char[ord(p)] = text[p]
    char[ord(" ")], char[ord(BLANK)] = char[ord(BLANK)], -1
    hashes = np.array([_sums(char[[ord(" ") if c == BLANK else ord(c) for c in p]])[-1] for p in usable], dtype=np.uint64)
    by = np.argsort(hashes)
    table = np.zeros(1 << _FILTER, dtype=bool)
    table[hashes >> np.uint64(64 - _FILTER)] = True
    bounds = np.concatenate(([0], np.cumsum([len(c) for c in contents])))
    return Pieces(hashes[by], np.array([text[p] for p in usable])[by], table, max(map(len, usable)), char, left, right, born, pair_keys, np.array([pairs[k] for k in pair_keys.tolist()]), bounds, np.frombuffer(b"".join(contents), np.uint8), byte_id, size)


class Codec:
    def __init__(self, pieces: Pieces):
        self.p = pieces
        self.memo_key = np.full(1 << _MEMO, -1, dtype=np.int64)
        self.memo = np.zeros(1 << _MEMO, dtype=bool)

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging leaves each pair of neighbouring pieces as two."""
        key = a << 20 | b
        slot = (key * 0x9E3779B1 >> 12) & ((1 << _MEMO) - 1)
        known = self.memo_key[slot] == key
        out = self.memo[slot]
        if not known.all():
            asked, back = np.unique(key[~known], return_inverse=True)
            answer = self._apart(asked >> 20, asked & ((1 << 20) - 1))
            out[~known] = answer[back]
            slot = (asked * 0x9E3779B1 >> 12) & ((1 << _MEMO) - 1)
            self.memo_key[slot], self.memo[slot] = asked, answer
            # two keys of one slot may have been written: the one that stands must have its own answer
            self.memo[slot] = answer[np.searchsorted(asked, self.memo_key[slot])]
        return out

    def _apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        p, out = self.p, np.ones(len(a), dtype=bool)
        at, limit = np.arange(len(a)), np.full(len(a), 1 << 40)
        while len(at):
            place = np.minimum(np.searchsorted(p.pairs, key := a << 20 | b), len(p.pairs) - 1)
            crossed = (p.pairs[place] == key) & (p.merged[place] < limit)
            out[at[crossed]] = False
            # Back in time: undo the later of the two pieces' last merges (of equal ones the right is later).
            left_later = p.born[a] > p.born[b]
            limit = np.where(left_later, p.born[a], p.born[b] + 1)
            go = ~crossed & (np.maximum(p.born[a], p.born[b]) >= 0)
            a, b = np.where(left_later, p.right[a], a), np.where(left_later, b, p.left[b])
            at, a, b, limit = at[go], a[go], b[go], limit[go]
        return out

    def _search(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks of one length (rows), right-aligned, and their number."""
        p, (rows, length) = self.p, symbols.shape
        sums = _sums(symbols)
        unscale = _powers(_INVERSE, length)
        found = np.full((min(p.longest, length) + 1, rows, length + 1), -1, dtype=np.int32)  # by size and end
        for size in range(1, len(found)):
            hashes = (sums[:, size:] - sums[:, : length + 1 - size]) * unscale[: length + 1 - size]
            r, c = np.nonzero(p.filter[hashes >> np.uint64(64 - _FILTER)])
            wanted = hashes[r, c]
            place = np.minimum(np.searchsorted(p.keys, wanted), len(p.keys) - 1)
            hit = p.keys[place] == wanted
            found[size, r[hit], c[hit] + size] = p.ids[place[hit]]
        last = np.full((rows, length + 1), -1, dtype=np.int64)
        step = np.zeros((rows, length + 1), dtype=np.int64)
        for end in range(1, length + 1):
            best = np.full(rows, -np.inf)
            for size in range(1, min(len(found) - 1, end) + 1):
                piece = found[size, :, end].astype(np.int64)
                ready = np.flatnonzero((piece >= 0) & ((end == size) | (last[:, end - size] >= 0)))
                if not len(ready):
                    continue
                score = np.zeros(len(ready))
                if end > size:
                    score[~self.apart(last[ready, end - size], piece[ready])] = -np.inf
                better = ready[score > best[ready]]
                best[better] = 0.0
                last[better, end], step[better, end] = piece[better], size
        out, counts = np.zeros((rows, length), dtype=np.int32), np.zeros(rows, dtype=np.int64)
        end, every = np.full(rows, length), np.arange(rows)
        while len(every):
            at = end[every]
            counts[every] += 1
            out[every, length - counts[every]] = last[every, at]
            end[every] = at - step[every, at]
            every = every[end[every] > 0]
        return out, counts

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and the texts' bounds in them."""
        p = self.p
        marked = [" " + t if t else "" for t in texts]
        points = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32)
        bounds = np.concatenate(([0], np.cumsum([len(t) for t in marked])))
        if not len(points):
            return np.zeros(0, dtype=np.int32), bounds
        symbols = p.char[points]
        blank, unknown = points == ord(" "), symbols < 0
        first = np.zeros(len(points) + 1, dtype=bool)
        first[bounds] = True
        first[1:-1] |= blank[1:] & ~blank[:-1]
        first[:-1] |= unknown
        first[1:] |= unknown
        starts = np.flatnonzero(first)
        lengths = np.diff(starts)
        starts = starts[:-1]
        sums = _sums(symbols)
        hashes = (sums[starts + lengths] - sums[starts]) * _powers(_INVERSE, len(points))[starts]
        hashes = (hashes ^ lengths.astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
        hashes[unknown[starts]] = points[starts[unknown[starts]]]
        _, chosen, which = np.unique(hashes, return_index=True, return_inverse=True)
        ids: list[np.ndarray] = []
        where, counts = np.zeros(len(chosen), dtype=np.int64), np.zeros(len(chosen), dtype=np.int64)
        base = 0
        strange = unknown[starts[chosen]]
        for i in np.flatnonzero(strange).tolist():
            own = p.byte_id[np.frombuffer(chr(points[starts[chosen[i]]]).encode("utf-8", "surrogatepass"), np.uint8)]
            where[i], counts[i] = base, len(own)
            ids.append(own.astype(np.int32))
            base += len(own)
        plain = np.flatnonzero(~strange)
        plain = plain[np.argsort(lengths[chosen[plain]], kind="stable")]
        sizes = lengths[chosen[plain]]
        for length in np.unique(sizes).tolist():
            group = plain[np.searchsorted(sizes, length) : np.searchsorted(sizes, length, side="right")]
            rows = max(1, 2_000_000 // (length * min(p.longest, length)))
            for at in range(0, len(group), rows):
                some = group[at : at + rows]
                out, n = self._search(symbols[starts[chosen[some], None] + np.arange(length)])
                ids.append(out[np.arange(length) >= length - n[:, None]])
                where[some] = base + np.concatenate(([0], np.cumsum(n)[:-1]))
                counts[some] = n
                base += int(n.sum())
        every = np.concatenate(ids)
        n = counts[which]
        ends = np.concatenate(([0], np.cumsum(n)))
        index = np.repeat(where[which] - ends[:-1], n)
        index += np.arange(ends[-1])
        return every[index], ends[np.searchsorted(starts, bounds)]

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> list[str]:
        """The text of each run of ids."""
        p = self.p
        inside = np.where((ids >= 0) & (ids < p.size), ids, 0)
        n = p.bytes_at[inside + 1] - p.bytes_at[inside]
        ends = np.concatenate(([0], np.cumsum(n)))
        index = np.repeat(p.bytes_at[inside] - ends[:-1], n)
        index += np.arange(ends[-1])
        raw = p.raw[index].tobytes()
        out = [raw[ends[a] : ends[b]].decode("utf-8", "replace") for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        return [t.removeprefix(" ") for t in out]


@lru_cache(1)
def worker_codec(path: str | None) -> Codec:
    """One for each Python worker: the tables are read once."""
    return Codec(load_pieces(path or model_path()))


def encode_documents(docs: DataFrame, model: str | None = None) -> DataFrame:
    """(doc_id, ids) of every whole text."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = worker_codec(model)
        for batch in batches:
            for part in slices(batch, limit=6 << 20):
                ids, bounds = codec.encode(filled(part.column("text")).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids))], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(encode, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """(doc_id, text) from (doc_id, ids)."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = worker_codec(model)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                ids = part.column("ids")
                lengths = np.asarray(ids.value_lengths().fill_null(0), dtype=np.int64)
                flat = np.asarray(ids.flatten().fill_null(-1), dtype=np.int64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(codec.decode(flat, np.concatenate(([0], np.cumsum(lengths)))), pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(decode, "doc_id long, text string")


def digest_documents(docs: DataFrame, model: str | None = None) -> DataFrame:
    """For each document the number of ids, their checksum (little-endian 32-bit), and whether decoding gives the text back."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = worker_codec(model)
        for batch in batches:
            for part in slices(batch, limit=6 << 20):
                texts = filled(part.column("text")).to_pylist()
                ids, bounds = codec.encode(texts)
                same = [a == b for a, b in zip(codec.decode(ids, bounds), texts, strict=True)]
                sums = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(bounds)), pa.array(sums, pa.int64()), pa.array(same, pa.bool_())], names=["doc_id", "n_ids", "ids_crc32", "round_trip"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(digest, "doc_id long, n_ids long, ids_crc32 long, round_trip boolean")
