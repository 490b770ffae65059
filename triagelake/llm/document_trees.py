"""Document fingerprints: a Merkle tree over word runs, paragraphs and sections, with a sketch of its leaves that tells how alike two trees are.

Leaves are runs of a few words, blanks included, that end where the last bytes of a word say so (one word in ``RUN``, about) or at a line's
end; each is digested by XXH64. A paragraph (line) is a digest of its leaves' digests, a section of its paragraphs' (it ends at a blank one or at
one whose digest is divisible by ``SECTION``), the root of the sections'. Bounds follow from the text around them alone, so an insertion moves no
later ones: equal stretches of two texts are equal branches. Equal texts have equal roots; where roots differ, only differing sections are opened,
which locates the changed paragraphs. The fingerprint is the root followed by a one-permutation min-hash sketch (``SLOTS`` bytes) of the tree's
leaves; likeness is 1 for equal roots, else the Dice coefficient of the leaves, from the share of agreeing used slots (a Jaccard estimate).

To meet each document with the next one in descending id order, ids are cut into ranges at real ids (approximate percentiles, about
``BLOCK_CHARS`` characters of text each, ``RANGES`` ranges at most: a range is read as a sorted stream, so a large one takes time, not memory, and the
table of cuts is bounded). The text at each cut goes to both neighbouring ranges, so a document's successor is always
in its range: one shuffle of the texts, no global window, and one streaming pass over each sorted range.

Cases: null text is the empty text. Null ids come after all others; equal ids follow each other by their text. A single document's
next one is itself. An empty text is one empty leaf: likeness 1 to another empty text, else 0. Empty tables give no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buffers, filled, slices

SLOTS = 128
RUN = 4
SECTION = 8
BLOCK_CHARS = 16_000_000
RANGES = 10_000


def _digest(data: bytes, size: int = 8) -> bytes:
    return hashlib.blake2b(data, digest_size=size).digest()


_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def leaves(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Digests of all leaves of the texts, each text's bounds in them, and whether a leaf ends its paragraph."""
    raw, offsets = buffers(texts)
    if not len(raw):
        empty = xxhash.xxh64_intdigest(b"")
        return np.full(len(texts), empty, dtype=np.uint64), np.arange(len(texts) + 1), np.ones(len(texts), dtype=bool)
    blank, line = _BLANK[raw], raw == 10
    # The last three bytes of a word, none of them from the text before.
    codes, first = raw.astype(np.uint32), offsets[:-1][np.diff(offsets) > 0]
    one, two = np.concatenate(([0], codes[:-1])).astype(np.uint32), np.concatenate(([0, 0], codes[:-2])).astype(np.uint32)[: len(raw)]
    one[first] = two[first] = 0
    two[first[first + 1 < len(raw)] + 1] = 0
    said = (codes * np.uint32(2654435761) + one * np.uint32(2246822519) + two * np.uint32(3266489917)) >> np.uint32(16)
    ends = ~blank & np.concatenate((blank[1:], [True])) & (said % RUN == 0)
    ends |= line
    ends[offsets[1:][np.diff(offsets) > 0] - 1] = True
    stops = np.flatnonzero(ends) + 1
    # An empty text has one leaf, without bytes, of its own.
    empty = np.flatnonzero(np.diff(offsets) == 0)
    starts = np.concatenate(([0], stops[:-1]))
    at = np.searchsorted(stops, offsets[empty], side="right")
    starts, stops = np.insert(starts, at, offsets[empty]), np.insert(stops, at, offsets[empty])
    data, digest = memoryview(raw), xxhash.xxh64_intdigest
    found = np.fromiter((digest(data[a:b]) for a, b in zip(starts.tolist(), stops.tolist(), strict=True)), np.uint64, len(stops))
    counts = np.bincount(np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(np.flatnonzero(ends) + 1, offsets, side="right"))), minlength=len(texts))
    counts[empty] = 1
    bounds = np.concatenate(([0], np.cumsum(counts)))
    paragraph = np.zeros(len(stops), dtype=bool)
    full = stops > starts
    paragraph[full] = line[stops[full] - 1]
    paragraph[bounds[1:] - 1] = True
    return found, bounds, paragraph


def _tree(digests: np.ndarray, paragraph: np.ndarray, ends_blank: bool) -> list[tuple[bytes, list[bytes]]]:
    sections, open_, start, blank = [], [], 0, _BLANK_LEAF
    data = digests.astype("<u8").tobytes()
    cuts = (np.flatnonzero(paragraph) + 1).tolist()
    for end in [*cuts, *([end_ for end_ in (len(digests),) if ends_blank])]:
        part = data[8 * start : 8 * end]
        node = _digest(part)
        open_.append(node)
        if part in (b"", blank) or node[0] % SECTION == 0:
            sections.append((_digest(b"".join(open_)), open_))
            open_ = []
        start = end
    if open_:
        sections.append((_digest(b"".join(open_)), open_))
    return sections


#: What a blank line's only leaf is.
_BLANK_LEAF = np.array([xxhash.xxh64_intdigest(b"\n")], dtype="<u8").tobytes()


def tree(text: str) -> list[tuple[bytes, list[bytes]]]:
    """The sections of a text in order: (digest, digests of its paragraphs)."""
    found, _, paragraph = leaves(pa.array([text], pa.string()))
    return _tree(found, paragraph, text.endswith("\n"))


def root(sections: list[tuple[bytes, list[bytes]]]) -> str:
    return _digest(b"".join(d for d, _ in sections), 16).hex()


def changed_paragraphs(old: list[tuple[bytes, list[bytes]]], new: list[tuple[bytes, list[bytes]]]) -> list[int]:
    """Places of the paragraphs of ``old`` that ``new`` lacks; only sections without an equal one are opened."""
    same = {d for d, _ in new}
    mine = {d for d, _ in old}
    leaves = {leaf for d, part in new if d not in mine for leaf in part}
    places, at = [], 0
    for d, part in old:
        if d not in same:
            places += [at + i for i, leaf in enumerate(part) if leaf not in leaves]
        at += len(part)
    return places


def sketches(digests: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One row of ``SLOTS`` bytes for each text, from its leaves; 0 marks an unused slot."""
    mixed = (digests ^ (digests >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(29)
    least = np.full((len(bounds) - 1) * SLOTS, np.uint64(0xFFFFFFFFFFFFFFFF))
    of = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    np.minimum.at(least, of * SLOTS + (mixed >> np.uint64(57)).astype(np.int64), mixed & np.uint64((1 << 57) - 1))
    used = least != np.uint64(0xFFFFFFFFFFFFFFFF)
    return np.where(used, least % np.uint64(255) + np.uint64(1), 0).astype(np.uint8).reshape(-1, SLOTS)


def likeness(root_a: str, sketch_a: np.ndarray, root_b: str, sketch_b: np.ndarray) -> float:
    if root_a == root_b:
        return 1.0
    used = (sketch_a != 0) | (sketch_b != 0)
    overlap = float(((sketch_a == sketch_b) & used).sum() / used.sum()) if used.any() else 0.0
    return 2 * overlap / (1 + overlap)


def fingerprint_likeness(a: str, b: str) -> float:
    """Likeness of two fingerprints as written."""
    return likeness(a[:32], np.frombuffer(bytes.fromhex(a[32:]), np.uint8), b[:32], np.frombuffer(bytes.fromhex(b[32:]), np.uint8))


def _describe(texts: list[str]) -> list[tuple[str, np.ndarray, list]]:
    """(root, sketch, sections) of each text."""
    digests, bounds, paragraph = leaves(pa.array(texts, pa.string()))
    rows = sketches(digests, bounds)
    trees = [_tree(digests[a:b], paragraph[a:b], t.endswith("\n")) for t, a, b in zip(texts, bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
    return [(root(t), row, t) for t, row in zip(trees, rows, strict=True)]


COLUMNS = {"doc_id": pa.int64(), "n_chars": pa.int64(), "edited_sha256": pa.string(), "fingerprint": pa.string(), "edited_fingerprint": pa.string(), "near_edited": pa.float64(), "near_next": pa.float64(), "n_paragraphs": pa.int64(), "n_changed": pa.int64()}


def _compare(rows: list[tuple], following: list[tuple]) -> pa.RecordBatch:
    """Output for rows (doc_id, text, described) and the row after each."""
    cut = [len(t) - len(t) // 2 for _, t, _ in rows]
    edited = [t[:c] + n[: len(t) // 2] for (_, t, _), (_, n, _), c in zip(rows, following, cut, strict=True)]
    out: dict[str, list] = {name: [] for name in COLUMNS}
    for (doc_id, text, (r, s, t)), (_, _, (next_r, next_s, _)), new, (new_r, new_s, new_t) in zip(rows, following, edited, _describe(edited), strict=True):
        values = doc_id, len(text), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), r + s.tobytes().hex(), new_r + new_s.tobytes().hex(), likeness(r, s, new_r, new_s), likeness(r, s, next_r, next_s), sum(len(p) for _, p in t), len(changed_paragraphs(t, new_t))
        for name, value in zip(COLUMNS, values, strict=True):
            out[name].append(value)
    return pa.RecordBatch.from_pydict(out, schema=pa.schema(list(COLUMNS.items())))


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranges one after another, each in order; a range's last row is followed by the row lent by the next range, if there is one."""
    held = None  # the last row so far, not yet compared
    block, first = None, None
    for batch in batches:
        for part in slices(batch, limit=4 << 20):
            texts = filled(part.column("text")).to_pylist()
            ready, following = [], []
            for b, lent, doc_id, text, described in zip(part.column("block").to_pylist(), part.column("lent").to_pylist(), part.column("doc_id").to_pylist(), texts, _describe(texts), strict=True):
                row = (doc_id, text, described)
                if b != block:
                    if held:
                        ready.append(held)
                        following.append(first)
                    block, first, held = b, row, None
                elif held:
                    ready.append(held)
                    following.append(row)
                held = None if lent else row
            if ready:
                yield _compare(ready, following)
    if held:
        yield _compare([held], [first])


def compare_with_next(docs: DataFrame) -> DataFrame:
    """For each document: its fingerprint, that of its edited text (half of it from the next document), and likenesses."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    facts = rows.agg(F.sum(F.length("text")).alias("chars"), F.max("doc_id").alias("top")).first()
    ranges = min(RANGES, max(1, math.ceil((facts["chars"] or 0) / BLOCK_CHARS)))
    cuts: list[int] = []
    if ranges > 1 and facts["top"] is not None:
        found = rows.agg(F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)], max(10_000, 20 * ranges)).alias("cuts")).first()["cuts"]
        cuts = sorted(set(found) - {facts["top"]})
    top, shared = facts["top"], docs.sparkSession.sparkContext.broadcast(np.array(cuts, dtype=np.int64))

    @F.pandas_udf("block long, at_cut boolean")
    def place(ids: pd.Series) -> pd.DataFrame:
        known = ids.notna().to_numpy()
        values = ids.fillna(0).to_numpy().astype(np.int64)
        at = np.where(known, np.searchsorted(shared.value, values, side="left"), 0)
        cut = known & (at < len(shared.value))
        cut[cut] = shared.value[at[cut]] == values[cut]
        return pd.DataFrame({"block": at, "at_cut": cut})

    own = F.struct(F.col("p.block").alias("block"), F.lit(False).alias("lent"))
    above = F.when(F.col("p.at_cut"), F.struct((F.col("p.block") + 1).alias("block"), F.lit(True).alias("lent")))
    around = F.when(F.col("doc_id") == F.lit(top).cast("long"), F.struct(F.lit(0).cast("long").alias("block"), F.lit(True).alias("lent")))
    dealt = rows.withColumn("p", place("doc_id")).select("doc_id", "text", F.explode(F.filter(F.array(own, above, around), lambda x: x.isNotNull())).alias("x")).select("x.block", "x.lent", "doc_id", "text")
    ordered = dealt.repartition("block").sortWithinPartitions("block", "lent", F.desc_nulls_last("doc_id"), "text")
    return ordered.mapInArrow(_stream, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_paragraphs long, n_changed long")
