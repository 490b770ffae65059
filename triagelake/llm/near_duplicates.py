"""SimHash near-duplicates by a byte-position inverted index with count filtering.

A document's fingerprint sets a bit where over half of the XXH64 hashes (seed 42) of its 3-word shingles have it. Two fingerprints of
8 positional bytes that differ in at most ``DISTANCE`` = 2 bits differ in at most 2 bytes, so they share at least ``LEAST_SHARED`` = 6
positional bytes: the guaranteed minimum of matches. Bytes left out are at most 2, so of the four pairs of neighbouring bytes two at
least are shared whole: the index has a posting for each choice of two pairs (6 postings of 4 positional bytes for a fingerprint), and
two linked fingerprints meet in one of them. In a posting the shared positional bytes of each pair are tallied, pairs that reach the minimum are
retained and verified by their differing bits. A posting of over ``CROWDED`` members is split by two more of the other four positional bytes,
in all 6 choices, which loses no pair with 6 in common; such a part holds 2^16 different fingerprints at most, and is looked up by flipped bits where it is large.

Copies cost nothing: fingerprints are made distinct before they are indexed, with the smallest id of each. Within a posting no
pairs are written out: verified links become one link to the smallest member of each linked set. Connected components follow by
alternating large-star and small-star rounds, with a checkpoint each.

``keep_one`` serves corpora: texts alike in 0.8 of their different five-word shingles. It goes by the fingerprints first: postings of positional bytes, tallies,
retained pairs within ``DISTANCE`` bits, each of which is verified at 0.8 on the whole texts. Texts so alike differ in 10 of 64 bits on average, where no
number of shared bytes is guaranteed, so what fingerprints leave apart is found by an index of the shingles themselves, by the same steps, which makes the result
exact. Shingles have one order for all texts, rare ones first; sets alike to 0.8 share a shingle among the first fifth of both, so postings by those hold every
such pair. Pairs that meet are filtered by how many shingles they can share at most, from their sizes and the shingle's places in both orders, then by
the parities of ``PARITY`` buckets, which tally no more differences than there are; what is left, and not tied yet, is verified on the shingles of the whole texts. A posting of many
members first compares one with all others. Then, in rounds, each member that links have not tied to the posting's largest component names
its closest few members of other components, and links are followed; what links tie is not compared again. So a family of copies costs rows
in proportion to its size, and it ends when every two members are tied, refuted or too far apart.

Cases: a null or wordless text has fingerprint zero and is linked like any other; fewer than three words are one shingle. Rows with
a null id get their group's smallest id (null if it has none). Repeated rows share a fingerprint and a group. Empty tables give no
rows. Only the id and text columns are read.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import FILE_ROWS, STAGE_BYTES, WordArrays, checkpointed, filled, segment_sums, shared_folder, slices, written

SHINGLE = 3
DISTANCE = 2
BYTES = 8
LEAST_SHARED = BYTES - DISTANCE
SEED = 42
SALTS = 8
#: Members above which a posting is split by more positional bytes.
CROWDED = 1024
#: The pipeline's rule: five-word shingles, similarity 0.8 (9 x shared >= 4 x both sizes).
WIDE_SHINGLE = 5
#: Commonest shingles that the order of prefixes puts last, and how many of them a slice of the corpus may name.
LISTED = 1 << 18
NAMED = 1 << 16
#: Bits of the bound on how many shingles two sets differ in.
PARITY = 4096
#: Bytes of bits that a step of a large posting compares.
COMPARED_BYTES = 16 << 20
#: Pairs of a large posting that a task holds before it hands them on.
HELD_PAIRS = 1 << 16
#: Members up to which a posting gives all its pairs at once; larger ones are compared over several rounds.
WHOLE_POSTING = 6

#: For each byte value, its bits as eight one-byte counters in a word.
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def shingle_hashes(texts: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of each shingle of lower-cased texts, and the texts' bounds in them."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    words = parts.flatten()
    keep = np.asarray(pc.binary_length(words), dtype=np.int64) > 0
    bounds = np.concatenate(([0], np.cumsum(keep)))[np.asarray(parts.offsets, dtype=np.int64) - parts.offsets[0].as_py()]
    spaced = pc.binary_join_element_wise(words.filter(pa.array(keep)), pa.scalar(" "), "")
    counts = np.diff(bounds)
    shingles = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    ends = np.concatenate(([0], np.cumsum(shingles)))
    if not ends[-1]:
        return np.zeros(0, dtype=np.uint64), ends
    offsets = np.frombuffer(spaced.buffers()[1], dtype=np.int32)[: len(spaced) + 1]
    first = np.arange(ends[-1]) - np.repeat(ends[:-1] - bounds[:-1], shingles)
    last = first + np.repeat(np.minimum(counts, size), shingles)
    raw, digest = memoryview(spaced.buffers()[2]), xxhash.xxh64_intdigest
    return np.fromiter((digest(raw[a:b], SEED) for a, b in zip(offsets[first].tolist(), (offsets[last] - 1).tolist(), strict=True)), np.uint64, int(ends[-1])), ends


def majority(hashes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The fingerprint of each text as a signed number; 0 for a text without shingles."""
    counts = np.diff(ends)
    if not len(hashes):
        return np.zeros(len(counts), dtype=np.int64)
    # Counters of one byte are summed over runs of up to 255 shingles of a text, then over its runs.
    runs = -(-counts // 255)
    run_ends = np.concatenate(([0], np.cumsum(runs)))
    starts = np.repeat(ends[:-1], runs) + 255 * (np.arange(run_ends[-1]) - np.repeat(run_ends[:-1], runs))
    lanes = np.add.reduceat(_LANES[hashes.view(np.uint8).reshape(-1, BYTES)], starts, axis=0)
    ones = segment_sums(lanes.view(np.uint8).astype(np.int64), run_ends)
    return np.packbits(ones * 2 > counts[:, None], axis=1, bitorder="little").view(np.int64).ravel()


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of every row, from the whole text."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, limit=4 << 20):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(majority(*shingle_hashes(filled(part.column("text")))))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(compute, "doc_id long, fp long")


def tallied(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs of fingerprints reach the minimum of shared positional bytes."""
    return (a[..., None].view(np.uint8) == b[..., None].view(np.uint8)).sum(axis=-1, dtype=np.uint8) >= LEAST_SHARED


def verified(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the pairs that the tally retained differ in ``DISTANCE`` bits at most."""
    return np.bitwise_count(a ^ b) <= DISTANCE


def _posting_links(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of the distinct fingerprints of one posting: each linked one with the smallest that it reaches there."""
    size = len(values)
    if size <= CROWDED:
        met = [np.nonzero(tallied(values[i : i + 64, None], values[None])) for i in range(0, size, 64)]
        a, b = np.concatenate([x + 64 * i for i, (x, _) in enumerate(met)]), np.concatenate([y for _, y in met])
        near = verified(values[a], values[b])
        a, b = a[near], b[near]
    else:
        # The two bytes left out hold 16 bits: look up each value's 136 neighbours at 1 or 2 flips instead of comparing all pairs.
        varying = np.bitwise_or.reduce(values ^ values[0])
        bits = [np.uint64(1) << np.uint64(b) for b in range(64) if int(varying) >> b & 1]
        flips = [*bits, *(a | b for a, b in combinations(bits, 2))]
        order = np.argsort(values)
        ranked = values[order]
        links = []
        for flip in flips:
            wanted = values ^ flip
            at = np.minimum(np.searchsorted(ranked, wanted), size - 1)
            there = ranked[at] == wanted
            links.append((np.flatnonzero(there), order[at[there]]))
        a, b = np.concatenate([x for x, _ in links]), np.concatenate([x for _, x in links])

    def step(label: np.ndarray) -> np.ndarray:
        out = label.copy()
        np.minimum.at(out, a, label[b])
        return out

    label = np.arange(size)
    while True:
        new = np.minimum(label, step(label))
        new = new[new]
        if (new == label).all():
            break
        label = new
    linked = np.flatnonzero(label != np.arange(size))
    return values[linked], values[label[linked]]


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings in order of their key; one that goes on in the next batch is carried over."""

    def emit(choice: np.ndarray, key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        edge = np.flatnonzero((np.diff(choice) != 0) | (np.diff(key) != 0)) + 1
        starts, ends = np.concatenate(([0], edge)), np.concatenate((edge, [len(fp)]))
        pairs = starts[ends - starts == 2]
        met = pairs[tallied(fp[pairs], fp[pairs + 1])]
        met = met[verified(fp[met], fp[met + 1])]
        a, b = [fp[met + 1]], [fp[met]]
        for start, end in zip(starts[ends - starts > 2].tolist(), ends[ends - starts > 2].tolist(), strict=True):
            x, y = _posting_links(fp[start:end])
            a.append(x)
            b.append(y)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a).view(np.int64)), pa.array(np.concatenate(b).view(np.int64))], names=["a", "b"])

    rest: tuple[np.ndarray, ...] = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))
    for batch in batches:
        now = tuple(np.concatenate((old, np.asarray(batch.column(n)).view(old.dtype))) for n, old in zip(("choice", "key", "fp"), rest, strict=True))
        if not len(now[0]):
            continue
        last = int(np.flatnonzero((now[0] != now[0][-1]) | (now[1] != now[1][-1])).max(initial=-1)) + 1
        if last:
            yield emit(*(x[:last] for x in now))
        rest = tuple(x[last:] for x in now)
    if len(rest[0]):
        yield emit(*rest)


def _mask(places) -> int:
    """A signed mask of positional bytes."""
    mask = sum(0xFF << 8 * p for p in places)
    return mask - (1 << 64) if mask >> 63 else mask


def fingerprint_links(distinct: DataFrame) -> DataFrame:
    """Links (a, b) that span the same sets as all pairs of distinct fingerprints within ``DISTANCE`` bits."""
    neighbours = [(p, p + 1) for p in range(0, BYTES, 2)]
    choices = [(*x, *y) for x, y in combinations(neighbours, 2)]
    finer = [[(*choice, *two) for two in combinations(sorted({*range(BYTES)} - {*choice}), LEAST_SHARED - len(choice))] for choice in choices]
    keyed = lambda sets: F.array(*[F.struct(F.lit(_mask(c)).alias("choice"), F.col("fp").bitwiseAND(F.lit(_mask(c))).alias("key")) for c in sets])
    postings = distinct.select("fp", F.inline(keyed(choices)))
    crowded = checkpointed(postings.groupBy("choice", "key").count().filter(F.col("count") > CROWDED).select("choice", "key"))
    if not crowded.isEmpty():
        apart = postings.join(crowded, ["choice", "key"], "left_semi").select("fp", F.inline(F.element_at(F.create_map(*[x for c, sets in zip(choices, finer, strict=True) for x in (F.lit(_mask(c)), keyed(sets))]), F.col("choice"))))
        postings = postings.join(crowded, ["choice", "key"], "left_anti").select("fp", "choice", "key").union(apart)
    return postings.select("choice", "key", "fp").repartition("choice", "key").sortWithinPartitions("choice", "key").mapInArrow(_links, "a long, b long").distinct()


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) of all links (u, v) of a task, without the roots themselves: roots of linked nodes are hooked to the smaller one until links have one root."""
    parts = [tuple(np.asarray(batch.column(c)) for c in ("u", "v")) for batch in batches]
    u, v = (np.concatenate([np.zeros(0, np.int64), *(part[i] for part in parts)]) for i in (0, 1))
    nodes, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while (root[a] != root[b]).any():
        x, y = root[a], root[b]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root != root[root]).any():
            root = root[root]
    tied = root != np.arange(len(nodes))
    yield pa.RecordBatch.from_arrays([pa.array(nodes[tied]), pa.array(nodes[root[tied]])], names=["node", "root"])


def connected(links: DataFrame, rounds: int = 40, rows: int | None = None) -> DataFrame:
    """(node, root) of every linked node; root is the smallest node that it reaches. ``rows``: how many links there are, if known. What one file of a
    checkpoint holds (1 MB) is connected by the task that writes it; more links go by rounds of shuffles, of which each costs thousands of tasks and their
    records at the driver, however few links there are."""
    if rows is not None and rows <= FILE_ROWS:
        return checkpointed(links.select(F.col("a").alias("u"), F.col("b").alias("v")).repartition(1).mapInArrow(_united, "node long, root long"))
    edges = checkpointed(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), rows)
    before = None
    for _ in range(rounds):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = checkpointed(small.union(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct(), rows)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def group_documents(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint and component_id of every row."""
    every = checkpointed(fingerprints(docs))
    distinct = checkpointed(every.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = connected(fingerprint_links(distinct)).withColumnRenamed("node", "fp")
    linked = distinct.join(roots.union(roots.select(F.col("root").alias("fp"), "root").distinct()), "fp")
    components = checkpointed(linked.join(linked.groupBy("root").agg(F.min("least").alias("component")), "root").select("fp", "component"))
    known = distinct.join(components, "fp", "left").select("fp", F.coalesce("component", "least").alias("component_id"))
    # Copies may be a third of all rows: they are dealt over SALTS tasks, and the one row of their fingerprint goes to each.
    salted = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = every.withColumn("salt", F.coalesce(F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"), F.lit(0)))
    return dealt.join(salted, ["fp", "salt"]).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def distinct_shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The different five-word shingles of each lower-cased text as 64-bit numbers, sorted, and the texts' bounds in them; fewer words are one."""
    words = WordArrays(pc.ascii_lower(texts))
    hashes = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in words.distinct.to_pylist()), np.uint64, len(words.distinct))[words.codes]
    shingles = np.where(words.counts >= WIDE_SHINGLE, words.counts - WIDE_SHINGLE + 1, np.minimum(words.counts, 1))
    ends = np.concatenate(([0], np.cumsum(shingles)))
    first = np.arange(ends[-1]) - np.repeat(ends[:-1] - words.offsets[:-1], shingles)
    size = np.repeat(np.minimum(words.counts, WIDE_SHINGLE), shingles)
    out = size.astype(np.uint64)
    for i in range(WIDE_SHINGLE):
        there = i < size
        out[there] = _mixed(out[there] * np.uint64(0x9E3779B97F4A7C15) + hashes[first[there] + i])
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        out[a:b].sort()
    text = np.repeat(np.arange(len(shingles)), shingles)
    fresh = np.ones(len(out), dtype=bool)
    fresh[1:] = (out[1:] != out[:-1]) | (text[1:] != text[:-1])
    return out[fresh], np.concatenate(([0], np.cumsum(np.bincount(text[fresh], minlength=len(shingles)))))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _node(docs: DataFrame) -> Column:
    """What a text under an id is called: an id may have unlike texts, each of which is a document of its own.

    A hash of both, but for its first 12 bits: those say where between the least and the largest id its id lies. A posting is compared to its first member,
    and texts with lower ids are more often what others were copied from. Two documents of one name are one: with ids that are spread evenly as unlikely as by 64
    bits of hash, at worst as by 52.
    """
    first, last = docs.agg(F.min(F.col("doc_id").cast("long")), F.max(F.col("doc_id").cast("long"))).first()
    first, last = (0, 0) if first is None else (first, last)
    place = F.floor((F.col("doc_id").cast("double") - float(first)) * (4095.0 / max(1.0, float(last) - float(first)))).cast("long")
    named = F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return F.shiftleft(F.least(F.greatest(place, F.lit(0)), F.lit(4095)) - 2048, 52).bitwiseOR(F.shiftrightunsigned(named, 12))


def common_shingles(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The ``LISTED`` commonest shingles, sorted, and how many texts have them. Only the order of prefixes rests on it, no result."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def often() -> pa.RecordBatch:
            ranked = np.sort(np.concatenate(held)) if held else np.zeros(0, np.uint64)
            # Runs of equal neighbours: a shingle that more than one text of the slice has, with the place where its run starts.
            starts = np.flatnonzero(np.concatenate((np.ones(min(1, len(ranked)), dtype=bool), ranked[1:] != ranked[:-1])))
            n = np.diff(np.concatenate((starts, [len(ranked)])))
            top = np.flatnonzero(n >= 2)
            top = top[np.argsort(-n[top], kind="stable")[:NAMED]]
            return pa.RecordBatch.from_arrays([pa.array(ranked[starts[top]].view(np.int64)), pa.array(n[top].astype(np.int64))], names=["shingle", "n"])

        for batch in batches:
            for part in slices(batch, limit=STAGE_BYTES):
                held.append(distinct_shingles(filled(part.column("text")))[0])
                if sum(map(len, held)) >= 2_000_000:
                    yield often()
                    held.clear()
        yield often()

    top = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).filter("n >= 4").orderBy(F.desc("n"), "shingle").limit(LISTED).toArrow()
    values, n = np.asarray(top["shingle"]).view(np.uint64), np.asarray(top["n"])
    order = np.argsort(values)
    return values[order], n[order]


def prefixes(docs: DataFrame, node: str) -> DataFrame:
    """(node, doc_id, fp, n, tokens, parity, simhash) of every row: a digest of the shingle set, its size, its rarest shingles in one order for all texts,
    as many as two sets alike to 0.8 need to have one of them in common, of each of ``PARITY`` buckets whether it has an odd number of
    shingles, and the fingerprint. Each shingle that one of two texts lacks changes one bit, so they differ in no more bits than shingles."""
    listed = docs.sparkSession.sparkContext.broadcast(common_shingles(docs))

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, often = listed.value
        for batch in batches:
            for part in slices(batch, limit=STAGE_BYTES):
                text = filled(part.column("text"))
                simhash = majority(*shingle_hashes(text))
                hashes, ends = distinct_shingles(text)
                n = np.diff(ends)
                # 0.8 n of n shingles, rounded up, must be shared: one more than the others may be missed.
                length = np.where(n > 0, n - (4 * n + 4) // 5 + 1, 0)
                rank = np.zeros(len(hashes), dtype=np.int64)
                if len(common):
                    at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
                    rank = np.where(common[at] == hashes, often[at], 0)
                bucket = (hashes % PARITY).astype(np.int64)
                fps, parity, tokens = [], [], []
                for a, b, most in zip(ends[:-1].tolist(), ends[1:].tolist(), length.tolist(), strict=True):
                    own = hashes[a:b]
                    fps.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest())
                    parity.append(np.packbits(np.bincount(bucket[a:b], minlength=PARITY) & 1).tobytes())
                    # Sorted by hash already: a stable sort by how common they are gives the one order.
                    tokens.append(own[:most] if not rank[a:b].any() else own[np.argsort(rank[a:b], kind="stable")[:most]])
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(length))), pa.int32()), pa.array(np.concatenate(tokens).view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column("node"), part.column("doc_id"), pa.array(fps, pa.binary()), pa.array(n, pa.int64()), lists, pa.array(parity, pa.binary()), pa.array(simhash)], names=["node", "doc_id", "fp", "n", "tokens", "parity", "simhash"])

    rows = docs.select(F.col(node).alias("node"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(compute, "node long, doc_id long, fp binary, n long, tokens array<long>, parity binary, simhash long")


def _whole_postings(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]]:
    """Columns of sorted postings, each member's place in its posting and the posting's size; a posting that goes on in the next batch is carried over."""

    def column(values: pa.Array) -> np.ndarray:
        return np.frombuffer(b"".join(values.to_pylist()), np.uint64).reshape(-1, PARITY // 64) if pa.types.is_binary(values.type) else np.asarray(values)

    def placed(now: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
        starts = np.concatenate(([0], np.flatnonzero(np.diff(now["token"])) + 1))
        size = np.diff(np.concatenate((starts, [len(now["token"])])))
        return now, np.arange(len(now["token"])) - np.repeat(starts, size), np.repeat(size, size)

    rest: dict[str, np.ndarray] = {}
    for batch in batches:
        now = {c: np.concatenate((rest[c], column(batch.column(c)))) if rest else column(batch.column(c)) for c in batch.schema.names}
        if not len(now["token"]):
            continue
        last = int(np.flatnonzero(now["token"] != now["token"][-1]).max(initial=-1)) + 1
        if last:
            yield placed({c: x[:last] for c, x in now.items()})
        rest = {c: x[last:] for c, x in now.items()}
    if rest:
        yield placed(rest)


def _can_share(place_a: np.ndarray, place_b: np.ndarray) -> np.ndarray:
    """Whether two sets can share enough, from their sizes (upper 32 bits) and the places of a common shingle in both orders (lower 32 bits)."""
    n_a, n_b, pos_a, pos_b = place_a >> 32, place_b >> 32, place_a & 0xFFFFFFFF, place_b & 0xFFFFFFFF
    return 9 * (np.minimum(pos_a, pos_b) + np.minimum(n_a - pos_a, n_b - pos_b)) >= 4 * (n_a + n_b)


def _compared(rows: DataFrame) -> DataFrame:
    """Of each posting (token, node, place), candidate pairs (a, b) of its first member with all others, or all pairs of a small one. Of a larger one
    also its other members (token, a, b = node, place)."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for now, nth, size in _whole_postings(batches):
            found = [np.zeros((0, 2), dtype=np.int64)]
            for pivot in range(min(int(size.max()), WHOLE_POSTING) - 1):
                b = np.flatnonzero((nth > pivot) & ((size <= WHOLE_POSTING) | (pivot == 0)))
                a = b - nth[b] + pivot
                good = _can_share(now["place"][a], now["place"][b])
                found.append(np.stack((now["node"][a[good]], now["node"][b[good]]), axis=1))
            pairs = np.unique(np.concatenate(found), axis=0)
            keep = (size > WHOLE_POSTING) & (nth > 0)
            columns = [np.concatenate((x, now[c][keep])) for x, c in ((pairs[:, 0], "node"), (pairs[:, 1], "place"))]
            token = pa.concat_arrays([pa.nulls(len(pairs), pa.int64()), pa.array(now["token"][keep])])
            yield pa.RecordBatch.from_arrays([token, *map(pa.array, columns)], names=["token", "a", "b"])

    return written(rows.repartition("token").sortWithinPartitions("token", "node").mapInArrow(compare, "token long, a long, b long"), "postings")


def _crossing(rows: DataFrame, most: int) -> DataFrame:
    """Of each posting (token, node, place, comp, parity), for each member outside its largest component the ``most`` closest members of other
    components that it may be alike to: (token, a, b, apart). A row without a pair says that the posting had more."""

    def emit(found: list[np.ndarray], more: list[int]) -> pa.RecordBatch:
        pairs = np.unique(np.concatenate(found), axis=0)
        token = pa.concat_arrays([pa.nulls(len(pairs), pa.int64()), pa.array(sorted(set(more)), pa.int64())])
        columns = [pa.concat_arrays([pa.array(pairs[:, i]), pa.nulls(len(token) - len(pairs), pa.int64())]) for i in range(3)]
        return pa.RecordBatch.from_arrays([token, *columns], names=["token", "a", "b", "apart"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for now, nth, size in _whole_postings(batches):
            found, more, held = [np.zeros((0, 3), dtype=np.int64)], [], 0
            for start in np.flatnonzero((nth == 0) & (size > 1)).tolist():
                node, place, comp, parity = (now[c][start : start + size[start]] for c in ("node", "place", "comp", "parity"))
                names, counts = np.unique(comp, return_counts=True)
                outside = np.flatnonzero(comp != names[counts.argmax()])
                # So many at once that what they are compared by stays within some megabytes, whatever the posting's size.
                some = max(1, COMPARED_BYTES * 8 // (PARITY * len(node)))
                for at in range(0, len(outside), some):
                    b = outside[at : at + some]
                    apart = np.bitwise_count(parity[b, None] ^ parity[None]).sum(axis=2, dtype=np.int64)
                    good = (comp[b, None] != comp[None]) & (9 * apart <= (place[b, None] >> 32) + (place[None] >> 32)) & _can_share(place[b, None], place[None])
                    if good.sum(axis=1).max() > most:
                        more.append(int(now["token"][start]))
                    far = np.where(good, apart, np.iinfo(np.int64).max)
                    near = np.argpartition(far, most - 1, axis=1)[:, :most] if most < len(node) else np.broadcast_to(np.arange(len(node)), far.shape)
                    i, j = np.nonzero(np.take_along_axis(good, near, axis=1))
                    x, y = b[i], near[i, j]
                    found.append(np.stack((np.minimum(node[x], node[y]), np.maximum(node[x], node[y]), apart[i, y]), axis=1))
                    held += len(x)
                    if held >= HELD_PAIRS:
                        yield emit(found, [])
                        found, held = [found[0][:0]], 0
            yield emit(found, more)

    return written(rows.repartition("token").sortWithinPartitions("token", "node").mapInArrow(compare, "token long, a long, b long, apart long"), "crossing")


def _retained(pairs: DataFrame, distinct: DataFrame) -> DataFrame:
    """The pairs (a, b, apart) whose parities differ in no more buckets than their sets may in shingles, at similarity 0.8."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(-1, PARITY // 64) for c in ("x", "y"))
            apart = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
            keep = pa.array(9 * apart <= np.asarray(batch.column("n")))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(apart)], names=["a", "b", "apart"]).filter(keep)

    known = distinct.select("node", "parity", "n")
    both = pairs.distinct().join(known.toDF("a", "x", "n_a"), "a").join(known.toDF("b", "y", "n_b"), "b")
    return both.select("a", "b", "x", "y", (F.col("n_a") + F.col("n_b")).alias("n")).mapInArrow(tally, "a long, b long, apart long")


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs that share 0.8 or more of all their different shingles; ``texts`` (node, text) lie in buckets by node, so only pairs are shuffled."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "x", STAGE_BYTES):
                (x, x_ends), (y, y_ends) = (distinct_shingles(filled(part.column(c))) for c in ("x", "y"))
                shared = np.array([len(np.intersect1d(x[a:b], y[c:d], assume_unique=True)) for a, b, c, d in zip(x_ends[:-1], x_ends[1:], y_ends[:-1], y_ends[1:], strict=True)])
                yield part.select(["a", "b"]).filter(pa.array(9 * shared >= 4 * (np.diff(x_ends) + np.diff(y_ends))))

    with_first = texts.join(pairs.hint("shuffle_hash"), texts["node"] == pairs["a"]).select("a", "b", F.col("text").alias("x"))
    with_both = texts.join(with_first.hint("shuffle_hash"), texts["node"] == with_first["b"]).select("a", "b", "x", F.col("text").alias("y"))
    return with_both.mapInArrow(verify, "a long, b long")


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs whose ends no links tie."""
    with_a = pairs.join(roots.toDF("a", "root_a"), "a", "left")
    return with_a.join(roots.toDF("b", "root_b"), "b", "left").filter(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select(*pairs.columns)


class _Ties:
    """What verified links tie: ``size`` nodes with their components (node, root), and the pairs verified or refuted so far. ``texts`` (node, text) lie in buckets by node."""

    def __init__(self, texts: DataFrame):
        spark = texts.sparkSession
        self.texts, self.tested = texts, spark.createDataFrame([], "a long, b long")
        self.roots, self.size = spark.createDataFrame([], "node long, root long"), 0

    def settle(self, pairs: DataFrame, rows: int) -> None:
        """Of the ``rows`` pairs (a, b, apart) of each b the closest is verified first, then the others where links have not tied the two by then."""
        rest = pairs.withColumn("nth", F.row_number().over(Window.partitionBy("b").orderBy("apart", "a")))
        for these in ("nth = 1", "nth > 1"):
            asked = checkpointed(_apart(rest.filter(these).select("a", "b"), self.roots), rows)
            if some := asked.count():
                found = checkpointed(_verified(asked, self.texts), some)
                self.tested = self.tested.union(asked)
                if alike := found.count():
                    self._tie(found, alike)

    def _tie(self, links: DataFrame, rows: int) -> None:
        """Only the roots of what new links tie are connected; then every node follows its old root to the new one."""
        old = self.roots
        between = links.join(old.toDF("a", "root_a"), "a", "left").join(old.toDF("b", "root_b"), "b", "left")
        merged = connected(between.select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b")), rows=rows)
        moved = old.join(merged.toDF("root", "new"), "root", "left").select("node", F.coalesce("new", "root").alias("root"))
        self.roots = checkpointed(moved.union(merged), self.size + 2 * rows)
        self.size = self.roots.count()


def bucketed(rows: DataFrame, name: str, key: str) -> DataFrame:
    """``rows`` as a table in the shared folder, in buckets by ``key``: what joins on it shuffles no text. Its files go when the session ends; the
    catalog, through which alone Spark writes buckets, forgets it at once."""
    spark = rows.sparkSession
    table, parts = f"{name}_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = f"{shared_folder(spark)}/{table}"
    rows.repartition(parts, key).write.bucketBy(parts, key).format("parquet").option("path", path).saveAsTable(table)
    found = spark.table(table)
    spark.sql(f"DROP TABLE {table}")
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return found


def fingerprint_pairs(distinct: DataFrame) -> DataFrame:
    """(a, b), a < b: texts of ``distinct`` (node, simhash) of one fingerprint, each with the first of them, and the firsts of linked fingerprints."""
    first = checkpointed(distinct.groupBy("simhash").agg(F.min("node").alias("first")), distinct.count())
    copies = distinct.join(first, "simhash").filter("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    links = fingerprint_links(first.select(F.col("simhash").alias("fp"))).join(first.toDF("a", "x"), "a").join(first.toDF("b", "y"), "b")
    return copies.union(links.select(F.least("x", "y"), F.greatest("x", "y")))


def similar_roots(distinct: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, root) of every node of ``distinct`` (node, n, tokens, parity, simhash) that links of similarity 0.8 or more tie to a smaller one.

    ``docs`` (node, text) lie in buckets by node."""
    rows = distinct.select("node", F.shiftleft("n", 32).alias("n"), F.posexplode("tokens").alias("pos", "token")).select("token", "node", F.col("n").bitwiseOR(F.col("pos").cast("long")).alias("place"))
    near = checkpointed(_retained(fingerprint_pairs(distinct.select("node", "simhash")), distinct), distinct.count())
    table, most = _compared(rows), 16
    met = table.filter("token IS NULL").select("a", "b")
    pairs = checkpointed(_retained(met, distinct), met.count())
    left = table.filter("token IS NOT NULL").toDF("token", "node", "place")
    # No other text is in any pair, now or later.
    wanted = near.union(pairs).select(F.explode(F.array("a", "b")).alias("node")).union(left.select("node")).distinct()
    ties = _Ties(bucketed(docs.join(wanted.hint("shuffle_hash"), "node", "left_semi").dropDuplicates(["node"]), "texts", "node"))
    parity = distinct.select("node", "parity")
    if some := near.count():
        ties.settle(near, some)
        pairs = pairs.join(ties.tested, ["a", "b"], "left_anti")
    while True:
        if some := pairs.count():
            ties.settle(pairs, some)
        known = left.select("token", "node", "place").join(ties.roots, "node", "left").select("token", "node", "place", F.coalesce("root", "node").alias("comp"))
        mixed = known.groupBy("token").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low <> high").select("token")
        # A posting that is one component stays one.
        left = written(known.join(mixed, "token", "left_semi"), "left")
        crossing = _crossing(left.join(parity, "node"), most)
        new = crossing.filter("a IS NOT NULL").groupBy("a", "b").agg(F.min("apart").alias("apart"))
        pairs = checkpointed(new.join(ties.tested, ["a", "b"], "left_anti"), crossing.count())
        if pairs.isEmpty() and crossing.filter("a IS NULL").isEmpty():
            return ties.roots
        most *= 8


def keep_one(docs: DataFrame) -> DataFrame:
    """Of each group of documents alike in 0.8 or more of their five-word shingles one with the smallest id, with all columns.

    A document is a text under an id: rows with the same of both stay one row, unlike texts under one id are documents of their own. A row without
    an id stays: nothing names it.
    """
    kind, columns = docs.schema["doc_id"].dataType, docs.columns
    named = f"_node_{uuid.uuid4().hex}"
    # Texts are shuffled once, into buckets: from here on they are read where they lie.
    held = bucketed(docs.filter(F.col("doc_id").isNotNull()).withColumn("doc_id", F.col("doc_id").cast("long")).withColumn(named, _node(docs)), "held", named)
    texts = held.select(F.col(named).alias("node"), F.col("text").cast("string").alias("text"))
    least = F.min(F.struct("doc_id", "node", "n", "tokens", "parity", "simhash")).alias("least")
    distinct = written(prefixes(held, named).groupBy("fp").agg(least).select("least.node", "least.doc_id", "least.n", "least.tokens", "least.parity", "least.simhash"), "prefixes")
    roots = similar_roots(distinct, texts)
    tied = roots.union(roots.select(F.col("root").alias("node"), "root").distinct()).join(distinct.select("node", "doc_id"), "node")
    first = tied.groupBy("root").agg(F.min(F.struct("doc_id", "node")).alias("first")).select(F.col("first.node").alias("node"))
    gone = tied.select("node").join(first, "node", "left_anti")
    kept = distinct.select(F.col("node").alias("_kept")).join(gone.withColumnRenamed("node", "_gone"), F.col("_kept") == F.col("_gone"), "left_anti")
    one = held.join(kept.hint("shuffle_hash"), held[named] == kept["_kept"], "left_semi").dropDuplicates([named])
    return one.select(*columns).withColumn("doc_id", F.col("doc_id").cast(kind)).unionByName(docs.filter(F.col("doc_id").isNull()))
