"""Operators against brute force, exact round trips and held-out accuracy."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from triagelake.llm import document_trees, entries, language_id, language_model, license_scan, near_duplicates, packing, personal_data, piece_codec, quality, vector_search

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACED = re.compile("[^\x20\x09-\x0d]+")


@pytest.fixture(scope="module")
def texts(spark, small):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()}


def test_language_held_out(spark, medium):
    got = entries.op1_language_id(spark, medium).join(spark.read.parquet(f"{medium}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert held and sum(r["lang_pred"] == r["lang"] for r in held) / len(held) > 0.95
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert sum(r["rejected"] for r in got) < 0.02 * len(got)


def test_license_base_and_rules(spark, small, texts):
    for r in entries.op2_license_scan(spark, small).collect():
        words = license_scan.WORD.findall(texts[r["doc_id"]].translate(LOWER))
        places = sorted((i, label) for phrase, label in license_scan.BASE for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split())
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (len(words), len(places), places[0][0] if places else None, places[-1][0] if places else None, ",".join(sorted({x for _, x in places})))
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1


def test_license_priority_and_containment():
    scan = lambda t: license_scan.scan_text(t.translate(LOWER))
    assert scan("Licensed under the Apache License, Version 2.0.")["labels"] == "apache,apache-2.0"
    assert [s["label"] for s in scan("Licensed under the Apache License, Version 2.0.")["spans"]] == ["apache-2.0"]  # the name inside the grant is suppressed
    assert scan("SPDX-License-Identifier: MIT")["labels"] == "mit" and scan("nothing here")["labels"] == ""
    assert len(license_scan.rules()[0]) >= 300
    assert all(re.search(license_scan.TRIGGERS, t) for t in ("licensed under cc by-nc 4.0", "all rights reserved", "no part of this book may be reproduced", "dedicated to the public domain"))


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    out = []
    for place, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            luhn = sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(reversed(digits))) % 10 == 0
            if kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m.group().split(".")) or kind == "card" and 12 <= len(digits) <= 19 and luhn or kind == "phone" and 9 <= len(digits) <= 15:
                out.append((m.start(), place, m.end()))
    return sorted(out)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab.@-_+%0123456789 ()é\n", max_size=60))
def test_base_spans_equal_plain_search(text):
    assert personal_data.base_spans(text) == plain_spans(text)


def test_personal_data_rows(spark, small, texts):
    for r in entries.op3_personal_data(spark, small).collect():
        plain = plain_spans(texts[r["doc_id"]])
        names = [f"{list(BASE)[k]}:{a}:{b}" for a, k, b in plain]
        assert r["base_sha256"] == hashlib.sha256(",".join(names).encode()).hexdigest() and set(names) <= set(r["spans"].split(",")) | {""}
        assert [r[f"n_{k}"] for k in BASE] == [sum(x[1] == i for x in plain) for i in range(4)]


def test_expectation_maximisation_separates():
    good, bad = "phone|1,1,1,1,0,0|4|1", "phone|-1,-1,-1,0,-1,-1|4|1"
    chances = personal_data.fit({good: 500, bad: 300, "email|1,0,1,0,0,0|5|1": 400})
    assert chances[good] > 0.9 and chances[bad] < 0.3 and personal_data.fit({}) == {}


def test_vector_recall(spark, medium):
    rows = spark.read.parquet(f"{medium}/embeddings.parquet").collect()
    points, ids = np.array([r["embedding"] for r in rows], dtype=np.float64), np.array([r["vec_id"] for r in rows])
    got = collections.defaultdict(dict)
    for r in entries.op4_vector_search(spark, medium).collect():
        got[r["query_id"]][r["rank"]] = (r["vec_id"], r["score"])
    shares = []
    for i in np.flatnonzero(ids % 100 == 0):
        away = np.sqrt(((points - points[i]) ** 2).sum(axis=1))
        away[i] = np.inf
        best = ids[np.lexsort((ids, away))[:10]]
        found = got[int(ids[i])]
        shares.append(len({v for v, _ in found.values()} & set(best.tolist())) / 10)
        assert sorted(found) == list(range(1, 11)) and all(abs(s - away[np.flatnonzero(ids == v)[0]]) < 1e-12 for v, s in found.values())
    assert np.mean(shares) >= 0.9


@pytest.mark.parametrize("kind", ["without structure", "clustered"])
def test_vector_recall_on_ten_thousand(spark, kind):
    """Enough vectors that the index leaves most of them out."""
    rng = np.random.default_rng(3)
    points = rng.normal(size=(10_000, 32))
    if kind == "clustered":
        points = rng.normal(size=(300, 32))[rng.integers(0, 300, 10_000)] + 0.3 * points
    points /= np.sqrt((points**2).sum(axis=1, keepdims=True))
    vectors = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "vec_id long, embedding array<double>").repartition(4)
    found = collections.defaultdict(set)
    for r in vector_search.nearest(vectors, every=100, k=10).collect():
        found[r["query_id"]].add(r["vec_id"])
    asked = np.arange(0, 10_000, 100)
    away = ((points[asked, None] - points[None]) ** 2).sum(axis=2)
    away[np.arange(len(asked)), asked] = np.inf
    best = np.argsort(away, axis=1, kind="stable")[:, :10]
    assert all(len(found[i]) == 10 for i in asked.tolist())
    assert np.mean([len(found[i] & set(b)) / 10 for i, b in zip(asked.tolist(), best.tolist(), strict=True)]) >= 0.9


def test_equal_distances_go_by_id(spark):
    """Unlike vectors as far from the query as each other."""
    rows = [(0, [0.0, 1.0])] + [(100 - i, [x, 1.0 + y]) for i, (x, y) in enumerate([(0.5, 0.0), (-0.5, 0.0), (0.0, 0.5), (0.0, -0.5)])]
    got = vector_search.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=1000, k=3).collect()
    assert [(r["rank"], r["vec_id"]) for r in sorted(got, key=lambda r: r["rank"])] == [(1, 97), (2, 98), (3, 99)]


def test_walk_takes_cells_in_order():
    rng = np.random.default_rng(0)
    sample = rng.normal(size=(400, 6))
    index = vector_search.MultiIndex(sample, 400)
    c1, c2 = index.cells(sample)
    counts = np.zeros((len(index.books[0]), len(index.books[1])), dtype=int)
    np.add.at(counts, (c1, c2), 1)
    first, second = (x[0] for x in index.halves(sample[:1]))
    cells = index.walk(first, second, counts, 10**9)
    sums = [first[a] + second[b] for a, b in cells]
    assert sums == sorted(sums) and len(cells) == (counts > 0).sum()


@pytest.fixture(scope="module")
def codec():
    return piece_codec.worker_codec(None)


def test_pieces_equal_library(codec, texts):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=piece_codec.model_path())
    rng = random.Random(1)
    signs = "abcdeinrstTheXYZéÉßẞİıΣσς’.,!?-_<>|@#0129 \t\n\x1c\x85́ 日本한ﬁ½ \x00"
    some = [*texts.values(), *("".join(rng.choice(signs) for _ in range(rng.randint(0, 40))) for _ in range(3000)), " " * 50 + "x" + " " * 17, "a" * 500, "=" * 99]
    ids, bounds = codec.encode(some)
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == model.encode(some)
    assert codec.decode(ids, bounds) == some


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=30), max_size=5))
def test_pieces_round_trip(some):
    some = [t.encode("utf-8", "replace").decode() for t in some]
    codec = piece_codec.worker_codec(None)
    assert codec.decode(*codec.encode(some)) == some


@pytest.mark.parametrize("order", [1, 2, 3])
def test_language_model_brute_force(spark, small, texts, order):
    prior = language_model.PRIOR
    got = {r["doc_id"]: r for r in language_model.score_documents(spark.read.parquet(f"{small}/documents.parquet"), order=order, block_chars=60_000).collect()}
    tokens = {i: [*SPACED.findall(t.translate(LOWER)), None] for i, t in texts.items()}
    grams = [collections.Counter() for _ in range(order + 1)]
    for i, own in tokens.items():
        if zlib.crc32(str(i).encode()) % 7 != 2:
            padded = [0, *own]
            for n in range(1, order + 1):
                grams[n].update(tuple(own[j : j + 1]) if n == 1 else tuple(padded[j + 2 - n : j + 2]) for j in range(len(own)) if n == 1 or j + 2 - n >= 0)
    total, vocabulary, ends = sum(grams[1].values()), len(grams[1]), grams[1][(None,)]
    for i, own in tokens.items():
        padded, score, base = [0, *own], 0.0, 0.0
        for j, w in enumerate(own):
            chance = (grams[1][(w,)] + 1) / (total + vocabulary + 1)
            base += math.log10(chance)
            for n in range(2, order + 1):
                if j + 2 - n < 0:
                    break
                gram = tuple(padded[j + 2 - n : j + 2])
                history = ends if gram[:-1] == (0,) else grams[n - 1][gram[:-1]]
                if history:
                    chance = (grams[n][gram] + prior * chance) / (history + prior)
            score += math.log10(chance)
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (len(own), sum(grams[1][(w,)] > 0 for w in own), total, zlib.crc32(str(i).encode()) % 7 == 2)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9) and math.isclose(r["score"], score, rel_tol=1e-9)


def plain_fingerprint(text):
    words = SPACED.findall(text.translate(LOWER))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum((sum(h >> b & 1 for h in hashes) * 2 > len(hashes)) << b for b in range(64))


def components(prints):
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= 2:
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(prints))]


def test_simhash_brute_force(spark, small, texts):
    got = {r["doc_id"]: r for r in entries.op7_simhash_groups(spark, small).collect()}
    ids = list(texts)
    prints = [plain_fingerprint(texts[i]) for i in ids]
    assert [got[i]["fingerprint"] for i in ids] == [f"{p:016x}" for p in prints]
    groups = components(prints)
    least = {g: min(i for i, h in zip(ids, groups) if h == g) for g in set(groups)}
    assert [got[i]["component_id"] for i in ids] == [least[g] for g in groups]


def test_links_of_crowded_postings(spark):
    rng = random.Random(3)
    base = rng.getrandbits(64)
    chain = [base]
    for _ in range(60):
        chain.append(chain[-1] ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64))
    crowd = [base ^ rng.getrandbits(16) for _ in range(1500)]  # one posting: six bytes shared
    prints = list({*chain, *crowd, *(rng.getrandbits(64) for _ in range(300))})
    frame = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp long")
    roots = {r["node"] & (1 << 64) - 1: r["root"] for r in near_duplicates.connected(near_duplicates.fingerprint_links(frame)).collect()}
    mine = {p: roots.get(p, p - (1 << 64) if p >> 63 else p) for p in prints}
    pairs = set(zip(components(prints), (mine[p] for p in prints)))
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


def shingled(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_one_of_each_group_of_near_copies_stays(spark):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(5000)]
    rows, family = [], {}
    for base in range(60):
        words = rng.choices(vocabulary, k=rng.randint(60, 400))
        for copy in range(rng.randint(1, 6)):
            edited = list(words)
            for _ in range(copy and max(1, len(words) // 120)):
                edited[rng.randrange(len(edited))] = rng.choice(vocabulary)
            family[len(rows)] = base
            rows.append((len(rows), " ".join(edited)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r["doc_id"] for r in near_duplicates.keep_one(docs).collect()}
    sets = [shingled(t) for _, t in rows]
    for i, own in enumerate(sets):
        if i not in kept:  # what goes is close to an earlier member of its family
            assert any(family[j] == family[i] and len(own & sets[j]) >= 0.7 * len(own | sets[j]) for j in range(i))
    # Each family keeps its first; hardly a near copy is missed.
    missed = sum(any(j in kept and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) for j in range(i)) for i in kept)
    assert {family[i] for i in kept} == set(range(60)) and missed <= 3


def test_trees(spark, small, texts):
    got = {r["doc_id"]: r for r in entries.op8_document_trees(spark, small).collect()}
    order = sorted(texts, reverse=True)
    for i, after in zip(order, order[1:] + order[:1]):
        t = texts[i]
        edited = t[: len(t) - len(t) // 2] + texts[after][: len(t) // 2]
        assert got[i]["n_chars"] == len(t) and got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= got[i]["near_next"] <= 1 and math.isclose(got[i]["near_edited"], document_trees.fingerprint_likeness(got[i]["fingerprint"], got[i]["edited_fingerprint"]))
    assert len({got[i]["fingerprint"] for i in order}) == len(set(texts.values()))
    long = [i for i in order if len(texts[i]) > 500]
    assert sum(got[i]["near_edited"] > got[i]["near_next"] for i in long) > 0.95 * len(long)


def test_trees_over_many_ranges(spark, small, texts, monkeypatch):
    whole = sorted(map(tuple, entries.op8_document_trees(spark, small).collect()))
    monkeypatch.setattr(document_trees, "BLOCK_CHARS", 20_000)
    assert sorted(map(tuple, entries.op8_document_trees(spark, small).collect())) == whole


def test_changed_paragraphs():
    lines = [f"paragraph number {i}" for i in range(50)]
    new = [*lines[:7], "changed", *lines[8:20], "inserted", *lines[20:]]
    assert document_trees.changed_paragraphs(document_trees.tree("\n".join(lines)), document_trees.tree("\n".join(new))) == [7]


def test_packing(spark, small, texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(packing.tokenizer_path())
    rows = entries.op9_packing(spark, small).collect()
    by, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, t in texts.items():
        ids = np.array([*library.encode(t, add_special_tokens=False).ids, 2], dtype="<u4")
        at = 0
        for r in sorted(by[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= packing.TOKENS and at.bit_count() == 1 and len(pieces) <= packing.SEGMENTS


def test_packer_limits():
    rng = np.random.default_rng(0)
    packer = packing.Packer(tokens=256, segments=4, loss=100, window=32)
    examples = [(i, int(n), rng.random(int(n)) < rng.random()) for i, n in enumerate(rng.integers(1, 700, 400))]
    pieces = [p for i, n, flags in examples for p in packer.add(i, n, flags)] + list(packer.finish())
    flags = {i: f for i, _, f in examples}
    assert all(sum(p[2] for p in pieces if p[0] == i) == n for i, n, _ in examples)
    sequences = collections.defaultdict(list)
    for key, start, length, sequence, _ in pieces:
        sequences[sequence].append((key, start, length))
    for s in sequences.values():
        assert sum(n for _, _, n in s) <= 256 and len(s) <= 4 and sum(int(flags[k][a : a + n].sum()) for k, a, n in s) <= 100


def test_word_tokenizer_equals_library():
    from tokenizers import Tokenizer

    library, own = Tokenizer.from_file(packing.tokenizer_path()), packing.worker_tokenizer(None)
    rng = random.Random(2)
    signs = "abcXYZéÉßẞİıΣσςÀçñ'’.,!?-_<>|@#0129 \t\n\x1c\x85́ e 日本한ﬁ½ªº×÷"
    some = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 40))) for _ in range(3000)] + ["don't I'll O'Neil's <|endoftext|> x"]
    ids, bounds = own(pa.array(some, pa.string()))
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [e.ids for e in library.encode_batch(some, add_special_tokens=False)]


def test_quality_held_out(spark, medium):
    rows = entries.op10_quality(spark, medium).join(spark.read.parquet(f"{medium}/labels.parquet").select("doc_id", "quality"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert sum(r["predicted"] == r["quality"] for r in held) / len(held) > 0.95


def test_isotonic_is_monotone():
    rng = np.random.default_rng(0)
    counts = rng.integers(1, 9, 200).astype(float)
    knots, levels = quality.isotonic(np.linspace(0, 1, 200), np.minimum(counts, rng.integers(0, 9, 200)), counts)
    assert (np.diff(knots) > 0).all() and (np.diff(levels) > 0).all() and 0 < levels[0] and levels[-1] < 1


def test_pipeline_works_on_what_is_kept(spark, medium):
    import corpus_pipeline

    docs = spark.read.parquet(f"{medium}/documents.parquet")
    before, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        before = corpus_pipeline.written(stage(spark, before, medium), "test")
        seen[name] = before
        if name != "packing":
            assert before.columns == docs.columns
    quality_labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{medium}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in seen["quality"].select("doc_id").collect()}
    good = [i for i, q in quality_labels.items() if q == 1]
    assert sum(i in kept for i in good) > 0.98 * len(good)
    groups = collections.defaultdict(list)
    for r in seen["quality"].select("doc_id", "text").collect():
        groups[r["text"]].append(r["doc_id"])
    left = {r["doc_id"] for r in seen["near_dedup"].select("doc_id").collect()}
    assert all(sum(i in left for i in g) <= 1 for g in groups.values())
    assert not [r for r in seen["personal_data"].select("text").collect() if plain_spans(r["text"])]
    assert {r["doc_id"] for r in seen["packing"].select("doc_id").distinct().collect()} == left
