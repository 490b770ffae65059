"""The named methods at work: automaton arcs, tallies, trees, limits that bind; scores computed plainly from fitted models."""

import collections
import itertools
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from triagelake.llm import common, document_trees, language_id, language_model, license_scan, near_duplicates, packing, quality

WORDS = "ab cd ef gh ij kl".split()


def automaton(texts, train, order=3, prior=2.0):
    block = language_model.Block(pa.array(texts, pa.string()), order, 64)
    flags = np.repeat(np.array(train), block.counts)
    totals = {n: block.learnt(n, flags) for n in block.grams}
    tokens, vocabulary = int(totals[1].sum()), int((totals[1] > 0).sum())
    return block, language_model.Automaton.build(block, totals, tokens, vocabulary, sum(train), prior)


def test_weights_of_every_state_sum_to_one():
    # Every word of the vocabulary, and one that was never seen, read from the state after each of many histories.
    rng = random.Random(1)
    texts = [" ".join(rng.choices(WORDS, k=rng.randint(0, 9))) for _ in range(60)]
    histories = [" ".join(h) for n in (0, 1, 2, 3) for h in itertools.product([*WORDS[:4], "new"], repeat=n)]
    probes = [f"{h} {w}".strip() for h in histories for w in [*WORDS, "unseen"]]
    block, model = automaton(texts + probes + histories, [True] * len(texts) + [False] * (len(probes) + len(histories)))
    chance = 10 ** model.walk(block.own[1], block.offsets)
    last = block.offsets[1:] - 1
    at = len(texts)
    for i in range(len(histories)):
        words = sum(chance[last[at + i * 7 + j] - 1] for j in range(7))
        end = chance[last[at + len(probes) + i]]
        assert math.isclose(words + end, 1.0, rel_tol=1e-9)


def test_failure_arcs_are_taken():
    # "ab cd" and "cd ef" are known, "ab cd ef" is not: from the state of "ab cd" the word is read along one failure arc.
    texts, prior = ["ab cd gh", "kl cd ef"], 2.0
    block, model = automaton([*texts, "ab cd ef"], [True, True, False], prior=prior)
    start = np.array([1])
    code = dict(zip("ab cd ef".split(), block.own[1][block.offsets[2] :]))
    _, state = model.advance(start, np.array([code["ab"]]))
    weight, pair = model.advance(state, np.array([code["cd"]]))
    assert model.failure[pair[0]] != 0 and not (model.keys == pair[0] * model.words + code["ef"]).any()
    weight, after = model.advance(pair, np.array([code["ef"]]))
    tokens, vocabulary = 8, 6
    unigram = 2 / (tokens + vocabulary + 1)
    pair_chance = (1 + prior * unigram) / (2 + prior)  # cd is read twice, once before ef
    assert math.isclose(10 ** weight[0], prior / (1 + prior) * pair_chance)  # ab cd is read once
    assert after[0] != 0


class Tally:
    """A scorer that keeps counts of tuples and follows no arcs: the share of each order in the mixture, from the longest history down."""

    def __init__(self, texts, order, prior):
        self.counts, self.order, self.prior = collections.Counter(), order, prior
        self.starts = len(texts)
        for t in texts:
            words = ["<s>", *t.split(), "</s>"]
            for i, n in itertools.product(range(1, len(words)), range(1, order + 1)):
                if i - n + 1 >= 0:
                    self.counts[tuple(words[i - n + 1 : i + 1])] += 1
        self.size = sum(n for g, n in self.counts.items() if len(g) == 1)
        self.kinds = sum(len(g) == 1 for g in self.counts)

    def chance(self, history, word):
        total, rest = 0.0, 1.0
        for n in range(min(self.order - 1, len(history)), 0, -1):
            h = tuple(history[-n:])
            seen = self.starts if h == ("<s>",) else self.counts[h]
            total += rest * self.counts[(*h, word)] / (seen + self.prior) if seen else 0.0
            rest *= self.prior / (seen + self.prior)
        return total + rest * (self.counts[(word,)] + 1) / (self.size + self.kinds + 1)


@pytest.mark.parametrize("order", [2, 3, 4])
def test_scores_equal_a_mixture_of_counts(order):
    rng = random.Random(order)
    texts = [" ".join(rng.choices(WORDS, k=rng.choice([0, 1, 5, 63, 64, 65, 200]))) for _ in range(40)]
    train = [rng.random() < 0.7 for _ in texts]
    block, model = automaton(texts, train, order)
    got = model.walk(block.own[1], block.offsets)
    plain = Tally([t for t, used in zip(texts, train) if used], order, 2.0)
    want = []
    for t in texts:
        words = ["<s>", *t.split(), "</s>"]
        want += [math.log10(plain.chance(words[:i], words[i])) for i in range(1, len(words))]
    assert np.allclose(got, want, rtol=1e-9)


def test_null_and_repeated_ids_over_many_blocks(spark):
    rows = [(None, "ab cd ef"), (None, None), (7, "ab cd"), (7, "ab cd"), (7, "kl"), *((i, " ".join(WORDS)) for i in range(20))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    one = sorted(map(repr, language_model.score_documents(docs).collect()))
    many = sorted(map(repr, language_model.score_documents(docs.repartition(5), block_chars=20).collect()))
    key = lambda r: re.sub(r"=-?\d+\.\d+", lambda m: f"={float(m.group()[1:]):.9f}", r)
    assert sorted(map(key, one)) == sorted(map(key, many)) and len(one) == len(rows)


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_a_posting_of_a_hundred_thousand(spark):
    # All share four positional bytes; a few are planted within two bits of others, by every pair of bytes.
    rng = np.random.default_rng(4)
    values = (np.uint64(0x1234ABCD) << np.uint64(32)) | rng.integers(0, 1 << 32, 100_000, dtype=np.uint64)
    planted = [int(values[i]) ^ (1 << a) ^ (1 << b) for i, (a, b) in enumerate(itertools.combinations(range(0, 64, 7), 2))]
    every = sorted({*map(int, values), *planted})
    frame = spark.createDataFrame([(signed(v),) for v in every], "fp long")
    root = {r["node"]: r["root"] for r in near_duplicates.connected(near_duplicates.fingerprint_links(frame)).collect()}
    find = lambda v: root.get(signed(v), signed(v))
    assert all(find(p) == find(int(values[i])) for i, p in enumerate(planted))
    # Brute force over a part: everything within two bits, by sorting on each choice of bytes that may differ.
    lookup, linked = set(every), 0
    for v in rng.choice(np.array(every, dtype=np.uint64), 300).tolist():
        for a, b in itertools.combinations_with_replacement(range(64), 2):
            other = v ^ (1 << a) ^ ((1 << b) if b != a else 0)
            if other in lookup:
                linked += 1
                assert find(other) == find(v)
    groups = collections.Counter(root.values())
    assert len(groups) < 60_000


def test_pairs_are_retained_by_tally_and_then_verified(monkeypatch):
    a = np.array([0x0101010101010101], dtype=np.uint64)
    far = a ^ np.uint64(0x0000000000010101)  # three bytes differ by a bit each
    near = a ^ np.uint64(0x0000000000000101)
    wide = a ^ np.uint64(0x0000000000000303)  # two bytes, four bits
    assert not near_duplicates.tallied(a, far)[0] and near_duplicates.tallied(a, near)[0] and near_duplicates.tallied(a, wide)[0]
    assert not near_duplicates.verified(a, wide)[0] and near_duplicates.verified(a, near)[0]
    asked = []
    check = near_duplicates.verified
    monkeypatch.setattr(near_duplicates, "verified", lambda x, y: asked.extend(zip(x.tolist(), y.tolist(), strict=True)) or check(x, y))
    near_duplicates._posting_links(np.concatenate((a, far, near, wide)))
    pairs = {frozenset(p) for p in asked if p[0] != p[1]}
    assert frozenset((int(a[0]), int(far[0]))) not in pairs and frozenset((int(a[0]), int(wide[0]))) in pairs


def test_unlike_texts_of_one_id_stay_and_tables_leave_the_catalog(spark):
    words = [f"w{i}" for i in range(200)]
    a, near, other = " ".join(words[:80]), " ".join([*words[:79], "new"]), " ".join(words[100:])
    rows = [(1, a), (5, near), (5, other), (5, other), (7, near + " more"), (3, other + " tail"), (None, a)]
    before = {t.name for t in spark.catalog.listTables()}
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, node string, least string")
    kept = near_duplicates.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in kept.collect()) == [(False, 1, a), (False, 3, other + " tail"), (True, 0, a)]
    alone = near_duplicates.keep_one(docs.filter("doc_id <> 3")).collect()
    assert sorted((r.doc_id, r.text) for r in alone if r.doc_id) == [(1, a), (5, other)]
    assert {t.name for t in spark.catalog.listTables()} == before


def test_what_language_training_sends_is_bounded(spark, monkeypatch):
    texts = [("en", " ".join(f"word{i * j % 977}" for i in range(4000))) for j in range(1, 40)] + [("fr", "mot " * 30 + "x" * 300_000)] * 3
    docs = spark.createDataFrame([(i, t, g) for i, (g, t) in enumerate(texts)], "doc_id long, text string, lang string")
    monkeypatch.setattr(language_id, "SAMPLE_GRAMS", 100_000)
    sample = language_id.labelled_sample(docs, 10)
    rows = sample.mapInArrow(language_id._examples, "lang string, place long, buckets array<int>, counts array<float>").collect()
    assert {r.lang for r in rows} == {"en", "fr"} and sum(sum(r.counts) for r in rows) <= 3 * 100_000
    assert language_id.train(docs, 10) is not None


def test_ranges_are_the_first_bits_of_hashes(spark, small, monkeypatch):
    """Scores do not depend on how many ranges and blocks there are."""
    docs = spark.createDataFrame([(i, f"a b c{i % 7} d{i % 3} e") for i in range(400)], "doc_id long, text string")
    few = {r.doc_id: r for r in language_model.score_documents(docs).collect()}
    many = {r.doc_id: r for r in language_model.score_documents(docs.repartition(3), block_chars=120).collect()}
    assert few.keys() == many.keys() and all(abs(few[i].score - many[i].score) < 1e-9 and few[i].n_known == many[i].n_known for i in few)


def test_many_copies_and_repeated_ids_in_near_dedup(spark):
    words = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(words[:60])) for i in range(300)] + [(5, " ".join(words[100:])), (5, " ".join(words[100:])), (None, "x"), (900, ""), (901, None)]
    docs = spark.createDataFrame([(i, t, "s", "clash") for i, t in rows], "doc_id long, text string, node string, token string")
    kept = near_duplicates.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], (r["text"] or "")[:4]) for r in kept.collect()) == [(-1, "x"), (0, "w0 w"), (5, "w100"), (900, "")]


def test_hand_written_signatures():
    assert len(license_scan.NOTICES) + len(license_scan.MORE_NOTICES) >= 200
    found = lambda t: license_scan.scan_text(t.lower())["labels"].split(",")
    assert "beerware" in found("If we meet some day, and you think this stuff is worth it, you can buy me a beer in return.")
    assert "zlib" in found("The origin of this software must not be misrepresented; you must not claim that you wrote the original software.")
    assert "agpl-3.0" in found("your modified version must prominently offer all users interacting with it remotely through a computer network")


def test_language_scores_follow_from_the_model(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    model = language_id.train(docs)
    texts = [r["text"] for r in docs.filter("text is not null and length(text) > 0").limit(40).collect()]
    names, scores, _ = language_id.predict_slice(pa.array(texts), model)

    def bucket(gram):
        value = 0
        for n, byte in enumerate(gram, 1):
            value = (value * 16777619 + byte + n) & 0xFFFFFFFF
        mixed = ((value ^ (value >> 15)) * 2246822519) & 0xFFFFFFFF
        return mixed >> (32 - 16)

    for text, name, score in zip(texts, names.to_pylist(), scores):
        if not re.search(r"[^\W\d_]", text):
            assert name == "und"
            continue
        total, n = np.zeros(model.table.shape[1]), 0
        for word in text.lower().split():
            marked = f"<{word}>".encode()
            for size in language_id.GRAMS:
                for i in range(len(marked) - size + 1):
                    total += model.table[bucket(marked[i : i + size])]
                    n += 1
        logits = (total / n + model.bias) / model.temperature
        chances = np.exp(logits - logits.max())
        chances /= chances.sum()
        assert name == model.languages[int(chances.argmax())] and math.isclose(score, chances.max(), rel_tol=1e-4)


def test_many_languages_are_all_learnt(spark):
    # More languages than the embeddings have dimensions: each has letters of its own.
    letters = [chr(0x61 + i % 26) * 2 + chr(0x61 + i // 26) for i in range(40)]
    rows = [(i * 40 + k, " ".join([letters[k] + w for w in ("on", "er", "st", "al")] * 3), f"l{k:02}") for k in range(40) for i in range(25)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(docs, epochs=4)
    assert len(model.languages) == 40 and model.linear is not None
    got = language_id.identify_languages(docs, model).join(docs.select("doc_id", "lang"), "doc_id")
    assert got.filter("lang_pred = lang").count() > 0.9 * len(rows)


def test_equal_language_scores_go_to_the_first(spark):
    model = language_id.LanguageModel(["aa", "bb"], np.zeros((language_id.BUCKETS, 2), dtype=np.float32), None, np.zeros(2), 1.0, 0.0)
    names, scores, rejected = language_id.predict_slice(pa.array(["any text", ""]), model)
    assert names.to_pylist() == ["aa", "und"] and scores.tolist() == [0.5, 0.0] and rejected.tolist() == [False, True]


def test_quality_scores_follow_from_the_model():
    rng = np.random.default_rng(2)
    n = len(quality.STATISTICS)
    model = quality.QualityModel(rng.normal(size=n), rng.uniform(0.5, 2, n), rng.normal(size=quality.FEATURES + 1), np.array([-1.0, 0.0, 0.0, 1.0]), np.array([0.0, 0.2, 0.7, 1.0]))
    x = rng.normal(size=(5, n))
    draw = np.random.default_rng(3)
    directions, phases = draw.normal(0, 1 / quality.BANDWIDTH, (n, quality.FEATURES)), draw.uniform(0, 2 * np.pi, quality.FEATURES)
    for row, got in zip(x, quality.apply(x.astype(np.float32), model)):
        scaled = [min(6, max(-6, (float(np.float32(v)) - m) / s)) for v, m, s in zip(row, model.mean, model.scale)]
        raw = model.weights[-1] + sum(w * math.sqrt(2 / quality.FEATURES) * math.cos(sum(a * d for a, d in zip(scaled, directions[:, j])) + phases[j]) for j, w in enumerate(model.weights[:-1]))
        assert math.isclose(got, min(1, max(0, float(np.interp(raw, model.knots, model.levels)))), rel_tol=1e-6, abs_tol=1e-6)


def test_partition_sums_do_not_depend_on_the_tree(spark, small):
    docs, labels = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.described(docs)
    one, many = quality.train(rows.coalesce(1), labels), quality.train(rows.repartition(70), labels)
    assert np.allclose(one.weights, many.weights, rtol=1e-4, atol=1e-5)


def test_leaves_are_shared_by_equal_stretches():
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 8))) for _ in range(2000)]
    text = " ".join(rng.choices(words, k=900))
    other = " ".join(rng.choices(words, k=900))
    like = lambda a, b: document_trees.likeness(*document_trees._describe([a])[0][:2], *document_trees._describe([b])[0][:2])
    assert like(text, text) == 1.0 and like(text, other) < 0.1
    assert like(text, f"{other[:40]} {text}") > 0.85  # an insertion moves no later bounds
    shares = [like(text, text[: len(text) * k // 4] + other[len(text) * k // 4 :]) for k in (1, 2, 3)]
    assert shares == sorted(shares) and abs(shares[1] - 0.5) < 0.15
    assert document_trees.root(document_trees.tree(text)) != document_trees.root(document_trees.tree(text.replace(" ", "  ", 1)))


def test_repeated_and_null_ids_over_many_ranges(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(rng.choice([1, 1, 1, 2, 3, 900, None]), " ".join(rng.choices(WORDS, k=rng.randint(0, 30)))) for _ in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    whole = sorted(map(repr, document_trees.compare_with_next(docs).collect()))
    monkeypatch.setattr(document_trees, "BLOCK_CHARS", 500)
    assert sorted(map(repr, document_trees.compare_with_next(docs.repartition(7)).collect())) == whole


def next_fit(lengths, room=packing.TOKENS):
    """Whole documents in order; one that does not fit opens the next sequence, a longer one is cut at its size."""
    used, sequences = room, 0
    for n in lengths:
        sequences += n // room
        n %= room
        if used + n > room:
            sequences, used = sequences + 1, 0
        used += n
    return sequences


def test_loss_limit_binds_and_padding_is_less_than_next_fit():
    rng = random.Random(7)
    lengths = [min(60_000, int(rng.lognormvariate(6, 1.1)) + 1) for _ in range(6000)]
    packer = packing.Packer(packing.TOKENS, packing.SEGMENTS, packing.LOSS)
    pieces = [p for i, n in enumerate(lengths) for p in packer.add(i, n, n // 2)] + list(packer.finish())
    total, loss, got = collections.Counter(), collections.Counter(), collections.defaultdict(list)
    for key, start, length, sequence, offset in pieces:
        assert offset == total[sequence]
        total[sequence] += length
        loss[sequence] += max(0, start + length - max(start, lengths[key] // 2))
        got[key].append((start, length))
    assert all(sum(n for _, n in v) == lengths[k] and all(a + n == b for (a, n), (b, _) in zip(sorted(v), sorted(v)[1:])) for k, v in got.items())
    assert max(loss.values()) == packing.LOSS and sum(x == packing.LOSS for x in loss.values()) > 10
    padded = sum(n if n & (n - 1) == 0 else packing.TOKENS for n in total.values())
    assert padded == sum(lengths) < 0.95 * packing.TOKENS * next_fit(lengths)


def test_a_cluster_without_a_shared_folder_is_refused():
    class Conf:
        def get(self, name, default=None):
            return default

    class Session:
        conf = Conf()

        class sparkContext:
            master = "spark://somewhere:7077"

            class _jsc:
                class sc:
                    def getCheckpointDir(self):
                        return self

                    def isEmpty(self):
                        return True

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_folder(Session())


def test_clashing_extra_columns_in_every_stage(spark, small):
    import corpus_pipeline

    docs = spark.read.parquet(f"{small}/documents.parquet").withColumns({c: F.lit(c) for c in ("score", "text_hash", "fp", "comp", "predicted", "spans", "place", "kept_id")})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, small)
        assert out.columns == docs.columns and out.count() <= docs.count(), name


def test_few_links_are_connected_in_one_task(spark, monkeypatch):
    rng = np.random.default_rng(5)
    chain, star = [(-i, -i - 1) for i in range(1, 300)], [(5_000, 5_001 + i) for i in range(300)]
    loose = [tuple(x) for x in rng.integers(10_000, 10_700, (400, 2)).tolist()]
    links = [*chain, *star, *loose, (7, 7)]
    least = {x: x for pair in links for x in pair}
    while any(least[a] != least[b] for a, b in links):
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
    wanted = {x: root for x, root in least.items() if x != root}
    frame = spark.createDataFrame(links, "a long, b long").repartition(8)
    spark.sparkContext.setJobGroup("few links", "")
    found = near_duplicates.connected(frame, rows=len(links)).collect()
    tracker = spark.sparkContext.statusTracker()
    tasks = sum(tracker.getStageInfo(s).numTasks for j in tracker.getJobIdsForGroup("few links") for s in tracker.getJobInfo(j).stageIds if tracker.getStageInfo(s))
    spark.sparkContext.setJobGroup("", "")
    assert len(found) == len(wanted) and {r.node: r.root for r in found} == wanted
    assert 0 < tasks < 60
    monkeypatch.setattr(near_duplicates, "FILE_ROWS", 100)
    more = near_duplicates.connected(frame, rows=len(links)).collect()
    assert len(more) == len(wanted) and {r.node: r.root for r in more} == wanted
    assert near_duplicates.connected(frame.limit(0), rows=0).collect() == []
