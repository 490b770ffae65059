"""Ranks, fits, loads and store operators on literal rows and against plain calculations."""

import collections
import datetime
import math
import random
import re

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from triagelake.functions import ranking
from triagelake.functions import text as T
from triagelake.functions.fixed_values import PATTERNS
from triagelake.operators import casework, cluster, corpus, features, gate, head, metrics, privacy
from triagelake.plans import standins
from triagelake.sources import seed, tables

def key():
    return F.unhex(F.sha2(F.lit("not a secret"), 256))


def test_ranks_equal_a_window_over_the_whole_group(spark):
    rng = random.Random(1)
    rows = spark.createDataFrame([(i, rng.choice(["a", "a", "a", "b", None])) for i in range(500)], "row_id long, g string")
    window = Window.partitionBy("g").orderBy(F.sha1(F.col("row_id").cast("string")), "row_id")
    plain = {r["row_id"]: (r["r"], r["n"]) for r in rows.withColumn("r", F.row_number().over(window)).withColumn("n", F.count("*").over(Window.partitionBy("g"))).collect()}
    assert {r["row_id"]: (r["_rank"], r["_size"]) for r in ranking.hash_ranked(rows.repartition(7), ["g"], "row_id").collect()} == plain


def test_recall_curve_counts_all_positives(spark):
    rng = random.Random(2)
    rows = [(i, round(rng.random(), 1), int(rng.random() < 0.3)) for i in range(200)]
    got = {r["k"]: r["recall"] for r in metrics.recall_curve(spark.createDataFrame(rows, "id long, score double, positive long"), (10, 20)).collect()}
    order, total = sorted(rows, key=lambda r: (-r[1], r[0])), sum(r[2] for r in rows)
    assert got == {k: sum(r[2] for r in order[:k]) / total for k in (10, 20, total)}
    assert metrics.recall_curve(spark.createDataFrame([], "id long, score double, positive long")).count() == 0


def test_temperature_is_the_best_of_a_fine_grid(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(3), [rng.gauss(0, 1) for _ in range(3)]) for _ in range(300)]
    rows = [(y, [x + 4 * (i == y) for i, x in enumerate(z)]) for y, z in rows]

    def loss(t):
        out = 0.0
        for y, z in rows:
            powers = [math.exp((x - max(z)) / t) for x in z]
            out -= math.log(max(powers[y] / sum(powers), 1e-12))
        return out / len(rows)

    frame = spark.createDataFrame(rows, "y_true long, logits array<double>")
    found = metrics.fit_temperature(frame)
    assert loss(found) <= min(loss(0.05 * 1.03**k) for k in range(200)) + 1e-4
    report = {r["stage"]: r for r in metrics.calibration_report(frame, found).collect()}
    assert report["scaled"]["nll"] <= report["raw"]["nll"] and report["scaled"]["accuracy"] == report["raw"]["accuracy"]


def test_isotonic_knots_are_bounded(spark):
    rows = spark.range(5000).select((F.col("id") / 5000).alias("score"), (F.rand(1) < F.col("id") / 5000).cast("double").alias("label"))
    knots, levels = head.fit_isotonic(rows, bins=50)
    assert len(knots) <= 100 and levels == sorted(levels) and abs(levels[len(levels) // 2] - 0.5) < 0.2


def test_out_of_fold_never_sees_its_case(spark):
    rng = random.Random(4)
    rows = spark.createDataFrame([(f"c{i}", f"T{i % 5}", (i % 5) + rng.gauss(0, 0.3), rng.gauss(0, 1)) for i in range(100)], "case_id string, tier string, x double, z double")
    out = head.out_of_fold(rows, ("x", "z"), k=3, inner=2).collect()
    assert len({r["case_id"] for r in out}) == 100 and {r["fold"] for r in out} == {0, 1, 2}
    assert all(len(r["probs"]) == 5 and 0 <= r["escalation"] <= 1 for r in out) and sum(r["model_tier"] == r["tier"] for r in out) > 60


def test_text_vectors_follow_from_counts(spark):
    texts = ["Big cats run", "big dogs run, a run", "the cats sleep", "Dögs sleep", "big cats sleep"] * 2
    rows = spark.createDataFrame([(i, t, "xy"[i % 2]) for i, t in enumerate(texts)], "row_id long, text string, label string")
    model = head.fit_text_baseline(rows)

    def words(t):
        own = re.findall(r"\w\w+", t.lower().replace("ö", "o"))
        return own + [f"{a} {b}" for a, b in zip(own, own[1:])]

    def chars(t):
        out = []
        for w in t.lower().split():
            w = f" {w} "
            for n in (3, 4, 5):
                if n == 3 or len(w) >= n:
                    out += [w[i : i + n] for i in range(max(1, len(w) - n + 1))]
        return out

    got = model.vectors(rows).orderBy("row_id").collect()
    want = [{} for _ in texts]
    for terms, least, names in ((words, 2, model.words.vocabulary), (chars, 3, model.chars.vocabulary)):
        df = collections.Counter(t for x in texts for t in set(terms(x)))
        assert set(names) == {t for t, n in df.items() if n >= least}
        for i, x in enumerate(texts):
            own = {t: (1 + math.log(n)) * (math.log((1 + len(texts)) / (1 + df[t])) + 1) for t, n in collections.Counter(terms(x)).items() if df[t] >= least}
            norm = math.sqrt(sum(v * v for v in own.values())) or 1.0
            want[i] |= {(least, t): v / norm for t, v in own.items()}
    for row, plain in zip(got, want):
        names = [(2, t) for t in model.words.vocabulary] + [(3, t) for t in model.chars.vocabulary]
        mine = {names[j]: v for j, v in zip(row["x"].indices.tolist(), row["x"].values.tolist())}
        assert mine.keys() == plain.keys() and all(math.isclose(mine[t], plain[t], rel_tol=1e-9) for t in plain)
    assert set(r["predicted"] for r in model.predict(rows).collect()) <= {"x", "y"}


def test_prefilter_never_loses_a_match(spark):
    import pyarrow as pa
    import pyarrow.compute as pc

    union = gate.prefilter(PATTERNS)
    rng = random.Random(5)
    pieces = "i i'm im've going to kill myself my knife tonight he said he'll stab me never want die\n the school é self-harm self harm cutting arms no ıts ſtab K1ll hurt   killing pills would told".split(" ")
    said = [rng.choice(["", "é", " "]).join([" ".join(rng.choices(pieces, k=rng.randint(2, 12)))]) for _ in range(3000)]
    look = pc.match_substring_regex(pa.array([s.lower() for s in said]), union).to_pylist()
    rules = [re.compile(rx, re.I | re.S) for *_, rx in PATTERNS]
    assert union and all(maybe or not any(rx.search(s.lower()) for rx in rules) for s, maybe in zip(said, look)) and not all(look)
    assert gate.prefilter((("c", "s", "n", r"a(?!b)"),)) is None


def test_gate_card_of_a_case_without_a_floor(spark):
    turns = spark.createDataFrame([("a", 0, "hello"), ("a", 1, "there was a knife"), ("b", 0, "first"), ("b", 1, "last one"), ("c", 0, "i've been cutting my arms")], "case_id string, turn int, text string")
    hits = gate.real_hits(gate.turn_hits(turns), ["case_id"])
    cases = turns.select("case_id").distinct().withColumn("handle", F.lit("h")).withColumn("started_at", F.lit(datetime.datetime(2026, 1, 1)))
    cards = {r["case_id"]: r for r in casework.gate_cards(gate.verdicts(hits, cases, ["case_id"]), hits, turns, cases).collect()}
    assert {c: (r["tier"], r["queue_rank"], r["confidence"]) for c, r in cards.items()} == {"a": ("T0", 1.0, None), "b": ("T0", 1.0, None), "c": ("T4", 5.0, None)}
    assert cards["c"]["retention_expires_at"] is None and cards["c"]["sla_hours"] == 0 and cards["b"]["sla_hours"] is None
    quotes = {(r["case_id"], r["quote"], r["reason"].split(" / ")[0]) for r in casework.gate_quotes(hits, turns).collect()}
    assert quotes == {("a", "there was a knife", "weapon_mention"), ("b", "last one", "no explicit signal; most recent message"), ("c", "i've been cutting my arms", "self_harm_intent")}
    assert {(r["case_id"], r["turn"]): r["risk"] for r in casework.gate_timeline(hits, turns).collect()} == {("a", 0): 0, ("a", 1): 1, ("b", 0): 0, ("b", 1): 0, ("c", 0): 1}


def test_features_that_are_not_finite_fail(spark):
    row = {f: 0.0 for f in features.FEATURES} | {"case_id": "a"}
    fine = spark.createDataFrame([row])
    assert features.checked(fine).count() == 1
    with pytest.raises(Exception, match="max_risk"):
        features.checked(fine.withColumn("max_risk", F.lit(float("nan")))).collect()


def test_best_score_is_that_of_all_pairs(spark):
    rng = random.Random(6)
    words = spark.createDataFrame([(f"c{i:02}", rng.choice("abcdefghijklmnop")) for i in range(60) for _ in range(rng.randint(3, 40))], "case_id string, term string")
    parts = cluster._term_parts(words)
    every = cluster.bm25_pairs(words).agg(F.max("bm25")).first()[0]
    assert math.isclose(cluster.best_bm25(parts).first()["top"], every)


def test_redacted_text_is_asserted(spark):
    rows = spark.createDataFrame([(1, "a [name] here", None, None)], "id int, text string, people array<string>, places array<string>")
    assert privacy.assert_redacted(rows).count() == 1
    with pytest.raises(Exception, match="identifying"):
        privacy.assert_redacted(rows.withColumn("text", F.lit("mail kai@x.org"))).collect()


def test_seals_have_the_four_parts(spark):
    row = spark.range(1).select(privacy.seal(F.lit("kai – é"), key()).alias("s")).select("s", privacy.unseal(F.col("s"), key()).alias("v"), privacy.unseal(F.concat("s", F.lit("x")), key()).alias("bad"), privacy.unseal(F.lit("v2.a.b.c"), key()).alias("old")).first()
    version, nonce, tag, body = row["s"].split(".")
    assert version == "v1" and (len(nonce), len(tag)) == (16, 22) and row["v"] == "kai – é" and row["old"] is None and row["bad"] != "kai – é"
    sealed = spark.createDataFrame([("a", row["s"])], "case_id string, ciphertext string")
    requests = spark.createDataFrame([("a", "c1", "x" * 20), ("a", "c2", "short"), ("a", None, "x" * 30)], "case_id string, counsellor_id string, reason string")
    assert [(r["counsellor_id"], r["value"], r["action"]) for r in privacy.unseal_requests(sealed, requests, key()).collect()] == [("c1", "kai – é", "unsealed_pii")]


def test_seed_load(spark, tmp_path):
    turns = spark.createDataFrame([("a", 0, "student", "Kai told me"), ("a", 1, "assistant", "ok"), ("b", 0, "student", "hi"), ("z", 0, "student", "no card")], "case_id string, turn long, role string, text string")
    cards = spark.createDataFrame([("a", "h1", "T4", 0.5, datetime.datetime(2026, 1, 1)), ("b", "h2", "T1", 0.5, datetime.datetime(2026, 1, 1))], "case_id string, handle string, tier string, confidence double, started_at timestamp")
    known = spark.createDataFrame([("a", ["Kai"], [])], "case_id string, people array<string>, places array<string>")
    dry = seed.load(turns, cards, known, key()).first()
    assert (dry["cases"], dry["turns"], dry["turns_redacted"], dry["spans_found"], dry["spans_sealed"]) == (2, 3, 1, 1, 0)
    assert seed.load(turns, cards, known, key(), str(tmp_path / "one")).first()["spans_sealed"] == 1
    before = {n: spark.read.parquet(str(tmp_path / "one" / n)) for n in ("conversations", "turns", "pii")}
    seed.load(turns, cards, known, key(), str(tmp_path / "two"), before)
    after = {n: spark.read.parquet(str(tmp_path / "two" / n)) for n in before}
    assert all(after[n].count() == before[n].count() for n in before) and after["turns"].filter("case_id = 'a' and turn = 0").first()["text"] == "[name] told me"
    assert after["pii"].select(privacy.unseal(F.col("ciphertext"), key()).alias("v")).first()["v"] == "Kai"
    with pytest.raises(Exception, match="nothing was redacted"):
        seed.load(turns.filter("case_id = 'b'"), cards, known, key()).collect()


def test_sources_and_stores(spark, tmp_path):
    spark.createDataFrame([(1, "x"), (0, "y"), (1, None)], "flag int, body string").write.parquet(str(tmp_path / "src"))
    source = tables.Source("own", str(tmp_path / "src"), "body", lambda: F.when(F.col("flag") == 1, "harassment"))
    assert sorted((r["text"], r["harm"], r["source"]) for r in tables.read_source(spark, source).filter("text is not null").collect()) == [("x", "harassment", "own")]
    (tmp_path / "e.json").write_text('{"conversations": [{"caseId": "a", "people": ["Kai"], "places": [], "platforms": ["x"]}]}')
    assert tables.read_entities(spark, str(tmp_path / "e.json")).first()["people"] == ["Kai"]
    good = spark.createDataFrame([(1, 0, [0.1, 0.2])], "row_id long, y_true long, logits array<double>")
    good.write.parquet(str(tmp_path / "l"))
    assert tables.read_logits(spark, str(tmp_path / "l"), 2).first()["logits"] == [0.1, 0.2]
    with pytest.raises(Exception, match="bad logits"):
        tables.read_logits(spark, str(tmp_path / "l"), 3).collect()
    for _ in range(2):
        tables.append(spark.range(2), str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 4
    tables.write_sorted_json(spark.createDataFrame([(2,), (1,)], "n int"), str(tmp_path / "j"), "n")
    assert [r["n"] for r in spark.read.json(str(tmp_path / "j")).orderBy("n").collect()] == [1, 2]
    rows = spark.createDataFrame([("a", None), ("b", 1)], "k string, v int")
    assert [r["k"] for r in tables.stored(rows, v=None).collect()] == ["a"] and tables.stored(rows, (F.desc("k"),), 1).first()["k"] == "b"
    assert [r["e"] for r in spark.createDataFrame([(" A@x.org ",)], "v string").select(T.email_key(F.col("v")).alias("e")).collect()] == ["a@x.org"]


def test_alerts_hold_their_cases_and_tiers(spark):
    start = datetime.datetime(2026, 1, 1)
    cases = spark.createDataFrame([(c, start + datetime.timedelta(days=i)) for i, c in enumerate("abcd")], "case_id string, started_at timestamp")
    tokens = spark.createDataFrame([(c, "person", "x") for c in "abc"], "case_id string, kind string, token string")
    tiers = spark.createDataFrame([("a", "T1"), ("b", "T4")], "case_id string, tier string")
    row = cluster.alerts(tokens, cases, tiers).first()
    assert row["members"] == ["a", "b", "c"] and row["tiers"] == ["T1", "T4", None] and row["headline"] == "3 separate reports, naming the same person, within 2 days"
    members = cluster.alert_members(tokens, cases)
    found = cluster.alerts_of_cases(members, cluster.alert_facts(members, tokens, cases), tiers)
    assert sorted((r["case_id"], r["cluster_id"]) for r in found.collect()) == [("a", "cluster-a"), ("b", "cluster-a")]


def test_class_names(spark):
    rows = spark.createDataFrame([(" SuicideWatch ",), ("age",), ("x",), (None,)], "v string")
    assert [tuple(r) for r in rows.select(corpus.class_label(F.col("v"), corpus.SUBREDDITS), corpus.class_label(F.col("v"), corpus.BULLYING)).collect()] == [("self_harm", None), (None, "identity_attack"), (None, None), (None, None)]
    assert len(standins.SAID) == 20
