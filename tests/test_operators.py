"""Operators on literal rows: probes, invariants and metamorphic checks."""

import datetime
import itertools
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from triagelake.functions import text as T
from triagelake.functions.fixed_values import PATTERNS, SUPPRESSORS
from triagelake.operators import casework, cluster, corpus, features, gate, head, metrics, privacy
from triagelake.sources import tables

#: (what a student writes, floor)
PROBES = [
    ("we walked 5 kms for the charity thing", None), ("im gonna kill myself", "T4"), ("i'm going to end it all tonight", "T4"), ("he said he'd stab me after school", "T4"), ("i've been cutting my arms", "T4"), ("i have been cutting my arms", "T4"),
    ("this coursework is killing me", None), ("he told me to kill myself, and honestly i do want to die", "T4"), ("i would never kill myself", None), ("self harm", "T3"), ("there was a knife", None), ("someone brought a knife to school", "T3"), ("see you tomorrow", None), ("i w4nt t0 d!e", "T4"),
    ("k1ll my5elf", "T4"), ("", None), ("   ", None), (None, None), ("kai says he'll batter me", "T3"), ("i stopped cutting last year", None),
]


def plain_floor(turn):
    """The gate on one turn, written out directly."""
    low = (turn or "").lower()
    if not low.strip():
        return None, []
    norm = low.translate(str.maketrans("!1|34@0$57", "iiieaaosst"))
    hay = [low] if low == norm else [low, norm]
    flags, hits = re.I | re.S, []
    for category in gate.CATEGORIES:
        cancelled = [m.span() for c, _, rx in SUPPRESSORS if c == category for h in hay for m in re.finditer(rx, h, flags)]
        taken = []
        for severity in gate.WEIGHTS:
            for c, s, name, rx in PATTERNS:
                if (c, s) == (category, severity):
                    for h in hay:
                        for m in re.finditer(rx, h, flags):
                            if not any(m.start() < b and a < m.end() for a, b in taken) and not any(a <= m.start() and m.end() <= b for a, b in cancelled):
                                taken.append(m.span())
                                hits.append((category, severity, name, *m.span()))
    marked = any(gate.CATEGORIES[h[0]] is None for h in hits)
    tiers = []
    for severity, down in (("strong", 0), ("moderate", 1)):
        floors = [gate.CATEGORIES[h[0]] for h in hits if h[1] == severity and gate.CATEGORIES[h[0]]]
        if floors:
            tiers.append((4 if marked and max(floors) == 3 else max(floors)) - down)
    return (f"T{max(tiers)}" if tiers else None), hits


@pytest.fixture(scope="module")
def probe_turns(spark):
    return spark.createDataFrame([(f"c{i}", 0, t) for i, (t, _) in enumerate(PROBES)], "case_id string, turn int, text string")


def test_gate_probes(probe_turns):
    found = {r["case_id"]: r["floor"] for r in gate.verdicts(gate.turn_hits(probe_turns), probe_turns, ["case_id"]).collect()}
    assert [found[f"c{i}"] for i in range(len(PROBES))] == [floor for _, floor in PROBES] == [plain_floor(t)[0] for t, _ in PROBES]


def test_gate_equals_plain_gate_on_random_speech(spark):
    rng = random.Random(4)
    words = "i i'm going to kill myself my knife tonight he said he'll stab me never want die the school brought self harm cutting arms no tomorrow hurt killing 5 kms pills would told".split()
    said = [" ".join(rng.choices(words, k=rng.randint(3, 14))) for _ in range(400)]
    rows = spark.createDataFrame([(f"c{i}", 0, t) for i, t in enumerate(said)], "case_id string, turn int, text string")
    hits = gate.turn_hits(rows.repartition(5))
    mine = {}
    for r in hits.orderBy("case_id", "place").collect():
        mine.setdefault(r["case_id"], []).append((r["category"], r["severity"], r["name"], r["a"], r["b"]))
    floors = {r["case_id"]: r["floor"] for r in gate.verdicts(hits, rows, ["case_id"]).collect()}
    for i, t in enumerate(said):
        floor, plain = plain_floor(t)
        assert floors[f"c{i}"] == floor and mine.get(f"c{i}", []) == plain


def test_union_of_turns_promotes(spark):
    rows = spark.createDataFrame([("a", 0, "he said he'd stab me"), ("a", 1, "see you tomorrow"), ("b", 0, "see you tomorrow")], "case_id string, turn int, text string")
    found = {r["case_id"]: r for r in gate.verdicts(gate.turn_hits(rows), rows.select("case_id").distinct(), ["case_id"]).collect()}
    assert found["a"]["floor"] == "T4" and found["a"]["ceiling"] is None and found["b"]["n_hits"] == 0 and found["b"]["level"] == "clear"


def test_floor_is_never_lowered(spark):
    grid = spark.createDataFrame(list(itertools.product(range(5), [None, 1, 2, 3, 4], [None, 3], [True, False])), "p int, f int, c int, o boolean")
    tier, _ = gate.apply_verdict(F.col("p"), F.col("f"), F.col("c"), F.col("o"), F.lit("x"))
    assert all(r["t"] >= (r["f"] or 0) and (r["t"] >= r["p"] or r["c"] == 3) for r in grid.withColumn("t", tier).collect())


def test_features_are_finite_and_complete(spark, probe_turns):
    rows = probe_turns.withColumn("probs", F.array(*[F.lit(x) for x in (0.4, 0.1, 0.2, 0.1, 0.1, 0.1)]))
    got = features.featurise(gate.verdicts(gate.turn_hits(rows), rows, ["case_id"]), rows, rows.select("case_id", F.coalesce("text", F.lit("")).alias("account"))).collect()
    assert len(features.FEATURES) == 38 and len(got) == len(PROBES)
    assert all(r[f] is not None and r[f] == r[f] for r in got for f in features.FEATURES)
    assert [sum(len(features.GROUPS[g]) for g in rung) for rung in features.ABLATIONS.values()] == [13, 11, 24, 29, 36, 38]


def test_hmac_equals_library(spark):
    import hashlib
    import hmac

    row = spark.range(1).select(T.hmac_sha256(b"key", F.lit("person:kai")).alias("a"), T.hmac_sha256(b"k" * 100, F.lit("é")).alias("b")).first()
    assert row["a"] == hmac.new(b"key", b"person:kai", hashlib.sha256).hexdigest() and row["b"] == hmac.new(b"k" * 100, "é".encode(), hashlib.sha256).hexdigest()


def test_spanning_links_connect_what_all_links_connect(spark):
    rng = random.Random(5)
    start = datetime.datetime(2026, 1, 1)
    cases = spark.createDataFrame([(f"c{i:03}", start + datetime.timedelta(hours=rng.randrange(24 * 200))) for i in range(120)], "case_id string, started_at timestamp")
    tokens = spark.createDataFrame([(f"c{i:03}", "person", f"t{rng.randrange(25)}") for i in range(120)], "case_id string, kind string, token string")
    group = lambda edges: {r["node"]: r["component"] for r in cluster.components(edges.select("a", "b")).collect()}
    every, few = cluster.links(tokens, cases), cluster.spanning_links(tokens, cases)
    assert group(every) == group(few) and few.count() <= 2 * 120


def test_links_keep_the_window_inclusive(spark):
    start = datetime.datetime(2026, 1, 1)
    cases = spark.createDataFrame([("a", start), ("b", start + datetime.timedelta(days=14)), ("c", start + datetime.timedelta(days=28, seconds=1))], "case_id string, started_at timestamp")
    tokens = spark.createDataFrame([(c, "place", "x") for c in "abc"], "case_id string, kind string, token string")
    assert [(r["a"], r["b"]) for r in cluster.links(tokens, cases).collect()] == [("a", "b")]
    assert cluster.alerts(tokens, cases).count() == 0


def test_first_of_key_is_stable(spark):
    rows = spark.createDataFrame([(3, "b", "Same  text!"), (1, "a", "same text"), (2, "a", "SAME TEXT"), (4, "a", "other")], "row_id int, source string, text string")
    for n in (1, 4):
        assert sorted(r["row_id"] for r in corpus.first_of_key(rows.repartition(n), [F.col("source"), F.col("row_id")]).collect()) == [1, 4]


def test_reliability_edges(spark):
    rows = spark.createDataFrame([(0, 0, 1 / 15), (0, 0, 1.0), (0, 1, 2 / 15), (0, 0, 0.0)], "y_true long, y_pred long, conf double")
    counts = [r["n"] for r in metrics.reliability_bins(rows).orderBy("bin").collect()]
    assert counts == [2, 1] + [0] * 12 + [1]


def test_head_fit_and_isotonic(spark):
    rng = random.Random(6)
    rows = [(f"c{i}", f"T{t}", t + rng.gauss(0, 0.4), rng.gauss(0, 1)) for i in range(300) for t in [i % 5]]
    frame = spark.createDataFrame(rows, "case_id string, tier string, x double, z double")
    params = head.fit_head(frame, ("x", "z"))
    scored = head.apply_head(frame, params)
    assert scored.filter("model_tier = tier").count() > 200 and head.rank_features(params)[0][0] == "x"
    knots, levels = head.fit_isotonic(scored.select(F.col("raw_escalation").alias("score"), F.col("tier").isin("T3", "T4").cast("double").alias("label")))
    assert knots == sorted(knots) and levels == sorted(levels)
    assert all(r["n"] in (11, 12, 13) for r in head.folds(frame, "tier").groupBy("tier", "fold").agg(F.count("*").alias("n")).collect())


def test_redaction(spark):
    rows = [(1, "Kai told Jamie about it, mail kai@x.org or +44 7700 900123"), (2, "my mum hits me"), (3, None), (4, "Kai pushed me, then kai laughed. With Kai again"), (5, "see @sam_99 at 12 Elm Road")]
    frame = spark.createDataFrame([(i, t, ["kai"] if i == 4 else None, None) for i, t in rows], "id int, text string, people array<string>, places array<string>")
    out = {r["id"]: r["redacted"] for r in privacy.redact(frame).collect()}
    assert out[1] == "[name 1] told [name 2] about it, mail [email] or +[phone]" and out[2] == "my mum hits me" and out[3] == ""
    assert out[4] == "[name] pushed me, then [name] laughed. With [name] again" and out[5] == "see @[handle] at [address]"


def test_sealing(spark):
    key, other = F.unhex(F.sha2(F.lit("a"), 256)), F.unhex(F.sha2(F.lit("b"), 256))
    rows = spark.createDataFrame([("kai",), ("kai",)], "v string").withColumn("s", privacy.seal(F.col("v"), key))
    got = rows.select("s", privacy.unseal(F.col("s"), key).alias("back"), privacy.unseal(F.col("s"), other).alias("wrong")).collect()
    assert all(r["back"] == "kai" and r["wrong"] is None and r["s"].startswith("v1.") for r in got) and got[0]["s"] != got[1]["s"]


def test_retention_order_of_rules(spark):
    now = datetime.datetime(2026, 3, 1)
    rows = [("due", "T0", datetime.datetime(2026, 1, 30), None, None, None), ("new", None, datetime.datetime(2026, 2, 20), None, None, None), ("t4", "T4", datetime.datetime(2020, 1, 1), now, None, None), ("hold", "T1", datetime.datetime(2020, 1, 1), None, "why", None), ("glass", "T1", datetime.datetime(2020, 1, 1), None, None, None), ("gone", "T4", datetime.datetime(2020, 1, 1), None, "why", now)]
    frame = spark.createDataFrame(rows, "case_id string, tier string, started_at timestamp, retention_expires_at timestamp, retention_hold_reason string, content_deleted_at timestamp")
    got = {r["case_id"]: (r["exemption"], r["delete"]) for r in casework.retention_decisions(frame, spark.createDataFrame([("glass",)], "case_id string"), F.lit(now)).collect()}
    assert got == {"due": (None, True), "new": (None, False), "t4": ("escalated", False), "hold": ("explicit_hold", False), "glass": ("unreviewed_break_glass", False), "gone": ("already_deleted", False)}


def test_sources_and_sinks(spark, tmp_path):
    path = tmp_path / "c.jsonl"
    path.write_text('{"id": "s1", "tier": "T2", "handle": "h", "days_ago": 1.0, "turns": [{"role": "student", "text": "hi"}]}\n\n')
    assert tables.read_conversations(spark, str(path)).first()["turns"][0]["text"] == "hi"
    path.write_text('{"id": "s1"\n')
    with pytest.raises(Exception):
        tables.read_conversations(spark, str(path)).collect()
    probs = tmp_path / "p.json"
    probs.write_text(json.dumps({"label_order": list(features.HARMS), "probs": {"s1": [[1, 0, 0, 0, 0, 0]]}}))
    read = tables.read_probabilities(spark, str(probs), features.HARMS)
    assert read.count() == 1 and tables.stale_probabilities(read, spark.createDataFrame([("s1", 0), ("s1", 1)], "case_id string, turn int")).count() == 1
    with pytest.raises(Exception):
        tables.read_probabilities(spark, str(probs), ("other",)).collect()
    rows = spark.createDataFrame([("a", "train"), ("b", "test")], "text string, split string")
    tables.write_splits(rows, str(tmp_path / "splits"))
    assert spark.read.parquet(str(tmp_path / "splits")).filter("split = 'test'").count() == 1
    messages = spark.createDataFrame([(1, [("student", "x" * 2000)]), (2, [("assistant", "x")]), (3, [("student", "x")] * 41), (4, [])], "id int, messages array<struct<role:string,text:string>>")
    kept = tables.valid_requests(messages).collect()
    assert [r["id"] for r in kept] == [1] and len(kept[0]["messages"][0]["text"]) == 1000


def test_entry_without_training_data_package():
    import subprocess
    import sys

    code = "import sys; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q = e.queries(); assert q and not [n for n in q if n.startswith('op') or n == 'pipeline'] and set(e.oracle_sql()) <= set(q)"
    from tests.conftest import ROOT

    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_bank_sizes(spark):
    found = {r["category"]: r["n_patterns"] for r in gate.bank_sizes(spark).collect()}
    assert found == {c: sum(p[0] == c for p in PATTERNS) for c in gate.CATEGORIES} and sum(found.values()) == 66


def test_interpolation_through_very_many_knots(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    xs = np.sort(rng.random(2000)).tolist()
    ys = np.sort(rng.random(2000)).tolist()
    values = [0.0, 1.0, xs[0], xs[-1], *xs[5:50:7], *rng.random(300).tolist()]
    rows = spark.createDataFrame([(v,) for v in [*values, None]], "v double").select("v", T.interpolate(F.col("v"), xs, ys).alias("y")).collect()
    assert rows[-1]["y"] is None
    assert all(abs(r["y"] - np.interp(r["v"], xs, ys)) < 1e-9 for r in rows[:-1])
    few = spark.createDataFrame([(v / 4,) for v in range(-2, 7)], "v double").select(T.interpolate(F.col("v"), [0.0, 0.5, 0.5, 1.0], [0.0, 0.2, 0.6, 1.0]).alias("y"), T.interpolate(F.col("v"), [0.3], [0.7]).alias("one")).collect()
    assert [round(r["y"], 9) for r in few] == [0, 0, 0, 0.1, 0.6, 0.8, 1, 1, 1] and {r["one"] for r in few} == {0.7}


def test_reasons_of_white_space_are_none(spark):
    blanks = ["\n" * 12, "\t \r\n" * 20, "\u3000\u00a0\ufeff\u2003" * 12, " " * 60, "", None]
    log = spark.createDataFrame([(i, "c", "k", a, r, i) for i, r in enumerate([*blanks, "\n\u3000 a reason of some length that says a lot indeed\t\r\n "]) for a in ("viewed_transcript", "unsealed_pii", "overrode_tier", "broke_glass", "reviewed_break_glass")], "seq long, case_id string, counsellor_id string, action string, reason string, at long")
    kept = casework.valid_access(log).collect()
    assert {r["reason"] for r in kept} == {"a reason of some length that says a lot indeed"} and len(kept) == 5
    asked = log.withColumn("level", F.lit("identity")).withColumn("escalated", F.lit(True))
    assert {r["reason"] for r in casework.disclosure(asked).filter("allowed").collect()} == {log.collect()[-1]["reason"]}
    over = log.filter("action = 'overrode_tier'").withColumn("requested_tier", F.lit("T1")).withColumn("gate_floor", F.lit("T2")).withColumn("closed_at_tier", F.lit("T1"))
    read = log.filter("action = 'viewed_transcript'")
    assert [r["refusal"] for r in casework.decide_overrides(over, read).orderBy("seq").collect()] == ["reason too short"] * 6 + [None]
    glass = casework.decide_break_glass(over, read).orderBy("seq").collect()
    assert [r["refusal"] for r in glass] == ["reason too short"] * 6 + [None]
    reviews = log.select(F.lit(1).alias("record_id"), F.concat(F.lit("r"), F.col("seq")).alias("reviewer_id"), F.col("reason").alias("note"), "at", F.lit(True).alias("is_lead"))
    record = spark.createDataFrame([(1, "k", None, None)], "record_id int, counsellor_id string, reviewed_by string, reviewed_at long")
    assert [r["reviewed_by"] for r in casework.review_break_glass(record, reviews).collect()] == ["r6"]
    assert spark.createDataFrame([("\ufeff A@b.C\n",)], "e string").select(T.email_key(F.col("e")).alias("k")).first()["k"] == "a@b.c"
