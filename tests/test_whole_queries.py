"""Queries that SQL cannot express, over whole tables, against plain Python."""

import collections
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from triagelake.operators import casework, head, privacy
from triagelake.plans import queries
from triagelake.plans import standins as S
from triagelake.sources import tables


def redacted(text, people=(), places=()):
    """One text, written out: every detector and name, stronger first, then longer, then earlier; placeholders numbered by first appearance."""
    text, names = text or "", []
    order = {t: i for i, t in reversed(list(enumerate(d[0] for d in privacy.DETECTORS)))}
    trim = lambda values: list(dict.fromkeys(v for v in (x.strip() for x in values or ()) if len(v) >= 2))
    known = [("name", v) for v in trim(people)] + [("place", v) for v in trim(places)]
    own = {v.lower() for _, v in known}
    for kind, v in known:
        names += [(kind, *m.span()) for m in re.finditer(rf"\b{re.escape(v)}\b", text, re.I | re.ASCII)]
    for kind, flags, group, rx in privacy.DETECTORS:
        names += [(kind, m.start(group), m.end(group)) for m in re.finditer(rx, text, (re.I if "i" in flags else 0) | re.ASCII)]
    graded = set()
    for kind, a, b in names:
        value = text[a:b]
        if not value or kind == "name" and value.lower() in privacy.NOT_A_NAME and value.lower() not in own:
            continue
        if kind == "phone" and len(re.sub("[^0-9]", "", value)) < privacy.LEAST_PHONE_DIGITS:
            continue
        graded.add((-1 if value.lower() in own else order.get(kind, -1), a - b, a, b, kind, value))
    kept = []
    for s in sorted(graded):
        if all(s[3] <= k[2] or k[3] <= s[2] for k in kept):
            kept.append(s)
    kept.sort(key=lambda s: s[2])
    values = collections.defaultdict(list)
    for *_, kind, value in kept:
        if value.lower() not in values[kind]:
            values[kind].append(value.lower())
    out, at = "", 0
    for _, _, a, b, kind, value in kept:
        number = f" {values[kind].index(value.lower()) + 1}" if len(values[kind]) > 1 else ""
        out, at = out + text[at:a] + f"[{kind}{number}]", b
    return out + text[at:], kept


@pytest.fixture(scope="module")
def known(spark, small):
    return queries._known(spark, small).collect()


def test_redacted_turns(spark, small, known):
    want = {(r["case_id"], r["turn"]): redacted(r["text"], r["people"], r["places"]) for r in known}
    got = {(r["case_id"], r["turn"]): r for r in queries.redacted_turns(spark, small).collect()}
    assert {k: (r["redacted"], r["n_spans"]) for k, r in got.items()} == {k: (t, len(s)) for k, (t, s) in want.items()} and any(s for _, s in want.values())


def test_redacted_documents_and_their_counts(spark, small):
    docs = tables.table(spark, small, "documents").collect()
    want = {r["doc_id"]: redacted(r["text"]) for r in docs}
    import hashlib

    got = {r["id"]: (r["n_spans"], r["redacted_sha1"]) for r in queries.redacted_documents(spark, small).collect()}
    assert got == {i: (len(s), hashlib.sha1(t.encode()).hexdigest()) for i, (t, s) in want.items()}
    counts = collections.Counter(s[4] for _, spans in want.values() for s in spans)
    assert {r["type"]: r["n"] for r in queries.span_type_counts(spark, small).collect()} == counts and counts


def test_every_detector_on_random_talk(spark):
    import random

    rng = random.Random(11)
    said = ["a@b.co", " www.x.y ", "https://q.r/s", "+44 20 7946 0958", " 0123 4567 89 ", " SW1A 2AA", " (@kai_1", " 12 Long Lane", " Oak Park School", " called Ann", " Ann said", " and Bob", " told Eve", " mum said", " É", ".", "\n", " with Kai", " Leeds", " leeds", " bob"]
    rows = [(i, "".join(rng.choice(said) for _ in range(rng.randint(0, 9))), rng.sample(["Bob", "Ann", "kai", " x", "Kai"], 2), rng.choice([["Leeds"], [], None])) for i in range(400)]
    got = {r["id"]: r for r in privacy.redact(spark.createDataFrame(rows, "id int, text string, people array<string>, places array<string>")).collect()}
    kinds = set()
    for i, text, people, places in rows:
        want, spans = redacted(text, people, places)
        kinds |= {s[4] for s in spans}
        assert got[i]["redacted"] == want and [(s["a"], s["b"], s["type"]) for s in got[i]["spans"]] == [(s[2], s[3], s[4]) for s in spans]
    assert len(kinds) >= 9


def test_receipts_hold_no_text_as_it_was(spark, small, known):
    want = {(r["case_id"], "turn", r["turn"]): redacted(r["text"], r["people"], r["places"])[0] for r in known}
    cases = {r["case_id"] for r in known}
    want |= {(r["case_id"], "access", r["seq"]): casework.ACCESS[r["action"]] for r in S.access(spark, small).collect() if r["case_id"] in cases}
    assert {(r["case_id"], r["part"], r["place"]): r["what"] for r in queries.case_receipt(spark, small).collect()} == want


def test_isotonic_knots_are_those_of_pooling_neighbours(spark, small):
    rows = [(r["s"], r["y"], r["n"]) for r in S.predictions(spark, small).select(F.get("probs", F.lit(1)).alias("score"), (F.col("y_true") == 1).cast("double").alias("label")).groupBy(F.least(F.floor(F.col("score") * 1000), F.lit(999)).alias("bin")).agg(F.avg("score").alias("s"), F.avg("label").alias("y"), F.count("*").alias("n")).collect()]
    blocks = []
    for s, y, n in sorted(rows):
        blocks.append([s, s, y * n, n])
        while len(blocks) > 1 and blocks[-2][2] / blocks[-2][3] >= blocks[-1][2] / blocks[-1][3]:
            low, _, total, n_ = blocks.pop(-2)
            blocks[-1] = [low, blocks[-1][1], blocks[-1][2] + total, blocks[-1][3] + n_]
    got = queries.isotonic_fit(spark, small).orderBy("knot", "level").collect()
    xs, ys = [r["knot"] for r in got], [r["level"] for r in got]
    assert xs == sorted(xs) and ys == sorted(ys)
    for s, _, _ in rows:
        want = next(t / n for a, b, t, n in blocks if a <= s <= b)
        assert np.interp(s, xs, ys) == pytest.approx(want, abs=1e-9)


def test_temperature_is_the_best_there_is(spark, small):
    rows = S.predictions(spark, small).select("y_true", F.transform("probs", lambda p: F.log(p) * 3).alias("logits")).collect()
    z, y = np.array([r["logits"] for r in rows]), np.array([r["y_true"] for r in rows])

    def loss(t):
        p = z / t - (z / t).max(axis=1, keepdims=True)
        return -(p - np.log(np.exp(p).sum(axis=1, keepdims=True)))[np.arange(len(y)), y].mean()

    report = {r["stage"]: r for r in queries.temperature_fit(spark, small).collect()}
    fitted = max(report.values(), key=lambda r: r["temperature"])
    best = min(loss(t) for t in np.geomspace(0.05, 20, 4000))
    assert len(report) == 2 and loss(fitted["temperature"]) < best + 1e-4 and abs(fitted["nll"] - loss(fitted["temperature"])) < 1e-3


def test_cards_are_whole(spark, small):
    import json

    cards = {r["case_id"]: json.loads(r["card"]) for r in queries.escalation_cards(spark, small).collect()}
    people = {r["case_id"]: r for r in S.entities(spark, small).collect()}
    for case, card in cards.items():
        assert set(card) >= {"handle", "confidence", "tier_floor_reason", "gate_floor", "gate_indicators", "cited_quotes", "entities", "session_timeline", "delta_since_last_session", "pattern_cluster_id", "retention_expires_at", "reasons", "queue_rank", "escalation", "model_tier", "sla_hours", "action", "crisis_shown", "n_student_turns", "started_at"}
        assert card["entities"] == {"people": people[case]["people"], "places": people[case]["places"], "platforms": []}
        assert [t["turn_id"] for t in card["session_timeline"]] == [f"turn-{i}" for i in range(card["n_student_turns"])]
    clusters = spark.createDataFrame([(next(iter(cards)), "cluster-x")], "case_id string, cluster_id string")
    decided = queries._decided(spark, small).join(S.cases(spark, small).select("case_id", "handle", "started_at"), "case_id")
    none = spark.createDataFrame([], "case_id string, turn long, risk double"), spark.createDataFrame([], "case_id string, rank long, turn long, quote string, score double, reason string")
    bare = casework.build_cards(decided, *none, clusters=clusters).collect()
    assert [r["case_id"] for r in bare if r["pattern_cluster_id"] == "cluster-x"] == [next(iter(cards))] and all(r["entities"]["people"] == [] and r["cited_quotes"] == [] for r in bare)


def test_majority_and_ranked_features(spark):
    rows = spark.createDataFrame([("b",), ("a",), ("a",), ("b",), ("c",)], "l string")
    assert tuple(head.majority(rows, "l").first()) == ("a", 2)
    p = queries.HEAD
    weights = head.rank_features(p)
    assert [w for _, w in weights] == sorted((w for _, w in weights), reverse=True) and dict(weights)["max_risk"] == pytest.approx(sum(abs(r[0]) for r in p.coef) / 5)
