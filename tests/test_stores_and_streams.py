"""Stores on disk that batches change in part, logs that take a batch once, and the state of a case over messages in any order."""

import datetime
import glob
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from triagelake.functions.ranking import numbered
from triagelake.operators import gate
from triagelake.plans import standins
from triagelake.sources import tables
from triagelake.sources.stores import AppendLog, BucketStore
from triagelake.streaming import cases
from triagelake.streaming import turns as streaming

SCHEMA = "case_id string, tier string, seq long, crisis boolean, awaiting boolean"


def files(folder):
    return {p: os.stat(p).st_ino for p in glob.glob(f"{folder}/rows/bucket=*/*.parquet")}


def rows(spark, *values):
    return spark.createDataFrame([(*v, *[None] * (5 - len(v))) for v in values], SCHEMA)


@pytest.fixture
def store(spark, tmp_path):
    made = BucketStore(spark, str(tmp_path / "s"), SCHEMA, buckets=16)
    made.upsert(rows(spark, *[(f"c{i}", "T0", 5, i % 2 == 0, True) for i in range(200)]))
    return made


def test_only_touched_buckets_are_rewritten(spark, store, tmp_path):
    before = files(tmp_path / "s")
    assert store.rows().count() == 200 and len({os.path.dirname(p) for p in before}) == 16
    store.upsert(rows(spark, ("c3", "T4", 6, False, True)))
    after = files(tmp_path / "s")
    changed = {os.path.dirname(p) for p in before.keys() ^ after.keys()}
    assert changed == {str(tmp_path / "s" / "rows" / f"bucket={store.bucket_number('c3')}")}
    assert all(before[p] == after[p] for p in before.keys() & after.keys())
    assert store.rows(case_id="c3").first()["tier"] == "T4" and store.rows().count() == 200


def test_store_keeps_latches_order_and_guards(spark, store):
    store.upsert(rows(spark, ("c2", "T1", 4, False), ("c4", "T1", 6, False), ("c5", "T1", 5, True), ("new", "T2", 1, None), (None, "T9", 9, True)), latch=("crisis",), newest="seq")
    got = {r["case_id"]: r for r in store.rows().collect()}
    assert (got["c2"]["tier"], got["c2"]["seq"], got["c2"]["crisis"]) == ("T0", 5, True)  # an older row never replaces a newer one
    assert (got["c4"]["tier"], got["c4"]["crisis"]) == ("T1", True) and (got["c5"]["tier"], got["c5"]["crisis"]) == ("T1", True)
    assert len(got) == 201 and got["new"]["crisis"] is False
    store.put_scored(spark.createDataFrame([("c7", "T3"), ("stranger", "T3")], "case_id string, tier string"), ("tier",))
    assert (store.rows(case_id="c7").first()["tier"], store.rows(case_id="c7").first()["awaiting"]) == ("T3", False) and store.rows(case_id="stranger").count() == 0
    store.update_where((F.col("case_id") == "c9") & F.col("awaiting"), awaiting=F.lit(False), tier=F.lit("T2"))
    store.update_where((F.col("case_id") == "c9") & F.col("awaiting"), tier=F.lit("T4"))
    assert store.rows(case_id="c9").first()["tier"] == "T2" and store.rows(tier="T2").count() == 2


def test_children_are_replaced_and_erased_whole(spark, tmp_path):
    turns = BucketStore(spark, str(tmp_path / "t"), "case_id string, turn long, text string", buckets=8)
    turns.replace_children(spark.createDataFrame([(f"c{i}", t, "x") for i in range(30) for t in range(4)], "case_id string, turn long, text string"))
    turns.replace_children(spark.createDataFrame([("c1", 0, "y")], "case_id string, turn long, text string"), parents=spark.createDataFrame([("c1",), ("c2",)], "case_id string"))
    assert [(r["turn"], r["text"]) for r in turns.rows(case_id="c1").collect()] == [(0, "y")] and turns.rows(case_id="c2").count() == 0 and turns.rows().count() == 113
    turns.erase(turns.rows())  # every bucket is empty now
    assert turns.rows().count() == 0
    turns.replace_children(spark.createDataFrame([("c1", 0, "z")], "case_id string, turn long, text string"))
    assert [r["text"] for r in turns.rows().collect()] == ["z"]


def test_a_lost_overwrite_is_played_again(spark, store, tmp_path, monkeypatch):
    monkeypatch.setattr(BucketStore, "_finish", lambda self: None)
    store.upsert(rows(spark, ("c1", "T4", 9, True)))
    monkeypatch.undo()
    for path in glob.glob(str(tmp_path / "s" / "rows" / f"bucket={store.bucket_number('c1')}" / "*.parquet")):
        os.remove(path)  # lost between the delete and the rename
    assert store.rows().count() == 200 and store.rows(case_id="c1").first()["tier"] == "T4" and not os.path.exists(tmp_path / "s" / "redo")
    os.makedirs(tmp_path / "s" / "redo")
    (tmp_path / "s" / "redo" / "part-0.parquet").write_text("half")  # a copy that was not written to its end
    assert store.rows().count() == 200


def test_point_reads_look_into_one_bucket(store):
    plan = store.rows(case_id="c3")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "PushedFilters: [IsNotNull(case_id), EqualNullSafe(case_id,c3)" in plan
    assert store.rows(case_id="c3").select("_metadata.file_path").distinct().count() == 1


def test_a_log_takes_a_batch_once(spark, tmp_path):
    log = AppendLog(spark, str(tmp_path / "log"), "case_id string, at long, what string")
    batch = lambda n, k: spark.createDataFrame([(f"c{i % 3}", (i * 7) % k, f"{n}-{i}") for i in range(k)], "case_id string, at long, what string").repartition(5)
    assert log.rows().count() == 0
    assert log.append(batch("a", 40), 0) and log.append(batch("b", 25), 1) and not log.append(batch("a", 40), 0) and log.append(batch("c", 0), 2)
    got = sorted(log.rows().collect(), key=lambda r: r["seq"])
    assert [r["seq"] for r in got] == list(range(65)) and [r["what"][0] for r in got] == ["a"] * 40 + ["b"] * 25
    assert [r["at"] for r in got[:40]] == sorted(r["at"] for r in got[:40])
    spark.createDataFrame([("c0", 1, "lost", 65)], "case_id string, at long, what string, seq long").write.parquet(str(tmp_path / "log" / "rows" / "batch=3"))
    assert log.rows().count() == 65  # a run that was lost before its entry
    assert log.append(batch("d", 5), 3) and sorted(r["seq"] for r in log.rows().collect()) == list(range(70))
    newest = [(r["place"], r["at"], r["seq"]) for r in log.newest("case_id", 2).filter("case_id = 'c1'").orderBy("place").collect()]
    every = sorted(((r["at"], r["seq"]) for r in log.rows().filter("case_id = 'c1'").collect()), reverse=True)[:2]
    assert newest == [(i + 1, *x) for i, x in enumerate(every)]


def test_numbers_follow_the_order_over_ranges(spark):
    many = spark.range(5000).select((F.col("id") * 7919 % 5000 / 10).cast("long").alias("at"), "id")
    got = [(r["at"], r["id"], r["n"]) for r in numbered(many, [F.col("at"), F.col("id")], "n", 3).collect()]
    assert sorted(x[2] for x in got) == list(range(3, 5003)) and [x[:2] for x in sorted(got, key=lambda x: x[2])] == sorted(x[:2] for x in got)


# ---- the state of a case

DAY = datetime.datetime(2026, 1, 1)


class Stream:
    def __init__(self, spark, folder, **options):
        self.spark, self.folder, self.options, self.n = spark, folder, options, 0
        (folder / "in").mkdir()

    def send(self, *messages):
        """Each list of messages is a batch; a run of its own, from the checkpoint, takes them."""
        for batch in messages:
            lines = [json.dumps({"case_id": c, "seq": s, "first": f, "turns": t, "at": (DAY + datetime.timedelta(days=day)).isoformat()}) for c, s, f, t, day in batch]
            (self.folder / "in" / f"{self.n:05d}.json").write_text("\n".join(lines))
            os.utime(self.folder / "in" / f"{self.n:05d}.json", (1_700_000_000 + self.n, 1_700_000_000 + self.n))
            self.n += 1
        events = streaming.read_events(self.spark, str(self.folder / "in"), 1)
        streaming.run_gate(events, str(self.folder / "out"), str(self.folder / "cp"), buckets=4, **self.options).awaitTermination()
        return {r["case_id"]: r for r in streaming.verdict_store(self.spark, str(self.folder / "out"), 4).rows().collect()}


def test_older_resends_never_lower_and_crisis_latches(spark, tmp_path):
    stream = Stream(spark, tmp_path)
    got = stream.send([("a", 7, 0, ["hello", "i've been cutting my arms"], 0), ("b", 1, 0, ["hi"], 0)])
    assert got["a"]["floor"] == "T4" and got["a"]["crisis"] and got["b"]["floor"] is None and not got["b"]["crisis"]
    got = stream.send([("a", 3, 0, ["hello"], 0)])  # after a restart
    assert (got["a"]["floor"], got["a"]["seq"], got["a"]["n_turns"]) == ("T4", 7, 2)
    got = stream.send([("a", 8, 0, ["hello"], 0), ("b", 2, 1, ["self harm"], 0), ("c", 2, 1, ["see you"], 0)])
    assert (got["a"]["floor"], got["a"]["seq"], got["a"]["crisis"]) == (None, 8, True)
    assert (got["b"]["floor"], got["b"]["n_turns"], got["b"]["complete"]) == ("T3", 2, True) and not got["c"]["complete"]
    got = stream.send([("c", 1, 0, ["im gonna kill myself"], 0)])
    assert got["c"]["complete"] and got["c"]["floor"] == "T4" and got["c"]["seq"] == 2


def test_messages_in_any_order_give_the_batch_gates_verdict(spark, tmp_path):
    rng, said = random.Random(3), ["the cat", "a dog by the sea", "in and out", "nothing", "or now", ""]
    truth, messages = {}, []
    for c in range(12):
        turns = []
        for seq in range(1, rng.randint(2, 7)):
            if rng.random() < 0.4:
                first = len(turns)
            else:
                first, turns = 0, (turns if rng.random() < 0.7 else turns[: rng.randint(0, len(turns))])
            turns = [*turns, *[rng.choice(said) for _ in range(rng.randint(1, 2))]]
            messages.append((f"c{c}", seq, first, turns[first:], rng.random()))
        truth[f"c{c}"] = turns
    repeated = [*messages, *rng.sample(messages, 10)]
    rng.shuffle(repeated)
    got = Stream(spark, tmp_path, patterns=standins.VOCABULARY, suppressors=(), late="10 days").send(*[repeated[i::4] for i in range(4)])
    assert got.keys() == truth.keys() and all(r["complete"] and r["n_turns"] == len(truth[c]) for c, r in got.items())
    turns = spark.createDataFrame([(c, i, t) for c, ts in truth.items() for i, t in enumerate(ts)], "case_id string, turn int, text string")
    want = {r["case_id"]: r for r in gate.verdicts(gate.turn_hits(turns, standins.VOCABULARY, ()), turns.select("case_id").distinct(), ["case_id"]).collect()}
    events = spark.createDataFrame([(c, s, f, t, DAY) for c, s, f, t, _ in repeated], "case_id string, seq long, first long, turns array<string>, at timestamp")
    batch = {r["case_id"]: r for r in cases.folded(events, standins.VOCABULARY, ()).collect()}
    for c in truth:
        for r in (got[c], batch[c]):
            assert (r["floor"], r["level"], r["ceiling"], r["n_hits"], r["n_turns"]) == (want[c]["floor"], want[c]["level"], want[c]["ceiling"], want[c]["n_hits"], len(truth[c])) and abs(r["score"] - want[c]["score"]) < 1e-12
        assert got[c]["crisis"] or not want[c]["requires_crisis"]


def test_quiet_cases_are_closed_and_held_ones_are_not(spark, tmp_path):
    stream = Stream(spark, tmp_path)
    got = stream.send([("quiet", 4, 0, ["hi", "there"], 0), ("grave", 1, 0, ["im gonna kill myself"], 0)], [("other", 1, 0, ["x"], 29)])
    assert not any(r["closed"] for r in got.values())
    got = stream.send([("other", 2, 0, ["x"], 32)], [("other", 3, 0, ["x"], 32.1)])
    assert got["quiet"]["closed"] and got["quiet"]["n_turns"] == 2 and not got["grave"]["closed"] and not got["other"]["closed"]
    got = stream.send([("quiet", 5, 0, ["back"], 33)])
    assert (got["quiet"]["closed"], got["quiet"]["n_turns"], got["quiet"]["seq"]) == (False, 1, 5)


def test_the_verdict_of_a_state_is_the_gates(spark):
    rng, kinds = random.Random(9), [(c, s) for c in gate.CATEGORIES for s in gate.WEIGHTS]
    sets = [[rng.choice(kinds) for _ in range(rng.randint(0, 4))] for _ in range(300)]
    hits = spark.createDataFrame([(i, c, s, gate.WEIGHTS[s]) for i, x in enumerate(sets) for c, s in x], "k int, category string, severity string, weight double")
    for r in gate.verdicts(hits, spark.range(len(sets)).select(F.col("id").cast("int").alias("k")), ["k"]).collect():
        own = cases.judge(sets[r["k"]])
        assert (own["floor"], own["level"], own["ceiling"], own["n_hits"], own["crisis"]) == (r["floor"], r["level"], r["ceiling"], r["n_hits"], r["requires_crisis"]) and abs(own["score"] - r["score"]) < 1e-12


def test_upsert_by_number(spark):
    old, new = spark.createDataFrame([("a", 3, "x"), ("b", None, "x"), ("c", 3, "x")], "k string, n int, v string"), spark.createDataFrame([("a", 2, "y"), ("b", 1, "y"), ("c", 3, "y"), ("d", 0, "y")], "k string, n int, v string")
    assert {r["k"]: r["v"] for r in tables.upsert(old, new, "k", newest="n").collect()} == {"a": "x", "b": "y", "c": "y", "d": "y"}
