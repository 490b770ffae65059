"""Nulls, empty and very long texts, repeats, empty tables and clashing extra columns: each operator's defined results."""

import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from triagelake.llm import document_trees, language_id, language_model, license_scan, near_duplicates, packing, personal_data, piece_codec, quality, vector_search

LONG = "the quick brown fox jumps over it " * 6000
ROWS = [
    (1, None, "en"), (2, "", None), (3, "  \n\t ", "en"), (4, LONG, "en"), (5, "the same text of the day", "en"), (6, "the same text of the day", "en"), (6, "the same text of the day", "en"),
    (7, "x", None), (8, "1234 !!", "fr"), (None, "an id is missing here", "en"), (9, "one two three four five six seven", "en"), (10, "é ß 日本 😀 \u0000 end", "de"),
]
SCHEMA = "doc_id long, text string, lang string"
CLASH = ("score", "held_out", "fp", "block", "x", "found", "kept", "p", "train", "n", "ids", "component_id", "source_id", "rejected", "start")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).withColumns({c: F.lit("clash") for c in CLASH})


@pytest.fixture(scope="module")
def empty(spark, docs):
    return docs.limit(0)


def labels(spark):
    return spark.createDataFrame([(4, 1, 0), (5, 1, 0), (8, 0, 0), (None, 1, 0), (9, None, None), (10, 0, 1)], "doc_id long, quality int, toxic int")


OPERATORS = {
    "language": lambda s, d: language_id.identify_languages(d, language_id.train(d)),
    "license": lambda s, d: license_scan.scan_licenses(d),
    "personal": lambda s, d: personal_data.find_personal_data(d),
    "pieces": lambda s, d: piece_codec.digest_documents(d),
    "model": lambda s, d: language_model.score_documents(d),
    "simhash": lambda s, d: near_duplicates.group_documents(d),
    "trees": lambda s, d: document_trees.compare_with_next(d),
    "quality": lambda s, d: quality.score_quality(d, labels(s)),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_each(spark, docs, empty, name):
    rows = OPERATORS[name](spark, docs).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in rows) == sorted((i is None, i or 0) for i, _, _ in ROWS)
    assert OPERATORS[name](spark, empty).collect() == []


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_language_cases(spark, docs):
    r = by_id(OPERATORS["language"](spark, docs))
    assert all(r[i]["lang_pred"] == "und" and r[i]["score"] == 0 and r[i]["rejected"] for i in (1, 2, 3, 8))
    assert r[5]["lang_pred"] in ("en", "fr", "de") and 0 <= r[5]["score"] <= 1 and not r[None]["held_out"]
    unlabelled = by_id(OPERATORS["language"](spark, docs.withColumn("lang", F.lit(None).cast("string"))))
    assert {x["lang_pred"] for x in unlabelled.values()} == {"und"} and not unlabelled[5]["rejected"]


def test_license_and_personal_cases(spark, docs):
    r = by_id(OPERATORS["license"](spark, docs))
    assert (r[1]["n_words"], r[1]["n_base"], r[1]["first_word"], r[1]["labels"], r[1]["score"]) == (0, 0, None, "", 0.0)
    assert r[4]["n_words"] == 7 * 6000
    r = by_id(OPERATORS["personal"](spark, docs))
    assert r[1]["spans"] == "" and r[1]["base_sha256"] == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def test_model_simhash_tree_cases(spark, docs):
    r = by_id(OPERATORS["model"](spark, docs))
    assert r[1]["n_tokens"] == r[3]["n_tokens"] == 1 and r[4]["n_tokens"] == 7 * 6000 + 1
    r = by_id(OPERATORS["simhash"](spark, docs))
    assert r[1]["fingerprint"] == "0" * 16 and r[1]["component_id"] == r[2]["component_id"] == r[3]["component_id"] == 1 and r[6]["component_id"] == 5
    r = by_id(OPERATORS["trees"](spark, docs))
    assert r[5]["fingerprint"] == r[6]["fingerprint"] and r[1]["n_chars"] == 0 and r[1]["near_edited"] == 1.0
    r = by_id(OPERATORS["quality"](spark, docs))
    assert all(0 <= x["score"] <= 1 and x["predicted"] == (x["score"] >= 0.5) for x in r.values())
    assert {x["score"] for x in by_id(quality.score_quality(docs, labels(spark).limit(0))).values()} == {0.5}


def test_packing_cases(spark, docs, empty):
    rows = packing.pack_documents(docs).collect()
    assert sum(r["length"] for r in rows if r["doc_id"] == 1) == 1  # the end id alone
    assert sum(r["length"] for r in rows if r["doc_id"] == 6) == 2 * next(r["doc_tokens"] for r in rows if r["doc_id"] == 6)
    assert packing.pack_documents(empty).collect() == []


def test_decode_cases(spark, docs):
    encoded = piece_codec.encode_documents(docs)
    back = piece_codec.decode_documents(encoded)
    assert {(r["doc_id"], r["text"]) for r in back.collect()} == {(i, t or "") for i, t, _ in ROWS}
    assert piece_codec.decode_documents(spark.createDataFrame([(1, None), (2, [0, 99999, -1])], "doc_id long, ids array<int>")).collect()[0]["text"] == ""


def test_vector_cases(spark):
    rows = [(100, [1.0, 0.0]), (200, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (6, [0.0, 1.0]), (7, [1.0]), (300, [0.0, 0.0]), (None, [1.0, 1.0]), (1, [1.0, 0.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("c1", F.lit("clash")).withColumn("entry", F.lit("clash"))
    got = {(r["query_id"], r["rank"]): (r["vec_id"], round(r["score"], 6)) for r in vector_search.nearest(v, 100).collect()}
    assert got == {(100, 1): (1, 0.0), (100, 2): (200, 0.0), (100, 3): (6, 1.414214), (200, 1): (1, 0.0), (200, 2): (100, 0.0), (200, 3): (6, 1.414214)}
    assert vector_search.nearest(v.limit(0), 100).collect() == []


@pytest.mark.parametrize("stage", [s for s, _ in corpus_pipeline.STAGES])
def test_stages(spark, docs, tmp_path, stage):
    labels(spark).write.parquet(str(tmp_path / "labels.parquet"))
    rows = docs.select("doc_id", "text", "lang", F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars"))
    run = dict(corpus_pipeline.STAGES)[stage]
    out = run(spark, rows, str(tmp_path))
    assert run(spark, rows.limit(0), str(tmp_path)).collect() == []
    if stage == "packing":
        return
    assert out.columns == rows.columns
    kept = [r["doc_id"] for r in out.collect()]
    if stage == "language_id":
        assert not {1, 2, 3, 8} & set(kept) and {4, 5, 6, 9, None} <= set(kept)
    if stage == "near_dedup":
        assert sorted(i for i in kept if i) == [1, 4, 5, 7, 8, 9, 10] and None in kept
    if stage == "personal_data":
        assert len(kept) == len(ROWS)


def test_slices_give_their_memory_back():
    """A worker of the pipeline holds little beside its model once its batch is through, and not much more before."""
    held = r"""
import re, threading, time
import numpy as np, pyarrow as pa
from triagelake.llm import common, language_id
now = lambda: sum(map(int, re.findall(r"\nPss_Anon:\s+(\d+)", open("/proc/self/smaps_rollup").read()))) >> 10
rng = np.random.default_rng(1)
words = np.array(["".join(map(chr, rng.integers(97, 123, n))) for n in rng.integers(2, 10, 200_000)])
texts = pa.array([" ".join(words[rng.integers(0, 200_000, 300)]) for _ in range(8_000)])
del words
model = language_id.LanguageModel(list("abcdefghij"), np.zeros((language_id.BUCKETS, 10), np.float32), None, np.zeros(10), 1.0, 0.0)
common.released()
before, most, done = now(), 0, []
def watch():
    global most
    while not done:
        most = max(most, now())
        time.sleep(0.005)
watching = threading.Thread(target=watch)
watching.start()
for part in common.slices(pa.record_batch([texts], ["text"]), limit=common.STAGE_BYTES):
    language_id.predict_slice(part.column("text"), model)
done.append(1)
watching.join()
print(now() - before, most - before)
"""
    # MB left, and at most in between
    left, most = map(int, subprocess.run([sys.executable, "-c", held], capture_output=True, text=True, check=True, cwd=Path(corpus_pipeline.__file__).parent).stdout.split())
    assert left < 30 and most < 120
