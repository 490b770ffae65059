"""Known names by one trie: the same spans as an expression for each name, at a cost that does not follow their number."""

import random
import re
import time

from hypothesis import given, settings
from hypothesis import strategies as st

from triagelake.operators import gate, privacy


def by_expressions(text, known):
    return [(i, m.start(), m.end()) for i, values in enumerate(known) for v in values for m in re.finditer(rf"\b{re.escape(v)}\b", text, re.I | re.ASCII)]


SAID = st.text(alphabet="aAbBı İéK_ -.'x", max_size=40)
NAMES = st.lists(st.text(alphabet="aAbBéK -'", min_size=1, max_size=5), max_size=6, unique=True)


@settings(max_examples=400, deadline=None)
@given(SAID, NAMES, NAMES)
def test_spans_equal_those_of_expressions(text, people, places):
    known = [people, places]
    assert privacy.Names({*people, *places}).find(text, known) == by_expressions(text, known)


TALK = st.lists(st.sampled_from(["a@b.co", "www.x.y", "https://q", "+44 20 7946 0958", "0123\x0b4567 89", "SW1A 2AA", "Singapore\x0b123456", "(@kai_1", " @x9", "12 Long Lane", "7b high\x0bstreet", "Oak\x0bPark School", "called Ann", "Ann said", "and Bob", "told Eve", "É", " ", "\n", "\x0b", "x", "\u017f", "\u212a"]), max_size=12).map("".join)


@settings(max_examples=400, deadline=None)
@given(TALK)
def test_a_batch_asks_for_every_detector_that_is_there(text):
    import pyarrow as pa
    import pyarrow.compute as pc

    for _, flags, _, rx in privacy.DETECTORS:
        if re.search(rx, text, (re.I if "i" in flags else 0) | re.ASCII):
            assert pc.match_substring_regex(pa.array([text]), privacy.re2_form(rx, flags))[0].as_py()


def test_names_of_other_rows_do_not_count(spark):
    rows = spark.createDataFrame([(1, "Ann met Bob", ["Ann"], ["Leeds"]), (2, "ann met bob in LEEDS", ["Bob"], None), (3, None, ["Ann"], []), (4, "ana ana", ["ana ana", "Ana"], [])], "id int, text string, people array<string>, places array<string>")
    got = {r["id"]: sorted((s["type"], s["a"], s["b"]) for s in r["spans"] if s["type"] in ("name", "place") and s["rank"] == -1) for r in privacy.raw_spans(rows).collect()}
    assert got[1] == [("name", 0, 3)] and got[2] == [("name", 8, 11)] and got[3] == [] and got[4] == [("name", 0, 3), ("name", 0, 7), ("name", 4, 7)]


def test_ten_thousand_names_cost_little_more_than_ten():
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(8))
    names = [word() for _ in range(10_000)]
    texts = [" ".join(word() if rng.random() < 0.9 else rng.choice(names) for _ in range(200)) for _ in range(60)]

    def seconds(some, find):
        began = time.perf_counter()
        found = [find(t, [some, []]) for t in texts]
        return time.perf_counter() - began, found

    trie = privacy.Names(set(names))
    many, found = seconds(names, trie.find)
    plain = [re.compile(rf"\b{n}\b", re.I | re.ASCII) for n in names[:500]]
    began = time.perf_counter()
    [list(rx.finditer(t)) for t in texts[:6] for rx in plain]
    each = (time.perf_counter() - began) / 6 / 500 * len(texts) * len(names)
    print(f"10,000 names in 60 texts: {many:.2f} s by the trie, {each:.1f} s by an expression for each")
    assert sum(map(len, found)) > 500 and many < each / 5


def test_patterns_that_are_not_there_are_not_run(spark, monkeypatch):
    turns = spark.createDataFrame([("a", 0, "im gonna kill myself"), ("b", 0, "nothing at all"), ("c", 0, "k1ll my5elf"), ("d", 0, None)], "case_id string, turn int, text string")
    found = gate.turn_hits(turns).select("case_id", "category").distinct().collect()
    assert {r["case_id"] for r in found} == {"a", "c"}
