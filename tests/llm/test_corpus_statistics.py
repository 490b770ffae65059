"""Source divergence, collocations and mixing: against plain Python on small tables, against SQL on given ones, and the defined edge cases."""

import glob
import os
import re
from collections import Counter, defaultdict
from fractions import Fraction
from hashlib import md5

import duckdb
import numpy as np
import pytest

from tests.test_oracle import plain
from triagelake.llm import collocations, entries, mixing, source_divergence

SCHEMA = "doc_id long, text string, lang string, source string, n string, term string, size string, h string, phrase string, words string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def table(spark, rows):
    """Documents with further columns whose names clash with those that the operators make."""
    return spark.createDataFrame([(*r, *["x"] * 6) for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    """Three languages of skewed words, a hot source, nulls, repeats, empties and one very long text."""
    rng = np.random.default_rng(5)
    words = ["The", "cat", "of", "Äther", "ß", "don't", "x1y", "über-all", "a", "NO", "😀", "e.g"]
    share = np.arange(12, 0, -1.0) ** 2
    out = []
    for i in range(260):
        n = int(rng.integers(0, 40)) if i != 7 else 9000
        signs = rng.choice([" ", "  ", "\t", ", ", ". ", "\n", "\r\n", "; "], size=n, p=[0.7, 0.05, 0.05, 0.05, 0.05, 0.04, 0.03, 0.03])
        text = "".join(w + s for w, s in zip(rng.choice(words, size=n, p=share / share.sum()), signs, strict=True))
        out.append((i, text, ["en", "en", "de", None][int(rng.integers(0, 4))], ["hot", "hot", "hot", "b", "c", "Ü", None][int(rng.integers(0, 7))]))
    out += [(300, None, "en", "b"), (301, "", None, None), (None, "the cat of the cat", "en", "hot"), (None, "the cat of the cat", "en", "hot"), (302, "123 !?", "xx", "only"), (303, "word", "xx", "other")]
    return out + [out[3]] * 12


# ---- source divergence

def audit(rows, least, top):
    docs = [((text or "").translate(LOWER), lang or "", source or "") for _, text, lang, source in rows]
    found, counts, groups = defaultdict(Counter), defaultdict(Counter), sorted({(g, s) for _, g, s in docs})
    for text, lang, source in docs:
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text)
        counts[lang, source].update(terms)
        found[lang].update(set(terms))
    out = []
    for lang in {g for g, _ in groups}:
        kept = [t for t, n in found[lang].items() if n >= least]
        sources = [s for g, s in groups if g == lang]
        share = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c[x] for x in kept) + 2 * len(kept)) for t in kept}
        of = {s: share(counts[lang, s]) for s in sources}
        whole = share(sum((counts[lang, s] for s in sources), Counter()))
        apart = lambda p, q: (p - q) ** 2 // (p + q)
        for s in sources:
            pairs = sorted((-sum(apart(of[s][t], of[o][t]) for t in kept), o.encode(), o) for o in sources if o != s)
            terms = sorted((-apart(of[s][t], whole[t]), t.encode(), t) for t in kept if counts[lang, s][t] and of[s][t] > whole[t])[:top]
            out += [(lang, s, part, item, -v, i) for part, found_ in (("pair", pairs), ("term", terms)) for i, (v, _, item) in enumerate(found_, 1)]
    return sorted(out)


@pytest.mark.parametrize(("least", "top"), [(10, 10), (3, 2), (10_000, 10)])
def test_audit_equals_plain_python(spark, rows, least, top):
    got = source_divergence.audit_sources(table(spark, rows), least, top)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == audit(rows, least, top)


def test_audit_of_languages_without_kept_terms_has_pairs_of_value_0(spark, rows):
    got = source_divergence.audit_sources(table(spark, [r for r in rows if r[2] == "xx"])).collect()
    assert [(r.source, r.item, r.value) for r in sorted(got)] == [("only", "other", 0), ("other", "only", 0)]


def test_audit_counts_group_after_group_and_lowers_only_ascii(spark):
    """Documents whose groups alternate are counted in order of their groups; only A-Z change, beside other signs and without."""
    rows = [(i, text, "en", f"s{i % 2}") for i, text in enumerate(["ABC Zz", "ABC Äß", "aBc zZ", "abc Äß", "İI Σ", None] * 4)]
    counts = source_divergence.term_counts(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    plan = counts._jdf.queryExecution().optimizedPlan().toString()
    assert "Sort [lang" in plan and "source" in plan.split("Sort [lang")[1].split("]")[0] and ", false" in plan.split("Sort [lang")[1].splitlines()[0]
    assert sorted(map(tuple, counts.collect())) == sorted(
        [("en", "s0", "abc", 8, 8), ("en", "s1", "abc", 8, 8), ("en", "s0", "zz", 8, 8), ("en", "s1", "Äß", 8, 8), ("en", "s0", "İi", 4, 4), ("en", "s0", "Σ", 4, 4)]
    )


# ---- collocations

def collocate(rows, least, longest, top):
    counts, totals = defaultdict(Counter), Counter()
    for _, text, lang, _ in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang or "und"] += len(words)
            counts[lang or "und"].update(tuple(words[i : i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1))
    out = []
    for lang, c in counts.items():
        candidates = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        inside = {q[i : i + k] for q, n in candidates.items() for k in range(2, len(q)) for i in range(len(q) - k + 1) if 100 * n >= 100 * candidates[q[i : i + k]]}
        scored = []
        for p, a in candidates.items():
            score, k = min((1000 * a * totals[lang] // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            if p not in inside:
                scored.append((-score, -a, " ".join(p).encode(), " ".join(p), c[p[:k]], c[p[k:]]))
        out += [(lang, i, p, -a, left, right, totals[lang], -s) for i, (s, a, _, p, left, right) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize(("least", "longest", "top", "marks"), [(100, 5, 2000, 1 << 27), (5, 5, 2000, 1 << 20), (2, 5, 40, 32768), (3, 3, 2000, 1 << 27)])
def test_collocations_equal_plain_python(spark, rows, least, longest, top, marks):
    got = collocations.mine(table(spark, rows), least, longest, top, marks)
    want = collocate(rows, least, longest, top)
    assert sorted(map(tuple, got.collect())) == want
    assert len(want) > 20 or least == 100


def test_counts_merge_over_shards(spark, rows, monkeypatch):
    """No shard sees a phrase often enough by itself."""
    many = spark.createDataFrame([(i, "a rare phrase indeed", "en", "s") for i in range(120)], "doc_id long, text string, lang string, source string").repartition(30)
    got = collocations.mine(many).collect()
    assert [(r.phrase, r.a, r.l, r.r, r.n, r.score) for r in got] == [("a rare phrase indeed", 120, 120, 120, 480, 4000)]


def test_suffix_arrays_are_in_order():
    rng = np.random.default_rng(2)
    for depth in (1, 2, 3, 5, 8):
        ids = np.concatenate((rng.integers(0, 4, 500), [0]))
        order = collocations.suffix_array(ids, depth)
        lcp = collocations.common_prefixes(ids, order, depth)
        cut = [tuple(ids[i : i + depth]) + (0,) * max(0, i + depth - len(ids)) for i in order]
        assert cut == sorted(cut) and sorted(order) == list(range(len(ids)))
        assert [0] + [next((k for k in range(depth) if a[k] != b[k]), depth) for a, b in zip(cut, cut[1:], strict=False)] == lcp.tolist()


# ---- mixing

def mixed(rows):
    sizes = [len(re.findall(r"[^\x20\x09-\x0D]+", text or "")) for _, text, _, _ in rows]
    words = Counter()
    for (*_, source), n in zip(rows, sizes, strict=True):
        words[source] += n
    names = sorted(words, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, free, target = Fraction(3, 2) * sum(sizes), set(names), {}
    while free:
        level = left / sum(weight[s] for s in free)
        above = {s for s in free if weight[s] * level > 2 * words[s]}
        target |= {s: Fraction(2 * words[s]) for s in above} if above else {s: weight[s] * level for s in free}
        left -= sum(target[s] for s in above)
        free = free - above if above else set()
    out, order = [None] * len(rows), defaultdict(list)
    for i, (doc, text, _, source) in enumerate(rows):
        order[source, md5(f"{'' if doc is None else doc}:{text or ''}".encode()).hexdigest()[:15]].append(i)
    spent = Counter()
    for source, h in sorted(order, key=lambda k: (k[0] or "", k[1])):
        same, budget = order[source, h], int(target[source])
        whole, rest = divmod(budget, words[source]) if words[source] else (0, 0)
        for i in same:
            out[i] = (rows[i][0], sizes[i], words[source], float(target[source]), whole * sizes[i] + max(0, min(sizes[i], (rest - spent[source]) // len(same))))
        spent[source] += sum(sizes[i] for i in same)
    return sorted(out, key=repr)


@pytest.mark.parametrize(("bits", "most"), [(12, 20_000), (12, 0), (1, 20_000), (7, 0)])
def test_mix_equals_a_sorted_walk(spark, rows, bits, most):
    got = mixing.mix(table(spark, rows), bits=bits, most_broadcast=most)
    assert got.columns == ["doc_id", "size", "source_size", "target", "taken"]
    assert sorted(map(tuple, got.collect()), key=repr) == mixed(rows)


def test_mix_meets_targets_within_limits_and_again(spark, rows):
    docs = table(spark, rows)
    got = mixing.mix(docs).collect()
    by = defaultdict(list)
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        by[r.source_size, r.target].append(r.taken)
    assert all(target - 12 < sum(taken) <= target <= 2 * size for (size, target), taken in by.items())
    assert abs(sum(t for _, t in by) - 1.5 * sum(r.size for r in got)) < 1e-6
    assert sorted(map(repr, got)) == sorted(map(repr, mixing.mix(docs.repartition(7)).collect()))


def test_sources_over_many_ranges_keep_their_places(spark):
    names = [f"s{i:03d}" for i in range(200)]
    got = mixing.weighted(spark.createDataFrame([(n,) for n in [*names, None]], "source string").repartition(9)).collect()
    assert {r.source: r.weight for r in got} == {s: (5, 2, 1)[i % 3] for i, s in enumerate([*names, None])}


# ---- all three

@pytest.mark.parametrize("run", [source_divergence.audit_sources, collocations.mine, mixing.mix])
def test_empty_tables_and_tables_of_nulls(spark, run):
    assert run(table(spark, [])).collect() == []
    out = run(table(spark, [(None, None, None, None)] * 3)).collect()
    assert [(r.size, r.target, r.taken) for r in out] == [(0, 0.0, 0)] * 3 if run is mixing.mix else out == []


@pytest.mark.parametrize("name", sorted(entries.ORACLE_SQL))
def test_query_equals_its_sql(spark, small, name):
    db = duckdb.connect()
    for path in glob.glob(f"{small}/*.parquet"):
        db.sql(f"CREATE VIEW {os.path.basename(path).split('.')[0]} AS SELECT * FROM '{path}'")
    frame = entries.QUERIES[name](spark, small)
    columns = sorted(frame.columns)
    found = db.sql(entries.ORACLE_SQL[name])
    names = list(found.columns)
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in columns) for r in frame.collect()), key=repr) == want and want


def test_each_occurrence_of_a_term_is_one_row(spark):
    """Documents are counted at the first of a term's sorted occurrences, not by rows of their own."""
    docs = spark.createDataFrame([(" b A.a  c b", "x", "s"), ("b", "x", "s"), ("b b \u00c9\u00e9 b", "x", "t"), ("", "x", "t"), (None, None, "t"), ("1 2", "x", "s")], "text string, lang string, source string")
    counts = source_divergence.term_counts(docs)
    found = {(r.lang, r.source, r.term): (r.n, r.docs) for r in counts.collect()}
    assert found == {("x", "s", "a"): (2, 1), ("x", "s", "b"): (3, 2), ("x", "s", "c"): (1, 1), ("x", "t", "b"): (3, 1), ("x", "t", "\u00c9\u00e9"): (1, 1)}
    plan = counts._jdf.queryExecution().optimizedPlan().toString()
    assert "array_distinct" not in plan and "concat" not in plan


def test_each_text_is_split_and_sorted_once(spark):
    """No filter that Spark puts before the explosion repeats the split, and texts without terms give no rows."""
    docs = spark.createDataFrame([("A b a", "x", "s"), ("", "x", "s"), ("1 !", "x", "t"), (None, "x", "u")], "text string, lang string, source string")
    counts = source_divergence.term_counts(docs)
    plan = counts._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1 and plan.count("sort_array(") == 1
    assert counts.columns == ["lang", "source", "term", "n", "docs"] and dict(counts.dtypes)["term"] == "string"
    assert sorted(map(tuple, counts.collect())) == [("x", "s", "a", 2, 1), ("x", "s", "b", 1, 1)]


def test_shares_are_exact_on_both_sides_of_64_bits(spark):
    edge = source_divergence.NARROW - 2
    rows = [(c, max(c, t), v) for c in (0, 7, edge - 1, edge, edge + 1, 10**12, 10**15) for t in (0, edge, 10**15 + 1) for v in (1, 12_345)]
    frame = spark.createDataFrame(rows, "c long, t long, v long")
    got = frame.select("c", "t", "v", source_divergence._share(frame.c, frame.t, frame.v).alias("p"))
    assert dict(got.dtypes)["p"] == "bigint"
    assert [r.p for r in got.collect()] == [1 + 10**9 * (r.c + 2) // (r.t + 2 * r.v) for r in got.collect()]
