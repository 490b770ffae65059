"""DuckDB SQL for the queries that SQL can express, over the same tables."""

from __future__ import annotations

from ..functions.fixed_values import DURATIONS, MARKERS, PATTERNS, STOP_WORDS
from ..operators.casework import GATE_REASONS, TIER_REASONS
from ..operators.gate import CATEGORIES, WEIGHTS
from . import queries as Q
from . import standins as S

ST = "st AS (SELECT 'case-' || conv_id AS case_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS BIGINT) AS turn, text, conv_id FROM conversations WHERE role = 'user')"
CASES = "cases AS (SELECT DISTINCT 'case-' || conv_id AS case_id, conv_id, make_timestamp(1772323200000000 - conv_id * 14400000000) AS started_at, 'Handle' || conv_id AS handle FROM conversations WHERE role = 'user')"


def probs(text: str, n: int) -> str:
    raw = [f"(CAST('0x' || substr(sha1({text}), {1 + 4 * i}, 4) AS BIGINT) + 1.0)" for i in range(n)]
    total = " + ".join(raw)
    return "[" + ", ".join(f"CAST({r} AS DOUBLE) / ({total})" for r in raw) + "]"


PR = f"pr AS (SELECT *, {probs('text', 6)} AS probs, 1 - ({probs('text', 6)})[1] AS risk FROM st)"
ACCOUNTS = r"acc AS (SELECT case_id, string_agg(text, chr(10) ORDER BY turn) AS account FROM st GROUP BY case_id)"
VOCAB = ", ".join(f"('{c}', '{s}', {WEIGHTS[s]}, '{name}', '{name[2:]}', {CATEGORIES[c] or 'NULL'}, {list(CATEGORIES).index(c)})" for c, s, name, _ in S.VOCABULARY)
HITS = rf"hits AS (SELECT case_id, turn, v.*, len(list_filter(string_split_regex(lower(text), '[^\p{{L}}\p{{N}}_]+'), lambda w: w = v.word)) AS n FROM st CROSS JOIN (VALUES {VOCAB}) v(category, severity, weight, name, word, floor, i)), fired AS (SELECT * FROM hits WHERE n > 0)"


def verdict(keys: str, scope: str) -> str:
    on = " AND ".join(f"s.{k} = g.{k}" for k in keys.split(", "))
    own = ", ".join(f"s.{k}" for k in keys.split(", "))
    return f"""cat AS (SELECT {keys}, category, i, max(weight) w, max(CASE WHEN severity = 'strong' THEN floor END) hard, max(CASE WHEN severity = 'moderate' THEN floor END) soft, sum(n) n, bool_or(floor IS NULL) AS marks FROM fired GROUP BY {keys}, category, i),
    g AS (SELECT {keys}, 1 - product(1 - w) AS score, max(hard) hard, max(soft) soft, bool_or(marks) marked, bool_or(NOT marks) AS real, sum(n) n, max(w) max_w, string_agg(category, ',' ORDER BY i) AS categories FROM cat GROUP BY {keys}),
    verdicts AS (SELECT {own}, CASE WHEN real THEN score ELSE 0.0 END AS score, CASE WHEN real THEN greatest(CASE WHEN marked AND hard = 3 THEN 4 ELSE hard END, CASE WHEN marked AND soft = 3 THEN 4 ELSE soft END - 1) END AS fr,
      CASE WHEN real THEN categories ELSE '' END AS categories, CAST(CASE WHEN real THEN n ELSE 0 END AS BIGINT) AS n_hits, CASE WHEN real THEN max_w ELSE 0.0 END AS max_weight FROM {scope} s LEFT JOIN g ON {on})"""


VERDICT_COLUMNS = "round(score, 6) AS score, CASE WHEN score >= 0.70 THEN 'high' WHEN score >= 0.35 THEN 'grey' ELSE 'clear' END AS level, 'T' || fr AS floor, CASE WHEN fr = 4 THEN NULL ELSE 'T3' END AS ceiling, n_hits, coalesce(fr = 4, false) AS requires_crisis"
CONV = f"{ST}, {CASES}, {HITS}, {verdict('case_id', 'cases')}"


#: Each occurrence of a bank's word, with the place where it starts: words are cut at every sign that is no letter, digit or underscore.
PLACED = rf"""cut AS (SELECT case_id, turn, text, unnest(ws) AS w, generate_subscripts(ws, 1) AS idx FROM (SELECT *, string_split_regex(lower(text), '[^\p{{L}}\p{{N}}_]') AS ws FROM st)),
 pl AS (SELECT *, CAST(sum(len(w) + 1) OVER (PARTITION BY case_id, turn ORDER BY idx) - len(w) - 1 AS BIGINT) AS a FROM cut),
 oc AS (SELECT pl.case_id, turn, text, a, a + len(w) AS b, substr(text, CAST(a + 1 AS INT), len(w)) AS said, v.* FROM pl JOIN (VALUES {VOCAB}) v(category, severity, weight, name, word, floor, i) ON w = word JOIN verdicts ON verdicts.case_id = pl.case_id AND verdicts.categories <> '')"""
SPACES = " || ".join(f"chr({c})" for c in (9, 10, 11, 12, 13, 32, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288, 65279))
TRIMMED = f"trim(reason, {SPACES})"
STRIPPED = "trim(text, ' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12))"


def lit(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _markers() -> str:
    weeks = ", ".join(f"CASE WHEN regexp_matches(account, {lit(p)}, 'i') THEN {w} ELSE 0.0 END" for w, p in DURATIONS)
    count = lambda f: "CAST(" + " + ".join(f"CAST(regexp_matches(account, {lit(p)}, 'i') AS INT)" for fam, _, p in MARKERS if fam == f) + " AS DOUBLE)"
    return f"mk AS (SELECT case_id, greatest(0.0, {weeks}) AS duration_weeks, {count('frequency')} AS frequency_count, {count('avoidance')} AS avoidance_count, {count('barrier')} AS barrier_count, {count('identity')} AS identity_count FROM acc)"


MARKED = "CAST(duration_weeks AS DOUBLE) AS duration_weeks, round(ln(1 + duration_weeks) / ln(101.0), 6) AS duration_score, frequency_count, CAST(frequency_count > 0 AS DOUBLE) AS has_frequency, avoidance_count, CAST(avoidance_count > 0 AS DOUBLE) AS has_avoidance, barrier_count, CAST(identity_count > 0 AS DOUBLE) AS has_identity_target"
HARM = "CASE WHEN l.toxic > 0 THEN 'harassment' WHEN 1 - l.quality > 0 THEN NULL ELSE 'none' END"
LABELLED = f"lab AS (SELECT d.doc_id AS row_id, d.source, d.text, {HARM} AS harm FROM documents d JOIN labels l USING (doc_id))"
CLEAN = r"substr(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, 'https?://\S+|www\.\S+', ' [URL] ', 'g'), '@\w+', ' [USER] ', 'g'), '\\n|\n', ' ', 'g'), '\s+', ' ', 'g')), 1, 1000)"
NORM = r"sha1(regexp_replace(regexp_replace(trim(lower(text)), '\s+', ' ', 'g'), '[^a-z0-9 ]', '', 'g'))"
PRED = f"p AS (SELECT d.doc_id AS id, CAST(l.quality + l.toxic AS BIGINT) AS y_true, {probs('d.text', 3)} AS probs FROM documents d JOIN labels l USING (doc_id)), sc AS (SELECT *, list_max(probs) AS conf, CAST(list_position(probs, list_max(probs)) - 1 AS BIGINT) AS y_pred FROM p)"
BINS = "b AS (SELECT k.bin, count(sc.id) AS n, coalesce(avg(conf), 0.0) AS mean_conf, coalesce(avg(CAST(y_true = y_pred AS DOUBLE)), 0.0) AS accuracy FROM (SELECT CAST(range AS BIGINT) AS bin FROM range(15)) k LEFT JOIN sc ON conf > CASE WHEN k.bin = 0 THEN -1 ELSE k.bin / 15.0 END AND conf <= (k.bin + 1) / 15.0 GROUP BY k.bin)"
WORDS = "w AS (SELECT case_id, term FROM (SELECT case_id, unnest(regexp_extract_all(lower(text), '[a-z'']+')) AS term FROM st) WHERE len(term) > 2 AND term NOT IN (" + ", ".join(lit(x) for x in STOP_WORDS) + "))"
GRAMS = r"sq AS (SELECT case_id, regexp_replace(lower(account), '\s+', ' ', 'g') AS s FROM acc), gr AS (SELECT case_id, unnest(list_transform(range(1, greatest(len(s) - 1, 1)), lambda i: substr(s, i, 3))) AS gram FROM sq)"
TOKENS = r"tk0 AS (SELECT case_id, unnest(string_split_regex(account, '[^A-Za-z]+')) AS token FROM acc), en AS (SELECT DISTINCT case_id, 'person' AS kind, token FROM tk0 WHERE regexp_full_match(token, '[A-Z][a-z]{5,}') UNION ALL SELECT DISTINCT case_id, 'place', token FROM tk0 WHERE regexp_full_match(token, '[a-z]{10,}'))"
LINKS = f"""{ST}, {CASES}, {ACCOUNTS}, {TOKENS},
 sz AS (SELECT case_id, count(*) FILTER (kind = 'person') AS np, count(*) FILTER (kind = 'place') AS nl FROM en GROUP BY 1),
 links AS (SELECT x.case_id AS a, y.case_id AS b, any_value(abs(epoch_us(cx.started_at) - epoch_us(cy.started_at)) / 86400000000.0) AS days_apart, count(*) FILTER (x.kind = 'person') AS sp, count(*) FILTER (x.kind = 'place') AS sl, coalesce(string_agg(x.token, ',' ORDER BY x.token) FILTER (x.kind = 'person'), '') AS people, coalesce(string_agg(x.token, ',' ORDER BY x.token) FILTER (x.kind = 'place'), '') AS places
  FROM en x JOIN en y ON x.kind = y.kind AND x.token = y.token AND x.case_id < y.case_id JOIN cases cx ON cx.case_id = x.case_id JOIN cases cy ON cy.case_id = y.case_id WHERE abs(epoch_us(cx.started_at) - epoch_us(cy.started_at)) / 86400000000.0 <= 14 GROUP BY 1, 2)"""
COMPONENTS = f"""{LINKS}, e AS (SELECT a AS u, b AS v FROM links UNION SELECT b, a FROM links), walk(node, seen) AS (SELECT u, u FROM e UNION SELECT e.u, walk.seen FROM walk JOIN e ON e.v = walk.node), comp AS (SELECT node, min(seen) AS component FROM walk GROUP BY 1)"""
TURN_FEATURES = f"tf AS (SELECT case_id, max(risk) AS max_risk, avg(risk) AS mean_risk, list_avg(list_slice(list_reverse_sort(list(risk)), 1, 3)) AS topk_mean_risk, avg(CAST(risk > 0.5 AS DOUBLE)) AS frac_above_tau, CAST(count(*) FILTER (risk > 0.5) AS DOUBLE) AS count_above_tau, {', '.join(f'max(probs[{i + 1}]) AS max_p_{h}' for i, h in enumerate(('none', 'distress', 'harassment', 'identity_attack', 'threat', 'self_harm')))} FROM pr GROUP BY 1)"
TREND = "sized AS (SELECT *, count(*) OVER (PARTITION BY case_id) AS n FROM pr), tr AS (SELECT case_id, CASE WHEN max(n) >= 4 THEN regr_slope(risk, turn) ELSE 0.0 END AS trend_slope, avg(risk) FILTER (turn >= n // 2) - avg(risk) FILTER (turn < greatest(n // 2, 1)) AS second_half_delta, arg_max(risk, turn) AS last_risk, CASE WHEN max(n) > 1 THEN CAST(arg_min(turn, {'r': -risk, 't': turn}) AS DOUBLE) / (max(n) - 1) ELSE 0.0 END AS peak_position, CAST(max(n) AS DOUBLE) AS n_turns FROM sized GROUP BY 1)"
TURN_NAMES = ["max_risk", "mean_risk", "topk_mean_risk", "frac_above_tau", "count_above_tau", *[f"max_p_{h}" for h in ("none", "distress", "harassment", "identity_attack", "threat", "self_harm")]]
TREND_NAMES = ["trend_slope", "second_half_delta", "last_risk", "peak_position", "n_turns"]
RECORDS = f"{CASES}, rec AS (SELECT case_id, conv_id, started_at, CASE WHEN conv_id % 7 = 6 THEN NULL ELSE 'T' || (conv_id % 5) END AS tier, CASE WHEN conv_id % 11 = 0 THEN started_at + INTERVAL 2 DAYS END AS retention_expires_at, CASE WHEN conv_id % 13 = 0 THEN 'under review' END AS hold, CASE WHEN conv_id % 17 = 0 THEN started_at END AS content_deleted_at, CASE WHEN conv_id % 17 <> 0 THEN 'card of ' || case_id END AS card FROM cases)"
DECIDED = f"""{RECORDS}, dec AS (SELECT case_id, conv_id, CASE WHEN content_deleted_at IS NOT NULL THEN 'already_deleted' WHEN coalesce(tier IN ('T3', 'T4'), false) THEN 'escalated' WHEN hold IS NOT NULL THEN 'explicit_hold' WHEN conv_id % 9 = 4 THEN 'unreviewed_break_glass' END AS exemption,
 coalesce(retention_expires_at, CASE WHEN coalesce(tier IN ('T3', 'T4'), false) THEN NULL ELSE started_at + INTERVAL 30 DAYS END) AS due_at FROM rec), dd AS (SELECT *, exemption IS NULL AND due_at <= make_timestamp(1774310400000000) AS del FROM dec)"""
LOG = "lg AS (SELECT event_id AS seq, 'case-' || (user_id % 50) AS case_id, 'c' || (event_id % 4) AS counsellor_id, ['viewed_card', 'viewed_transcript', 'unsealed_pii', 'overrode_tier'][CAST(event_id % 4 + 1 AS INT)] AS action, CASE WHEN event_id % 11 = 5 THEN repeat(chr(9) || chr(13) || chr(10) || chr(12288), 8) WHEN event_id % 3 = 1 THEN chr(10) || chr(9) || ' ' || chr(160) || repeat('x', CAST(event_id % 30 AS INT)) || chr(13) || chr(10) || chr(8195) || chr(65279) ELSE repeat('x', CAST(event_id % 30 AS INT)) END AS reason, ts AS \"at\" FROM events)"
REQUESTS = f"{LOG}, rq AS (SELECT seq, case_id, 'c' || ((seq // 4) % 5) AS counsellor_id, reason, 'T' || (seq % 5) AS requested_tier, CASE WHEN seq % 3 > 0 THEN 'T' || ((seq // 8) % 5) END AS gate_floor FROM lg WHERE action = 'overrode_tier'), rd AS (SELECT DISTINCT case_id, counsellor_id, true AS ok FROM lg WHERE action = 'viewed_transcript')"


def _head() -> str:
    h = Q.HEAD
    scaled = [f"(({f}) - {m}) / {s}" for f, m, s in zip(h.features, h.mean, h.scale, strict=True)]
    dot = lambda w, b: f"({b} + " + " + ".join(f"{x} * ({v})" for x, v in zip(scaled, w, strict=True)) + ")"
    logits = ", ".join(dot(w, b) for w, b in zip(h.coef, h.intercept, strict=True))
    x, y = h.knots, h.levels
    pieces = " ".join(f"WHEN raw < {x[i]} THEN {y[i - 1]} + (raw - {x[i - 1]}) * {(y[i] - y[i - 1]) / (x[i] - x[i - 1])}" for i in range(1, len(x)))
    return f"""hd AS (SELECT case_id, list_transform([{logits}], lambda z: exp(z)) AS pw, 1 / (1 + exp(-{dot(h.ranker, h.ranker_intercept)})) AS raw FROM tf),
 ha AS (SELECT case_id, ['T0', 'T1', 'T2', 'T3', 'T4'][list_position(pw, list_max(pw))] AS model_tier, list_max(pw) / list_sum(pw) AS confidence, pw[5] / list_sum(pw) AS p4, raw AS raw_escalation, CASE WHEN raw <= {x[0]} THEN {y[0]} {pieces} ELSE {y[-1]} END AS escalation FROM hd)"""


DECIDE = f"{CONV}, {PR}, {TURN_FEATURES}, {_head()}, cap AS (SELECT ha.*, fr, CASE WHEN coalesce(fr, 0) <> 4 AND CAST(substr(model_tier, 2) AS INT) > 3 AND NOT (model_tier = 'T4' AND p4 >= 0.70) THEN 3 ELSE CAST(substr(model_tier, 2) AS INT) END AS capped FROM ha JOIN verdicts USING (case_id)), dc AS (SELECT case_id, model_tier, 'T' || greatest(capped, coalesce(fr, 0)) AS tier, coalesce(fr, 0) + least(greatest(escalation, 0.0), 1.0) AS queue_rank FROM cap)"


#: Quotes by the three bands: hits of a turn by weight and place, turns of risk, and one turn for queued cases without either.
QUOTES = f"""fh AS (SELECT case_id, turn, any_value(text) AS text, arg_min({{'w': weight, 'a': a, 'c': category, 'n': name}}, {{'k': -weight, 'a': a, 'i': i}}) AS h FROM oc GROUP BY 1, 2),
 lg_ AS (SELECT case_id, turn, {STRIPPED} AS quote, risk FROM pr WHERE len({STRIPPED}) >= 15),
 bd AS (SELECT case_id, turn, 0 AS band, -h.w AS key, h.a AS a, {STRIPPED} AS quote, h.w AS score, h.c || ' / ' || h.n AS reason FROM fh UNION ALL SELECT case_id, turn, 1, -risk, 0, quote, risk, 'highest-scoring turn' FROM lg_ WHERE risk >= 0.5 AND NOT EXISTS (SELECT 1 FROM fh WHERE fh.case_id = lg_.case_id AND fh.turn = lg_.turn)),
 ls AS (SELECT case_id, arg_max({{'t': turn, 'q': quote, 'r': risk}}, {{'r': risk, 't': -turn}}) AS m FROM lg_ WHERE case_id IN (SELECT case_id FROM queued) AND case_id NOT IN (SELECT case_id FROM bd) GROUP BY 1),
 every AS (SELECT * FROM bd UNION ALL SELECT case_id, m.t, 2, -m.r, 0, m.q, m.r, 'no explicit signal; highest-scoring turn' FROM ls),
 qs AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY band, key, turn, a) AS rank FROM every)"""
QUEUED = "queued AS (SELECT case_id FROM dc WHERE tier IN ('T2', 'T3', 'T4'))"
ALERTED = f"""{COMPONENTS}, rec AS (SELECT case_id, CASE WHEN conv_id % 7 = 6 THEN NULL ELSE 'T' || (conv_id % 5) END AS tier FROM cases), mem AS (SELECT component, count(*) AS size, string_agg(node, ',' ORDER BY node) AS members, string_agg(coalesce(tier, '-'), ',' ORDER BY node) AS tiers, (max(epoch_us(started_at)) - min(epoch_us(started_at))) / 86400000000.0 AS span FROM comp JOIN cases ON case_id = node JOIN rec ON rec.case_id = node GROUP BY 1 HAVING count(*) >= 3),
 tk AS (SELECT component, len(list_distinct(list_filter(flatten(list(string_split(people, ','))), lambda x: x <> ''))) AS n_people, len(list_distinct(list_filter(flatten(list(string_split(places, ','))), lambda x: x <> ''))) AS n_places FROM links JOIN comp ON node = a GROUP BY 1)"""
#: Half the BM25 score over the best of all pairs, half the trigram cosine, of linked cases.
LEXICAL = f"""{WORDS}, tf AS (SELECT case_id, term, count(*) AS tf FROM w GROUP BY 1, 2), ln_ AS (SELECT case_id, sum(tf) AS length FROM tf GROUP BY 1), fa AS (SELECT count(*) AS n, avg(length) AS m FROM ln_), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
 bm AS (SELECT x.case_id AS a, y.case_id AS b, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * y.tf * 2.5 / (y.tf + 1.5 * (0.25 + 0.75 * length / m))) AS bm25 FROM tf x JOIN tf y ON x.term = y.term AND x.case_id < y.case_id JOIN ln_ ON ln_.case_id = y.case_id JOIN df ON df.term = x.term CROSS JOIN fa GROUP BY 1, 2), bn AS (SELECT a, b, bm25 / max(bm25) OVER () AS bm25 FROM bm),
 {GRAMS}, t AS (SELECT case_id, gram, count(*) AS n FROM gr GROUP BY 1, 2), nm AS (SELECT case_id, sqrt(sum(n * n)) AS norm FROM t GROUP BY 1), dt AS (SELECT x.case_id AS a, y.case_id AS b, sum(x.n * y.n) AS dot FROM t x JOIN t y ON x.gram = y.gram AND x.case_id < y.case_id GROUP BY 1, 2),
 lx AS (SELECT l.a, l.b, 0.5 * coalesce(bn.bm25, 0) + 0.5 * coalesce(dot / (na.norm * nb.norm), 0) AS lexical FROM links l LEFT JOIN bn ON bn.a = l.a AND bn.b = l.b LEFT JOIN dt ON dt.a = l.a AND dt.b = l.b LEFT JOIN nm na ON na.case_id = l.a LEFT JOIN nm nb ON nb.case_id = l.b)"""
OVERLAP = "round_even(greatest(coalesce(sp / nullif(sa.np + sb.np - sp, 0), 0.0), coalesce(sl / nullif(sa.nl + sb.nl - sl, 0), 0.0)), 3)"
HOURS = "CAST(CASE {t} WHEN 'T2' THEN 48 WHEN 'T3' THEN 24 WHEN 'T4' THEN 0 END AS BIGINT)"
ACTION = "CASE {t} WHEN 'T0' THEN 'Log only' WHEN 'T1' THEN 'Log, no counsellor action' WHEN 'T2' THEN 'Queue, routine' WHEN 'T3' THEN 'Queue, priority' ELSE 'Break-glass immediately, crisis resources to student' END"


NAMES = "nm_ AS (SELECT case_id, string_agg(DISTINCT category || ' / ' || name, ', ' ORDER BY category || ' / ' || name) AS names FROM fired WHERE weight >= 0.6 GROUP BY 1)"
FLOOR_REASON = "CASE WHEN coalesce(cap.fr, 0) > capped THEN 'floored to T' || cap.fr || ' by the safety gate: ' || names WHEN coalesce(cap.fr, 0) <> 4 AND dc.model_tier = 'T4' AND capped = 4 THEN 'model proposed T4 above the gate ceiling T3; allowed on strong calibrated self-harm evidence' WHEN coalesce(cap.fr, 0) <> 4 AND dc.model_tier = 'T4' THEN 'capped at T3: no self-harm, abuse disclosure or imminent danger evidence in the transcript' END"


def _reasons() -> str:
    """Of each case the sentences of its card, as a list."""
    case = lambda values, key: f"CASE {key} " + " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in values.items()) + " END"
    sentence = lambda x: f"upper(substr({x}, 1, 1)) || lower(substr({x}, 2)) || '.'"
    targets = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(account, {lit(p)}, 'i') THEN {lit(n.replace('_', ' '))} END" for f, n, p in MARKERS if f == "identity") + "], lambda x: x IS NOT NULL), ', ')"
    told = f"[CASE WHEN duration_weeks >= 4 THEN 'ongoing for roughly ' || CAST(duration_weeks AS INT) || '+ weeks' END, CASE WHEN avoidance_count > 0 THEN 'student has changed their behaviour to avoid it' END, CASE WHEN frequency_count >= 2 THEN 'described as recurring' END, CASE WHEN identity_count > 0 THEN 'targets a protected characteristic: ' || {targets} END, CASE WHEN barrier_count > 0 THEN 'barrier to disclosure reported' END, {FLOOR_REASON}]"
    gate = f"list_transform(list_filter(string_split(categories, ','), lambda x: x <> ''), lambda x: {case(GATE_REASONS, 'x')})"
    return f"{NAMES}, rs AS (SELECT dc.case_id, list_concat(list_concat([{case(TIER_REASONS, 'dc.tier')}], {gate}), list_transform(list_filter({told}, lambda x: x IS NOT NULL), lambda x: {sentence('x')})) AS reasons FROM dc JOIN cap USING (case_id) JOIN verdicts USING (case_id) JOIN mk USING (case_id) JOIN acc USING (case_id) LEFT JOIN nm_ USING (case_id))"


def _recall(weeks: int = 500, intake: int = 100, budget: int = 20, seed: int = 7) -> str:
    quota = ", ".join(f"('{t}', {round(p * intake)})" for t, p in Q.WEEKLY.items())
    number = lambda n: f"CAST('0x' || substr(sha1('{n}:' || week || ':' || q.tier || ':' || slot), 1, 15) AS BIGINT)"
    return f"""WITH {DECIDE}, rk AS (SELECT case_id, 'T' || (conv_id % 5) AS tier, queue_rank AS score, row_number() OVER (PARTITION BY conv_id % 5 ORDER BY sha1(case_id), case_id) - 1 AS place, count(*) OVER (PARTITION BY conv_id % 5) AS size FROM dc JOIN cases USING (case_id) WHERE conv_id % 7 <> 6),
 sl AS (SELECT week, q.tier, slot FROM (SELECT range AS week FROM range({weeks})) w, (SELECT tier, unnest(range(1, n + 1)) AS slot FROM (VALUES {quota}) v(tier, n)) q),
 dr AS (SELECT q.*, {number(seed)} % size AS place, ({number(seed + 1)} % 1000) * 1e-12 AS jitter FROM sl q JOIN (SELECT DISTINCT tier, size FROM rk) z USING (tier)),
 fi AS (SELECT week, tier, row_number() OVER (PARTITION BY week ORDER BY score + jitter DESC, tier, slot) AS r FROM dr JOIN rk USING (tier, place)),
 wk AS (SELECT week, CAST(count(*) FILTER (tier IN ('T3', 'T4') AND r <= {budget}) AS DOUBLE) / nullif(count(*) FILTER (tier IN ('T3', 'T4')), 0) AS recall FROM fi GROUP BY 1)
 SELECT round(avg(recall), 6) AS mean_recall, round(stddev_pop(recall), 6) AS sd_recall, count(*) AS weeks FROM wk"""


def _pseudonyms() -> str:
    block = S.KEY.ljust(64, b"\0")
    pad = lambda x: "'" + "".join(f"\\x{b ^ x:02X}" for b in block) + "'::BLOB"
    name = r"trim(regexp_replace(regexp_replace(regexp_replace(trim(lower(token)), '^(mr|mrs|miss|ms|sir|dr)\.?\s+', ''), '[^\w\s]', '', 'g'), '\s+', ' ', 'g'))"
    return f"SELECT DISTINCT case_id, kind, substr(kind, 1, 3) || '_' || substr(sha256({pad(0x5C)} || unhex(sha256({pad(0x36)} || encode(kind || ':' || {name})))), 1, 12) AS token FROM en"


round_all = lambda names: ", ".join(f"round({n}, 6) AS {n}" for n in names)
PRF = "cells AS (SELECT a.i AS y_true, c.i AS y_pred, count(sc.id) AS n FROM (SELECT CAST(range AS BIGINT) i FROM range(3)) a CROSS JOIN (SELECT CAST(range AS BIGINT) i FROM range(3)) c LEFT JOIN sc ON sc.y_true = a.i AND sc.y_pred = c.i GROUP BY 1, 2), lb AS (SELECT k.i AS label, sum(n) FILTER (y_true = k.i AND y_pred = k.i) AS hit, sum(n) FILTER (y_true = k.i) AS support, sum(n) FILTER (y_pred = k.i) AS predicted FROM cells CROSS JOIN (SELECT CAST(range AS BIGINT) i FROM range(3)) k GROUP BY 1), prf AS (SELECT label, coalesce(hit / nullif(predicted, 0), 0.0) AS precision, coalesce(hit / nullif(support, 0), 0.0) AS recall, CAST(support AS BIGINT) AS support FROM lb), f AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0.0) AS f1 FROM prf)"
TEMPS = ", ".join(f"({float(t)})" for t in Q.TEMPERATURES)

ORACLE_SQL = {
    "student_turns": f"WITH {ST} SELECT case_id, turn, text FROM st",
    "leet_normalize": f"WITH {ST} SELECT case_id, turn, translate(lower(text), '!1|34@0$57', 'iiieaaosst') AS norm, CAST(CASE WHEN lower(text) = translate(lower(text), '!1|34@0$57', 'iiieaaosst') THEN 1 ELSE 2 END AS BIGINT) AS n_haystacks FROM st",
    "clean_text": f"SELECT doc_id, {CLEAN} AS cleaned FROM documents",
    "norm_key_dedupe": f"SELECT arg_min(doc_id, {{'s': source, 'd': doc_id}}) AS doc_id, key FROM (SELECT *, {NORM} AS key FROM documents) GROUP BY key",
    "word_tokens": f"WITH {ST}, {WORDS} SELECT case_id, term, count(*) AS tf FROM w GROUP BY 1, 2",
    "char_trigrams": f"WITH {ST}, {ACCOUNTS}, {GRAMS} SELECT case_id, gram, count(*) AS n FROM gr GROUP BY 1, 2",
    "pseudonyms": f"WITH {ST}, {ACCOUNTS}, {TOKENS} {_pseudonyms()}",
    "label_mapping": f"WITH {LABELLED} SELECT harm, count(*) AS n FROM lab GROUP BY 1",
    "gate_hit_counts": f"WITH {ST}, {HITS} SELECT case_id, turn, name, CAST(n AS BIGINT) AS n FROM fired",
    "gate_turn_verdict": f"WITH {ST}, {HITS}, {verdict('case_id, turn', 'st')} SELECT case_id, turn, {VERDICT_COLUMNS} FROM verdicts",
    "gate_conversation_verdict": f"WITH {CONV} SELECT case_id, categories, {VERDICT_COLUMNS} FROM verdicts",
    "gate_suppressed_hits": r"""WITH st AS (SELECT 'case-' || conv_id AS case_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS BIGINT) AS turn, text FROM conversations WHERE role = 'user'), ws AS (SELECT case_id, turn, string_split(regexp_replace(lower(text), '[^\p{L}\p{N}_ ]', ' # ', 'g'), ' ') AS l FROM st),
 x AS (SELECT case_id, turn, unnest(l) AS w, unnest(list_concat([''], l)) AS before, unnest(list_concat(l[2:], [''])) AS after FROM ws), n AS (SELECT case_id, turn, CASE WHEN w = 'of' AND after = 'the' THEN 'w_of_the' WHEN w = 'the' AND before <> 'of' THEN 'w_the' WHEN w = 'in' AND after <> 'the' THEN 'w_in' WHEN w = 'a' THEN 'w_a' END AS name FROM x WHERE w IS NOT NULL) SELECT case_id, turn, name, count(*) AS n FROM n WHERE name IS NOT NULL GROUP BY 1, 2, 3""",
    "gate_probes": f"WITH {CASES} SELECT case_id, floor, CASE WHEN floor IS DISTINCT FROM 'T4' THEN 'T3' END AS ceiling, coalesce(floor = 'T4', false) AS requires_crisis FROM (VALUES (0, NULL), (1, 'T4'), (2, 'T4'), (3, 'T4'), (4, 'T4'), (5, 'T4'), (6, NULL), (7, 'T4'), (8, NULL), (9, 'T3'), (10, NULL), (11, 'T3'), (12, NULL), (13, 'T4'), (14, 'T4'), (15, NULL), (16, NULL), (17, 'T3'), (18, NULL), (19, NULL)) v(i, floor) JOIN cases ON conv_id % 20 = i",
    "gate_top_hits": f"WITH {CONV}, {PLACED}, r AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY weight DESC, turn, a, b, name) AS rank FROM oc) SELECT case_id, rank, turn, name, a, b, said FROM r WHERE rank <= 3",
    "verdict_audit": f"WITH {CONV} SELECT case_id, 'T' || fr AS floor, 'T9' AS expected_floor, categories, categories AS expected_categories FROM verdicts WHERE substr(sha1(case_id), 1, 1) = '0'",
    "apply_verdict_grid": """WITH g AS (SELECT event_id % 5 AS predicted, CASE WHEN event_id // 5 % 6 < 5 THEN event_id // 5 % 6 END AS floor, CASE WHEN event_id // 60 % 2 = 1 THEN CAST(3 AS BIGINT) END AS ceiling, event_id // 30 % 2 = 1 AS override FROM events),
 t AS (SELECT *, CASE WHEN ceiling IS NOT NULL AND predicted > ceiling AND NOT override THEN ceiling ELSE predicted END AS capped FROM g)
 SELECT predicted, floor, ceiling, override, CAST(CASE WHEN floor IS NOT NULL AND floor > capped THEN floor ELSE capped END AS BIGINT) AS tier,
 CASE WHEN floor IS NOT NULL AND floor > capped THEN 'floored to T' || floor || ' by the safety gate: names' WHEN ceiling IS NOT NULL AND predicted > ceiling AND override THEN 'model proposed T' || predicted || ' above the gate ceiling T' || ceiling || '; allowed on strong calibrated self-harm evidence'
 WHEN ceiling IS NOT NULL AND predicted > ceiling THEN 'capped at T' || ceiling || ': no self-harm, abuse disclosure or imminent danger evidence in the transcript' END AS reason, count(*) AS n FROM t GROUP BY ALL""",
    "report_markers": f"WITH {ST}, {ACCOUNTS}, {_markers()} SELECT case_id, {MARKED} FROM mk",
    "features_turn": f"WITH {ST}, {PR}, {TURN_FEATURES} SELECT case_id, {round_all(TURN_NAMES)} FROM tf",
    "features_trend": f"WITH {ST}, {PR}, {TREND} SELECT case_id, {round_all(TREND_NAMES)} FROM tr",
    "features_all": f"WITH {CONV}, {PR}, {TURN_FEATURES}, {TREND}, {ACCOUNTS}, {_markers()} SELECT case_id, round(score, 6) AS gate_score, CAST(fr IS NOT NULL AS DOUBLE) AS gate_has_floor, CAST(coalesce(fr, 0) AS DOUBLE) AS gate_floor_rank, CAST(score >= 0.70 AS DOUBLE) AS gate_is_high, CAST(score >= 0.35 AND score < 0.70 AS DOUBLE) AS gate_is_grey, CAST(n_hits AS DOUBLE) AS gate_hit_count, CAST(max_weight AS DOUBLE) AS gate_max_weight, {', '.join(f'CAST(list_contains(string_split(categories, {lit(chr(44))}), {lit(c)}) AS DOUBLE) AS gate_{c}' for c in CATEGORIES)}, {round_all(TURN_NAMES)}, {round_all(TREND_NAMES)}, {MARKED.split(', ', 1)[1]}, 0.0::DOUBLE AS prior_sessions, 0.0::DOUBLE AS prior_max_tier_rank FROM tf JOIN tr USING (case_id) JOIN mk USING (case_id) JOIN verdicts USING (case_id)",
    "features_checked": f"WITH {CONV}, {PR}, z AS (SELECT case_id, count(*) AS n, max(risk) AS risk FROM pr GROUP BY 1) SELECT count(*) AS n, CAST(sum(n_hits) AS DOUBLE) AS hits, CAST(sum(n) AS DOUBLE) AS turns, round(max(risk), 4) AS max_risk FROM z JOIN verdicts USING (case_id)",
    "topk_quotes": f"WITH {DECIDE}, {PLACED}, {QUEUED}, {QUOTES} SELECT case_id, rank, turn, CAST(band AS BIGINT) AS band, quote, round(score, 6) AS score, reason FROM qs WHERE rank <= 3",
    "quotes_without_hits": f"WITH {ST}, {PR}, c AS (SELECT case_id, turn, {STRIPPED} AS quote, 1 - (1 + probs[1]) / 2 AS risk FROM pr WHERE len({STRIPPED}) >= 15), b AS (SELECT case_id, turn, quote, risk, row_number() OVER (PARTITION BY case_id ORDER BY risk DESC, turn) AS r FROM c) SELECT case_id, CAST(1 AS BIGINT) AS rank, turn, CAST(2 AS BIGINT) AS band, quote, round(risk, 6) AS score, 'no explicit signal; highest-scoring turn' AS reason FROM b WHERE r = 1",
    "transcript_join": f"WITH {ST}, {CASES} SELECT case_id, turn, started_at, CAST(len(text) AS BIGINT) AS n_chars FROM st JOIN cases USING (case_id)",
    "access_valid": f"WITH {LOG} SELECT action, count(*) AS n, min(seq) AS first_seq FROM lg WHERE len({TRIMMED}) >= CASE action WHEN 'viewed_transcript' THEN 10 WHEN 'unsealed_pii' THEN 20 WHEN 'overrode_tier' THEN 10 ELSE 0 END GROUP BY 1",
    "access_log": f"WITH {LOG}, r AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY \"at\" DESC, seq DESC) AS place FROM lg) SELECT case_id, seq, action, \"at\", place FROM r WHERE place <= 100",
    "latest_override": f"WITH {LOG}, r AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY \"at\" DESC, seq DESC) AS place FROM lg WHERE action = 'overrode_tier') SELECT case_id, \"at\", seq, counsellor_id FROM r WHERE place = 1",
    "override_decisions": f"WITH {REQUESTS}, o AS (SELECT seq, requested_tier, gate_floor, greatest(requested_tier, coalesce(gate_floor, 'T0')) AS eff, CASE WHEN len({TRIMMED}) < 10 THEN 'reason too short' WHEN rd.ok IS NULL THEN 'transcript not read' END AS refusal FROM rq LEFT JOIN rd USING (case_id, counsellor_id)) SELECT seq, refusal, CASE WHEN refusal IS NULL THEN eff END AS effective_tier, refusal IS NULL AND eff <> requested_tier AS floored, CASE WHEN refusal IS NULL AND eff <> requested_tier THEN 'Recorded as ' || eff || ', not ' || requested_tier || ': the safety gate floors this conversation at ' || gate_floor || '. Your reason has been logged against it. To close it below the floor you have to break glass, which a lead will review.' END AS floored_notice FROM o",
    "break_glass_decisions": f"WITH {REQUESTS}, o AS (SELECT seq, CASE WHEN gate_floor IS NULL THEN 'no floor' WHEN requested_tier >= gate_floor THEN 'not below floor' WHEN len(trim(reason || reason, {SPACES})) < 40 THEN 'reason too short' WHEN rd.ok IS NULL THEN 'transcript not read' END AS refusal FROM rq LEFT JOIN rd USING (case_id, counsellor_id)) SELECT seq, refusal, refusal IS NULL AS allowed FROM o",
    "break_glass_review": f"WITH {LOG}, br AS (SELECT seq AS record_id, counsellor_id, CASE WHEN seq % 80 = 3 THEN \"at\" END AS reviewed_at FROM lg WHERE seq % 40 = 3), rv AS (SELECT seq // 40 * 40 + 3 AS record_id, 'c' || (seq // 8 % 4) AS reviewer_id, \"at\" AS t FROM lg WHERE seq % 8 = 1 AND seq % 3 > 0 AND len({TRIMMED}) >= 10), fr AS (SELECT record_id, arg_min({{'who': reviewer_id, 't': rv.t}}, {{'t': rv.t, 'who': reviewer_id}}) AS f FROM br JOIN rv USING (record_id) WHERE reviewer_id <> counsellor_id GROUP BY 1) SELECT record_id, CASE WHEN reviewed_at IS NULL THEN f.who END AS reviewed_by, coalesce(reviewed_at, f.t) AS reviewed_at FROM br LEFT JOIN fr USING (record_id)",
    "session_resolve": "WITH m AS (SELECT max(ts) - INTERVAL 10 DAYS AS now FROM events) SELECT user_id % 9 AS counsellor_id, count(*) AS n, min(sha256(CAST(event_id AS VARCHAR))) AS first_token FROM events, m WHERE event_id % 6 <> 0 AND ts + INTERVAL 12 HOURS > now AND user_id % 9 % 3 > 0 GROUP BY 1",
    "disclosure_grid": f"WITH {LOG}, x AS (SELECT seq, ['card', 'transcript', 'identity'][CAST(seq % 3 + 1 AS INT)] AS level, len({TRIMMED}) AS size, seq // 9 % 2 = 1 AS escalated, CASE WHEN seq % 7 > 0 THEN counsellor_id END AS counsellor_id FROM lg), y AS (SELECT *, CASE WHEN counsellor_id IS NULL THEN 'no counsellor' WHEN size < CASE level WHEN 'identity' THEN 20 WHEN 'transcript' THEN 10 ELSE 0 END THEN 'reason too short' WHEN level = 'identity' AND NOT escalated THEN 'not escalated' END AS refusal FROM x) SELECT seq, level, escalated, counsellor_id, refusal IS NULL AS allowed, refusal, CASE WHEN refusal IS NULL THEN CASE level WHEN 'card' THEN 'viewed_card' WHEN 'transcript' THEN 'viewed_transcript' ELSE 'unsealed_pii' END END AS action FROM y",
    "cap_per_group": f"WITH {LABELLED}, r AS (SELECT *, row_number() OVER (PARTITION BY source, harm ORDER BY sha1(CAST(row_id AS VARCHAR)), row_id) AS r FROM lab WHERE harm IS NOT NULL) SELECT row_id, source, harm FROM r WHERE r <= 10",
    "stratified_split": f"WITH {LABELLED}, r AS (SELECT row_id, harm, (row_number() OVER (PARTITION BY harm ORDER BY sha1(CAST(row_id AS VARCHAR)), row_id) - 1) / count(*) OVER (PARTITION BY harm) AS share FROM lab WHERE harm IS NOT NULL) SELECT row_id, harm, CASE WHEN share < 0.70 THEN 'train' WHEN share < 0.85 THEN 'val' ELSE 'test' END AS split FROM r",
    "corpus_build": f"WITH {LABELLED}, c AS (SELECT row_id, source, harm, {CLEAN} AS text FROM lab WHERE harm IS NOT NULL), k AS (SELECT *, {NORM} AS key FROM c WHERE len(text) >= 3), u AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY key ORDER BY source, row_id) = 1), r AS (SELECT harm, (row_number() OVER (PARTITION BY harm ORDER BY sha1(CAST(row_id AS VARCHAR)), row_id) - 1) / count(*) OVER (PARTITION BY harm) AS share FROM u) SELECT harm, CASE WHEN share < 0.70 THEN 'train' WHEN share < 0.85 THEN 'val' ELSE 'test' END AS split, count(*) AS n FROM r GROUP BY 1, 2",
    "label_maps": "WITH e AS (SELECT ['suicidewatch', 'depression', 'teenagers', 'not_cyberbullying', 'religion', 'ethnicity', 'gender', 'age', 'other_cyberbullying', 'other'][CAST(event_id % 10 + 1 AS INT)] AS c FROM events) SELECT CASE c WHEN 'suicidewatch' THEN 'self_harm' WHEN 'depression' THEN 'distress' WHEN 'teenagers' THEN 'none' END AS reddit, CASE WHEN c = 'not_cyberbullying' THEN 'none' WHEN c IN ('religion', 'ethnicity', 'gender', 'age') THEN 'identity_attack' WHEN c = 'other_cyberbullying' THEN 'harassment' END AS bullying, count(*) AS n FROM e GROUP BY 1, 2",
    "stratified_baseline": f"WITH {LABELLED}, c AS (SELECT harm AS drawn, sum(count(*)) OVER (ORDER BY harm) / sum(count(*)) OVER () AS upper FROM lab WHERE harm IS NOT NULL GROUP BY 1), p AS (SELECT row_id, harm, CAST('0x' || substr(sha1(CAST(row_id AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296.0 AS u FROM lab WHERE harm IS NOT NULL) SELECT row_id, harm, arg_min(drawn, upper) AS drawn FROM p JOIN c ON u < upper GROUP BY 1, 2",
    "harm_by_tier": f"WITH {ST}, {RECORDS}, {PR}, h AS (SELECT tier, CAST(list_position(probs, list_max(probs)) - 1 AS BIGINT) AS label FROM pr JOIN rec USING (case_id) WHERE tier IS NOT NULL), n AS (SELECT tier, label, count(*) AS n FROM h GROUP BY 1, 2) SELECT tier, label, n, row_number() OVER (PARTITION BY tier ORDER BY n DESC, label) AS place FROM n",
    "class_distribution": f"WITH {LABELLED}, c AS (SELECT harm, count(*) AS n FROM lab WHERE harm IS NOT NULL GROUP BY 1) SELECT harm, n, round(100.0 * n / sum(n) OVER (), 6)::DOUBLE AS pct, n < 1000 AS scarce FROM c",
    "class_weights": f"WITH {LABELLED}, c AS (SELECT harm, count(*) AS n FROM lab WHERE harm IS NOT NULL GROUP BY 1) SELECT harm, n, round(CAST(sum(n) OVER () AS DOUBLE) / (count(*) OVER () * n), 6) AS weight FROM c",
    "confusion_matrix": f"WITH {PRED}, {PRF} SELECT y_true, y_pred, n FROM cells",
    "class_f1": f"WITH {PRED}, {PRF} SELECT label, {round_all(['precision', 'recall', 'f1'])}, support FROM f",
    "f1_summary": f"WITH {PRED}, {PRF} SELECT round(avg(f1), 6) AS macro_f1, round(sum(f1 * support) / sum(support), 6) AS weighted_f1, round(sum(recall * support) / sum(support), 6) AS accuracy FROM f",
    "reliability_bins": f"WITH {PRED}, {BINS} SELECT bin, n, round(mean_conf, 6) AS mean_conf, round(accuracy, 6) AS accuracy, round(abs(accuracy - mean_conf), 6) AS gap FROM b",
    "calibration_error": f"WITH {PRED}, {BINS}, t AS (SELECT *, abs(accuracy - mean_conf) AS gap, sum(n) OVER () AS total FROM b) SELECT round(sum(gap * n / total), 6) AS ece, round(max(gap) FILTER (n >= greatest(1, floor(total * 0.01))), 6) AS mce FROM t",
    "brier_nll": f"WITH {PRED} SELECT round(avg(list_sum(list_transform(range(0, 3), lambda i: pow(probs[i + 1] - CAST(i = y_true AS DOUBLE), 2)))), 6) AS brier, round(avg(-ln(greatest(probs[y_true + 1], 1e-12))), 6) AS nll, round(avg(conf), 6) AS mean_confidence, round(avg(CAST(y_true = y_pred AS DOUBLE)), 6) AS accuracy FROM sc",
    "safety_view": f"WITH {PRED} SELECT count(*) FILTER (y_true <> 0) AS n_risky, round(count(*) FILTER (y_true <> 0 AND y_pred <> 0) / count(*) FILTER (y_true <> 0), 6) AS risky_recall, round(count(*) FILTER (y_true <> 0 AND y_pred = 0) / count(*) FILTER (y_true <> 0), 6) AS missed_as_none FROM sc",
    "confusion_pair": f"WITH {PRED} SELECT round(count(*) FILTER (y_true = 0 AND y_pred = 1) / count(*) FILTER (y_true = 0), 6) AS a_as_b, round(count(*) FILTER (y_true = 1 AND y_pred = 0) / count(*) FILTER (y_true = 1), 6) AS b_as_a FROM sc",
    "class_gaps": f"WITH {PRED}, e AS (SELECT y_true, unnest(probs) AS p, CAST(generate_subscripts(probs, 1) - 1 AS BIGINT) AS label FROM sc) SELECT label, round(avg(p), 6) AS mean_prob, round(avg(CAST(y_true = label AS DOUBLE)), 6) AS base_rate, round(avg(p) - avg(CAST(y_true = label AS DOUBLE)), 6) AS gap FROM e GROUP BY 1",
    "recall_curve": f"WITH {PRED}, r AS (SELECT row_number() OVER (ORDER BY probs[3] DESC, id) AS r, CAST(y_true = 2 AS BIGINT) AS positive FROM sc) SELECT k, round(coalesce(sum(positive) FILTER (r <= k) / nullif(sum(positive), 0), 0.0), 6) AS recall FROM r CROSS JOIN (SELECT unnest([10, 20, 30, 40, (SELECT CAST(sum(positive) AS BIGINT) FROM r)]) AS k) v GROUP BY k",
    "temperature_grid": f"WITH {PRED}, l AS (SELECT t, probs[y_true + 1] AS p, list_sum(list_transform(probs, lambda x: exp((ln(x) - ln(conf)) / t))) AS z, conf FROM sc CROSS JOIN (VALUES {TEMPS}) v(t)) SELECT CAST(t AS DOUBLE) AS temperature, round(avg(-ln(greatest(exp((ln(p) - ln(conf)) / t) / z, 1e-12))), 6) AS nll FROM l GROUP BY 1",
    "risk_by_tier": f"WITH {ST}, {RECORDS}, {PR}, m AS (SELECT case_id, max(risk) AS risk FROM pr GROUP BY 1) SELECT tier, count(*) AS n, round(avg(risk), 6) AS mean_risk, round(min(risk), 6) AS min_risk FROM rec JOIN m USING (case_id) WHERE tier IS NOT NULL GROUP BY 1",
    "majority_baseline": f"WITH {LABELLED} SELECT harm, count(*) AS n FROM lab WHERE harm IS NOT NULL GROUP BY 1 ORDER BY n DESC, harm LIMIT 1",
    "entity_links": f"WITH {LINKS} SELECT a, b, round(days_apart, 6) AS days_apart, round(greatest(coalesce(sp / nullif(sa.np + sb.np - sp, 0), 0.0), coalesce(sl / nullif(sa.nl + sb.nl - sl, 0), 0.0)), 6) AS entity_overlap, people, places FROM links JOIN sz sa ON sa.case_id = a JOIN sz sb ON sb.case_id = b",
    "bm25_pairs": f"WITH {ST}, {WORDS}, tf AS (SELECT case_id, term, count(*) AS tf FROM w GROUP BY 1, 2), ln_ AS (SELECT case_id, sum(tf) AS length FROM tf GROUP BY 1), fa AS (SELECT count(*) AS n, avg(length) AS m FROM ln_), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), p AS (SELECT x.case_id AS a, y.case_id AS b, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * y.tf * 2.5 / (y.tf + 1.5 * (0.25 + 0.75 * length / m))) AS bm25 FROM tf x JOIN tf y ON x.term = y.term AND x.case_id < y.case_id JOIN ln_ ON ln_.case_id = y.case_id JOIN df ON df.term = x.term CROSS JOIN fa GROUP BY 1, 2) SELECT a, b, round(bm25, 6) AS bm25, round(bm25 / max(bm25) OVER (), 6) AS bm25_norm FROM p",
    "trigram_cosine": f"WITH {ST}, {ACCOUNTS}, {GRAMS}, t AS (SELECT case_id, gram, count(*) AS n FROM gr GROUP BY 1, 2), nm AS (SELECT case_id, sqrt(sum(n * n)) AS norm FROM t GROUP BY 1), p AS (SELECT x.case_id AS a, y.case_id AS b, sum(x.n * y.n) AS dot FROM t x JOIN t y ON x.gram = y.gram AND x.case_id < y.case_id GROUP BY 1, 2) SELECT a, b, round(dot / (na.norm * nb.norm), 6) AS cosine FROM p JOIN nm na ON na.case_id = a JOIN nm nb ON nb.case_id = b",
    "components": f"WITH RECURSIVE {COMPONENTS} SELECT node, component FROM comp",
    "link_counts": f"WITH {ST}, {CASES}, {ACCOUNTS}, {TOKENS}, met AS (SELECT x.kind, x.token, count(*) AS n FROM en x JOIN en y ON x.kind = y.kind AND x.token = y.token AND x.case_id < y.case_id JOIN cases cx ON cx.case_id = x.case_id JOIN cases cy ON cy.case_id = y.case_id WHERE abs(epoch_us(cx.started_at) - epoch_us(cy.started_at)) / 86400000000.0 <= 14 GROUP BY 1, 2) SELECT e.kind, e.token, e.n AS n_cases, coalesce(met.n, 0) AS n_links FROM (SELECT kind, token, count(*) AS n FROM en GROUP BY 1, 2) e LEFT JOIN met ON met.kind = e.kind AND met.token = e.token",
    "alert_tokens": f"WITH RECURSIVE {ALERTED}, each AS (SELECT component, 'person' AS kind, unnest(string_split(people, ',')) AS token FROM links JOIN comp ON node = a UNION SELECT component, 'place', unnest(string_split(places, ',')) FROM links JOIN comp ON node = a) SELECT 'cluster-' || component AS cluster_id, kind, token FROM each JOIN mem USING (component) WHERE token <> ''",
    "alert_links": f"WITH RECURSIVE {ALERTED} SELECT 'cluster-' || component AS cluster_id, a, b, round(days_apart, 6) AS days_apart, round(greatest(coalesce(sp / nullif(sa.np + sb.np - sp, 0), 0.0), coalesce(sl / nullif(sa.nl + sb.nl - sl, 0), 0.0)), 6) AS entity_overlap FROM links JOIN comp ON node = a JOIN mem USING (component) JOIN sz sa ON sa.case_id = a JOIN sz sb ON sb.case_id = b",
    "pattern_alerts": f"WITH RECURSIVE {ALERTED} SELECT 'cluster-' || component AS cluster_id, size, members, tiers, round(span, 6) AS span_days, CAST(n_people AS BIGINT) AS n_people, CAST(n_places AS BIGINT) AS n_places, size || ' separate reports' || CASE WHEN n_places > 0 THEN ', naming the same location' ELSE '' END || CASE WHEN n_people > 0 THEN ', naming the same person' ELSE '' END || ', within ' || CAST(round_even(span, 0) AS BIGINT) || ' days' AS headline FROM mem JOIN tk USING (component)",
    "alerts_of_cases": f"WITH RECURSIVE {ALERTED} SELECT node AS case_id, 'cluster-' || component AS cluster_id, size FROM comp JOIN mem USING (component) JOIN rec ON rec.case_id = node WHERE tier = 'T4'",
    "link_similarity": f"WITH {LINKS}, {LEXICAL} SELECT a, b, round(lexical, 6) AS lexical FROM lx",
    "link_rows": f"WITH {LINKS}, {LEXICAL} SELECT links.a, links.b, {OVERLAP} AS entity_overlap, round_even(lexical, 3) AS lexical, round_even(days_apart, 1) AS days_apart, people, places, concat_ws(' and ', CASE WHEN sp > 0 THEN sp || ' shared person' END, CASE WHEN sl > 0 THEN sl || ' shared location' END) || ', ' || CAST(round_even(days_apart, 0) AS BIGINT) || ' days apart' AS reason FROM links JOIN lx ON lx.a = links.a AND lx.b = links.b JOIN sz sa ON sa.case_id = links.a JOIN sz sb ON sb.case_id = links.b",
    "break_glass_open": f"WITH {LOG} SELECT seq AS record_id, \"at\" FROM lg WHERE seq % 40 = 3 AND seq % 80 <> 3",
    "transcript_readers": f"WITH {REQUESTS} SELECT seq, case_id, counsellor_id FROM rq JOIN rd USING (case_id, counsellor_id)",
    "receipt_accesses": f"WITH {ST}, {LOG} SELECT case_id, seq AS place, CASE action WHEN 'viewed_card' THEN 'Opened the summary of your conversation.' WHEN 'viewed_transcript' THEN 'Read the full conversation.' WHEN 'unsealed_pii' THEN 'Looked up names or places you mentioned.' WHEN 'overrode_tier' THEN 'Changed how urgent your case is marked.' END AS what FROM lg WHERE case_id IN (SELECT case_id FROM st)",
    "cross_validation_folds": f"WITH {RECORDS} SELECT case_id, tier, (row_number() OVER (PARTITION BY tier ORDER BY sha1('0:' || case_id), case_id) - 1) % 5 AS fold FROM rec WHERE tier IS NOT NULL",
    "head_apply": f"WITH {ST}, {PR}, {TURN_FEATURES}, {_head()} SELECT case_id, model_tier, {round_all(['confidence', 'raw_escalation', 'escalation'])} FROM ha",
    "decided_cases": f"WITH {DECIDE} SELECT case_id, model_tier, tier, round(queue_rank, 6) AS queue_rank FROM dc",
    "queue_order": f"WITH {DECIDE}, q AS (SELECT case_id, tier, floor(queue_rank) AS queue_rank, conv_id % 2 = 0 AS is_live FROM dc JOIN cases USING (case_id) WHERE tier IN ('T2', 'T3', 'T4')) SELECT *, row_number() OVER (PARTITION BY tier ORDER BY queue_rank DESC, is_live DESC, case_id) AS place FROM q",
    "card_reasons": f"WITH {DECIDE}, {ACCOUNTS}, {_markers()}, {_reasons()} SELECT case_id, unnest(reasons) AS reason, CAST(generate_subscripts(reasons, 1) - 1 AS BIGINT) AS place FROM rs",
    "card_lists": rf"WITH {ST}, {PR}, {ACCOUNTS}, tk0 AS (SELECT case_id, unnest(ws) AS token, generate_subscripts(ws, 1) AS i FROM (SELECT case_id, string_split_regex(account, '[^A-Za-z]+') AS ws FROM acc)), nt_ AS (SELECT case_id, CASE WHEN regexp_full_match(token, '[A-Z][a-z]{{5,}}') THEN 'people' WHEN regexp_full_match(token, '[a-z]{{10,}}') THEN 'places' END AS part, token, min(i) AS i FROM tk0 GROUP BY ALL) SELECT case_id, part, row_number() OVER (PARTITION BY case_id, part ORDER BY i) - 1 AS place, token AS what, CAST(NULL AS DOUBLE) AS risk FROM nt_ WHERE part IS NOT NULL UNION ALL SELECT case_id, 'turn', turn, 'turn-' || turn, round(risk, 4) FROM pr",
    "card_places": f"WITH {DECIDE} SELECT row_number() OVER (ORDER BY round(queue_rank, 4) DESC, tier DESC, case_id) AS place, case_id, tier, round(queue_rank, 4) AS queue_rank FROM dc",
    "verdict_json": f"""WITH {CONV}, {PLACED}, hl AS (SELECT case_id, string_agg('{{"category":"' || category || '","pattern":"' || name || '","severity":"' || severity || '","turn_index":' || turn || ',"text":"' || said || '"}}', ',' ORDER BY turn, i, a) AS hits FROM oc GROUP BY 1)
 SELECT case_id, '{{"score":' || CAST(round(score, 4) AS VARCHAR) || ',"level":"' || CASE WHEN score >= 0.70 THEN 'high' WHEN score >= 0.35 THEN 'grey' ELSE 'clear' END || '","is_high":' || (score >= 0.70) || ',"is_grey":' || (score >= 0.35 AND score < 0.70) || ',"indicators":[' || array_to_string(list_transform(list_filter(string_split(categories, ','), lambda x: x <> ''), lambda x: '"' || x || '"'), ',') || '],"floor":' || coalesce('"T' || fr || '"', 'null') || ',"ceiling":' || CASE WHEN fr = 4 THEN 'null' ELSE '"T3"' END || ',"hits":[' || coalesce(hits, '') || ']}}' AS verdict FROM verdicts LEFT JOIN hl USING (case_id)""",
    "recall_at_budget": _recall(),
    "card_fields": f"WITH {DECIDE}, {PLACED}, {QUEUED}, {QUOTES}, nq AS (SELECT case_id, count(*) AS n FROM qs WHERE rank <= 3 GROUP BY 1), nt AS (SELECT case_id, count(*) AS n FROM st GROUP BY 1), {NAMES} SELECT dc.case_id, handle, dc.tier, round(confidence, 4) AS confidence, {FLOOR_REASON} AS tier_floor_reason, 'T' || cap.fr AS gate_floor, categories AS gate_indicators, {ACTION.format(t='dc.tier')} AS action, {HOURS.format(t='dc.tier')} AS sla_hours, nt.n AS n_student_turns, round(queue_rank, 4) AS queue_rank, round(escalation, 4) AS escalation, dc.model_tier, coalesce(cap.fr = 4, false) AS crisis_shown, CASE WHEN dc.tier NOT IN ('T3', 'T4') THEN started_at + INTERVAL 30 DAYS END AS retention_expires_at, coalesce(nq.n, 0) AS n_quotes, started_at, CAST(NULL AS VARCHAR) AS delta_since_last_session, CAST(NULL AS VARCHAR) AS pattern_cluster_id FROM dc JOIN cap USING (case_id) JOIN verdicts USING (case_id) JOIN cases USING (case_id) JOIN nt USING (case_id) LEFT JOIN nq USING (case_id) LEFT JOIN nm_ USING (case_id)",
    "queue_stats": f"WITH {RECORDS} SELECT count(*) AS total, count(*) FILTER (tier IN ('T2', 'T3', 'T4')) AS queued, count(*) FILTER (tier = 'T4') AS t4, count(*) FILTER (conv_id % 2 = 0) AS live, count(*) FILTER (conv_id % 3 = 0) AS awaiting FROM rec",
    "tier_counts": f"WITH {RECORDS} SELECT t AS tier, count(case_id) AS n FROM (VALUES ('T0'), ('T1'), ('T2'), ('T3'), ('T4')) v(t) LEFT JOIN rec ON rec.tier = t AND rec.tier <> 'T3' GROUP BY 1",
    "gate_cards": f"WITH {CONV}, fc AS (SELECT case_id, category, i, min(turn) AS t FROM fired GROUP BY 1, 2, 3), ind AS (SELECT case_id, string_agg(category, ',' ORDER BY t, i) AS names, string_agg(CASE category WHEN 'self_harm_intent' THEN 'Stated intent to self-harm or end their life.' WHEN 'abuse_disclosure' THEN 'Described harm being done to them by someone else.' ELSE 'Safety gate flagged: ' || category || '.' END, '|' ORDER BY t, i) AS why FROM fc GROUP BY 1), nt AS (SELECT case_id, count(*) AS n FROM st GROUP BY 1), g2 AS (SELECT *, 'T' || coalesce(fr, 0) AS tier FROM verdicts LEFT JOIN ind ON ind.case_id = verdicts.case_id AND categories <> '' JOIN nt ON nt.case_id = verdicts.case_id JOIN cases ON cases.case_id = verdicts.case_id) SELECT case_id, handle, tier, CAST(NULL AS DOUBLE) AS confidence, 'The safety gate floors this conversation at T' || fr || '.' AS tier_floor_reason, 'T' || fr AS gate_floor, coalesce(names, '') AS gate_indicators, CASE tier WHEN 'T0' THEN 'No action needed; logged only.' WHEN 'T1' THEN 'Mild concern; logged, no action needed.' WHEN 'T2' THEN 'Sustained difficulty. Queue for a conversation.' WHEN 'T3' THEN 'Significant distress. Contact within 24 hours.' ELSE 'Risk to life. Act now.' END || coalesce('|' || why, '') || '|Scored by the safety gate only. The classifier has not run on this yet.' AS reasons, CASE WHEN tier NOT IN ('T3', 'T4') THEN started_at + INTERVAL 30 DAYS END AS retention_expires_at, CAST(coalesce(fr, 0) + 1.0 AS DOUBLE) AS queue_rank, CAST(0 AS DOUBLE) AS escalation, 'T0' AS model_tier, {HOURS.format(t='tier')} AS sla_hours, {ACTION.format(t='tier')} AS action, coalesce(fr = 4, false) AS crisis_shown, n AS n_student_turns, true AS awaiting_classifier FROM g2",
    "gate_card_quotes": f"WITH {CONV}, {PLACED}, f1 AS (SELECT case_id, turn, any_value(text) AS quote, arg_min({{'w': weight, 'c': category, 'n': name}}, {{'i': i, 'a': a}}) AS h FROM oc GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY turn) AS rank FROM f1), l AS (SELECT case_id, max(turn) AS turn, arg_max(text, turn) AS quote FROM st WHERE case_id NOT IN (SELECT case_id FROM f1) GROUP BY 1) SELECT case_id, rank, turn, quote, CAST(h.w AS DOUBLE) AS score, h.c || ' / ' || h.n AS reason FROM r WHERE rank <= 3 UNION ALL SELECT case_id, 1, turn, quote, 0.0, 'no explicit signal; most recent message' FROM l",
    "gate_card_timeline": f"WITH {CONV}, t1 AS (SELECT DISTINCT case_id, turn FROM fired WHERE case_id IN (SELECT case_id FROM verdicts WHERE categories <> '')) SELECT st.case_id, st.turn, CAST(t1.turn IS NOT NULL AS BIGINT) AS risk FROM st LEFT JOIN t1 ON t1.case_id = st.case_id AND t1.turn = st.turn",
    "pinned_cards": f"WITH {RECORDS} SELECT conv_id AS card_id, case_id, 'Handle' || conv_id AS handle, tier, false AS awaiting FROM rec",
    "start_times": f"WITH {CASES} SELECT case_id, make_timestamp(CASE WHEN conv_id % 3 = 0 THEN 1786266000000000 - CAST(conv_id / 8.0 * 86400000000 AS BIGINT) ELSE 1786266000000000 - conv_id * 14400000000 END) AS started_at FROM cases",
    "retention_exemptions": f"WITH {DECIDED} SELECT case_id, exemption FROM dd WHERE exemption IS NOT NULL AND exemption <> 'already_deleted'",
    "retention_tombstones": f"WITH {DECIDED} SELECT dd.case_id, CASE WHEN coalesce(del, false) THEN NULL ELSE rec.card END AS card, CASE WHEN coalesce(del, false) THEN make_timestamp(1774310400000000) ELSE rec.content_deleted_at END AS content_deleted_at FROM dd JOIN rec USING (case_id)",
    "put_scored": f"WITH {RECORDS} SELECT case_id, started_at, CASE WHEN conv_id % 2 = 0 THEN tier ELSE 'T0' END AS tier, CASE WHEN conv_id % 2 = 0 THEN conv_id / 1000 END AS confidence, conv_id % 2 <> 0 AS awaiting FROM rec",
    "store_reads": f"WITH {RECORDS} SELECT case_id, tier, started_at FROM rec WHERE tier = 'T2' AND content_deleted_at IS NULL ORDER BY started_at DESC, case_id LIMIT 20",
    "revoked_sessions": "SELECT user_id % 9 AS counsellor_id, CASE WHEN event_id % 6 = 0 THEN ts WHEN user_id % 9 = 4 THEN make_timestamp(1774310400000000) END AS revoked_at, count(*) AS n FROM events GROUP BY 1, 2",
    "retention_decide": f'WITH {DECIDED} SELECT case_id, exemption, due_at, coalesce(del, false) AS "delete" FROM dd',
    "retention_sweep": f"WITH {DECIDED} SELECT count(*) AS examined, count(*) FILTER (del) AS to_delete, count(*) FILTER (exemption IS NULL AND NOT coalesce(del, false)) AS not_yet_due, count(*) FILTER (exemption = 'escalated') AS escalated, count(*) FILTER (exemption = 'explicit_hold') AS explicit_hold, count(*) FILTER (exemption = 'unreviewed_break_glass') AS unreviewed_break_glass FROM dd",
    "retention_erase": f"WITH {ST}, {DECIDED} SELECT case_id, count(*) AS n FROM st WHERE case_id NOT IN (SELECT case_id FROM dd WHERE del) GROUP BY 1",
    "case_messages": f"WITH {CONV}, sent AS (SELECT case_id, count(*) AS n_turns FROM st GROUP BY 1) SELECT case_id, n_turns + 1 AS seq, n_turns, true AS complete, round(score, 6) AS score, CASE WHEN score >= 0.70 THEN 'high' WHEN score >= 0.35 THEN 'grey' ELSE 'clear' END AS level, 'T' || fr AS floor, CASE WHEN fr = 4 THEN NULL ELSE 'T3' END AS ceiling, n_hits FROM verdicts JOIN sent USING (case_id)",
    "bucket_store": f"WITH {RECORDS}, st0 AS (SELECT case_id, conv_id, CASE WHEN conv_id % 3 = 1 OR (conv_id % 3 = 0 AND conv_id % 10 >= 5) THEN 'T1' ELSE tier END AS tier, CASE WHEN conv_id % 3 = 1 OR (conv_id % 3 = 0 AND conv_id % 10 >= 5) THEN conv_id % 10 ELSE 5 END AS seq, CASE conv_id % 3 WHEN 1 THEN conv_id % 5 = 0 WHEN 2 THEN conv_id % 4 = 0 ELSE conv_id % 4 = 0 OR conv_id % 5 = 0 END AS crisis FROM rec) SELECT case_id, CASE WHEN seq = 9 AND NOT crisis THEN 'T9' ELSE tier END AS tier, seq, crisis FROM st0 WHERE conv_id % 7 <> 3",
    "logged_once": f"WITH {LOG}, numbered AS (SELECT row_number() OVER (ORDER BY seq % 3, \"at\", seq) - 1 AS n, * FROM lg) SELECT n AS seq, seq AS event, case_id, \"at\" FROM numbered",
    "newest_logged": f"WITH {LOG}, r AS (SELECT *, row_number() OVER (PARTITION BY counsellor_id ORDER BY \"at\" DESC, seq DESC) AS place FROM lg) SELECT counsellor_id, place, seq AS event, \"at\" FROM r WHERE place <= 100",
    "stored_turns": f"WITH {ST} SELECT count(*) AS n, count(text) AS readable FROM st",
    "scored_turns": f"WITH {ST}, z AS (SELECT *, list_prepend(0.0, list_transform({list(Q.SCORED_WORDS)}, lambda w: 0.5 * len(list_filter(regexp_extract_all(text, '[a-z]+'), lambda x: x = w)))) AS logits FROM st), e AS (SELECT *, len(text) <= {Q.SCORED_CHARS} AS fine, list_transform(logits, lambda x: exp(x / 1.5)) AS powers FROM z) SELECT case_id, turn, CASE WHEN fine THEN 'scored' ELSE 'bad_response' END AS outcome, CASE WHEN fine THEN round(powers[1] / list_sum(powers), 6) END AS \"none\", CASE WHEN fine THEN round(list_max(powers) / list_sum(powers), 6) END AS top FROM e",
    "seed_store": f"WITH {ST}, {RECORDS} SELECT case_id, tier, n_turns, true AS whole, CASE WHEN coalesce(tier IN ('T3', 'T4'), false) THEN NULL ELSE started_at + INTERVAL 30 DAYS END AS retention_expires_at FROM rec JOIN (SELECT case_id, count(*) AS n_turns FROM st GROUP BY 1) USING (case_id)",
    "upsert_latch": f"WITH {RECORDS} SELECT case_id, CASE WHEN conv_id % 3 = 2 THEN tier ELSE 'T1' END AS tier, CASE WHEN conv_id % 3 = 1 THEN conv_id % 5 = 0 WHEN conv_id % 3 = 2 THEN conv_id % 4 = 0 ELSE conv_id % 4 = 0 OR conv_id % 5 = 0 END AS crisis FROM rec",
    "replace_children": f"WITH {ST} SELECT case_id, count(*) FILTER (conv_id % 2 = 1 OR turn = 0) AS n, max(CASE WHEN conv_id % 2 = 1 OR turn = 0 THEN turn END) AS last_turn FROM st GROUP BY 1",
    "email_redaction": r"SELECT doc_id AS id, CAST(len(regexp_extract_all(text, '\b[\w.+-]+@[\w-]+\.[\w.-]+\b')) AS BIGINT) AS n_emails FROM documents",
    "student_receipt": f"WITH {RECORDS} SELECT case_id, CASE tier WHEN 'T4' THEN 'Someone will get in touch with you as soon as possible.' WHEN 'T3' THEN 'A counsellor will get in touch, usually within a day.' WHEN 'T2' THEN 'A counsellor has your conversation and will read it.' ELSE 'Nobody has been asked to follow this up.' END AS status, CASE tier WHEN 'T4' THEN 'A counsellor at your school has been told about this conversation and it is at the top of their list. If you need to talk to someone right now, the numbers below are free and open all day and night.' WHEN 'T3' THEN 'Someone at your school has your conversation and will read it. You do not have to do anything else.' WHEN 'T2' THEN 'It is in their list rather than at the top of it, so this might take a few days.' ELSE 'Nothing here looked like something a counsellor needed to act on. That is not a judgement about whether it matters to you. You can keep talking any time, and if things change, say so and it will be looked at again.' END AS detail, coalesce(tier IN ('T2', 'T3', 'T4'), false) AS someone_will_read, CASE WHEN retention_expires_at IS NOT NULL THEN 'Your conversation is deleted on ' || strftime(retention_expires_at, '%-d %B %Y') || ', 30 days after it started. After that it is gone and nobody can read it, including us.' WHEN tier IN ('T3', 'T4') THEN 'Because a counsellor is following this up, your conversation is kept as part of their record and is not deleted automatically. You can ask your school what happens to it.' ELSE 'This conversation does not have a deletion date set yet.' END AS retention FROM rec",
    "event_windows": "SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2",
    "user_sessions": "WITH o AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOURS THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS g FROM o) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOURS AS \"end\", count(*) AS n FROM s GROUP BY user_id, g",
}
