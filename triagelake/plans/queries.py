"""One query for each operator, over the driver's tables. Computed numbers are rounded to six places on both sides of the check."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import casework, cluster, corpus, features, gate, head, ladder, metrics, privacy, scorer
from ..sources import seed, stores, tables
from ..streaming import cases as case_stream
from . import standins as S

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*[(F.round(c, places) if t == "double" else F.col(c)).alias(c) for c, t in df.dtypes])


def longs(df: DataFrame) -> DataFrame:
    return df.select(*[(F.col(c).cast("bigint") if t == "int" else F.col(c)).alias(c) for c, t in df.dtypes])


# ---- text

@query
def student_turns(spark, d):
    return S.turns(spark, d).select("case_id", "turn", "text")


@query
def leet_normalize(spark, d):
    return S.turns(spark, d).select("case_id", "turn", T.leet_normalize(F.col("text")).alias("norm"), F.size(T.haystacks(F.col("text"))).cast("long").alias("n_haystacks"))


@query
def clean_text(spark, d):
    return tables.table(spark, d, "documents").select("doc_id", T.clean_text(F.col("text")).alias("cleaned"))


@query
def norm_key_dedupe(spark, d):
    docs = tables.table(spark, d, "documents").select("doc_id", "source", "text")
    return corpus.first_of_key(docs, [F.col("source"), F.col("doc_id")]).select("doc_id", T.norm_key(F.col("text")).alias("key"))


@query
def word_tokens(spark, d):
    each = S.turns(spark, d).select("case_id", F.explode(T.word_tokens(F.col("text"))).alias("term"))
    return each.groupBy("case_id", "term").agg(F.count("*").alias("tf"))


@query
def char_trigrams(spark, d):
    each = S.accounts(spark, d).select("case_id", F.explode(T.char_ngrams(F.col("account"))).alias("gram"))
    return each.groupBy("case_id", "gram").agg(F.count("*").alias("n"))


@query
def pseudonyms(spark, d):
    return cluster.entity_tokens(S.entities(spark, d), S.KEY)


@query
def label_mapping(spark, d):
    return S.labelled(spark, d).groupBy("harm").agg(F.count("*").alias("n"))


# ---- gate

def _hits(spark, d):
    return gate.turn_hits(S.turns(spark, d), S.VOCABULARY, ())


@query
def gate_hit_counts(spark, d):
    return _hits(spark, d).groupBy("case_id", "turn", "name").agg(F.count("*").alias("n"))


def _verdicts(spark, d, hits=None):
    return gate.verdicts(_hits(spark, d) if hits is None else hits, S.cases(spark, d), ["case_id"])


@query
def gate_turn_verdict(spark, d):
    out = gate.verdicts(_hits(spark, d), S.turns(spark, d), ["case_id", "turn"])
    return rounded(out.select("case_id", "turn", "score", "level", "floor", "ceiling", "n_hits", "requires_crisis"))


@query
def gate_conversation_verdict(spark, d):
    return rounded(_verdicts(spark, d).select("case_id", "score", "level", "floor", "ceiling", "categories", "n_hits", "requires_crisis"))


@query
def gate_real_bank(spark, d):
    """The shipped bank over all student turns: verdicts of all cases."""
    return rounded(gate.verdicts(gate.turn_hits(S.turns(spark, d)), S.cases(spark, d), ["case_id"]))


@query
def gate_suppressed_hits(spark, d):
    """Overlapping patterns, a suppressor and look-alike signs: every other turn is written with 4, 3 and 0 for a, e and o."""
    text = F.when(F.col("turn") % 2 == 1, F.translate("text", "aeo", "430")).otherwise(F.col("text"))
    hits = gate.turn_hits(S.turns(spark, d).withColumn("text", text), S.OVERLAPPING, S.SUPPRESSING)
    return hits.groupBy("case_id", "turn", "name").agg(F.count("*").alias("n"))


@query
def gate_probes(spark, d):
    """The shipped bank on what students may write: each case says one thing of a list."""
    said = F.element_at(F.array(*map(F.lit, S.SAID)), (F.col("conv_id") % len(S.SAID) + 1).cast("int"))
    turns = S.cases(spark, d).select("case_id", F.lit(0).cast("long").alias("turn"), said.alias("text"))
    out = gate.verdicts(gate.turn_hits(turns), turns, ["case_id"])
    return out.select("case_id", "floor", "ceiling", "requires_crisis")


@query
def gate_top_hits(spark, d):
    return longs(gate.top_hits(gate.real_hits(_hits(spark, d), ["case_id"])).select("case_id", "rank", "turn", "name", "a", "b", "said"))


@query
def apply_verdict_grid(spark, d):
    """Events as proposals of a tier, with a floor, a ceiling and strong evidence or without: what comes of each, and how often."""
    e = F.col("event_id")
    grid = tables.table(spark, d, "events").select((e % 5).cast("int").alias("predicted"), (F.floor(e / 5) % 6).cast("int").alias("f"), (F.floor(e / 30) % 2 == 1).alias("override"), (F.floor(e / 60) % 2 == 1).alias("capped"))
    grid = grid.withColumn("floor", F.when(F.col("f") < 5, F.col("f"))).withColumn("ceiling", F.when(F.col("capped"), F.lit(3)))
    tier, reason = gate.apply_verdict(F.col("predicted"), F.col("floor"), F.col("ceiling"), F.col("override"), F.lit("names"))
    return longs(grid.select("predicted", "floor", "ceiling", "override", tier.alias("tier"), reason.alias("reason"))).groupBy("predicted", "floor", "ceiling", "override", "tier", "reason").agg(F.count("*").alias("n"))


# ---- markers and features

@query
def report_markers(spark, d):
    return rounded(features.markers(S.accounts(spark, d)).select("case_id", "duration_weeks", *features.GROUPS["report"]))


@query
def features_turn(spark, d):
    return rounded(features.turn_features(S.turns(spark, d)))


@query
def features_trend(spark, d):
    return rounded(features.trend_features(S.turns(spark, d)))


@query
def features_all(spark, d):
    return rounded(features.featurise(_verdicts(spark, d), S.turns(spark, d), S.accounts(spark, d)))


@query
def features_checked(spark, d):
    """Features of all cases, none of which may be missing or infinite: how many cases, and the sum of each group."""
    rows = features.checked(features.featurise(_verdicts(spark, d), S.turns(spark, d), S.accounts(spark, d)))
    return rounded(rows.agg(F.count("*").alias("n"), F.sum("gate_hit_count").alias("hits"), F.sum("n_turns").alias("turns"), F.max("max_risk").alias("max_risk")), 4)


@query
def topk_quotes(spark, d):
    hits = tables.checkpointed(_hits(spark, d))
    queued = _decided(spark, d, hits).filter(F.col("tier").isin(*casework.QUEUED)).select("case_id")
    return rounded(features.quotes(S.turns(spark, d), gate.real_hits(hits, ["case_id"]), queued))


@query
def quotes_without_hits(spark, d):
    """The last band: cases of which nothing is risky or flagged (risks are halved here), all of them queued."""
    calm = S.turns(spark, d).withColumn("probs", F.transform("probs", lambda p, i: F.when(i == 0, (1 + p) / 2).otherwise(p / 2)))
    return rounded(features.quotes(calm, _hits(spark, d).filter("false"), S.cases(spark, d)))


# ---- joins and logs

@query
def transcript_join(spark, d):
    return S.turns(spark, d).select("case_id", "turn", "text").join(S.cases(spark, d).select("case_id", "started_at"), "case_id").select("case_id", "turn", "started_at", F.length("text").cast("long").alias("n_chars"))


@query
def access_valid(spark, d):
    return casework.valid_access(S.access(spark, d)).groupBy("action").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"))


@query
def access_log(spark, d):
    return longs(casework.newest_accesses(S.access(spark, d)).select("case_id", "seq", "action", "at", "place"))


@query
def latest_override(spark, d):
    return casework.latest(S.access(spark, d).filter("action = 'overrode_tier'").select("case_id", "at", "seq", "counsellor_id"), "case_id", "at", "seq")


def _requests(spark, d):
    r = S.access(spark, d).filter("action = 'overrode_tier'")
    return r.select("seq", "case_id", F.concat(F.lit("c"), (F.floor(F.col("seq") / 4) % 5).cast("string")).alias("counsellor_id"), "reason", T.tier_name(F.col("seq") % 5).alias("requested_tier"), F.when(F.col("seq") % 3 > 0, T.tier_name(F.floor(F.col("seq") / 8) % 5)).alias("gate_floor"))


@query
def override_decisions(spark, d):
    out = casework.decide_overrides(_requests(spark, d), S.access(spark, d))
    return out.select("seq", "refusal", "effective_tier", "floored", "floored_notice")


@query
def break_glass_decisions(spark, d):
    requests = _requests(spark, d).withColumnRenamed("requested_tier", "closed_at_tier").withColumn("reason", F.concat("reason", "reason"))
    return casework.decide_break_glass(requests, S.access(spark, d)).select("seq", "refusal", "allowed")


@query
def break_glass_review(spark, d):
    log = S.access(spark, d)
    broke = log.filter("seq % 40 = 3").select(F.col("seq").alias("record_id"), "case_id", "counsellor_id", "at", F.lit(None).cast("string").alias("reviewed_by"), F.when(F.col("seq") % 80 == 3, F.col("at")).alias("reviewed_at"))
    reviews = log.filter("seq % 8 = 1").select((F.floor(F.col("seq") / 40) * 40 + 3).alias("record_id"), F.concat(F.lit("c"), (F.floor(F.col("seq") / 8) % 4).cast("string")).alias("reviewer_id"), F.col("reason").alias("note"), "at", (F.col("seq") % 3 > 0).alias("is_lead"))
    return casework.review_break_glass(broke, reviews).select("record_id", "reviewed_by", "reviewed_at")


@query
def session_resolve(spark, d):
    e = tables.table(spark, d, "events")
    sessions = e.select(F.sha2(F.col("event_id").cast("string"), 256).alias("token_hash"), (F.col("user_id") % 9).alias("counsellor_id"), F.when(F.col("event_id") % 6 == 0, F.col("ts")).alias("revoked_at"), (F.col("ts") + F.expr("INTERVAL 12 HOURS")).alias("expires_at"))
    counsellors = spark.range(9).select(F.col("id").alias("counsellor_id"), (F.col("id") % 3 > 0).alias("active"))
    now = e.agg(F.max("ts").alias("now"))
    live = casework.resolve_sessions(sessions.crossJoin(F.broadcast(now)), counsellors, F.col("now") - F.expr("INTERVAL 10 DAYS"))
    return live.groupBy("counsellor_id").agg(F.count("*").alias("n"), F.min("token_hash").alias("first_token"))


@query
def disclosure_grid(spark, d):
    """Requests for what lies behind a card: the log's entries ask for one of three levels, with the reasons given there."""
    levels = F.element_at(F.array(*map(F.lit, ("card", "transcript", "identity"))), (F.col("seq") % 3 + 1).cast("int"))
    asked = S.access(spark, d).select("seq", levels.alias("level"), "reason", (F.floor(F.col("seq") / 9) % 2 == 1).alias("escalated"), F.when(F.col("seq") % 7 > 0, F.col("counsellor_id")).alias("counsellor_id"))
    return casework.disclosure(asked).select("seq", "level", "escalated", "counsellor_id", "allowed", "refusal", "action")


# ---- corpus

@query
def cap_per_group(spark, d):
    return corpus.cap_groups(S.labelled(spark, d).filter("harm is not null"), ["source", "harm"], cap=10).select("row_id", "source", "harm")


@query
def stratified_split(spark, d):
    return corpus.stratified_split(S.labelled(spark, d).filter("harm is not null")).select("row_id", "harm", "split")


@query
def corpus_build(spark, d):
    rows = corpus.cleaned(S.labelled(spark, d).select("row_id", "source", "text", "harm"))
    kept = corpus.cap_groups(corpus.first_of_key(rows, [F.col("source"), F.col("row_id")]), ["source", "harm"])
    return corpus.stratified_split(kept).groupBy("harm", "split").agg(F.count("*").alias("n"))


@query
def label_maps(spark, d):
    """Class names of two sources, written in any case, as labels; unknown ones have none."""
    names = [*corpus.SUBREDDITS, *corpus.BULLYING, "other"]
    e = tables.table(spark, d, "events").select("event_id", F.get(F.array(*map(F.lit, names)), (F.col("event_id") % len(names)).cast("int")).alias("name"))
    written = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit(" "), F.upper("name"))).otherwise(F.col("name"))
    return e.select(corpus.class_label(written, corpus.SUBREDDITS).alias("reddit"), corpus.class_label(written, corpus.BULLYING).alias("bullying")).groupBy("reddit", "bullying").agg(F.count("*").alias("n"))


@query
def stratified_baseline(spark, d):
    return metrics.stratified_draw(S.labelled(spark, d).filter("harm is not null"), "harm", "row_id").select("row_id", "harm", "drawn")


@query
def class_distribution(spark, d):
    return rounded(corpus.class_distribution(S.labelled(spark, d).filter("harm is not null")))


@query
def class_weights(spark, d):
    return rounded(metrics.class_weights(S.labelled(spark, d).filter("harm is not null")))


# ---- metrics

def _scored(spark, d):
    return metrics.top_class(S.predictions(spark, d))


@query
def confusion_matrix(spark, d):
    return longs(metrics.confusion(_scored(spark, d), 3))


@query
def class_f1(spark, d):
    return rounded(metrics.class_scores(_scored(spark, d), 3))


@query
def f1_summary(spark, d):
    return rounded(metrics.summary_scores(_scored(spark, d), 3))


@query
def reliability_bins(spark, d):
    return rounded(metrics.reliability_bins(_scored(spark, d)))


@query
def calibration_error(spark, d):
    return rounded(metrics.calibration_error(_scored(spark, d)))


@query
def brier_nll(spark, d):
    return rounded(metrics.proper_scores(_scored(spark, d)))


@query
def safety_view(spark, d):
    return rounded(metrics.safety_view(_scored(spark, d)))


@query
def confusion_pair(spark, d):
    return rounded(metrics.confusion_pair(_scored(spark, d), 0, 1))


@query
def class_gaps(spark, d):
    return rounded(metrics.class_gaps(_scored(spark, d)))


@query
def recall_curve(spark, d):
    ranked = S.predictions(spark, d).select("id", F.get("probs", F.lit(2)).alias("score"), (F.col("y_true") == 2).cast("long").alias("positive"))
    return rounded(metrics.recall_curve(ranked))


@query
def temperature_fit(spark, d):
    """Errors of logits before and after the temperature that fits them best."""
    logits = S.predictions(spark, d).select("y_true", F.transform("probs", lambda p: F.log(p) * 3).alias("logits"))
    return rounded(metrics.calibration_report(logits, metrics.fit_temperature(logits)), 4)


@query
def harm_by_tier(spark, d):
    top = metrics.top_class(S.turns(spark, d).withColumn("y_true", F.lit(0)))
    return metrics.label_counts(top.join(S.records(spark, d).filter("tier is not null").select("case_id", "tier"), "case_id"), "tier")


TEMPERATURES = [0.5, 0.75, 1.0, 1.25, 1.5, 2.0, 3.0]


@query
def temperature_grid(spark, d):
    logits = S.predictions(spark, d).select("y_true", F.transform("probs", lambda p: F.log(p)).alias("logits"))
    return rounded(metrics.temperature_grid(logits, TEMPERATURES))


@query
def risk_by_tier(spark, d):
    top = S.turns(spark, d).groupBy("case_id").agg(F.max(1 - F.get("probs", F.lit(0))).alias("risk"))
    return rounded(metrics.risk_by_group(S.records(spark, d).filter("tier is not null").join(top, "case_id"), "tier", "risk"))


@query
def majority_baseline(spark, d):
    return head.majority(S.labelled(spark, d).filter("harm is not null"), "harm")


#: Shares of tiers in a simulated week.
WEEKLY = {"T0": 0.45, "T1": 0.30, "T2": 0.15, "T3": 0.08, "T4": 0.02}


@query
def recall_at_budget(spark, d):
    """How many of the grave cases of a week the queue's order brings up within the budget."""
    ranked = tables.checkpointed(_decided(spark, d).select("case_id", F.col("queue_rank").alias("score")))
    return rounded(metrics.simulated_recall(S.records(spark, d).filter("tier is not null").select("case_id", "tier").join(ranked, "case_id"), WEEKLY))


# ---- clustering

def _tokens(spark, d):
    tokens = S.entities(spark, d)
    return tokens.select("case_id", F.lit("person").alias("kind"), F.explode("people").alias("token")).unionByName(tokens.select("case_id", F.lit("place").alias("kind"), F.explode("places").alias("token")))


def _links(spark, d):
    return cluster.links(_tokens(spark, d), S.cases(spark, d))


@query
def entity_links(spark, d):
    return rounded(_links(spark, d).select("a", "b", "days_apart", "entity_overlap", F.array_join("shared_people", ",").alias("people"), F.array_join("shared_places", ",").alias("places")))


@query
def bm25_pairs(spark, d):
    words = S.turns(spark, d).select("case_id", F.explode(T.word_tokens(F.col("text"))).alias("term"))
    return rounded(cluster.bm25_pairs(words))


@query
def trigram_cosine(spark, d):
    return rounded(cluster.gram_cosine(S.accounts(spark, d).select("case_id", F.explode(T.char_ngrams(F.col("account"))).alias("gram"))))


@query
def components(spark, d):
    return cluster.components(cluster.spanning_links(_tokens(spark, d), S.cases(spark, d)).select("a", "b"))


def _alerts(spark, d):
    tokens, cases = _tokens(spark, d), S.cases(spark, d)
    tied = tables.checkpointed(cluster.spanning_links(tokens, cases))
    members = tables.checkpointed(cluster.alert_members(tokens, cases, tied=tied))
    return members, cluster.alert_facts(members, tokens, cases, tied=tied)


@query
def pattern_alerts(spark, d):
    out = cluster.alerts(_tokens(spark, d), S.cases(spark, d), S.records(spark, d))
    return rounded(out.select("cluster_id", "size", F.array_join("members", ",").alias("members"), F.array_join("tiers", ",", "-").alias("tiers"), "span_days", "n_people", "n_places", "headline"))


@query
def alerts_of_cases(spark, d):
    """The alerts that hold each case of the top tier."""
    members, facts = _alerts(spark, d)
    return cluster.alerts_of_cases(members, facts, S.records(spark, d).filter("tier = 'T4'")).select("case_id", "cluster_id", "size")


@query
def link_rows(spark, d):
    """Links as delivered, with the lexical similarity that corroborates them."""
    links = tables.checkpointed(_links(spark, d))
    out = cluster.describe_links(links, _lexical(spark, d, links))
    return out.select("a", "b", "entity_overlap", "lexical", "days_apart", F.array_join("shared_people", ",").alias("people"), F.array_join("shared_places", ",").alias("places"), "reason")


@query
def link_counts(spark, d):
    """How many links each shared person or place makes."""
    return cluster.link_counts(_tokens(spark, d), S.cases(spark, d))


@query
def alert_tokens(spark, d):
    """The people and places that an alert's links share."""
    tokens, cases = _tokens(spark, d), S.cases(spark, d)
    tied = tables.checkpointed(cluster.spanning_links(tokens, cases))
    return cluster.alert_tokens(cluster.alert_members(tokens, cases, tied=tied), tied)


@query
def alert_links(spark, d):
    """The links within each alert."""
    tokens, cases = _tokens(spark, d), S.cases(spark, d)
    return rounded(cluster.alert_links(cluster.alert_members(tokens, cases), cluster.links(tokens, cases)).select("cluster_id", "a", "b", "days_apart", "entity_overlap"))


# ---- messages and stores

@query
def case_messages(spark, d):
    """Messages of all cases, late, repeated and stale ones among them, folded to each case's verdict."""
    return rounded(case_stream.folded(S.messages(spark, d), S.VOCABULARY, ()))


@query
def bucket_store(spark, d):
    """A store on disk after a load, a batch of newer and older rows, a guarded update and an erasure: each rewrote only the buckets it touched."""
    store = stores.BucketStore(spark, tables.scratch(spark, "store"), "case_id string, tier string, seq long, crisis boolean", buckets=16)
    flag = lambda m: (F.col("conv_id") % m == 0).alias("crisis")
    r = S.records(spark, d)
    store.upsert(r.filter("conv_id % 3 <> 1").select("case_id", "tier", F.lit(5).cast("long").alias("seq"), flag(4)))
    store.upsert(r.filter("conv_id % 3 <> 2").select("case_id", F.lit("T1").alias("tier"), (F.col("conv_id") % 10).alias("seq"), flag(5)), latch=("crisis",), newest="seq")
    store.update_where((F.col("seq") == 9) & ~F.col("crisis"), tier=F.lit("T9"))
    store.erase(r.filter("conv_id % 7 = 3"))
    return store.rows()


@query
def logged_once(spark, d):
    """The access log as it arrives in three batches, the second of them twice: numbers without gaps, in order of time within a batch."""
    log = stores.AppendLog(spark, tables.scratch(spark, "log"), "case_id string, counsellor_id string, action string, reason string, at timestamp, event long", order=("at", "event"))
    rows = S.access(spark, d).withColumnRenamed("seq", "event")
    for batch in (0, 1, 1, 2):
        log.append(rows.filter(F.col("event") % 3 == batch), batch)
    return log.rows().select("seq", "event", "case_id", "at")


@query
def newest_logged(spark, d):
    """The newest entries of each counsellor, out of a log on disk."""
    log = stores.AppendLog(spark, tables.scratch(spark, "log"), "case_id string, counsellor_id string, action string, reason string, at timestamp, event long", order=("at", "event"))
    log.append(S.access(spark, d).withColumnRenamed("seq", "event"), 0)
    return longs(log.newest("counsellor_id").select("counsellor_id", "place", "event", "at"))


# ---- head and cards

HEAD = head.HeadParams(
    features=("max_risk", "mean_risk", "count_above_tau"), mean=(0.8, 0.7, 1.5), scale=(0.1, 0.2, 1.0), classes=("T0", "T1", "T2", "T3", "T4"),
    coef=((-0.5, 0.25, 0.0), (0.1, -0.2, 0.3), (0.2, 0.1, -0.1), (0.4, 0.0, 0.2), (0.6, 0.3, -0.4)), intercept=(0.2, 0.1, 0.0, -0.1, -0.3), ranker=(0.8, -0.4, 0.3), ranker_intercept=-0.2, knots=(0.0, 0.3, 0.5, 0.8, 1.0), levels=(0.05, 0.2, 0.2, 0.6, 0.95),
)


def _lexical(spark, d, links):
    pairs = links.select("a", "b")
    words = S.turns(spark, d).select("case_id", F.explode(T.word_tokens(F.col("text"))).alias("term"))
    linked = pairs.select(F.explode(F.array("a", "b")).alias("case_id")).distinct()
    grams = S.accounts(spark, d).join(linked, "case_id", "left_semi").select("case_id", F.explode(T.char_ngrams(F.col("account"))).alias("gram"))
    both = pairs.join(cluster.bm25_pairs(words, pairs), ["a", "b"], "left").join(cluster.gram_cosine(grams, pairs), ["a", "b"], "left")
    return both.select("a", "b", (0.5 * F.coalesce("bm25_norm", F.lit(0.0)) + 0.5 * F.coalesce("cosine", F.lit(0.0))).alias("lexical"))


@query
def link_similarity(spark, d):
    """Lexical similarity of linked cases only, half BM25 over the best score of all pairs, half trigram cosine."""
    return rounded(_lexical(spark, d, tables.checkpointed(_links(spark, d))))


FEATURES = tuple(features.FEATURES)


def _tiered(spark, d):
    """All features of the cases that have a stand-in tier."""
    return features.featurise(_verdicts(spark, d), S.turns(spark, d), S.accounts(spark, d)).join(S.records(spark, d).select("case_id", "tier").filter("tier is not null"), "case_id")


@query
def head_fit(spark, d):
    """Fit on stand-in tiers: weights of the features, heaviest first."""
    return spark.createDataFrame(head.rank_features(head.fit_head(_tiered(spark, d), FEATURES)), "feature string, weight double")


@query
def isotonic_fit(spark, d):
    """Knots of the isotonic map from one class's stand-in probability to its rate."""
    rows = S.predictions(spark, d).select(F.get("probs", F.lit(1)).alias("score"), (F.col("y_true") == 1).cast("double").alias("label"))
    knots, levels = head.fit_isotonic(rows)
    return spark.createDataFrame(list(zip(knots, levels, strict=True)), "knot double, level double")


@query
def cross_validation(spark, d):
    """Out-of-fold tiers and calibrated escalation of all cases with a stand-in tier, from all features."""
    out = head.out_of_fold(_tiered(spark, d), FEATURES)
    return rounded(out.select("case_id", "tier", "fold", "model_tier", "raw_escalation", "escalation"))


@query
def ablation_ladder(spark, d):
    """Six sets of features, each cross-validated in five folds under ten seeds: 300 models in one job."""
    rungs = {name: tuple(f for g in groups for f in features.GROUPS[g]) for name, groups in features.ABLATIONS.items()}
    return rounded(ladder.ladder(_tiered(spark, d), rungs))


@query
def text_baseline(spark, d):
    """Labelled documents judged by a text model that was fitted on the others of a hash split in two."""
    rows = S.labelled(spark, d).filter("harm is not null")
    half = F.substring(F.sha1(F.col("row_id").cast("string")), 1, 1) < "8"
    model = head.fit_text_baseline(rows.filter(half), "harm")
    return model.predict(rows.filter(~half)).groupBy("harm", "predicted").agg(F.count("*").alias("n"))


#: A classifier for checks: so many logits for each time that its word is there. Turns over 150 signs are more than it takes.
SCORED_WORDS, SCORED_CHARS = ("the", "of", "in", "and", "to"), 150


def _count_words():
    import re

    import numpy as np

    def predict(texts):
        out = np.array([[0.0, *[0.5 * re.findall(r"[a-z]+", t).count(w) for w in SCORED_WORDS]] for t in texts])
        out[[len(t) > SCORED_CHARS for t in texts]] = np.nan
        return out

    return predict


@query
def scored_turns(spark, d):
    """Turns through the seam: probabilities at a temperature, and what failed as null."""
    rows = scorer.scored(S.turns(spark, d).select("case_id", "turn", "text"), scorer.batched(_count_words), temperature=1.5)
    return rounded(rows.select("case_id", "turn", "outcome", F.get("probs", F.lit(0)).alias("none"), F.array_max("probs").alias("top")))


@query
def seed_report(spark, d):
    """A dry run of the seed load."""
    turns = S.turns(spark, d).select("case_id", "turn", F.lit("student").alias("role"), "text")
    cards = S.records(spark, d).select("case_id", F.lit("h").alias("handle"), "tier", F.lit(0.5).alias("confidence"), "started_at")
    return seed.load(turns, cards, S.entities(spark, d), F.unhex(F.sha2(F.lit("not a secret"), 256)))


@query
def seed_store(spark, d):
    """Stores after a load of all cases and one of every third again: each case's turns, and whether all that was found in them is sealed and opens to it."""
    found = seed.seed_stores(spark, tables.scratch(spark, "seed"), buckets=16)
    key = F.unhex(F.sha2(F.lit("not a secret"), 256))
    turns, people = S.turns(spark, d).select("case_id", "turn", F.lit("student").alias("role"), "text", "conv_id"), S.entities(spark, d)
    cards = S.records(spark, d).select("case_id", F.lit("h").alias("handle"), "tier", F.lit(0.5).alias("confidence"), "started_at", "conv_id")
    for some in (F.lit(True), F.col("conv_id") % 3 == 0):
        seed.load_into(found, turns.filter(some).drop("conv_id"), cards.filter(some).drop("conv_id"), people, key)
    sealed = found["pii"].rows().groupBy("case_id").agg(F.count("*").alias("n_sealed"), F.count_if(F.length(privacy.unseal(F.col("ciphertext"), key)) > 0).alias("n_opened"))
    told = found["turns"].rows().groupBy("case_id").agg(F.count("*").alias("n_turns"), F.sum("n_spans").alias("n_spans"))
    both = found["conversations"].rows().join(told, "case_id").join(sealed, "case_id", "left")
    same = (F.coalesce("n_sealed", F.lit(0)) == F.col("n_spans")) & (F.coalesce("n_opened", F.lit(0)) == F.col("n_spans"))
    return both.select("case_id", "tier", "n_turns", same.alias("whole"), "retention_expires_at")


@query
def cross_validation_folds(spark, d):
    return longs(head.folds(S.records(spark, d).filter("tier is not null"), "tier").select("case_id", "tier", "fold"))


@query
def verdict_audit(spark, d):
    """Verdicts against an expectation that is wrong for one case in sixteen."""
    actual = _verdicts(spark, d)
    wrong = F.substring(F.sha1("case_id"), 1, 1) == "0"
    expected = actual.select("case_id", F.when(wrong, "T9").otherwise(F.col("floor")).alias("expected_floor"), F.col("categories").alias("expected_categories"))
    return gate.audit_verdicts(actual, expected)


@query
def span_type_counts(spark, d):
    docs = tables.table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", F.array().cast("array<string>").alias("people"), F.array().cast("array<string>").alias("places"))
    return privacy.span_counts(privacy.redact(docs))


@query
def break_glass_open(spark, d):
    log = S.access(spark, d)
    return casework.unreviewed(log.filter("seq % 40 = 3").select(F.col("seq").alias("record_id"), "at", F.when(F.col("seq") % 80 == 3, F.col("at")).alias("reviewed_at"))).select("record_id", "at")


@query
def transcript_readers(spark, d):
    return casework.read_first(_requests(spark, d), S.access(spark, d)).select("seq", "case_id", "counsellor_id")


def _known(spark, d):
    """Student turns with the names that are known of their case."""
    return S.turns(spark, d).select("case_id", "turn", "text").join(S.entities(spark, d), "case_id")


@query
def redacted_turns(spark, d):
    """Every turn redacted by itself, with its case's people and places known: placeholders number anew in each."""
    out = privacy.redact(_known(spark, d).select(F.struct("case_id", "turn").alias("id"), "text", "people", "places"))
    return out.select("id.case_id", "id.turn", "redacted", F.size("spans").cast("long").alias("n_spans"))


@query
def stored_turns(spark, d):
    """Redacted turns on their way to the store: one that still held something identifying would fail the query."""
    rows = redacted_turns(spark, d).select(F.struct("case_id", "turn").alias("id"), F.col("redacted").alias("text"), F.array().cast("array<string>").alias("people"), F.array().cast("array<string>").alias("places"))
    return privacy.assert_redacted(rows).agg(F.count("*").alias("n"), F.count_if(F.length("text") >= 0).alias("readable"))


@query
def case_receipt(spark, d):
    """What students may see: their turns redacted, and who looked."""
    return casework.receipt(_known(spark, d), S.access(spark, d))


@query
def receipt_accesses(spark, d):
    return casework.receipt(_known(spark, d), S.access(spark, d)).filter("part = 'access'").select("case_id", "place", "what")


@query
def head_apply(spark, d):
    out = head.apply_head(features.turn_features(S.turns(spark, d)), HEAD)
    return rounded(out.select("case_id", "model_tier", "confidence", "raw_escalation", "escalation"))


def _decided(spark, d, hits=None):
    """Texts are searched once: ``hits``, where they are there already, else a checkpoint of them."""
    hits = tables.checkpointed(_hits(spark, d)) if hits is None else hits
    scored = head.apply_head(features.turn_features(S.turns(spark, d)), HEAD)
    return head.decide_case(scored.join(_verdicts(spark, d, hits), "case_id").join(gate.floor_names(hits), "case_id", "left"))


@query
def decided_cases(spark, d):
    return rounded(_decided(spark, d).select("case_id", "model_tier", "tier", "queue_rank"))


def _cards(spark, d):
    turns = S.turns(spark, d)
    reports = features.markers(S.accounts(spark, d)).select("case_id", features.describe_markers().alias("report"))
    found = tables.checkpointed(_hits(spark, d))
    hits = gate.real_hits(found, ["case_id"])
    decided = tables.checkpointed(_decided(spark, d, found))
    queued = decided.filter(F.col("tier").isin(*casework.QUEUED)).select("case_id")
    return casework.build_cards(decided.join(S.cases(spark, d).select("case_id", "handle", "started_at"), "case_id"), turns.select("case_id", "turn", (1 - F.get("probs", F.lit(0))).alias("risk")), features.quotes(turns, hits, queued), reports, S.entities(spark, d).withColumn("platforms", F.array().cast("array<string>")))


@query
def escalation_cards(spark, d):
    """The nested record of every case."""
    return casework.card_json(_cards(spark, d))


@query
def verdict_json(spark, d):
    """The gate's verdicts as documents."""
    hits = tables.checkpointed(_hits(spark, d))
    return gate.verdict_json(_verdicts(spark, d, hits), gate.real_hits(hits, ["case_id"]))


@query
def card_reasons(spark, d):
    """Why a card has its tier, sentence by sentence."""
    return longs(_cards(spark, d).select("case_id", F.posexplode("reasons").alias("place", "reason")))


@query
def card_lists(spark, d):
    """The lists of the cards that name a person or a place, or have a turn of risk: entities and timeline, in order."""
    cards = tables.checkpointed(_cards(spark, d))
    named = lambda kind: cards.select("case_id", F.lit(kind).alias("part"), F.posexplode(f"entities.{kind}").alias("place", "what"), F.lit(None).cast("double").alias("risk"))
    turns = cards.select("case_id", F.inline("session_timeline")).select("case_id", F.lit("turn").alias("part"), F.col("ordinal").alias("place"), F.col("turn_id").alias("what"), "risk")
    return longs(named("people").unionByName(named("places")).unionByName(turns))


@query
def card_places(spark, d):
    """All cards in the order in which they are written."""
    return casework.ranked_cards(_cards(spark, d).select("case_id", "tier", "queue_rank")).select("place", "case_id", "tier", "queue_rank")


@query
def card_fields(spark, d):
    """Cards without their lists."""
    cards = _cards(spark, d)
    return longs(cards.select("case_id", "handle", "tier", "confidence", "tier_floor_reason", "gate_floor", F.array_join("gate_indicators", ",").alias("gate_indicators"), "action", "sla_hours", "n_student_turns", "queue_rank", "escalation", "model_tier", "crisis_shown", "retention_expires_at", F.size("cited_quotes").alias("n_quotes"), "started_at", "delta_since_last_session", "pattern_cluster_id"))


@query
def queue_order(spark, d):
    """Ranks are rounded to whole numbers here, so that many are equal and the rule for ties decides."""
    cards = _decided(spark, d).join(S.cases(spark, d).select("case_id", "conv_id"), "case_id").select("case_id", "tier", F.floor("queue_rank").cast("double").alias("queue_rank"), (F.col("conv_id") % 2 == 0).alias("is_live"))
    return longs(casework.queue_places(cards).select("case_id", "tier", "queue_rank", "is_live", "place"))


@query
def queue_stats(spark, d):
    cards = S.records(spark, d).select("case_id", "tier", (F.col("conv_id") % 2 == 0).alias("is_live"), (F.col("conv_id") % 3 == 0).alias("awaiting"))
    return casework.queue_stats(cards)


@query
def tier_counts(spark, d):
    return casework.tier_counts(S.records(spark, d).filter("tier <> 'T3'"))


@query
def gate_cards(spark, d):
    """Cards of cases that only the gate has seen, lists joined to texts."""
    found = tables.checkpointed(_hits(spark, d))
    hits = gate.real_hits(found, ["case_id"])
    cards = casework.gate_cards(_verdicts(spark, d, found), hits, S.turns(spark, d), S.cases(spark, d))
    return longs(cards.withColumn("gate_indicators", F.array_join("gate_indicators", ",")).withColumn("reasons", F.array_join("reasons", "|")))


@query
def gate_card_quotes(spark, d):
    return longs(casework.gate_quotes(gate.real_hits(_hits(spark, d), ["case_id"]), S.turns(spark, d)))


@query
def gate_card_timeline(spark, d):
    return longs(casework.gate_timeline(gate.real_hits(_hits(spark, d), ["case_id"]), S.turns(spark, d)))


@query
def pinned_cards(spark, d):
    """Scored cards that came back under wrong names keep the identity that was asked about."""
    asked = S.cases(spark, d).select(F.col("conv_id").alias("card_id"), "case_id", "handle")
    scored = S.records(spark, d).select(F.col("conv_id").alias("card_id"), F.lit("someone else").alias("case_id"), F.lit("x").alias("handle"), "tier", F.lit(True).alias("awaiting"))
    return casework.pinned(scored, asked).select("card_id", "case_id", "handle", "tier", "awaiting")


@query
def start_times(spark, d):
    """When cases began: so many days before the epoch where that is declared, else by their place."""
    c = S.cases(spark, d)
    return c.select("case_id", casework.started(F.when(F.col("conv_id") % 3 == 0, F.col("conv_id") / 8.0), F.col("conv_id"), F.timestamp_micros(F.lit(1_786_266_000_000_000))).alias("started_at"))


# ---- retention, stores, privacy

def _decisions(spark, d):
    open_glass = S.cases(spark, d).filter("conv_id % 9 = 4")
    return casework.retention_decisions(S.records(spark, d), open_glass, F.timestamp_micros(F.lit(1_774_310_400_000_000)))


@query
def retention_decide(spark, d):
    return _decisions(spark, d).select("case_id", "exemption", "due_at", "delete")


@query
def retention_sweep(spark, d):
    return casework.retention_sweep(_decisions(spark, d))


@query
def retention_exemptions(spark, d):
    return casework.exemptions(_decisions(spark, d))


@query
def retention_tombstones(spark, d):
    """Records after a sweep: the erased have no card and are stamped."""
    out = casework.erase_records(S.records(spark, d), _decisions(spark, d), F.timestamp_micros(F.lit(1_774_310_400_000_000)))
    return out.select("case_id", "card", "content_deleted_at")


@query
def put_scored(spark, d):
    """Stored gate cards with the columns of those that have been scored since."""
    old = S.records(spark, d).select("case_id", "started_at", F.lit("T0").alias("tier"), F.lit(None).cast("double").alias("confidence"), F.lit(True).alias("awaiting"))
    new = S.records(spark, d).filter("conv_id % 2 = 0").select("case_id", "tier", (F.col("conv_id") / 1000).alias("confidence"))
    return tables.put_scored(old, new, ("tier", "confidence"))


@query
def store_reads(spark, d):
    """A filtered, ordered and limited read: the newest cases of one tier whose content is there."""
    return tables.stored(S.records(spark, d), (F.desc("started_at"), F.col("case_id")), 20, tier="T2", content_deleted_at=None).select("case_id", "tier", "started_at")


@query
def revoked_sessions(spark, d):
    """A guarded point update: sessions of one counsellor that are not revoked yet are revoked now."""
    e = tables.table(spark, d, "events").select("event_id", (F.col("user_id") % 9).alias("counsellor_id"), F.when(F.col("event_id") % 6 == 0, F.col("ts")).alias("revoked_at"))
    return tables.update_where(e, (F.col("counsellor_id") == 4) & F.col("revoked_at").isNull(), revoked_at=F.timestamp_micros(F.lit(1_774_310_400_000_000))).groupBy("counsellor_id", "revoked_at").agg(F.count("*").alias("n"))


@query
def retention_erase(spark, d):
    return casework.erase(S.turns(spark, d).select("case_id", "turn"), _decisions(spark, d)).groupBy("case_id").agg(F.count("*").alias("n"))


@query
def upsert_latch(spark, d):
    flag = lambda m: (F.col("conv_id") % m == 0).alias("crisis")
    old = S.records(spark, d).filter("conv_id % 3 <> 1").select("case_id", "tier", flag(4))
    new = S.records(spark, d).filter("conv_id % 3 <> 2").select("case_id", F.lit("T1").alias("tier"), flag(5))
    return tables.upsert(old, new, "case_id", latch=("crisis",))


@query
def replace_children(spark, d):
    old = S.turns(spark, d).select("case_id", "turn", "text", "conv_id")
    new = old.filter("conv_id % 2 = 0 and turn = 0").withColumn("text", F.upper("text"))
    return tables.replace_children(old, new, "case_id").groupBy("case_id").agg(F.count("*").alias("n"), F.max("turn").alias("last_turn"))


@query
def email_redaction(spark, d):
    docs = tables.table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", F.array().cast("array<string>").alias("people"), F.array().cast("array<string>").alias("places"))
    out = privacy.redact(docs)
    emails = F.filter("spans", lambda s: s["type"] == "email")
    return out.select("id", F.size(emails).cast("long").alias("n_emails"))


@query
def redacted_documents(spark, d):
    docs = tables.table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", F.array().cast("array<string>").alias("people"), F.array().cast("array<string>").alias("places"))
    return privacy.redact(docs).select("id", F.size("spans").cast("long").alias("n_spans"), F.sha1("redacted").alias("redacted_sha1"))


@query
def sealed_names(spark, d):
    """Round trip of sealing: the ciphertexts differ by nonce, what comes back does not."""
    key = F.unhex(F.sha2(F.lit("not a secret"), 256))
    names = S.entities(spark, d).select("case_id", F.explode("people").alias("value"))
    sealed = names.withColumn("sealed", privacy.seal(F.col("value"), key))
    return sealed.select("case_id", "value", (privacy.unseal(F.col("sealed"), key) == F.col("value")).alias("same"))


@query
def student_receipt(spark, d):
    tier = F.col("tier")
    return S.records(spark, d).select("case_id", casework.student_status(tier).alias("status"), casework.student_detail(tier).alias("detail"), casework.someone_will_read(tier).alias("someone_will_read"), casework.retention_copy(tier, F.col("retention_expires_at")).alias("retention"))


@query
def event_windows(spark, d):
    """An extension: tumbling windows over the events table, as a stream would count them."""
    from ..streaming.turns import windowed_counts

    return rounded(windowed_counts(tables.table(spark, d, "events"), window="1 day"), 2)


@query
def user_sessions(spark, d):
    """An extension: sessions of users over the events table, ended by six quiet hours."""
    from ..streaming.turns import sessions

    return sessions(tables.table(spark, d, "events"), gap="6 hours")
