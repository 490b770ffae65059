"""Cards, queue, audit, overrides, break-glass, disclosure and retention: rules as columns, lookups as joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tier_name, tier_rank, trimmed

#: Fixed values. Least lengths of the reasons that actions need, days a case is kept, tiers that count as escalated, session hours.
REASON_CHARS = {"viewed_transcript": 10, "unsealed_pii": 20, "overrode_tier": 10, "broke_glass": 40, "reviewed_break_glass": 10}
KEEP_DAYS, ESCALATED, QUEUED = 30, ("T3", "T4"), ("T2", "T3", "T4")
#: Fixed values. Sentences of a card.
TIER_REASONS = {
    "T0": "No concern identified. Logged only.",
    "T1": "Venting or minor social friction. No counsellor action needed.",
    "T2": "Sustained bullying or exclusion. Routine queue, 48 hours.",
    "T3": "Severe or persistent harassment. Priority queue, 24 hours.",
    "T4": "Immediate risk. Break-glass now; crisis resources were shown to the student.",
}
TIER_ACTIONS = {"T0": "Log only", "T1": "Log, no counsellor action", "T2": "Queue, routine", "T3": "Queue, priority", "T4": "Break-glass immediately, crisis resources to student"}
TIER_HOURS = {"T2": 48, "T3": 24, "T4": 0}
GATE_REASONS = {
    "self_harm_intent": "Describes harming themselves.",
    "suicidal_ideation": "Describes not wanting to be alive.",
    "abuse_disclosure": "Describes being hurt or unsafe at home.",
    "threat_of_violence": "Reports being threatened with violence.",
    "weapon_mention": "Mentions a weapon.",
    "imminent_time_marker": "Refers to something happening imminently.",
}


#: Fixed values. Sentences of a card that only the gate has seen.
GATE_CARD_TIERS = {
    "T0": "No action needed; logged only.",
    "T1": "Mild concern; logged, no action needed.",
    "T2": "Sustained difficulty. Queue for a conversation.",
    "T3": "Significant distress. Contact within 24 hours.",
    "T4": "Risk to life. Act now.",
}
GATE_CARD_REASONS = {
    "self_harm_intent": "Stated intent to self-harm or end their life.",
    "self_harm_past": "Described self-harm that has already happened.",
    "abuse_disclosure": "Described harm being done to them by someone else.",
    "weapon_or_violence": "Mentioned a weapon or planned violence.",
    "imminence": "Language suggesting something is about to happen.",
    "isolation": "Described having nobody to turn to.",
}
GATE_CARD_LAST = "Scored by the safety gate only. The classifier has not run on this yet."
LAST_MESSAGE = "no explicit signal; most recent message"


def _lookup(values: dict, key: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[key]


def started(days_ago: Column, place: Column, epoch: Column) -> Column:
    """When a fixture's case began: so many days before the epoch, or four hours earlier for each place in the file."""
    micros = F.coalesce(F.round(days_ago * 86_400_000_000.0).cast("long"), place.cast("long") * F.lit(4 * 3_600_000_000))
    return F.timestamp_micros(F.unix_micros(epoch) - micros)


def retention_expiry(started_at: Column, tier: Column) -> Column:
    """When content is due to go; null (never) for escalated tiers, 30 days for others and for cases without a tier."""
    return F.when(F.coalesce(tier.isin(*ESCALATED), F.lit(False)), F.lit(None).cast("timestamp")).otherwise(started_at + F.expr(f"INTERVAL {KEEP_DAYS} DAYS"))


def _turn_id(turn: Column) -> Column:
    return F.concat(F.lit("turn-"), turn.cast("string"))


def build_cards(cases: DataFrame, timeline: DataFrame, quotes: DataFrame, reports: DataFrame | None = None, entities: DataFrame | None = None, clusters: DataFrame | None = None) -> DataFrame:
    """One nested record for each decided case: reasons, risk by turn, quotes, entities, expiry, rank and alert.

    ``cases`` come from decide_case with started_at and handle; ``timeline`` has (case_id, turn, risk), ``quotes`` (case_id, rank, turn, quote,
    score, reason), ``reports`` (case_id, report: marker sentences). ``entities`` (case_id, people, places, platforms) and ``clusters`` (case_id, cluster_id) come
    from work across conversations; without them a card's are empty. There is no earlier session to differ from yet. A card holds its case's risks in
    one row, as long as the conversation.
    """
    line = timeline.groupBy("case_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "risk"))), lambda t: F.struct(_turn_id(t["turn"]).alias("turn_id"), t["turn"].alias("ordinal"), F.round(t["risk"], 4).alias("risk"))).alias("session_timeline"), F.count("*").alias("n_student_turns"))
    cited = quotes.groupBy("case_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "turn", "quote", "score", "reason"))), lambda q: F.struct(_turn_id(q["turn"]).alias("turn_id"), q["turn"].alias("turn"), q["quote"].alias("quote"), q["score"].alias("score"), q["reason"].alias("reason"))).alias("cited_quotes"))
    gate = F.transform(F.filter(F.split("categories", ","), lambda c: c != ""), lambda c: _lookup(GATE_REASONS, c))
    out = cases.join(line, "case_id", "left").join(cited, "case_id", "left")
    out = out.join(reports, "case_id", "left") if reports is not None else out.withColumn("report", F.array().cast("array<string>"))
    none = F.array().cast("array<string>")
    known = out.select("case_id", none.alias("people"), none.alias("places"), none.alias("platforms")).limit(0) if entities is None else entities.select("case_id", "people", "places", "platforms")
    out = out.join(known, "case_id", "left")
    out = out.withColumn("cluster_id", F.lit(None).cast("string")) if clusters is None else out.join(clusters.select("case_id", "cluster_id"), "case_id", "left")
    sentence = lambda s: F.concat(F.upper(F.substring(s, 1, 1)), F.lower(F.substr(s, F.lit(2))), F.lit("."))
    told = F.transform(F.coalesce("report", F.array().cast("array<string>")), sentence)
    why = F.when(F.col("floor_reason").isNotNull(), F.array(sentence(F.col("floor_reason")))).otherwise(F.array().cast("array<string>"))
    return out.select(
        "case_id", "handle", "tier", F.round("confidence", 4).alias("confidence"), F.col("floor_reason").alias("tier_floor_reason"), F.col("floor").alias("gate_floor"), F.filter(F.split("categories", ","), lambda c: c != "").alias("gate_indicators"),
        _lookup(TIER_ACTIONS, F.col("tier")).alias("action"), _lookup(TIER_HOURS, F.col("tier")).alias("sla_hours"), F.coalesce("n_student_turns", F.lit(0)).alias("n_student_turns"), F.concat(F.array(_lookup(TIER_REASONS, F.col("tier"))), gate, told, why).alias("reasons"), "session_timeline",
        F.coalesce("cited_quotes", F.array().cast("array<struct<turn_id:string,turn:bigint,quote:string,score:double,reason:string>>")).alias("cited_quotes"), retention_expiry(F.col("started_at"), F.col("tier")).alias("retention_expires_at"), F.round("queue_rank", 4).alias("queue_rank"), F.round("escalation", 4).alias("escalation"), "model_tier", F.col("requires_crisis").alias("crisis_shown"),
        F.struct(*[F.coalesce(c, none).alias(c) for c in ("people", "places", "platforms")]).alias("entities"), F.lit(None).cast("string").alias("delta_since_last_session"), F.col("cluster_id").alias("pattern_cluster_id"), "started_at",
    )


def card_json(cards: DataFrame) -> DataFrame:
    """(case_id, tier, card): each card as a document, empty fields kept."""
    return cards.select("case_id", "tier", F.to_json(F.struct(*[c for c in cards.columns if c not in ("case_id", "tier")]), {"ignoreNullFields": "false"}).alias("card"))


def ranked_cards(cards: DataFrame) -> DataFrame:
    """``cards`` with their place in the list that is written: highest rank first, then tier, then id.

    Numbered range by range, so a list of any length is not one task's work.
    """
    from ..functions.ranking import numbered

    return numbered(cards, [F.desc("queue_rank"), F.desc("tier"), F.col("case_id")], "place", 1)


def gate_cards(verdicts: DataFrame, hits: DataFrame, turns: DataFrame, cases: DataFrame) -> DataFrame:
    """Cards of cases that only the gate has seen: tier from the floor (T0 without one), no confidence, and the top of the floor's band as rank.

    Unknown is not low: a case without a floor ranks at 1, above all that a model has scored without one. ``hits`` are those that count
    (real_hits), ``cases`` has case_id, handle and started_at. Quotes and timeline are rows of their own: gate_quotes, gate_timeline.
    """
    seen = hits.groupBy("case_id", "category").agg(F.min(F.struct("turn", "place")).alias("at"))
    indicators = seen.groupBy("case_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "category"))), lambda x: x["category"]).alias("gate_indicators"))
    said = turns.groupBy("case_id").agg(F.count("*").alias("n_student_turns"))
    out = verdicts.join(cases.select("case_id", "handle", "started_at"), "case_id").join(indicators, "case_id", "left").join(said, "case_id", "left")
    floor, none = F.coalesce(tier_rank(F.col("floor")), F.lit(0)), F.array().cast("array<string>")
    out = out.withColumn("tier", tier_name(floor)).withColumn("gate_indicators", F.coalesce("gate_indicators", none))
    why = F.transform("gate_indicators", lambda c: F.coalesce(_lookup(GATE_CARD_REASONS, c), F.concat(F.lit("Safety gate flagged: "), c, F.lit("."))))
    floored = F.concat(F.lit("The safety gate floors this conversation at "), F.col("floor"), F.lit("."))
    return out.select(
        "case_id", "handle", "tier", F.lit(None).cast("double").alias("confidence"), floored.alias("tier_floor_reason"), F.col("floor").alias("gate_floor"), "gate_indicators",
        F.concat(F.array(_lookup(GATE_CARD_TIERS, F.col("tier"))), why, F.array(F.lit(GATE_CARD_LAST))).alias("reasons"), retention_expiry(F.col("started_at"), F.col("tier")).alias("retention_expires_at"),
        (floor + 1.0).alias("queue_rank"), F.lit(0.0).alias("escalation"), F.lit("T0").alias("model_tier"), _lookup(TIER_HOURS, F.col("tier")).alias("sla_hours"), _lookup(TIER_ACTIONS, F.col("tier")).alias("action"),
        F.col("requires_crisis").alias("crisis_shown"), F.coalesce("n_student_turns", F.lit(0)).alias("n_student_turns"), F.lit(True).alias("awaiting_classifier"),
    )


def gate_quotes(hits: DataFrame, turns: DataFrame, limit: int = 3) -> DataFrame:
    """(case_id, rank, turn, quote, score, reason): whole turns with hits, in order, for the first hit of each; else the most recent message."""
    first = hits.groupBy("case_id", "turn").agg(F.min_by(F.struct("weight", "category", "name"), "place").alias("h"))
    early = first.withColumn("rank", F.row_number().over(Window.partitionBy("case_id").orderBy("turn"))).filter(F.col("rank") <= limit)
    cited = early.join(turns.select("case_id", "turn", "text"), ["case_id", "turn"]).select("case_id", "rank", "turn", F.col("text").alias("quote"), F.col("h.weight").alias("score"), F.concat(F.col("h.category"), F.lit(" / "), F.col("h.name")).alias("reason"))
    last = turns.join(cited.select("case_id").distinct(), "case_id", "left_anti").groupBy("case_id").agg(F.max_by(F.struct("turn", "text"), "turn").alias("m"))
    return cited.unionByName(last.select("case_id", F.lit(1).alias("rank"), "m.turn", F.col("m.text").alias("quote"), F.lit(0.0).alias("score"), F.lit(LAST_MESSAGE).alias("reason")))


def gate_timeline(hits: DataFrame, turns: DataFrame) -> DataFrame:
    """(case_id, turn, risk): 1 for a turn with a hit, else 0."""
    hit = hits.select("case_id", "turn").distinct().withColumn("_hit", F.lit(1))
    return turns.select("case_id", "turn").join(hit, ["case_id", "turn"], "left").select("case_id", "turn", F.coalesce("_hit", F.lit(0)).alias("risk"))


def pinned(scored: DataFrame, asked: DataFrame) -> DataFrame:
    """Scored cards under the identity that was asked about (card_id, case_id, handle), whatever they say; none awaits the classifier."""
    return scored.drop("case_id", "handle", "awaiting").join(asked.select("card_id", "case_id", "handle"), "card_id").withColumn("awaiting", F.lit(False))


def queue(cards: DataFrame) -> DataFrame:
    """Cards of queued tiers, most urgent first; on ties live ones before seeded ones, then by id."""
    return cards.filter(F.col("tier").isin(*QUEUED)).orderBy(F.desc("queue_rank"), F.desc(tier_rank(F.col("tier"))), F.desc("is_live"), "case_id")


def queue_places(cards: DataFrame) -> DataFrame:
    """Each queued card's place among those of its tier, in the queue's order."""
    order = Window.partitionBy("tier").orderBy(F.desc("queue_rank"), F.desc("is_live"), "case_id")
    return cards.filter(F.col("tier").isin(*QUEUED)).withColumn("place", F.row_number().over(order))


def queue_stats(cards: DataFrame) -> DataFrame:
    return cards.agg(F.count("*").alias("total"), F.count_if(F.col("tier").isin(*QUEUED)).alias("queued"), F.count_if(F.col("tier") == "T4").alias("t4"), F.count_if("is_live").alias("live"), F.count_if("awaiting").alias("awaiting"))


def tier_counts(cards: DataFrame) -> DataFrame:
    """Cards of each tier, absent tiers with 0."""
    tiers = cards.sparkSession.createDataFrame([(f"T{i}",) for i in range(5)], "tier string")
    return tiers.join(cards.groupBy("tier").agg(F.count("*").alias("n")), "tier", "left").select("tier", F.coalesce("n", F.lit(0)).alias("n"))


def _chars(column: str) -> Column:
    """How much a person wrote: white space at both ends does not count, nothing is 0."""
    return F.length(trimmed(F.coalesce(F.col(column), F.lit(""))))


def disclosure(requests: DataFrame) -> DataFrame:
    """Whether each request (level, counsellor_id, reason, escalated) is allowed, why not, and the action to log."""
    size = _chars("reason")
    need = F.when(F.col("level") == "identity", REASON_CHARS["unsealed_pii"]).when(F.col("level") == "transcript", REASON_CHARS["viewed_transcript"]).otherwise(0)
    refusal = F.when(F.col("counsellor_id").isNull(), "no counsellor").when(size < need, "reason too short").when((F.col("level") == "identity") & ~F.col("escalated"), "not escalated")
    action = _lookup({"card": "viewed_card", "transcript": "viewed_transcript", "identity": "unsealed_pii"}, F.col("level"))
    return requests.withColumn("refusal", refusal).withColumn("allowed", F.col("refusal").isNull()).withColumn("action", F.when(F.col("refusal").isNull(), action))


def valid_access(entries: DataFrame) -> DataFrame:
    """Log entries whose action has the reason it needs; the trimmed reason is kept, blank ones are null."""
    reason = F.nullif(trimmed(F.col("reason")), F.lit(""))
    need = F.coalesce(F.create_map(*[F.lit(x) for kv in REASON_CHARS.items() for x in kv])[F.col("action")], F.lit(0))
    return entries.withColumn("reason", reason).filter((need == 0) | (F.length("reason") >= need))


def access_log(entries: DataFrame, case_id: str | None = None) -> DataFrame:
    """Entries in the order in which they happened: by time, then by sequence number."""
    return (entries.filter(F.col("case_id") == case_id) if case_id else entries).orderBy("at", "seq")


def newest_accesses(entries: DataFrame, most: int = 100) -> DataFrame:
    """The newest entries of each case, with their place from the newest."""
    last = Window.partitionBy("case_id").orderBy(F.desc("at"), F.desc("seq"))
    return entries.withColumn("place", F.row_number().over(last)).filter(F.col("place") <= most)


def latest(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The newest row of each key, by ``order`` descending; ``max_by`` combines before the shuffle."""
    row = F.struct(*[F.col(c) for c in rows.columns])
    return rows.groupBy(key).agg(F.max_by(row, F.struct(*order)).alias("_row")).select("_row.*")


def read_first(requests: DataFrame, log: DataFrame) -> DataFrame:
    """Requests by counsellors who have opened the case's transcript."""
    return requests.join(log.filter(F.col("action") == "viewed_transcript").select("case_id", "counsellor_id").distinct(), ["case_id", "counsellor_id"], "left_semi")


def decide_overrides(requests: DataFrame, log: DataFrame) -> DataFrame:
    """Requests (requested_tier, gate_floor, reason) with the effective tier, or the refusal."""
    read = log.filter(F.col("action") == "viewed_transcript").select("case_id", "counsellor_id").distinct().withColumn("_read", F.lit(True))
    out = requests.join(read, ["case_id", "counsellor_id"], "left")
    refusal = F.when(_chars("reason") < REASON_CHARS["overrode_tier"], "reason too short").when(F.col("_read").isNull(), "transcript not read")
    effective = tier_name(F.greatest(tier_rank(F.col("requested_tier")), tier_rank(F.col("gate_floor"))))
    out = out.withColumn("refusal", refusal).withColumn("effective_tier", F.when(F.col("refusal").isNull(), effective)).withColumn("floored", F.coalesce(F.col("effective_tier") != F.col("requested_tier"), F.lit(False)))
    # The notice's sentences.
    notice = F.concat(F.lit("Recorded as "), F.col("effective_tier"), F.lit(", not "), F.col("requested_tier"), F.lit(": the safety gate floors this conversation at "), F.col("gate_floor"), F.lit(". Your reason has been logged against it. To close it below the floor you have to break glass, which a lead will review."))
    return out.withColumn("floored_notice", F.when(F.col("floored"), notice)).drop("_read")


def decide_break_glass(requests: DataFrame, log: DataFrame) -> DataFrame:
    """Requests (gate_floor, closed_at_tier, reason) that go below a floor: allowed or refused, in the order of the rules."""
    read = log.filter(F.col("action") == "viewed_transcript").select("case_id", "counsellor_id").distinct().withColumn("_read", F.lit(True))
    out = requests.join(read, ["case_id", "counsellor_id"], "left")
    refusal = F.when(F.col("gate_floor").isNull(), "no floor").when(tier_rank(F.col("closed_at_tier")) >= tier_rank(F.col("gate_floor")), "not below floor").when(_chars("reason") < REASON_CHARS["broke_glass"], "reason too short").when(F.col("_read").isNull(), "transcript not read")
    return out.withColumn("refusal", refusal).withColumn("allowed", F.col("refusal").isNull()).drop("_read")


def review_break_glass(records: DataFrame, reviews: DataFrame) -> DataFrame:
    """Records with their first valid review: by a lead who is not the one that broke it, with a note; a reviewed record stays as it is."""
    ok = F.col("is_lead") & (_chars("note") >= REASON_CHARS["reviewed_break_glass"])
    joined = records.join(reviews.filter(ok).select("record_id", "reviewer_id", "note", F.col("at").alias("review_at")), "record_id", "left").filter(F.col("reviewer_id").isNull() | (F.col("reviewer_id") != F.col("counsellor_id")) | F.col("reviewed_at").isNotNull())
    first = joined.groupBy("record_id").agg(F.min_by(F.struct("reviewer_id", "note", "review_at"), F.struct("review_at", "reviewer_id")).alias("r"))
    out = records.join(first, "record_id", "left")
    return out.withColumn("reviewed_by", F.coalesce(F.col("reviewed_by"), F.when(F.col("reviewed_at").isNull(), F.col("r.reviewer_id")))).withColumn("reviewed_at", F.coalesce(F.col("reviewed_at"), F.col("r.review_at"))).drop("r")


def unreviewed(records: DataFrame) -> DataFrame:
    return records.filter(F.col("reviewed_at").isNull()).orderBy("at", "record_id")


def resolve_sessions(sessions: DataFrame, counsellors: DataFrame, now: Column) -> DataFrame:
    """Sessions that hold: not revoked, not expired (due exactly now is expired), of an active counsellor."""
    live = sessions.filter(F.col("revoked_at").isNull() & (F.col("expires_at") > now))
    return live.join(counsellors.filter("active"), "counsellor_id")


def retention_decisions(records: DataFrame, open_glass: DataFrame, now: Column) -> DataFrame:
    """Per record (case_id, tier, started_at, retention_expires_at, retention_hold_reason, content_deleted_at): exemption, due date, delete."""
    flagged = records.join(open_glass.select("case_id").distinct().withColumn("_open", F.lit(True)), "case_id", "left")
    due = F.coalesce(F.col("retention_expires_at"), retention_expiry(F.col("started_at"), F.col("tier")))
    exemption = F.when(F.col("content_deleted_at").isNotNull(), "already_deleted").when(F.coalesce(F.col("tier").isin(*ESCALATED), F.lit(False)), "escalated").when(F.coalesce(F.col("retention_hold_reason") != "", F.lit(False)), "explicit_hold").when(F.col("_open"), "unreviewed_break_glass").when(due.isNull(), "escalated")
    out = flagged.withColumn("due_at", due).withColumn("exemption", exemption)
    return out.withColumn("delete", F.col("exemption").isNull() & (F.col("due_at") <= now)).drop("_open")


def retention_sweep(decisions: DataFrame) -> DataFrame:
    """Counters of a sweep; content already gone is not an exemption to report."""
    count = lambda r: F.count_if(F.col("exemption") == r).alias(r)
    late = F.count_if(F.col("exemption").isNull() & ~F.coalesce(F.col("delete"), F.lit(False))).alias("not_yet_due")
    return decisions.agg(F.count("*").alias("examined"), F.count_if("delete").alias("to_delete"), late, count("escalated"), count("explicit_hold"), count("unreviewed_break_glass"))


def exemptions(decisions: DataFrame) -> DataFrame:
    """(case_id, exemption) of what a sweep leaves alone for a reason."""
    return decisions.filter(F.col("exemption").isNotNull() & (F.col("exemption") != "already_deleted")).select("case_id", "exemption")


def erase_records(records: DataFrame, decisions: DataFrame, now: Column) -> DataFrame:
    """Records after a sweep: those it deletes lose their card, which quotes the student, and are stamped; running it again changes nothing."""
    gone = decisions.filter("delete").select("case_id", F.lit(True).alias("_gone"))
    both = records.join(gone, "case_id", "left").withColumn("_gone", F.coalesce("_gone", F.lit(False)) & F.col("content_deleted_at").isNull())
    return both.withColumn("content_deleted_at", F.when(F.col("_gone"), now).otherwise(F.col("content_deleted_at"))).withColumn("card", F.when(~F.col("_gone"), F.col("card"))).drop("_gone")


def erase(children: DataFrame, decisions: DataFrame) -> DataFrame:
    """Children of the cases that a sweep deletes are gone; running it again changes nothing."""
    return children.join(decisions.filter("delete").select("case_id"), "case_id", "left_anti")


#: Fixed values. What a student reads; a tier is never named.
STATUS = {"T4": "Someone will get in touch with you as soon as possible.", "T3": "A counsellor will get in touch, usually within a day.", "T2": "A counsellor has your conversation and will read it."}
NO_STATUS = "Nobody has been asked to follow this up."
STATUS_DETAILS = {
    "T4": "A counsellor at your school has been told about this conversation and it is at the top of their list. If you need to talk to someone right now, the numbers below are free and open all day and night.",
    "T3": "Someone at your school has your conversation and will read it. You do not have to do anything else.",
    "T2": "It is in their list rather than at the top of it, so this might take a few days.",
}
NO_STATUS_DETAIL = "Nothing here looked like something a counsellor needed to act on. That is not a judgement about whether it matters to you. You can keep talking any time, and if things change, say so and it will be looked at again."
KEPT = "Because a counsellor is following this up, your conversation is kept as part of their record and is not deleted automatically. You can ask your school what happens to it."
NO_DATE = "This conversation does not have a deletion date set yet."
DATED = ("Your conversation is deleted on ", " days after it started. After that it is gone and nobody can read it, including us.")
ACCESS = {
    "viewed_card": "Opened the summary of your conversation.",
    "viewed_transcript": "Read the full conversation.",
    "unsealed_pii": "Looked up names or places you mentioned.",
    "overrode_tier": "Changed how urgent your case is marked.",
    "broke_glass": "Closed your case despite the safety check flagging it.",
    "reviewed_break_glass": "Reviewed another counsellor's decision to close your case.",
}


def student_status(tier: Column) -> Column:
    return F.coalesce(_lookup(STATUS, tier), F.lit(NO_STATUS))


def student_detail(tier: Column) -> Column:
    return F.coalesce(_lookup(STATUS_DETAILS, tier), F.lit(NO_STATUS_DETAIL))


def someone_will_read(tier: Column) -> Column:
    return F.coalesce(tier.isin(*QUEUED), F.lit(False))


def retention_copy(tier: Column, expires_at: Column) -> Column:
    """When a conversation is deleted, in the student's words."""
    dated = F.concat(F.lit(DATED[0]), F.date_format(expires_at, "d MMMM yyyy"), F.lit(f", {KEEP_DAYS}"), F.lit(DATED[1]))
    return F.when(expires_at.isNotNull(), dated).when(F.coalesce(tier.isin(*ESCALATED), F.lit(False)), F.lit(KEPT)).otherwise(F.lit(NO_DATE))


def describe_access(action: Column) -> Column:
    """An action in the student's words."""
    return _lookup(ACCESS, action)


def receipt(turns: DataFrame, log: DataFrame) -> DataFrame:
    """(case_id, part, place, what): what a case holds and who looked at it, as rows in order, since neither is bounded.

    ``turns`` (case_id, turn, people, places, text) are redacted here: a receipt never holds what a student wrote as it was. A turn's place is its
    number, an access's is its sequence number, and ``what`` is the sentence for its action.
    """
    from .privacy import redact

    redacted = redact(turns.select(F.struct("case_id", "turn").alias("id"), "text", "people", "places"))
    said = redacted.select("id.case_id", F.lit("turn").alias("part"), F.col("id.turn").cast("long").alias("place"), F.col("redacted").alias("what"))
    cases = turns.select("case_id").distinct()
    seen = log.join(cases, "case_id", "left_semi").select("case_id", F.lit("access").alias("part"), F.col("seq").cast("long").alias("place"), describe_access(F.col("action")).alias("what"))
    return said.unionByName(seen)
