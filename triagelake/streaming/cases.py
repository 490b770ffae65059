"""One state for each case: what its turns said, how far its client had got, and whether crisis numbers were ever shown.

Messages are whole histories (``first`` 0) or deltas (turns from place ``first`` on), numbered by ``seq``; they may come late, twice and in any order. A place
keeps what the message with the highest number says there, and the highest number of all says where the conversation ends. So the state
after some messages does not depend on their order, an older resend can only fill places that nothing newer has told, and never lowers a verdict. What is kept of
a turn is its hits, not its text. The verdict is that of the gate over the union of the hits, worked out once; a case whose places are not all told yet has
``complete`` false. The flag for crisis numbers latches.

Timers: a case that has been quiet for ``keep_days`` of event time and has no floor that holds it (``HELD``) is closed: one last row, and its state goes.
The hits come from the gate's own expressions in front of the state, so the state's function sees numbers only.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.fixed_values import PATTERNS, SUPPRESSORS
from ..functions.text import leet_normalize
from ..operators import gate
from ..sources.tables import checkpointed

KEEP_DAYS, HELD = 30, (3, 4)
LATE = "1 hour"
OUT = "case_id string, seq long, n_turns long, complete boolean, score double, level string, floor string, ceiling string, n_hits long, crisis boolean, closed boolean"


def event_hits(events: DataFrame, patterns: Sequence = PATTERNS, suppressors: Sequence = SUPPRESSORS, late: str = LATE) -> DataFrame:
    """(case_id, seq, end, at, place, hits) for each turn of each message; one row without a place for a message without turns."""
    known = events.filter(F.col("case_id").isNotNull() & F.col("seq").isNotNull()).withWatermark("at", late)
    start = F.coalesce("first", F.lit(0)).cast("long")
    each = known.select("case_id", "seq", "at", start.alias("start"), (start + F.greatest(F.size("turns"), F.lit(0))).alias("end"), F.posexplode_outer("turns").alias("i", "text"))
    prepared = each.select("case_id", "seq", "at", "end", (F.col("start") + F.col("i")).alias("place"), "text", F.lower("text").alias("low"), leet_normalize(F.col("text")).alias("norm"))
    found = gate.raw_matches(prepared, patterns, suppressors)
    hits = gate.resolve_overlaps(gate.suppress(F.col("found"), F.col("cancelled")))
    return found.select("case_id", "seq", "end", "at", "place", F.to_json(F.transform(hits, lambda h: F.struct(h["category"].alias("c"), h["severity"].alias("s")))).alias("hits"))


def judge(hits: Sequence[tuple[str, str]]) -> dict:
    """The gate's verdict from (category, severity) of all hits."""
    real = [c for c, _ in hits if c not in gate.MODIFIERS]
    if not real:
        return {"score": 0.0, "level": "clear", "floor": None, "ceiling": f"T{gate.CEILING}", "n_hits": 0, "crisis": False}
    clear = 1.0
    for category in gate.CATEGORIES:
        weights = [gate.WEIGHTS[s] for c, s in hits if c == category]
        clear *= 1 - max(weights, default=0.0)
    marked = len(real) < len(hits)

    def floor_of(severity: str) -> int | None:
        top = max((gate.CATEGORIES[c] for c, s in hits if s == severity and gate.CATEGORIES[c] is not None), default=None)
        return 4 if marked and top == 3 else top

    hard, soft = floor_of("strong"), floor_of("moderate")
    floor = max([x for x in (hard, None if soft is None else soft - 1) if x is not None], default=None)
    score = 1 - clear
    level = "high" if score >= gate.HIGH else "grey" if score >= gate.GREY else "clear"
    return {"score": score, "level": level, "floor": None if floor is None else f"T{floor}", "ceiling": None if floor == 4 else f"T{gate.CEILING}", "n_hits": len(hits), "crisis": floor == 4}


class CaseState(StatefulProcessor):
    """Places and facts of one case; see the module."""

    def __init__(self, keep_days: float = KEEP_DAYS):
        self.keep = int(keep_days * 86_400_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.places = handle.getMapState("places", "place long", "seq long, hits string")
        self.facts = handle.getValueState("facts", "seq long, end_ long, crisis boolean, at_ms long")

    def _row(self, key: tuple, closed: bool = False) -> tuple[dict, dict]:
        seq, end, crisis, _ = self.facts.get()
        told = {k[0]: v[1] for k, v in self.places.iterator() if k[0] < end}
        verdict = judge([(h["c"], h["s"]) for place in sorted(told) for h in json.loads(told[place])])
        row = {"case_id": key[0], "seq": seq, "n_turns": end, "complete": len(told) == end, **verdict, "closed": closed}
        return row | {"crisis": crisis or verdict["crisis"]}, verdict

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        seq, end, crisis, at = self.facts.get() if self.facts.exists() else (-(1 << 62), 0, False, 0)
        by_message: dict[int, list] = {}
        for frame in rows:
            for s, e, t, place, hits in zip(frame["seq"], frame["end"], frame["at"], frame["place"], frame["hits"], strict=True):
                at = max(at, 0 if pd.isna(t) else int(t.timestamp() * 1000))
                if s >= seq:
                    seq, end = int(s), int(e)
                if pd.isna(place):
                    continue
                found = json.loads(hits or "[]")
                by_message.setdefault(int(s), []).extend((h["c"], h["s"]) for h in found)
                place = (int(place),)
                if not self.places.containsKey(place) or self.places.getValue(place)[0] <= s:
                    self.places.updateValue(place, (int(s), json.dumps(found)))
        for place in [k for k in self.places.keys() if k[0] >= end]:
            self.places.removeKey(place)
        # Numbers were shown for what a message said by itself too, even if a newer one came in the same batch.
        crisis = bool(crisis) or any(judge(h)["crisis"] for h in by_message.values())
        self.facts.update((seq, end, crisis, at))
        row, verdict = self._row(key)
        self.facts.update((seq, end, row["crisis"], at))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if verdict["floor"] not in [f"T{t}" for t in HELD]:
            self.handle.registerTimer(at + self.keep)
        yield pd.DataFrame([row])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        row, _ = self._row(key, closed=True)
        self.places.clear()
        self.facts.clear()
        yield pd.DataFrame([row])

    def close(self) -> None:
        pass


def case_states(events: DataFrame, patterns: Sequence = PATTERNS, suppressors: Sequence = SUPPRESSORS, keep_days: float = KEEP_DAYS, late: str = LATE) -> DataFrame:
    """A stream of the cases that a batch of messages (case_id, seq, first, turns, at) changes, each with its verdict."""
    hits = event_hits(events, patterns, suppressors, late)
    return hits.groupBy("case_id").transformWithStateInPandas(statefulProcessor=CaseState(keep_days), outputStructType=OUT, outputMode="Update", timeMode="EventTime")


def folded(events: DataFrame, patterns: Sequence = PATTERNS, suppressors: Sequence = SUPPRESSORS) -> DataFrame:
    """The same over a table of messages, without state: each place as the highest number that tells it says, up to the end that the highest of all says."""
    # Texts are searched once, all that follows is worked out from what was found.
    hits = checkpointed(event_hits(events, patterns, suppressors))
    last = hits.groupBy("case_id").agg(F.max("seq").alias("seq"), F.max_by("end", "seq").alias("end"))
    told = hits.filter("place IS NOT NULL").groupBy("case_id", "place").agg(F.max_by("hits", "seq").alias("hits")).join(last, "case_id").filter("place < end")
    pairs = told.select("case_id", F.explode(F.from_json("hits", "array<struct<c:string,s:string>>")).alias("h")).select("case_id", F.col("h.c").alias("category"), F.col("h.s").alias("severity"))
    weights = F.create_map(*[x for s, w in gate.WEIGHTS.items() for x in (F.lit(s), F.lit(w))])
    verdicts = gate.verdicts(pairs.withColumn("weight", weights[F.col("severity")]), last, ["case_id"])
    counted = last.join(told.groupBy("case_id").agg(F.count("*").alias("told")), "case_id", "left")
    return counted.join(verdicts, "case_id").select("case_id", "seq", F.col("end").alias("n_turns"), (F.coalesce("told", F.lit(0)) == F.col("end")).alias("complete"), "score", "level", "floor", "ceiling", "n_hits")
