"""Redaction of identifying spans, and sealing of what was redacted. Regexes run in Arrow batches; the rest is columns."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import trimmed

# Fixed values. (type, flags, group, pattern), in order of precedence
DETECTORS = (
    ("email", "", 0, r"\b[\w.+-]+@[\w-]+\.[\w.-]+\b"),
    ("url", "", 0, r"\bhttps?://\S+|\bwww\.[\w-]+\.\S+"),
    ("phone", "", 0, r"\b(?:\+\d{1,3}[\s-]?)?(?:\d[\s-]?){7,14}\d\b"),
    ("postcode", "i", 0, r"\b[A-Z]{1,2}\d[A-Z\d]?\s?\d[A-Z]{2}\b|\bSingapore\s?\d{6}\b"),
    ("handle", "", 1, r"(?:^|[\s(])@([A-Za-z0-9_.]{2,30})\b"),
    ("address", "i", 0, r"\b\d{1,4}[a-z]?\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\s+(?:road|rd|street|st|avenue|ave|lane|ln|close|court|crescent|drive|way|grove|terrace)\b"),
    ("school", "", 0, r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\s+(?:School|Academy|College|High|Primary|Secondary)\b"),
    ("name", "", 1, r"\b(?:called|named|nicknamed|his name is|her name is|their name is)\s+([A-Z]?[a-z]+)\b"),
    ("name", "", 1, r"\b([A-Z][a-z]{1,20})\s+(?:said|says|told|pushed|hit|kicked|punched|threatened|started|keeps|calls|called|took|threw|shoved|laughed|filmed)\b"),
    ("name", "", 1, r"\b(?:and|with|to|from|about|like|than)\s+([A-Z][a-z]{1,20})\b"),
    ("name", "", 1, r"\b(?:told|telling|tells|pushed|hit|kicked|punched|threatened|texted|messaged|called|followed|filmed|blocked|reported)\s+([A-Z][a-z]{1,20})\b"),
)
# Fixed values. Words that cues precede but that name no one.
NOT_A_NAME = (
    "mum mom mother dad father brother sister nan nana gran grandma grandad uncle aunt auntie cousin stepdad stepmum carer teacher miss sir friend mate bestfriend "
    "everyone everybody someone somebody nobody anyone people them him her they she he it one two school class year home work today tomorrow yesterday monday "
    "tuesday wednesday thursday friday saturday sunday"
).split()
LEAST_PHONE_DIGITS = 8
SPAN = "struct<rank:int,minus_size:int,a:int,b:int,type:string,value:string>"


def re2_form(rx: str, flags: str) -> str:
    """A detector for RE2, whose classes are ASCII's too, but for the vertical tab that its white space lacks: it finds whatever the detector finds."""
    wider = re.sub(r"\[[^\]]*\]|\\s", lambda m: m.group().replace(r"\s", r"\s\x0b") if m.group()[0] == "[" else r"[\s\x0b]", rx)
    return ("(?i)" if "i" in flags else "") + wider


_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(ord("A"), ord("Z") + 1)})
_WORD = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_")


class Names:
    """Known names as one trie with failure links: a text is read once, however many names there are. Letters match in either case, at word boundaries."""

    def __init__(self, names: set[str]):
        import ahocorasick

        self.trie = ahocorasick.Automaton()
        for name in names:
            self.trie.add_word(name.translate(_LOWER), len(name))
        if names:
            self.trie.make_automaton()

    def find(self, text: str, known: list[list[str]]) -> list[tuple[int, int, int]]:
        """(list, start, end) of the names of each list in a text: of one name the leftmost occurrences that do not overlap, names in the order of their lists."""
        wanted = [[v.translate(_LOWER) for v in values] for values in known]
        if not text or not any(wanted):
            return []
        own = {v for values in wanted for v in values}
        low, edge = text.translate(_LOWER), lambda i: (i > 0 and text[i - 1] in _WORD) != (i < len(text) and text[i] in _WORD)
        places: dict[str, list[tuple[int, int]]] = {}
        for last, size in self.trie.iter(low):
            start, end = last + 1 - size, last + 1
            name = low[start:end]
            if name in own and edge(start) and edge(end):
                met = places.setdefault(name, [])
                if not met or met[-1][1] <= start:
                    met.append((start, end))
        return [(i, a, b) for i, values in enumerate(wanted) for v in values for a, b in places.get(v, ())]


def raw_spans(rows: DataFrame) -> DataFrame:
    """``rows`` (id, text, people, places) with ``spans``: what each detector and each known name or place finds, before overlaps are resolved.

    Arrow batches only search: (rule, start, end), rules from 0 in the detectors' order, -1 for people and -2 for places. Which of that counts,
    its type and its strength are columns.
    """
    compiled = [(re.compile(rx, (re.I if "i" in flags else 0) | re.ASCII), group) for _, flags, group, rx in DETECTORS]
    likely = [re2_form(rx, flags) for _, flags, _, rx in DETECTORS]
    kind = pa.list_(pa.struct([("rule", pa.int32()), ("a", pa.int32()), ("b", pa.int32())]))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            texts, people, places = (batch.column(c).to_pylist() for c in ("text", "_people", "_places"))
            names = Names({v for rows in (people, places) for values in rows for v in values})
            # Each detector is asked for in one go over the batch; only texts that it is in are searched for its places.
            there = [np.asarray(pc.fill_null(pc.match_substring_regex(batch.column("text"), rx), False)) for rx in likely]
            for row, (text, *known) in enumerate(zip(texts, people, places, strict=True)):
                spans = [{"rule": -1 - i, "a": a, "b": b} for i, a, b in names.find(text or "", known)]
                spans += [{"rule": i, "a": m.start(group), "b": m.end(group)} for i, (rx, group) in enumerate(compiled) if there[i][row] for m in rx.finditer(text)]
                found.append(spans)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kind)], names=[*batch.schema.names, "_found"])

    names = lambda c: F.array_distinct(F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), trimmed), lambda v: F.length(v) >= 2))
    known = rows.withColumn("_people", names(F.col("people"))).withColumn("_places", names(F.col("places")))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in known.schema)
    searched = known.mapInArrow(search, f"{schema}, _found array<struct<rule:int,a:int,b:int>>")
    types, strength = [d[0] for d in DETECTORS], {}
    for i, t in enumerate(types):
        strength.setdefault(t, i)
    type_of = lambda s: F.when(s["rule"] == -1, "name").when(s["rule"] == -2, "place").otherwise(F.get(F.array(*map(F.lit, types)), s["rule"]))
    spans = F.transform("_found", lambda s: F.struct(s["a"].alias("a"), s["b"].alias("b"), type_of(s).alias("type"), F.substr("text", s["a"] + 1, s["b"] - s["a"]).alias("value")))
    low = lambda s: F.lower(s["value"])
    is_known = lambda s: F.exists(F.concat("_people", "_places"), lambda v: F.lower(v) == low(s))
    no_one = lambda s: (s["type"] == "name") & low(s).isin(*NOT_A_NAME) & ~is_known(s)
    too_short = lambda s: (s["type"] == "phone") & (F.length(F.regexp_replace(s["value"], "[^0-9]", "")) < LEAST_PHONE_DIGITS)
    counted = F.filter(spans, lambda s: (s["value"] != "") & ~no_one(s) & ~too_short(s))
    rank = lambda s: F.when(is_known(s), -1).otherwise(F.coalesce(F.create_map(*[F.lit(x) for kv in strength.items() for x in kv])[s["type"]], F.lit(-1)))
    graded = F.transform(counted, lambda s: F.struct(rank(s).alias("rank"), (s["a"] - s["b"]).alias("minus_size"), s["a"].alias("a"), s["b"].alias("b"), s["type"].alias("type"), s["value"].alias("value")))
    return searched.withColumn("spans", graded).drop("_found", "_people", "_places")


def resolve_spans(spans: Column) -> Column:
    """Kept spans by place: a stronger detector first, then longer, then earlier; what overlaps a kept one goes."""
    keep = lambda kept, s: F.when(F.exists(kept, lambda k: (s["a"] < k["b"]) & (k["a"] < s["b"])), kept).otherwise(F.concat(kept, F.array(s)))
    kept = F.aggregate(F.array_sort(spans), F.array().cast(f"array<{SPAN}>"), keep)
    by_place = F.array_sort(F.transform(kept, lambda s: F.struct(s["a"].alias("a"), s["b"].alias("b"), s["type"].alias("type"), s["value"].alias("value"))))
    return by_place


def placeholders(spans: Column) -> Column:
    """Spans with their placeholder: values of a type are numbered by first appearance once there is more than one."""
    of = lambda t: F.array_distinct(F.transform(F.filter(spans, lambda x: x["type"] == t), lambda x: F.lower(x["value"])))
    number = lambda s: F.when(F.size(of(s["type"])) > 1, F.concat(F.lit(" "), F.array_position(of(s["type"]), F.lower(s["value"])).cast("string"))).otherwise("")
    return F.transform(spans, lambda s: F.struct(s["a"].alias("a"), s["b"].alias("b"), s["type"].alias("type"), s["value"].alias("value"), F.concat(F.lit("["), s["type"], number(s), F.lit("]")).alias("placeholder")))


def redact(rows: DataFrame) -> DataFrame:
    """(id, text, people, places) to (id, redacted, spans); numbering is within each text. Null text: empty, no spans.

    Every occurrence of a value has one number, also where its second occurrence comes before the second value.
    """
    kept = raw_spans(rows).withColumn("kept", placeholders(resolve_spans(F.col("spans"))))
    text = F.coalesce("text", F.lit(""))
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    step = lambda acc, s: F.struct(F.concat(acc["out"], F.substr(text, acc["at"] + 1, s["a"] - acc["at"]), s["placeholder"]).alias("out"), s["b"].alias("at"))
    finish = lambda acc: F.concat(acc["out"], F.substr(text, acc["at"] + 1, F.length(text)))
    return kept.select("id", F.aggregate("kept", start, step, finish).alias("redacted"), F.col("kept").alias("spans"))


def span_counts(redacted: DataFrame) -> DataFrame:
    return redacted.select(F.explode("spans.type").alias("type")).groupBy("type").agg(F.count("*").alias("n"))


def assert_redacted(rows: DataFrame) -> DataFrame:
    """``rows`` (id, text, people, places) as they are; one whose text still holds something identifying fails the write it is on its way to."""
    return raw_spans(rows).withColumn("text", F.when(F.size("spans") > 0, F.raise_error(F.lit("text to be stored holds identifying spans")).cast("string")).otherwise(F.col("text"))).drop("spans")


def _url64(value: Column) -> Column:
    return F.translate(F.regexp_replace(F.base64(value), "[=\\s]", ""), "+/", "-_")


def _from_url64(value: Column) -> Column:
    return F.try_to_binary(F.rpad(F.translate(value, "-_", "+/"), F.ceil(F.length(value) / 4) * 4, F.lit("=")), F.lit("base64"))


def seal(value: Column, key: Column) -> Column:
    """AES-GCM with a fresh nonce, as ``v1.nonce.tag.body`` in URL-safe base 64: equal values are sealed differently. The key is a column, from a secret, never a literal."""
    whole = F.aes_encrypt(value, key, F.lit("GCM"))
    parts = lambda w: F.concat_ws(".", F.lit("v1"), _url64(F.substring(w, 1, 12)), _url64(F.substr(w, F.octet_length(w) - 15)), _url64(F.substr(w, F.lit(13), F.octet_length(w) - 28)))
    # One encryption, one nonce: the parts are cut from it once.
    return F.get(F.transform(F.array(whole), parts), F.lit(0))


def unseal(sealed: Column, key: Column) -> Column:
    """The value, or null if it was changed, is no such text, or the key is another."""
    parts = F.split(sealed, r"\.")
    part = lambda i: _from_url64(F.get(parts, F.lit(i)))
    whole = F.when((F.size(parts) == 4) & (F.get(parts, F.lit(0)) == "v1"), F.concat(part(1), part(3), part(2)))
    return F.try_aes_decrypt(whole, key, F.lit("GCM")).cast("string")


def unseal_requests(sealed: DataFrame, requests: DataFrame, key: Column) -> DataFrame:
    """Values for requests (case_id, counsellor_id, reason) with a counsellor and a reason of 20 characters, with the record to log."""
    ok = requests.filter(F.col("counsellor_id").isNotNull() & (F.length(trimmed(F.col("reason"))) >= 20))
    return sealed.join(ok, "case_id").select("case_id", "counsellor_id", "reason", unseal(F.col("ciphertext"), key).alias("value"), F.lit("unsealed_pii").alias("action"))
