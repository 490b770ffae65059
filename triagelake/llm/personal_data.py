"""Personal data: weak supervision over regex, gazetteer and context labelers, expectation-maximisation and a final span classifier.

1. Whole texts are searched for base spans (fixed rules, always kept) and for wider candidates: local phone numbers, spelled-out
   mail addresses, IPv6, account numbers, secrets, identity numbers and names.
2. Every span gets the votes of ``LABELERS`` (+1, -1 or no vote) and a coarse shape; both make its *pattern*. Patterns are counted over
   all documents; there are only so many of them, whatever the data's size, so the counts may go to the driver.
3. Expectation-maximisation over the pattern counts estimates each labeler's reliability and each kind's share of true spans.
4. The posteriors train a logistic span classifier over votes, kind and shape. Candidates it gives ``ACCEPT`` or more join the base.

Cases: null text is the empty text (no spans; the digest of the empty list). Overlapping base spans of different kinds are all kept;
a candidate overlapping an earlier, longer candidate
goes, and so does one overlapping a base span, unless it is a secret of which base spans cover less than half. An empty table trains nothing and returns no rows.
Repeated rows are counted as often as they occur. Only the id and text columns are read.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import STAGE_BYTES, checkpointed, filled, slices

ACCEPT = 0.5
#: Fixed order of kinds: the base's, then the method's own.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "name", "secret", "ssn")

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_GIVEN = (
    "James Mary Robert Patricia John Jennifer Michael Linda David Elizabeth William Barbara Richard Susan Joseph Jessica Thomas Sarah "
    "Charles Karen Daniel Nancy Matthew Lisa Anthony Betty Mark Margaret Paul Sandra Steven Ashley Andrew Kimberly Kenneth Emily George "
    "Donna Pierre Marie Jean Claire Julien Camille Antoine Sophie Hans Greta Klaus Heike Stefan Anja Jürgen Sabine José María Carlos "
    "Carmen Luis Ana Javier Lucía Ahmed Fatima Mohammed Aisha Wei Li Hiroshi Yuki Priya Raj Olga Ivan"
).split()  # fixed list of common given names
_WIDE = {
    "email": re.compile(r"(?<![\w.])[A-Za-z0-9._%+-]{2,64} ?[\[(](?:at|@)[\])] ?[A-Za-z0-9-]{1,63}(?: ?(?:[\[(](?:dot|\.)[\])]|\.) ?[A-Za-z0-9-]{1,63}){1,4}", re.I),
    "ip": re.compile(r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){3,7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])"),
    "iban": re.compile(r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b"),
    "name": re.compile(r"\b(?:(?:Mr|Mrs|Ms|Dr|Prof)\.? [A-Z][\w'-]{1,30}|(?:" + "|".join(_GIVEN) + r") [A-Z][\w'-]{1,30})(?: [A-Z][\w'-]{1,30})?\b"),
    "phone": re.compile(r"(?<![0-9+.])(?:\([0-9]{2,4}\) ?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9])"),
    "secret": re.compile(r"\bAKIA[0-9A-Z]{16}\b|\b(?:password|passwd|pwd|token|secret|api[_-]?key|access[_-]?key)\"? ?[=:] ?[\"']?[^\s\"']{6,}[\"']?|\bgh[pousr]_[A-Za-z0-9]{36}\b", re.I),
    "ssn": re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
}
_JWT = re.compile(r"\beyJ", re.I)
_SEGMENT = re.compile(r"[\w-]*")
_PEM = re.compile(r"-----(BEGIN|END) [A-Z ]{0,20}PRIVATE KEY-----", re.I)
#: What may follow the head of a key that never ends: lines of base 64.
_PEM_LINES = re.compile(r"(?:(?:\s|\\[nr])+[A-Za-z0-9+/]{16,}={0,2})*")
#: A text without any of these has no span.
TRIGGERS = r"[0-9@]|(?i:\(at\)|\[at\]|password|passwd|pwd|token|secret|api.?key|access.?key|private key|eyJ)|:[0-9A-Fa-f]+:|\b(Mr|Mrs|Ms|Dr|Prof)\.? [A-Z]|(" + "|".join(_GIVEN) + r") [A-Z]"
_TOP = frozenset("com org net edu gov io dev fr de es uk eu it nl ch at info example".split())
_DIAL = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
_NEAR = {
    "email": re.compile(r"mail|contact|write|courriel|correo|kontakt", re.I),
    "ip": re.compile(r"\bip\b|address|host|server|adresse|dirección", re.I),
    "card": re.compile(r"card|visa|master|credit|carte|tarjeta|karte", re.I),
    "phone": re.compile(r"phone|\btel|call|fax|mobile|téléphone|teléfono|telefon", re.I),
    "iban": re.compile(r"iban|account|bank|konto|compte|cuenta", re.I),
    "name": re.compile(r"\bname|signed|dear|by\b|author|contact|nom\b|nombre", re.I),
    "secret": re.compile(r"key|secret|auth|login|credential|aws|user", re.I),
    "ssn": re.compile(r"ssn|social|security|identity", re.I),
}
_AGAINST = re.compile(r"version|release|isbn|issn|\bdoi\b|page|figure|table|order|section|chapter|\bpp?\.|§", re.I)


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost, non-overlapping; linear, as each @ is met once with the run of local characters before it."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            end = m.end()
            at = text.find("@", end)
        else:
            end = max(end, at)
            at = text.find("@", at + 1)


def _luhn(digits: str) -> bool:
    values = [int(d) for d in reversed(digits)]
    return (sum(values[::2]) + sum(x * 2 - 9 * (x > 4) for x in values[1::2])) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place, end) by the fixed rules, in code points."""
    spans = []
    if "@" in text:
        spans += [(a, 0, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(part.lstrip("0")) < 4 and int(part.lstrip("0") or 0) <= 255 for part in m.group().split(".")):
            spans.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and _luhn(digits):
            spans.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
                spans.append((m.start(), 3, m.end()))
    return sorted(spans)


def _jwts(text: str) -> Iterator[tuple[int, int]]:
    """Three segments of 10 characters or more; linear, as what fails is passed over up to the end of its first segment."""
    at = 0
    while m := _JWT.search(text, at):
        parts = [_SEGMENT.match(text, m.end())]
        while len(parts) < 3 and len(parts[-1].group()) >= 10 and text[parts[-1].end() : parts[-1].end() + 1] == ".":
            parts.append(_SEGMENT.match(text, parts[-1].end() + 1))
        if len(parts) == 3 and len(parts[-1].group()) >= 10:
            yield m.start(), parts[-1].end()
            at = parts[-1].end()
        else:
            at = parts[0].end()


def _pem_keys(text: str) -> Iterator[tuple[int, int]]:
    """Private keys from the BEGIN line to the END line; without one before the next BEGIN, to the last line of base 64."""
    marks = list(_PEM.finditer(text))
    for m, after in zip(marks, [*marks[1:], None], strict=False):
        if m.group(1).upper() == "BEGIN":
            yield m.start(), after.end() if after and after.group(1).upper() == "END" else _PEM_LINES.match(text, m.end()).end()


def _secrets(text: str) -> Iterator[tuple[int, int]]:
    """Secrets of all forms; those that overlap are one."""
    start = end = -1
    for a, b in sorted([*(m.span() for m in _WIDE["secret"].finditer(text)), *_jwts(text), *_pem_keys(text)]):
        if a < end:
            end = max(end, b)
            continue
        if end >= 0:
            yield start, end
        start, end = a, b
    if end >= 0:
        yield start, end


def candidates(text: str) -> list[tuple[int, int, int, bool]]:
    """(start, kind's place, end, whether base): base spans and the wider candidates that overlap nothing stronger."""
    base = base_spans(text)
    secret = KINDS.index("secret")
    wide = sorted([*((m.start(), -m.end(), KINDS.index(kind)) for kind, pattern in _WIDE.items() if kind != "secret" for m in pattern.finditer(text)), *((a, -b, secret) for a, b in _secrets(text))])
    taken = [(a, b) for a, _, b in base]
    merged: list[list[int]] = []
    for a, b in sorted(taken):
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(b, merged[-1][1])
        else:
            merged.append([a, b])
    out, at, end = [(a, k, b, True) for a, k, b in base], 0, 0
    for a, minus, k in wide:
        while at < len(merged) and merged[at][1] <= a:
            at += 1
        if a < end:
            continue
        covered, there = 0, at
        while there < len(merged) and merged[there][0] < -minus:
            covered += min(merged[there][1], -minus) - max(merged[there][0], a)
            there += 1
        if not covered or k == secret and 2 * covered < -minus - a:
            out.append((a, k, -minus, False))
            end = -minus
    return sorted(out)


def votes(text: str, start: int, kind: str, end: int) -> tuple[int, ...]:
    """Each labeler's vote on a span: strict form, checksum or structure, gazetteer, words before it, words against it, filler digits."""
    span, before = text[start:end], text[max(0, start - 40) : start]
    digits = "".join(c for c in span if "0" <= c <= "9")
    strict = {
        "email": lambda: bool(re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9._%+-]*@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}", span)),
        "ip": lambda: span.count(".") == 3 or span.count(":") == 7,
        "card": lambda: span[:1] in "3456" and len(digits) in (13, 14, 15, 16, 19),
        "phone": lambda: span.startswith(("+", "(")) or span.count("-") == 2,
        "iban": lambda: 15 <= len(span.replace(" ", "")) <= 34,
        "name": lambda: span[0].isupper(),
        "secret": lambda: bool(re.search(r"AKIA|BEGIN|gh[pousr]_|eyJ|[=:]", span)),
        "ssn": lambda: span[:3] not in ("000", "666") and span[:1] != "9",
    }[kind]()
    if kind == "card":
        sound = 1 if _luhn(digits) else -1
    elif kind == "iban":
        packed = span.replace(" ", "")
        sound = 1 if int("".join(str(int(c, 36)) for c in packed[4:] + packed[:4])) % 97 == 1 else -1
    elif kind == "ip":
        try:
            sound = 1 if ipaddress.ip_address(span) else -1
        except ValueError:
            sound = -1
    elif kind == "secret":
        body = re.split(r"[=:]", span, maxsplit=1)[-1].strip(" \"'")
        sound = 1 if re.search("[0-9]", body) and len(set(body)) >= 6 else -1
    elif kind == "phone":
        sound = 1 if 9 <= len(digits) <= 15 else -1
    else:
        sound = 0
    listed = 0
    if kind == "email":
        listed = 1 if re.split(r"[.\s)\]]", span.rstrip(")]"))[-1].lower() in _TOP else -1
    elif kind == "phone" and span.startswith("+"):
        listed = 1 if any(digits[:n] in _DIAL for n in (1, 2)) else -1
    elif kind == "name":
        listed = 1 if span.split()[0] in _GIVEN else 0
    filler = -1 if digits and (len(set(digits)) == 1 or digits in "01234567890123456789") else 0
    return 1 if strict else -1, sound, listed, 1 if _NEAR[kind].search(before) else 0, -1 if _AGAINST.search(before) else 0, filler


LABELERS = ("form", "sound", "listed", "near", "against", "filler")


def pattern_of(text: str, start: int, kind: str, end: int) -> str:
    """kind, votes and a coarse shape (length class, alone between blanks or not)."""
    size = min(5, (end - start).bit_length())
    alone = (start == 0 or text[start - 1].isspace()) and (end == len(text) or not text[end].isalnum())
    return f"{kind}|{','.join(map(str, votes(text, start, kind, end)))}|{size}|{int(alone)}"


def fit(counts: dict[str, int], rounds: int = 50, seed: int = 0) -> dict[str, float]:
    """From how often each pattern occurs: the classifier's probability that a span of this pattern is personal data."""
    if not counts:
        return {}
    names = sorted(counts)
    weight = np.array([counts[n] for n in names], dtype=np.float64)
    parts = [n.split("|") for n in names]
    vote = np.array([[int(v) for v in p[1].split(",")] for p in parts])
    kind = np.array([KINDS.index(p[0]) for p in parts])
    right = np.full(vote.shape[1], 0.8)  # P(a vote is right), by labeler
    share = np.full(len(KINDS), 0.7)  # P(a span is true), by kind
    for _ in range(rounds):
        odds = np.log(share[kind] / (1 - share[kind])) + (vote * np.log(right / (1 - right))).sum(axis=1)
        true = 1 / (1 + np.exp(-odds))
        agree = np.where(vote > 0, true[:, None], 1 - true[:, None]) * (vote != 0) * weight[:, None]
        # Beta priors keep a labeler that votes little, or always with the others, near its start.
        right = np.clip((agree.sum(axis=0) + 8) / (((vote != 0) * weight[:, None]).sum(axis=0) + 10), 0.55, 0.99)
        share = np.clip((np.bincount(kind, weight * true, len(KINDS)) + 7) / (np.bincount(kind, weight, len(KINDS)) + 10), 0.05, 0.95)
    x = np.zeros((len(names), 3 * vote.shape[1] + len(KINDS) + 6 + 2))
    rows = np.arange(len(names))
    for j in range(vote.shape[1]):
        x[rows, 3 * j + vote[:, j] + 1] = 1
    x[rows, 3 * vote.shape[1] + kind] = 1
    x[rows, 3 * vote.shape[1] + len(KINDS) + np.array([int(p[2]) for p in parts])] = 1
    x[rows, 3 * vote.shape[1] + len(KINDS) + 6 + np.array([int(p[3]) for p in parts])] = 1
    theta = np.zeros(x.shape[1])
    balance = np.sqrt(weight) / np.sqrt(weight).sum()
    for step in range(600):
        chance = 1 / (1 + np.exp(-x @ theta))
        theta -= 4.0 * (x.T @ (balance * (chance - true)) + 1e-4 * theta)
    chance = 1 / (1 + np.exp(-x @ theta))
    return {n: float(c) for n, c in zip(names, chance, strict=True)}


SPAN = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("pattern", pa.string())])


def _found(texts: pa.Array) -> Iterator[tuple[int, str, list[dict]]]:
    """Index, text and spans of the texts that have any."""
    for i in np.flatnonzero(np.asarray(pc.match_substring_regex(texts, TRIGGERS))).tolist():
        text = texts[i].as_py()
        spans = [{"start": a, "kind": k, "end": b, "base": base, "pattern": pattern_of(text, a, KINDS[k], b)} for a, k, b, base in candidates(text)]
        if spans:
            yield i, text, spans


def digest(spans: list[dict]) -> str:
    return hashlib.sha256(",".join(f"{KINDS[s['kind']]}:{s['start']}:{s['end']}" for s in sorted(spans, key=lambda s: (s["start"], s["kind"])) if s["base"]).encode()).hexdigest()


def extract_spans(docs: DataFrame) -> DataFrame:
    """doc_id, the digest of the base spans, and all spans with their patterns."""
    empty = digest([])

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, limit=STAGE_BYTES):
                spans: list[list[dict]] = [[] for _ in range(part.num_rows)]
                digests = [empty] * part.num_rows
                for i, _, found in _found(filled(part.column("text"))):
                    spans[i], digests[i] = found, digest(found)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(digests, pa.string()), pa.array(spans, pa.list_(SPAN))], names=["doc_id", "base_sha256", "found"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(extract, "doc_id long, base_sha256 string, found array<struct<start:int,kind:int,end:int,base:boolean,pattern:string>>")


def fit_patterns(found: DataFrame) -> dict[str, float]:
    """Pattern counts of all spans (bounded by votes x kinds x shapes, so collected) to the classifier's probabilities."""
    counts = found.select(F.explode("found.pattern").alias("pattern")).groupBy("pattern").agg(F.count("*").alias("n"))
    return fit({r["pattern"]: r["n"] for r in counts.collect()})


def find_personal_data(docs: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """One row for each document: base counts and digest, all spans as text, and the added spans' number."""
    found = checkpointed(extract_spans(docs))
    accepted = sorted(p for p, chance in fit_patterns(found).items() if chance >= accept)
    names = F.array(*map(F.lit, KINDS))
    taken = F.array(*map(F.lit, accepted)) if accepted else F.array().cast("array<string>")
    kept = F.filter("found", lambda s: s["base"] | F.array_contains(taken, s["pattern"]))
    ordered = F.transform(F.array_sort(F.transform(F.col("kept"), lambda s: F.struct(s["start"].alias("a"), s["kind"].alias("k"), s["end"].alias("b")))), lambda s: F.concat_ws(":", F.element_at(names, s["k"] + 1), s["a"].cast("string"), s["b"].cast("string")))
    count = lambda k: F.size(F.filter("found", lambda s: s["base"] & (s["kind"] == k))).cast("long").alias(f"n_{BASE_KINDS[k]}")
    return found.withColumn("kept", kept).select("doc_id", *map(count, range(4)), "base_sha256", F.array_join(ordered, ",").alias("spans"), (F.size("kept") - F.size(F.filter("found", lambda s: s["base"]))).cast("long").alias("n_added"))


def redact(docs: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """``docs`` with every accepted span of ``text`` replaced by its kind in brackets and ``n_chars`` counted anew; a null text stays null."""
    chances = fit_patterns(extract_spans(docs))
    accepted = frozenset(p for p, chance in chances.items() if chance >= accept)

    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, limit=STAGE_BYTES):
                place = part.schema.get_field_index("text")
                changed = filled(part.column(place))
                new = {}
                for i, text, spans in _found(changed):
                    out, end = [], 0
                    for s in sorted((s for s in spans if s["base"] or s["pattern"] in accepted), key=lambda s: (s["start"], -s["end"], s["kind"])):
                        if s["start"] >= end:
                            out += [text[end : s["start"]], f"[{KINDS[s['kind']].upper()}]"]
                        end = max(end, s["end"])
                    if out:
                        new[i] = "".join(out) + text[end:]
                if new:
                    where = np.zeros(part.num_rows, dtype=bool)
                    where[list(new)] = True
                    texts = pc.replace_with_mask(part.column(place).cast(pa.string()), pa.array(where), pa.array([new[i] for i in sorted(new)], pa.string()))
                    part = part.set_column(place, part.schema.field(place), texts)
                yield part

    return docs.mapInArrow(replace, docs.schema).withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(*docs.columns)
