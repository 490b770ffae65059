"""Scalar text functions as columns: no Python runs on the executors."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed_values import STOP_WORDS


def leet_normalize(text: Column) -> Column:
    """Lower case, with look-alike signs turned to letters one by one, so offsets hold."""
    return F.translate(F.lower(text), "!1|34@0$57", "iiieaaosst")


def haystacks(text: Column) -> Column:
    """The lower-cased text, and the normalised one if it differs."""
    return F.array_distinct(F.array(F.lower(text), leet_normalize(text)))


def clean_text(text: Column, limit: int = 1000) -> Column:
    """Addresses and mentions masked, line breaks and runs of blanks to one blank, trimmed, then cut."""
    masked = F.regexp_replace(F.regexp_replace(text, r"https?://\S+|www\.\S+", " [URL] "), r"@\w+", " [USER] ")
    flat = F.regexp_replace(F.regexp_replace(masked, r"\\n|\n", " "), r"\s+", " ")
    return F.substring(F.trim(flat), 1, limit)


def norm_text(text: Column) -> Column:
    """Lower case, blanks collapsed, then everything but ASCII letters, digits and blanks dropped."""
    return F.regexp_replace(F.regexp_replace(strip(F.lower(text)), r"\s+", " "), r"[^a-z0-9 ]", "")


def norm_key(text: Column) -> Column:
    return F.sha1(norm_text(text))


def word_tokens(text: Column) -> Column:
    """Words of letters and apostrophes longer than two, without stop words; repeats stay."""
    stops = F.array(*map(F.lit, STOP_WORDS))
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"([a-z']+)"), F.lit(1)), lambda w: (F.length(w) > 2) & ~F.array_contains(stops, w))


def char_ngrams(text: Column, n: int = 3) -> Column:
    """All character n-grams of the lower-cased text with blanks collapsed (not trimmed)."""
    # Characters are cut once and bound to a name: what a lambda reads from outside is made anew for each gram.
    cut = F.array(F.split(F.regexp_replace(F.lower(text), r"\s+", " "), ""))
    gram = lambda c, i: F.concat(*[F.get(c, i + k) for k in range(n)])
    grams = F.transform(cut, lambda c: F.when(F.size(c) >= n, F.transform(F.sequence(F.lit(0), F.size(c) - n), lambda i: gram(c, i))).otherwise(F.array().cast("array<string>")))
    return F.coalesce(F.get(grams, F.lit(0)), F.array().cast("array<string>"))


def _accents() -> tuple[str, str]:
    """Letters with marks of the Latin blocks and the letters without, by Unicode's own decompositions."""
    import unicodedata

    pairs = [(chr(c), unicodedata.normalize("NFKD", chr(c))[0]) for c in range(0xC0, 0x250)]
    pairs = [(a, b) for a, b in pairs if a != b and b.isascii() and b.isalpha()]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def strip_accents(text: Column) -> Column:
    return F.translate(text, *_accents())


def word_list(text: Column) -> Column:
    """Words of two letters, digits or underscores at least, lower-cased and without accents; repeats stay."""
    return F.regexp_extract_all(F.lower(strip_accents(text)), F.lit(r"(?U)(\w\w+)"), F.lit(1))


def word_runs(text: Column) -> Column:
    """What stands between blanks, lower-cased; repeats stay."""
    return F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")


def word_terms(text: Column) -> Column:
    """The words of ``word_list`` and their neighbouring pairs; repeats stay."""
    words = word_list(text)
    pairs = F.when(F.size(words) > 1, F.zip_with(F.slice(words, F.lit(1), F.size(words) - 1), F.slice(words, F.lit(2), F.size(words) - 1), lambda a, b: F.concat(a, F.lit(" "), b))).otherwise(F.array().cast("array<string>"))
    return F.concat(words, pairs)


def char_terms(text: Column, low: int = 3, high: int = 5) -> Column:
    """Character n-grams within words, each with a blank at both ends; a word no longer than n is one gram, once."""
    words = F.transform(word_runs(text), lambda w: F.concat(F.lit(" "), w, F.lit(" ")))
    grams = lambda w, n: F.when(F.length(w) >= n if n > low else F.lit(True), F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - n + 1, F.lit(1))), lambda i: F.substr(w, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    return F.flatten(F.transform(words, lambda w: F.concat(*[grams(w, n) for n in range(low, high + 1)])))


def entity_name(raw: Column) -> Column:
    """Lower case, one leading title dropped, marks dropped, blanks collapsed."""
    untitled = F.regexp_replace(strip(F.lower(raw)), r"^(mr|mrs|miss|ms|sir|dr)\.?\s+", "")
    return F.trim(F.regexp_replace(F.regexp_replace(untitled, r"[^\w\s]", ""), r"\s+", " "))


def hmac_sha256(key: bytes, message: Column) -> Column:
    """Hex HMAC-SHA256 from built-in digests; the key enters the plan only as its two padded forms."""
    import hashlib

    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (bytes(b ^ pad for b in block) for pad in (0x36, 0x5C))
    digest = F.unhex(F.sha2(F.concat(F.lit(bytearray(inner)), F.encode(message, "UTF-8")), 256))
    return F.sha2(F.concat(F.lit(bytearray(outer)), digest), 256)


def pseudonym(kind: str, raw: Column, key: bytes) -> Column:
    """Stable, keyed token of an entity: the kind's first letters and twelve hex digits."""
    return F.concat(F.lit(f"{kind[:3]}_"), F.substring(hmac_sha256(key, F.concat(F.lit(f"{kind}:"), entity_name(raw))), 1, 12))


def email_key(email: Column) -> Column:
    return F.lower(trimmed(email))


#: White space of any script. What people type is trimmed of all of it, and of the byte order mark; what a script has cleaned also of separators.
SPACES = "\t\n\x0b\x0c\r \xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def trimmed(text: Column) -> Column:
    """What a person typed, without white space of any kind at both ends."""
    return F.btrim(text, F.lit(SPACES + "\ufeff"))


def strip(text: Column) -> Column:
    """Without white space, separators and line breaks at both ends."""
    return F.btrim(text, F.lit(SPACES + "\x1c\x1d\x1e\x1f\x85"))


def widen_quote(span: Column, turn: Column, least: int = 15) -> Column:
    """The stripped span if it is long enough to carry evidence, else the stripped turn."""
    return F.when(F.length(strip(span)) >= least, strip(span)).otherwise(strip(turn))


def tier_rank(tier: Column) -> Column:
    return F.substring(tier, 2, 1).cast("int")


def tier_name(rank: Column) -> Column:
    return F.concat(F.lit("T"), rank.cast("string"))


def softmax(logits: Column, temperature: Column | float = 1.0) -> Column:
    """Softmax of an array at a temperature, shifted by its maximum."""
    top = F.array_max(logits)
    scale = temperature if isinstance(temperature, Column) else F.lit(float(temperature))
    powers = F.transform(logits, lambda x: F.exp((x - top) / scale))
    return F.transform(powers, lambda x: x / F.aggregate(powers, F.lit(0.0), lambda a, b: a + b))


def interpolate(x: Column, xs: list[float], ys: list[float]) -> Column:
    """Piecewise-linear through knots in ascending order, flat beyond them.

    Knots are one literal, and a value's place among them is found by halving: the plan has one size whatever their number.
    """
    knots, n = [float(v) for v in xs], len(xs)
    slopes = [(ys[i + 1] - ys[i]) / (xs[i + 1] - xs[i]) if i + 1 < n and xs[i + 1] > xs[i] else 0.0 for i in range(n)]
    row = F.from_json(F.lit(json.dumps([{"x": k, "y": float(y), "s": s} for k, y, s in zip(knots, ys, slopes, strict=True)])), "array<struct<x:double,y:double,s:double>>")
    steps = F.array(*[F.lit(1 << i) for i in range(n.bit_length() - 1, -1, -1)])
    further = lambda at, step: F.when((at + step <= n) & (F.get(row, at + step - 1)["x"] <= x), at + step).otherwise(at)
    inside = F.transform(F.array(F.greatest(F.aggregate(steps, F.lit(0), further), F.lit(1)) - 1), lambda i: F.get(row, i)["y"] + (x - F.get(row, i)["x"]) * F.get(row, i)["s"])
    return F.when(x.isNull(), F.lit(None).cast("double")).when(x <= knots[0], F.lit(float(ys[0]))).when(x >= knots[-1], F.lit(float(ys[-1]))).otherwise(F.get(inside, F.lit(0)))
