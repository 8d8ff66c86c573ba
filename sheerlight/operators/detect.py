"""Detectors: each takes a text column and gives an array of findings, in the order in which they are reported.

A finding is a struct of ``FIELDS``; what a type doesn't use is null.  Null texts have no findings.  Each detector looks for
its signal with one pattern first, and only rows that have it pay for more.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import values as V
from ..functions.normalise import DROPPED_CLASS, NEAR_ODD, REMOVED_CLASS, beyond_ascii, deobfuscate, strip_invisible
from ..functions.text import any_of, bound, class_of, cut, in_units, java, keyword, located, readable, units, with_raw_offsets

FIELDS = {
    "type": "string", "severity": "string", "index": "int", "code_point": "int", "hex": "string", "name": "string", "sample": "string", "decoded": "string",
    "likely_jwt": "boolean", "match": "string", "pattern": "string", "length": "int", "count": "int", "normalized": "boolean",
}
SCHEMA = "array<struct<" + ",".join(f"{k}:{v}" for k, v in FIELDS.items()) + ">>"


_NULLS: dict[object, dict[str, Column]] = {}


def finding(**parts: Column) -> Column:
    """A struct of all fields; null columns are made once a context, as each costs several calls to the JVM."""
    sc = SparkContext._active_spark_context
    if sc not in _NULLS:
        _NULLS.clear()
        _NULLS[sc] = {k: F.lit(None).cast(v).alias(k) for k, v in FIELDS.items()}
    return F.struct(*[parts[k].cast(v).alias(k) if k in parts else _NULLS[sc][k] for k, v in FIELDS.items()])


def none() -> Column:
    return F.array().cast(SCHEMA)


def when_seen(text: Column, pattern: str, found: Column) -> Column:
    return F.when(text.rlike(pattern), found).otherwise(none())


# ------------------------------------------------------------------------------------------------ characters

_INVISIBLE_CLASS = class_of(sorted(V.INVISIBLE))


def _mapping(pairs: dict[int, str]) -> Column:
    return F.create_map(*[F.lit(x) for k, v in pairs.items() for x in (chr(k), v)])


def invisible(text: Column) -> Column:
    """A finding for each invisible character and each tag character; the first of the tags carries the message they spell."""
    names, levels = _mapping({k: v[0] for k, v in V.INVISIBLE.items()}), _mapping({k: v[1] for k, v in V.INVISIBLE.items()})
    spoken = "".join(chr(0xE0000 + i) for i in range(0x20, 0x7F))
    tags = F.array_join(F.regexp_extract_all(text, F.lit(r"[\x{e0020}-\x{e007e}]+"), F.lit(0)), "")
    message = F.when(tags != "", F.translate(tags, spoken, "".join(chr(i) for i in range(0x20, 0x7F))))
    hits = located(text, f"(?=[^\\x00-\\x7f]){REMOVED_CLASS}")
    is_tag = lambda h: h["hit"] >= chr(0xE0000)

    def one(h: Column, first_tag: Column) -> Column:
        tag = is_tag(h)
        point = F.ascii(h["hit"])
        raw = F.hex(point.cast("long"))
        return finding(
            type=F.when(tag, "unicode-tag").otherwise("invisible"),
            severity=F.when(tag, "high").otherwise(F.element_at(levels, h["hit"])),
            index=h["at"],
            code_point=point,
            hex=F.concat(F.lit("U+"), F.when(F.length(raw) < 4, F.lpad(raw, 4, "0")).otherwise(raw)),
            name=F.when(tag, V.TAG_NAME).otherwise(F.element_at(names, h["hit"])),
            decoded=F.when(tag & (h["at"] == first_tag), message),
        )

    with_first = lambda hs: bound(F.get(F.filter(hs, is_tag), F.lit(0))["at"], lambda first: F.transform(hs, lambda h: one(h, first)))
    return F.when(beyond_ascii(text) & text.rlike(NEAR_ODD), bound(hits, with_first)).otherwise(none())


def _payload(kind: str, hits: Column, decode: Callable[[Column], Column], length: Callable[[Column], Column]) -> Column:
    """Findings of runs whose bytes (as hex) are readable UTF-8."""

    def one(h: Column) -> Column:
        data = F.unhex(decode(h["hit"]))
        valid = F.is_valid_utf8(data.cast("string"))
        plain = F.when(valid, F.regexp_replace(data.cast("string"), r"^\x{feff}", ""))
        return F.when(valid & readable(plain), finding(type=F.lit(kind), severity=F.lit("high"), index=h["at"], length=length(h["hit"]), decoded=cut(plain, V.DECODED_CUT)))

    return F.filter(F.transform(hits, one), lambda f: f.isNotNull())


def variation_selectors(text: Column) -> Column:
    """Runs of variation selectors that spell bytes."""
    selectors = "".join(chr(0xFE00 + i) for i in range(16)) + "".join(chr(0xE0100 + i) for i in range(240))
    run = r"[\x{fe00}-\x{fe0f}\x{e0100}-\x{e01ef}]"

    def spelled(hit: Column) -> Column:
        # A selector's byte is its place among all of them: two letters for the high and the low digit.
        high = F.translate(hit, selectors, "".join(f"{i:02X}"[0] for i in range(256)))
        low = F.translate(hit, selectors, "".join(f"{i:02X}"[1] for i in range(256)))
        return F.array_join(F.zip_with(F.split(high, ""), F.split(low, ""), lambda a, b: F.concat(a, b)), "")

    return when_seen(text, run + f"{{{V.READABLE_LEAST}}}", _payload("variation-selector-smuggling", located(text, run + "+"), spelled, F.length))


def sneaky_bits(text: Column) -> Column:
    """Runs of invisible operators that spell bits, the highest first; a last part of a byte is dropped."""
    run = r"[\x{2062}\x{2064}]"

    def spelled(hit: Column) -> Column:
        bits = F.translate(hit, "\u2062\u2064", "01")
        octets = F.regexp_extract_all(bits, F.lit("[01]{8}"), F.lit(0))
        return F.array_join(F.transform(octets, lambda o: F.lpad(F.conv(o, 2, 16), 2, "0")), "")

    return when_seen(text, run + f"{{{V.BITS_LEAST}}}", _payload("sneaky-bits-smuggling", located(text, run + "+"), spelled, F.length))


def combining_marks(text: Column) -> Column:
    run = rf"[\x{{0300}}-\x{{036f}}]{{{V.COMBINING_LEAST},}}"
    found = F.transform(located(text, run), lambda h: finding(type=F.lit("excessive-combining-marks"), severity=F.lit("low"), index=F.greatest(F.lit(0), h["at"] - 1), count=F.length(h["hit"])))
    return when_seen(text, run, found)


# ------------------------------------------------------------------------------------------------ encodings


def from_base64(s: Column) -> Column:
    """The bytes of a run as Latin-1, with its padding put right; null if that is no base64."""
    padded = F.concat(s, F.repeat(F.lit("="), F.pmod(4 - F.pmod(F.length(s), F.lit(4)), F.lit(4)).cast("int")))
    return F.decode(F.try_to_binary(padded, F.lit("base64")), "ISO-8859-1")


def jwt_like(flat: Column, at: Column, length: Column) -> Column:
    """Whether the run lies in the first dotted triple of its surroundings, whose first part decodes to a token header.

    ``flat`` is the text with places that are UTF-16 offsets.
    """
    first = F.greatest(F.lit(0), at - V.JWT_WINDOW)
    window = F.substr(flat, first + 1, at - first + length + V.JWT_WINDOW)
    triple = r"[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"
    hit = F.regexp_extract(window, triple, 0)
    start = first + F.regexp_instr(window, F.lit(triple)) - 1
    head = from_base64(F.element_at(F.split(hit, r"\."), 1))
    inside = (hit != "") & (at >= start) & (at + length <= start + F.length(hit))
    return F.coalesce(inside & head.rlike(r'^\{"(?:alg|typ)"\s*:'), F.lit(False))


def _decoded(kind: str, level: str, text: Column, run: str, decode: Callable[[Column], Column], jwt: bool = False) -> Column:
    def told(h: Column, plain: Column, flat: Column | None) -> Column:
        parts = {"type": F.lit(kind), "severity": F.lit(level), "index": h["at"], "sample": cut(h["hit"], V.SAMPLE_CUT, "…"), "decoded": cut(plain, V.DECODED_CUT)}
        if flat is not None:
            make = lambda like: finding(**parts | {"severity": F.when(like, "low").otherwise(level), "likely_jwt": F.when(like, F.lit(True))})
            return bound(jwt_like(flat, h["at"], units(h["hit"])), make)
        return finding(**parts)

    each = lambda flat: F.transform(located(text, run), lambda h: bound(decode(h["hit"]), lambda plain: F.when(plain.isNotNull() & readable(plain), told(h, plain, flat))))
    found = bound(in_units(text), each) if jwt else each(None)
    return when_seen(text, run, F.filter(found, lambda f: f.isNotNull()))


BASE64_RUN = rf"[A-Za-z0-9+/]{{{V.BASE64_LEAST},}}+={{0,2}}"
PERCENT_RUN = rf"(?:%[0-9A-Fa-f]{{2}}){{{V.RUN_LEAST},}}+"
HEX_RUN = rf"(?:\\x[0-9A-Fa-f]{{2}}){{{V.RUN_LEAST},}}+"
SPACED_HEX_RUN = rf"(?<![A-Za-z0-9_])[0-9A-Fa-f]{{2}}(?:[\s\x0b\x{{00a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}\x{{feff}}]++[0-9A-Fa-f]{{2}}(?![A-Za-z0-9_])){{{V.RUN_LEAST - 1},}}+"
UNICODE_RUN = rf"(?:\\u[0-9A-Fa-f]{{4}}){{{V.RUN_LEAST},}}+"
ENTITY_RUN = rf"(?:&#(?:[0-9]{{2,7}}|x[0-9A-Fa-f]{{1,6}});){{{V.RUN_LEAST},}}+"


def base64(text: Column) -> Column:
    return _decoded("encoded-base64", "medium", text, BASE64_RUN, from_base64, jwt=True)


def percent(text: Column) -> Column:
    """Strict UTF-8: a run with a bad byte sequence is no finding."""

    def decode(run: Column) -> Column:
        raw = F.unhex(F.replace(run, F.lit("%"), F.lit(""))).cast("string")
        return F.when(F.is_valid_utf8(raw), raw)

    return _decoded("encoded-percent", "medium", text, PERCENT_RUN, decode)


def _latin(digits: Column) -> Column:
    return F.decode(F.unhex(digits), "ISO-8859-1")


def hex_escape(text: Column) -> Column:
    return _decoded("encoded-hex-escape", "medium", text, HEX_RUN, lambda r: _latin(F.replace(r, F.lit("\\x"), F.lit(""))))


def spaced_hex(text: Column) -> Column:
    return _decoded("encoded-spaced-hex", "medium", text, SPACED_HEX_RUN, lambda r: _latin(F.regexp_replace(r, "[^0-9A-Fa-f]+", "")))


def unicode_escape(text: Column) -> Column:
    """UTF-16 units; one without its pair is read as the replacement character, which counts as unreadable either way."""

    def decode(run: Column) -> Column:
        lone = r"(?i)(\\ud[89ab]..)(?!\\ud[c-f])|(?<!\\ud[89ab]..)(\\ud[c-f]..)"
        return F.decode(F.unhex(F.replace(F.regexp_replace(run, lone, r"\\\\uFFFD"), F.lit("\\u"), F.lit(""))), "UTF-16BE")

    return _decoded("encoded-unicode-escape", "low", text, UNICODE_RUN, decode)


def html_entities(text: Column) -> Column:
    """Numeric references: decimal ones first, then hexadecimal ones in what they gave; those out of range vanish."""

    def char(point: Column) -> Column:
        # A code point as UTF-16: one unit, or a pair.
        low = point - 0x10000
        one = F.lpad(F.hex(point), 4, "0")
        two = F.concat(F.lpad(F.hex(F.floor(low / 1024) + 0xD800), 4, "0"), F.lpad(F.hex(F.pmod(low, F.lit(1024)) + 0xDC00), 4, "0"))
        unpaired = (point >= 0xD800) & (point <= 0xDFFF)
        return F.when(point > 0x10FFFF, "").otherwise(F.decode(F.unhex(F.when(unpaired, "FFFD").when(point < 0x10000, one).otherwise(two)), "UTF-16BE"))

    def replaced(s: Column, pattern: str, point: Callable[[Column], Column]) -> Column:
        hits = F.transform(F.regexp_extract_all(s, F.lit(pattern), F.lit(1)), lambda d: char(point(d)))
        return F.array_join(F.zip_with(F.split(s, pattern, -1), hits, lambda gap, c: F.concat(gap, F.coalesce(c, F.lit("")))), "")

    def decode(run: Column) -> Column:
        first = replaced(run, "&#([0-9]{2,7});", lambda d: d.cast("long"))
        return replaced(first, "&#x([0-9A-Fa-f]{1,6});", lambda d: F.conv(d, 16, 10).cast("long"))

    return _decoded("encoded-html-entity", "low", text, ENTITY_RUN, decode)


# ------------------------------------------------------------------------------------------------ phrases


def _first_matches(kind: str, level: str, text: Column, patterns: dict[str, str], normalized: bool = False) -> Column:
    """A finding for the first match of each pattern.

    One pattern made of all of them spares most texts the rest; in the others, a word that a pattern needs is looked for first.
    """
    def one(name: str, p: str, low: Column) -> Column:
        hit = bound(F.regexp_instr(text, F.lit(java(p))), lambda at: F.when(at > 0, F.struct((at - 1).alias("at"), F.regexp_extract(text, java(p), 0).alias("match"), F.lit(name).alias("pattern"))))
        needed = keyword(p)
        return F.when(F.contains(low, F.lit(needed)), hit) if needed else hit

    more = {"normalized": F.lit(True)} if normalized else {}
    told = lambda h: finding(type=F.lit(kind), severity=F.lit(level), index=h["at"], match=cut(h["match"], V.MATCH_CUT), pattern=h["pattern"], **more)
    each = lambda low: F.transform(F.filter(F.array(*[one(n, p, low) for n, p in patterns.items()]), lambda h: h.isNotNull()), told)
    return when_seen(text, any_of(list(patterns.values())), bound(F.lower(text), each))


def instructions(text: Column) -> Column:
    return _first_matches("instruction-phrase", "low", text, V.INSTRUCTIONS)


def control_tokens(text: Column) -> Column:
    return _first_matches("control-token", "high", text, V.CONTROL_TOKENS)


def spaced_instructions(text: Column) -> Column:
    return _first_matches("instruction-phrase", "low", text, V.SPACED, normalized=True)


ENCODINGS = {"base64": base64, "percent": percent, "hex_escape": hex_escape, "spaced_hex": spaced_hex, "unicode_escape": unicode_escape, "html_entities": html_entities}


def encoded(text: Column) -> Column:
    """All encodings, and control tokens."""
    return F.concat(*[d(text) for d in ENCODINGS.values()], control_tokens(text))


def content(text: Column) -> Column:
    return F.concat(encoded(text), instructions(text))


# ------------------------------------------------------------------------------------------------ all of them


def content_key(f: Column) -> Column:
    return F.concat(f["type"], F.lit(":"), F.coalesce(f["pattern"], f["decoded"], F.lit("")))


def _unseen(found: Column, seen: Column) -> Column:
    keys = F.transform(seen, content_key)
    return F.filter(found, lambda f: ~F.array_contains(keys, content_key(f)))


def _revealed(found: Column, text: Column, removed: str) -> Column:
    whole = lambda fs: F.when(F.size(fs) > 0, with_raw_offsets(F.transform(fs, lambda f: f.withField("normalized", F.lit(True))), text, removed)).otherwise(none())
    return bound(found, whole)


class TextScan:
    """The steps of a full scan as columns that build on each other, so that no part is worked out twice.

    ``apply`` adds them to a frame: findings of the raw text; those that only show once invisible characters are gone; phrases
    that only show once letters are made plain; spaced-out phrases.
    """

    def __init__(self, text: str, out: str = "findings"):
        self.text, self.out = text, out

    def apply(self, df):
        t, own = F.col(self.text), f"__{self.out}"
        stripped, plain, codes, phrases = (F.col(f"{own}_{k}") for k in ("stripped", "plain", "codes", "phrases"))
        df = df.withColumns({f"{own}_stripped": strip_invisible(t), f"{own}_plain": deobfuscate(t)})
        # The same detectors read the text and what the normalisers made of it; a null stands for a text that they left alone.
        bare = F.when(stripped != t, stripped)
        df = df.withColumns({f"{own}_codes": F.transform(F.array(t, bare), encoded), f"{own}_phrases": F.transform(F.array(t, bare, F.when(plain != t, plain)), instructions)})
        raw = F.concat(codes[0], phrases[0])
        df = df.withColumns({f"{own}_raw": raw, f"{own}_bare": _revealed(_unseen(F.concat(codes[1], phrases[1]), raw), t, REMOVED_CLASS)})
        so_far = F.concat(F.col(f"{own}_raw"), F.col(f"{own}_bare"))
        df = df.withColumn(f"{own}_clear", _revealed(_unseen(phrases[2], so_far), t, DROPPED_CLASS))
        apart = _unseen(spaced_instructions(t), F.concat(so_far, F.col(f"{own}_clear")))
        odd = F.when(beyond_ascii(t) & t.rlike(NEAR_ODD), F.concat(invisible(t), variation_selectors(t), sneaky_bits(t), combining_marks(t))).otherwise(none())
        whole = F.concat(odd, so_far, F.col(f"{own}_clear"), apart)
        return df.withColumn(self.out, F.when(t.isNull(), none()).otherwise(whole)).drop(*[f"{own}_{k}" for k in ("stripped", "plain", "codes", "phrases", "raw", "bare", "clear")])


def scan_text(df, text: str = "text", out: str = "findings"):
    """``df`` with all findings of ``text`` as an array."""
    return TextScan(text, out).apply(df)


def worst(findings: Column) -> Column:
    """The worst severity, null without findings."""
    levels = F.transform(findings, lambda f: f["severity"])
    return F.when(F.array_contains(levels, "high"), "high").when(F.array_contains(levels, "medium"), "medium").when(F.size(levels) > 0, "low")
