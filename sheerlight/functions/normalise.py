"""Normalisers: text without invisible characters, and text with disguised letters made plain."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import values as V
from .text import class_of

TAGS = [0xE0000 + i for i in range(128)]
REMOVED = sorted(V.INVISIBLE) + TAGS
REMOVED_SET = frozenset(map(chr, REMOVED))
#: What the first normaliser takes away, as a class.
REMOVED_CLASS = class_of(sorted(V.INVISIBLE))[:-1] + r"\x{e0000}-\x{e007f}]"
#: What the second one takes away.
DROPPED_CLASS = REMOVED_CLASS[:-1] + r"|_`^~]"


def letter_map() -> dict[str, str]:
    """Each disguised letter and its plain one."""
    out: dict[str, str] = {}
    for starts, base in ((V.STYLED_UPPER, "A"), (V.STYLED_LOWER, "a")):
        for s in starts:
            out |= {chr(s + i): chr(ord(base) + i) for i in range(26)}
    return out | V.LEET | {chr(k): v for k, v in V.HOMOGLYPHS.items()}


def beyond_ascii(text: Column) -> Column:
    """A cheap test that spares most texts the character classes."""
    return F.octet_length(text) != F.length(text)


#: A few ranges around what the normalisers and the detectors of odd characters look for.
NEAR_ODD = r"[\x{ad}\x{300}-\x{36f}\x{61c}\x{180e}\x{200b}-\x{2069}\x{fe00}-\x{feff}\x{e0000}-\x{e01ef}]"
NEAR_STYLED = r"[\x{390}-\x{460}\x{ff21}-\x{ff5a}\x{1d400}-\x{1d6a3}\x{1f1e6}-\x{1f1ff}]"


def strip_invisible(text: Column) -> Column:
    return F.when(beyond_ascii(text) & text.rlike(NEAR_ODD), F.translate(text, "".join(map(chr, REMOVED)), "")).otherwise(text)


def plain_letters(text: Column) -> Column:
    """One pass that maps letters and drops invisible characters and delimiters; texts without any are left alone."""
    pairs = letter_map()
    signs = "[" + "".join(V.LEET) + V.DELIMITERS.replace("^", r"\^") + "]"
    changed = F.translate(text, "".join(pairs) + "".join(map(chr, REMOVED)) + V.DELIMITERS, "".join(pairs.values()))
    return F.when(text.rlike(signs) | (beyond_ascii(text) & (text.rlike(NEAR_ODD) | text.rlike(NEAR_STYLED))), changed).otherwise(text)


def signature(word: str) -> str:
    return f"{len(word)}:{word[0]}:{word[-1]}:{''.join(sorted(word[1:-1]))}"


_LIKE = "|".join(f"{w[0]}[{''.join(sorted(set(w[1:-1])))}]{{{len(w) - 2}}}{w[-1]}" for w in V.SCRAMBLED)
#: A word that may be a scramble of a listed one (the same ends, the same letters between, in any number), and isn't listed itself.
MAYBE_SCRAMBLED = f"(?i)(?<![A-Za-z])(?:{_LIKE})(?![A-Za-z])(?<!(?<![A-Za-z])(?:{'|'.join(V.SCRAMBLED)}))"


def repair_words(text: Column) -> Column:
    """Scrambled words of the list put right; the first letter's case stays.  No digit or underscore is left in ``text``."""
    table = F.create_map(*[F.lit(x) for w in V.SCRAMBLED for x in (signature(w), w)])
    known = F.array(*[F.lit(w) for w in V.SCRAMBLED])
    parts = F.split(text, r"(?<=[A-Za-z])(?=[^A-Za-z])|(?<=[^A-Za-z])(?=[A-Za-z])", -1)

    def repaired(w: Column) -> Column:
        low = F.lower(w)
        inner = F.array_join(F.array_sort(F.split(F.substr(low, F.lit(2), F.length(w) - 2), "")), "")
        key = F.concat(F.length(w).cast("string"), F.lit(":"), F.substring(low, 1, 1), F.lit(":"), F.substring(low, -1, 1), F.lit(":"), inner)
        right = F.element_at(table, key)
        cased = F.when(F.substring(w, 1, 1).rlike("[A-Z]"), F.concat(F.upper(F.substring(right, 1, 1)), F.substr(right, F.lit(2)))).otherwise(right)
        return F.when(w.rlike("^[A-Za-z]{3,}$") & ~F.array_contains(known, low), F.coalesce(cased, w)).otherwise(w)

    whole = F.array_join(F.transform(parts, repaired), "")
    return F.when(text.rlike(MAYBE_SCRAMBLED), whole).otherwise(text)


def deobfuscate(text: Column) -> Column:
    return repair_words(plain_letters(text))
