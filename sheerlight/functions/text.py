"""Patterns and string functions with the scanner's semantics: white space and offsets are those of UTF-16 strings.

The same pattern notation is rendered for Spark (Java regular expressions) and for the SQL that checks it.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import values as V

#: White space of a UTF-16 string library: the ASCII ones, the Unicode spaces and the byte order mark.
SPACE_SET = r"\s\x0b\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"
SPACE = f"[{SPACE_SET}]"
#: The edge of an ASCII word: what stands before may be a blank or a sign, and then a word has to begin.
EDGE = "(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"


def java(pattern: str) -> str:
    """A pattern of ``values`` for Spark, ignoring case."""
    out = pattern.replace("{line}", "\0L").replace("{after}", "\0A").replace("{solid}", "\0S").replace("{any}", "\0W")
    out = out.replace("<", "\0B").replace(">", "\0E") if not pattern.startswith(("<\\|", "</")) else out
    out = out.replace(" ", f"{SPACE}+") if "END OF PROMPT" not in pattern else out
    out = out.replace("~", f"{SPACE}*")
    for mark, text in (("\0L", r"(?:^|(?<=[\n\r\x{2028}\x{2029}]))"), ("\0A", f"[{SPACE_SET},;:]"), ("\0S", f"[^{SPACE_SET}]"), ("\0W", f"{SPACE}*"), ("\0B", "(?<![A-Za-z0-9_])"), ("\0E", EDGE)):
        out = out.replace(mark, text)
    return "(?i)" + out


def any_of(patterns: list[str]) -> str:
    """A pattern that is found where one of some patterns is; those that begin a word share one test of that."""
    edge = "(?<![A-Za-z0-9_])"
    made = [java(p).removeprefix("(?i)") for p in patterns]
    at_word = [m.removeprefix(edge) for m in made if m.startswith(edge)]
    firsts = "".join(sorted({c for m in at_word for c in _firsts(m)}))
    others = [m for m in made if not m.startswith(edge)]
    return "(?i)" + "|".join(([f"{edge}(?=[{firsts}])(?:{'|'.join(at_word)})"] if at_word else []) + others)


def _firsts(pattern: str) -> set[str]:
    """The letters that a pattern of words can begin with."""
    if not pattern.startswith("(?:"):
        return {pattern[0]}
    inner = pattern[3 : pattern.index(")")]
    return {x[0] for x in inner.split("|")}


def plain(pattern: str) -> str:
    """A pattern of ``values`` for an engine whose word edges and spaces are ASCII, ignoring case."""
    out = pattern.replace("{line}", "\0L").replace("{after}", "\0A").replace("{solid}", "\0S").replace("{any}", "\0W")
    out = out.replace("<", "\0B").replace(">", "\0B") if not pattern.startswith(("<\\|", "</")) else out
    out = out.replace(" ", r"\s+") if "END OF PROMPT" not in pattern else out
    out = out.replace("~", r"\s*")
    for mark, text in (("\0L", "(?m:^)"), ("\0A", r"[\s,;:]"), ("\0S", r"\S"), ("\0W", r"\s*"), ("\0B", r"\b")):
        out = out.replace(mark, text)
    return "(?i)" + out


def units(s: Column) -> Column:
    """Length in UTF-16 units."""
    return (F.octet_length(F.encode(s, "UTF-16BE")) / 2).cast("int")


def strip(s: Column) -> Column:
    return F.regexp_replace(s, f"^{SPACE}+|{SPACE}+$", "")


def snippet(s: Column) -> Column:
    """The text on one line, cut after ``CONTEXT_CUT``."""
    clean = strip(F.regexp_replace(s, f"{SPACE}+", " "))
    return cut(clean, V.CONTEXT_CUT, "…")


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often it is used there."""
    return F.element_at(F.transform(F.array(value), body), 1)


def cut(s: Column, n: int, mark: str = "") -> Column:
    """At most n UTF-16 units of s, and ``mark`` if something was cut; a character of two units that crosses the border is left out."""

    def whole_units(head: Column) -> Column:
        high = F.hex(F.substring(head, 2 * n - 1, 1)).between("D8", "DB")
        return F.decode(F.substr(head, F.lit(1), F.when(high, 2 * n - 2).otherwise(2 * n)), "UTF-16BE")

    first = bound(F.substring(F.encode(F.substring(s, 1, n), "UTF-16BE"), 1, 2 * n), whole_units)
    return F.when(units(s) > n, F.concat(first, F.lit(mark)) if mark else first).otherwise(s)


def in_units(s: Column) -> Column:
    """s with two replacement characters for each one of two units, so that places in it are UTF-16 offsets."""
    return F.when(units(s) > F.length(s), F.regexp_replace(s, r"[\x{10000}-\x{10ffff}]", "��")).otherwise(s)


def readable(s: Column) -> Column:
    """Whether a decoded string looks like text: long enough, and mostly printable ASCII."""
    n = units(s)
    printable = F.length(F.regexp_replace(s, r"[^\t\n\r -~]", ""))
    return F.coalesce((n >= V.READABLE_LEAST) & (printable / n > V.READABLE_SHARE), F.lit(False))


#: Matches that one running sum goes through; a sum over the sums of such blocks says where each begins.
BLOCK = 64


def _located_blocks(text: Column, pattern: str) -> Column:
    """The matches of a pattern in blocks: structs of ``at`` (UTF-16 offset), ``hit`` and ``before`` (units of the matches before it).

    A list that grows by one is copied, so lists grow only to the size of a block, and one to the number of blocks.
    """
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    pairs = F.zip_with(hits, gaps, lambda h, g: F.struct(units(g).alias("gap"), units(h).alias("size"), h.alias("hit")))
    # There is one gap more than matches; it stays in the last block as a pair without a match.
    in_blocks = lambda p: F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(p) - 2) / BLOCK).cast("int"))), lambda k: F.filter(F.slice(p, k * BLOCK + 1, BLOCK), lambda x: x["hit"].isNotNull()))
    place = lambda pos, gone: F.struct(pos.cast("int").alias("pos"), gone.cast("int").alias("gone"))
    empty = lambda kind: F.array().cast(f"array<{kind}>")

    def starts(blocks: Column) -> Column:
        zero = place(F.lit(0), F.lit(0))
        total = F.transform(blocks, lambda b: F.aggregate(b, zero, lambda acc, x: place(acc["pos"] + x["gap"] + x["size"], acc["gone"] + x["size"])))
        first = F.struct(empty("struct<pos:int,gone:int>").alias("out"), zero.alias("so_far"))
        more = lambda acc, t: F.struct(F.array_append(acc["out"], acc["so_far"]).alias("out"), place(acc["so_far"]["pos"] + t["pos"], acc["so_far"]["gone"] + t["gone"]).alias("so_far"))
        return F.aggregate(total, first, more, lambda acc: acc["out"])

    def placed(b: Column, start: Column) -> Column:
        first = F.struct(empty("struct<at:int,hit:string,before:int>").alias("out"), start.alias("so_far"))

        def more(acc: Column, x: Column) -> Column:
            at = acc["so_far"]["pos"] + x["gap"]
            found = F.struct(at.cast("int").alias("at"), x["hit"].alias("hit"), acc["so_far"]["gone"].alias("before"))
            return F.struct(F.array_append(acc["out"], found).alias("out"), place(at + x["size"], acc["so_far"]["gone"] + x["size"]).alias("so_far"))

        return F.aggregate(b, first, more, lambda acc: acc["out"])

    return bound(bound(pairs, in_blocks), lambda blocks: F.zip_with(blocks, starts(blocks), placed))


def located(text: Column, pattern: str) -> Column:
    """All matches of a pattern, as structs of ``at`` (UTF-16 offset), ``hit`` and ``before``."""
    return F.flatten(_located_blocks(text, pattern))


def with_raw_offsets(found: Column, text: Column, removed: str) -> Column:
    """Findings in the text without ``removed`` characters, with their ``index`` brought to the text itself."""

    def raw(blocks: Column, at: Column) -> Column:
        kept = lambda x: x["at"] - x["before"]  # noqa: E731  units before a run that are left
        far = F.filter(blocks, lambda b: kept(F.get(b, F.lit(0))) <= at)  # what comes before the last of these is gone in full
        last = F.element_at(F.filter(F.element_at(far, -1), lambda x: kept(x) <= at), -1)
        return F.least(at + F.when(F.size(far) > 0, last["before"] + units(last["hit"])).otherwise(0), units(text))

    return bound(_located_blocks(text, f"{removed}+"), lambda blocks: F.transform(found, lambda f: f.withField("index", raw(blocks, f["index"]))))


def class_of(points: list[int]) -> str:
    """A character class of code points, neighbours as ranges."""
    out, points = [], sorted(points)
    first = last = None
    for p in [*points, None]:
        if last is not None and p == last + 1:
            last = p
            continue
        if last is not None:
            out.append(f"\\x{{{first:x}}}" + (f"-\\x{{{last:x}}}" if last > first else ""))
        first = last = p
    return "[" + "".join(out) + "]"


def keyword(pattern: str) -> str | None:
    """The longest word that every match of a pattern of ``values`` holds, if the pattern has one outside its groups."""
    out, depth = "", 0
    for c in pattern:
        depth += (c == "(") - (c == ")")
        out += " " if depth or c == ")" else c
    out = re.sub(r"\{[^}]*\}", " ", out)
    words = re.findall("[a-z]{3,}", re.sub(r"[a-zA-Z]\?", " ", out))
    return max(words, key=len) if words else None
