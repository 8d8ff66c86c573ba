"""The words of a report: labels, status lines and badges."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import values as V
from .rank import colour

def _quoted(c: Column) -> Column:
    return F.concat(F.lit("“"), F.coalesce(c, F.lit("")), F.lit("”"))


def _if(cond: Column, text: str) -> Column:
    return F.when(F.coalesce(cond, F.lit(False)), text).otherwise("")


def type_label() -> Column:
    """What a finding is called, from its fields."""
    c = F.col
    out = F.when(c("type") == "unicode-tag", F.concat(F.lit(V.TAG_LABEL), F.when(c("decoded").isNotNull(), F.concat(F.lit(V.TAG_DECODED), _quoted(c("decoded")))).otherwise("")))
    out = out.when(c("type") == "invisible", F.concat(F.lit(V.INVISIBLE_LABEL), c("name"), F.lit(" ("), c("hex"), F.lit(")")))
    out = out.when(c("type") == "encoded-base64", F.concat(F.lit(V.BASE64_LABEL), _if(c("likely_jwt"), V.JWT_LABEL), F.lit(" → "), _quoted(c("decoded"))))
    for kind, name in V.DECODED_LABELS.items():
        out = out.when(c("type") == kind, F.concat(F.lit(f"{name} → "), _quoted(c("decoded"))))
    out = out.when(c("type") == "control-token", F.concat(F.lit(V.TOKEN_LABEL), _quoted(c("match"))))
    out = out.when(c("type") == "css-hidden", F.concat(F.lit(V.HIDDEN_LABEL), F.array_join("reasons", ", "), F.lit(")"), _if(c("likely_a11y"), V.A11Y_LABEL)))
    place = F.when(c("attr_name").isNotNull(), F.concat(F.lit(" (in "), c("attr_name"), F.lit(")"))).otherwise("")
    out = out.when(c("type") == "instruction-phrase", F.concat(F.lit(V.PHRASE_LABEL), _if(c("normalized"), V.REVEALED_LABEL), place, F.lit(": "), _quoted(c("match"))))
    out = out.when(c("type") == "excessive-combining-marks", F.concat(F.lit(V.MARKS_LABEL), c("count").cast("string"), F.lit(V.MARKS_END)))
    return out.otherwise(F.concat(c("type"), place))


def row_label() -> Column:
    """A report row: its rank, the label, whether it stood in a comment, and how often it was found."""
    times = F.when(F.col("shown_count") > 1, F.concat(F.lit(" (×"), F.col("shown_count").cast("string"), F.lit(")"))).otherwise("")
    return F.concat(F.lit("#"), F.col("rank").cast("string"), F.lit(" "), type_label(), _if(F.col("in_comment"), V.COMMENT_LABEL), times)


def status_line() -> Column:
    """Of a summary: how many findings of which severity."""
    parts = F.concat_ws(", ", *[F.when(F.col(x) > 0, F.concat(F.col(x).cast("string"), F.lit(f" {x}"))) for x in V.SEVERITIES])
    many = F.when(F.col("count") == 1, "").otherwise("s")
    return F.when(F.col("count") == 0, V.NOTHING).otherwise(F.concat(F.col("count").cast("string"), F.lit(" finding"), many, F.lit(": "), parts))


def badge_text() -> Column:
    n = F.col("high") + F.col("medium")
    return F.when(n > 0, n.cast("string")).otherwise("")


def badge_colour() -> Column:
    return colour(F.coalesce(F.col("worst"), F.lit("")))
