"""Whole scans: a text column of any table, or a table of pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import values as V
from ..functions.text import snippet
from ..operators import rank, report
from ..operators.detect import FIELDS, scan_text, worst
from ..sources.pages import framed_pages, hidden_rows, page_rows


def text_findings(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys, ``pos`` and the fields of each finding of a text column."""
    return exploded(scan_text(df.select(*keys, text), text, "__found").select(*keys, "__found")).select(*keys, "pos", "f.*")


def exploded(scanned: DataFrame) -> DataFrame:
    """``pos`` and ``f`` for each of ``__found``.

    The outer form keeps the optimizer from testing ``__found`` for emptiness below the projections that build it, which would
    repeat the whole scan in the test.
    """
    return scanned.select("*", F.posexplode_outer("__found").alias("pos", "f")).drop("__found").filter("pos is not null")


def text_worst(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with ``n_findings`` and ``worst_severity`` of its text."""
    return scan_text(df, text, "__found").withColumns({"n_findings": F.size("__found"), "worst_severity": worst(F.col("__found"))}).drop("__found")


#: Order of a page's findings: roots (those of frames below the frame's), then the passes over one root, then texts, then findings of one text.
_SEQ = "struct<path:array<int>,pass:int,ord:int,pos:int>"


class PageScan:
    """The scan of a table of pages: one parse of each, one scan of its texts, and what follows from their findings.

    Texts, comments and attributes are scanned first, as elements with findings are made visible before styles are looked at.  What is
    kept of a page are its findings, its declared styles, its frames and its status: ``rows``, which several branches read.  Call ``release``
    when done.
    """

    def __init__(self, pages: DataFrame, mask_revealed: bool = True, key: str = "page_id", url: str = "url", html: str = "html"):
        self.pages, self.key, self.url = pages, key, url
        read = F.col("kind").isin("text", "comment", "attribute")
        rows = page_rows(pages, key, url, html).withColumn("__read", F.when(read, F.col("text")))
        shown = F.when(F.col("attr_name").isNotNull(), F.concat(F.lit("["), F.col("attr_name"), F.lit("] "), F.col("text"))).otherwise(F.col("text"))
        # The outer form, as in ``exploded``; rows of other kinds have nothing to read and stay.
        each = scan_text(rows, "__read", "__found").select("*", F.posexplode_outer("__found").alias("pos", "f")).filter(F.col("pos").isNotNull() | ~F.col("kind").isin("text", "comment", "attribute"))
        self.rows = each.select(key, "root", "pass", "ord", "pos", "kind", "element", "tag", "attr_name", F.when(F.col("pos").isNull(), F.col("text")).alias("text"), F.when(F.col("pos").isNotNull(), snippet(shown)).alias("context"), "f").persist()
        self.held: list[DataFrame] = [self.rows]
        texts = self.rows.filter("pos is not null")
        hits = texts.filter((F.col("pass") == 1) & F.col("element").isNotNull()).groupBy(key).agg(F.collect_set("element").alias("elements"))
        hidden = hidden_rows(self.rows.filter("kind = 'style'").select(key, "text").join(hits, key, "left"), mask_revealed, key)
        own = self._text_items(texts).unionByName(self._hidden_items(hidden))
        self.items = own.unionByName(self._framed(own))

    def _text_items(self, texts: DataFrame) -> DataFrame:
        return texts.select(
            self.key, F.struct(F.array("root").alias("path"), "pass", "ord", "pos").cast(_SEQ).alias("seq"), F.col("element").cast("string").alias("element"), "f.*",
            F.lit(None).cast("array<string>").alias("reasons"), F.lit(None).cast("boolean").alias("likely_a11y"),
            F.when(F.col("kind") == "comment", F.lit(True)).alias("in_comment"), "attr_name", "context",
        )

    def _hidden_items(self, found: DataFrame) -> DataFrame:
        given = {"type": F.lit("css-hidden"), "severity": F.when(F.col("likely_a11y"), "low").otherwise("medium")}
        fields = [given.get(n, F.lit(None)).cast(t).alias(n) for n, t in FIELDS.items()]
        return found.select(
            self.key, F.struct(F.array("root").alias("path"), F.lit(2).alias("pass"), "ord", F.lit(0).alias("pos")).cast(_SEQ).alias("seq"), F.col("element").cast("string").alias("element"), *fields,
            "reasons", F.when(F.col("likely_a11y"), F.lit(True)).alias("likely_a11y"), F.lit(None).cast("boolean").alias("in_comment"), F.lit(None).cast("string").alias("attr_name"), snippet(F.col("text")).alias("context"),
        )

    def _framed(self, own: DataFrame) -> DataFrame:
        """The findings of pages in same-origin frames, as findings of the pages that hold the frames."""
        found, held = framed_pages(self.rows, self.key)
        self.held += held
        path = F.concat("__path", "seq.path")
        place = F.when(F.col("element").isNotNull(), F.concat(F.array_join(F.transform("__path", lambda x: x.cast("string")), "."), F.lit(":"), F.col("element")))
        each = own.withColumnRenamed(self.key, "__inner").join(found.select(F.col("outer").alias(self.key), F.col("inner").alias("__inner"), F.col("path").alias("__path")), "__inner")
        return each.withColumns({"seq": F.struct(path.alias("path"), "seq.pass", "seq.ord", "seq.pos").cast(_SEQ), "element": place}).select(own.columns)

    def status(self) -> DataFrame:
        """key, status and error of each page."""
        return self.rows.filter("kind = 'page'").select(self.key, F.col("tag").alias("status"), F.col("text").alias("error"))

    def findings(self, cap: int = V.PAGE_CAP) -> DataFrame:
        """Merged, ranked and capped findings of each page."""
        return rank.ranked(rank.dedup(rank.with_targets(self.items, self.key), self.key), cap, self.key)

    def summary(self, cap: int = V.PAGE_CAP) -> DataFrame:
        """A row for each page: counts, worst severity, status line and badge; a page that can't be scanned has no counts."""
        state = self.pages.select(self.key, F.col(self.url).alias("url")).join(self.status(), self.key)
        out = rank.summary(state, self.findings(cap), self.key).join(self.status().withColumnRenamed("status", "state"), self.key)
        scanned = F.col("state") == "ok"
        out = out.withColumns({c: F.when(scanned, F.col(c)) for c in ("count", *V.SEVERITIES)})
        return out.withColumns({"status": F.when(scanned, report.status_line()).otherwise(V.CANNOT), "badge_text": F.when(scanned, report.badge_text()).otherwise(""), "badge_colour": report.badge_colour()})

    def report(self, cap: int = V.PAGE_CAP, least: int = V.FOLD_LEAST) -> DataFrame:
        """The rows of each page's report, folded and labelled."""
        return rank.fold(self.findings(cap), least, self.key).withColumn("label", report.row_label())

    def release(self) -> None:
        """Give back what the scan keeps; results that have not been read yet are worked out anew."""
        for df in self.held:
            df.unpersist()


def page_items(pages: DataFrame, mask_revealed: bool = True, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """A row for each finding of each page that can be scanned, before duplicates are merged."""
    return PageScan(pages, mask_revealed, key, url, html).items


def page_findings(pages: DataFrame, cap: int = V.PAGE_CAP, mask_revealed: bool = True) -> DataFrame:
    """Merged, ranked and capped findings of pages."""
    return PageScan(pages, mask_revealed).findings(cap)


def page_summary(pages: DataFrame, cap: int = V.PAGE_CAP) -> DataFrame:
    """A row for each page: counts, worst severity, status line and badge."""
    return PageScan(pages).summary(cap)


def page_report(pages: DataFrame, cap: int = V.PAGE_CAP, least: int = V.FOLD_LEAST) -> DataFrame:
    """The rows of each page's report, folded and labelled."""
    return PageScan(pages).report(cap, least)
