"""Scans of streams: every detector works on one row, and pages never meet, so a batch is scanned like a table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.detect import scan_text
from ..plans.scan import PageScan


def scan_text_stream(stream: DataFrame, text: str = "text", out: str = "findings") -> DataFrame:
    """A stream with the findings of its text column; stateless."""
    return scan_text(stream, text, out)


def scan_page_stream(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Summaries of each batch of pages, handed to ``sink`` with the batch's number; a repeated batch has the same number.

    What a batch's scan keeps is released when the sink returns.
    """

    def one(batch: DataFrame, number: int) -> None:
        found = PageScan(batch)
        try:
            sink(found.summary(), number)
        finally:
            found.release()

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).start()
