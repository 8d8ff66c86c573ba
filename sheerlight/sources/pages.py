"""Pages as one table of rows: texts, comments, attributes, styles, frames and a status, from one parse of each page.

Pages are parsed on the executors in Arrow batches.  A page that can't be parsed gets a status with the error instead of failing the job;
null pages are empty documents.  Elements are numbered over all roots of a page, in the order of the walk.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from urllib.parse import urldefrag, urlsplit, urlunsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import values as V
from .css import hidden_elements, style_records, trim
from .dom import Node, parse, roots, scope

#: ``kind`` is text, comment, attribute; frame (the text is its address), style (what hides texts, as JSON) or page (the status as ``tag``, the
#: address as ``attr_name``, an error as text).
ROWS = "array<struct<root:int,pass:int,ord:int,kind:string,element:int,tag:string,attr_name:string,text:string>>"
HIDDEN = "array<struct<root:int,ord:int,element:int,reasons:array<string>,likely_a11y:boolean,text:string>>"
#: Without one of these words a page has no style that hides text.
STYLED = ("font-size", "opacity", "position", "text-indent", "transform", "clip", "color", "background")
#: Addresses that can't be scanned.
UNSCANNABLE = "^(?:about:|moz-extension:)"
#: Pages whose rows are in memory at once.
PAGES_A_BATCH = 64
_PORTS = {"http": 80, "https": 443}


def _walk(html: str, address: str = "") -> tuple[list[Node], dict[int, int]]:
    """The roots, and the number of each element by its identity."""
    found = roots(parse(html), address)
    numbers: dict[int, int] = {}
    for r in found:
        if r.kind == "outside":
            continue
        for e in scope(r).elements():
            numbers[id(e)] = len(numbers)
        if r.kind == "document":
            numbers[id(scope(r))] = len(numbers)
    return found, numbers


def _texts(found: list[Node], numbers: dict[int, int]) -> list[dict]:
    out: list[dict] = []
    for k, r in enumerate(found):
        if r.kind == "outside":
            continue
        for n in scope(r).walk():
            p = n.parent if n.parent is not None and n.parent.kind == "element" else None
            if trim(n.text) and not (p is not None and p.tag.upper() in V.SKIP_TAGS):
                out.append({"root": k, "pass": 1, "ord": len(out), "kind": n.kind, "element": None if p is None else numbers.get(id(p)), "tag": p.tag if p else None, "attr_name": None, "text": n.text})
        for e in scope(r).elements():
            if e.tag.upper() in V.SKIP_TAGS:
                continue
            for name in V.ATTRIBUTES:
                v = e.attrs.get(name, "")
                if v and len(v.encode("utf-16-le")) // 2 >= V.ATTRIBUTE_LEAST:
                    out.append({"root": k, "pass": 3, "ord": len(out), "kind": "attribute", "element": numbers[id(e)], "tag": e.tag, "attr_name": name, "text": v})
    return out


def text_nodes(html: str) -> list[dict]:
    """Texts and comments (pass 1) and attributes (pass 3) of a page, in the order in which they are scanned."""
    return _texts(*_walk(html))


def hidden_texts(html: str, hits: set[int], mask_revealed: bool = True) -> list[dict]:
    """Elements that hide their text (pass 2); ``hits`` are the elements whose texts had findings."""
    return _hidden(style_records(*_walk(html)), hits, mask_revealed)


def _hidden(records: list[list], hits: set[int], mask_revealed: bool) -> list[dict]:
    found = hidden_elements(records, hits, mask_revealed)
    return [{"root": k, "ord": i, "element": e, "reasons": why, "likely_a11y": a11y, "text": text} for i, (k, e, why, a11y, text) in enumerate(found)]


def same_origin(a: str, b: str) -> bool:
    """Of two addresses; those without a host have none."""
    try:
        x, y = urlsplit(a), urlsplit(b)
        of = lambda u: (u.scheme, u.hostname, u.port or _PORTS.get(u.scheme))
        return bool(x.hostname) and of(x) == of(y)
    except ValueError:
        return False


def normal(address: str) -> str | None:
    """An address without its fragment and the default port, with scheme and host in small letters; null for what is none."""
    try:
        x = urlsplit(urldefrag(address)[0])
        if not x.hostname:
            return address or None
        host = f"[{x.hostname}]" if ":" in x.hostname else x.hostname
        port = "" if x.port is None or x.port == _PORTS.get(x.scheme) else f":{x.port}"
        return urlunsplit((x.scheme, host + port, x.path or "/", x.query, ""))
    except ValueError:
        return address or None


def parsed(html: str, address: str = "") -> list[dict]:
    """All rows of a page but its status."""
    found, numbers = _walk(html, address)
    out = _texts(found, numbers)
    row = lambda k, kind, text: {"root": k, "pass": 2, "ord": 0, "kind": kind, "element": None, "tag": None, "attr_name": None, "text": text}
    out += [row(k, "frame", normal(r.attrs["address"])) for k, r in enumerate(found) if r.kind == "outside" and same_origin(address, r.attrs["address"])]
    low = html.lower()
    if any(x in low for x in STYLED) and (records := style_records(found, numbers)):
        out.append(row(0, "style", json.dumps(records, separators=(",", ":"))))
    return out


def _arrow(schema: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_type(_parse_datatype_string(schema))


def scannable(url: Column) -> Column:
    return ~F.coalesce(url.rlike(UNSCANNABLE), F.lit(False))


def page_rows(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """key, root, pass, ord, kind, element, tag, attr_name and text: what a scan reads of each page, and a row of kind ``page`` with its status.

    The status (``tag``) is ``ok``, ``unscannable`` by its address, or ``failed``, with the error as text.
    """
    kind = pages.schema[key].dataType.simpleString()
    made = _arrow(ROWS)  # on the driver: executors can't parse schemas

    def rows_of(html: str | None, address: str | None, free: bool) -> list[dict]:
        out, status, error = [], "ok" if free else "unscannable", None
        if free:
            try:
                out = parsed(html or "", address or "")
            except Exception as e:  # noqa: BLE001  one bad page must not fail the job
                status, error = "failed", f"{type(e).__name__}: {e}"
        return [*out, {"root": 0, "pass": 0, "ord": 0, "kind": "page", "element": None, "tag": status, "attr_name": normal(address or ""), "text": error}]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, PAGES_A_BATCH):
                part = b.slice(at, PAGES_A_BATCH)
                rows = [rows_of(*x) for x in zip(*(part.column(i).to_pylist() for i in (1, 2, 3)), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, made)], names=[key, "rows"])

    each = pages.select(key, html, url, scannable(F.col(url)).alias("free")).mapInArrow(run, f"`{key}` {kind}, rows {ROWS}")
    return each.select(key, F.explode("rows").alias("r")).select(key, "r.*")


def page_nodes(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """key, root, pass, ord, kind, element, tag, attr_name and text of each scanned text of each page."""
    return page_rows(pages.withColumn("__url", F.lit(None).cast("string")), key, "__url", html).filter(F.col("kind").isin("text", "comment", "attribute"))


def page_status(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """key, status and error of each page."""
    return page_rows(pages, key, url, html).filter("kind = 'page'").select(key, F.col("tag").alias("status"), F.col("text").alias("error"))


def hidden_rows(styles: DataFrame, mask_revealed: bool = True, key: str = "page_id") -> DataFrame:
    """key, root, ord, element, reasons, likely_a11y and text of each element that hides its text.

    ``styles``: key, ``text`` (of kind ``style``) and ``elements``, those whose texts had findings; a page's are no more than its elements.
    """
    kind = styles.schema[key].dataType.simpleString()
    made = _arrow(HIDDEN)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, PAGES_A_BATCH):
                part = b.slice(at, PAGES_A_BATCH)
                out = [_hidden(json.loads(x), set(h), mask_revealed) for x, h in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, made)], names=[key, "hidden"])

    told = styles.select(key, "text", F.coalesce("elements", F.array().cast("array<int>")).alias("elements"))
    return told.mapInArrow(run, f"`{key}` {kind}, hidden {HIDDEN}").select(key, F.explode("hidden").alias("h")).select(key, "h.*")


def page_hidden(pages: DataFrame, mask_revealed: bool = True, key: str = "page_id", html: str = "html") -> DataFrame:
    """``hidden_rows`` of whole pages, as if no text had findings."""
    rows = page_rows(pages.withColumn("__url", F.lit(None).cast("string")), key, "__url", html).filter("kind = 'style'")
    return hidden_rows(rows.withColumn("elements", F.lit(None).cast("array<int>")), mask_revealed, key)


def frames(pages: DataFrame, url: str = "url", html: str = "html", key: str = "page_id") -> DataFrame:
    """``outer`` (a key), ``root`` and ``target`` (address) of each frame of a page's own origin that holds another page."""
    return frame_rows(page_rows(pages, key, url, html), key)


def frame_rows(rows: DataFrame, key: str = "page_id") -> DataFrame:
    return rows.filter("kind = 'frame'").select(F.col(key).alias("outer"), "root", F.col("text").alias("target"))


def framed_pages(rows: DataFrame, key: str = "page_id") -> tuple[DataFrame, list[DataFrame]]:
    """``outer``, ``inner`` (keys) and ``path`` (the roots from the outer page to the inner one) of every page that another one frames, at any depth;
    and what is kept for that.

    ``rows`` as ``page_rows`` gives them, of kinds ``frame`` and ``page``.  An address stands for the page of the least key that has it.  A page that
    a frame above it holds already is not loaded again, so cycles end.  Each level is one join of narrow rows; levels are followed until
    one is empty.
    """
    own = rows.filter("kind = 'page' and tag = 'ok'").select(F.col(key).alias("inner"), F.col("attr_name").alias("target"))
    named = own.filter("target is not null").groupBy("target").agg(F.min("inner").alias("inner"))
    steps = frame_rows(rows, key).join(named, "target").select("outer", "root", "inner", F.col("target").alias("address")).persist()
    above = own.select(F.col("inner").alias("outer"), F.col("target").alias("above"))
    level = steps.join(above, "outer").filter(F.col("address") != F.col("above"))
    level = level.select("outer", "inner", F.array("root").alias("path"), F.array("above", "address").alias("above")).persist()
    held, out = [steps, level], level
    further = steps.select(F.col("outer").alias("inner"), "root", F.col("inner").alias("next"), "address")
    while level.limit(1).count():
        level = level.join(further, "inner").filter(~F.array_contains("above", F.col("address")))
        level = level.select("outer", F.col("next").alias("inner"), F.concat("path", F.array("root")).alias("path"), F.concat("above", F.array("address")).alias("above")).persist()
        held.append(level)
        out = out.union(level)
    return out.select("outer", "inner", "path"), held
