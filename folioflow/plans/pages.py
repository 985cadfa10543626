"""Operators that go through one page in order, applied to rows of pages: Arrow batches in, rows out, no shuffle."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..operators import assemble, formulas, layout, tables, vision

Row = dict[str, Any]


def per_page(pages: DataFrame, each: Callable[[Row], Iterator[Row]], schema: str, keys: tuple[str, ...]) -> DataFrame:
    """The rows that `each` makes of every page, with the page's keys first. A page is one row and is handled alone."""
    made = StructType([pages.schema[k] for k in keys] + StructType.fromDDL(schema).fields)
    arrow = to_arrow_schema(made)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [{**{k: row[k] for k in keys}, **new} for row in batch.to_pylist() for new in each(row)]
            if out:
                yield pa.RecordBatch.from_pylist(out, arrow)

    return pages.mapInArrow(go, made)


def detect_tables(pages: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Tables among `lines` (array of text, y, x, size): (table_no, kind, start_line, end_line, n_rows, n_cols, confidence, markdown)."""

    def each(row: Row) -> Iterator[Row]:
        yield from map(_table, range(1 << 30), tables.detect_tables([tables.Line(x["text"], x["y"], x["x"], x["size"]) for x in row["lines"] or ()]))

    return per_page(pages, each, _TABLE, keys)


_TABLE = "table_no bigint, kind string, start_line bigint, end_line bigint, n_rows bigint, n_cols bigint, confidence double, markdown string"


def _table(number: int, t: tables.Table) -> Row:
    return {"table_no": number, "kind": t.kind, "start_line": t.start, "end_line": t.end, "n_rows": len(t.rows), "n_cols": len(t.alignments), "confidence": round(t.confidence, 6), "markdown": tables.to_markdown(t)}


def _lines(row: Row) -> list[layout.Line]:
    return [layout.Line(x["text"], x["y"], x["min_x"], x["max_x"], x["size"]) for x in row["lines"] or ()]


def _cells(row: Row) -> list[tuple[float, list[tables.Cell]]]:
    """Cells of lines whose characters are spread evenly."""
    out = []
    for x in row["lines"] or ():
        step = (x["max_x"] - x["min_x"]) / max(len(x["text"]), 1)
        chars = [(c, x["min_x"] + i * step, x["size"]) for i, c in enumerate(x["text"]) if c != " "]
        out += [(x["y"], tables.cells_of(chars))] if chars else []
    return out


def positioned_tables(pages: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Tables by the positions of `lines` (array of text, y, min_x, max_x, size)."""

    def each(row: Row) -> Iterator[Row]:
        yield from map(_table, range(1 << 30), tables.positioned_tables(_cells(row)))

    return per_page(pages, each, _TABLE, keys)


def regions(pages: DataFrame, keys: tuple[str, ...], width: float = 612) -> DataFrame:
    """(region_no, kind, column, confidence, n_blocks, n_columns, x, y, w, h, is_table, text) of `lines` (array of text, y, min_x, max_x, size)."""

    def each(row: Row) -> Iterator[Row]:
        columns = layout.columns_of(_lines(row), width)
        for n, r in enumerate(layout.regions_of(columns)):
            x, y, w, h = (round(float(v), 6) for v in r.box)
            text = "\n\n".join(b.text for b in r.blocks)
            yield {"region_no": n, "kind": r.kind, "column": r.column, "confidence": round(r.confidence, 6), "n_blocks": len(r.blocks), "n_columns": len(columns), "x": x, "y": y, "w": w, "h": h, "is_table": layout.is_table_region(r), "text": text}

    return per_page(pages, each, "region_no bigint, kind string, column bigint, confidence double, n_blocks bigint, n_columns bigint, x double, y double, w double, h double, is_table boolean, text string", keys)


def reading_order(pages: DataFrame, keys: tuple[str, ...], width: float = 612) -> DataFrame:
    """(n_columns, column_prose, text) of each page: its columns from left to right, blocks from top to bottom."""

    def each(row: Row) -> Iterator[Row]:
        columns = layout.columns_of(_lines(row), width)
        yield {"n_columns": len(columns), "column_prose": layout.is_column_prose(columns, layout.regions_of(columns)), "text": layout.reading_order(columns)}

    return per_page(pages, each, "n_columns bigint, column_prose boolean, text string", keys)


def structured_markdown(pages: DataFrame, keys: tuple[str, ...], width: float = 612, **options: bool) -> DataFrame:
    """(markdown, error) of pages given as `st_json`, with `lines` (array of text, y, min_x, max_x, size; may be null). JSON that
    can't be read gives a null Markdown and an error."""

    def each(row: Row) -> Iterator[Row]:
        try:
            blocks = json.loads(row["st_json"] or "")["blocks"]
        except (ValueError, KeyError, TypeError) as e:
            yield {"markdown": None, "error": type(e).__name__}
            return
        yield {"markdown": assemble.page_markdown(blocks, _lines(row), _cells(row), width, **options), "error": None}

    return per_page(pages, each, "markdown string, error string", keys)


def math_segments(texts: DataFrame, keys: tuple[str, ...], text: str = "text") -> DataFrame:
    """(segment_no, segment, is_math, is_display, start_at, end_at): code points, end exclusive."""

    def each(row: Row) -> Iterator[Row]:
        for n, s in enumerate(formulas.segments(row[text] or "")):
            yield {"segment_no": n, "segment": s.text, "is_math": s.is_math, "is_display": s.is_display, "start_at": s.start, "end_at": s.end}

    return per_page(texts, each, "segment_no bigint, segment string, is_math boolean, is_display boolean, start_at bigint, end_at bigint", keys)


def math_markup(texts: DataFrame, keys: tuple[str, ...], text: str = "text") -> DataFrame:
    """(marked, n_expressions): texts with formulas as delimited LaTeX; null stays null."""

    def each(row: Row) -> Iterator[Row]:
        source = row[text]
        yield {"marked": None if source is None else formulas.marked_up(source), "n_expressions": len(formulas.expressions(source or ""))}

    return per_page(texts, each, "marked string, n_expressions bigint", keys)


def vision_pages(replies: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(markdown, n_elements, n_images) of pages by a model's replies in `headlines`, `images` and `paragraphs`; null or unreadable
    replies have no elements."""

    def each(row: Row) -> Iterator[Row]:
        found = vision.distinct(vision.reading_order(vision.elements(row["headlines"], row["images"], row["paragraphs"])))
        yield {"markdown": vision.to_markdown(found), "n_elements": len(found), "n_images": sum(e["type"] == "image" for e in found)}

    return per_page(replies, each, "markdown string, n_elements bigint, n_images bigint", keys)


def hybrid_pages(pages: DataFrame, keys: tuple[str, ...], canvas: tuple[int, int] = (1200, 1650)) -> DataFrame:
    """(markdown, n_equations, n_images) of a page's `text` with the equations and photographs of a model's replies in `equations`
    and `photos`. Only garbled texts take equations, and those that find no place are dropped; images that are large enough on
    the canvas are referred to."""

    def each(row: Row) -> Iterator[Row]:
        text = row["text"] or ""
        found = vision.equations(row["equations"]) if row["garbled"] else []
        images = vision.image_regions(row["photos"])
        pictures = {i: "data:image/png;base64," + "A" * 100 for i, x in enumerate(images) if vision.crop(x["bounds"], *canvas)}
        shown, kept = vision.with_images(vision.with_equations(text, found, keep_rest=False), images, pictures)
        yield {"markdown": shown, "n_equations": len(found), "n_images": len(kept)}

    return per_page(pages, each, "markdown string, n_equations bigint, n_images bigint", keys)
