"""Markdown of a page from its structured text: headings, lists and paragraphs, then tables and formulas."""

from __future__ import annotations

import re
from dataclasses import dataclass
from typing import Any

from ..functions.text import BULLETS, OPEN_WORDS
from . import formulas, layout, tables

_CLOSING = "\"'”“’‘)"


@dataclass
class Item:
    """A piece of text of a block: `box` is the block's y and height."""

    text: str
    level: int
    bold: bool
    italic: bool
    listed: bool
    box: tuple[float, float]


def ends_terminal(text: str) -> bool:
    t = text.strip()
    return t[-1:] in ('"', "”") or t.rstrip(_CLOSING)[-1:] in (".", "!", "?", ":")


def ends_complete(text: str) -> bool:
    t = text.strip()
    return t.rstrip(_CLOSING)[-1:] in (".", "!", "?") or (t.split() or [""])[-1].lower() not in OPEN_WORDS


def continues(text: str) -> bool:
    return re.match(r"""[a-z,;:\-–—"”’)\]]""", text.strip()) is not None


def has_label(text: str) -> bool:
    return re.match(r"[A-Z][A-Za-z]*(\s+[A-Z][A-Za-z]*)*:\s", text.strip()) is not None


def _capital(text: str) -> bool:
    return "A" <= text.strip()[:1] <= "Z"


def _size(line: dict[str, Any]) -> float:
    return (line.get("font") or {}).get("size") or 12


def _styled(line: dict[str, Any], kind: str, key: str) -> bool:
    font = line.get("font") or {}
    return font.get(key) == kind or kind in (font.get("name") or "").lower()


def _box(block: dict[str, Any]) -> tuple[float, float]:
    box = block.get("bbox") or {}
    return box.get("y") or 0, box.get("h") or 0


def body_size(lines: list[dict[str, Any]]) -> float:
    """The size, in halves, of most characters; of equal ones the first seen."""
    counts: dict[float, int] = {}
    for line in lines:
        size = int(_size(line) * 2 + 0.5) / 2
        counts[size] = counts.get(size, 0) + len(line["text"].strip())
    return max(counts, key=counts.get, default=12.0)


def line_height(block: dict[str, Any]) -> float:
    """Mean distance of a block's lines; the height of a single line."""
    lines = block["lines"]
    if len(lines) < 2:
        return _box(block)[1] or 12
    gaps = [g for a, b in zip(lines, lines[1:]) if (g := (b.get("y") or 0) - (a.get("y") or 0)) > 0]
    return sum(gaps) / len(gaps) if gaps else 1.2 * _size(lines[0])


def heading_level(size: float, body: float) -> int:
    return next((n for n, factor in ((1, 1.5), (2, 1.25), (3, 1.1)) if size >= body * factor), 0)


def _items(block: dict[str, Any], body: float) -> list[Item]:
    """A block whose first line is a list item gives an item a line, another a piece for each group of lines."""
    lines = [x for x in block["lines"] if (x.get("text") or "").strip()]
    texts = [x["text"].strip() for x in lines]
    if not texts:
        return []
    box = _box(block)
    bullet, number = re.compile(rf"[{BULLETS}]\s*"), re.compile(r"([0-9]+)[.)]\s+")
    if bullet.match(texts[0]) or number.match(texts[0]):
        return [Item(number.sub(r"\1. ", bullet.sub("- ", t, count=1) if bullet.match(t) else t, count=1) if bullet.match(t) or number.match(t) else t, 0, False, False, True, box) for t in texts]
    weights = [len(x["text"]) for x in lines]
    share = lambda kind, key: sum(w for x, w in zip(lines, weights) if _styled(x, kind, key)) > 0.5 * sum(weights)
    level = heading_level(sum(_size(x) * w for x, w in zip(lines, weights)) / sum(weights), body)
    groups = [[texts[0]]]
    for before, now in zip(texts, texts[1:]):
        if has_label(now) or ((ends_complete(before) or ends_terminal(before)) and _capital(now)):
            groups.append([now])
        else:
            groups[-1].append(now)
    return [Item(" ".join(g), level, share("bold", "weight"), share("italic", "style"), False, box) for g in groups]


def belongs(before: Item, now: Item, height: float) -> bool:
    """Whether a piece continues the paragraph of the one before."""
    if has_label(now.text) or ((ends_terminal(before.text) or ends_complete(before.text)) and _capital(now.text)):
        return False
    return continues(now.text) or (not ends_complete(before.text) and now.box[0] - sum(before.box) < 1.5 * height)


def paragraphs(blocks: list[dict[str, Any]]) -> list[str]:
    """Headings, list items and paragraphs of a page's text blocks, from top to bottom; a paragraph is styled by its first piece."""
    blocks = sorted((b for b in blocks if b.get("type") == "text" and b.get("lines")), key=lambda b: _box(b)[0])
    body = body_size([x for b in blocks for x in b["lines"] if (x.get("text") or "").strip()])
    height = sum(map(line_height, blocks)) / len(blocks) if blocks else 12
    out: list[list[Item]] = []
    for item in (i for b in blocks for i in _items(b, body)):
        last = out[-1][-1] if out else None
        if last is not None and not (last.listed or last.level or item.listed or item.level) and belongs(last, item, height):
            out[-1].append(item)
        else:
            out.append([item])
    return [_shown(run) for run in out]


def _shown(run: list[Item]) -> str:
    first, text = run[0], " ".join(i.text for i in run)
    if first.level:
        return f"{'#' * first.level} {text}"
    mark = "" if first.listed else "*" * (2 * first.bold + first.italic)
    return f"{mark}{text}{mark}"


def page_tables(blocks: list[dict[str, Any]], lines: list[layout.Line], rows: list[tuple[float, list[tables.Cell]]], width: float) -> list[tables.Table]:
    """Tables of a page: in its table regions alone where prose runs in columns, else by positions, else by its lines."""
    columns = layout.columns_of(lines, width)
    regions = layout.regions_of(columns)
    if lines and layout.is_column_prose(columns, regions):
        own = [[tables.Line(x.text, x.y, x.min_x, x.size) for b in r.blocks for x in b.lines] for r in regions if layout.is_table_region(r)]
        return [t for part in own for t in tables.detect_tables(part)]
    if found := tables.positioned_tables(rows):
        return found
    ordered = sorted((b for b in blocks if b.get("type") == "text" and b.get("lines")), key=lambda b: _box(b)[0])
    texts = [tables.Line(x["text"], x.get("y") or _box(b)[0], x.get("x") or (b.get("bbox") or {}).get("x") or 0, _size(x)) for b in ordered for x in b["lines"] if (x.get("text") or "").strip()]
    return tables.detect_tables(texts)


def page_markdown(blocks: list[dict[str, Any]], lines: list[layout.Line] = (), rows: list[tuple[float, list[tables.Cell]]] = (), width: float = 612, detect_tables: bool = True, detect_math: bool = True, preserve_layout: bool = True) -> str:
    """The page's Markdown. Tables of over 0.5 confidence follow the text, those of under three rows only if it has no pipe."""
    text = "\n\n".join(paragraphs(blocks))
    for table in page_tables(blocks, list(lines), list(rows), width) if detect_tables else ():
        if table.confidence > 0.5 and ("|" not in text or len(table.rows) >= 3):
            text += "\n\n" + tables.to_markdown(table)
    if detect_math and formulas.contains_math(text):
        text = formulas.marked_up(text)
    return (text if preserve_layout else re.sub(r"\n{3,}", "\n\n", text)).strip()
