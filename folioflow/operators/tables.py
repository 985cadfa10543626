"""Table detectors over the lines or positioned cells of a page, and their Markdown."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from dataclasses import dataclass
from itertools import groupby

from ..functions import cells as C


@dataclass
class Line:
    text: str
    y: float = 0.0
    x: float = 0.0
    size: float = 12.0


@dataclass
class Table:
    """A detected table: its rows (the first is the header), column alignments, confidence, and first and last line."""

    rows: list[list[str]]
    alignments: list[str]
    confidence: float
    start: int
    end: int
    kind: str


def alignments(grid: list[list[str]], share: float = 0.7, header: bool = True) -> list[str]:
    """right for columns of which more than `share` of the filled cells are numeric; a header row doesn't count."""
    out = []
    for column in zip(*grid[header:]):
        filled = [c for c in column if c.strip()]
        out.append("right" if filled and sum(map(C.is_numeric, filled)) / len(filled) > share else "left")
    return out or ["left"] * len(grid[0])


def _table(grid: list[list[str]], start: int, end: int, kind: str, bonus: float = 0.0) -> Table | None:
    found = C.Profile(grid)
    return Table(grid, alignments(grid), min(1.0, (found.score + bonus) / 10), start, end, kind) if found.passes(bonus) else None


def never_table(lines: list[str]) -> bool:
    n = len(lines)
    if n < 2 or (n <= 3 and all(len(x.strip()) <= 40 for x in lines) and not any(len(C.split_cells(x)) > 1 for x in lines)):
        return True
    listed, starred = sum(map(C.is_list_line, lines)), sum(x.strip()[:1] in ("•", "◦", "-", "*") for x in lines if x.strip())
    return listed >= max(2, 0.8 * n) or starred >= 0.9 * n or C.is_code_block(lines)


def bordered_tables(lines: list[str]) -> list[Table]:
    """Runs of two or more lines with pipes, or of separators alone."""
    border = lambda t: "|" in t or "¦" in t or ("-" in t and re.fullmatch(r"[\s+|=:¦-]+", t) is not None)
    out = []
    for is_border, run in groupby(enumerate(lines), lambda x: border(x[1])):
        places = list(run)
        if is_border and len(places) > 1 and (found := _parse_bordered([t for _, t in places], places[0][0])):
            out.append(found)
    return out


def _parse_bordered(lines: list[str], start: int) -> Table | None:
    piped = [x for x in (t.replace("¦", "|") for t in lines) if "|" in x]
    if len(piped) < 2 or max(x.count("|") for x in piped) < 2:
        return None
    grid = []
    for x in piped:
        if re.fullmatch(r"[\s|:-]+", x):
            continue
        row = [c.strip() for c in x.split("|")]
        row = row[not row[0] :]
        row = row[: len(row) - (row[-1:] == [""])]
        if len(row) > 1:
            grid.append(row)
    width = max(map(len, grid), default=0)
    grid = [row + [""] * (width - len(row)) for row in grid]
    return _table(grid, start, start + len(lines) - 1, "bordered", 2.0) if len(grid) > 1 else None


def ascii_tables(lines: list[str]) -> list[Table]:
    """One table at most: from the first to the last line with gaps, if most of these have the same number of cells."""
    if len(lines) < 2 or C.is_code_block(lines):
        return []
    split = [C.split_cells(x) for x in lines]
    rows = [i for i, x in enumerate(split) if len(x) > 1]
    if len(rows) < 2:
        return []
    (width, many), *_ = Counter(len(split[i]) for i in rows).most_common()  # of equal ones the first seen
    if many < max(2, 0.6 * len(rows)):
        return []
    grid = []
    for row in split[rows[0] : rows[-1] + 1]:
        row = [c.strip() for c in [*row[: width - 1], " ".join(row[width - 1 :])]] if len(row) > width else [c.strip() for c in row]
        row += [""] * (width - len(row))
        if any(row):
            grid.append(row)
    found = _table(grid, rows[0], rows[-1], "ascii") if len(grid) > 1 else None
    return [found] if found else []


def rows_by_height(lines: list[Line]) -> list[list[Line]]:
    """Lines at about the height of the first of their row, from left to right."""
    out: list[list[Line]] = []
    for line in sorted(lines, key=lambda x: x.y):
        head = out[-1][0] if out else None
        if head is not None and abs(line.y - head.y) < (line.size + (head.size or 12)) / 4:
            out[-1].append(line)
        else:
            out.append([line])
    return [sorted(row, key=lambda x: x.x) for row in out]


def vertical_tables(lines: list[Line]) -> list[Table]:
    """Runs of three or more rows with equally many parts and no list marks or code."""
    rows = rows_by_height(lines)
    listed = [any(C.is_list_line(x.text) for x in row) for row in rows]
    code = [C.is_code_block([x.text for x in row]) for row in rows]
    out, at = [], 0
    while len(rows) >= 3 and at < len(rows):
        end = at + 1
        if len(rows[at]) > 1 and not listed[at]:
            while end < len(rows) and len(rows[end]) == len(rows[at]) and not listed[end] and not code[end]:
                end += 1
        found = _table([[x.text.strip() for x in row] for row in rows[at:end]], 0, end - at - 1, "vertical") if end - at >= 3 else None
        at = end if found else at + 1
        out += [found] if found else []
    return out


def detect_tables(lines: list[Line]) -> list[Table]:
    """All three detectors, in this order of precedence; a table that shares lines with an earlier one is left out."""
    texts = [x.text for x in lines]
    if never_table(texts):
        return []
    out = bordered_tables(texts)
    for found in (*ascii_tables(texts), *vertical_tables(lines)):
        if not any(found.start <= x.end and found.end >= x.start for x in out):
            out.append(found)
    return sorted(out, key=lambda x: x.start)


def to_markdown(table: Table) -> str:
    widths = [min(max(3, *map(len, column)), 50) for column in zip(*table.rows)]
    pad = {"left": str.ljust, "right": str.rjust, "center": lambda t, w: " " * ((w - len(t)) // 2) + t + " " * (w - len(t) - (w - len(t)) // 2)}
    rule = {"left": lambda w: "-" * w, "right": lambda w: "-" * (w - 1) + ":", "center": lambda w: ":" + "-" * (w - 2) + ":"}
    line = lambda parts: "| " + " | ".join(parts) + " |"
    safe = lambda t: t.replace("|", "\\|").replace("\n", " ").strip()
    rows = [line(pad[a](safe(c), w) for c, a, w in zip(row, table.alignments, widths)) for row in table.rows]
    return "\n".join([rows[0], line(rule[a](w) for a, w in zip(table.alignments, widths)), *rows[1:]])


# Positioned cells.


@dataclass
class Cell:
    text: str
    x: float
    width: float = 0.0


def cells_of(chars: list[tuple[str, float, float]], gap: float = 2.5) -> list[Cell]:
    """Characters (char, x, size) of a line as cells: one ends before a gap of more than `gap` characters' widths."""
    out: list[list[tuple[str, float, float]]] = []
    for char in sorted(chars, key=lambda c: c[1]):
        if out and char[1] - out[-1][-1][1] <= gap * 0.6 * out[-1][-1][2]:
            out[-1].append(char)
        else:
            out.append([char])
    last = len(out) - 1
    return [Cell("".join(c[0] for c in part), part[0][1], part[-1][1] - part[0][1] + 0.6 * part[0 if i == last else -1][2]) for i, part in enumerate(out)]


def column_places(places: list[float], tolerance: float = 15) -> list[float]:
    """Centres of clusters of places; a cluster's reach grows with its size."""
    out: list[tuple[float, int]] = []
    for x in sorted(places):
        if out and x - out[-1][0] <= tolerance * out[-1][1]:
            centre, n = out[-1]
            out[-1] = ((centre * n + x) / (n + 1), n + 1)
        else:
            out.append((x, 1))
    return [centre for centre, _ in out]


def nearest(centres: list[float], x: float) -> int:
    """The nearest centre, the left one of two."""
    at = bisect_right(centres, x)
    return min(range(max(at - 1, 0), min(at + 1, len(centres))), key=lambda i: (abs(x - centres[i]), i))


def positioned_grid(rows: list[list[Cell]], centres: list[float]) -> list[list[str]]:
    out = []
    for row in rows:
        parts: list[list[str]] = [[] for _ in centres]
        for cell in row:
            own = parts[nearest(centres, cell.x)]
            if cell.text.strip() or (own and own[0]):
                own.append(cell.text.strip())
        out.append([" ".join(x) for x in parts])
    return out


def positioned_tables(rows: list[tuple[float, list[Cell]]]) -> list[Table]:
    """Tables among rows (y, cells): a region starts at a row of two cells or more and ends at a gap of over 50 or, below a row of
    over three cells, at a row without two."""
    rows = sorted(rows, key=lambda r: r[0])
    out, at = [], 0
    while len(rows) > 1 and at < len(rows):
        end = at + 1
        if len(rows[at][1]) > 1:
            while end < len(rows) and rows[end][0] - rows[end - 1][0] <= 50 and not (len(rows[end][1]) < 2 and len(rows[at][1]) - len(rows[end][1]) > 2):
                end += 1
            wide = [cells for _, cells in rows[at:end] if len(cells) > 1]
            if len(wide) > 1 and (found := _positioned(wide, at, end - 1)):
                out.append(found)
        at = end
    return out


def _positioned(rows: list[list[Cell]], start: int, end: int) -> Table | None:
    centres = column_places([c.x for row in rows for c in row])
    grid = positioned_grid(rows, centres)
    found = C.Profile(grid)
    wordy = found.sentences > 0 and found.sentences >= 0.3 * found.n and not found.tokens(0.4)
    if len(centres) < 2 or not found.passes() or wordy or (found.mean > 50 and not found.tokens(0.5)):
        return None
    return Table(grid, alignments(grid, 0.5, False), min(1.0, max(0.4, found.score / 10)), start, end, "vertical")
