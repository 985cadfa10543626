"""Page layout: columns, blocks of lines, their classes, regions and reading order."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from itertools import groupby

#: Bins of a page's width in which lines are counted.
BINS = 50
#: Words that mark prose in a block.
PROSE_WORDS = frozenset(
    "the a an is are was were be been have has had do does did will would could should may might must shall can to of in for on with at by from as into through during before after and but or nor so yet both either neither "
    "not only also just than then now here there this that these those it its they their them he she his her we our you your who which what".split()
)
_LIST = re.compile(r"\s*([-•●○◦▪▸►◆✓✗★☆‣⁃∙]|[0-9]+[.)]\s)")
_CODE = re.compile(r"^\s*[{}()\[\]<>]\s*$|^\s*(if|else|for|while|return|function|def|class|import|from)\b|[{};]$|^\s{4}|[a-zA-Z_]\w*\s*\(|[a-zA-Z_]\w*\s*=\s*[^=]")
_NUMBER = re.compile(r"[0-9$€£%.,\-+()]+")


@dataclass
class Line:
    text: str
    y: float
    min_x: float
    max_x: float
    size: float = 12.0


@dataclass
class Block:
    lines: list[Line]

    @property
    def text(self) -> str:
        return "\n".join(x.text for x in self.lines)

    @property
    def size(self) -> float:
        return sum(x.size for x in self.lines) / len(self.lines)

    @property
    def box(self) -> tuple[float, float, float, float]:
        """x, y, width and height."""
        left, top = min(x.min_x for x in self.lines), min(x.y for x in self.lines)
        return left, top, max(x.max_x for x in self.lines) - left, max(x.y for x in self.lines) - top + self.size


@dataclass
class Column:
    x: float
    width: float
    blocks: list[Block]


@dataclass
class Region:
    kind: str
    blocks: list[Block]
    confidence: float
    column: int
    box: tuple[float, float, float, float] = field(default=(0, 0, 0, 0))


def line_of(chars: list[tuple[str, float]], y: float, min_x: float, max_x: float) -> Line:
    """A line of characters (char, size)."""
    return Line("".join(c for c, _ in chars), y, min_x, max_x, sum(s for _, s in chars) / len(chars) if chars else 12.0)


def blocks_of(lines: list[Line]) -> list[Block]:
    """Lines from top to bottom, cut at gaps of over 2.5 times the mean size of the two lines."""
    out: list[Block] = []
    for line in sorted(lines, key=lambda x: x.y):
        last = out[-1].lines[-1] if out else None
        if last is not None and line.y - last.y <= 2.5 * (last.size + line.size) / 2:
            out[-1].lines.append(line)
        else:
            out.append(Block([line]))
    return out


def columns_of(lines: list[Line], width: float) -> list[Column]:
    """Columns between gaps of the lines' coverage: runs of bins under a fifth of the mean, wider than 3 % of the page and closed by
    a covered bin. A column has a fifth of the page's width at least; lines belong where their middle is."""
    if not lines:
        return []
    step = width / BINS
    cover = [0] * BINS
    for x in lines:
        for i in range(max(int(x.min_x // step), 0), min(BINS - 1, int(x.max_x // step)) + 1):
            cover[i] += 1
    empty = [n < 0.2 * sum(cover) / BINS for n in cover]
    edges, at = [0.0], 0
    for is_gap, run in groupby(empty):
        n = len(list(run))
        if is_gap and at + n < BINS and n * step > 0.03 * width:
            edges.append((2 * at + n) / 2 * step)
        at += n
    edges.append(width)
    out = []
    for left, right in zip(edges, edges[1:]):
        own = [x for x in lines if left <= (x.min_x + x.max_x) / 2 < right]
        if own and right - left >= 0.2 * width:
            out.append(Column(left, right - left, blocks_of(own)))
    return out or [Column(0.0, width, blocks_of(lines))]


def is_list_block(block: Block) -> bool:
    return sum(_LIST.match(x.text) is not None for x in block.lines) >= 0.6 * len(block.lines)


def is_code_block(block: Block) -> bool:
    return sum(_CODE.search(x.text) is not None for x in block.lines) >= 0.5 * len(block.lines)


def is_heading_block(block: Block) -> bool:
    return len(block.lines) <= 3 and len(block.text) < 100 and not re.search("[.!?,;:]", block.text.strip())


def prose_score(block: Block) -> float:
    words = block.text.split()
    if not words:
        return 0.0
    per_sentence = len(words) / max(1, sum(bool(s.strip()) for s in re.split("[.!?]+", block.text)))
    common = sum(re.sub("[^a-z]", "", w.lower()) in PROSE_WORDS for w in words) / len(words)
    ended = sum(re.search(r"[.!?,;:][\s\"')\]]*$", x.text.strip()) is not None for x in block.lines)
    mean = sum(map(len, words)) / len(words)
    return 0.25 * (5 <= per_sentence <= 30) + 0.25 * (common > 0.15) + 0.15 * (common > 0.25) + 0.2 * (ended > 0.3 * len(block.lines)) + 0.15 * (4 <= mean <= 8)


def table_score(block: Block) -> float:
    cells = [[c for c in re.split(r"\s{2,}", x.text) if c.strip()] for x in block.lines]
    n = len(cells)
    short = sum(sum(len(c.strip()) <= 20 and " " not in c for c in row) >= 0.5 * len(row) for row in cells)
    numeric = sum(any(_NUMBER.fullmatch(c.strip()) for c in row) for row in cells)
    steady = sum(len(a) == len(b) >= 2 for a, b in zip(cells, cells[1:]))
    out = 0.4 * ("|" in block.text) + 0.25 * (short >= 0.4 * n) + 0.2 * (numeric >= 0.3 * n) + 0.15 * (steady >= 0.6 * n - 1) - 0.2 * (len(block.text) / max(1, n) > 100)
    return max(0.0, min(1.0, out))


def classify(block: Block) -> tuple[str, float]:
    """list, code, heading, prose or potential-table, with a confidence; what is neither clear prose nor clear table has 0.5."""
    for kind, test, sure in (("list", is_list_block, 0.85), ("code", is_code_block, 0.8), ("heading", is_heading_block, 0.9)):
        if test(block):
            return kind, sure
    prose, table = prose_score(block), table_score(block)
    if prose > 0.7 and table < 0.3:
        return "prose", prose
    if table > 0.6 and prose < 0.4:
        return "potential-table", table
    return ("prose" if prose >= table else "potential-table"), 0.5


def regions_of(columns: list[Column]) -> list[Region]:
    """Classified blocks by column and height; neighbours of one class are one region, whose confidence is averaged pair by pair.
    Prose on a page of several columns is prose-column."""
    out: list[Region] = []
    for i, column in enumerate(columns):
        for block in sorted(column.blocks, key=lambda b: b.box[1]):
            kind, sure = classify(block)
            kind = "prose-column" if kind == "prose" and len(columns) > 1 else kind
            last = out[-1] if out else None
            if last is not None and (last.kind, last.column) == (kind, i):
                (ax, ay, aw, ah), (bx, by, bw, bh) = last.box, block.box
                x, y = min(ax, bx), min(ay, by)
                last.box = x, y, max(ax + aw, bx + bw) - x, max(ay + ah, by + bh) - y
                last.confidence = (last.confidence + sure) / 2
                last.blocks.append(block)
            else:
                out.append(Region(kind, [block], sure, i, block.box))
    return out


def is_table_region(region: Region) -> bool:
    return region.kind == "potential-table" and region.confidence > 0.5


def is_column_prose(columns: list[Column], regions: list[Region]) -> bool:
    return len(columns) > 1 and any(r.kind == "prose-column" for r in regions)


def table_blocks(regions: list[Region]) -> list[Block]:
    return [b for r in regions if is_table_region(r) for b in r.blocks]


def reading_order(columns: list[Column]) -> str:
    return "\n\n".join(b.text for c in sorted(columns, key=lambda c: c.x) for b in sorted(c.blocks, key=lambda b: b.box[1]))
