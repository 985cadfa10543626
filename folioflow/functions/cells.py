"""Cells and lines in Python, for the operators that go through a page in order: the same tests as in `text`."""

from __future__ import annotations

import re

from .text import CELL_WORDS

_CORE = re.compile(r"^[()\[\]{}%$€£+-]+|[()\[\]{}%$€£+-]+$")


def is_short_token(cell: str) -> bool:
    t = cell.strip()
    return 0 < len(t) <= 24 and " " not in t and re.fullmatch(r"[0-9]*\.[0-9]+|[A-Za-z0-9]+", _CORE.sub("", t)) is not None


def is_numeric(cell: str) -> bool:
    t = re.sub(r"^[$€£¥₹]|[$€£¥₹]$", "", cell.strip().replace(",", "")).replace(".", "", 1).replace("%", "", 1)
    return re.fullmatch(r"[0-9]+|\(?[0-9]+\)?|-[0-9]+\)?", t) is not None and not (t[0].isdigit() and t.endswith(")"))


def is_sentence(cell: str) -> bool:
    return len(cell.split()) >= 5 and cell.strip()[-1] in ".!?…"


def is_prose_fragment(cell: str) -> bool:
    t, words = cell.strip(), cell.split()
    if len(t) > 60:
        return True
    common = sum(re.sub("[^a-z]", "", w.lower()) in CELL_WORDS for w in words)
    if len(words) >= 4 and len(t) > 40 and common >= 0.15 * len(words):
        return True
    return len(words) >= 5 and "A" <= t[0] <= "Z" and sum(map(len, words)) >= 3.5 * len(words)


def is_list_line(line: str) -> bool:
    return re.match(r"[-•◦*]\s|([0-9]+|[A-Za-z])[.)]\s", line.strip()) is not None


def is_code_block(lines: list[str]) -> bool:
    filled = [x.strip() for x in lines if x.strip()]

    def code(t: str) -> bool:
        solid = "".join(t.split())
        return bool(re.match("(def|class|for|while|if|import|const|let|var|function) ", t.lower())) or " -> " in t or (": " in t and "=" in t) or sum(c in "{}[]();<>/=*+-" for c in solid) >= 0.35 * len(solid)

    hits = sum(map(code, filled))
    return hits >= 2 and hits >= len(filled) / 2


def split_cells(line: str) -> list[str]:
    wide = re.split(r"[ \t]{3,}", line.rstrip())
    return wide if len(wide) > 1 else re.split(r"[ \t]{2,}", line.rstrip())


class Profile:
    """Counts, score and gate of a grid of cells; `grids.profile` gives the same of grids in a table."""

    def __init__(self, grid: list[list[str]]):
        cells = [c.strip() for row in grid for c in row if c.strip()]
        kinds = (is_short_token, is_numeric, is_sentence, is_prose_fragment)
        self.short, self.numeric, self.sentences, self.prose = (sum(map(kind, cells)) for kind in kinds)
        self.rows, self.cols, self.n = len(grid), max(map(len, grid), default=0), len(cells)
        self.mean, self.most = (sum(map(len, cells)) / len(cells), max(map(len, cells))) if cells else (0.0, 0)
        self.density = len(cells) / (self.rows * self.cols) if self.rows * self.cols else 0.0
        self.score = self._score(len({len(r) for r in grid}) == 1)

    def _score(self, even: bool) -> float:
        out = self.rows + 0.8 * self.cols
        if self.n:
            sentences, prose = self.sentences / self.n, self.prose / self.n
            out += (3 * self.short + 2 * self.numeric) / self.n
            out -= sentences * (4 if sentences > 0.8 else 2 if sentences > 0.4 else 0)
            out -= prose * (6 if prose > 0.5 else 3 if prose > 0.3 else 1.5 if prose > 0.15 else 0)
            out -= 5 * (max(sentences, prose) > 0.6 and self.short + self.numeric < 0.3 * self.n)
        out -= 4 if self.mean > 80 else 2 if self.mean > 50 else 0
        out -= 2 * (self.most > 100)
        return out + 2 * (self.rows >= 4 and self.cols >= 3 and self.prose < 0.3 * self.n) + 1.5 * even + (self.density >= 0.6)

    def tokens(self, share: float) -> bool:
        return self.short + self.numeric >= share * self.n

    def passes(self, bonus: float = 0.0) -> bool:
        return (
            self.rows >= 2 and self.cols >= 2 and self.n > 0 and self.density >= 0.25
            and (self.mean <= 60 or self.tokens(0.5)) and (self.most <= 80 or self.mean <= 40 or self.tokens(0.4))
            and (self.sentences < 0.4 * self.n or self.numeric >= 0.2 * self.n or self.short >= 0.3 * self.n)
            and (self.short >= 0.15 * self.n or self.numeric > 0 or (self.rows >= 4 and self.cols >= 3 and self.mean <= 30))
            and self.score + bonus >= 2
        )
