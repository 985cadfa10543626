"""Mathematics in running text: segments, their LaTeX, and whole texts with formulas marked up."""

from __future__ import annotations

import re
from dataclasses import dataclass

from ..functions import latex
from ..functions.text import PROSE_WORDS, STRONG

_SIGNS = STRONG[:-2]
_STRONG = frozenset(STRONG)
_SCRIPTS = "\u2080-\u209c\u2070-\u207f"
_FENCED = re.compile(r"\$\$[\s\S]+?\$\$|\$[^$\n]+?\$|\\\[[\s\S]+?\\\]|\\\([^)]+\\\)")
_SPAN = re.compile(rf"[A-Za-z0-9_]*[{re.escape(_SIGNS)}][A-Za-z0-9_\s+\-=<>^{{}}()]*[{re.escape(_SIGNS)}]?[A-Za-z0-9_]*")
_BONUSES = ((r"[0-9]+\s*/\s*[0-9]+", 0.05), (rf"[a-zA-Z][{_SCRIPTS}]+", 0.15), (r"(^|\s)[a-zA-Z]\s*=\s*[^=]", 0.1), ("sqrt|√", 0.15), ("sum|∑|int|∫", 0.2))
_PROSE = re.compile(rf"\b({'|'.join(PROSE_WORDS)})\b", re.I | re.A)


@dataclass
class Segment:
    text: str
    is_math: bool
    is_display: bool
    start: int

    @property
    def end(self) -> int:
        return self.start + len(self.text)


def strong_count(text: str) -> int:
    return sum(c in _STRONG for c in text)


def density(text: str) -> float:
    strong = strong_count(text)
    if not strong:
        return 0.0
    return min(1.0, (strong + 0.3 * sum(c in "=+*" for c in text)) / len(text) + sum(gain for pattern, gain in _BONUSES if re.search(pattern, text)))


def looks_like_prose(text: str) -> bool:
    t, words = text.strip(), text.split()
    points = (t[-1:] in (".", "!", "?")) + bool(_PROSE.search(t)) + (sum(map(len, words)) > 4 * len(words)) + (len(words) > 10)
    return len(t) >= 20 and len(words) >= 5 and points >= 2


def contains_math(text: str) -> bool:
    strong = strong_count(text)
    if not strong or len(text) < 50:
        return strong > 0
    return not (looks_like_prose(text) and density(text) < 0.3) and (density(text) > 0.15 or strong >= 3)


def is_display(text: str) -> bool:
    t = text.strip()
    if (t.startswith("$$") and t.endswith("$$")) or (t.startswith("\\[") and t.endswith("\\]")) or re.search(r"\\begin\{(equation|align|gather|multline|eqnarray|displaymath)\*?\}", t):
        return True
    special = re.search(r"[=≤≥≠≈≃⇒→⇔↦∝]|\\[dt]?frac", t) or re.search(r"∫|\\int|integral|∑|\\sum|summation|matrix|\\begin\{", t, re.I)
    return ("\n" in t and density(t) > 0.35) or (len(t) < 200 and density(t) > 0.4 and special is not None)


def inline_spans(text: str) -> list[tuple[int, int]]:
    """Stretches of a sentence that are formulas: around a sign, short, and dense enough; touching ones are one."""
    out: list[list[int]] = []
    for m in _SPAN.finditer(text):
        own = m.group().strip()
        words = own.split()
        if len(own) > 80 or len(words) > 6 or (own.endswith(".") and len(words) > 2) or density(own) < 0.2:
            continue
        if out and m.start() <= out[-1][1]:
            out[-1][1] = max(out[-1][1], m.end())
        else:
            out.append([m.start(), m.end()])
    return [(a, b) for a, b in out]


def _plain_segments(text: str, at: int) -> list[Segment]:
    plain, strong = [Segment(text, False, False, at)], strong_count(text)
    if not text.strip() or not strong:
        return plain
    dense = density(text)
    if looks_like_prose(text) and dense < 0.4:
        out, last = [], 0
        for a, b in inline_spans(text):
            out += [Segment(text[last:a], False, False, at + last), Segment(text[a:b], True, False, at + a)]
            last = b
        return [s for s in (*out, Segment(text[last:], False, False, at + last)) if s.text]
    if dense < 0.12 + 0.13 * min(1.0, len(text) / 50) or (len(text) > 100 and strong < 3):
        return plain
    return [Segment(text, True, is_display(text), at)]


def segments(text: str) -> list[Segment]:
    """The text cut into delimited formulas, formulas found by their characters, and the rest."""
    out, last = [], 0
    for m in _FENCED.finditer(text):
        out += _plain_segments(text[last : m.start()], last) if m.start() > last else []
        out.append(Segment(m.group(), True, m.group().startswith(("$$", "\\[")), m.start()))
        last = m.end()
    return out + (_plain_segments(text[last:], last) if last < len(text) else [])


def to_latex(text: str) -> str:
    for mark, (chars, plain) in (("^", latex.RAISED), ("_", latex.LOWERED)):
        known = dict(zip(chars, plain))
        span = "\u2070\u00b9\u00b2\u00b3\u2071\u2074-\u207f" if mark == "^" else "\u2080-\u209c"
        text = re.sub(f"[{span}]+", lambda m, k=known, s=mark: f"{s}{{{''.join(k.get(x, '') for x in m.group())}}}", text)
    return " ".join("".join(latex.COMMANDS[c] + " " if c in latex.COMMANDS else c for c in text).split())


def normal_latex(text: str) -> str:
    text = re.sub(r"\s*([=+-])\s*", r" \1 ", text)
    return " ".join(re.sub(r"([0-9]+)\s*/\s*([0-9]+)", r"\\frac{\1}{\2}", text).split())


def marked_up(text: str) -> str:
    """The text with formulas as delimited LaTeX; signs elsewhere become commands."""
    out = []
    for s in segments(text):
        if s.is_math and not s.text.strip().startswith(("$", "\\(", "\\[")):
            formula = normal_latex(to_latex(s.text))
            out.append(f"$$\n{formula}\n$$" if s.is_display else f"${formula}$")
        else:
            out.append(to_latex(s.text) if not s.is_math and strong_count(s.text) else s.text)
    return "".join(out)


def expressions(text: str) -> list[str]:
    return [s.text for s in segments(text) if s.is_math]
