"""Mathematical characters as LaTeX commands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The LaTeX of each Greek letter and mathematical symbol; a space follows each.
COMMANDS = {
    "α": r"\alpha", "β": r"\beta", "γ": r"\gamma", "δ": r"\delta", "ε": r"\epsilon", "ζ": r"\zeta", "η": r"\eta", "θ": r"\theta", "ι": r"\iota", "κ": r"\kappa", "λ": r"\lambda", "μ": r"\mu",
    "ν": r"\nu", "ξ": r"\xi", "ο": "o", "π": r"\pi", "ρ": r"\rho", "ς": r"\varsigma", "σ": r"\sigma", "τ": r"\tau", "υ": r"\upsilon", "φ": r"\phi", "χ": r"\chi", "ψ": r"\psi", "ω": r"\omega",
    "Α": "A", "Β": "B", "Γ": r"\Gamma", "Δ": r"\Delta", "Ε": "E", "Ζ": "Z", "Η": "H", "Θ": r"\Theta", "Ι": "I", "Κ": "K", "Λ": r"\Lambda", "Μ": "M",
    "Ν": "N", "Ξ": r"\Xi", "Ο": "O", "Π": r"\Pi", "Ρ": "P", "Σ": r"\Sigma", "Τ": "T", "Υ": r"\Upsilon", "Φ": r"\Phi", "Χ": "X", "Ψ": r"\Psi", "Ω": r"\Omega",
    "ϑ": r"\vartheta", "ϕ": r"\varphi", "ϖ": r"\varpi", "ϱ": r"\varrho", "ϵ": r"\varepsilon",
    "≠": r"\neq", "≤": r"\leq", "≥": r"\geq", "≪": r"\ll", "≫": r"\gg", "≈": r"\approx", "≡": r"\equiv", "∼": r"\sim", "≅": r"\cong", "∝": r"\propto",
    "×": r"\times", "÷": r"\div", "±": r"\pm", "∓": r"\mp", "⋅": r"\cdot", "∗": r"\ast", "∘": r"\circ",
    "∈": r"\in", "∉": r"\notin", "∋": r"\ni", "⊂": r"\subset", "⊃": r"\supset", "⊆": r"\subseteq", "⊇": r"\supseteq", "∪": r"\cup", "∩": r"\cap", "∅": r"\emptyset",
    "∧": r"\land", "∨": r"\lor", "¬": r"\neg", "⇒": r"\Rightarrow", "⇐": r"\Leftarrow", "⇔": r"\Leftrightarrow", "∀": r"\forall", "∃": r"\exists", "∄": r"\nexists",
    "∂": r"\partial", "∞": r"\infty", "∇": r"\nabla", "∫": r"\int", "∬": r"\iint", "∭": r"\iiint", "∮": r"\oint", "∑": r"\sum", "∏": r"\prod", "∐": r"\coprod", "√": r"\sqrt", "∛": r"\sqrt[3]", "∜": r"\sqrt[4]",
    "→": r"\rightarrow", "←": r"\leftarrow", "↔": r"\leftrightarrow", "↑": r"\uparrow", "↓": r"\downarrow", "↦": r"\mapsto", "°": r"^\circ", "Ω": r"\Omega", "Å": r"\text{\AA}", "ℏ": r"\hbar", "ℓ": r"\ell", "ℜ": r"\Re", "ℑ": r"\Im", "ℵ": r"\aleph",
    "⟨": r"\langle", "⟩": r"\rangle", "⌈": r"\lceil", "⌉": r"\rceil", "⌊": r"\lfloor", "⌋": r"\rfloor", "⋯": r"\cdots", "⋮": r"\vdots", "⋱": r"\ddots", "…": r"\ldots",
    "′": "'", "″": "''", "‴": "'''",
}
#: Raised and lowered characters with what they stand for. The last two lowered ones stand for nothing and vanish.
RAISED = ("⁰¹²³⁴⁵⁶⁷⁸⁹⁺⁻⁼⁽⁾ⁿⁱ", "0123456789+-=()ni")
LOWERED = ("₀₁₂₃₄₅₆₇₈₉₊₋₌₍₎ₐₑₒₓₕₖₗₘₙₚₛₜ₏ₔ", "0123456789+-=()aeoxhklmnpst")


def to_latex(text: Column) -> Column:
    """Commands for Greek letters and symbols, runs of raised or lowered characters in ^{} or _{}, white space as single spaces, trimmed.

    Null stays null. One map lookup for each command and each stretch between commands, in place of a replacement of the
    whole text for each entry.
    """
    runs = F.regexp_replace(F.regexp_replace(text, f"([{RAISED[0]}]+)", r"^{$1}"), f"([{LOWERED[0]}]+)", "_{$1}")
    plain = F.translate(F.translate(runs, *RAISED), *LOWERED)
    names = F.create_map(*[F.lit(x) for a, b in COMMANDS.items() for x in (a, b + " ")])
    marks = "".join(COMMANDS)
    parts = F.regexp_extract_all(plain, F.lit(f"[{marks}]|[^{marks}]+"), F.lit(0))
    mapped = F.array_join(F.transform(parts, lambda c: F.coalesce(F.try_element_at(names, c), c)), "")
    touched = F.when(plain.rlike(f"[{marks}]"), mapped).otherwise(plain)
    return F.regexp_replace(F.regexp_replace(touched, r"[\s ﻿\p{Z}]+", " "), "^ | $", "")
