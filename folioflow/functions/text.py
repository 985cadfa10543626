"""Line predicates and string functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import latex

#: White space as the documents' tools see it, for use in a pattern.
WS = r"[\t-\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
BULLETS = "•‣◦⁃∙●○"
#: Words after which a thought is not complete.
OPEN_WORDS = tuple("the a an and or but in on at to for of with that this is are was were be been being have has had do does did will would could should may might must shall can by from into through during before after above below between under over such as if when where while although because since unless whether which who whom whose their its his her our your my these those".split())
#: Words that mark prose in a table cell.
CELL_WORDS = tuple("the a an is are was were be been have has had to of in for on with at by from that this and or but we it as which".split())
#: Words that mark prose beside mathematics.
PROSE_WORDS = tuple("the a an is are was were has have had to of in for on with at by from that this and or but".split())
#: Greek letters with a subscript iota, small and capital: in Unicode's simple case mapping each is one character.
_IOTA = "".join(chr(x) for y in (0x1F80, 0x1F90, 0x1FA0) for x in range(y, y + 8)) + "\u1FB3\u1FC3\u1FF3", "".join(chr(x) for y in (0x1F88, 0x1F98, 0x1FA8) for x in range(y, y + 8)) + "\u1FBC\u1FCC\u1FFC"
#: Letters whose case mapping is newer than the SQL engine's; it leaves them as they are.
_NEWER_SMALL = "\u019B\u0264\u1C8A\uA7CD\uA7DB" + "".join(map(chr, range(0x10D70, 0x10D86)))
_NEWER_LARGE = "\u1C89\uA7CB\uA7CC\uA7DA\uA7DC" + "".join(map(chr, range(0x10D50, 0x10D66)))


def trim(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{WS}+|{WS}+\z", "")


def upper_letter(c: Column) -> Column:
    """A single character in upper case as SQL has it: one character for one, so ß gives ẞ and not SS, and ligatures stay."""
    one = F.translate(c, "ß" + _IOTA[0], "ẞ" + _IOTA[1])
    return F.when((F.length(F.upper(one)) == 1) & ~F.lit(_NEWER_SMALL).contains(one), F.upper(one)).otherwise(one)


def lower(c: Column) -> Column:
    """Lower case as SQL has it: one character for one wherever it stands, so a final Σ gives σ, and İ gives i."""
    plain = F.translate(c, "Σİ", "σi")
    each = F.array_join(F.transform(F.split(plain, ""), lambda x: F.when(F.lit(_NEWER_LARGE).contains(x), x).otherwise(F.lower(x))), "")
    return F.when(plain.rlike(f"[{_NEWER_LARGE}]"), each).otherwise(F.lower(plain))


def list_kind(c: Column) -> Column:
    """'bullet', 'number' or null."""
    return F.when(c.rlike(rf"^[{BULLETS}]{WS}*"), "bullet").when(c.rlike(rf"^[0-9]+[.)]{WS}+"), "number")


def list_content(c: Column) -> Column:
    return F.when(c.rlike(rf"^[{BULLETS}]"), F.regexp_replace(c, rf"^[{BULLETS}]{WS}*", "")).otherwise(c)


def ends_terminal(c: Column) -> Column:
    return trim(c).rlike(r"""([.!?:]["'”’)]*|["”])\z""")


def starts_as_continuation(c: Column) -> Column:
    return trim(c).rlike(r"""^[a-z,;:–—"'”’)\]-]""")


def has_label(c: Column) -> Column:
    return trim(c).rlike(rf"^[A-Z][A-Za-z]*({WS}+[A-Z][A-Za-z]*)*:{WS}")


def ends_complete_thought(c: Column) -> Column:
    last = F.lower(F.element_at(F.split(trim(c), rf"{WS}+"), -1))
    return trim(c).rlike(r"""[.!?]["'”’)]*\z""") | ~last.isin(*OPEN_WORDS)


def list_like(c: Column) -> Column:
    return trim(c).rlike(rf"^([-•◦*]{WS}|([0-9]+|[A-Za-z])[.)]{WS}+)")


def dehyphenate(c: Column) -> Column:
    """Join words that a hyphen splits over a line end."""
    return F.regexp_replace(c, rf"([A-Za-z0-9_])-{WS}*\n{WS}*([A-Za-z0-9_])", "$1$2")


def dehyphenate_all(c: Column) -> Column:
    """The same, then soft hyphens go and en dashes join as well."""
    plain = F.regexp_replace(dehyphenate(c), "\u00AD", "")
    return F.regexp_replace(plain, rf"([A-Za-z0-9_])–{WS}*\n{WS}*([A-Za-z0-9_])", "$1$2")


def comparable(c: Column) -> Column:
    """Digits as #, one space between words, lower case."""
    return F.lower(trim(F.regexp_replace(F.regexp_replace(c, "[0-9]+", "#"), rf"{WS}+", " ")))


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of the sets of words."""
    x, y = F.split(F.lower(a), rf"{WS}+"), F.split(F.lower(b), rf"{WS}+")
    return F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))


def collapse_newlines(c: Column) -> Column:
    return trim(F.regexp_replace(c, r"\n{3,}", "\n\n"))


def plain_markdown(c: Column, preserve_layout: bool = False) -> Column:
    """Trimmed lines with Markdown bullets and numbers; runs of blank lines become one unless the layout is preserved."""
    line = lambda s: F.regexp_replace(F.regexp_replace(trim(s), rf"^[{BULLETS}]{WS}*", "- "), rf"^([0-9]+)[.)]{WS}+", r"$1. ")
    whole = F.array_join(F.transform(F.split(c, "\n"), line), "\n")
    return trim(whole) if preserve_layout else collapse_newlines(whole)


def file_size(n: Column) -> Column:
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1024 * 1024, F.format_string("%.1f KB", F.round(n / 1024, 1))).otherwise(F.format_string("%.1f MB", F.round(n / (1024 * 1024), 1)))


def markdown_name(c: Column) -> Column:
    return F.regexp_replace(c, r"(?i)\.pdf\z", ".md")


def split_cells(c: Column) -> Column:
    """Cells of a line: parts between three or more blanks, or two or more if there are none; trailing space is no part."""
    bare = F.regexp_replace(c, rf"{WS}+\z", "")
    wide = F.split(bare, r"[ \t]{3,}", -1)
    return F.when(bare == "", F.array(F.lit(""))).when(F.size(wide) >= 2, wide).otherwise(F.split(bare, r"[ \t]{2,}", -1))


def table_likelihood(c: Column) -> Column:
    """Score from 0 to 1 that a line belongs to a table, in tenths."""
    parts = F.size(split_cells(c))
    tenths = F.when(c.contains("|"), 3).otherwise(0) + F.when(parts >= 2, 2).otherwise(0) + F.when(parts >= 4, 1).otherwise(0)
    tenths = tenths + F.when(F.regexp_count(c, F.lit("[0-9]+([,.0-9]*)?")) >= 3, 2).otherwise(0) + F.when(c.rlike(rf"\t|{WS}{{3}}"), 1).otherwise(0) + F.when(c.rlike("[$€£%]"), 1).otherwise(0)
    return F.least(tenths, F.lit(10)) / 10


def is_prose_fragment(c: Column) -> Column:
    """Whether a cell is a piece of prose: long, or of several words with common ones among them, or like a sentence's head."""
    t = trim(c)
    w = F.split(t, rf"{WS}+")
    common = F.size(F.filter(w, lambda x: F.regexp_replace(F.lower(x), "[^a-z]", "").isin(*CELL_WORDS)))
    letters = F.length(F.regexp_replace(t, WS, ""))
    head = (F.size(w) >= 5) & t.rlike("^[A-Z]") & (letters >= 3.5 * F.size(w))
    return (t != "") & ((F.length(t) > 60) | ((F.size(w) >= 4) & (F.length(t) > 40) & (common >= F.size(w) * 0.15)) | head)


def is_code_line(c: Column) -> Column:
    """Whether a line looks like source code: a keyword, an arrow, an annotated assignment, or over a third of symbols."""
    t = trim(c)
    solid = F.regexp_replace(t, WS, "")
    symbols = F.length(solid) - F.length(F.translate(solid, "{}[]();<>/=*+-", ""))
    return F.lower(t).rlike("^(def|class|for|while|if|import|const|let|var|function) ") | t.contains(" -> ") | (t.contains(": ") & t.contains("=")) | ((solid != "") & (symbols >= 0.35 * F.length(solid)))


def is_code_block(lines: Column) -> Column:
    """Whether at least two of an array's lines, and half of those that aren't blank, look like code."""
    filled = F.filter(lines, lambda x: trim(x) != "")
    hits = F.size(F.filter(filled, is_code_line))
    return (hits >= 2) & (hits >= F.size(filled) / 2)


def never_table(lines: Column) -> Column:
    """Whether an array of lines is plainly no table: a single line, few short ones without gaps, a list, or code."""
    n = F.size(lines)
    short = (n <= 3) & F.forall(lines, lambda x: F.length(trim(x)) <= 40) & ~F.exists(lines, lambda x: F.size(split_cells(x)) >= 2)
    listed = F.size(F.filter(lines, list_like))
    starred = F.size(F.filter(lines, lambda x: trim(x).rlike("^[•◦*-]")))
    return (n < 2) | short | ((listed >= 2) & (listed >= 0.8 * n)) | (starred >= 0.9 * n) | is_code_block(lines)


def heading_level(size: Column, body: Column) -> Column:
    """1 to 3 for sizes from 1.5, 1.25 and 1.1 times the body's, else 0."""
    return F.when(size >= body * 1.5, 1).when(size >= body * 1.25, 2).when(size >= body * 1.1, 3).otherwise(0)


def format_stats(words: Column, headings: Column, tables: Column, items: Column, images: Column, pages: Column) -> Column:
    """The counts that aren't zero, as text."""
    many = lambda n, name: F.when(n > 0, F.concat(n.cast("string"), F.lit(f" {name}"), F.when(n == 1, "").otherwise("s")))
    return F.concat_ws(" | ", F.when(words > 0, F.concat(F.format_number(words, 0), F.lit(" words"))), many(headings, "heading"), many(tables, "table"), many(items, "list item"), many(images, "image"), F.when(pages > 1, F.concat(pages.cast("string"), F.lit(" pages"))))


def clean_reply(c: Column, keep_lines: bool = False) -> Column:
    """A model's reply without position tags, with six entities decoded in a fixed order, and white space folded."""
    out = F.regexp_replace(c, r"</?(point_box|collection)[^>]*>", "")
    for entity, char in (("&quot;", '"'), ("&#x27;", "'"), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&#39;", "'")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    if not keep_lines:
        return trim(F.regexp_replace(out, rf"{WS}+", " "))
    folded = F.array_join(F.transform(F.split(out, "\n"), lambda x: trim(F.regexp_replace(x, r"[ \t]+", " "))), "\n")
    return collapse_newlines(folded)


def safe_caption(c: Column) -> Column:
    """Text for a Markdown image: brackets escaped, one line, at most 200 characters."""
    return F.substring(trim(F.replace(F.regexp_replace(c, r"([\[\]()])", r"\\$1"), F.lit("\n"), F.lit(" "))), 1, 200)


def is_image_url(c: Column) -> Column:
    return F.coalesce(c.startswith("data:image/") & (F.length(c) >= 100), F.lit(False))


# Cells of grids.
def is_short_token(c: Column) -> Column:
    core = F.regexp_replace(F.regexp_replace(trim(c), r"^[()\[\]{}%$€£+-]+", ""), r"[()\[\]{}%$€£+-]+\z", "")
    return (F.length(trim(c)) >= 1) & (F.length(trim(c)) <= 24) & ~trim(c).contains(" ") & core.rlike(r"^([0-9]+|[0-9]*\.[0-9]+|[A-Za-z0-9]+)\z")


def is_numeric(c: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(F.replace(trim(c), F.lit(",")), r"^[$€£¥₹]", ""), r"[$€£¥₹]\z", "")
    once = F.regexp_replace(F.regexp_replace(bare, r"^([^.]*)\.", "$1"), "^([^%]*)%", "$1")
    signed = F.regexp_replace(F.regexp_replace(once, r"^[-(]", ""), r"\)\z", "")
    return once.rlike(r"^[0-9]+\z") | (once.rlike(r"^[-(]") & signed.rlike(r"^[0-9]+\z"))


def is_sentence(c: Column) -> Column:
    return (F.size(F.split(trim(c), rf"{WS}+")) >= 5) & trim(c).rlike(r"[.!?…]+\z")


# Mathematical notation: the characters of `latex`'s tables, and signs that count beside them.
STRONG = "".join(latex.COMMANDS) + latex.RAISED[0] + latex.LOWERED[0][: len(latex.LOWERED[1])] + "^_"
WEAK = "=+*"


def count_of(c: Column, chars: str) -> Column:
    """How many characters of the text are among `chars`."""
    return F.length(c) - F.length(F.translate(c, chars, ""))


def math_density(c: Column) -> Column:
    """Share of mathematical characters, signs beside them counting 0.3, with bonuses for fractions, scripts, equations, roots and
    sums where there are any; at most 1."""
    strong, weak = count_of(c, STRONG), count_of(c, WEAK)
    bonus = lambda pattern, value: F.when(c.rlike(pattern), value).otherwise(0.0)
    bonuses = bonus(rf"[0-9]+{WS}*/{WS}*[0-9]+", 0.05) + bonus(r"[a-zA-Z][\x{2080}-\x{209C}\x{2070}-\x{207F}]+", 0.15) + bonus(rf"(^|{WS})[a-zA-Z]{WS}*={WS}*[^=]", 0.1) + bonus("sqrt|√", 0.15) + bonus("sum|∑|int|∫", 0.2)
    return F.when(strong == 0, 0.0).otherwise(F.least((strong + weak * 0.3) / F.length(c) + bonuses, F.lit(1.0)))


def looks_like_prose(c: Column) -> Column:
    t = trim(c)
    n = F.size(F.split(t, rf"{WS}+"))
    flag = lambda x: F.when(x, 1).otherwise(0)
    points = flag(t.rlike(r"[.!?]\z")) + flag(t.rlike(rf"(?i)(^|[^A-Za-z0-9_])({'|'.join(PROSE_WORDS)})([^A-Za-z0-9_]|\z)")) + flag(F.length(F.regexp_replace(t, WS, "")) > 4 * n) + flag(n > 10)
    return (F.length(t) >= 20) & (n >= 5) & (points >= 2)


def contains_math(c: Column) -> Column:
    strong, density = count_of(c, STRONG), math_density(c)
    return F.when(strong == 0, False).when(F.length(c) < 50, True).when(looks_like_prose(c) & (density < 0.3), False).otherwise((density > 0.15) | (strong >= 3))


def is_inline_math(c: Column) -> Column:
    return ((math_density(c) > 0.25) & (F.length(c) < 100)) | ((F.length(c) < 50) & (count_of(c, STRONG[:-2]) > 0))


def is_display_math(c: Column) -> Column:
    """Delimited or in an environment, or of several dense lines, or a dense line with a relation, integral, sum, matrix or fraction."""
    t = trim(c)
    fenced = (t.startswith("$$") & t.endswith("$$")) | (t.startswith("\\[") & t.endswith("\\]"))
    environment = t.rlike(r"\\begin\{(equation|align|gather|multline|eqnarray|displaymath)\*?\}")
    special = t.rlike(r"[=≤≥≠≈≃⇒→⇔↦∝]") | t.rlike(r"(?i)∫|\\int|integral|∑|\\sum|summation|matrix|\\begin\{") | t.rlike(r"\\[dt]?frac")
    return fenced | environment | (t.contains("\n") & (math_density(t) > 0.35)) | ((F.length(t) < 200) & (math_density(t) > 0.4) & special)


def normal_latex(c: Column) -> Column:
    """Single spaces around =, + and -, numeric fractions as \\frac, white space folded."""
    out = c
    for sign in ("=", r"\+", "-"):
        out = F.regexp_replace(out, rf"{WS}*{sign}{WS}*", f" {sign[-1]} ")
    out = F.regexp_replace(out, rf"([0-9]+){WS}*/{WS}*([0-9]+)", r"\\frac{$1}{$2}")
    return trim(F.regexp_replace(out, rf"{WS}+", " "))


def delimited(c: Column, display: Column) -> Column:
    t = trim(c)
    done = t.startswith("$") | t.startswith("\\(") | t.startswith("\\[")
    return F.when(done, t).when(display, F.concat(F.lit("$$\n"), t, F.lit("\n$$"))).otherwise(F.concat(F.lit("$"), t, F.lit("$")))


#: Patterns that fonts with lost encodings leave.
GARBLED = (r"[a-zA-Z]\x{FFFD}[a-zA-Z]", r"\x{FFFD}{2,}", r"[\x{2200}-\x{22FF}]{3,}", rf"[><=]{WS}*[A-Za-z]{WS}*[><=]", rf"[A-Za-z][>@]{WS}*[A-Za-z]", r"\([^)]{0,3}\x{FFFD}")
_LOST = r"[\x{FFFD}\x{E000}-\x{F8FF}]"


def is_garbled(c: Column) -> Column:
    """Whether the text has many lost characters, or the traces that garbled formulas leave."""
    traces = sum((F.regexp_count(c, F.lit(p)) for p in GARBLED[1:]), F.regexp_count(c, F.lit(GARBLED[0])))
    return (count_of(c, "\uFFFD") >= 3) | (F.regexp_count(c, F.lit(r"[\x{E000}-\x{F8FF}]")) >= 2) | (traces >= 3) | c.rlike(rf"[()=+\-*/∑∫]{WS}*{_LOST}")


def garbled_percentage(c: Column) -> Column:
    """Per cent of garbled characters, in tenths, where the text should be read again by eye; else null."""
    lost = F.regexp_count(c, F.lit(_LOST))
    percent = (lost + 2 * F.regexp_count(c, F.lit(rf"[>@]{WS}*[A-Za-z]|[A-Za-z]{WS}*[>@]"))) / F.length(c) * 100
    return F.when((F.length(c) >= 50) & is_garbled(c) & ((percent > 1) | (lost > 5)), F.floor(percent * 10 + 0.5) / 10)
