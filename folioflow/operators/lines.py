"""Line repair, statistics, validation and running headers over documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .islands import joined, number_islands, ordered


def lines_of(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, line_no, raw): one row per line, from 0."""
    return docs.select(key, F.posexplode(F.split(text, "\n")).alias("line_no", "raw"))


def defragment(lines: DataFrame, limit: int = 45, key: str = "doc_id") -> DataFrame:
    """Join short orphan lines to the line before: (key, text).

    Whether a line joins depends on it and the raw line before alone, so the loop is a lag and a running sum.
    """
    w = ordered([key], ["line_no"])
    before, now = T.trim(F.lag("raw").over(w)), T.trim(F.col("raw"))
    orphan = (F.length(now) > 0) & (F.length(now) <= limit) & ~now.rlike("^#") & ~now.rlike(r"^[-*0-9]+[.)]\s") & (F.length(before) > 0) & ~now.rlike("^[A-Z]")
    merges = F.coalesce(orphan & (~before.rlike(r"[.!?:;]\z") | now.rlike("^[a-z]")), F.lit(False))
    cut = number_islands(lines.withColumn("m", merges), [key], ["line_no"], ~F.col("m"))
    # A line that another joins is trimmed too.
    cut = cut.withColumn("m", F.col("m") | F.coalesce(F.lead("m").over(w), F.lit(False)))
    part = F.when(F.col("m"), T.trim(F.col("raw"))).otherwise(F.col("raw"))
    runs = cut.withColumn("part", part).groupBy(key, "island").agg(joined("part", "line_no", " ").alias("line"))
    return runs.groupBy(key).agg(joined("line", "island").alias("text"))


def merge_bullets(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """A line that is a lone bullet takes the next line, unless that is blank or an item itself: (key, text)."""
    w = ordered([key], ["line_no"])
    lone = T.trim(F.col("raw")).rlike(rf"^[{T.BULLETS}*-]\z")
    after = T.trim(F.lead("raw").over(w))
    takes = lone & (F.length(after) > 0) & ~after.rlike(rf"^[{T.BULLETS}0-9*-]")
    flagged = lines.withColumn("takes", F.coalesce(takes, F.lit(False))).withColumn("after", after)
    kept = flagged.withColumn("gone", F.coalesce(F.lag("takes").over(w), F.lit(False))).where("not gone")
    line = F.when(F.col("takes"), F.concat(F.lit("- "), F.col("after"))).otherwise(F.col("raw"))
    return kept.withColumn("line", line).groupBy(key).agg(joined("line", "line_no").alias("text"))


def statistics(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Words, headings, tables (runs of pipe rows), list items and images of each Markdown text."""
    c = F.col(text)
    bare = F.regexp_replace(F.regexp_replace(c, rf"(?dm)^#+{T.WS}+", ""), "[*_`~]", "")
    bare = F.replace(F.regexp_replace(F.regexp_replace(bare, r"\[([^\]]+)\]\([^)]+\)", "$1"), r"!\[[^\]]*\]\([^)]+\)", ""), F.lit("|"), F.lit(" "))
    rows = F.transform(F.split(c, "\n"), lambda s: T.trim(s).rlike(r"^\|.+\|\z"))
    starts = F.filter(rows, lambda x, i: x & ((i == 0) | ~F.coalesce(F.get(rows, i - 1), F.lit(False))))
    count = lambda pattern: F.regexp_count(c, F.lit(pattern)).cast("bigint")
    return docs.select(key, F.regexp_count(bare, F.lit("[A-Za-z0-9_]+")).cast("bigint").alias("words"), count(rf"(?dm)^#+{T.WS}+.+$").alias("headings"), F.size(starts).cast("bigint").alias("tables"), (count(rf"(?dm)^{T.WS}*[-*+]{T.WS}+.+$") + count(rf"(?dm)^{T.WS}*[0-9]+[.)]{T.WS}+.+$")).alias("list_items"), count(r"!\[[^\]]*\]\([^)]+\)").alias("images"))


def validate(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Structural checks of each Markdown text: hard ones, warnings, and whether all hard ones hold."""
    c = F.col(text)
    n = lambda s: (F.length(c) - F.length(F.replace(c, F.lit(s)))) / len(s)
    checks = {
        "has_text": F.length(T.trim(c)) > 0, "no_undefined": ~c.contains("undefined"), "no_object": ~c.contains("[object Object]"), "no_wide_gaps": ~c.contains("\n\n\n\n"),
        "fences_even": (n("```") % 2) == 0, "few_controls": F.regexp_count(c, F.lit(r"[\x00-\x08\x0B\x0C\x0E-\x1F]")) * 100 < F.length(c), "bold_even": (n("**") % 2) == 0, "dollars_even": (n("$") % 2) == 0,
    }
    hard = list(checks)[:6]
    out = docs.select(key, *[v.alias(k) for k, v in checks.items()], F.length(c).cast("bigint").alias("characters"), F.size(F.split(c, "\n")).cast("bigint").alias("n_lines"))
    passed = F.lit(True)
    for k in hard:
        passed = passed & F.col(k)
    return out.withColumn("passed", passed)


def running_lines(pages: DataFrame, key: str, page: str, text: str, depth: int = 3, share: float = 0.5, least: int = 3, similar: float = 0.8) -> DataFrame:
    """(key, kind, place, pattern, n_pages): comparable lines at the same place of at least half of a document's pages.

    Pages are taken in order; a line counts for the first pattern that it resembles, or starts one. A document's page ends are
    gathered (its first and last lines alone), not its text.
    """
    filled = F.filter(F.split(text, "\n"), lambda s: F.length(T.trim(s)) > 0)
    ends = lambda name, lines: F.transform(F.slice(lines, 1, depth), lambda s, i: F.struct(F.lit(name).alias("kind"), i.alias("place"), T.comparable(s).alias("line")))
    base = pages.select(key, page, F.posexplode_outer(F.concat(ends("header", filled), ends("footer", F.reverse(filled)))).alias("n", "e"))
    total = F.size(F.collect_set(page))
    runs = base.groupBy(key).agg(total.alias("total"), F.array_sort(F.collect_list(F.when(F.length("e.line") > 0, F.struct(page, "n", "e")))).alias("ends")).where(F.col("total") >= least)
    places = F.flatten(F.transform(F.array(F.lit("header"), F.lit("footer")), lambda kind: F.transform(F.sequence(F.lit(0), F.lit(depth - 1)), lambda p: F.struct(kind.alias("kind"), p.alias("place")))))
    each = runs.select(key, "total", "ends", F.explode(places).alias("p"))
    lines = F.transform(F.filter("ends", lambda x: (x.e.kind == F.col("p.kind")) & (x.e.place == F.col("p.place"))), lambda x: x.e.line)
    none = F.expr("cast(array() as array<struct<pattern:string,n:bigint>>)")

    def count(found, line):
        near = F.array_position(F.transform(found, lambda f: T.jaccard(f.pattern, line) >= similar), F.lit(True))
        more = F.transform(found, lambda f, i: F.struct(f.pattern.alias("pattern"), (f.n + F.when(i + 1 == near, 1).otherwise(0)).alias("n")))
        return F.when(near > 0, more).otherwise(F.array_append(found, F.struct(line.alias("pattern"), F.lit(1).cast("bigint").alias("n"))))

    found = each.select(key, "total", "p.kind", "p.place", F.explode(F.aggregate(lines, none, count)).alias("f"))
    return found.where(F.col("f.n") >= share * F.col("total")).select(key, "kind", "place", "f.pattern", F.col("f.n").alias("n_pages"))


def remove_running_lines(pages: DataFrame, patterns: DataFrame, key: str, page: str, text: str, similar: float = 0.8) -> DataFrame:
    """Drop every line that resembles a running line of its document: (key, page, text). A document's patterns are few, so they travel as one array."""
    own = patterns.groupBy(key).agg(F.array_sort(F.collect_set("pattern")).alias("patterns"))
    gone = lambda s: (F.length(T.trim(s)) > 0) & F.exists(F.coalesce("patterns", F.array().cast("array<string>")), lambda p: T.jaccard(T.comparable(s), p) >= similar)
    return pages.join(own, key, "left").select(key, page, F.array_join(F.filter(F.split(text, "\n"), lambda s: ~gone(s)), "\n").alias("text"))


def without_drop_caps(spans: DataFrame, key: str = "doc_id", order: str = "line_no") -> DataFrame:
    """Spans (key, order, text, font_size) with single large capitals put before the lower-case span that follows them.

    Large is 1.5 times the upper median of the document's sizes.
    """
    sizes = spans.groupBy(key).agg(F.sort_array(F.collect_list("font_size")).alias("sizes")).select(key, F.get("sizes", F.floor(F.size("sizes") / 2).cast("int")).alias("median"))
    w = ordered([key], [order])
    own = spans.join(sizes, key)
    cap = T.trim(F.col("text")).rlike(r"^[A-Z]\z") & (F.col("font_size") >= F.col("median") * 1.5)
    takes = F.coalesce(cap & T.trim(F.lead("text").over(w)).rlike("^[a-z]"), F.lit(False))
    own = own.withColumn("takes", takes).withColumn("after", F.lead("text").over(w)).withColumn("after_size", F.lead("font_size").over(w))
    own = own.withColumn("gone", F.coalesce(F.lag("takes").over(w), F.lit(False))).where("not gone")
    return own.select(key, order, F.when(F.col("takes"), F.concat(T.trim(F.col("text")), "after")).otherwise(F.col("text")).alias("text"), F.when(F.col("takes"), F.col("after_size")).otherwise(F.col("font_size")).alias("font_size"))


def warnings(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts of each Markdown text, and the checks of which a failure is a warning."""
    c = F.col(text)
    count = lambda x, pattern: F.regexp_count(x, F.lit(pattern)).cast("bigint")
    words, chars = count(c, "[A-Za-z0-9_]+"), F.length(F.regexp_replace(c, T.WS, ""))
    lone, bold = F.regexp_replace(c, r"\*{2,}", ""), (F.length(c) - F.length(F.replace(c, F.lit("**"), F.lit("")))) / 2
    least = F.greatest(words, F.lit(1))
    return docs.select(
        key, words.alias("words"), count(c, rf"(?dm)^#+{T.WS}+.+$").alias("headings"), count(c, rf"(?dm)^{T.WS}*[-*+0-9.]+{T.WS}+.+$").alias("lists"),
        ((T.count_of(lone, "*") % 2 == 0) & (bold % 2 == 0)).alias("emphasis_even"), ((count(c, r"(?dm)^\|.*\|$") < 2) | (count(c, r"(?dm)^\|[\s:-]+\|$") > 0)).alias("tables_ruled"),
        ((chars == 0) | ((chars >= 2 * least) & (chars <= 15 * least))).alias("word_density"),
    )
