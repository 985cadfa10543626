"""Pages to finished documents: running lines removed, pages joined, lines repaired, counts taken."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import lines
from ..operators.islands import joined


def convert(pages: DataFrame, key: str = "doc_id", page: str = "page_no", text: str = "text", remove_running: bool = True, fix_hyphens: bool = True) -> DataFrame:
    """(key, markdown, words, headings, tables, list_items, images, pages, summary) of documents given as pages.

    Blank pages are left out. All steps after the join of running lines keep the partitioning by document, so lines are not
    shuffled again. A document without text has an empty Markdown; null page texts are blank.
    """
    own = pages.select(key, page, F.coalesce(F.col(text), F.lit("")).alias(text))
    found = lines.running_lines(own, key, page, text)
    kept = lines.remove_running_lines(own, found, key, page, text) if remove_running else own
    filled = F.when(F.length(T.trim(F.col(text))) > 0, F.struct(page, text))
    whole = kept.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(filled)), lambda p: p[text]), "\n\n").alias(text), F.count("*").alias("pages"))
    body = whole.withColumn(text, T.dehyphenate_all(F.col(text))) if fix_hyphens else whole
    merged = lines.merge_bullets(lines.lines_of(body, key, text), key)
    repaired = lines.defragment(lines.lines_of(merged, key, "text"), key=key)
    final = repaired.select(key, T.collapse_newlines(F.col("text")).alias("markdown"))
    counted = lines.statistics(final, key, "markdown").join(final, key).join(whole.select(key, F.col("pages").cast("bigint").alias("pages")), key)
    counts = ["words", "headings", "tables", "list_items", "images", "pages"]
    return counted.select(key, "markdown", *counts, T.format_stats(*[F.col(c) for c in counts]).alias("summary"))


def apply_transforms(docs: DataFrame, key: str = "doc_id", text: str = "text", hyphens: bool = True, bullets: bool = True, fragments: bool = True) -> DataFrame:
    """Hyphenation, lone bullets and orphan lines repaired, in this order: (key, text)."""
    out = docs.select(key, (T.dehyphenate_all(F.col(text)) if hyphens else F.col(text)).alias("text"))
    out = lines.merge_bullets(lines.lines_of(out, key, "text"), key) if bullets else out
    return lines.defragment(lines.lines_of(out, key, "text"), key=key) if fragments else out


def lines_to_text(rows: DataFrame, key: str, order: str, text: str) -> DataFrame:
    return rows.groupBy(key).agg(joined(text, order).alias("text"))
