"""Font profiles and line heights of pages, and modes with first-seen ties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .islands import ordered

#: Size of text without one, and the least multiples of the body size of first to third headings.
DEFAULT_SIZE, HEADINGS = 12.0, (1.5, 1.25, 1.1)


def first_seen_mode(rows: DataFrame, keys: list[str], value: str, position: str, weight: Column | None = None, name: str = "mode") -> DataFrame:
    """(*keys, name, weight): the value of the largest total weight (rows where none is given) in each group; ties go to the first seen.

    Two partial aggregates; a hot group is summed before it is shuffled. Null values are left out, so a group of only these has no row.
    """
    total = F.count("*") if weight is None else F.sum(weight)
    sums = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(total.alias("weight"), F.min(position).alias("first"))
    return sums.groupBy(*keys).agg(F.max_by(value, F.struct("weight", -F.col("first"))).alias(name), F.max("weight").alias("weight"))


def font_profile(lines: DataFrame) -> DataFrame:
    """(doc_id, page_no, body, h1, h2, h3) of lines (doc_id, page_no, line_no, text, font_size): the body size is the half
    point with the most characters; a null or zero size counts as 12."""
    size = F.when(F.col("font_size") > 0, F.col("font_size")).otherwise(F.lit(DEFAULT_SIZE))
    sized = lines.withColumn("size", F.floor(size * 2 + 0.5) / 2)
    body = first_seen_mode(sized, ["doc_id", "page_no"], "size", "line_no", F.coalesce(F.length("text"), F.lit(0)), "body")
    return body.select("doc_id", "page_no", "body", *[(F.col("body") * m).alias(f"h{i}") for i, m in enumerate(HEADINGS, 1)])


def line_heights(lines: DataFrame) -> DataFrame:
    """(doc_id, page_no, n_lines, height): mean of the positive distances of successive lines' y; 12 where there is a single
    line, 1.2 times the mean size where no distance is positive."""
    w = ordered(["doc_id", "page_no"], ["line_no"])
    gaps = lines.withColumn("gap", F.col("y") - F.lag("y").over(w))
    mean = F.avg(F.when(F.col("gap") > 0, F.col("gap")))
    height = F.when(F.count("*") < 2, F.lit(DEFAULT_SIZE)).otherwise(F.coalesce(mean, 1.2 * F.avg("font_size")))
    return gaps.groupBy("doc_id", "page_no").agg(F.count("*").alias("n_lines"), height.alias("height"))


def block_styles(rows: DataFrame, keys: list[str], body: Column, text: str = "text", size: str = "font_size", font: str = "font") -> DataFrame:
    """(keys, size, level, bold, italic) of blocks of lines: sizes and styles weighted by characters; 12 without any."""
    n = F.length(text)
    styled = lambda kind: F.sum(F.when(F.lower(font).contains(kind), n).otherwise(0))
    sums = rows.groupBy(*keys).agg(F.sum(n).alias("n"), F.sum(F.col(size) * n).alias("s"), styled("bold").alias("b"), styled("italic").alias("i"))
    mean = F.when(F.col("n") > 0, F.col("s") / F.col("n")).otherwise(12.0)
    return sums.select(*keys, mean.alias("size"), T.heading_level(mean, body).alias("level"), (F.col("b") > 0.5 * F.col("n")).alias("bold"), (F.col("i") > 0.5 * F.col("n")).alias("italic"))
