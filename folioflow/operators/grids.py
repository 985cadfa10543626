"""Grids and tables: profiles, gates, alignments, rendering and bordered runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .islands import joined, number_islands


def profile(cells: DataFrame, grid: str, row: str, col: str, text: str) -> DataFrame:
    """One row a grid: sizes and counts of its cells' kinds, its density and its score; two aggregates with partial sums."""
    c = F.col(text)
    kinds = {"non_empty": F.length(T.trim(c)) > 0, "short_cells": T.is_short_token(c), "numeric_cells": T.is_numeric(c), "sentence_cells": T.is_sentence(c), "prose_cells": T.is_prose_fragment(c)}
    flags = cells.select(grid, row, *[v.cast("int").alias(k) for k, v in kinds.items()], F.length(T.trim(c)).alias("len"))
    by_row = flags.groupBy(grid, row).agg(F.count("*").alias("width"), *[F.sum(k).alias(k) for k in kinds], F.sum("len").alias("len"), F.max("len").alias("max_len"))
    out = by_row.groupBy(grid).agg(F.count("*").alias("n_rows"), F.max("width").alias("n_cols"), *[F.sum(k).alias(k) for k in kinds], F.sum("len").alias("total_len"), F.max("max_len").cast("bigint").alias("max_len"), (F.min("width") == F.max("width")).alias("even"))
    return out.withColumn("score", score()).drop("even")


def score() -> Column:
    """How like a table a profile is: points for rows, columns, tokens and numbers, less for sentences, prose and long cells."""
    c, n = F.col, F.col("non_empty")
    share = lambda k: F.when(n > 0, c(k) / n).otherwise(0.0)
    sentences, prose, tokens = share("sentence_cells"), share("prose_cells"), c("short_cells") + c("numeric_cells")
    mean = share("total_len")
    steps = lambda x, *cuts: F.coalesce(*[F.when(x > at, cost) for at, cost in cuts], F.lit(0.0))
    out = c("n_rows") * 1.0 + c("n_cols") * 0.8 + share("short_cells") * 3 + share("numeric_cells") * 2
    out = out - steps(sentences, (0.8, sentences * 4), (0.4, sentences * 2)) - steps(prose, (0.5, prose * 6), (0.3, prose * 3), (0.15, prose * 1.5))
    out = out - F.when((F.greatest(sentences, prose) > 0.6) & (tokens < n * 0.3), 5.0).otherwise(0.0)
    out = out - steps(mean, (80, F.lit(4.0)), (50, F.lit(2.0))) - F.when(c("max_len") > 100, 2.0).otherwise(0.0)
    out = out + F.when((c("n_rows") >= 4) & (c("n_cols") >= 3) & (c("prose_cells") < n * 0.3), 2.0).otherwise(0.0)
    return out + F.when(c("even"), 1.5).otherwise(0.0) + F.when(n >= 0.6 * c("n_rows") * c("n_cols"), 1.0).otherwise(0.0)


def passes(profiles: DataFrame, bonus: float = 0.0) -> DataFrame:
    """Profiles with `is_table`: the size, density, length, kind and score gates. Bordered tables have a bonus of 2."""
    c, n = F.col, F.col("non_empty")
    dense = n >= 0.25 * c("n_rows") * c("n_cols")
    tokens, total = c("short_cells") + c("numeric_cells"), c("total_len")
    long = ((total <= 60 * n) | (tokens >= 0.5 * n)) & ((c("max_len") <= 80) | (total <= 40 * n) | (tokens >= 0.4 * n))
    worded = (c("sentence_cells") < 0.4 * n) | (c("numeric_cells") >= 0.2 * n) | (c("short_cells") >= 0.3 * n)
    plain = (c("short_cells") >= 0.15 * n) | (c("numeric_cells") > 0) | ((c("n_rows") >= 4) & (c("n_cols") >= 3) & (total <= 30 * n))
    return profiles.withColumn("is_table", (c("n_rows") >= 2) & (c("n_cols") >= 2) & (n > 0) & dense & long & worded & plain & (c("score") + bonus >= 2.0))


def columns(cells: DataFrame, grid: str, row: str, col: str, text: str) -> DataFrame:
    """(grid, col, width, alignment): widths from 3 to 50; right-aligned if over 0.7 of the cells below the header are numeric."""
    c = F.col(text)
    return cells.groupBy(grid, col).agg(F.least(F.greatest(F.max(F.length(c)), F.lit(3)), F.lit(50)).cast("bigint").alias("width"), F.when(F.sum(F.when((F.col(row) > 0) & T.is_numeric(c), 1).otherwise(0)) > 0.7 * F.sum(F.when(F.col(row) > 0, 1).otherwise(0)), "right").otherwise("left").alias("alignment"))


def to_markdown(cells: DataFrame, grid: str, row: str, col: str, text: str) -> DataFrame:
    """(grid, markdown): padded pipe rows with a separator under the first."""
    shown = cells.join(columns(cells, grid, row, col, text), [grid, col])
    value = T.trim(F.replace(F.replace(F.col(text), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" ")))
    gap = F.repeat(F.lit(" "), F.greatest(F.col("width") - F.length("v"), F.lit(0)).cast("int"))
    shown = shown.withColumn("v", value).withColumn("v", F.when(F.col("alignment") == "right", F.concat(gap, "v")).otherwise(F.concat("v", gap)))
    dashes = F.repeat(F.lit("-"), F.col("width").cast("int"))
    shown = shown.withColumn("d", F.when(F.col("alignment") == "right", F.concat(F.expr("substring(repeat('-', width), 2)"), F.lit(":"))).otherwise(dashes))
    rows = shown.groupBy(grid, row).agg(joined("v", col, " | ").alias("v"), joined("d", col, " | ").alias("d"))
    line = F.concat(F.lit("| "), "v", F.lit(" |"), F.when(F.col(row) == 0, F.concat(F.lit("\n| "), "d", F.lit(" |"))).otherwise(""))
    return rows.withColumn("line", line).groupBy(grid).agg(joined("line", row).alias("markdown"))


def bordered_runs(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, start_line, end_line, n_lines): runs of two or more lines with pipes or of separators alone."""
    border = F.col("raw").contains("|") | F.col("raw").contains("¦") | (F.col("raw").rlike(r"^[\s+|=:¦-]+\z") & F.col("raw").contains("-"))
    cut = number_islands(lines.withColumn("b", border), [key], ["line_no"], ~F.col("b"))
    return cut.where("b").groupBy(key, "island").agg(F.min("line_no").alias("start_line"), F.max("line_no").alias("end_line"), F.count("*").alias("n_lines")).where("n_lines >= 2").drop("island")
