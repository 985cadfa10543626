"""Inputs: tables in a folder, and deterministic adapters that give them lines, cells, pages, items and stored files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def pdf_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, modificationTime, length, content) of PDF files; unreadable ones are skipped."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][dD][fF]").option("ignoreCorruptFiles", "true").load(path)


def marked_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, raw): lines of which some are bullets, numbers, labels, pipe rows or lone bullets, by number."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "raw"))
    k = F.col("line_no") % 7
    pipes = F.concat(F.lit("| "), F.replace("raw", F.lit(" "), F.lit(" | ")), F.lit(" |"))
    return lines.withColumn("raw", F.when(k == 1, F.concat(F.lit("• "), "raw")).when(k == 2, F.concat(F.col("line_no").cast("string"), F.lit(") "), "raw")).when(k == 3, F.concat(F.lit("Label Name: "), "raw")).when((k == 4) | (k == 5), pipes).when(k == 6, "•").otherwise(F.col("raw")))


def order_cells(lineitem: DataFrame) -> DataFrame:
    """(grid, r, c, text): a grid for each order, a row for each item, four columns."""
    whole = lambda n: F.col(n).cast("bigint").cast("string")
    kinds = F.array(whole("l_quantity"), F.concat(F.lit("$"), whole("l_extendedprice")), F.col("l_returnflag"), F.concat(F.lit("shipped on day "), F.date_format("l_shipdate", "dd"), F.lit(" of it.")))
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    rows = lineitem.withColumn("r", (F.row_number().over(w) - 1).cast("bigint"))
    return rows.select(F.col("l_orderkey").alias("grid"), "r", F.posexplode(kinds).alias("c", "text"))


def dialogue_pages(conversations: DataFrame) -> DataFrame:
    """(doc_id, page_no, text): a document for each conversation, with a running head and foot."""
    return conversations.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_no"), F.concat(F.lit("Report "), F.col("conv_id").cast("string"), F.lit("\n"), "text", F.lit("\nPage "), F.col("turn").cast("string")).alias("text"))


def stored_files(docs: DataFrame) -> DataFrame:
    """(file_id, project_id, name, size, status) of the documents."""
    status = F.when(F.col("doc_id") % 5 == 0, "pending").when(F.col("doc_id") % 7 == 0, "error").otherwise("completed")
    return docs.select(F.col("doc_id").alias("file_id"), F.col("source").alias("project_id"), F.concat(F.lit("file"), (F.col("doc_id") % 100).cast("string"), F.lit(".PDF")).alias("name"), F.col("n_chars").alias("size"), status.alias("status"))


def printed_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, page_no, line_no, text, font_size, y): lines of documents on pages of 20, with sizes and positions by length."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "text"))
    n = F.length("text")
    return lines.select("doc_id", F.floor(F.col("line_no") / 20).alias("page_no"), "line_no", "text", (8 + (n * 7 % 29) / 4).alias("font_size"), (F.col("line_no") * 12 - n % 3 * 8).cast("double").alias("y"))


def order_pages(lineitem: DataFrame) -> DataFrame:
    """(grid, lines): a page for each order, its items as lines with pipes, with gaps, or as prose, by the order's number."""
    cells = order_cells(lineitem).groupBy("grid", "r").agg(F.array_sort(F.collect_list(F.struct("c", "text"))).alias("t"))
    parts = F.transform("t", lambda x: x.text)
    kind = F.col("grid") % 3
    text = F.when(kind == 0, F.concat(F.lit("| "), F.array_join(parts, " | "), F.lit(" |"))).when(kind == 1, F.array_join(F.slice(parts, 1, 3), "    ")).otherwise(F.array_join(parts, " "))
    line = F.struct("r", F.struct(text.alias("text"), (F.col("r") * 12).cast("double").alias("y"), F.lit(0.0).alias("x"), F.lit(12.0).alias("size")).alias("line"))
    return cells.groupBy("grid").agg(F.transform(F.array_sort(F.collect_list(line)), lambda x: x.line).alias("lines"))


def placed_pages(docs: DataFrame, per_page: int = 24) -> DataFrame:
    """(doc_id, page_no, lines, st_json): lines of documents placed on pages of 612 x 792, in two columns on every third document,
    with a heading's size for the first, and the same as structured text."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "raw"))
    two, i = F.col("doc_id") % 3 == 0, F.col("n") % per_page
    right = two & (i >= per_page / 2)
    left = F.when(right, 330.0).otherwise(50.0)
    y = (100 + 14 * F.when(right, i - per_page / 2).otherwise(i)).cast("double")
    text = F.substring("raw", 1, 70)
    end = left + F.when(two, F.least(F.length(text) * 4, F.lit(230))).otherwise(F.least(F.length(text) * 7, F.lit(500)))
    size = F.when(F.col("n") == 0, 18.0).otherwise(12.0)
    line = F.struct(text.alias("text"), y.alias("y"), left.alias("min_x"), end.cast("double").alias("max_x"), size.alias("size"))
    pages = lines.groupBy("doc_id", F.floor(F.col("n") / per_page).alias("page_no")).agg(F.transform(F.array_sort(F.collect_list(F.struct("n", line.alias("line")))), lambda x: x.line).alias("lines"))
    block = lambda x: F.struct(F.lit("text").alias("type"), F.struct(x.min_x.alias("x"), x.y.alias("y"), (x.max_x - x.min_x).alias("w"), x["size"].alias("h")).alias("bbox"), F.array(F.struct(x.text.alias("text"), x.min_x.alias("x"), x.y.alias("y"), F.struct(x["size"].alias("size")).alias("font"))).alias("lines"))
    return pages.withColumn("st_json", F.to_json(F.struct(F.transform("lines", block).alias("blocks"))))


def mathematical(docs: DataFrame) -> DataFrame:
    """(doc_id, text): documents with Greek letters, relations, formulas or lost characters, by number; the first 400 characters."""
    k, t = F.col("doc_id") % 5, F.substring("text", 1, 400)
    return docs.select("doc_id", F.when(k == 0, F.translate(t, "aeo", "αεω")).when(k == 1, F.concat(t, F.lit(" x² ≤ y"))).when(k == 2, F.concat(F.lit("Let $a/b$ and α = 3/4 + β² be given. "), t)).when(k == 3, F.translate(t, "io", "\uFFFD\uE001")).otherwise(F.lit("∑x₂ = √2 ± 1/2")).alias("text"))
