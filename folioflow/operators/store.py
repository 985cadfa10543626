"""The project and file store: keyed collections as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of `new`, and those of `old` whose key it lacks."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def delete(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return rows.join(gone.select(key), key, "left_anti")


def delete_project(projects: DataFrame, files: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both collections without the projects in `gone` (project_id) and their files."""
    return delete(projects, gone, "project_id"), delete(files, gone, "project_id")


def file_counts(projects: DataFrame, files: DataFrame) -> DataFrame:
    """(project_id, n_files), 0 for a project without files. Files are counted before they meet the projects."""
    return projects.select("project_id").join(files.groupBy("project_id").agg(F.count("*").alias("n")), "project_id", "left").select("project_id", F.coalesce("n", F.lit(0)).alias("n_files"))


def status_counts(files: DataFrame) -> DataFrame:
    return files.groupBy("status").agg(F.count("*").alias("n_files"))


def insert(rows: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """`rows` and those of `new` whose key is not there yet."""
    return rows.unionByName(new.join(rows.select(key), key, "left_anti").select(*rows.columns))


def patch(rows: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """`rows` with the values of `changes` that aren't null, by key."""
    changed = [c for c in changes.columns if c != key]
    both = rows.join(changes.select(key, *[F.col(c).alias(f"_{c}") for c in changed]), key, "left")
    return both.select(*[F.coalesce(f"_{c}", c).alias(c) if c in changed else F.col(c) for c in rows.columns])


def files_of(files: DataFrame, project: str, newest: str) -> DataFrame:
    """(place, file_id, name, status, progress) of a project's files, those of the highest `newest` first."""
    place = F.row_number().over(Window.partitionBy("project_id").orderBy(F.desc(newest), "file_id")).cast("bigint")
    own = files.where(F.col("project_id") == project).withColumn("place", place)
    return own.select("place", "file_id", "name", "status", F.when(F.col("status") == "completed", 100).otherwise(0).cast("bigint").alias("progress"))


def put_setting(settings: DataFrame, new: DataFrame) -> DataFrame:
    """Settings (key, value) with those of `new`; a null or empty value deletes its key."""
    return upsert(settings, new, "key").where("value IS NOT NULL AND value <> ''")


def encrypted(value: Column, secret: Column) -> Column:
    """AES-GCM with a random start, as base64; `secret` has 32 bytes and never stands in code."""
    return F.base64(F.aes_encrypt(value, secret, F.lit("GCM")))


def decrypted(value: Column, secret: Column) -> Column:
    """The value again; an empty text if it was made with another secret."""
    return F.coalesce(F.try_aes_decrypt(F.unbase64(value), secret, F.lit("GCM")).cast("string"), F.lit(""))


def shown_images(documents: DataFrame, images: DataFrame, key: str) -> DataFrame:
    """(key, alt, shown) of each image in the Markdown: the data of images (id, data_url) that it refers to, or its description."""
    links = documents.select(key, F.explode(F.regexp_extract_all("markdown", F.lit(r"(!\[[^\]]*\]\([^)]+\))"), F.lit(1))).alias("link"))
    parts = links.select(key, F.regexp_extract("link", r"!\[([^\]]*)\]", 1).alias("alt"), F.regexp_extract("link", r"\(#?([^)]+)\)$", 1).alias("id"))
    return parts.join(images, "id", "left").select(key, "alt", F.coalesce("data_url", F.concat(F.lit("[Image: "), "alt", F.lit("]"))).alias("shown"))
