"""Sinks for finished documents."""

from __future__ import annotations

import io
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def write_markdown(files: DataFrame, path: str) -> None:
    """Write (name, markdown) as UTF-8 text, a folder for each name, `.pdf` at its end made `.md`. Null texts are empty."""
    named = files.select(T.markdown_name(F.col("name")).alias("entry"), F.coalesce("markdown", F.lit("")).alias("value"))
    named.write.mode("overwrite").partitionBy("entry").text(path)


def zipped(files: DataFrame, archives: int = 1, name: str = "name", text: str = "markdown", order: str = "file_id") -> DataFrame:
    """(archive, entries, content): completed files as ZIP archives, dealt to `archives` of them by name.

    Of files with one name the last by `order` is kept. An archive is made in one task and held in memory, so their number
    must follow the input. Null texts are empty entries; without completed files there is no row.
    """
    last = files.where("status = 'completed'").groupBy(name).agg(F.max_by(F.coalesce(text, F.lit("")), order).alias("body"))
    dealt = last.select(F.pmod(F.hash(name), F.lit(archives)).alias("archive"), F.regexp_replace(name, r"(?i)\.pdf\z", ".md").alias("entry"), "body")

    def pack(group: pa.Table) -> pa.Table:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
            for entry, body in sorted(zip(group.column("entry").to_pylist(), group.column("body").to_pylist())):
                archive.writestr(zipfile.ZipInfo(entry), body)
        return pa.table({"archive": group.column("archive").slice(0, 1), "entries": pa.array([group.num_rows], pa.int64()), "content": pa.array([out.getvalue()], pa.binary())})

    return dealt.groupBy("archive").applyInArrow(pack, "archive int, entries bigint, content binary")
