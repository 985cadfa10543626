"""WARC archives as a Python data source: planned file ranges, header-first reading, and predicates on record type and headers."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, StringStartsWith, WriterCommitMessage

from .common import discard, mapped, new_path, table

SCHEMA = "page_id bigint, record_type string, record_id string, target_uri string, payload_digest string, payload_bytes bigint, refers_to string, payload binary"
#: A file is closed at this size; files are what a read divides among tasks.
FILE_BYTES, SPLIT_BYTES = 64 << 20, 64 << 20
#: Least payload that another record may revisit.
MIN_REVISIT_BYTES = 0
#: Bytes read for a record's header, which comes first, where the rest may not be wanted.
HEAD_BYTES = 2048
#: Suffix of the file with an archive's compressed offsets; field for a target with line ends or edge spaces.
_INDEX, _EXACT = ".idx", "X-Target-URI-Base64"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
#: Columns that a filter can test on the headers alone.
_HEADERS = {"record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to"}


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system that a URI names (local, HDFS, object stores), and the path in it."""
    return pafs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (pafs.LocalFileSystem(), path)


def record_id(page_id: int | None, target: str | None) -> str:
    return f"urn:page:{page_id}" if page_id is not None else f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, target or '')}"


def encode_record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    """One WARC/1.1 record as a gzip member of its own."""
    head = "WARC/1.1\r\n" + "".join(f"{k}: {_line(v)}\r\n" for k, v in fields) + f"Content-Length: {len(block)}\r\n\r\n"
    return gzip.compress(head.encode("utf-8") + block + b"\r\n\r\n", compresslevel=1, mtime=0)


def _line(value: str) -> str:
    return value.replace("\r", "%0D").replace("\n", "%0A")


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class WarcWriter(DataSourceArrowWriter):
    """Writes rows (page_id, record_type, target_uri, payload_digest, payload_bytes, refers_to, payload); a revisit has no payload block.

    Each task writes files of its own name; only those that its commit names are listed in the manifest that a read follows.
    """

    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = _open(self.path)
        fs.create_dir(root, recursive=True)
        files, out, starts = [], None, []
        for batch in iterator:
            columns = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            payloads = columns["payload"]
            rest = [columns[c].to_pylist() for c in ("page_id", "record_type", "target_uri", "payload_digest", "payload_bytes", "refers_to")]
            for i, (page, kind, target, digest, size, refers) in enumerate(zip(*rest)):
                if out is None:
                    files.append(f"part-{uuid.uuid4().hex}.warc.gz")
                    out, starts = fs.open_output_stream(f"{root}/{files[-1]}", compression=None), []
                fields = [("WARC-Type", kind), ("WARC-Record-ID", f"<{record_id(page, target)}>"), ("WARC-Date", "1970-01-01T00:00:00Z")]
                fields += [("WARC-Target-URI", target)] if target is not None else []
                if target is not None and target != _line(target).strip():
                    fields.append((_EXACT, base64.b64encode(target.encode("utf-8")).decode()))
                fields += [("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Payload-Bytes", str(size)), ("Content-Type", "application/http; msgtype=response")]
                fields += [("X-Page-ID", str(page))] if page is not None else []
                if kind == "revisit":
                    fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<{record_id(int(refers), None)}>")]
                starts.append(out.tell())
                out.write(encode_record(fields, _HTTP + (b"" if kind == "revisit" else payloads[i].as_py() or b"")))
                if out.tell() >= FILE_BYTES:
                    self._finish(fs, f"{root}/{files[-1]}", out, starts)
                    out = None
        if out is not None:
            self._finish(fs, f"{root}/{files[-1]}", out, starts)
        return Written(files)

    @staticmethod
    def _finish(fs: pafs.FileSystem, path: str, out: pa.NativeFile, starts: list[int]) -> None:
        """Close an archive and write the compressed offsets of its records, and its size, beside it."""
        ends = np.array([*starts, out.tell()], dtype="<i8")
        out.close()
        with fs.open_output_stream(path + _INDEX, compression=None) as index:
            index.write(ends.tobytes())

    def commit(self, messages: list[Written]) -> None:
        fs, root = _open(self.path)
        fs.create_dir(root, recursive=True)
        with fs.open_output_stream(f"{root}/_manifest") as out:
            out.write("\n".join(f for m in messages if m for f in m.files).encode())

    def abort(self, messages: list[Written]) -> None:
        fs, root = _open(self.path)
        for name in (f for m in messages if m for f in m.files):
            for file in (name, name + _INDEX):
                if fs.get_file_info(f"{root}/{file}").type != pafs.FileType.NotFound:
                    fs.delete_file(f"{root}/{file}")


@dataclass
class Files(InputPartition):
    paths: list[str]


class WarcReader(DataSourceReader):
    """Reads archives file by file. Headers come first. Of a record that the pushed predicates refuse, or whose payload is not
    wanted, nothing else is decoded: files that were written here have an index of compressed offsets to skip by, and plain
    files are skipped in by length. Only in compressed files of others must a block be inflated to find where it ends."""

    def __init__(self, path: str, payload: bool, verify: bool):
        self.path, self.payload, self.verify = path, payload, verify
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            name = _HEADERS.get(f.attribute[0]) if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if name and isinstance(f, EqualTo) and isinstance(f.value, str):
                self.tests.append((name, "in", (f.value,)))
            elif name and isinstance(f, In) and all(isinstance(v, str) for v in f.value):
                self.tests.append((name, "in", tuple(f.value)))
            elif name and isinstance(f, StringStartsWith):
                self.tests.append((name, "starts", f.value))
            elif name and isinstance(f, IsNotNull):
                self.tests.append((name, "there", None))
            else:
                yield f

    def partitions(self) -> list[Files]:
        fs, root = _open(self.path)
        if fs.get_file_info(f"{root}/_manifest").type == pafs.FileType.NotFound:
            infos = [x for x in fs.get_file_info(pafs.FileSelector(root, recursive=True)) if x.path.endswith((".warc", ".warc.gz"))]
        else:
            with fs.open_input_stream(f"{root}/_manifest") as f:
                names = [n for n in f.read().decode().split("\n") if n]
            infos = fs.get_file_info([f"{root}/{n}" for n in names]) if names else []
        prefix = self.path[: len(self.path) - len(root)] if self.path.endswith(root) else ""
        plan, size = [], 0
        for info in sorted(infos, key=lambda x: x.path):
            if not plan or size + info.size > SPLIT_BYTES:
                plan.append(Files([]))
                size = 0
            plan[-1].paths.append(prefix + info.path)
            size += info.size
        return plan or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "record_type", "record_id", "target_uri", "payload_digest", "payload_bytes", "refers_to", "payload"]
        schema = pa.schema([pa.field(n, pa.int64() if n in ("page_id", "payload_bytes") else pa.binary() if n == "payload" else pa.string()) for n in names])
        rows, have = [], 0
        for path in partition.paths:
            for head, block in self.records(path):
                rows.append(self.row(head, block))
                have += len(block or b"")
                if len(rows) >= 4096 or have > 16 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)
                    rows, have = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)

    def wanted(self, head: dict[str, str]) -> bool:
        for name, how, value in self.tests:
            got = _value(head, name)
            if got is None or (how == "in" and got not in value) or (how == "starts" and not got.startswith(value)):
                return False
        return True

    def records(self, path: str) -> Iterator[tuple[dict[str, str], bytes | None]]:
        fs, inner = _open(path)
        if fs.get_file_info(inner + _INDEX).type != pafs.FileType.NotFound:
            yield from self._indexed(fs, inner)
        elif path.endswith(".gz"):
            with fs.open_input_stream(inner, compression=None, buffer_size=1 << 20) as raw:
                yield from self._streamed(io.BufferedReader(gzip.GzipFile(fileobj=raw), 1 << 18))
        else:
            with fs.open_input_file(inner) as raw:
                yield from self._streamed(io.BufferedReader(raw, 1 << 18))

    def _indexed(self, fs: pafs.FileSystem, inner: str) -> Iterator[tuple[dict[str, str], bytes | None]]:
        with fs.open_input_stream(inner + _INDEX, compression=None) as index:
            ends = np.frombuffer(index.read(), dtype="<i8").tolist()
        with fs.open_input_file(inner) as raw:
            for start, end in zip(ends, ends[1:]):
                inflate, at, text = zlib.decompressobj(31), start, b""
                step = end - start if self.payload and not self.tests else HEAD_BYTES
                while b"\r\n\r\n" not in text and at < end:
                    piece = raw.read_at(min(step, end - at), at)
                    at += len(piece)
                    text += inflate.decompress(piece)
                lines, _, block = text.partition(b"\r\n\r\n")
                head = _head(lines.split(b"\r\n")[1:])
                if self.wanted(head):
                    if self.payload and head.get("warc-type") != "revisit":
                        if at < end:
                            block += inflate.decompress(raw.read_at(end - at, at))
                        yield head, block[: int(head.get("content-length", 0))]
                    else:
                        yield head, None

    def _streamed(self, stream: io.BufferedReader) -> Iterator[tuple[dict[str, str], bytes | None]]:
        while line := stream.readline():
            if not line.startswith(b"WARC/"):
                continue
            lines = []
            while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
                lines.append(line)
            head = _head(lines)
            size = int(head.get("content-length", 0))
            keep = self.wanted(head)
            if keep and self.payload and head.get("warc-type") != "revisit":
                yield head, stream.read(size)
                continue
            stream.seek(size, io.SEEK_CUR)
            if keep:
                yield head, None

    def row(self, head: dict[str, str], block: bytes | None) -> tuple:
        page = head.get("x-page-id")
        digest, size, payload = _value(head, "warc-payload-digest"), head.get("x-payload-bytes"), None
        if block is not None:
            payload = block.partition(b"\r\n\r\n")[2] if head.get("content-type", "").startswith("application/http") else block
            size = len(payload)
            if self.verify:
                own = base32_sha1(payload)
                if digest is not None and digest != own:
                    raise ValueError(f"payload of {head.get('warc-record-id')} does not match its digest")
                digest = own
        return int(page) if page is not None else None, head.get("warc-type"), _value(head, "warc-record-id"), head.get("warc-target-uri"), digest, int(size) if size is not None else None, _value(head, "warc-refers-to"), payload


def _head(lines: list[bytes]) -> dict[str, str]:
    """Header fields by lower-cased name; a target that its own field can't hold stands in another, exactly."""
    head = {}
    for line in lines:
        k, _, v = line.decode("utf-8").partition(":")
        head[k.strip().lower()] = v.strip()
    if exact := head.get(_EXACT.lower()):
        head["warc-target-uri"] = base64.b64decode(exact).decode("utf-8")
    return head


def _value(head: dict[str, str], name: str) -> str | None:
    got = head.get(name)
    if got is None:
        return None
    if name in ("warc-record-id", "warc-refers-to"):
        return got.strip("<>")
    return got.removeprefix("sha1:") if name == "warc-payload-digest" else got


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


class WarcSource(DataSource):
    """Format "warc". Options of a read: payload (true or false) and verify (recompute payload digests)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        flag = lambda k: self.options.get(k, "true").lower() == "true"
        return WarcReader(self.options["path"], flag("payload"), flag("verify"))

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    """Make format "warc" known to a session, with its predicates pushed down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def read(spark: SparkSession, path: str, payload: bool = True, verify: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).option("verify", str(verify).lower()).load(path)


def archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit_bytes: int = MIN_REVISIT_BYTES) -> None:
    """Write one record per row to archives under `path`.

    The payload is the html in UTF-8, empty for null. Of rows with equal payloads of `min_revisit_bytes` or more, those with
    the least page_id are responses; the others are revisits of it. Rows with a null page_id never become the response while
    another has one, and are responses where none has. Repeated rows are written each. The least ids go through a partial
    aggregate and the shared folder, and only for payloads that occur twice, so a hot payload's rows can be split in the join.
    """
    spark = pages.sparkSession
    register(spark)
    body = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    base = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("target_uri"), body.alias("html"), F.unhex(F.sha1(body.cast("binary"))).alias("sha"))
    firsts = base.groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 AND first IS NOT NULL").select("sha", "first")
    firsts = table(firsts, "firsts")
    typed = base.join(firsts, "sha", "left")
    size = F.octet_length("html").cast("bigint")
    again = (size >= min_revisit_bytes) & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    rows = typed.select("page_id", F.when(again, "revisit").otherwise("response").alias("record_type"), "target_uri", size.alias("payload_bytes"), F.when(again, F.col("first").cast("string")).alias("refers_to"), F.when(~again, F.col("html").cast("binary")).alias("payload"), F.col("sha"))

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = pa.array([base64.b32encode(x).decode() for x in batch.column(6).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], text], [*batch.schema.names[:6], "payload_digest"])

    rows = mapped(rows, digests, "page_id bigint, record_type string, target_uri string, payload_bytes bigint, refers_to string, payload binary, payload_digest string")
    rows.write.format("warc").mode("append").save(path)
    discard(firsts)


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Write the pages to archives in the shared folder and read those: (page_id, payload_bytes, payload_digest, record_type, refers_to).

    Size and digest of a response are computed from the payload read back; those of a revisit come from its headers.
    """
    path = new_path(pages.sparkSession, "warc")
    archive(pages, path, id_col, url_col, html_col, min_revisit_bytes)
    back = read(pages.sparkSession, path)
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", F.regexp_extract("refers_to", "^urn:page:(.*)$", 1).cast("bigint").alias("refers_to"))


__all__ = ["WarcSource", "archive", "read", "register", "round_trip"]
