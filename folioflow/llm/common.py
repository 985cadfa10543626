"""Shared pieces: tables cut from lineage, Arrow batches in bounded slices, and vectorised word hashing."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Hashable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Text bytes handled at once inside a Python worker; one longer text is handled alone.
SLICE_BYTES = 1 << 19
#: Rows of an Arrow batch between the JVM and a Python worker.
BATCH_ROWS = 2000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local session (tests) gets one of
    our own; on a cluster that is an error, since no local folder is shared there."""
    found = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file:///tmp/checkpoints/folioflow"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/folioflow/{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"


def table(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it again: cuts lineage, so a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._folio_path = path
    return out


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that have ended: it does so once the driver has collected their objects."""
    spark.sparkContext._jvm.System.gc()


def discard(*tables: DataFrame) -> None:
    """Delete tables made by `table` that nothing will read again: all that was made of them has been written."""
    for df in tables:
        _delete(df.sparkSession, df._folio_path)


def clean_up(spark: SparkSession) -> None:
    """Delete all tables and archives that this application has left in the shared folder, once its results are written."""
    _delete(spark, f"{shared_dir(spark)}/folioflow/{spark.sparkContext.applicationId}")


def _delete(spark: SparkSession, name: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


# Rows that an operator carries along: its text column as `text`, and all other columns but the id as one struct `row`, so that
# no name of theirs can clash with the operator's own columns.


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def carried(docs: DataFrame, id_col: str, text_col: str) -> Column:
    rest = [c for c in docs.columns if c not in (id_col, text_col)]
    return F.struct(*[F.col(_quoted(c)).alias(f"c{i}") for i, c in enumerate(rest)], F.lit(True).alias("there")).alias("row")


def restored(result: DataFrame, columns: list[str], id_col: str = "doc_id", text_col: str = "text", change: dict[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """The rows as they were before `carried`, with the columns in their order; `change` makes a new column of an old one."""
    rest = [c for c in columns if c not in (id_col, text_col)]
    own = {c: F.col(f"row.c{i}") for i, c in enumerate(rest)} | {id_col: F.col("doc_id"), text_col: F.col("text")}
    return result.select(*[(change or {}).get(c, lambda old: old)(own[c]).alias(c) for c in columns])


def schema_of(frame: DataFrame, own: str, last: tuple[str, ...] = (), first: str = "doc_id") -> StructType:
    """The frame's column `first`, the operator's own columns (as DDL), and the frame's columns `last`."""
    out = StructType([frame.schema[first]])
    for field in [*StructType.fromDDL(own), *[frame.schema[c] for c in last]]:
        out.add(field)
    return out


_resident: dict[Hashable, Any] = {}


def resident(key: Hashable, build: Callable[[], Any]) -> Any:
    """What a worker process keeps between tasks: one thing of one operator, so that a pipeline's stages don't add up."""
    if key not in _resident:
        _resident.clear()
        _powers.clear()
        give_back()
        _resident[key] = build()
    return _resident[key]


def slices(batch: pa.RecordBatch, column: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows whose text in `column` has at most `limit` bytes together (one row at least)."""
    lengths = np.diff(_offsets(batch.column(column)))
    ends = np.cumsum(lengths, dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(at, to - at)
        at = to


def _offsets(column: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    raw = np.frombuffer(column.buffers()[1], dtype=kind) if column.buffers()[1] else np.zeros(1, dtype=kind)
    return raw[column.offset : column.offset + len(column) + 1].astype(np.int64)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts joined, and the n + 1 offsets of the texts in them. A null text is empty."""
    if column.null_count:
        column = column.fill_null("")
    offsets = _offsets(column) if len(column) else np.zeros(1, dtype=np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def texts(column: pa.Array) -> list[bytes]:
    raw, offsets = utf8(column)
    data = raw.tobytes()
    at = offsets.tolist()
    return [data[a:b] for a, b in zip(at, at[1:])]


# Word hashing: a polynomial over the bytes of each word, by differences of one running sum, then mixed.
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = {}

#: Word breaks of the two word definitions in use, as byte tables.
SPACES = np.zeros(256, dtype=bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers with good diffusion (the finaliser of MurmurHash3)."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


_BYTE_CODES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_LOWER_CODES = _BYTE_CODES[LOWER]


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(1 << 12, 1 << (n - 1).bit_length()) if n <= SLICE_BYTES else n
        have = np.ones(size, dtype=np.uint64)
        have[1:] = np.uint64(base)
        have = np.multiply.accumulate(have)
        if size <= SLICE_BYTES:
            _powers[base] = have
    return have[:n]


def hashed(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """64-bit hashes of the byte runs from `starts` to `ends`."""
    n = len(raw)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((_LOWER_CODES if lower else _BYTE_CODES)[raw] * _power(_BASE, n), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _power(_INVERSE, n)[starts] + (ends - starts).astype(np.uint64))


def words(raw: np.ndarray, offsets: np.ndarray, lower: bool = False, breaks: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of many texts at once: byte starts, byte ends, 64-bit hashes, and the n + 1 word offsets of the texts."""
    n = len(raw)
    if not n:
        none = np.zeros(0, dtype=np.int64)
        return none, none, np.zeros(0, dtype=np.uint64), np.zeros(len(offsets), dtype=np.int64)
    inside = ~breaks[raw]
    cut = np.zeros(n + 1, dtype=bool)
    cut[offsets] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | cut[1:n]
    last[:-1] &= ~inside[1:] | cut[1:n]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, hashed(raw, starts, ends, lower), np.searchsorted(starts, offsets)


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of `size` words; entry i covers words i to i + size - 1."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for j in range(size):
        out *= np.uint64(0x9FB21C651E98DF25)
        out += hashes[j : j + n]
    return mix(out)


def give_back() -> None:
    """Return freed memory of a finished task to the system: its worker process lives on beside the executor's JVM."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def mapped(df: DataFrame, go: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """mapInArrow over small batches, which gives memory back when a task has ended."""
    spark = df.sparkSession
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))

    def all_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from go(batches)
        give_back()

    return df.mapInArrow(all_of, schema)


def run_in_arrow(df: DataFrame, each: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str | StructType, column: int = 0, limit: int = SLICE_BYTES) -> DataFrame:
    """`mapped` with batches cut by `slices`; `each` may return None for no rows."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, column, limit):
                out = each(part)
                if out is not None:
                    yield out

    return mapped(df, go, schema)


#: Bits of an id filter; its size does not depend on the data.
FILTER_BITS = 1 << 24


def filter_place(id_col: str) -> Column:
    """The bit of an id in a filter, from 1 on."""
    return (F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(FILTER_BITS)) + 1).cast("bigint")


def id_filter(ids: DataFrame, id_col: str) -> bytes:
    """A bitmap of FILTER_BITS with the place of each id set."""
    return place_filter(ids, filter_place(id_col))


def place_filter(rows: DataFrame, place: Column) -> bytes:
    """A bitmap of FILTER_BITS with the places of rows set. It is made by partial aggregates; the driver gets its pieces."""
    pieces = rows.groupBy(F.bitmap_bucket_number(place).alias("piece")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    out = np.zeros(FILTER_BITS >> 3, dtype=np.uint8)
    for row in pieces.collect():
        own = np.frombuffer(row.bits, dtype=np.uint8)
        at = (row.piece - 1) * 4096
        out[at : at + len(own)] |= own[: len(out) - at]
    return out.tobytes()


def may_hold(bits: bytes, places: pa.Array) -> pa.Array:
    """Which places are set in the filter: those of all ids in it, and few others unless it is full."""
    at = places.to_numpy().astype(np.int64) - 1
    return pa.array((np.frombuffer(bits, dtype=np.uint8)[at >> 3] >> (at & 7).astype(np.uint8) & 1).view(bool))
