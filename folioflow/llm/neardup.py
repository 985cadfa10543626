"""Near-duplicate documents: fast similarity sketches, banding, exact verification and connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, filter_place, id_filter, mapped, may_hold, mix, run_in_arrow, slices, table, utf8, windows, words
from .graph import components

#: Words of a shingle; similarity as a percentage.
SHINGLE, PERCENT = 5, 75
#: Text bytes hashed at once; a longer text is hashed alone. Hashing takes some 40 bytes for each.
HASHED_BYTES = 1 << 19
#: Coordinates of a sketch are BANDS * ROWS. A pair of similarity 0.75 shares no band with probability (1 - 0.75^4)^32 = 5e-6.
BANDS, ROWS = 32, 4
#: A pair is not verified if this many of its 128 coordinates, of which 4 bits are held, differ. At similarity 0.75 they
#: differ with probability 0.234 each, so that many do with probability 4e-7.
UNLIKE = 59


def shingles(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, joined, and their n + 1 offsets. A text of fewer words has one, of all of them."""
    _, _, hashes, at = words(raw, offsets, lower=True)
    runs = windows(hashes, SHINGLE)
    found = []
    for a, b in zip(at.tolist(), at[1:].tolist()):
        if b - a >= SHINGLE:
            own = np.sort(runs[a : b - SHINGLE + 1])
            found.append(own[np.append(True, own[1:] != own[:-1])])
        elif b > a:
            found.append(mix(windows(hashes[a:b], b - a) + np.uint64(b - a)))
        else:
            found.append(hashes[:0])
    sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
    return np.concatenate(found) if found else np.zeros(0, dtype=np.uint64), np.concatenate([[0], np.cumsum(sizes)])


def sketch(items: np.ndarray, at: np.ndarray, size: int = BANDS * ROWS) -> np.ndarray:
    """Fast similarity sketch of each set: a row of `size` coordinates.

    In round i below `size` each item goes to a hashed bin; in round size + j all go to bin j, so that every bin of a set
    with items fills at last. A bin keeps the least (round, hash). A set stops at the round that fills it, which for n items
    takes size * ln(size) / n rounds as expected, and later rounds couldn't change filled bins.
    """
    n = len(at) - 1
    out = np.full((n, size), np.iinfo(np.uint64).max, dtype=np.uint64)
    sizes = np.diff(at)
    left = np.flatnonzero(sizes > 0)
    flat = out.reshape(-1)
    owner, mine = np.repeat(np.arange(n), sizes), items
    for i in range(2 * size):
        if not len(left):
            break
        hashed = mix(mine + np.uint64((i + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        bins = (hashed >> np.uint64(32)) * np.uint64(size) >> np.uint64(32) if i < size else np.full(len(hashed), i - size, dtype=np.uint64)
        value = (hashed * np.uint64(0xC4CEB9FE1A85EC53)) >> np.uint64(9) | np.uint64(i) << np.uint64(55)
        np.minimum.at(flat, owner * size + bins.astype(np.int64), value)
        open_ = (out[left] == np.iinfo(np.uint64).max).any(axis=1)
        if not open_.all():
            left = left[open_]
            still = np.zeros(n, dtype=bool)
            still[left] = True
            keep = still[owner]
            owner, mine = owner[keep], mine[keep]
    return out


def bands(coordinates: np.ndarray) -> np.ndarray:
    """One hash of each band of ROWS coordinates; the band's number is part of it."""
    grouped = coordinates.reshape(len(coordinates), BANDS, ROWS)
    out = np.zeros(grouped.shape[:2], dtype=np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64)
    for j in range(ROWS):
        out = mix(out * np.uint64(0x9FB21C651E98DF25) + grouped[:, :, j])
    return out


def marks(coordinates: np.ndarray) -> np.ndarray:
    """Four mixed bits of each coordinate, sixteen to a 64-bit number."""
    bits = (mix(coordinates.copy()) >> np.uint64(60)).reshape(len(coordinates), -1, 16)
    return (bits << (np.arange(16, dtype=np.uint64) * np.uint64(4))).sum(axis=2, dtype=np.uint64)


def _differing(a: str, b: str) -> Column:
    """In how many coordinates two marks differ."""
    total = F.lit(0)
    for i in range(BANDS * ROWS // 16):
        x = F.col(a)[i].bitwiseXOR(F.col(b)[i])
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseAND(F.lit(0x1111111111111111))
        total = total + F.bit_count(x)
    return total


def _signatures(items: np.ndarray, at: np.ndarray) -> list[bytes]:
    """128 bits of each set, from sums of its items' hashes; the same for equal sets."""
    sums = []
    for seed in (0x243F6A8885A308D3, 0x13198A2E03707344):
        run = np.concatenate([[np.uint64(0)], np.cumsum(mix(items + np.uint64(seed)), dtype=np.uint64)])
        sums.append(np.diff(run[at]))
    return [bytes(x) for x in np.stack(sums, axis=1).astype(">u8").view("V16").ravel()]


def sketches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n_shingles, sig, bands, marks) of each row; the last three are null for an empty set."""
    key = docs.schema[id_col].dataType.simpleString()

    def each(part: pa.RecordBatch) -> pa.RecordBatch:
        items, at = shingles(*utf8(part.column(1)))
        full = np.diff(at) > 0
        coordinates = sketch(items, at)[full]
        hashed = [bands(coordinates).view(np.int64), marks(coordinates).view(np.int64)]
        lists = [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(full * x.shape[1])]), pa.int32()), pa.array(x.ravel())) for x in hashed]
        sig = pa.array([s if f else None for s, f in zip(_signatures(items, at), full)], pa.binary())
        return pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(at)), sig, *lists], ["doc_id", "n_shingles", "sig", "bands", "marks"])

    return run_in_arrow(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")), each, f"doc_id {key}, n_shingles bigint, sig binary, bands array<bigint>, marks array<bigint>", 1, HASHED_BYTES)


def _sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(sig, items) of the classes in `wanted` (doc_id, sig): whole shingle sets, read again from the texts of one document each."""
    places = docs.sparkSession.sparkContext.broadcast(id_filter(wanted, "doc_id"))

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.filter(may_hold(places.value, batch.column(2))), 1, HASHED_BYTES):
                items, at = shingles(*utf8(part.column(1)))
                full = np.diff(at) > 0
                sig = pa.array(_signatures(items, at), pa.binary()).filter(pa.array(full))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], at[1:][full]]), pa.int32()), pa.array(items.view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column(0).filter(pa.array(full)), sig, lists], ["doc_id", "sig", "items"])

    named_rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("doc_id"), F.col(text_col).cast("string").alias("text"), filter_place(id_col))
    found = mapped(named_rows, go, "doc_id string, sig binary, items array<bigint>")
    named = wanted.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), "sig")
    return found.join(named, ["doc_id", "sig"]).dropDuplicates(["sig"]).select("sig", "items")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of signatures with their shared and united shingles counted on the whole sets."""
    left = pairs.join(sets.select(F.col("sig").alias("a"), F.col("items").alias("x")), "a")
    both = left.join(sets.select(F.col("sig").alias("b"), F.col("items").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y")).cast("bigint")
    return both.select("a", "b", shared.alias("shared"), (F.size("x") + F.size("y") - shared).cast("bigint").alias("united"))


def _unsettled(state: DataFrame, final: DataFrame) -> DataFrame:
    """Rows (band, sig, marks, root) of the buckets that still hold several components."""
    now = state.join(final, F.col("sig") == F.col("node"), "left").select("band", "sig", "marks", F.coalesce("root", "sig").alias("root"))
    mixed = now.groupBy("band").agg(F.min("root").alias("r"), F.max("root").alias("s")).where("r <> s").select("band")
    return table(now.join(mixed, "band"), "unsettled")


def _reachable(state: DataFrame, sets: DataFrame) -> DataFrame:
    """(sig, n, c) of the classes in `state` that a class of another component can still be similar to: n are its shingles, and c
    those of them that some class of another component in `state` has too; no such class shares more.

    Similarity 0.75 needs c >= 0.75 n. A text that differs from its group by words of its own fails here, without being
    compared with the group's members.
    """
    each = table(state.select("sig", "root").distinct().join(sets, "sig").select("sig", "root", F.size("items").alias("n"), F.explode("items").alias("item")), "open-items")
    common = each.groupBy("item").agg(F.min("root").alias("r"), F.max("root").alias("s")).where("r <> s").select("item")
    counts = each.join(common, "item").groupBy("sig").agg(F.max("n").alias("n"), F.count("*").alias("c")).where(F.col("c") * 100 >= F.col("n") * PERCENT)
    out = table(counts, "reachable")
    discard(each)
    return out


def _measured(state: DataFrame, reach: DataFrame, centres: DataFrame, tested: DataFrame) -> DataFrame:
    """`state` of the classes in `reach`, with the centre of each row's bucket and `held`, the shingles shared with it; null if that
    pair was not verified."""
    placed = state.join(reach, "sig").join(centres.select("band", F.col("c.sig").alias("centre")), "band").withColumn("a", F.least("sig", "centre")).withColumn("b", F.greatest("sig", "centre"))
    held = F.when(F.col("sig") == F.col("centre"), F.col("n")).otherwise(F.col("shared"))
    return table(placed.join(tested.select("a", "b", "shared"), ["a", "b"], "left").select("band", "centre", "sig", "root", "marks", "n", "c", held.alias("held")), "measured")


def _enough(shared: Column) -> Column:
    """Whether sets of n and m shingles that share at most so many can be linked."""
    return shared * 100 >= (F.col("n") + F.col("m") - shared) * PERCENT


def _open_pairs(state: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of one bucket, of two components, that can still be linked.

    With a bucket's centre z, sets x and y share at most min(|x & z|, |y & z|) shingles of z. Where that is not enough, they
    must share a shingle that z has not, and such pairs are found by those shingles: two texts that were changed in different
    places from the same original are never compared.
    """
    alike = (F.col("root") < F.col("other")) & (_differing("marks", "other_marks") < UNLIKE)
    renamed = lambda df, *keys: df.select(*keys, F.col("sig").alias("b"), F.col("root").alias("other"), F.col("marks").alias("other_marks"), F.col("n").alias("m"), F.col("c").alias("d"), F.col("held").alias("other_held"))
    pair = (F.least("sig", "b").alias("a"), F.greatest("sig", "b").alias("b"))
    either = F.least("c", "d")
    within = F.when(F.col("held").isNull() | F.col("other_held").isNull(), either).otherwise(F.least(either, "held", "other_held"))
    inside = state.join(renamed(state, "band"), "band").where(alike & _enough(within)).select(*pair)
    known = state.where("held IS NOT NULL").drop("band").distinct()
    items = known.join(sets, "sig").join(sets.select(F.col("sig").alias("centre"), F.col("items").alias("own")), "centre")
    extra = table(items.select("centre", "sig", "root", "marks", "n", "c", "held", F.explode(F.array_except("items", "own")).alias("item")), "extra")
    common = extra.groupBy("centre", "item").agg(F.min("root").alias("r"), F.max("root").alias("s")).where("r <> s").select("centre", "item")
    extra = extra.join(common, ["centre", "item"])
    most = F.least(either, F.least("held", "other_held") + F.least(F.col("n") - F.col("held"), F.col("m") - F.col("other_held")))
    beside = extra.join(renamed(extra, "centre", "item"), ["centre", "item"]).where(alike & _enough(most)).select(*pair)
    return inside.unionByName(beside).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: (doc_id, n_shingles, component_id, kept).

    Documents whose sets of word shingles have similarity 0.75 or more are linked; component_id is the least doc_id that
    links reach, and a document is kept if that is its own. Null, empty and wordless texts have no shingles and stay alone.
    Rows that repeat get the same answer each. Of rows with a null doc_id, alone, component_id is null and kept true.

    Documents with equal sets form one class, which is sketched once and never expanded. Every class is verified against one
    centre in each of its buckets, the class that meets the most others, and components are formed; buckets that lie in one
    component are done. In the others, all pairs across components are verified that the counts of shared shingles and the
    sketches allow (see _reachable and _open_pairs). So the pairs inside a group of copies are not expanded, and no link
    between components is lost.
    """
    rows = table(sketches(docs, id_col, text_col), "sketches")
    classes = table(rows.where("sig is not null").groupBy("sig").agg(F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands"), F.first("marks").alias("marks")), "classes")
    members = classes.select("sig", F.explode("bands").alias("band"))
    shared = members.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    inside = table(members.join(shared, "band").select("band", "sig", "n"), "bucket-members")
    # A class that meets many others comes first as a centre: the text that a group was copied from meets the most.
    weights = inside.groupBy("sig").agg(F.sum("n").alias("weight"))
    needed = table(weights.join(classes.select("sig", "doc_id", "marks"), "sig"), "needed")
    sets = table(_sets(docs, needed, id_col, text_col), "sets")
    members_of = table(inside.join(needed.select("sig", "weight", "marks"), "sig").select("band", "sig", "weight", "marks"), "members")
    discard(inside, needed)
    linked = F.col("shared") * 100 >= F.col("united") * PERCENT
    centres = members_of.groupBy("band").agg(F.max_by(F.struct("sig", "marks"), F.struct("weight", F.xxhash64("sig"))).alias("c"))
    pairs = members_of.join(centres, "band").where((F.col("sig") != F.col("c.sig")) & (_differing("marks", "c.marks") < UNLIKE)).select(F.least("sig", "c.sig").alias("a"), F.greatest("sig", "c.sig").alias("b")).distinct()
    tested = table(_verified(pairs, sets), "links")
    final = components(tested.where(linked).select("a", "b"))
    unsettled = _unsettled(members_of, final)
    reach = _reachable(unsettled, sets)
    state = _measured(unsettled, reach, centres, tested)
    discard(members_of, unsettled, reach)
    rest = _open_pairs(state, sets).join(tested, ["a", "b"], "left_anti")
    more = table(_verified(rest, sets).where(linked).select("a", "b"), "more-links")
    discard(sets, state, tested)
    if more.limit(1).count():
        final = components(final.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))
    placed = classes.select("sig", "doc_id").join(final, F.col("sig") == F.col("node")).select("sig", "doc_id", "root")
    least = placed.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    moved = placed.join(least, "root").select("sig", "component_id")
    answer = table(classes.select("sig", "doc_id").join(moved, "sig", "left").select("sig", F.coalesce("component_id", "doc_id").alias("component_id")), "answer")
    discard(classes)
    full = rows.select("doc_id", "n_shingles", "sig").join(answer, "sig", "left")
    alone = F.when(F.col("sig").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return full.select("doc_id", "n_shingles", alone.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
