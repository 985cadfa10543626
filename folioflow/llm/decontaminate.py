"""Benchmark decontamination: one Aho-Corasick automaton over the normalised windows of the test items."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import carried, discard, resident, run_in_arrow, schema_of, table, utf8, words

#: Item text in one automaton, in bytes; it takes some hundred times as much memory. A larger benchmark is scanned in several
#: rounds, one after the other, each with an automaton of its own.
AUTOMATON_BYTES = 3 << 20

#: Breaks between words: all ASCII but digits and letters (A-Z are lower-cased before).
BREAKS = np.zeros(256, dtype=bool)
BREAKS[[x for x in range(0x80) if not chr(x).isalnum()]] = True

#: Code points that stand for words in the automaton's alphabet, the first of them for any word that no item has; a vocabulary
#: beyond them gets two for each word, one of either half.
_CODES = np.array([x for x in range(1, 0x110000) if not 0xD800 <= x < 0xE000], dtype=np.uint32)


@dataclass
class Machine:
    """The automaton over words as symbols. `hashes` (sorted) and `names` are the items' words, `codes` their code points."""

    automaton: ahocorasick.Automaton
    hashes: np.ndarray
    names: list[bytes]
    codes: np.ndarray

    def symbols(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """Code points of words, a row each. A word is one of the items' only if its bytes are equal."""
        if not len(self.hashes) or not len(hashes):
            return np.tile(_CODES[:1], (len(hashes), self.codes.shape[1]))
        row = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        known = np.flatnonzero(self.hashes[row] == hashes)
        own, first = np.unique(row[known], return_index=True)
        data = raw.tobytes()
        other = [r for r, i in zip(own.tolist(), known[first].tolist()) if data[starts[i] : ends[i]].lower() != self.names[r]]
        out = np.tile(_CODES[:1], (len(hashes), self.codes.shape[1]))
        known = known[~np.isin(row[known], other)] if other else known
        out[known] = self.codes[row[known]]
        return out


def machine(items: list[bytes], size: int) -> Machine:
    """The automaton of the windows of all items: each run of `size` words, or all words of an item with fewer. A window's value
    is its number of words and the places of its items in `items`."""
    raw, offsets = utf8(pa.array(items, pa.binary()))
    starts, ends, hashes, at = words(raw, offsets, lower=True, breaks=BREAKS)
    known, first, which = np.unique(hashes, return_index=True, return_inverse=True)
    data = raw.tobytes()
    names = [data[starts[i] : ends[i]].lower() for i in first.tolist()]
    if len(known) < len(_CODES) - 1:
        codes = _CODES[1 : len(known) + 1, None]
    else:
        half = len(_CODES) // 2
        number = np.arange(len(known))
        codes = np.stack([_CODES[1 + number // half], _CODES[half + number % half]], axis=1)
    width = codes.shape[1]
    text = codes[which].tobytes().decode("utf-32-le")
    owners: dict[str, list[int]] = {}
    for place, (a, b) in enumerate(zip(at.tolist(), at[1:].tolist())):
        for i in range(a, max(a + 1, b - size + 1) if b > a else a):
            mine = owners.setdefault(text[i * width : min(i + size, b) * width], [])
            if not mine or mine[-1] != place:
                mine.append(place)
    out = ahocorasick.Automaton()
    for window, places in owners.items():
        out.add_word(window, (len(window) // width, places))
    if owners:
        out.make_automaton()
    return Machine(out, known, names, codes)


def blocks(benchmark: DataFrame, id_col: str, text_col: str, limit: int) -> Iterator[list[tuple[object, bytes]]]:
    """Items in runs of at most `limit` bytes (one item at least), as the driver reads them partition by partition."""
    run, have = [], 0
    for row in benchmark.select(F.col(id_col).alias("item"), F.col(text_col).cast("string").alias("text")).where("text is not null").toLocalIterator():
        data = row.text.encode("utf-8")
        if run and have + len(data) > limit:
            yield run
            run, have = [], 0
        run.append((row.item, data))
        have += len(data)
    yield run


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", keep: bool = False, limit: int = AUTOMATON_BYTES) -> DataFrame:
    """Per document: (doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans[, text, row]).

    A word is hit inside any occurrence of a window of an item. `spans` are the hit stretches as "start:end" code points of the
    original text, comma-joined. Null or wordless texts have no words, hits or items; items with a null text are not used, and
    an item with a null id hits words but is not listed. Equal item ids count once; repeated rows pass through. `keep` carries
    the text and all other columns along (see common.restored), whatever their names.

    No shuffle: documents stream through the automaton, each text once. At most `limit` bytes of items are on the driver and
    broadcast at a time; a benchmark of more takes a round for each run of so many, with the hits so far written between them.
    """
    spark = docs.sparkSession
    start = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.lit(None).cast("array<int>").alias("hits"), F.lit(None).cast("array<string>").alias("items"), *[carried(docs, id_col, text_col)] * keep)
    frame, more, last = start, ("row",) * keep, None
    for run in blocks(benchmark, item_col, item_text_col, limit):
        if last is not None:
            written = table(run_in_arrow(frame, _round(last, size, False), schema_of(frame, "text string, hits array<int>, items array<string>", more), 1), "hits")
            if frame is not start:
                discard(frame)
            frame = written
        last = spark.sparkContext.broadcast(run)
    own = "n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean, spans string"
    return run_in_arrow(frame, _round(last, size, True, keep), schema_of(frame, own, (("text",) if keep else ()) + more), 1)


def _round(shared, size: int, final: bool, keep: bool = False):
    """One scan: adds hits (starts and ends of runs of words) and items of a block; the final one gives the answer."""
    token = uuid.uuid4().hex

    def each(part: pa.RecordBatch) -> pa.RecordBatch:
        run = shared.value
        own = resident(("decontamination", token), lambda: machine([t for _, t in run], size))
        raw, offsets = utf8(part.column(1))
        starts, ends, hashes, at = words(raw, offsets, lower=True, breaks=BREAKS)
        codes = own.symbols(raw, starts, ends, hashes)
        width, cuts = codes.shape[1], at.tolist()
        all_hits, all_items = [], []
        for a, b, had, listed in zip(cuts, cuts[1:], part.column(2).to_pylist(), part.column(3).to_pylist()):
            hits, places = had or [], set()
            if b > a and len(own.automaton):
                for end, (n, mine) in own.automaton.iter(codes[a:b].tobytes().decode("utf-32-le")):
                    hits += [(end + 1) // width - n, (end + 1) // width]
                    places.update(mine)
            all_hits.append(hits)
            all_items.append(sorted({*(listed or ()), *(str(run[i][0]) for i in places if run[i][0] is not None)}))
        if not final:
            columns = [part.column(0), part.column(1), pa.array(all_hits, pa.list_(pa.int32())), pa.array(all_items, pa.list_(pa.string())), *part.columns[4:]]
            return pa.RecordBatch.from_arrays(columns, part.schema.names)
        points = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
        stretches = [_joined(hits) for hits in all_hits]
        spans = [",".join(f"{points[starts[a + x]] - points[o]}:{points[ends[a + y - 1]] - points[o]}" for x, y in s) for s, a, o in zip(stretches, cuts, offsets.tolist())]
        n_hit = [sum(y - x for x, y in s) for s in stretches]
        columns = [
            part.column(0), pa.array(np.diff(at), pa.int64()), pa.array(n_hit, pa.int64()), pa.array([len(x) for x in all_items], pa.int64()),
            pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in all_items], pa.string()), pa.array([n > 0 for n in n_hit], pa.bool_()), pa.array(spans, pa.string()),
        ]
        names = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans"]
        if keep:
            return pa.RecordBatch.from_arrays([*columns, part.column(1), part.column(4)], [*names, "text", "row"])
        return pa.RecordBatch.from_arrays(columns, names)

    return each


def _joined(ends: list[int]) -> list[tuple[int, int]]:
    """Union of half-open runs given as a flat list of starts and ends."""
    out: list[list[int]] = []
    for a, b in sorted(zip(ends[::2], ends[1::2])):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]
