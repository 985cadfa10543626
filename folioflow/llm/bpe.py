"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue."""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator, MutableSequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hashed, mapped, resident, slices, texts, utf8

#: Bounds of a worker's cache: pieces, of some 40 bytes each, and the longest in bytes. They bound memory only: what is not
#: cached is merged anew.
CACHED_PIECES, CACHED_BYTES = 500_000, 64
#: Text bytes encoded at once; a longer text is encoded alone.
ENCODED_BYTES = 1 << 18
#: Bytes of pre-tokens that share one queue; a longer pre-token has a queue of its own.
QUEUE_BYTES = 1 << 16
#: Ranks below this are popped a whole bucket at a time with array operations, as their buckets are long.
LOW_RANKS = 1200
#: Ranks under one leaf of the bitmap, as a power of two.
_LEAF = 8


def read_ranks(path: str) -> bytes:
    """The rank file at `path` (lines of base64 token and rank); its size is fixed by the vocabulary, not by the data."""
    with open(path, "rb") as f:
        return f.read()


class RankQueue:
    """Buckets of linked-list positions by merge rank. A two-level bitmap marks the buckets in use; find-first-set picks the lowest rank."""

    __slots__ = ("root", "leaves", "buckets")

    def __init__(self, n_ranks: int):
        self.root = 0
        self.leaves = [0] * ((n_ranks >> _LEAF) + 1)
        self.buckets: list[list[int] | None] = [None] * n_ranks

    def push(self, rank: int, positions: list[int]) -> None:
        bucket = self.buckets[rank]
        if bucket is not None:
            bucket += positions
            return
        self.buckets[rank] = positions
        leaf = rank >> _LEAF
        self.leaves[leaf] |= 1 << (rank & 255)
        self.root |= 1 << leaf

    def pop(self) -> tuple[int, list[int]]:
        """The lowest rank in use and its bucket, leftmost position first; the queue must not be empty."""
        root = self.root
        leaf = (root & -root).bit_length() - 1
        bits = self.leaves[leaf]
        low = bits & -bits
        self.leaves[leaf] = bits = bits ^ low
        if not bits:
            self.root = root ^ (1 << leaf)
        rank = (leaf << _LEAF) + low.bit_length() - 1
        bucket = self.buckets[rank]
        self.buckets[rank] = None
        bucket.sort()
        return rank, bucket


class Pieces:
    """Ids of short pieces of text by the hash of their bytes: sorted hashes, each with a run of ids in one pool."""

    def __init__(self):
        self.keys, self.at, self.size = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int32)
        self.asked = np.zeros(0, dtype=bool)
        self.pool, self.held = np.zeros(1 << 16, dtype=np.int32), 0

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key, or -1."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        rows = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        rows[self.keys[rows] != keys] = -1
        self.asked[rows[rows >= 0]] = True
        return rows

    def add(self, keys: np.ndarray, ids: np.ndarray, size: np.ndarray) -> None:
        """Add keys, sorted, with `size` ids each; those that are there already stay as they are."""
        new = self.find(keys) < 0
        if not new.all():
            keys, ids, size = keys[new], ids[np.repeat(new, size)], size[new]
        if len(self.keys) + len(keys) > CACHED_PIECES:
            self._forget()
        if self.held + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.held], np.zeros(self.held + 2 * len(ids), dtype=np.int32)])
        self.pool[self.held : self.held + len(ids)] = ids
        place = np.searchsorted(self.keys, keys)
        self.at = np.insert(self.at, place, self.held + np.cumsum(size) - size)
        self.size, self.asked = np.insert(self.size, place, size), np.insert(self.asked, place, False)
        self.keys = np.insert(self.keys, place, keys)
        self.held += len(ids)

    def _forget(self) -> None:
        """Keep what was asked for since the last time, or nothing if that is nearly all."""
        keep = np.flatnonzero(self.asked & (self.asked.sum() < 3 * CACHED_PIECES // 4))
        ids = self.pool[_runs(self.at[keep], self.size[keep])]
        self.keys, self.size = self.keys[keep], self.size[keep]
        self.at = np.cumsum(self.size, dtype=np.int64) - self.size
        self.asked = np.zeros(len(keep), dtype=bool)
        self.pool, self.held = ids, len(ids)


def _runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of each run, joined."""
    ends = np.cumsum(sizes, dtype=np.int64)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


def _list(x: np.ndarray) -> MutableSequence[int]:
    """As a list, or as a more compact array if it is long."""
    return x.tolist() if len(x) <= 2 * QUEUE_BYTES else array("q", x.astype(np.int64).tobytes())


#: Bytes after a space before which a text is cut: not white space, and not the first byte of a character that may be.
_STARTS = np.ones(256, dtype=bool)
_STARTS[[*range(0x09, 0x0E), *range(0x1C, 0x21), 0xC2, 0xE1, 0xE2, 0xE3]] = False


class Codec:
    """Encoder and decoder for one vocabulary. `pattern` cuts a text into pre-tokens that are merged separately.

    Texts are first cut before spaces that a non-space follows. The pattern can match no space inside a token that has a
    non-space after it, so such a place is always a token's start, and the pieces between can be cached whole.
    """

    def __init__(self, ranks: bytes, pattern: str):
        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line.strip())}
        self.size = max(self.ranks.values()) + 1
        self.find = regex.compile(pattern).findall
        #: Rank of each pair of tokens: of the token with their bytes.
        self.pairs = {self.ranks[t[:i]] * (self.size + 1) + self.ranks[t[i:]]: r for t, r in self.ranks.items() for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks}
        self.bytes = np.array([self.ranks[bytes([i])] for i in range(256)], dtype=np.int64)
        self.byte_pairs = np.array([[self.ranks.get(bytes([a, b]), -1) for b in range(256)] for a in range(256)], dtype=np.int64)
        #: The same for pairs of tokens below `low` (0 if single bytes aren't all below it), the last row and column for the mark.
        self.low = min(LOW_RANKS, self.size) if self.bytes.max() < LOW_RANKS else 0
        self.low_pairs = np.full((self.low + 1, self.low + 1), -1, dtype=np.int32)
        #: Tokens that can make a pair of lower rank than their own.
        self.turns = set()
        for key, rank in self.pairs.items():
            a, b = divmod(key, self.size + 1)
            if a < self.low and b < self.low:
                self.low_pairs[a, b] = rank
            self.turns.update(x for x in (a, b) if rank < x)
        tokens = [b""] * self.size
        for token, rank in self.ranks.items():
            tokens[rank] = token
        self.lengths = np.array([len(t) for t in tokens], dtype=np.int64)
        self.places = np.concatenate([[0], np.cumsum(self.lengths)])[:-1]
        self.flat = np.frombuffer(b"".join(tokens), dtype=np.uint8)
        self.queue = RankQueue(self.size)
        self.pieces = Pieces()

    def merge(self, items: list[bytes]) -> list[bytes]:
        """Packed ids of each pre-token: again and again its leftmost pair of lowest rank becomes one token.

        All items stand in one linked list, ended by a mark that pairs with nothing, and share one rank queue. The queue
        gives ranks in rising order, so each item sees its own lowest rank first; a bucket's entry whose pair has changed
        since is stale and skipped. If a merge makes a pair of lower rank, the rest of the bucket goes back.
        """
        mark, queue, get, step = self.size, self.queue, self.pairs.get, self.size + 1
        data = np.frombuffer(b"\0".join(items) + b"\0", dtype=np.uint8)
        n = len(data)
        ends = np.cumsum(np.array([len(x) + 1 for x in items])) - 1
        tok_np = self.bytes[data]
        tok_np[ends] = mark
        first = np.append(self.byte_pairs[data[:-1], data[1:]], -1)
        first[ends] = first[ends[ends > 0] - 1] = -1
        at = np.flatnonzero(first >= 0)
        at = at[np.argsort(first[at], kind="stable")]
        starts = np.flatnonzero(np.diff(first[at], prepend=-1))
        for rank, positions in zip(first[at[starts]].tolist(), np.split(at, starts[1:])):
            if len(at):
                queue.push(rank, positions.tolist())
        tok, now, after, before = self._merge_low(tok_np, first)  # now: rank of the pair that starts here
        tok.append(mark)
        buckets, push = queue.buckets, queue.push
        while queue.root:
            rank, bucket = queue.pop()
            for at, i in enumerate(bucket):
                if now[i] != rank:
                    continue
                j = after[i]
                k = after[i] = after[j]
                before[k] = i
                tok[i] = rank
                tok[j] = now[j] = -1
                right = now[i] = get(rank * step + tok[k], -1)
                if right >= 0:
                    if buckets[right] is None:
                        push(right, [i])
                    else:
                        buckets[right].append(i)
                p = before[i]
                left = -1
                if p >= 0:
                    left = now[p] = get(tok[p] * step + rank, -1)
                    if left >= 0:
                        if buckets[left] is None:
                            push(left, [p])
                        else:
                            buckets[left].append(p)
                if 0 <= right < rank or 0 <= left < rank:
                    push(rank, bucket[at + 1 :])
                    break
        out = np.array(tok[:n], dtype=np.int32)
        out = out[out >= 0]
        ends = np.flatnonzero(out == mark).tolist()
        flat = out.tobytes()
        return [flat[4 * a : 4 * b] for a, b in zip([0, *(x + 1 for x in ends)], ends)]

    def _merge_low(self, tok: np.ndarray, now: np.ndarray) -> tuple[MutableSequence[int], ...]:
        """Empty the queue's buckets of low rank, each at once, and give the linked list.

        Merges in one bucket don't depend on each other except for overlapping pairs, of which every other one of a run is
        merged from its left end on, and for adjacent pairs whose token can make a pair of lower rank: these end this phase.
        """
        n, low, queue = len(tok), self.low, self.queue
        if not low:
            return _list(tok), _list(now), _list(np.arange(1, n + 1)), _list(np.arange(-1, n))
        tok = np.append(np.where(tok == self.size, low, tok), low)
        after, before = np.arange(1, n + 1), np.arange(-1, n)
        while queue.root:
            rank, bucket = queue.pop()
            if rank >= low:
                queue.push(rank, bucket)
                break
            at = np.array(bucket)
            at = at[now[at] == rank]
            if len(at) > 1:
                at = at[np.append(True, at[1:] != at[:-1])]
                joint = before[at[1:]] == at[:-1]
                if joint.any():
                    t = np.arange(len(at))
                    start = np.maximum.accumulate(np.where(np.append(False, joint), 0, t))
                    at = at[(t - start) % 2 == 0]
                if rank in self.turns and (after[after[at[:-1]]] == at[1:]).any():
                    queue.push(rank, bucket)
                    break
            nxt = after[at]
            end = after[nxt]
            after[at], before[end] = end, at
            tok[at], tok[nxt], now[nxt] = rank, -1, -1
            right = now[at] = self.low_pairs[rank, tok[end]]
            prior = before[at]
            prior, here = prior[prior >= 0], at[prior >= 0]
            left = now[prior] = self.low_pairs[tok[prior], tok[here]]
            where, ranks = np.concatenate([at, prior]), np.concatenate([right, left])
            where, ranks = where[ranks >= 0], ranks[ranks >= 0]
            order = np.argsort(ranks, kind="stable")
            where, ranks = where[order], ranks[order]
            cuts = np.flatnonzero(np.diff(ranks, prepend=-1)).tolist()
            heads, where = ranks[cuts].tolist(), where.tolist()
            for head, a, b in zip(heads, cuts, [*cuts[1:], len(where)]):
                queue.push(head, where[a:b])
        return _list(np.where(tok[:n] == low, self.size, tok[:n])), _list(now), _list(after), _list(before)

    def learn(self, pieces: list[str], cached: bool = True) -> list[bytes]:
        """Packed ids of whole pieces. Their pre-tokens that are not cached are merged, as many at once as QUEUE_BYTES allows."""
        cut = [self.find(x) for x in pieces]
        known = dict.fromkeys(x for found in cut for x in found)
        items = [x.encode("utf-8") for x in known]
        raw = np.frombuffer(b"".join(items), dtype=np.uint8)
        ends = np.cumsum(np.fromiter(map(len, items), dtype=np.int64, count=len(items)))
        starts = np.append(0, ends)[:-1]
        keys = hashed(raw, starts, ends) if cached and len(raw) else np.zeros(len(items), dtype=np.uint64)
        rows = self.pieces.find(keys) if cached else np.full(len(items), -1)
        at, size, pool = self.pieces.at, self.pieces.size, self.pieces.pool
        out: list[bytes] = [pool[at[r] : at[r] + size[r]].tobytes() if r >= 0 else b"" for r in rows.tolist()]
        missing = np.flatnonzero(rows < 0)
        lots = np.cumsum(ends[missing] - starts[missing]) // QUEUE_BYTES
        for lot in np.split(missing, np.flatnonzero(np.diff(lots)) + 1) if len(missing) else ():
            for i, ids in zip(lot.tolist(), self.merge([items[i] for i in lot.tolist()])):
                out[i] = ids
        short = missing[(ends - starts)[missing] <= CACHED_BYTES]
        if cached and len(short):
            short = short[np.argsort(keys[short])]
            self.pieces.add(keys[short], np.frombuffer(b"".join([out[i] for i in short.tolist()]), dtype=np.int32), np.array([len(out[i]) >> 2 for i in short.tolist()]))
        known = dict(zip(known, out))
        return [known[found[0]] if len(found) == 1 else b"".join([known[x] for x in found]) for found in cut]

    def encode_all(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (joined bytes and their n + 1 offsets), joined, and the n + 1 offsets of the texts in them."""
        n = len(raw)
        if not n:
            return np.zeros(0, dtype=np.int32), np.zeros(len(offsets), dtype=np.int64)
        cut = raw == 0x20
        cut[:-1] &= _STARTS[raw[1:]]
        cut[offsets[1:][offsets[1:] > 0] - 1] = False
        cut[offsets[:-1][offsets[:-1] < n]] = True
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], n)
        keys, first, inverse = np.unique(hashed(raw, starts, ends), return_index=True, return_inverse=True)
        rows = self.pieces.find(keys)
        known, missing = np.flatnonzero(rows >= 0), np.flatnonzero(rows < 0)
        size = np.zeros(len(keys), dtype=np.int64)
        size[known] = self.pieces.size[rows[known]]
        parts = [self.pieces.pool[_runs(self.pieces.at[rows[known]], size[known])]]
        at = np.zeros(len(keys), dtype=np.int64)
        at[known] = np.cumsum(size[known]) - size[known]
        if len(missing):
            data = raw.tobytes()
            a, b = starts[first[missing]], ends[first[missing]]
            packed = self.learn([data[i:j].decode("utf-8", "replace") for i, j in zip(a.tolist(), b.tolist())])
            size[missing] = own = np.fromiter((len(x) >> 2 for x in packed), dtype=np.int64, count=len(packed))
            ids = np.frombuffer(b"".join(packed), dtype=np.int32)
            at[missing] = len(parts[0]) + np.cumsum(own) - own
            parts.append(ids)
            short = b - a <= CACHED_BYTES
            self.pieces.add(keys[missing[short]], ids[np.repeat(short, own)], own[short])
        sizes = size[inverse]
        out = np.concatenate(parts)[_runs(at[inverse], sizes)]
        return out, np.concatenate([[0], np.cumsum(sizes)])[np.searchsorted(starts, offsets)]

    def encode_alone(self, text: str) -> np.ndarray:
        """Ids of one text, without the cache."""
        return np.frombuffer(b"".join(self.learn([text], cached=False)), dtype=np.int32)

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of all ids, joined."""
        return self.flat[_runs(self.places[ids], self.lengths[ids])]

    def both(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, their offsets and the decoded bytes. Should two pieces share a hash, decoding shows it, and no piece is taken from the cache."""
        ids, at = self.encode_all(raw, offsets)
        decoded = self.decode(ids)
        if not np.array_equal(decoded, raw):
            data, cuts = raw.tobytes(), offsets.tolist()
            each = [self.encode_alone(data[a:b].decode("utf-8", "replace")) for a, b in zip(cuts, cuts[1:])]
            ids, at = np.concatenate(each), np.cumsum([0, *map(len, each)])
            decoded = self.decode(ids)
        return ids, at, decoded


def codec(ranks: bytes, pattern: str) -> Codec:
    """One codec per worker process and vocabulary."""
    return resident(("bpe", hash(ranks), pattern), lambda: Codec(ranks, pattern))


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = False) -> DataFrame:
    """Encode every whole text and decode the ids again: (doc_id, n_tokens, ids_sha256, decoded_sha256[, ids]).

    A null or empty text has no tokens and the digests of empty strings. Null ids and repeated rows pass through; other
    columns of `docs` are not read, so clashing names don't matter. No shuffle; memory is one Arrow batch and a bounded cache.
    """
    blob = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    key = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {key}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(blob.value, pattern)
        for batch in batches:
            for part in slices(batch, 1, ENCODED_BYTES):
                got, at, data = own.both(*utf8(part.column(1)))
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(got))
                joined = pc.binary_join(pa.ListArray.from_arrays(lists.offsets, pc.cast(lists.values, pa.string())), " ")
                ends = np.concatenate([[0], np.cumsum(own.lengths[got])])[at].tolist()
                view = memoryview(data)
                digests = [hashlib.sha256(x).hexdigest() for x in texts(joined)]
                decoded = [hashlib.sha256(view[a:b]).hexdigest() for a, b in zip(ends, ends[1:])]
                columns = [part.column(0), pa.array(np.diff(at), pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())]
                if ids:
                    columns.append(lists)
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: len(columns)])

    return mapped(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")), go, schema)


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) of every whole text, null texts as empty."""
    return round_trip(docs, ranks_path, pattern, id_col, text_col, ids=True).select("doc_id", "ids")


def decode(encoded: DataFrame, ranks_path: str, pattern: str, ids_col: str = "ids") -> DataFrame:
    """Replace the column of ids by `text`; bytes that aren't UTF-8 become U+FFFD. Null ids give a null text."""
    blob = encoded.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    kept = [c for c in encoded.columns if c not in (ids_col, "text")]
    frame = encoded.select(ids_col, *kept)
    schema = ", ".join([f"`{c}` {encoded.schema[c].dataType.simpleString()}" for c in kept] + ["text string"])

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(blob.value, pattern)
        for batch in batches:
            text = [None if x is None else own.decode(np.array(x, dtype=np.int64)).tobytes().decode("utf-8", "replace") for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(text, pa.string())], [*kept, "text"])

    return mapped(frame, go, schema)
