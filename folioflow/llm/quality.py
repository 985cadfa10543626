"""Quality rules: counting rules, and a hashed n-gram log-likelihood ratio between trusted and raw text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, carried, filter_place, id_filter, mapped, may_hold, run_in_arrow, schema_of, slices, utf8, windows, words

#: Bytes of an n-gram, and the power of two of the hashed buckets that both multinomials share.
GRAM, BUCKET_BITS = 4, 16
#: Mean log-ratio below which a document is rejected, and the n-grams of ratio 0 that each text gets in advance,
#: so that a few odd n-grams don't decide about a very short text.
THRESHOLD, PRIOR_GRAMS = -0.35, 50

_SYMBOLS = np.zeros(256, dtype=bool)
_SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
_NEWLINE = np.zeros(256, dtype=bool)
_NEWLINE[0x0A] = True


@dataclass(frozen=True)
class Ratio:
    """Log-ratio of each bucket."""

    weights: np.ndarray


def grams(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of the texts, and the n + 1 offsets of each text's n-grams among them."""
    lengths = np.maximum(np.diff(offsets) - (GRAM - 1), 0)
    out = np.concatenate([[0], np.cumsum(lengths)])
    n = len(raw) - (GRAM - 1)
    if n <= 0:
        return np.zeros(0, dtype=np.int64), np.zeros(len(offsets), dtype=np.int64)
    key = np.zeros(n, dtype=np.uint32)
    for j in range(GRAM):
        key |= raw[j : j + n].astype(np.uint32) << np.uint32(8 * j)
    key *= np.uint32(2654435769)
    key ^= key >> np.uint32(15)
    key *= np.uint32(0x85EBCA6B)
    key >>= np.uint32(32 - BUCKET_BITS)
    inside = np.ones(n, dtype=bool)
    for end in offsets[1:-1]:  # n-grams that reach from one text into the next
        inside[max(0, end - GRAM + 1) : end] = False
    return key[inside].astype(np.int64), out


def fit(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Ratio:
    """Count n-grams of all whole texts, and of all those whose id is in `trusted`, into hashed buckets.

    `trusted` has a column doc_id; its repeated and null ids count for nothing. A bitmap of its ids, of fixed size, spares most
    other texts the exact join by id, which is one of sorted rows at every size. Counts are added up in each task and then by bucket, so what is shuffled of them is
    2^BUCKET_BITS rows a task at most, and as many reach the driver. Both multinomials get the same mass and one more of each
    bucket: log((t + 1) / (r + 1)) with r scaled to t's total. Null texts count for nothing. Without trusted text all ratios
    are 0.
    """
    spark = docs.sparkSession
    ids = trusted.select(F.col("doc_id").cast("string").alias("doc_id")).where("doc_id is not null").distinct()
    bits = spark.sparkContext.broadcast(id_filter(ids, "doc_id"))

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = batch.filter(may_hold(bits.value, batch.column(2)))
            yield pa.RecordBatch.from_arrays(kept.columns[:2], ["doc_id", "text"])

    named = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).cast("string").alias("text"), filter_place(id_col)).where("text is not null")
    target = _counts(mapped(named.where("doc_id is not null"), likely, "doc_id string, text string").join(ids.hint("merge"), "doc_id", "left_semi").select("text"), "t")
    raw_counts = _counts(named.select("text"), "n")
    total = target.sum()
    if not total:
        return Ratio(np.zeros(1 << BUCKET_BITS, dtype=np.float32))
    return Ratio(np.log((target + 1) / (raw_counts * (total / raw_counts.sum()) + 1)).astype(np.float32))


def _counts(texts: DataFrame, name: str) -> np.ndarray:
    """How many n-grams of a frame (text) fall into each bucket; `name` is that of the count."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(1 << BUCKET_BITS, dtype=np.int64)
        for batch in batches:
            for part in slices(batch, 0):
                own += np.bincount(grams(*utf8(part.column(0)))[0], minlength=len(own))
        full = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(own[full])], ["bucket", name])

    rows = mapped(texts, count, f"bucket bigint, {name} bigint").groupBy("bucket").agg(F.sum(name).alias(name)).toArrow()
    out = np.zeros(1 << BUCKET_BITS)
    out[rows.column("bucket").to_numpy()] = rows.column(name).to_numpy()
    return out


def measure(raw: np.ndarray, offsets: np.ndarray, weights: np.ndarray) -> dict[str, np.ndarray]:
    """The counts and the score of each text."""
    n_docs = len(offsets) - 1
    per_text = lambda flags, at: np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[at])
    starts, ends, hashes, at = words(raw, offsets)
    in_word = ~SPACES[raw]
    out = {"n_words": np.diff(at), "word_chars": per_text(in_word & ((raw & 0xC0) != 0x80), offsets), "n_symbols": per_text(_SYMBOLS[raw], offsets)}
    # Lines with a word that equal an earlier line of their text.
    line_starts, line_ends, lines, line_at = words(raw, offsets, breaks=_NEWLINE)
    filled = np.concatenate([[0], np.cumsum(in_word, dtype=np.int64)])
    real = filled[line_ends] > filled[line_starts] if len(lines) else np.zeros(0, dtype=bool)
    owner = np.repeat(np.arange(n_docs), np.diff(line_at))
    out["n_dup_lines"] = np.bincount(owner[real][_repeats(owner[real], lines[real], later=True)], minlength=n_docs)
    # Words in windows of five that occur twice or more in their text.
    size = 5
    owner = np.repeat(np.arange(n_docs), np.diff(at))
    runs = windows(hashes, size)
    whole = owner[: len(runs)] == owner[size - 1 :] if len(runs) else np.zeros(0, dtype=bool)
    place = np.flatnonzero(whole)
    place = place[_repeats(owner[place], runs[place], later=False)]
    cover = np.bincount(place, minlength=len(hashes) + 1)[: len(hashes) + 1] - np.bincount(place + size, minlength=len(hashes) + 1)[: len(hashes) + 1]
    out["n_repeat_words"] = per_text(np.cumsum(cover[:-1]) > 0, at)
    out["base_failed"] = (out["n_words"] < 10) | (100 * out["n_repeat_words"] > 20 * out["n_words"])
    keys, gram_at = grams(raw, offsets)
    sums = np.concatenate([[0.0], np.cumsum(weights[keys], dtype=np.float64)])
    out["score"] = np.diff(sums[gram_at]) / (np.diff(gram_at) + PRIOR_GRAMS)
    return out


def _repeats(owner: np.ndarray, keys: np.ndarray, later: bool) -> np.ndarray:
    """Which entries have an equal key in their text: all of them, or only those after the first."""
    out = np.zeros(len(keys), dtype=bool)
    if len(keys):
        order = np.lexsort((keys, owner))  # stable: earlier entries first
        same = (keys[order[1:]] == keys[order[:-1]]) & (owner[order[1:]] == owner[order[:-1]])
        out[order[1:]] = same
        if not later:
            out[order[:-1]] |= same
    return out


def rules(docs: DataFrame, ratio: Ratio, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """Per document: (doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept[, text, row]).

    `score` is the mean log-ratio of the text's n-grams; a document is kept if it passes the counting rules and its score is at
    least `threshold`, whatever the other documents are. Null and empty texts have no words and fail. Repeated rows and null
    ids pass through. `keep` carries the text and all other columns along (see common.restored), whatever their names. No
    shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(ratio.weights)
    frame = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), *[carried(docs, id_col, text_col)] * keep)
    more = ("text", "row") * keep
    schema = schema_of(frame, "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, score double, kept boolean", more)

    def each(part: pa.RecordBatch) -> pa.RecordBatch:
        got = measure(*utf8(part.column(1)), shared.value)
        got["kept"] = ~got["base_failed"] & (got["score"] >= threshold)
        return pa.RecordBatch.from_arrays([part.column(0), *[pa.array(x) for x in got.values()], *part.columns[1 : 1 + len(more)]], ["doc_id", *got, *more])

    return run_in_arrow(frame, each, schema, 1)


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Ids of the documents that the labels call good."""
    return labels.where("quality = 1").select("doc_id")


__all__ = ["Ratio", "fit", "grams", "measure", "rules", "trusted_ids"]
