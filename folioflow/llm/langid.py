"""Language identification with interpolated Kneser-Ney character models in sorted hash arrays."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import mix, resident, run_in_arrow, utf8, words

#: Longest n-gram in characters.
ORDER = 5
#: Bounds of the labelled sample: documents a language (as expected; chosen by a hash of the id), and word types of all
#: languages together, dealt to the languages in turn, most frequent first, so that a small one keeps all it has. They bound
#: the model; every document is scored whole.
SAMPLE_DOCS, SAMPLE_TYPES = 3000, 300_000
#: A language with fewer labelled documents spares none for calibration. The labels may name MAX_LANGS languages, more than there
#: are; the most frequent are learned if they name more.
TUNE_DOCS, MAX_LANGS = 50, 10_000
#: A longer run of letters is scored in pieces of this many characters.
WORD_CHARS = 64
#: Text bytes scored at once; a longer text is scored alone.
SCORED_BYTES = 1 << 19
#: Numbers that a worker's cache of scored words holds.
CACHED_SCORES = 2_000_000

_START, _END = 1, 2


@dataclass
class Model:
    """Of each language and order k: sorted hashes of its n-grams with their log-probabilities, and sorted hashes of their
    contexts with the log-weights of backing off. All languages together have ORDER entries for each letter of the sample's
    word types at most, however many languages there are."""

    langs: list[str]
    grams: list[list[np.ndarray]] = field(default_factory=list)
    probs: list[list[np.ndarray]] = field(default_factory=list)
    contexts: list[list[np.ndarray]] = field(default_factory=list)
    backoff: list[list[np.ndarray]] = field(default_factory=list)
    floor: float = 0.0
    sharpness: float = 10.0
    reject_entropy: float = float("inf")
    reject_score: float = 0.5


def letters(text: Column) -> Column:
    """Lower-cased runs of letters and marks between single spaces."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{M}]+", " "))


def _layout(items: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of all words, each between a start and an end mark; index in the word; the word's number."""
    lengths = np.fromiter((len(x) for x in items), dtype=np.int64, count=len(items)) + 2
    ends = np.cumsum(lengths)
    starts = ends - lengths
    codes = np.empty(int(ends[-1]) if len(items) else 0, dtype=np.uint64)
    inner = np.ones(len(codes), dtype=bool)
    inner[starts] = inner[ends - 1] = False
    codes[inner] = np.frombuffer("".join(items).encode("utf-32-le"), dtype=np.uint32)
    codes[starts], codes[ends - 1] = _START, _END
    return codes, np.arange(len(codes)) - np.repeat(starts, lengths), np.repeat(np.arange(len(items)), lengths)


def _hashes(codes: np.ndarray, order: int) -> list[np.ndarray]:
    """For k = 0 to order: hash of the k-gram that ends at each place (whatever stands before its word, for short prefixes)."""
    out = [np.zeros(len(codes), dtype=np.uint64)]
    mixed = mix(codes + np.uint64(0x51ED27))
    for k in range(1, order + 1):
        earlier = np.zeros(len(codes), dtype=np.uint64)
        earlier[1:] = out[k - 1][:-1]
        out.append(mix(earlier * np.uint64(0x9FB21C651E98DF25) + mixed + np.uint64(k)))
    return out


def _find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Row of each wanted hash in the sorted array, or -1."""
    if not len(keys):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


def estimate(langs: list[str], samples: dict[str, tuple[list[str], np.ndarray]], order: int = ORDER) -> Model:
    """Interpolated Kneser-Ney models from word types and their counts in each language.

    The highest order, and n-grams at a word's start, use token counts; the others count distinct left extensions. One
    discount a language and order, n1 / (n1 + 2 n2).
    """
    layouts = {lang: _layout(samples[lang][0]) for lang in langs}
    symbols = set().union(*[np.unique(codes).tolist() for codes, _, _ in layouts.values()])
    model = Model(langs, floor=-float(np.log(len(symbols) + 1)))
    for lang in langs:
        codes, index, word = layouts[lang]
        hashes = _hashes(codes, order)
        weight = samples[lang][1][word].astype(np.float64)
        tallies, longer = [], None
        for k in range(order, 0, -1):
            place = np.flatnonzero(index >= max(k - 1, 1))
            tally = place if k == order else place[index[place] == k - 1]
            gram, first, inverse = np.unique(hashes[k][tally], return_index=True, return_inverse=True)
            total, at = np.bincount(inverse, weights=weight[tally], minlength=len(gram)), tally[first]
            if longer is not None:  # each longer type is one left extension of its suffix
                more, first, inverse = np.unique(hashes[k][longer], return_index=True, return_inverse=True)
                gram, total, at = np.concatenate([gram, more]), np.concatenate([total, np.bincount(inverse, minlength=len(more))]), np.concatenate([at, longer[first]])
            tallies.append((gram, total, at))
            longer = at
        grams, probs, contexts, backoff = [], [], [], []
        for k, (gram, total, at) in enumerate(tallies[::-1], 1):
            gram, first, inverse = np.unique(gram, return_index=True, return_inverse=True)
            total, at = np.bincount(inverse, weights=total), at[first]
            n1, n2 = (total == 1).sum(), (total == 2).sum()
            discount = min(max(n1 / (n1 + 2 * n2), 0.1), 0.95) if n1 else 0.5
            context, which = np.unique(hashes[k - 1][at - 1], return_inverse=True)
            mass, types = np.bincount(which, weights=total), np.bincount(which)
            share = discount * types / mass
            lower = np.full(len(gram), np.exp(model.floor)) if k == 1 else np.exp(probs[-1][_find(grams[-1], hashes[k - 1][at])])
            grams.append(gram)
            probs.append(np.log(np.maximum(total - discount, 0) / mass[which] + share[which] * lower))
            contexts.append(context)
            backoff.append(np.log(share).astype(np.float32))
        model.grams.append(grams)
        model.probs.append([x.astype(np.float32) for x in probs])
        model.contexts.append(contexts)
        model.backoff.append(backoff)
    return model


def score_words(model: Model, items: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Sum of each word's log-probabilities in each language, and the number of predictions (letters and the end).

    Each distinct n-gram of the words is looked up once in each language, from short to long: where a language lacks one, it
    backs off to what it gives the n-gram's suffix.
    """
    if not items:
        return np.zeros((0, len(model.langs))), np.zeros(0, dtype=np.int64)
    order = len(model.grams[0])
    codes, index, word = _layout(items)
    hashes = _hashes(codes, order)
    predicted = np.flatnonzero(index >= 1)
    rank = np.cumsum(index >= 1) - 1  # of a place among the predicted ones
    levels, suffix_of = [], np.zeros(len(predicted), dtype=np.int64)
    for k in range(1, order + 1):
        place = predicted[index[predicted] >= k - 1]
        keys, first, inverse = np.unique(hashes[k][place], return_index=True, return_inverse=True)
        levels.append((keys, hashes[k - 1][place[first] - 1], suffix_of[rank[place[first]]], rank[place], inverse))
        suffix_of = np.zeros(len(predicted), dtype=np.int64)
        suffix_of[rank[place]] = inverse
    starts = np.flatnonzero(np.diff(word[predicted], prepend=-1))
    out = np.empty((len(items), len(model.langs)))
    for i in range(len(model.langs)):
        values, score = np.full(1, model.floor), np.zeros(len(predicted))
        for k, (keys, context, suffix, at, inverse) in enumerate(levels):
            rows, back = _find(model.grams[i][k], keys), _find(model.contexts[i][k], context)
            lower = values[suffix]
            lower[back >= 0] += model.backoff[i][k][back[back >= 0]]
            lower[rows >= 0] = model.probs[i][k][rows[rows >= 0]]
            values = lower
            score[at] = values[inverse]
        out[:, i] = np.add.reduceat(score, starts)
    return out, np.diff(np.append(starts, len(predicted)))


class Scored:
    """What score_words gave for words, by the hash of their bytes. It bounds memory only: other words are scored anew."""

    def __init__(self, model: Model):
        self.most = CACHED_SCORES // (len(model.langs) + 1)
        self.keys, self.asked = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=bool)
        self.scores = np.zeros((0, len(model.langs) + 1), dtype=np.float32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        rows = _find(self.keys, keys)
        self.asked[rows[rows >= 0]] = True
        return rows

    def add(self, keys: np.ndarray, scores: np.ndarray) -> None:
        if len(self.keys) + len(keys) > self.most:  # keep what was asked for since the last time, or nothing if that is nearly all
            keep = self.asked & (self.asked.sum() < 3 * self.most // 4)
            self.keys, self.scores, self.asked = self.keys[keep], self.scores[keep], np.zeros(keep.sum(), dtype=bool)
        place = np.searchsorted(self.keys, keys)
        self.keys, self.asked = np.insert(self.keys, place, keys), np.insert(self.asked, place, False)
        self.scores = np.insert(self.scores, place, scores, axis=0)


def score_texts(model: Model, raw: np.ndarray, offsets: np.ndarray, known: Scored | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Mean log-probability of each text's symbols in each language, and the number of symbols. Each distinct word is scored once."""
    starts, ends, hashes, at = words(raw, offsets)
    n, n_langs = len(offsets) - 1, len(model.langs)
    if not len(hashes):
        return np.zeros((n, n_langs)), np.zeros(n, dtype=np.int64)
    keys, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
    rows = known.find(keys) if known is not None else np.full(len(keys), -1)
    scores = np.zeros((len(keys), n_langs + 1), dtype=np.float32)
    scores[rows >= 0] = known.scores[rows[rows >= 0]] if known is not None else 0
    missing = np.flatnonzero(rows < 0)
    if len(missing):
        data = raw.tobytes()
        items, owner = [], []
        for i, f in enumerate(first[missing].tolist()):
            word = data[starts[f] : ends[f]].decode("utf-8")
            for a in range(0, len(word), WORD_CHARS):
                items.append(word[a : a + WORD_CHARS])
                owner.append(i)
        sums, counts = score_words(model, items)
        new = np.zeros((len(missing), n_langs + 1))
        np.add.at(new, owner, np.concatenate([sums, counts[:, None]], axis=1))
        scores[missing] = new
        if known is not None:
            known.add(keys[missing], scores[missing])
    total = np.concatenate([np.zeros((1, n_langs + 1)), np.cumsum(scores[inverse], axis=0, dtype=np.float64)])[at]
    each = np.diff(total, axis=0)
    symbols = np.rint(each[:, -1]).astype(np.int64)
    return each[:, :-1] / np.maximum(symbols, 1)[:, None], symbols


def posterior(model: Model, means: np.ndarray, symbols: np.ndarray, sharpness: float | None = None) -> np.ndarray:
    """Calibrated probabilities of the languages from length-normalised log-probabilities; short texts are less certain."""
    logits = (sharpness or model.sharpness) * means * (symbols / (symbols + 10))[:, None]
    odds = np.exp(logits - logits.max(axis=1, keepdims=True))
    return odds / odds.sum(axis=1, keepdims=True)


def held_out(id_col: str) -> Column:
    """Whether crc32 of the id as text leaves remainder 2 by 4; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = SAMPLE_DOCS, sample_types: int = SAMPLE_TYPES) -> Model:
    """Learn from a bounded sample of the labelled rows of `docs`, which the caller has cut to what may be learned from.

    Rows with a null id, text or language, or without a letter, teach nothing. A tenth of the sample only calibrates: the
    sharpness that makes its labels likeliest, and the cross-entropy above which a prediction counts as not accepted.
    Without a learnable row the model has no language.
    """
    frame = docs.select(F.col(lang_col).cast("string").alias("lang"), F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(1 << 30)).alias("pick"), F.col(text_col).cast("string").alias("text"), F.col(id_col).isNotNull().alias("named"))
    frame = frame.where(F.col("named") & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r.lang: r["count"] for r in frame.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LANGS).collect()}
    if not sizes:
        return Model([])
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1 << 30, max(1, (sample_docs << 30) // n)))])
    sample = frame.where(F.col("lang").isin(*sizes)).where(F.col("pick") < F.element_at(share, F.col("lang")))
    clean = sample.select("lang", letters(F.col("text")).alias("text"), ((F.pmod(F.xxhash64("pick"), F.lit(10)) == 0) & F.col("lang").isin([x for x, n in sizes.items() if n >= TUNE_DOCS])).alias("tune"))
    pieces = F.expr(f"transform(sequence(1, length(word), {WORD_CHARS}), i -> substring(word, i, {WORD_CHARS}))")
    counted = clean.where("not tune").select("lang", F.explode(F.split("text", " ")).alias("word")).where("word <> ''").select("lang", F.explode(pieces).alias("word")).groupBy("lang", "word").count()
    ranked = counted.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("count"), "word")))
    rows = ranked.orderBy("rank", "lang").limit(sample_types).toArrow()
    by_lang: dict[str, tuple[list[str], list[int]]] = {}
    for lang, word, n in zip(*[rows.column(c).to_pylist() for c in ("lang", "word", "count")]):
        items, tokens = by_lang.setdefault(lang, ([], []))
        items.append(word)
        tokens.append(n)
    if not by_lang:
        return Model([])
    model = estimate(sorted(by_lang), {k: (a, np.array(b)) for k, (a, b) in by_lang.items()})
    tune = _means(clean.where("tune and text <> ''").select("lang", "text"), model).toArrow()
    truth = np.array([model.langs.index(x) if x in model.langs else -1 for x in tune.column("lang").to_pylist()], dtype=np.int64)
    if (truth >= 0).any():
        means, symbols = np.array(tune.column("means").to_pylist())[truth >= 0], tune.column("symbols").to_numpy()[truth >= 0]
        truth = truth[truth >= 0]
        loss = {b: -np.log(posterior(model, means, symbols, b)[np.arange(len(truth)), truth] + 1e-9).mean() for b in (2, 4, 6, 8, 12, 16, 24, 32, 48)}
        model.sharpness = float(min(loss, key=loss.get))
        entropy = -means[np.arange(len(truth)), truth]
        model.reject_entropy = float(entropy.mean() + 6 * entropy.std() + 0.25)
    return model


def _means(frame: DataFrame, model: Model) -> DataFrame:
    """(lang, means, symbols) of a frame (lang, text)."""
    shared = frame.sparkSession.sparkContext.broadcast(model)

    def each(part: pa.RecordBatch) -> pa.RecordBatch:
        means, symbols = score_texts(shared.value, *utf8(part.column(1)))
        return pa.RecordBatch.from_arrays([part.column(0), pa.array(means.tolist(), pa.list_(pa.float64())), pa.array(symbols)], ["lang", "means", "symbols"])

    return run_in_arrow(frame, each, "lang string, means array<double>, symbols bigint", 1, SCORED_BYTES)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: (doc_id, held_out, lang_pred, score, cross_entropy, accepted).

    The language of lowest length-normalised cross-entropy of the whole text; ties go to the first name. `score` is its
    calibrated probability. `accepted` is false where the cross-entropy or the score says that no learned language fits. A
    null text, or one without a letter, is `und` with score 0 and a null cross-entropy. Rows pass through unshuffled.
    """
    shared, token = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex
    key = docs.schema[id_col].dataType.simpleString()

    def each(part: pa.RecordBatch) -> pa.RecordBatch:
        own = shared.value
        n = part.num_rows
        if own.langs:
            means, symbols = score_texts(own, *utf8(part.column(2)), resident(("langid", token), lambda: Scored(own)))
            best = means.argmax(axis=1)
            score = np.where(symbols > 0, posterior(own, means, symbols)[np.arange(n), best], 0.0)
            entropy = np.where(symbols > 0, -means[np.arange(n), best], np.nan)
            names = [own.langs[i] if s else "und" for i, s in zip(best.tolist(), symbols.tolist())]
        else:
            score, entropy, names = np.zeros(n), np.full(n, np.nan), ["und"] * n
        good = (entropy <= own.reject_entropy) & (score >= own.reject_score)
        columns = [part.column(0), part.column(1), pa.array(names, pa.string()), pa.array(score), pa.array(entropy, from_pandas=True), pa.array(good)]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "lang_pred", "score", "cross_entropy", "accepted"])

    frame = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), F.when(F.col(text_col).cast("string").rlike(r"\p{L}"), letters(F.col(text_col).cast("string"))).alias("text"))
    return run_in_arrow(frame, each, f"doc_id {key}, held_out boolean, lang_pred string, score double, cross_entropy double, accepted boolean", 2, SCORED_BYTES)
