"""Secret scans: candidate spans by pattern, and how many repositories and owners each candidate occurs with. No Python on executors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import carried, discard, table

#: Kinds in the order that breaks ties: name, pattern, group with the value, least length of the value.
BASE = (
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
)
#: The method's own kind: a long token that mixes cases and digits. It becomes a span only if it is specific to few owners.
TOKEN = ("owned", r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z0-9+/_=-]*[a-z])(?=[A-Za-z0-9+/_=-]*[A-Z])(?=(?:[A-Za-z0-9+/_=-]*[0-9]){3})[A-Za-z0-9+/_=-]{24,}+", 0, 24)
_FAR = (1 << 31) - 1
#: A candidate of at most this many owners and repositories can be live; one that more have is a copied example.
LIVE_OWNERS, LIVE_REPOS = 2, 4


#: Entries that a running sum goes through at once. A sum over a long array is made of sums over such blocks, so that its cost
#: does not grow with the square of the array's length.
BLOCK = 512


def running(items: Column, size: Callable[[Column], Column], join: Callable[[Column, Column], Column], first: int = 0) -> Column:
    """array<int>: for each item of an array, `join` over `first` and the sizes of all items before it."""

    def before(sizes: Column) -> Column:
        """The folds before each size, and the fold of all as last entry."""
        return F.aggregate(sizes, F.array(F.lit(first)), lambda state, x: F.array_append(state, join(F.element_at(state, -1), x)))

    starts = F.transform(F.sequence(F.lit(0), F.greatest(F.size(items) - 1, F.lit(0)), F.lit(BLOCK)), lambda i: F.transform(F.slice(items, i + 1, F.lit(BLOCK)), size))
    blocks = F.transform(starts, before)
    totals = before(F.transform(blocks, lambda x: F.element_at(x, -1)))
    return F.flatten(F.zip_with(blocks, F.slice(totals, F.lit(1), F.size(totals) - 1), lambda x, t: F.transform(F.slice(x, F.lit(1), F.size(x) - 1), lambda y: join(t, y))))


def found(text: Column, pattern: str, group: int, least: int, quick: str | None = None) -> Column:
    """array<struct<start, end, bstart, bend, value>> of the leftmost non-overlapping matches whose group has `least` characters or more.

    start and end are code points, bstart and bend bytes. Matches and the texts between them alternate, so running sums of their
    lengths place them. `quick` is a cheaper pattern that any text with such a match fits; other texts are not cut.
    """
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    sizes = F.zip_with(whole, F.slice(gaps, F.lit(1), F.size(whole)), lambda m, g: F.struct((F.length(g) + F.length(m)).alias("chars"), (F.octet_length(g) + F.octet_length(m)).alias("bytes"), F.length(g).alias("gap"), F.octet_length(g).alias("bgap"), F.length(m).alias("size"), F.octet_length(m).alias("bsize")))
    parts = F.zip_with(sizes, values, lambda p, v: F.struct(p.chars.alias("chars"), p.bytes.alias("bytes"), p.gap.alias("gap"), p.bgap.alias("bgap"), p["size"].alias("size"), p.bsize.alias("bsize"), v.alias("value")))
    add = lambda x, y: x + y
    places = F.arrays_zip(running(parts, lambda p: p.chars, add).alias("at"), running(parts, lambda p: p.bytes, add).alias("bat"))
    placed = F.zip_with(parts, places, lambda p, at: F.struct((at["at"] + p.gap).alias("start"), (at["at"] + p.gap + p["size"]).alias("end"), (at["bat"] + p.bgap).alias("bstart"), (at["bat"] + p.bgap + p.bsize).alias("bend"), p.value.alias("value")))
    empty = F.expr("cast(array() as array<struct<start:int,end:int,bstart:int,bend:int,value:string>>)")
    return F.when(text.rlike(quick or pattern), F.filter(placed, lambda s: F.length(s.value) >= least)).otherwise(empty)


#: Patterns with the same long matches as BASE's: a maximal run is long enough or it is dropped.
_LONG = {"access": r"AKIA[A-Z0-9]{16,}+", "hex": r"[0-9a-f]{24,}+"}


def _kinds(text: Column) -> list[Column]:
    out = []
    for rank, (name, pattern, group, least) in enumerate((*BASE, TOKEN)):
        spans = found(text, _LONG.get(name, pattern), group, least, r"[A-Za-z0-9+/_=-]{24}" if name == "owned" else None)
        out.append(F.transform(spans, _labelled(rank, name)))
    return out


def _labelled(rank: int, name: str):
    return lambda s: F.struct(s.start.alias("start"), F.lit(rank).alias("rank"), s.end.alias("end"), s.bstart.alias("bstart"), s.bend.alias("bend"), F.lit(name).alias("kind"), F.xxhash64(s.value).alias("hash"), F.sha2(s.value, 256).alias("digest"))


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "source", keep: bool = False) -> DataFrame:
    """(id, doc_id, repo, base, more[, text, row]) of every row: spans of the base kinds, and the method's candidates that no base span overlaps."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    kept = [F.col(text_col).alias("own"), carried(docs, id_col, text_col)] * keep
    frame = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(repo_col).cast("string"), F.lit("")).alias("repo"), text.alias("text"), *kept)
    kinds = _kinds(F.col("text"))
    frame = frame.withColumn("base", F.array_sort(F.concat(*kinds[:3]))).withColumn("more", kinds[3])
    events = F.array_sort(F.concat("base", "more"))
    reached = running(events, lambda s: F.when(s["rank"] < 3, s.end).otherwise(0), F.greatest)
    ahead = F.reverse(running(F.reverse(events), lambda s: F.when(s["rank"] < 3, s.start).otherwise(_FAR), F.least, _FAR))
    beside = F.zip_with(F.zip_with(events, reached, lambda s, r: F.struct(s.alias("s"), (r <= s.start).alias("free"))), ahead, lambda x, n: F.struct(x.s.alias("s"), (x.free & (n >= x.s.end)).alias("free")))
    apart = F.transform(F.filter(beside, lambda x: (x.s["rank"] == 3) & x.free), lambda x: x.s)
    frame = frame.withColumn("more", apart).drop("text").withColumn("id", F.monotonically_increasing_id())
    return frame.withColumnRenamed("own", "text") if keep else frame


def ownership(rows: DataFrame) -> DataFrame:
    """(hash, digest, repos, owners): in how many repositories and with how many owners each candidate occurs.

    An owner is the part of a repository's name before the first slash, or the name. Candidates are made distinct by
    repository and then by owner before they are counted, with partial aggregates, so no key gathers its rows in a task.
    """
    each = rows.select("repo", F.explode(F.concat("base", "more")).alias("c")).select("c.hash", "c.digest", "repo").distinct()
    owners = each.groupBy("hash", "digest", F.substring_index("repo", "/", 1).alias("owner")).agg(F.count("*").alias("repos"))
    return owners.groupBy("hash", "digest").agg(F.sum("repos").alias("repos"), F.count("*").alias("owners"))


def _joined(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "source", keep: bool = False) -> DataFrame:
    """Per row: (doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_owned, n_live, n_example, found[, text, row]).

    `spans` are all base spans and those long tokens that at most LIVE_OWNERS owners and LIVE_REPOS repositories have, as
    kind:start:end by start and kind. n_live and n_example split all candidates of the row by that frequency; `found` is the
    array of the spans with their verdict. Null and empty texts have no spans; a null repository counts as one of its own
    empty name; repeated rows are answered each. `keep` carries the text and all other columns along (see common.restored),
    whatever their names. Spans are written once to the shared folder (with the texts only where these are kept) and the
    frequency table too, so the join's hot candidates can be split by the adaptive skew join.
    """
    rows = table(candidates(docs, id_col, text_col, repo_col, keep), "spans")
    known = table(ownership(rows), "ownership")
    own = rows.select("id", F.explode(F.concat("base", "more")).alias("c")).select("id", "c.*")
    live = (F.col("owners") <= LIVE_OWNERS) & (F.col("repos") <= LIVE_REPOS)
    judged = own.join(known, ["hash", "digest"]).select("id", F.struct("start", "rank", "end", "bstart", "bend", "kind", live.alias("live")).alias("s"))
    per_row = table(judged.groupBy("id").agg(F.array_sort(F.collect_list("s")).alias("s")), "judged")
    discard(known)
    some = F.size("base") + F.size("more") > 0
    none = F.expr("cast(array() as array<struct<start:int,rank:int,end:int,bstart:int,bend:int,kind:string,live:boolean>>)")
    full = rows.where(some).join(per_row, "id").unionByName(rows.where(~some).withColumn("s", none))
    kept = F.filter("s", lambda s: (s.rank < 3) | s.live)
    count = lambda rank: F.size(F.filter("base", lambda b: b.rank == rank)).cast("bigint")
    return full.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(kept).alias("spans"),
        F.size(F.filter("s", lambda s: (s.rank == 3) & s.live)).cast("bigint").alias("n_owned"), F.size(F.filter("s", lambda s: s.live)).cast("bigint").alias("n_live"), F.size(F.filter("s", lambda s: ~s.live)).cast("bigint").alias("n_example"), kept.alias("found"),
        *["text", "row"] * keep,
    )


def masked(text: Column, spans: Column) -> Column:
    """The text with each span (array of structs with bstart, bend and kind, by start) replaced by <kind>; overlapping spans become one.

    Cut by bytes, whose places need no search, and with a running maximum of the ends, so the cost is in proportion.
    """
    data = text.cast("binary")
    cut = lambda a, b: F.substring(data, a + 1, b - a).cast("string")
    most = lambda x, y: F.greatest(x, y)
    pieces = F.zip_with(spans, running(spans, lambda s: s.bend, most), lambda s, at: F.when(s.bstart >= at, F.concat(cut(at, s.bstart), F.lit("<"), s.kind, F.lit(">"))).otherwise(F.lit("")))
    tail = cut(F.array_max(F.transform(spans, lambda s: s.bend)), F.octet_length(text))
    return F.when(F.size(spans) == 0, text).otherwise(F.concat(F.array_join(pieces, ""), tail))
