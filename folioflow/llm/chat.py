"""Chat formatting: every participant's perspective on a dialogue, with training masks. No Python on executors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, table

#: Marks around a message; in a text or role they are broken by a space, so that neither can open or close a message.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
#: Messages of one row. A dialogue of so many at most is one row a speaker; a longer one has a row for each run of so many.
PIECE_TURNS = 4096
#: Roles that speak but have no perspective.
SYSTEM = ("system",)


def _plain(text: Column) -> Column:
    return F.replace(text, F.lit("<|"), F.lit("< |"))


def _ranked(long: DataFrame, size: int) -> DataFrame:
    """The messages of long conversations with their piece: their rank in the conversation by `size`.

    They are sorted by range, so a hot conversation spreads over partitions, and ranked by their place in the partition and the
    counts of the partitions before; a number of its own tells equal messages apart.
    """
    placed = table(long.withColumn("same", F.monotonically_increasing_id()), "long")
    order = ["conv_id", "turn", "role", "text", "same"]
    spread = placed.repartitionByRange(*order).sortWithinPartitions(*order)
    spread = table(spread.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()), "spread")
    discard(placed)
    counts = spread.groupBy("conv_id", "part").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).select(F.col("conv_id").alias("own"), F.col("part").alias("own_part"), "first", "before")
    joined = spread.join(counts, spread["conv_id"].eqNullSafe(counts["own"]) & (spread["part"] == counts["own_part"]))
    return joined.select("conv_id", "turn", "role", "text", F.floor((F.col("at") - F.col("first") + F.col("before")) / size).cast("bigint").alias("piece"))


def _long(long: DataFrame, spoken: Column, message: Column, size: int) -> DataFrame:
    """(conv_id, piece, turns, speaker) of long conversations: every speaker with every piece."""
    speakers = long.where(spoken).select(F.col("conv_id").alias("own"), F.col("role").alias("speaker")).distinct()
    pieces = _ranked(long, size).groupBy("conv_id", "piece").agg(F.array_sort(F.collect_list(message)).alias("turns"))
    return pieces.join(speakers, pieces["conv_id"].eqNullSafe(speakers["own"])).select("conv_id", "piece", "turns", "speaker")


def perspectives(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", system: tuple[str, ...] = SYSTEM, piece_turns: int = PIECE_TURNS) -> DataFrame:
    """One row per conversation, speaker and piece: (conv_id, speaker, piece, n_turns, n_own, rendered, mask, n_masked).

    The speaker's messages are rendered as assistant, system messages as system, all others as user with name=<their role>.
    `mask` lists the code-point ranges start:end of `rendered` to train on, comma-joined: the speaker's texts with their end
    marks. Turns are ordered by number, role and text, nulls first, so ties and repeated rows have one order. A null text is
    empty. A null role is a speaker of its own (null), shown as a user without a name. All rows with a null conv_id are one
    conversation. Line ends in a role are shown as spaces. A conversation with system messages alone, or an empty table, gives
    no row. A dialogue of more than `piece_turns` messages has a row for each run of so many, of any turn numbers, and every
    speaker of the dialogue has all its pieces; the messages of such a dialogue are ranked and grouped without ever meeting in
    one task.
    """
    text = _plain(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    base = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).cast("string").alias("role"), text.alias("text"))
    counts = base.groupBy("conv_id").count().where(F.col("count") > piece_turns)
    many = table(counts.select(F.col("conv_id").alias("long_id")), "long-ids")
    is_long = base["conv_id"].eqNullSafe(many["long_id"])
    spoken = ~F.coalesce(F.col("role").isin(*system), F.lit(False))
    message = F.struct("turn", "role", "text")
    short = base.join(many, is_long, "left_anti").groupBy("conv_id").agg(F.array_sort(F.collect_list(message)).alias("turns"))
    said = F.filter("turns", lambda t: ~F.coalesce(t.role.isin(*system), F.lit(False)))
    short = short.select("conv_id", F.lit(0).cast("bigint").alias("piece"), "turns", F.explode(F.array_distinct(F.transform(said, lambda t: t.role))).alias("speaker"))
    both = short
    if many.head(1):
        both = short.unionByName(_long(base.join(many, is_long, "left_semi"), spoken, message, piece_turns))

    def shown(t: Column) -> Column:
        own = t.role.eqNullSafe(F.col("speaker"))
        name = F.translate(_plain(t.role), "\r\n", "  ")
        head = F.when(own, F.lit("assistant")).when(t.role.isin(*system), t.role).when(t.role.isNull(), F.lit("user")).otherwise(F.concat(F.lit("user name="), name))
        return F.struct(own.alias("own"), F.concat(F.lit(OPEN), head, F.lit("\n")).alias("head"), F.concat(t.text, F.lit(CLOSE)).alias("body"))

    def place(state: Column, m: Column) -> Column:
        start = state.at + F.length(m["head"])
        end = start + F.length(m.body)
        return F.struct((end + 1).alias("at"), F.when(m.own, F.array_append(state.spans, F.concat_ws(":", start.cast("string"), end.cast("string")))).otherwise(state.spans).alias("spans"), (state.n + F.when(m.own, F.length(m.body)).otherwise(0)).alias("n"))

    marks = F.aggregate("m", F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<string>)").alias("spans"), F.lit(0).alias("n")), place)
    both = both.withColumn("m", F.transform("turns", shown)).withColumn("marks", marks)
    return both.select(
        "conv_id", "speaker", "piece", F.size("m").cast("bigint").alias("n_turns"), F.size(F.filter("m", lambda m: m.own)).cast("bigint").alias("n_own"),
        F.array_join(F.transform("m", lambda m: F.concat(m["head"], m.body)), "\n").alias("rendered"), F.array_join("marks.spans", ",").alias("mask"), F.col("marks.n").cast("bigint").alias("n_masked"),
    )


ORACLE = f"""
WITH t AS (
  SELECT conv_id, turn, role, replace(coalesce(text, ''), '<|', '< |') AS text,
         (row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, replace(coalesce(text, ''), '<|', '< |')) - 1) // {PIECE_TURNS} AS piece
  FROM conversations),
s AS (SELECT DISTINCT conv_id, role AS speaker FROM t WHERE role IS DISTINCT FROM 'system'),
m AS (
  SELECT t.conv_id, s.speaker, t.piece, t.turn, t.role, t.text, t.role IS NOT DISTINCT FROM s.speaker AS own,
         '{OPEN}' || CASE WHEN t.role IS NOT DISTINCT FROM s.speaker THEN 'assistant' WHEN t.role = 'system' THEN 'system' WHEN t.role IS NULL THEN 'user'
           ELSE 'user name=' || translate(replace(t.role, '<|', '< |'), chr(13) || chr(10), '  ') END || chr(10) AS head,
         t.text || '{CLOSE}' AS body,
         row_number() OVER (PARTITION BY t.conv_id, s.speaker, t.piece ORDER BY t.turn NULLS FIRST, t.role NULLS FIRST, t.text) AS n
  FROM t JOIN s ON t.conv_id IS NOT DISTINCT FROM s.conv_id),
p AS (
  SELECT *, CAST(coalesce(sum(length(head) + length(body) + 1) OVER (PARTITION BY conv_id, speaker, piece ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) + length(head) AS a
  FROM m)
SELECT conv_id, speaker, CAST(piece AS BIGINT) AS piece, count(*) AS n_turns, CAST(sum(CASE WHEN own THEN 1 ELSE 0 END) AS BIGINT) AS n_own,
       string_agg(head || body, chr(10) ORDER BY n) AS rendered,
       coalesce(string_agg(CAST(a AS VARCHAR) || ':' || CAST(a + length(body) AS VARCHAR), ',' ORDER BY n) FILTER (WHERE own), '') AS mask,
       CAST(sum(CASE WHEN own THEN length(body) ELSE 0 END) AS BIGINT) AS n_masked
FROM p GROUP BY conv_id, speaker, piece
"""
