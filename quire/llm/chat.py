"""Chat formatting of logged conversations, in DataFrame functions alone.

Logs hold a conversation several times, each snapshot a prefix of the next. Every turn gets a rolling hash of its
conversation up to there: the exclusive or of 128-bit hashes of (place, role, text), so that it does not depend on
how turns are dealt out. Equal conversations leave the one with the smallest id, and those go whose whole hash is found at
more turns than conversations end with it, that is, at an inner turn of another; what is left is rendered.

Turns are put in order by ranges, and places and rolling hashes are added up in two steps, inside a range and over the
ranges of a conversation: no task gets a conversation whole, and texts are not part of it.

Places: rank of the turn in its conversation by (turn, role, text). A null role or text is a value of its own, and is
rendered as an empty one; rows with a null conv_id are one conversation. Repeated rows are turns. Marks inside a text
are parted by a space so that they can't open or close a turn. Other columns are left aside; an empty table gives an
empty result. Long conversations come in parts of `part_turns` turns, so no row grows without bound.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import joined_back
from .durable import checkpointed

#: The marks of the rendered format.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def render_turn(role: Column, text: Column) -> Column:
    clean = lambda c: F.replace(F.coalesce(c, F.lit("")), F.lit("<|im_"), F.lit("<| im_"))
    return F.concat(F.lit(OPEN), clean(role), F.lit("\n"), clean(text), F.lit(CLOSE + "\n"))


def ordered(turns: DataFrame) -> DataFrame:
    """Turns with `at`, their place among all turns (range in the upper bits), and two hashes of what they say; written out."""
    order = ["conv_id", "turn", "role", "text"]
    said = [F.col("role").isNull(), F.coalesce("role", F.lit("")), F.col("text").isNull(), F.coalesce("text", F.lit(""))]
    x = turns.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    return checkpointed(x.select("conv_id", "role", "text", "at", F.xxhash64(F.lit("a"), *said).alias("x"), F.xxhash64(F.lit("b"), *said).alias("y")))


def placed(turns: DataFrame) -> DataFrame:
    """conv_id, at, the turn's place n and the two halves a, b of the rolling hash, for ordered turns."""
    x = turns.select("conv_id", "at", F.shiftright("at", 33).alias("range"), "x", "y")
    group = ["conv_id", "range"]
    before = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # over ranges

    def back(rows: DataFrame, sums: DataFrame) -> DataFrame:
        s = sums.select(*[F.col(c).alias(f"__{c}") for c in group], *[c for c in sums.columns if c not in group])
        return rows.join(s, F.col("conv_id").eqNullSafe(F.col("__conv_id")) & (F.col("range") == F.col("__range"))).drop("__conv_id", "__range")

    inside = Window.partitionBy(*group).orderBy("at")
    starts = x.groupBy(*group).agg(F.count("*").alias("k")).select(*group, F.coalesce(F.sum("k").over(before), F.lit(0)).alias("start"))
    x = back(x, starts).withColumn("n", F.col("start") + F.row_number().over(inside))
    x = x.select(*group, "at", "n", F.xxhash64("n", "x", "y").alias("a"), F.xxhash64("y", "n", "x").alias("b"))
    zero = F.lit(0).cast("long")
    sums = x.groupBy(*group).agg(F.bit_xor("a").alias("a0"), F.bit_xor("b").alias("b0"))
    sums = sums.select(*group, *[F.coalesce(F.bit_xor(c).over(before), zero).alias(c) for c in ("a0", "b0")])
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    whole = lambda c: F.bit_xor(c).over(upto).bitwiseXOR(F.col(f"{c}0")).alias(c)
    return back(x, sums).select("conv_id", "at", "n", whole("a"), whole("b"))


def maximal(places: DataFrame) -> DataFrame:
    """conv_id, n_turns of the conversations that no other one equals (but for a larger id) or goes on from."""
    ends = places.groupBy("conv_id").agg(F.max(F.struct("n", "a", "b")).alias("end"))
    whole = ends.groupBy("end").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("ends"))
    met = places.groupBy(F.struct("n", "a", "b").alias("end")).agg(F.count("*").alias("turns"))
    return whole.join(met, "end").where("turns = ends").select("conv_id", F.col("end.n").alias("n_turns"))


def format_chats(turns: DataFrame, part_turns: int = 256) -> DataFrame:
    """conv_id, part (from 0), n_turns (of the conversation), rendered."""
    turns = ordered(turns)
    places = checkpointed(placed(turns))
    keep = maximal(places)
    # the turns of what is kept, without texts; a conversation is known by its struct, so a null id is one too
    kept = joined_back(places.select("at", "n", F.struct("conv_id").alias("c")), keep.select(F.struct("conv_id").alias("c"), "n_turns"), "c")
    x = turns.select("conv_id", "at", render_turn(F.col("role"), F.col("text")).alias("rendered")).join(kept.select("at", "n", "n_turns"), "at")
    parts = x.groupBy("conv_id", F.expr(f"cast((n - 1) div {part_turns} as int)").alias("part"), F.col("n_turns").cast("long").alias("n_turns"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "rendered"))), lambda t: t["rendered"]), "")
    return parts.agg(joined.alias("rendered"))


ORACLE_SQL = """
WITH placed AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS n, role, text FROM conversations),
rolled AS (
  SELECT *, string_agg(coalesce('r' || role, 'n') || chr(30) || coalesce('t' || text, 'n'), chr(31)) OVER (PARTITION BY conv_id ORDER BY n) AS upto,
    count(*) OVER (PARTITION BY conv_id) AS n_turns FROM placed),
whole AS (SELECT min(conv_id) AS conv_id, n_turns, upto FROM rolled WHERE n = n_turns GROUP BY n_turns, upto),
kept AS (SELECT * FROM whole w WHERE NOT EXISTS (SELECT 1 FROM rolled r WHERE r.n < r.n_turns AND r.n = w.n_turns AND r.upto = w.upto))
SELECT p.conv_id, ((p.n - 1) // 256)::INTEGER AS part, k.n_turns::BIGINT AS n_turns,
  string_agg('<|im_start|>' || replace(coalesce(p.role, ''), '<|im_', '<| im_') || chr(10) || replace(coalesce(p.text, ''), '<|im_', '<| im_') || '<|im_end|>' || chr(10), '' ORDER BY p.n) AS rendered
FROM placed p JOIN kept k USING (conv_id) GROUP BY 1, 2, 3
"""
