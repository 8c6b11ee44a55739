"""Chat formatting: logged snapshots of a conversation collapse into the longest one before rendering.

Every turn-prefix of a conversation has a rolling hash: running sums of four 31-bit lanes of hashes of (position, role,
text). A conversation whose whole hash is a proper prefix hash of another goes (left anti-join on length and hash); of
conversations with equal turns the one of smallest conv_id stays. Prefixes are pre-aggregated, so a first turn that
many conversations share is one row on the side it is joined with.

Nulls and ties: a null role or text equals another null, renders as empty, and differs from an empty one. Turns sort by
(turn, role, text), nulls first. Rows of null conv_id are one conversation, the last of equal ones. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

LANES = 4


def collapse(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_copies, turns): maximal conversations, their turns in order, and how many logs equal them."""
    turns = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    all_turns = Window.partitionBy("conv_id")
    turns = turns.withColumn("n", F.row_number().over(w).cast("long"))
    lane = [F.xxhash64(F.lit(i), "n", F.col("role").isNull(), "role", F.col("text").isNull(), "text").bitwiseAND(F.lit(0x7FFFFFFF)) for i in range(LANES)]
    running = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    turns = turns.withColumns({f"h{i}": x for i, x in enumerate(lane)})
    turns = turns.withColumns({f"h{i}": F.sum(f"h{i}").over(running) for i in range(LANES)} | {"size": F.max("n").over(all_turns)})
    key = ["n", *(f"h{i}" for i in range(LANES))]
    prefixes = turns.filter("n < size").select(*key).distinct()
    last = F.max(F.struct(*key)).alias("last")
    whole = turns.groupBy("conv_id").agg(last, F.array_sort(F.collect_list(F.struct("n", "role", "text"))).alias("turns")).select("conv_id", "turns", *(F.col(f"last.{c}") for c in key))
    # equal logs are one row before the anti-join, so a conversation that was logged often is in no task more than once a map task
    copies = whole.groupBy(*key).agg(F.min(F.struct(F.col("conv_id").isNull().alias("none"), "conv_id", "turns")).alias("one"), F.count("*").alias("n_copies"))
    return copies.join(prefixes, key, "left_anti").select("one.conv_id", F.col("n").alias("n_turns"), "n_copies", "one.turns")


def render(turns):
    """One string of all turns: <|role|>, a line feed, the text, <|end|>, a line feed."""
    empty = F.lit("")
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit("<|"), F.coalesce(t["role"], empty), F.lit("|>\n"), F.coalesce(t["text"], empty), F.lit("<|end|>\n"))), "")


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = collapse(table(spark, sf_dir, "conversations"))
    return out.select("conv_id", "n_turns", "n_copies", render(F.col("turns")).alias("rendered"))


SQL = r"""
with t as (
  select conv_id, row_number() over (partition by conv_id order by turn nulls first, role nulls first, text nulls first) as n,
         coalesce('r' || role, '-') || chr(30) || coalesce('t' || text, '-') || chr(31) as exact,
         '<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10) as shown
  from conversations
), p as (
  select conv_id, n, sha256(string_agg(exact, '') over (partition by conv_id order by n)) as h, count(*) over (partition by conv_id) as size from t
), whole as (
  select t.conv_id, count(*) as n_turns, string_agg(shown, '' order by n) as rendered, sha256(string_agg(exact, '' order by n)) as h from t group by t.conv_id
)
select min(conv_id) as conv_id, cast(n_turns as bigint) as n_turns, cast(count(*) as bigint) as n_copies, min(rendered) as rendered
from whole where h not in (select h from p where n < size)
group by n_turns, h
"""
