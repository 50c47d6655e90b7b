"""Cumulative-snapshot collapse of logged conversations, then rendering.

A log often holds a conversation again after each turn. Every turn extends a rolling hash of its conversation (the position, role and
text of each turn, combined in order); a conversation whose final hash is the hash of a shorter prefix of another one is
dropped by an anti-join, of equal conversations the smallest conv_id stays, and the maximal ones are rendered.
Prefix hashes are distinct before they are joined, so a first turn that very many conversations share is one row.

Rows: null role or text counts as its own value and renders as nothing; turns come in the order of turn, role and text (ties, repeated
rows and null turns included, null first); conversations with a null conv_id are one. Extra columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadloom.llm.common import stored

#: Fixed marks of the rendered form.
BEGIN, END = "<|im_start|>", "<|im_end|>"


def _turn_hash(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), "place", F.col("role").isNull(), "role", F.col("text").isNull(), "text")


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """(conv_id, place, n, h1, h2): a 128-bit hash of the first ``place`` turns of each conversation, which has n."""
    key = F.col("conv_id")
    order = [F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first()]
    by = Window.partitionBy(key)
    placed = turns.select("conv_id", "turn", "role", "text").withColumn("place", F.row_number().over(by.orderBy(*order)))
    so_far = by.orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hashed = placed.select("conv_id", "place", _turn_hash(1).alias("x1"), _turn_hash(2).alias("x2"))
    return hashed.select("conv_id", "place", F.count("*").over(by).alias("n"), F.bit_xor("x1").over(so_far).alias("h1"), F.bit_xor("x2").over(so_far).alias("h2"))


def maximal(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_equal): conversations that no other one extends, with the number of equal ones."""
    hashes = stored(prefix_hashes(turns), "prefixes")
    finals = hashes.where("place = n").groupBy("h1", "h2", "n").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_equal"))
    inner = hashes.where("place < n").select("h1", "h2", F.col("place").cast("long").alias("n")).distinct()
    kept = finals.join(inner, ["h1", "h2", "n"], "left_anti")
    return kept.select("conv_id", F.col("n").cast("long").alias("n_turns"), "n_equal")


def render(turns: DataFrame, kept: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_equal, rendered) of the conversations in kept; a conversation's turns make one text."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    line = F.concat(F.lit(BEGIN), role, F.lit("\n"), text, F.lit(END + "\n"))
    mark = kept.select(F.col("conv_id").alias("kept_id"), "n_turns", "n_equal")
    rows = turns.join(mark, F.col("conv_id").eqNullSafe(F.col("kept_id")))
    item = F.struct(F.col("turn"), F.col("role"), F.col("text"), line.alias("line"))
    grouped = rows.groupBy("conv_id", "n_turns", "n_equal").agg(F.sort_array(F.collect_list(item)).alias("lines"))
    return grouped.select("conv_id", "n_turns", "n_equal", F.array_join("lines.line", "").alias("rendered"))


def collapse(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_equal, rendered): the maximal conversations of turns(conv_id, turn, role, text), rendered."""
    return render(turns, maximal(turns))


ORACLE = """
WITH t AS (
  SELECT conv_id, count(*) AS n_turns,
    list({'r': role, 't': text} ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS turns,
    string_agg('<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), ''
      ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS rendered
  FROM conversations GROUP BY conv_id
), one AS (
  SELECT min(conv_id) AS conv_id, n_turns, turns, any_value(rendered) AS rendered, count(*) AS n_equal FROM t GROUP BY n_turns, turns
)
SELECT conv_id, n_turns, n_equal, rendered FROM one a
WHERE NOT EXISTS (SELECT 1 FROM one b WHERE b.n_turns > a.n_turns AND b.turns[1:a.n_turns] = a.turns)
"""
