"""Preference formatting of chat conversations, in DataFrame operations only.

A pair has a chosen and a rejected conversation.  Their longest common prefix of turns
is rendered once as the prompt; what remains of each is its completion, with a mask of
the parts that count for the loss: the text and end mark of the trained role's turns.

All windows have the pair as their (leading) key, so turns are shuffled once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """A turn is ``before_role + role + after_role + text + end``."""

    before_role: str = "<|"
    after_role: str = "|>\n"
    end: str = "<|end|>\n"
    trained_role: str = "assistant"


def preference_pairs(chosen: DataFrame, rejected: DataFrame, template: Template = Template()) -> DataFrame:
    """One row per pair from two tables ``pair_id, turn, role, text``.

    Returns ``pair_id, n_prompt_turns, n_chosen_turns, n_rejected_turns`` (of the
    completions), ``prompt, chosen, rejected`` and ``chosen_mask, rejected_mask``: spans
    ``start:stop`` in code points of that completion, comma-joined.

    A turn belongs to the prefix if role and text are equal on both sides there and in all
    turns before.  Turns are ordered by turn, role and text; repeated rows are turns of their
    own.  A null turn comes first; a null role or text is as an empty one; a text of any length is kept
    whole.  A side without turns has an empty completion; empty tables give no rows; of two equal conversations all is prompt.  Rows without pair_id belong to no
    pair and are left out.  Other columns are ignored.
    """

    def side(turns: DataFrame, rejected_side: bool) -> DataFrame:
        blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
        return turns.where("pair_id is not null").select("pair_id", F.lit(rejected_side).alias("is_rejected"), F.col("turn").cast("long").alias("turn"), blank("role").alias("role"), blank("text").alias("text"))

    rows = side(chosen, False).unionByName(side(rejected, True)).repartition("pair_id")
    ordered = Window.partitionBy("pair_id", "is_rejected").orderBy("turn", "role", "text")
    head = F.concat(F.lit(template.before_role), F.col("role"), F.lit(template.after_role))
    rows = rows.withColumn("pos", F.row_number().over(ordered)).withColumn("head", head).withColumn("piece", F.concat("head", "text", F.lit(template.end)))

    # A place of the prefix holds one turn of each side, and the two are equal.
    place = Window.partitionBy("pair_id", "pos")
    turn = F.struct("role", "text")
    rows = rows.withColumn("same", (F.count("*").over(place) == 2) & (F.min(turn).over(place) == F.max(turn).over(place)))
    pair = Window.partitionBy("pair_id")
    rows = rows.withColumn("first_other", F.min(F.when(~F.col("same"), F.col("pos"))).over(pair))
    in_prompt = F.col("first_other").isNull() | (F.col("pos") < F.col("first_other"))
    rows = rows.withColumn("in_prompt", in_prompt)

    # Code points of the completion before each turn.
    before = Window.partitionBy("pair_id", "is_rejected").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    length = F.when(F.col("in_prompt"), F.lit(0)).otherwise(F.length("piece")).cast("long")
    rows = rows.withColumn("at", F.coalesce(F.sum(length).over(before), F.lit(0)))
    span = F.concat_ws(":", F.col("at") + F.length("head"), F.col("at") + F.length("piece"))

    def joined(when: Column, value: Column, by: str) -> Column:
        items = F.sort_array(F.collect_list(F.when(when, F.struct("pos", value.alias("value")))))
        return F.array_join(F.transform(items, lambda x: x["value"]), by)

    later, trained = ~F.col("in_prompt"), F.col("role") == template.trained_role
    on_chosen, on_rejected = later & ~F.col("is_rejected"), later & F.col("is_rejected")
    return rows.groupBy("pair_id").agg(
        F.count_if(F.col("in_prompt") & ~F.col("is_rejected")).alias("n_prompt_turns"),
        F.count_if(on_chosen).alias("n_chosen_turns"),
        F.count_if(on_rejected).alias("n_rejected_turns"),
        joined(F.col("in_prompt") & ~F.col("is_rejected"), F.col("piece"), "").alias("prompt"),
        joined(on_chosen, F.col("piece"), "").alias("chosen"),
        joined(on_rejected, F.col("piece"), "").alias("rejected"),
        joined(on_chosen & trained, span, ",").alias("chosen_mask"),
        joined(on_rejected & trained, span, ",").alias("rejected_mask"),
    )


def neighbour_pairs(conversations: DataFrame, template: Template = Template()) -> DataFrame:
    """Pairs from ``conv_id, turn, role, text``: conversation 2k is chosen and 2k + 1 rejected."""
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text").withColumn("pair_id", F.expr("conv_id div 2"))
    return preference_pairs(turns.where("conv_id % 2 = 0"), turns.where("conv_id % 2 <> 0"), template)


PAIRS_SQL = """
WITH t AS (
  SELECT conv_id // 2 AS pair_id, conv_id % 2 <> 0 AS is_rejected, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
), p AS (
  SELECT *, row_number() OVER (PARTITION BY pair_id, is_rejected ORDER BY turn, role, text) AS pos,
    '<|' || role || '|>' || chr(10) AS head, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS piece
  FROM t
), s AS (
  SELECT *, count(*) OVER (PARTITION BY pair_id, pos) = 2
    AND min(piece) OVER (PARTITION BY pair_id, pos) = max(piece) OVER (PARTITION BY pair_id, pos) AS same
  FROM p
), f AS (
  SELECT *, coalesce(pos < min(CASE WHEN NOT same THEN pos END) OVER (PARTITION BY pair_id), true) AS in_prompt FROM s
), a AS (
  SELECT *, coalesce(sum(CASE WHEN in_prompt THEN 0 ELSE length(piece) END) OVER (PARTITION BY pair_id, is_rejected ORDER BY pos
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS place FROM f
), m AS (
  SELECT *, (place + length(head)) || ':' || (place + length(piece)) AS span FROM a
)
SELECT pair_id,
  count(*) FILTER (WHERE in_prompt AND NOT is_rejected) AS n_prompt_turns,
  count(*) FILTER (WHERE NOT in_prompt AND NOT is_rejected) AS n_chosen_turns,
  count(*) FILTER (WHERE NOT in_prompt AND is_rejected) AS n_rejected_turns,
  coalesce(string_agg(piece, '' ORDER BY pos) FILTER (WHERE in_prompt AND NOT is_rejected), '') AS prompt,
  coalesce(string_agg(piece, '' ORDER BY pos) FILTER (WHERE NOT in_prompt AND NOT is_rejected), '') AS chosen,
  coalesce(string_agg(piece, '' ORDER BY pos) FILTER (WHERE NOT in_prompt AND is_rejected), '') AS rejected,
  coalesce(string_agg(span, ',' ORDER BY pos) FILTER (WHERE NOT in_prompt AND NOT is_rejected AND role = 'assistant'), '') AS chosen_mask,
  coalesce(string_agg(span, ',' ORDER BY pos) FILTER (WHERE NOT in_prompt AND is_rejected AND role = 'assistant'), '') AS rejected_mask
FROM m GROUP BY pair_id
"""
