"""Multi-party perspective rotation of dialogues.

For each participant of a conversation the dialogue is rendered with that speaker as the assistant and everyone else as a named user;
the mask covers what the assistant says (content and end mark), as these are the characters to be learned. System turns belong to
nobody: they stay system turns in every perspective.

The result has a row for each perspective and turn, with the turn's place in the rendered dialogue, so a dialogue of any length is spread
over many rows and tasks; the segments in order are the dialogue. Places are running sums made in two steps (inside ranges, then over
ranges), so a conversation that holds a third of all turns isn't gathered into one task.

Defined cases: a null role is the speaker `unknown`; a null text is empty; turns with equal numbers are ordered by role, then by the
SHA-256 of their texts (whole texts would be range keys otherwise, of which a sample comes to the driver); texts of any length are one segment; rows
that are equal in all of these are numbered in any order (they render alike); a null conv_id is a conversation of its own; null turn
numbers come first; system turns alone have no perspective and give no row; an empty table
gives none; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import running

SYSTEM = ("system",)
START, END = "<|im_start|>", "<|im_end|>\n"


def rotate(conversations: DataFrame, system_roles: tuple[str, ...] = SYSTEM) -> DataFrame:
    """conv_id, perspective, seq, turn, speaker, role, segment, start, length, mask_start, mask_length (characters; length 0: no mask)."""
    speaker = F.coalesce("role", F.lit("unknown"))
    turns = conversations.select("conv_id", "turn", speaker.alias("speaker"), F.coalesce("text", F.lit("")).alias("text"))
    people = turns.where(~F.col("speaker").isin(*system_roles)).select(F.col("conv_id").alias("p_conv"), F.col("speaker").alias("perspective")).distinct()
    seen = turns.join(people, F.col("conv_id").eqNullSafe(F.col("p_conv"))).drop("p_conv")
    role = F.when(F.col("speaker").isin(*system_roles), "system").when(F.col("speaker") == F.col("perspective"), "assistant").otherwise("user")
    named = F.when(F.col("role") == "user", F.concat(F.lit("user name="), "speaker")).otherwise(F.col("role"))
    shown = seen.withColumn("role", role).withColumn("head", F.concat(F.lit(START), named, F.lit("\n")))
    shown = shown.withColumn("segment", F.concat("head", "text", F.lit(END))).withColumn("length", F.length("segment").cast("long")).withColumn("head_length", F.length("head").cast("long"))
    shown = shown.withColumn("digest", F.sha2("text", 256)).drop("head", "text")
    out = running(shown, ["conv_id", "perspective"], ["turn", "speaker", "digest"], "length")
    taught = F.col("role") == "assistant"
    pick = lambda c: F.when(taught, c).otherwise(F.lit(0)).cast("long")
    return out.select(
        "conv_id", "perspective", "seq", "turn", "speaker", "role", "segment", F.col("before").alias("start"), "length",
        pick(F.col("before") + F.col("head_length")).alias("mask_start"), pick(F.col("length") - F.col("head_length")).alias("mask_length"),
    )


def assemble(rotated: DataFrame, part_chars: int = 1 << 20) -> DataFrame:
    """conv_id, perspective, part, text, masks: whole dialogues (part 0), longer ones in parts of about `part_chars` characters."""
    keys = ["conv_id", "perspective", F.floor(F.col("start") / part_chars).alias("part")]
    grouped = rotated.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("seq", "segment", "mask_start", "mask_length"))).alias("turns"))
    masks: Column = F.expr("transform(filter(turns, t -> t.mask_length > 0), t -> struct(t.mask_start as start, t.mask_length as length))")
    return grouped.select("conv_id", "perspective", "part", F.expr("array_join(transform(turns, t -> t.segment), '')").alias("text"), masks.alias("masks"))


def op6_chat_rotation(spark, sf_dir: str) -> DataFrame:
    return rotate(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


SQL = {
    "op6_chat_rotation": r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS text FROM conversations),
p AS (SELECT DISTINCT conv_id, speaker AS perspective FROM t WHERE speaker <> 'system'),
s AS (SELECT t.conv_id, perspective, turn, speaker, text,
             CASE WHEN speaker = 'system' THEN 'system' WHEN speaker = perspective THEN 'assistant' ELSE 'user' END AS role
      FROM t JOIN p ON t.conv_id = p.conv_id),
h AS (SELECT *, '<|im_start|>' || CASE WHEN role = 'user' THEN 'user name=' || speaker ELSE role END || chr(10) AS head FROM s),
g AS (SELECT *, head || text || '<|im_end|>' || chr(10) AS segment FROM h),
l AS (SELECT *, CAST(length(segment) AS BIGINT) AS length, CAST(length(head) AS BIGINT) AS head_length FROM g),
r AS (SELECT *, CAST(coalesce(sum(length) OVER w, 0) AS BIGINT) AS start, CAST(count(*) OVER w AS BIGINT) AS seq FROM l
      WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn, speaker, sha256(text) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT conv_id, perspective, seq, turn, speaker, role, segment, start, length,
       CAST(CASE WHEN role = 'assistant' THEN start + head_length ELSE 0 END AS BIGINT) AS mask_start,
       CAST(CASE WHEN role = 'assistant' THEN length - head_length ELSE 0 END AS BIGINT) AS mask_length
FROM r
"""
}
