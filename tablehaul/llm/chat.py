"""Chat formatting by perspective rotation.

For every participant of a conversation the dialogue is rendered once with that speaker as the assistant. All other
speakers become users under their own names, system turns stay as they are, and the loss mask covers what the
assistant says. A rendering is kept as its turns in order, each with its place in the whole text, so a conversation
of any length is never gathered into one row or task: places are running sums inside chunks of turns, plus the sums
of the chunks before. ``dialogues`` glues the turns together where a length bound allows it.

Defined results: a null role is a speaker named ``unknown``; a null text is empty; turns in equal places are ordered
by speaker and text; a null turn comes first; a conversation of system turns only has no perspective; turns
without a conv_id belong to no conversation and give no rows; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SYSTEM = "system"
CHUNK = 256
#: What a turn looks like; the query's SQL says the same.
END = "<|end|>\n"


def turns_of(conversations: DataFrame) -> DataFrame:
    return conversations.select("conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("speaker"), F.coalesce("text", F.lit("")).alias("text"))


def participants(turns: DataFrame) -> DataFrame:
    """Distinct (conv_id, participant): everyone who speaks but the system."""
    return turns.filter(F.col("speaker") != SYSTEM).select("conv_id", F.col("speaker").alias("participant")).distinct()


def rotate(conversations: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """conv_id, participant, turn, role, name, rendered, mask_start, mask_end, masked_chars, char_start, char_end.

    ``mask_start``/``mask_end`` bound the characters to learn from, in the whole rendering; both are null in turns
    that are only read. Offsets count code points.
    """
    turns = turns_of(conversations)
    me = F.col("speaker") == F.col("participant")
    role = F.when(F.col("speaker") == SYSTEM, SYSTEM).when(me, "assistant").otherwise("user")
    name = F.when(role == "user", F.col("speaker"))
    head = F.concat(F.lit("<|"), F.col("role"), F.lit("|>"), F.coalesce(F.concat(F.lit(" "), F.col("name")), F.lit("")), F.lit("\n"))
    rows = turns.join(participants(turns), "conv_id")
    rows = rows.withColumns({"role": role, "name": name}).withColumn("head", head).withColumn("rendered", F.concat("head", "text", F.lit(END))).withColumn("n", F.length("rendered").cast("bigint"))
    rows = rows.withColumn("chunk", F.floor(F.coalesce("turn", F.lit(-1)) / F.lit(chunk)))
    keys = ["conv_id", "participant"]
    inside = Window.partitionBy(*keys, "chunk").orderBy("turn", "speaker", "text").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*keys, "chunk").agg(F.sum("n").alias("chars"))
    before = sums.withColumn("before", F.coalesce(F.sum("chars").over(Window.partitionBy(*keys).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("chars")
    out = rows.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(before, [*keys, "chunk"])
    start = F.col("before") + F.col("inside")
    said = F.col("role") == "assistant"
    return out.select(
        *keys, "turn", "role", "name", "rendered",
        F.when(said, start + F.length("head")).alias("mask_start"), F.when(said, start + F.length("head") + F.length("text")).alias("mask_end"),
        F.when(said, F.length("text")).otherwise(0).cast("bigint").alias("masked_chars"), start.alias("char_start"), (start + F.col("n")).alias("char_end"),
    )


def dialogues(rotated: DataFrame, max_chars: int = 1_000_000) -> DataFrame:
    """Whole renderings (conv_id, participant, text, masks) of conversations of up to ``max_chars``; longer ones stay in turns."""
    keys = ["conv_id", "participant"]
    short = rotated.groupBy(*keys).agg(F.max("char_end").alias("chars")).filter(F.col("chars") <= max_chars).drop("chars")
    turn = F.struct("char_start", "rendered", "mask_start", "mask_end")
    got = rotated.join(short, keys).groupBy(*keys).agg(F.array_sort(F.collect_list(turn)).alias("t"))
    masks = F.transform(F.filter("t", lambda x: x["mask_start"].isNotNull()), lambda x: F.struct(x["mask_start"], x["mask_end"]))
    return got.select(*keys, F.array_join(F.transform("t", lambda x: x["rendered"]), "").alias("text"), masks.alias("masks"))


ORACLE = """
WITH t AS (SELECT conv_id, turn, coalesce(role, 'unknown') speaker, coalesce(text, '') txt FROM conversations),
p AS (SELECT DISTINCT conv_id, speaker participant FROM t WHERE speaker <> 'system'),
r AS (SELECT t.conv_id, participant, turn, speaker, txt, CASE WHEN speaker = 'system' THEN 'system' WHEN speaker = participant THEN 'assistant' ELSE 'user' END role FROM t JOIN p ON p.conv_id = t.conv_id),
h AS (SELECT *, CASE WHEN role = 'user' THEN speaker END name, '<|' || role || '|>' || CASE WHEN role = 'user' THEN ' ' || speaker ELSE '' END || chr(10) head FROM r),
x AS (SELECT *, head || txt || '<|end|>' || chr(10) rendered FROM h),
s AS (SELECT *, coalesce(sum(length(rendered)) OVER (PARTITION BY conv_id, participant ORDER BY turn, speaker, txt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) pos FROM x)
SELECT conv_id, participant, turn, role, name, rendered,
  CAST(CASE WHEN role = 'assistant' THEN pos + length(head) END AS BIGINT) mask_start, CAST(CASE WHEN role = 'assistant' THEN pos + length(head) + length(txt) END AS BIGINT) mask_end,
  CAST(CASE WHEN role = 'assistant' THEN length(txt) ELSE 0 END AS BIGINT) masked_chars, CAST(pos AS BIGINT) char_start, CAST(pos + length(rendered) AS BIGINT) char_end
FROM s
"""
