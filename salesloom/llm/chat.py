"""Multi-party perspective rotation: a dialogue rendered once for each participant.

For each participant that speaker is the assistant, all others are users named after their role, and system messages stay
system messages. The result has a row for each message and perspective, so a dialogue of any length is whole and
nothing is gathered: the texts of a perspective, in order of its turns, are the rendered dialogue. Every row carries its
training mask as a range of characters in its own text: the content and end mark of the assistant's messages, nothing of
others. Participants meet messages in one join by conversation, which Spark can split where one is hot.

Marks of the format inside a content are broken by a space after their first character, so no text can end its message.
System messages, and rows with a null role, make no participant; a null role is a user without a name; null and empty
texts are empty contents. A null conversation is one conversation. Turns that repeat or are null stay as rows with their
turn. A conversation without participants is rendered by no perspective and has no rows. An empty table gives an empty
result. Native expressions only.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BEGIN, END = "<|im_start|>", "<|im_end|>"
SYSTEM = "system"


def _content(text: str) -> Column:
    plain = F.coalesce(F.col(text), F.lit(""))
    return F.replace(F.replace(plain, F.lit(BEGIN), F.lit("< " + BEGIN[1:])), F.lit(END), F.lit("< " + END[1:]))


def rotate(messages: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, perspective, turn, speaker, rendered, mask_start, mask_end (an empty range, 0 to 0, where nothing is trained on)."""
    rows = messages.select(F.col(conversation).alias("conv"), F.col(turn).alias("turn"), F.col(role).alias("who"), _content(text).alias("content"))
    people = rows.where(F.col("who").isNotNull() & (F.col("who") != SYSTEM)).select(F.col("conv").alias("of"), F.col("who").alias("perspective")).distinct()
    met = rows.join(people, F.col("conv").eqNullSafe(F.col("of")))
    own = F.coalesce(F.col("who") == F.col("perspective"), F.lit(False))
    name = F.regexp_replace("who", r"[^0-9A-Za-z_-]", "_")
    head = (F.when(own, "assistant").when(F.col("who") == SYSTEM, SYSTEM).when(F.col("who").isNull() | (name == ""), "user").otherwise(F.concat(F.lit("user name="), name)))
    speaker = F.when(own, "assistant").when(F.col("who") == SYSTEM, SYSTEM).otherwise("user")
    opening = F.concat(F.lit(BEGIN), head, F.lit("\n"))
    return met.select(
        F.col("conv").alias(conversation), "perspective", F.col("turn").alias(turn), speaker.alias("speaker"),
        F.concat(opening, "content", F.lit(END + "\n")).alias("rendered"),
        F.when(own, F.length(opening)).otherwise(0).cast("bigint").alias("mask_start"),
        F.when(own, F.length(opening) + F.length("content") + len(END)).otherwise(0).cast("bigint").alias("mask_end"),
    )


ROTATE_SQL = f"""
WITH m AS (
  SELECT conv_id, turn, role, replace(replace(coalesce(text, ''), '{BEGIN}', '< {BEGIN[1:]}'), '{END}', '< {END[1:]}') AS content FROM conversations),
p AS (SELECT DISTINCT conv_id, role AS perspective FROM m WHERE role IS NOT NULL AND role <> '{SYSTEM}'),
r AS (
  SELECT m.*, perspective, coalesce(role = perspective, false) AS own,
         CASE WHEN coalesce(role = perspective, false) THEN 'assistant' WHEN role = '{SYSTEM}' THEN '{SYSTEM}'
              WHEN role IS NULL OR role = '' THEN 'user' ELSE 'user name=' || regexp_replace(role, '[^0-9A-Za-z_-]', '_', 'g') END AS head
  FROM m JOIN p ON m.conv_id IS NOT DISTINCT FROM p.conv_id)
SELECT conv_id, perspective, turn, CASE WHEN own THEN 'assistant' WHEN role = '{SYSTEM}' THEN '{SYSTEM}' ELSE 'user' END AS speaker,
       '{BEGIN}' || head || chr(10) || content || '{END}' || chr(10) AS rendered,
       CASE WHEN own THEN length('{BEGIN}' || head || chr(10)) ELSE 0 END::BIGINT AS mask_start,
       CASE WHEN own THEN length('{BEGIN}' || head || chr(10)) + length(content) + {len(END)} ELSE 0 END::BIGINT AS mask_end
FROM r
"""
