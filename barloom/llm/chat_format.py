"""Multi-party dialogues as training chats, one perspective for each participant.

Every participant's perspective shows the whole dialogue: its own messages as ``assistant`` (trained), the others' as ``user``
with their names, system messages as ``system``.  The result has a row for each message and perspective, with its text and
its place in the rendered dialogue, so a dialogue of any length never has to fit in one row or task.

Skew: places are prefix sums in two levels (within ``CHUNK`` turns, then over chunks), keyed by dialogue, perspective and chunk.

Defined results: a null text is empty; a message without a speaker is of the user ``unknown`` and has no perspective; messages
with the same turn are ordered by speaker, then text, null turns first; equal rows are separate messages; a dialogue of system
messages only has no perspective; a null dialogue id is a dialogue; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.mixing import prefix_sums
from barloom.llm.steps import written

SYSTEM = "system"
UNKNOWN = "unknown"
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
CHUNK = 64  # turns


def perspectives(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", speaker: str = "role", text: str = "text") -> DataFrame:
    """``(conv_id, perspective, turn, seq, role, name, rendered, begin, trained_from, trained_to, trained)``.

    ``begin`` is the character at which the message starts in the rendered dialogue; a trained message is trained on
    ``[trained_from, trained_to)``, its text and end mark; for others both are null.
    """
    rows = messages.select(
        F.col(conv).alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.col(speaker).alias("speaker"),
        F.coalesce(F.col(text), F.lit("")).alias("body"), F.monotonically_increasing_id().alias("_row"),
    )
    rows = written(rows, "messages")
    seats = rows.where(F.col("speaker").isNotNull() & (F.col("speaker") != SYSTEM)).select(F.col("conv_id").alias("_conv"), F.col("speaker").alias("perspective")).distinct()
    both = rows.join(seats, rows.conv_id.eqNullSafe(seats._conv)).drop("_conv")
    trained = F.coalesce(F.col("speaker") == F.col("perspective"), F.lit(False))
    system = F.coalesce(F.col("speaker") == SYSTEM, F.lit(False))
    role = F.when(trained, "assistant").when(system, SYSTEM).otherwise("user")
    name = F.when(~trained & ~system, F.coalesce("speaker", F.lit(UNKNOWN)))
    both = both.withColumn("trained", trained).withColumn("role", role).withColumn("name", name)
    head = F.concat(F.lit(OPEN), "role", F.when(F.col("name").isNotNull(), F.concat(F.lit(" name="), "name")).otherwise(""), F.lit("\n"))
    both = both.withColumn("_head", F.length(head)).withColumn("rendered", F.concat(head, "body", F.lit(CLOSE)))
    both = both.withColumn("_chunk", F.coalesce(F.floor(F.col("turn") / CHUNK), F.lit(-(1 << 62)))).withColumn("_size", F.length("rendered").cast("long"))
    order = ["turn", "speaker", "body", "_row"]
    placed = prefix_sums(both.withColumn("_one", F.lit(1)), ["conv_id", "perspective"], "_chunk", order, {"begin": "_size", "seq": "_one"})
    begin = F.when(F.col("trained"), F.col("begin") + F.col("_head"))
    placed = placed.withColumn("trained_from", begin).withColumn("trained_to", F.when(F.col("trained"), F.col("begin") + F.col("_size")))
    return placed.select("conv_id", "perspective", "turn", "seq", "role", "name", "rendered", "begin", "trained_from", "trained_to", "trained")


def dialogues(segments: DataFrame) -> DataFrame:
    """Whole rendered dialogues ``(conv_id, perspective, text, masks)``, for dialogues that fit in a row."""
    parts = F.array_sort(F.collect_list(F.struct("begin", "rendered", "trained_from", "trained_to", "trained")))
    out = segments.groupBy("conv_id", "perspective").agg(parts.alias("p"))
    masks = F.transform(F.filter("p", lambda s: s["trained"]), lambda s: F.struct(s["trained_from"].alias("begin"), s["trained_to"].alias("end")))
    return out.select("conv_id", "perspective", F.concat_ws("", F.col("p.rendered")).alias("text"), masks.alias("masks"))
