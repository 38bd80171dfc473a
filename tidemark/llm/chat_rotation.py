"""Multi-party perspective rotation of dialogues. DataFrame operations only.

For every participant of a conversation the dialogue is rendered once with that participant as the
assistant and the others as named users; the mask marks the characters that the assistant speaks.

A conversation is rendered in parts of at most ``part_turns`` turns, so that no row holds an unbounded
dialogue: turns are numbered by a range sort, whatever their own numbers are. Participants are those of
the whole conversation. Spans count from the part's begin, and ``part_start`` says where in the participant's
whole rendering that is: the parts, joined in order, are the dialogue. Its lengths are added up over rows
without texts, one for each part and participant, which then bring the participants to the parts; no row
holds all of a conversation's speakers.

Defined results: turns are ordered by turn number, then role, then text; null turns come first; a null
role is the speaker named ``unknown``; a null text is an empty one; rows that are alike are turns of
their own; a null conv_id is a conversation; texts of any length are rendered whole; an empty table
gives no row; further columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.position import with_position

UNKNOWN = "unknown"
PART_TURNS = 1024
ASSISTANT, USER, CLOSE = "<|assistant|>\n", ("<|user name=", "|>\n"), "<|end|>\n"


def _starts(rows: DataFrame) -> DataFrame:
    """(conv_id, part, participant, part_start): characters that the participant's parts before have."""
    line = F.length(F.lit(USER[0])) + F.length("role") + F.length(F.lit(USER[1])) + F.length("text") + F.length(F.lit(CLOSE))
    sizes = rows.groupBy("conv_id", "part").agg(F.sum(line.cast("long")).alias("size"))  # all turns as another's
    # what a turn has less, or more, in its own speaker's rendering
    saved = F.lit(len(ASSISTANT)).cast("long") - F.lit(len(USER[0]) + len(USER[1])) - F.length("role")
    own = rows.groupBy("conv_id", "part", "role").agg(F.sum(saved).alias("saved"))
    speakers = own.select(F.col("conv_id").alias("_c"), F.col("role").alias("participant")).distinct()
    cells = sizes.join(speakers, F.col("conv_id").eqNullSafe(F.col("_c"))).drop("_c")
    own = own.withColumnsRenamed({"conv_id": "_c", "part": "_p"})
    met = F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("part") == F.col("_p")) & (F.col("participant") == F.col("role"))
    before = W.partitionBy("conv_id", "participant").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    size = F.col("size") + F.coalesce("saved", F.lit(0))
    return cells.join(own, met, "left").select("conv_id", "part", "participant", F.coalesce(F.sum(size).over(before), F.lit(0)).alias("part_start"))


def rotate(turns: DataFrame, part_turns: int = PART_TURNS, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Row per (conversation, part, participant): conv_id, part, participant, part_start, n_turns, own_turns,
    rendered text, and spans, the 0-based [start, end) character ranges that count in training."""
    rows = turns.select(
        F.col(conv).alias("conv_id"),
        F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role), F.lit(UNKNOWN)).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
        F.monotonically_increasing_id().alias("salt"),  # parts rows that are alike
    )
    rows = with_position(rows, "turn", "role", "text", "salt", by=("conv_id",)).withColumn("part", F.floor(F.col("pos") / part_turns))
    parts = rows.groupBy("conv_id", "part").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("said"))
    heads = _starts(rows).withColumnsRenamed({"conv_id": "_conv", "part": "_part"})
    each = parts.join(heads, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("part") == F.col("_part"))).drop("_conv", "_part")
    own = lambda t: t["role"] == F.col("participant")
    head = lambda t: F.when(own(t), F.lit(ASSISTANT)).otherwise(F.concat(F.lit(USER[0]), t["role"], F.lit(USER[1])))
    lines = F.transform("said", lambda t: F.struct(head(t).alias("head"), t["text"].alias("body"), own(t).alias("own")))
    each = each.withColumn("lines", lines)
    close = F.lit(CLOSE)
    rendered = F.array_join(F.transform("lines", lambda s: F.concat(s["head"], s["body"], close)), "")
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("spans"))
    # the assistant's end mark is learnt too, the heads are not
    fold = F.aggregate(
        "lines",
        start,
        lambda acc, s: F.struct(
            (acc["at"] + F.length(s["head"]) + F.length(s["body"]) + F.length(close)).alias("at"),
            F.when(
                s["own"],
                F.concat(
                    acc["spans"],
                    F.when(acc["spans"] == "", "").otherwise(","),
                    (acc["at"] + F.length(s["head"])).cast("string"),
                    F.lit("-"),
                    (acc["at"] + F.length(s["head"]) + F.length(s["body"]) + F.length(close)).cast("string"),
                ),
            )
            .otherwise(acc["spans"])
            .alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    return each.select(
        "conv_id",
        F.col("part").cast("long").alias("part"),
        "participant",
        "part_start",
        F.size("said").cast("long").alias("n_turns"),
        F.size(F.filter("said", own)).cast("long").alias("own_turns"),
        rendered.alias("rendered"),
        fold.alias("spans"),
    )
