"""Chat formatting by perspective rotation: every participant of a dialogue in turn is the assistant.

For each participant the dialogue is rendered with that speaker's turns as the assistant's, a system speaker's as the
system's and everyone else's as those of a user with a name; the spans to train on are the assistant's texts with the
mark that ends them. Built-in expressions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
SYSTEM = "system"
USER, ASSISTANT = "user name=", "assistant"


def rotate(turns: DataFrame, part: int | None = None, speaker: str = "role") -> DataFrame:
    """turns (conv_id, turn, <speaker>, text) -> conv_id, perspective, part, before, n_turns, rendered, spans, n_target_chars.

    One row for each dialogue and participant: the whole dialogue, in the order of turn, speaker, text. Participants are the
    speakers other than the system; a dialogue of the system alone gives no row. spans array<struct<from long, to long>> are
    offsets in code points in rendered, from inclusive, to exclusive: the perspective's texts with their end mark. A null
    speaker is named unknown, a null text is empty, null turns come first. A turn without conv_id is a dialogue of
    its own. Rows that repeat conv_id, turn, speaker and text are one turn. `<|` in a text or name is written `< |`, so
    that no text ends its own turn. Other columns don't matter. An empty table gives an empty result.

    part: for storage, at most so many turns in a row; the rows of one rendering, joined in the order of part, are the whole
    of it, and before is how many of its code points stand in earlier parts. Without it part and before are 0.
    """
    safe = lambda c: F.replace(c, F.lit("<|"), F.lit("< |"))
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        safe(F.coalesce(F.col(speaker).cast("string"), F.lit("unknown"))).alias("who"),
        safe(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text"),
    )
    # what tells dialogues apart; turns without conv_id by what they are, so that they don't meet in one group
    alone = F.when(F.col("conv_id").isNull(), F.struct("turn", "who", "text"))
    rows = rows.distinct().withColumn("talk", F.struct("conv_id", alone.alias("alone")))

    said = Window.partitionBy("talk").orderBy("turn", "who", "text")
    before = said.rowsBetween(Window.unboundedPreceding, -1)
    system = F.col("who") == SYSTEM
    # offsets as if every speaker were a user; of the perspective's own turns before, each is shorter by the same number
    user = F.when(system, F.lit(SYSTEM)).otherwise(F.concat(F.lit(USER), "who"))
    size = (F.length(user) + F.length("text") + len(OPEN) + len(CLOSE) + 2).cast("long")
    rows = rows.withColumns({"at": F.coalesce(F.sum(size).over(before), F.lit(0)), "place": F.row_number().over(said)})
    rows = rows.withColumn("own", F.row_number().over(Window.partitionBy("talk", "who").orderBy("place")) - 1)
    less = F.length("who") + len(USER) - len(ASSISTANT)
    begin = F.col("at") - F.col("own") * less + len(OPEN) + len(ASSISTANT) + 1
    span = F.struct(begin.cast("long").alias("from"), (begin + F.length("text") + len(CLOSE)).cast("long").alias("to"))
    rows = rows.withColumn("part", F.floor((F.col("place") - 1) / part) if part else F.lit(0).cast("long"))

    parts = rows.groupBy("talk", "part").agg(F.sort_array(F.collect_list(F.struct("place", "who", "text"))).alias("said"), F.min("at").alias("at"))
    mine = rows.where(~system).withColumn("span", span).groupBy("talk", F.col("who").alias("perspective"), "part")
    mine = mine.agg(F.sort_array(F.collect_list("span")).alias("spans"), F.min("own").alias("own"))
    people = mine.select("talk", "perspective").distinct()
    both = parts.join(people, "talk")
    if part:
        both = both.join(mine, ["talk", "perspective", "part"], "left")
        # where a part holds none of the perspective's turns, those before it come from the last part that does
        own = Window.partitionBy("talk", "perspective").orderBy("part")
        count = F.coalesce(F.sum(F.coalesce(F.size("spans"), F.lit(0))).over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        both = both.withColumn("before", (F.col("at") - count * (F.length("perspective") + len(USER) - len(ASSISTANT))).cast("long"))
        none = F.expr("cast(array() as array<struct<from: bigint, to: bigint>>)")
        moved = F.transform("spans", lambda s: F.struct((s["from"] - F.col("before")).alias("from"), (s["to"] - F.col("before")).alias("to")))
        both = both.withColumn("spans", F.coalesce(moved, none))
    else:
        both = parts.join(mine.drop("part"), "talk").withColumn("before", F.lit(0).cast("long"))

    name = lambda t: F.when(t["who"] == SYSTEM, SYSTEM).when(t["who"] == F.col("perspective"), ASSISTANT).otherwise(F.concat(F.lit(USER), t["who"]))
    shown = F.transform("said", lambda t: F.concat(F.lit(OPEN), name(t), F.lit("\n"), t["text"], F.lit(CLOSE), F.lit("\n")))
    return both.select(
        F.col("talk.conv_id").alias("conv_id"),
        "perspective",
        "part",
        "before",
        F.size("said").cast("long").alias("n_turns"),
        F.array_join(shown, "").alias("rendered"),
        "spans",
        F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + (s["to"] - s["from"])).alias("n_target_chars"),
    )
