"""Multi-party perspective rotation of dialogues; DataFrame functions only.

For every participant (each role but `system`; `system` itself if it speaks
alone) the whole dialogue is rendered with that speaker as assistant, the others
as named users, and the character spans of the assistant's own words as mask.

Turns are numbered by the counts of parts of a dialogue and rendered in chunks of
CHUNK_TURNS, so no long dialogue is sorted or rendered turn by turn in one task;
only the finished chunks of one rendering meet, as it is one text in the end. The
output grows with participants times turns, as each has a rendering.

Defined cases: turns go by (turn, role, text); null role is `unknown`, null text
is empty, null turn comes first (as -1), turns without conv_id make one dialogue;
`<|` in names and texts becomes `< |`, so that no text can look like a mark;
repeated rows are rendered as often as they occur; an empty table gives an empty
result; other columns are ignored. A rendering of over 2 GB is an error.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CHUNK_TURNS = 64


def rotate_perspectives(turns: DataFrame) -> DataFrame:
    """Per dialogue and perspective: conv_id, perspective, n_turns, n_masked, rendered, mask ("start:end" of each own text)."""
    plain = lambda c: F.replace(c, F.lit("<|"), F.lit("< |"))
    clean = turns.select(
        "conv_id",
        F.coalesce(F.col("turn").cast("long"), F.lit(-1)).alias("turn"),
        plain(F.coalesce("role", F.lit("unknown"))).alias("role"),
        plain(F.coalesce("text", F.lit(""))).alias("text"),
    ).withColumn("part", F.floor(F.col("turn") / CHUNK_TURNS))
    roles = clean.groupBy("conv_id").agg(F.collect_set("role").alias("roles"))
    roles = roles.select(F.col("conv_id").alias("of"), F.explode(F.when(F.size("roles") > 1, F.array_remove("roles", "system")).otherwise(F.col("roles"))).alias("perspective"))
    # gapless numbers of the turns in their dialogue: those of its part, after the turns of the parts before
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = clean.groupBy("conv_id", "part").count().select(F.col("conv_id").alias("of"), F.col("part").alias("of_part"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    nth = F.row_number().over(Window.partitionBy("conv_id", "part").orderBy("turn", "role", "text"))
    numbered = clean.withColumn("nth", nth).join(starts, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("part") == F.col("of_part"))).withColumn("nth", F.col("nth") + F.col("start") - 1)
    chunks = numbered.groupBy("conv_id", F.floor(F.col("nth") / CHUNK_TURNS).alias("chunk")).agg(F.sort_array(F.collect_list(F.struct("nth", "role", "text"))).alias("turns"))
    each = chunks.join(roles, F.col("conv_id").eqNullSafe(F.col("of")))
    mine = lambda t: t["role"] == F.col("perspective")
    head = lambda t: F.when(mine(t), F.lit("<|assistant|>\n")).when(t["role"] == "system", F.lit("<|system|>\n")).otherwise(F.concat(F.lit("<|user name="), t["role"], F.lit("|>\n")))
    each = each.withColumn("parts", F.transform("turns", lambda t: F.struct(head(t).alias("head"), t["text"].alias("text"), mine(t).alias("mine"))))
    rendered = F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["text"], F.lit("\n"))), "")
    each = each.select("conv_id", "perspective", "chunk", "parts", rendered.alias("rendered"))
    ahead = Window.partitionBy("conv_id", "perspective").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    each = each.withColumn("at", F.coalesce(F.sum(F.length("rendered").cast("long")).over(ahead), F.lit(0).cast("long")))
    first = F.struct(F.col("at"), F.expr("cast(array() as array<string>)").alias("spans"))
    step = lambda acc, p: F.struct(
        (acc["at"] + F.length(p["head"]) + F.length(p["text"]) + 1).cast("long").alias("at"),
        F.when(p["mine"], F.concat(acc["spans"], F.array(F.concat_ws(":", acc["at"] + F.length(p["head"]), acc["at"] + F.length(p["head"]) + F.length(p["text"]))))).otherwise(acc["spans"]).alias("spans"),
    )
    spans = F.aggregate("parts", first, step)["spans"]
    done = each.select("conv_id", "perspective", F.struct("chunk", "rendered", spans.alias("spans")).alias("c"), F.size("parts").alias("turns"), F.size(spans).alias("masked"))
    whole = done.groupBy("conv_id", "perspective").agg(F.sort_array(F.collect_list("c")).alias("c"), F.sum("turns").alias("n_turns"), F.sum("masked").alias("n_masked"))
    return whole.select("conv_id", "perspective", "n_turns", "n_masked", F.array_join("c.rendered", "").alias("rendered"), F.array_join(F.flatten("c.spans"), ",").alias("mask"))
