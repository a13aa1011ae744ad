"""Preference formatting of chosen and rejected conversations.

The longest common prefix of turns (same role and text at the same place) is rendered
once as prompt; what follows it in either conversation is a completion. Completions
carry the spans of characters that are trained on: the texts of assistant turns, not
the role marks or other roles' turns.

Everything is DataFrame functions. One row is made for a pair; turns of a conversation
meet in one row, as a conversation is one text.

Defined results: a null role or text is an empty one; turns go by turn number, ties by
role and text, null numbers first; repeated turns stay; a pair without a second
conversation has an empty rejected completion and no common prefix; a common prefix
covers the shorter conversation whole if it is a prefix of the other; an empty table
gives no pairs; very long texts are rendered whole; rows of a null conversation id are in no
pair. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Marks around a turn.
OPEN, MIDDLE, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"


def turns_of(df: DataFrame, key: str = "conv_id") -> DataFrame:
    """One row a conversation: its id and its turns in order."""
    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return df.groupBy(F.col(key).cast("long").alias(key)).agg(F.array_sort(F.collect_list(turn)).alias("turns"))


def _render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), t["role"], F.lit(MIDDLE), t["text"], F.lit(CLOSE))), "")


def _mask(turns: Column, trained: str) -> Column:
    """Character spans [start, end) of the trained turns' texts in the rendered turns."""
    around = len(OPEN + MIDDLE + CLOSE)
    start = F.aggregate(
        turns,
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:long,end:long>>").alias("spans")),
        lambda seen, t: F.struct(
            (seen["at"] + around + F.length(t["role"]) + F.length(t["text"])).alias("at"),
            F.when(
                t["role"] == trained,
                F.concat(
                    seen["spans"],
                    F.array(F.struct((seen["at"] + len(OPEN + MIDDLE) + F.length(t["role"])).cast("long").alias("start"), (seen["at"] + len(OPEN + MIDDLE) + F.length(t["role"]) + F.length(t["text"])).cast("long").alias("end"))),
                ),
            )
            .otherwise(seen["spans"])
            .alias("spans"),
        ),
    )
    return start["spans"]


def preferences(pairs: DataFrame, trained: str = "assistant") -> DataFrame:
    """``pairs`` has pair_id, chosen and rejected (arrays of turns); rows of prompt and completions."""
    same = F.zip_with("chosen", "rejected", lambda x, y: F.coalesce((x["role"] == y["role"]) & (x["text"] == y["text"]), F.lit(False)))
    differs = F.array_position(same, False)
    n = F.when(differs > 0, differs - 1).otherwise(F.size(same)).cast("int")
    rows = pairs.withColumn("n_common", n)
    rest = {side: F.slice(F.col(side), F.col("n_common") + 1, F.greatest(F.size(side), F.lit(1))) for side in ("chosen", "rejected")}
    return rows.select(
        "pair_id",
        "n_common",
        _render(F.slice("chosen", F.lit(1), F.col("n_common"))).alias("prompt"),
        _render(rest["chosen"]).alias("chosen"),
        _render(rest["rejected"]).alias("rejected"),
        _mask(rest["chosen"], trained).alias("chosen_mask"),
        _mask(rest["rejected"], trained).alias("rejected_mask"),
    )


def neighbour_pairs(df: DataFrame, key: str = "conv_id") -> DataFrame:
    """Pairs of conversations 2k (chosen) and 2k + 1 (rejected); either may be absent."""
    none = F.array().cast("array<struct<turn:long,role:string,text:string>>")
    pair = F.shiftright(F.col(key).cast("long"), 1)
    turns = turns_of(df, key).withColumn("pair_id", pair)
    side = lambda odd: F.coalesce(F.max(F.when(F.pmod(F.col(key), F.lit(2)) == odd, F.col("turns"))), none)
    return turns.where(F.col(key).isNotNull()).groupBy("pair_id").agg(side(0).alias("chosen"), side(1).alias("rejected"))
