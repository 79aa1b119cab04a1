"""Chat formatting: every participant's perspective on a multi-party dialogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

#: Roles that set the scene and take no turn of their own.
SCENE = "system"
BUCKET_BITS = 8


def _header(role: Column, perspective: Column) -> Column:
    return (
        F.when(role == perspective, F.lit("<|assistant|>\n"))
        .when(role == SCENE, F.lit("<|system|>\n"))
        .otherwise(F.concat(F.lit("<|user:"), F.coalesce(role, F.lit("unknown")), F.lit("|>\n")))
    )


def perspectives(conversations: DataFrame) -> DataFrame:
    """Render ``conversations(conv_id, turn, role, text)`` once for every participant.

    Rows: ``(conv_id, perspective, turn, position, role, segment, start, n_chars, mask_start, mask_end)``. The
    segments of a conversation and perspective, in the order of position, are one training text: the perspective's
    turns are the assistant's, other participants are users by name, system turns stay. start is the segment's
    place in that text, in characters; [mask_start, mask_end) is what is learned (the assistant's words and the
    end of the turn), null elsewhere. Turns are in the order of turn, role and the text's MD5.

    The text is shuffled once, by conversation and block of 256 turns, so a conversation with a third of all
    turns spreads over its blocks; offsets come from sums per block and role. Each turn is rendered once for each
    participant, which is the result's size. DataFrame functions only.

    Defined results: a null text is an empty turn; a text of any length is one segment; texts are passed as they are,
    marks like those of the headers among them; a null role speaks as the user "unknown" and has no
    perspective; turns alike in turn, role and text come in any order, which shows nowhere; system has none either, so a conversation of nothing else yields no rows; null turns come first;
    a null conv_id is a conversation of its own; repeated rows are turns of their own; an empty table gives no
    rows; extra columns are ignored.
    """
    rows = conversations.select(
        "conv_id",
        "turn",
        "role",
        F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit("n")).alias("ck"),
        F.coalesce(F.shiftright(F.col("turn").cast("long"), BUCKET_BITS), F.lit(-(1 << 60))).alias("block"),
    )
    role, seen_as = F.col("role"), F.col("perspective")
    sums = rows.groupBy("ck", "block", "role").agg(F.count("*").alias("turns"), F.sum(F.length("text")).alias("chars"))
    people = sums.where(role.isNotNull() & (role != SCENE)).select("ck", role.alias("perspective")).distinct()
    size = F.col("chars") + F.col("turns") * (F.length(_header(role, seen_as)) + 1)
    blocks = sums.join(people, "ck").groupBy("ck", "perspective", "block").agg(F.sum(size).alias("chars"), F.sum("turns").alias("turns"))
    earlier = W.partitionBy("ck", "perspective").orderBy("block")
    bases = blocks.select(
        "ck",
        "block",
        "perspective",
        (F.sum("chars").over(earlier) - F.col("chars")).alias("base"),
        (F.sum("turns").over(earlier) - F.col("turns")).alias("before"),
    )
    segment = F.concat(_header(role, seen_as), F.col("text"), F.lit("\n"))
    inside = W.partitionBy("ck", "block", "perspective").orderBy("turn", "role", "tie")
    upto = inside.rowsBetween(W.unboundedPreceding, W.currentRow)
    out = (
        rows.join(bases, ["ck", "block"])
        .withColumn("tie", F.md5("text"))
        .withColumn("segment", segment)
        .withColumn("n_chars", F.length("segment").cast("long"))
        .withColumn("position", (F.col("before") + F.row_number().over(inside) - 1).cast("long"))
        .withColumn("start", (F.col("base") + F.sum("n_chars").over(upto) - F.col("n_chars")).cast("long"))
    )
    spoken = role == seen_as
    return out.select(
        "conv_id",
        "perspective",
        "turn",
        "position",
        "role",
        "segment",
        "start",
        "n_chars",
        F.when(spoken, F.col("start") + F.length(_header(role, seen_as))).cast("long").alias("mask_start"),
        F.when(spoken, F.col("start") + F.col("n_chars")).cast("long").alias("mask_end"),
    )
