"""Sharding by proportional stratified interleaving, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from .common import stored

LAW = "rows"


def interleave(docs: DataFrame, shards: int = 16, seed: int = 17, cells: int = 4096) -> DataFrame:
    """Put every row of ``docs(doc_id, text, source)`` into one of ``shards`` so that each shard has the mixture.

    Rows are put in a seeded order (MD5 of seed and doc_id) within their source; the row of rank r among n has
    the fractional rank (2r + 1) / 2n; all rows sorted by fractional rank, then source and rank, are cut into
    ``shards`` runs whose sizes differ by one at most (the law ``rows``). Each source is spread evenly over
    that order, so each run holds its share of each source to within a row or so a source.

    Both rankings are made in two levels: ``row_number`` inside small cells (4096 hash cells a source; 4096
    cells of fractional rank) plus running totals of cell counts, so neither a source with a third of all rows
    nor the whole table is ever sorted by one task. Text never leaves the scan: only its size and CRC do.

    Defined results: a null text has size 1 and CRC 0; a null source is a stratum of its own, apart from the
    empty string; rows without a doc_id are ordered by their size and CRC, so that many of them spread over the cells;
    ties of the order are in that of doc_id, CRC and size; rows that are equal in every column get different slots in
    an arbitrary, stored order; a text of any length is one row whose size and CRC are those of all its bytes; an empty
    table gives no rows; extra columns of ``docs`` are ignored. Equal texts are not kept together: the law is one of
    counts, and a group of copies with a third of all rows would break it.
    """
    base = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n")).alias("stratum"),
    ).withColumn("h", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.concat_ws(":", F.lit("none"), "size", "text_crc32"))))).withColumn("cell", F.expr(f"cast(conv(substring(h, 1, 8), 16, 10) as bigint) * {cells} div 4294967296"))
    in_cell = W.partitionBy("stratum", "cell").orderBy("h", "doc_id", "text_crc32", "size")
    by_stratum = W.partitionBy("stratum")
    counts = (
        base.groupBy("stratum", "cell")
        .agg(F.count("*").alias("n"))
        .select(
            "stratum",
            "cell",
            (F.sum("n").over(by_stratum.orderBy("cell")) - F.col("n")).alias("before"),
            F.sum("n").over(by_stratum).alias("total"),
        )
    )
    ranked = (
        base.withColumn("rn", F.row_number().over(in_cell))
        .join(counts, ["stratum", "cell"])
        .select("doc_id", "size", "text_crc32", "stratum", (F.col("before") + F.col("rn") - 1).alias("rank"), "total")
        .withColumn("frac", (2 * F.col("rank") + 1) / (2 * F.col("total")))
        .withColumn("part", F.least(F.floor(F.col("frac") * cells), F.lit(cells - 1)))
    )
    ranked = stored(ranked, "shard-ranks")
    # At most ``cells`` rows: a fixed bound, so the running total may sit in one task and be broadcast.
    parts = ranked.groupBy("part").agg(F.count("*").alias("n"))
    starts = parts.select(
        "part",
        (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("start"),
        F.sum("n").over(W.partitionBy()).alias("rows"),
    )
    in_part = W.partitionBy("part").orderBy("frac", "stratum", "rank")
    return (
        ranked.withColumn("rn", F.row_number().over(in_part))
        .join(F.broadcast(starts), "part")
        .withColumn("at", F.col("start") + F.col("rn") - 1)
        .withColumn("shard", F.expr(f"cast((at * {shards}) div rows as int)"))
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit(LAW).alias("law"),
            "shard",
            F.expr(f"at - ((shard * rows + {shards - 1}) div {shards})").cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )
