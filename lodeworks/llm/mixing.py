"""Mixing sources to target weights by Efraimidis-Spirakis sampling, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import stored

#: Weights of the sources in their order, repeating.
WEIGHTS = (5, 2, 1)
#: No source is taken more often than this.
MOST = 3
#: Weights of documents are held between these, so that keys spread over the cells.
LEAST_QUALITY, MOST_QUALITY = 1 / 16, 16.0
#: Parts of the order of keys within a source.
CELLS = 4096


def label_weights(labels: DataFrame) -> DataFrame:
    """``(doc_id, weight)``: 2 for a document of quality 1 that is not toxic, 0.5 for one of quality 0 or a toxic one; the
    mean where several labels share a doc_id."""
    good = F.when((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) != 1), 2.0).otherwise(0.5)
    return labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.avg(good).alias("weight"))


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``sources(source, source_size)`` with weight and target.

    Sources in the order of code points, null last, weigh ``weights`` in turn and share the sum of all sizes; a target
    stops at ``most`` times its source's size and the excess is shared again by weight until none is above. That ends
    where target = min(most * size, weight * level) for one level: the sources that stop are those of the least
    most * size / weight, so running sums in that order give the level. One row a source: the table's size is the number
    of sources, whatever the documents.
    """
    turn = (F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn + 1)
    cap = (F.col("source_size") * most).cast("double")
    order = W.orderBy(F.col("_cap") / F.col("weight"), F.col("source").asc_nulls_last())
    upto = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    after = order.rowsBetween(W.currentRow, W.unboundedFollowing)
    total = F.sum("source_size").over(W.partitionBy())
    # The level if all sources before this one stop and this one does not.
    level = (total - (F.sum("_cap").over(upto) - F.col("_cap"))) / F.sum("weight").over(after)
    rows = sources.withColumn("weight", weight).withColumn("_cap", cap).withColumn("_level", level)
    open_level = F.when(F.col("_level") * F.col("weight") < F.col("_cap"), F.col("_level"))
    rows = rows.withColumn("_level", F.first(open_level, ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    target = F.when(F.col("_level") * F.col("weight") < F.col("_cap"), F.col("_level") * F.col("weight")).otherwise(F.col("_cap"))
    return rows.select("source", "source_size", "weight", target.alias("target"))


def mix(
    docs: DataFrame, quality: DataFrame | None = None, weights: tuple[float, ...] = WEIGHTS, most: int = MOST, seed: int = 23, cells: int = CELLS
) -> DataFrame:
    """How many words of each row of ``docs(doc_id, text, source)`` a mixture of the sources takes.

    Rows: ``(doc_id, size, source_size, target, taken, source, epochs, key)``. size is the number of words
    ``[^\\x20\\x09-\\x0D]+``; ``targets`` gives each source its target. A source is taken whole as often as its target
    holds its size (epochs); for the rest, its documents stand in the order of exponential keys -ln(u) / quality, u from
    the MD5 of seed and doc_id, and are taken once more as long as the sum of sizes before them, and half their own, is
    within what remains. So a source is missed by half a document's size at most, a document of a higher weight in
    ``quality(doc_id, weight)``, one row a doc_id, stands earlier the more often (1 where there is none), and the same rows
    are chosen in every run.

    Every text is read once, where it lies; what is shuffled is a row of numbers a document. Rows are summed by source
    and cell (``cells`` ranges of k / (1 + k) of the key k), sorted within their cell only, and placed by running totals
    of the cells: a source with a third of all rows is ``cells`` small sorts.

    Defined results: a null or empty text has size 0 and takes nothing; a null source is a source of its own, the last;
    rows without a doc_id are ordered by the MD5 of their text; rows of one doc_id are ordered by size and count each;
    rows alike in id, size and key are summed before they are shuffled and the first of them taken; a weight that is
    null, not a number or not above 0 counts as 1 and others are held within 1/16 and 16; an empty table gives no rows;
    a text of any length is counted whole; extra columns are ignored.
    """
    text = F.coalesce("text", F.lit(""))
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("none:"), F.md5(text)))
    # 52 bits, and a half, so that u is neither 0 nor 1.
    u = (F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), name)), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    words = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    base = docs.select("doc_id", F.col("source").cast("string").alias("source"), words.alias("size"), (-F.log(u)).alias("key"))
    if quality is not None:
        # Met by rows of numbers, not by texts.
        given = quality.select(F.col("doc_id").alias("_of"), F.col("weight").cast("double").alias("_w"))
        odd = F.col("_w").isNull() | F.isnan("_w") | (F.col("_w") <= 0)
        w: Column = F.when(odd, 1.0).otherwise(F.greatest(F.lit(LEAST_QUALITY), F.least("_w", F.lit(MOST_QUALITY))))
        base = base.join(given, F.col("doc_id") == F.col("_of"), "left").withColumn("key", F.col("key") / w).drop("_of", "_w")
    base = base.withColumn("cell", F.floor(F.col("key") / (1 + F.col("key")) * cells).cast("int"))
    # A null source joins like any other under a name of its own.
    base = stored(base.withColumn("stratum", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))), "mix-sizes")
    summed = base.groupBy("stratum", "source", "cell").agg(F.sum("size").alias("words"))
    summed = stored(summed, "mix-cells")
    shares = targets(summed.groupBy("source").agg(F.sum("words").alias("source_size")), weights, most)
    shares = shares.select(F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")).alias("stratum"), "source_size", "target")
    shares = shares.withColumn("epochs", F.coalesce(F.floor(F.try_divide("target", "source_size")), F.lit(0)).cast("int"))
    # Exact where a source stops at its most; else what a fraction of an epoch is to bring.
    shares = shares.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    by = W.partitionBy("stratum").orderBy("cell")
    starts = summed.select("stratum", "cell", (F.sum("words").over(by) - F.col("words")).alias("start")).join(shares, "stratum")
    groups = base.groupBy("stratum", "source", "cell", "key", "doc_id", "size").agg(F.count("*").alias("n"))
    inside = W.partitionBy("stratum", "cell").orderBy("key", "doc_id", "size")
    words = F.col("n") * F.col("size")
    placed = groups.withColumn("before", F.sum(words).over(inside.rowsBetween(W.unboundedPreceding, W.currentRow)) - words)
    rows = placed.join(starts, ["stratum", "cell"]).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    before = F.col("start") + F.col("before") + F.col("copy") * F.col("size")
    once_more = F.when(2 * before + F.col("size") <= 2 * F.col("rest"), 1).otherwise(0)
    return rows.select(
        "doc_id", "size", F.col("source_size").cast("long").alias("source_size"), "target",
        (F.col("size") * (F.col("epochs") + once_more)).cast("long").alias("taken"), "source", "epochs", "key",
    )
