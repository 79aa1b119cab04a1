"""Line deduplication over levelled sorted runs of line hashes."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import SPACE, discard, drop_run, fresh, ordered_buckets, sorted_run, stored

_STRIP = SPACE.encode()
#: Keys that every document must be held against are broadcast up to this many (16 bytes each), else joined.
BROADCAST_KEYS = 200_000
#: Hashes that a bucket of a run holds at most, in the mean; a merge join of buckets is never split, so their number
#: follows the input.
BUCKET_ROWS = 2_000_000


def line_keys(text: bytes | None) -> list[bytes]:
    """The key of each line: white space stripped at both ends, A-Z lower-cased."""
    return [line.strip(_STRIP) for line in (text or b"").lower().split(b"\n")]


def digests(text: bytes | None, least: int = 1) -> list[bytes | None]:
    """The 128-bit hash of each line's key; None for a key of fewer than ``least`` code points."""
    import xxhash

    digest = xxhash.xxh3_128_digest
    short = lambda k: len(k) < least or least > 1 and len(k.decode("utf-8", "replace")) < least
    return [None if short(k) else digest(k) for k in line_keys(text)]


class LineRuns:
    """Runs of ``(h, n)``: line hash and the number of documents that had it, each sorted by h, in levels.

    A run is a table bucketed and sorted by h, with as many buckets in all runs, so bucket meets bucket: a batch
    is dealt out and sorted once, and merge-anti-joined with every run as it lies. A batch's new counts become a
    run of level 0. When a level holds ``fanout`` runs they are merged bucket by bucket, counts added, into one run of the
    next level, so a hash is rewritten once a level: a logarithm of the batches. A hash that some run already
    shows in ``threshold`` documents is settled: the anti-join leaves it out of later batches, so the most
    frequent lines cost nothing more.
    """

    def __init__(self, spark: SparkSession, threshold: int, fanout: int = 2, rows: int = 0, bucket_rows: int = BUCKET_ROWS) -> None:
        """``rows``: how many hashes all batches have together, by which the number of buckets is chosen."""
        self.spark, self.threshold, self.fanout, self.levels = spark, threshold, fanout, [[]]
        self.buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // bucket_rows))
        self.compactions = 0

    def _run(self, counts: DataFrame, level: int) -> DataFrame:
        return sorted_run(counts, "h", self.buckets, f"line_run_{level}")

    @staticmethod
    def _merge(runs: list[DataFrame]) -> DataFrame:
        """Counts of sorted runs added up by merge joins: two runs meet as they lie. (A union of bucketed scans would
        do, but Spark 4.1 plans the sum without an exchange and then sets the scans side by side.)"""
        out = runs[0].select("h", "n")
        for r in runs[1:]:
            other = r.select("h", F.col("n").alias("more")).hint("merge")
            n = F.coalesce("n", F.lit(0)) + F.coalesce("more", F.lit(0))
            out = out.join(other, "h", "full_outer").select("h", n.alias("n"))
        return out

    def runs(self) -> list[DataFrame]:
        return [r for level in self.levels for r in level]

    def unsettled(self, counts: DataFrame) -> DataFrame:
        """The batch's ``(h, n)`` without the hashes that some run has settled."""
        counts = counts.select("h", "n").repartition(self.buckets, "h")
        for r in self.runs():
            counts = counts.join(r.where(F.col("n") >= self.threshold).select("h").hint("merge"), "h", "left_anti")
        return counts

    def add(self, counts: DataFrame) -> None:
        """Merge-anti-join the batch's ``(h, n)`` with the runs' settled hashes, then add it as a run of its own."""
        self.levels[0].append(self._run(self.unsettled(counts), 0))
        level = 0
        while len(self.levels[level]) >= self.fanout:
            old, self.levels[level] = self.levels[level], []
            if level + 1 == len(self.levels):
                self.levels.append([])
            self.levels[level + 1].append(self._run(self._merge(old), level + 1))
            self.compactions += 1
            for r in old:
                drop_run(r)
            level += 1

    def frequent(self) -> DataFrame:
        """Hashes found in ``threshold`` documents or more, over all runs."""
        return self._merge(self.runs()).where(F.col("n") >= self.threshold).select("h")

    def drop(self) -> None:
        for r in self.runs():
            drop_run(r)
        self.levels = [[]]


def line_counts(docs: DataFrame, batches: int, least: int = 1) -> DataFrame:
    """``(batch, h, n)``: in how many documents of each batch of ``docs(doc_id, text)`` each line key occurs.

    All rows of a doc_id are one document and go to one batch; a row without a doc_id is a document of its own.
    Only the lines of doc_ids that occur more than once are made distinct by a shuffle.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            row, hashes = [], []
            for i, t in enumerate(b.column(1)):
                found = set(digests(t.as_py(), least)) - {None}
                hashes.extend(found)
                row.extend([i] * len(found))
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(at), b.column(2).take(at), pa.array(hashes, pa.binary())], names=["doc_id", "batch", "h"]
            )

    binary = F.col("text").cast("binary")
    batch = F.pmod(F.when(F.col("doc_id").isNull(), F.xxhash64(binary)).otherwise(F.xxhash64("doc_id")), F.lit(batches))
    docs = docs.select("doc_id", binary.alias("text"), batch.cast("int").alias("batch"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    keys = lambda rows: rows.mapInArrow(run, f"doc_id {kind}, batch int, h binary")
    again = docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    again = stored(again, "line-again")
    if again.isEmpty():
        rows = keys(docs)
    else:
        once = keys(docs.join(again, "doc_id", "left_anti").select("doc_id", "text", "batch"))
        rows = once.unionByName(keys(docs.join(again, "doc_id", "left_semi").select("doc_id", "text", "batch")).distinct())
    return rows.groupBy("batch", "h").agg(F.count("*").alias("n"))


def frequent_lines(docs: DataFrame, threshold: int = 10, batches: int = 8, fanout: int = 2, least: int = 1, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``(h)`` of the line keys found in ``threshold`` documents of ``docs`` or more, through ``LineRuns``."""
    staged = stored(line_counts(docs, batches, least), "line-batches", ["batch"])
    runs = LineRuns(docs.sparkSession, threshold, fanout, staged.count(), bucket_rows)
    try:
        for k in range(batches):
            runs.add(staged.where(F.col("batch") == k).select("h", "n"))
        with ordered_buckets(docs.sparkSession):
            return stored(runs.frequent(), "line-frequent")
    finally:
        # Runs are tables of the catalog: none stays, whatever happened.
        discard(staged)
        runs.drop()


def drop_frequent_lines(
    docs: DataFrame, threshold: int = 10, batches: int = 8, fanout: int = 2, least: int = 1, broadcast_keys: int = BROADCAST_KEYS
) -> DataFrame:
    """``docs`` with frequent lines taken out of ``text``, plus ``_n_lines`` and ``_n_dropped`` (with more
    underscores if ``docs`` has such columns).

    A line's key is the line with white space stripped at both ends and A-Z lower-cased. Keys of at least
    ``least`` code points found in ``threshold`` documents or more lose all their lines everywhere; the other lines
    stay as they were, joined by newlines. Keys are compared by 128-bit hashes.

    While the frequent keys are few they go to every task; beyond ``broadcast_keys`` each text's own frequent keys are
    found by a join and travel to it as an array, no longer than its lines. A text is known there by its MD5, so rows
    without a doc_id, or of one doc_id, are as many keys as they have texts.

    Defined results: a null or empty text is one empty line, which is never dropped, and comes out empty; a
    document whose lines all go comes out with an empty text; rows with the same doc_id, repeated rows among them,
    count as one document and come out once each; a row without a doc_id counts as a document of its own; a text of any
    length is taken whole, line by line; an empty table gives no rows; other columns pass unchanged.
    """
    spark, columns = docs.sparkSession, docs.columns
    total, lost = fresh("_n_lines", columns), fresh("_n_dropped", columns)
    owner, gone_name = fresh("_id", columns), fresh("_gone", columns)
    frequent = frequent_lines(docs, threshold, batches, fanout, least)
    at = {c: i for i, c in enumerate(columns)}["text"]

    def rewritten(text: bytes | None, gone) -> tuple[bytes, int, int]:
        text = text or b""
        if not gone:
            return text, text.count(b"\n") + 1, 0
        lines = text.split(b"\n")
        kept = [line for line, h in zip(lines, digests(text, least)) if h is None or h not in gone]
        return b"\n".join(kept), len(lines), len(lines) - len(kept)

    def output(b: pa.RecordBatch, gone_of) -> pa.RecordBatch:
        made = [rewritten(t.as_py(), gone_of(i)) for i, t in enumerate(b.column(at))]
        texts, n_lines, n_dropped = zip(*made) if made else ((), (), ())
        cols = [b.column(i) for i in range(len(columns))]
        cols[at] = pa.array(texts, pa.binary())
        return pa.RecordBatch.from_arrays(
            [*cols, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], names=[*columns, total, lost]
        )

    binary = docs.withColumn("text", F.col("text").cast("binary"))
    schema = ", ".join(f"`{c}` {t}" for c, t in binary.dtypes) + f", {total} long, {lost} long"
    if frequent.count() <= broadcast_keys:
        held = spark.sparkContext.broadcast(frozenset(bytes(r["h"]) for r in frequent.collect()))
        discard(frequent)

        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in it:
                yield output(b, lambda i: held.value)

        out = binary.mapInArrow(run, schema)
    else:

        def hashed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in it:
                ids, hashes = [], []
                for i, t in enumerate(b.column(1)):
                    found = set(digests(t.as_py(), least)) - {None}
                    hashes.extend(found)
                    ids.extend([i] * len(found))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(ids, pa.int64())), pa.array(hashes, pa.binary())], names=[owner, "h"]
                )

        name = F.md5(F.coalesce("text", F.lit(b"")))
        own = binary.select(name.alias(owner), "text").mapInArrow(hashed, f"{owner} string, h binary").join(frequent, "h", "left_semi")
        own = own.groupBy(owner).agg(F.collect_set("h").alias(gone_name))

        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in it:
                gone = b.column(len(columns))
                yield output(b, lambda i: frozenset(gone[i].as_py() or ()))

        joined = binary.withColumn(owner, name).join(own, owner, "left").select(*columns, gone_name)
        out = joined.mapInArrow(run, schema)
    return out.withColumn("text", F.col("text").cast("string"))
