"""An index as immutable segments of Parquet tables, published by numbered pointer files.

A refresh adds one segment: the rows of the files it read, and tombstones for the files whose earlier rows no longer hold.
Nothing written before is touched, so what a refresh writes is in proportion to what has changed. Readers see the union
of all segments less what a later segment has tombstoned. Segments of one size are merged into one of the next, so a row
is rewritten once a tier, and a read unites as many segments as there are tiers, times the fan-out.
"""

from __future__ import annotations

import json
import math
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import lexical
from .files import read_text

TABLES = ("manifest", "chunks", "extracted", "symbols", "calls")
#: Which tombstones speak of a table's rows, and by what key; those of the others are paths.
TOMBS = {"blocks": ("chunk_id", "gone_chunks"), "manifest": ("path", "gone_stats")}
KEYS = {"gone_paths": "path", "gone_chunks": "chunk_id", "gone_stats": "path"}
#: How the rows of a table are ordered in a segment, where not by path.
ORDER = {"blocks": ["slot", "term", "cell"], "terms": ["slot", "term"]}
#: Large segments lay a table out in folders of this column.
FOLDERS = {"blocks": "slot", "terms": "slot"}
#: Postings from which on a segment has folders.
FOLDER_ROWS = 200_000
#: So many segments of a tier, or smaller, are merged; a tier is this many times the one before.
FAN_OUT = 8
#: Bytes of the smallest tier.
LEAST_TIER = 1 << 20
#: Pointer files are numbered; the highest number is what is published.
POINTER = "CURRENT-"
#: Of what is written; an index of another layout is built anew.
LAYOUT = 5


class NotIndexed(RuntimeError):
    """There is no index to read."""


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _write_new(spark: SparkSession, path: str, text: str) -> None:
    """Write aside, then rename to a name that is not taken: a reader sees the whole file or none."""
    fs, p = _fs(spark, path)
    aside = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    stream = fs.create(aside, True)
    stream.write(bytearray(text.encode()))
    stream.close()
    if not fs.rename(aside, p):
        fs.delete(aside, False)
        raise RuntimeError(f"{path} was published by someone else meanwhile")


def tier(size: int) -> int:
    return 0 if size <= LEAST_TIER else 1 + int(math.log(size / LEAST_TIER, FAN_OUT))


def to_merge(sizes: list[int]) -> int:
    """How many of the newest segments to merge: as soon as FAN_OUT of one tier follow the last larger one, these and the
    smaller ones after them."""
    for t in sorted({tier(s) for s in sizes}):
        run = equal = 0
        for s in reversed(sizes):
            if tier(s) > t:
                break
            run, equal = run + 1, equal + (tier(s) == t)
        if equal >= FAN_OUT:
            return run
    return 0


class Store:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    # Pointers ------------------------------------------------------------------

    def _pointers(self) -> list[tuple[int, str]]:
        """Numbered pointer files, the newest first."""
        fs, p = _fs(self.spark, self.root)
        names = [str(x.getPath().getName()) for x in fs.listStatus(p)] if fs.exists(p) else []
        return sorted(((int(n[len(POINTER) :]), n) for n in names if n.startswith(POINTER) and n[len(POINTER) :].isdigit()), reverse=True)

    def pointer(self) -> dict:
        """What is published: the newest pointer that can be read, else nothing."""
        for _, name in self._pointers():
            text = read_text(self.spark, f"{self.root}/{name}")
            try:
                return json.loads(text) if text else {}
            except ValueError:
                continue
        return {}

    def segments(self) -> list[dict]:
        """Published segments, the oldest first: folder, bytes, tables with their rows, tombstones."""
        now = self.pointer()
        return now.get("segments", []) if now.get("layout") == LAYOUT else []

    # Reading -------------------------------------------------------------------

    def _table(self, segment: dict, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{segment['folder']}/{table}")

    def _all(self, segments: list[dict], table: str) -> DataFrame | None:
        """Rows of a table in all of ``segments``, with the place of their segment."""
        parts = [self._table(s, table).withColumn("_segment", F.lit(i)) for i, s in enumerate(segments) if table in s["tables"]]
        return reduce(lambda a, b: a.unionByName(b), parts) if parts else None

    def _alive(self, segments: list[dict], table: str, rows: DataFrame) -> DataFrame:
        """Of ``rows`` of a table, those that no later segment has tombstoned."""
        key, tombs = TOMBS.get(table, ("path", "gone_paths"))
        first = next(i for i, s in enumerate(segments) if table in s["tables"])
        dead = self._all([s if i > first and s["tables"].get(tombs) else s | {"tables": {}} for i, s in enumerate(segments)], tombs)
        if dead is None:
            return rows.drop("_segment")
        until = dead.groupBy(key).agg(F.max("_segment").alias("_until"))
        kept = rows.join(until, key, "left").where(F.col("_until").isNull() | (F.col("_segment") >= F.col("_until")))
        return kept.select([c for c in rows.columns if c != "_segment"])

    def _live(self, segments: list[dict], table: str) -> DataFrame | None:
        """Rows of a table in ``segments`` that no later one of them has tombstoned."""
        if table == "postings":
            blocks = self._all(segments, "blocks")
            return None if blocks is None else self._alive(segments, "blocks", lexical.opened(blocks.drop("cell"), "chunk_id"))
        rows = self._all(segments, table)
        return None if rows is None else self._alive(segments, table, rows)

    def read(self, table: str) -> DataFrame | None:
        """A published table; ``postings`` are those of the stored blocks."""
        return self._live(self.segments(), table)

    def bm25(self, query: str, k: int) -> tuple[DataFrame, DataFrame]:
        """``(chunk_id, score)`` of the k best chunks, and the posting blocks that were opened for it.

        Statistics are sums over the segments of what each has added and taken away, so they are exact without a look at
        a posting."""
        segments = self.segments()
        blocks, terms = self._all(segments, "blocks"), self._all(segments, "terms")
        if blocks is None:
            raise NotIndexed(f"no postings in {self.root}: build the index first")
        kinds = list(dict.fromkeys(lexical.query_terms(query)))
        dfs = {r["term"]: r["df"] for r in lexical.of_terms(terms, kinds).groupBy("term").agg(F.sum("df").alias("df")).collect()}
        n, length = (sum(s.get("corpus", (0, 0))[i] for s in segments) for i in (0, 1))
        return lexical.blocks_topk(blocks, dfs, n, length / max(n, 1), "chunk_id", query, k, ["_segment", "cell"], lambda d: self._alive(segments, "blocks", d))

    def require(self, table: str) -> DataFrame:
        found = self.read(table)
        if found is None:
            raise NotIndexed(f"no {table} in {self.root}: build the index first")
        return found

    # Writing -------------------------------------------------------------------

    def _write(self, tables: dict[str, DataFrame], rows: int, corpus: tuple[int, int]) -> dict:
        """A segment of ``tables``, which is nothing until a pointer names it. ``corpus``: chunks and tokens it adds, less
        those it takes away."""
        folder, counts = f"segment-{uuid.uuid4().hex}", None
        for name, df in tables.items():
            by = ORDER.get(name, [c for c in ("path", "chunk_id") if c in df.columns][:1])
            path = f"{self.root}/{folder}/{name}"
            if rows < FOLDER_ROWS:
                # A small segment: a file a table, sorted, so that row groups tell what they hold.
                df.coalesce(1).sortWithinPartitions(*by).write.parquet(path)
            elif name in FOLDERS:
                # Ranges of the whole order, so that neither a folder nor a frequent key is one task's.
                df.repartitionByRange(*by).sortWithinPartitions(*by).write.partitionBy(FOLDERS[name]).parquet(path)
            else:
                df.sortWithinPartitions(*by).write.parquet(path)
            counted = self.spark.read.parquet(path).agg(F.lit(name).alias("t"), F.count("*").alias("n"))
            counts = counted if counts is None else counts.unionByName(counted)
        fs, p = _fs(self.spark, f"{self.root}/{folder}")
        return {"folder": folder, "corpus": corpus, "bytes": int(fs.getContentSummary(p).getLength()), "tables": {r["t"]: r["n"] for r in counts.collect()}}

    def _publish(self, segments: list[dict], facts: dict) -> None:
        """Write a pointer of the next number. It is never overwritten, so a reader finds the old state or the new one. The
        state before stays for those who read it still; folders that only older ones name are deleted."""
        numbered, now = self._pointers(), self.pointer()
        folders = lambda p: {s["folder"] for s in p.get("segments", [])} | {*p.get("tables", {}).values()}
        was = folders(now)
        number = numbered[0][0] + 1 if numbered else 1
        told = facts | {"layout": LAYOUT, "segments": segments, "before": sorted(was)}
        _write_new(self.spark, f"{self.root}/{POINTER}{number:08d}", json.dumps(told))
        before = now.get("before", [])
        for name in {*(before.values() if isinstance(before, dict) else before)} - folders(told) - was:
            fs, p = _fs(self.spark, f"{self.root}/{name}")
            fs.delete(p, True)
        for _, name in numbered[1:]:
            fs, p = _fs(self.spark, f"{self.root}/{name}")
            fs.delete(p, False)

    def publish(self, tables: dict[str, DataFrame], fingerprint: str, gone: dict[str, DataFrame] | None = None, anew: tuple[str, ...] = (), corpus: tuple[int, int] = (0, 0), **facts) -> dict:
        """Add a segment of ``tables``, with the tombstones ``gone(paths, chunks, stats)`` for what earlier segments hold of
        files, their chunks and their manifest rows; without ``gone`` it is all there is. Tables of ``anew`` are dropped from
        the earlier segments. Returns the segment."""
        segments = [] if gone is None else [s | {"tables": {t: n for t, n in s["tables"].items() if t not in anew}} for s in self.segments()]
        if gone is not None:
            tables = tables | {name: gone[name[5:]].select(key).distinct() for name, key in KEYS.items() if name[5:] in gone}
        # Without postings, the rows of the largest table tell whether one task may write one.
        rows = tables["blocks"].agg(F.sum("n")).first()[0] or 0 if "blocks" in tables else max((df.count() for df in tables.values()), default=0)
        added = self._write(tables, rows, corpus)
        self._publish([*segments, added], facts | {"fingerprint": fingerprint})
        return added

    def compact(self, everything: bool = False) -> int:
        """Merge the newest segments while a tier is full, or all of them if more than half of the chunks are tombstoned;
        returns how many segments were merged. Tombstones stay as long as there are older segments they speak of."""
        merged = 0
        while True:
            segments, now = self.segments(), self.pointer()
            dead = sum(s["tables"].get("gone_chunks", 0) for s in segments)
            chunks = sum(s["tables"].get("chunks", 0) for s in segments)
            n = len(segments) if (everything or 2 * dead > chunks) and len(segments) > 1 else to_merge([s["bytes"] for s in segments])
            if not n:
                return merged
            older, newest = segments[:-n], segments[-n:]
            tables = {t: rows for t in TABLES if (rows := self._live(newest, t)) is not None}
            corpus = tuple(sum(s["corpus"][i] for s in newest) for i in (0, 1))
            if (postings := self._live(newest, "postings")) is not None:
                tables["blocks"] = lexical.blocked(postings, "chunk_id", lexical.cell_bits(sum(s["tables"].get("chunks", 0) for s in newest)))
                sums = self._all(newest, "terms").groupBy("slot", "term").agg(F.sum("df").alias("df"))
                tables["terms"] = sums.where("df <> 0")
            if older:
                for name, key in KEYS.items():
                    if parts := [self._table(s, name) for s in newest if name in s["tables"]]:
                        tables[name] = reduce(lambda a, b: a.unionByName(b), parts).select(key).distinct()
            rows = sum(s["corpus"][1] for s in newest)
            one = self._write(tables, rows, corpus)
            facts = {k: v for k, v in now.items() if k not in ("layout", "segments", "before", "tables")}
            self._publish([*older, one], facts)
            merged += n
            everything = False
