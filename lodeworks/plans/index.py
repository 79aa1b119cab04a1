"""Building and refreshing an index of a source tree."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.models import Embedder, HashEmbedder
from ..functions.text import embedding_text, lexical_text
from ..operators import lexical
from ..operators.snapshot import replace_paths, snapshot_diff
from ..scratch import stored
from ..sources import syntax
from ..sources.files import INDEX_DIR, listed_files, named_files, source_files
from ..sources.store import Store


#: Files named one by one, at most, when they are read again.
NAMED = 10_000
#: Microseconds that a file's last change must lie before it was read, for its length and time to vouch for it.
SETTLED = 1_500_000


class NoSources(RuntimeError):
    """The tree has nothing to index."""


def index_dir(repo: str) -> str:
    return f"{repo.rstrip('/')}/{INDEX_DIR}"


def with_ids(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("chunk_id", F.xxhash64("path", "start_line", "end_line", "symbol"))


def _suspects(listed: DataFrame, old: DataFrame) -> DataFrame:
    """The listed files that their length and time of change do not vouch for."""
    was = old.select("path", F.col("size").alias("_size"), F.col("modified").alias("_modified"), F.col("seen").alias("_seen"))
    same = F.col("size").eqNullSafe(F.col("_size")) & F.col("modified").eqNullSafe(F.col("_modified")) & (F.col("modified") < F.col("_seen") - SETTLED)
    return stored(listed.join(was, "path", "left").where(~F.coalesce(same, F.lit(False))).select(listed.columns), "index-suspects")


def _read(spark: SparkSession, repo: str, suspects: DataFrame, names: list[str] | None, seen: int) -> tuple[DataFrame, DataFrame]:
    """``(path, hash, size, modified, seen)`` of ``suspects``, and their rows with content: read by ``names``, or, where there
    are none or so many that they are cheaper to pick from it, from the whole tree."""
    if names is not None and len(names) <= NAMED:
        files = named_files(spark, repo, names)
    else:
        files = source_files(spark, repo)
        files = files if names is None else files.join(suspects, "path", "left_semi")
    read = stored(files.select("path", "hash"), "index-hashes")
    return stored(read.join(suspects, "path").select("path", "hash", "size", "modified", F.lit(seen).alias("seen")), "index-manifest"), files


def _status(old: DataFrame, listed: DataFrame, manifest: DataFrame) -> DataFrame:
    """``(path, status)`` of files that were read, and of those that are gone."""
    gone = old.join(listed, "path", "left_anti")
    known = old.join(manifest, "path", "left_semi").unionByName(gone)
    return snapshot_diff(known, manifest)


def embedded(chunks: DataFrame, before: DataFrame | None, embedder: Embedder) -> tuple[DataFrame, int]:
    """``chunks`` with their vectors, and how many were embedded: those whose embedding text is that of a chunk of
    ``before`` have its vector, since equal texts have equal vectors in one vector space."""
    text = embedding_text(F.col("path"), F.col("start_line"), F.col("end_line"), F.col("symbol"), F.col("text"))
    rows = chunks.withColumn("_embed", text)
    if before is None:
        fresh = stored(embedder.add(rows, "_embed", "embedding").drop("_embed"), "index-fresh")
        return fresh, fresh.count()
    known = before.groupBy(F.sha2(text, 256).alias("_of")).agg(F.first("embedding").alias("embedding"))
    rows = stored(rows.withColumn("_of", F.sha2("_embed", 256)), "index-rows")
    kept = rows.join(known, "_of").drop("_embed", "_of")
    new = stored(embedder.add(rows.join(known.select("_of"), "_of", "left_anti"), "_embed", "embedding").drop("_embed", "_of"), "index-embedded")
    return stored(kept.select(new.columns).unionByName(new), "index-fresh"), new.count()


def build_index(
    spark: SparkSession, repo: str, embedder: Embedder | None = None, full: bool = False, graph: bool = True, progress: Callable[[str], None] = lambda m: None
) -> dict[str, int]:
    """Bring the index of ``repo`` up to date; returns counts of files added, changed and deleted, and chunks embedded.

    The listing is compared to the manifest first: a file whose length and time of change are those of when it was read,
    and whose time lay safely before that, is not opened again. Only files whose hash differs are parsed, once each, chunked, embedded where a text is new, and put
    into the inverted index. They make a segment of their own, with tombstones for the earlier rows of changed and
    deleted files, so what is written follows what has changed and not the size of the index. Ids of symbols and calls
    depend on their own file alone, and names are resolved when they are asked for, so the graph of other files stays. A
    new embedder, another layout, or ``full``, starts over. All tables become visible together.
    """
    embedder = embedder or HashEmbedder()
    store, seen = Store(spark, index_dir(repo)), time.time_ns() // 1000
    listed = stored(listed_files(spark, repo), "index-listed")
    if listed.isEmpty():
        raise NoSources(f"no source files in {repo}")
    now = store.pointer()
    old = None if full or now.get("fingerprint") != embedder.fingerprint() else store.read("manifest")
    lacking = graph and old is not None and not now.get("graph")
    suspects, names = listed, None
    if old is not None:
        suspects = _suspects(listed, old)
        names = [r["path"] for r in suspects.select("path").limit(NAMED + 1).collect()]
        if not names and not lacking and old.join(listed, "path", "left_anti").isEmpty():
            progress("nothing changed")
            return {"added": 0, "changed": 0, "deleted": 0, "embedded": 0}
    manifest, files = _read(spark, repo, suspects, names, seen)
    base = old if old is not None else manifest.limit(0)
    status = stored(_status(base, listed, manifest), "index-status")
    counts = {r["status"]: r["count"] for r in status.groupBy("status").count().collect()}
    report = {k: counts.get(k, 0) for k in ("added", "changed", "deleted")} | {"embedded": 0}
    if old is not None and not any(report.values()) and not lacking:
        if counts.get("unchanged"):
            # Read, and found as it was: from now on its new length and time tell that.
            store.publish({"manifest": manifest}, embedder.fingerprint(), {"stats": manifest}, graph=now.get("graph"))
            store.compact()
        progress("nothing changed")
        return report
    changed = files.join(status.where("status in ('added', 'changed')").select("path"), "path", "left_semi")
    rows = stored(syntax.extracted(changed), "index-extracted")
    chunks = with_ids(syntax.chunks_of(rows, changed))
    gone, stale = None, None
    if old is not None:
        paths = status.where("status in ('changed', 'deleted')").select("path")
        stale = stored(store.require("chunks").join(paths, "path", "left_semi"), "index-stale")
        gone = {"paths": paths, "chunks": stale, "stats": status.select("path")}
    fresh, report["embedded"] = embedded(chunks, stale, embedder)
    progress(f"{report['embedded']} chunks embedded")
    body = lexical_text(F.col("path"), F.col("symbol"), F.col("text"))
    postings = stored(lexical.inverted(fresh.withColumn("_body", body), "chunk_id", F.col("_body")), "index-postings")
    fresh = stored(fresh.join(lexical.lengths_of(postings, fresh, "chunk_id"), "chunk_id"), "index-chunks")
    lengths, bits = fresh.select("chunk_id", "dl"), lexical.cell_bits(fresh.count())
    blocks = lexical.blocked(postings.join(lengths, "chunk_id"), "chunk_id", bits)
    # Statistics are kept as what a segment adds, less what it takes away.
    counts, total = postings.select("slot", "term", F.lit(1).alias("df")), lengths
    sign = F.lit(1)
    if stale is not None:
        lost = lexical.inverted(stale.withColumn("_body", body), "chunk_id", F.col("_body"))
        counts = counts.unionByName(lost.select("slot", "term", F.lit(-1).alias("df")))
        total, sign = lengths.withColumn("_sign", sign).unionByName(stale.select("chunk_id", "dl", F.lit(-1).alias("_sign"))), F.col("_sign")
    terms = counts.groupBy("slot", "term").agg(F.sum("df").alias("df")).where("df <> 0")
    corpus = tuple(int(v or 0) for v in total.agg(F.sum(sign), F.sum(sign * F.col("dl"))).first())
    tables = {"manifest": manifest, "chunks": fresh, "extracted": rows, "blocks": blocks, "terms": terms}
    anew: tuple[str, ...] = ()
    if graph:
        if lacking:
            anew, rows = ("symbols", "calls"), replace_paths(store.require("extracted"), gone["paths"], rows)
        tables["symbols"], tables["calls"] = syntax.graph_of(rows)
    store.publish(tables, embedder.fingerprint(), gone, anew, corpus, graph=graph)
    store.compact()
    return report
