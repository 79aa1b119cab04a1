"""Diffs: hunks of a unified diff, changed symbols, what no symbol covers, stale files."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .spans import innermost

# Fixed value: a hunk header; its new side is start[,count].
HUNK = r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@"
NEW_FILE = r"^\+\+\+ (?:b/)?(.*?)\t?$"


def hunks(diffs: DataFrame) -> DataFrame:
    """``diffs(diff_id, text)`` exploded to ``(diff_id, hunk, path, start, end, deletion_only)`` of the new side.

    A hunk that only deletes has no range (null start and end) and counts as 1 in deletion_only. The file of a
    hunk is the last "+++" line before it, found inside the row; nothing is shuffled.
    """
    rows = diffs.select("diff_id", F.split("text", "\n").alias("l"))
    rows = rows.withColumn(
        "f",
        F.filter(
            F.transform("l", lambda x, i: F.when(x.startswith("+++ "), F.struct(i.alias("i"), F.regexp_extract(x, NEW_FILE, 1).alias("p")))),
            lambda x: x.isNotNull(),
        ),
    ).select("diff_id", "f", F.posexplode("l").alias("pos", "x"))
    head = rows.where(F.col("x").rlike(HUNK))
    count = F.regexp_extract("x", HUNK, 2)
    n = F.when(count == "", 1).otherwise(count.cast("int"))
    first = F.regexp_extract("x", HUNK, 1).cast("int")
    file = F.try_element_at(F.filter("f", lambda f: f["i"] < F.col("pos")), F.lit(-1))
    return head.select(
        "diff_id",
        F.col("pos").alias("hunk"),
        file["p"].alias("path"),
        F.when(n > 0, first).alias("start"),
        F.when(n > 0, first + n - 1).alias("end"),
        (n == 0).cast("int").alias("deletion_only"),
    ).where(F.col("path").isNotNull() & (F.col("path") != "/dev/null"))


def changed_symbols(changes: DataFrame, symbols: DataFrame) -> DataFrame:
    """Distinct symbols of ``changes(path, start, end)``: of each range, the smallest one it overlaps."""
    ranges = changes.where("start is not null").select("path", "start", "end").distinct()
    hit = innermost(ranges, symbols, [])
    return symbols.join(hit.select(F.col("symbol_id").alias("id")).distinct(), "id", "left_semi")


def unmapped_changes(changes: DataFrame, symbols: DataFrame) -> DataFrame:
    """Paths that changed where no symbol is: paths without symbols, and paths none of whose ranges overlaps one.

    A path with symbols whose hunks only delete is mapped.
    """
    per_path = changes.groupBy("path").agg(F.count("start").alias("ranges"))
    ranges = changes.where("start is not null").select("path", "start", "end").distinct()
    hit = innermost(ranges, symbols, []).groupBy("path").agg(F.count("*").alias("hits"))
    known = symbols.select("path").distinct().withColumn("has", F.lit(True))
    out = per_path.join(known, "path", "left").join(hit, "path", "left")
    none = F.coalesce("hits", F.lit(0)) == 0
    return out.where(F.col("has").isNull() | (none & (F.col("ranges") > 0))).select("path")


def stale_files(changed: DataFrame, on_disk: DataFrame, manifest: DataFrame) -> DataFrame:
    """Of ``changed(path)``, the indexable files on disk whose hash is not the manifest's, or that were never indexed."""
    now = changed.select("path").distinct().join(on_disk.select("path", "hash"), "path")
    known = manifest.select("path", F.col("hash").alias("known"))
    return now.join(known, "path", "left").where(~F.col("hash").eqNullSafe(F.col("known"))).select("path")


def tests_to_run(nodes: DataFrame) -> DataFrame:
    """Distinct ``path::qualified`` of the tests among impact rows, sorted."""
    return nodes.where("is_test").select(F.concat("path", F.lit("::"), "qualified").alias("test")).distinct().orderBy("test")
