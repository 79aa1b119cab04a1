"""Transitive callers: bounded breadth-first search over reversed edges, level by level."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.text import is_test_path, looks_like_test
from ..scratch import stored

ROWS = "root_id node_key symbol_id qualified path call_line depth uncertain is_test chain".split()


def _by_caller(calls: DataFrame) -> DataFrame:
    """Linked ``calls`` that reach something, those of one caller side by side and numbered in the order of their ids (``n``).

    Code outside definitions is a caller for each path (``mod``); of its calls the first of each name is enough, since all
    reach the same symbols.
    """
    calls = calls.where("candidates > 0").withColumn("local", F.coalesce("local", F.lit(False)))
    names = ["caller_id", "mod", "callee", "path", "local", "call_id", "line", "candidates"]
    inside = calls.where("caller_id >= 0").withColumn("mod", F.lit(None).cast("string")).select(names)
    outside = calls.where("not (caller_id >= 0) or caller_id is null").groupBy(F.lit(-1).cast("long").alias("caller_id"), F.col("path").alias("mod"), "callee", "path", "local")
    outside = outside.agg(F.min("call_id").alias("call_id"), F.min_by("line", "call_id").alias("line"), F.min("candidates").alias("candidates")).select(names)
    order = W.partitionBy("caller_id", "mod").orderBy("call_id", "line", "callee")
    return inside.unionByName(outside).withColumn("n", F.row_number().over(order).cast("long"))


def impact(roots: DataFrame, symbols: DataFrame, calls: DataFrame, max_depth: int = 3, chains: bool = True) -> DataFrame:
    """Who reaches ``roots(id)``: one row per root and node, at its least depth.

    Columns: root_id, node_key ("sym:<id>", or "mod:<path>" for code outside definitions), symbol_id, qualified,
    path, call_line, depth, uncertain, is_test, chain (names from the node down to the root), truncated.

    A level goes from the frontier to its names, and from the names to the ``linked`` calls of them: the pairs of
    calls and candidates are never written out. Of several ways to a node the one of the least ordinal
    path (edges in the order of call_id and target) wins, which is the one a queue would find first; it fixes
    depth, parent and chain. All ways of a level are equally long, so the least way to a target is kept for each name
    before calls meet it, and told by its place among those of the root. A call carries that place and its own in one number, of which
    the least of a node is kept: calls of one caller lie side by side, so they are one row for each root before any
    shuffle, and the ways are joined to the nodes that are new. A node is uncertain if its call has several candidates or its parent is uncertain.
    The root itself is never reported and module nodes lead nowhere. truncated tells whether the search stopped
    at max_depth with nodes there. Levels are stored tables, so a level is
    computed once; the driver only loops over depths and never sees nodes. A hub's calls are joined by key,
    which adaptive execution may split. Without ``chains`` the levels do not carry them, and chain is null.
    """
    calls = stored(_by_caller(calls), "impact-calls")
    ids = roots.select("id").distinct()
    names = symbols.select(F.col("id").alias("root_id"), F.col("qualified").alias("_root"), "name", "path")
    start = ids.select(
        F.col("id").alias("root_id"),
        F.concat(F.lit("sym:"), F.col("id").cast("string")).alias("node_key"),
        F.col("id").alias("symbol_id"),
        F.lit(False).alias("uncertain"),
        F.array().cast("array<struct<c:bigint,t:bigint>>").alias("way"),
    ).join(names.hint("merge"), "root_id").withColumn("chain", F.array("_root") if chains else F.lit(None).cast("array<string>")).drop("_root")
    frontier = stored(start, "impact-0")
    seen = frontier.select("root_id", F.col("symbol_id").alias("caller_id"), F.lit(None).cast("string").alias("mod"))
    caller = symbols.select(F.col("id").alias("caller_id"), F.col("qualified").alias("_q"), F.col("path").alias("_p"), "name").hint("merge")
    levels: list[DataFrame] = []
    for depth in range(1, max_depth + 1):
        up = frontier.where("symbol_id >= 0").select("root_id", "symbol_id", "name", "path", "uncertain", "way", "chain")
        target = F.struct("way", "symbol_id", "uncertain", "chain")
        near = up.groupBy("root_id", F.col("name").alias("callee"), "path").agg(F.min(target).alias("best"))
        far = near.groupBy("root_id", "callee").agg(F.min("best").alias("best")).withColumn("path", F.lit(None).cast("string"))
        named = near.withColumn("local", F.lit(True)).unionByName(far.withColumn("local", F.lit(False)))
        named = stored(named.withColumn("o", F.dense_rank().over(W.partitionBy("root_id").orderBy("best")).cast("long")), f"impact-names-{depth}")
        reach = named.select("root_id", "callee", "path", "local", "o")
        met = calls.where("local").join(reach.where("local").drop("local"), ["callee", "path"]).unionByName(calls.where("not local").join(reach.where("not local").drop("local", "path"), "callee"))
        place = F.shiftleft("o", 32).bitwiseOR(F.col("n"))
        first = met.groupBy("root_id", "caller_id", "mod").agg(
            F.min(place).alias("place"), *[F.min_by(c, place).alias(c) for c in ("call_id", "line", "candidates")]
        )
        # An anti-join would be pushed beneath the aggregate, and every call of every root shuffled for it.
        known = seen.select(F.col("root_id").alias("_r"), F.col("caller_id").alias("_c"), F.col("mod").alias("_m"), F.lit(True).alias("_seen")).hint("merge")
        fresh = first.join(known, (F.col("root_id") == F.col("_r")) & (F.col("caller_id") == F.col("_c")) & F.col("mod").eqNullSafe(F.col("_m")), "left").where("_seen is null")
        ways = named.groupBy("root_id", "o").agg(F.first("best").alias("best"))
        fresh = fresh.withColumn("o", F.shiftright("place", 32)).join(ways, ["root_id", "o"]).join(caller, "caller_id", "left")
        step = F.struct(F.col("call_id").cast("long").alias("c"), F.col("best.symbol_id").cast("long").alias("t"))
        node_key = F.when(F.col("caller_id") >= 0, F.concat(F.lit("sym:"), F.col("caller_id").cast("string"))).otherwise(F.concat(F.lit("mod:"), "mod"))
        qualified = F.when(F.col("caller_id") >= 0, F.col("_q")).otherwise(F.concat(F.lit("<module "), "mod", F.lit(">")))
        path = F.when(F.col("caller_id") >= 0, F.col("_p")).otherwise(F.col("mod"))
        level = fresh.select(
            "root_id",
            node_key.alias("node_key"),
            "name",
            F.when(F.col("caller_id") >= 0, F.col("caller_id")).otherwise(-1).cast("long").alias("symbol_id"),
            qualified.alias("qualified"),
            path.alias("path"),
            F.col("line").alias("call_line"),
            F.lit(depth).alias("depth"),
            ((F.col("candidates") > 1) | F.col("best.uncertain")).alias("uncertain"),
            (is_test_path(path) | looks_like_test(qualified)).alias("is_test"),
            F.concat(F.array(qualified), "best.chain").alias("chain"),
            F.concat("best.way", F.array(step)).alias("way"),
        )
        frontier = stored(level, f"impact-{depth}")
        levels.append(frontier)
        inner = F.col("symbol_id") >= 0
        seen = seen.unionByName(frontier.select("root_id", F.col("symbol_id").alias("caller_id"), F.when(~inner, F.col("path")).alias("mod")))
    out = None
    for level in levels:
        out = level.select(*ROWS) if out is None else out.unionByName(level.select(*ROWS))
    if out is None:
        return start.select("root_id", "node_key", "symbol_id", F.lit(None).cast("string").alias("qualified")).limit(0)
    cut = levels[-1].groupBy("root_id").agg(F.lit(True).alias("truncated"))
    return out.join(cut, "root_id", "left").withColumn("truncated", F.coalesce("truncated", F.lit(False)))


def tests_for(roots: DataFrame, symbols: DataFrame, calls: DataFrame, max_depth: int = 4) -> DataFrame:
    """The tests among the nodes of ``impact``; their chains keep the nodes between."""
    return impact(roots, symbols, calls, max_depth).where("is_test")
