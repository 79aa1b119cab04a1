"""The call graph: name resolution, callers, callees, degrees, lookups.

Callees are met by merge joins by hint: a table of symbols takes many times the bytes of its files when it is broadcast.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..scratch import stored


def resolve_calls(calls: DataFrame, symbols: DataFrame, same_language: bool = False, told: Callable[[Column], Column] = lambda ids: ids) -> DataFrame:
    """``calls`` with ``resolved``: ids of the symbols of the callee's name; those of the call's path alone, if any.

    The candidates stay an array, for those who want them listed; the graph is walked over ``linked`` calls, without
    them. Names are aggregated once, per name and per name and path, and joined to calls, so a name with many symbols
    makes one row a call. ``same_language`` asks for a lang column on both sides and keeps candidates to it. ``told`` is what
    is asked of the array (its size, a digest), instead of the array itself: it is worked out once a name and once a name and path,
    before calls meet it, so that no call carries its candidates.
    """
    scope = ["lang"] if same_language else []
    names = symbols.select(F.col("name").alias("callee"), "path", "id", *scope)
    ids = F.array_sort(F.collect_list("id"))
    everywhere = names.groupBy("callee", *scope).agg(ids.alias("_all")).withColumn("_all", told(F.col("_all")))
    here = names.groupBy("callee", "path", *scope).agg(ids.alias("_here")).withColumn("_here", told(F.col("_here")))
    return (
        calls.join(here, ["callee", "path", *scope], "left")
        .join(everywhere, ["callee", *scope], "left")
        .withColumn("resolved", F.coalesce("_here", "_all", told(F.array().cast("array<long>"))))
        .drop("_here", "_all")
        .select(*calls.columns, "resolved")
    )


def linked(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """The call graph in factors: ``(call_id, caller_id, callee, path, line, local, candidates)``, a row a call.

    A call reaches all symbols of its callee's name, or those of its own path alone where there are any (local). Both
    sets are told by (callee) or (callee, path), so calls and symbols meet by way of the name and no row is made for each
    pair of them: a name with m calls and n symbols is m + n rows, not m * n. candidates: how many symbols there are.
    """
    here = symbols.groupBy(F.col("name").alias("callee"), "path").agg(F.count("*").alias("_here"))
    # Of names few rows are left by then; the second sum is over those.
    everywhere = here.groupBy("callee").agg(F.sum("_here").alias("_all"))
    return (
        calls.select("call_id", "caller_id", "callee", "path", "line")
        .join(here, ["callee", "path"], "left")
        .join(everywhere, "callee", "left")
        .select(
            "call_id", "caller_id", "callee", "path", "line",
            F.col("_here").isNotNull().alias("local"), F.coalesce("_here", "_all", F.lit(0)).cast("long").alias("candidates"),
        )
    )


def edges(resolved: DataFrame) -> DataFrame:
    """One row per call and candidate: ``(call_id, caller_id, path, line, target, ambiguous)``: the pairs written out."""
    return resolved.select(
        "call_id", "caller_id", "path", "line", F.explode("resolved").alias("target"), (F.size("resolved") > 1).alias("ambiguous")
    )


def reaching(calls: DataFrame, targets: DataFrame, keys: list[str], best: Column) -> DataFrame:
    """Linked ``calls`` that reach ``targets(*keys, name, path, …)``, with the ``best`` of the targets that each reaches.

    Targets of a name, and of a name and path, are brought down to their best before calls meet them, so a call is one row
    for each of ``keys`` however many of its candidates are targets.
    """
    local = targets.groupBy(*keys, F.col("name").alias("callee"), "path").agg(F.min(best).alias("best"))
    wide = local.groupBy(*keys, "callee").agg(F.min("best").alias("best"))
    return calls.where("local").join(local, ["callee", "path"]).unionByName(calls.where("not local").join(wide, "callee"))


def find(symbols: DataFrame, query: str) -> DataFrame:
    """Symbols whose qualified name is the query; only if there are none, those of that name or ending in it."""
    exact = F.col("qualified") == query
    loose = (F.col("name") == query) | F.col("qualified").endswith("." + query)
    some = symbols.agg(F.coalesce(F.bool_or(exact), F.lit(False)).alias("_some"))
    return symbols.crossJoin(F.broadcast(some)).where(exact | (~F.col("_some") & loose)).drop("_some")


def callers(calls: DataFrame, symbols: DataFrame, targets: DataFrame) -> DataFrame:
    """Call sites of ``targets(id)`` among linked ``calls``: ``(caller_id, path, line, target)``, each site once, with its
    first target."""
    wanted = symbols.join(targets.select("id").distinct(), "id", "left_semi")
    # Of all calls, those of the wanted names are linked.
    calls = calls.join(wanted.select(F.col("name").alias("callee")).distinct(), "callee", "left_semi")
    met = reaching(calls, wanted, [], F.col("id"))
    return met.groupBy("caller_id", "path", "line").agg(F.min("best").alias("target"))


def out_of(calls: DataFrame, symbols: DataFrame, sources: DataFrame) -> DataFrame:
    """``(call_id, caller_id, target)`` of the linked ``calls`` out of ``sources(id)``: pairs, for the sources alone."""
    mine = calls.join(sources.select(F.col("id").alias("caller_id")).distinct(), "caller_id", "left_semi").select("call_id", "caller_id", "callee", "path", "local")
    named = symbols.select(F.col("name").alias("callee"), F.col("path").alias("_at"), F.col("id").alias("target"))
    near = mine.where("local").join(named.withColumnRenamed("_at", "path"), ["callee", "path"])
    far = mine.where("not local").join(named.drop("_at"), "callee")
    columns = ["call_id", "caller_id", "target"]
    return near.select(columns).unionByName(far.select(columns))


def callees(calls: DataFrame, symbols: DataFrame, sources: DataFrame) -> DataFrame:
    """What ``sources(id)`` call: distinct ``(caller_id, target)``.

    A caller meets each of a name's symbols once where it calls the name from anywhere, and those of each path once where all
    its calls of the name are local: as symbols have one name and path each, no pair comes twice, and pairs, of which there may be
    as many as callers times symbols, are never shuffled. Only ids that several names or paths share are told apart by pairs.
    """
    mine = calls.where("candidates > 0").join(sources.select(F.col("id").alias("caller_id")).distinct(), "caller_id", "left_semi")
    called = mine.groupBy("caller_id", "callee").agg(F.bool_or(~F.col("local")).alias("wide"), F.collect_set(F.when(F.col("local"), F.col("path"))).alias("paths"))
    near = called.where("not wide").select("caller_id", "callee", F.explode("paths").alias("path"))
    far = called.where("wide").select("caller_id", "callee")
    homes = symbols.select(F.col("id").alias("target"), F.col("name").alias("callee"), "path").distinct()
    shared = homes.groupBy("target").agg((F.count("*") > 1).alias("shared"))
    homes = stored(homes.join(shared.hint("merge"), "target"), "homes")

    def met(named: DataFrame) -> DataFrame:
        named = named.drop("shared").hint("merge")
        pairs = near.join(named, ["callee", "path"]).select("caller_id", "target")
        return pairs.unionByName(far.join(named.drop("path"), "callee").select("caller_id", "target"))

    once = met(homes.where("not shared"))
    return once if homes.where("shared").isEmpty() else once.unionByName(met(homes.where("shared")).distinct())


def external_callees(calls: DataFrame, sources: DataFrame) -> DataFrame:
    """Distinct names that ``sources(id)`` call and no symbol bears."""
    mine = calls.join(sources.select(F.col("id").alias("caller_id")).distinct(), "caller_id", "left_semi")
    return mine.where("candidates = 0").select("callee").distinct()


def degrees(symbols: DataFrame, calls: DataFrame) -> DataFrame:
    """``(id, fan_in, call_sites, fan_out)``: calling symbols, call sites, and called symbols of each symbol.

    Counted by name and path: the local calls of a symbol are those of its name in its path, the others those of its name
    in paths without the name, so a caller is among one of both only, but for code outside definitions, which counts once.
    """
    counts = [
        F.count_distinct(F.when(F.col("caller_id") >= 0, F.col("caller_id"))).alias("callers"),
        F.coalesce(F.bool_or(F.col("caller_id") < 0), F.lit(False)).alias("loose"),
        F.count("*").alias("sites"),
    ]
    near = calls.where("local").groupBy(F.col("callee").alias("name"), "path").agg(*counts)
    far = calls.where("not local").groupBy(F.col("callee").alias("name")).agg(*counts)
    far = far.withColumnsRenamed({c: f"far_{c}" for c in ("callers", "loose", "sites")})
    out = calls.where("caller_id >= 0").select("caller_id", "callee", "candidates").distinct()
    out = out.groupBy(F.col("caller_id").alias("id")).agg(F.sum("candidates").alias("fan_out"))
    rows = symbols.select("id", "name", "path").join(near, ["name", "path"], "left").join(far, "name", "left").join(out, "id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    loose = (F.coalesce("loose", F.lit(False)) | F.coalesce("far_loose", F.lit(False))).cast("long")
    return rows.select(
        "id", (zero("callers") + zero("far_callers") + loose).alias("fan_in"), (zero("sites") + zero("far_sites")).alias("call_sites"), zero("fan_out").alias("fan_out")
    )


def expand_hits(hits: DataFrame, symbols: DataFrame, calls: DataFrame, chunks: DataFrame, k_expand: int = 3, per_callee: int = 2, most: int = 6) -> DataFrame:
    """Chunks of what the best hits call: ``(place, path, start_line, end_line, symbol, text)``.

    ``hits(rank, path, start_line, end_line)``: the first ``k_expand`` are mapped to their innermost symbol; its
    callees, itself excepted, yield up to ``per_callee`` chunks each; chunks already hit are left out; the first
    ``most`` stay, in the order of hit, call and chunk, each once, marked with who calls it.
    """
    from .spans import chunks_in_span, innermost

    top = hits.where(F.col("rank") <= k_expand).select("rank", "path", F.col("start_line").alias("start"), F.col("end_line").alias("end"))
    at = innermost(top, symbols, ["rank"]).select("rank", F.col("symbol_id").alias("caller_id"))
    pairs = out_of(calls, symbols, at.select(F.col("caller_id").alias("id"))).where("caller_id <> target")
    called = at.join(pairs, "caller_id").groupBy("rank", "caller_id", "target").agg(F.min("call_id").alias("call_id"))
    named = symbols.select(F.col("id").alias("caller_id"), F.col("qualified").alias("by"))
    spans = (
        called.join(symbols.select(F.col("id").alias("target"), "path", F.col("start_line").alias("start"), F.col("end_line").alias("end")), "target")
        .join(named, "caller_id")
        .withColumn("site", F.struct("rank", "call_id", "target"))
    )
    found = chunks_in_span(spans.select("site", "by", "path", "start", "end"), chunks, "site", per_callee)
    known = hits.select("path", F.col("start_line").alias("c_start"), F.col("end_line").alias("c_end"))
    fresh = found.join(known, ["path", "c_start", "c_end"], "left_anti")
    once = W.partitionBy("path", "c_start", "c_end").orderBy("site", "rank")
    fresh = fresh.withColumn("_n", F.row_number().over(once)).where("_n = 1").orderBy("site", "rank").limit(most)
    place = F.row_number().over(W.orderBy("site", "rank"))
    mark: Column = F.concat("symbol", F.lit("  ← called by "), "by")
    return fresh.select(
        place.alias("place"), "path", F.col("c_start").alias("start_line"), F.col("c_end").alias("end_line"), mark.alias("symbol"), "text"
    )
