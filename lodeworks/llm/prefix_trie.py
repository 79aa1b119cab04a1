"""The prefix trie of conversations: a Cartesian tree over the LCP array of the sorted conversations."""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F

from .common import stored

#: Turns, or names of runs of turns, in one key that is sorted.
RUN = 256
#: Characters of a turn's digest and of a name in a key.
DIGEST, NAME = 24, 16
#: Entries of the LCP array that one group holds.
BLOCK = 1024
#: Conversations of five share up to this many first turns, less one.
KINDS = 9
#: Above all ids: the entry after the last conversation.
LAST_ID = (1 << 63) - 1
EMPTY_SHA = hashlib.sha256(b"").hexdigest()
SIDES = ("left", "right")
NEXT = ["at", "lcp", "same", "a", "b"]


# Rows in a global order -----------------------------------------------------


def in_order(df: DataFrame, by: list, name: str, sums: list[str] = ()) -> DataFrame:
    """``df`` stored in the order ``by``, with its place in it (``at``, from 0) and, for each of ``sums``, the sum of the
    rows before (``before_<column>``).

    Ranges of the order are sorted by a task each; places and sums inside a range come as its rows pass, and those of the
    ranges before it, a row a range, are added afterwards. ``by`` should tell rows apart, so that no key is one task's.
    """
    kinds = dict(df.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in df.columns) + ", part int, inside long" + "".join(f", `in_{c}` long" for c in sums)

    def number(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, total = TaskContext.get().partitionId(), 0, dict.fromkeys(sums, 0)
        for batch in it:
            extra = [pa.array(np.full(batch.num_rows, part, np.int32)), pa.array(np.arange(n, n + batch.num_rows))]
            for c in sums:
                v = batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64)
                upto = np.cumsum(v)
                extra.append(pa.array(upto - v + total[c]))
                total[c] += int(upto[-1]) if len(v) else 0
            n += batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[*batch.schema.names, "part", "inside", *[f"in_{c}" for c in sums]])

    rows = stored(df.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(number, schema), name)
    ends = rows.groupBy("part").agg((F.max("inside") + 1).alias("n"), *[F.max(F.col(f"in_{c}") + F.col(c)).alias(f"s_{c}") for c in sums])
    earlier = W.orderBy("part")
    starts = ends.select("part", (F.sum("n").over(earlier) - F.col("n")).alias("_n"), *[(F.sum(f"s_{c}").over(earlier) - F.col(f"s_{c}")).alias(f"_s_{c}") for c in sums])
    placed = rows.join(F.broadcast(starts), "part").select(
        *df.columns, (F.col("_n") + F.col("inside")).alias("at"), *[(F.col(f"_s_{c}") + F.col(f"in_{c}")).alias(f"before_{c}") for c in sums]
    )
    return placed


# Conversations to keys ---------------------------------------------------------


def turns_of(conversations: DataFrame) -> DataFrame:
    """``(conv_id, pos, digest, bytes)``: turns numbered from 1 in the order of turn (null first), role and text's digest.

    Numbers come from one order of all turns, so the turns of a long conversation are many tasks'.
    """
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        F.base64(F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))).alias("digest"),
        F.octet_length(text).cast("long").alias("bytes"),
        # Rows alike in all else are spread by it; which comes first shows nowhere.
        F.monotonically_increasing_id().alias("row"),
    )
    placed = in_order(rows, [F.col("conv_id"), F.asc_nulls_first("turn"), F.col("digest"), F.col("row")], "trie-turns")
    first = placed.groupBy("conv_id").agg(F.min("at").alias("first"), F.count("*").alias("turns"))
    return placed.join(first, "conv_id").select("conv_id", (F.col("at") - F.col("first") + 1).alias("pos"), "digest", "bytes", "turns")


def rebuilt(turns: DataFrame) -> DataFrame:
    """``(conv_id, pos, digest, bytes)`` of the rebuilt conversations: the first h original turns of conversation
    conv_id - conv_id % 5, then its own after its first h; h = crc32(conv_id) % 9."""
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(KINDS))
    ids = turns.select("conv_id").distinct().withColumn("h", h).withColumn("of", F.col("conv_id") - F.col("conv_id") % 5)
    heads = turns.where(F.col("pos") < KINDS).select(F.col("conv_id").alias("of"), "pos", "digest", "bytes", "turns")
    lent = ids.join(heads, "of").where("pos <= h")
    first = lent.select("conv_id", "pos", "digest", "bytes")
    # As many turns come first as there are, h at most.
    base = heads.where("pos = 1").select("of", F.col("turns").alias("there"))
    own = turns.withColumn("h", h).where("pos > h").withColumn("of", F.col("conv_id") - F.col("conv_id") % 5).join(base, "of", "left")
    place = F.col("pos") - F.col("h") + F.least("h", F.coalesce("there", F.lit(0)))
    return first.unionByName(own.select("conv_id", place.alias("pos"), "digest", "bytes"))


def _keys(rows: DataFrame) -> DataFrame:
    """``(conv_id, run, symbol)`` to ``(conv_id, run, key)``: RUN symbols a key, in order."""
    cell = F.struct("run", "symbol")
    held = rows.groupBy("conv_id", F.expr(f"run div {RUN}").alias("_run")).agg(F.array_sort(F.collect_list(cell)).alias("_s"))
    return held.select("conv_id", F.col("_run").alias("run"), F.array_join(F.transform("_s", lambda s: s["symbol"]), "").alias("key"))


def _mismatch(a: str, b: str, width: int) -> int:
    """How many symbols two keys have in common at their start."""
    low, high = 0, min(len(a), len(b)) // width
    while low < high:
        mid = (low + high + 1) // 2
        if a[: mid * width] == b[: mid * width]:
            low = mid
        else:
            high = mid - 1
    return low


def _symbol(key: str, i: int, width: int) -> str | None:
    return key[i * width : (i + 1) * width] or None


def sorted_conversations(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """``(at, conv_id, turns, bytes, digest, lcp, same)`` of all ``ids`` in the order of their turns' digests; lcp: turns in
    common with the one before, -1 for the first; same: whether all are; digest: of all.

    A key holds RUN turns, so a conversation of up to RUN turns is one key. Longer ones: the keys of their runs are
    sorted and named by their ranks, which keep the order, and the names are the symbols of the next level. Keys stay as
    short as they are at any length of a conversation. Neighbours then differ in one name first; the runs it stands for
    are looked up and compared, level by level, down to a turn.
    """
    whole = turns.groupBy("conv_id").agg(F.max("pos").alias("turns"), F.sum("bytes").alias("bytes"))
    level, width, names = turns.select("conv_id", (F.col("pos") - 1).alias("run"), F.col("digest").alias("symbol")), DIGEST, []
    while True:
        keys = stored(_keys(level), "trie-keys")
        if keys.where("run > 0").isEmpty():
            break
        named = in_order(keys.select("key").distinct(), ["key"], "trie-names").select("key", F.lpad(F.hex("at"), NAME, "0").alias("symbol"))
        names.append((named, width))
        level, width = keys.join(named, "key").select("conv_id", "run", "symbol"), NAME
    top = width
    rows = ids.join(keys.drop("run"), "conv_id", "left").join(whole, "conv_id", "left")
    rows = rows.select("conv_id", F.coalesce("key", F.lit("")).alias("key"), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("turns", "bytes")])
    ordered = stored(in_order(rows, ["key", "conv_id"], "trie-sorted"), "trie-order")
    # Each row beside the one before: of a block of places, the first has the last of the block before it.
    kinds = "at long, lcp long, same boolean, a string, b string"
    peers = ordered.select("at", "key").withColumn("block", F.explode(F.array_distinct(F.array(F.expr(f"at div {BLOCK}"), F.expr(f"(at + 1) div {BLOCK}")))))

    def neighbours(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, at, key = None, None, None
        for part in it:
            out = []
            for b, i, k in zip(part["block"], part["at"], part["key"], strict=True):
                if b == block and i == at + 1:
                    n = _mismatch(key, k, top)
                    out.append((i, n, key == k, _symbol(key, n, top), _symbol(k, n, top)))
                block, at, key = b, i, k
            yield pd.DataFrame(out, columns=NEXT)

    pairs = peers.repartition("block").sortWithinPartitions("block", "at").mapInPandas(neighbours, kinds)
    for named, width in reversed(names):
        look = named.select("key", "symbol")
        both = pairs.join(look.select(F.col("symbol").alias("a"), F.col("key").alias("ka")), "a", "left").join(
            look.select(F.col("symbol").alias("b"), F.col("key").alias("kb")), "b", "left"
        )

        def descend(it: Iterator[pd.DataFrame], width=width) -> Iterator[pd.DataFrame]:
            for part in it:
                out = []
                for i, n, same, a, b in zip(part["at"], part["lcp"], part["same"], part["ka"], part["kb"], strict=True):
                    a, b = a or "", b or ""
                    m = _mismatch(a, b, width)
                    out.append((i, n * RUN + m, same, _symbol(a, m, width), _symbol(b, m, width)))
                yield pd.DataFrame(out, columns=NEXT)

        pairs = both.select("at", "lcp", "same", "ka", "kb").mapInPandas(descend, kinds)
    out = ordered.withColumn("digest", F.md5("key")).drop("key").join(pairs.select("at", "lcp", "same"), "at", "left")
    # Names count as whole runs; the last run of equal conversations may be a shorter one.
    lcp = F.when(F.col("same"), F.col("turns")).otherwise(F.coalesce("lcp", F.lit(-1)))
    return out.withColumn("lcp", lcp.cast("long")).withColumn("same", F.coalesce("same", F.lit(False)))


# All nearest smaller values --------------------------------------------------------


def _stack(values: np.ndarray) -> np.ndarray:
    """For each entry, the last earlier one that is smaller; -1 if there is none."""
    out, stack = np.full(len(values), -1), []
    v = values.tolist()
    for i, x in enumerate(v):
        while stack and v[stack[-1]] >= x:
            stack.pop()
        if stack:
            out[i] = stack[-1]
        stack.append(i)
    return out


def _minima(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Least of values[low..high] for pairs of ends, by a table of runs of powers of two."""
    table, w = [values], 1
    while 2 * w <= len(values):
        table.append(np.minimum(table[-1][:-w], table[-1][w:]))
        w *= 2
    level = np.frexp(high - low + 1)[1] - 1
    out = np.empty(len(low), values.dtype)
    for j in np.unique(level):
        m = level == j
        out[m] = np.minimum(table[j][low[m]], table[j][high[m] + 1 - (1 << j)])
    return out


def _before(keys: np.ndarray, values: np.ndarray, at: np.ndarray, v: np.ndarray) -> np.ndarray:
    """For each query, the index of the last of the sorted ``keys`` below ``at`` whose value is below ``v``; -1 for none."""
    out, ks, vs = np.full(len(at), -1), keys.tolist(), values.tolist()
    low: list[int] = []
    held: list[int] = []
    i = 0
    for q in np.argsort(at, kind="stable").tolist():
        while i < len(ks) and ks[i] < at[q]:
            while low and low[-1] >= vs[i]:
                low.pop()
                held.pop()
            low.append(vs[i])
            held.append(i)
            i += 1
        j = bisect_left(low, v[q]) - 1
        if j >= 0:
            out[q] = held[j]
    return out


def _with_cells(array: DataFrame, queries: DataFrame, names: list[str], answer, kinds: str) -> DataFrame:
    """Lay ``array(cell, at, v)`` and ``queries(cell, *names)`` of a cell side by side: ``answer(at, v, queries)`` adds a
    column ``hit`` to the queries. A cell has BLOCK entries at most."""
    blank = [F.lit(None).cast(t).alias(c) for c, t in queries.select(*names).dtypes]
    entries = array.select("cell", F.col("at").alias("_at"), F.col("v").alias("_v"), *blank)
    asked = queries.select("cell", F.lit(None).cast("long").alias("_at"), F.lit(None).cast("long").alias("_v"), *names)

    def work(part: pa.Table) -> pa.Table:
        here = part["_at"].is_valid()
        mine, found = part.filter(here).sort_by("_at"), part.filter(pc.invert(here)).select(names)
        hit = answer(mine["_at"].to_numpy(), mine["_v"].to_numpy(), {c: np.array(found[c].to_pylist(), object if c == "side" else np.int64) for c in names})
        return found.append_column("hit", pa.array(hit, pa.int64()))

    wanted = queries.select("cell").distinct()
    return entries.join(wanted, "cell", "left_semi").unionByName(asked).groupBy("cell").applyInArrow(work, kinds + ", hit long")


def levels_of(array: DataFrame, n: int) -> list[DataFrame]:
    """``array(at, v)`` of ``n`` entries and its block minima, block minima of those, and so on until one block is left."""
    out = [array.select("at", "v", F.expr(f"at div {BLOCK}").alias("cell"))]
    while n > BLOCK:
        up = out[-1].groupBy("cell").agg(F.min("v").alias("v")).select(F.col("cell").alias("at"), "v", F.expr(f"cell div {BLOCK}").alias("cell"))
        out.append(stored(up, "trie-minima"))
        n = -(-n // BLOCK)
    return out


def nearest_smaller(levels: list[DataFrame], queries: DataFrame, k: int = 1) -> DataFrame:
    """``queries(at, v, side)`` about cells of level ``k``, with ``hit``: the place in the array of the nearest entry beyond
    the cell on that side that is below v.

    The nearest such cell of the same cell of level k + 1 is found by the stack of its minima; where there is none, the
    question is that cell's. A cell that was found is opened level by level. Equal questions are asked once.
    """

    def beyond(at: np.ndarray, v: np.ndarray, q: dict[str, np.ndarray]) -> list[int | None]:
        return _sided(at, v, q["at"], q["v"], q["side"])

    def opened(at: np.ndarray, v: np.ndarray, q: dict[str, np.ndarray]) -> list[int | None]:
        return _sided(at, v, np.where(q["side"] == "left", at[-1] + 1, at[0] - 1), q["v"], q["side"])

    asked = queries.select(F.expr(f"at div {BLOCK}").alias("cell"), "at", "v", "side").distinct()
    found = stored(_with_cells(levels[k], asked, ["at", "v", "side"], beyond, "at long, v long, side string"), "trie-found")
    inside, outside = found.where("hit is not null"), found.where("hit is null")
    cells = inside.select(F.col("hit").alias("cell"), "v", "side").distinct().withColumn("start", F.col("cell"))
    for j in range(k - 1, -1, -1):
        cells = _with_cells(levels[j], cells, ["start", "v", "side"], opened, "start long, v long, side string")
        cells = cells.withColumnRenamed("hit", "cell")
    cells = stored(cells, "trie-opened").select(F.col("start").alias("hit"), "v", "side", F.col("cell").alias("place"))
    out = inside.join(cells, ["hit", "v", "side"]).select("at", "v", "side", F.col("place").alias("hit"))
    if k + 1 < len(levels):
        up = nearest_smaller(levels, outside.select(F.expr(f"at div {BLOCK}").alias("at"), "v", "side"), k + 1)
        out = out.unionByName(outside.drop("hit").withColumn("up", F.expr(f"at div {BLOCK}")).join(up.withColumnRenamed("at", "up"), ["up", "v", "side"]).select(*out.columns))
    return out


def _sided(keys: np.ndarray, values: np.ndarray, at: np.ndarray, v: np.ndarray, side: np.ndarray) -> list[int | None]:
    out = np.full(len(v), -1)
    left = side == "left"
    out[left] = _before(keys, values, at[left], v[left])
    back = _before(-keys[::-1], values[::-1], -at[~left], v[~left])
    out[~left] = np.where(back < 0, -1, len(keys) - 1 - back)
    return [int(keys[i]) if i >= 0 else None for i in out]


def range_minima(levels: list[DataFrame], queries: DataFrame, k: int = 0) -> DataFrame:
    """``queries(low, high)`` with ``hit``: the least of the entries low..high of level ``k``. A range within one cell is
    looked up there; others are the end of one cell, the start of another, and a range of whole cells between."""

    def least(at: np.ndarray, v: np.ndarray, q: dict[str, np.ndarray]) -> np.ndarray:
        return _minima(v, q["a"] - at[0], q["b"] - at[0])

    first, last = F.expr(f"low div {BLOCK}"), F.expr(f"high div {BLOCK}")
    asked = queries.select("low", "high", first.alias("f"), last.alias("l")).distinct()
    ends = F.when(F.col("f") == F.col("l"), F.array(F.struct(F.col("f").alias("cell"), F.col("low").alias("a"), F.col("high").alias("b")))).otherwise(
        F.array(
            F.struct(F.col("f").alias("cell"), F.col("low").alias("a"), ((F.col("f") + 1) * BLOCK - 1).alias("b")),
            F.struct(F.col("l").alias("cell"), (F.col("l") * BLOCK).alias("a"), F.col("high").alias("b")),
        )
    )
    parts = asked.select("low", "high", F.inline(ends))
    found = _with_cells(levels[k], parts, ["low", "high", "a", "b"], least, "low long, high long, a long, b long").select("low", "high", "hit")
    if k + 1 < len(levels):
        wide = asked.where("l > f + 1").select("low", "high", (F.col("f") + 1).alias("a"), (F.col("l") - 1).alias("b"))
        up = range_minima(levels, wide.select(F.col("a").alias("low"), F.col("b").alias("high")), k + 1)
        found = found.unionByName(wide.join(up.select(F.col("low").alias("a"), F.col("high").alias("b"), "hit"), ["a", "b"]).select("low", "high", "hit"))
    return found.groupBy("low", "high").agg(F.min("hit").alias("hit"))


# The tree -------------------------------------------------------------------------------

ENTRY = "at long, conv_id long, turns long, bytes long, lcp long, next_lcp long, psv long, nsv long, least long, ended string, n_ended long, open boolean, digest string"


def _block(part: pd.DataFrame) -> pd.DataFrame:
    """One block of the sorted conversations, and the entry after it: what can be told without the other blocks.

    psv, nsv: nearest entries of a smaller LCP; least: the smallest conv_id between them, where both lie in the block;
    ended: at the first row of a run of equal conversations in the block, the ids of it, and open whether the run may go on beyond.
    """
    part = part.sort_values("at").reset_index(drop=True)
    peek = part.iloc[-1] if part["peek"].iloc[-1] else None
    rows = part.iloc[:-1] if peek is not None else part
    at, lcp, conv = (rows[c].to_numpy(np.int64) for c in ("at", "lcp", "conv_id"))
    n = len(rows)
    psv, nsv = _stack(lcp), n - 1 - _stack(lcp[::-1])[::-1]
    has_p, has_n = psv >= 0, nsv < n
    both = np.flatnonzero(has_p & has_n & (lcp >= 0))
    least = pd.array([None] * n, "Int64")
    if len(both):
        least[both] = _minima(conv, psv[both], nsv[both] - 1)
    after = np.append(lcp[1:], int(peek["lcp"]) if peek is not None else -1)
    same = rows["same"].to_numpy(bool)
    start = np.flatnonzero(~same | (np.arange(n) == 0))
    stop = np.append(start[1:], n)
    ended, times, opens = np.full(n, None, object), np.zeros(n, np.int64), np.zeros(n, bool)
    for a, b in zip(start, stop, strict=True):
        ended[a], times[a] = ",".join(map(str, conv[a:b].tolist())), b - a
        opens[a] = same[a] or (b == n and peek is not None and bool(peek["same"]))
    places = lambda i, ok: pd.array([int(at[0] + x) if y else None for x, y in zip(i, ok, strict=True)], "Int64")
    return pd.DataFrame(
        {
            "at": at, "conv_id": conv, "turns": rows["turns"].to_numpy(np.int64), "bytes": rows["bytes"].to_numpy(np.int64), "lcp": lcp, "next_lcp": after,
            "psv": places(psv, has_p), "nsv": places(nsv, has_n), "least": least, "ended": ended, "n_ended": times, "open": opens, "digest": rows["digest"],
        }
    )


def _hashed(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """SHA-256 over the parts of runs, as they pass in order."""
    digest, sha, first, turns, n = None, None, None, None, 0
    for part in it:
        out = []
        for d, i, t, text, k in zip(part["digest"], part["at"], part["turns"], part["ended"], part["n_ended"], strict=True):
            if d != digest:
                if sha is not None:
                    out.append((first, turns, sha.hexdigest(), n))
                digest, sha, first, turns, n = d, hashlib.sha256(), i, t, 0
                sha.update(text.encode())
            else:
                sha.update(b"," + text.encode())
            n += k
        yield pd.DataFrame(out, columns=["low", "depth", "sha", "n_ends"])
    if sha is not None:
        yield pd.DataFrame([(first, turns, sha.hexdigest(), n)], columns=["low", "depth", "sha", "n_ends"])


def trie(conversations: DataFrame) -> DataFrame:
    """The prefix trie of the rebuilt conversations of ``conversations(conv_id, turn, role, text)``, a row a node.

    Rows: ``(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256)``.

    The rebuilt conversations are sorted by their turns' digests; neighbours' common turns are the LCP array. The
    branching nodes are its intervals between nearest smaller values, which every block of BLOCK entries finds for
    itself by a stack, and for entries whose neighbour lies in another block by the block minima. Entries of one interval
    are merged into one node; a conversation that no other one starts with is a node too. Where a node's parent is more than a
    turn above, the depths between are nodes of the same members. Figures of a node are those of its interval: differences
    of running sums, and the least id by blocks.

    No conversation, group of equal conversations, or node is one task's: turns are numbered in one order of them all,
    keys of long conversations are built in levels, equal conversations are told apart by their id in the sort, and the
    ids of a run of them are joined by blocks before one task hashes the parts as they pass.

    Defined results: null role or text is empty; turns of one number stand in the order of the MD5 of role and text, turns
    alike in that too are alike; null turns come first; rows without a conv_id belong to no conversation and are passed
    over; a conversation left without turns is a member of the root; % is SQL's remainder, whose sign is the dividend's;
    texts of any length count by their digest and bytes; an empty table has no root and gives no rows; extra columns are
    ignored. Turns are compared by 128 bits of their digest.
    """
    spark = conversations.sparkSession
    original = stored(turns_of(conversations), "trie-original")
    ids = original.select("conv_id").distinct()
    turns = in_order(rebuilt(original), ["conv_id", "pos"], "trie-rebuilt", ["bytes"])
    ordered = stored(sorted_conversations(turns.drop("at", "before_bytes"), ids), "trie-lcp")
    n = ordered.count()
    # The end of the array is smaller than all of it.
    last = spark.range(1).select(F.lit(n).cast("long").alias("at"), F.lit(-1).cast("long").alias("lcp"))
    blank = ordered.withColumn("peek", F.lit(False)).unionByName(last.withColumn("peek", F.lit(False)), allowMissingColumns=True)
    blank = blank.fillna({"conv_id": LAST_ID, "turns": 0, "bytes": 0, "same": False, "digest": ""})
    cut = blank.withColumn("block", F.expr(f"at div {BLOCK}"))
    after = cut.where(F.expr(f"at % {BLOCK} = 0 and at > 0")).withColumn("block", F.col("block") - 1).withColumn("peek", F.lit(True))
    entries = stored(cut.unionByName(after).groupBy("block").applyInPandas(_block, ENTRY), "trie-entries")
    real = F.col("at") < n

    # Nearest smaller values beyond the block.
    inner = real & (F.col("at") > 0)
    if n > BLOCK - 1:
        levels = levels_of(entries.select("at", F.col("lcp").alias("v")), n + 1)
        open_left = entries.where(inner & F.col("psv").isNull()).select(F.expr(f"at div {BLOCK}").alias("at"), F.col("lcp").alias("v"), F.lit("left").alias("side"))
        open_right = entries.where(inner & F.col("nsv").isNull()).select(F.expr(f"at div {BLOCK}").alias("at"), F.col("lcp").alias("v"), F.lit("right").alias("side"))
        hits = stored(nearest_smaller(levels, open_left.unionByName(open_right)), "trie-smaller")
        for side, name in zip(SIDES, ("psv", "nsv"), strict=True):
            mine = hits.where(F.col("side") == side).select(F.col("at").alias("_b"), F.col("v").alias("lcp"), F.col("hit").alias("_hit"))
            some = entries.withColumn("_b", F.expr(f"at div {BLOCK}"))
            entries = some.join(mine, ["_b", "lcp"], "left").withColumn(name, F.when(inner, F.coalesce(name, "_hit"))).drop("_b", "_hit")

    # Bytes of a conversation that the one before does not share.
    start = turns.where("pos = 1").select("conv_id", F.col("before_bytes").alias("_start"))
    upto = turns.join(start, "conv_id").select(F.col("conv_id").alias("_c"), F.col("pos").alias("_p"), (F.col("before_bytes") - F.col("_start")).alias("before_turn"), F.col("bytes").alias("turn_bytes"))
    upto = stored(upto, "trie-bytes")
    shared = F.coalesce(F.col("before_turn") + F.col("turn_bytes"), F.lit(0))
    e = entries.join(upto, (F.col("conv_id") == F.col("_c")) & (F.col("lcp") == F.col("_p")), "left")
    e = e.withColumn("fresh", F.when(real, F.col("bytes") - shared).otherwise(0)).withColumn("leaf", (real & (F.col("next_lcp") < F.col("turns"))).cast("long"))
    e = e.drop("_c", "_p", "before_turn", "turn_bytes").withColumnRenamed("at", "i")
    e = in_order(e, ["i"], "trie-sums", ["bytes", "fresh", "leaf"]).drop("at").withColumnRenamed("i", "at")

    def seen(prefix: str, *columns: str) -> DataFrame:
        return e.select(*[F.col(c).alias(f"{prefix}_{c}") for c in ("at", *columns)])

    # Intervals: entries of one interval are one node.
    merged = e.where(inner).groupBy(F.col("psv").alias("low"), F.col("lcp").alias("depth")).agg(F.min("nsv").alias("end"), F.min("least").alias("least"), F.count("*").alias("cuts"))
    merged = stored(merged, "trie-merged")
    wide = merged.where("least is null").select("low", (F.col("end") - 1).alias("high"))
    if n > BLOCK - 1:
        ids_levels = levels_of(e.select("at", F.col("conv_id").alias("v")), n + 1)
        known = range_minima(ids_levels, wide).select("low", (F.col("high") + 1).alias("end"), "hit")
        merged = merged.join(known, ["low", "end"], "left").withColumn("least", F.coalesce("least", "hit")).drop("hit")
    sums = ["conv_id", "bytes", "fresh", "leaf", "before_bytes", "before_fresh", "before_leaf"]
    inter = (
        merged.join(seen("l", *sums, "lcp", "psv"), F.col("low") == F.col("l_at"))
        .join(seen("h", *sums[1:]), F.col("end") - 1 == F.col("h_at"))
        .join(seen("n", "lcp", "psv"), F.col("end") == F.col("n_at"))
    )
    up = F.greatest("l_lcp", "n_lcp")
    inter = inter.select(
        "low", "depth", "least", up.alias("above"), F.when(F.col("l_lcp") >= F.col("n_lcp"), F.col("l_psv")).otherwise(F.col("n_psv")).alias("up_low"),
        (F.col("end") - F.col("low")).alias("n_convs"), F.col("cuts"), F.col("l_conv_id").alias("of"), F.col("l_bytes").alias("first_bytes"),
        (F.col("h_before_leaf") + F.col("h_leaf") - F.col("l_before_leaf")).alias("n_leaves"),
        (F.col("h_before_bytes") + F.col("h_bytes") - F.col("l_before_bytes")).alias("all_bytes"),
        (F.col("h_before_fresh") + F.col("h_fresh") - F.col("l_before_fresh") - F.col("l_fresh")).alias("more_fresh"),
    )
    # Ids of the conversations that end at a node: runs within a block are whole there, the others' parts are put together.
    runs = e.where(real & F.col("ended").isNotNull() & (F.greatest("lcp", "next_lcp") >= F.col("turns")))
    whole = runs.where(~F.col("open")).select(F.col("at").alias("low"), F.col("turns").alias("depth"), F.sha2("ended", 256).alias("sha"), F.col("n_ended").alias("n_ends"))
    parts = runs.where("open").select("digest", "at", "turns", "ended", "n_ended").repartition("digest").sortWithinPartitions("digest", "at")
    ends = whole.unionByName(parts.mapInPandas(_hashed, "low long, depth long, sha string, n_ends long"))
    inter = stored(inter.join(ends, ["low", "depth"], "left").withColumn("n_ends", F.coalesce("n_ends", F.lit(0))), "trie-intervals")
    inter = inter.withColumn("n_children", F.col("cuts") + 1 - F.col("n_ends")).drop("cuts", "n_ends")

    # Conversations that are nodes by themselves.
    alone = e.where(real & (F.col("turns") > F.greatest("lcp", "next_lcp")))
    of = F.when(F.col("lcp") >= F.col("next_lcp"), F.col("at")).otherwise(F.col("at") + 1)
    alone = alone.withColumn("_of", of).join(seen("u", "psv"), F.col("_of") == F.col("u_at")).select(
        F.col("at").alias("low"), F.col("turns").alias("depth"), F.col("conv_id").alias("least"), F.greatest("lcp", "next_lcp").alias("above"), F.col("u_psv").alias("up_low"),
        F.lit(1).cast("long").alias("n_convs"), F.col("conv_id").alias("of"), F.col("bytes").alias("first_bytes"), F.lit(1).cast("long").alias("n_leaves"),
        F.col("bytes").alias("all_bytes"), F.lit(0).cast("long").alias("more_fresh"), F.sha2(F.col("conv_id").cast("string"), 256).alias("sha"), F.lit(0).cast("long").alias("n_children"),
    )
    parents = inter.select(F.col("low").alias("up_low"), F.col("depth").alias("above"), F.col("least").alias("up_least"))
    explicit = inter.unionByName(alone).join(parents, ["up_low", "above"], "left")

    # The depths between a node and its parent.
    nodes = explicit.withColumn("d", F.explode(F.sequence(F.col("above") + 1, F.col("depth"))))
    nodes = nodes.join(upto, (F.col("of") == F.col("_c")) & (F.col("d") == F.col("_p")), "left")
    bottom, pre = F.col("d") == F.col("depth"), F.coalesce("before_turn", F.lit(0))
    return nodes.select(
        F.col("least").alias("conv_id"),
        F.col("d").alias("depth"),
        F.when(F.col("d") > 0, F.when(F.col("d") == F.col("above") + 1, F.col("up_least")).otherwise(F.col("least"))).alias("parent_conv_id"),
        "n_convs",
        F.when(bottom, F.col("n_children")).otherwise(1).cast("long").alias("n_children"),
        "n_leaves",
        (F.col("all_bytes") - F.col("n_convs") * pre - (F.col("first_bytes") - pre) - F.col("more_fresh")).cast("long").alias("saved_tokens"),
        F.coalesce(F.when(bottom, F.col("sha")), F.lit(EMPTY_SHA)).alias("ends_sha256"),
    )
