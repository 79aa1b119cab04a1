"""Suffix-array deduplication: column-wise construction of a collection's transform and common prefixes."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import discard, stored

LENGTH = 50
#: Bytes of the grams whose smallest hash in a window is the window's anchor.
GRAM = 24
#: Windows of one string at most, strings of one collection at least, and strings of an anchor from which its
#: windows are compared one by one instead.
STRIDE, COLLECTION, CROWDED = 32, 512, 4_096

#: Strings from which a window of crowded anchors counts as hot, and hot windows (50 bytes each) that go to all tasks
#: at most; beyond, adaptive execution splits them.
HOT_WINDOW, HOT_WINDOWS = 1_024, 100_000
#: Pairs of anchor and text that a task sorts at once.
PAIRS = 1 << 20
#: Bytes of text whose strings are made at once, besides the last text, and whose anchors are.
TEXT_BYTES, TOGETHER = 1 << 19, 1 << 15

_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]
_SHIFT = [np.uint64(x) for x in (29, 32)]


def anchors(text: bytes, length: int = LENGTH, gram: int = GRAM) -> np.ndarray:
    """For each window of ``length`` bytes, the smallest hash of its grams: equal windows have equal anchors."""
    part = np.frombuffer(text, np.uint8).astype(np.uint64) + np.uint64(1)
    power, size, whole, done = _MIX[:1][0], 1, None, 0
    with np.errstate(over="ignore"):
        while True:  # polynomial hashes of grams by doubling
            if gram & size:
                if whole is None:
                    whole, done = part, size
                else:
                    n = len(part) - done
                    whole, done = whole[:n] * power + part[done : done + n], done + size
            if 2 * size > gram:
                break
            part = part[:-size] * power + part[size:]
            power, size = power * power, 2 * size
        h = whole[: len(text) - gram + 1]
        h = (h ^ (h >> _SHIFT[0])) * _MIX[1]
        h = (h ^ (h >> _SHIFT[1])) * _MIX[2]
        h ^= h >> _SHIFT[0]
    span, size = length - gram + 1, 1
    while 2 * size <= span:
        h, size = np.minimum(h[:-size], h[size:]), 2 * size
    rest = span - size
    return (np.minimum(h[: len(h) - rest], h[rest:]) if rest else h).view(np.int64)


def anchors_of(texts: list[bytes]) -> Iterator[np.ndarray]:
    """``anchors`` of each text (of ``LENGTH`` bytes at least), worked out over many short texts at once."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= TOGETHER):
            size += len(texts[end])
            end += 1
        whole, start = anchors(b"".join(texts[at:end])), 0
        for text in texts[at:end]:  # windows that span two texts are passed over
            yield whole[start : start + len(text) - LENGTH + 1]
            start += len(text)
        at = end


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are among the known ones, of which there is one at least."""
    known = np.sort(known)
    at = np.searchsorted(known, values)
    at[at == len(known)] = 0
    return known[at] == values


def runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and one past the last place of each run of equal values."""
    cut = np.flatnonzero(values[1:] != values[:-1]) + 1
    return np.concatenate(([0], cut)), np.concatenate((cut, [len(values)]))


def column_transform(strings: list[bytes], cap: int, symbol: str = "u1") -> tuple[np.ndarray, np.ndarray]:
    """The collection's Burrows-Wheeler transform (0: a string's begin) and capped common prefixes.

    Strings are of bytes, or of byte pairs (``symbol`` ">u2"), which order the same.

    Round j inserts, for every string, the suffix of length j: its place follows from the rank of its first
    symbol among equal symbols of the transform so far; its common prefixes with both neighbours are one more
    than the least common prefix between that symbol's place and its previous and next occurrence. Each round
    passes over the transform and the prefixes once, in order, and writes both anew.
    """
    n = len(strings)
    data = np.frombuffer(b"".join(strings), symbol)
    wide = data.dtype.itemsize
    code = np.zeros(1 << 8 * wide, np.int32)
    code[data] = 1
    kinds = int(code.sum())
    code = np.cumsum(code)  # small codes in the symbols' order
    codes = np.append(code[data], 0).astype(np.uint8 if kinds < 255 else np.uint16)
    size = np.array([len(s) for s in strings]) // wide
    end = np.cumsum(size)
    bwt = np.where(size > 0, codes[np.maximum(end - 1, 0)], 0).astype(codes.dtype)
    lcp, place = np.zeros(n + 1, np.uint8), np.arange(n)
    for j in range(1, int(size.max(initial=0)) + 1):
        live = np.flatnonzero(size >= j)
        order = np.argsort(bwt, kind="stable")
        rank = np.empty(len(bwt), np.int32)
        rank[order] = np.arange(len(bwt), dtype=np.int32)
        blank = len(bwt) - int(np.count_nonzero(bwt))
        at = place[live]
        r, symbol = rank[at], bwt[at]
        new = r.astype(np.int64) - blank + n
        before, after = order[np.maximum(r - 1, 0)], order[np.minimum(r + 1, len(bwt) - 1)]
        has_before = (r > 0) & (bwt[before] == symbol) & (before < at)
        has_after = (after > at) & (bwt[after] == symbol)
        common = np.zeros(len(live), np.uint8)
        common[has_before] = _least(lcp, before[has_before] + 1, at[has_before] + 1)
        common[has_before] = np.minimum(common[has_before] + 1, cap)
        follow = np.minimum(_least(lcp, at[has_after] + 1, after[has_after] + 1) + 1, cap)
        following = rank[after[has_after]].astype(np.int64) - blank + n
        fresh = np.zeros(len(bwt) + len(live), bool)
        fresh[new] = True
        next_symbol = np.where(size[live] > j, codes[np.maximum(end[live] - j - 1, 0)], 0)
        grown, prefixes, kept = np.empty(len(fresh), bwt.dtype), np.zeros(len(fresh) + 1, np.uint8), ~fresh
        grown[kept], grown[new] = bwt, next_symbol
        prefixes[:-1][kept], prefixes[new] = lcp[:-1], common
        prefixes[following] = follow
        bwt, lcp = grown, prefixes
        place[live] = new
    return bwt, lcp[:-1]


def _least(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The least of ``values[low:high]`` for each pair; every range has a member."""
    if not len(low):
        return np.zeros(0, values.dtype)
    return np.minimum.reduceat(values, np.column_stack((low, high)).ravel())[::2]


def window_lows(strings: list[bytes], lows: np.ndarray, length: int = LENGTH) -> list[np.ndarray]:
    """For each window of each string, the smallest of ``lows`` over the strings that hold the same window.

    Windows of an even length are compared by byte pairs, a string's from its first byte and from its second: half the
    rounds, over as many suffixes as there are bytes.
    """
    if length % 2:
        return _window_lows(strings, lows, length, "u1")
    halves = [s[: len(s) - len(s) % 2] for s in strings], [s[1 : len(s) - (len(s) - 1) % 2] for s in strings]
    found = _window_lows([*halves[0], *halves[1]], np.concatenate((lows, lows)), length // 2, ">u2")
    out = []
    for even, odd in zip(found, found[len(strings) :]):
        both = np.empty(len(even) + len(odd), np.int64)
        both[0::2], both[1::2] = even, odd
        out.append(both)
    return out


def _window_lows(strings: list[bytes], lows: np.ndarray, length: int, symbol: str) -> list[np.ndarray]:
    bwt, lcp = column_transform(strings, length, symbol)
    n, size = len(strings), np.array([len(s) for s in strings]) // np.dtype(symbol).itemsize
    order = np.argsort(bwt, kind="stable")
    step = np.empty(len(bwt), np.int64)
    step[order] = np.arange(len(bwt)) - (len(bwt) - int(np.count_nonzero(bwt))) + n
    group = np.cumsum(lcp < length) - 1
    least = np.full(int(group[-1]) + 1, np.iinfo(np.int64).max)
    at, seen = np.arange(n), []
    for j in range(1, int(size.max(initial=0)) + 1):  # walk each string from its end along the transform
        live = np.flatnonzero(size >= j)
        at[live] = step[at[live]]
        if j >= length:
            g = group[at[live]]
            np.minimum.at(least, g, lows[live])
            seen.append((live, g))
    windows = np.maximum(0, size - length + 1)
    ends = np.cumsum(windows)
    flat = np.empty(int(ends[-1]) if n else 0, np.int64)
    for back, (live, g) in enumerate(seen):
        flat[ends[live] - 1 - back] = least[g]
    return np.split(flat, ends[:-1])


def _encode(lows: np.ndarray) -> bytes:
    """Runs of equal values as (length, value) pairs."""
    if (lows == lows[0]).all():
        return struct.pack("<qq", len(lows), lows[0])
    a, b = runs(lows)
    return np.column_stack((b - a, lows[a])).astype("<i8").tobytes()


def _text_id(md5_hex: Column) -> Column:
    """60 bits of a text's MD5: with the smallest doc_id of the text, its name in all tables here."""
    return F.conv(F.substring(md5_hex, 1, 15), 16, 10).cast("long")


class SharedPairs:
    """Finds the anchors of two texts or more in a stream of (anchor, text) pairs.

    Kept are one pair for each anchor seen in one text so far, and the anchors known to be shared; pairs of
    shared anchors leave as soon as they come, so an anchor that very many texts have takes no memory.
    """

    def __init__(self) -> None:
        self.h = self.d = self.shared = np.zeros(0, np.int64)

    def add(self, h: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of shared anchors among these and those kept."""
        h, d = np.concatenate((self.h, h)), np.concatenate((self.d, d))
        if not len(h):
            return h, d
        order = np.argsort(h)
        h, d = h[order], d[order]
        a, z = runs(h)
        first = h[a]
        many = (np.minimum.reduceat(d, a) != np.maximum.reduceat(d, a)) | np.isin(first, self.shared)
        self.h, self.d = first[~many], d[a[~many]]
        self.shared = np.union1d(self.shared, first[many])
        out = np.repeat(many, z - a)
        return h[out], d[out]


def _shared_anchors(docs: DataFrame, n_bytes: int) -> DataFrame:
    """``(d, hs)``: for each text (60 bits of its MD5), its anchors that a different text has, too.

    Pairs travel as packed blobs, one for each bucket of anchors and ``PAIRS`` pairs read. There are so many
    buckets that a bucket's different anchors are about ``PAIRS``, whatever the size of the input. Of an anchor that
    several texts among those pairs have, two pairs go to its bucket, and the others, known to be shared, to any: so
    an anchor of very many texts does not fill its bucket.
    """
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n_bytes // (PAIRS * (LENGTH - GRAM) // 2)))

    def emit(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(turn: int) -> pa.RecordBatch:
            h, d = np.concatenate(hs), np.concatenate(ds)
            hs.clear(), ds.clear()
            order = np.argsort(h)
            a, z = runs(h[order])
            by = d[order]
            # Of each anchor one text travels, and another one if it has any; the rest is known to be shared here.
            other = np.where(by != np.repeat(by[a], z - a), np.arange(len(by)), -1)
            last = np.maximum.reduceat(other, a)
            two = last >= 0
            inner = np.repeat(two, z - a)
            inner[a] = inner[last[two]] = False
            known_h, known_d = h[order[inner]], by[inner]
            sent = np.zeros(len(h), bool)
            sent[order[a]] = sent[order[last[two]]] = True
            del order, by, other, inner
            h, d = h[sent], d[sent]
            bucket = (h.view(np.uint64) % np.uint64(buckets)).astype(np.uint16 if buckets < 1 << 16 else np.int64)
            order = np.argsort(bucket, kind="stable")
            h, d, bucket = h[order], d[order], bucket[order]
            first, last = runs(bucket)
            places = bucket[first].tolist()
            # Anchors, then texts in their turn: those repeat, which the shuffle's compression notices side by side only.
            blobs = [h[i:k].tobytes() + d[i:k].tobytes() for i, k in zip(first.tolist(), last.tolist())]
            kinds, part = [False] * len(blobs), PAIRS // 64
            for k, i in enumerate(range(0, len(known_h), part)):  # spread over all buckets
                blobs.append(known_h[i : i + part].tobytes() + known_d[i : i + part].tobytes())
                places.append((turn * 64 + k * 7919 + len(known_h)) % buckets)
                kinds.append(True)
            return pa.RecordBatch.from_arrays([pa.array(places, pa.int64()), pa.array(kinds), pa.array(blobs, pa.binary())], names=["p", "shared", "pairs"])

        hs, ds, n, turn = [], [], 0, 0
        for b in it:
            texts = b.column(0).to_pylist()
            for text, a in zip(texts, anchors_of(texts)):
                h = np.unique(a[runs(a)[0]])
                hs.append(h)
                ds.append(np.full(len(h), int(hashlib.md5(text).hexdigest()[:15], 16)))
                n += len(h)
                if n >= PAIRS:
                    yield flush(turn)
                    hs, ds, n, turn = [], [], 0, turn + 1
        if n:
            yield flush(turn)

    def shared(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> pa.RecordBatch:
            columns = [np.frombuffer(x, "<i8").reshape(2, -1) for x in held]
            h, d = state.add(*(np.concatenate([c[k] for c in columns]) for k in (0, 1)))
            return pa.RecordBatch.from_arrays([pa.array(d), pa.array(h)], names=["d", "h"])

        at, state, held, n = None, SharedPairs(), [], 0
        for b in it:
            for p, known, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                if known:
                    h, d = np.frombuffer(blob.as_py(), "<i8").reshape(2, -1)
                    yield pa.RecordBatch.from_arrays([pa.array(d), pa.array(h)], names=["d", "h"])
                    continue
                if p != at or n >= 16 * PAIRS:
                    if held:
                        yield flush()
                    held, n = [], 0
                    if p != at:
                        at, state = p, SharedPairs()
                held.append(blob.as_py())
                n += len(held[-1])
        if held:
            yield flush()

    rows = docs.select("text").mapInArrow(emit, "p long, shared boolean, pairs binary")
    pairs = rows.repartition(buckets, "p").sortWithinPartitions("p").mapInArrow(shared, "d long, h long")
    return pairs.groupBy("d").agg(F.collect_set("h").alias("hs"))


def _strings(docs: DataFrame) -> DataFrame:
    """Runs of windows with one shared anchor, as strings: ``(h, sh, d, low, start, windows, string)``."""

    def emit(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in it:
            size = np.cumsum([0, *(len(t.as_py()) for t in whole.column(2))]) // TEXT_BYTES
            cuts = [0, *(np.flatnonzero(size[1:] != size[:-1]) + 1).tolist(), whole.num_rows]
            for at, end_at in zip(cuts, cuts[1:]):
                if at == end_at:
                    continue
                b = whole.slice(at, end_at - at)
                made, base, texts = [], 0, b.column(2).to_pylist()
                for i, (text, a) in enumerate(zip(texts, anchors_of(texts))):
                    first, end = runs(a)
                    keep = _among(a[first], b.column(3)[i].values.to_numpy())
                    first, end = first[keep], end[keep]
                    parts = -(-(end - first) // STRIDE)  # longer runs are cut
                    turn = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
                    start = np.repeat(first, parts) + STRIDE * turn
                    windows = np.minimum(STRIDE, np.repeat(end, parts) - start)
                    made.append((a[start], start, windows, start + base, np.full(len(start), i)))
                    base += len(text)
                h, start, windows, place, row = (np.concatenate(c) for c in zip(*made))
                size = windows + LENGTH - 1
                ends = np.cumsum(size)
                bytes_at = np.arange(int(size.sum())) + np.repeat(place - (ends - size), size)
                data = np.frombuffer(b"".join(texts), np.uint8)[bytes_at]
                offsets = np.concatenate(([0], ends)).astype(np.int32)
                strings = pa.Array.from_buffers(pa.binary(), len(h), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
                row = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(h), b.column(0).take(row), b.column(1).take(row), pa.array(start.astype(np.int32)),
                        pa.array(windows.astype(np.int32)), strings,
                    ],
                    names=["h", "d", "low", "start", "windows", "string"],
                )

    schema = "h long, d long, low long, start int, windows int, string binary"
    return docs.select("d", "low", "text", "hs").mapInArrow(emit, schema).withColumn("sh", F.xxhash64("string"))


def _lows(strings: DataFrame) -> DataFrame:
    """``(h, sh, lows)``: for each different string, the smallest document of each of its windows, as runs."""
    each = stored(strings.groupBy("h", "sh", "string").agg(F.min("low").alias("low")), "suffix-strings", compression="zstd")
    crowded = stored(each.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > CROWDED).select("h"), "suffix-crowded")

    def solve(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(rows):
            h, sh, texts, low = zip(*rows)
            low = np.array(low)
            found = [_encode(x) for x in window_lows(list(texts), low)]
            return pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(sh, pa.int64()), pa.array(found, pa.binary())], names=["h", "sh", "lows"])

        def alone(row):
            return struct.pack("<qq", len(row[2]) - LENGTH + 1, row[3])

        rows, group, single = [], [], []
        for b in it:
            for row in zip(*(b.column(k).to_pylist() for k in range(4))):
                if group and row[0] != group[0][0]:
                    if len(group) == 1:  # one string: its windows have no others to be equal to
                        single.append((*group[0][:2], alone(group[0])))
                    else:
                        rows.extend(group)
                    group = []
                    if len(rows) >= COLLECTION:
                        yield flush(rows)
                        rows = []
                    if len(single) >= 16_384:
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*single)], names=["h", "sh", "lows"])
                        single = []
                group.append(row)
        # A string may hold a window twice, so the last groups go through the same construction.
        rows.extend(group)
        if rows:
            yield flush(rows)
        if single:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*single)], names=["h", "sh", "lows"])

    schema = "h long, sh long, lows binary"
    rest, dense = (each, None) if crowded.isEmpty() else (each.join(crowded, "h", "left_anti"), each.join(crowded, "h", "left_semi"))
    ordered = rest.select("h", "sh", "string", "low").repartition(F.col("h")).sortWithinPartitions("h", "sh")
    out = ordered.mapInArrow(solve, schema)
    if dense is not None:
        out = out.unionByName(_dense_lows(dense, schema))
    out = stored(out, "suffix-lows")
    discard(each)
    return out


def _dense_lows(dense: DataFrame, schema: str) -> DataFrame:
    """The same for anchors of very many strings: their windows are grouped over all tasks, with partial sums."""
    windows = dense.select(
        "h", "sh", "low", F.posexplode(F.transform(F.sequence(F.lit(1), F.length("string") - LENGTH + 1), lambda i: F.substring(F.col("string"), i, F.lit(LENGTH)))).alias("at", "window")
    )
    least = stored(windows.groupBy("window").agg(F.min("low").alias("least"), F.count("*").alias("n")), "suffix-least")
    # Windows of very many strings, where they are few, go to all tasks instead of gathering their strings in one.
    hot = least.where(F.col("n") > HOT_WINDOW)
    if hot.count() <= HOT_WINDOWS:
        cold = windows.join(F.broadcast(hot.select("window")), "window", "left_anti").join(least.where(F.col("n") <= HOT_WINDOW).drop("n"), "window")
        placed = cold.unionByName(windows.join(F.broadcast(hot.drop("n")), "window"))
    else:
        placed = windows.join(least.drop("n"), "window")
    back = placed.groupBy("h", "sh").agg(F.array_sort(F.collect_list(F.struct("at", "least"))).alias("all"))

    def encode(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            found = [_encode(np.array([x["least"] for x in v.as_py()])) for v in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.binary())], names=["h", "sh", "lows"])

    return back.mapInArrow(encode, schema)


def _removals(strings: DataFrame, lows: DataFrame) -> DataFrame:
    """``(d, low, spans)``: byte ranges of a text covered by windows of smaller documents."""

    def emit(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            row, a, z = [], [], []
            for i, (low, at, code) in enumerate(zip(*(b.column(k).to_pylist() for k in (1, 2, 3)))):
                for n, m in struct.iter_unpack("<qq", code):
                    if m < low:
                        row.append(i), a.append(at), z.append(at + n + LENGTH - 1)
                    at += n
            row = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(row), b.column(1).take(row), pa.array(a, pa.int32()), pa.array(z, pa.int32())], names=["d", "low", "a", "z"]
            )

    joined = strings.select("h", "sh", "d", "low", "start").join(lows, ["h", "sh"]).select("d", "low", "start", "lows")
    rows = joined.mapInArrow(emit, "d long, low long, a int, z int")
    return rows.groupBy("d", "low").agg(F.collect_set(F.struct("a", "z")).alias("spans"))


def cut(text: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """What is left of a text, the bytes removed, and the number of maximal removed runs."""
    kept, removed, n, at = [], 0, 0, 0
    for a, z in sorted(spans):
        if a > at or not n:
            kept.append(text[at:a])
            n += 1
            removed += z - a
            at = z
        elif z > at:
            removed += z - at
            at = z
    kept.append(text[at:])
    return b"".join(kept), removed, n


def _ranked(texts: DataFrame) -> DataFrame:
    """``texts`` with ``low``, a long in the order of ``first``, whatever its type: equal ids share one."""
    if texts.schema["first"].dataType.typeName() in ("byte", "short", "integer", "long"):
        return texts.withColumn("low", F.col("first").cast("long"))
    ids = texts.select("first").distinct().repartitionByRange("first").sortWithinPartitions("first")
    return texts.join(stored(ids.withColumn("low", F.monotonically_increasing_id()), "suffix-ranks"), "first")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept)`` for every row of ``docs(doc_id, text)``.

    Removed is each byte covered by a 50-byte string that also starts in a document with a smaller doc_id, judged
    on the input. ``kept`` holds the remaining bytes. The suffix structure is built for small collections: every
    50-byte window goes to the collection of its anchor, the smallest hash of its 24-byte grams, so equal
    windows meet; only anchors that two different texts have lead to strings at all. Within a collection the
    transform and common prefixes are built column by column. Copies of a whole text are one text to all this.

    A document is smaller by its doc_id's own order, numbers as numbers and strings as strings. A text of any length is
    cut into windows in bounded parts of the collection.

    Memory is bounded: a collection has at most ``COLLECTION + CROWDED`` strings of at most 81 bytes; an anchor
    with more strings is resolved window by window over all tasks.

    Defined results: a null text is empty; texts under 50 bytes stay whole; a null doc_id neither takes nor gives;
    rows with the same doc_id do not affect each other; repeated rows come out once each; an empty table gives
    no rows; extra columns are ignored.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    usable = docs.where(F.col("doc_id").isNotNull() & (F.length("text") >= LENGTH))
    texts = usable.groupBy(F.md5("text").alias("md5")).agg(F.min("doc_id").alias("first"), F.sum(F.length("text")).alias("n"))
    lows = stored(_ranked(texts), "suffix-texts")
    shared = stored(_shared_anchors(usable, lows.agg(F.sum("n")).first()[0] or 0), "suffix-anchors")
    wanted = lows.withColumn("d", _text_id(F.col("md5"))).join(shared, "d").select("d", "first", "low", "hs")
    # Copies of a text spread over tasks by their doc_id: only the first one meets the text's row.
    name = {"d": _text_id(F.md5("text")), "first": F.col("doc_id")}
    texts = usable.withColumns(name).join(wanted, ["d", "first"])
    strings = stored(_strings(texts), "suffix-rows", compression="zstd")
    spans = stored(_removals(strings, _lows(strings)), "suffix-spans")
    discard(strings)
    about = lows.select(_text_id(F.col("md5")).alias("d"), "first", "low").join(spans, ["d", "low"], "left").select("d", "first", F.lit(True).alias("is_first"), "spans")
    joined = docs.withColumns(name).join(about, ["d", "first"], "left").select("doc_id", "text", "is_first", "spans")

    def emit(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            made = []
            for d, t, first, s in zip(*(b.column(k) for k in range(4))):
                text = t.as_py()
                if d.as_py() is None or len(text) < LENGTH:
                    made.append((text, 0, 0, len(text)))
                elif not first.as_py():  # a copy of a smaller document
                    made.append((b"", len(text), 1, len(text)))
                else:
                    made.append((*cut(text, [(x["a"], x["z"]) for x in s.as_py() or ()]), len(text)))
            kept, removed, n, size = zip(*made) if made else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(x, pa.int64()) for x in (size, removed, n)), pa.array(kept, pa.binary())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
            )

    kind = dict(docs.dtypes)["doc_id"]
    return joined.mapInArrow(emit, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary")
