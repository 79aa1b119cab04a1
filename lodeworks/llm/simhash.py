"""SimHash near-duplicates: fingerprints, multi-index Hamming search, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import connected_components, stored

BITS, HALF, SEED = 64, 32, 42


def fingerprint(text: bytes | None, width: int = 3) -> int:
    """64-bit SimHash of the ``width``-word shingles of lower-cased (A-Z) text, repeats included."""
    import xxhash

    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) < width:
        words = [b" ".join(words)]
        width = 1
    digest, n = xxhash.xxh64_intdigest, len(words) - width + 1
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, 1 << 15):  # bounded memory for very long texts
        part = words[at : at + (1 << 15) + width - 1]
        shingles = zip(*(part[i:] for i in range(width)))
        hashes = np.array([digest(b" ".join(s), SEED) for s in shingles], dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 3, *carried: str) -> DataFrame:
    """``(doc_id, fp, *carried)`` for every row of ``docs(doc_id, text, …)``; fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = np.array([fingerprint(t.as_py(), width) for t in b.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(values.view(np.int64)), *b.columns[2:]], names=["doc_id", "fp", *carried]
            )

    kinds = dict(docs.dtypes)
    schema = f"doc_id {kinds['doc_id']}, fp long" + "".join(f", `{c}` {kinds[c]}" for c in carried)
    return docs.select("doc_id", F.col("text").cast("binary").alias("text"), *carried).mapInArrow(run, schema)


def _half(fp: Column, segment: int) -> Column:
    return F.shiftrightunsigned(fp, HALF * segment).bitwiseAND(F.lit(0xFFFFFFFF))


def _key(half: Column, segment: int) -> Column:
    return half.bitwiseOR(F.lit(segment << HALF))


def links(fps: DataFrame, distance: int = 3, dense: int = 64) -> DataFrame:
    """Pairs ``(src, dst)`` of different fingerprints that connect all those at most ``distance`` (3) bits apart.

    Multi-index hashing over two 32-bit segments: with three differing bits, one segment has at most one. The
    table holds each fingerprint under both its segments; a fingerprint looks up each segment's value and the
    values with one more bit set; matches are verified over all 64 bits. A key that more than ``dense``
    fingerprints share is resolved exactly by a second level instead (``_dense_links``), so no list of
    candidates grows with the square of a group.
    """
    if distance != 3:
        raise ValueError("two segments with balls of radius 1 serve a distance of 3")
    fp = F.col("fp")
    table = fps.select("fp", F.explode(F.array(*[_key(_half(fp, s), s) for s in (0, 1)])).alias("key"))
    probes = fps.select(
        "fp",
        F.explode(F.concat(*[_ball(_half(fp, s), s) for s in (0, 1)])).alias("key"),
    )
    crowded = stored(table.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > dense).select("key"), "simhash-crowded")
    none_crowded = crowded.isEmpty()
    t, p = (table, probes) if none_crowded else (table.join(crowded, "key", "left_anti"), probes.join(crowded, "key", "left_anti"))
    found = _verified(t, p, "key")
    if not none_crowded:
        found = found.unionByName(_dense_links(table.join(crowded, "key", "left_semi"), probes.join(crowded, "key", "left_semi")))
    return found


def _ball(value: Column, segment: int) -> Column:
    return F.transform(F.concat(F.array(value), _flips(value, HALF)), lambda v: _key(v, segment))


def _flips(value: Column, bits: int) -> Column:
    """The values with one more of the low ``bits`` bits set; of two values one bit apart, one reaches the other so."""
    masks = F.array(*[F.lit(1 << i).cast("long") for i in range(bits)])
    return F.filter(F.transform(masks, lambda m: value.bitwiseOR(m)), lambda x: x != value)


def _verified(table: DataFrame, probes: DataFrame, *keys: str) -> DataFrame:
    t, p = table.withColumnRenamed("fp", "dst"), probes.withColumnRenamed("fp", "src")
    return (
        p.join(t, list(keys))
        .where((F.col("src") != F.col("dst")) & (F.bit_count(F.col("src").bitwiseXOR(F.col("dst"))) <= 3))
        .select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
    )


def _other(key: str) -> Column:
    """The 32 bits of ``fp`` that are not the key's segment."""
    fp = F.col("fp")
    return F.when(F.shiftright(F.col(key), HALF) == 0, _half(fp, 1)).otherwise(_half(fp, 0))


def _dense_links(table: DataFrame, probes: DataFrame) -> DataFrame:
    """Exact links inside crowded keys: the same search over the two 16-bit quarters of the other segment.

    Rows that meet under a key differ by three bits at most in the other segment, so one of its quarters differs
    by one at most. A key of this level fixes 48 bits; at most 65,536 different fingerprints can share it, and
    of a group whose members stray r bits from their centre only one in 4**r does.
    """

    def quarter(q: int) -> Column:
        return F.shiftrightunsigned(F.col("rest"), 16 * q).bitwiseAND(F.lit(0xFFFF))

    def tagged(value: Column, q: int) -> Column:
        return value.bitwiseOR(F.lit(q << 16))

    masks = F.array(*[F.lit(m).cast("long") for m in [0, *(1 << i for i in range(16))]])
    table, probes = (x.withColumn("rest", _other("key")) for x in (table, probes))
    t = table.select("key", "fp", F.explode(F.array(*[tagged(quarter(q), q) for q in (0, 1)])).alias("key2"))
    # Flips in both directions: a pair that the first level met through a flip is met from that side only.
    near = F.concat(
        F.transform(masks, lambda m: tagged(quarter(0).bitwiseXOR(m), 0)),
        F.transform(masks, lambda m: tagged(quarter(1).bitwiseXOR(m), 1)),
    )
    return _verified(t, probes.select("key", "fp", F.explode(near).alias("key2")), "key", "key2")


def _components(marked: DataFrame, distance: int, dense: int) -> DataFrame:
    """``marked(doc_id, fp, …)`` with component_id."""
    vertices = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("low")), "simhash-vertices")
    member = connected_components(links(vertices.select("fp"), distance, dense), "simhash")
    member = stored(member, "simhash-members")
    rooted = vertices.join(member, vertices.fp == member.node, "left").select(
        "fp", "low", F.coalesce("component", "fp").alias("root")
    )
    lows = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    return marked.join(rooted.join(lows, "root").select("fp", "component_id"), "fp").select(*marked.columns, "component_id")


def near_duplicates(docs: DataFrame, distance: int = 3, width: int = 3, dense: int = 64) -> DataFrame:
    """``(doc_id, fp, component_id)`` for every row of ``docs(doc_id, text)``.

    component_id is the smallest doc_id reachable over links of fingerprints at most ``distance`` bits apart.
    Rows with the same fingerprint share one vertex, so copies are never paired. Fingerprints and components
    stay distributed; the driver sees row counts only.

    Defined results: a null or blank text has fingerprint 0, which links like any other; a null doc_id is
    fingerprinted and linked but is no candidate for component_id, which is null where a component has no other;
    repeated rows come out once each; ties of fingerprints are one component; a text of any length is read whole,
    in parts of bounded memory; an empty table gives no rows; extra columns are ignored.
    """
    return _components(stored(fingerprints(docs, width), "simhash-fp"), distance, dense)
