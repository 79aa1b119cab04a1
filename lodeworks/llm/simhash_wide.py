"""SimHash near-duplicates of a lower similarity: fingerprints of 512 bits, the same search over their segments.

At a similarity of 0.8 about 15 % of the bits differ, far more than 64 bits can be searched for. Of 21 segments of 24 bits,
one differs by one bit at most in nine of ten pairs at that similarity, and in nearly all pairs above 0.85.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import connected_components, fresh, stored
from .simhash import SEED

WORDS, SEGMENT, SEGMENTS = 8, 24, 21
BITS = 64 * WORDS
#: Shingles that are turned into bits at once.
ROWS = 1 << 12
#: Leaders of a crowded key, which its rows are held against first.
LEADERS = 4
#: Rows of a crowded key that meet as many others in one part of a join.
CELL = 4096
#: Of the 64 bits that candidates carry, so many may differ at most: four standard deviations above the mean at 0.8.
SHORT = 22
_STEPS = (np.arange(1, WORDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[None, :]


def distance_for(similarity: float) -> int:
    """Differing bits of two texts of that similarity, in the mean, and half a standard deviation more.

    The shingle sets of two texts of one size and a similarity (shared of all shingles) j meet at the cosine 2j / (1 + j), and a
    bit differs with the probability of their angle over pi."""
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return round(BITS * p + 0.5 * math.sqrt(BITS * p * (1 - p)))


def _mixed(h: np.ndarray) -> np.ndarray:
    """Seven more hashes of each of ``h``, by the finisher of SplitMix64 over a step each."""
    with np.errstate(over="ignore"):
        z = h[:, None] + _STEPS
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return np.hstack((h[:, None], z ^ (z >> np.uint64(31))))


def fingerprint(text: bytes | None, width: int = 5) -> np.ndarray:
    """512 bits, a byte each: the majority over the different ``width``-word shingles of lower-cased (A-Z) text. Fewer words
    are one shingle; none, all bits zero."""
    import xxhash

    words = (text or b"").lower().split()
    if not words:
        return np.zeros(BITS, np.uint8)
    if len(words) < width:
        words, width = [b" ".join(words)], 1
    digest = xxhash.xxh64_intdigest
    h = np.unique(np.array([digest(b" ".join(words[i : i + width]), SEED) for i in range(len(words) - width + 1)], dtype="<u8"))
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(h), ROWS):
        bits = np.unpackbits(_mixed(h[at : at + ROWS]).view(np.uint8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
    return (2 * ones > len(h)).astype(np.uint8)


def fingerprints(docs: DataFrame, width: int, own: str) -> DataFrame:
    """``(doc_id, own, fp, segments)``: eight longs, and the 21 values of 24 bits."""
    weights = 1 << np.arange(SEGMENT, dtype=np.int64)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            bits = np.array([fingerprint(t.as_py(), width) for t in b.column(2)], np.uint8).reshape(-1, BITS)
            fp = np.packbits(bits, axis=1, bitorder="little").view("<i8")
            cut = bits[:, : SEGMENT * SEGMENTS].reshape(-1, SEGMENTS, SEGMENT) @ weights
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(list(fp), pa.list_(pa.int64())), pa.array(list(cut), pa.list_(pa.int64()))], names=["doc_id", own, "fp", "segments"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", own, F.col("text").cast("binary").alias("text")).mapInArrow(run, f"doc_id {kind}, {own} long, fp array<long>, segments array<long>")


def links(vertices: DataFrame, most: int, dense: int = 64) -> DataFrame:
    """Pairs ``(src, dst)`` of ``vertices(v, fp, segments)`` whose fingerprints differ in ``most`` bits or fewer.

    Multi-index hashing: the table has each fingerprint under its segments; a fingerprint looks up each segment's value,
    and the values with one more bit set, of which one of two values a bit apart reaches the other. Candidates carry 64 of
    their bits, which rules out nearly all that met by chance; complete distances decide. In a key that more than
    ``dense`` fingerprints share, each is held against LEADERS of them first, the least by as many hashes, which aggregates
    find before any row meets another. That joins most of a group of near copies by as many rows as it has; what it leaves
    apart is compared in full (``_apart``). So the components are those of all pairs that meet under a key, while of the
    pairs within a component of a crowded key only some are listed.
    """
    key = lambda x, i: F.shiftleft(i.cast("long"), SEGMENT).bitwiseOR(x)
    masks = F.array(*[F.lit(1 << i).cast("long") for i in range(SEGMENT)])
    # A value's own key is looked up from one side only, by the order of the pair below.
    flips = F.transform("segments", lambda x, i: F.transform(F.filter(masks, lambda m: x.bitwiseAND(m) == 0), lambda m: key(x.bitwiseOR(m), i)))
    base = vertices.select("v", F.element_at("fp", WORDS).alias("c"), "segments")
    table = base.select("v", "c", F.explode(F.transform("segments", key)).alias("key"))
    probes = base.select("v", "c", F.explode(F.flatten(flips)).alias("key"))
    crowd = table.groupBy("key").agg(F.count("*").alias("n"), *[F.min_by(F.struct("v", "c"), F.xxhash64("v", F.lit(j))).alias(f"l{j}") for j in range(LEADERS)])
    crowd = stored(crowd.where(F.col("n") > dense).select("key", F.array(*[f"l{j}" for j in range(LEADERS)]).alias("leaders")), "wide-crowded")
    near = F.bit_count(F.col("c").bitwiseXOR(F.col("d"))) <= SHORT

    def pairs(rows: DataFrame) -> DataFrame:
        return rows.where((F.col("v") != F.col("w")) & near).select(F.least("v", "w").alias("src"), F.greatest("v", "w").alias("dst"))

    none = crowd.isEmpty()
    keep = (lambda x: x) if none else (lambda x: x.join(crowd.select("key"), "key", "left_anti"))
    t, p = keep(table), keep(probes)
    other = t.select("key", F.col("v").alias("w"), F.col("c").alias("d"))
    found = pairs(t.join(other, "key").where("v < w")).unionByName(pairs(p.join(other, "key")))
    if not none:
        many = table.unionByName(probes).join(crowd, "key").select("v", "c", F.explode("leaders").alias("l"))
        found = found.unionByName(pairs(many.select("v", "c", F.col("l.v").alias("w"), F.col("l.c").alias("d"))))
    found = _verified(stored(found.distinct(), "wide-candidates"), vertices, most)
    if none:
        return found
    found = stored(found, "wide-links")
    return found.unionByName(_verified(_apart(table, probes, crowd.select("key"), found, near), vertices, most))


def _verified(pairs: DataFrame, vertices: DataFrame, most: int) -> DataFrame:
    """Of ``pairs(src, dst)``, those whose complete fingerprints differ in ``most`` bits or fewer."""
    a, b = (vertices.select(F.col("v").alias(end), F.col("fp").alias(f"_{end}")) for end in ("src", "dst"))
    bits = F.aggregate(F.zip_with("_src", "_dst", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    return pairs.join(a, "src").join(b, "dst").where(bits <= most).select("src", "dst")


def _apart(table: DataFrame, probes: DataFrame, crowd: DataFrame, found: DataFrame, near: Column) -> DataFrame:
    """Candidates ``(src, dst)`` of all pairs that meet under a crowded key and that the links ``found`` leave in two components.

    A key whose rows are all in one component is done. Of the others, each row outside the key's largest component meets the
    rows of the table there, and each row of the table outside it all rows; pairs within a component are passed over by the
    join itself. Both sides of a key are dealt into cells of ``CELL`` rows, so no task gets a whole one.
    """
    member = stored(connected_components(found, "wide-first"), "wide-first-members").withColumnsRenamed({"node": "v"})
    rows = table.withColumn("own", F.lit(True)).unionByName(probes.withColumn("own", F.lit(False)))
    rows = rows.join(crowd, "key", "left_semi").join(member, "v", "left").withColumn("component", F.coalesce("component", "v"))
    rows = stored(rows, "wide-crowd")
    sizes = rows.groupBy("key", "component").agg(F.count("*").alias("n"))
    left = sizes.groupBy("key").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.count("*").alias("components"), F.sum("n").alias("n"), F.max("n").alias("most"))
    across = lambda n: F.ceil(n / F.lit(CELL)).cast("int")
    left = left.where("components > 1").select("key", "main", across(F.col("n") - F.col("most")).alias("down"), across(F.col("n")).alias("along"))
    rows = rows.join(left, "key")
    place = lambda n: F.pmod(F.xxhash64("v", F.lit(7)), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    out = rows.where("component <> main").withColumn("i", place(F.col("down"))).select("key", "v", "c", "own", "component", "i", every(F.col("along")).alias("j"))
    all_ = rows.withColumn("j", place(F.col("along"))).select(
        "key", F.col("v").alias("w"), F.col("c").alias("d"), F.col("own").alias("theirs"), F.col("component").alias("other"), "j", every(F.col("down")).alias("i")
    )
    # Two flipped values that are equal are two bits apart, or met under their own.
    met = out.join(all_, ["key", "i", "j"]).where(F.col("own") | F.col("theirs")).where(F.col("component") != F.col("other")).where(near)
    return met.select(F.least("v", "w").alias("src"), F.greatest("v", "w").alias("dst")).distinct()


def keep_one(docs: DataFrame, similarity: float = 0.8, width: int = 5, dense: int = 64) -> DataFrame:
    """The rows of ``docs(doc_id, text, …)`` whose doc_id is the smallest of their group, columns as they are.

    Groups are the components of links between texts whose ``width``-word shingle sets have about ``similarity`` in common, as
    their fingerprints tell it (``distance_for``). Rows with one fingerprint share one vertex, so copies are never
    paired; fingerprints, links and components stay distributed.

    Defined results: rows without a doc_id stay; a row is judged by its own text: of two texts under one doc_id each goes only
    where it is itself near a document with a smaller id; rows that share the smallest doc_id all stay; null and blank
    texts are one group; repeated rows are judged alike; a text of any length is read whole; an empty table gives no
    rows; extra columns pass unchanged, whatever their names.
    """
    # A text's hash, made by the scan itself, tells the rows of a doc_id apart without keeping texts.
    own = fresh("_own", docs.columns)
    hashed = docs.withColumn(own, F.xxhash64(F.coalesce("text", F.lit(""))))
    marked = stored(fingerprints(hashed, width, own).withColumn("v", F.xxhash64("fp")), "wide-prints")
    vertices = stored(marked.groupBy("v").agg(F.min("doc_id").alias("low"), F.first("fp").alias("fp"), F.first("segments").alias("segments")), "wide-vertices")
    member = stored(connected_components(links(vertices.select("v", "fp", "segments"), distance_for(similarity), dense), "wide"), "wide-members")
    rooted = vertices.join(member, vertices.v == member.node, "left").select("v", "low", F.coalesce("component", "v").alias("root"))
    lows = rooted.groupBy("root").agg(F.min("low").alias("least"))
    found = marked.select("doc_id", own, "v").join(rooted.join(lows, "root").select("v", "least"), "v")
    gone = found.where(F.col("doc_id") != F.col("least")).select("doc_id", own).distinct()
    return hashed.join(gone, ["doc_id", own], "left_anti").select(docs.columns)
