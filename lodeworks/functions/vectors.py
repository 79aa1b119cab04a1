"""Dense-vector expressions over arrays, accumulated in double precision."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from .text import let

BUCKETS = 256
#: Texts whose different words are hashed at once.
TOGETHER = 1024


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def normalized(v: Column) -> Column:
    """``v`` at unit length; a zero vector stays zero."""
    norm = F.sqrt(dot(v, v))
    return let(norm, lambda n: F.transform(v, lambda x: x.cast("double") / F.when(n == 0, F.lit(1.0)).otherwise(n)))


def embedded_words(text: Column) -> Column:
    return F.filter(F.split(F.replace(F.lower(text), F.lit("_"), F.lit(" ")), "\\s+"), lambda w: w != "")


def hash_embedding(text: Column, buckets: int = BUCKETS) -> Column:
    """A deterministic embedding: words counted in the bucket of their MD5 modulo 256, at unit length."""
    if buckets != 256:
        raise ValueError("a bucket is the last byte of the MD5")
    words = embedded_words(text)
    # A word is twice its bucket; one odd mark a bucket is sorted in among them. Mark b has b marks before it, so its
    # place tells how many words lie in the buckets up to b.
    hashed = F.transform(words, lambda w: F.conv(F.substring(F.md5(w), -2, 2), 16, 10).cast("int") * 2)
    marks = F.array(*[F.lit(2 * b + 1) for b in range(buckets)])
    places = lambda s: F.filter(F.transform(s, lambda x, i: F.when(x % 2 == 1, i)), lambda i: i.isNotNull())
    upto = lambda p: F.transform(p, lambda x, b: x - b)
    counts = lambda n: F.transform(n, lambda x, b: (x - F.when(b > 0, F.get(n, b - 1)).otherwise(0)).cast("double"))
    return let(let(let(F.array_sort(F.concat(hashed, marks)), places), upto), lambda n: let(counts(n), normalized))


def hash_embeddings(rows: DataFrame, key: str, text: Column, out: str) -> DataFrame:
    """``(key, out)``: the ``hash_embedding`` of every text of a large table, to the bit. A word that several texts share is
    hashed once for ``TOGETHER`` texts."""
    kind = rows.select(key).dtypes[0][1]

    def embed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for at in range(0, batch.num_rows, TOGETHER):
                keys, words = batch.slice(at, TOGETHER).columns
                sizes, word = pc.list_value_length(words), words.flatten().dictionary_encode()
                bucket = np.array([hashlib.md5(w).digest()[-1] for w in word.dictionary.cast(pa.binary()).to_pylist()], np.int64)
                text_of = np.repeat(np.arange(len(keys)), sizes.fill_null(0).to_numpy(zero_copy_only=False))
                counts = np.bincount(text_of * BUCKETS + bucket[word.indices.to_numpy(zero_copy_only=False)], minlength=len(keys) * BUCKETS)
                counts = counts.reshape(-1, BUCKETS).astype(np.float64)
                norm = np.sqrt((counts * counts).sum(axis=1, keepdims=True))
                ends = pa.array(np.arange(len(keys) + 1) * BUCKETS, pa.int32())
                unit = pa.array((counts / np.where(norm == 0, 1.0, norm)).ravel())
                yield pa.RecordBatch.from_arrays([keys, pa.ListArray.from_arrays(ends, unit, mask=sizes.is_null())], names=[key, out])

    return rows.select(key, embedded_words(text).alias("_w")).mapInArrow(embed, f"{key} {kind}, {out} array<double>")
