"""Packing documents into token sequences through a configuration linear program."""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import chain, compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window as W, functions as F

from .common import stored

CAPACITY = 2048
#: Words from which a worker's young generation of remembered words is full.
REMEMBERED_WORDS = 300_000
#: Bytes of text whose words are looked up together, and words that the tokenizer is handed at once.
TOGETHER, ENCODED_WORDS = 1 << 22, 4096
#: Share of a size's pieces that the linear program may leave to the filling.
COVER_ERROR = 0.02
RANK_BITS = 44
MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Small letters of ASCII and Latin-1, which normal form and lower case leave as they are.
LETTERS = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+").fullmatch

_loaded: dict[str, "WordIds"] = {}


class WordIds:
    """Token ids of white-space-delimited words as little-endian 32-bit bytes.

    The tokenizer drops white space and never joins what white space separates, so a text's ids are those of its
    words in turn. Only ASCII white space splits here; the tokenizer itself splits at the rest. Words are
    remembered in two generations: when the young one is full it becomes the old one, whose words come back as they
    are met, so frequent words stay and memory is bounded.
    """

    MARK = "|"

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers as pre

        self.tokenizer, self.known, self.old = Tokenizer.from_file(path), {}, {}
        self.mark = self._encode(self.tokenizer, self.MARK)
        # The same merges without normal form and pattern, which leave words of small letters as they are.
        self.letters = Tokenizer.from_file(path)
        self.letters.normalizer = None
        self.letters.pre_tokenizer = pre.Sequence([pre.WhitespaceSplit(), pre.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    @staticmethod
    def _encode(tokenizer, text: str) -> bytes:
        return array("I", tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids).tobytes()

    @staticmethod
    def _cut(ids: bytes, ends: np.ndarray, gap: int = 0) -> Iterator[bytes]:
        """``ids`` up to each of the places ``ends``; the next part begins ``gap`` ids after it."""
        ends = 4 * ends
        return map(ids.__getitem__, map(slice, [0, *(ends[:-1] + 4 * gap).tolist()], ends.tolist()))

    def _encode_words(self, words: Iterable[bytes]) -> dict[bytes, bytes]:
        """Words are encoded as one text. Words of small letters have one id that ends a word; the others are parted
        by a mark whose id only a word that holds the mark itself could yield; such words go one by one."""
        simple, plain, made = [], [], {}
        for w in words:
            (simple if LETTERS(w) else plain).append(w)
        for at in range(0, len(simple), ENCODED_WORDS):
            part = simple[at : at + ENCODED_WORDS]
            ids = self._encode(self.letters, b" ".join(part).decode())
            made.update(zip(part, self._cut(ids, np.flatnonzero(self.ends[np.frombuffer(ids, "<u4")]) + 1)))
        made.update((w, self._encode(self.tokenizer, w.decode())) for w in plain if b"|" in w)
        plain = [w for w in plain if b"|" not in w]
        for at in range(0, len(plain), ENCODED_WORDS):
            part = plain[at : at + ENCODED_WORDS]
            ids = self._encode(self.tokenizer, b" | ".join(part).decode())
            found = np.frombuffer(ids, "<u4")
            marks = np.flatnonzero(found == np.frombuffer(self.mark, "<u4")[0])
            made.update(zip(part, self._cut(ids, np.append(marks, len(found)), 1)))
        return made

    def _learn(self, words: list[bytes], plain: bool) -> dict[bytes, bytes]:
        """The ids of different words that are not known, remembered from now on. A plain word whose marks follow a
        small letter is its stem's ids and theirs: the tokenizer keeps them apart."""
        known, old = self.known, self.old
        made = {w: old[w] for w in words if w in old} if old else {}
        new = [w for w in words if w not in made] if made else words
        if plain:
            stems = [w.rstrip(MARKS) for w in new]
            cut = [bool(s) and 97 <= s[-1] <= 122 and len(s) < len(w) for w, s in zip(new, stems)]
            marked, stems = list(compress(new, cut)), list(compress(stems, cut))
            tails = [w[len(s) :] for w, s in zip(marked, stems)]
            whole = {x for x in chain(stems, set(tails)) if x not in known}
            whole.update(w for w, c in zip(new, cut) if not c)
            made.update(self._encode_words(whole))
            known.update(made)
            made.update(zip(marked, [known[s] + known[t] for s, t in zip(stems, tails)]))
        else:
            made.update(self._encode_words(new))
        known.update(made)
        return made

    def _ids(self, texts: pa.Array, plain: bool, end: bytes) -> tuple[bytes, np.ndarray]:
        """The ids of all texts in turn, each followed by ``end``, and where each text's ids stop, in bytes."""
        if len(self.known) > REMEMBERED_WORDS:
            self.known, self.old = {}, self.known
        texts = texts.view(pa.string())
        lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if plain else texts)
        coded = lists.flatten().dictionary_encode()
        words = coded.dictionary.view(pa.binary()).to_numpy(zero_copy_only=False).tolist()
        found = list(map(self.known.get, words))
        missing = [w for w, x in zip(words, found) if x is None]
        if missing:
            made = self._learn(missing, plain)
            found = [made[w] if x is None else x for w, x in zip(words, found)]
        found.append(end)
        flat = np.frombuffer(b"".join(found), "<u4")
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        start = np.cumsum(size) - size
        ends = np.cumsum(pc.list_value_length(lists).to_numpy())
        at = np.insert(coded.indices.to_numpy(), ends, len(words))  # each text's words, then the end
        del texts, lists, coded, words, found
        size, start = size[at], start[at]
        until = np.cumsum(size)
        start -= until - size
        at = np.repeat(start, size)
        at += np.arange(len(at))
        return flat[at].tobytes(), 4 * until[ends + np.arange(len(ends))]

    def ids(self, text: bytes) -> bytes:
        return next(self.each(pa.array([text], pa.binary())))

    def each(self, texts: pa.Array, end: bytes = b"") -> Iterator[bytes]:
        """The ids of each text, followed by ``end``. A text is lower-cased first unless it could hold a special
        token's name, or marks that combine with a letter, where lower case before the tokenizer's own normal form
        might change the ids."""
        size = np.cumsum(pc.binary_length(texts).to_numpy()) // TOGETHER
        cuts = [0, *(np.flatnonzero(size[1:] != size[:-1]) + 1).tolist(), len(texts)]
        for at, z in zip(cuts, cuts[1:]):
            part = texts.slice(at, z - at)
            odd = [any(x in t for x in (b"<|", b"\xcc", b"\xcd")) for t in part.to_pylist()]
            turns = {}
            for kind in set(odd):
                made, until = self._ids(part.filter(pa.array(odd if kind else [not x for x in odd])), not kind, end)
                turns[kind] = map(made.__getitem__, map(slice, [0, *until[:-1].tolist()], until.tolist()))
            for kind in odd:
                yield next(turns[kind])
            pa.default_memory_pool().release_unused()


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32, ids)`` of every row of ``docs(doc_id, text)``; ids as 32-bit bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _loaded.get(tokenizer) or _loaded.setdefault(tokenizer, WordIds(tokenizer))
        end = np.array([end_id], "<u4").tobytes()
        for b in batches:
            at, rows = [], []
            for i, ids in enumerate(words.each(b.column(1), end)):
                for start in range(0, len(ids), 4 * capacity):
                    part = ids[start : start + 4 * capacity]
                    at.append(i)
                    rows.append((start // (4 * capacity), start // 4, len(part) // 4, zlib.crc32(part), part))
            columns = list(zip(*rows)) or [()] * 5
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, k) for c, k in zip(columns, kinds))],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, ids binary"
    return docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text")).mapInArrow(run, schema)


def knapsack(sizes: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unbounded knapsack by dynamic programming: the highest total price in each space up to ``capacity``, the
    size put in last (-1: none), and how many of the sizes fit."""
    value, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    fits = np.searchsorted(sizes, np.arange(capacity + 1), "right")
    for c in range(1, capacity + 1):
        k = fits[c]
        if k:
            got = value[c - sizes[:k]] + prices[:k]
            best = int(got.argmax())
            value[c], last[c] = got[best], best
    return value, last, fits


def best_configuration(sizes: np.ndarray, prices: np.ndarray, capacity: int) -> Counter:
    """The multiset of sizes of the highest total price that fits."""
    _, last, _ = knapsack(sizes, prices, capacity)
    found, c = Counter(), capacity
    while last[c] >= 0:
        found[int(sizes[last[c]])] += 1
        c -= int(sizes[last[c]])
    return found


def configuration_lp(
    counts: dict[int, int], capacity: int, rounds: int = 1200, step: float = 0.125, rate: float = 0.5, error: float = COVER_ERROR
) -> list[tuple[Counter, float]]:
    """A fractional cover of the pieces by few full configurations: ``[(sizes, times)]``.

    Multiplicative weights: a size's weight starts at the tokens it holds and falls as it is served, so a piece is
    priced at its length times exp(-``rate`` x how far its size is served beyond the average), whether the size
    is rare or common. The least served size leads: the rest of its sequence is the configuration of the highest
    price, of several such the one whose sizes lack most, used until a size has gained ``step`` of its count or is
    served in full. Nothing is served beyond its count. ``rounds`` is how often the knapsack is solved anew, not
    when to stop: that is when every size is covered but for ``error`` of its count.
    """
    sizes = np.array(sorted(counts))
    need = np.array([counts[s] for s in sizes], float)
    served, uses = np.zeros(len(sizes)), {}
    every, turn = max(1, int(len(sizes) / step / max(1, rounds))), 0
    while (served < 1 - error - 1e-9).any():
        wanting = served < 1 - 1e-9
        if turn % every == 0:
            average = float(served @ (need * sizes)) / float(need @ sizes)
            prices = sizes * np.exp(-rate * (served - average))
            value, _, fits = knapsack(sizes, np.where(wanting, prices, 0.0), capacity)
        turn += 1
        room = np.where(wanting, np.minimum(step, 1 - served) * need, 0.0)
        lead = int(served.argmin())
        taken, space = np.zeros(len(sizes)), capacity - sizes[lead]
        taken[lead] = 1
        while k := fits[space]:
            got = np.where(wanting[:k], value[space - sizes[:k]] + prices[:k], -1.0)
            if (top := got.max()) < 0:
                break
            best = np.flatnonzero(got >= top * (1 - 1e-12))
            pick = int(best[(room[best] / (taken[best] + 1)).argmax()])
            taken[pick] += 1
            space -= sizes[pick]
        at = np.flatnonzero(taken)
        times = float((room[at] / taken[at]).min())
        served[at] += times * taken[at] / need[at]
        key = tuple(zip(sizes[at].tolist(), taken[at].astype(int).tolist()))
        uses[key] = uses.get(key, 0.0) + times
    return [(Counter(dict(k)), v) for k, v in uses.items()]


def plan(counts: dict[int, int], capacity: int = CAPACITY, rounds: int = 1200) -> list[tuple[Counter, int]]:
    """Integral configurations that hold every piece once: ``[(sizes, times)]``.

    Full pieces stand alone. The linear program's uses are rounded down; what that and the program's stated error
    leave, a share that shrinks as counts grow, is filled largest piece first, each time with the largest pieces
    that still fit, and used as often as the counts allow.
    """
    left = {s: n for s, n in counts.items() if n and s != capacity}
    made = [(Counter({capacity: 1}), counts[capacity])] if counts.get(capacity) else []
    if left:
        for config, times in sorted(configuration_lp(left, capacity, rounds), key=lambda x: -x[1]):
            whole = min([int(times + 1e-6), *(left.get(s, 0) // k for s, k in config.items())])
            if whole:
                _use(config, whole, left, made)
    _fill(left, capacity, made)
    return made


def _use(config: Counter, times: int, left: dict[int, int], made: list[tuple[Counter, int]]) -> None:
    made.append((config, times))
    for s, k in config.items():
        left[s] -= k * times
        if not left[s]:
            del left[s]


def _fill(left: dict[int, int], capacity: int, made: list[tuple[Counter, int]]) -> None:
    while left:
        config, space = Counter(), capacity
        for s in sorted(left, reverse=True):
            k = min(left[s], space // s)
            if k:
                config[s], space = k, space - k * s
        _use(config, min(left[s] // k for s, k in config.items()), left, made)


def segments(configs: list[tuple[Counter, int]]) -> dict[str, np.ndarray]:
    """Where the r-th piece of each size goes, as arrays sorted by size and first rank: a few rows a configuration."""
    rows, used, base = [], Counter(), 0
    for config, times in configs:
        offset = 0
        for s, k in sorted(config.items(), reverse=True):
            rows.append(((s << RANK_BITS) | used[s], used[s], base, k, offset))
            used[s] += k * times
            offset += k * s
        base += times
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return dict(zip(("key", "first", "base", "each", "offset"), table.T))


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, rounds: int = 1200, cells: int = 1024, keep_ids: bool = False) -> DataFrame:
    """Place every piece of every document: ``(doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset)``.

    The histogram of lengths (at most ``capacity`` rows) goes to the driver, which solves the configuration
    program on it; what comes back is a table of rank ranges, a few rows a configuration. Pieces get their rank
    among those of equal length in two levels, by ``cells`` hash cells a length, so a length that a third of
    all pieces share is not ranked by one task. Text is read once; shuffles carry piece records only.

    Defined results: a null text is an empty one, whose single token is the end id; documents of more than
    ``capacity`` tokens are cut, and nothing else is; repeated rows and equal texts are placed once each; an
    empty table gives no rows; extra columns are ignored.
    """
    spark = docs.sparkSession
    cut = pieces(docs, tokenizer, capacity)
    cut = cut if keep_ids else cut.drop("ids")
    cut = stored(cut.withColumn("cell", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(cells))), "pack-pieces")
    cell_counts = cut.groupBy("length", "cell").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in cell_counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    where = spark.sparkContext.broadcast(segments(plan(counts, capacity, rounds)))
    befores = cell_counts.select(
        "length", "cell", (F.sum("n").over(W.partitionBy("length").orderBy("cell")) - F.col("n")).alias("before")
    )
    order = W.partitionBy("length", "cell").orderBy("doc_id", "piece", "ids_crc32")
    ranked = (
        cut.withColumn("rn", F.row_number().over(order))
        .join(befores, ["length", "cell"])
        .withColumn("rank", F.col("before") + F.col("rn") - 1)
        .drop("before", "rn", "cell")
    )
    names = [c for c in cut.columns if c != "cell"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seg = where.value
        for b in batches:
            length = b.column(names.index("length")).to_numpy()
            rank = b.column(len(names)).to_numpy()
            i = np.searchsorted(seg["key"], (length << RANK_BITS) | rank, "right") - 1
            turn = rank - seg["first"][i]
            sequence = seg["base"][i] + turn // seg["each"][i]
            offset = seg["offset"][i] + turn % seg["each"][i] * length
            yield pa.RecordBatch.from_arrays(
                [*(b.column(k) for k in range(len(names))), pa.array(sequence), pa.array(offset)],
                names=[*names, "sequence_id", "offset"],
            )

    kinds = dict(cut.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in names) + ", sequence_id long, offset long"
    return ranked.select(*names, "rank").mapInArrow(place, schema)
