"""Benchmark decontamination: pigeonhole pieces, exact hits, Myers bit-parallel verification."""

from __future__ import annotations

import uuid
from collections import OrderedDict
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: Share of an item's characters that may be edited.
ERROR_RATE = 0.1
#: Characters of benchmark text that are searched at once, and bytes of documents that a task holds against one such
#: block after the other where there are several.
BLOCK_CHARS, HELD_BYTES = 1_000_000, 64 << 20
GRAM = 4

_searchers: "OrderedDict[str, Searcher]" = OrderedDict()


def normal(text: str | None) -> str:
    """Lower case, runs of white space as one space."""
    return " ".join((text or "").lower().split())


def masks(pattern: str) -> dict[str, int]:
    found: dict[str, int] = {}
    for i, c in enumerate(pattern):
        found[c] = found.get(c, 0) | 1 << i
    return found


def distances(pattern_masks: dict[str, int], size: int, text: str, anchored: bool = False) -> Iterator[int]:
    """Myers: after each character of ``text``, the least edit distance of the pattern to a substring ending there.

    ``anchored`` makes the substring begin where the text begins. One Python integer holds a whole column.
    """
    full, high = (1 << size) - 1, 1 << size >> 1
    up, down, score, first = full, 0, size, int(anchored)
    for c in text:
        eq = pattern_masks.get(c, 0)
        vertical = eq | down
        across = (((eq & up) + up) ^ up) | eq
        plus = down | full & ~(across | up)
        minus = up & across
        if plus & high:
            score += 1
        elif minus & high:
            score -= 1
        plus = (plus << 1 | first) & full
        minus = (minus << 1) & full
        up = minus | full & ~(vertical | plus)
        down = plus & vertical
        yield score


class Item:
    def __init__(self, item_id, text: str, rate: float) -> None:
        self.id, self.text, self.errors = item_id, text, int(len(text) * rate)
        self.masks, self.backward = masks(text), masks(text[::-1])
        self.grams = {text[i : i + GRAM] for i in range(len(text) - GRAM + 1)}
        #: An occurrence with that many errors keeps at least so many of the item's grams.
        self.least = len(text) - GRAM + 1 - GRAM * self.errors

    def pieces(self) -> Iterator[tuple[int, str]]:
        n, k = len(self.text), self.errors + 1
        for j in range(k):
            yield j * n // k, self.text[j * n // k : (j + 1) * n // k]

    def best(self, text: str, low: int, high: int) -> tuple[int, int, int] | None:
        """The nearest occurrence in ``text[low:high]`` within the budget: (distance, start, end)."""
        if self.least > 0:
            grams, window = self.grams, text[low:high]
            if sum(window[i : i + GRAM] in grams for i in range(len(window) - GRAM + 1)) < self.least:
                return None
        found = min(((d, i) for i, d in enumerate(distances(self.masks, len(self.text), text[low:high]))), default=None)
        if found is None or found[0] > self.errors:
            return None
        least, end = found[0], low + found[1] + 1
        back = text[max(low, end - len(self.text) - least) : end][::-1]
        size = next(
            (j for j, d in enumerate(distances(self.backward, len(self.text), back, anchored=True), 1) if d == least), len(back)
        )
        return least, end - size, end


class Searcher:
    """All items of a block: an automaton of their pieces, and the verification of its hits."""

    def __init__(self, items: list[tuple], rate: float) -> None:
        import ahocorasick

        self.items = [Item(i, t, rate) for i, t in items]
        where: dict[str, list[tuple[int, int]]] = {}
        for k, item in enumerate(self.items):
            for at, piece in item.pieces():
                where.setdefault(piece, []).append((k, at))
        self.machine = ahocorasick.Automaton()
        for piece, spots in where.items():
            self.machine.add_word(piece, (len(piece), spots))
        if where:
            self.machine.make_automaton()

    def hits(self, text: str) -> dict[int, list[int]]:
        """For each item, where it would begin if a piece hit belonged to it."""
        found: dict[int, list[int]] = {}
        if self.items:
            for end, (size, spots) in self.machine.iter(text):
                for k, at in spots:
                    found.setdefault(k, []).append(end + 1 - size - at)
        return found

    def search(self, text: str) -> Iterator[tuple]:
        """``(item_id, distance, start, end)``: the nearest occurrence of each item that occurs within its budget."""
        for k, begins in sorted(self.hits(text).items()):
            item, best = self.items[k], None
            begins.sort()
            i = 0
            while i < len(begins) and (best is None or best[0]):
                j = i
                while j + 1 < len(begins) and begins[j + 1] - begins[i] <= item.errors:
                    j += 1
                low = max(0, begins[i] - item.errors)
                got = item.best(text, low, begins[j] + len(item.text) + item.errors)
                best = min(filter(None, (best, got)), default=None)
                i = j + 1
            if best:
                yield (item.id, *best)


def _searcher(name: str, items: list[tuple], rate: float) -> Searcher:
    if name not in _searchers:
        while len(_searchers) >= 2:
            _searchers.popitem(last=False)
        _searchers[name] = Searcher(items, rate)
    return _searchers[name]


def _blocks(benchmark: DataFrame, block_chars: int) -> Iterator[list[tuple]]:
    """The benchmark's non-blank items in blocks of bounded size; one block is on the driver at a time."""
    items = benchmark.select("item_id", "text").where(F.length(F.trim("text")) > 0)
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-total // block_chars) or 1
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    for k in range(n):
        rows = [(r["item_id"], normal(r["text"])) for r in items.where(block == k).collect()]
        yield [r for r in rows if r[1]]


def contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Which items of ``benchmark(item_id, text)`` occur in which rows of ``docs(doc_id, text)``.

    Returns ``(doc_id, item_id, distance, start, end)``: the nearest occurrence of each item in each row, in
    characters of the lower-cased text with white space runs as one space. An item of n characters may differ by
    ``rate * n`` edits: cut into one piece more than that, it keeps a piece whole, so exact hits of pieces lead to all
    occurrences; each hit's surroundings are verified by Myers' bit-parallel distance. Before that, surroundings
    that share too few 4-grams with the item for any such occurrence are passed over, which loses none.

    The documents are scanned once; nothing is shuffled. A benchmark of over ``block_chars`` characters goes to the tasks
    in blocks of that size, and a task holds up to ``HELD_BYTES`` of text against one block after the other.

    Defined results: null and blank texts, on either side, match nothing; texts of any length are searched whole; of
    equally near occurrences the first counts; an item shorter than 1 / rate characters
    must occur exactly; rows that are repeated, on either side, match each on their own; a null doc_id or item_id
    is passed on; empty tables give no rows; extra columns are ignored.
    """
    kinds = [docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()]
    item_type = to_arrow_type(benchmark.schema["item_id"].dataType)
    blocks = _sent(docs, benchmark, block_chars)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, found in _found(batches, 1, blocks, rate):
            at = [i for i, rows in enumerate(found) for _ in rows]
            columns = list(zip(*(row for rows in found for row in rows))) or [()] * 4
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(at, pa.int64())), pa.array(columns[0], item_type), *(pa.array(c, pa.int32()) for c in columns[1:])],
                names=["doc_id", "item_id", "distance", "start", "end"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kinds[0]}, item_id {kinds[1]}, distance int, start int, end int")


def _sent(docs: DataFrame, benchmark: DataFrame, block_chars: int) -> list[tuple]:
    """Each block of the benchmark as a broadcast, with a name of its own."""
    context = docs.sparkSession.sparkContext
    return [(context.broadcast(items), uuid.uuid4().hex) for items in _blocks(benchmark, block_chars)]


def _found(batches: Iterator[pa.RecordBatch], at: int, blocks: list[tuple], rate: float, first: bool = False) -> Iterator[tuple[pa.RecordBatch, list[list]]]:
    """Batches with what is found in the text (column ``at``) of each row; ``first``: the first item only."""

    def searched(held: list[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[list]]]:
        found = [[[] for _ in range(b.num_rows)] for b in held]
        for sent, name in blocks:
            search = _searcher(name, sent.value, rate).search
            for b, rows in zip(held, found):
                for t, row in zip(b.column(at), rows):
                    if not (first and row):
                        row.extend(islice(search(normal(t.as_py())), 1 if first else None))
        yield from zip(held, found)

    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.nbytes
        if len(blocks) == 1 or size >= HELD_BYTES:
            yield from searched(held)
            held, size = [], 0
    if held:
        yield from searched(held)


def decontaminated(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs`` in which no item occurs, by the rules of ``contaminated``; columns pass unchanged."""
    at, blocks = docs.columns.index("text"), _sent(docs, benchmark, block_chars)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, found in _found(batches, at, blocks, rate, first=True):
            yield b.filter(pa.array([not rows for rows in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
