"""Quality classifier by co-training a text-content view and a page-metadata view."""

from __future__ import annotations

import copy
import math
import warnings
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import discard, fresh, stored

#: Labelled documents that training looks at, at most (chosen by a hash of doc_id), and pseudo-labels that a view gives
#: a label and round, at most (the surest of all unlabelled documents).
LABELLED_ROWS, TAUGHT_ROWS = 6_000, 500
LEAST_LABELS = 5
#: What a pseudo-label weighs beside a label.
TRUST = 0.05
HASH_BITS = 20
CONTENT_WORDS, LEAST_DOCS = 800, 4
ROUNDS, CONFIDENT = 3, 0.97
EDGES = b".,;:!?\"'()[]*#$%&|<>-"
SYMBOLS = b"#*$%&|<>"
#: Bytes that go on with a character of UTF-8.
_CONTINUATION = bytes(range(0x80, 0xC0))
#: Documents below this combined score are rejected.
THRESHOLD = 0.5


def content_features(text: bytes) -> tuple[list[float], set[int]]:
    """What a whole text says: shape ratios of its words and marks, and the hashed set of its words (lower-cased, bare
    of edge marks)."""
    words = text.split()
    n, size = max(1, len(words)), max(1, len(text))
    distinct = set(text.lower().split())
    lines = [x for x in text.split(b"\n") if x.strip()]
    mask = (1 << HASH_BITS) - 1
    hashed = {zlib.crc32(w.strip(EDGES)) & mask for w in distinct}
    without = lambda marks: len(text) - len(text.translate(None, marks))
    shape = [
        math.log1p(len(words)),
        (len(text) - without(b" \t\n\x0b\f\r")) / n,
        len(distinct) / n,
        without(SYMBOLS) / n,
        without(b"!?") / n,
        without(b"0123456789") / size,
        without(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ") / size,
        (len(lines) - len(set(lines))) / max(1, len(lines)),
        math.log1p(n / max(1, len(lines))),
    ]
    return shape, hashed


def layout_features(text: bytes, n_chars: int | None) -> list[float]:
    """How a page is laid out, whatever its words: share of markup, the profile of its lines, share of characters
    beyond ASCII, and how far the declared length is from the actual one."""
    size = max(1, len(text))
    long = [len(x) for x in text.split(b"\n") if x.strip()] or [0]
    mean = sum(long) / len(long)
    actual = len(text.translate(None, _CONTINUATION))
    return [
        (len(text) - len(text.translate(None, SYMBOLS))) / size,
        math.log1p(len(long)),
        math.log1p(mean),
        math.log1p(max(long)),
        math.sqrt(sum((x - mean) ** 2 for x in long) / len(long)) / max(1.0, mean),
        (len(text) - actual) / size,
        0.0 if n_chars is None else float(abs(n_chars - actual) > 0.01 * max(1, actual)),
    ]


def metadata_features(lang: str | None, source: str | None, n_chars: int | None) -> list[str]:
    """Names of what a page's metadata shows: language, source, both, and its declared length in octaves."""
    length = "length=none" if n_chars is None else f"length={int(math.log2(max(1, n_chars)))}"
    return [f"lang={lang}", f"source={source}", f"both={lang}/{source}", length, f"{lang}/{length}"]


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float, steps: int = 250) -> tuple[np.ndarray, float]:
    """L2-penalised logistic regression by accelerated gradient steps; ``y`` in 0..1."""
    w, b = np.zeros(x.shape[1]), 0.0
    vw, vb, total = w.copy(), b, weight.sum()
    rate = 4.0 / (((x**2).sum(1) + 1).mean() * 2 + penalty * 4)
    for k in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ vw + vb, -35, 35)))
        g = weight * (p - y) / total
        nw, nb = vw - rate * (x.T @ g + penalty * vw), vb - rate * g.sum()
        vw, vb = nw + k / (k + 3) * (nw - w), nb + k / (k + 3) * (nb - b)
        w, b = nw, nb
    return w, b


class View:
    """Standardised features and a logistic model of one view."""

    def __init__(self, x: np.ndarray, penalty: float) -> None:
        self.mean, self.scale, self.penalty = x.mean(0), np.maximum(x.std(0), 1e-2), penalty
        self.w, self.b = np.zeros(x.shape[1]), 0.0

    def fit(self, x: np.ndarray, y: np.ndarray, trust: np.ndarray) -> None:
        # Both classes weigh the same in sum.
        weight = trust * np.where(y > 0.5, 0.5 / max(1e-9, trust[y > 0.5].sum()), 0.5 / max(1e-9, trust[y <= 0.5].sum()))
        self.w, self.b = fit_logistic((x - self.mean) / self.scale, y, weight, self.penalty)

    def margin(self, numbers: np.ndarray, starts: np.ndarray, ones: np.ndarray) -> np.ndarray:
        """Of rows given as ``numbers`` and the places of their ones, row i's from ``starts[i]``; a row's sum does not
        depend on the rows beside it."""
        c, s = self.w / self.scale, numbers.shape[1]
        row = np.repeat(np.arange(len(numbers)), np.diff(starts))
        return (numbers * c[:s]).sum(1) + np.bincount(row, c[s + ones], len(numbers)) + (self.b - self.mean @ c)


def calibrate(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Platt scaling with smoothed targets."""
    n1, n0 = y.sum(), len(y) - y.sum()
    target = np.where(y > 0.5, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    scale = max(1e-6, np.abs(margin).mean())
    w, b = fit_logistic((margin / scale)[:, None], target, np.ones(len(y)), 1e-4, 400)
    return float(w[0] / scale), float(b)


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


class Rows:
    """Features of rows in both views: numbers, and the places of ones, as flat arrays."""

    def __init__(self, numbers: list[np.ndarray], starts: list[np.ndarray], ones: list[np.ndarray]) -> None:
        self.numbers, self.starts, self.ones = numbers, starts, ones

    @classmethod
    def of(cls, batch: pa.RecordBatch | pa.Table) -> Rows:
        numbers, starts, ones = [], [], []
        for part in ("shape", "layout"):
            column = batch[part].combine_chunks() if isinstance(batch, pa.Table) else batch[part]
            width = WIDTHS[part]
            numbers.append(column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width))
        for part in ("words", "meta"):
            column = batch[part].combine_chunks() if isinstance(batch, pa.Table) else batch[part]
            ones.append(column.flatten().to_numpy(zero_copy_only=False).astype(np.int64))
            starts.append(np.concatenate(([0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False)))).astype(np.int64))
        return cls(numbers, starts, ones)

    def dense(self, view: int, width: int) -> np.ndarray:
        n, s = self.numbers[view].shape
        x = np.zeros((n, s + width))
        x[:, :s] = self.numbers[view]
        x[np.repeat(np.arange(n), np.diff(self.starts[view])), s + self.ones[view]] = 1
        return x


class Model:
    """The two views, their calibrations, and their combination, as plain arrays."""

    def __init__(self, columns: dict[int, int], names: dict[str, int]) -> None:
        self.columns, self.names = columns, names
        self.views: list[View] = []
        self.scaled: list[tuple[float, float]] = []
        self.both, self.bias = np.zeros(2), 0.0
        #: Pseudo-labels given: (round, view that is taught, signature, label, whether it kept the lesson).
        self.exchanged: list[tuple[int, int, int, float, bool]] = []
        #: Held-out accuracy before and after the exchange, and the weights of the views.
        self.report: dict[str, float] = {}

    def places(self, hashed: set[int], names: list[str]) -> tuple[list[int], list[int]]:
        """The places of a row's ones in both views."""
        words = sorted(self.columns.keys() & hashed if len(hashed) > len(self.columns) else (h for h in hashed if h in self.columns))
        return sorted(self.columns[h] for h in words), sorted(self.names[n] for n in names if n in self.names)

    def sure(self, rows: Rows, view: int) -> np.ndarray:
        """The view's calibrated probability that a row is good."""
        a, b = self.scaled[view]
        return sigmoid(a * self.views[view].margin(rows.numbers[view], rows.starts[view], rows.ones[view]) + b)

    def score(self, rows: Rows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated scores of the content view, the metadata view, and both."""
        z = [a * v.margin(rows.numbers[i], rows.starts[i], rows.ones[i]) + b for i, (v, (a, b)) in enumerate(zip(self.views, self.scaled))]
        return sigmoid(z[0]), sigmoid(z[1]), sigmoid(np.clip(z[0], -8, 8) * self.both[0] + np.clip(z[1], -8, 8) * self.both[1] + self.bias)

    def train(self, rows: Rows, y: np.ndarray, best: Callable[[Model, set[int]], pa.Table], rounds: int = ROUNDS) -> Model:
        """Fit both views on ``rows`` with labels ``y``; over rounds, ``best`` gives what each view is surest of among
        the unlabelled rows, which the other view learns from, unless that makes it worse on the labels held out.
        Then combine the calibrated views on those."""
        width = (len(self.columns), len(self.names))
        x = [rows.dense(v, width[v]) for v in (0, 1)]
        held = np.arange(len(y)) % 4 == 0
        self.views = [View(x[v], p) for v, p in ((0, 2e-3), (1, 2e-2))]
        learnt: list[list[tuple[np.ndarray, np.ndarray]]] = [[], []]

        def fitted(v: int, view: View, lessons: list[tuple[np.ndarray, np.ndarray]]) -> tuple[tuple[float, float], float]:
            """The view's calibration and its log loss on the labels held out."""
            own, given = int((~held).sum()), sum(len(b) for _, b in lessons)
            trust = np.concatenate((np.ones(own), np.full(given, TRUST)))
            view.fit(np.vstack([x[v][~held], *(a for a, _ in lessons)]), np.concatenate([y[~held], *(b for _, b in lessons)]), trust)
            margin = (x[v][held] - view.mean) / view.scale @ view.w + view.b
            a, b = calibrate(margin, y[held])
            p = np.clip(sigmoid(a * margin + b), 1e-12, 1 - 1e-12)
            return (a, b), float(-(y[held] * np.log(p) + (1 - y[held]) * np.log(1 - p)).mean())

        now = [fitted(v, self.views[v], []) for v in (0, 1)]
        self.scaled, taken = [c for c, _ in now], set()
        self._combine(x, y, held, "before")
        for turn in range(rounds):
            found = best(self, taken)
            given = Rows.of(found)
            sig, by, label = (found[c].to_numpy() for c in ("sig", "view", "label"))
            taken |= set(sig.tolist())
            for v in (0, 1):
                at = by == 1 - v  # what the other view is sure of
                if not at.any():
                    continue
                lesson = (given.dense(v, width[v])[at], label[at])
                other = copy.copy(self.views[v])
                tried = fitted(v, other, [*learnt[v], lesson])
                kept = tried[1] <= now[v][1]
                self.exchanged += [(turn, v, int(k), float(t), kept) for k, t in zip(sig[at], label[at])]
                if kept:
                    learnt[v].append(lesson)
                    self.views[v], now[v] = other, tried
            self.scaled = [c for c, _ in now]
        self._combine(x, y, held, "after")
        return self

    def _combine(self, x: list[np.ndarray], y: np.ndarray, held: np.ndarray, when: str) -> None:
        margins = [(x[v][held] - w.mean) / w.scale @ w.w + w.b for v, w in enumerate(self.views)]
        logits = np.clip(np.column_stack([a * m + b for m, (a, b) in zip(margins, self.scaled)]), -8, 8)
        both, self.bias = fit_logistic(logits, y[held], np.ones(int(held.sum())), 1e-3, 400)
        self.both = np.maximum(both, 0)
        self.report[f"held out, {when}"] = float(((logits @ self.both + self.bias > 0) == (y[held] > 0.5)).mean())
        for v, name in enumerate(("content", "metadata")):
            self.report[f"{name} alone, {when}"] = float(((logits[:, v] > 0) == (y[held] > 0.5)).mean())
            self.report[f"{name} weight, {when}"] = float(self.both[v])


WIDTHS = {"shape": 9, "layout": 7}
_FEATURES = {
    "sig": pa.int64(), "shape": pa.list_(pa.float64()), "layout": pa.list_(pa.float64()),
    "words": pa.list_(pa.int32()), "meta": pa.list_(pa.int32()),
}
_FEATURE_SCHEMA = "sig long, shape array<double>, layout array<double>, words array<int>, meta array<int>"


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Batches of few rows, so that a worker holds the words of few texts at once."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def encoded(batch: pa.RecordBatch, at: int, model: Model) -> pa.RecordBatch:
    """Features by the model's places of rows whose text, lang, source and n_chars are the columns from ``at`` on."""
    import xxhash

    made = []
    for t, lang, source, n in zip(*(batch.column(at + k).to_pylist() for k in range(4))):
        text = t or b""
        shape, hashed = content_features(text)
        words, meta = model.places(hashed, metadata_features(lang, source, n))
        layout = layout_features(text, n)
        sig = xxhash.xxh64_intdigest(np.array([*shape, *layout, -1, *words, -1, *meta], float).tobytes())
        made.append((sig - (1 << 64) if sig >> 63 else sig, shape, layout, words, meta))
    columns = list(zip(*made)) or [()] * len(_FEATURES)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _FEATURES.values())], names=list(_FEATURES))


def _good(labels: DataFrame) -> DataFrame:
    """``(doc_id, good)``: good if quality is 1 and not labelled toxic, in all of a document's labels."""
    return (
        labels.where("doc_id is not null and quality is not null")
        .groupBy("doc_id")
        .agg(((F.min("quality") > 0) & (F.max(F.coalesce("toxic", F.lit(0))) == 0)).alias("good"))
    )


def labelled_rows(docs: DataFrame, known: DataFrame, most: int) -> DataFrame:
    """``(order, shape, layout, hashes, names, good)`` of at most ``most`` labelled documents, chosen by a hash of doc_id."""
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = docs.join(F.broadcast(chosen), "doc_id").select("text", "lang", "source", "n_chars", F.xxhash64("doc_id", "text", "source").alias("order"), "good")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.list_(pa.float64()), pa.list_(pa.float64()), pa.list_(pa.int32()), pa.list_(pa.string())]
        for b in slices(batches):
            made = []
            for t, lang, source, n in zip(*(b.column(k).to_pylist() for k in range(4))):
                shape, hashed = content_features(t or b"")
                made.append((shape, layout_features(t or b"", n), sorted(hashed), metadata_features(lang, source, n)))
            columns = list(zip(*made)) or [()] * 4
            yield pa.RecordBatch.from_arrays(
                [b.column(4), *(pa.array(c, k) for c, k in zip(columns, kinds)), b.column(5)],
                names=["order", "shape", "layout", "hashes", "names", "good"],
            )

    return rows.mapInArrow(run, "order long, shape array<double>, layout array<double>, hashes array<int>, names array<string>, good boolean")


def vocabulary(rows: DataFrame, n0: int, n1: int) -> dict[int, int]:
    """The ``CONTENT_WORDS`` hashed words that tell good from bad most, counted where the rows are."""
    seen = rows.select("good", F.explode("hashes").alias("h")).groupBy("h").agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad"))
    good, bad = F.col("good") + 0.5, F.col("bad") + 0.5
    strength = F.abs(F.log((good / (n1 + 1)) / (bad / (n0 + 1)))) / F.sqrt(1 / good + 1 / bad)
    first = seen.where(F.col("good") + F.col("bad") >= LEAST_DOCS).orderBy(F.desc(F.round(strength, 9)), "h").limit(CONTENT_WORDS)
    return {r["h"]: j for j, r in enumerate(first.select("h").collect())}


def best_of(pool: DataFrame, model: Model, taken: set[int], most: int) -> pa.Table:
    """What each view is surest of in ``pool``: for each view and label the ``most`` rows of at least ``CONFIDENT``,
    surest first, then by signature. A task keeps that many of each, so no more reaches the last step a task."""
    held = pool.sparkSession.sparkContext.broadcast((model, taken))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, gone = held.value
        kept: dict[tuple[int, int], list] = {}
        for b in batches:
            rows, sig = Rows.of(b), b["sig"].to_numpy()
            free = np.array([k not in gone for k in sig.tolist()], bool)
            for v in (0, 1):
                p = np.round(m.sure(rows, v), 9)
                for label, sure in ((1, p), (0, np.round(1 - p, 9))):
                    at = np.flatnonzero(free & (sure >= CONFIDENT))
                    at = at[np.lexsort((sig[at], -sure[at]))][:most]
                    part = b.take(pa.array(at))
                    part = part.append_column("view", pa.array(np.full(len(at), v, np.int32))).append_column("label", pa.array(np.full(len(at), label, float)))
                    kept.setdefault((v, label), []).append(part.append_column("sure", pa.array(sure[at])))
                    if len(kept[v, label]) > 8:
                        kept[v, label] = [_surest(kept[v, label], most)]
        for parts in kept.values():
            yield _surest(parts, most)

    found = stored(pool.mapInArrow(run, _FEATURE_SCHEMA + ", view int, label double, sure double"), "quality-surest")
    out = None
    for v in (0, 1):
        for label in (1.0, 0.0):
            part = found.where((F.col("view") == v) & (F.col("label") == label)).orderBy(F.desc("sure"), "sig").limit(most)
            out = part if out is None else out.unionByName(part)
    table = out.toArrow()
    discard(found)
    # A row that both views, or one view for both labels, would give goes to where it is surest, the content view first.
    rank = np.lexsort((table["view"].to_numpy(), -table["sure"].to_numpy(), table["sig"].to_numpy()))
    sig = table["sig"].to_numpy()[rank]
    return table.take(pa.array(np.sort(rank[np.concatenate(([True], sig[1:] != sig[:-1]))]) if len(sig) else rank))


def _surest(parts: list[pa.RecordBatch], most: int) -> pa.RecordBatch:
    whole = pa.Table.from_batches(parts).combine_chunks()
    order = np.lexsort((whole["sig"].to_numpy(), -whole["sure"].to_numpy()))[:most]
    return whole.take(pa.array(order)).combine_chunks().to_batches()[0] if len(order) else parts[0].slice(0, 0)


def co_trained(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED_ROWS, taught: int = TAUGHT_ROWS) -> tuple[Model | None, DataFrame | None]:
    """The model, and the stored features of every row ``(doc_id, sig, …)``; None without labels of both kinds.

    Features of all documents are made in one scan and stored, about a tenth of the input; every round passes over
    those of all unlabelled documents, texts that are alike counted once.
    """
    docs = docs.withColumn("text", F.col("text").cast("binary"))
    known = _good(labels)
    sample = stored(labelled_rows(docs, known, labelled), "quality-labelled")
    counts = {r["good"]: r["count"] for r in sample.groupBy("good").count().collect()}
    if min(counts.get(True, 0), counts.get(False, 0)) < LEAST_LABELS:
        return None, None
    columns = vocabulary(sample, counts[False], counts[True])
    names = sorted(r["n"] for r in sample.select(F.explode("names").alias("n")).distinct().collect())
    model = Model(columns, {n: j for j, n in enumerate(names)})
    places = lambda source, known: F.array_sort(F.transform(F.filter(source, lambda x: known[x].isNotNull()), lambda x: known[x]))
    of_words = F.create_map(*[F.lit(x) for pair in columns.items() for x in pair]) if columns else F.create_map().cast("map<int,int>")
    of_names = F.create_map(*[F.lit(x) for pair in model.names.items() for x in pair])
    train = sample.select("order", "shape", "layout", places(F.col("hashes"), of_words).alias("words"), places(F.col("names"), of_names).alias("meta"), F.col("good").cast("double"))
    train = train.toArrow().combine_chunks()
    key = [tuple(r) for r in zip(train["order"].to_pylist(), train["good"].to_pylist(), map(tuple, train["shape"].to_pylist()))]
    train = train.take(pa.array(sorted(range(len(key)), key=key.__getitem__)))
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            made = encoded(b, 1, held.value)
            yield pa.RecordBatch.from_arrays([b.column(0), *made.columns], names=["doc_id", *_FEATURES])

    kind = docs.schema["doc_id"].dataType.simpleString()
    features = stored(docs.select(*_COLUMNS).mapInArrow(run, f"doc_id {kind}, {_FEATURE_SCHEMA}"), "quality-features", compression="zstd")
    pool = features.join(known.select("doc_id"), "doc_id", "left_anti").drop("doc_id").dropDuplicates(["sig"])
    pool = stored(pool, "quality-pool", compression="zstd")
    model.train(Rows.of(train), train["good"].to_numpy(), lambda m, taken: best_of(pool, m, taken, taught))
    discard(pool)
    discard(sample)
    return model, features


_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _with_columns(docs: DataFrame) -> DataFrame:
    have = {"lang": "string", "source": "string", "n_chars": "long"}
    return docs.select(
        "doc_id", "text", *[F.col(c).cast(t).alias(c) if c in docs.columns else F.lit(None).cast(t).alias(c) for c, t in have.items()]
    )


def scored(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **bounds: int) -> DataFrame:
    """``(doc_id, content_score, metadata_score, quality_score, kept)`` for every row of ``docs``.

    ``docs(doc_id, text, lang, source, n_chars)``; ``labels(doc_id, quality, toxic)``. A document is good if its
    quality is 1 and it is not labelled toxic. The content view sees shape ratios and the presence of the words
    that tell most; the metadata view sees language, source, declared length and the page's layout. Over a few rounds each view labels, among all unlabelled documents, those it is surest of for
    the other; both are then calibrated on held-out labels and combined there by a logistic model. Bounds:
    ``LABELLED_ROWS`` labelled documents, ``TAUGHT_ROWS`` pseudo-labels a view, label and round. Every document is
    scored by its whole text, read once.

    Defined results: null text counts as empty; a text of any length is read whole; a null doc_id is scored like any
    other; null or absent metadata are a value of their own; labels without both kinds at least ``LEAST_LABELS``
    times give a warning, leave the scores null and keep everything; a document labelled twice is good if all its
    labels are; ties of confidence are in the order of the features' hash; repeated rows come out once each; empty
    tables give no rows; extra columns are ignored.
    """
    model, features = co_trained(_with_columns(docs), labels, **bounds)
    kind = docs.schema["doc_id"].dataType.simpleString()
    if model is None:
        _untrained()
        nothing = [F.lit(None).cast("double").alias(c) for c in ("content_score", "metadata_score", "quality_score")]
        return docs.select("doc_id", *nothing, F.lit(True).alias("kept"))
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            content, page, both = held.value.score(Rows.of(b))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(content), pa.array(page), pa.array(both), pa.array(both >= threshold)],
                names=["doc_id", "content_score", "metadata_score", "quality_score", "kept"],
            )

    schema = f"doc_id {kind}, content_score double, metadata_score double, quality_score double, kept boolean"
    return features.mapInArrow(run, schema)


def _untrained() -> None:
    warnings.warn(f"under {LEAST_LABELS} labels of a kind: nothing is scored and every document is kept", stacklevel=3)


def good_only(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **bounds: int) -> DataFrame:
    """The rows of ``docs`` that ``scored`` keeps, with their columns as they are, by a second scan without a shuffle."""
    model, features = co_trained(_with_columns(docs), labels, **bounds)
    if model is None:
        _untrained()
        return docs
    discard(features)
    held, n = docs.sparkSession.sparkContext.broadcast(model), len(docs.columns)
    seen = {"lang": "string", "source": "string", "n_chars": "long"}
    inputs = [F.col("text").cast("binary"), *[F.col(c).cast(t) if c in docs.columns else F.lit(None).cast(t) for c, t in seen.items()]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            kept = b.filter(pa.array(held.value.score(Rows.of(encoded(b, n, held.value)))[2] >= threshold))
            yield pa.RecordBatch.from_arrays(kept.columns[:n], schema=pa.schema(list(b.schema)[:n]))

    return docs.select("*", *[c.alias(fresh(f"_view_{i}", docs.columns)) for i, c in enumerate(inputs)]).mapInArrow(run, docs.schema)
