"""Quality rules: decision lists learned from labelled statistics, applied as Spark conditional expressions."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .common import SPACE

#: Labelled documents that the list is learned from at most: a documented bound on what the driver holds.
SAMPLE_ROWS = 4_000
SYMBOLS = "#*$%&|<>"
FAILED_WORDS, FAILED_SHARE = 50, 50

#: Ratios that conditions may test, as SQL over the statistics; n_words is at least 1 there.
FEATURES = {
    "n_words": "n_words",
    "mean_word_chars": "word_chars / n_words",
    "symbols_per_word": "n_symbols / n_words",
    "dup_line_share": "n_dup_lines / n_lines",
    "repeat_word_share": "n_repeat_words / n_words",
    "upper_share": "n_upper / word_chars",
    "digit_share": "n_digits / word_chars",
    "mark_share": "n_marks / word_chars",
    "words_per_line": "n_words / n_lines",
}


def _without(text: Column, characters: str) -> Column:
    for c in characters:
        text = F.replace(text, F.lit(c))
    return text


def _count_of(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(_without(text, characters))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once: the plan may copy or push down what surrounds it freely."""
    return F.get(F.transform(F.array(value), lambda x: use(x)), F.lit(0))


def _windows(words: Column, n: Column) -> Column:
    return F.transform(
        F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))
    )


def _repeated_starts(ordered: Column) -> Column:
    """From sorted (hash, place) pairs, the places whose hash a neighbour shares, in text order."""

    def mark(x: Column, k: Column) -> Column:
        left = F.coalesce(F.get(ordered, k - 1)["h"] == x["h"], F.lit(False))
        return F.when(left | F.coalesce(F.get(ordered, k + 1)["h"] == x["h"], F.lit(False)), x["i"])

    return F.sort_array(F.array_compact(F.transform(ordered, mark)))


def _covered(starts: Column) -> Column:
    """Words under windows of three that begin at the given places."""
    step = F.transform(starts, lambda x, k: F.least(F.coalesce(F.get(starts, k + 1) - x, F.lit(3)), F.lit(3)))
    return F.aggregate(step, F.lit(0), lambda total, x: total + x)


def repeat_words(words: Column) -> Column:
    """How many words lie in a 3-word window found twice or more, the first included."""
    pairs = lambda g: F.array_sort(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    of_windows = lambda g: F.when(
        F.size(F.array_distinct(g)) < F.size(g), _let(pairs(g), lambda s: _let(_repeated_starts(s), _covered))
    ).otherwise(F.lit(0))
    return F.when(F.size(words) >= 4, _let(_windows(words, F.size(words)), of_windows)).otherwise(F.lit(0))


def statistics(docs: DataFrame, *others: str) -> DataFrame:
    """The statistics of every whole text of ``docs(doc_id, text)``, one row each, by DataFrame functions only.

    Words are runs of anything but space and \\x09-\\x0D. n_repeat_words counts the words that lie in a 3-word
    window found twice or more in the text, the first included. Windows are compared by 64-bit hashes of their
    words. A text without two equal windows ends after a hash-set pass; the others sort (hash, place) pairs
    within the row. Nothing is shuffled.
    """
    text = F.coalesce("text", F.lit(""))
    words = F.filter(F.split(text, "[ \\t\\n\\x0B\\f\\r]+"), lambda x: x != "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(_without(x, SPACE)) > 0)
    counted = F.struct(
        _let(words, lambda w: F.struct(F.size(w).alias("n"), repeat_words(w).alias("repeat"))).alias("w"),
        _let(lines, lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("kinds"))).alias("l"),
        _let(
            _without(text, SPACE),
            lambda x: F.struct(
                F.length(x).alias("n"),
                _count_of(x, SYMBOLS).alias("symbols"),
                F.regexp_count(x, F.lit("\\p{Lu}")).alias("upper"),
                F.regexp_count(x, F.lit("[0-9]")).alias("digits"),
                _count_of(x, "!?").alias("marks"),
            ),
        ).alias("c"),
    )
    whole = lambda sql: F.expr(f"cast({sql} as bigint)")
    return docs.select("doc_id", *others, counted.alias("_s")).select(
        "doc_id",
        *others,
        whole("_s.w.n").alias("n_words"),
        whole("_s.c.n").alias("word_chars"),
        whole("_s.c.symbols").alias("n_symbols"),
        whole("_s.l.n - _s.l.kinds").alias("n_dup_lines"),
        whole("_s.w.repeat").alias("n_repeat_words"),
        whole("greatest(_s.l.n, 1)").alias("n_lines"),
        whole("_s.c.upper").alias("n_upper"),
        whole("_s.c.digits").alias("n_digits"),
        whole("_s.c.marks").alias("n_marks"),
    )


def failed() -> Column:
    """The fixed base rule: under 50 words, or over half of the words in repeated windows."""
    return (F.col("n_words") < FAILED_WORDS) | (100 * F.col("n_repeat_words") > FAILED_SHARE * F.col("n_words"))


Rule = list[tuple[str, str, float]]


class DecisionList:
    """Ordered rules ``if all conditions hold: reject``, then ``keep``; learned by sequential covering.

    Each rule grows on two thirds of the labelled rows by the condition with the highest FOIL gain, is pruned
    on the rest by dropping final conditions while (p - n) / (p + n) does not fall, and is accepted while it is
    right on the pruning rows more often than ``precision``. Rows that a rule covers leave before the next.
    """

    def __init__(self, rules: list[Rule]) -> None:
        self.rules = rules

    @staticmethod
    def _covers(rule: Rule, row: dict) -> bool:
        return all(row[f] <= t if op == "<=" else row[f] > t for f, op, t in rule)

    @classmethod
    def learn(
        cls, rows: Sequence[dict], features: Sequence[str], max_rules: int = 12, max_conditions: int = 3, cuts: int = 24, precision: float = 0.9
    ) -> DecisionList:
        """``rows``: feature values and ``bad`` (True: to be rejected), in an order that has nothing to do with them."""
        grow = [r for i, r in enumerate(rows) if i % 3]
        prune = [r for i, r in enumerate(rows) if not i % 3]
        rules: list[Rule] = []
        while len(rules) < max_rules and any(r["bad"] for r in grow):
            rule, held = [], grow
            while len(rule) < max_conditions and not all(r["bad"] for r in held):
                best = max(cls._conditions(held, features, cuts), default=None)
                if best is None or best[0] <= 1e-9:
                    break
                rule.append(best[1])
                held = [r for r in held if cls._covers([best[1]], r)]
            worth = [(cls._worth(rule[:k], prune), -k) for k in range(1, len(rule) + 1)]
            rule = rule[: -max(worth)[1]] if worth else []
            right, wrong = cls._counts(rule, prune) if rule else (0, 0)
            if not rule or right + wrong and right < precision * (right + wrong) or not right and not cls._sure(rule, grow, precision):
                break
            rules.append(rule)
            grow = [r for r in grow if not cls._covers(rule, r)]
            prune = [r for r in prune if not cls._covers(rule, r)]
        return cls(rules)

    @classmethod
    def _counts(cls, rule: Rule, rows: Sequence[dict]) -> tuple[int, int]:
        hit = [r["bad"] for r in rows if cls._covers(rule, r)]
        return sum(hit), len(hit) - sum(hit)

    @classmethod
    def _worth(cls, rule: Rule, rows: Sequence[dict]) -> float:
        p, n = cls._counts(rule, rows)
        return (p - n) / (p + n) if p + n else -1.0

    @classmethod
    def _sure(cls, rule: Rule, rows: Sequence[dict], precision: float) -> bool:
        p, n = cls._counts(rule, rows)
        return p >= 3 and p >= precision * (p + n)

    @staticmethod
    def _conditions(rows: Sequence[dict], features: Sequence[str], cuts: int):
        """``(gain, condition)`` of thresholds halfway between neighbouring values, near quantiles of the bad rows."""
        bad_all, all_n = sum(r["bad"] for r in rows), len(rows)
        if not bad_all:
            return
        base = math.log2(bad_all / all_n)
        for f in features:
            order = sorted((r[f], r["bad"]) for r in rows)
            seen_bad, bounds = 0, []
            for i, (v, bad) in enumerate(order[:-1], 1):
                seen_bad += bad
                if order[i][0] > v:
                    bounds.append(((v + order[i][0]) / 2, i, seen_bad))
            keep = bounds if len(bounds) <= 16 * cuts else bounds[:: max(1, len(bounds) // (16 * cuts))]
            for t, n, p in keep:
                for op, p_, n_ in (("<=", p, n), (">", bad_all - p, all_n - n)):
                    if p_:
                        yield p_ * (math.log2(p_ / n_) - base), (f, op, t)

    def column(self, verdict_reject: Column, verdict_keep: Column) -> Column:
        """The list as one conditional expression: the first rule that holds decides."""
        out = None
        for rule in self.rules:
            test = None
            for f, op, t in rule:
                one = F.col(f) <= F.lit(t) if op == "<=" else F.col(f) > F.lit(t)
                test = one if test is None else test & one
            out = F.when(test, verdict_reject) if out is None else out.when(test, verdict_reject)
        return verdict_keep if out is None else out.otherwise(verdict_keep)

    def __str__(self) -> str:
        return "\n".join("reject if " + " and ".join(f"{f} {op} {t:.6g}" for f, op, t in r) for r in self.rules) + "\nelse keep"


def with_features(stats: DataFrame) -> DataFrame:
    safe = {"n_words": "greatest(n_words, 1)", "word_chars": "greatest(word_chars, 1)"}
    expr = lambda sql: sql.replace("/ n_words", "/ " + safe["n_words"]).replace("/ word_chars", "/ " + safe["word_chars"])
    return stats.withColumns({f"f_{k}": F.expr(f"cast({expr(v)} as double)") for k, v in FEATURES.items()})


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """``(doc_id, text, bad)`` of at most ``rows`` labelled documents, chosen by a hash of doc_id, whatever the size."""
    chosen = (
        labels.where("doc_id is not null and quality is not null")
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
    )
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").withColumn("bad", F.col("quality") == 0)


def learn(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DecisionList:
    """The decision list of the labelled documents that pass the base rule (quality 0 is to be rejected)."""
    stats = statistics(labelled_sample(docs, labels, rows), "bad")
    names = [f"f_{k}" for k in FEATURES]
    found = with_features(stats).select("doc_id", "bad", failed().alias("failed"), *names)
    found = found.orderBy(F.xxhash64("doc_id"), "doc_id", *names).limit(2 * rows).collect()
    return DecisionList.learn([r.asDict() for r in found if not r["failed"]], names)


def judge(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, learned: DecisionList | None = None) -> DataFrame:
    """Statistics, ``base_failed`` and ``kept`` of every row of ``docs(doc_id, text)``.

    The list is learned from at most ``rows`` documents of ``labels(doc_id, quality)``; its learning sees
    numbers only. Every document is then judged in one scan without a shuffle.

    Defined results: a null text has no words and fails; without usable labels the list is empty and everything
    that passes the base rule is kept; a document labelled twice counts as bad if one label says so; rows with a
    null doc_id are judged, too; repeated rows come out once each; an empty table gives no rows.
    """
    learned = learned or learn(docs, labels, rows)
    stats = with_features(statistics(docs)).withColumn("base_failed", failed())
    verdict = learned.column(F.lit(False), F.lit(True))
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    return stats.select(*names, (~F.col("base_failed") & verdict).alias("kept"))
