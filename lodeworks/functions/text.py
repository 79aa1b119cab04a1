"""Text and naming expressions: tokenizer, identifier words, test conventions, locators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

# The tokenizer's runs and the camelCase parts of a run.
RUN = "[A-Za-z0-9]+"
SUBWORD = "[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z]+|[A-Z]+|[0-9]+"

# Each ecosystem's conventions for test files.
TEST_DIRS = ["test", "tests", "__tests__", "spec", "specs", "testing", "e2e"]
TEST_PREFIXES = ["test_", "test-"]
TEST_SUFFIXES = [
    "_test.py", "_test.go", "_test.rs", "_test.java", "_test.ts", "_test.js",
    ".test.ts", ".test.tsx", ".test.js", ".test.jsx",
    ".spec.ts", ".spec.tsx", ".spec.js", ".spec.jsx",
    "test.java", "tests.cs", "test.cs", "_spec.rb",
]

# What an embedding model's queries and passages are prefixed with.
PREFIXES = {
    "bge": ("Represent this sentence for searching relevant passages: ", ""),
    "e5": ("query: ", "passage: "),
    "none": ("", ""),
}


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once a row, however often it is used."""
    return F.get(F.transform(F.array(value), lambda x: use(x)), F.lit(0))


def subwords(run: Column) -> Column:
    return F.regexp_extract_all(run, F.lit(SUBWORD), F.lit(0))


#: A run of one part: of one case, capitalised, or all digits.
PLAIN = "[A-Z]?[a-z]+|[A-Z]+|[0-9]+"
#: A run of several parts, or of letters and digits: not of one case, nor capitalised, nor all digits.
MIXED = f"(?<![A-Za-z0-9])(?!(?:{PLAIN})(?![A-Za-z0-9])){RUN}"
#: Set after mixed runs so that the others, most of all runs, are known without another look.
MARK = "\x01"


def tokenize(text: Column) -> Column:
    """Every alphanumeric run in lower case, each camelCase run followed by its parts; order and repeats are kept."""

    def expand(run: Column) -> Column:
        bare = F.rtrim(run, F.lit(MARK))
        parts = lambda p: F.when(
            F.size(p) > 1, F.concat(F.array(F.lower(bare)), F.transform(p, lambda x: F.lower(x)))
        ).otherwise(F.array(F.lower(bare)))
        return F.when(run.endswith(MARK), let(subwords(bare), parts)).otherwise(F.array(F.lower(run)))

    marked = F.regexp_replace(text, MIXED, "$0" + MARK)
    return F.flatten(F.transform(F.regexp_extract_all(marked, F.lit(f"{RUN}{MARK}?"), F.lit(0)), expand))


def token_counts(text: Column, terms: list[str]) -> Column:
    """``(dl, t0, t1, …)``: how many tokens a text has, and how many of them are each term, without listing them.

    A term counts where it is a run, in any case, or a part of a mixed run.
    """
    mixed = F.flatten(F.transform(F.regexp_extract_all(text, F.lit(MIXED), F.lit(0)), subwords_of_several))
    whole = "|".join(sorted(terms, key=lambda t: (-len(t), t)))
    runs = F.regexp_extract_all(text, F.lit(f"(?i)(?<![A-Za-z0-9])(?:{whole})(?![A-Za-z0-9])"), F.lit(0))

    def counted(parts: Column) -> Column:
        found = F.concat(runs, F.filter(parts, lambda p: F.lower(p).isin(terms)))
        return let(
            F.transform(found, lambda x: F.lower(x)),
            lambda f: F.struct(
                (F.regexp_count(text, F.lit(RUN)) + F.size(parts)).cast("long").alias("dl"),
                *[occurrences(f, t).cast("long").alias(f"t{i}") for i, t in enumerate(terms)],
            ),
        )

    return let(mixed, counted)


def occurrences(words: Column, term: str) -> Column:
    return F.size(F.filter(words, lambda x: x == F.lit(term)))


def subwords_of_several(run: Column) -> Column:
    """The parts of a run that has two or more of them."""
    return let(subwords(run), lambda p: F.when(F.size(p) > 1, p).otherwise(F.array().cast("array<string>")))


def identifier_words(name: Column) -> Column:
    """The lower-case words of an identifier; the whole name where it has none."""
    return let(subwords(name), lambda p: F.when(F.size(p) > 0, F.transform(p, lambda x: F.lower(x))).otherwise(F.array(F.lower(name))))


def is_test_path(path: Column) -> Column:
    """Whether a path is a test file's by its ecosystem's convention."""
    low = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    parts = F.split(low, "/")
    in_dir = F.arrays_overlap(F.slice(parts, 1, F.size(parts) - 1), F.array(*map(F.lit, TEST_DIRS)))
    name = F.element_at(parts, -1)
    by_name = [name.startswith(p) for p in TEST_PREFIXES] + [name.endswith(s) for s in TEST_SUFFIXES]
    out = in_dir
    for test in by_name:
        out = out | test
    return out


def looks_like_test(qualified: Column) -> Column:
    """Whether a qualified name speaks of a test, wherever its file lies."""
    q = F.lower(qualified)
    return q.startswith("test") | q.contains(".test") | q.contains("tests.") | q.endswith(".tests")


def locator(path: Column, start: Column, end: Column, symbol: Column | None = None) -> Column:
    base = F.concat(path, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"))
    return base if symbol is None else F.concat(base, F.lit(" ("), symbol, F.lit(")"))


def lexical_text(path: Column, symbol: Column, text: Column) -> Column:
    """What lexical search and re-ranking see of a chunk."""
    return F.concat(path, F.lit(" "), symbol, F.lit("\n"), text)


def embedding_text(path: Column, start: Column, end: Column, symbol: Column, text: Column) -> Column:
    """What an embedding model sees of a chunk."""
    return F.concat(locator(path, start, end, symbol), F.lit("\n"), text)


def lines(text: Column) -> Column:
    """The lines of a text, broken where Python's splitlines breaks it, without a final empty one."""
    parts = F.split(text, "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]")
    return let(parts, lambda p: F.when(F.element_at(p, -1) == "", F.slice(p, 1, F.size(p) - 1)).otherwise(p))
