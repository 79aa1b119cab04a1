"""Source trees as DataFrames: which files count, their language, text and hash."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..scratch import stored

INDEX_DIR, IGNORE_FILE = ".lodeworks", ".lodeworksignore"
MAX_BYTES, BLOCK_BYTES = 1_000_000, 64_000_000

# Languages by file extension.
LANGUAGES = {
    "py": "python",
    "js": "javascript", "jsx": "javascript",
    "ts": "typescript", "tsx": "typescript",
    "rs": "rust",
    "java": "java",
    "cs": "csharp",
    "cpp": "cpp", "cc": "cpp", "hpp": "cpp", "h": "cpp",
    "go": "go",
    "rb": "ruby",
    "php": "php",
    "md": "markdown", "mdx": "markdown",
    "txt": "text",
    "json": "json", "yaml": "yaml", "yml": "yaml", "toml": "toml",
    "sql": "sql",
}
# Directories that hold nothing worth reading.
SKIPPED = [
    ".git", ".hg", ".svn", "node_modules", "target", "dist", "build",
    "__pycache__", ".venv", "venv", "env", ".idea", ".vscode", ".mypy_cache",
    ".pytest_cache", ".next", ".turbo", "coverage", "vendor", "bin", "obj",
    INDEX_DIR,
]


def language(path: Column) -> Column:
    """The language of a path by its extension, null where it has none that counts."""
    table = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.try_element_at(table, F.lower(F.regexp_extract(path, r"[^/.][^/]*\.([^./]+)$", 1)))


def ignore_patterns(text: str) -> list[str]:
    return [line for line in map(str.strip, text.splitlines()) if line and not line.startswith("#")]


def _glob(pattern: str, any_one: str = ".") -> str:
    """A file-name pattern as a regular expression; ``any_one`` is what ? and * range over."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        close = pattern.find("]", i + 2) if c == "[" else -1
        if c == "*":
            out += f"{any_one}*"
        elif c == "?":
            out += any_one
        elif close > 0:
            body = pattern[i + 1 : close].replace("\\", "\\\\").replace("[", "\\[")
            out += "[" + ("^" + body[1:] if body[0] == "!" else body) + "]"
            i = close
        else:
            out += re.escape(c)
        i += 1
    return out


def ignore_regex(pattern: str) -> str | None:
    """One ignore pattern as an anchored regular expression over relative paths; an empty one gives None.

    A pattern with a slash inside is anchored at the root and covers what lies below it. One without names a
    directory at any depth, or a file unless it ends in a slash. Stars cross slashes in anchored patterns.
    """
    bare = pattern.rstrip("/")
    if not bare:
        return None
    ways = [_glob(bare.replace("**", "*"))] if "**" in bare else []
    if "/" in bare:
        ways += [re.escape(bare) + "(?:/.*)?", _glob(bare), _glob(bare + "/*")]
    else:
        part = _glob(bare, "[^/]")
        ways.append(f"(?:.*/)?{part}/.*")
        if not pattern.endswith("/"):
            ways.append(f"(?:.*/)?{part}")
    return "(?s)^(?:" + "|".join(ways) + ")$"


def ignored(path: Column, patterns: Iterable[str]) -> Column:
    out = F.lit(False)
    for r in filter(None, map(ignore_regex, patterns)):
        out = out | path.rlike(r)
    return out


def _qualified(spark: SparkSession, root: str) -> str:
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file's text, None where there is no such file; unlike Spark's readers, of any name."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def read_ignore(spark: SparkSession, root: str) -> list[str]:
    """The patterns of the tree's ignore file, none where there is no such file."""
    return ignore_patterns(read_text(spark, f"{root.rstrip('/')}/{IGNORE_FILE}") or "")


def _apart(spark: SparkSession, base: str) -> Iterator[tuple]:
    """Statuses of the source files whose path has a part that begins with "_" or ".", which Spark's listing passes over."""
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(base)
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    todo = [(top, False)]
    while todo:
        folder, apart = todo.pop()
        for status in fs.listStatus(folder):
            name = status.getPath().getName()
            here = apart or name[0] in "_."
            if status.isDirectory():
                if name not in SKIPPED:
                    todo.append((status.getPath(), here))
            elif here and name.rpartition(".")[2].lower() in LANGUAGES and status.getLen() <= MAX_BYTES:
                yield fs, status


def _set_apart(spark: SparkSession, base: str) -> DataFrame | None:
    """``(path, length, content)`` of the files of ``_apart``.

    The driver reads them through the file system and hands them on in blocks of ``BLOCK_BYTES``, written to the shared
    folder: package markers and settings, of 1 MB at most each.
    """
    jvm, out, rows, held = spark.sparkContext._jvm, None, [], 0

    def flush(out: DataFrame | None) -> DataFrame:
        part = spark.createDataFrame(rows, "path string, length long, content binary")
        if out is None and held < BLOCK_BYTES:
            return part
        part = stored(part, "files-apart")
        return part if out is None else out.unionByName(part)

    for fs, status in _apart(spark, base):
        stream = fs.open(status.getPath())
        content = bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        stream.close()
        rows.append((status.getPath().toString(), len(content), bytearray(content)))
        held += len(content)
        if held >= BLOCK_BYTES:
            out, rows, held = flush(out), [], 0
    return flush(out) if rows else out


def listed_files(spark: SparkSession, root: str) -> DataFrame:
    """``(path, size, modified)`` of the source files below ``root``, modified in microseconds: from the listing, no file is
    opened."""
    base = _qualified(spark, root)
    columns = ["path", "length", F.unix_micros("modificationTime").alias("modified")]
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base).select(*columns)
    rows = [(x.getPath().toString(), x.getLen(), x.getModificationTime() * 1000) for _, x in _apart(spark, base)]
    if rows:
        raw = raw.unionByName(spark.createDataFrame(rows, "path string, length long, modified long"))
    return _wanted(spark, base, raw).select("path", "size", "modified")


def source_files(spark: SparkSession, root: str, with_content: bool = True) -> DataFrame:
    """``(path, lang, size, hash, content)`` of the source files below ``root``, on any file system Spark reads.

    Paths are relative; skipped directories, unknown extensions, ignored paths and files over 1 MB are left out
    before a byte is read. Content is UTF-8 with invalid bytes dropped; the hash is the SHA-256 of the bytes.
    """
    base = _qualified(spark, root)
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base).select("path", "length", "content")
    apart = _set_apart(spark, base)
    return _sources(spark, base, raw if apart is None else raw.unionByName(apart), with_content)


def named_files(spark: SparkSession, root: str, names: list[str]) -> DataFrame:
    """The same for given relative paths; no other file is listed or read."""
    base = _qualified(spark, root)
    known = [n for n in names if n.rpartition(".")[2].lower() in LANGUAGES]
    plain = [n for n in known if not any(part[0] in "_." for part in n.split("/") if part)]
    raw = spark.createDataFrame([], "path string, length long, content binary")
    if plain:
        raw = spark.read.format("binaryFile").load([f"{base}/" + re.sub(r"([\[\]{}*?\\])", r"\\\1", n) for n in plain]).select("path", "length", "content")
    rest = sorted(set(known) - set(plain))
    rows = [(f"{base}/{n}", len(content), bytearray(content)) for n in rest if (content := _read_bytes(spark, f"{base}/{n}")) is not None]
    if rows:
        raw = raw.unionByName(spark.createDataFrame(rows, raw.schema))
    return _sources(spark, base, raw, True)


def _read_bytes(spark: SparkSession, path: str) -> bytes | None:
    """A source file of at most ``MAX_BYTES``, read by the driver."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p) or fs.getFileStatus(p).getLen() > MAX_BYTES:
        return None
    stream = fs.open(p)
    try:
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
    finally:
        stream.close()


def _wanted(spark: SparkSession, base: str, raw: DataFrame) -> DataFrame:
    """Of ``raw(path, length, …)`` the source files, with relative paths, size and lang."""
    path = F.regexp_replace(F.expr(f"substring(path, {len(base) + 2})"), "^/+", "")
    found = raw.where(F.col("length") <= MAX_BYTES).withColumn("path", path).withColumnRenamed("length", "size")
    dirs = F.split("path", "/")
    found = found.where(~F.arrays_overlap(F.slice(dirs, 1, F.size(dirs) - 1), F.array(*map(F.lit, SKIPPED))))
    found = found.withColumn("lang", language(F.col("path"))).where(F.col("lang").isNotNull())
    patterns = read_ignore(spark, base)
    return found.where(~ignored(F.col("path"), patterns)) if patterns else found


def _sources(spark: SparkSession, base: str, raw: DataFrame, with_content: bool) -> DataFrame:
    found = _wanted(spark, base, raw)
    text = F.replace(F.make_valid_utf8(F.col("content").cast("string")), F.lit("�"), F.lit(""))
    content = [text.alias("content")] if with_content else []
    return found.select("path", "lang", "size", F.sha2("content", 256).alias("hash"), *content)


def curated_items(spark: SparkSession, path: str) -> DataFrame:
    """Hand-written evaluation items of a JSON-lines file; blank lines and ``#`` comments are passed over."""
    rows = spark.read.text(path).where("trim(value) <> '' and not startswith(trim(value), '#')")
    o = F.from_json("value", "query string, path string, start_line int, end_line int")
    return rows.select(o.alias("o")).select(
        "o.query",
        F.col("o.path").alias("gold_path"),
        F.col("o.start_line").alias("gold_start"),
        F.col("o.end_line").alias("gold_end"),
        F.lit("curated").alias("source"),
    )
