"""Version control: diffs and untracked files of a working tree, read on the driver."""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.text import lines
from ..operators.diff import hunks
from .files import INDEX_DIR, named_files


class GitError(RuntimeError):
    """git is missing, or said no."""


def git(repo: str, *args: str) -> str:
    try:
        run = subprocess.run(["git", "-C", repo, *args], capture_output=True, text=True)
    except FileNotFoundError as e:
        raise GitError("git is not installed") from e
    if run.returncode:
        raise GitError(run.stderr.strip() or "git failed")
    return run.stdout


def is_repository(repo: str) -> bool:
    try:
        git(repo, "rev-parse", "--git-dir")
    except GitError:
        return False
    return True


def diff_text(repo: str, rev: str | None = None, staged: bool = False) -> str:
    flags = ["--unified=0", "--no-color", "--no-ext-diff", "--find-renames", "--diff-filter=ACMR"]
    return git(repo, "diff", *flags, *(["--cached"] if staged else []), rev or "HEAD")


def changes(spark: SparkSession, repo: str, rev: str | None = None, staged: bool = False) -> DataFrame:
    """``(path, start, end, deletion_only)`` of what changed; new source files count as changed from end to end.

    Untracked files belong to a comparison of the working tree with HEAD only.
    """
    text = spark.createDataFrame([(0, diff_text(repo, rev, staged))], "diff_id int, text string")
    out = hunks(text).select("path", "start", "end", "deletion_only")
    if rev is None and not staged:
        names = [p.strip() for p in git(repo, "ls-files", "--others", "--exclude-standard").splitlines() if p.strip()]
        n = F.size(lines(F.col("content")))
        files = named_files(spark, repo, names).select("path", n.alias("n")).where("n > 0")
        out = out.unionByName(
            files.select("path", F.lit(1).alias("start"), F.col("n").alias("end"), F.lit(0).alias("deletion_only"))
        )
    return out.where(~F.col("path").startswith(INDEX_DIR + "/"))
