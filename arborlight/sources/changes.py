"""What changed in a repository: diffs, changed files and line ranges, read by git on the driver."""

from __future__ import annotations

import os
import re
import subprocess

from pyspark.sql import DataFrame, SparkSession

from arborlight.operators.weakening import parse_diff

WHOLE_FILE = (1 << 32) - 1
_RANGE = re.compile(r"^@@ -\S+ \+(\d+)(?:,(\d+))? @@")


def safe_revision(rev: str) -> str:
    """The revision, if it can be no option of git; ValueError otherwise."""
    if not rev or rev.startswith("-") or "\0" in rev or any(c.isspace() for c in rev):
        raise ValueError(f"not a revision: {rev!r}")
    return rev


def safe_path(root: str, path: str) -> str:
    """The path below the root, as an absolute one; ValueError where it is absolute, climbs out, or leaves by a link."""
    if os.path.isabs(path) or "\0" in path or ".." in path.replace("\\", "/").split("/"):
        raise ValueError(f"not a path inside: {path!r}")
    full, top = os.path.realpath(os.path.join(root, path)), os.path.realpath(root)
    if os.path.commonpath([full, top]) != top:
        raise ValueError(f"{path!r} leads out of {root!r}")
    return full


def run_git(repo: str, *args: str, most: int = 64 << 20) -> str:
    """git's output, bounded; ValueError with its message where it fails."""
    done = subprocess.run(["git", "-C", repo, "-c", "core.quotepath=off", *args], capture_output=True, check=False, timeout=300)
    if done.returncode:
        raise ValueError(done.stderr.decode("utf-8", "replace").strip()[:500])
    if len(done.stdout) > most:
        raise ValueError(f"git put out more than {most} bytes")
    return done.stdout.decode("utf-8", "replace")


def _span(base: str, head: str | None) -> list[str]:
    return [safe_revision(base)] + ([safe_revision(head)] if head else [])


def diff_lines(spark: SparkSession, repo: str, base: str, head: str | None = None) -> DataFrame:
    """Diff lines between a revision and another, or the working tree."""
    return parse_diff(spark, run_git(repo, "diff", "--unified=0", "--find-renames", "--no-color", "--no-ext-diff", *_span(base, head), "--"))


def _untracked(repo: str) -> list[str]:
    return [p for p in run_git(repo, "ls-files", "--others", "--exclude-standard", "-z").split("\0") if p]


def changed_files(repo: str, base: str) -> list[str]:
    """Files that differ from the revision, and untracked ones, in order."""
    return sorted({*(p for p in run_git(repo, "diff", "--name-only", "-z", *_span(base, None), "--").split("\0") if p), *_untracked(repo)})


def changed_ranges(spark: SparkSession, repo: str, base: str) -> DataFrame:
    """(path, lo, hi): lines that are new or touched; an untracked file is touched whole, a pure deletion at the line it leaves."""
    rows, path = [], None
    for line in run_git(repo, "diff", "--unified=0", "--no-color", "--no-ext-diff", *_span(base, None), "--").split("\n"):
        if line.startswith("+++ "):
            path = None if line[4:] == "/dev/null" else line[4:].split("\t")[0].removeprefix("b/")
        elif path and (m := _RANGE.match(line)):
            lo, n = int(m[1]), int(m[2] or 1)
            rows.append((path, max(1, lo), max(1, lo + max(0, n - 1))))
    rows += [(p, 1, WHOLE_FILE) for p in _untracked(repo)]
    return spark.createDataFrame(rows, "path string, lo long, hi long")
