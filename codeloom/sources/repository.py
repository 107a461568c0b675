"""Bringing source trees and git's texts to where Spark can read them. This runs on the driver; everything after is DataFrames.

What git prints is written to the shared folder in pieces as it comes, so the driver holds one piece of a log or difference at a time.
"""

from __future__ import annotations

import re
import subprocess
import uuid
import zipfile
from collections.abc import Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder
from . import gitlog

MAX_COMMITS = 500
#: Bytes of git's output that the driver holds before it writes them.
PIECE = 32 << 20
#: Scopes of a working-tree difference: arguments after ``git diff --unified=0``.
SCOPES = {"unstaged": (), "staged": ("--cached",), "all": ("HEAD",)}


def _pieces(lines: Iterable[bytes], size: int) -> Iterator[pa.Table]:
    """(n, line) of lines in a row, in tables of about so many bytes; numbers from 0."""
    n, start, held, texts = 0, 0, 0, []
    for x in lines:
        texts.append(x.removesuffix(b"\n").removesuffix(b"\r").decode("utf-8", "replace"))
        held, n = held + len(x), n + 1
        if held >= size:
            yield pa.table({"n": pa.array(range(start, n), pa.int64()), "line": pa.array(texts, pa.string())})
            start, held, texts = n, 0, []
    if texts:
        yield pa.table({"n": pa.array(range(start, n), pa.int64()), "line": pa.array(texts, pa.string())})


def _git_lines(spark: SparkSession, folder: str, *args: str, size: int | None = None) -> DataFrame:
    """(n, line) of what git prints, from files of the shared folder. A failing git is an error."""
    out = f"{shared_folder(spark)}/git-{uuid.uuid4().hex}"
    spark.createDataFrame([], "n long, line string").write.parquet(out)
    with subprocess.Popen(["git", "-C", folder, *args], stdout=subprocess.PIPE, stderr=subprocess.DEVNULL) as p:
        for piece in _pieces(p.stdout, size or PIECE):
            spark.createDataFrame(piece).write.mode("append").parquet(out)
    if p.returncode:
        raise subprocess.CalledProcessError(p.returncode, p.args)
    return spark.read.schema("n long, line string").parquet(out)


def clone(url: str, branch: str, target: str) -> str:
    """One branch with its whole history."""
    if url.startswith("-") or branch.startswith("-"):
        raise ValueError("a URL or branch can't start with a dash")
    subprocess.run(["git", "clone", "--single-branch", "--branch", branch, "--", url, target], check=True, capture_output=True)
    return target


def unzip(archive: str, target: str) -> str:
    """The folder with the archive's files: a single top-level folder is stepped into. Entries that lead out of target are an error."""
    root = Path(target).resolve()
    with zipfile.ZipFile(archive) as z:
        for name in z.namelist():
            if not (root / name).resolve().is_relative_to(root):
                raise ValueError(f"{name} leads out of the archive")
        z.extractall(root)
    top = list(root.iterdir())
    return str(top[0]) if len(top) == 1 and top[0].is_dir() else str(root)


def local(folder: str) -> str:
    if not Path(folder).is_dir():
        raise ValueError(f"{folder} is no folder")
    return folder


def log_lines(spark: SparkSession, folder: str, repo_id: str, path: str | None = None) -> DataFrame:
    """(repo_id, n, line) of the last commits with name status, of one file only if path is given."""
    lines = _git_lines(spark, folder, "log", f"-{MAX_COMMITS}", "--name-status", "--diff-filter=ADMR", "--date=iso-strict", "--pretty=format:%H|%an|%ae|%ad|%s", *(["--", path] if path else []))
    return lines.select(F.lit(repo_id).alias("repo_id"), "n", "line")


def history(spark: SparkSession, folder: str, repo_id: str, known: DataFrame | None = None, path: str | None = None) -> DataFrame:
    """History rows of a repository, or of one file (path), whose changes all count as M then."""
    rows = gitlog.parse_log(log_lines(spark, folder, repo_id, path), known)
    return rows if path is None else rows.withColumn("change_type", F.lit("M"))


def diff_lines(spark: SparkSession, folder: str, diff_id: str, scope: str = "all", ref: str | None = None) -> DataFrame:
    """(diff_id, n, line) of a difference: unstaged, staged, all, or compare, which takes ref..HEAD."""
    if scope == "compare":
        if not ref or not re.fullmatch(r"[\w./~^@-]+", ref) or ref.startswith("-"):
            raise ValueError("compare needs a plain ref")
        args: tuple[str, ...] = (f"{ref}..HEAD",)
    elif scope in SCOPES:
        args = SCOPES[scope]
    else:
        raise ValueError(f"unknown scope {scope!r}")
    return _git_lines(spark, folder, "diff", "--unified=0", *args).select(F.lit(diff_id).alias("diff_id"), "n", "line")


def changed_files(spark: SparkSession, folder: str, repo_id: str, old: str, new: str) -> DataFrame:
    """(repo_id, file_path, change) between two commits."""
    for ref in (old, new):
        if not re.fullmatch(r"[0-9a-fA-F]{4,40}|[\w./~^@]+", ref):
            raise ValueError("a commit is wanted")
    lines = _git_lines(spark, folder, "diff", "--name-status", f"{old}..{new}")
    return gitlog.parse_name_status(lines.select(F.lit(repo_id).alias("repo_id"), "n", "line"))
