"""A repository's commits, references and tree as tables, read by plain git on the driver."""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COMMITS = "ordinal long, commit string, parents array<string>, author_name string, author_email string, author_time string, committer_name string, committer_email string, committer_time string, summary string"


def _git(root: str, *args: str) -> str:
    return subprocess.run(["git", "-C", root, *args], check=True, capture_output=True, text=True).stdout


def commits(spark: SparkSession, root: str, head: str = "HEAD", after: str | None = None, last: int = 0) -> DataFrame:
    """Oldest first in topological order; ``ordinal`` counts on from ``last``. With ``after`` only commits that it does not reach."""
    form = "%x1e" + "%x1f".join(("%H", "%P", "%an", "%ae", "%aI", "%cn", "%ce", "%cI", "%s"))
    rows = []
    span = [head] if after is None else [head, f"^{after}"]
    for i, record in enumerate(_git(root, "log", "--topo-order", "--reverse", f"--format={form}", *span).split("\x1e")[1:], last + 1):
        sha, parents, *rest = record.rstrip("\n").split("\x1f")
        rows.append((i, sha, parents.split(), *rest))
    return spark.createDataFrame(rows, COMMITS)


def refs(spark: SparkSession, root: str) -> DataFrame:
    """(kind, name, target): branches and tags, annotated tags peeled."""
    rows = []
    for line in _git(root, "for-each-ref", "--format=%(refname)%09%(objectname)%09%(*objectname)").splitlines():
        name, target, peeled = line.split("\t")
        rows.append(("Tag" if name.startswith("refs/tags/") else "Branch", name, peeled or target))
    return spark.createDataFrame(rows, "kind string, name string, target string")


def tree(spark: SparkSession, root: str, head: str = "HEAD") -> DataFrame:
    """(path, mode, blob, size) of the files at a commit."""
    rows = []
    for entry in _git(root, "ls-tree", "-r", "-l", "-z", head).split("\0")[:-1]:
        meta, path = entry.split("\t", 1)
        mode, kind, blob, size = meta.split()
        if kind == "blob":
            rows.append((path, mode, blob, int(size)))
    return spark.createDataFrame(rows, "path string, mode string, blob string, size long")


def blobs(files: DataFrame) -> DataFrame:
    """(blob, size): each content of a tree once, however many paths have it."""
    return files.select("blob", "size").dropDuplicates(["blob"])


def ignored(spark: SparkSession, root: str) -> DataFrame:
    """(path): what the repository's ignore rules leave out; a folder that is ignored whole is one row."""
    out = _git(root, "ls-files", "--others", "--ignored", "--exclude-standard", "--directory", "-z")
    return spark.createDataFrame([(p.rstrip("/"),) for p in out.split("\0")[:-1]], "path string")


def not_ignored(docs: DataFrame, left_out: DataFrame) -> DataFrame:
    """Rows of ``docs`` (path, ...) whose path is neither in ``left_out`` (path) nor below a folder in it."""
    steps = F.split("path", "/")
    above = F.explode(F.transform(F.sequence(F.lit(1), F.size(steps)), lambda n: F.array_join(F.slice(steps, 1, n), "/")))
    hit = docs.select("path", above.alias("above")).join(left_out.select(F.col("path").alias("above")), "above", "left_semi")
    return docs.join(hit.select("path").distinct(), "path", "left_anti").select(docs.columns)


def touched(spark: SparkSession, root: str, head: str = "HEAD") -> DataFrame:
    """(commit, status, path, old_path): each commit against its first parent, the first against the empty tree; halves alike are renames."""
    out = []
    raw = _git(root, "log", "--topo-order", "--reverse", "--diff-merges=first-parent", "--root", "-M50%", "--name-status", "-z", "--format=%x1e%H", head)
    for record in raw.split("\x1e")[1:]:
        parts = [p.lstrip("\n") for p in record.split("\0")]
        sha, at = parts[0].strip(), 1
        while at < len(parts) and (status := parts[at].strip()):
            if status[0] in "RC":
                out.append((sha, status[0], parts[at + 2], parts[at + 1]))
                at += 3
            else:
                out.append((sha, status[0], parts[at + 1], None))
                at += 2
    return spark.createDataFrame(out, "commit string, status string, path string, old_path string")
