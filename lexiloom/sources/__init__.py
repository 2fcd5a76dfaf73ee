"""Sources: file trees, incremental manifests, git output, configuration and line ranges."""

from __future__ import annotations

import fnmatch
import os
import re
import subprocess
import tomllib
from collections.abc import Iterator
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.extract import REGISTRY
from lexiloom.functions import content_hash
from lexiloom.operators.workspace import file_key

MAX_FILES = 100_000
MAX_LINES = 500
CONFIG = ".lexiloom.toml"


def _ignore_rules(folder: str) -> list[tuple[bool, str]]:
    try:
        lines = Path(folder, ".gitignore").read_text(errors="replace").splitlines()
    except OSError:
        return []
    rules = [x.strip() for x in lines if x.strip() and not x.startswith("#")]
    return [(not r.startswith("!"), r.lstrip("!")) for r in rules]


def _ignored(path: str, name: str, is_dir: bool, rules: list[tuple[str, bool, str]]) -> bool:
    out = False
    for base, bad, rule in rules:
        if rule.endswith("/") and not is_dir:
            continue
        r, rel = rule.strip("/"), os.path.relpath(path, base)
        if fnmatch.fnmatch(rel, r) if "/" in rule.rstrip("/") else fnmatch.fnmatch(name, r):
            out = bad
    return out


def walk(root: str, respect_gitignore: bool = True, ignore: list[str] | None = None) -> Iterator[str]:
    """Supported files below a local root, sorted, as relative paths; hidden ones and ignored ones are left out."""
    own = [(root, True, x) for x in ignore or []]

    def down(folder: str, rules: list) -> Iterator[str]:
        if respect_gitignore:
            rules = rules + [(folder, bad, r) for bad, r in _ignore_rules(folder)]
        for e in sorted(os.scandir(folder), key=lambda e: e.name):
            is_dir = e.is_dir(follow_symlinks=False)
            if e.name.startswith(".") or _ignored(e.path, e.name, is_dir, rules):
                continue
            if is_dir:
                yield from down(e.path, rules)
            elif e.name.rpartition(".")[2] in REGISTRY:
                yield os.path.relpath(e.path, root)

    yield from down(root, own)


def scan_tree(spark: SparkSession, root: str, max_files: int = MAX_FILES, respect_gitignore: bool = True, ignore: list[str] | None = None) -> tuple[DataFrame, int]:
    """((file_path, mtime_ns) of a local tree, number of files beyond max_files). Contents are read on the executors by read_sources."""
    paths = list(walk(root, respect_gitignore, ignore))
    rows = [(p, os.stat(os.path.join(root, p)).st_mtime_ns) for p in paths[:max_files]]
    return spark.createDataFrame(rows, "file_path string, mtime_ns long"), max(0, len(paths) - max_files)


def read_sources(files: DataFrame, root: str) -> DataFrame:
    """files with content and read_error; a file that can't be read has null content and the reason. The root must be mounted on the executors."""

    def run(batches):
        for b in batches:
            content, errors = [], []
            for p in b["file_path"]:
                try:
                    content.append(Path(root, p).read_bytes())
                    errors.append(None)
                except OSError as e:
                    content.append(None)
                    errors.append(f"read: {e.strerror}")
            yield b.assign(content=content, read_error=errors)

    schema = ", ".join(f"`{n}` {t}" for n, t in files.dtypes)
    return files.mapInPandas(run, f"{schema}, content binary, read_error string").withColumn("hash", content_hash("content"))


def scan_store(spark: SparkSession, path: str, max_files: int | None = None) -> tuple[DataFrame, int]:
    """((file_path, mtime_ns, content, hash) below any URI that Spark reads, number of files beyond max_files).

    Every file unless max_files is given; then those whose paths are first, picked by the listing before any content is read. No ignore rules.
    """
    suffix = "|".join(sorted(REGISTRY))
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{" + suffix.replace("|", ",") + "}").load(path)
    base = path.rstrip("/").split(":")[-1].lstrip("/")
    rel = F.regexp_replace(F.regexp_replace("path", r"^[a-z0-9]+:/+", ""), "^" + re.escape(base) + "/", "")
    truncated = 0
    if max_files is not None:
        listed = raw.select("path")
        truncated = max(0, listed.count() - max_files)
        raw = raw.join(listed.orderBy("path").limit(max_files), "path", "left_semi")
    return raw.select(rel.alias("file_path"), (F.unix_micros("modificationTime") * 1000).alias("mtime_ns"), "content", content_hash("content").alias("hash")), truncated


def from_memory(spark: SparkSession, sources: dict[str, str]) -> DataFrame:
    return spark.createDataFrame([*sources.items()], "file_path string, content string")


def line_range(files: DataFrame, path: str, start: int, end: int) -> DataFrame:
    """(line, text) of lines start to end of a file, counted from 1, at most MAX_LINES; none beyond the file's end. The file may be named as its path or [label]path."""
    text = F.col("content").cast("string")
    return file_key(files, path).select(F.posexplode(F.split(text, "\n")).alias("at", "text")).select((F.col("at") + 1).alias("line"), "text").where(F.col("line").between(max(1, start), min(end, max(1, start) + MAX_LINES - 1))).orderBy("line")


def _git(root: str, *args: str) -> str:
    done = subprocess.run(["git", "-C", root, *args], capture_output=True, text=True, errors="replace")
    return done.stdout if done.returncode == 0 else ""


def git_name_status(spark: SparkSession, root: str, old: str, new: str) -> DataFrame:
    """(status, file) of the changes between two commits; none where git fails."""
    rows = [(p[0][:1], p[-1]) for x in _git(root, "diff", "--name-status", old, new).splitlines() if len(p := x.split("\t")) >= 2]
    return spark.createDataFrame(rows, "status string, file string")


def git_hunks(spark: SparkSession, root: str, old: str, new: str) -> DataFrame:
    """(file, start, end): changed ranges of the new side of each file."""
    rows, name = [], None
    for x in _git(root, "diff", "-U0", old, new).splitlines():
        if x.startswith("+++ "):
            name = x[6:] if x.startswith("+++ b/") else None
        elif name and (m := re.match(r"@@[^+]*\+(\d+)(?:,(\d+))?", x)) and int(m[1]):
            rows.append((name, int(m[1]), int(m[1]) + max(int(m[2] or 1) - 1, 0)))
    return spark.createDataFrame(rows, "file string, start int, end int")


def git_blame(spark: SparkSession, root: str, file: str, start: int, end: int) -> DataFrame:
    """(file, line_no, raw) of porcelain blame output, for operators.changes.blame_lines."""
    out = _git(root, "blame", "--porcelain", f"-L{start},{end}", "--", file)
    return spark.createDataFrame([(file, i, x) for i, x in enumerate(out.split("\n")) if x], "file string, line_no long, raw string")


@dataclass
class Config:
    max_files: int = MAX_FILES
    ignore: list[str] = field(default_factory=list)
    languages: list[str] = field(default_factory=list)
    no_ignore: bool = False
    roots: list[str] = field(default_factory=list)


def load_config(folder: str) -> Config:
    """The configuration of a folder, with defaults; roots of a workspace are made absolute, missing ones dropped."""
    path = Path(folder, CONFIG)
    raw = tomllib.loads(path.read_text()) if path.exists() else {}
    c = Config(**{k: v for k, v in raw.items() if k in Config.__dataclass_fields__})
    c.roots = [r for x in c.roots if os.path.isdir(r := os.path.realpath(os.path.join(folder, x)))]
    return c


def find_root(path: str) -> str:
    """The nearest folder upwards with .git; the path itself if there is none."""
    at = Path(path).resolve()
    return next((str(p) for p in [at, *at.parents] if (p / ".git").exists()), str(at))
