"""An index of a project or a workspace as Parquet tables, and the engine that answers queries on it."""

from __future__ import annotations

import json
import os
import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom import sources
from lexiloom.durable import materialize
from lexiloom.extract import parse_files, relations
from lexiloom.functions import kind_priority
from lexiloom.operators import changes, deps, export, search, symbols, workspace
from lexiloom.operators.callgraph import CallGraph, enriched
from lexiloom.schemas import INDEX_VERSION

TABLES = ("symbols", "call_edges", "imports", "identifiers", "files")
#: Made of symbols for stored search: postings sorted by term, and the length of each field.
SEARCH_TABLES = ("postings", "lengths")
SEARCHED = ["name", "qualified_name", "signature", "doc_comment"]


@dataclass
class Index:
    tables: dict[str, DataFrame]
    meta: dict

    def __getattr__(self, name: str) -> DataFrame:
        try:
            return self.__dict__["tables"][name]
        except KeyError:
            raise AttributeError(name) from None

    def with_search(self) -> Index:
        """With the tables of stored search, made anew from symbols."""
        tokens = materialize(search.tokenized(self.symbols, "id", SEARCHED), "tokens")
        made = {"postings": search.postings(tokens), "lengths": search.lengths(tokens)}
        return Index({**self.tables, **{k: materialize(v, k) for k, v in made.items()}}, self.meta)

    def write(self, path: str) -> None:
        """To a folder of any file system that Spark writes: a new version beside the old one, then the name of it in CURRENT.

        A reader finds the old version or the new one, never a part. The version before the old one is removed.
        """
        spark = next(iter(self.tables.values())).sparkSession
        store = _Store(spark, path)
        version = f"v{time.time_ns()}"
        for name, df in self.tables.items():
            out = search.by_term(df) if name == "postings" else df.repartitionByRange("name", "file_path", "line").sortWithinPartitions("name") if name == "identifiers" else df
            out.write.parquet(f"{store.path}/{version}/{name}")
        store.put(f"{version}/meta.json", json.dumps(self.meta))
        before = store.get("CURRENT")
        store.put("CURRENT", version)
        for old in store.folders("v"):
            if old not in (version, before):
                store.remove(old)

    @staticmethod
    def read(spark: SparkSession, path: str) -> Index | None:
        """None if there is no index of this version."""
        store = _Store(spark, path)
        version = store.get("CURRENT")
        meta = json.loads(store.get(f"{version}/meta.json") or "{}") if version else {}
        if meta.get("version") != INDEX_VERSION:
            return None
        there = store.folders("", version)
        return Index({t: spark.read.parquet(f"{store.path}/{version}/{t}") for t in (*TABLES, *SEARCH_TABLES) if t in there}, meta)


class _Store:
    """Small files and folders below a path, by Hadoop's file systems; a path without a scheme is a local one in a local session."""

    def __init__(self, spark: SparkSession, path: str):
        self.path = path.rstrip("/") if "://" in path or not spark.sparkContext.master.startswith("local") else "file://" + os.path.abspath(path)
        self.jvm, self.gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
        self.fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def put(self, name: str, text: str) -> None:
        """Written beside and renamed, so that no reader sees a part of it."""
        tmp = self._at(f"{name}.tmp")
        out = self.fs.create(tmp, True)
        out.write(text.encode())
        out.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri())
        kind = self.jvm.org.apache.hadoop.fs.Options.Rename
        options = self.gateway.new_array(kind, 1)
        options[0] = kind.OVERWRITE
        context.rename(tmp, self._at(name), options)

    def get(self, name: str) -> str | None:
        if not self.fs.exists(self._at(name)):
            return None
        f = self.fs.open(self._at(name))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(f)).decode()
        finally:
            f.close()

    def folders(self, start: str, below: str = "") -> list[str]:
        return [n for x in self.fs.listStatus(self._at(below)) if x.isDirectory() and (n := x.getPath().getName()).startswith(start)]

    def remove(self, name: str) -> None:
        self.fs.delete(self._at(name), True)


def build_index(spark: SparkSession, root: str, max_files: int = sources.MAX_FILES, previous: Index | None = None, respect_gitignore: bool = True, ignore: list[str] | None = None) -> Index:
    """Scan, read and parse what changed since previous; unchanged files keep their rows. meta has the counters of the run."""
    found, truncated = sources.scan_tree(spark, root, max_files, respect_gitignore, ignore)
    if previous is None:
        todo, kept = found, None
    else:
        before = previous.files.select("file_path", "mtime_ns", "hash")
        same = found.join(before.withColumnsRenamed({"file_path": "p", "mtime_ns": "m", "hash": "h"}), (F.col("file_path") == F.col("p")) & (F.col("mtime_ns") == F.col("m")), "left")
        todo, kept = same.where("p is null").select("file_path", "mtime_ns"), same.where("p is not null").select("file_path", "mtime_ns", F.col("h").alias("hash"))
    read = materialize(sources.read_sources(todo, root), "read")
    if previous is not None:
        equal = read.join(previous.files.select(F.col("file_path").alias("p"), F.col("hash").alias("h")), (F.col("file_path") == F.col("p")) & (F.col("hash") == F.col("h")), "left_semi")
        kept = kept.unionByName(equal.select("file_path", "mtime_ns", "hash"))
        read = read.join(equal.select("file_path"), "file_path", "left_anti")
    parsed = materialize(parse_files(read), "parsed")
    new = relations(parsed)
    ok = parsed.where("status <> 'failed'").select("file_path")
    new["files"] = read.join(ok, "file_path", "left_semi").select("file_path", "mtime_ns", "hash")
    skipped = kept.count() if kept is not None else 0
    if kept is not None:
        for t in TABLES[:-1]:
            new[t] = new[t].unionByName(previous.tables[t].join(kept.select("file_path"), "file_path", "left_semi"), allowMissingColumns=True)
        new["files"] = new["files"].unionByName(kept)
    reasons = read.select("file_path", "read_error").where("read_error is not null").withColumnRenamed("read_error", "reason").unionByName(parsed.where("status <> 'parsed' and reason <> 'parse: no content'").select("file_path", "reason")).orderBy("file_path")
    failures = [r.asDict() for r in reasons.limit(50).collect()]
    done = ok.count()
    degraded = parsed.where("status = 'degraded'").count()
    meta = {"root": root, "version": INDEX_VERSION, "indexed_at": int(time.time()), "scanned": found.count(), "parsed": done, "skipped": skipped, "truncated": truncated, "degraded": degraded, "failed": reasons.count() - degraded, "failures": failures}
    return Index({k: materialize(v, k) for k, v in new.items()}, meta).with_search()


def merge_roots(indexes: dict[str, tuple[str, Index]]) -> Index:
    """One index of {label: (root_id, index)}: symbols and edges carry [label], every table its root_id."""
    parts: dict[str, list[DataFrame]] = {t: [] for t in TABLES}
    for label, (root_id, ix) in indexes.items():
        for t in TABLES:
            df = ix.tables[t]
            parts[t].append(workspace.prefixed_symbols(df, label, root_id) if t == "symbols" else workspace.prefixed_edges(df, label, root_id) if t == "call_edges" else df.withColumn("root_id", F.lit(root_id)))
    return Index({t: workspace.union_all(p) for t, p in parts.items()}, {"version": INDEX_VERSION, "roots": {label: r for label, (r, _) in indexes.items()}})


class Engine:
    """Queries on an index; call() serves the same by method name and parameters, with JSON-RPC error codes."""

    METHODS = ("search", "refs", "callers", "callees", "outline", "symbol", "impact", "status", "path", "deps", "stats")

    def __init__(self, index: Index):
        self.index = index
        self.graph = CallGraph.stored(index.call_edges)
        self.edges = deps.deps_edges(index.imports, index.files)

    def search(self, query: str, limit: int = 20, offset: int = 0, kind: str | None = None, path: str | None = None) -> DataFrame:
        words = search.query_tokens(query)
        if "postings" in self.index.tables and words and all(len(w) == 1 for w in words) and not kind and not path:
            scores = search.bm25_lookup(self.index.postings, self.index.lengths, query, limit + offset)
            if not (scores := materialize(scores, "found")).isEmpty():
                page = self.index.symbols.join(scores, "id").orderBy(F.desc("score"), kind_priority("kind"), "name", "id")
                return (page.offset(offset) if offset else page).limit(limit).select("id", "name", "kind", "file_path", "signature", "score")
        return search.search(self.index.symbols, query, limit, offset, kind, path)

    def refs(self, name: str, kind: str | None = None, scope: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
        return symbols.refs(self.index.identifiers, name, kind, scope, limit, offset)

    def callers(self, name: str, limit: int = 20) -> DataFrame:
        return enriched(self.graph.callers(name).orderBy("name").limit(limit), self.index.symbols)

    def callees(self, name: str, limit: int = 20) -> DataFrame:
        return enriched(self.graph.callees(name).orderBy("name").limit(limit), self.index.symbols)

    def outline(self, file: str | None = None, depth: int = 3) -> DataFrame:
        return symbols.file_outline(self.index.symbols.where(F.col("file_path") == file)) if file else symbols.project_outline(self.index.symbols, depth)

    def symbol(self, name: str) -> DataFrame:
        return symbols.find_symbol(self.index.symbols, name)

    def impact(self, name: str, depth: int = 3) -> DataFrame:
        return self.graph.impact(name, depth)

    def path(self, source: str, target: str) -> DataFrame:
        return self.graph.path(source, target)

    def deps(self, file: str | None = None, reverse: bool = False) -> DataFrame:
        if not file:
            return self.edges
        return deps.dependents(self.edges, file) if reverse else deps.dependencies(self.edges, file)

    def stats(self) -> DataFrame:
        return symbols.stats_kind(self.index.symbols)

    def status(self) -> DataFrame:
        return symbols.stats_totals(self.index.symbols)

    def diff(self, root: str, old: str, new: str, kind: str | None = None) -> DataFrame:
        spark = self.index.symbols.sparkSession
        return changes.changed_symbols(sources.git_name_status(spark, root, old, new), sources.git_hunks(spark, root, old, new), self.index.symbols, kind)

    def export_sqlite(self, path: str) -> None:
        export.to_sqlite(path, self.index.symbols, self.index.call_edges, self.index.files.withColumnRenamed("file_path", "path"), {k: str(v) for k, v in self.index.meta.items()}, "roots" in self.index.meta)

    def call(self, method: str, params: dict | None = None) -> dict:
        if method not in self.METHODS:
            return {"error": {"code": -32601, "message": f"no method {method}"}}
        try:
            rows = getattr(self, method)(**(params or {})).toJSON().collect()
        except TypeError as e:
            return {"error": {"code": -32602, "message": str(e)}}
        except Exception as e:
            return {"error": {"code": -32603, "message": str(e)[:500]}}
        return {"result": [json.loads(x) for x in rows]}

    def handle(self, line: str) -> str:
        """One JSON-RPC request line to one response line."""
        try:
            request = json.loads(line)
        except ValueError:
            return json.dumps({"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "not JSON"}})
        if not isinstance(request, dict) or "method" not in request:
            return json.dumps({"jsonrpc": "2.0", "id": None, "error": {"code": -32600, "message": "not a request"}})
        return json.dumps({"jsonrpc": "2.0", "id": request.get("id"), **self.call(request["method"], request.get("params"))})
