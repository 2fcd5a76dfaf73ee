"""Relational queries over symbols, references and imports: lookups, outlines, counts and inverted indexes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.functions import detect_language, dir_of, file_name, path_depth
from lexiloom.schemas import REF_ALIASES

OUTLINE_KINDS = ("function", "struct", "class", "interface", "enum")


def last_wins(file_symbols: DataFrame) -> DataFrame:
    """One row for each id, that of the highest ordinal."""
    w = Window.partitionBy("id").orderBy(F.desc("ordinal"))
    return file_symbols.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def lookup(symbols: DataFrame, id_: str) -> DataFrame:
    return symbols.where(F.col("id") == id_)


def find_symbol(symbols: DataFrame, name: str, workspace: bool = False) -> DataFrame:
    """The best symbol for a name: by id, qualified name, then name; in a workspace by name, then by the end of the qualified name."""
    if workspace:
        rank = F.when(F.col("name") == name, 0).when(F.col("qualified_name").endswith(name), 1)
    else:
        rank = F.when(F.col("id") == name, 0).when(F.col("qualified_name") == name, 1).when(F.col("name") == name, 2)
    return symbols.withColumn("rank", rank).where("rank is not null").orderBy("rank", "id").limit(1).select("id", "name", "qualified_name", "kind", "file_path", "rank")


def symbols_in_file(symbols: DataFrame, path: str | None = None) -> DataFrame:
    """(file_path, n, symbols): the names of a file, or of each, in its order."""
    own = symbols.where(F.col("file_path") == path) if path else symbols
    return own.groupBy("file_path").agg(F.count(F.lit(1)).alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "name"))), lambda x: x["name"]).alias("names"))


def file_outline(symbols: DataFrame) -> DataFrame:
    """(file_path, symbol, child, is_last): top-level symbols of each file and their children, is_last marking the last child."""
    top = symbols.where("parent is null").select("file_path", F.col("id").alias("pid"), F.col("qualified_name").alias("symbol"))
    kids = symbols.where("parent is not null").select(F.col("parent").alias("cp"), F.col("qualified_name").alias("child"), F.col("ordinal").alias("child_at"))
    both = top.join(kids, F.col("pid") == F.col("cp"), "left")
    last = F.row_number().over(Window.partitionBy("pid").orderBy("child_at")) == F.count(F.lit(1)).over(Window.partitionBy("pid"))
    return both.select("file_path", "symbol", "child", F.when(F.col("child").isNotNull(), last).alias("is_last"))


def project_outline(symbols: DataFrame, depth: int = 3) -> DataFrame:
    """(dir, files, symbols) of each directory of at most that depth."""
    return symbols.withColumn("dir", dir_of("file_path")).where(path_depth("dir") <= depth).groupBy("dir").agg(F.countDistinct("file_path").alias("files"), F.count(F.lit(1)).alias("symbols"))


def top_names(symbols: DataFrame, n: int = 5) -> DataFrame:
    """(file_path, file_name, names): the first n top-level names of each file, in its order."""
    own = symbols.where(F.col("parent").isNull() & F.col("kind").isin(*OUTLINE_KINDS))
    first = own.withColumn("rn", F.row_number().over(Window.partitionBy("file_path").orderBy("ordinal"))).where(F.col("rn") <= n)
    return first.groupBy("file_path").agg(F.transform(F.array_sort(F.collect_list(F.struct("rn", "name"))), lambda x: x["name"]).alias("names")).withColumn("file_name", file_name("file_path"))


def stats_language(file_symbols: DataFrame) -> DataFrame:
    return file_symbols.groupBy(detect_language("file_path").alias("language")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "language")


def stats_kind(symbols: DataFrame) -> DataFrame:
    return symbols.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "kind")


def stats_totals(symbols: DataFrame) -> DataFrame:
    return symbols.agg(F.countDistinct("file_path").alias("total_files"), F.count(F.lit(1)).alias("total_symbols"))


def count_maps(symbols: DataFrame) -> DataFrame:
    """One row of maps by_language and by_kind, from names to numbers of symbols; languages and kinds are few."""
    of = lambda key, name: symbols.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "n")))).alias(name))
    return of(detect_language("file_path"), "by_language").crossJoin(of(F.col("kind"), "by_kind"))


def files_per_language(files: DataFrame) -> DataFrame:
    """(language, files, bytes) of a table of (file_path, bytes)."""
    return files.groupBy(detect_language("file_path").alias("language")).agg(F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes"))


def ref_filter(identifiers: DataFrame, name: str, kind: str | None = None, scope: str | None = None) -> DataFrame:
    """The uses of a name: definitions never count, unknown kinds filter nothing, scope is a path prefix."""
    own = identifiers.where((F.col("name") == name) & (F.col("ref_kind") != "Definition"))
    if kind and kind.lower() in REF_ALIASES:
        own = own.where(F.col("ref_kind") == REF_ALIASES[kind.lower()])
    return own.where(F.col("file_path").startswith(scope)) if scope else own


def refs(identifiers: DataFrame, name: str, kind: str | None = None, scope: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    page = ref_filter(identifiers, name, kind, scope).orderBy("file_path", "line", "ref_kind", "context")
    return (page.offset(offset) if offset else page).limit(limit).select("file_path", "line", "context", "ref_kind")


def refs_breakdown(identifiers: DataFrame, name: str | None = None) -> DataFrame:
    """(name, calls, types, imports, other, total) of a name, or of every name."""
    own = ref_filter(identifiers, name) if name else identifiers.where("ref_kind <> 'Definition'")
    k = F.col("ref_kind")
    return own.groupBy("name").agg(
        F.count_if(k.isin("Call", "Constructor")).alias("calls"), F.count_if(k == "TypeRef").alias("types"), F.count_if(k == "Import").alias("imports"),
        F.count_if(~k.isin("Call", "Constructor", "TypeRef", "Import")).alias("other"), F.count(F.lit(1)).alias("total"),
    )


def identifier_index(identifiers: DataFrame) -> DataFrame:
    """(name, files): the distinct files of each name, sorted. One exchange, by name; repeats within a file are better left out before it."""
    own = identifiers.select("name", "file_path").repartition("name")  # so the aggregate needs no exchange of lists
    return own.groupBy("name").agg(F.array_distinct(F.sort_array(F.collect_list("file_path"))).alias("files"))


def import_names(imports: DataFrame) -> DataFrame:
    """(name, files): the importing files of each imported name, repeats kept, sorted."""
    own = imports.select("file_path", F.explode("names").alias("name")).repartition("name")
    return own.groupBy("name").agg(F.sort_array(F.collect_list("file_path")).alias("files"))


def index_counters(parsed: DataFrame, listed: int = 50) -> DataFrame:
    """One row of counters of (file_path, status, reason): status is parsed, skip_mtime, skip_hash, degraded, failed or truncated."""
    s = F.col("status")
    first = parsed.where(s == "failed").orderBy("file_path").limit(listed).agg(F.array_sort(F.collect_list(F.struct("file_path", "reason"))).alias("failures"))
    return parsed.agg(
        F.count_if(s != "truncated").alias("scanned"), F.count_if(s.isin("parsed", "degraded")).alias("parsed"), F.count_if(s.startswith("skip")).alias("skipped"),
        F.count_if(s == "truncated").alias("truncated"), F.count_if(s == "failed").alias("failed"), F.count_if(s == "degraded").alias("degraded"),
    ).crossJoin(first)
