"""Several projects as one: prefixes for ids, names and edges; removal of roots and files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.functions import file_display


def _tag(label: str, c: str) -> Column:
    return F.concat(F.lit(f"[{label}]"), F.col(c))


def prefixed_symbols(symbols: DataFrame, label: str, root_id: str) -> DataFrame:
    """Ids, qualified names, parents and children carry [label]; root_id is a column of its own."""
    out = symbols.withColumns({c: _tag(label, c) for c in ("id", "qualified_name", "parent") if c in symbols.columns})
    if "children" in symbols.columns:
        out = out.withColumn("children", F.transform("children", lambda x: F.concat(F.lit(f"[{label}]"), x)))
    return out.withColumn("root_id", F.lit(root_id))


def prefixed_edges(edges: DataFrame, label: str, root_id: str) -> DataFrame:
    """Both ends get the label of the caller's root."""
    return edges.withColumns({"caller": _tag(label, "caller"), "callee": _tag(label, "callee"), "root_id": F.lit(root_id)})


def union_all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def remove_root(table: DataFrame, root_id: str) -> DataFrame:
    return table.where(F.col("root_id") != root_id)


def remove_file(table: DataFrame, root_id: str, path: str) -> DataFrame:
    return table.where(~((F.col("root_id") == root_id) & (F.col("file_path") == path)))


def remove_keys(table: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return table.join(gone.select(*keys).distinct(), keys, "left_anti")


def resolve_root(roots: DataFrame, text: str) -> DataFrame:
    """The root of an id, else of a label, else of a path."""
    rank = F.when(F.col("root_id") == text, 0).when(F.col("label") == text, 1).when(F.col("root_path") == text, 2)
    return roots.withColumn("rank", rank).where("rank is not null").orderBy("rank", "root_id").limit(1).drop("rank")


def file_key(table: DataFrame, text: str) -> DataFrame:
    """The rows of the files that a text names, as their path or, where the table has labels, as [label]path; several roots may have one path."""
    hit = F.col("file_path") == text
    return table.where(hit | (file_display("label", "file_path") == text) if "label" in table.columns else hit)


def git_roots(symbols: DataFrame, roots: DataFrame) -> DataFrame:
    """(id, root_path) of each symbol: the longest root that its absolute path lies below; none for symbols outside all. roots: (root_path).

    Joined by the path's folders, not by comparing every symbol with every root.
    """
    parts = F.split("file_path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    each = symbols.where(F.size(parts) > 1).select("id", F.explode(above).alias("folder"))
    return each.join(roots.select(F.rtrim(roots["root_path"], F.lit("/")).alias("folder"), roots["root_path"].alias("root_path")), "folder").groupBy("id").agg(F.max_by("root_path", F.length("folder")).alias("root_path"))
