"""File dependencies from imports: resolution in tiers, neighbours, cycles and a Mermaid export."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.durable import materialize
from lexiloom.functions import import_candidates, module_name


def deps_edges(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(src_file, dst_file): each import's best match among the known files; an import of its own file is dropped.

    Tiers: the literal path, crate paths, dotted paths, relative paths, and last a file whose stem is the last
    segment (the smallest path). imports: (file_path, module_path); files: (file_path).
    """
    wanted = imports.select("file_path", "module_path").where("module_path is not null").distinct()
    tries = wanted.select("module_path").distinct().select("module_path", F.posexplode(import_candidates("module_path")).alias("pos", "c")).select("module_path", "pos", "c.*")
    known = files.select(F.col("file_path").alias("known")).distinct()
    exact = tries.join(known, F.col("path") == F.col("known")).select("module_path", F.struct("tier", "pos", F.col("known").alias("dst")).alias("hit"))
    stems = known.groupBy(F.regexp_replace(F.substring_index("known", "/", -1), r"\.[^.]*$", "").alias("stem")).agg(F.min("known").alias("dst"))
    last = wanted.select("module_path").distinct().withColumn("stem", F.substring_index("module_path", "::", -1))
    by_stem = last.join(stems, "stem").select("module_path", F.struct(F.lit(5).alias("tier"), F.lit(0).alias("pos"), "dst").alias("hit"))
    best = exact.union(by_stem).groupBy("module_path").agg(F.min("hit").alias("hit"))
    return wanted.join(best, "module_path").select(F.col("file_path").alias("src_file"), F.col("hit.dst").alias("dst_file")).where("src_file <> dst_file").distinct()


def dependencies(edges: DataFrame, file: str) -> DataFrame:
    return edges.where(F.col("src_file") == file).select(F.col("dst_file").alias("file"))


def dependents(edges: DataFrame, file: str) -> DataFrame:
    return edges.where(F.col("dst_file") == file).select(F.col("src_file").alias("file"))


def modules(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src_file", "dst_file")).alias("file")).distinct().select(module_name("file").alias("module")).distinct()


def cycle_members(edges: DataFrame) -> DataFrame:
    """(file): files on a cycle, self-loops included.

    Files that nothing imports or that import nothing are peeled off until none is left; then the
    strongly connected components of the rest are found by forward and backward labels: everyone takes
    the smallest label that reaches it and that it reaches, and files whose two labels agree with a
    pivot form its component and leave. Each round is a few shuffles of the remaining edges.
    """
    loops = edges.where("src_file = dst_file").select(F.col("src_file").alias("file"))
    e = materialize(edges.where("src_file <> dst_file").select(F.col("src_file").alias("u"), F.col("dst_file").alias("v")).distinct(), "deps")
    found = loops.distinct()
    while True:
        e, size = _peel(e)
        if not size:
            return found.distinct()
        ahead, behind = _least(e, "u", "v"), _least(e, "v", "u")
        labels = materialize(ahead.withColumnRenamed("label", "f").join(behind.withColumnRenamed("label", "b"), "node"), "deps")
        inside = labels.where("f = b").select("node")
        found = materialize(found.union(inside.select(F.col("node").alias("file"))), "deps")
        # components never span different labels, so edges between them can go as well
        a, b = labels.select(F.col("node").alias("u"), F.col("f").alias("fu"), F.col("b").alias("bu")), labels.select(F.col("node").alias("v"), F.col("f").alias("fv"), F.col("b").alias("bv"))
        e = materialize(e.join(a, "u").join(b, "v").where("fu = fv and bu = bv and fu <> bu").select("u", "v"), "deps")


def _peel(e: DataFrame) -> tuple[DataFrame, int]:
    """Edges without those that leave a node no edge enters, or enter one no edge leaves, repeatedly; and how many are left."""
    size = e.count()
    while size:
        kept = materialize(e.join(e.select(F.col("v").alias("u")).distinct(), "u", "left_semi").join(e.select(F.col("u").alias("v")).distinct(), "v", "left_semi").select("u", "v"), "deps")
        now = kept.count()
        if now == size:
            return kept, now
        e, size = kept, now
    return e, 0


def _least(e: DataFrame, at: str, to: str) -> DataFrame:
    """(node, label): the smallest node that reaches each along the edges, itself included."""
    labels = e.select(F.explode(F.array("u", "v")).alias("node")).distinct().withColumn("label", F.col("node"))
    while True:
        moved = e.join(labels, F.col(at) == F.col("node")).groupBy(F.col(to).alias("node")).agg(F.min("label").alias("near"))
        new = materialize(labels.join(moved, "node", "left").select("node", "label", F.least("label", F.coalesce("near", "label")).alias("new")), "deps")
        labels = new.select("node", F.col("new").alias("label"))
        if new.where("new <> label").isEmpty():
            return labels


def has_cycle_from(edges: DataFrame, file: str) -> bool:
    """Whether a file is on a cycle: frontiers over the edges until they are empty or the file is met again."""
    frontier = seen = materialize(dependencies(edges, file).distinct(), "deps")
    while True:
        if not seen.where(F.col("file") == file).isEmpty():
            return True
        step = edges.join(frontier, edges["src_file"] == frontier["file"], "left_semi").select(F.col("dst_file").alias("file")).distinct()
        frontier = materialize(step.join(seen, "file", "left_anti"), "deps")
        if frontier.isEmpty():
            return False
        seen = seen.unionByName(frontier)


def cycle_heads(edges: DataFrame) -> list[str]:
    """Files on cycles in sorted order, each hiding everything that it reaches. The cycle members' edges come to the driver: a report, not an operator for large graphs."""
    members = {r["file"] for r in cycle_members(edges).collect()}
    out: dict[str, set[str]] = {}
    for r in edges.collect():
        out.setdefault(r["src_file"], set()).add(r["dst_file"])
    heads, hidden = [], set()
    for f in sorted(set(out)):
        if f in hidden:
            continue
        stack, reach = [f], set()
        while stack:
            for x in out.get(stack.pop(), ()):
                if x not in reach:
                    reach.add(x)
                    stack.append(x)
        if f in members:
            heads.append(f)
        hidden |= reach | {f}
    return heads


def to_mermaid(edges: DataFrame) -> DataFrame:
    """(line): an edge of a Mermaid graph for each dependency; mermaid_text joins them."""
    return edges.select(F.concat(F.lit("    "), module_name("src_file"), F.lit(" --> "), module_name("dst_file")).alias("line"))


def mermaid_text(edges: DataFrame) -> DataFrame:
    """(text): the whole graph in one row, lines in order of their files."""
    return to_mermaid(edges).agg(F.concat(F.lit("graph TD\n"), F.array_join(F.array_sort(F.collect_list("line")), "\n")).alias("text"))
