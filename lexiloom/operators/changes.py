"""Changes: symbols of changed files and hunks, blame records, and what an incremental run must parse again."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.functions import format_timestamp, ranges_overlap
from lexiloom.operators.search import kind_filter

SUPPORTED = ("rs", "ts", "tsx", "js", "jsx", "mts", "cts", "py", "swift", "go", "dart", "kt", "kts", "c", "h", "cpp", "cc", "cxx", "hpp", "hh", "vue")


def is_supported(path):
    return F.substring_index(path, ".", -1).isin(*SUPPORTED)


def changed_symbols(name_status: DataFrame, hunks: DataFrame, symbols: DataFrame, kind: str | None = None) -> DataFrame:
    """(file, name, kind, start_line, end_line, change): added files' symbols, modified files' symbols that meet a hunk, and deleted files.

    name_status: (status, file); hunks: (file, start, end). Of the rows of one file and name the first stays:
    Added, Modified, Deleted, then the order of the file.
    """
    own = symbols.select("file_path", "qualified_name", "kind", "start_line", "end_line", "ordinal")
    pick = lambda df, change, rank: df.select(F.col("file_path").alias("file"), F.col("qualified_name").alias("name"), "kind", "start_line", "end_line", F.lit(change).alias("change"), F.lit(rank).alias("rank"), "ordinal")
    files = lambda s: name_status.where((F.col("status") == s) & is_supported(F.col("file"))).select(F.col("file").alias("f"))
    added = pick(own.join(files("A"), F.col("file_path") == F.col("f"), "left_semi"), "Added", 0)
    near = (F.col("file_path") == hunks["file"]) & ranges_overlap(hunks["start"], hunks["end"], F.col("start_line"), F.col("end_line"))
    modified = pick(own.join(files("M"), F.col("file_path") == F.col("f"), "left_semi").join(hunks, near, "left_semi"), "Modified", 1)
    deleted = files("D").select(F.col("f").alias("file"), F.lit("[entire file deleted]").alias("name"), F.lit("module").alias("kind"), F.lit(0).alias("start_line"), F.lit(0).alias("end_line"), F.lit("Deleted").alias("change"), F.lit(2).alias("rank"), F.lit(0).cast("long").alias("ordinal"))
    every = kind_filter(added.unionByName(modified).unionByName(deleted), kind)
    first = F.row_number().over(Window.partitionBy("file", "name").orderBy("rank", "ordinal", "start_line"))
    return every.withColumn("rn", first).where("rn = 1").drop("rn", "rank", "ordinal")


def diff_counts(changes: DataFrame) -> DataFrame:
    return changes.groupBy("change").agg(F.count(F.lit(1)).alias("n"))


def by_file(changes: DataFrame) -> DataFrame:
    """(file, n, names): the changes of each file, which its symbols bound, in the order of their lines."""
    each = F.array_sort(F.collect_list(F.struct("start_line", "name", "change")))
    return changes.groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.transform(each, lambda x: F.concat(x["change"], F.lit(" "), x["name"])).alias("names"))


def blame_lines(raw: DataFrame) -> DataFrame:
    """(file, line, commit, author, timestamp, date, summary, content) of porcelain blame output, one row for each content line.

    raw: (file, line_no, raw). A record starts with a header '<commit> <from> <to>'; the metadata of a commit
    stands after its first header only, so it is looked up by commit.
    """
    text = F.col("raw")
    header = r"^(\S{20,}) (\d+) (\d+)( \d+)?$"
    order = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    is_header = ~text.startswith("\t") & text.rlike(header)
    last = lambda c: F.last(c, ignorenulls=True).over(order)
    rows = raw.select("file", "line_no", "raw", last(F.when(is_header, F.regexp_extract(text, header, 1))).alias("commit"), last(F.when(is_header, F.regexp_extract(text, header, 3).cast("int"))).alias("line"))
    word = lambda key: F.max(F.when(text.startswith(key), F.substring(text, len(key) + 1, 1 << 30)))
    meta = rows.where(text.rlike("^(author|author-time|committer-time|summary) ")).groupBy("file", "commit").agg(word("author ").alias("author"), word("author-time ").cast("long").alias("timestamp"), word("committer-time ").cast("long").alias("committed"), word("summary ").alias("summary"))
    lines = rows.where(text.startswith("\t")).join(meta, ["file", "commit"], "left")
    return lines.select("file", "line", "commit", "author", "timestamp", format_timestamp("committed").alias("date"), "summary", F.substring(text, 2, 1 << 30).alias("content"))


def blame_commits(blame: DataFrame) -> DataFrame:
    """(file, commit, author, timestamp, lines): the commits of each file, newest first."""
    return blame.groupBy("file", "commit").agg(F.max("author").alias("author"), F.max("timestamp").alias("timestamp"), F.count(F.lit(1)).alias("lines")).orderBy("file", F.desc("timestamp"), "commit")


def incremental_plan(current: DataFrame, previous: DataFrame) -> DataFrame:
    """(file_path, action) with action skip_mtime, skip_hash or parse for current files, and removed for those that are gone.

    Both: (file_path, mtime_ns, hash). Equal times save reading a file, equal hashes save parsing it.
    """
    p = previous.select(F.col("file_path").alias("old_path"), F.col("mtime_ns").alias("old_mtime"), F.col("hash").alias("old_hash"))
    action = F.when(F.col("file_path").isNull(), "removed").when(F.col("mtime_ns") == F.col("old_mtime"), "skip_mtime").when(F.col("hash") == F.col("old_hash"), "skip_hash").otherwise("parse")
    return current.join(p, current["file_path"] == p["old_path"], "full_outer").select(F.coalesce("file_path", "old_path").alias("file_path"), action.alias("action"))


def changed_roots(roots: DataFrame, files: DataFrame) -> DataFrame:
    """Roots, of (root_path), that contain one of the changed files, of (path)."""
    return roots.join(files, F.startswith(files["path"], F.concat(roots["root_path"], F.lit("/"))), "left_semi")

