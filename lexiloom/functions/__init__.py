"""Scalar functions over symbols, paths, code tokens and diffs: columns in, columns out, no Python on the executors."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexiloom.schemas import KIND_ALIASES, KIND_PRIORITY, LANGUAGES

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _map(d: dict) -> Column:
    return F.create_map(*[F.lit(x) for x in chain(*d.items())])


def symbol_id(path, qualified_name, kind, root=None) -> Column:
    """path::qualified#kind, with the prefix [root] where root isn't empty."""
    plain = F.concat(_c(path), F.lit("::"), _c(qualified_name), F.lit("#"), _c(kind))
    if root is None:
        return plain
    return F.when(_c(root) == "", plain).otherwise(F.concat(F.lit("["), _c(root), F.lit("]"), plain))


def id_root(id_) -> Column:
    return F.regexp_extract(_c(id_), r"^\[([^\]]*)\]", 1)


def _rest(id_) -> Column:
    return F.regexp_replace(_c(id_), r"^\[[^\]]*\]", "")


def id_file(id_) -> Column:
    return F.substring_index(_rest(id_), "::", 1)


def id_name(id_) -> Column:
    """Between the first :: and the last #; the whole rest where there is no ::."""
    return F.regexp_replace(F.regexp_replace(_rest(id_), "#[^#]*$", ""), "^.*?::", "")


def id_kind(id_) -> Column:
    rest = _rest(id_)
    return F.when(rest.contains("#"), F.substring_index(rest, "#", -1)).otherwise("")


def kind_alias(text) -> Column:
    """The kind that a user's word names, null for none."""
    return F.try_element_at(_map(KIND_ALIASES), F.lower(_c(text)))


def kind_priority(kind) -> Column:
    return F.coalesce(F.try_element_at(_map(KIND_PRIORITY), _c(kind)), F.lit(7))


def extension(path) -> Column:
    """After the last dot of the file name; null without one."""
    name = F.substring_index(_c(path), "/", -1)
    return F.when(name.rlike(r"^.+\.[^.]+$"), F.substring_index(name, ".", -1))


def detect_language(path) -> Column:
    ext = extension(path)
    return F.coalesce(F.try_element_at(_map(LANGUAGES), ext), ext, F.lit("unknown"))


def span_display(start, end) -> Column:
    return F.when(_c(start) == _c(end), F.concat(F.lit("L"), _c(start))).otherwise(F.concat(F.lit("L"), _c(start), F.lit("-"), _c(end)))


def short_name(name) -> Column:
    return F.substring_index(_c(name), "::", -1)


def extract_module(name) -> Column:
    """The first segment that isn't crate, self or super, without a [root]; null if there is none."""
    x = F.regexp_replace(_rest(name), r"^(?:(crate|self|super)(::|$))+", "")
    return F.nullif(F.substring_index(x, "::", 1), F.lit(""))


def module_name(path) -> Column:
    x = F.regexp_replace(_c(path), r"\.[^./]*$", "")
    return F.replace(F.replace(x, F.lit("/"), F.lit("::")), F.lit("src::"), F.lit(""))


def file_display(root, path) -> Column:
    return F.when(_c(root) == "", _c(path)).otherwise(F.concat(F.lit("["), _c(root), F.lit("]"), _c(path)))


def dir_of(path) -> Column:
    return F.when(_c(path).contains("/"), F.regexp_replace(_c(path), "/[^/]*$", "")).otherwise("")


def file_name(path) -> Column:
    return F.substring_index(_c(path), "/", -1)


def path_depth(path) -> Column:
    return F.when(_c(path) == "", 0).otherwise(F.size(F.split(_c(path), "/")))


def truncated(text, longest: int = 80, kept: int = 77) -> Column:
    return F.when(F.length(_c(text)) > longest, F.concat(F.substring(_c(text), 1, kept), F.lit("..."))).otherwise(_c(text))


def truncate_str(text, n: int) -> Column:
    return F.substring(_c(text), 1, n)


def content_hash(content) -> Column:
    return F.substring(F.sha2(_c(content), 256), 1, 16)


def root_id(path) -> Column:
    """Of a root's absolute path."""
    return F.substring(F.sha2(_c(path), 256), 1, 8)


def root_label(path) -> Column:
    """The last folder of a root's path, its id where there is none."""
    name = F.substring_index(F.rtrim(_c(path), F.lit("/")), "/", -1)
    return F.when(name == "", root_id(path)).otherwise(name)


def workspace_hash(hashes) -> Column:
    """Of an array of root hashes, in any order."""
    return F.substring(F.sha2(F.array_join(F.array_sort(_c(hashes)), ""), 256), 1, 16)


def format_timestamp(seconds) -> Column:
    return F.when(_c(seconds) == 0, "unknown").otherwise(F.date_format(F.timestamp_seconds(_c(seconds)), "yyyy-MM-dd"))


def age_str(seconds) -> Column:
    s = _c(seconds).cast("long")
    return F.when(s < 60, F.concat(s, F.lit("s ago"))).when(s < 3600, F.concat(F.floor(s / 60), F.lit("m ago"))).when(s < 86400, F.concat(F.floor(s / 3600), F.lit("h ago"))).otherwise(F.concat(F.floor(s / 86400), F.lit("d ago")))


def size_str(n) -> Column:
    n = _c(n)
    return F.when(n < 1024, F.concat(n.cast("long"), F.lit(" B"))).when(n < 1 << 20, F.format_string("%.1f KB", F.bround(n / 1024.0, 1))).otherwise(F.format_string("%.1f MB", F.bround(n / 1048576.0, 1)))


def code_tokens(text) -> Column:
    """Identifier-aware tokens: camel humps and every non-alphanumeric character separate, ASCII is lowered, tokens of one byte go."""
    humps = F.regexp_replace(_c(text), r"(?<=[\p{IsAlphabetic}\p{N}&&[^\p{IsUppercase}]])(?=\p{IsUppercase})|(?<=\p{IsUppercase})(?=\p{IsUppercase}\p{IsLowercase})", " ")
    return F.filter(F.split(F.translate(humps, _UPPER, _LOWER), r"[^\p{IsAlphabetic}\p{N}]+"), lambda t: F.octet_length(t) >= 2)


def fuzzy_match(term, query: str) -> Column:
    """Whether a prefix of the term is within one edit of the query, swapped neighbours being one edit."""
    t, n = _c(term), len(query)
    hit = F.lit(False)
    for k in {max(n - 1, 1), n, n + 1}:
        hit = hit | ((F.length(t) >= k) & (F.levenshtein(F.substring(t, 1, k), F.lit(query)) <= 1))
    swaps = sorted({query[:i] + query[i + 1] + query[i] + query[i + 2 :] for i in range(n - 1)} - {query})
    return hit | F.substring(t, 1, n).isin(swaps) if swaps else hit


def risk_score(dependents, reached, max_depth: int, modules) -> Column:
    depth = (_c(reached) / F.lit(float(max_depth))) if max_depth > 0 else F.lit(0.0)
    return F.least(F.lit(1.0), (F.log(_c(dependents) + F.lit(1.0)) / 6 + depth + F.log(_c(modules) + F.lit(1.0)) / 5) / 3)


def ranges_overlap(a_start, a_end, b_start, b_end) -> Column:
    return (_c(a_start) <= _c(b_end)) & (_c(b_start) <= _c(a_end))


def diff_range(line) -> Column:
    """(start, end) of the new side of a hunk header; null for other lines and for start 0."""
    pattern = r"^@@[^+]*\+(\d+)(?:,(\d+))?"
    start = F.try_to_number(F.nullif(F.regexp_extract(_c(line), pattern, 1), F.lit("")), F.lit("9999999999")).cast("int")
    count = F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(_c(line), pattern, 2), F.lit("")), F.lit("9999999999")).cast("int"), F.lit(1))
    return F.when(start > 0, F.struct(start.alias("start"), (start + F.greatest(count - 1, F.lit(0))).alias("end")))


def import_candidates(module_path) -> Column:
    """Paths that an import may mean, an array of (tier, path), best first; literal, crate, dotted, relative."""
    m = _c(module_path)
    slashed = F.replace(F.regexp_replace(m, "^crate::", "src/"), F.lit("::"), F.lit("/"))
    dotted = F.replace(m, F.lit("."), F.lit("/"))
    relative = F.regexp_replace(m, r"^(\./)+", "")
    path = lambda tier, x: F.struct(F.lit(tier).alias("tier"), x.alias("path"))
    none = F.array().cast("array<struct<tier:int,path:string>>")
    return F.concat(
        F.array(path(1, m)),
        F.when(m.startswith("crate::"), F.array(path(2, F.concat(slashed, F.lit(".rs"))), path(2, F.concat(slashed, F.lit("/mod.rs"))))).otherwise(none),
        F.when(m.contains(".") & ~m.contains("/") & ~m.contains("::"), F.array(*[path(3, F.concat(dotted, F.lit(e))) for e in (".py", "/__init__.py", ".kt")])).otherwise(none),
        F.when(m.startswith("./") | m.startswith("../"), F.array(*[path(4, F.concat(relative, F.lit(e))) for e in (".ts", ".tsx", ".js", "/index.ts")])).otherwise(none),
    )


def script_blocks(html) -> Column:
    """The contents of the <script> elements of a page, in order."""
    return F.regexp_extract_all(_c(html), F.lit(r"(?s)<script(?:\s[^>]*)?>(.*?)</script>"), F.lit(1))


def text_imports(source, kind: str) -> Column:
    """Import targets found line by line: kind 'include' (C family) or 'import' (Swift)."""
    pattern = r"""(?m)^[ \t]*#[ \t]*include[ \t]*[<"]([^>"\n]+)[>"]""" if kind == "include" else r"(?m)^[ \t]*import[ \t]+(?:class |struct |enum |protocol |func )?([A-Za-z_][\w.]*)"
    return F.regexp_extract_all(_c(source), F.lit(pattern), F.lit(1))
