"""Parsing files into symbols, call edges, imports and identifiers: one pass for each file, pluggable by extension."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiloom.extract import brace, python_
from lexiloom.schemas import EDGE, IDENTIFIER, IMPORT, SYMBOL

Extractor = Callable[[str, str], dict]
_EXTENSIONS = {"rust": "rs", "typescript": "ts tsx js jsx mts cts", "swift": "swift", "go": "go", "dart": "dart", "kotlin": "kt kts", "c": "c h", "cpp": "cpp cc cxx hpp hh"}
REGISTRY: dict[str, tuple[str, Extractor]] = {e: (lang, brace.extract) for lang, es in _EXTENSIONS.items() for e in es.split()}
REGISTRY["py"] = ("python", python_.extract)


def script_blocks(text: str) -> list[tuple[str, int]]:
    """(content, lines before it) of each <script> block."""
    return [(m[1], text.count("\n", 0, m.start(1))) for m in re.finditer(r"(?is)<script(?:\s[^>]*)?>(.*?)</script>", text)]


def _vue(text: str, lang: str) -> dict:
    out: dict = {"symbols": [], "call_edges": [], "imports": [], "identifiers": []}
    for body, shift in script_blocks(text):
        part = brace.extract(body, "typescript")
        for s in part["symbols"]:
            s["span"]["start_line"] += shift
            s["span"]["end_line"] += shift
        for i in part["identifiers"]:
            i["line"] += shift
        for k in out:
            out[k] += part[k]
    return out


REGISTRY["vue"] = ("vue", _vue)


def register(extension: str, language: str, extractor: Extractor) -> None:
    """Add or replace the extractor of an extension."""
    REGISTRY[extension] = (language, extractor)


def extract_all(path: str, text: str) -> dict:
    """The four relations of one file with ids, parents and children filled in; unknown extensions give empty ones."""
    ext = path.rpartition(".")[2]
    if ext not in REGISTRY:
        return {"symbols": [], "call_edges": [], "imports": [], "identifiers": []}
    lang, extractor = REGISTRY[ext]
    out = extractor(text, lang)
    ids = {}
    for s in out["symbols"]:
        s["file_path"], s["id"] = path, f"{path}::{s['qualified_name']}#{s['kind']}"
        ids.setdefault((s["qualified_name"], s["kind"]), s)
        s["children"] = []
    for s in out["symbols"]:
        owner = s.pop("owner")
        s["parent"] = f"{path}::{owner[0]}#{owner[1]}" if owner else None
        if owner and owner in ids:
            ids[owner]["children"].append(s["id"])
    return out


_STATUS = [T.StructField("status", T.StringType()), T.StructField("reason", T.StringType())]
_SCHEMA = T.StructType([T.StructField("file_path", T.StringType()), T.StructField("symbols", T.ArrayType(SYMBOL)), T.StructField("call_edges", T.ArrayType(EDGE)), T.StructField("imports", T.ArrayType(IMPORT)), T.StructField("identifiers", T.ArrayType(IDENTIFIER)), *_STATUS])


_DEFINITION = re.compile(r"^([ \t]*)(?:async[ \t]+)?(def|class)[ \t]+([A-Za-z_]\w*)", re.M)


def degraded(path: str, text: str) -> list[dict]:
    """Symbols of a file that its extractor can't parse, by its lines alone; for Python, whose extractor needs the whole file to be right."""
    if not path.endswith(".py"):
        return []
    out = []
    for m in _DEFINITION.finditer(text):
        line = text.count("\n", 0, m.start()) + 1
        kind = "class" if m[2] == "class" else "method" if m[1] else "function"
        head = text[m.start() : text.find("\n", m.start()) if "\n" in text[m.start() :] else len(text)].strip()
        out.append({"id": f"{path}::{m[3]}#{kind}", "name": m[3], "qualified_name": m[3], "kind": kind, "file_path": path, "span": {"start_line": line, "end_line": line, "start_col": len(m[1]), "end_col": len(m[1]) + len(head)}, "signature": head, "doc_comment": None, "visibility": "Private" if m[3].startswith("_") else "Public", "parent": None, "children": []})
    return out


def parse_files(files: DataFrame) -> DataFrame:
    """(file_path, symbols, call_edges, imports, identifiers, status, reason) of a table of (file_path, content).

    content may be text or bytes. Where a file's own extractor fails, what a tolerant scan finds of its symbols
    is kept, status is degraded and the other relations are empty; if that finds none either, status is
    failed, with no rows. Null content is failed too. Each file is parsed once; write the result before exploding it several times.
    """
    custom = {k: v for k, v in REGISTRY.items()}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        REGISTRY.update(custom)
        for b in batches:
            rows = []
            for path, content in zip(b["file_path"], b["content"]):
                try:
                    if content is None:
                        raise ValueError("no content")
                    text = bytes(content).decode("utf-8", "replace") if isinstance(content, bytes | bytearray | memoryview) else content
                    rows.append((path, *(extract_all(path, text)[k] for k in ("symbols", "call_edges", "imports", "identifiers")), "parsed", None))
                except (SyntaxError, ValueError, RecursionError) as e:
                    found = degraded(path, text) if content is not None else []
                    rows.append((path, found, [], [], [], "degraded" if found else "failed", f"parse: {e}"))
            yield pd.DataFrame(rows, columns=[f.name for f in _SCHEMA.fields])

    return files.select("file_path", "content").mapInPandas(run, _SCHEMA)


def relations(parsed: DataFrame) -> dict[str, DataFrame]:
    """The four tables of parse_files; symbols keep the order of their file in ordinal."""
    s = parsed.select(F.posexplode("symbols").alias("ordinal", "s")).select("s.*", F.col("ordinal").cast("long")).withColumns({"start_line": F.col("span.start_line"), "end_line": F.col("span.end_line")})
    return {
        "symbols": s,
        "call_edges": parsed.select("file_path", F.inline("call_edges")),
        "imports": parsed.select("file_path", F.inline("imports")),
        "identifiers": parsed.select("file_path", F.inline("identifiers")),
    }


__all__ = ["REGISTRY", "extract_all", "parse_files", "register", "relations", "script_blocks"]
