"""Extractor for Python by the standard library's syntax tree."""

from __future__ import annotations

import ast
import io
import keyword
import tokenize


def _signature(lines: list[str], node: ast.AST) -> str:
    end = node.body[0].lineno if node.body[0].lineno > node.lineno else node.lineno
    head = " ".join(x.strip() for x in lines[node.lineno - 1 : max(node.lineno, end - 1)])
    return head.split('"""')[0].strip().rstrip(":").strip()


def _callee(f: ast.expr) -> str | None:
    return f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else None


def extract(text: str, lang: str = "python") -> dict:
    """Raises SyntaxError for a file that isn't Python; the caller records it."""
    tree, lines = ast.parse(text), text.split("\n")
    symbols, edges, imports = [], [], []

    def span(n: ast.AST) -> dict:
        return {"start_line": n.lineno, "end_line": n.end_lineno, "start_col": n.col_offset, "end_col": n.end_col_offset}

    def calls(n: ast.AST, caller: str) -> None:
        for x in ast.walk(n):
            if isinstance(x, ast.Call) and (name := _callee(x.func)):
                edges.append({"caller": caller, "callee": name})

    def add(n, kind: str, owner: dict | None) -> dict:
        s = {"name": n.name, "qualified_name": f"{owner['qualified_name']}::{n.name}" if owner else n.name, "kind": kind, "span": span(n), "signature": _signature(lines, n), "doc_comment": ast.get_docstring(n), "visibility": "Public", "owner": (owner["qualified_name"], owner["kind"]) if owner else None}
        symbols.append(s)
        return s

    def visit(body: list, owner: dict | None) -> None:
        for n in body:
            if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef):
                add(n, "method" if owner else "function", owner)
                calls(n, n.name)
            elif isinstance(n, ast.ClassDef):
                visit(n.body, add(n, "class", owner))
            elif isinstance(n, ast.If | ast.Try) and not owner:
                visit(n.body, owner)

    visit(tree.body, None)
    for n in ast.walk(tree):
        if isinstance(n, ast.Import):
            imports.append({"module_path": n.names[-1].name, "names": [a.name for a in n.names]})
        elif isinstance(n, ast.ImportFrom) and (names := [a.name for a in n.names if a.name != "*"]):
            imports.append({"module_path": "." * n.level + (n.module or ""), "names": names})
    defined = {(s["span"]["start_line"], s["name"]) for s in symbols}
    identifiers = []
    tokens = list(tokenize.generate_tokens(io.StringIO(text).readline))
    for i, t in enumerate(tokens):
        if t.type != tokenize.NAME or keyword.iskeyword(t.string):
            continue
        before, after = tokens[i - 1].string if i else "", tokens[i + 1].string if i + 1 < len(tokens) else ""
        raw = t.line.strip()
        if before in ("def", "class") or (t.start[0], t.string) in defined and before in ("def", "class"):
            kind = "Definition"
        elif raw.startswith(("import ", "from ")):
            kind = "Import"
        elif after == "(":
            kind = "Constructor" if t.string[:1].isupper() else "Call"
        elif before == ".":
            kind = "FieldAccess"
        elif before in (":", "->") or t.string[:1].isupper():
            kind = "TypeRef"
        else:
            kind = "Unknown"
        identifiers.append({"name": t.string, "line": t.start[0], "context": raw[:120], "ref_kind": kind})
    return {"symbols": symbols, "call_edges": edges, "imports": imports, "identifiers": identifiers}
