"""A tolerant extractor for languages with braces: comments and strings are masked, declarations found level by level.

It reads no grammar. Bodies of functions aren't searched for declarations, bodies of types are; whatever it
can't read it skips, and it never fails on a broken file.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass, field

_ID = r"[A-Za-z_$][\w$]*"
_MASK = re.compile(r"""//[^\n]*|/\*.*?(?:\*/|\Z)|\"\"\".*?(?:\"\"\"|\Z)|"(?:\\.|[^"\\\n])*"|`(?:\\.|[^`\\])*`|'(?:\\.|[^'\\\n])'|'(?:\\[^\n']*|[^'\\\n]{2,})'""", re.S)
_RUST_MASK = re.compile(r"""//[^\n]*|/\*.*?(?:\*/|\Z)|r#*".*?"#*|"(?:\\.|[^"\\])*"|'(?:\\.[^']*|[^'\\\n])'""", re.S)
KEYWORDS = frozenset("if else for while loop match switch case return break continue fn func fun def function class struct enum interface trait impl type let var val const static pub public private protected internal mod use import package new in of as is when where guard do try catch throw throws async await yield self this super Self true false null nil None void int char bool float double unsigned long short sizeof typeof extends implements override open final abstract mutating init deinit extension protocol namespace template typename using include define ifdef ifndef endif export default from require mut ref move dyn unsafe extern crate go defer select chan map range inline virtual operator delete with show hide mixin typedef factory late required get set data object companion suspend lateinit sealed".split())


@dataclass
class Spec:
    """decls: (kind, regex with the group name) tried in order at each position; a kind ending in '*' has members."""

    decls: list[tuple[str, str]]
    imports: list[str]
    method: str = ""
    member: list[tuple[str, str]] = field(default_factory=list)
    callee: str = "last"
    visibility: str = "keyword"
    type_kind: str = "class"


#: Words that can stand before a parenthesis or a brace and never name a declaration.
_RESERVED = frozenset("if else for while loop match switch case return break continue do try catch throw super this self sizeof typeof function fn func fun class struct enum interface when".split())
_MODS = r"(?:(?:pub(?:\([^)]*\))?|public|private|protected|internal|open|final|abstract|static|async|override|export|default|declare|const|inline|unsafe|extern|virtual|explicit|friend|mutating|suspend|sealed|data|companion|fileprivate|required|convenience|external|late|factory|base|constexpr)\s+)*"
SPECS = {
    "rust": Spec([("impl*", rf"impl(?:\s*<[^{{;]*?>)?\s+(?:[^{{;]*?\bfor\s+)?(?P<name>{_ID})"), ("function", rf"{_MODS}fn\s+(?P<name>{_ID})"), ("struct*", rf"{_MODS}struct\s+(?P<name>{_ID})"), ("enum*", rf"{_MODS}enum\s+(?P<name>{_ID})"), ("interface", rf"{_MODS}trait\s+(?P<name>{_ID})"), ("skip", rf"{_MODS}mod\s+(?P<name>{_ID})"), ("constant", rf"{_MODS}(?:const|static)\s+(?:mut\s+)?(?P<name>{_ID})\s*:"), ("type_alias", rf"{_MODS}type\s+(?P<name>{_ID})"), ("macro", rf"macro_rules!\s*(?P<name>{_ID})")], [r"^\s*(?:pub(?:\([^)]*\))?\s+)?use\s+([^;]+);"], callee="rust", visibility="rust", type_kind="struct"),
    "typescript": Spec([("function", rf"{_MODS}function\*?\s+(?P<name>{_ID})"), ("class*", rf"{_MODS}class\s+(?P<name>{_ID})"), ("interface", rf"{_MODS}interface\s+(?P<name>{_ID})"), ("enum", rf"{_MODS}enum\s+(?P<name>{_ID})"), ("type_alias", rf"{_MODS}type\s+(?P<name>{_ID})[^=;\n]*="), ("function", rf"(?:export\s+)?(?:const|let|var)\s+(?P<name>{_ID})[^=;\n]*=\s*(?:async\s+)?(?:function\b|\([^()]*\)[^=\n{{]*=>|{_ID}\s*=>)"), ("constant", rf"(?:export\s+)?(?:const|let|var)\s+(?P<name>{_ID})")], [r"""^\s*(?:import|export)\s+(.+?)\s+from\s+['"]([^'"\n]+)['"]"""], method=rf"{_MODS}(?:get\s+|set\s+|readonly\s+)?(?P<name>#?{_ID})\s*(?:<[^>]*>)?\(", member=[("field", rf"{_MODS}(?:readonly\s+)?(?P<name>#?{_ID})\s*[?!]?\s*[:=]")], visibility="export"),
    "swift": Spec([("function", rf"{_MODS}func\s+(?P<name>{_ID})"), ("class*", rf"{_MODS}(?:class|actor|extension)\s+(?P<name>{_ID})"), ("struct*", rf"{_MODS}struct\s+(?P<name>{_ID})"), ("enum*", rf"{_MODS}(?:indirect\s+)?enum\s+(?P<name>{_ID})"), ("interface", rf"{_MODS}protocol\s+(?P<name>{_ID})")], [r"^\s*import\s+(?:class |struct |enum |protocol |func )?([\w.]+)"], visibility="internal"),
    "go": Spec([("method", rf"func\s*\(\s*(?:{_ID}\s+)?\*?\s*(?P<recv>{_ID})[^)]*\)\s*(?P<name>{_ID})"), ("function", rf"func\s+(?P<name>{_ID})"), ("struct", rf"type\s+(?P<name>{_ID})(?:\[[^\]]*\])?\s+struct\b"), ("interface", rf"type\s+(?P<name>{_ID})(?:\[[^\]]*\])?\s+interface\b"), ("type_alias", rf"type\s+(?P<name>{_ID})"), ("constant", rf"const\s+(?P<name>{_ID})"), ("variable", rf"var\s+(?P<name>{_ID})")], [], callee="full", visibility="capital", type_kind="struct"),
    "dart": Spec([("interface*", rf"(?:abstract\s+(?:interface\s+)?class|(?:base\s+)?mixin)\s+(?P<name>{_ID})"), ("class*", rf"{_MODS}class\s+(?P<name>{_ID})"), ("class*", rf"extension\s+(?P<name>{_ID})"), ("enum", rf"enum\s+(?P<name>{_ID})"), ("type_alias", rf"typedef\s+(?P<name>{_ID})"), ("constant", rf"(?:const|final|var)\s+(?:{_ID}(?:<[^>]*>)?\??\s+)?(?P<name>{_ID})\s*="), ("function", rf"{_MODS}(?:{_ID}(?:<[^(){{}};]*>)?\??\s+)?(?P<name>{_ID})\s*\([^;{{}}]*\)\s*(?:async\*?\s*)?(?=\{{|=>)")], [r"""^\s*(?:import|export)\s+['"]([^'"\n]+)['"]([^;]*);"""], method=rf"{_MODS}(?:(?:{_ID}(?:<[^(){{}};]*>)?\??\s+)?(?:get\s+|set\s+)?)?(?P<name>{_ID}(?:\.{_ID})?)\s*\(", member=[("field", rf"{_MODS}(?:final\s+|var\s+)?{_ID}(?:<[^(){{}};]*>)?\??\s+(?P<name>{_ID})\s*[=;]")], visibility="underscore"),
    "kotlin": Spec([("enum", rf"{_MODS}enum\s+class\s+(?P<name>{_ID})"), ("interface*", rf"{_MODS}(?:fun\s+)?interface\s+(?P<name>{_ID})"), ("class*", rf"{_MODS}(?:annotation\s+|inner\s+|value\s+)?class\s+(?P<name>{_ID})"), ("class*", rf"{_MODS}object\s+(?P<name>{_ID})"), ("function", rf"{_MODS}(?:operator\s+|infix\s+)?fun\s+(?:<[^>]*>\s*)?(?:{_ID}(?:<[^>]*>)?\.)?(?P<name>{_ID})"), ("type_alias", rf"{_MODS}typealias\s+(?P<name>{_ID})"), ("constant", rf"{_MODS}val\s+(?P<name>{_ID})"), ("variable", rf"{_MODS}(?:lateinit\s+)?var\s+(?P<name>{_ID})")], [r"^\s*import\s+([\w.*]+)"], visibility="kotlin"),
    "c": Spec([("macro", rf"#[ \t]*define[ \t]+(?P<name>{_ID})"), ("enum", rf"typedef\s+enum\b[^{{;]*\{{[^}}]*\}}\s*(?P<name>{_ID})"), ("struct", rf"typedef\s+struct\b[^{{;]*\{{[^}}]*\}}\s*(?P<name>{_ID})"), ("type_alias", rf"typedef\s+[^;{{]*?(?P<name>{_ID})\s*;"), ("struct", rf"struct\s+(?P<name>{_ID})\s*(?=\{{)"), ("enum", rf"enum\s+(?P<name>{_ID})\s*(?=\{{)"), ("function", rf"(?:{_ID}[\s*]+)+(?P<name>{_ID})\s*\([^;{{}}]*\)\s*(?=\{{)"), ("variable", rf"(?:{_ID}[\s*]+)+(?P<name>{_ID})(?:\[[^\]]*\])*\s*=(?!=)")], [r"""^[ \t]*#[ \t]*include[ \t]*[<"]([^>"\n]+)"""], visibility="static"),
    "cpp": Spec([("macro", rf"#[ \t]*define[ \t]+(?P<name>{_ID})"), ("module*", rf"namespace\s+(?P<name>[\w:]+)"), ("enum", rf"enum\s+(?:class\s+|struct\s+)?(?P<name>{_ID})"), ("class*", rf"(?:template\s*<[^>]*>\s*)?class\s+(?P<name>{_ID})(?=[^;(]*\{{)"), ("struct*", rf"(?:template\s*<[^>]*>\s*)?struct\s+(?P<name>{_ID})(?=[^;(]*\{{)"), ("type_alias", rf"using\s+(?P<name>{_ID})\s*="), ("type_alias", rf"typedef\s+[^;{{]*?(?P<name>{_ID})\s*;"), ("function", rf"(?:template\s*<[^>]*>\s*)?(?:[\w:<>,&*]+[\s*&]+)+(?P<name>[\w:~]+)\s*\([^;{{}}]*\)[^;{{}}()]*(?=\{{)")], [r"""^[ \t]*#[ \t]*include[ \t]*[<"]([^>"\n]+)"""], method=rf"{_MODS}(?:[\w:<>,&*]+[\s*&]+)*?(?P<name>~?{_ID})\s*\(", member=[("field", rf"(?:[\w:<>,]+[\s*&]+)+(?P<name>{_ID})\s*(?:=[^;]*|\{{[^}}]*\}})?;")], visibility="access"),
}
_ACCESS = re.compile(r"\b(public|private|protected)\s*:(?!:)")


def _blank(m: re.Match) -> str:
    return re.sub(r"[^\n]", " ", m[0])


class Source:
    def __init__(self, text: str, lang: str):
        self.text, self.lang, self.spec = text, lang, SPECS[lang]
        self.masked = (_RUST_MASK if lang == "rust" else _MASK).sub(_blank, text)
        self.lines = [0, *(m.end() for m in re.finditer("\n", text))]
        self.close: dict[int, int] = {}
        stack: list[int] = []
        for m in re.finditer(r"[{}]", self.masked):
            if m[0] == "{":
                stack.append(m.start())
            elif stack:
                self.close[stack.pop()] = m.start()
        for at in stack:
            self.close[at] = len(text)
        top = [(k, re.compile(r)) for k, r in self.spec.decls]
        inner = [(k, re.compile(r)) for k, r in self.spec.decls]
        inner += [("function", re.compile(self.spec.method))] if self.spec.method else []
        inner += [(k, re.compile(r)) for k, r in self.spec.member]
        self.rules = {False: top, True: inner}
        self.symbols: list[dict] = []
        self.functions: list[tuple[int, int, str]] = []

    def line(self, at: int) -> int:
        return bisect_right(self.lines, at)

    def span(self, a: int, b: int) -> dict:
        la, lb = self.line(a), self.line(max(a, b - 1))
        return {"start_line": la, "end_line": lb, "start_col": a - self.lines[la - 1], "end_col": b - self.lines[lb - 1]}

    def doc(self, at: int) -> str | None:
        out: list[str] = []
        n = self.line(at) - 2
        while n >= 0:
            s = self.text[self.lines[n] : self.lines[n + 1]].strip()
            if s.startswith(("#[", "@")):
                n -= 1
                continue
            if not s.startswith(("//", "/*", "*")):
                break
            out.append(re.sub(r"^(?:///?!?|/\*\*?|\*/|\*)\s?|\*/\s*$", "", s).strip())
            if s.startswith("/*"):
                break
            n -= 1
        return "\n".join(x for x in reversed(out) if x) or None

    def seen(self, head: str, name: str, access: str) -> str:
        v = self.spec.visibility
        if v == "capital":
            return "Public" if name[:1].isupper() else "Private"
        if v == "underscore":
            return "Private" if name.startswith("_") else "Public"
        if v == "rust":
            return "Internal" if re.match(r"pub\s*\(", head) else "Public" if head.startswith("pub") else "Private"
        if v == "export":
            return "Public" if head.startswith("export") else "Private"
        if v == "static":
            return "Private" if re.match(r"static\b", head) else "Public"
        if v == "access":
            return access
        if re.search(r"\b(private|fileprivate)\b", head):
            return "Private"
        if v == "internal":
            return "Public" if re.search(r"\b(public|open)\b", head) else "Internal"
        return "Internal" if re.search(r"\b(protected|internal)\b", head) else "Public"

    def add(self, kind: str, name: str, owner: dict | None, a: int, b: int, head: str, access: str, parent_kind: str | None = None) -> dict:
        qualified = f"{owner['qualified_name']}::{name}" if owner else name
        s = {"name": name, "qualified_name": qualified, "kind": kind, "span": self.span(a, b), "signature": " ".join(head.split()) or None, "doc_comment": self.doc(a), "visibility": self.seen(head, name, access), "owner": (owner["qualified_name"], parent_kind or owner["kind"]) if owner else None}
        self.symbols.append(s)
        return s

    def block(self, at: int, to: int, owner: dict | None, depth: int = 0) -> None:
        inside = owner is not None and owner["kind"] != "module"
        access = "Private" if owner and owner["kind"] == "class" else "Public"
        while at < to:
            c = self.masked[at]
            if c == "{":
                at = self.close.get(at, to) + 1
                continue
            if not (c.isalpha() or c in "_#~$" or c == "@") or at and (self.masked[at - 1].isalnum() or self.masked[at - 1] in "_."):
                at += 1
                continue
            if self.lang == "cpp" and (m := _ACCESS.match(self.masked, at)):
                access = "Private" if m[1] == "private" else "Public"
                at = m.end()
                continue
            for kind, rule in self.rules[inside]:
                if (m := rule.match(self.masked, at, to)) and m["name"] not in _RESERVED:
                    at = self.declared(kind, m, to, owner, access, depth)
                    break
            else:
                # past the word, so that nothing matches in its middle
                m = re.compile(r"[\w$]+").match(self.masked, at)
                at = m.end() if m else at + 1

    def declared(self, kind: str, m: re.Match, to: int, owner: dict | None, access: str, depth: int) -> int:
        name, members = m["name"], kind.endswith("*")
        kind = kind.rstrip("*")
        if kind == "macro" and self.lang in ("c", "cpp"):
            end = self.masked.find("\n", m.end())
            end = to if end < 0 else end
            self.add(kind, name, None, m.start(), end, self.text[m.start() : end], access)
            return end
        stop = re.compile(r"\{|;|\n(?=\s*\n)|\}" if self.lang in ("go", "kotlin", "swift", "typescript") else r"\{|;|\}").search(self.masked, m.end(), to)
        body = None
        if self.lang in ("kotlin", "swift", "go", "typescript") and kind in ("constant", "variable", "type_alias", "field"):
            end = self.masked.find("\n", m.end())
            end = to if end < 0 or end > to else end
            if (o := self.masked.find("{", m.end(), end)) >= 0:
                end = self.close.get(o, end) + 1
        elif "{" in m[0] or m[0].endswith(";"):
            end = m.end()
        elif stop and stop[0] == "{":
            body, end = stop.start(), min(self.close[stop.start()] + 1, to)
        else:
            end = stop.start() + (stop[0] == ";") if stop else to
        head = self.text[m.start() : body if body is not None else end].rstrip("{; \n\t")
        if kind == "skip":
            return end
        if kind == "impl":
            if body is not None:
                self.block(body + 1, end - 1, {"qualified_name": name, "kind": "struct"}, depth + 1)
            return end
        own = owner
        if kind == "method":  # a receiver names the type
            own, parent_kind = {"qualified_name": m["recv"], "kind": "struct"}, "struct"
        if kind == "constant" and self.lang == "kotlin" and own and not re.search(r"\bconst\b", head):
            kind = "variable"
        if kind == "function" and own and own["kind"] != "module":
            kind = "method"
        s = self.add(kind, name, own, m.start(), end, head, access)
        if kind in ("function", "method"):
            self.functions.append((body if body is not None else m.end(), end, name.rpartition("::")[2]))
        elif members and body is not None:
            if self.lang == "rust":
                self.rust_members(kind, body + 1, end - 1, s)
            else:
                self.block(body + 1, end - 1, s, depth + 1)
        return end

    def rust_members(self, kind: str, a: int, b: int, owner: dict) -> None:
        pattern = rf"(?m)^\s*((?:pub(?:\([^)]*\))?\s+)?(?P<name>{_ID})\s*:\s*[^,\n]+)" if kind == "struct" else rf"(?m)^\s*((?P<name>{_ID})\s*(?:\([^)]*\)|\{{[^}}]*\}}|=[^,\n]*)?)\s*,?\s*$"
        for m in re.compile(pattern).finditer(self.masked, a, b):
            self.add("field" if kind == "struct" else "variant", m["name"], owner, m.start(1), m.end(1), self.text[m.start(1) : m.end(1)], "Public")

    def calls(self) -> list[dict]:
        out = []
        pattern = re.compile(rf"({_ID}(?:\s*(?:::|\.|->|\?\.)\s*{_ID})*)\s*(?:::<[^>]*>)?\(")
        for a, b, caller in self.functions:
            for m in pattern.finditer(self.masked, a, b):
                full = re.sub(r"\s+", "", m[1])
                if self.spec.callee == "full":
                    callee = full
                elif self.spec.callee == "rust":
                    callee = full if "::" in full and "." not in full else full.rpartition(".")[2]
                else:
                    callee = re.split(r"::|\?\.|\.|->", full)[-1]
                if callee not in KEYWORDS:
                    out.append({"caller": caller, "callee": callee})
        return out

    def imports(self) -> list[dict]:
        out: list[dict] = []
        text = re.sub(r"/\*.*?\*/", _blank, self.text, flags=re.S)
        if self.lang == "go":
            for m in re.finditer(r'(?m)^\s*import\s*(?:\(([^)]*)\)|(?:[\w.]+\s+)?"([^"]+)")', text):
                for path in [m[2]] if m[2] else re.findall(r'"([^"]+)"', m[1]):
                    out.append({"module_path": path, "names": [path.rpartition("/")[2]]})
        for pattern in self.spec.imports:
            for m in re.finditer("(?m)" + pattern, text):
                out += _import(self.lang, m)
        return out

    def identifiers(self) -> list[dict]:
        rows = self.text.split("\n")
        defined = {(s["span"]["start_line"], s["name"]) for s in self.symbols}
        out = []
        for m in re.finditer(_ID, self.masked):
            if m[0] in KEYWORDS:
                continue
            n = self.line(m.start())
            raw = rows[n - 1]
            before, after = self.masked[max(0, m.start() - 12) : m.start()], self.masked[m.end() : m.end() + 2]
            if (n, m[0]) in defined:
                kind = "Definition"
            elif re.match(r"\s*(?:pub\s+)?(?:import|use|#\s*include|export .* from)\b", raw):
                kind = "Import"
            elif re.search(r"\bnew\s+$", before):
                kind = "Constructor"
            elif after.lstrip().startswith("("):
                kind = "Call"
            elif before.rstrip().endswith((".", "->")):
                kind = "FieldAccess"
            elif m[0][:1].isupper() or re.search(r"(?:[^:]:|->)\s*[&*]?$", before):
                kind = "TypeRef"
            else:
                kind = "Unknown"
            out.append({"name": m[0], "line": n, "context": raw.strip()[:120], "ref_kind": kind})
        return out


def _names(text: str) -> list[str]:
    return [x for x in (re.split(r"\s+as\s+", p.strip())[0].strip() for p in text.split(",")) if x]


def _import(lang: str, m: re.Match) -> list[dict]:
    if lang == "rust":
        body = " ".join(m[1].split())
        if "{" in body:
            base, _, rest = body.partition("{")
            return [{"module_path": base.rstrip(": "), "names": _names(rest.rstrip("} "))}]
        path = re.split(r"\s+as\s+", body)[0]
        base, _, last = path.rpartition("::")
        return [{"module_path": base or path, "names": [last]}]
    if lang == "typescript":
        what = re.sub(r"^type\s+", "", m[1])
        names = _names(re.sub(r"[{}]", ",", re.sub(r"\*\s+as\s+", "", what)))
        return [{"module_path": m[2], "names": names}] if names else []
    if lang == "dart":
        show = re.search(r"\bshow\s+([\w\s,]+)", m[2])
        return [{"module_path": m[1], "names": _names(show[1]) if show else [m[1].rpartition("/")[2].removesuffix(".dart")]}]
    path = m[1]
    return [{"module_path": path, "names": [re.split(r"[./]", path)[-1] if lang != "c" and lang != "cpp" else path.rpartition("/")[2]]}]


def extract(text: str, lang: str) -> dict:
    """symbols (with owner in place of ids), call_edges, imports and identifiers of one file."""
    s = Source(text, lang)
    s.block(0, len(text), None)
    return {"symbols": s.symbols, "call_edges": s.calls(), "imports": s.imports(), "identifiers": s.identifiers()}
