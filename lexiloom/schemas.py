"""The relations of an index, their types and the vocabularies of kinds and languages."""

from __future__ import annotations

from pyspark.sql import types as T

INDEX_VERSION = 1

SPAN = T.StructType([T.StructField(n, T.IntegerType()) for n in ("start_line", "end_line", "start_col", "end_col")])
SYMBOL = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("qualified_name", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("file_path", T.StringType()),
        T.StructField("span", SPAN),
        T.StructField("signature", T.StringType()),
        T.StructField("doc_comment", T.StringType()),
        T.StructField("visibility", T.StringType()),
        T.StructField("parent", T.StringType()),
        T.StructField("children", T.ArrayType(T.StringType())),
    ]
)
EDGE = T.StructType([T.StructField("caller", T.StringType()), T.StructField("callee", T.StringType())])
IMPORT = T.StructType([T.StructField("module_path", T.StringType()), T.StructField("names", T.ArrayType(T.StringType()))])
IDENTIFIER = T.StructType([T.StructField("name", T.StringType()), T.StructField("line", T.IntegerType()), T.StructField("context", T.StringType()), T.StructField("ref_kind", T.StringType())])
PARSED = T.StructType(
    [
        T.StructField("symbols", T.ArrayType(SYMBOL)),
        T.StructField("call_edges", T.ArrayType(EDGE)),
        T.StructField("imports", T.ArrayType(IMPORT)),
        T.StructField("identifiers", T.ArrayType(IDENTIFIER)),
    ]
)

KINDS = ("function", "method", "struct", "class", "enum", "variant", "interface", "field", "constant", "variable", "module", "type_alias", "macro", "import")
REF_KINDS = ("Call", "TypeRef", "Import", "FieldAccess", "Constructor", "Definition", "Unknown")
KIND_ALIASES = {k: k for k in KINDS} | {"fn": "function", "enum_variant": "variant", "trait": "interface", "protocol": "interface", "const": "constant", "var": "variable", "let": "variable", "mod": "module", "type": "type_alias", "use": "import"}
REF_ALIASES = {"call": "Call", "type": "TypeRef", "import": "Import", "use": "Import", "field": "FieldAccess", "constructor": "Constructor", "ctor": "Constructor", "def": "Definition", "definition": "Definition"}
KIND_PRIORITY = {"function": 0, "method": 0, "struct": 1, "class": 1, "interface": 2, "enum": 3, "constant": 4, "type_alias": 5, "macro": 6}
LANGUAGES = {"rs": "rust", "java": "java", "ts": "typescript", "tsx": "typescript", "mts": "typescript", "cts": "typescript", "js": "javascript", "jsx": "javascript", "py": "python", "swift": "swift", "go": "go", "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp"}
