"""Types of the graph's tables and the closed sets of their values."""

from __future__ import annotations

from pyspark.sql import types as T

NODE_KINDS = ("project", "crate", "file", "module", "function", "method", "constructor", "variable", "field", "property", "struct", "enum", "enum_member", "trait", "impl", "type_alias", "type_parameter", "const", "static", "macro", "unknown")
EDGE_KINDS = ("contains", "declares", "imports", "calls", "implements", "has_method", "uses_type", "returns", "module_file", "possible_dispatch")
SOURCES = ("ast", "rust_analyzer", "mir", "inferred")
CERTAINTIES = ("definite", "confirmed", "inferred", "possible")

CALLABLE = ("function", "method", "macro", "constructor")
#: Kinds worth showing to a reader.
READABLE = ("file", "module", "function", "method", "struct", "enum", "impl", "trait", "type_alias", "const", "static", "macro")
#: Kinds that hold other symbols and are none themselves.
CONTAINERS = ("project", "crate", "file", "module")

LINES = T.StructType([T.StructField("start_line", T.LongType()), T.StructField("end_line", T.LongType())])
EVIDENCE = T.StructType([T.StructField("file", T.StringType()), T.StructField("line", T.LongType())])

#: As persisted in the JSON document; the tables have ``src`` and ``dst`` for from and to, and ``ord``.
NODE = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("kind", T.StringType(), False),
        T.StructField("name", T.StringType(), False),
        T.StructField("qualified_name", T.StringType(), False),
        T.StructField("file", T.StringType()),
        T.StructField("range", LINES),
        T.StructField("visibility", T.StringType()),
        T.StructField("signature", T.StringType()),
        T.StructField("docs", T.StringType()),
        T.StructField("metrics", T.MapType(T.StringType(), T.LongType()), False),
    ]
)
EDGE = T.StructType(
    [
        T.StructField("from", T.StringType(), False),
        T.StructField("to", T.StringType(), False),
        T.StructField("kind", T.StringType(), False),
        T.StructField("label", T.StringType()),
        T.StructField("evidence", EVIDENCE),
        T.StructField("weight", T.LongType(), False),
        T.StructField("source", T.StringType(), False),
        T.StructField("certainty", T.StringType(), False),
        T.StructField("call_style", T.StringType()),
        T.StructField("profiles", T.ArrayType(T.StringType()), False),
    ]
)
TARGET = T.StructType([T.StructField("name", T.StringType()), T.StructField("kind", T.ArrayType(T.StringType())), T.StructField("src_path", T.StringType())])
PACKAGE = T.StructType([T.StructField("name", T.StringType()), T.StructField("manifest_path", T.StringType()), T.StructField("targets", T.ArrayType(TARGET))])
PROFILE = T.StructType([T.StructField("name", T.StringType()), T.StructField("features", T.ArrayType(T.StringType())), T.StructField("all_features", T.BooleanType()), T.StructField("no_default_features", T.BooleanType()), T.StructField("target", T.StringType())])
DOCUMENT = T.StructType(
    [
        T.StructField("schema_version", T.IntegerType(), False),
        T.StructField("project", T.StructType([T.StructField("root", T.StringType()), T.StructField("workspace_root", T.StringType()), T.StructField("packages", T.ArrayType(PACKAGE))])),
        T.StructField("nodes", T.ArrayType(NODE), False),
        T.StructField("edges", T.ArrayType(EDGE), False),
        T.StructField("warnings", T.ArrayType(T.StringType()), False),
        T.StructField("profiles", T.ArrayType(PROFILE), False),
        T.StructField("generated_at_ms", T.LongType()),
    ]
)
