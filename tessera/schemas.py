"""Schemas of entities, edges and records, and the closed value sets."""

from __future__ import annotations

from pyspark.sql import types as T

S, I, L, B, F, TS = T.StringType(), T.IntegerType(), T.LongType(), T.BooleanType(), T.FloatType(), T.TimestampType()


def struct(text: str) -> T.StructType:
    """A struct from "name type[?], ..."; a question mark makes a column nullable. Types: DDL names."""
    out = T.StructType()
    for part in text.split(";"):
        name, kind = part.split(maxsplit=1)
        optional = kind.endswith("?")
        out.add(name, _ddl(kind.rstrip("?").strip()), optional)
    return out


_ATOMS = {"string": S, "int": I, "long": L, "bool": B, "float": F, "timestamp": TS}


def _ddl(kind: str) -> T.DataType:
    if kind in _ATOMS:
        return _ATOMS[kind]
    if kind.startswith("list "):
        return T.ArrayType(_ddl(kind[5:]), False)
    return globals()[kind]


Parameter = struct("name string;type_name string;is_mutable bool;is_reference bool")
Complexity = struct("cyclomatic int;loc int;cognitive int?")
Field = struct("name string;type_name string;visibility string;attributes list string;doc_comment string?")
Variant = struct("name string;fields list Field;discriminant string?;doc_comment string?")
Import = struct("source string;items list string;is_reexport bool;line int")
Span = "id string?;name string;qualified_name string;file_path string;start_line int;end_line int;visibility string;generics list string;doc_comment string?"
Function = struct(Span + ";signature string;parent string?;is_async bool;is_unsafe bool;parameters list Parameter;return_type string?;complexity Complexity?")
Struct = struct(Span + ";fields list Field;derives list string;attributes list string")
Trait = struct(Span + ";super_traits list string;required_methods list string;provided_methods list string;associated_types list string")
Impl = struct("id string?;target_type string;trait_name string?;file_path string;start_line int;end_line int;generics list string;where_clause string?;methods list string")
Enum = struct(Span + ";variants list Variant;derives list string")
Constant = struct("id string?;name string;qualified_name string;file_path string;line int;visibility string;type_name string;is_static bool;is_mutable bool;doc_comment string?")
FileRow = struct("path string;name string;extension string;hash string;size long;indexed_at timestamp")
Chunk = struct("file_path string;entity_id string?;entity_type string;content string;start_line int;end_line int;embedding list float")
SearchResult = struct("path string;score float;start_line int;end_line int;preview string?;entity_id string?;entity_type string")
Calls = struct("caller_id string;callee_id string;caller_name string;callee_name string;call_type string;is_conditional bool;is_in_loop bool")
Implements = struct("impl_id string;trait_id string")
Metadata = struct("key string;value string;updated_at timestamp")
Module = struct("name string;path string;parent string?;children list string;files list string;reexports list string")
Finding = struct("title string;description string;related_files list string")
Dependency = struct("name string;description string;is_external bool")
ResearchDoc = struct("task_name string;summary string;codebase_analysis list Finding;dependencies list Dependency;suggested_approach string;sources list string")
FileSpec = struct("path string;description string")
Plan = struct("task_name string;approach string;complexity string;files_to_create list FileSpec;files_to_modify list FileSpec;dependencies_to_add list string")
Task = struct("id string;name string;prompt string;phase string;created_at timestamp;updated_at timestamp;research_doc string?;plan string?")

#: One row per extracted node or edge; columns that a kind lacks are null.
Extracted = struct(
    "file_path string;kind string;ordinal int;id string?;name string?;qualified_name string?;start_line int?;end_line int?;visibility string?;is_async bool?;is_unsafe bool?;signature string?;parent string?;"
    "return_type string?;doc_comment string?;cyclomatic int?;loc int?;parameters list Parameter?;fields list Field?;members list string?;bases list string?;attributes list string?;"
    "edge_type string?;src string?;dst string?;call_type string?;is_conditional bool?;is_in_loop bool?"
)

NODE_TABLES = {"function": "fn_node", "struct": "struct_node", "trait": "trait_node", "impl": "impl_node", "enum": "enum_node", "const": "const_node", "static": "const_node"}

# Fixed values.
VISIBILITY = ("public", "public_crate", "public_super", "public_in", "private")
CALL_TYPES = ("direct", "method", "static", "dynamic", "closure", "macro", "constructor")
PHASES = ("research", "planning", "agent", "complete")
EDGE_CATEGORY = {
    "contains": "structural", "belongs_to": "structural", "imports": "structural", "exports": "structural", "depends_on": "structural",
    "calls": "behavioral", "returns": "behavioral", "throws": "behavioral", "awaits": "behavioral", "reads": "behavioral", "writes": "behavioral",
    "implements": "type_system", "extends": "type_system", "uses_type": "type_system", "returns_type": "type_system", "has_field": "type_system",
    "exposes": "api", "maps_to": "api", "consumes": "api", "produces": "api", "tests": "api",
}
NODE_CATEGORY = {
    "function": "code", "struct": "code", "trait": "code", "impl": "code", "enum": "code", "constant": "code",
    "endpoint": "api", "schema": "api", "operation": "api", "file": "structure", "module": "structure", "package": "structure", "test_case": "test", "test_suite": "test",
}
LANGUAGE_OF = {
    "rs": "rust", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "py": "python", "pyi": "python", "go": "go", "java": "java",
    "kt": "kotlin", "kts": "kotlin", "cs": "csharp", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "hxx": "cpp", "c": "c", "h": "c", "rb": "ruby", "php": "php", "swift": "swift",
    "yaml": "yaml", "yml": "yaml", "json": "json", "toml": "toml", "md": "markdown", "markdown": "markdown",
}
