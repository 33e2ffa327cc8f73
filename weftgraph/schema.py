"""Schemas and identities of the graph's tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NODES = "id string, type string, name string, source string, confidence double, metadata string"
EDGES = "from_node string, to_node string, type string, weight double, confidence double, metadata string"
FILES = (
    "path string, name string, extension string, language string, category string, size_bytes long, hash_value string, "
    "is_hidden boolean, is_binary boolean, lines_count long, modified_at timestamp, content binary"
)
SYMBOLS = "file_path string, name string, kind string, line_start int, line_end int, parent string, is_private boolean"
DEPENDENCIES = "source_file string, target_module string, kind string, line int, level int, ord long"

NODE_KEY = ["id"]
EDGE_KEY = ["from_node", "to_node", "type"]

#: The types of nodes and edges.
NODE_TYPES = ("FILE", "FUNCTION", "CLASS", "METHOD", "MODULE", "VARIABLE", "CONFIG", "VAULT_CONCEPT", "DECISION", "PATTERN", "CONFLICT", "SYMBOL")


def file_id(path: Column) -> Column:
    return F.concat(F.lit("file:"), path)


def symbol_id(file: Column, name: Column, line: Column) -> Column:
    return F.concat(file, F.lit("::symbol:"), name, F.lit(":"), line.cast("string"))


def pattern_id(name: Column) -> Column:
    return F.concat(F.lit("pattern:"), name)


def conflict_id(category: Column, a: Column, b: Column) -> Column:
    digest = F.substring(F.sha2(F.concat(a, F.lit("|"), b), 256), 1, 12)
    return F.concat(F.lit("conflict:"), category, F.lit(":"), digest)


def scanned_file_id(rel_path: Column) -> Column:
    """Digest of the path with forward slashes, without leading dots and slashes, in lower case."""
    return F.sha2(F.lower(F.regexp_replace(F.regexp_replace(rel_path, r"\\", "/"), r"^[./]+", "")), 256)


def fingerprint(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)
