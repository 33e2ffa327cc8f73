"""Symbols, imports, headings and settings of source files.

Patterns run as built-in expressions; Python's own grammar and nested settings need Arrow-batched
Python workers, which see only the files of their kind.
"""

from __future__ import annotations

import ast
import json
import re
import tomllib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph import schema
from weftgraph.plans.staging import spread

_SYMBOL = "struct<name:string,kind:string,line_start:int,line_end:int,is_private:boolean,decorators:array<string>>"
_DEPENDENCY = "struct<target_module:string,kind:string,line:int,level:int>"
PARSED = f"symbols array<{_SYMBOL}>, dependencies array<{_DEPENDENCY}>, calls array<string>, errors array<string>, confidence double"

# Forms of definitions and imports in scripts.
SCRIPT_PATTERNS = {
    "FUNCTION": (r"(?m)^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s+([A-Za-z_$][\w$]*)", r"(?m)^\s*(?:export\s+)?(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*=\s*(?:async\s*)?(?:\([^)]*\)|[A-Za-z_$][\w$]*)\s*=>"),
    "CLASS": (r"(?m)^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+([A-Za-z_$][\w$]*)",),
}
SCRIPT_IMPORT = r"(?:import\s+(?:[\w$*{}\s,]+?\s+from\s+)?|export\s+[\w$*{}\s,]+?\s+from\s+|require\s*\(\s*|import\s*\(\s*)[\"']([^\"']+)[\"']"
HREF = r"href=\"([^\"]*)\""
HEADING = r"^(#{1,6})\s+(.+)$"
WIKILINK = r"\[\[([^\]|]+)(?:\|[^\]]*)?\]\]"


def _decorators(node: ast.AST) -> list[str]:
    found = []
    for d in getattr(node, "decorator_list", []):
        d = d.func if isinstance(d, ast.Call) else d
        found.append(d.attr if isinstance(d, ast.Attribute) else getattr(d, "id", ""))
    return [x for x in found if x]


def parse_python(text: str | None) -> dict:
    """Functions, classes, imports and called names of a module; with a syntax error none, at half confidence."""
    out: dict = {"symbols": [], "dependencies": [], "calls": [], "errors": [], "confidence": 0.95}
    try:
        module = ast.parse(text or "")
    except (SyntaxError, ValueError, RecursionError) as e:
        return out | {"errors": [str(e)], "confidence": 0.5}
    calls = set()
    for node in ast.walk(module):
        match node:
            case ast.FunctionDef() | ast.AsyncFunctionDef() | ast.ClassDef():
                kind = "CLASS" if isinstance(node, ast.ClassDef) else "FUNCTION"
                out["symbols"].append({"name": node.name, "kind": kind, "line_start": node.lineno, "line_end": node.end_lineno, "is_private": node.name.startswith("_"), "decorators": _decorators(node)})
            case ast.Import():
                out["dependencies"] += [{"target_module": a.name, "kind": "import", "line": node.lineno, "level": 0} for a in node.names]
            case ast.ImportFrom():
                out["dependencies"].append({"target_module": node.module or "", "kind": "from", "line": node.lineno, "level": node.level})
            case ast.Call(func=ast.Name(id=name)) | ast.Call(func=ast.Attribute(attr=name)):
                calls.add(name)
    return out | {"calls": sorted(calls)}


_SCRIPT_FORMS = [(kind, re.compile(p)) for kind, ps in SCRIPT_PATTERNS.items() for p in ps]
_SCRIPT_IMPORT_FORM = re.compile(SCRIPT_IMPORT)


def parse_script(text: str | None) -> dict:
    """Functions, classes and imports of a script with their lines, by patterns."""
    text = text or ""
    line = lambda at: text.count("\n", 0, at) + 1
    symbols = [
        {"name": m[1], "kind": kind, "line_start": line(m.start(1)), "line_end": line(m.start(1)), "is_private": m[1].startswith("_"), "decorators": []}
        for kind, form in _SCRIPT_FORMS for m in form.finditer(text)
    ]
    found = [{"target_module": m[1], "kind": "import", "line": line(m.start()), "level": 0} for m in _SCRIPT_IMPORT_FORM.finditer(text)]
    return {"symbols": symbols, "dependencies": found, "calls": [], "errors": [], "confidence": 0.85}


_HEADING_FORM = re.compile(r"^(#{1,6})\s+(.+)$", re.MULTILINE)


def parse_markdown(text: str | None) -> dict:
    """Headings as concepts."""
    text = text or ""
    symbols = [{"name": m[2].strip(), "kind": "VAULT_CONCEPT", "line_start": text.count("\n", 0, m.start()) + 1, "line_end": text.count("\n", 0, m.start()) + 1, "is_private": False, "decorators": []} for m in _HEADING_FORM.finditer(text)]
    return {"symbols": symbols, "dependencies": [], "calls": [], "errors": [], "confidence": 0.8}


# Forms of definitions and imports in other languages.
OTHER_PATTERNS = {
    "go": ((("FUNCTION", r"(?m)^func\s+(?:\([^)]*\)\s*)?(\w+)"), ("CLASS", r"(?m)^type\s+(\w+)\s+(?:struct|interface)")), r"(?m)^(?:import\s+(?:\w+\s+)?|\s+(?:\w+\s+)?)\"([^\"]+)\"\s*$"),
    "rust": ((("FUNCTION", r"(?m)^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?(?:unsafe\s+)?fn\s+(\w+)"), ("CLASS", r"(?m)^\s*(?:pub(?:\([^)]*\))?\s+)?(?:struct|enum|trait)\s+(\w+)")), r"(?m)^\s*(?:pub\s+)?use\s+([\w:]+)"),
    "java": ((("CLASS", r"(?m)^\s*(?:[\w@]+\s+)*(?:class|interface|enum|record)\s+(\w+)"), ("FUNCTION", r"(?m)^\s+(?:(?:public|private|protected|static|final|abstract|synchronized)\s+)+[\w<>\[\], ?]+\s+(\w+)\s*\(")), r"(?m)^\s*import\s+(?:static\s+)?([\w.]+)"),
    "kotlin": ((("CLASS", r"(?m)^\s*(?:\w+\s+)*(?:class|interface|object)\s+(\w+)"), ("FUNCTION", r"(?m)^\s*(?:\w+\s+)*fun\s+(?:<[^>]*>\s*)?(?:\w+\.)?(\w+)")), r"(?m)^\s*import\s+([\w.]+)"),
    "csharp": ((("CLASS", r"(?m)^\s*(?:\w+\s+)*(?:class|interface|struct|record|enum)\s+(\w+)"), ("FUNCTION", r"(?m)^\s+(?:(?:public|private|protected|internal|static|async|override|virtual)\s+)+[\w<>\[\], ?]+\s+(\w+)\s*\(")), r"(?m)^\s*using\s+(?:static\s+)?([\w.]+)\s*;"),
    "c": ((("FUNCTION", r"(?m)^[A-Za-z_][\w\s*]*?\b(\w+)\s*\([^;{)]*\)\s*\{"), ("CLASS", r"(?m)^\s*(?:typedef\s+)?(?:struct|enum|union)\s+(\w+)\s*\{")), r"(?m)^\s*#\s*include\s*[<\"]([^>\"]+)[>\"]"),
    "cpp": ((("FUNCTION", r"(?m)^[A-Za-z_][\w\s*&:<>,]*?\b(\w+)\s*\([^;{)]*\)\s*(?:const\s*)?\{"), ("CLASS", r"(?m)^\s*(?:class|struct|enum(?:\s+class)?)\s+(\w+)[^;]*\{")), r"(?m)^\s*#\s*include\s*[<\"]([^>\"]+)[>\"]"),
    "ruby": ((("FUNCTION", r"(?m)^\s*def\s+(?:self\.)?(\w+[?!]?)"), ("CLASS", r"(?m)^\s*(?:class|module)\s+(\w+)")), r"(?m)^\s*require(?:_relative)?\s+['\"]([^'\"]+)['\"]"),
    "php": ((("FUNCTION", r"(?m)^\s*(?:(?:public|private|protected|static|abstract|final)\s+)*function\s+(\w+)"), ("CLASS", r"(?m)^\s*(?:abstract\s+|final\s+)?(?:class|interface|trait)\s+(\w+)")), r"(?m)^\s*use\s+([\w\\]+)"),
}
_OTHER_FORMS = {k: ([(kind, re.compile(p)) for kind, p in forms], re.compile(imports)) for k, (forms, imports) in OTHER_PATTERNS.items()}


def parse_other(language: str, text: str | None) -> dict:
    """Functions, classes and imports of other languages, by patterns."""
    text = text or ""
    line = lambda at: text.count("\n", 0, at) + 1
    forms, imports = _OTHER_FORMS[language]
    symbols = [
        {"name": m[1], "kind": kind, "line_start": line(m.start(1)), "line_end": line(m.start(1)), "is_private": m[1].startswith("_"), "decorators": []}
        for kind, form in forms for m in form.finditer(text)
    ]
    found = [{"target_module": m[1], "kind": "import", "line": line(m.start(1)), "level": 0} for m in imports.finditer(text)]
    return {"symbols": symbols, "dependencies": found, "calls": [], "errors": [], "confidence": 0.8}


def parse_file(language: str | None, text: str | None) -> dict | None:
    """The parse result by language; none for a language without a parser."""
    if language == "python":
        return parse_python(text)
    if language in ("javascript", "typescript"):
        return parse_script(text)
    if language == "markdown":
        return parse_markdown(text)
    return parse_other(language, text) if language in _OTHER_FORMS else None


def top_level_names(text: str | None) -> list[str]:
    return sorted({s["name"] for s in parse_python(text)["symbols"]})


def with_parsed(files: DataFrame, parser: Callable[[str | None, str | None], dict | None] | None = None) -> DataFrame:
    """Adds the parse result of each file (text, and language if there) as a struct `parsed`; a parser's
    failure is an error row, and a language without a parser has no result. Files without a language
    column are Python. Files are dealt over all cores, as parsing takes longer than reading."""
    parser = parser or parse_file

    @F.pandas_udf(PARSED)
    def each(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for languages, texts in batches:
            rows = []
            for language, t in zip(languages, texts, strict=True):
                try:
                    rows.append(parser(language, t) or {"symbols": [], "dependencies": [], "calls": [], "errors": [], "confidence": None})
                except Exception as e:  # one file's failure is its own result
                    rows.append({"symbols": [], "dependencies": [], "calls": [], "errors": [f"{type(e).__name__}: {e}"], "confidence": 0.2})
            yield pd.DataFrame(rows, columns=["symbols", "dependencies", "calls", "errors", "confidence"])

    language = F.col("language") if "language" in files.columns else F.lit("python")
    each = each.asNondeterministic()  # else the filter that comes with an explode parses each file once more
    return spread(files, "path", "text").withColumn("parsed", each(language, F.col("text")))


def symbols(parsed: DataFrame) -> DataFrame:
    return parsed.select(F.col("path").alias("file_path"), F.explode("parsed.symbols").alias("s")).select("file_path", "s.*")


def dependencies(parsed: DataFrame) -> DataFrame:
    return parsed.select(F.col("path").alias("source_file"), F.posexplode("parsed.dependencies").alias("ord", "d")).select("source_file", "d.target_module", "d.kind", "d.line", "d.level", F.col("ord").cast("long"))


def script_symbols(files: DataFrame) -> DataFrame:
    """(path, kind, name) of definitions in scripts, found by patterns."""
    named = lambda kind: lambda n: F.struct(F.lit(kind).alias("kind"), n.alias("name"))
    found = F.concat(*[F.transform(F.regexp_extract_all("text", F.lit(p), F.lit(1)), named(kind)) for kind, ps in SCRIPT_PATTERNS.items() for p in ps])
    return files.select("path", F.explode(found).alias("s")).select("path", "s.kind", "s.name")


def script_imports(files: DataFrame) -> DataFrame:
    """(source_file, target_module) of imports in scripts."""
    return files.select(F.col("path").alias("source_file"), F.explode(F.regexp_extract_all("text", F.lit(SCRIPT_IMPORT), F.lit(1))).alias("target_module"))


def href_imports(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, target) of a page's links."""
    return pages.select(id_col, F.explode(F.regexp_extract_all(html_col, F.lit(HREF), F.lit(1))).alias("target"))


SHOWN = 500  # characters of a file without a parser that its element holds
MAX_KB = 2048


def capped_text(text: Column, size_bytes: Column, max_kb: int = MAX_KB) -> Column:
    """A file's text as a parser gets it: empty beyond the cap."""
    return F.when(size_bytes > max_kb * 1024, "").otherwise(text)


def generic_elements(files: DataFrame) -> DataFrame:
    """(element_id, path, name, kind, line_start, line_end, text, parser, confidence): the one element of a file
    (path, text, lines_count, is_binary) that no parser reads: its first characters, or none of a binary file."""
    binary, file = F.coalesce("is_binary", F.lit(False)), schema.scanned_file_id(F.col("path"))
    return files.select(
        F.sha2(F.concat(file, F.lit(":text:"), "path", F.lit(":1")), 256).alias("element_id"), "path", F.col("path").alias("name"), F.lit("TEXT_BLOCK").alias("kind"),
        F.lit(1).alias("line_start"), F.greatest(F.lit(1).cast("long"), F.coalesce("lines_count", F.lit(1).cast("long"))).alias("line_end"),
        F.when(binary, "").otherwise(F.left(F.coalesce("text", F.lit("")), F.lit(SHOWN))).alias("text"), F.when(binary, "binary").otherwise("generic").alias("parser"),
        F.when(binary, 0.2).otherwise(0.35).alias("confidence"),
    )


def strip_quotes(target: Column) -> Column:
    """The last word of an import statement without one layer of quotes or brackets."""
    last = F.element_at(F.split(F.trim(F.regexp_replace(target, r"[;)]+\s*$", "")), r"\s+"), -1)
    return F.regexp_replace(F.regexp_replace(last, r"^[\"'<(\[]", ""), r"[\"'>)\]]$", "")


def lines(files: DataFrame, text: str = "text") -> DataFrame:
    """(..., line, content): a file's lines, numbered from 1."""
    rest = [c for c in files.columns if c != text]
    return files.select(*rest, F.posexplode(F.split(text, "\r\n|\r|\n")).alias("_i", "content")).select(*rest, (F.col("_i") + 1).alias("line"), "content")


def headings(files: DataFrame) -> DataFrame:
    """(path, line, level, title) of Markdown headings."""
    found = lines(files.select("path", "text")).select("path", "line", F.regexp_extract("content", HEADING, 1).alias("m"), F.regexp_extract("content", HEADING, 2).alias("title"))
    return found.filter("m <> ''").select("path", "line", F.length("m").alias("level"), F.trim("title").alias("title"))


def wikilinks(files: DataFrame) -> DataFrame:
    """(path, line, target) of links between notes."""
    return lines(files.select("path", "text")).select("path", "line", F.explode(F.regexp_extract_all("content", F.lit(WIKILINK), F.lit(1))).alias("target")).select("path", "line", F.trim("target").alias("target"))


def config_keys(files: DataFrame) -> DataFrame:
    """(path, line, key) by lines: neither blank nor comment, the text before the first colon and then the
    first equals sign, without quotes."""
    trimmed = F.trim("content")
    key = F.regexp_replace(F.trim(F.split_part(F.split_part(trimmed, F.lit(":"), F.lit(1)), F.lit("="), F.lit(1))), "^[\"']+|[\"']+$", "")
    holds = (trimmed != "") & ~trimmed.startswith("#") & (trimmed.contains(":") | trimmed.contains("="))
    return lines(files.select("path", "text")).filter(holds).select("path", "line", key.alias("key")).filter("key <> ''")


def _dotted(tree: dict, prefix: str = "") -> Iterator[str]:
    for k, v in tree.items():
        yield f"{prefix}{k}"
        if isinstance(v, dict):
            yield from _dotted(v, f"{prefix}{k}.")


def structured_keys(files: DataFrame) -> DataFrame:
    """(path, keys array<string>) of JSON, TOML and YAML files: dotted keys in order; null if unreadable."""

    @F.pandas_udf("array<string>")
    def each(ext: pd.Series, text: pd.Series) -> pd.Series:
        out = []
        for e, t in zip(ext, text, strict=True):
            try:
                if e == ".json":
                    tree = json.loads(t)
                elif e == ".toml":
                    tree = tomllib.loads(t)
                else:
                    import yaml

                    tree = yaml.safe_load(t)
                out.append(list(_dotted(tree)) if isinstance(tree, dict) else [])
            except Exception:  # not readable as what its name says
                out.append(None)
        return pd.Series(out)

    each = each.asNondeterministic()  # as in with_parsed
    read = files.filter(F.col("extension").isin(".json", ".toml", ".yaml", ".yml")).select("path", "extension", "text")
    return spread(read, "path", "text").select("path", each("extension", "text").alias("keys"))


def promote(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the symbols of parsed files: each belongs to its file with weight 0.6."""
    own = symbols(parsed)
    file = schema.file_id(F.col("file_path"))
    node_id = schema.symbol_id(file, F.col("name"), F.col("line_start"))
    kind = F.when(F.col("kind").isin("CLASS", "TYPE_ALIAS"), "CLASS").when(F.col("kind").isin("METHOD", "MODULE", "VARIABLE", "VAULT_CONCEPT"), F.col("kind")).otherwise("FUNCTION")
    metadata = F.to_json(F.struct("file_path", "line_start", "line_end", "is_private", "decorators"))
    nodes = own.select(node_id.alias("id"), kind.alias("type"), "name", F.col("file_path").alias("source"), F.lit(0.9).alias("confidence"), metadata.alias("metadata"))
    edges = own.select(node_id.alias("from_node"), file.alias("to_node"), F.lit("BELONGS_TO").alias("type"), F.lit(0.6).alias("weight"), F.lit(0.9).alias("confidence"), F.lit(None).cast("string").alias("metadata"))
    return nodes, edges
