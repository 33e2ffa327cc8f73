"""Files of a source tree as a DataFrame: ignore rules, language, category, text profile, changes."""

from __future__ import annotations

import fnmatch
import os
import re
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.plans.staging import stage

# Folders and endings that are ignored, languages and categories by ending.
IGNORED_DIRS = (
    ".git", "__pycache__", "node_modules", "dist", "build", ".venv", "venv", "env", ".mypy_cache", ".ruff_cache", ".eggs", "*.egg-info",
    ".tox", ".nox", "htmlcov", ".coverage", ".pytest_cache",
)
IGNORED_EXTENSIONS = (".pyc", ".pyo", ".so", ".dylib", ".dll", ".exe", ".bin", ".wasm", ".lock")
LANGUAGES = (
    ("python", ".py"), ("javascript", ".js .jsx"), ("typescript", ".ts .tsx"), ("go", ".go"), ("rust", ".rs"), ("java", ".java"),
    ("kotlin", ".kt"), ("swift", ".swift"), ("c", ".c .h"), ("cpp", ".cpp .cc .cxx .hpp"), ("csharp", ".cs"), ("ruby", ".rb"), ("php", ".php"),
    ("r", ".r"), ("lua", ".lua"), ("shell", ".sh .bash .zsh .ps1"), ("sql", ".sql"), ("html", ".html"), ("css", ".css .scss .less"),
    ("json", ".json"), ("yaml", ".yaml .yml"), ("toml", ".toml"), ("xml", ".xml"), ("markdown", ".md .rst"), ("text", ".txt"), ("data", ".csv"),
    ("env", ".env"), ("docker", ".dockerfile"), ("terraform", ".tf"), ("protobuf", ".proto"),
)
CATEGORIES = (
    ("source", ".py .js .jsx .ts .tsx .go .rs .java .kt .swift .c .h .cpp .cc .cxx .hpp .cs .rb .php .r .lua .sh .bash .zsh .ps1 .sql .html .css .scss .less"),
    ("knowledge", ".md .rst .mdx"),
    ("config", ".json .yaml .yml .toml .xml .env"),
    ("data", ".sql .csv"),
    ("document", ".pdf .doc .docx .rtf"),
    ("asset", ".png .jpg .jpeg .gif .webp .svg .ico .bmp .tiff .avif"),
    ("system", ".dockerfile .sh .bash .zsh .ps1 .tf .proto"),
)
PROBED = 8192  # bytes that decide whether a file is binary


def extension(path: Column) -> Column:
    """Lower-case ending with its dot; empty for none and for names that only begin with a dot."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.lower(F.regexp_extract(name, r"[^.](\.[^.]+)$", 1))


def _lookup(ext: Column, table: tuple[tuple[str, str], ...]) -> Column:
    out = None
    for name, endings in table:
        hit = ext.isin(*endings.split())
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def language(ext: Column) -> Column:
    return _lookup(ext, LANGUAGES)


def category(ext: Column) -> Column:
    return _lookup(ext, CATEGORIES).when(language(ext).isNotNull(), "source").otherwise("unknown")


def is_hidden(path: Column) -> Column:
    return F.exists(F.split(path, "/"), lambda p: p.startswith("."))


def is_ignored(path: Column, globs: tuple[str, ...] = (), dirs: tuple[str, ...] = IGNORED_DIRS, extensions: tuple[str, ...] = IGNORED_EXTENSIONS) -> Column:
    """A part that equals an ignored folder, an ignored ending, or a glob on the path or one of its parts."""
    parts = F.split(path, "/")
    out = F.exists(parts, lambda p: p.isin(*dirs)) | extension(path).isin(*extensions)
    for g in globs:
        regex = fnmatch.translate(g).replace(r"\Z", "$").replace(r"\z", "$")
        out = out | path.rlike(f"^{regex}") | F.exists(parts, _like(f"^{regex}"))
    return out


def ignore_rules(text: str) -> tuple[str, ...]:
    """Globs of an ignore file: no blank lines, comments or negations, without a leading slash."""
    lines = (line.strip() for line in text.splitlines())
    return tuple(line.lstrip("/").rstrip("/") for line in lines if line and line[0] not in "#!")


def _like(regex: str):
    return lambda part: part.rlike(regex)


def is_binary(content: Column) -> Column:
    """Of the first bytes: none is text; a zero byte is binary; else more than 30 % of bytes outside
    printable ASCII and its controls."""
    digits = F.hex(F.substring(content, 1, PROBED))
    bytes_ = F.length(digits) / 2
    plain = F.regexp_count(digits, F.lit(r"\G(?:..)*?(?:0[789ACD]|1B|[2-6][0-9A-F]|7[0-9A-E])"))
    return F.when(bytes_ == 0, False).when(F.regexp_count(digits, F.lit(r"\G(?:..)*?00")) > 0, True).otherwise((bytes_ - plain) / bytes_ > 0.3)


def lines_count(text: Column) -> Column:
    """Newlines, and one for a last line without."""
    breaks = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return (breaks + F.when((F.length(text) > 0) & (F.right(text, F.lit(1)) != "\n"), 1).otherwise(0)).cast("long")


LISTING = "at string, path string, is_dir boolean, is_symlink boolean, size_bytes long, modified_at timestamp, error string"
_ENTRIES = 20_000  # that a task lists below one folder before it hands the folders left to others


def _system(root: str):
    """The file system and the path in it of a root's address."""
    from pyarrow import fs as arrow_fs

    root = root if "://" in root else re.sub("^(file:)?/*", "file:///", root)
    return arrow_fs.FileSystem.from_uri(quote(unquote(root), safe=":/@"))


def _lister(root: str, ignored: tuple[str, ...]):
    """Lists folders (at) on the executors, into their own folders up to a number of entries; what is then
    left, and folders that can't be read, are rows."""
    shown = frozenset(ignored)

    def pruned(name: str) -> bool:
        return name.startswith(".") or any(fnmatch.fnmatch(name, g) for g in shown)

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs as arrow_fs

        system, base = _system(root)
        local = isinstance(system, arrow_fs.LocalFileSystem)
        for f in frames:
            for start in f["at"]:
                rows, todo = [], [start]
                while todo and len(rows) < _ENTRIES:
                    folder = todo.pop()
                    try:
                        found = system.get_file_info(arrow_fs.FileSelector(folder))
                    except OSError as e:
                        rows.append((folder, folder[len(base) :].strip("/"), True, False, 0, None, f"{type(e).__name__}: {e}"))
                        continue
                    for x in found:
                        link = local and os.path.islink(x.path)
                        is_dir = x.type == arrow_fs.FileType.Directory
                        if is_dir and pruned(x.base_name):
                            continue
                        if is_dir and not link:
                            todo.append(x.path)
                        else:
                            rows.append((x.path, x.path[len(base) :].strip("/"), is_dir, link, x.size or 0, x.mtime, None))
                rows += [(x, x[len(base) :].strip("/"), True, False, 0, None, None) for x in todo]
                out = pd.DataFrame(rows, columns=[c.split()[0] for c in LISTING.split(", ")])
                out["modified_at"] = pd.to_datetime(out["modified_at"], utc=True)
                yield out

    return each


def list_tree(spark: SparkSession, root: str, ignored: tuple[str, ...] = IGNORED_DIRS) -> DataFrame:
    """(at, path, is_dir, is_symlink, size_bytes, modified_at, error) of all below a root but hidden and ignored
    folders; nothing is opened. Executors list: folders that a task has no time for are dealt out in the next
    round. Links to folders are rows and not followed, so there are no cycles; folders that can't be read are error rows."""
    start = _system(root)[1]
    frontier, found = spark.createDataFrame([(start,)], "at string"), None
    while True:
        listed = stage(frontier.mapInPandas(_lister(root, ignored), LISTING), "listing")
        left = F.col("is_dir") & ~F.col("is_symlink") & F.col("error").isNull()
        found = listed.filter(~left) if found is None else found.unionByName(listed.filter(~left))
        n = listed.filter(left).count()
        if not n:
            return found
        frontier = listed.filter(left).select("at").repartition(max(1, min(n, 4096)))


def with_content(files: DataFrame, root: str, max_kb: int | None = None) -> DataFrame:
    """Adds content to listed files; one that can't be read, or is larger than the cap, has none and an error."""

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, _ = _system(root)
        for f in frames:
            data, errors = [], []
            for at, size in zip(f["at"], f["size_bytes"], strict=True):
                content, error = None, None
                if max_kb and size > max_kb * 1024:
                    error = f"larger than {max_kb} KB"
                else:
                    try:
                        with system.open_input_stream(at) as stream:
                            content = stream.read()
                    except OSError as e:
                        error = f"{type(e).__name__}: {e}"
                data.append(content)
                errors.append(error)
            yield f.assign(content=data, error=errors)

    return files.mapInPandas(each, f"{LISTING}, content binary")


def scannable(listing: DataFrame, extensions: list[str] | None = None, globs: tuple[str, ...] = ()) -> DataFrame:
    """The files of a listing that are not hidden or ignored, of some endings if these are given."""
    files = listing.filter(~F.col("is_dir") & F.col("error").isNull())
    if extensions:
        files = files.filter(extension(F.col("path")).isin(*extensions))
    return files.filter(~F.exists(F.split("path", "/"), lambda p: p.startswith(".") & (p != ".gitignore")) & ~is_ignored(F.col("path"), globs))


def read_tree(spark: SparkSession, root: str, extensions: list[str] | None = None, globs: tuple[str, ...] = (), max_kb: int | None = None) -> DataFrame:
    """Files below a root: path relative to it, size, time, content, error. Sizes and names are looked at
    before files are opened."""
    files = scannable(list_tree(spark, root), extensions, globs)
    if max_kb:
        files = files.filter(F.col("size_bytes") <= max_kb * 1024)
    spread = files.repartition(max(1, min(4096, files.count() // 64)))
    return with_content(spread, root).select("path", "size_bytes", "modified_at", "content", "error")


def ignore_file(spark: SparkSession, root: str, name: str = ".gitignore", most: int = 1 << 20) -> tuple[str, ...]:
    """The globs of the ignore file at a root; none if there is none, or none that a person wrote by its size."""
    from pyarrow import fs as arrow_fs

    system, base = _system(root)
    found = system.get_file_info(f"{base.rstrip('/')}/{name}")
    if found.type != arrow_fs.FileType.File or found.size > most:
        return ()
    with system.open_input_stream(found.path) as stream:
        return ignore_rules(stream.read().decode("utf-8", "replace"))


def describe(files: DataFrame) -> DataFrame:
    """Adds name, extension, language, category, hash_value, is_hidden, is_binary, encoding, text, lines_count."""
    ext, binary = extension(F.col("path")), is_binary(F.col("content"))
    valid = F.expr("is_valid_utf8(CAST(content AS STRING))")
    text = F.when(binary, "").when(F.col("content").isNull(), F.lit(None)).when(valid, F.col("content").cast("string")).otherwise(F.decode("content", "ISO-8859-1"))
    return files.select(
        "*", F.element_at(F.split("path", "/"), -1).alias("name"), ext.alias("extension"), language(ext).alias("language"), category(ext).alias("category"),
        F.sha2("content", 256).alias("hash_value"), is_hidden(F.col("path")).alias("is_hidden"), binary.alias("is_binary"),
        F.when(binary, "").when(valid, "utf-8").otherwise("latin-1").alias("encoding"), text.alias("text"),
    ).withColumn("lines_count", lines_count(F.col("text")))


def changes(old: DataFrame, new: DataFrame, by: tuple[str, ...] = ("hash_value", "size_bytes")) -> DataFrame:
    """(path, change) against a snapshot: added, changed, unchanged or deleted, by null-safe comparison."""
    o = old.select("path", F.struct(*by).alias("_o"))
    n = new.select("path", F.struct(*by).alias("_n"))
    change = F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "deleted").when(F.col("_o").eqNullSafe(F.col("_n")), "unchanged").otherwise("changed")
    return o.join(n, "path", "full_outer").select("path", change.alias("change"))


def tree(files: DataFrame) -> DataFrame:
    """(parent, child): every folder's different children, the root being `.`. A row for each child, so a
    folder of any size is no single row."""
    parts = F.split("path", "/")
    steps = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(F.when(n == 1, ".").otherwise(F.array_join(F.slice(parts, F.lit(1), n - 1), "/")).alias("parent"), F.element_at(parts, n).alias("child")))
    return files.select(F.explode(steps).alias("s")).select("s.*").distinct()


def statistics(files: DataFrame) -> DataFrame:
    """(kind, key, n): counts by language, by extension and by binary or text, in one pass."""
    keys = F.array(
        F.struct(F.lit("language").alias("kind"), F.coalesce("language", F.lit("unknown")).alias("key")),
        F.struct(F.lit("extension").alias("kind"), F.when(F.coalesce("extension", F.lit("")) == "", "<none>").otherwise(F.col("extension")).alias("key")),
        F.struct(F.lit("content").alias("kind"), F.when(F.col("is_binary"), "binary").otherwise("text").alias("key")),
    )
    return files.select(F.explode(keys).alias("k")).groupBy("k.kind", "k.key").agg(F.count(F.lit(1)).alias("n"))


def preview(files: DataFrame, lines: int = 200) -> DataFrame:
    """(path, line, text): the first lines of each file, numbered from 1."""
    return files.select("path", F.posexplode(F.slice(F.split("text", "\r\n|\r|\n"), 1, lines)).alias("_i", "text")).select("path", (F.col("_i") + 1).alias("line"), "text")


def explorer(files: DataFrame, deepest: int = 12, entries: int = 5000) -> DataFrame:
    """(parent, child): the first entries of the tree in order, down to a depth."""
    depth = F.when(F.col("parent") == ".", 1).otherwise(F.size(F.split("parent", "/")) + 1)
    return tree(files).filter(depth <= deepest).orderBy("parent", "child").limit(entries)
