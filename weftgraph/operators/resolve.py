"""Import resolution: from strings in source files to edges between files, as joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Endings tried for a script's import, in order.
SCRIPT_ENDINGS = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs")


def dotted(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, r"\.[^./]*$", ""), "/", ".")


def relativize(path: Column, root: str | None) -> Column:
    """An absolute path below the root without it; other paths, and all without a root, as they are."""
    if root is None:
        return path
    base = root.rstrip("/") + "/"
    return F.when(path.startswith(base), F.substr(path, F.lit(len(base) + 1))).otherwise(path)


def common_root(files: DataFrame, installed: tuple[str, ...] = ("node_modules", "venv", ".venv", "site-packages")) -> DataFrame:
    """(root): the folders that all paths share, null for one file only, for none, or inside installed
    packages. The common prefix of all paths is that of the least and the greatest as arrays."""
    parts = F.slice(F.split("path", "/"), F.lit(1), F.greatest(F.size(F.split("path", "/")) - 1, F.lit(0)))
    ends = files.agg(F.min(parts).alias("a"), F.max(parts).alias("b"), F.count(F.lit(1)).alias("n"))
    n = F.least(F.size("a"), F.size("b"))
    same = F.size(F.filter(F.sequence(F.lit(0), n), lambda k: F.slice("a", F.lit(1), k) == F.slice("b", F.lit(1), k))) - 1
    root = F.array_join(F.slice("a", F.lit(1), same), "/")
    return ends.select(F.when((F.col("n") >= 2) & (root != "") & ~F.arrays_overlap(F.slice("a", F.lit(1), same), F.array(*[F.lit(x) for x in installed])), root).alias("root"))


def module_index(files: DataFrame) -> DataFrame:
    """(key, path): dotted module, bare stem, and every dotted prefix of each file (path, ord); of files
    with one key the last wins."""
    module = dotted(F.col("path"))
    parts = F.split(module, r"\.")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."))
    keys = files.select("path", "ord", F.explode(F.array_distinct(F.concat(prefixes, F.array(F.element_at(parts, -1))))).alias("key"))
    return keys.groupBy("key").agg(F.max_by("path", F.struct("ord", "path")).alias("path"))


def normalized(path: Column) -> Column:
    """A path without `.` and `..` steps, folded from the left."""
    empty = F.array().cast("array<string>")

    def step(acc: Column, part: Column) -> Column:
        return F.when((part == "") | (part == "."), acc).when(part == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(part)))

    return F.array_join(F.aggregate(F.split(path, "/"), empty, step), "/")


def _folder(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit(""))


def _in(folder: Column, name: Column) -> Column:
    return F.when(folder == "", name).otherwise(F.concat(folder, F.lit("/"), name))


def candidates(source: Column, target: Column, level: Column) -> Column:
    """Paths that an import may mean, in order of precedence."""
    folder, bare = _folder(source), F.regexp_replace(target, r"^\.+", "")
    exact = F.array(target)
    script_base = normalized(_in(folder, target))
    script = F.concat(F.array(script_base), *[F.array(F.concat(script_base, F.lit(e))) for e in SCRIPT_ENDINGS], *[F.array(F.concat(script_base, F.lit(f"/index{e}"))) for e in SCRIPT_ENDINGS])
    dots = F.length(target) - F.length(bare)
    up = F.greatest(level, dots)
    # one dot is the file's own folder, each further one goes up
    rise = normalized(_in(folder, F.array_join(F.array_repeat(F.lit(".."), F.greatest(up - 1, F.lit(0))), "/")))
    inner = F.regexp_replace(bare, r"\.", "/")
    base = F.when(inner == "", rise).otherwise(_in(rise, inner))
    python = F.array(F.concat(base, F.lit("/__init__.py")), F.concat(base, F.lit(".py")))
    sibling_base = _in(folder, F.regexp_replace(target, r"\.", "/"))
    sibling = F.array(F.concat(sibling_base, F.lit(".py")), F.concat(sibling_base, F.lit("/__init__.py")))
    relative = target.startswith("./") | target.startswith("../")
    return F.when(relative, F.concat(exact, script)).when(target.startswith(".") | (level > 0), F.concat(exact, python)).otherwise(F.concat(exact, sibling))


def resolve(dependencies: DataFrame, files: DataFrame, drop_self: bool = False) -> DataFrame:
    """Import edges (from_node, to_node, type, line, import_str) between files (path, ord).

    dependencies: source_file, target_module, level, line. A path given exactly comes first, then a
    module's key for imports that aren't relative, then the candidates by rule; the first that exists
    holds. Self-imports are kept unless dropped.
    """
    deps = dependencies.select("source_file", "target_module", F.coalesce("level", F.lit(0)).alias("level"), "line")
    known = files.select(F.col("path").alias("_path"))
    asked = deps.select("source_file", "target_module", "level").distinct()
    tried = asked.select("*", F.posexplode(candidates(F.col("source_file"), F.col("target_module"), F.col("level"))).alias("_rank", "_path"))
    tried = tried.join(known, "_path", "left_semi").select("source_file", "target_module", "level", F.when(F.col("_rank") == 0, 0).otherwise(F.col("_rank") + 1).alias("_rank"), "_path")
    relative = F.col("target_module").startswith(".") | (F.col("level") > 0)
    keyed = asked.filter(~relative).join(module_index(files), F.col("target_module") == F.col("key")).select("source_file", "target_module", "level", F.lit(1).alias("_rank"), F.col("path").alias("_path"))
    found = tried.union(keyed).groupBy("source_file", "target_module", "level").agg(F.min(F.struct("_rank", "_path")).alias("m"))
    edges = deps.join(found, ["source_file", "target_module", "level"])
    if drop_self:
        edges = edges.filter(F.col("source_file") != F.col("m._path"))
    return edges.select(F.concat(F.lit("file:"), "source_file").alias("from_node"), F.concat(F.lit("file:"), F.col("m._path")).alias("to_node"), F.lit("IMPORTS").alias("type"), "line", F.col("target_module").alias("import_str"))
