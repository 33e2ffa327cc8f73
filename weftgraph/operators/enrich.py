"""Patterns, naming and conflicts found in paths, and links between concepts and code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph import schema
from weftgraph.plans.staging import as_few, counted

# Signals of design patterns, naming conventions, names that say nothing.
PATTERN_SIGNALS = (
    ("repository", ("repository", "repo")),
    ("factory", ("factory", "create_", "build_")),
    ("observer", ("observer", "subscribe", "event")),
    ("adapter", ("adapter", "wrapper")),
)
CONVENTIONS = (("snake_case", "^[a-z][a-z0-9_]*$"), ("PascalCase", "^[A-Z][a-zA-Z0-9]*$"))
COMMON_NAMES = ("__init__", "setup", "conftest", "index")


PARTS = 100_000  # parts of paths with a signal that are broadcast at most


def _parts(path: Column) -> Column:
    return F.split(F.regexp_replace(path, r"\\", "/"), "/")


def parent(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, r"\\", "/"), r"/?[^/]*$", "")


def design_patterns(files: DataFrame, least: int = 2) -> DataFrame:
    """(pattern, part, n, confidence): parts of paths that hold a pattern's signal, found at least twice.
    The signals are constants, so each part is tested in place and only counts are shuffled."""
    part = F.col("part")
    hits = [F.when(F.array_contains(F.array(*[F.lower(part).contains(s) for s in signals]), True), F.lit(name)) for name, signals in PATTERN_SIGNALS]
    parts = files.select(F.explode(_parts(F.col("path"))).alias("part"))
    found = parts.select("part", F.explode(F.array_compact(F.array(*hits))).alias("pattern"))
    counted = found.groupBy("pattern", "part").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    return counted.withColumn("confidence", F.round(F.least(F.col("n") * F.lit(0.15), F.lit(0.9)), 6))


def pattern_locations(files: DataFrame, patterns: DataFrame) -> DataFrame:
    """(pattern, part, path): files whose path holds a part's text, in any case.

    The different parts of paths are tested against the different parts of patterns; what meets is joined
    back to the files by part. A pattern's part lies within one part of a path, as it holds no slash, so
    files themselves are never tested against patterns."""
    wanted = counted(patterns.select("pattern", "part").distinct(), "patterns", PARTS)
    parts = files.select("path", F.explode(F.array_distinct(_parts(F.lower("path")))).alias("_own"))
    met = parts.select("_own").distinct().join(as_few(wanted.select("part").distinct(), wanted), F.col("_own").contains(F.lower("part")))
    return parts.join(met, "_own").select("path", "part").distinct().join(wanted, "part").select("pattern", "part", "path")


def naming_conventions(files: DataFrame) -> DataFrame:
    """(convention, n, confidence) of conventions that more than half of the files' stems follow."""
    stem = F.split_part(F.element_at(_parts(F.col("path")), -1), F.lit("."), F.lit(1))
    counts = [F.sum(F.when(stem.rlike(regex), 1).otherwise(0)).cast("long").alias(name) for name, regex in CONVENTIONS]
    total = files.agg(F.count(F.lit(1)).alias("total"), *counts)
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("convention"), F.col(name).alias("n")) for name, _ in CONVENTIONS])).alias("e")
    share = F.col("e.n") / F.col("total")
    return total.select("total", each).filter(share > 0.5).select("e.convention", "e.n", F.round(share, 2).alias("confidence"))


def naming_conflicts(files: DataFrame) -> DataFrame:
    """(source_a, source_b, base): all pairs of files in different folders with one base name, by path.
    An equality join on the base, whose hot keys skew handling may split; its result is the pairs."""
    base = F.lower(F.split_part(F.element_at(_parts(F.col("path")), -1), F.lit("."), F.lit(1)))
    own = files.select("path", base.alias("base"), parent(F.col("path")).alias("dir")).filter(~F.col("base").isin(*COMMON_NAMES))
    left = own.alias("a").join(own.alias("b"), (F.col("a.base") == F.col("b.base")) & (F.col("a.path") < F.col("b.path")) & (F.col("a.dir") != F.col("b.dir")))
    return left.select(F.col("a.path").alias("source_a"), F.col("b.path").alias("source_b"), F.col("a.base").alias("base"))


def naming_groups(files: DataFrame) -> DataFrame:
    """(base, files, folders, first, last): base names that stand in several folders, with their least and
    greatest path: a row for each name, where ``naming_conflicts`` has one for each pair."""
    base = F.lower(F.split_part(F.element_at(_parts(F.col("path")), -1), F.lit("."), F.lit(1)))
    own = files.select("path", base.alias("base"), parent(F.col("path")).alias("dir")).filter(~F.col("base").isin(*COMMON_NAMES))
    found = own.groupBy("base").agg(F.count(F.lit(1)).alias("files"), F.count_distinct("dir").alias("folders"), F.min("path").alias("first"), F.max("path").alias("last"))
    return found.filter("folders > 1")


def pattern_nodes(patterns: DataFrame) -> DataFrame:
    best = patterns.groupBy("pattern").agg(F.max_by(F.struct("confidence", "part", "n"), F.struct("n", "part")).alias("m"))
    metadata = F.to_json(F.struct(F.col("m.n").alias("occurrences"), F.col("m.part").alias("part")))
    return best.select(schema.pattern_id(F.col("pattern")).alias("id"), F.lit("PATTERN").alias("type"), F.col("pattern").alias("name"), F.lit("pattern").alias("source"), F.col("m.confidence").alias("confidence"), metadata.alias("metadata"))


def conflict_nodes(conflicts: DataFrame, category: str = "naming", severity: str = "low", confidence: float = 0.8) -> DataFrame:
    a, b = F.col("source_a"), F.col("source_b")
    metadata = F.to_json(F.struct("source_a", "source_b", F.lit(severity).alias("severity")))
    return conflicts.select(schema.conflict_id(F.lit(category), a, b).alias("id"), F.lit("CONFLICT").alias("type"), F.lit(category).alias("name"), a.alias("source"), F.lit(confidence).alias("confidence"), metadata.alias("metadata"))


def enrichment_edges(nodes: DataFrame, locations: DataFrame, conflicts: DataFrame, category: str = "naming") -> DataFrame:
    """(from_node, to_node, type): patterns implement, conflicts depend on, existing files."""
    pattern = locations.select(schema.pattern_id(F.col("pattern")).alias("from_node"), schema.file_id(F.col("path")).alias("to_node"), F.lit("IMPLEMENTS").alias("type"))
    own = schema.conflict_id(F.lit(category), F.col("source_a"), F.col("source_b"))
    conflict = conflicts.select(own.alias("from_node"), F.explode(F.array("source_a", "source_b")).alias("p")).select("from_node", schema.file_id(F.col("p")).alias("to_node"), F.lit("DEPENDS_ON").alias("type"))
    return pattern.union(conflict).distinct().join(nodes.select(F.col("id").alias("to_node")), "to_node", "left_semi").select(*schema.EDGE_KEY)


def concept_code_edges(concepts: DataFrame, nodes: DataFrame) -> DataFrame:
    """(from_node, to_node, type, weight): links of concepts to existing code."""
    links = concepts.select(F.col("id").alias("from_node"), F.explode("linked_code_paths").alias("p"), F.col("strength").alias("weight"))
    links = links.select("from_node", schema.file_id(F.col("p")).alias("to_node"), F.lit("REFERENCES").alias("type"), "weight").dropDuplicates(["from_node", "to_node"])
    return links.join(nodes.select(F.col("id").alias("to_node")), "to_node", "left_semi").select("from_node", "to_node", "type", "weight")


def concept_links(concepts: DataFrame) -> DataFrame:
    """(from_node, to_node, type): links to other existing concepts by name."""
    links = concepts.select(F.col("id").alias("from_node"), F.explode("related_concepts").alias("r"))
    links = links.select("from_node", F.concat(F.lit("vault:"), "r").alias("to_node"), F.lit("LINKS_TO").alias("type")).filter("from_node <> to_node").distinct()
    return links.join(concepts.select(F.col("id").alias("to_node")), "to_node", "left_semi").select(*schema.EDGE_KEY)


def orphan_concepts(concepts: DataFrame, nodes: DataFrame) -> DataFrame:
    """Concepts that link to no existing code and no other concept."""
    linked = concept_code_edges(concepts, nodes).select("from_node").union(concept_links(concepts).select("from_node"))
    return concepts.join(linked.select(F.col("from_node").alias("id")), "id", "left_anti")
