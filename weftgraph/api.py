"""The library's front: index a source tree, ask questions of it, follow its graph."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph import schema
from weftgraph.functions import task as K
from weftgraph.operators import edits, enrich, lookups, rank, resolve, traverse
from weftgraph.operators.store import SnapshotStore
from weftgraph.plans.staging import as_few, counted, stage
from weftgraph.sources import parse, scan

DEFAULT_BUDGET = 32_000


class Repository:
    """A source tree as snapshots of files, parse results, nodes and edges under a root folder."""

    def __init__(self, spark: SparkSession, store_root: str) -> None:
        self.spark, self.root = spark, store_root.rstrip("/")
        self.store = SnapshotStore(spark, f"{self.root}/graph")

    @property
    def files(self) -> DataFrame:
        return self.store.table("files")

    @property
    def nodes(self) -> DataFrame:
        return self.store.read()[0]

    @property
    def edges(self) -> DataFrame:
        return self.store.read()[1]

    @property
    def failures(self) -> DataFrame | None:
        """(path, error) of files and folders that the last index could not read or parse."""
        return self.store.table("failures")

    def index(self, tree: str, extensions: list[str] | None = None, globs: tuple[str, ...] = (), max_kb: int | None = None) -> dict[str, int]:
        """Lists the tree, reads files whose size or time changed, parses those whose content did, and commits
        files, parse results, terms and graph as one snapshot. Returns how many files were added, changed,
        unchanged and deleted. Without a change nothing is written. What can't be read keeps its old rows,
        if it has any, and is listed in `failures`. The ignore file at the root counts."""
        with self.store.lock():
            return self._index(tree, extensions, (*globs, *scan.ignore_file(self.spark, tree)), max_kb)

    def _index(self, tree: str, extensions: list[str] | None, globs: tuple[str, ...], max_kb: int | None) -> dict[str, int]:
        version = self.store.version()
        listing = stage(scan.list_tree(self.spark, tree), "listing")
        listed = scan.scannable(listing, extensions, globs)
        kept = {name: self.store.table(name, version) for name in ("files", "parsed", "terms")}
        if kept["files"] is None:
            todo = listed
        else:
            stamps = scan.changes(kept["files"], listed, by=("size_bytes", "modified_at"))
            stamps = stage(stamps, "stamps")
            moved = {r.change: r["count"] for r in stamps.groupBy("change").count().collect()}
            if set(moved) == {"unchanged"}:
                return {"added": 0, "changed": 0, "unchanged": moved["unchanged"], "deleted": 0}
            todo = listed.join(stamps.filter("change IN ('added', 'changed')").select("path"), "path", "left_semi").select(*listed.columns)
        todo = todo.repartition(max(1, min(4096, todo.count() // 64)))
        read = stage(scan.describe(scan.with_content(todo, tree, max_kb)).drop("content"), "read")
        broken = read.filter("error IS NOT NULL").select("path", "error").unionByName(listing.filter("error IS NOT NULL").select("path", "error"))
        fresh = read.filter("error IS NULL").drop("error", "at", "is_dir", "is_symlink")
        if kept["files"] is None:
            files, before = fresh, self.spark.createDataFrame([], fresh.schema)
        else:
            # a folder that can't be read keeps its files
            before = kept["files"]
            lost = listing.filter("is_dir AND error IS NOT NULL").select(F.concat("path", F.lit("/")).alias("_folder"))
            there = listed.select("path").union(before.join(lost, F.col("path").startswith(F.col("_folder")), "left_semi").select("path"))
            files = before.join(there, "path", "left_semi").join(fresh.select("path"), "path", "left_anti").unionByName(fresh.select(*before.columns))
        # the texts themselves are written by the commit alone
        known = stage(files.drop("text"), "files")
        change = stage(scan.changes(before, known), "changes")
        counts = {r.change: r["count"] for r in change.groupBy("change").count().collect()}
        touched = change.filter("change <> 'unchanged'").select("path")
        todo = fresh.join(change.filter("change IN ('added', 'changed')"), "path", "left_semi")
        parsed = parse.with_parsed(todo.select("path", "language", "text")).select("path", "parsed")
        terms = rank.file_terms(todo.select(schema.file_id(F.col("path")).alias("id"), "path", "text"))
        if kept["parsed"] is not None:
            parsed = parsed.unionByName(kept["parsed"].join(change.filter("change = 'unchanged'"), "path", "left_semi"))
            terms = terms.unionByName(kept["terms"].join(touched.select(schema.file_id(F.col("path")).alias("id")), "id", "left_anti"))
        parsed = stage(parsed, "parsed")
        failed = parsed.filter("parsed.confidence <= 0.2").select("path", F.element_at("parsed.errors", 1).alias("error"))
        nodes, edges = self._graph(known, parsed)
        terms = terms.repartitionByRange("term").sortWithinPartitions("term")  # so that a reader skips what it does not ask for
        self.store.commit(nodes, edges, {"files": files, "parsed": parsed, "terms": terms, "failures": broken.unionByName(failed)})
        return {k: counts.get(k, 0) for k in ("added", "changed", "unchanged", "deleted")}

    def _graph(self, files: DataFrame, parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
        known = files.join(parsed.select("path", F.col("parsed.confidence").alias("_sure")), "path").filter("_sure IS NOT NULL")
        metadata = F.to_json(F.struct(F.col("path").alias("file_path"), "language", "size_bytes", "lines_count"))
        file_nodes = known.select(schema.file_id(F.col("path")).alias("id"), F.lit("FILE").alias("type"), "name", F.col("path").alias("source"), F.col("_sure").alias("confidence"), metadata.alias("metadata"))
        symbol_nodes, belongs = parse.promote(parsed)
        paths = files.select("path", F.col("path").alias("ord"))
        imports = resolve.resolve(parse.dependencies(parsed), paths)
        weigh = lambda df, w, c: df.select("from_node", "to_node", "type", F.lit(w).alias("weight"), F.lit(c).alias("confidence"), F.lit(None).cast("string").alias("metadata"))
        ends = known.select(schema.file_id(F.col("path")).alias("to_node"))
        imports = weigh(imports.join(ends, "to_node", "left_semi"), 1.0, 0.9).dropDuplicates(schema.EDGE_KEY)
        patterns = enrich.design_patterns(files.select("path"))
        conflicts = enrich.naming_conflicts(files.select("path"))
        derived = weigh(enrich.enrichment_edges(file_nodes, enrich.pattern_locations(files, patterns), conflicts), 0.8, 0.8)
        nodes = file_nodes.unionByName(symbol_nodes.dropDuplicates(["id"])).unionByName(enrich.pattern_nodes(patterns)).unionByName(enrich.conflict_nodes(conflicts))
        return nodes, imports.unionByName(belongs.dropDuplicates(schema.EDGE_KEY)).unionByName(derived)

    def context(self, questions: list[str] | DataFrame, budget: int = DEFAULT_BUDGET, expand: bool = True) -> DataFrame:
        """(qid, id, type, path, rank, score, snippet) of each question's pack, best first.

        questions: texts, or rows (qid, text). All are answered by one plan. Files are found by the stored
        terms, other nodes by their names and metadata; with `expand` also what lies around the seeds of a
        question within the walk of its strategy, and settings if that includes them.
        """
        if isinstance(questions, list):
            questions = self.spark.createDataFrame(list(enumerate(questions)), "qid int, text string")
        words = K.keywords(F.col("text"))
        asked = questions.select("qid", K.task_type(F.col("text")).alias("kind"), words.alias("terms"), K.scope(words).alias("scope"))
        asked = counted(K.with_strategy(asked), "asked")
        version = self.store.version()
        nodes, edges = self.store.read(version)
        files, terms = self.store.table("files", version), self.store.table("terms", version)
        ids = files.select(schema.file_id(F.col("path")).alias("id"))
        others = nodes.filter(~F.col("type").isin("FILE", "PATTERN", "CONFLICT"))
        found = rank.text_match(terms, asked, ids).unionByName(rank.node_match(others, asked))
        total = ids.agg(F.greatest(F.count(F.lit(1)), F.lit(1))).first()[0]
        asked_terms = rank.wanted_terms(asked).select("term").distinct()
        frequency = rank.document_frequency(terms.join(as_few(asked_terms, asked), "term", "left_semi"))
        named = rank.name_answers(nodes, frequency, asked, total).withColumn("answers", F.lit(True))
        exact = rank.exact_symbols(nodes, asked).withColumn("exact", F.lit(True))
        match = found.join(named, ["qid", "id"], "full_outer").select("qid", "id", F.coalesce("match", F.lit(0.0)).alias("match"), F.coalesce("answers", F.lit(False)).alias("answers"))
        if expand:
            start = rank.seeds(nodes, lookups.name_tokens(nodes), asked.select("qid", F.col("terms").alias("words"), "scope"))
            start = start.join(asked.select("qid", F.col("upstream").alias("up"), F.col("downstream").alias("down"), (4 * F.col("max_nodes")).alias("budget")), "qid")
            near = traverse.around(edges, stage(start, "seeds")).select("qid", "id").union(rank.configs(nodes, asked)).distinct()
            match = match.join(near, ["qid", "id"], "full_outer").select("qid", "id", F.coalesce("match", F.lit(0.0)).alias("match"), F.coalesce("answers", F.lit(False)).alias("answers"))
        rows = match.join(as_few(asked.select("qid", "kind"), asked), "qid").join(exact, "qid", "left").join(nodes, "id").join(lookups.degrees(edges), "id", "left")
        value = rank.score(
            F.get_json_object("metadata", "$.file_path"), F.col("type"), F.col("confidence"), F.coalesce("out_degree", F.lit(0)), F.coalesce("in_degree", F.lit(0)),
            F.col("match"), F.col("kind"), F.col("answers"), F.coalesce("exact", F.lit(False)), off_name=~F.col("answers"),
        )
        top = rank.top_k(rows.select("qid", "id", "type", "name", "source", "metadata", value.alias("score")), rank.most_nodes(budget))
        cost = rank.tokens(F.concat_ws(" ", "id", "name", "type"))
        cut = rank.budget_cut(top.withColumn("cost", cost).withColumn("is_seed", F.lit(False)), budget)
        cut = stage(cut, "pack")
        line = F.coalesce(F.get_json_object("metadata", "$.line_start").cast("int"), F.lit(1))
        few = cut.select("qid", "id", "rank", "source", line.alias("line"))
        texts = files.select(F.col("path").alias("source"), "text").join(as_few(few, asked), "source")  # a bounded pack for each question
        parts = rank.snippets(texts.select("qid", "id", "rank", rank.first_lines(F.col("text"), F.col("line"), 40).alias("text")), budget)
        return cut.join(parts.drop("rank"), ["qid", "id"], "left").select("qid", "id", "type", F.col("source").alias("path"), "rank", "score", "snippet").orderBy("qid", "rank")

    def pack_edges(self, pack: DataFrame) -> DataFrame:
        """(qid, from_node, to_node, type, true_type): the edges between the nodes of a pack (qid, id)."""
        ends = [pack.select("qid", F.col("id").alias(end)) for end in ("from_node", "to_node")]
        return rank.pack_edges(self.edges.join(ends[0], "from_node").join(ends[1], ["qid", "to_node"]).select("qid", "from_node", "to_node", "type"))

    def context_around(self, node_ids: list[str], budget: int = DEFAULT_BUDGET) -> DataFrame:
        """(id, rank): the pack around given nodes, in the order in which it is come upon."""
        nodes, edges = self.store.read()
        start = self.spark.createDataFrame([(0, i, k) for k, i in enumerate(node_ids)], "qid int, id string, ord int")
        return rank.seeded_pack(nodes, edges, start, budget).select("id", "rank").orderBy("rank")

    def impact(self, node_id: str, depth: int = 3) -> DataFrame:
        nodes, edges = self.store.read()
        return traverse.impact(nodes, edges, self._ids(node_id), depth)

    def path(self, source: str, target: str) -> list[str] | None:
        row = traverse.shortest_path(self.edges, source, target).first()
        return list(row.path) if row else None

    def neighbours(self, node_id: str, depth: int = 1, reverse: bool = False) -> DataFrame:
        return traverse.neighbours(self.edges, self._ids(node_id), depth, reverse)

    def node(self, node_id: str) -> DataFrame:
        nodes, edges = self.store.read()
        return lookups.node_detail(nodes, edges, node_id)

    def cycles(self, longest: int | None = None) -> DataFrame:
        return traverse.cycles(self.edges.filter("type = 'IMPORTS'"), longest)

    def propose(self, reply: str) -> DataFrame:
        """(path, verdict, result, level, score) of the edits in a model's reply, reviewed against the snapshot."""
        replies = self.spark.createDataFrame([(0, reply)], "reply_id int, text string")
        found = edits.parse_edits(replies).filter("warning IS NULL").withColumn("edit_id", F.monotonically_increasing_id())
        files = self.files.select("path", F.col("text").alias("content"))
        names = F.pandas_udf(lambda t: t.map(parse.top_level_names), "array<string>")
        seen = stage(edits.review(found, files).join(files, "path", "left"), "review")
        diff = edits.names_diff(names(F.coalesce("content", F.lit(""))), names(F.coalesce("result", "content", F.lit(""))))
        rated = seen.select("edit_id", "path", "verdict", "result", diff.alias("d"))
        risk = edits.risk(F.size("d.added"), F.size("d.removed"), F.size("d.modified"), F.lit(0))
        return rated.select("path", "verdict", "result", risk.alias("r")).select("path", "verdict", "result", "r.level", "r.score")

    def ask(self, question: str, model: Callable[[str], str], budget: int = DEFAULT_BUDGET) -> DataFrame:
        """Hands a question with its rendered pack to a model and reviews the edits in its reply."""
        pack = self.context([question], budget).filter("snippet IS NOT NULL")
        shown = rank.render(pack.select("qid", "id", "rank", "snippet")).first()
        return self.propose(model(f"{question}\n\n{shown.text if shown else ''}\n\nReply with JSON: {{\"edits\": [{{\"path\", \"old_text\", \"new_text\", \"reason\"}}]}}"))

    def _ids(self, *ids: str) -> DataFrame:
        return self.spark.createDataFrame([(i,) for i in ids], "id string")
