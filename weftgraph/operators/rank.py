"""Ranking of nodes for a question, and the cuts that fit a budget of tokens.

Questions are rows: document frequencies are computed once, and any number of questions is answered
by one plan. A question's terms are joined with the inverted index on the term, so only postings of
words that were asked for are touched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.functions import text as T
from weftgraph.plans.staging import as_few, counted, stage

# Weights of node types by task type (1 where absent), names and endings of prose and settings.
TYPE_WEIGHTS = (
    ("BUG_FIX", "FILE", 1.5), ("BUG_FIX", "FUNCTION", 2.0), ("BUG_FIX", "CLASS", 1.2), ("BUG_FIX", "VAULT_CONCEPT", 0.8),
    ("BUG_FIX", "DECISION", 0.5), ("BUG_FIX", "PATTERN", 0.6), ("BUG_FIX", "CONFIG", 1.3),
    ("FEATURE_ADDITION", "FILE", 1.5), ("FEATURE_ADDITION", "CLASS", 1.8), ("FEATURE_ADDITION", "FUNCTION", 1.2), ("FEATURE_ADDITION", "PATTERN", 1.4),
    ("FEATURE_ADDITION", "VAULT_CONCEPT", 1.0), ("FEATURE_ADDITION", "DECISION", 0.9), ("FEATURE_ADDITION", "CONFIG", 1.0),
    ("REFACTOR", "FILE", 1.5), ("REFACTOR", "CLASS", 1.6), ("REFACTOR", "MODULE", 1.4), ("REFACTOR", "PATTERN", 1.3), ("REFACTOR", "DECISION", 1.1),
    ("REFACTOR", "VAULT_CONCEPT", 0.9),
    ("OPTIMIZATION", "FUNCTION", 1.8), ("OPTIMIZATION", "FILE", 1.4), ("OPTIMIZATION", "PATTERN", 1.2),
    ("DEBUG_TRACE", "FUNCTION", 1.8), ("DEBUG_TRACE", "FILE", 1.5), ("DEBUG_TRACE", "CLASS", 1.3), ("DEBUG_TRACE", "CONFIG", 1.1),
    ("ARCHITECTURE_REVIEW", "MODULE", 1.7), ("ARCHITECTURE_REVIEW", "DECISION", 1.5), ("ARCHITECTURE_REVIEW", "PATTERN", 1.4),
    ("ARCHITECTURE_REVIEW", "FILE", 1.1),
)
PROSE = r"(?i)(\.(md|markdown|rst|txt|adoc)$)|(^(pyproject\.toml|setup\.cfg|setup\.py|requirements\.txt|dockerfile|makefile|tox\.ini|noxfile\.py)$)|(^(requirements|constraints)[^.]*(\..*)?\.(txt|in)$)"
TEST = r"^test_|_test(\.py)?$"


NODE_TERMS = 20_000  # terms of questions against which nodes are tested in place at most


def base_name(path: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(path, r"\\", "/"), "/"), -1)


def is_test(path: Column) -> Column:
    return F.coalesce(base_name(path).rlike(TEST), F.lit(False))


def is_prose(path: Column) -> Column:
    return F.coalesce(base_name(path).rlike(PROSE), F.lit(False))


def file_terms(files: DataFrame, max_chars: int | None = None) -> DataFrame:
    """(id, term): different stems of each file's name and text. files: id, path, text.

    Words are taken apart and stemmed in the file's own row, so no pair is shuffled, however many different
    words the corpus has. Only rows of an id that occurs again are brought together.
    """
    body = F.substring("text", 1, max_chars) if max_chars else F.col("text")
    names = F.transform(T.name_parts(F.regexp_replace(base_name(F.col("path")), r"\.[^.]*$", "")), T.stem)
    none = F.array().cast("array<string>")
    found = F.array_distinct(F.concat(F.coalesce(T.stems(T.words(body)), none), F.coalesce(names, none)))
    again = files.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("id").alias("_id"))
    again = counted(again, "repeated")
    if again.isEmpty():
        return files.select("id", F.explode(found).alias("term"))
    same = F.col("id").eqNullSafe(F.col("_id"))
    split = [files.join(again, same, how).select("id", F.explode(found).alias("term")) for how in ("left_anti", "left_semi")]
    return split[0].union(split[1].distinct())


def document_frequency(terms: DataFrame) -> DataFrame:
    """(term, df). The pairs of file_terms are different already, so a count is enough."""
    return terms.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def idf(df: Column, files: Column) -> Column:
    return F.log((files + 1) / (F.coalesce(df, F.lit(0)) + 1)) + 1


def wanted_terms(questions: DataFrame) -> DataFrame:
    """(qid, term) of questions (qid, terms array): different stems of the words' parts."""
    parts = F.flatten(F.transform("terms", lambda w: F.filter(F.split(w, r"[_\-\s]+"), lambda x: x != "")))
    return questions.select("qid", F.explode(F.array_distinct(F.transform(parts, T.stem))).alias("term"))


def text_match(terms: DataFrame, questions: DataFrame, files: DataFrame) -> DataFrame:
    """(qid, id, match): part of a question's inverse document frequencies that a file's terms cover.

    files: any table with a row for each file, to be counted. The postings of the words asked for are
    written once; frequencies and matches are taken from them.
    """
    total = files.agg(F.greatest(F.count(F.lit(1)), F.lit(1)).alias("files"))
    wanted = counted(wanted_terms(questions), "wanted")
    hits = stage(terms.join(as_few(wanted.select("term").distinct(), wanted), "term", "left_semi"), "postings")
    weights = wanted.join(document_frequency(hits), "term", "left").crossJoin(F.broadcast(total))
    weights = weights.select("qid", "term", idf(F.col("df"), F.col("files")).alias("w"))
    most = weights.groupBy("qid").agg(F.sum("w").alias("most"))
    found = hits.join(as_few(weights, wanted), "term").groupBy("qid", "id").agg(F.sum("w").alias("w"))
    return found.join(as_few(most, wanted), "qid").select("qid", "id", F.least(F.lit(1.0), F.col("w") / F.col("most")).alias("match"))


def name_answers(nodes: DataFrame, frequency: DataFrame, questions: DataFrame, files: int | Column) -> DataFrame:
    """(qid, id) of nodes whose own name answers: it holds the one word asked for, all of them, two of
    them, or one that at most a quarter of the files use."""
    wanted = counted(wanted_terms(questions), "wanted")
    asked = as_few(wanted.groupBy("qid").agg(F.count(F.lit(1)).alias("asked")), wanted)
    names = nodes.select("id", F.explode(F.array_distinct(F.transform(T.name_parts(F.regexp_replace("name", r"\.py", "")), T.stem))).alias("term"))
    met = names.join(wanted, "term").join(frequency, "term", "left").groupBy("qid", "id").agg(F.count(F.lit(1)).alias("n"), F.min(F.coalesce("df", F.lit(0))).alias("rarest"))
    total = files if isinstance(files, Column) else F.lit(files)
    answers = (F.col("asked") == 1) | (F.col("n") >= 2) | (F.col("n") == F.col("asked")) | (F.col("rarest") * 4 <= total)
    return met.join(asked, "qid").filter(answers).select("qid", "id")


def node_match(nodes: DataFrame, questions: DataFrame) -> DataFrame:
    """(qid, id, match) of nodes (id, name, metadata) without terms of their own: the part of a question's
    terms, weighted by their length, that stand in the node's name or in values of its metadata. Nodes are
    tested against the different terms of all questions, and hits are joined with the questions by term."""
    wanted = counted(wanted_terms(questions).withColumn("w", 1 + F.least(F.length("term"), F.lit(12)) / 12.0), "wanted", NODE_TERMS)
    most = as_few(wanted.groupBy("qid").agg(F.sum("w").alias("most")), wanted)
    values = F.regexp_replace(F.coalesce("metadata", F.lit("")), r'"[^"]*"\s*:', "")
    text = nodes.select("id", F.lower(F.concat_ws(" ", "name", values)).alias("_text"))
    hits = text.join(as_few(wanted.select("term").distinct(), wanted), F.col("_text").contains(F.col("term"))).select("id", "term")
    found = hits.join(wanted, "term").groupBy("qid", "id").agg(F.sum("w").alias("w"))
    return found.join(most, "qid").select("qid", "id", (F.col("w") / F.col("most")).alias("match"))


def exact_symbols(nodes: DataFrame, questions: DataFrame) -> DataFrame:
    """Questions (qid) whose words are exactly some function's or class's name."""
    symbols = nodes.filter(F.col("type").isin("FUNCTION", "CLASS"))
    key = symbols.select(F.array_join(F.array_sort(F.array_distinct(F.transform(T.name_parts(F.col("name")), T.stem))), " ").alias("key"))
    asked = wanted_terms(questions).groupBy("qid").agg(F.array_join(F.array_sort(F.collect_set("term")), " ").alias("key"))
    return asked.join(key, "key", "left_semi").select("qid")


def weight_of_type(kind: Column, node_type: Column) -> Column:
    out = None
    for k, t, w in TYPE_WEIGHTS:
        hit = (kind == k) & (node_type == t)
        out = F.when(hit, w) if out is None else out.when(hit, w)
    return out.otherwise(1.0)


def score(
    path: Column, node_type: Column, confidence: Column, out_degree: Column, in_degree: Column, match: Column, kind: Column,
    answers: Column | bool = False, exact: Column | bool = False, risk: Column | str = "low", orphan: Column | bool = False, complexity: Column | float = 0.0,
    off_name: Column | bool = False,
) -> Column:
    """Text evidence, structure and kind of a node as one number, to three places."""
    answers, exact, risk, orphan, complexity, off_name = (x if isinstance(x, Column) else F.lit(x) for x in (answers, exact, risk, orphan, complexity, off_name))
    weak = is_test(path) | is_prose(path)
    derived = node_type.isin("PATTERN", "CONFLICT", "DECISION")
    text = 15.0 * match * F.when(weak, 0.3).otherwise(1.0)
    degree = lambda d: F.least(F.log1p(d), F.lit(6.0))
    structure = (1.5 * confidence + 0.5 * degree(out_degree) + 0.6 * degree(in_degree)) * F.when(weak, 0.25).otherwise(1.0) * F.when(orphan, 0.3).otherwise(1.0)
    structure = (structure + F.when(risk == "high", 2.0).when(risk == "medium", 1.0).otherwise(0.0)) * weight_of_type(kind, node_type)
    structure = structure + F.least(complexity / 50.0, F.lit(1.0))
    whole = text + F.when(derived, 0.15).otherwise(1.0) * structure
    whole = whole + F.when(node_type == "FILE", F.when(~exact & answers, 9.0).otherwise(1.5)).when(node_type == "CLASS", 0.7).when(node_type == "FUNCTION", 0.6).when(node_type == "VAULT_CONCEPT", 0.4).otherwise(0.0)
    whole = whole * F.when(node_type.isin("FUNCTION", "CLASS") & off_name, 0.3).otherwise(1.0) * F.when(derived, 0.2).otherwise(1.0)
    return F.round(whole, 3)


def top_k(scored: DataFrame, k: int, by: str = "score") -> DataFrame:
    """Each question's k best (qid, id, ...), with rank. Spark keeps the k best of a task before the shuffle."""
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.col(by).desc(), F.col("id")))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= k)


def most_nodes(budget: int) -> int:
    """Nodes that a budget of tokens admits."""
    return max(12, min(120, budget // 300))


def tokens(text: Column) -> Column:
    """Estimated tokens of a text."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("long")


def budget_cut(ranked: DataFrame, budget: int, by: str = "qid") -> DataFrame:
    """Rows (rank, cost, is_seed) up to the first that is no seed and no longer fits; nothing after it stays."""
    order = Window.partitionBy(by).orderBy("rank")
    used = ranked.withColumn("used", F.sum("cost").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    out = used.withColumn("_cut", F.min(F.when(~F.col("is_seed") & (F.col("used") > budget), F.col("rank"))).over(Window.partitionBy(by)))
    return out.filter("_cut IS NULL OR rank < _cut").drop("_cut")


def first_fit(ranked: DataFrame, budget: int, by: str = "qid") -> DataFrame:
    """(by, id): greedy by rank, skipping what doesn't fit. The ranked list is a top-k, so folding it is bounded."""
    listed = ranked.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("rank", "id", "cost"))).alias("list"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<string>").alias("ids"))

    def step(acc: Column, x: Column) -> Column:
        fits = acc["used"] + x["cost"] <= budget
        return F.struct(F.when(fits, acc["used"] + x["cost"]).otherwise(acc["used"]).alias("used"), F.when(fits, F.concat(acc["ids"], F.array(x["id"].cast("string")))).otherwise(acc["ids"]).alias("ids"))

    return listed.select(by, F.explode(F.aggregate("list", start, step)["ids"]).alias("id"))


def risk_summary(nodes: DataFrame, risk: Column) -> DataFrame:
    """(n, high, medium, score): counts of risky nodes, and their weighted share."""
    high, medium = F.sum(F.when(risk == "high", 1).otherwise(0)), F.sum(F.when(risk == "medium", 1).otherwise(0))
    found = nodes.agg(F.count(F.lit(1)).alias("n"), high.cast("long").alias("high"), medium.cast("long").alias("medium"))
    return found.withColumn("score", F.round(F.least((3 * F.col("high") + F.col("medium")) / F.greatest("n", F.lit(1)), F.lit(5.0)), 2))


def first_lines(text: Column, start: Column, n: int) -> Column:
    """Up to n lines of a text from a 1-based line on."""
    return F.array_join(F.slice(F.split(text, "\r\n|\r|\n"), start, F.lit(n)), "\n")


def snippets(ranked: DataFrame, budget: int, by: str = "qid", each: int = 2400, least: int = 200) -> DataFrame:
    """(by, id, rank, snippet): texts in rank order within 70 % of the budget in characters; each is cut
    at its last line end to what is left, and skipped when little is left. A bounded list is folded."""
    room = int(budget * 0.7) * 4
    listed = ranked.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("rank", "id", F.left("text", F.lit(each + 1)).alias("text")))).alias("list"))
    kind = "array<struct<id:string,rank:int,snippet:string>>"
    start = F.struct(F.lit(room).alias("room"), F.array().cast(kind).alias("kept"))

    def step(acc: Column, x: Column) -> Column:
        size = F.least(acc["room"], F.lit(each))
        cut = F.left(x["text"], size)
        at_line = F.when(F.instr(cut, "\n") > 0, F.regexp_replace(cut, r"\n[^\n]*$", "")).otherwise(cut)
        own = F.when(F.length(x["text"]) > size, F.concat(at_line, F.lit("\n..."))).otherwise(x["text"])
        taken = F.when(F.length(x["text"]) > size, F.length(at_line)).otherwise(F.length(x["text"]))
        skip = (acc["room"] <= least) | x["text"].isNull()
        item = F.array(F.struct(x["id"].cast("string").alias("id"), x["rank"].cast("int").alias("rank"), own.alias("snippet")))
        return F.struct(F.when(skip, acc["room"]).otherwise(acc["room"] - taken).cast("int").alias("room"), F.when(skip, acc["kept"]).otherwise(F.concat(acc["kept"], item)).cast(kind).alias("kept"))

    return listed.select(by, F.explode(F.aggregate("list", start, step)["kept"]).alias("k")).select(by, "k.*")


def render(ranked: DataFrame, max_chars: int = 24_000, lines: int = 40, by: str = "qid") -> DataFrame:
    """(by, text): snippets (rank, id, snippet) of at most so many lines, up to the first that overflows."""
    part = F.concat(F.lit("## "), F.col("id"), F.lit("\n"), first_lines(F.col("snippet"), F.lit(1), lines))
    order = Window.partitionBy(by).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    kept = ranked.withColumn("_part", part).withColumn("_used", F.sum(F.length("_part")).over(order)).filter(F.col("_used") <= max_chars)
    return kept.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "_part"))), lambda x: x["_part"]), "\n").alias("text"))


def hidden_risks(nodes: DataFrame, risk: Column) -> DataFrame:
    """(id, message) of risky nodes."""
    return nodes.withColumn("_r", risk).filter(F.col("_r").isin("high", "medium")).select("id", F.format_string("%s risk: %s", F.col("_r"), F.col("name")).alias("message"))


def required_files(files: DataFrame, kept: DataFrame) -> DataFrame:
    """Files (file) that are a kept node's path or a part of it; a pack bounds the kept nodes, which are counted."""
    paths = counted(kept.select(F.col("path").alias("_path")).distinct(), "kept")
    return files.join(paths, F.col("_path").contains(F.col("file")), "left_semi")


def pack_edges(edges: DataFrame) -> DataFrame:
    """A pack's edges: all depend on each other for a reader; the true type is kept beside."""
    return edges.withColumn("true_type", F.col("type")).withColumn("type", F.lit("DEPENDS_ON"))


def seeds(nodes: DataFrame, tokens: DataFrame, questions: DataFrame) -> DataFrame:
    """(qid, id): nodes from which a question's walk starts, for questions (qid, words, scope): the file of
    each path in its scope, and all nodes of whose names (tokens: token, id) one holds a keyword or shares
    its stem. The different keywords are tested against the different tokens of names, not against nodes."""
    words = questions.select("qid", F.explode("words").alias("word")).select("qid", F.lower("word").alias("word")).distinct()
    words = counted(words.withColumn("stem", T.light_stem(F.col("word"))), "keywords", NODE_TERMS)
    different = as_few(words.select("word", "stem").distinct(), words)
    token, stem = F.col("token"), F.col("stem")
    fits = token.contains(F.col("word")) | ((stem != "") & (token.contains(stem) | stem.contains(token)))
    met = tokens.select("token").distinct().join(different, fits).select("token", "word")
    by_word = tokens.join(met, "token").select("word", "id").distinct().join(words.select("qid", "word"), "word").select("qid", "id")
    paths = counted(questions.select("qid", F.explode("scope").alias("path")).select("qid", F.regexp_replace("path", r"\\", "/").alias("path")).distinct(), "scope", NODE_TERMS)
    name = F.regexp_replace("name", r"\\", "/")
    own = (name == F.col("path")) | name.endswith(F.concat(F.lit("/"), F.col("path"))) | F.col("path").endswith(name)
    by_path = nodes.filter("type = 'FILE'").join(paths, own).groupBy("qid", "path").agg(F.min("id").alias("id")).select("qid", "id")
    return by_word.union(by_path).distinct()


def configs(nodes: DataFrame, questions: DataFrame) -> DataFrame:
    """(qid, id): settings, for each question (qid, configs) whose strategy includes them. Questions are counted."""
    asked = counted(questions.filter("configs").select("qid").distinct(), "asked", NODE_TERMS)
    return nodes.filter("type = 'CONFIG'").select("id").join(asked, F.lit(True)).select("qid", "id")


def seeded_pack(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, budget: int) -> DataFrame:
    """(qid, id, rank): the pack around seeds (qid, id, ord): the seeds in order, then what their edges lead
    to, then what leads to any of these, each in the order in which it is come upon (edges by id); of the
    existing ones those that still fit the budget of tokens."""
    seeds = seeds.groupBy("qid", "id").agg(F.min("ord").alias("ord"))
    start = seeds.select("qid", "id", F.struct(F.lit(0).alias("phase"), F.col("ord").cast("long").alias("at"), F.lit("").alias("by")).alias("place"))
    out = start.join(edges.select(F.col("from_node").alias("id"), "to_node"), "id")
    out = out.select("qid", F.col("to_node").alias("id"), F.struct(F.lit(1).alias("phase"), F.col("place.at"), F.col("to_node").alias("by")).alias("place"))
    first = start.union(out).groupBy("qid", "id").agg(F.min("place").alias("place"))
    numbered = first.withColumn("at", F.row_number().over(Window.partitionBy("qid").orderBy("place", "id")).cast("long"))
    numbered = stage(numbered, "around")
    into = numbered.join(edges.select(F.col("to_node").alias("id"), "from_node"), "id")
    into = into.select("qid", F.col("from_node").alias("id"), F.struct(F.lit(2).alias("phase"), F.col("at"), F.col("from_node").alias("by")).alias("place"))
    every = numbered.select("qid", "id", F.struct(F.lit(0).alias("phase"), F.col("at"), F.lit("").alias("by")).alias("place")).union(into)
    every = every.groupBy("qid", "id").agg(F.min("place").alias("place")).join(nodes.select("id", "type", "name"), "id")
    ranked = every.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("place", "id")))
    ranked = ranked.select("qid", "id", "rank", tokens(F.concat_ws(" ", "id", "type", "name")).alias("cost"))
    return first_fit(ranked, budget).join(ranked, ["qid", "id"]).select("qid", "id", "rank")
