"""Registered queries over documents as files: scans, parsing, terms, questions, ranking, budgets."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftgraph import schema
from weftgraph.functions import task as K
from weftgraph.functions import text as T
from weftgraph.operators import rank, resolve
from weftgraph.plans import fixtures as X
from weftgraph.plans.registry import query
from weftgraph.sources import parse, scan

W = f"WITH {X.FILES_SQL} "


def _case(expr: str, table) -> str:
    return "CASE " + " ".join(f"WHEN {expr} IN ({', '.join(repr(e) for e in ends.split())}) THEN '{name}'" for name, ends in table)


_EXT = "('.' || list_last(string_split(path, '.')))"
_LANG = _case(_EXT, scan.LANGUAGES) + " END"


@query("s01_s04_ignored", f"{W} SELECT path, (list_has_any(string_split(path, '/'), ['build', 'dist', 'env']) OR {_EXT} IN ('.lock', '.bin') OR regexp_full_match(path, 'src1.*\\.md') OR regexp_full_match(list_last(string_split(path, '/')), '.*7\\.py')) AS ignored FROM files")
def _(spark, d):
    # the same globs on the path and its parts
    f = X.files(spark, d)
    return f.select("path", scan.is_ignored(F.col("path"), ("src1*.md", "*7.py")).alias("ignored"))


@query("s05_language", f"{W} SELECT path, {_LANG} AS language FROM files")
def _(spark, d):
    return X.files(spark, d).select("path", scan.language(scan.extension(F.col("path"))).alias("language"))


@query("s06_category", f"{W} SELECT path, {_case(_EXT, scan.CATEGORIES)} WHEN ({_LANG}) IS NOT NULL THEN 'source' ELSE 'unknown' END AS category FROM files")
def _(spark, d):
    return X.files(spark, d).select("path", scan.category(scan.extension(F.col("path"))).alias("category"))


@query("s07_binary", "WITH b AS (SELECT doc_id, regexp_extract_all(substr(hex(coalesce(text, '')), 1, 16384), '..') AS b FROM documents) SELECT doc_id, CASE WHEN len(b) = 0 THEN false WHEN list_contains(b, '00') THEN true ELSE len(list_filter(b, lambda x: NOT regexp_full_match(x, '0[789ACD]|1B|[2-6][0-9A-F]|7[0-9A-E]'))) / len(b) > 0.3 END AS is_binary FROM b")
def _(spark, d):
    docs = X.table(spark, d, "documents")
    return docs.select("doc_id", scan.is_binary(F.coalesce("text", F.lit("")).cast("binary")).alias("is_binary"))


@query("s08_hash", "SELECT doc_id, sha256(text) AS hash_value, md5(text) AS md5 FROM documents")
def _(spark, d):
    return X.table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("hash_value"), F.md5("text").alias("md5"))


@query("s09_file_ids", f"{W} SELECT path, sha256(lower(path)) AS id FROM files")
def _(spark, d):
    return X.files(spark, d).select("path", schema.scanned_file_id(F.col("path")).alias("id"))


@query("s10_lines", "SELECT doc_id, (length(text) - length(replace(text, chr(10), '')) + CASE WHEN length(text) > 0 AND right(text, 1) <> chr(10) THEN 1 ELSE 0 END)::BIGINT AS lines_count FROM documents")
def _(spark, d):
    return X.table(spark, d, "documents").select("doc_id", scan.lines_count(F.col("text")).alias("lines_count"))


@query("s11_hidden", f"{W} SELECT path, len(list_filter(string_split(path, '/'), lambda p: starts_with(p, '.'))) > 0 AS is_hidden FROM files")
def _(spark, d):
    return X.files(spark, d).select("path", scan.is_hidden(F.col("path")).alias("is_hidden"))


def snapshots(spark, d):
    """The files as they were and as they are: each ninth is new, each fifth of the rest gone, each seventh changed."""
    f = X.files(spark, d).select("path", "doc_id", F.sha2("text", 256).alias("hash_value"), F.length("text").alias("size_bytes"))
    old = f.filter("doc_id % 9 <> 0").withColumn("hash_value", F.when(F.col("doc_id") % 7 == 0, "old").otherwise(F.col("hash_value")))
    return old, f.filter("doc_id % 9 = 0 OR doc_id % 5 <> 0")


@query("s14_changes", f"{W} SELECT path, CASE WHEN doc_id % 9 = 0 THEN 'added' WHEN doc_id % 5 = 0 THEN 'deleted' WHEN doc_id % 7 = 0 THEN 'changed' ELSE 'unchanged' END AS change FROM files")
def _(spark, d):
    return scan.changes(*snapshots(spark, d))


@query("s15_tree", f"{W}, p AS (SELECT string_split(path, '/') AS p FROM files), s AS (SELECT p, unnest(range(1, len(p) + 1)) AS n FROM p) SELECT DISTINCT CASE WHEN n = 1 THEN '.' ELSE array_to_string(p[1:n-1], '/') END AS parent, p[n] AS child FROM s")
def _(spark, d):
    return scan.tree(X.files(spark, d))


@query("s16_statistics", f"{W}, e AS (SELECT {_EXT} AS ext, {_LANG} AS lang FROM files) SELECT 'language' AS kind, coalesce(lang, 'unknown') AS key, count(*) AS n FROM e GROUP BY 2 UNION ALL SELECT 'extension', ext, count(*) FROM e GROUP BY 2 UNION ALL SELECT 'content', 'text', count(*) FROM e")
def _(spark, d):
    ext = scan.extension(F.col("path"))
    return scan.statistics(X.files(spark, d).select(ext.alias("extension"), scan.language(ext).alias("language"), F.lit(False).alias("is_binary")))


_LINES = "lines AS (SELECT path, unnest(l) AS content, generate_subscripts(l, 1) AS line FROM (SELECT path, regexp_split_to_array(text, '\\r\\n|\\r|\\n') AS l FROM files))"


@query("s20_preview", f"{W}, {_LINES} SELECT path, line::INTEGER AS line, content AS text FROM lines WHERE line <= 200")
def _(spark, d):
    return scan.preview(X.files(spark, d))


@query("p05_href_imports", "SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS target FROM pages")
def _(spark, d):
    return parse.href_imports(X.table(spark, d, "pages"))


def notes(spark, d):
    """Documents as notes: short lines that end a sentence become headings, words of nine letters are links."""
    text = F.regexp_replace("text", r"(?m)^([^\n]{1,60}\.)$", "## $1")
    text = F.regexp_replace(text, r"(^|[ .,\n])([a-z]{9})([ .,\n]|$)", "$1[[$2|x]]$3")
    return X.files(spark, d).select("path", text.alias("text"))


_NOTES = f"{X.FILES_SQL}, notes AS (SELECT path, regexp_replace(regexp_replace(text, '(?m)^([^\\n]{{1,60}}\\.)$', '## \\1', 'g'), '(^|[ .,\\n])([a-z]{{9}})([ .,\\n]|$)', '\\1[[\\2|x]]\\3', 'g') AS text FROM files), lines AS (SELECT path, unnest(l) AS content, generate_subscripts(l, 1) AS line FROM (SELECT path, regexp_split_to_array(text, '\\r\\n|\\r|\\n') AS l FROM notes))"


@query("p06_headings", f"WITH {_NOTES} SELECT path, line::INTEGER AS line, length(regexp_extract(content, '^(#{{1,6}})\\s+(.+)$', 1))::INTEGER AS level, trim(regexp_extract(content, '^(#{{1,6}})\\s+(.+)$', 2)) AS title FROM lines WHERE regexp_matches(content, '^(#{{1,6}})\\s+(.+)$')")
def _(spark, d):
    return parse.headings(notes(spark, d))


@query("p10_wikilinks", f"WITH {_NOTES} SELECT path, line::INTEGER AS line, trim(unnest(regexp_extract_all(content, '\\[\\[([^\\]|]+)(?:\\|[^\\]]*)?\\]\\]', 1))) AS target FROM lines")
def _(spark, d):
    return parse.wikilinks(notes(spark, d))


@query("p11_config_keys", "SELECT p_partkey || '.cfg' AS path, unnest([2, 3, 5])::INTEGER AS line, unnest([p_name, 'size', p_brand]) AS key FROM part")
def _(spark, d):
    p = X.table(spark, d, "part")
    text = F.concat(F.lit("# settings: none\n"), F.col("p_name"), F.lit(": 1\n 'size' = 3\nno key here\n"), F.col("p_brand"), F.lit("=a:b\n\n"))
    return parse.config_keys(p.select(F.concat(F.col("p_partkey").cast("string"), F.lit(".cfg")).alias("path"), text.alias("text")))


@query("p11_structured_keys", "SELECT p_partkey || '.json' AS path, unnest(['name', 'more', 'more.size', 'more.kind', 'more.kind.brand', 'list']) AS key FROM part")
def _(spark, d):
    p = X.table(spark, d, "part")
    more = F.struct(F.col("p_size").alias("size"), F.struct(F.col("p_brand").alias("brand")).alias("kind"))
    text = F.to_json(F.struct(F.col("p_name").alias("name"), more.alias("more"), F.array(F.lit(1)).alias("list")))
    files = p.select(F.concat(F.col("p_partkey").cast("string"), F.lit(".json")).alias("path"), F.lit(".json").alias("extension"), text.alias("text"))
    return parse.structured_keys(files).select("path", F.explode("keys").alias("key"))


def scripts(spark, d):
    """Parts as scripts with a function, an arrow function, a class and imports."""
    p = X.table(spark, d, "part")
    name = F.regexp_replace("p_name", "[^A-Za-z0-9]+", "_")
    text = F.concat(F.lit("import { a } from './lib/"), name, F.lit("';\nexport async function run_"), name, F.lit("(x) {\n}\nconst go_"), name, F.lit(" = (y) => y;\nexport default class C_"), name, F.lit(" {}\nconst z = require(\"z/"), name, F.lit("\");\n"))
    return p.select(F.concat(F.col("p_partkey").cast("string"), F.lit(".js")).alias("path"), text.alias("text"))


_SCRIPT = "s AS (SELECT p_partkey || '.js' AS path, regexp_replace(p_name, '[^A-Za-z0-9]+', '_', 'g') AS n FROM part)"


@query("p03_script_symbols", f"WITH {_SCRIPT} SELECT path, 'FUNCTION' AS kind, 'run_' || n AS name FROM s UNION ALL SELECT path, 'FUNCTION', 'go_' || n FROM s UNION ALL SELECT path, 'CLASS', 'C_' || n FROM s")
def _(spark, d):
    return parse.script_symbols(scripts(spark, d))


@query("p03_script_imports", f"WITH {_SCRIPT} SELECT path AS source_file, './lib/' || n AS target_module FROM s UNION ALL SELECT path, 'z/' || n FROM s")
def _(spark, d):
    return parse.script_imports(scripts(spark, d))


def modules(spark, d):
    """Parts as Python modules: a class with a method, a private function, two imports."""
    p = X.table(spark, d, "part")
    name = F.regexp_replace("p_name", "[^A-Za-z0-9]+", "_")
    text = F.concat(F.lit("import os, sys\nfrom ..pkg import x\n\nclass C_"), name, F.lit(":\n    def go(self):\n        return helper(1)\n\ndef _p_"), name, F.lit("():\n    pass\n"))
    return p.select(F.concat(F.col("p_partkey").cast("string"), F.lit(".py")).alias("path"), text.alias("text"))


_MODULE = "m AS (SELECT p_partkey || '.py' AS path, regexp_replace(p_name, '[^A-Za-z0-9]+', '_', 'g') AS n FROM part)"


@query("p01_python_symbols", f"WITH {_MODULE} SELECT path AS file_path, 'C_' || n AS name, 'CLASS' AS kind, 4 AS line_start, 6 AS line_end, false AS is_private FROM m UNION ALL SELECT path, 'go', 'FUNCTION', 5, 6, false FROM m UNION ALL SELECT path, '_p_' || n, 'FUNCTION', 8, 9, true FROM m")
def _(spark, d):
    return parse.symbols(parse.with_parsed(modules(spark, d))).drop("decorators")


@query("p01_python_imports", f"WITH {_MODULE} SELECT path AS source_file, t AS target_module, line, level FROM m, (VALUES ('os', 1, 0), ('sys', 1, 0), ('pkg', 2, 2)) AS v(t, line, level)")
def _(spark, d):
    return parse.dependencies(parse.with_parsed(modules(spark, d))).select("source_file", "target_module", "line", "level")


@query("p14_symbol_promotion", f"WITH {_MODULE}, s AS (SELECT path, 'C_' || n AS name, 4 AS l FROM m UNION ALL SELECT path, 'go', 5 FROM m UNION ALL SELECT path, '_p_' || n, 8 FROM m) SELECT 'file:' || path || '::symbol:' || name || ':' || l AS from_node, 'file:' || path AS to_node, 'BELONGS_TO' AS type, 0.6::DOUBLE AS weight FROM s")
def _(spark, d):
    return parse.promote(parse.with_parsed(modules(spark, d)))[1].select("from_node", "to_node", "type", "weight")


# words, stems, terms --------------------------------------------------------------------------------

_WORDS = f"words AS (SELECT DISTINCT unnest(regexp_extract_all(text, '{T.WORD}')) AS word FROM documents), cut AS (SELECT word, {T.cut_sql('word')} AS cut FROM words)"


@query("p17_stem", f"WITH {_WORDS} SELECT word, {T.bucket_sql('word', 'cut')} AS stem FROM cut")
def _(spark, d):
    words = X.table(spark, d, "documents").select(F.explode(T.words(F.col("text"))).alias("word")).distinct()
    return words.select("word", T.stem(F.col("word")).alias("stem"))


_LIGHT = "WITH words AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '{w}'))) AS w FROM documents), b AS (SELECT w, CASE WHEN w LIKE '%ing' THEN substr(w, 1, length(w) - 3) WHEN w LIKE '%ed' THEN substr(w, 1, length(w) - 2) END AS base FROM words) SELECT w AS word, CASE WHEN length(w) <= 4 OR w IN ({stop}) THEN '' WHEN base IS NOT NULL THEN CASE WHEN length(base) < 3 THEN '' WHEN length(base) > 3 AND right(base, 1) = substr(base, length(base) - 1, 1) AND right(base, 1) NOT IN ('a', 'e', 'i', 'o', 'u') THEN substr(base, 1, length(base) - 1) ELSE base END WHEN w LIKE '%ies' THEN substr(w, 1, length(w) - 3) || 'y' WHEN w LIKE '%sses' OR w LIKE '%shes' OR w LIKE '%ches' THEN substr(w, 1, length(w) - 2) WHEN w LIKE '%s' AND w NOT LIKE '%ss' THEN substr(w, 1, length(w) - 1) ELSE '' END AS stem FROM b"


@query("p19_light_stem", _LIGHT.format(w=T.WORD, stop=", ".join(f"'{w}'" for w in T.LIGHT_STOPWORDS)))
def _(spark, d):
    words = X.table(spark, d, "documents").select(F.explode(T.words(F.col("text"))).alias("w")).select(F.lower("w").alias("word")).distinct()
    return words.select("word", T.light_stem(F.col("word")).alias("stem"))


_STOP = ", ".join(f"'{w}'" for w in T.SOURCE_STOPWORDS)
_TERMS = f"""{X.FILES_SQL}, fw AS (SELECT DISTINCT id, unnest(regexp_extract_all(text, '{T.WORD}')) AS word FROM files),
fp AS (SELECT DISTINCT id, lower(unnest(list_concat(regexp_split_to_array(word, '[_\\-.]+'), regexp_extract_all(regexp_replace(word, '([A-Z]+)([A-Z][a-z])', '\\1_\\2', 'g'), '{T.CAMEL}')))) AS piece FROM fw),
fa AS (SELECT id, piece FROM fp WHERE length(piece) > 2 AND piece NOT IN ({_STOP}) UNION SELECT id, doc_id::VARCHAR FROM files),
fc AS (SELECT id, piece, {T.cut_sql('piece')} AS cut FROM fa),
terms AS (SELECT DISTINCT id, {T.bucket_sql('piece', 'cut')} AS term FROM fc)"""


@query("p16_file_terms", f"WITH {_TERMS} SELECT id, term FROM terms")
def _(spark, d):
    return rank.file_terms(X.files(spark, d).select("id", "path", "text"))


# questions ------------------------------------------------------------------------------------------

_CONV = "c AS (SELECT conv_id, turn, text, regexp_replace(text, '[^\\x00-\\x7F]', 'x', 'g') AS plain FROM conversations)"


def _counts(expr: str, patterns) -> str:
    return "[" + ", ".join(f"len(regexp_extract_all({expr}, '(?i)\\b({p})\\b'))" for _, p in patterns) + "]"


def _best(counts: str, patterns, none: str) -> str:
    names = "[" + ", ".join(f"'{n}'" for n, _ in patterns) + "]"
    return f"CASE WHEN list_max({counts}) = 0 THEN '{none}' ELSE {names}[list_position({counts}, list_max({counts}))] END"


_KEYS = "k AS (SELECT conv_id, turn, text, plain, list_filter(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_/.\\\\-]+'), lambda w: length(w) > 2 AND lower(w) NOT IN ({})) AS raw FROM c), kw AS (SELECT conv_id, turn, text, plain, list_filter(raw, lambda w, i: list_position(list_transform(raw, lambda y: lower(y)), lower(w)) = i) AS words FROM k)".format(", ".join(f"'{w}'" for w in K.STOPWORDS))
_KINDS = f"n AS (SELECT *, {_counts('plain', K.TYPE_PATTERNS)} AS tc, {_counts('lower(plain || chr(32) || array_to_string(words, chr(32)))', K.DOMAIN_PATTERNS)} AS dc FROM kw), q AS (SELECT conv_id, turn, text, words, {_best('tc', K.TYPE_PATTERNS, 'ANALYSIS')} AS task_type, {_best('dc', K.DOMAIN_PATTERNS, '')} AS domain FROM n)"
_Q = f"WITH {_CONV}, {_KEYS}, {_KINDS} "


def questions(spark, d):
    c = X.table(spark, d, "conversations").select("conv_id", "turn", "text", K.task_type(F.col("text")).alias("task_type"), K.keywords(F.col("text")).alias("words"))
    return c.withColumn("domain", K.domain(F.col("text"), F.col("words")))


@query("g01_task_type", f"{_Q} SELECT conv_id, turn, task_type FROM q")
def _(spark, d):
    return questions(spark, d).select("conv_id", "turn", "task_type")


@query("g02_keywords", f"{_Q} SELECT conv_id, turn, array_to_string(words, ' ') AS keywords FROM q")
def _(spark, d):
    return questions(spark, d).select("conv_id", "turn", F.array_join("words", " ").alias("keywords"))


@query("g03_domain", f"{_Q} SELECT conv_id, turn, domain FROM q")
def _(spark, d):
    return questions(spark, d).select("conv_id", "turn", "domain")


@query("g04_scope", f"{_Q} SELECT conv_id, turn, array_to_string(list_filter(list_transform(words, lambda w: regexp_replace(replace(w, '\\', '/'), '\\.py|\\.js|\\.ts', '', 'g')), lambda w: contains(w, '/') OR contains(w, '.')), ' ') AS scope FROM q")
def _(spark, d):
    return questions(spark, d).select("conv_id", "turn", F.array_join(K.scope(F.col("words")), " ").alias("scope"))


@query("g05_confidence", f"{_Q} SELECT conv_id, turn, round(least(0.4::DOUBLE + CASE WHEN task_type <> 'ANALYSIS' THEN 0.25::DOUBLE ELSE 0.0::DOUBLE END + least(0.2::DOUBLE, len(words) * 0.04::DOUBLE) + CASE WHEN domain <> '' THEN 0.15::DOUBLE ELSE 0.0::DOUBLE END, 1.0::DOUBLE), 2) AS confidence FROM q")
def _(spark, d):
    q = questions(spark, d)
    return q.select("conv_id", "turn", K.confidence(F.col("task_type"), F.col("words"), F.col("domain")).alias("confidence"))


@query("g06_strategy", f"{_Q}, s(task_type, upstream, downstream, max_nodes) AS (VALUES {', '.join(f'({s[0]!r}, {s[1]}, {s[2]}, {s[6]})' for s in K.STRATEGIES)}) SELECT conv_id, turn, upstream, downstream, max_nodes FROM q JOIN s USING (task_type)")
def _(spark, d):
    table = spark.createDataFrame(list(K.STRATEGIES), "task_type string, upstream int, downstream int, configs boolean, concepts boolean, conflicts boolean, max_nodes int")
    return questions(spark, d).join(F.broadcast(table), "task_type").select("conv_id", "turn", "upstream", "downstream", "max_nodes")


# ranking --------------------------------------------------------------------------------------------

#: Questions asked of the corpus: id, kind, words.
ASKED = ((1, "BUG_FIX", ("nding", "error_handler", "blething")), (2, "DEBUG_TRACE", ("anerly", "onwh", "tionhea")), (3, "ANALYSIS", ("errewh",)), (4, "REFACTOR", ("letre", "ouan", "chen", "adota")))
BUDGET = 8000
_ASKED = f"asked(qid, kind, words) AS (VALUES {', '.join(f'({q}, {k!r}, {list(w)!r})' for q, k, w in ASKED)}), aw AS (SELECT DISTINCT qid, kind, unnest(regexp_split_to_array(w, '[_\\-\\s]+')) AS word FROM (SELECT qid, kind, unnest(words) AS w FROM asked)), ac AS (SELECT *, {T.cut_sql('word')} AS cut FROM aw), wanted AS (SELECT DISTINCT qid, kind, {T.bucket_sql('word', 'cut')} AS term FROM ac)"
_DF = "df AS (SELECT term, count(*) AS df FROM terms GROUP BY term), nf AS (SELECT greatest(count(DISTINCT id), 1) AS files FROM terms), idf AS (SELECT qid, w.term, ln((files + 1) / (coalesce(df, 0) + 1)) + 1 AS w FROM wanted w CROSS JOIN nf LEFT JOIN df ON df.term = w.term)"
_MATCH = "most AS (SELECT qid, sum(w) AS most FROM idf GROUP BY qid), found AS (SELECT qid, id, least(1.0::DOUBLE, sum(w) / any_value(most)) AS match FROM terms JOIN idf USING (term) JOIN most USING (qid) GROUP BY qid, id)"
_RANK = f"WITH {_TERMS}, {_ASKED}, {_DF}, {_MATCH}"


def asked(spark):
    return spark.createDataFrame([(q, k, list(w)) for q, k, w in ASKED], "qid int, kind string, terms array<string>")


@query("g11_document_frequency", f"WITH {_TERMS} SELECT term, count(*) AS df FROM terms GROUP BY term")
def _(spark, d):
    return rank.document_frequency(X.terms(spark, d))


@query("g12_idf", f"WITH {_TERMS}, n AS (SELECT count(DISTINCT id) AS files FROM terms) SELECT term, round(ln((any_value(files) + 1) / (count(*) + 1)) + 1, 6) AS idf FROM terms CROSS JOIN n GROUP BY term")
def _(spark, d):
    t = X.terms(spark, d)
    files = X.files(spark, d).agg(F.count(F.lit(1)).alias("files"))
    return rank.document_frequency(t).crossJoin(F.broadcast(files)).select("term", F.round(rank.idf(F.col("df"), F.col("files")), 6).alias("idf"))


@query("g13_text_match", f"{_RANK} SELECT qid, id, round(match, 6) AS match FROM found")
def _(spark, d):
    return rank.text_match(X.terms(spark, d), asked(spark), X.files(spark, d).select("id")).select("qid", "id", F.round("match", 6).alias("match"))


@query("g14_g15_weak_files", f"{W} SELECT path, regexp_matches(list_last(string_split(path, '/')), '^test_|_test(\\.py)?$') AS is_test, regexp_matches(list_last(string_split(path, '/')), '\\.(md|markdown|rst|txt|adoc)$') AS is_prose FROM files")
def _(spark, d):
    return X.files(spark, d).select("path", rank.is_test(F.col("path")).alias("is_test"), rank.is_prose(F.col("path")).alias("is_prose"))


_NAMES = f"np AS (SELECT 'part:' || p_partkey AS id, list_distinct(list_filter(regexp_split_to_array(p_name, '[.\\s_\\-]+'), lambda x: x <> '')) AS p FROM part), nw AS (SELECT id, unnest(p) AS word FROM np), nc AS (SELECT *, {T.cut_sql('word')} AS cut FROM nw), names AS (SELECT DISTINCT id, {T.bucket_sql('word', 'cut')} AS term FROM nc)"
_PART_Q = f"pq(qid, words) AS (VALUES (1, ['red', 'steel']), (2, ['Part']), (3, ['part', '000000017', 'nothing'])), pw AS (SELECT qid, unnest(words) AS word FROM pq), pc AS (SELECT *, {T.cut_sql('word')} AS cut FROM pw), pwanted AS (SELECT DISTINCT qid, {T.bucket_sql('word', 'cut')} AS term FROM pc)"


@query("g16_name_answers", f"WITH {_NAMES}, {_PART_Q}, freq AS (SELECT term, count(*) AS df FROM names GROUP BY term), n AS (SELECT count(*) AS files FROM part), a AS (SELECT qid, count(*) AS asked FROM pwanted GROUP BY qid), m AS (SELECT qid, id, count(*) AS k, min(coalesce(df, 0)) AS rarest FROM names JOIN pwanted USING (term) LEFT JOIN freq USING (term) GROUP BY qid, id) SELECT qid, id FROM m JOIN a USING (qid) CROSS JOIN n WHERE asked = 1 OR k >= 2 OR k = asked OR rarest * 4 <= files")
def _(spark, d):
    part = X.table(spark, d, "part").select(F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_name").alias("name"))
    stems = part.select("id", F.explode(F.array_distinct(F.transform(T.name_parts(F.col("name")), T.stem))).alias("term"))
    q = spark.createDataFrame([(1, ["red", "steel"]), (2, ["Part"]), (3, ["part", "000000017", "nothing"])], "qid int, terms array<string>")
    return rank.name_answers(part, rank.document_frequency(stems), q, part.count())


@query("g17_exact_symbols", f"WITH {_NAMES.replace('part:', 'customer:').replace('p_partkey', 'c_custkey').replace('p_name', 'c_name').replace('FROM part)', 'FROM customer)')}, k AS (SELECT string_agg(term, ' ' ORDER BY term) AS key FROM names GROUP BY id), w(qid, key) AS (SELECT * FROM (VALUES (1, (SELECT min(key) FROM k)), (2, 'none such'))) SELECT qid FROM w WHERE key IN (SELECT key FROM k)")
def _(spark, d):
    nodes = X.table(spark, d, "customer").select(F.lit("CLASS").alias("type"), F.col("c_name").alias("name"))
    first = nodes.agg(F.min("name").alias("n")).first().n or ""  # the question is a name
    q = spark.createDataFrame([(1, [first.replace("#", "#")]), (2, ["none", "such"])], "qid int, terms array<string>")
    return rank.exact_symbols(nodes, q)


_SCORE = f"""deg AS (SELECT id, 1 - (doc_id = (SELECT max(doc_id) FROM documents))::INTEGER AS o, 1 - (doc_id = (SELECT min(doc_id) FROM documents))::INTEGER AS i, path FROM files),
tw(kind, w) AS (VALUES ('BUG_FIX', 1.5::DOUBLE), ('DEBUG_TRACE', 1.5::DOUBLE), ('ANALYSIS', 1.0::DOUBLE), ('REFACTOR', 1.5::DOUBLE)),
weak AS (SELECT id, path, o, i, regexp_matches(path, '\\.(md|txt)$') AS weak FROM deg),
scored AS (SELECT qid, id, path, round(15.0::DOUBLE * match * CASE WHEN weak THEN 0.3::DOUBLE ELSE 1.0::DOUBLE END + (1.5::DOUBLE * 0.95::DOUBLE + 0.5::DOUBLE * least(ln(1 + o), 6.0::DOUBLE) + 0.6::DOUBLE * least(ln(1 + i), 6.0::DOUBLE)) * CASE WHEN weak THEN 0.25::DOUBLE ELSE 1.0::DOUBLE END * w + 1.5::DOUBLE, 3) AS score
  FROM found JOIN asked USING (qid) JOIN tw USING (kind) JOIN weak USING (id)),
top AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM scored QUALIFY rank <= {rank.most_nodes(BUDGET)})"""


def scored(spark, d):
    """Files found for each question, scored; documents import the next one."""
    files = X.files(spark, d)
    bounds = files.agg(F.min("doc_id").alias("_lo"), F.max("doc_id").alias("_hi"))
    ends = files.select("id", "path", "doc_id").crossJoin(F.broadcast(bounds))
    ends = ends.select("id", "path", (F.col("doc_id") != F.col("_hi")).cast("int").alias("o"), (F.col("doc_id") != F.col("_lo")).cast("int").alias("i"))
    found = rank.text_match(X.terms(spark, d), asked(spark), X.files(spark, d).select("id")).join(F.broadcast(asked(spark).select("qid", "kind")), "qid").join(ends, "id")
    value = rank.score(F.col("path"), F.lit("FILE"), F.lit(0.95), F.col("o"), F.col("i"), F.col("match"), F.col("kind"))
    return found.select("qid", "id", "path", value.alias("score"))


@query("g19_score", f"{_RANK}, {_SCORE} SELECT qid, id, score FROM scored")
def _(spark, d):
    return scored(spark, d).select("qid", "id", "score")


@query("g21_topk", f"{_RANK}, {_SCORE} SELECT qid, id, score, rank::INTEGER AS rank FROM top")
def _(spark, d):
    return rank.top_k(scored(spark, d), rank.most_nodes(BUDGET)).select("qid", "id", "score", "rank")


@query("g22_files", f"{_RANK}, {_SCORE} SELECT DISTINCT qid, list_last(string_split(path, '/')) AS file FROM top")
def _(spark, d):
    return rank.top_k(scored(spark, d), rank.most_nodes(BUDGET)).select("qid", rank.base_name(F.col("path")).alias("file")).distinct()


@query("g23_risk_summary", "SELECT count(*) AS n, count(*) FILTER (o_orderpriority = '1-URGENT') AS high, count(*) FILTER (o_orderpriority = '2-HIGH') AS medium, round(least((3 * count(*) FILTER (o_orderpriority = '1-URGENT') + count(*) FILTER (o_orderpriority = '2-HIGH')) / greatest(count(*), 1), 5.0::DOUBLE), 2) AS score FROM orders")
def _(spark, d):
    p = F.col("o_orderpriority")
    return rank.risk_summary(X.table(spark, d, "orders"), F.when(p == "1-URGENT", "high").when(p == "2-HIGH", "medium").otherwise("low"))


@query("g25_tokens", "SELECT doc_id, greatest(1, length(text) // 4)::BIGINT AS tokens FROM documents")
def _(spark, d):
    return X.table(spark, d, "documents").select("doc_id", rank.tokens(F.col("text")).alias("tokens"))


_COST = "cost AS (SELECT t.*, greatest(1, length(text) // 4)::BIGINT AS cost, rank <= 2 AS is_seed FROM top t JOIN files USING (id))"


def costed(spark, d):
    top = rank.top_k(scored(spark, d), rank.most_nodes(BUDGET))
    sizes = X.files(spark, d).select("id", rank.tokens(F.col("text")).alias("cost"))
    return sizes.join(F.broadcast(top), "id").withColumn("is_seed", F.col("rank") <= 2)  # a top-k of each question


@query("g26_budget_cut", f"{_RANK}, {_SCORE}, {_COST}, u AS (SELECT *, sum(cost) OVER (PARTITION BY qid ORDER BY rank)::BIGINT AS used FROM cost), x AS (SELECT *, min(CASE WHEN NOT is_seed AND used > {BUDGET} THEN rank END) OVER (PARTITION BY qid) AS cut FROM u) SELECT qid, id, rank::INTEGER AS rank, used FROM x WHERE cut IS NULL OR rank < cut")
def _(spark, d):
    return rank.budget_cut(costed(spark, d), BUDGET).select("qid", "id", "rank", "used")


@query("g29_first_fit", f"{_RANK.replace('WITH files', 'WITH RECURSIVE files')}, {_SCORE}, {_COST}, fit AS (SELECT qid, 0::BIGINT AS r, 0::BIGINT AS used, NULL::VARCHAR AS id FROM asked UNION ALL SELECT f.qid, c.rank, CASE WHEN f.used + c.cost <= {BUDGET} THEN f.used + c.cost ELSE f.used END, CASE WHEN f.used + c.cost <= {BUDGET} THEN c.id END FROM fit f JOIN cost c ON c.qid = f.qid AND c.rank = f.r + 1) SELECT qid, id FROM fit WHERE id IS NOT NULL")
def _(spark, d):
    return rank.first_fit(costed(spark, d), BUDGET)


_PACK = f"{_RANK}, {_SCORE}, n AS (SELECT *, greatest(1, length(id || ' ' || list_last(string_split(path, '/')) || ' FILE') // 4)::BIGINT AS cost FROM top), u AS (SELECT *, sum(cost) OVER (PARTITION BY qid ORDER BY rank)::BIGINT AS used FROM n)"


@query("g32_context_pack", f"{_PACK} SELECT qid, id, path, rank::INTEGER AS rank, score, used FROM u WHERE used <= {BUDGET}")
def context_pack(spark, d):
    """Questions answered end to end: terms, document frequencies, scores, the best, the cut to the budget."""
    top = rank.top_k(scored(spark, d), rank.most_nodes(BUDGET))
    cost = rank.tokens(F.concat(F.col("id"), F.lit(" "), rank.base_name(F.col("path")), F.lit(" FILE")))
    cut = rank.budget_cut(top.withColumn("cost", cost).withColumn("is_seed", F.lit(False)), BUDGET)
    return cut.select("qid", "id", "path", "rank", "score", "used")


@query("g18_type_weights", f"WITH {X.GRAPH_SQL} SELECT kind, type, coalesce(w, 1.0::DOUBLE) AS weight, count(*) AS n FROM (VALUES ('BUG_FIX'), ('REFACTOR'), ('ANALYSIS'), ('OPTIMIZATION')) AS k(kind) CROSS JOIN nodes LEFT JOIN (VALUES " + ", ".join(f"('{k}', '{t}', {w}::DOUBLE)" for k, t, w in rank.TYPE_WEIGHTS) + ") AS w(kind, type, w) USING (kind, type) GROUP BY 1, 2, 3")
def _(spark, d):
    kinds = F.explode(F.array(*[F.lit(k) for k in ("BUG_FIX", "REFACTOR", "ANALYSIS", "OPTIMIZATION")])).alias("kind")
    pairs = X.nodes(spark, d).select(kinds, "type")
    return pairs.groupBy("kind", "type", rank.weight_of_type(F.col("kind"), F.col("type")).alias("weight")).agg(F.count(F.lit(1)).alias("n"))


@query("g27_required_files", f"{_RANK}, {_SCORE}, own AS (SELECT DISTINCT split_part(path, '/', 1) AS file FROM files) SELECT file FROM own WHERE EXISTS (SELECT 1 FROM top WHERE contains(top.path, file))")
def _(spark, d):
    top = rank.top_k(scored(spark, d), rank.most_nodes(BUDGET))
    return rank.required_files(X.files(spark, d).select(F.split_part("path", F.lit("/"), F.lit(1)).alias("file")).distinct(), top)


_EACH = 2400
_SNIPPETS = f"t AS (SELECT qid, rank, id, left(text, {_EACH + 1}) AS text FROM top JOIN files USING (id)), w AS (SELECT qid, 0::BIGINT AS r, {int(BUDGET * 0.7) * 4}::BIGINT AS room, NULL::VARCHAR AS id, NULL::VARCHAR AS snippet FROM asked UNION ALL SELECT w.qid, t.rank, CASE WHEN room <= 200 THEN room WHEN length(text) > least(room, {_EACH}) THEN room - length(regexp_replace(left(text, least(room, {_EACH})), '\\n[^\\n]*$', '')) ELSE room - length(text) END, CASE WHEN room > 200 THEN t.id END, CASE WHEN room <= 200 THEN NULL WHEN length(text) > least(room, {_EACH}) THEN regexp_replace(left(text, least(room, {_EACH})), '\\n[^\\n]*$', '') || chr(10) || '...' ELSE text END FROM w JOIN t ON t.qid = w.qid AND t.rank = w.r + 1)"


def packed_snippets(spark, d):
    top = rank.top_k(scored(spark, d), rank.most_nodes(BUDGET))
    texts = X.files(spark, d).select("id", "text").join(F.broadcast(top.select("qid", "id", "rank")), "id")
    return rank.snippets(texts, BUDGET, each=_EACH)


@query("g30_snippets", f"{_RANK.replace('WITH files', 'WITH RECURSIVE files')}, {_SCORE}, {_SNIPPETS} SELECT qid, id, r::INTEGER AS rank, snippet FROM w WHERE id IS NOT NULL")
def _(spark, d):
    return packed_snippets(spark, d)


@query("g33_render", f"{_RANK.replace('WITH files', 'WITH RECURSIVE files')}, {_SCORE}, {_SNIPPETS}, p AS (SELECT qid, r, '## ' || id || chr(10) || array_to_string((regexp_split_to_array(snippet, '\\r\\n|\\r|\\n'))[1:40], chr(10)) AS part FROM w WHERE id IS NOT NULL), u AS (SELECT *, sum(length(part)) OVER (PARTITION BY qid ORDER BY r) AS used FROM p) SELECT qid, string_agg(part, chr(10) ORDER BY r) AS text FROM u WHERE used <= 24000 GROUP BY qid")
def _(spark, d):
    return rank.render(packed_snippets(spark, d))


@query("s18_stamps", f"{W} SELECT path, CASE WHEN doc_id % 9 = 0 THEN 'added' WHEN doc_id % 5 = 0 THEN 'deleted' ELSE 'unchanged' END AS change FROM files")
def _(spark, d):
    return scan.changes(*snapshots(spark, d), by=("size_bytes",))


@query("s19_explorer", f"{W}, p AS (SELECT string_split(path, '/') AS p FROM files), s AS (SELECT p, unnest(range(1, len(p) + 1)) AS n FROM p) SELECT DISTINCT CASE WHEN n = 1 THEN '.' ELSE array_to_string(p[1:n-1], '/') END AS parent, p[n] AS child FROM s WHERE n <= 12 ORDER BY parent, child LIMIT 5000")
def _(spark, d):
    return scan.explorer(X.files(spark, d))


@query("p09_calls", f"WITH {_MODULE} SELECT path, 'helper' AS call FROM m")
def _(spark, d):
    return parse.with_parsed(modules(spark, d)).select("path", F.explode("parsed.calls").alias("call"))


@query("p02_decorators", f"WITH {_MODULE} SELECT path AS file_path, 'f_' || n AS name, 'b,c' AS decorators FROM m")
def _(spark, d):
    p = X.table(spark, d, "part")
    name = F.regexp_replace("p_name", "[^A-Za-z0-9]+", "_")
    text = F.concat(F.lit("@a.b\n@c(1)\ndef f_"), name, F.lit("():\n    pass\n"))
    files = p.select(F.concat(F.col("p_partkey").cast("string"), F.lit(".py")).alias("path"), text.alias("text"))
    return parse.symbols(parse.with_parsed(files)).select("file_path", "name", F.array_join("decorators", ",").alias("decorators"))


@query("p11_toml_keys", "SELECT p_partkey || '.toml' AS path, unnest(['name', 'more', 'more.size', 'more.kind', 'more.kind.brand']) AS key FROM part")
def _(spark, d):
    p = X.table(spark, d, "part")
    text = F.concat(F.lit("name = '"), F.col("p_name"), F.lit("'\n[more]\nsize = "), F.col("p_size").cast("string"), F.lit("\n[more.kind]\nbrand = \""), F.col("p_brand"), F.lit("\"\n"))
    files = p.select(F.concat(F.col("p_partkey").cast("string"), F.lit(".toml")).alias("path"), F.lit(".toml").alias("extension"), text.alias("text"))
    return parse.structured_keys(files).select("path", F.explode("keys").alias("key"))


_LINES_OF = "(length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(10), '')) + CASE WHEN length(coalesce(text, '')) > 0 AND right(text, 1) <> chr(10) THEN 1 ELSE 0 END)"


@query("p12_generic_elements", f"{W} SELECT sha256(sha256(lower(path)) || ':text:' || path || ':1') AS element_id, path, greatest(1, {_LINES_OF})::BIGINT AS line_end, CASE WHEN doc_id % 3 = 0 THEN '' ELSE left(coalesce(text, ''), 500) END AS text, CASE WHEN doc_id % 3 = 0 THEN 'binary' ELSE 'generic' END AS parser, CASE WHEN doc_id % 3 = 0 THEN 0.2::DOUBLE ELSE 0.35::DOUBLE END AS confidence FROM files")
def _(spark, d):
    f = X.files(spark, d).withColumn("text", F.coalesce("text", F.lit("")))
    f = f.withColumns({"lines_count": scan.lines_count(F.col("text")), "is_binary": F.col("doc_id") % 3 == 0})
    return parse.generic_elements(f).select("element_id", "path", "line_end", "text", "parser", "confidence")


@query("p13_capped_text", "SELECT doc_id, CASE WHEN octet_length(encode(text)) > 2048 THEN '' ELSE text END AS text FROM documents")
def _(spark, d):
    docs = X.table(spark, d, "documents")
    return docs.select("doc_id", parse.capped_text(F.col("text"), F.octet_length("text"), 2).alias("text"))


@query("c04_relativize", f"{W} SELECT path, CASE WHEN starts_with('/' || path, '/src1/') THEN substr(path, 6) ELSE '/' || path END AS relative FROM files")
def _(spark, d):
    return X.files(spark, d).select("path", resolve.relativize(F.concat(F.lit("/"), "path"), "/src1").alias("relative"))
