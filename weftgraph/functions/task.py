"""Questions: their type, keywords, domain, scope and confidence, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns of task types and domains in the order in which ties are decided, stopwords
# of questions, and each type's strategy (upstream, downstream, configs, concepts, conflicts, nodes).
TYPE_PATTERNS = (
    ("BUG_FIX", "fix|bug|crash|error|exception|fail|broken|issue|defect|regression|traceback"),
    ("FEATURE_ADDITION", "add|create|implement|build|new|feature|support|introduce|generate"),
    ("REFACTOR", "refactor|restructure|reorganize|clean|simplify|extract|move|rename|consolidate"),
    ("OPTIMIZATION", "optimi[sz]e|speed|performance|fast|slow|memory|cache|throughput|latency|scale"),
    ("DEBUG_TRACE", "debug|trace|investigate|why|root cause|propagat|where does|how does"),
    ("ARCHITECTURE_REVIEW", "architect|design|layer|boundary|structure|review|assess|evaluate|audit"),
    ("ANALYSIS", "analy[sz]e|understand|explain|what|describe|overview|summari[sz]e|map"),
)
DOMAIN_PATTERNS = (
    ("authentication", "auth|login|password|token|session|jwt|oauth|credential|user"),
    ("data", "storage|database|persist|schema|migration|repo|model"),
    ("api", "api|endpoint|route|controller|handler|request|response"),
    ("knowledge", "scan|parse|reader|index|graph|knowledge|semantic"),
    ("presentation", "dashboard|frontend|view|template|ui|render"),
    ("configuration", "config|setting|env|constant|flag"),
    ("filesystem", "scan|file|repo|repository|directory|tree"),
)
STOPWORDS = (
    "the", "a", "an", "is", "are", "was", "were", "be", "been", "being", "this", "that", "these", "those", "i", "we", "you", "they", "it",
    "to", "of", "in", "on", "at", "for", "with", "by", "from", "and", "or", "but", "not", "if", "then", "so", "as", "do", "does", "did",
    "will", "would", "should", "could", "may", "might", "my", "our", "your", "their", "its", "his", "her", "what", "which", "who", "whom",
    "whose", "where", "why", "how", "there", "here", "when", "while", "during", "work", "works", "working", "worked", "used", "using",
    "uses", "get", "gets", "make", "makes", "made", "take", "takes", "file", "files", "code", "thing", "things", "stuff", "done", "via",
    "per", "etc", "one", "two",
)
STRATEGIES = (
    ("BUG_FIX", 2, 1, True, True, True, 25),
    ("FEATURE_ADDITION", 1, 2, True, True, True, 30),
    ("REFACTOR", 3, 3, False, True, True, 40),
    ("DEBUG_TRACE", 4, 2, True, False, True, 35),
    ("OPTIMIZATION", 1, 1, False, False, False, 20),
    ("ARCHITECTURE_REVIEW", 2, 2, True, True, True, 50),
    ("ANALYSIS", 2, 2, True, True, True, 35),
)
STRATEGY = "task_type string, upstream int, downstream int, configs boolean, concepts boolean, conflicts boolean, max_nodes int"
KEYWORD = r"[A-Za-z_][A-Za-z0-9_/.\\-]+"


def _best(text: Column, patterns: tuple[tuple[str, str], ...], none: str) -> Column:
    """The name with the most whole-word matches; of equal ones the first."""
    counts = F.array(*[F.regexp_count(text, F.lit(rf"(?i)\b({p})\b")) for _, p in patterns])

    def pick(c: Column) -> Column:
        most = F.array_max(c)
        return F.when(most == 0, none).otherwise(F.element_at(F.array(*[F.lit(n) for n, _ in patterns]), F.array_position(c, most).cast("int")))

    return F.element_at(F.transform(F.array(counts), pick), 1)


def task_type(text: Column) -> Column:
    return _best(text, TYPE_PATTERNS, "ANALYSIS")


def keywords(text: Column) -> Column:
    """Words in order without stopwords, short ones, and repeats in other case."""
    found = F.filter(F.regexp_extract_all(text, F.lit(f"({KEYWORD})"), F.lit(1)), lambda w: (F.length(w) > 2) & ~F.lower(w).isin(*STOPWORDS))
    # the first of each lower-case form
    return F.element_at(F.transform(F.array(found), lambda all_: F.transform(F.array_distinct(F.transform(all_, lambda w: F.lower(w))), lambda low: F.element_at(F.filter(all_, lambda w: F.lower(w) == low), 1))), 1)


def domain(text: Column, words: Column) -> Column:
    """Keywords count once more than the text they stand in."""
    return _best(F.lower(F.concat_ws(" ", text, F.array_join(words, " "))), DOMAIN_PATTERNS, "")


def scope(words: Column) -> Column:
    """Keywords that look like paths, without the endings of scripts."""
    bare = F.transform(words, lambda w: F.regexp_replace(F.regexp_replace(w, r"\\", "/"), r"\.py|\.js|\.ts", ""))
    return F.filter(bare, lambda w: w.contains("/") | w.contains("."))


def confidence(kind: Column, words: Column, field: Column) -> Column:
    sure = F.lit(0.4) + F.when(kind != "ANALYSIS", 0.25).otherwise(0.0)
    sure = sure + F.least(F.lit(0.2), F.size(words) * F.lit(0.04)) + F.when(field != "", 0.15).otherwise(0.0)
    return F.round(F.least(sure, F.lit(1.0)), 2)


def with_strategy(questions: DataFrame, kind: str = "kind") -> DataFrame:
    """Adds the strategy of each question's type; the table has a row for each type."""
    table = questions.sparkSession.createDataFrame(list(STRATEGIES), STRATEGY).withColumnRenamed("task_type", kind)
    return questions.join(F.broadcast(table), kind)
