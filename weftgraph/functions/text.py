"""Words, stems and terms as column expressions, and the same as SQL text for other engines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Suffixes in the order in which they are tried, words that are never cut, the length of
# a stem, and words that are no evidence in source text.
SUFFIXES = (
    "izations", "ization", "ically", "iveness", "fulness", "ousness", "ements", "ement", "ances", "ance", "ingly", "edly",
    "ings", "ing", "ies", "ied", "ers", "er", "est", "es", "ly", "ed", "s",
)
KEPT = (
    "bus", "gas", "less", "loss", "cross", "class", "pass", "press", "process", "address", "access", "status", "focus", "bonus", "virus",
    "analysis", "basis", "thesis", "crisis", "this", "is", "was", "has", "its", "as", "us", "does", "yes", "plus", "thus", "unless",
    "cases", "uses", "comes", "goes", "makes", "takes", "gives",
)
STEM_LENGTH = 6
SOURCE_STOPWORDS = (
    "the", "and", "for", "with", "this", "that", "from", "into", "def", "class", "self", "none", "true", "false", "return", "import",
    "as", "if", "else", "elif", "while", "in", "not", "or", "is", "are", "was", "were", "be", "been", "has", "have", "had", "do", "does",
    "did", "can", "could", "should", "would", "may", "might", "must", "will", "list", "dict", "str", "int", "float", "bool", "set",
    "tuple", "type", "value", "name", "path", "file", "data", "result", "results", "node", "nodes", "item", "items", "key", "keys",
    "index", "get", "add", "new",
)
LIGHT_STOPWORDS = ("a", "an", "the", "is", "are", "in", "of", "to", "and", "or", "it", "this")

_LEAST = 4  # characters that a suffix must leave


def _quoted(words: tuple[str, ...]) -> str:
    return ", ".join(f"'{w}'" for w in words)


def cut_sql(word: str) -> str:
    """SQL of a word in lower case without its suffix, in functions that Spark and other engines share."""
    low = f"lower({word})"
    cases = " ".join(f"WHEN {low} LIKE '%{s}' AND length({low}) >= {len(s) + _LEAST} THEN substr({low}, 1, length({low}) - {len(s)})" for s in SUFFIXES)
    return f"CASE WHEN {low} IN ({_quoted(KEPT)}) THEN {low} {cases} ELSE {low} END"


def bucket_sql(word: str, cut: str) -> str:
    """SQL of a word's stem from its cut form: one of a doubled last letter goes, and the rest is cut to a stem's length."""
    last = f"substr({cut}, length({cut}), 1)"
    doubled = f"length({cut}) >= {_LEAST} AND {last} = substr({cut}, length({cut}) - 1, 1) AND {last} NOT IN ({_quoted(tuple('aeiousl'))})"
    return f"CASE WHEN lower({word}) IN ({_quoted(KEPT)}) THEN lower({word}) ELSE substr(CASE WHEN {doubled} THEN substr({cut}, 1, length({cut}) - 1) ELSE {cut} END, 1, {STEM_LENGTH}) END"


def _stripped(low: Column) -> Column:
    out = None
    for s in SUFFIXES:
        hit = low.endswith(s) & (F.length(low) >= len(s) + _LEAST)
        cut = F.left(low, F.length(low) - len(s))
        out = F.when(hit, cut) if out is None else out.when(hit, cut)
    return out.otherwise(low)


def _bucket(cut: Column) -> Column:
    last = F.right(cut, F.lit(1))
    doubled = (F.length(cut) >= _LEAST) & (last == F.substr(cut, F.length(cut) - 1, F.lit(1))) & ~last.isin(*"aeiousl")
    return F.left(F.when(doubled, F.left(cut, F.length(cut) - 1)).otherwise(cut), F.lit(STEM_LENGTH))


def stem(word: Column) -> Column:
    """Lower case, kept if on the list; else without the first suffix that leaves four characters,
    without a doubled last letter, cut to six. The suffix is taken off in a lambda of its own, so that
    the long expression is evaluated once."""
    low = F.lower(word)
    cut = F.element_at(F.transform(F.array(_stripped(low)), _bucket), 1)
    return F.when(low.isin(*KEPT), low).otherwise(cut)


def light_stem(word: Column) -> Column:
    """The lighter stemmer of keyword search; empty where a word has no other form."""
    n = F.length(word)

    def base_of(k: int) -> Column:
        def undouble(base: Column) -> Column:
            last = F.right(base, F.lit(1))
            doubled = (F.length(base) > 3) & (last == F.substr(base, F.length(base) - 1, F.lit(1))) & ~last.isin(*"aeiou")
            return F.when(F.length(base) < 3, "").when(doubled, F.left(base, F.length(base) - 1)).otherwise(base)

        return F.element_at(F.transform(F.array(F.left(word, n - k)), undouble), 1)

    return (
        F.when((n <= 4) | word.isin(*LIGHT_STOPWORDS), "")
        .when(word.endswith("ing"), base_of(3)).when(word.endswith("ed"), base_of(2))
        .when(word.endswith("ies"), F.concat(F.left(word, n - 3), F.lit("y")))
        .when(word.endswith("sses") | word.endswith("shes") | word.endswith("ches"), F.left(word, n - 2))
        .when(word.endswith("s") & ~word.endswith("ss"), F.left(word, n - 1)).otherwise("")
    )


WORD = "[A-Za-z_][A-Za-z0-9_]{2,}"
CAMEL = "[A-Z][a-z]+|[A-Z]+|[a-z]+"


def words(text: Column) -> Column:
    """Different identifiers and words of a text."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1)))


def pieces(word: Column) -> Column:
    """Lower-case parts of an identifier by underscores and by case, longer than two and no stopwords."""
    cased = F.regexp_extract_all(F.regexp_replace(word, "([A-Z]+)([A-Z][a-z])", "$1_$2"), F.lit(f"({CAMEL})"), F.lit(1))
    parts = F.transform(F.concat(F.split(word, r"[_\-.]+"), cased), lambda x: F.lower(x))
    return F.array_distinct(F.filter(parts, lambda x: (F.length(x) > 2) & ~x.isin(*SOURCE_STOPWORDS)))


_SMALL, _CAPITAL = "^[a-z]+$", "^(?:[A-Z][a-z]+|[A-Z]+)$"
_BY_LETTER = "|".join(f"{c}(?:{'|'.join(s[1:] for s in SUFFIXES if s[0] == c)})" for c in sorted({s[0] for s in SUFFIXES}))
_CUT = f"(?<=[a-z0-9]{{{_LEAST}}})(?:{_BY_LETTER})(?![a-z0-9])"  # of suffixes in each other the longer one is met first
_DOUBLED = f"(?<=[a-z0-9]{{{_LEAST - 2}}})([^aeiousl ])\\1(?![a-z0-9])"


def stems(words: Column) -> Column:
    """Different stems of the parts of an array of identifiers, as `stem` of `pieces` has them.

    Words of small letters, with a capital first or of capitals are one piece. Pieces are letters and digits, so they
    are cut as one string with blanks between them, in three passes. Arrays that are used twice are handed to
    lambdas, so that they are made once."""
    bound = lambda x, f: F.element_at(F.transform(F.array(x), f), 1)
    small, capital = lambda w: w.rlike(_SMALL), lambda w: w.rlike(_CAPITAL)

    def parts(found: Column) -> Column:
        rest = F.filter(found, lambda w: ~small(w))
        low = F.split(F.lower(F.array_join(F.filter(rest, capital), " ")), " ")
        mixed = F.flatten(F.transform(F.filter(rest, lambda w: ~capital(w)), pieces))
        every = F.array_distinct(F.concat(F.filter(found, small), low, mixed))
        return F.filter(every, lambda x: (F.length(x) > 2) & ~x.isin(*SOURCE_STOPWORDS))

    def cut(found: Column) -> Column:
        rest = F.array_join(F.filter(found, lambda x: ~x.isin(*KEPT)), " ")
        rest = F.regexp_replace(F.regexp_replace(rest, _CUT, ""), _DOUBLED, "$1")
        rest = F.regexp_extract_all(rest, F.lit(f"(?<![a-z0-9])([a-z0-9]{{1,{STEM_LENGTH}}})"), F.lit(1))
        return F.array_distinct(F.concat(F.filter(found, lambda x: x.isin(*KEPT)), rest))

    return bound(bound(words, parts), cut)


def name_parts(name: Column) -> Column:
    """Parts of a name by dots, underscores, hyphens and spaces."""
    return F.array_distinct(F.filter(F.split(name, r"[.\s_\-]+"), lambda x: x != ""))
