"""Text functions as columns: tokens, identifier words, query preprocessing, occurrence counts."""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: A token of the search index: letters, digits and underscore of any script.
TOKEN = r"[\p{L}\p{N}_]+"

# Abbreviations of code identifiers and the words that stand for them.
ABBREVIATIONS = {
    "btn": "button",
    "cfg": "config configuration",
    "ctx": "context",
    "db": "database",
    "fn": "function",
    "func": "function",
    "impl": "implementation implement",
    "mgr": "manager",
    "obj": "object",
    "param": "parameter",
    "proc": "process processor",
    "repo": "repository",
    "req": "request require",
    "res": "response result",
    "str": "string",
    "temp": "temporary template",
    "util": "utility utilities",
    "val": "value",
    "var": "variable",
    "auth": "authentication authorize",
    "admin": "administrator administration",
    "api": "application programming interface",
    "ui": "user interface",
    "url": "uniform resource locator link",
    "http": "hypertext transfer protocol",
    "json": "javascript object notation",
    "xml": "extensible markup language",
    "sql": "structured query language",
    "css": "cascading style sheets",
    "html": "hypertext markup language",
    "js": "javascript",
    "py": "python",
    "ts": "typescript",
    "async": "asynchronous",
    "sync": "synchronous",
}

# Suffix rules of the stemmer; the first that leaves two characters or more applies.
STEM_RULES = [("ies", "y"), ("ied", "y"), ("ying", "y"), ("ing", ""), ("ed", ""), ("er", ""), ("est", ""), ("s", "")]

# Stop words.
STOP_WORDS = [
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "is", "are",
    "was", "were", "be", "been", "have", "has", "had", "do", "does", "did", "will", "would", "this", "that",
    "these", "those", "i", "you", "he", "she", "it", "we", "they", "me", "him", "her", "us", "them",
]


def tokens(text: Column) -> Column:
    """Lower-cased tokens in order; null has none."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0)), F.array().cast("array<string>"))


def token_count(text: Column) -> Column:
    """How many tokens a text has, without making them."""
    return F.coalesce(F.regexp_count(F.lower(text), F.lit(TOKEN)), F.lit(0)).cast("long")


def quoted(name: Column) -> Column:
    """name as a literal inside a regular expression."""
    return F.concat(F.lit(r"\Q"), F.replace(name, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def occurrences(text: Column, name: Column) -> Column:
    """How often name stands in text with no ASCII letter, digit or underscore on either side."""
    return F.when(F.length(name) > 0, F.regexp_count(text, F.concat(F.lit("(?<![a-zA-Z0-9_])"), quoted(name), F.lit("(?![a-zA-Z0-9_])")))).otherwise(0).cast("long")


def substring_count(text: Column, part: Column) -> Column:
    """Non-overlapping occurrences of part in text; none of an empty part."""
    n = (F.length(text) - F.length(F.replace(text, part, F.lit("")))) / F.length(part)
    return F.when(F.length(part) > 0, n).otherwise(0).cast("long")


def camel_words(word: Column) -> Column:
    return F.split(F.lower(F.regexp_replace(word, "([a-z])([A-Z])", "$1 $2")), " ")


def snake_words(word: Column) -> Column:
    return F.filter(F.split(F.lower(word), r"[_\-]+"), lambda w: w != "")


def stem(word: Column) -> Column:
    """The word by the first suffix rule that applies and leaves two characters; words of three or fewer stay."""
    out = word
    for suffix, ending in reversed(STEM_RULES):
        cut = F.concat(F.substring(word, F.lit(1), F.length(word) - len(suffix)), F.lit(ending))
        out = F.when(word.endswith(suffix) & (F.length(cut) >= 2), cut).otherwise(out)
    return F.when(F.length(word) <= 3, word).otherwise(out)


def abbreviation_words(word: Column) -> Column:
    """The words an abbreviation stands for, then the word itself."""
    table = F.create_map(*[F.lit(x) for pair in ABBREVIATIONS.items() for x in pair])
    found = F.element_at(table, word)
    return F.when(found.isNull(), F.array(word)).otherwise(F.concat(F.split(found, " "), F.array(word)))


@F.pandas_udf(StringType())
def nfkd(text: pd.Series) -> pd.Series:
    """Unicode compatibility decomposition, for which there is no built-in."""
    return text.map(lambda t: unicodedata.normalize("NFKD", t), na_action="ignore")


def preprocess(query: Column, expand_case: bool = True, expand_abbreviations: bool = True, stemming: bool = True, stop_words: bool = False, min_length: int = 2, normalise: bool = False, lowercase_first: bool = True) -> Column:
    """The words of a query, joined by spaces: parts of identifiers, abbreviations spelt out, stems, each once.

    lowercase_first keeps camel case together, as lower-casing comes before the split; False splits it.
    """
    text = nfkd(query) if normalise else query
    text = F.regexp_replace(text, r"[^\p{L}\p{N}_\s]", " ")
    words = F.regexp_extract_all(F.lower(text) if lowercase_first else text, F.lit(TOKEN), F.lit(0))
    words = F.filter(words, lambda w: F.length(w) >= min_length)

    def parts(word: Column) -> Column:
        low = F.lower(word)
        found = []
        if not lowercase_first:
            found.append(F.when(F.substring(word, 2, 2**31 - 1).rlike("[A-Z]"), camel_words(word)).otherwise(F.array().cast("array<string>")))
        found.append(F.when(low.contains("_"), snake_words(low)).otherwise(F.array().cast("array<string>")))
        return F.when(low.rlike(r"^\d+$"), F.array(low)).otherwise(F.concat(*found, F.array(low)))

    if expand_case:
        words = F.flatten(F.transform(words, parts))
    words = F.array_distinct(F.filter(words, lambda w: F.length(w) >= min_length))
    if expand_abbreviations:
        words = F.flatten(F.transform(words, abbreviation_words))
    if stemming:
        words = F.transform(words, stem)
    if stop_words:
        words = F.filter(words, lambda w: ~w.isin(STOP_WORDS))
    return F.array_join(F.array_distinct(F.filter(words, lambda w: F.length(w) >= min_length)), " ")


def query_variations(query: Column, **options) -> Column:
    """The query itself and three ways to preprocess it; no empties, each once."""
    made = [query, preprocess(query, stemming=False, **options), preprocess(query, expand_abbreviations=False, **options), preprocess(query, expand_case=False, **options)]
    return F.array_distinct(F.filter(F.array(*made), lambda v: v.isNotNull() & (v != "")))


def line_variations(text: Column, indent: str = "    ") -> Column:
    """Each line and, if it isn't indented already, the line with an indent; blank lines once."""
    return F.flatten(F.transform(F.split(text, "\n"), lambda x: F.when(F.trim(x) == "", F.array(x)).otherwise(F.array_distinct(F.array(x, F.concat(F.lit(indent), F.ltrim(x)))))))


def newlines(raw: Column) -> Column:
    """CRLF and CR as LF, without one newline at the end."""
    return F.regexp_replace(F.regexp_replace(raw, "\r\n?", "\n"), r"\n\z", "")


def trimmed(raw: Column, top_lines: int = 15) -> Column:
    """The first lines; if more follow, "..." at the indent of the last line shown."""
    lines = F.split(raw, "\n")
    head = F.slice(lines, 1, top_lines)
    indent = F.regexp_extract(F.element_at(head, -1), "^ *", 0)
    return F.when(F.size(lines) <= top_lines, raw).otherwise(F.concat(F.array_join(head, "\n"), F.lit("\n"), indent, F.lit("...")))


def is_docstring(text: Column) -> Column:
    return text.rlike(r'^\s*("""[\s\S]*"""|\'\'\'[\s\S]*\'\'\')\s*$')


def upto_docstring(raw: Column, docstring: Column) -> Column:
    """raw up to and with its docstring; null without one."""
    return F.when((F.length(docstring) > 0) & raw.contains(docstring), F.substring(raw, F.lit(1), F.position(docstring, raw) + F.length(docstring) - 1))


def without_prompts(text: Column, prompts: list[str]) -> Column:
    return reduce(lambda t, p: F.replace(t, F.lit(p), F.lit("")), prompts, text)


def is_git_url(url: Column) -> Column:
    return url.rlike(r"^(https?://|git://|ssh://|git@)[\w.\-]+(:\d+)?[:/][\w./~\-]+?(\.git)?/?$")


def escape_regex(literal: str) -> str:
    return re.sub(r"([^\w\s])", r"\\\1", literal)
