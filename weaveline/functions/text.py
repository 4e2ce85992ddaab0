"""Text expressions: tokens, normal forms, distances and escapes, all on the JVM unless said."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Word characters and white space as Python's `re` has them for text; plain `\w` and `\s` are ASCII on the JVM.
WORD = r"[\p{L}\p{N}_]"
SPACE = r"[\s\p{Z}\x{0b}\x{1c}-\x{1f}\x{85}]"
#: A token: a run of word characters, or one other character that isn't white space.
TOKEN = rf"{WORD}+|[^\p{{L}}\p{{N}}_\s\p{{Z}}\x{{0b}}\x{{1c}}-\x{{1f}}\x{{85}}]"


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(f"({TOKEN})"), F.lit(1))


def token_count(c: Column) -> Column:
    """Number of tokens; additive over white space; null for null, 0 for empty text."""
    return F.regexp_count(c, F.lit(TOKEN))


def words(c: Column) -> Column:
    """Lower-cased words."""
    return F.regexp_extract_all(F.lower(c), F.lit(f"({WORD}+)"), F.lit(1))


def lexical_tokens(c: Column) -> Column:
    """Distinct lower-cased ASCII letter-digit runs of at least three characters."""
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]{3,})"), F.lit(1)))


def split_space(c: Column) -> Column:
    """Pieces between Unicode white space, without empty ones."""
    return F.filter(F.split(c, f"{SPACE}+"), lambda w: w != "")


def collapse_space(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, f"{SPACE}+", " "), "^ | $", "")


def strip_space(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{SPACE}+|{SPACE}+$", "")


def line_ends(c: Column) -> Column:
    """CRLF and CR as LF."""
    return F.regexp_replace(c, r"\r\n?", "\n")


def strip_line_tails(c: Column) -> Column:
    """Blanks and tabs before a line end dropped."""
    return F.regexp_replace(c, r"(?m)[ \t]+$", "")


@F.pandas_udf(StringType())
def nfc(s: pd.Series) -> pd.Series:
    """Canonical composition; Spark has no such function.  Null stays null."""
    return s.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFC", t), na_action="ignore")


@F.pandas_udf(StringType())
def casefold(s: pd.Series) -> pd.Series:
    """Full case folding, which `lower` isn't."""
    return s.map(str.casefold, na_action="ignore")


def canonical(c: Column, *, ends: bool = True, tails: bool = True, compose: bool = True) -> Column:
    """Canonical text; each step can be switched off; idempotent."""
    if ends:
        c = line_ends(c)
    if tails:
        c = strip_line_tails(c)
    return nfc(c) if compose else c


def mention_key(c: Column) -> Column:
    """A mention's key: white space collapsed, punctuation around it stripped, lower case; empty becomes null."""
    bare = F.regexp_replace(collapse_space(c), rf"^(?:{SPACE}|\p{{P}})+|(?:{SPACE}|\p{{P}})+$", "")
    return F.when(F.length(bare) > 0, F.lower(bare))


def slug_key(c: Column) -> Column:
    """A page address without leading and trailing slashes, a final `.md` or `index`, and what follows `#` or `?`."""
    path = F.regexp_replace(F.regexp_replace(strip_space(c), r"[#?].*$", ""), r"\.md$", "")
    return F.regexp_replace(F.regexp_replace(path, r"^/+|/+$", ""), r"(^|/)index$", "")


def tag_key(c: Column) -> Column:
    """A tag in lower case with dashes as blanks."""
    return collapse_space(F.regexp_replace(F.lower(c), "-", " "))


def edit_similarity(a: Column, b: Column) -> Column:
    """1 - distance / longer length: 1 for two equal strings, 0 if one of them is empty."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1.0 - F.levenshtein(a, b) / longest)


def escape_markdown(c: Column) -> Column:
    return F.regexp_replace(c, r"([\\`*_\[\]#<>{}|])", r"\\$1")


def strip_markdown(c: Column) -> Column:
    """Fenced blocks dropped, inline code and links reduced to their text, tags to blanks, blank runs collapsed."""
    c = F.regexp_replace(c, r"(?s)```.*?```", "")
    c = F.regexp_replace(c, r"`([^`]+)`", "$1")
    c = F.regexp_replace(c, r"!?\[([^\]]*)\]\([^)]*\)", "$1")
    c = F.regexp_replace(c, r"<[^>]+>", " ")
    c = F.regexp_replace(c, r"\n{3,}", "\n\n")
    return F.regexp_replace(F.regexp_replace(c, r"[ \t]+", " "), rf"^{SPACE}+|{SPACE}+$", "")


def plain_words(c: Column, stopwords: list[str]) -> Column:
    """Lower-cased words without punctuation and digits, stop words and words of at most two letters."""
    bare = F.regexp_replace(F.lower(c), r"[\p{P}\p{S}0-9]", "")
    return F.filter(split_space(bare), lambda w: (F.length(w) > 2) & ~w.isin(stopwords))


def non_ascii(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"([^\x00-\x7F])"), F.lit(1))


def context_window(c: Column, start: Column, end: Column, reach: int = 240) -> Column:
    """`reach` characters around a span, white space collapsed, `...` where text was cut off."""
    a = F.greatest(start - reach, F.lit(0))
    b = F.least(end + reach, F.length(c))
    body = collapse_space(F.substring(c, (a + 1).cast("int"), (b - a).cast("int")))
    return F.concat(F.when(a > 0, "... ").otherwise(""), body, F.when(b < F.length(c), " ...").otherwise(""))


def humanize(target: Column) -> Column:
    """The last segment of a path with dashes as blanks."""
    return F.regexp_replace(F.element_at(F.split(target, "/"), -1), "-", " ")
