"""Text normalisation shared by indexing, querying and corpus statistics."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# The stop words that content terms leave out.
STOPWORDS = tuple(
    """a about above after again against all am an and any are as at be because been before being
    below between both but by can could did do does doing down during each few for from further had
    has have having he her here hers herself him himself his how i if in into is it its itself just
    let me more most my myself no nor not now of off on once only or other our ours ourselves out
    over own same she should so some such than that the their theirs them themselves then there
    these they this those through to too under until up very was we were what when where which
    while who whom why will with would you your yours yourself yourselves also yeah okay oh um uh
    like really got get gets going go know think thing things lot kind sort well right mean
    actually""".split()
)

TOKEN = re.compile(r"[a-z0-9]+")
POSSESSIVE = re.compile(r"'s\b")
QUOTES = str.maketrans("‘’", "''")



def _folds() -> tuple[str, str]:
    """Characters whose NFKC form is one letter, digit or apostrophe of the tokens, and what they stand for."""
    found = [(chr(c), unicodedata.normalize("NFKC", chr(c)).translate(QUOTES).lower()) for c in range(0x80, 0x20000)]
    found = [(c, to) for c, to in found if re.fullmatch("[a-z0-9']", to)]
    return "".join(c for c, _ in found), "".join(to for _, to in found)


FOLDED, PLAIN = _folds()


def normalise(text: str) -> str:
    """NFKC, plain apostrophes, lower case."""
    return unicodedata.normalize("NFKC", text).translate(QUOTES).lower()


def tokenise(text: str | None) -> list[str]:
    """Lower-case alphanumeric tokens; possessive 's dropped, other apostrophes removed. None has none."""
    if not text:
        return []
    return TOKEN.findall(POSSESSIVE.sub("", normalise(text)).replace("'", ""))


def tokens(text: Column) -> Column:
    """`tokenise` as a column expression. Characters that NFKC makes one letter or digit are folded by a table; those that
    it makes several (ligatures, units) and combining marks are left as they are, for which Spark has no function."""
    plain = F.lower(F.translate(text, FOLDED, PLAIN))
    return F.regexp_extract_all(F.regexp_replace(F.regexp_replace(plain, r"'s\b", ""), "'", ""), F.lit("([a-z0-9]+)"), 1)


def word_list(words: tuple[str, ...]) -> Column:
    """An array of plain words, made in one step."""
    return F.expr("array(" + ", ".join(f"'{w}'" for w in words) + ")")


def is_content(token: Column, min_len: int = 3) -> Column:
    return (F.length(token) >= min_len) & ~F.array_contains(word_list(STOPWORDS), token) & ~token.rlike("^[0-9]+$")


def content_tokens(text: Column, min_len: int = 3) -> Column:
    """Tokens of at least min_len characters that are neither stop words nor numbers."""
    return F.filter(tokens(text), lambda t: is_content(t, min_len))


def vocabulary_terms(text: Column) -> Column:
    """Distinct content tokens that hold a letter."""
    return F.array_distinct(F.filter(content_tokens(text), lambda t: t.rlike("[a-z]")))


def word_count(text: Column) -> Column:
    """Stretches between Unicode white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"(?U)\S+")), F.lit(0))
