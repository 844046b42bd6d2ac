"""Text helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that make a text blank, as escapes of a SQL literal.
BLANK_CHARACTERS = (
    r" \t\n\u000b\u000c\r\u001c\u001d\u001e\u001f"
    r"\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2008\u2009\u200a"
    r"\u2028\u2029\u205f\u3000"
)


def is_blank(column: str) -> str:
    """SQL test: true for null, empty and whitespace-only text; never null. Trimming from the left stops at the first
    character that is not blank, however long the text."""
    return f"({column} IS NULL OR length(trim(LEADING '{BLANK_CHARACTERS}' FROM {column})) = 0)"


def contains_ignore_case(text: Column, term: str) -> Column:
    """Substring search in any case; ``%`` and ``_`` in the term are ordinary characters."""
    return F.contains(F.lower(text), F.lower(F.lit(term)))


def stable_id(key: Column) -> Column:
    """A UUID-shaped id computed from the key, so a retried task gives the same id again."""
    digest = F.md5(key)
    cuts = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat_ws("-", *[F.substring(digest, start, length) for start, length in cuts])


def comma_list(text: Column) -> Column:
    """'a, b,,c' -> ['a', 'b', 'c'] ; null stays null."""
    items = F.transform(F.split(text, ","), lambda item: F.btrim(item))
    return F.filter(items, lambda item: F.length(item) > 0)
