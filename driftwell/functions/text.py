"""String expressions. All of them stay inside the JVM."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Everything Unicode counts as white space, plus the four ASCII separators 1C-1F.
SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"
WORD = r"[\p{L}\p{N}_]+"


def trim_all(c: Column) -> Column:
    """Trim any white space, not only blanks."""
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def is_blank(c: Column) -> Column:
    """True for null, empty and all-white-space strings."""
    return c.isNull() | ~c.rlike(r"[^\s\x1c-\x1f\x85\p{Z}]")


def or_default(c: Column, default: str | Column) -> Column:
    """The trimmed string, or ``default`` where nothing is left of it."""
    d = F.lit(default) if isinstance(default, str) else default
    return F.coalesce(F.nullif(trim_all(c), F.lit("")), d)


def tokens(c: Column, max_len: int | None = None) -> Column:
    """Lower-cased white-space tokens, the first ``max_len`` of them if given."""
    toks = F.array_remove(F.split(F.lower(c), f"{SPACE}+"), "")
    return toks if max_len is None else F.slice(toks, 1, max_len)


def word_count(c: Column) -> Column:
    """Number of words (runs of letters, digits, underscores)."""
    return F.regexp_count(F.coalesce(c, F.lit("")), F.lit(WORD)).cast("int")


def contains_any_case(c: Column, needle: str | Column) -> Column:
    n = F.lit(needle.lower()) if isinstance(needle, str) else F.lower(needle)
    return F.contains(F.lower(c), n)


def first_label(c: Column, patterns: Iterable[tuple[str, str]], default: str) -> Column:
    """Label of the first pattern found in the text (any case), tested in the given order."""
    out = None
    for needle, label in patterns:
        hit = contains_any_case(c, needle)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return F.lit(default) if out is None else out.otherwise(default)


# What would end a line of a file, and the backslash that its codes begin with; the backslash goes first.
LINE_CODES = (("\\", "\\s"), ("\n", "\\n"), ("\r", "\\r"))


def to_one_line(c: Column) -> Column:
    """The string without line breaks; :func:`from_one_line` restores it exactly."""
    for plain, code in LINE_CODES:
        c = F.replace(c, F.lit(plain), F.lit(code))
    return c


def from_one_line(c: Column) -> Column:
    for plain, code in reversed(LINE_CODES):
        c = F.replace(c, F.lit(code), F.lit(plain))
    return c


def key_hash(*parts: Column | str | int) -> Column:
    """A repeatable draw: 32 bits of the MD5 of the parts joined with ``:``, as BIGINT."""
    cols = [p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *cols)), 1, 8), 16, 10).cast("bigint")
