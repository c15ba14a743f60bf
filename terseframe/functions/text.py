"""Conventions every operator shares: lengths, token estimates, hashes and whitespace."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def saved_tokens(chars: Column) -> Column:
    """Tokens of a number of characters at 3.5 a token, truncated, in exact integers."""
    return _div(chars * 2, 7)


def _div(a: Column, b: int) -> Column:
    return ((a - F.pmod(a, F.lit(b))) / F.lit(b)).cast("long")


def tokens(text: Column) -> Column:
    """Offload estimate: at least one token."""
    return F.greatest(F.lit(1), _div(F.length(text) * 2, 7)).cast("long")


def saved_by(before: Column, after: Column) -> Column:
    return _div(F.greatest(F.lit(0), F.length(before) - F.length(after)) * 2, 7)


def content_hash(text: Column) -> Column:
    return F.substring(F.sha2(text.cast("binary"), 256), 1, 16)


def strip(text: Column) -> Column:
    """Without leading and trailing Unicode whitespace."""
    return F.regexp_replace(F.regexp_replace(text, r"(?U)^\s+", ""), r"(?U)\s+\z", "")


def lstrip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+", "")


def json_string_length(text: Column) -> Column:
    """Length of a string as an ASCII-escaped JSON literal, quotes included."""
    short = F.regexp_count(text, F.lit(r'["\\\n\r\t\x08\x0c]'))
    control = F.regexp_count(text, F.lit(r"[\x00-\x07\x0b\x0e-\x1f\x7f-\x{ffff}]"))
    wide = F.regexp_count(text, F.lit(r"[\x{10000}-\x{10ffff}]"))
    return (F.length(text) + 2 + short + control * 5 + wide * 11).cast("long")


def lines_with_ends(text: Column) -> Column:
    """Lines with their terminators, by every Unicode line end."""
    end = r"\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}"
    return F.regexp_extract_all(text, F.lit(rf"[^{end}]*(?:\r\n|[{end}])|[^{end}]+\z"), F.lit(0))
