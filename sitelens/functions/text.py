"""Text expressions whose white space and line breaks are Unicode's, as the audit's rules are stated."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Everything that ends a line: CR LF as one, and the other breaks of Unicode and ASCII.
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^(?U)[\s\x1c-\x1f]+|(?U)[\s\x1c-\x1f]+$", "")


def lines(c: Column) -> Column:
    return F.split(c, LINE_BREAK)


def shorten(c: Column, limit: int = 60) -> Column:
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit - 3), F.lit("..."))).otherwise(c)


def escape_cell(c: Column) -> Column:
    return F.replace(c, F.lit("|"), F.lit("\\|"))


def fence(c: Column, language: str = "") -> Column:
    return F.concat(F.lit(f"```{language}\n"), F.regexp_replace(c, r"\n+$", ""), F.lit("\n```"))


def join_words(c: Column) -> Column:
    """An array of words as an English list: a, b and c."""
    n = F.size(c)
    return F.when(n == 1, F.get(c, F.lit(0))).when(n > 1, F.concat(F.array_join(F.slice(c, F.lit(1), n - 1), ", "), F.lit(" and "), F.get(c, n - 1))).otherwise("")


def first_sentence(c: Column) -> Column:
    return F.split(c, r"(?<=[a-z0-9)])\. ", 2)[0]


def percentage(count: Column, total: Column) -> Column:
    """Half-even to one decimal; 0 where there is nothing to divide by."""
    return F.coalesce(F.bround(F.try_divide(count * 100.0, total), 1), F.lit(0.0))
