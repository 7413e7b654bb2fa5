"""Text expressions with the regex and string conventions of the whole library.

Java patterns get ``(?Ud)`` where white space, digits or line ends matter: Unicode classes, and
only the line feed ends a line. Offsets and lengths are code points.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of any kind, as ``utrim`` takes it off.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"

ID_CARD = r"[1-9]\d{5}(?:19|20)\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])\d{3}[\dXx]"
MOBILE = r"(?<!\d)1[3-9]\d{9}(?!\d)"
EMAIL = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"


def utrim(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def casefold(c: Column) -> Column:
    return F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))


def no_space(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+", "")


def normal_value(c: Column) -> Column:
    """Folded case, ASCII brackets, commas and colons, no white space or zero-width marks."""
    return F.regexp_replace(no_space(F.translate(casefold(utrim(F.coalesce(c, F.lit("")))), "（），：", "(),:")), "[​﻿]", "")


def search_key(c: Column) -> Column:
    """What pages are searched by: no white space or Markdown marks, folded case."""
    return casefold(F.regexp_replace(c, r"(?U)[\s|`*_#>]+", ""))


_MARKS = re.compile(f"[{WHITE}|`*_#>]+")


def key_of(x: str) -> str:
    """``search_key`` of one text."""
    return _MARKS.sub("", x).lower().replace("ß", "ss")


def light_clean(c: Column) -> Column:
    """At most one blank line in a row, single spaces, trimmed."""
    return utrim(F.regexp_replace(F.regexp_replace(c, r"\n{3,}", "\n\n"), r"[ \t]+", " "))


def tokens(c: Column) -> Column:
    """Token estimate: a quarter of the characters."""
    return F.floor(F.length(c) / 4).cast("int")


def occurrences(text: Column, part: Column) -> Column:
    """How often a literal occurs without overlaps."""
    return ((F.length(text) - F.length(F.replace(text, part, F.lit("")))) / F.length(part)).cast("int")


def line_of(text: Column, offset: Column) -> Column:
    """1-based line of a 0-based offset."""
    before = F.substring(text, F.lit(1), offset.cast("int"))
    return (F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1).cast("int")


def characters(c: Column) -> Column:
    return F.filter(F.split(c, ""), lambda x: x != "")


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 1 where both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def shingles(c: Column, k: int = 3) -> Column:
    """Runs of k characters in order, with repeats; the text itself where it is shorter."""
    n = F.length(c)
    return F.when(n < k, F.array(c)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(n - (k - 1), F.lit(1))), lambda i: F.substring(c, i, F.lit(k))))


def mask_id(c: Column) -> Column:
    """The first six and last four characters of values of ten or more."""
    return F.when(F.length(c) < 10, c).otherwise(F.concat(F.substring(c, 1, 6), F.lit("****"), F.substring(c, -4, 4)))


def mask_text(c: Column) -> Column:
    """Every 18-digit identity number masked."""
    return F.regexp_replace(c, r"([1-9]\d{5})(?:19|20)\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])(\d{3}[\dXx])", "$1****$2")


def redacted(c: Column) -> Column:
    """Identity numbers, mobiles and e-mails hidden, for text that leaves the cluster."""
    hidden = F.regexp_replace(mask_text(c), r"(?<!\d)(1[3-9]\d)\d{4}(\d{4})(?!\d)", "$1****$2")
    return F.regexp_replace(hidden, EMAIL, "[REDACTED_EMAIL]")


def id_checksum(c: Column) -> Column:
    """Whether the last character of an 18-digit identity number is right; 15-digit ones pass by length."""
    weights = F.array(*(F.lit(w) for w in (7, 9, 10, 5, 8, 4, 2, 1, 6, 3, 7, 9, 10, 5, 8, 4, 2)))
    total = F.aggregate(F.zip_with(F.transform(F.slice(characters(c), 1, 17), lambda d: F.try_to_number(d, F.lit("9")).cast("int")), weights, lambda d, w: d * w), F.lit(0), lambda acc, x: acc + x)
    right = F.substring(F.lit("10X98765432"), (total % 11 + 1).cast("int"), F.lit(1)) == F.upper(F.substring(c, 18, 1))
    return F.when(F.length(c) == 18, F.coalesce(right, F.lit(False))).otherwise(F.length(c) == 15)
