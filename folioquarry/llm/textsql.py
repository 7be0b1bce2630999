"""DataFrame expressions for words, used by the operators that run no Python on rows."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Separators: ASCII other than digits and lower-case letters, after A-Z are lower-cased.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased and nothing else; texts of ASCII alone take the faster way to the same result."""
    plain = F.length(text) == F.octet_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def words_of(text: Column) -> Column:
    """Words of a text, in order; none for null."""
    return F.array_remove(F.split(lower_ascii(F.coalesce(text.cast("string"), F.lit(""))), SEPARATORS), "")


def starts(n: Column, k: int | Column) -> Column:
    """0..n-k as an array, empty if n < k."""
    k = F.lit(k) if isinstance(k, int) else k
    return F.when(n >= k, F.sequence(F.lit(0), (n - k).cast("int"))).otherwise(F.array().cast("array<int>"))
