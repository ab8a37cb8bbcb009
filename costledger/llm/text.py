"""Column expressions on texts that several operators share; all run in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The ASCII white space that separates words, as a Java or RE2 pattern.
SPACE = r"[\x20\x09-\x0D]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """The words of a text; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"{SPACE}+"), "")


def count_bytes(text: Column, chars: str) -> Column:
    """How often any of these ASCII characters occurs."""
    size = F.octet_length(text).cast("long")
    parts = [size - F.octet_length(F.replace(text, F.lit(c), F.lit(""))) for c in chars]
    return sum(parts[1:], parts[0])


def shingles(word_list: Column, n: int) -> Column:
    """Space-joined runs of ``n`` words, repeats included; of fewer words, all of them; of none, none."""
    runs = F.transform(F.sequence(F.lit(1), F.size(word_list) - (n - 1)), lambda i: F.array_join(F.slice(word_list, i, n), " "))
    whole = F.array(F.array_join(word_list, " "))
    return F.when(F.size(word_list) >= n, runs).when(F.size(word_list) > 0, whole).otherwise(F.array().cast("array<string>"))


def word_hashes(word_list: Column, n: int) -> Column:
    """A hash per run of ``n`` words; of fewer words, of all; of none, none."""
    runs = F.transform(F.sequence(F.lit(1), F.size(word_list) - (n - 1)), lambda i: F.xxhash64(F.slice(word_list, i, n)))
    return F.when(F.size(word_list) >= n, runs).when(F.size(word_list) > 0, F.array(F.xxhash64(word_list))).otherwise(F.array().cast("array<bigint>"))
