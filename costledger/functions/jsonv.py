"""Strict reading of untrusted JSON through variants.

A path is absent (SQL NULL), null, or of a JSON type; casts alone would take ``"7"`` or 3.5 for a count.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .money import MAX_TOKENS


def allow_duplicate_keys(spark: SparkSession) -> None:
    """Of repeated keys the last counts, as JSON readers have it; else the whole text would be invalid."""
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")


def parse(text: Column) -> Column:
    return F.try_parse_json(text)


def at(v: Column, path: str = "$") -> Column:
    return v if path == "$" else F.try_variant_get(v, path, "variant")


def fields(v: Column, path: str, **kinds: str) -> Column:
    """Some fields of the object at a path, looked up together and nothing else copied; null for any
    other type.  A field that is absent, or not of its kind, is null; a JSON null stays a variant."""
    return F.try_variant_get(v, path, struct_of(**kinds))


def struct_of(**kinds: str) -> str:
    return f"struct<{','.join(f'{name}:{kind}' for name, kind in kinds.items())}>"


def absent(v: Column, path: str) -> Column:
    return at(v, path).isNull()


def is_null(v: Column, path: str) -> Column:
    return F.coalesce(F.is_variant_null(at(v, path)), F.lit(False))


def missing(v: Column, path: str) -> Column:
    return absent(v, path) | is_null(v, path)


def _kind(v: Column, path: str) -> Column:
    return F.coalesce(F.schema_of_variant(at(v, path)), F.lit(""))


def is_string(v: Column, path: str) -> Column:
    return _kind(v, path) == "STRING"


def is_object(v: Column, path: str = "$") -> Column:
    """Cast to a struct without fields: tells objects apart and copies nothing."""
    return F.try_variant_get(v, path, "struct<>").isNotNull()


def is_boolean(v: Column, path: str) -> Column:
    return _kind(v, path) == "BOOLEAN"


def is_number(v: Column, path: str) -> Column:
    return _kind(v, path).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT|INT)")


def string(v: Column, path: str) -> Column:
    """The string at a path; null for any other type."""
    return F.when(is_string(v, path), F.try_variant_get(v, path, "string"))


def nonempty(v: Column, path: str) -> Column:
    text = string(v, path)
    return F.when(text != "", text)


def array(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "array<variant>")


def count(v: Column, path: str) -> Column:
    """A token count: a whole number from 0 to 2^53 - 1; null for anything else."""
    number = F.try_variant_get(v, path, "double")
    ok = is_number(v, path) & (number == F.floor(number)) & (number >= 0) & (number <= float(MAX_TOKENS))
    return F.when(ok, number.cast("bigint"))


def optional(check: Column, v: Column, path: str, nullable: bool = False) -> Column:
    """Absent, or (if ``nullable``) null, or what ``check`` says."""
    fine = absent(v, path) | check
    return fine | is_null(v, path) if nullable else fine


def count_ok(v: Column, path: str, nullable: bool = False) -> Column:
    return optional(count(v, path).isNotNull(), v, path, nullable)


def millis(text: Column) -> Column:
    """An ISO 8601 date or time as milliseconds since the epoch; null for any other form.  Without a
    zone the session's time zone counts."""
    iso = text.rlike(r"^\d{4}(-\d\d(-\d\d([T ]\d\d:\d\d(:\d\d(\.\d{1,9})?)?\s*(Z|[+-]\d\d:?\d\d)?)?)?)?$")
    return F.when(iso, F.unix_millis(F.try_to_timestamp(text)))
