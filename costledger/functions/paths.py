"""POSIX paths as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalise(path: Column) -> Column:
    """An absolute path without empty, ``.`` and ``..`` segments."""
    step = lambda acc, s: F.when(s.isin("", "."), acc).when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(s)))
    parts = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step)
    return F.concat(F.lit("/"), F.array_join(parts, "/"))


def resolve(folder: Column, path: Column) -> Column:
    """An absolute path as it is, a relative one from ``folder``; null without a folder."""
    return F.when(path.startswith("/"), normalise(path)).otherwise(normalise(F.concat(folder, F.lit("/"), path)))


def base_name(path: Column, *suffixes: str) -> Column:
    name = F.element_at(F.split(path, "/"), -1)
    for s in suffixes:
        name = F.when(name.endswith(s), F.substr(name, F.lit(1), F.length(name) - len(s))).otherwise(name)
    return name


def collapse_rename(path: Column) -> Column:
    """The new path of ``a => b`` and ``p/{a => b}/q``."""
    braces = F.regexp_replace(F.regexp_replace(path, r"^([^{]*)\{[^}]*? => ([^}]*)\}(.*)$", "$1$2$3"), "/{2,}", "/")
    return F.when(path.rlike(r"^[^{]*\{[^}]* => [^}]*\}"), braces).otherwise(F.regexp_replace(path, r"^.*? => ", ""))
