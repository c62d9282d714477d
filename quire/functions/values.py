"""Values of files as variants: parsed once, then read by path without parsing again. See quire.sources.syntax for their tags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def part(value: Column | str, key: str, kind: str = "variant") -> Column:
    """What a dictionary has at a key (or a path `a.b`), as a type; null if it has nothing or that is of another type."""
    return F.try_variant_get(col(value), "$." + key, kind)


def text(value: Column | str, key: str) -> Column:
    return part(value, key, "string")


def ref_number(value: Column | str) -> Column:
    """The number of the object that a reference points at; null for any other value."""
    return F.when(text(value, "t") == "ref", part(value, "n", "int"))


def name(value: Column | str) -> Column:
    """A name's text; null for any other value."""
    return F.when(text(value, "t") == "name", text(value, "v"))


def numbers(column: str) -> Column:
    """An array of numbers whose references were looked up (sources.files.resolve_inside), null where an item is something else."""
    return F.coalesce(f"{column}_plain", F.transform(f"{column}_items", lambda x: F.try_variant_get(x, "$", "double")))
