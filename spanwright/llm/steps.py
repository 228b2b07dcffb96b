"""Columns that several operators on ordered spans share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bare(text: Column) -> Column:
    """Without white space (any Unicode white space) at the ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def kind_of(kind: Column, attributes: Column) -> Column:
    """The kind in lower case; for ``other`` the one in ``openinference.span.kind``, if it is not blank."""
    own = F.lower(bare(kind))
    told = F.lower(bare(F.try_element_at(attributes, F.lit("openinference.span.kind"))))
    return F.when((own == "other") & (F.coalesce(told, F.lit("")) != ""), told).otherwise(F.coalesce(own, F.lit("other")))


def step_of(kind: Column, name: Column, attributes: Column) -> Column:
    """``kind/name``, both in lower case; a null name is an empty one."""
    return F.concat_ws("/", kind_of(kind, attributes), F.lower(bare(F.coalesce(name, F.lit("")))))


def tool_key(name: Column) -> Column:
    """A tool's name but for letter case, white space, hyphens and underscores."""
    return F.lower(F.regexp_replace(name, r"(?U)[\s_\-]+", ""))


def error_key(error: Column) -> Column:
    """What an error says but for letter case, white space, a final full stop and words that hold a digit.

    Null and blank errors give ''; all others start with '!', so that an error of digits alone is not a missing one.
    """
    worded = F.regexp_replace(F.lower(bare(error)), r"\S*\d\S*", "")
    key = F.regexp_replace(F.regexp_replace(worded, r"(?U)\s+", ""), r"\.$", "")
    return F.when(error.isNull() | (bare(error) == ""), F.lit("")).otherwise(F.concat(F.lit("!"), key))
