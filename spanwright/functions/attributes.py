"""Typed look-ups in span attributes (MAP<STRING,STRING>): the first of several keys that holds a value of the type wanted."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanwright.functions.text import ascii_lower, trim_u

# The kinds of spans.
KINDS = ["llm", "agent", "tool", "chain", "retriever", "reranker", "embedding", "guardrail", "evaluator", "prompt", "other"]


def attr(attributes: Column, *keys: str) -> Column:
    return F.coalesce(*[F.try_element_at(attributes, F.lit(k)) for k in keys])


def as_bool(value: Column) -> Column:
    low = ascii_lower(value)
    return F.when(low.isin("true", "yes", "1"), True).when(low.isin("false", "no", "0"), False)


def attr_bool(attributes: Column, *keys: str) -> Column:
    return F.coalesce(*[as_bool(F.try_element_at(attributes, F.lit(k))) for k in keys])


def attr_count(attributes: Column, *keys: str) -> Column:
    """The first value that is a whole number from 0 to 2^32-1."""
    def whole(v: Column) -> Column:
        n = F.when(v.rlike(r"^\+?\d{1,10}$"), v.try_cast("long"))
        return F.when(n < 2**32, n)

    return F.coalesce(*[whole(F.try_element_at(attributes, F.lit(k))) for k in keys])


def attr_number(attributes: Column, *keys: str) -> Column:
    return F.coalesce(*[F.try_element_at(attributes, F.lit(k)).try_cast("double") for k in keys])


def resolved_kind(kind: Column, attributes: Column) -> Column:
    """The kind of a span; for ``other`` the one in attribute ``openinference.span.kind``, in any letter case."""
    told = ascii_lower(trim_u(F.try_element_at(attributes, F.lit("openinference.span.kind"))))
    told = F.when(told == "retrieval", "retriever").otherwise(told)
    return F.when((kind == "other") & told.isin(*KINDS), told).otherwise(F.coalesce(kind, F.lit("other")))


def alias_value(value: Column, table: dict[str, list[str]], default: str | None) -> Column:
    """The name whose spellings hold the value (any ASCII letter case), ``default`` for other values, null for null."""
    low = ascii_lower(value)
    out = F.lit(default).cast("string")
    for name, spellings in table.items():
        out = F.when(low.isin(*spellings), name).otherwise(out)
    return F.when(value.isNotNull(), out)
