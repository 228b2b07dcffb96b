"""Alignment of two runs' steps.

Steps with equal keys pair up in order; where the keys differ the nearer match within ``lookahead`` steps wins (of equal distances the
candidate's), and what it skips stands alone; without a match the two steps count as changed. Rows before the first meaningful difference are kept
only as context. The alignment of one pair runs in one task over narrow rows; pairs are spread over tasks.

Defined results: pairs with no steps on either side give no row; at most ``most`` rows are given, with ``truncated`` saying if more there were.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanwright.functions.text import operation_key


def pairs_of(left: list[str], right: list[str], lookahead: int = 32) -> Iterator[tuple[str, int | None, int | None]]:
    """(relation, place left, place right): ``same``, ``changed``, ``baseline_only`` or ``candidate_only``."""
    places: tuple[dict[str, list[int]], dict[str, list[int]]] = (defaultdict(list), defaultdict(list))
    for side, keys in zip(places, (left, right)):
        for i, k in enumerate(keys):
            side[k].append(i)

    def ahead(side: int, key: str, at: int) -> int | None:
        """How far beyond ``at`` the next step with the key is, if within reach."""
        p = places[side].get(key, [])
        j = bisect_right(p, at)
        return p[j] - at if j < len(p) and p[j] - at <= lookahead else None

    i = j = 0
    while i < len(left) and j < len(right):
        if left[i] == right[j]:
            yield "same", i, j
            i, j = i + 1, j + 1
            continue
        skip_right, skip_left = ahead(1, left[i], j), ahead(0, right[j], i)
        if skip_right is not None and (skip_left is None or skip_right <= skip_left):
            yield from (("candidate_only", None, x) for x in range(j, j + skip_right))
            j += skip_right
        elif skip_left is not None:
            yield from (("baseline_only", x, None) for x in range(i, i + skip_left))
            i += skip_left
        else:
            yield "changed", i, j
            i, j = i + 1, j + 1
    yield from (("baseline_only", x, None) for x in range(i, len(left)))
    yield from (("candidate_only", None, x) for x in range(j, len(right)))


def aligned(left: pd.DataFrame, right: pd.DataFrame, lookahead: int = 32, context: int = 12, most: int | None = 1024) -> pd.DataFrame:
    """Rows of one pair; steps have ``key``, ``span_id``, ``status``, ``facts`` and ``root`` (whether a root agent)."""
    rows, prefix, cut, lone = [], 0, False, [0, 0]
    of = {c: (left[c].tolist(), right[c].tolist()) for c in ("status", "facts", "root", "span_id")}
    before: list[tuple] = []
    split = False
    for n, (relation, i, j) in enumerate(pairs_of(left["key"].tolist(), right["key"].tolist(), lookahead)):
        meaningful = relation != "same"
        confidence = 0.75 if relation == "changed" else 0.85
        if relation == "same":
            same = lambda c: of[c][0][i] == of[c][1][j]  # noqa: B023, E731
            if not (same("status") and same("facts")):
                meaningful = not (of["root"][0][i] and of["root"][1][j])  # a root's outcome is an effect, no cause
                relation, confidence = "changed", 0.75 if meaningful else 0.9
            else:
                exact = same("span_id")
                relation, confidence = ("exact", 1.0) if exact else ("equivalent", 0.9)
        lone[0] += relation == "baseline_only"
        lone[1] += relation == "candidate_only"
        row = (n, relation, meaningful, confidence, i, j)
        if not split and not meaningful:
            prefix += 1
            before = [*before, row][-context:] if context else []
            continue
        if not split:
            split = True
            rows += before
        rows.append(row)
    if not split:
        rows = before
    cut = most is not None and len(rows) > most
    out = pd.DataFrame(rows[:most], columns=["alignment_index", "relation", "meaningful", "confidence", "baseline_step", "candidate_step"])
    for c in ("baseline_step", "candidate_step"):
        out[c] = out[c].astype("Int64")
    return out.assign(common_prefix_steps=prefix, baseline_unmatched=lone[0], candidate_unmatched=lone[1], truncated=cut)


_ROWS = "pair_id string, alignment_index bigint, relation string, meaningful boolean, confidence double, baseline_step bigint, candidate_step bigint, common_prefix_steps bigint, baseline_unmatched bigint, candidate_unmatched bigint, truncated boolean"


def steps(spans: DataFrame) -> DataFrame:
    """Steps of spans (trace_id, pos, id, parent_id, name, kind, source_status, error, attributes): their key and what is compared."""
    op = F.coalesce(F.try_element_at("attributes", F.lit("agent.operation")), F.try_element_at("attributes", F.lit("gen_ai.tool.name")), F.col("name"), F.lit(""))
    key = F.concat_ws("|", "kind", operation_key(op), F.col("parent_id").isNull().cast("string"))
    return spans.select("trace_id", "pos", F.col("id").alias("span_id"), key.alias("key"), F.coalesce("source_status", F.lit("unset")).alias("status"), F.coalesce(F.try_element_at("attributes", F.lit("agent.tool.status")), F.lit("")).alias("facts"), (F.col("parent_id").isNull() & (F.col("kind") == "agent")).alias("root"))


def compare_runs(baseline: DataFrame, candidate: DataFrame, lookahead: int = 32, context: int = 12, most: int | None = 1024) -> DataFrame:
    """Aligned rows of step tables with ``pair_id``, ``pos`` and the columns of :func:`steps`; all rows if ``most`` is None."""
    def one(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        name = left["pair_id"].iloc[0] if len(left) else right["pair_id"].iloc[0]
        got = aligned(left.sort_values("pos"), right.sort_values("pos"), lookahead, context, most)
        return got.assign(pair_id=name)[[c.split()[0] for c in _ROWS.split(", ")]]

    baseline, candidate = (x.toDF(*x.columns) for x in (baseline, candidate))
    return baseline.groupBy("pair_id").cogroup(candidate.groupBy("pair_id")).applyInPandas(one, _ROWS)
