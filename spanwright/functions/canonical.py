"""Canonical JSON and content ids, as columns and as plain functions.

Canonical: keys sorted by UTF-16 code units, no blanks, numbers as ECMAScript writes them, strings with the shortest escapes (the rules of RFC 8785).
"""

from __future__ import annotations

import hashlib
import json
import math
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def number(x: float | int) -> str:
    if isinstance(x, int):
        return str(x)
    if not math.isfinite(x):
        raise ValueError("no finite number")
    if x == 0:
        return "0"
    if x == int(x) and abs(x) < 1e21:
        return str(int(x))
    mantissa, _, exponent = repr(float(x)).partition("e")
    sign = "-" if mantissa.startswith("-") else ""
    whole, _, part = mantissa.lstrip("-").partition(".")
    part = "" if part == "0" else part
    digits = (whole + part).lstrip("0")
    point = len(whole) + int(exponent or 0) - (len(whole + part) - len(digits))
    digits = digits.rstrip("0")
    n = len(digits)
    if 0 < point <= 21:
        return sign + (digits + "0" * (point - n) if point >= n else digits[:point] + "." + digits[point:])
    if -6 < point <= 0:
        return sign + "0." + "0" * -point + digits
    e = point - 1
    return f"{sign}{digits[0]}{'.' + digits[1:] if n > 1 else ''}e{'+' if e >= 0 else '-'}{abs(e)}"


def text(value: Any) -> str:
    if value is None or isinstance(value, bool):
        return {None: "null", True: "true", False: "false"}[value]
    if isinstance(value, str):
        return json.dumps(value, ensure_ascii=False)
    if isinstance(value, (int, float)):
        return number(value)
    if isinstance(value, dict):
        keys = sorted(value, key=lambda k: k.encode("utf-16-be"))
        return "{" + ",".join(f"{text(k)}:{text(value[k])}" for k in keys) + "}"
    return "[" + ",".join(map(text, value)) + "]"


def content_id(domain: str, value: Any) -> str:
    return "sha256:" + hashlib.sha256((domain + text(value)).encode()).hexdigest()


def canonical(column: Column) -> Column:
    """Canonical form of JSON texts; null for what is no JSON. Runs on batches in Python, for ids that hold fractions."""
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        def one(x: str | None) -> str | None:
            try:
                return None if x is None else text(json.loads(x))
            except ValueError:
                return None

        return s.map(one)

    return run(column)


def content_id_column(domain: str, column: Column) -> Column:
    c = canonical(column)
    return F.concat(F.lit("sha256:"), F.sha2(F.encode(F.concat(F.lit(domain), c), "UTF-8"), 256))
