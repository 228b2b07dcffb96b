"""Text, hash and score expressions; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEVERITIES = ["info", "low", "medium", "high", "critical"]
QUALITIES = ["missing", "ambiguous", "inferred", "derived", "explicit"]


def trim_u(text: Column) -> Column:
    """Without Unicode white space at the ends (the built-in trim strips blanks only)."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def ascii_lower(text: Column) -> Column:
    """Lower case of A-Z only."""
    return F.translate(text, UPPER, LOWER)


def single_line(text: Column) -> Column:
    return trim_u(F.regexp_replace(text, r"(?U)\s+", " "))


def is_label(text: Column) -> Column:
    """Whether a text is a bounded label: 1 to 128 of letters, digits, ``_ . : / -``."""
    return F.coalesce(text.rlike(r"^[A-Za-z0-9_.:/-]{1,128}$"), F.lit(False))


def is_identity(text: Column) -> Column:
    """Whether a text is 1 to 256 visible ASCII characters."""
    return F.coalesce(text.rlike(r"^[!-~]{1,256}$"), F.lit(False))


def operation_key(text: Column) -> Column:
    """Runs of other than letters and digits become one underscore; none stand at the ends; A-Z in lower case."""
    return F.regexp_replace(F.regexp_replace(ascii_lower(text), r"[^a-z0-9]+", "_"), r"^_+|_+$", "")


def _framed(part: Column) -> Column:
    b = F.encode(F.coalesce(part, F.lit("")), "UTF-8")
    return F.concat(F.unhex(F.lpad(F.hex(F.octet_length(b).cast("long")), 16, "0")), b)


def hash_parts(*parts: Column, more: Column | None = None) -> Column:
    """``sha256:`` and the hash over all parts, each behind its length in bytes (eight bytes, big end first). ``more``: an array of further parts."""
    whole = F.concat(*[_framed(p) for p in parts])
    if more is not None:
        # Joined at once: added one by one they would copy what stands before each.
        whole = F.concat(whole, F.unhex(F.array_join(F.transform(more, lambda p: F.hex(_framed(p))), "")))
    return F.concat(F.lit("sha256:"), F.sha2(whole, 256))


def hash_text(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(F.encode(text, "UTF-8"), 256))


def canonical_json(text: Column) -> Column:
    """A JSON text with sorted keys and without blanks, null if it is no JSON. Numbers are written in their shortest form."""
    return F.to_json(F.try_parse_json(text))


def truncate_utf8(text: Column, most: int) -> Column:
    """The longest start of a text with at most ``most`` bytes that cuts no character."""
    b = F.encode(text, "UTF-8")
    cut = F.lit(most)
    for _ in range(3):  # a character has up to three further bytes, each 10xxxxxx
        at = F.conv(F.hex(F.substring(b, cut + 1, 1)), 16, 10).cast("int")
        cut = F.when((at >= 128) & (at < 192), cut - 1).otherwise(cut)
    return F.when(F.octet_length(text) <= most, text).otherwise(F.decode(F.substring(b, F.lit(1), cut), "UTF-8"))


def rank_of(value: Column, order: list[str]) -> Column:
    """The place of a value in an order of names, null for others."""
    out = F.lit(None).cast("int")
    for i, s in enumerate(order):
        out = F.when(value == s, F.lit(i)).otherwise(out)
    return out


def named(rank: Column, order: list[str]) -> Column:
    return F.try_element_at(F.array(*[F.lit(s) for s in order]), rank + 1)


def weakest(*qualities: Column) -> Column:
    return named(F.least(*[rank_of(q, QUALITIES) for q in qualities]), QUALITIES)


def on_scale(label: Column, scale: list[str]) -> Column:
    """The label in the scale's spelling, or null. Letter case, blanks at the ends, and a blank or hyphen for the underscore don't matter."""
    key = F.regexp_replace(F.lower(F.regexp_replace(label, r"(?U)^\s+|\s+$", "")), "[ -]", "_")
    out = F.lit(None).cast("string")
    for s in scale:
        out = F.when(key == s.lower(), s).otherwise(out)
    return out


def clamp01(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def normalized_score(raw: Column, scale: Column) -> Column:
    """A raw score on 0..1: ``binary`` and ``unit`` as they are, ``four_point`` from 1..4."""
    return clamp01(F.when(scale == "four_point", (raw - 1.0) / 3.0).otherwise(raw))


def word_overlap(a: Column, b: Column, least: int = 3) -> Column:
    """How many distinct words of at least ``least`` bytes two texts share."""
    def words(t: Column) -> Column:
        return F.array_distinct(F.filter(F.split(ascii_lower(t), r"[^\p{L}\p{N}]+"), lambda w: F.octet_length(w) >= least))

    return F.size(F.array_intersect(words(a), words(b)))


def escape_tagged(text: Column) -> Column:
    """A text on one line with & < > escaped."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("\r", "\\r"), ("\n", "\\n")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def log_loss(p: Column, label: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(1e-15)), F.lit(1 - 1e-15))
    return -F.when(label, F.log(q)).otherwise(F.log(1 - q))


def sigmoid(x: Column) -> Column:
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


# Names of fields that hold secrets, and forms of credentials.
SECRET_NAMES = r"(?i)(password|passwd|secret|api[_-]?key|access[_-]?token|auth[_-]?token|private[_-]?key|credential|bearer)"
CREDENTIALS = [r"(?i)\b(password|passwd|secret|api[_-]?key|token)\s*[:=]\s*\S{6,}", r"\bsk-[A-Za-z0-9_-]{16,}", r"\bAKIA[0-9A-Z]{16}\b", r"\bgh[pousr]_[A-Za-z0-9]{20,}", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", r"\beyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\."]


def leaks_secret(text: Column) -> Column:
    """Whether a text, or what it says in base64, holds the form of a credential."""
    def plain(t: Column) -> Column:
        out = F.lit(False)
        for p in CREDENTIALS:
            out = out | t.rlike(p)
        return out

    packed = F.regexp_extract_all(text, F.lit(r"([A-Za-z0-9+/]{24,}={0,2})"), F.lit(1))
    opened = F.transform(packed, lambda x: F.decode(F.try_to_binary(F.rpad(x, (F.ceil(F.length(x) / 4) * 4).cast("int"), F.lit("=")), F.lit("base64")), "ISO-8859-1"))
    return F.coalesce(plain(text), F.lit(False)) | F.exists(F.coalesce(opened, F.array().cast("array<string>")), lambda x: F.coalesce(plain(x), F.lit(False)))


def secret_names(attributes: Column) -> Column:
    """The keys of a map that name secrets."""
    return F.filter(F.map_keys(attributes), lambda k: k.rlike(SECRET_NAMES))
