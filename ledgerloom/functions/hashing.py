"""Hash-derived integers, seeds and content keys, all in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def joined(*parts: Column) -> Column:
    """Parts as text with '|' between them; a null part becomes the empty text."""
    return F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def head32(digest: Column) -> Column:
    """The first 32 bits of a hex digest as a bigint."""
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def hash32(text: Column) -> Column:
    """The first 32 bits of SHA-256 as a bigint."""
    return head32(F.sha2(text, 256))


def derive_seed(*parts: Column) -> Column:
    """A 31-bit seed from a namespace and its coordinates."""
    return hash32(joined(*parts)).bitwiseAND(F.lit((1 << 31) - 1).cast("bigint"))


def uniform(text: Column) -> Column:
    """A number in [0, 1) from 52 bits of SHA-256."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))


#: What stands for itself nowhere in a JSON string, backslash first; other controls are written by their number.
_ESCAPES = {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}
_ESCAPES |= {chr(c): f"\\u{c:04x}" for c in range(32) if chr(c) not in _ESCAPES}


# Coefficients of the rational approximation of the normal quantile, relative error below 1.2e-9.
_CENTRE = ((-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00), (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0))
_TAIL = ((-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00), (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0))


def _polynomial(x: Column, coefficients: tuple[float, ...]) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + F.lit(c)
    return out


def normal_quantile(p: Column) -> Column:
    """The standard normal quantile of a probability between 0 and 1."""
    q = p - 0.5
    centre = q * _polynomial(q * q, _CENTRE[0]) / _polynomial(q * q, _CENTRE[1])
    far = F.sqrt(-2.0 * F.log(F.least(p, 1.0 - p)))
    tail = _polynomial(far, _TAIL[0]) / _polynomial(far, _TAIL[1])
    return F.when(F.abs(q) <= 0.47575, centre).when(q < 0, tail).otherwise(-tail)


def normal(text: Column) -> Column:
    """A standard normal number from the hash of a text."""
    half = F.conv(F.substring(F.sha2(text, 256), 1, 13), 16, 10).cast("bigint")
    return normal_quantile((half + 0.5) / F.lit(float(1 << 52)))


def pick(uniform_: Column, weights: list[tuple[str, float]]) -> Column:
    """One of the names by a number in [0, 1), each as often as its share of the weights."""
    total = sum(w for _, w in weights)
    if total <= 0 or min(w for _, w in weights) < 0:
        raise ValueError("weights must be non-negative and not all zero")
    out, below = None, 0.0
    for name, w in weights[:-1]:
        below += w / total
        out = F.when(uniform_ < below, F.lit(name)) if out is None else out.when(uniform_ < below, F.lit(name))
    return F.lit(weights[-1][0]) if out is None else out.otherwise(F.lit(weights[-1][0]))


def json_text(value: Column) -> Column:
    """A JSON string with everything outside ASCII as it is, or null as a JSON null."""
    escaped = value
    for raw, written in _ESCAPES.items():
        escaped = F.replace(escaped, F.lit(raw), F.lit(written))
    body = F.when(value.rlike(r'[\x00-\x1f"\\]'), escaped).otherwise(value)
    return F.when(value.isNull(), F.lit("null")).otherwise(F.concat(F.lit('"'), body, F.lit('"')))


def canonical_object(text: Column, names: tuple[str, ...]) -> Column:
    """A compact JSON object of the numbers that a JSON text has under ``names``, sorted by name; absent ones are left out."""
    parts = [F.concat(F.lit(f'"{name}":'), F.get_json_object(text, f"$.{name}")) for name in sorted(names)]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def content_key(fields: dict[str, Column]) -> Column:
    """SHA-256 of the compact JSON object with sorted keys whose values are given as JSON text."""
    parts = []
    for i, name in enumerate(sorted(fields)):
        parts += [F.lit(("{" if i == 0 else ",") + f'"{name}":'), fields[name]]
    return F.sha2(F.concat(*parts, F.lit("}")), 256)
