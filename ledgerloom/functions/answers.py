"""Answers in free text: marker selection, strict extraction, canonical decimals.

All columns; ``lenient`` has what columns can't express.  Numbers are compared by their canonical text: an integer, a
terminating decimal without trailing zeros, or a reduced fraction p/q.  Full-width
digits and the Unicode minus are read as their ASCII counterparts.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions.lenient import canonical_quotient, last_box_exact

STRICT = r"^-?\d+(\.\d+)?$"
_PLAIN = r"(?:[^{}\\]|\\.)"
_NEST = rf"(?:{_PLAIN}|\{{(?:{_PLAIN}|\{{(?:{_PLAIN}|\{{{_PLAIN}*\}})*\}})*\}})*"


def ascii_digits(text: Column) -> Column:
    return F.translate(text, "０１２３４５６７８９，．−", "0123456789,.-")


def _all(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _last(values: Column) -> Column:
    return F.when(F.size(values) > 0, F.element_at(values, -1))


#: Four braces open at once: more than the pattern of boxes reads.  Also a box in a box, of which it reads the outer one.
_DEEP = r"(?s)\{[^{}]*\{[^{}]*\{[^{}]*\{|\\boxed\s*\{[^{}]*\\boxed"


def boxes(text: Column, command: str = "boxed") -> Column:
    """Contents of all balanced ``\\command{...}``, with braces nested up to three deep."""
    return _all(text, rf"(?s)\\{command}\s*\{{({_NEST})\}}")


def last_box(text: Column) -> Column:
    """Content of the last balanced box, null without one.  Only deeply nested texts leave the JVM."""
    deep = text.rlike(_DEEP)
    return F.when(deep, last_box_exact(F.when(deep, text))).otherwise(_last(boxes(text)))


def last_hash_line(text: Column) -> Column:
    """What follows the last '####' on its line, trimmed; null without one."""
    rest = F.substring_index(F.substring_index(text, "####", -1), "\n", 1)
    return F.when(text.contains("####"), F.regexp_replace(rest, r"(?U)^\s+|\s+$", ""))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def marker(text: Column) -> Column:
    """struct(kind, content) of the later of the last balanced box and the last '####' line; null without either."""
    after = F.when(text.contains("####"), F.substring_index(text, "####", -1))
    parts = F.struct(last_box(text).alias("box"), last_box(after).alias("after"), last_hash_line(text).alias("hashed"))

    def chosen(p: Column) -> Column:
        later = F.when(p["hashed"].isNull(), p["box"].isNotNull()).otherwise(p["after"].isNotNull())
        boxed = F.struct(F.lit("boxed").alias("kind"), F.regexp_replace(p["box"], r"(?U)^\s+|\s+$", "").alias("content"))
        return F.when(later, boxed).when(p["hashed"].isNotNull(), F.struct(F.lit("hash").alias("kind"), payload(p["hashed"]).alias("content")))

    return _let(parts, chosen)


def payload(line: Column) -> Column:
    """A '####' line without one final point."""
    return F.regexp_replace(line, r"(?U)\s*\.$", "")


def canonical_decimal(number: Column) -> Column:
    """Canonical text of a decimal number in text; commas are dropped.  Null for anything else."""
    s = F.regexp_replace(number, ",", "")
    sign = F.when(s.startswith("-"), F.lit("-")).otherwise(F.lit(""))
    whole = F.regexp_replace(F.regexp_extract(s, r"^-?(\d*)", 1), r"^0+", "")
    part = F.regexp_replace(F.regexp_extract(s, r"\.(\d+)$", 1), r"0+$", "")
    body = F.concat(F.when(whole == "", F.lit("0")).otherwise(whole), F.when(part == "", F.lit("")).otherwise(F.concat(F.lit("."), part)))
    return F.when(s.rlike(r"^-?(\d+(\.\d+)?|\.\d+)$"), F.when(body == "0", body).otherwise(F.concat(sign, body)))


def extract_strict(text: Column) -> Column:
    """Canonical value of the selected marker if it is a plain number, else null."""
    return _let(ascii_digits(marker(text)["content"]), lambda c: F.when(c.rlike(STRICT), canonical_decimal(c)))


def canonical_gold(gold: Column) -> Column:
    """Canonical text of a gold answer: commas and spaces dropped, the Unicode minus and quotients read."""
    s = F.regexp_replace(ascii_digits(gold), r"(?U)[\s,]", "")
    return F.when(s.contains("/"), canonical_quotient(s)).otherwise(canonical_decimal(s))
