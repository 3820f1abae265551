"""Words and word shingles as columns.

A word is a maximal run of letters and digits of the lower-cased text, whatever
the script.  Everything here runs in the JVM; whole texts are used.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def words(text: Column) -> Column:
    """array<string>; empty for a null or wordless text."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)), F.array().cast("array<string>"))


def shingles(tokens: Column, k: int) -> Column:
    """The set of ``k``-word runs of an array of words, each as a 64-bit hash; empty if there are fewer than ``k`` words."""

    def runs(w: Column) -> Column:
        last = F.size(w) - F.lit(k)
        starts = F.when(last >= 0, F.sequence(F.lit(1), last + 1)).otherwise(F.array().cast("array<int>"))
        return F.array_distinct(F.transform(starts, lambda i: F.xxhash64(F.slice(w, i, F.lit(k)))))

    # the words are bound as a variable: else each run would take them from the text again
    return F.transform(F.array(tokens), runs)[0]
