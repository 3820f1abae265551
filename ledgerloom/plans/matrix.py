"""A full measurement matrix over the held-out test items.

The stored log samples the matrix sparsely, so the paired analyses run on a
deterministic one: every item of split ``test``, three seeds, rounds 0..11, every
prompt slot k at every round r >= k, two decodings, two extractors.  Outcomes come
from integer hashes only, so that any SQL engine gives the same.

``SCORES`` is SQL with H(...) for the 32-bit hash; ``sql`` writes it for Spark.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.lineage import cut
from ledgerloom.plans.protocol import SCHEDULE, STORAGE_ENV as STORAGE
from ledgerloom.sources.tables import table

__all__ = ["ENVS", "PHYSICAL", "R", "SCHEDULE", "SCORES", "SEEDS", "STORAGE", "duck", "environments", "packed", "scores", "spark_sql", "trajectory"]

SEEDS, R = 3, 11
ENVS = (("E1", "greedy", "v1"), ("E2", "t02", "v1"), ("E3", "greedy", "v2"), ("E4", "t02", "v2"))
#: Ages at which a greedy output was really generated again.
PHYSICAL = (1, 3, 5, 10)


def _values(name: str, rows: list[tuple], columns: str) -> str:
    cells = ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in row) + ")" for row in rows)
    return f"{name} AS (SELECT * FROM (VALUES {cells}) AS t({columns}))"


_SPINE = ",\n".join(
    [
        _values("sd", [(s,) for s in range(SEEDS)], "seed"),
        _values("rd", [(r,) for r in range(R + 1)], "draw"),
        _values("sk", [(k,) for k in range(R + 1)], "slot"),
        _values("envs", list(ENVS), "env, decoding, extractor"),
        _values("dec", [("greedy",), ("t02",)], "decoding"),
    ]
)
SCORES = f"""{_SPINE},
it AS (SELECT DISTINCT idx AS item FROM items WHERE split = 'test' AND idx IS NOT NULL),
sq AS (SELECT seed, slot, 450 + H('q|' || CASE WHEN slot = 0 THEN 0 ELSE seed END || '|' || slot) % 300 AS q FROM sd CROSS JOIN sk),
di AS (SELECT item, H('d|' || item) % 1000 AS difficulty FROM it),
fm AS (SELECT slot, item, CASE WHEN H('f|' || slot || '|' || item) % 10 < 8 THEN 1 ELSE 0 END AS strict FROM sk CROSS JOIN it),
cl AS (
  SELECT seed, decoding, slot, 'round' AS draw_kind, draw, item, decoding = 'greedy' AND draw - slot IN {PHYSICAL} AS physical
  FROM sd CROSS JOIN dec CROSS JOIN sk CROSS JOIN rd CROSS JOIN it WHERE slot <= draw
  UNION ALL SELECT seed, 't02', slot, 'gt', 0, item, false FROM sd CROSS JOIN sk CROSS JOIN it),
no AS (
  SELECT *, H('n|' || seed || '|' || decoding || '|' || slot || '|' || draw_kind || '|' || draw || '|' || item) AS h FROM cl),
so AS (
  SELECT n.*, CASE WHEN decoding = 't02' AND h % 23 = 0 THEN 1 ELSE 0 END AS truncated,
    CASE WHEN q + CASE WHEN decoding = 't02' THEN h % 200 - 100 WHEN physical THEN h % 40 - 20 ELSE 0 END > difficulty THEN 1 ELSE 0 END AS solved, strict
  FROM no n JOIN sq USING (seed, slot) JOIN di USING (item) JOIN fm USING (slot, item)),
sc AS (
  SELECT seed, decoding, slot, draw_kind, draw, item, physical, truncated,
    CASE WHEN decoding = 'greedy' AND NOT physical THEN -1 ELSE draw END AS generation,
    solved * (1 - truncated) AS v2, solved * (1 - truncated) * strict AS v1
  FROM so),
tj AS (
  SELECT seed, draw AS t, CASE WHEN draw > 0 AND H('adv|' || seed || '|' || draw) % 3 = 0 THEN 1 ELSE 0 END AS advanced FROM sd CROSS JOIN rd),
tr AS (
  SELECT seed, t, advanced, coalesce(max(CASE WHEN advanced = 1 THEN t END) OVER (PARTITION BY seed ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS inc_slot
  FROM tj)"""


def _calls(text: str, write) -> str:
    """Writes every H(...) with ``write``; parentheses inside are balanced."""
    out, at = [], 0
    for m in re.finditer(r"\bH\(", text):
        depth, i = 1, m.end()
        while depth:
            depth += {"(": 1, ")": -1}.get(text[i], 0)
            i += 1
        out += [text[at : m.start()], write(text[m.end() : i - 1])]
        at = i
    return "".join([*out, text[at:]])


def duck(text: str) -> str:
    return _calls(text, lambda x: f"CAST('0x' || substr(sha256({x}), 1, 8) AS BIGINT)")


def spark_sql(text: str) -> str:
    return _calls(text, lambda x: f"CAST(conv(substr(sha2({x}, 256), 1, 8), 16, 10) AS BIGINT)")


def scores(spark: SparkSession, d: str) -> DataFrame:
    """(seed, decoding, slot, draw_kind, draw, item, physical, truncated, generation, v1, v2)."""
    return spark.sql(spark_sql(f"WITH {SCORES} SELECT * FROM sc").replace("FROM items ", "FROM {items} "), items=table(spark, d, "items", "split", "idx"))


def trajectory(spark: SparkSession, d: str) -> DataFrame:
    """(seed, t, advanced, inc_slot)."""
    head = SCORES[: SCORES.index("it AS (")]
    tail = SCORES[SCORES.index("tj AS (") :]
    return spark.sql(spark_sql(f"WITH {head}{tail} SELECT * FROM tr"))


def environments(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(ENVS), "env string, decoding string, extractor string")


#: Items whose outcomes share one bigint.
WORD = 63


def packed(rows: DataFrame) -> DataFrame:
    """Cells in bit form, one row for each cell and block of items: masks of the items seen (p), correct under each extractor (v1, v2) and truncated, and the outputs (gens).

    Comparing two cells is then a bit operation on a sixty-third of the rows.  Written
    to the shared folder, as analyses read it several times.
    """
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(F.col("item"), F.lit(WORD)).cast("int"))
    mask = lambda c: F.bit_or(F.when(F.col(c) == 1, bit).otherwise(F.lit(0).cast("bigint"))).alias(c)
    cells = rows.groupBy("seed", "decoding", "slot", "draw_kind", "draw", F.floor(F.col("item") / WORD).alias("block"))
    gens = F.array_sort(F.collect_set(F.struct(F.col("item").cast("int").alias("item"), F.col("generation").cast("bigint").alias("generation")))).alias("gens")  # at most WORD of them
    return cut(cells.agg(F.bit_or(bit).alias("p"), mask("v1"), mask("v2"), mask("truncated"), F.bool_or("physical").alias("physical"), gens))
