"""SQL of the queries that SQL can express on whole tables."""

from __future__ import annotations

_WORDS = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}]+')"


def _runs(source: str, keys: str, text: str, k: int) -> str:
    """The distinct k-word runs of a text, one row each."""
    run = " || ' ' || ".join(f"w[i + {j}]" for j in range(k))
    return f"SELECT DISTINCT {keys}, {run} AS g FROM (SELECT {keys}, w, unnest(range(1, len(w) - {k - 2})) AS i FROM (SELECT {keys}, {_WORDS.format(text)} AS w FROM ({source})))"


P1 = f"""
WITH s AS ({_runs("SELECT DISTINCT prompt_hash, text FROM prompts", "prompt_hash", "text", 3)}),
n AS (SELECT prompt_hash, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.prompt_hash AS hash_a, b.prompt_hash AS hash_b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.prompt_hash < b.prompt_hash GROUP BY 1, 2)
SELECT hash_a, hash_b FROM c JOIN n x ON x.prompt_hash = hash_a JOIN n y ON y.prompt_hash = hash_b WHERE 2 * c >= x.n + y.n - c
"""

_P1_SIMILAR = P1[: P1.index("SELECT hash_a, hash_b FROM c")].replace("WITH s AS", "WITH RECURSIVE s AS", 1)
P1_GROUPS = (
    _P1_SIMILAR
    + """, q AS (SELECT hash_a, hash_b, c = x.n AND c = y.n AS same FROM c JOIN n x ON x.prompt_hash = hash_a JOIN n y ON y.prompt_hash = hash_b WHERE 2 * c >= x.n + y.n - c),
e AS (SELECT hash_a AS x, hash_b AS y, same FROM q UNION ALL SELECT hash_b, hash_a, same FROM q), p AS (SELECT DISTINCT prompt_hash FROM prompts),
cl AS (SELECT prompt_hash, least(prompt_hash, coalesce(min(y) FILTER (same), prompt_hash)) AS class_first FROM p LEFT JOIN e ON x = prompt_hash GROUP BY 1),
ln AS (SELECT p.prompt_hash, count(DISTINCT k.class_first) FILTER (NOT same) AS n_links FROM p LEFT JOIN e ON x = p.prompt_hash LEFT JOIN cl k ON k.prompt_hash = y GROUP BY 1),
r AS (SELECT prompt_hash AS x, prompt_hash AS g FROM p UNION SELECT e.y, r.g FROM r JOIN e ON e.x = r.x), gr AS (SELECT x AS prompt_hash, min(g) AS group_first FROM r GROUP BY 1)
SELECT prompt_hash, class_first, n_links, group_first FROM cl JOIN ln USING (prompt_hash) JOIN gr USING (prompt_hash)"""
)

_P4_PART = """
{name} AS (
  SELECT a.split AS split_a, a.idx AS idx_a, b.split AS split_b, b.idx AS idx_b, count(*) AS c
  FROM {s} a JOIN {s} b ON a.g = b.g AND a.split <> 'train' AND b.split = 'train' GROUP BY 1, 2, 3, 4),
n{name} AS (SELECT split, idx, count(*) AS n FROM {s} GROUP BY 1, 2),
f{name} AS (
  SELECT split_a, idx_a, split_b, idx_b FROM {name} JOIN n{name} x ON x.split = split_a AND x.idx = idx_a
  JOIN n{name} y ON y.split = split_b AND y.idx = idx_b WHERE 10 * c >= 6 * (x.n + y.n - c))
"""
_P4 = f"""
WITH sq AS ({_runs("SELECT DISTINCT split, idx, question FROM items", "split, idx", "question", 2)}),
sa AS ({_runs("SELECT DISTINCT split, idx, answer_text FROM items", "split, idx", "answer_text", 2)}),
{_P4_PART.format(name="q", s="sq")}, {_P4_PART.format(name="a", s="sa")},
found AS (SELECT * FROM fq UNION SELECT * FROM fa)
"""
P4 = _P4 + "SELECT split_a, idx_a, split_b, idx_b FROM found"
P4_REPORT = (
    _P4
    + """, i AS (SELECT split, idx, min(source) AS source FROM items WHERE split <> 'train' GROUP BY 1, 2),
p AS (SELECT split_a AS split, idx_a AS idx, count(*) AS pairs FROM found GROUP BY 1, 2)
SELECT split, source, count(*) AS n_items, count(pairs) AS n_overlapping, CAST(coalesce(sum(pairs), 0) AS BIGINT) AS n_pairs
FROM i LEFT JOIN p USING (split, idx) GROUP BY 1, 2"""
)

_P5 = f"""
WITH i AS (
  {_runs("SELECT DISTINCT split, idx, question FROM items WHERE split <> 'train'", "split, idx", "question", 13)}
  UNION {_runs("SELECT DISTINCT split, idx, answer_text FROM items WHERE split <> 'train'", "split, idx", "answer_text", 13)}),
d AS ({_runs("SELECT doc_id, text FROM documents", "doc_id", "text", 13)}),
leaks AS (SELECT DISTINCT doc_id, split, idx FROM d JOIN i USING (g))
"""
P5 = _P5 + "SELECT doc_id, split, idx FROM leaks"
P5_ITEMS = (
    _P5
    + """, s AS (SELECT doc_id, min(source) AS source FROM documents GROUP BY 1)
SELECT split, idx, source, count(DISTINCT doc_id) AS n_documents FROM leaks JOIN s USING (doc_id) GROUP BY 1, 2, 3"""
)


def oracle_sql() -> dict[str, str]:
    return {"p1_found": P1, "p1_groups": P1_GROUPS, "p4_found": P4, "p4_report": P4_REPORT, "p5_found": P5, "p5_leaked_items": P5_ITEMS}
