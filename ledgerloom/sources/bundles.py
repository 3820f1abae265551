"""Result bundles: tables as CSV in one folder, and small ones as text."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_bundle(frames: dict[str, DataFrame], folder: str) -> None:
    """Each frame as CSV with a header under ``folder/name``, in one file: results are summaries."""
    for name, df in frames.items():
        df.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{folder}/{name}")


def render(df: DataFrame, kind: str = "md", digits: int = 3, most: int = 1000) -> str:
    """A small frame as a Markdown or LaTeX table; more than ``most`` rows are an error.  Nulls are dashes."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows are no table to read")
    cell = lambda v: "–" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v)
    body = [[cell(v) for v in row] for row in rows]
    if kind == "md":
        lines = [df.columns, ["-"] * len(df.columns), *body]
        return "\n".join("| " + " | ".join(x) + " |" for x in lines)
    if kind == "tex":
        head = f"\\begin{{tabular}}{{{'l' * len(df.columns)}}}\n" + " & ".join(c.replace("_", "\\_") for c in df.columns) + " \\\\ \\hline\n"
        return head + "\n".join(" & ".join(x).replace("_", "\\_") + " \\\\" for x in body) + "\n\\end{tabular}"
    raise ValueError(f"unknown kind {kind!r}")
