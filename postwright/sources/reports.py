"""Markdown reports of small result tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

MISSING = "…"


def cell(value, digits: int = 4) -> str:
    if value is None or value != value:
        return MISSING
    return f"{value:.{digits}f}" if isinstance(value, float) else str(value)


def with_interval(value, low, high, excludes_zero: bool | None = None, digits: int = 4) -> str:
    """``+0.0511 [0.0302, 0.0720]*``: a star where the interval leaves zero out."""
    if value is None:
        return MISSING
    return f"{value:+.{digits}f} [{low:.{digits}f}, {high:.{digits}f}]" + "*" * bool(excludes_zero)


def markdown(rows: Sequence[Sequence], header: Sequence[str]) -> str:
    lines = [header, ["---"] * len(header), *[[x if isinstance(x, str) else cell(x) for x in r] for r in rows]]
    return "\n".join("| " + " | ".join(map(str, x)) + " |" for x in lines) + "\n"


def report(result: DataFrame, at_most: int = 1000) -> str:
    """A result table as markdown; it is small by nature, and cut with a note where it is not."""
    rows = result.limit(at_most + 1).collect()
    text = markdown([list(r) for r in rows[:at_most]], result.columns)
    return text + f"(the first {at_most} rows)\n" * (len(rows) > at_most)
