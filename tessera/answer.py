"""Answers in words from small results."""

from __future__ import annotations

from pyspark.sql import DataFrame

from .operators.relational import compact
from .provider import Provider

NAMES = {"count": "Count", "avg": "Average", "sum": "Total", "min": "Minimum", "max": "Maximum", "result": "Result"}


def shown(value: object) -> str:
    if isinstance(value, float):
        value = round(value, 2)
        return str(int(value)) if value == int(value) else str(value)
    return str(value)


def answer(question: str, df: DataFrame, rows: int = 10, columns: int = 4, provider: Provider | None = None) -> str:
    """A sentence for one row, else the first rows; at most ``rows`` + 1 rows reach the driver, and a count if there are more.

    A provider that writes text is given the question and twenty rows; the template stays if it fails.
    """
    df = compact(df)
    if provider is not None:
        try:
            return provider.complete(f"Answer from these rows alone.\nQuestion: {question}\nRows: {[r.asDict() for r in df.limit(20).collect()]}")
        except Exception:  # noqa: BLE001  the template needs no model
            pass
    got = [r.asDict() for r in df.limit(rows + 1).collect()]
    if not got:
        return f"No results found for: {question}"
    if len(got) == 1:
        parts = []
        for name, value in got[0].items():
            fn, _, column = name.partition("_")
            parts.append(f"{NAMES[fn]}{' ' + column if column else ''}: {shown(value)}" if fn in NAMES else f"{name}: {shown(value)}")
        return "; ".join(parts)
    total = len(got) if len(got) <= rows else df.count()
    lines = [f"Found {total} results:"] + [f"  {i}. " + ", ".join(f"{k}={shown(v)}" for k, v in list(r.items())[:columns]) for i, r in enumerate(got[:rows], 1)]
    return "\n".join(lines + ([f"  ... and {total - rows} more rows"] if total > rows else []))
