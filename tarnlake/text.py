"""Results as text tables."""

from __future__ import annotations

from tarnlake.engine import Result

#: Characters of the widest column; longer values end in three dots.
WIDEST = 50


def cell(v: object) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, float) and v == v and abs(v) < 1e15 and v == int(v):
        return str(int(v))
    return str(v)


def format_result(r: Result, most: int | None = None) -> str:
    """The message of a statement, or the rows in padded columns and their number."""
    if r.df is None:
        return r.message
    rows = [[cell(v) for v in row] for row in r.rows(most)]
    columns = r.columns
    widths = [min(WIDEST, max([len(c), *(len(row[i]) for row in rows)])) for i, c in enumerate(columns)]

    def padded(values: list[str]) -> str:
        return " | ".join((v if len(v) <= WIDEST else v[: WIDEST - 3] + "...").ljust(w) for v, w in zip(values, widths, strict=True))

    lines = [" | ".join(c.ljust(w) for c, w in zip(columns, widths, strict=True)), "-+-".join("-" * w for w in widths), *map(padded, rows), f"({len(rows)} rows)"]
    return "\n".join(lines) + "\n"
