"""Names for helper columns that cannot clash with those of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names behind as many underscores as no column of the table starts one of them with, in whatever case."""
    taken, front = {c.lower() for c in df.columns}, "__"
    while any((front + n).lower() in taken for n in names):
        front += "_"
    return [front + n for n in names]
