"""A join by key that does not gather the rows of a frequent key in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_KEYS = 2048


def looked_up(rows: DataFrame, table: DataFrame, key: str, size: str) -> DataFrame:
    """The inner join of two written tables by ``key``, unique in ``table``, whose ``size`` is the number of ``rows`` with that key.

    Fewer than HOT_KEYS keys can hold more than that part of the rows each; what the table has on these is broadcast, and their rows
    stay where they are. Null keys match nothing.
    """
    hot = F.col(size) > F.lit(rows.count() / HOT_KEYS)
    keys = [r[0] for r in table.filter(hot).select(key).collect()]
    if not keys:
        return rows.join(table.hint("merge"), key)
    often = F.col(key).isin(keys)
    rest = rows.filter(~often).join(table.filter(~hot).hint("merge"), key)
    return rows.filter(often).join(F.broadcast(table.filter(hot)), key).unionByName(rest)
