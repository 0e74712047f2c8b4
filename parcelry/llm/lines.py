"""Removal of repeated lines by overlapping windows of consecutive lines, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelry.sources.scratch import keep
from parcelry.llm.names import unused

_OWN = ("n_lines", "n_removed", "kept_text")


def remove_repeated_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 3) -> DataFrame:
    """Remove the lines covered by any later occurrence of ``window`` consecutive lines.

    Lines are separated by a newline and compared unchanged, by 128 bits. The first occurrence of
    a window is the one with the smallest id (nulls last), then text hash, then position. Every
    other occurrence is a later one, also in the same document, and the lines it covers
    go, even those it shares with the first occurrence. Overlapping covers are merged. Returns the columns of ``docs`` with
    ``n_lines``, ``n_removed`` and ``kept_text`` (the other lines, joined by newlines).

    Defined cases: a null text has no lines and stays null; an empty text is one empty line; a text of fewer lines than
    the window stays whole; rows equal in id and text are one document and keep the same
    lines; an empty table gives an empty result. Columns of ``docs`` named like an added one are
    replaced, all others stay, whatever their names.
    """
    docs = docs.drop(*_OWN)
    id_, hash_, of, text_, at_, lines_, kept_ = helpers = unused(docs, "id", "hash", "of", "text", "at", "lines", "kept")
    docs = docs.withColumns({id_: F.col(id_col), hash_: F.xxhash64(text_col)})
    lines = F.split(text_col, "\n", -1)
    hashed = docs.select(
        F.col(id_).alias("__id"),
        F.col(hash_).alias("__hash"),
        F.transform(lines, lambda x: F.xxhash64(x)).alias("a"),
        F.transform(lines, lambda x: F.xxhash64(F.lit(window), x)).alias("b"),
    ).filter(F.size("a") >= window)
    starts = F.sequence(F.lit(0), F.size("a") - window)
    several = lambda c, i: F.xxhash64(*[F.col(c)[i + k] for k in range(window)])
    windows = hashed.select("__id", "__hash", F.explode(F.transform(starts, lambda i: F.struct(i.alias("pos"), several("a", i).alias("w1"), several("b", i).alias("w2")))).alias("w"))
    windows = keep(windows.select("__id", "__hash", "w.*"), "windows")
    place = F.struct(F.col("__id").isNull(), "__id", "__hash", "pos")
    repeated = keep(windows.groupBy("w1", "w2").agg(F.count("*").alias("n"), F.min(place).alias("first")).filter("n > 1").select("w1", "w2", "first"), "repeated")
    later = windows.join(repeated, ["w1", "w2"]).filter(place != F.col("first"))
    covers = later.groupBy(F.col("__id").alias(of), F.col("__hash").alias(text_)).agg(F.array_sort(F.collect_set("pos")).alias(at_))

    joined = docs.join(covers, docs[id_].eqNullSafe(covers[of]) & (docs[hash_] == covers[text_]), "left").withColumn(lines_, lines)
    kept = _outside(F.col(lines_), F.col(at_), window)
    out = joined.withColumn(kept_, F.when(F.col(at_).isNull(), F.col(lines_)).otherwise(kept)).withColumns(
        {
            "n_lines": F.coalesce(F.size(lines_), F.lit(0)).cast("long"),
            "n_removed": F.coalesce(F.size(lines_) - F.size(kept_), F.lit(0)).cast("long"),
            "kept_text": F.when(F.col(at_).isNull(), F.col(text_col)).otherwise(F.array_join(kept_, "\n")),
        }
    )
    return out.drop(*helpers)


def _outside(lines: Column, at: Column, window: int) -> Column:
    """The lines outside the windows that start at the sorted positions; covers that touch are merged first."""
    starts = F.filter(at, lambda p, i: (i == 0) | (p - at[i - 1] > window))
    ends = F.filter(at, lambda p, i: (i == F.size(at) - 1) | (F.get(at, i + 1) - p > window))
    begin = lambda i: F.when(i == 0, 0).otherwise(F.get(ends, i - 1) + window)
    end = lambda i: F.coalesce(F.get(starts, i), F.size(lines))
    return F.flatten(F.transform(F.sequence(F.lit(0), F.size(starts)), lambda i: F.slice(lines, begin(i) + 1, end(i) - begin(i))))
