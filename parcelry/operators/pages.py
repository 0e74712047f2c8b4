"""Facts from stored HTML pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelry.functions.columns import found

# Possession phrases by priority.
POSSESSION = ("ready to move", "under construction", "possession by", "possession in", "ready for possession")


# How unit counts, registration ids, descriptions and titles are written, and how near the word an id must be.
UNITS = r"(?i)\b(\d{1,4})\s*(?:units|apartments|flats)\b"
REGISTRATION = r"\b[A-Z]{1,3}\d{10,13}\b"
META = r"(?is)<meta[^>]+name=[\"']description[\"'][^>]+content=[\"'](.*?)[\"']"
TITLE = r"(?is)<title[^>]*>(.*?)</title>"
WORD, BEFORE, BEHIND = "rera", 60, 10


def registration(page: Column) -> Column:
    """The first id with the word within 60 characters before it or 10 behind it.

    One pass over the words and ids of the page, which keeps the place reached, where the last word began, and the last id, for which only what comes next can
    be near enough behind it, because an id is longer than that.
    """
    seen = f"(?i:{WORD})|{REGISTRATION}"
    parts = F.zip_with(F.regexp_extract_all(page, F.lit(seen), 0), F.split(page, seen, -1), lambda x, gap: F.struct(x.alias("x"), F.length(gap).alias("gap")))
    none = F.lit(None).cast("string")

    def step(a: Column, part: Column) -> Column:
        start = a["at"] + part["gap"]
        end, is_word = start + F.length(part["x"]), F.length(part["x"]) == len(WORD)
        behind = is_word & (end <= a["at"] + BEHIND)
        own = ~is_word & (a["word"] >= start - BEFORE)
        return F.struct(
            end.alias("at"),
            F.when(is_word, start).otherwise(a["word"]).alias("word"),
            F.when(~is_word, part["x"]).otherwise(none).alias("id"),
            F.coalesce(a["found"], F.when(behind, a["id"]), F.when(own, part["x"])).alias("found"),
        )

    zero = F.struct(F.lit(0).alias("at"), F.lit(-1000).alias("word"), none.alias("id"), none.alias("found"))
    return F.aggregate(F.filter(parts, lambda p: p["x"].isNotNull()), zero, step, lambda a: a["found"])


def page_facts(df: DataFrame, html: str, keywords: Sequence[str] = POSSESSION) -> DataFrame:
    """Unit count, registration id, first possession keyword of the list, and the first 300 characters of the meta description, or of the title of pages without one."""
    page, low = F.col(html), F.lower(html)
    keyword = F.coalesce(*[F.when(low.contains(k), F.lit(k)) for k in keywords])
    outer = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    title = F.regexp_replace(F.regexp_extract(page, TITLE, 1), r"\s+", " ")
    text = F.when(page.rlike(META), outer(F.regexp_extract(page, META, 1))).when(page.rlike(TITLE), outer(title))
    return df.withColumns({"units": found(page, UNITS).cast("int"), "registration": registration(page), "possession": keyword, "description": F.left(text, F.lit(300))})


def extract_all(df: DataFrame, text: str, pattern: str, exclude: Sequence[str], limit: int, out: str) -> DataFrame:
    """The first ``limit`` matches that hold none of the excluded markers."""
    matches = F.regexp_extract_all(F.col(text), F.lit(pattern), 0)
    clean = F.filter(matches, lambda m: ~_holds_any(m, exclude))
    return df.withColumn(out, F.slice(clean, 1, limit))


def _holds_any(c: Column, words: Sequence[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(F.lower(c), F.lit(w))
    return out
