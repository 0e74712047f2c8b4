"""Prefix filters: rows that can be similar enough share one of their first tokens, rarest first, so that a join by token finds them all.

Two sets of sizes a and b with at least k tokens in common share one of the first a - k + 1 and b - k + 1 in any fixed order. How many they need in
common follows from the sizes, so rows are posted once for each band of partner sizes, under the pair of bands.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator, Sequence
from functools import lru_cache
from math import ceil

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COMMON = 2048
# Bands of sizes, each about 1.2 times as wide as the one before.
_BANDS = sorted({int(1.2**k) for k in range(114)})


def common_tokens(tokens: DataFrame) -> dict[str, int]:
    """How often the frequent ones of a column of tokens occur: those with more than one in COMMON of all, so fewer than that many."""
    counts = tokens.toDF("token").groupBy("token").agg(F.count("*").alias("n"))
    least = (counts.agg(F.sum("n")).head()[0] or 0) / COMMON
    return {r["token"]: r["n"] for r in counts.filter(F.col("n") > F.lit(least)).collect()}


def ordered(tokens: Sequence[str], common: dict[str, int]) -> list[str]:
    """Rare tokens first, in the order of their hashes, then frequent ones by their counts."""
    return sorted(tokens, key=lambda t: (common.get(t, 0), xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass")), t))


def token_hash(*parts: str) -> int:
    return xxhash.xxh64_intdigest("\0".join(parts).encode("utf-8", "surrogatepass")) - (1 << 63)


def band(n: int) -> int:
    return bisect_right(_BANDS, n) - 1


def band_range(j: int) -> tuple[int, int]:
    """The smallest and largest size of a band."""
    return _BANDS[j], _BANDS[j + 1] - 1


def partner_bands(low: float, high: float) -> range:
    """The bands of sizes from low to high."""
    return range(band(max(1, ceil(low - 1e-9))), band(max(1, int(high + 1e-9))) + 1)


def set_posts(words: Sequence[str], threshold: float) -> Iterator[tuple[str, str]]:
    """(pair of bands, token) of a set in order, for Jaccard similarity of at least the threshold."""
    n, share = len(words), threshold / (1 + threshold)
    for j in partner_bands(threshold * n, n / threshold) if n else ():
        needed = ceil(share * (n + max(band_range(j)[0], threshold * n)) - 1e-9)
        low, high = sorted((band(n), j))
        for w in words[: max(0, n - needed + 1)]:
            yield f"{low}-{high}", w


def _kept_pairs(a: int, low: float, high: float, cutoff: float) -> float:
    """How many of the a - 1 letter pairs of a name at least occur in a match with a length from low to high.

    In a match of lengths a and b, at least m = cutoff * (a + b) / 2 letters correspond in order. A letter without partner breaks two letter pairs of its
    name, and one of the other between two that have partners breaks one.
    """
    broken = lambda b: 2 * (a - cutoff * (a + b) / 2) + b - cutoff * (a + b) / 2
    return a - 1 - max(broken(low), broken(high))


def _partners(a: int, j: int, cutoff: float) -> tuple[float, float]:
    low, high = band_range(j)
    return max(low, a * cutoff / (2 - cutoff) - 1e-9), min(high, a * (2 - cutoff) / cutoff + 1e-9)


@lru_cache(maxsize=None)
def _by_pairs(i: int, j: int, cutoff: float) -> bool:
    """Whether every match between names of two bands has a letter pair in common."""

    def all_keep(own: int, other: int) -> bool:
        low, high = band_range(own)
        ends = [(a, *_partners(a, other, cutoff)) for a in range(low, min(high, low + 4096) + 1)]
        return all(_kept_pairs(a, x, y, cutoff) >= 1 for a, x, y in ends if x <= y)

    return low_enough(i, j) and all_keep(i, j) and all_keep(j, i)


def low_enough(i: int, j: int) -> bool:
    """Bands whose sizes are listed one by one above."""
    return max(band_range(i)[1], band_range(j)[1]) <= 4096


def numbered_tokens(tokens: Sequence[str]) -> list[str]:
    """Each token with its number among equal ones before it, so that a bag becomes a set."""
    seen: dict[str, int] = {}
    out = []
    for t in tokens:
        seen[t] = seen.get(t, 0) + 1
        out.append(f"{t}\1{seen[t]}")
    return out


def name_posts(name: str, cutoff: float, common: dict[str, int]) -> Iterator[tuple[str, str]]:
    """(pair of bands, token) of a name, for edit similarity or difflib's ratio of at least the cutoff.

    Tokens are pairs of letters where every match has one in common, else single letters.
    """
    a = len(name)
    pairs = ordered(numbered_tokens([name[k : k + 2] for k in range(a - 1)]), common)
    letters = ordered(numbered_tokens(list(name)), common)
    for j in partner_bands(a * cutoff / (2 - cutoff), a * (2 - cutoff) / cutoff):
        low, high = _partners(a, j, cutoff)
        bands = "-".join(map(str, sorted((band(a), j))))
        if low > high + 2e-9:
            continue
        if _by_pairs(*sorted((band(a), j)), cutoff):
            needed, tokens = ceil(_kept_pairs(a, low, high, cutoff) - 1e-9), pairs
        else:
            needed, tokens = ceil(cutoff * (a + low) / 2 - 1e-9), letters
        for t in tokens[: max(0, len(tokens) - needed + 1)]:
            yield bands, t

