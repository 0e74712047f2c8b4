"""Best-fit packing of documents into sequences of several permitted lengths."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelry.sources.scratch import keep

_PACKED = "piece int, first_token long, n_tokens long, bin long, bin_size int, bin_offset long"


def sequence_cost(size: int) -> float:
    """Relative cost of a sequence: linear work, attention that grows with the square, and a fixed share."""
    return size + size * size / 32768 + 16


def pack_best_fit(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    sizes: tuple[int, ...] = (512, 1024, 2048, 4096),
    tokens: Column | None = None,
    cost: Callable[[int], float] = sequence_cost,
    group_pieces: int = 8192,
) -> DataFrame:
    """Pack documents into bins of the permitted ``sizes``, best fit by falling length.

    ``tokens`` is a document's length, by default its number of words (runs of non-space characters). Documents longer than the largest size are cut
    into pieces of that size and a rest. Pieces are dealt evenly into groups of about ``group_pieces``,
    each packed on its own: a piece goes into the open bin with the least room that holds it;
    if none does, a bin opens with the size whose cost per token is least when filled with what is
    still to come. At the end every bin shrinks to the smallest size that holds its contents.

    Returns ``id``, ``piece``, ``first_token``, ``n_tokens``, ``bin``, ``bin_size`` and ``bin_offset``, a row per piece.
    Texts never leave their task; only lengths move.

    Defined cases: a null, empty or negative length counts as 0, and such a document takes one row of 0 tokens
    in some bin; ids may be null or repeated, and each row is packed for itself; other
    columns are left out, whatever their names; an empty table gives an empty result.
    """
    sizes = tuple(sorted(set(sizes)))
    if not sizes or sizes[0] < 1:
        raise ValueError("sizes must be positive")
    length = F.regexp_count(text_col, F.lit(r"\S+")) if tokens is None else tokens
    rows = docs.select(F.col(id_col).alias("id"), F.greatest(F.coalesce(length, F.lit(0)), F.lit(0)).cast("long").alias("length"))
    last = F.greatest(F.ceil(F.col("length") / sizes[-1]) - 1, F.lit(0)).cast("int")
    pieces = rows.select("id", "length", F.explode(F.sequence(F.lit(0), last)).alias("piece"))
    first = F.col("piece").cast("long") * sizes[-1]
    pieces = pieces.select("id", "piece", first.alias("first_token"), F.least(F.col("length") - first, F.lit(sizes[-1])).alias("n_tokens"), F.monotonically_increasing_id().alias("row"))
    pieces = keep(pieces, "pieces")
    groups = max(1, -(-pieces.count() // group_pieces))
    dealt = pieces.withColumn("group", F.pmod(F.xxhash64("row"), F.lit(groups)))
    return dealt.groupBy("group").applyInArrow(lambda t: _pack_group(t, sizes, cost), f"id {dict(rows.dtypes)['id']}, {_PACKED}")


def _pack_group(t: pa.Table, sizes: tuple[int, ...], cost: Callable[[int], float]) -> pa.Table:
    t = t.sort_by([("n_tokens", "descending"), ("row", "ascending")])
    at, used = best_fit(t.column("n_tokens").to_pylist(), sizes, cost)
    group = int(t.column("group")[0].as_py()) if t.num_rows else 0
    n = np.array(t.column("n_tokens").to_pylist(), np.int64)
    final = np.array([next(s for s in sizes if s >= u) for u in used], np.int32)
    bins = np.array(at, np.int64)
    order = np.argsort(bins, kind="stable")
    before = np.cumsum(n[order]) - n[order]
    start = np.flatnonzero(np.r_[True, np.diff(bins[order]) > 0]) if len(bins) else np.zeros(0, np.int64)
    offset = np.empty(len(n), np.int64)
    offset[order] = before - np.repeat(before[start], np.diff(np.append(start, len(n))))
    own = [pa.array((group << 32) + bins), pa.array(final[bins]), pa.array(offset)]
    return pa.Table.from_arrays([*(t.column(c) for c in ("id", "piece", "first_token", "n_tokens")), *own], names=["id", "piece", "first_token", "n_tokens", "bin", "bin_size", "bin_offset"])


def best_fit(lengths: list[int], sizes: tuple[int, ...], cost: Callable[[int], float]) -> tuple[list[int], list[int]]:
    """The bin of each length (given in falling order) and the tokens in each bin.

    Sets of lengths and of rooms are kept as bits of one integer, so the next fitting one is found by bit operations.
    """
    waiting: dict[int, int] = {}
    for n in lengths:
        waiting[n] = waiting.get(n, 0) + 1
    present = sum(1 << n for n in waiting)
    room: dict[int, list[int]] = {}
    rooms, at, used = 0, [], []
    prices = {s: cost(s) for s in sizes}

    def filled(space: int) -> int:
        """Tokens that greedy filling with waiting pieces would put into a space."""
        left, took = space, {}
        options = present & ~1
        while options := options & ((1 << (left + 1)) - 1):
            n = options.bit_length() - 1
            copies = min(waiting[n] - took.get(n, 0), left // n)
            if copies:
                took[n] = took.get(n, 0) + copies
                left -= n * copies
            options &= ~(1 << n)
        return space - left

    for n in lengths:
        waiting[n] -= 1
        if not waiting[n]:
            present &= ~(1 << n)
        fitting = rooms >> n
        if fitting:
            space = n + (fitting & -fitting).bit_length() - 1
            bin_ = room[space].pop()
            if not room[space]:
                rooms &= ~(1 << space)
        else:
            space = min((s for s in sizes if s >= n), key=lambda s: prices[s] / max(1, n + filled(s - n)))
            bin_ = len(used)
            used.append(0)
        at.append(bin_)
        used[bin_] += n
        room.setdefault(space - n, []).append(bin_)
        rooms |= 1 << (space - n)
    return at, used
