"""Shards of near-equal bytes by histogram sort.

Rows are ordered by a 192-bit key: a hash of the text, a hash of the id, and, only for rows of a key that repeats beyond what a
splitter tolerates, a hash of a row number. Rounds of probes cut the
key space into ever finer bins where a splitter or too much data lies, and count exact bytes and rows of each bin across all
partitions; only these counts, of bounded number, reach the driver. Once the splitters are known, rows
move once. Equal texts have neighbouring keys and stay in one shard unless the group is
too large for that.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass
from math import ceil, log2

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parcelry.sources.scratch import keep
from parcelry.llm.names import unused

_FIRST_BITS, _MOST_BITS, _ROUND_BITS = (12, 17), 18, 8
_WORD, _KEY_BITS = 64, 192
_SIGN = -(1 << 63)
_OWN = ("size", "shard", "slot")
_KEYS = ("k1", "k2", "k3")
_KEY = "struct<k1: long, k2: long, k3: long>"


@dataclass
class Bin:
    """An interval of keys that starts at ``key`` and spans ``bits`` low bits, with the exact totals below it and in it."""

    key: int
    bits: int
    bytes_below: int
    rows_below: int
    bytes: int
    rows: int
    same: int  # leading words of the key (0 to 3) that all its rows share

    @property
    def end(self) -> int:
        return self.key + (1 << self.bits)


@dataclass
class Piece:
    """Rows from ``key`` on, up to the next piece; ``before`` rows of its shard come earlier."""

    key: int
    shard: int
    before: int


def shard_by_bytes(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    shards: int = 24,
    row_bytes: int = 8,
    tolerance: float = 0.001,
    keep_group: float = 0.1,
    piece_bytes: int = 8 << 20,
) -> DataFrame:
    """Deal the rows into ``shards`` of near-equal bytes, in key order.

    A row's size is the UTF-8 bytes of its text plus ``row_bytes``. Every splitter lies within ``tolerance`` of a shard's
    share of its target, or at the end of a row or of a group of equal texts of up to
    ``keep_group`` of a share that is nearest: such a group stays in one shard, which may cost half its bytes on either side. Larger groups
    are divided, because shards could not be near equal otherwise. Returns the columns of ``docs`` with ``size``, ``shard`` (from 0) and ``slot`` (place in
    the shard in key order, gapless from 0). A task sorts pieces of about ``piece_bytes``, or of a 32,768th of all bytes if that is more.

    Defined cases: a null text counts as empty; null ids are one id; rows equal in id and text are divided like any others, in
    any order; with fewer rows than shards some shards stay empty; an empty table gives an empty
    result. Columns of ``docs`` named like an added one are replaced, all others stay, whatever their names.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = docs.drop(*_OWN)
    k1, k2, k3, bin_, piece, base, cuts, at, before = helpers = unused(docs, *_KEYS, "bin", "piece", "base", "cuts", "at", "before")
    keyed = docs.withColumns({"size": (F.octet_length(text) + row_bytes).cast("long"), k1: F.xxhash64(text), k2: F.xxhash64(id_col)})
    keys = keep(keyed.select(F.col(k1).alias("k1"), F.col(k2).alias("k2"), F.lit(0).cast("long").alias("k3"), "size"), "keys")
    total = keys.agg(F.sum("size")).collect()[0][0] or 0
    bits = min(max(ceil(log2(max(total / piece_bytes, 1))) + 2, _FIRST_BITS[0]), _FIRST_BITS[1])
    most = max(piece_bytes, 4 * total >> bits)

    # At most shards / tolerance or 32,768 keys are that large, whatever the input.
    limit = min(tolerance * total / shards, most)
    large = keys.groupBy("k1", "k2").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).filter((F.col("rows") > 1) & (F.col("bytes") > limit))
    large = keep(large.select("k1", "k2"), "large")
    if large.head(1):
        named = F.broadcast(large.select(F.col("k1").alias(k1), F.col("k2").alias(k2)))
        # Writing the rows down fixes their numbers.
        numbered = keep(keyed.join(named, [k1, k2], "left_semi").withColumn(k3, F.xxhash64(F.monotonically_increasing_id())), "repeated")
        keyed = keyed.join(named, [k1, k2], "left_anti").withColumn(k3, F.lit(0).cast("long")).unionByName(numbered)
        more = numbered.select(F.col(k1).alias("k1"), F.col(k2).alias("k2"), F.col(k3).alias("k3"), "size")
        keys = keep(keys.join(F.broadcast(large), ["k1", "k2"], "left_anti").select(*_KEYS, "size").unionByName(more), "keys")
    else:
        keyed = keyed.withColumn(k3, F.lit(0).cast("long"))

    pieces = cut_pieces(keys, shards, total, bits, most, tolerance, keep_group)
    by_bin, by_piece = _tables(spark, pieces, bits)
    by_bin, by_piece = by_bin.toDF(bin_, base, cuts), by_piece.toDF(piece, "shard", before)

    # Both tables follow the numbers of first-round bins and pieces, at most some 2 ** 17 of each.
    placed = keyed.withColumn(bin_, _prefix(F.col(k1), bits)).join(F.broadcast(by_bin), bin_)
    own = F.struct(F.col(k1).alias("k1"), F.col(k2).alias("k2"), F.col(k3).alias("k3"))
    placed = placed.withColumn(piece, F.col(base) + F.size(F.filter(cuts, lambda c: c <= own)))
    order = Window.partitionBy(piece).orderBy(k1, k2, k3)
    numbered = placed.drop(bin_, base, cuts).withColumn(at, F.row_number().over(order)).join(F.broadcast(by_piece), piece)
    return numbered.withColumn("slot", F.col(before) + F.col(at) - 1).drop(*helpers)


def _prefix(key: F.Column, bits: int) -> F.Column:
    """The top bits of a signed long, in the order of its values."""
    return F.shiftrightunsigned(key.bitwiseXOR(F.lit(_SIGN)), _WORD - bits).cast("long")


def _top(bits: int) -> F.Column:
    """The top bits of the whole key, as its leading words."""
    words = []
    for i, name in enumerate(_KEYS):
        n = min(max(bits - i * _WORD, 0), _WORD)
        words.append((F.lit(0).cast("long") if not n else _prefix(F.col(name), n)).alias(name))
    return F.struct(*words)


def _words(prefix: int, bits: int) -> tuple[int, ...]:
    """A prefix as _top gives it."""
    full = prefix << (_KEY_BITS - bits)
    words = []
    for i in range(3):
        n = min(max(bits - i * _WORD, 0), _WORD)
        word = (full >> (_KEY_BITS - (i + 1) * _WORD)) % (1 << _WORD)
        words.append(_signed(word >> (_WORD - n) if n else 0))
    return tuple(words)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _count(keys: DataFrame, bits: int, within: tuple[int, list[int]] | None = None) -> list[tuple[int, int, int, int]]:
    """(prefix, bytes, rows, words that all rows share) of the bins of ``bits`` bits, in order; ``within``: inside these bins of so many bits only."""
    if within:
        n, open_bins = within
        wanted = keys.sparkSession.createDataFrame([(_words(p, n),) for p in open_bins], f"within {_KEY}")
        keys = keys.withColumn("within", _top(n)).join(F.broadcast(wanted), "within")
    one = [F.min(k) == F.max(k) for k in _KEYS]
    same = F.when(one[0] & one[1] & one[2], 3).when(one[0] & one[1], 2).when(one[0], 1).otherwise(0)
    found = keys.groupBy(_top(bits).alias("p")).agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"), same.alias("same")).collect()

    def prefix(p) -> int:
        full = 0
        for i, name in enumerate(_KEYS):
            n = min(max(bits - i * _WORD, 0), _WORD)
            full = (full << n) | (p[name] % (1 << _WORD) if n else 0)
        return full

    return sorted((prefix(r["p"]), r["bytes"], r["rows"], r["same"]) for r in found)


def _chain(counts: list, bits: int, bytes_below: int, rows_below: int) -> list[Bin]:
    out = []
    for prefix, size, count, same in counts:
        out.append(Bin(prefix << (_KEY_BITS - bits), _KEY_BITS - bits, bytes_below, rows_below, size, count, same))
        bytes_below, rows_below = bytes_below + size, rows_below + count
    return out


def cut_pieces(keys: DataFrame, shards: int, total: int, bits: int, most: int, tolerance: float, keep_group: float) -> list[Piece]:
    """Probe until every splitter meets the tolerance and no bin that can be divided holds more than ``most`` bytes; then the pieces in key order."""
    bins = _chain(_count(keys, bits), bits, 0, 0)
    if not bins:
        return [Piece(0, 0, 0)]
    share = total / shards
    splitters: dict[int, int] = {}  # of each shard but the first, its first key

    def probe(leaves: list[Bin]) -> list[Bin]:
        """Settle the splitters that an edge of a bin serves; the bins to divide."""
        ends, wanted = [b.bytes_below + b.bytes for b in leaves], {}
        for shard in range(1, shards):
            if shard in splitters:
                continue
            want = share * shard
            b = leaves[min(bisect_right(ends, want), len(leaves) - 1)]
            low, high = abs(want - b.bytes_below), abs(b.bytes_below + b.bytes - want)
            # From 128 open bits on, a bin of one text holds all of its rows.
            whole = b.rows == 1 or b.same == 3 or (b.same >= 1 and b.bits >= 2 * _WORD and b.bytes <= keep_group * share)
            if min(low, high) <= tolerance * share or whole:
                splitters[shard] = b.end if high < low else b.key
            else:
                wanted[b.key] = b
        wanted |= {b.key: b for b in leaves if b.bytes > most and b.rows > 1 and b.same < 3}
        return list(wanted.values())

    while todo := probe(bins):
        step = max(1, min(_ROUND_BITS, _MOST_BITS - ceil(log2(len(todo)))))
        alike: dict[tuple[int, int], list[Bin]] = {}
        for b in todo:
            # Words that all its rows share have nothing to find.
            at = _KEY_BITS - b.bits
            alike.setdefault((at, max(at, b.same * _WORD)), []).append(b)
        children: dict[int, list[Bin]] = {}
        for (at, known), here in alike.items():
            finer = min(known + step, (known // _WORD + 1) * _WORD)  # a step does not cross from one word into the next
            inside = {b.key >> (_KEY_BITS - at): b for b in here}
            counted: dict[int, list] = {}
            for c in _count(keys, finer, (at, list(inside))):
                counted.setdefault(c[0] >> (finer - at), []).append(c)
            for prefix, b in inside.items():
                children[b.key] = _chain(counted[prefix], finer, b.bytes_below, b.rows_below)
        bins = [x for b in bins for x in children.get(b.key, [b])]

    starts = sorted(splitters.values())  # a row larger than a share may leave a shard empty
    pieces, held = [], 0
    shard, first_row = 0, 0
    for b in bins:
        to = bisect_right(starts, b.key)
        if not pieces or to > shard or held + b.bytes > most:
            if to > shard or not pieces:
                shard, first_row = to, b.rows_below
            pieces.append(Piece(b.key, shard, b.rows_below - first_row))
            held = 0
        held += b.bytes
    pieces[0].key = 0
    return pieces


def _tables(spark: SparkSession, pieces: list[Piece], bits: int) -> tuple[DataFrame, DataFrame]:
    """Per first-round bin the last piece that starts at or before it and the starts inside; per piece its shard and the shard's rows before it."""
    keys = [p.key for p in pieces]
    shift = _KEY_BITS - bits
    triple = lambda k: tuple(((k >> (_WORD * i)) % (1 << _WORD)) - (1 << 63) for i in (2, 1, 0))
    bins = []
    for b in range(1 << bits):
        lo, hi = bisect_right(keys, b << shift), bisect_right(keys, ((b + 1) << shift) - 1)
        bins.append((b, lo - 1, [triple(k) for k in keys[lo:hi]]))
    return (
        spark.createDataFrame(bins, f"bin long, base int, cuts array<{_KEY}>"),
        spark.createDataFrame([(i, p.shard, p.before) for i, p in enumerate(pieces)], "piece int, shard int, before long"),
    )
