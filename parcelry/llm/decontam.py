"""Benchmark decontamination by winnowed fingerprints.

Windows of ``window`` words are what counts as contamination. Of every ``window - gram + 1`` consecutive
grams (exactly one window) the one with the smallest hash is kept as a
fingerprint, in benchmark items and documents alike, so a shared window always shares
a fingerprint. An item shorter than a window is itself a window and its own fingerprint.

Documents keep only fingerprints that pass a bit table of the benchmark's fingerprints; its
size is fixed, it has no false negatives, and the join that follows removes false positives. Hits
are extended to the windows around them, which are compared by 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parcelry.operators.lookups import looked_up
from parcelry.sources.scratch import keep
from parcelry.llm.names import unused
from parcelry.llm.words import PLAIN, Words, first_minimum, slices

_OWN = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")
_TABLE_BITS = 25  # 4 MB

_ITEM = "kind string, size int, h1 long, h2 long, item string"
_HIT = "array<struct<fp: long, size: int, pos: int, h1: long, h2: long>>"
_WINDOW = ["h1", "h2", "size"]


def mark_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 10,
    gram: int = 6,
) -> DataFrame:
    """Mark the document words that lie inside any occurrence of a benchmark window.

    Words are runs of ASCII letters (A-Z lower-cased), digits and non-ASCII characters. A window is ``window``
    consecutive words of an item; an item with fewer words, but not none, is one window.
    Returns the columns of ``docs`` with ``n_words``, ``n_hit`` (words hit), ``n_items`` (items with an
    occurring window), ``items_sha256`` (of their ids, sorted as strings and joined by commas)
    and ``contaminated`` (``n_hit > 0``).

    Defined cases: null and empty texts have no words; an item without words never occurs;
    an item id that is null counts as one item named by the empty string; rows with the
    same item id are one item; repeated document rows are judged each for itself; without documents
    or items the result is empty or clean. Columns of ``docs`` named like an added one are
    replaced, all others stay, whatever their names.
    """
    if not 1 <= gram <= window:
        raise ValueError("gram must be between 1 and window")
    docs = docs.drop(*_OWN)
    row, hits_, names = unused(docs, "row", "hits", "names")
    docs = docs.withColumn(row, F.monotonically_increasing_id())
    at = docs.columns.index(text_col)
    items = keep(
        benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.col(item_text_col).alias("text"))
        .mapInArrow(lambda batches: _item_rows(batches, window, gram), _ITEM),
        "benchmark",
    )
    prints = keep(items.filter("kind = 'print'").select("size", F.col("h1").alias("fp")).distinct(), "prints")
    # Windows that occur in the same items share a set; 128 bits tell sets apart, so no window ever lists its items.
    held = items.filter("kind = 'window'").select(*_WINDOW, "item").distinct()
    marks = [F.bit_xor(F.xxhash64(F.lit(seed), "item")).alias(f"s{seed}") for seed in (1, 2)]
    windows = keep(held.groupBy(*_WINDOW).agg(*marks), "windows")
    one = windows.groupBy("s1", "s2").agg(F.min(F.struct(*_WINDOW)).alias("w")).select("s1", "s2", "w.*")
    sets = keep(one.join(held, _WINDOW).select("s1", "s2", "item"), "sets")
    short = sorted(r[0] for r in prints.filter("size > 0").select("size").distinct().collect())  # at most window - 1 numbers
    sent = docs.sparkSession.sparkContext.broadcast(_bit_table(prints))

    # Row numbers tie hits to their rows; writing the table down fixes them.
    schema = T.StructType([*docs.schema.fields, *T._parse_datatype_string(f"n_words long, {hits_} {_HIT}").fields])
    found = keep(docs.mapInArrow(lambda batches: _document_rows(batches, at, hits_, window, gram, short, sent.value), schema), "found")
    hits = found.select(F.col(row).alias("row"), F.inline(hits_)).join(prints, ["fp", "size"]).select("row", "pos", *_WINDOW).distinct()
    spans = keep(hits.join(windows, _WINDOW).select("row", "pos", "size", "s1", "s2"), "spans")
    # A size of 0 stands for the full window length.
    span = F.struct("pos", F.when(F.col("size") == 0, window).otherwise(F.col("size")).alias("n"))
    per_row = spans.groupBy("row").agg(_union_length(F.sort_array(F.collect_set(span))).alias("n_hit"))
    # Rows that hold the same sets share a combination of sets; only one row of each meets the items.
    combination = [F.bit_xor(F.xxhash64(F.lit(seed), "s1", "s2")).alias(f"c{seed}") for seed in (1, 2)]
    combined = keep(spans.select("row", "s1", "s2").distinct().groupBy("row").agg(*combination), "combined")
    shown = keep(combined.groupBy("c1", "c2").agg(F.min("row").alias("row"), F.count("*").alias("rows")), "shown")
    named = spans.join(shown, "row").select("c1", "c2", "rows", "s1", "s2").distinct().join(sets, ["s1", "s2"]).select("c1", "c2", "rows", "item").distinct()
    named = named.groupBy("c1", "c2").agg(F.max("rows").alias("rows"), F.count("*").alias("n_items"), F.sha2(F.array_join(F.sort_array(F.collect_list("item")), ","), 256).alias("names"))
    key = F.concat_ws(":", "c1", "c2").alias("key")
    named = keep(named.select(key, "rows", "n_items", "names"), "named")
    labelled = looked_up(combined.select("row", key), named, "key", "rows").select("row", "n_items", "names")
    per_row = per_row.join(labelled, "row").select(F.col("row").alias(row), "n_hit", "n_items", F.col("names").alias(names))
    n_hit = F.coalesce("n_hit", F.lit(0))
    return (
        found.drop(hits_)
        .join(per_row, row, "left")
        .withColumns(
            {
                "n_hit": n_hit.cast("long"),
                "n_items": F.coalesce("n_items", F.lit(0)).cast("long"),
                "items_sha256": F.coalesce(names, F.sha2(F.lit(""), 256)),
                "contaminated": n_hit > 0,
            }
        )
        .drop(row, names)
    )


def _union_length(spans: Column) -> Column:
    """The number of positions in sorted spans (pos, n) that may overlap."""
    step = lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0), s["pos"] + s["n"] - F.greatest(a["to"], s["pos"]))).cast("int").alias("n"), F.greatest(a["to"], s["pos"] + s["n"]).cast("int").alias("to"))
    return F.aggregate(spans, F.struct(F.lit(0).alias("n"), F.lit(0).alias("to")), step, lambda a: a["n"])


def _bit_table(prints: DataFrame) -> np.ndarray:
    """One bit per fingerprint, by its top bits. Partitions are combined in the cluster; only the table, of fixed size, comes back."""
    bits = prints.rdd.mapPartitions(lambda rows: [_bits_of(np.fromiter((r["fp"] for r in rows), np.int64).view(np.uint64))])
    return bits.treeReduce(np.bitwise_or) if bits.getNumPartitions() else _bits_of(np.zeros(0, np.uint64))


def _bits_of(fp: np.ndarray) -> np.ndarray:
    table = np.zeros(1 << (_TABLE_BITS - 3), np.uint8)
    at = fp >> np.uint64(64 - _TABLE_BITS)
    np.bitwise_or.at(table, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
    return table


def _passes(table: np.ndarray, fp: np.ndarray) -> np.ndarray:
    at = fp >> np.uint64(64 - _TABLE_BITS)
    return (table[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _winnowed(words: Words, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Gram hashes, and the positions that any full window of the text keeps."""
    grams = words.windows(gram)
    full = np.flatnonzero(words.fits(window))
    return grams, np.unique(first_minimum(grams, window - gram + 1)[full])


def _item_rows(batches: Iterator[pa.RecordBatch], window: int, gram: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            words = Words(part.column(1), PLAIN)
            names = np.array(part.column(0).to_pylist(), object)
            of, rows = words.text_of(), []
            grams, kept = _winnowed(words, window, gram)
            full = np.flatnonzero(words.fits(window))
            rows.append(("print", np.zeros(len(kept), np.int32), grams[kept], np.zeros(len(kept), np.uint64), names[of[kept]]))
            rows.append(("window", np.zeros(len(full), np.int32), words.windows(window)[full], words.windows(window, 1)[full], names[of[full]]))
            for n in np.unique(words.count[(words.count > 0) & (words.count < window)]):
                at = words.first[:-1][words.count == n]
                h1, h2 = words.windows(int(n))[at], words.windows(int(n), 1)[at]
                for kind in ("print", "window"):
                    rows.append((kind, np.full(len(at), n, np.int32), h1, h2, names[of[at]]))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([k for k, s, *_ in rows for _ in s], pa.string()),
                    pa.array(np.concatenate([r[1] for r in rows]), pa.int32()),
                    pa.array(np.concatenate([r[2] for r in rows]).view(np.int64)),
                    pa.array(np.concatenate([r[3] for r in rows]).view(np.int64)),
                    pa.array(np.concatenate([r[4] for r in rows]).tolist(), pa.string()),
                ],
                names=["kind", "size", "h1", "h2", "item"],
            )


def _document_rows(batches: Iterator[pa.RecordBatch], text_at: int, hits: str, window: int, gram: int, short: list[int], table: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Add the number of words, and a hit for every window around a fingerprint that passes the table."""
    for batch in batches:
        for part in slices(batch, batch.schema.names[text_at]):
            words = Words(part.column(text_at), PLAIN)
            grams, kept = _winnowed(words, window, gram)
            kept = kept[_passes(table, grams[kept])]
            of = words.text_of()
            first, last = words.first[of[kept]], words.first[of[kept] + 1]
            low, high = np.maximum(first, kept - (window - gram)), np.minimum(kept, last - window)
            around = high - low + 1
            pos = np.repeat(low - np.cumsum(around) + around, around) + np.arange(around.sum())
            found = [(pos, np.repeat(grams[kept], around), 0, window)]
            for n in short:
                h1 = words.windows(n)
                at = np.flatnonzero(words.fits(n) & _passes(table, h1))
                found.append((at, h1[at], n, n))
            pos = np.concatenate([f[0] for f in found]).astype(np.int64)
            order = np.argsort(pos, kind="stable")  # texts follow one another, so this brings each text's hits together
            columns = [
                np.concatenate([f[1] for f in found]).view(np.int64),
                np.concatenate([np.full(len(f[0]), f[2], np.int32) for f in found]),
                (pos - words.first[of[pos]]).astype(np.int32),
                *(np.concatenate([words.windows(f[3], seed)[f[0]] if len(f[0]) else np.zeros(0, np.uint64) for f in found]).view(np.int64) for seed in (0, 1)),
            ]
            structs = pa.StructArray.from_arrays([pa.array(c[order]) for c in columns], names=["fp", "size", "pos", "h1", "h2"])
            ends = pa.array(np.searchsorted(pos[order], words.first), pa.int32())
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(words.count, pa.int64()), pa.ListArray.from_arrays(ends, structs)], names=[*part.schema.names, "n_words", hits])
