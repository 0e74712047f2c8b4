"""Removal of passages that repeat anywhere in a corpus, by level-wise doubling of windows.

Levels are a quarter of the wanted length, half of it (both rounded up), the wanted length, and on request twice, four times, ...
that. Every window of the wanted length contains several of half of it, and the one that starts with the smallest hash
of the first level's length stands for it: equal windows choose equal representatives, so about a tenth of
all places suffice and none of the repeats is lost. Representatives that repeat at the first length alone are extended to
the second, and windows whose representative repeats there to the wanted length, where they are compared by 128 bits.

Windows that repeat at the wanted length decide what goes, and they alone go on to twice that length, and so on until no
candidate survives. What goes on are representatives again: of the windows of L words inside each window of 2 L words, the one
that starts with the smallest hash. Whoever represents 2 L represents L too, so levels are nested, and they hold a
falling share of all places, about 2 / L each on random words. Hashes of all levels are taken in one reading of the texts; a
level then asks only about those whose window of half its length repeats.

With ``extend`` all windows go on instead of representatives: a window of 2 L words is two repeating ones side by side, so
its hash comes from theirs and texts are not read again.

Rows are packed into compressed chunks. A chunk sends each distinct window
hash once, with a mark when the chunk itself holds it twice, so a passage that sits in a third of
all documents reaches a bucket at most once per chunk. Buckets answer with one bit per hash. Their number follows the bytes of all texts, and
chunks grow with it, so neither a bucket nor the slices that a chunk sends become too large or too small.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parcelry.sources.scratch import discard, keep, partitions
from parcelry.llm.words import SPACED, Words, covered, first_minimum, paired_hash, slices

_ASKED = "level int, bucket int, chunk long, key1 binary, key2 binary, twice binary"
_ANSWER = "level int, bucket int, chunk long, some boolean, bits binary"
_STATE = "chunk long, level int, pos binary, doc binary, h1 binary, h2 binary"
_BUCKET_BYTES, _SLICE_BYTES, _CHUNK_BYTES = 64 << 20, 2 << 10, (1 << 20, 32 << 20)
_DOCS, _ANCHORED = -1, -2  # the buckets of rows that list documents instead of bits
_CLIMB = "chunk long, level int, found array<binary>, pos array<binary>, doc array<binary>, h1 array<binary>, h2 array<binary>"
_OWN = ("n_words", "n_removed", "repeat_at_least", "longest_repeat", "kept_text")


def remove_repeated_passages(
    docs: DataFrame,
    *,
    text_col: str = "text",
    window: int = 35,
    extend: bool = False,
    chunk_bytes: int | None = None,
) -> DataFrame:
    """Remove every word covered by a window of ``window`` words that also starts anywhere else.

    Words are runs of bytes other than ASCII white space and are compared unchanged. Windows
    stay inside one document and are judged on the input; the other occurrence may be in the
    same document and may overlap. Returns the columns of ``docs`` with ``n_words``, ``n_removed``,
    ``kept_text`` (kept words joined by one space), ``repeat_at_least``: the longest of the lengths window, 2 x window, 4 x window, ...
    at which a representative of the document repeats (for the window itself: any window), 0 if none; a repeated passage of that length is
    there, and none of four times that length. ``longest_repeat`` is the longest of these lengths at which any window of the document repeats, so
    the same or twice as long. Without ``extend`` only the first length is looked at for it.

    Defined cases: a null or empty text has no words, nothing removed and an empty kept text;
    a text shorter than the window is kept whole; a row that is repeated counts as another
    occurrence, so both copies lose their words; ids are carried, never compared, and may be
    null or repeated; an empty table gives an empty result. Columns of ``docs`` named like
    an added one are replaced.
    """
    if window < 2:
        raise ValueError("window must be at least 2")
    spark = docs.sparkSession
    docs = docs.drop(*_OWN)
    at = docs.columns.index(text_col)
    total = docs.agg(F.sum(F.octet_length(text_col))).collect()[0][0] or 0
    buckets = max(2 * partitions(spark), -(-total // _BUCKET_BYTES))
    chunk_bytes = chunk_bytes or min(max(buckets * _SLICE_BYTES, _CHUNK_BYTES[0]), _CHUNK_BYTES[1])
    half = (window + 1) // 2
    lengths = [(half + 1) // 2, half, window]
    dealt = keep(docs.mapInArrow(lambda batches: _deal(batches, at, chunk_bytes, lengths, buckets), f"chunk long, rows binary, asked array<struct<{_ASKED}>>"), "chunks")
    chunks = dealt.select("chunk", "rows")
    answers = keep(_judge(dealt.select(F.inline("asked"))), "level0")
    for level in (1, 2):
        if not answers.filter((F.col("level") == level - 1) & F.col("some")).head(1):
            break  # no candidate survives
        asked = chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_extender(lengths, at, level, buckets), _ASKED)
        answers = answers.unionByName(keep(_judge(asked), f"level{level}"))
    answers = answers.unionByName(_climbed(chunks, answers, lengths, at, buckets))
    if extend:
        answers = answers.unionByName(_doubled(chunks, answers, lengths, at, buckets))
    out = T.StructType([*docs.schema.fields, *T._parse_datatype_string("n_words long, n_removed long, repeat_at_least int, longest_repeat int, kept_text string").fields])
    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(lambda t, a: _removed(t, a, lengths, at, buckets), out)


def _climbed(chunks: DataFrame, answers: DataFrame, lengths: list[int], at: int, buckets: int) -> DataFrame:
    """The documents in which a representative of 2, 4, 8, ... times the wanted length repeats, level by level until none does."""
    kind = f"{_CLIMB}, asked array<struct<{_ASKED}>>"
    live = keep(chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(lambda t, a: _anchors(t, a, lengths, at, buckets), kind), "climb")
    while live.filter(F.size("asked") > 0).head(1):
        judged = keep(_judge(live.select(F.inline("asked"))), "judged")
        higher = keep(live.drop("asked").groupBy("chunk").cogroup(judged.groupBy("chunk")).applyInArrow(lambda t, a: _climb(t, a, buckets), kind), "climb")
        discard(live, judged)
        live = higher
    found = live.select("chunk", F.posexplode("found").alias("nth", "bits"))
    return found.select((F.col("nth") + 3).alias("level"), F.lit(_ANCHORED).alias("bucket"), "chunk", F.lit(True).alias("some"), "bits")


def _doubled(chunks: DataFrame, answers: DataFrame, lengths: list[int], at: int, buckets: int) -> DataFrame:
    """The documents that have a repeating window of 2, 4, 8, ... times the wanted length, chunk by chunk, level by level."""
    level, length = 3, lengths[2]
    # Where windows of the wanted length repeat, and the candidates of twice that length, each level from the one before.
    live = chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(lambda t, a: _live(t, a, lengths, at, buckets), f"{_STATE}, asked array<struct<{_ASKED}>>")
    live, found = keep(live, "live"), []
    while live.head(1):
        judged = keep(_judge(live.select(F.inline("asked"))), f"level{level}")
        longer = live.select("chunk", "level", "pos", "doc", "h1", "h2").groupBy("chunk").cogroup(judged.groupBy("chunk"))
        longer = keep(longer.applyInArrow(_doubler(length, buckets), f"{_STATE}, asked array<struct<{_ASKED}>>"), "live")
        found.append(keep(longer.select(F.col("level").alias("level"), F.lit(_DOCS).alias("bucket"), "chunk", F.lit(True).alias("some"), F.col("doc").alias("bits")), "longer"))
        discard(live, judged)
        live, level, length = longer, level + 1, 2 * length
    discard(live)
    none = chunks.sparkSession.createDataFrame([], _ANSWER)
    for part in found:
        none = none.unionByName(part)
    return none


def _deal(batches: Iterator[pa.RecordBatch], at: int, chunk_bytes: int, lengths: list[int], buckets: int) -> Iterator[pa.RecordBatch]:
    """Pack slices of the incoming rows into chunks, with what each asks at the first level. Their numbers are fixed once the table is written."""
    number = TaskContext.get().partitionId() << 32
    for batch in batches:
        for part in slices(batch, batch.schema.names[at], chunk_bytes):
            asked = _first_level(part.column(at), number, lengths, buckets).to_struct_array().combine_chunks()
            ends = pa.array([0, len(asked)], pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([_packed(part)], pa.binary()), pa.ListArray.from_arrays(ends, asked)], names=["chunk", "rows", "asked"])
            number += 1


def _packed(rows: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_batch(rows)
    return sink.getvalue().to_pybytes()


def _unpacked(t: pa.Table) -> pa.Table:
    return pa.ipc.open_stream(t.column("rows")[0].as_buffer()).read_all()


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    """Rising with the hash, so that sorted hashes fall into consecutive slices."""
    return ((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


class _Text(Words):
    """Words whose window hashes from the first level's length on are kept, each built from its halves."""

    def __init__(self, column: pa.Array, shortest: int):
        super().__init__(column, SPACED)
        self._shortest, self._kept = shortest, {}

    def windows(self, length: int, seed: int = 0) -> np.ndarray:
        if (length, seed) not in self._kept:
            half = (length + 1) // 2
            w = super().windows(length, seed) if length == 1 or half < self._shortest else self._joined(self.windows(half, seed), length, seed)
            self._kept[length, seed] = w
        return self._kept[length, seed]

    @staticmethod
    def _joined(w: np.ndarray, length: int, seed: int) -> np.ndarray:
        return paired_hash(w, _shifted(w, length // 2), length, seed)


def _shifted(w: np.ndarray, by: int) -> np.ndarray:
    """The values that stand so many places further on; zeros at the end."""
    out = np.zeros_like(w)
    out[: max(len(w) - by, 0)] = w[by:]
    return out


def _ask(level: int, chunk: int, key1: np.ndarray, key2: np.ndarray | None, buckets: int) -> pa.Table:
    """The distinct keys of a chunk, cut by bucket."""
    k1, k2, counts = _distinct(key1, key2)
    cut = np.searchsorted(_bucket(k1, buckets), np.arange(buckets + 1))
    used = np.flatnonzero(np.diff(cut))
    rows = [(level, int(b), chunk, k1[cut[b] : cut[b + 1]].tobytes(), k2[cut[b] : cut[b + 1]].tobytes() if k2 is not None else b"", np.packbits(counts[cut[b] : cut[b + 1]] > 1).tobytes()) for b in used]
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
    return pa.Table.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds], names=["level", "bucket", "chunk", "key1", "key2", "twice"])


def _distinct(key1: np.ndarray, key2: np.ndarray | None) -> tuple[np.ndarray, np.ndarray | None, np.ndarray]:
    order = np.argsort(key1) if key2 is None else np.lexsort((key2, key1))
    k1, k2 = key1[order], None if key2 is None else key2[order]
    new = np.ones(len(k1), bool)
    new[1:] = k1[1:] != k1[:-1]
    if k2 is not None:
        new[1:] |= k2[1:] != k2[:-1]
    first = np.flatnonzero(new)
    return k1[first], None if k2 is None else k2[first], np.diff(np.append(first, len(k1)))


def _judge(asked: DataFrame) -> DataFrame:
    """Per bucket, which keys occur in two chunks, or twice in one; answered chunk by chunk."""
    return asked.groupBy("level", "bucket").applyInArrow(_judged, _ANSWER)


def _judged(t: pa.Table) -> pa.Table:
    key1, key2 = (t.column(c).combine_chunks() for c in ("key1", "key2"))
    k1 = np.frombuffer(b"".join(key1.to_pylist()), np.uint64)
    k2 = np.frombuffer(b"".join(key2.to_pylist()), np.uint64)
    sizes = np.array([len(x) // 8 for x in key1.to_pylist()], np.int64)
    twice = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=int(n)) for x, n in zip(t.column("twice").to_pylist(), sizes)]).astype(bool)
    order = np.argsort(k1, kind="stable") if not len(k2) else np.lexsort((k2, k1))
    same = k1[order][1:] == k1[order][:-1]
    if len(k2):
        same &= k2[order][1:] == k2[order][:-1]
    again = np.zeros(len(k1), bool)
    again[order[1:]] |= same
    again[order[:-1]] |= same
    again |= twice
    ends = np.cumsum(sizes)
    bits = [np.packbits(again[e - n : e]).tobytes() for e, n in zip(ends, sizes)]
    some = pa.array([bool(again[e - n : e].any()) for e, n in zip(ends, sizes)], pa.bool_())
    return pa.Table.from_arrays([t.column("level"), t.column("bucket"), t.column("chunk"), some, pa.array(bits, pa.binary())], names=["level", "bucket", "chunk", "some", "bits"])


def _answered(keys: tuple[np.ndarray, np.ndarray | None], bits: dict[int, bytes], buckets: int) -> np.ndarray:
    """Which of a chunk's keys repeat, in the order of the keys."""
    k1, k2 = keys
    d1, d2, _ = _distinct(k1, k2)
    cut = np.searchsorted(_bucket(d1, buckets), np.arange(buckets + 1))
    again = np.zeros(len(d1), bool)
    for b in np.flatnonzero(np.diff(cut)) if bits else ():
        n = int(cut[b + 1] - cut[b])
        again[cut[b] : cut[b + 1]] = np.unpackbits(np.frombuffer(bits[int(b)], np.uint8), count=n).astype(bool)
    if k2 is None:
        return again[np.searchsorted(d1, k1)]
    order = np.lexsort((k2, k1))
    new = np.ones(len(k1), bool)
    new[1:] = (k1[order][1:] != k1[order][:-1]) | (k2[order][1:] != k2[order][:-1])
    out = np.zeros(len(k1), bool)
    out[order] = again[np.cumsum(new) - 1]
    return out


def _representatives(words: Words, lengths: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes at the first length; starts of full windows; the position that represents each."""
    short = words.windows(lengths[0])
    full = np.flatnonzero(words.fits(lengths[2]))
    return short, full, first_minimum(short, lengths[2] - lengths[1] + 1)[full]


def _first_level(texts: pa.Array, chunk: int, lengths: list[int], buckets: int) -> pa.Table:
    short, _, chosen = _representatives(_Text(texts, lengths[0]), lengths)
    return _ask(0, chunk, short[np.unique(chosen)], None, buckets)


def _bits(a: pa.Table) -> dict[int, dict[int, bytes]]:
    out: dict[int, dict[int, bytes]] = {}
    for level, bucket, bits in zip(*(a.column(c).to_pylist() for c in ("level", "bucket", "bits"))):
        out.setdefault(level, {})[bucket] = bits
    return out


def _survivors(words: Words, bits: dict[int, dict[int, bytes]], lengths: list[int], level: int, buckets: int) -> np.ndarray:
    """Starts of what repeats at the levels before ``level``: representatives before level 2, then windows of the wanted length.

    A level without answers had no candidates, so nothing repeats there.
    """
    short, full, chosen = _representatives(words, lengths)
    live = np.unique(chosen)
    for k in range(min(level, 2)):
        if len(live):
            live = live[_answered((words.windows(lengths[k])[live], None), bits.get(k, {}), buckets)]
    if level < 2:
        return live
    again = np.zeros(len(short), bool)
    again[live] = True
    live = full[again[chosen]]
    if level > 2 and len(live):
        live = live[_answered((words.windows(lengths[2])[live], words.windows(lengths[2], 1)[live]), bits.get(2, {}), buckets)]
    return live


def _extender(lengths: list[int], at: int, level: int, buckets: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    return lambda t, a: _next_level(t, a, lengths, at, level, buckets)


def _next_level(t: pa.Table, a: pa.Table, lengths: list[int], at: int, level: int, buckets: int) -> pa.Table:
    none = np.zeros(0, np.uint64)
    if not t.num_rows:
        return _ask(level, 0, none, none, buckets)
    words = _Text(_unpacked(t).column(at).combine_chunks(), lengths[0])
    live = _survivors(words, _bits(a), lengths, level, buckets)
    second = words.windows(lengths[2], 1)[live] if level == 2 else None
    return _ask(level, t.column("chunk")[0].as_py(), words.windows(lengths[level])[live], second, buckets)


def _anchors(t: pa.Table, a: pa.Table, lengths: list[int], at: int, buckets: int) -> pa.Table:
    """The representatives of every longer level, their hashes, and what they ask at the first of these levels; no row without any."""
    if not t.num_rows:
        return _rungs(0, 3, [], [], buckets)
    words = _Text(_unpacked(t).column(at).combine_chunks(), lengths[0])
    length, rungs = lengths[2], []
    alive = np.zeros(len(words.start), bool)
    alive[_survivors(words, _bits(a), lengths, 3, buckets)] = True
    of, place, left = words.text_of(), np.arange(len(alive)), np.repeat(words.first[1:], words.count) - np.arange(len(alive))
    short, h = words.windows(lengths[0]), [words.windows(length, seed) for seed in (0, 1)]
    while True:
        # Only documents with a candidate, and long enough for what it represents, are looked at any further.
        busy = np.zeros(len(words.count), bool)
        busy[of[alive]] = True
        stay = (busy & (words.count >= 4 * length))[of]
        if not stay.any():
            return _rungs(t.column("chunk")[0].as_py(), 3, [], rungs, buckets)
        h = [paired_hash(w[stay], _shifted(w[stay], length), 2 * length, seed) for seed, w in enumerate(h)]
        of, place, left, short, alive = (x[stay] for x in (of, place, left, short, alive))
        length *= 2
        chosen = np.unique(first_minimum(short, length + 1)[left >= 2 * length])
        chosen = chosen[alive[chosen]]
        alive = np.zeros(len(of), bool)
        alive[chosen] = True
        if len(chosen):
            rungs.append((place[chosen].astype(np.int32), of[chosen].astype(np.int32), h[0][chosen], h[1][chosen]))


def _rungs(chunk: int, level: int, found: list[bytes], rungs: list[tuple[np.ndarray, ...]], buckets: int) -> pa.Table:
    """The documents found so far by level, the candidates of this level and those above, and what this level asks."""
    some = bool(found or rungs)
    keys = rungs[0][2:] if rungs else 2 * [np.zeros(0, np.uint64)]
    asked = _ask(level, chunk, *keys, buckets).to_struct_array().combine_chunks()
    lists = [found, *([r[k].tobytes() for r in rungs] for k in range(4))]
    columns = [pa.array([chunk][:some], pa.int64()), pa.array([level][:some], pa.int32()), *(pa.array([x][:some], pa.list_(pa.binary())) for x in lists)]
    ends = pa.array([0, len(asked)][: 1 + some], pa.int32())
    return pa.Table.from_arrays([*columns, pa.ListArray.from_arrays(ends, asked)], names=["chunk", "level", "found", "pos", "doc", "h1", "h2", "asked"])


def _climb(t: pa.Table, a: pa.Table, buckets: int) -> pa.Table:
    """Keep the candidates of the next level whose window of half its length repeats, and note the documents of those that do."""
    if not t.num_rows:
        return _rungs(0, 0, [], [], buckets)
    chunk, level, found = (t.column(c)[0].as_py() for c in ("chunk", "level", "found"))
    kinds = {"pos": np.int32, "doc": np.int32, "h1": np.uint64, "h2": np.uint64}
    rungs = list(zip(*([np.frombuffer(x, kind) for x in t.column(c)[0].as_py()] for c, kind in kinds.items())))
    if not rungs:
        return _rungs(chunk, level, found, [], buckets)
    pos, doc, h1, h2 = rungs[0]
    again = _answered((h1, h2), _bits(a)[level], buckets)
    higher = rungs[1:]
    if higher:
        stay = np.isin(higher[0][0], pos[again])
        higher = [tuple(x[stay] for x in higher[0]), *higher[1:]] if stay.any() else []
    return _rungs(chunk, level + 1, [*found, np.unique(doc[again]).tobytes()], higher, buckets)


def _state(chunk: int, level: int, length: int, pos: np.ndarray, doc: np.ndarray, h1: np.ndarray, h2: np.ndarray, buckets: int) -> pa.Table:
    """The repeating windows of a level, with what they ask about windows of twice their length; no row without any."""
    names = ["chunk", "level", "pos", "doc", "h1", "h2", "asked"]
    first, second = _pairs(pos, doc, length)
    asked = _ask(level + 1, chunk, paired_hash(h1[first], h1[second], 2 * length), paired_hash(h2[first], h2[second], 2 * length, 1), buckets).to_struct_array().combine_chunks()
    some = bool(len(pos))
    ends = pa.array([0, len(asked)][: 1 + some], pa.int32())
    columns = [pa.array([x][:some], k) for x, k in ((chunk, pa.int64()), (level, pa.int32()), *((x.tobytes(), pa.binary()) for x in (pos.astype(np.int32), doc.astype(np.int32), h1, h2)))]
    return pa.Table.from_arrays([*columns, pa.ListArray.from_arrays(ends, asked)], names=names)


def _pairs(pos: np.ndarray, doc: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The windows that another one of the same document follows without a gap, and those others; positions rise."""
    if not len(pos):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(pos, pos + length), len(pos) - 1)
    first = np.flatnonzero((pos[at] == pos + length) & (doc[at] == doc))
    return first, at[first]


def _live(t: pa.Table, a: pa.Table, lengths: list[int], at: int, buckets: int) -> pa.Table:
    none = np.zeros(0, np.uint64)
    if not t.num_rows:
        return _state(0, 2, lengths[2], none, none, none, none, buckets)
    words = _Text(_unpacked(t).column(at).combine_chunks(), lengths[0])
    live = _survivors(words, _bits(a), lengths, 3, buckets)
    return _state(t.column("chunk")[0].as_py(), 2, lengths[2], live, words.text_of()[live], words.windows(lengths[2])[live], words.windows(lengths[2], 1)[live], buckets)


def _doubler(length: int, buckets: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    return lambda t, a: _longer(t, a, length, buckets)


def _longer(t: pa.Table, a: pa.Table, length: int, buckets: int) -> pa.Table:
    """The windows of twice ``length`` that repeat."""
    none = np.zeros(0, np.uint64)
    if not t.num_rows or not a.num_rows:
        return _state(0, 0, length, none, none, none, none, buckets)
    pos, doc = (np.frombuffer(t.column(c)[0].as_buffer(), np.int32) for c in ("pos", "doc"))
    h1, h2 = (np.frombuffer(t.column(c)[0].as_buffer(), np.uint64) for c in ("h1", "h2"))
    level = t.column("level")[0].as_py() + 1
    first, second = _pairs(pos, doc, length)
    k1, k2 = paired_hash(h1[first], h1[second], 2 * length), paired_hash(h2[first], h2[second], 2 * length, 1)
    again = _answered((k1, k2), _bits(a)[level], buckets)
    return _state(t.column("chunk")[0].as_py(), level, 2 * length, pos[first][again], doc[first][again], k1[again], k2[again], buckets)


def _removed(t: pa.Table, a: pa.Table, lengths: list[int], at: int, buckets: int) -> pa.Table:
    t = _unpacked(t)
    column = t.column(at).combine_chunks()
    words = _Text(column, lengths[0])
    bits = _bits(a)
    live = _survivors(words, bits, lengths, 3, buckets)
    hit = np.zeros(len(words.start), bool)
    hit[live] = True
    gone = covered(hit, lengths[2])
    of = words.text_of()
    removed = np.bincount(of[gone], minlength=len(column))
    longest = np.zeros(len(column), np.int32)
    longest[of[live]] = lengths[2]
    least = longest.copy()
    for level in sorted(k for k in bits if k > 2):
        for lengths_of, listed in ((longest, _DOCS), (least, _ANCHORED)):
            lengths_of[np.frombuffer(bits[level].get(listed, b""), np.int32)] = lengths[2] << (level - 2)
    kept = []
    for i, text in enumerate(column.to_pylist()):
        parts = (text or "").encode().split()
        if removed[i]:
            stay = ~gone[words.first[i] : words.first[i + 1]]
            parts = [p for p, s in zip(parts, stay) if s]
        kept.append(b" ".join(parts).decode())
    own = [pa.array(words.count, pa.int64()), pa.array(removed, pa.int64()), pa.array(least), pa.array(longest), pa.array(kept, pa.string())]
    return pa.Table.from_arrays([*t.columns, *own], names=[*t.schema.names, "n_words", "n_removed", "repeat_at_least", "longest_repeat", "kept_text"])
