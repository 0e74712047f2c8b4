"""Quality rules: base measures of a text, and its divergence from the texts of its language.

A language's reference is made of all its texts: a histogram of character classes, and one of its most common words beside all others.
A text is judged by the Jensen-Shannon distances of its own histograms from these, each only from a minimum length on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelry.llm.names import unused
from parcelry.llm.words import PLAIN, SPACED, Words, covered, slices, text_bytes
from parcelry.sources.scratch import discard, keep

CLASSES = ("lower", "upper", "digit", "blank", "line end", "punctuation", "symbol", "other ascii", "up to U+02FF", "above")
_PUNCTUATION, _SYMBOLS = b".,;:'\"()?!-", b"#*$%&|<>"
_WINDOW = 8
_BUCKETS = 64

_byte = np.arange(256)
_CLASS_OF = np.full(256, 7)
for _k, _members in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n", _PUNCTUATION, _SYMBOLS)):
    _CLASS_OF[list(_members)] = _k
# A code point counts where its first byte stands; those of U+0080 to U+02FF begin with C2 to CB, and 80 to BF go on.
_CLASS_OF[_byte >= 0xC0] = 8
_CLASS_OF[_byte >= 0xCC] = 9
_IN_CLASS = (_CLASS_OF[:, None] == np.arange(len(CLASSES))) & ((_byte < 0x80) | (_byte >= 0xC0))[:, None]
_IS_SPACE = (_byte == 0x20) | ((_byte >= 0x09) & (_byte <= 0x0D))

_MEASURES = "n_words:long,word_chars:long,n_symbols:long,n_dup_lines:long,n_repeat_words:long,base_failed:boolean,chars:array<long>,words:array<long>"
_RESULTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "js_chars", "js_words", "kept")


def quality_rules(
    docs: DataFrame,
    *,
    text_col: str = "text",
    lang_col: str = "lang",
    carry_text: bool = False,
    common_words: int = 50,
    min_share: float = 0.001,
    refinements: int = 2,
    min_chars: int = 500,
    chars_limit: tuple[float, float] = (0.14, 2.6),
    min_plain_words: int = 100,
    words_limit: tuple[float, float] = (0.10, 3.2),
    reference_limit: float = 0.2,
) -> DataFrame:
    """Measure every text and judge whether to keep it.

    Returns the other columns (the text with ``carry_text``) with ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words``, ``base_failed``
    (fewer than 20 words, or over 30 % of them in repeated windows of eight), the distances ``js_chars`` and ``js_words`` (0 to 1, with logarithms to
    base 2) and ``kept``: base_failed is false, and no distance that is judged exceeds its limit. A limit (a, b) is a + b / sqrt(length), because a short text strays
    further by chance; ``js_chars`` is judged from ``min_chars`` characters on, ``js_words`` from ``min_plain_words`` runs of letters and digits.

    The word reference counts all texts of a language, and the ``common_words`` most frequent of its words (ties in byte order) have places of their own. The class
    reference sums the texts that pass the base rules, then ``refinements`` times those of them whose distance is below ``reference_limit`` or that are too short to be judged.
    A language has a reference from ``min_share`` of all words of the table on, so there are at most 1 / min_share; the distances of other texts are null and do not count
    against them.

    A null text has no words and is not kept; a null language is one of its own. Distances of texts without characters or words are null. Very long texts are
    measured whole; rows that repeat count each; an empty table gives an empty result. Columns named like a result are replaced. Runs jobs when it is called.
    """
    text, lang, m, chars, own = unused(docs, "text", "lang", "m", "chars", "own")
    carried = [c for c in docs.columns if c.lower() not in _RESULTS and (carry_text or c != text_col)]
    table = docs.select(*carried, F.col(text_col).alias(text), F.col(lang_col).cast("string").alias(lang))
    reference = _word_reference(table.select(F.col(text).alias("text"), F.col(lang).alias("lang")), common_words, min_share)
    schema = docs.select(*carried, F.col(lang_col).cast("string").alias(lang), F.lit(None).cast(f"struct<{_MEASURES}>").alias(m)).schema
    held = keep(table.mapInArrow(lambda batches: _measured(batches, carried, text, lang, m, reference), schema), "measures")

    measured = held.select(F.col(lang).alias("lang"), F.col(m)["chars"].alias("chars"), (~F.col(m)["base_failed"]).alias("passed")).filter("passed")
    judged = F.aggregate("chars", F.lit(0).cast("long"), lambda a, x: a + x) >= min_chars
    classes = _class_reference(measured, reference)
    for _ in range(refinements):
        near = measured.join(F.broadcast(classes.toDF("own", "ref")), F.col("lang").eqNullSafe(F.col("own"))).filter(~judged | (js_distance(F.col("chars"), F.col("ref")) < reference_limit))
        classes = _class_reference(near, reference)

    spark = docs.sparkSession
    words = spark.createDataFrame([(k, [n for _, n in r]) for k, r in reference.items()], "own string, words array<long>")
    both = classes.toDF("own", "chars").join(F.broadcast(words.withColumnRenamed("own", "of")), F.col("own").eqNullSafe(F.col("of"))).select(F.col("own").alias(own), F.struct("chars", "words").alias(chars))
    out = held.join(F.broadcast(both), F.col(lang).eqNullSafe(F.col(own)), "left")
    size = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    for name in ("chars", "words"):
        out = out.withColumn(f"js_{name}", F.when(size(F.col(m)[name]) > 0, js_distance(F.col(m)[name], F.col(chars)[name])))

    def too_far(name: str, least: int, limit: tuple[float, float]) -> Column:
        n = size(F.col(m)[name])
        return F.coalesce((n >= least) & (F.col(f"js_{name}") > F.lit(limit[0]) + F.lit(limit[1]) / F.sqrt(n)), F.lit(False))

    kept = ~F.col(m)["base_failed"] & ~too_far("chars", min_chars, chars_limit) & ~too_far("words", min_plain_words, words_limit)
    return out.withColumn("kept", kept).select(*carried, *[F.col(m)[c].alias(c) for c in _RESULTS[:6]], "js_chars", "js_words", "kept")


def js_distance(p: Column, q: Column) -> Column:
    """The Jensen-Shannon distance of two histograms of the same bins, both with a positive sum; null if one is."""

    def part(a: Column, mid: Column) -> Column:
        return F.when(a > 0, a * F.log2(a / mid)).otherwise(0.0)

    total = lambda h: F.aggregate(h, F.lit(0).cast("long"), lambda a, x: a + x)
    # The sums stand in a struct, so that they are taken once and not for every bin.
    sums = F.struct(total(p).alias("p"), total(q).alias("q"))

    def distance(n: Column) -> Column:
        shares = F.zip_with(p, q, lambda x, y: F.struct((x / n["p"]).alias("a"), (y / n["q"]).alias("b"), ((x / n["p"] + y / n["q"]) / 2).alias("mid")))
        return F.aggregate(shares, F.lit(0.0), lambda a, s: a + part(s["a"], s["mid"]) + part(s["b"], s["mid"]), lambda a: F.sqrt(F.greatest(a, F.lit(0.0)) / 2))

    usable = (total(p) > 0) & (total(q) > 0)
    return F.when(usable, F.transform(F.array(sums), distance)[0])


def _class_reference(rows: DataFrame, reference: dict[str | None, list]) -> DataFrame:
    """The summed classes of the rows of each language that has a reference, as a table of its own."""
    known = rows.sparkSession.createDataFrame([(k,) for k in reference], "known string")
    sums = rows.join(F.broadcast(known), F.col("lang").eqNullSafe(F.col("known"))).groupBy("known").agg(F.array(*[F.sum(F.col("chars")[i]) for i in range(len(CLASSES))]).alias("ref"))
    return rows.sparkSession.createDataFrame([tuple(r) for r in sums.collect()], "own string, ref array<long>")  # at most 1 / min_share rows


def _word_reference(texts: DataFrame, common: int, min_share: float) -> dict[str | None, list[tuple[str | None, int]]]:
    """For each language with a share of all words its most common words with their counts, and at the end (None, the count of all others)."""
    counts = keep(texts.mapInArrow(_counted, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    least = (counts.agg(F.sum("n")).head()[0] or 0) * min_share
    large = {r["lang"]: r["total"] for r in totals.filter(F.col("total") >= F.lit(least)).collect()}  # at most 1 / min_share rows
    spark = texts.sparkSession
    known = spark.createDataFrame([(k,) for k in large], "known string")
    rows = counts.join(F.broadcast(known), F.col("lang").eqNullSafe(F.col("known"))).select("lang", "word", "n", F.pmod(F.xxhash64("word"), F.lit(_BUCKETS)).alias("bucket"))
    # The most common of each part of the words first, so that no task holds a language.
    for keys in (["lang", "bucket"], ["lang"]):
        rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), "word"))).filter(F.col("nth") <= common)
    found: dict[str | None, list[tuple[str | None, int]]] = {k: [] for k in large}
    for r in rows.orderBy("lang", "nth").collect():
        found[r["lang"]].append((r["word"], r["n"]))
    discard(counts)
    return {k: [*top, (None, large[k] - sum(n for _, n in top))] for k, top in found.items()}


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each language has each word, a slice of texts at a time."""
    for batch in batches:
        for some in slices(batch, "text"):
            words = Words(some.column("text"), PLAIN)
            langs = some.column("lang").to_pylist()
            names = list(dict.fromkeys(langs))
            of = np.array([names.index(x) for x in langs])[words.text_of()] if len(langs) else np.zeros(0, int)
            for k, name in enumerate(names):
                at = np.flatnonzero(of == k)
                _, first, n = np.unique(words.hashes()[at], return_index=True, return_counts=True)
                raw = words.raw.tobytes()
                text = [raw[words.start[i] : words.end[i]].decode("utf-8", "replace") for i in at[first]]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(text), pa.string()), pa.array(text, pa.string()), pa.array(n.astype(np.int64))], names=["lang", "word", "n"])


def _measured(batches: Iterator[pa.RecordBatch], carried: list[str], text: str, lang: str, m: str, reference: dict[str | None, list]) -> Iterator[pa.RecordBatch]:
    tables = {}
    for k, top in reference.items():
        h = Words(pa.array([w for w, _ in top[:-1]], pa.string()), PLAIN).hashes()
        order = np.argsort(h)
        tables[k] = (h[order], order)
    for batch in batches:
        for some in slices(batch, text):
            texts, langs = some.column(text), some.column(lang).to_pylist()
            fields = [*_base(texts), _histograms(texts)[1], _common(texts, langs, tables)]
            struct = pa.StructArray.from_arrays(fields, names=[f.split(":")[0] for f in _MEASURES.split(",")])
            yield pa.RecordBatch.from_arrays([*[some.column(c) for c in carried], some.column(lang), struct], names=[*carried, lang, m])


def _lists(values: np.ndarray) -> pa.Array:
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), pa.array(values.ravel().astype(np.int64)))


def _histograms(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """How often each byte occurs in each text, and each class of code points."""
    raw, off = text_bytes(texts)
    h = np.zeros((len(texts), 256), np.int64)
    for i in range(len(texts)):
        for a in range(off[i], off[i + 1], 1 << 20):
            h[i] += np.bincount(raw[a : min(a + (1 << 20), off[i + 1])], minlength=256)
    return h, _lists(h @ _IN_CLASS.astype(np.int64))


def _base(texts: pa.Array) -> list[pa.Array]:
    """The measures that need no reference, from n_words to base_failed."""
    words, (h, _) = Words(texts, SPACED), _histograms(texts)
    code_points = h[:, (_byte < 0x80) | (_byte >= 0xC0)].sum(1)
    raw, off = text_bytes(texts)
    repeated_lines = np.zeros(len(texts), np.int64)
    for i in np.flatnonzero(h[:, 10]):
        lines = [x for x in raw[off[i] : off[i + 1]].tobytes().split(b"\n") if x.strip()]
        repeated_lines[i] = len(lines) - len(set(lines))
    repeated = np.bincount(words.text_of(), _in_repeats(words), len(texts)).astype(np.int64)
    failed = (words.count < 20) | (100 * repeated > 30 * words.count)
    columns = [words.count, code_points - h[:, _IS_SPACE].sum(1), h[:, list(_SYMBOLS)].sum(1), repeated_lines, repeated]
    return [*[pa.array(c.astype(np.int64)) for c in columns], pa.array(failed)]


def _in_repeats(words: Words) -> np.ndarray:
    """Which words lie in a window that occurs more than once in its text."""
    hit = np.zeros(len(words.start), bool)
    at = np.flatnonzero(words.fits(_WINDOW))
    if len(at):
        keys = (words.windows(_WINDOW, 1)[at], words.windows(_WINDOW, 0)[at], words.text_of()[at])
        order = np.lexsort(keys)
        same = np.logical_and.reduce([k[order][1:] == k[order][:-1] for k in keys])
        hit[at[order[1:][same]]] = hit[at[order[:-1][same]]] = True
    return covered(hit, _WINDOW)


def _common(texts: pa.Array, langs: list[str | None], tables: dict[str | None, tuple[np.ndarray, np.ndarray]]) -> pa.Array:
    """Counts of the common words of each text's language and of all others; null for a language without reference."""
    words = Words(texts, PLAIN)
    of, h, out = words.text_of(), words.hashes(), [None] * len(texts)
    for name in set(langs) & tables.keys():
        known, order = tables[name]
        mine = np.array([x == name for x in langs])
        at = np.flatnonzero(mine[of])
        place = np.minimum(np.searchsorted(known, h[at]), max(len(known) - 1, 0))
        which = np.where(known[place] == h[at], order[place], len(known)) if len(known) else np.zeros(len(at), int)
        counts = np.zeros((len(texts), len(known) + 1), np.int64)
        np.add.at(counts, (of[at], which), 1)
        for i in np.flatnonzero(mine):
            out[i] = counts[i]
    return pa.array(out, pa.list_(pa.int64()))
