"""Exact largest inner products, with vectors in order of falling length and SVD-rotated partial sums.

Vectors are packed into groups by falling length, a group of candidates meets a block of queries in
one task, and both are rotated onto the principal axes of all candidates. Within a task the first
components give a partial inner product, and Cauchy-Schwarz bounds the rest by the lengths of the
residuals; only pairs whose bound reaches the query's k-th best score so far are scored exactly.

The groups with the longest vectors are searched first. From the k-th best scores found there follows how long a candidate must
be to matter to a query; queries of like need share a block, and a block meets only the groups that are long enough.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parcelry.sources.scratch import keep, partitions

_PACK = "ids binary, rows binary, kind string, vectors binary, bound binary, last binary"
_SLICE, _QUERIES = 512, 2048
_NO_ID = np.iinfo(np.int64).max  # above every id
_NULL_ID = _NO_ID - 1
_LOW, _HIGH = -(1 << 63), (1 << 63) - 1
_PART = "query_row long, query_id long, vec_id long, score long, digits string"
_NONE = "query_id long, rank int, vec_id long, score long"
_CLASSES = 8


def integer_vectors(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64) -> DataFrame:
    """``vec_id`` and ``v``: floor(scale * x) of each component, a whole number in a double; vectors that are null or hold null or non-finite components are left out."""
    x = F.col(vector_col)
    sound = x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    product = lambda c: c.cast("double") * F.lit(float(scale))
    # floor of a double is a long; from 2 ** 52 on doubles are whole numbers already.
    whole = lambda c: F.when(F.abs(product(c)) < 2.0**52, F.floor(product(c)).cast("double")).otherwise(product(c))
    return vectors.filter(sound).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(x, whole).alias("v"))


def top_inner_products(vectors: DataFrame, *, queries: str = "vec_id % 20 = 0", k: int = 20, lead: int = 16, group_rows: tuple[int, int] = (2048, 16384)) -> DataFrame:
    """For every row that satisfies ``queries``, the ``k`` other rows with the largest inner product.

    Takes ``vec_id`` and ``v`` (whole numbers, see integer_vectors). Returns ``query_id``, ``rank`` from 1, ``vec_id`` and
    ``score``; equal scores rank the smaller id first (null ids last). Every candidate is either scored exactly or excluded by a bound.
    ``group_rows``: the fewest and most candidates of a task; within these, two groups per shuffle partition.

    Defined cases: rows are told apart by their place, not their id, so queries are candidates of each other, never of themselves, and
    rows that share an id, or repeat in full, all count, as queries and as candidates; vectors of different lengths have no
    score, and each length (there are few) is searched by itself; vectors without components have score 0 with each other; fewer than ``k`` others give fewer rows; an
    empty table gives an empty result; other columns are left out. Scores are exact whatever their size and ranked as such;
    in ``score`` those beyond 64 bits are shown as the nearest 64-bit number. A vector whose length overflows a double takes no part.
    """
    spark = vectors.sparkSession
    # A vector whose length overflows cannot be ordered, so lengths are doubles.
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double")))
    v = F.when(F.size("v") == 0, F.array(F.lit(0.0))).otherwise(F.transform("v", lambda c: c.cast("double")))
    rows = keep(vectors.select(F.monotonically_increasing_id().alias("row"), F.coalesce("vec_id", F.lit(_NULL_ID)).alias("vec_id"), v.alias("v"), norm.alias("norm"), F.size("v").alias("dims"), F.coalesce(F.expr(queries), F.lit(False)).alias("asked")).filter(F.col("norm") < float("inf")), "vectors")
    counts = rows.groupBy("dims").agg(F.count("*").alias("n"), F.count_if("asked").alias("asked")).filter("asked > 0").orderBy("dims").collect()
    found = [_search_length(rows.filter(F.col("dims") == c["dims"]), max(c["dims"], 1), c["n"], c["asked"], k, lead, group_rows) for c in counts]
    out = spark.createDataFrame([], _NONE)
    for part in found:
        out = out.unionByName(part)
    return out


def _search_length(rows: DataFrame, dims: int, count: int, asked: int, k: int, lead: int, group_rows: tuple[int, int]) -> DataFrame:
    """The search among vectors of one length."""
    spark = rows.sparkSession
    axes = spark.sparkContext.broadcast(_axes(rows, dims))  # dims x dims
    per_group = min(max(count // (2 * partitions(spark)), group_rows[0]), group_rows[1])
    pieces = keep(_pieces(rows, count, per_group, dims), "candidates")
    # One number per piece, of some thousand vectors each.
    listed = pieces.select("piece", "n", "longest").orderBy("piece").collect()
    groups, longest, room = [], [], 0
    for p in listed:
        if not longest or room + p["n"] > per_group:
            longest.append(p["longest"])
            room = 0
        room += p["n"]
        groups.append((p["piece"], len(longest) - 1))
    candidates = pieces.join(F.broadcast(spark.createDataFrame(groups, "piece int, group int")), "piece")
    opened = -(-len(longest) // 8)

    queries = rows.filter("asked").select("row", "vec_id", "v", "norm")
    blocks = max(1, -(-asked // group_rows[1]), min(-(-asked // group_rows[0]), partitions(spark)))
    none = {"least": F.lit(float("-inf")), "last": F.lit(_NO_ID)}
    dealt = queries.withColumns(none).withColumn("block", _deal(blocks))
    first = spark.range(blocks).select(F.col("id").cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(opened - 1))).alias("group"))
    best = Window.partitionBy("query_row").orderBy(F.desc("score"), F.desc_nulls_last("digits"), "vec_id")
    opening = _search(candidates, dealt, first, k, lead, axes)
    opening = keep(opening.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k), "opening")
    if opened == len(longest):
        return opening.transform(_shown)

    # Of a k-th score below 64 bits only that it is no bound is known.
    least = F.when(F.col("score") > _LOW, F.col("score").cast("double"))
    kth = opening.filter(F.col("rank") == k).select(F.col("query_row").alias("row"), least.alias("least"), F.col("vec_id").alias("last"))
    need = F.when(F.col("least") > 0, F.col("least") / F.col("norm") * (1 - 1e-9)).otherwise(0.0)
    known = {"least": F.coalesce("least", F.lit(float("-inf"))), "last": F.coalesce("last", F.lit(_NO_ID)), "need": F.coalesce(need, F.lit(0.0))}
    bounded = keep(queries.join(kth, "row", "left").withColumns(known), "bounded")
    classes = min(_CLASSES, blocks)
    cuts = bounded.approxQuantile("need", [i / classes for i in range(1, classes)], 0.01) if classes > 1 else []
    each = -(-blocks // classes)
    of = sum((F.when(F.col("need") > c, 1).otherwise(0) for c in cuts), F.lit(0))
    bounded = bounded.withColumn("block", (of * each + _deal(each)).cast("int"))
    # One number per block of queries. Groups come in order of falling length, so a block needs the first ones.
    needs = bounded.groupBy("block").agg(F.min("need").alias("need")).collect()
    reach = [(r["block"], sum(x >= r["need"] for x in longest)) for r in needs]
    pairs = spark.createDataFrame(reach, "block int, upto int").filter(F.col("upto") > opened)
    pairs = pairs.select("block", F.explode(F.sequence(F.lit(opened), F.col("upto") - 1)).alias("group"))
    found = _search(candidates, bounded, pairs, k, lead, axes)
    ranked = opening.drop("rank").unionByName(found).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.transform(_shown)


def _shown(ranked: DataFrame) -> DataFrame:
    return ranked.select("query_id", "rank", F.nullif("vec_id", F.lit(_NULL_ID)).alias("vec_id"), "score")


def _deal(blocks: int) -> F.Column:
    return F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int")


def _matrix(v: pd.Series, dims: int) -> np.ndarray:
    return np.stack(v.to_numpy()).reshape(-1, dims) if len(v) else np.zeros((0, dims))


def _axes(rows: DataFrame, dims: int) -> np.ndarray:
    """The principal axes of all vectors, largest first, from the sum of their outer products."""

    def grams(batches):
        total = np.zeros((dims, dims))
        for pdf in batches:
            m = _matrix(pdf["v"], dims).astype(float)
            total += m.T @ m
        yield pd.DataFrame({"gram": [total.tobytes()]})

    parts = rows.select("v").mapInPandas(grams, "gram binary").rdd.map(lambda r: np.frombuffer(bytes(r["gram"])).reshape(dims, dims))
    gram = parts.treeReduce(lambda a, b: a + b)
    return np.linalg.svd(gram / max(gram.max(), 1.0))[0]


def _pack(pdf: pd.DataFrame, dims: int) -> dict:
    """All vectors of a frame as the fields of one row, in the smallest number type that holds them."""
    m = _matrix(pdf["v"], dims)
    fits = lambda t: not m.size or (m.min() >= np.iinfo(t).min and m.max() <= np.iinfo(t).max)
    kind = next((t for t in ("int8", "int16", "int32") if fits(t)), "float64")
    bound = pdf["least"].to_numpy(float) if "least" in pdf else np.zeros(0)
    last = pdf["last"].to_numpy(np.int64) if "last" in pdf else np.zeros(0, np.int64)
    ids = pdf["vec_id"].to_numpy(np.int64)
    return {"ids": ids.tobytes(), "rows": pdf["row"].to_numpy(np.int64).tobytes(), "kind": kind, "vectors": m.astype(kind).tobytes(), "bound": bound.tobytes(), "last": last.tobytes()}


def _pieces(rows: DataFrame, count: int, per_group: int, dims: int) -> DataFrame:
    """One row per range of lengths; piece 0 holds the longest vectors."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if frames := [pdf for pdf in batches if len(pdf)]:
            pdf = pd.concat(frames)
            yield pd.DataFrame([{**_pack(pdf, dims), "n": len(pdf), "longest": pdf["norm"].max()}])

    ranged = rows.select("row", "vec_id", "v", "norm").repartitionByRange(-(-count // per_group), F.desc("norm"), "vec_id", "row")
    return ranged.sortWithinPartitions(F.desc("norm"), "vec_id", "row").mapInPandas(pack, f"{_PACK}, n long, longest double").withColumn("piece", F.spark_partition_id())


def _search(candidates: DataFrame, queries: DataFrame, pairs: DataFrame, k: int, lead: int, axes: Broadcast) -> DataFrame:
    """Every pair of a query block and a candidate group meets in a task of its own."""
    dims = len(axes.value)
    packed = queries.groupBy("block").applyInPandas(lambda pdf: pd.DataFrame([{**_pack(pdf, dims), "block": pdf["block"].iloc[0]}]), f"{_PACK}, block int")
    left = packed.join(pairs, "block").groupBy("block", "group")
    right = candidates.join(pairs, "group").groupBy("block", "group")
    return left.cogroup(right).applyInPandas(lambda q, c: _meet(q, c, k, lead, axes.value), _PART)


def _unpack(row: pd.Series, dims: int) -> tuple[np.ndarray, ...]:
    return np.frombuffer(row["ids"], np.int64), np.frombuffer(row["rows"], np.int64), np.frombuffer(row["vectors"], row["kind"]).reshape(-1, dims).astype(float)


def _meet(q: pd.DataFrame, c: pd.DataFrame, k: int, lead: int, axes: np.ndarray) -> pd.DataFrame:
    columns = ["query_row", "query_id", "vec_id", "score", "digits"]
    if not len(q) or not len(c):
        return pd.DataFrame({x: [] for x in columns}).astype({x: np.int64 for x in columns[:4]} | {"digits": object})
    dims = len(axes)
    parts = [_unpack(row, dims) for _, row in c.sort_values("piece").iterrows()]
    c_ids, c_rows, c_vectors = (np.concatenate(x) for x in zip(*parts))
    one = q.iloc[0]
    q_ids, q_rows, q_vectors = _unpack(one, dims)
    bound, last = np.frombuffer(one["bound"]).copy(), np.frombuffer(one["last"], np.int64).copy()
    out = []
    for at in range(0, len(q_ids), _QUERIES):
        s = slice(at, at + _QUERIES)
        rows, ids, scores = best_pairs(q_rows[s], q_vectors[s], bound[s], last[s], c_ids, c_rows, c_vectors, k, lead, axes)
        shown = np.array([min(max(x, _LOW), _HIGH) for x in scores], np.int64) if scores.dtype == object else scores
        digits = [_digits(x) for x in scores] if scores.dtype == object else [None] * len(scores)
        out.append(pd.DataFrame({"query_row": q_rows[s][rows], "query_id": q_ids[s][rows], "vec_id": ids, "score": shown, "digits": pd.Series(digits, dtype=object)}))
    return pd.concat(out, ignore_index=True)


def _digits(score: int) -> str | None:
    """Orders the scores that 64 bits cannot hold, or only as a limit."""
    return None if _LOW < score < _HIGH else str(score if score > 0 else 10**399 + score).zfill(399)


def best_pairs(
    q_rows: np.ndarray, q: np.ndarray, bound: np.ndarray, last: np.ndarray, c_ids: np.ndarray, c_rows: np.ndarray, c: np.ndarray, k: int, lead: int, axes: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best candidates of each query among those that beat its bound, or reach it with an id below ``last``: query numbers, ids, scores.

    Candidates come in order of falling length. Scores are longs, or Python integers where the lengths allow more than 64 bits.
    """
    qr, cr = q @ axes, c @ axes
    q_norm, c_norm = np.linalg.norm(q, axis=1), np.linalg.norm(c, axis=1)
    q_rest, c_rest = np.linalg.norm(qr[:, lead:], axis=1), np.linalg.norm(cr[:, lead:], axis=1)
    largest = q_norm.max() * c_norm.max()
    in_float = largest < 2.0**52
    kind = np.int64 if largest < 2.0**62 else object
    if not in_float:
        whole = np.frompyfunc(int, 1, 1)
        q_exact, c_exact = whole(q).astype(kind), whole(c).astype(kind)
    rows, ids, scores = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, kind)
    for at in range(0, len(c), _SLICE):
        part = slice(at, at + _SLICE)
        slack = 1e-9 * q_norm * c_norm[at] + 1e-6  # of the rotated products
        live = np.flatnonzero(q_norm * c_norm[at] + slack >= bound)
        if not len(live):
            break
        upper = qr[live, :lead] @ cr[part, :lead].T + np.outer(q_rest[live], c_rest[part])
        near = upper + slack[live, None] >= bound[live, None]
        own = q_rows[live, None] == c_rows[None, part]
        near &= ~own
        use_q, use_c = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
        if not len(use_q):
            continue
        live, own = live[use_q], own[use_q][:, use_c]
        exact = q[live] @ c[part][use_c].T if in_float else q_exact[live] @ c_exact[part][use_c].T
        shown = np.where(own, -np.inf, exact.astype(float))
        if len(use_c) > k:
            here = np.partition(shown, len(use_c) - k, axis=1)[:, len(use_c) - k]
            if not in_float:
                here = here - slack[live]
            last[live] = np.where(here > bound[live], _NO_ID, last[live])
            bound[live] = np.maximum(bound[live], here)
        if in_float:
            good = (shown > bound[live, None]) | ((shown == bound[live, None]) & (c_ids[part][use_c][None, :] < last[live, None]))
        else:
            good = shown >= bound[live, None] - slack[live, None]
        i, j = np.nonzero(good & ~own)
        rows, ids = np.concatenate([rows, live[i]]), np.concatenate([ids, c_ids[part][use_c][j]])
        scores = np.concatenate([scores, exact[i, j].astype(kind)])
        order = np.lexsort((ids, -scores, rows)) if kind is not object else np.array(sorted(range(len(rows)), key=lambda x: (rows[x], -scores[x], ids[x])), np.int64)
        rows, ids, scores = rows[order], ids[order], scores[order]
        start = np.searchsorted(rows, rows)
        keep_ = np.arange(len(rows)) - start < k
        rows, ids, scores = rows[keep_], ids[keep_], scores[keep_]
        full = np.flatnonzero(np.bincount(rows, minlength=len(q)) >= k)
        end = np.searchsorted(rows, full, "right") - 1
        reached = scores[end].astype(float)
        better = reached >= bound[full]
        bound[full[better]], last[full[better]] = reached[better], ids[end][better]
    return rows, ids, scores
