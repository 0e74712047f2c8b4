"""Whitening of integer vectors by the covariance of their distinct values, each counted once or as often as it occurs.

Equal vectors are grouped first, so a vector is multiplied once however many rows hold it. Tasks multiply centred blocks of distinct vectors
and give one matrix each; the sums of these are factored, every distinct vector is projected, and rows take the result of their vector.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelry.operators.lookups import looked_up
from parcelry.llm.names import unused
from parcelry.sources.scratch import discard, keep

_MATRIX_ENTRIES = 4 << 20  # numbers that the matrices of one round of vector lengths hold together
_ROUNDING = 1e-11  # an eigenvalue below this part of the largest is rounding
_LOW, _HIGH = -(1 << 63), (1 << 63) - 1
_RESULT = "component int, n long, deviation long, whitened double, explained double"


class Total(NamedTuple):
    """Of the vectors of one length: their number by weight and exact sums."""

    n: int
    sums: list[int]

    def parts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whole means, what the sums hold beyond n times these, and that as a fraction."""
        whole = np.array([s // self.n for s in self.sums], np.int64)
        rest = np.array([s % self.n for s in self.sums], object)
        return whole, rest, np.array([r / self.n for r in rest], float)


def fixed_point(df: DataFrame, vector_col: str, *, scale: int = 64, offset: int = 1_000_000, out: str = "x") -> DataFrame:
    """Replace a vector column by ``out``, floor(scale * c) + offset of each component as a long; rows whose vector is null or holds null or non-finite components go.

    Beyond 64 bits a component is the nearest 64-bit number.
    """
    v = F.col(vector_col)
    sound = v.isNotNull() & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    scaled = lambda c: c.cast("double") * F.lit(float(scale))
    limit = F.when(F.lit(offset) >= 0, _HIGH).otherwise(_LOW)
    whole = lambda c: F.when(scaled(c) >= 2.0**63, F.lit(_HIGH)).when(scaled(c) <= -(2.0**63), F.lit(_LOW)).otherwise(F.floor(scaled(c)))
    return df.filter(sound).withColumn(out, F.transform(v, lambda c: F.coalesce(F.try_add(whole(c), F.lit(offset)), limit)))


def whiten(vectors: DataFrame, *, x_col: str = "x", components: int = 16, counts: bool = False) -> DataFrame:
    """Project every row's vector onto the leading unit eigenvectors of the covariance, divided by the roots of the eigenvalues.

    ``x_col`` holds arrays of longs. Each distinct vector weighs 1, or with ``counts`` as many as rows hold it. Returns a row per row and component
    (from 1, by falling eigenvalue): the other columns, ``component``, ``n`` (weight of the fit), ``deviation`` (sum over dimensions of the squares of n * x - S,
    where S are the sums; exact), ``whitened``, ``explained`` (the eigenvalue's share of the trace) and ``identity_error``, one value: the largest entry, over
    the fit, of the whitened vectors' covariance minus the identity. Covariances have the divisor n and are centred before multiplying.

    Null vectors and those with null components are left out. Vectors of different lengths are fitted by themselves. A component whose
    eigenvalue is below 1e-11 of the largest is rounding, has no direction and is left out, so equal vectors only, one vector or no components give no rows; ``identity_error``
    is null where no component is left. Rows that repeat count each; other columns stay, those named like a result are replaced. A deviation beyond
    64 bits is shown as the largest 64-bit number. An empty table gives an empty result. Runs jobs when it is called.

    Per vector length, tasks hold one square matrix; the driver gets sums and the leading components, never vectors.
    """
    spark = vectors.sparkSession
    results = ["component", "n", "deviation", "whitened", "explained", "identity_error"]
    carried = [c for c in vectors.columns if c != x_col and c.lower() not in results]
    key, times, c = unused(vectors, "key", "times", "c")
    x = F.col(x_col)
    sound = vectors.filter(x.isNotNull() & F.forall(x, lambda c: c.isNotNull())).withColumn(key, F.sha2(F.array_join(x.cast("array<string>"), ","), 256))
    rows = keep(sound.select(*carried, key), "rows")
    distinct = keep(sound.groupBy(F.col(key).alias("key")).agg(F.count("*").alias("times"), F.any_value(x_col).alias("x")).select("key", F.size("x").alias("dims"), "times", "x"), "distinct")
    parts = []
    for lengths in _rounds([r["dims"] for r in distinct.select("dims").distinct().filter("dims > 0").collect()]):
        some = distinct.filter(F.col("dims").isin(lengths))
        totals = _totals(some, counts)
        axes = _axes(_matrix(some, totals, counts), totals, components)
        parts.append(some.mapInArrow(lambda batches, totals=totals, axes=axes: _projected(batches, totals, axes), f"key string, dims int, times long, c array<struct<{_RESULT}>>"))
    fitted = spark.createDataFrame([], f"key string, dims int, times long, c array<struct<{_RESULT}>>")
    for part in parts:
        fitted = fitted.unionByName(part)
    fitted = keep(fitted, "whitened")
    discard(distinct)
    error = _identity_error(fitted, counts)
    each = looked_up(rows, fitted.select(F.col("key").alias(key), F.col("times").alias(times), F.col("c").alias(c)), key, times)
    return each.select(*carried, F.explode(c).alias(key)).select(*carried, f"{key}.*", F.lit(error).cast("double").alias("identity_error"))


def _rounds(lengths: Sequence[int]) -> Iterator[list[int]]:
    """Vector lengths whose matrices fit together into the memory of a task; usually all."""
    some: list[int] = []
    for d in sorted(lengths):
        if some and sum(e * e for e in some) + d * d > _MATRIX_ENTRIES:
            yield some
            some = []
        some.append(d)
    if some:
        yield some


def _groups(batch: pa.RecordBatch, counts: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Of each vector length in a batch: its rows, their vectors and weights."""
    dims = batch.column("dims").to_numpy()
    times = batch.column("times").to_numpy() if counts else np.ones(len(dims), np.int64)
    flat = batch.column("x").flatten().to_numpy()
    first = np.concatenate([[0], np.cumsum(dims)])
    for d in np.unique(dims):
        at = np.flatnonzero(dims == d)
        yield int(d), at, flat[first[at][:, None] + np.arange(d)], times[at]


def _summed(x: np.ndarray, w: np.ndarray) -> list[int]:
    """The exact weighted sum of each column."""
    low, high = x & 0xFFFFFFFF, x >> 32
    if w.max() < 1 << 31 and (int(np.abs(high).max()) + 1) * int(w.sum()) < 1 << 62:
        product = low * w[:, None]
        sums = (high * w[:, None]).sum(0), (product >> 32).sum(0), (product & 0xFFFFFFFF).sum(0)
        return [((int(a) + int(b)) << 32) + int(c) for a, b, c in zip(*sums)]
    return list((x.astype(object) * w.astype(object)[:, None]).sum(0))


def _totals(distinct: DataFrame, counts: bool) -> dict[int, Total]:
    """Weights and exact sums per vector length."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for batch in batches:
            for d, _, x, w in _groups(batch, counts):
                n, before = found.get(d, (0, [0] * d))
                found[d] = [n + int(w.sum()), [a + b for a, b in zip(before, _summed(x, w))]]
        for d, (n, total) in found.items():
            columns = [np.full(d, d, np.int32), np.arange(d, dtype=np.int32), np.full(d, n)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(list(map(Decimal, total)), pa.decimal128(38, 0))], names=["dims", "i", "n", "s"])

    parts = distinct.mapInArrow(sums, "dims int, i int, n long, s decimal(38,0)")
    out: dict[int, Total] = {}
    for r in parts.groupBy("dims", "i").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).orderBy("dims", "i").collect():
        out.setdefault(r["dims"], Total(r["n"], [])).sums.append(int(r["s"]))
    return out


def _centred(x: np.ndarray, total: Total) -> np.ndarray:
    whole, _, part = total.parts()
    # The difference of longs is exact unless it leaves their range.
    near = np.abs(x.astype(float) - whole).max(initial=0) < 2.0**62
    return (x - whole).astype(float) - part if near else x.astype(float) - (whole + part)


def _matrix(distinct: DataFrame, totals: dict[int, Total], counts: bool) -> DataFrame:
    """(dims, i, j, value) for i <= j: the centred vectors' products, summed."""

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for d, _, x, w in _groups(batch, counts):
                c = _centred(x, totals[d])
                product = (c * w[:, None]).T @ c
                found[d] = found[d] + product if d in found else product
        for d, m in found.items():
            i, j = np.triu_indices(d)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), d, np.int32)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(m[i, j])], names=["dims", "i", "j", "value"])

    return distinct.mapInArrow(products, "dims int, i int, j int, value double").groupBy("dims", "i", "j").agg(F.sum("value").alias("value"))


def _axes(matrix: DataFrame, totals: dict[int, Total], components: int) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per vector length the leading eigenvalues, their shares of the trace and unit eigenvectors; one task factors one length."""
    weights = {d: t.n for d, t in totals.items()}

    def factored(entries: pd.DataFrame) -> pd.DataFrame:
        d = int(entries["dims"].iloc[0])
        v = np.zeros((d, d))
        v[entries["i"], entries["j"]] = v[entries["j"], entries["i"]] = entries["value"] / weights[d]
        values, vectors = np.linalg.eigh(v)
        values, vectors = values[::-1], vectors[:, ::-1]
        trace, floor = np.trace(v), max(values[0], 0) * _ROUNDING
        found = [(d, k, values[k], values[k] / trace, vectors[:, k]) for k in range(min(components, d)) if values[k] > floor]
        return pd.DataFrame(found, columns=["dims", "k", "value", "share", "axis"])

    found = matrix.groupBy("dims").applyInPandas(factored, "dims int, k int, value double, share double, axis array<double>").orderBy("dims", "k").collect()
    out = {}
    for d in totals:
        own = [r for r in found if r["dims"] == d]
        out[d] = (np.array([r["value"] for r in own]), np.array([r["share"] for r in own]), np.array([r["axis"] for r in own]).reshape(-1, d).T)
    return out


def _deviations(x: np.ndarray, total: Total) -> np.ndarray:
    """The sum over dimensions of (n * x - S) ** 2, exact; beyond 64 bits the largest number of these."""
    whole, rest, _ = total.parts()
    far = np.abs(x.astype(float) - whole).max(initial=0) + 1
    if far * total.n < 2.0**31 / max(1, x.shape[1]) ** 0.5:
        # All parts and sums fit into 64 bits.
        return (((x - whole) * total.n - rest.astype(np.int64)) ** 2).sum(1)
    off = (x.astype(object) - whole.astype(object)) * total.n - rest
    return np.array([min(v, _HIGH) for v in (off * off).sum(1)], np.int64)


def _projected(batches: Iterator[pa.RecordBatch], totals: dict[int, Total], axes: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Every distinct vector's components."""
    for batch in batches:
        for d, at, x, _ in _groups(batch, False):
            values, shares, directions = axes[d]
            k, total = len(values), totals[d]
            whitened = _centred(x, total) @ directions / np.sqrt(values)
            fields = [
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(at))), pa.array(np.full(len(at) * k, total.n, np.int64)), pa.array(np.repeat(_deviations(x, total), k)),
                pa.array(whitened.ravel()), pa.array(np.tile(shares, len(at))),
            ]
            items = pa.StructArray.from_arrays(fields, names=["component", "n", "deviation", "whitened", "explained"])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * k, pa.int32()), items)
            yield pa.RecordBatch.from_arrays([*[batch.column(c).take(pa.array(at)) for c in ("key", "dims", "times")], lists], names=["key", "dims", "times", "c"])


def _identity_error(fitted: DataFrame, counts: bool) -> float | None:
    """The largest absolute entry, over all vector lengths, of the whitened vectors' centred covariance minus the identity."""
    weight = F.col("times") if counts else F.lit(1)
    flat = fitted.select("dims", weight.cast("double").alias("w"), F.transform("c", lambda c: c["whitened"]).alias("y")).filter(F.size("y") > 0)
    mean = flat.select("dims", "w", F.posexplode("y").alias("i", "v")).groupBy("dims", "i").agg((F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias("mean")).collect()
    if not mean:
        return None
    means = {d: np.array([m["mean"] for m in sorted(mean, key=lambda m: m["i"]) if m["dims"] == d]) for d in {m["dims"] for m in mean}}

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for batch in batches:
            dims, w = batch.column("dims").to_numpy(), batch.column("w").to_numpy()
            y, first = batch.column("y").flatten().to_numpy(), np.concatenate([[0], np.cumsum(pc.list_value_length(batch.column("y")).to_numpy())])
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                c = y[first[at][:, None] + np.arange(len(means[d]))] - means[d]
                have = found.setdefault(int(d), [0.0, 0.0])
                have[0], have[1] = have[0] + w[at].sum(), have[1] + (c * w[at][:, None]).T @ c
        for d, (n, m) in found.items():
            i, j = np.triu_indices(len(m))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), d, np.int32)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(np.full(len(i), n)), pa.array(m[i, j])], names=["dims", "i", "j", "n", "value"])

    entries = flat.mapInArrow(products, "dims int, i int, j int, n double, value double").groupBy("dims", "i", "j").agg((F.sum("value") / F.sum("n")).alias("value"))
    return entries.agg(F.max(F.abs(F.col("value") - (F.col("i") == F.col("j")).cast("double")))).head()[0]
