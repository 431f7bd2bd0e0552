"""Whitening by polarisation: every covariance is read off variances.

Entries become integers, floor(SCALE * c) + SHIFT. Over the distinct vectors (the fit list) one job adds up each
dimension, a second one the squares of z = n*x - S for every dimension and of z_i + z_j for every pair of
dimensions, all in integers, one row a pair and task. Half of var(z_i + z_j) - var(z_i) - var(z_j) is their
covariance; the driver gets only these d(d+1)/2 sums, assembles the matrix without rounding and takes its
eigenvectors. A third job over the fit list measures the covariance of the whitened values themselves.

Distinct vectors are grouped before they are shuffled, so that a vector in a third of all rows costs no task more
than a row a partition. Nothing but dimensions by dimensions reaches the driver.

Dropped are rows whose vector is null, is empty, or holds a null or non-finite entry. Vectors of different
lengths, or an entry of 2**47 / SCALE or more, raise an error. Components are those with an eigenvalue above
RANK of the largest, at most `components`: equal vectors alone have none and give no rows, nor does an empty
table. Each eigenvector's largest entry is positive. `deviation` is null where it is beyond a long;
`deviation_exact` holds it in 38 digits. Null and repeated vec_ids keep their rows. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from fractions import Fraction
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from orrery.llm.common import written

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 16
# Entries are below this in magnitude; eigenvalues below this share of the largest are rounding.
BOUND, RANK = 1 << 47, 1e-12
# Rows whose pair sums are formed at once; bits of the lower half of an integer that is squared in halves.
ROWS, HALF = 512, 24


class Fit(NamedTuple):
    """Whitening as fitted: n vectors, sums, directions (dimension, component), eigenvalues and their trace."""

    n: int
    sums: list[int]
    directions: np.ndarray
    values: np.ndarray
    trace: float


def integers(vectors: DataFrame) -> DataFrame:
    """vec_id and the integers `x` of the rows with a whole vector."""
    whole = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return vectors.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & whole).select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.transform("embedding", lambda c: F.floor(c.cast("double") * SCALE).cast("long") + SHIFT).alias("x"),
    )


def dimension_sums(fit_list: DataFrame) -> tuple[int, list[int]]:
    """The number of vectors and the sum of each dimension."""

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, total = 0, None
        for b in batches:
            if len(b):
                x = np.stack(b["x"].to_numpy()).astype(np.int64)
                if np.abs(x).max() >= BOUND:
                    raise ValueError(f"an entry of {BOUND // SCALE} or more")
                part = x.sum(axis=0).astype(object)
                n, total = n + len(x), part if total is None else total + part
        if n:
            yield pd.DataFrame({"d": range(len(total)), "n": n, "total": [Decimal(int(v)) for v in total]})

    rows = fit_list.mapInPandas(sums, "d int, n long, total decimal(38,0)") \
        .groupBy("d").agg(F.sum("n").alias("n"), F.sum("total").cast("decimal(38,0)").alias("total")).orderBy("d").collect()
    return (rows[0].n, [int(r.total) for r in rows]) if rows else (0, [])


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n*x - S in integers: of 64 bits where they fit, with room for the sum of two, else of any size."""
    wide = np.array(sums, dtype=object)
    low, high = x.min(axis=0).astype(object), x.max(axis=0).astype(object)
    if max(abs(v) for v in [*(n * low - wide), *(n * high - wide)]) < 1 << 47:
        # The differences from a whole number near the mean keep n*x itself from overflowing.
        near = np.array([s // n for s in sums], np.int64)
        rest = np.array([s - n * int(m) for s, m in zip(sums, near, strict=True)], np.int64)
        return n * (x - near) - rest
    return n * x.astype(object) - wide


def squares(v: np.ndarray) -> np.ndarray:
    """Column sums of squares in Python integers. 48-bit integers are squared in halves, so that no sum overflows."""
    if v.dtype == object:
        return (v * v).sum(axis=0)
    high, low = v >> HALF, v & ((1 << HALF) - 1)
    parts = [np.einsum("ij,ij->j", a, b).astype(object) for a, b in ((high, high), (high, low), (low, low))]
    return (parts[0] << 2 * HALF) + (parts[1] << HALF + 1) + parts[2]


def pair_variances(fit_list: DataFrame, n: int, sums: list[int]) -> dict[tuple[int, int], int]:
    """The sum over the vectors of z_i squared, as (i, i), and of (z_i + z_j) squared for i < j."""
    d = len(sums)

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for b in batches:
            for at in range(0, len(b), ROWS):
                z = centred(np.stack(b["x"].iloc[at:at + ROWS].to_numpy()).astype(np.int64), n, sums)
                found = np.concatenate([squares(z), *(squares(z[:, i:i + 1] + z[:, i + 1:]) for i in range(d - 1))])
                total = found if total is None else total + found
        if total is not None:
            pairs = [(i, i) for i in range(d)] + [(i, j) for i in range(d) for j in range(i + 1, d)]
            yield pd.DataFrame({"i": [i for i, _ in pairs], "j": [j for _, j in pairs], "total": [Decimal(int(v)) for v in total]})

    rows = fit_list.mapInPandas(add, "i int, j int, total decimal(38,0)") \
        .groupBy("i", "j").agg(F.sum("total").cast("decimal(38,0)").alias("total")).collect()
    return {(r.i, r.j): int(r.total) for r in rows}


def covariance(variances: dict[tuple[int, int], int], n: int, d: int) -> np.ndarray:
    """The covariance of x, each entry rounded once: sums of z's squares are n cubed times those of x."""
    v = np.zeros((d, d))
    for (i, j), total in variances.items():
        twice = 2 * total if i == j else total - variances[i, i] - variances[j, j]
        v[i, j] = v[j, i] = float(Fraction(twice, 2 * n ** 3))
    return v


def fitted(fit_list: DataFrame, components: int = COMPONENTS) -> Fit:
    """The whitening of the distinct vectors `x`."""
    n, sums = dimension_sums(fit_list)
    if not n:
        return Fit(0, [], np.zeros((0, 0)), np.zeros(0), 0.0)
    v = covariance(pair_variances(fit_list, n, sums), n, len(sums))
    values, directions = np.linalg.eigh(v)
    values, directions = values[::-1], directions[:, ::-1]
    kept = min(components, int((values > max(values[0], 0) * RANK).sum()))
    directions = directions[:, :kept]
    signs = np.sign(directions[np.abs(directions).argmax(axis=0), np.arange(kept)])
    return Fit(n, sums, directions * signs, values[:kept], float(np.trace(v)))


def project(x: np.ndarray, fit: Fit) -> tuple[np.ndarray, np.ndarray]:
    """The whitened values and the exact deviations of integer vectors."""
    z = centred(x, fit.n, fit.sums)
    wide = z if z.dtype == object or np.abs(z).max(initial=0) ** 2 >= (1 << 62) / z.shape[1] else None
    squared = (z * z).sum(axis=1) if wide is None else (wide.astype(object) ** 2).sum(axis=1)
    return (z / fit.n).astype(np.float64) @ fit.directions / np.sqrt(fit.values), squared


def identity_error(fit_list: DataFrame, fit: Fit) -> float:
    """The largest absolute entry of the covariance of the whitened fit list less the identity."""
    k = len(fit.values)

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first, second = np.zeros(k), np.zeros((k, k))
        for b in batches:
            if len(b):
                w, _ = project(np.stack(b["x"].to_numpy()).astype(np.int64), fit)
                first += w.sum(axis=0)
                second += w.T @ w
        i, j = np.indices((k, k)).reshape(2, -1)
        yield pd.DataFrame({"i": i, "j": j, "first": np.where(j == 0, first[i], 0.0), "second": second.ravel()})

    # Whitened values are centred already: their own mean, zero but for rounding, is taken off afterwards.
    rows = fit_list.mapInPandas(products, "i int, j int, first double, second double") \
        .groupBy("i", "j").agg(F.sum("first").alias("first"), F.sum("second").alias("second")).collect()
    mean, second = np.zeros(k), np.zeros((k, k))
    for r in rows:
        second[r.i, r.j] = r.second / fit.n
        mean[r.i] += r.first / fit.n
    return float(np.abs(second - np.outer(mean, mean) - np.eye(k)).max())


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error (and deviation_exact) of `vectors`
    (vec_id, embedding), one row a kept vector and component."""
    kept = integers(vectors)
    fit_list = written(kept.select("x").distinct(), "fit-list")
    lengths = [r[0] for r in fit_list.select(F.size("x")).distinct().orderBy(F.size("x")).limit(2).collect()]
    if len(lengths) > 1:
        raise ValueError(f"vectors of different lengths: {lengths}")
    fit = fitted(fit_list, components)
    k = len(fit.values)
    if not k:
        kept = kept.limit(0)
    error = identity_error(fit_list, fit) if k else 0.0

    @F.pandas_udf("whitened array<double>, squared decimal(38,0)")
    def values(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for x in batches:
            if len(x):
                w, squared = project(np.stack(x.to_numpy()).astype(np.int64), fit)
                yield pd.DataFrame({"whitened": list(w), "squared": [Decimal(int(s)) for s in squared]})
            else:
                yield pd.DataFrame({"whitened": [], "squared": []})

    explained = F.array(*[F.lit(float(e / fit.trace)) for e in fit.values]) if k else F.array(F.lit(0.0))
    found = kept.select("vec_id", values("x").alias("v"))
    rows = found.select("vec_id", F.col("v.squared").alias("squared"), F.posexplode("v.whitened").alias("at", "whitened"))
    return rows.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(fit.n).cast("long").alias("n"),
        F.expr("try_cast(squared AS long)").alias("deviation"), "whitened", F.get(explained, F.col("at")).alias("explained"),
        F.lit(error).alias("identity_error"), F.col("squared").alias("deviation_exact"),
    )
