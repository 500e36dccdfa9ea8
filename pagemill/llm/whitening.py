"""Whitening of vectors on an integer grid, fitted on distinct vectors with weights.

Rows with the same grid vector are one vector with a multiplicity.  The fit
counts each distinct vector once or as often as it occurs; its sums are exact,
its covariance is a weighted product of centred blocks.  Each distinct vector
is whitened once and joined back to its rows, so a vector that a third of all
rows share costs one projection.  The driver sees numbers by dimension only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.session import written

# Rows that a worker multiplies at once.
_BLOCK = 4096
_EXACT = 1 << 62


@dataclass(frozen=True)
class Fit:
    """What is known of the distinct vectors of one length: weight, exact sums, eigenvalues and unit eigenvectors (columns)."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums], dtype=float)

    @property
    def usable(self) -> np.ndarray:
        """Eigenvalues that are not zero up to rounding."""
        limit = len(self.sums) * np.finfo(float).eps * max(self.trace, 0.0)
        return self.values > limit


def grid_rows(df: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """``id``, ``x`` (longs) and ``key`` of each row whose vector and all its entries are there and finite."""
    entry = F.col(f"`{vec_col}`")
    whole = F.forall(entry, lambda c: F.coalesce(F.abs(c.cast("double")) < float("inf"), F.lit(False)))
    rows = df.filter(entry.isNotNull() & whole)
    x = F.transform(entry, lambda c: F.floor(c.cast("double") * float(scale)).cast("long"))
    return rows.select(F.col(f"`{id_col}`").alias("id"), x.alias("x"))


def _key(x: Column) -> Column:
    return F.unhex(F.sha2(F.array_join(x, ","), 256))


def distinct_vectors(rows: DataFrame, weights: str) -> DataFrame:
    """Each grid vector once, with its ``weight``; written, as the fit reads it several times."""
    if weights not in ("one", "count"):
        raise ValueError("weights are 'one' or 'count'")
    counted = rows.groupBy("x").agg(F.count(F.lit(1)).alias("count"))
    weight = F.col("count") if weights == "count" else F.lit(1).cast("long")
    return written(counted.select(_key(F.col("x")).alias("key"), "x", F.size("x").alias("dim"), weight.alias("weight")), "whitening-distinct")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, pa.RecordBatch]]:
    """Matrices of vectors of one length, their weights, and the rows they come from."""
    for batch in batches:
        dims = batch.column("dim").to_numpy(zero_copy_only=False)
        for dim in np.unique(dims):
            part = batch.filter(pa.array(dims == dim)) if (dims != dim).any() else batch
            for start in range(0, part.num_rows, _BLOCK):
                piece = part.slice(start, _BLOCK)
                x = piece.column("x").flatten().to_numpy(zero_copy_only=False).reshape(piece.num_rows, int(dim))
                yield int(dim), x, piece.column("weight").to_numpy(zero_copy_only=False), piece


def _integers(x: np.ndarray, bound: int) -> np.ndarray:
    """``x`` as it is where results stay below ``bound`` bits of 64, else as Python's integers."""
    return x if bound < _EXACT else x.astype(object)


def _largest(x: np.ndarray) -> int:
    return max(-int(x.min()), int(x.max()), 1) if x.size else 1


def _sums(distinct: DataFrame) -> dict[int, tuple[int, tuple[int, ...]]]:
    """For each length the total weight and the exact weighted sum of each dimension."""

    def partial(batches):
        held: dict[int, list] = {}
        for dim, x, weight, _ in _blocks(batches):
            bound = _largest(x) * _largest(weight) * len(weight)
            own = _integers(weight, bound) @ _integers(x, bound) if dim else []
            mine = held.setdefault(dim, [0, [0] * dim])
            mine[0] += sum(weight.tolist())
            mine[1] = [a + int(b) for a, b in zip(mine[1], own)]
        rows = [(dim, place, Decimal(n), Decimal(s)) for dim, (n, sums) in held.items() for place, s in enumerate(sums)]
        kind = pa.decimal128(38, 0)
        columns = list(zip(*rows)) or [[]] * 4
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), kind, kind))], ["dim", "place", "n", "s"]
        )

    parts = distinct.select("x", "dim", "weight").mapInArrow(partial, "dim int, place int, n decimal(38,0), s decimal(38,0)")
    found = parts.groupBy("dim", "place").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect()
    sums: dict[int, dict[int, tuple[int, int]]] = {}
    for row in found:
        sums.setdefault(row["dim"], {})[row["place"]] = (int(row["n"]), int(row["s"]))
    return {dim: (own[0][0], tuple(own[i][1] for i in range(dim))) for dim, own in sums.items()}


def _covariances(distinct: DataFrame, sums: dict[int, tuple[int, tuple[int, ...]]]) -> dict[int, np.ndarray]:
    """For each length the weighted covariance, centred before it is multiplied."""
    means = {dim: np.array([s / n for s in own], dtype=float) for dim, (n, own) in sums.items()}

    def partial(batches):
        held: dict[int, np.ndarray] = {}
        for dim, x, weight, _ in _blocks(batches):
            if dim:
                centred = x - means[dim]
                held[dim] = held.get(dim, 0.0) + (centred * weight[:, None]).T @ centred
        for dim, gram in held.items():
            i, j = np.triu_indices(dim)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(i), dim, np.int32)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(gram[i, j])],
                ["dim", "i", "j", "v"],
            )

    parts = distinct.select("x", "dim", "weight").mapInArrow(partial, "dim int, i int, j int, v double")
    found = {dim: np.zeros((dim, dim)) for dim in sums}
    for row in parts.groupBy("dim", "i", "j").agg(F.sum("v").alias("v")).collect():
        found[row["dim"]][row["i"], row["j"]] = found[row["dim"]][row["j"], row["i"]] = row["v"] / sums[row["dim"]][0]
    return found


def fit(distinct: DataFrame, components: int) -> dict[int, Fit]:
    """A fit for each length of vectors.  What is collected is bounded by the square of the length."""
    sums = _sums(distinct)
    fits = {}
    for dim, covariance in _covariances(distinct, sums).items():
        values, vectors = np.linalg.eigh(covariance)
        values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
        largest = vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])]
        fits[dim] = Fit(*sums[dim], np.maximum(values, 0.0), vectors * np.where(largest < 0, -1.0, 1.0), float(np.trace(covariance)))
    return fits


def _projected(distinct: DataFrame, fits: dict[int, Fit]) -> DataFrame:
    """Each distinct vector whitened once: ``key, dim, weight, n, deviation, y``; written."""

    def project(batches):
        for dim, x, weight, piece in _blocks(batches):
            if not dim:
                continue
            own = fits[dim]
            with np.errstate(divide="ignore", invalid="ignore"):
                y = (x - own.mean) @ own.vectors / np.sqrt(own.values)
            bound = 4 * (own.n * _largest(x)) ** 2 * dim
            away = _integers(x, bound) * own.n - _integers(np.array(own.sums, dtype=object if bound >= _EXACT else np.int64), bound)
            y = [[v if good else None for v, good in zip(row, own.usable)] for row in y.tolist()]
            yield pa.RecordBatch.from_arrays(
                [
                    piece.column("key"), piece.column("dim"), piece.column("weight"), pa.array([own.n] * len(weight), pa.int64()),
                    pa.array((away * away).sum(axis=1).tolist(), pa.int64()), pa.array(y, pa.list_(pa.float64())),
                ],
                ["key", "dim", "weight", "n", "deviation", "y"],
            )

    made = distinct.select("key", "x", "dim", "weight").mapInArrow(project, "key binary, dim int, weight long, n long, deviation long, y array<double>")
    return written(made, "whitening-projected")


def _identity_errors(projected: DataFrame, fits: dict[int, Fit], components: int) -> dict[int, float | None]:
    """For each length the largest entry of the whitened vectors' covariance less the identity, over the components that could be whitened."""
    y = [F.get(F.col("y"), F.lit(i)) for i in range(components)]
    weight = F.col("weight").cast("double")
    means = {r["dim"]: r for r in projected.groupBy("dim").agg(*(F.sum(v * weight).alias(f"m{i}") for i, v in enumerate(y))).collect()}
    errors: dict[int, float | None] = {}
    for dim, own in fits.items():
        good = [i for i in range(len(own.values)) if own.usable[i]]
        if not good or dim not in means:
            errors[dim] = None
            continue
        centred = {i: y[i] - means[dim][f"m{i}"] / own.n for i in good}
        pairs = [(i, j) for i in good for j in good if i <= j]
        row = projected.filter(F.col("dim") == dim).agg(*(F.sum(centred[i] * centred[j] * weight).alias(f"v{i}_{j}") for i, j in pairs)).first()
        errors[dim] = max(abs(row[f"v{i}_{j}"] / own.n - (i == j)) for i, j in pairs)
    return errors


def whitened(
    df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = 4, scale: int = 256, weights: str = "one",
) -> DataFrame:
    """For each row and component its whitened coordinate, with the fit's figures.

    Rows whose vector is null or holds a null or non-finite entry are left
    out.  Each other entry c becomes floor(scale * c); entries beyond the
    range of a long are held at its ends.  Vectors of one length make up one
    fit; an empty vector has no component and so no row.  Null or repeated
    ids keep their rows.  A component along which the vectors do not vary
    cannot be whitened: ``whitened`` is null there, and where nothing varies
    at all ``explained`` and ``identity_error`` are null too.  Other columns
    are left out, whatever their names.  A ``deviation`` that no long can
    hold is an error.
    """
    rows = grid_rows(df, id_col, vec_col, scale)
    distinct = distinct_vectors(rows, weights)
    fits = fit(distinct, components)
    projected = _projected(distinct, fits)
    errors = _identity_errors(projected, fits, components)
    none = F.lit(None).cast("double")
    shares, error = F.array().cast("array<double>"), none
    for dim, own in fits.items():
        explained = [float(v / own.trace) if own.trace > 0 else None for v in own.values]
        shares = F.when(F.col("dim") == dim, F.array(*(F.lit(v).cast("double") for v in explained)) if explained else F.array().cast("array<double>")).otherwise(shares)
        error = F.when(F.col("dim") == dim, F.lit(errors[dim]).cast("double")).otherwise(error)
    met = rows.select("id", _key(F.col("x")).alias("key")).join(projected, "key")
    each = met.select("id", "n", "deviation", error.alias("identity_error"), F.posexplode(F.arrays_zip(F.col("y").alias("y"), shares.alias("share"))).alias("at", "c"))
    return each.select(
        F.col("id").alias(id_col), (F.col("at") + 1).cast("int").alias("component"), "n", "deviation",
        F.col("c.y").alias("whitened"), F.col("c.share").alias("explained"), "identity_error",
    )
