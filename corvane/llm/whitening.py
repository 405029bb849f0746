"""Embedding whitening: spectral divide and conquer over QDWH polar decompositions, then a broadcast projection."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.vectors import matrix, usable

#: Entries are counted in steps of 1/1024, from an offset that keeps them positive.
STEPS, OFFSET = 1024, 100_000
#: Beyond this, steps and their sums might not fit a long.
LARGEST = 2.0**40
EPS = float(np.finfo(np.float64).eps)


@dataclass(frozen=True)
class Whitening:
    """A fitted model. components has a unit eigenvector in each row, by falling eigenvalue; the largest entry of each is positive."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    eigenvalues: np.ndarray
    explained: np.ndarray

    @property
    def scales(self) -> np.ndarray:
        """1 / sqrt(eigenvalue); NaN for components without variance, whose whitened values are null."""
        flat = self.eigenvalues <= len(self.sums) * EPS * max(self.eigenvalues.max(initial=0.0), 0.0)
        return np.where(flat, np.nan, 1 / np.sqrt(np.where(flat, 1.0, self.eigenvalues)))


def polar(a: np.ndarray, low: float) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix of norm 1 at most, whose singular values are `low` or more.

    QDWH: Halley steps with the weights that bring the interval [low, 1] nearest to 1, each by a QR factorisation.
    """
    x, eye = a, np.eye(len(a))
    for _ in range(60):
        sq = low * low
        g = np.cbrt(4 * (1 - sq) / sq**2)
        h = np.sqrt(1 + g) + np.sqrt(8 - 4 * g + 8 * (2 - sq) / (sq * np.sqrt(1 + g))) / 2
        b = (h - 1) ** 2 / 4
        c = h + b - 1
        q, _ = np.linalg.qr(np.vstack([np.sqrt(c) * x, eye]))
        new = (b / c) * x + (h - b / c) / np.sqrt(c) * (q[: len(a)] @ q[len(a) :].T)
        new = (new + new.T) / 2
        moved, x = np.linalg.norm(new - x), new
        low = min(1.0, low * (h + b * sq) / (1 + c * sq))
        if moved <= np.cbrt(EPS) and 1 - low <= 10 * EPS:
            break
    return x


def _shift(a: np.ndarray, refused: int) -> tuple[float, float, float]:
    """(shift, norm, low): a value inside the spectrum, far from every eigenvalue; `refused` of the best have split nothing."""
    diagonal = np.sort(np.diag(a))
    middle = len(a) // 2
    spots = [*((diagonal[max(0, middle - 3) : middle + 3][:-1] + diagonal[max(0, middle - 3) : middle + 3][1:]) / 2), diagonal.mean(), np.median(diagonal)]
    found = []
    for spot in spots:
        moved = a - spot * np.eye(len(a))
        norm = np.abs(moved).sum(axis=0).max()
        if norm > 0:
            try:
                low = 1 / np.abs(np.linalg.inv(moved / norm)).sum(axis=0).max()
            except np.linalg.LinAlgError:
                continue
            found.append((min(1.0, max(low, EPS)), norm, spot))
    found.sort(reverse=True)
    low, norm, spot = found[min(refused, len(found) - 1)] if found else (EPS, np.abs(a).sum(axis=0).max(), float(np.median(diagonal)))
    return spot, norm, low


def eigenvectors(a: np.ndarray, wanted: int) -> np.ndarray:
    """Unit eigenvectors (rows) of a symmetric matrix for its `wanted` largest eigenvalues, by falling eigenvalue.

    The polar factor U of a - shift gives the projector (U + 1) / 2 onto the invariant subspace above the shift. a is
    restricted to it and to its complement, and each is split again; parts below those that are wanted aren't split.
    """
    rng, tiny = np.random.default_rng(7), len(a) * EPS * max(np.abs(a).max(initial=0.0), np.finfo(np.float64).tiny)
    done: list[np.ndarray] = []

    def split(part: np.ndarray, basis: np.ndarray) -> None:
        if len(done) >= wanted:
            return
        n = len(part)
        if n == 1 or np.abs(part - np.diag(np.diag(part))).max() <= tiny:
            done.extend(basis[:, i] for i in np.argsort(-np.diag(part), kind="stable"))
            return
        for refused in range(7):
            spot, norm, low = _shift(part, refused)
            projector = (polar((part - spot * np.eye(n)) / norm, low) + np.eye(n)) / 2
            k = int(round(np.trace(projector)))
            if 0 < k < n:
                break
        else:  # eigenvalues that rounding alone tells apart: any basis will do
            done.extend(basis[:, i] for i in np.argsort(-np.diag(part), kind="stable"))
            return
        some, _ = np.linalg.qr(projector @ rng.standard_normal((n, k)))
        both, _ = np.linalg.qr(projector @ some, mode="complete")
        turned = both.T @ part @ both
        turned = (turned + turned.T) / 2
        split(turned[:k, :k], basis @ both[:, :k])
        split(turned[k:, k:], basis @ both[:, k:])

    if len(a):
        split((a + a.T) / 2, np.eye(len(a)))
    rows = np.array(done[: max(wanted, 0)]).reshape(-1, len(a))
    values = np.einsum("ki,ij,kj->k", rows, a, rows)
    rows = rows[np.argsort(-values, kind="stable")]
    tops = rows[np.arange(len(rows)), np.abs(rows).argmax(axis=1)] if len(a) else np.empty(0)
    return rows * np.where(tops < 0, -1.0, 1.0)[:, None]


def _steps(column: pa.Array, width: int) -> np.ndarray:
    """Entries as whole steps (int64)."""
    x = matrix(column, width)
    if np.abs(x).max(initial=0.0) >= LARGEST:
        raise ValueError("an entry is too large to be counted in steps")
    return np.floor(STEPS * x).astype(np.int64) + OFFSET


def _summed(rows: DataFrame, part: Callable[[pa.Array], np.ndarray], size: int, whole: bool = True) -> np.ndarray:
    """The sum of `part` (an array of `size` numbers) over all batches of x: added up in each task, then by Spark position by position.

    Whole numbers are summed as such, whatever their size, so that the sum doesn't hang on how rows are dealt.
    """
    kind = "decimal(38,0)" if whole else "double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                new = part(batch.column(0).slice(at, 4096))
                new = new.astype(object) if whole else new
                total = new if total is None else total + new
        if total is not None:
            values = [int(v) for v in total.ravel()] if whole else total.ravel().tolist()
            yield pa.RecordBatch.from_arrays([pa.array([values], pa.list_(pa.decimal128(38, 0) if whole else pa.float64()))], names=["part"])

    parts = rows.select("x").mapInArrow(run, f"part array<{kind}>").select(F.posexplode("part").alias("at", "value"))
    out = np.zeros(size, dtype=object if whole else np.float64)
    table = parts.groupBy("at").agg(F.sum("value").alias("total")).toArrow()
    for at, value in zip(table.column("at").to_pylist(), table.column("total").to_pylist(), strict=True):
        out[at] = int(value) if whole else value
    return out


def fit(rows: DataFrame, width: int, components: int) -> Whitening:
    """The model of all rows (vec_id, x) that `usable` gives.

    Sums first, then products of steps centred at the whole number next to their mean: whole numbers again, and sums of these
    are exact; what the mean has beyond the whole number is taken off at the end. Matrices have width * width numbers in
    each task and in the driver, whatever the number of rows.
    """

    def sums(x: pa.Array) -> np.ndarray:
        return np.concatenate([[len(x)], _steps(x, width).sum(axis=0)])

    first = _summed(rows, sums, width + 1)
    n, total = int(first[0]), first[1:]
    if not n:
        return Whitening(0, np.zeros(width, dtype=np.int64), np.empty((0, width)), np.empty(0), np.empty(0))
    centre = np.array([(2 * s + n) // (2 * n) for s in total], dtype=np.int64)

    def products(x: pa.Array) -> np.ndarray:
        c = (_steps(x, width) - centre).astype(np.float64)
        return c.T @ c  # exact below 2 ** 53

    second = _summed(rows, products, width * width).reshape(width, width)
    rest = np.array([int(s) - n * int(c) for s, c in zip(total, centre, strict=True)], dtype=object)
    scaled = second * n - np.outer(rest, rest)  # whole numbers: n * n times the covariance
    covariance = np.array([[v / (n * n) for v in row] for row in scaled.tolist()], dtype=np.float64)
    vectors = eigenvectors(covariance, min(components, width))
    values = np.maximum(np.einsum("ki,ij,kj->k", vectors, covariance, vectors), 0.0)
    trace = float(np.trace(covariance))
    return Whitening(n, total, vectors, values, values / trace if trace > 0 else np.zeros(len(values)))


def _whitened(x: np.ndarray, model: Whitening) -> np.ndarray:
    mean = np.array([s / model.n for s in model.sums.tolist()])
    return (x - mean) @ model.components.T * model.scales


def identity_error(rows: DataFrame, model: Whitening) -> float | None:
    """The largest absolute entry of the whitened rows' covariance minus the identity, over components with variance; None without any."""
    keep = np.flatnonzero(~np.isnan(model.scales))
    k, width = len(keep), len(model.sums)
    if not model.n or not k:
        return None

    def products(x: pa.Array) -> np.ndarray:
        w = _whitened(_steps(x, width), model)[:, keep]
        return np.concatenate([w.sum(axis=0), (w.T @ w).ravel()])

    total = _summed(rows, products, k + k * k, whole=False) / model.n
    mean, second = total[:k], total[k:].reshape(k, k)
    return float(np.abs(second - np.outer(mean, mean) - np.eye(k)).max())


def apply(rows: DataFrame, model: Whitening) -> DataFrame:
    """(vec_id, deviation decimal(38,0), whitened array<double>) of each row; the model, width * components numbers, is broadcast."""
    width, kind = len(model.sums), rows.schema["vec_id"].dataType.simpleString()
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        sums = np.array(m.sums.tolist(), dtype=object)
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                x = _steps(batch.column(1), width)
                reach = max((abs(m.n * v - s) for top in (x.min(axis=0), x.max(axis=0)) for v, s in zip(top.tolist(), sums, strict=True)), default=0)
                if reach * reach * width < 2**62:
                    off = x * m.n - sums.astype(np.int64)
                    deviation = (off * off).sum(axis=1).tolist()
                else:  # whole numbers of any size
                    off = x.astype(object) * m.n - sums
                    deviation = (off * off).sum(axis=1).tolist()
                w = _whitened(x, m)
                lists = pa.ListArray.from_arrays(np.arange(len(w) + 1, dtype=np.int32) * w.shape[1], pa.array(w.ravel(), mask=np.isnan(w.ravel())))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([int(v) for v in deviation], pa.decimal128(38, 0)), lists], names=["vec_id", "deviation", "whitened"])

    return rows.mapInArrow(run, f"vec_id {kind}, deviation decimal(38,0), whitened array<double>")


def whiten(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", components: int = 8) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row for each vector that takes part and each component.

    Null, empty and non-finite vectors and those of another length than most take no part; repeated rows and null ids count
    and come out like others; other columns, whatever their names, don't go on. An empty table gives no rows. Components without variance (all vectors
    alike) have null for whitened and don't count in identity_error, which is null if there is none with variance. Among
    eigenvalues that tie, any orthonormal vectors of their space are components.
    """
    rows, width = usable(vectors, vec_id, vector)
    model = fit(rows, width, components)
    error = identity_error(rows, model)
    shares = F.array(*[F.lit(float(v)) for v in model.explained]) if len(model.explained) else F.array().cast("array<double>")
    out = apply(rows, model).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return out.select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.element_at(shares, F.col("at") + 1).alias("explained"), F.lit(error).cast("double").alias("identity_error"))
