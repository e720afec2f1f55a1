"""Multinomial logistic regression over stored rows, in passes whose number doesn't grow with the rows.

The weighted mean loss plus ``regularization / 2`` times the squared coefficients, without the intercepts, has one minimum. It is
reached by L-BFGS steps over all rows, measured by the inverse of an approximate curvature: the terms' second moments, from
some rows only. That choice of rows affects the number of passes, not the minimum.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clearwake.operators.term_arrays import SLICE_ENTRIES, list_lengths, release, slices, unit_weights

#: The fit ends when a whole step would lower the objective by less.
TOLERANCE = 1e-8
#: Until a step lowers it by less than this, a bound of the curvature is used, then the curvature there.
NEAR = 1e-4
HISTORY = 30
#: Rows and entries of them that the second moments are taken from.
MOMENT_ROWS = 60_000
MOMENT_ENTRIES = 24_000_000
#: Terms whose moments are kept together; further ones have their own only.
MOMENT_TERMS = 6_000
DENSE_ROWS = 1_024
BAND_TERMS = 512
LEAST_PIVOT = 1e-12
#: Sums of a pass beyond this are added up by tasks before the driver gets them.
COLLECTED_BYTES = 64 << 20
TASKS_PER_CORE = 1

#: A row's label and weight, the length of its vector, and the terms and counts of it.
STORED = "label int, weight double, length double, terms binary, counts binary"


def _kind(most: int) -> type:
    """The smallest type that holds the numbers up to ``most``."""
    return np.min_scalar_type(most).type


def packed(idf: np.ndarray, most: int) -> Callable:
    """``STORED`` rows from ``label, weight, i, tf``, with counts of ``most`` at most."""

    def binary(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
        offsets = np.concatenate([[0], np.cumsum(lengths) * values.itemsize]).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(values)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, at = list_lengths(batch.column("i")), 0
            terms, counts = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("i", "tf"))
            for first, last in slices(lengths, SLICE_ENTRIES):
                own = lengths[first:last]
                some = slice(at, at := at + int(own.sum()))
                _, _, norm = unit_weights(own, terms[some], counts[some], idf)
                part = batch.slice(first, last - first)
                columns = [
                    part.column("label").cast(pa.int32()),
                    part.column("weight"),
                    pa.array(np.where(own > 0, norm, 1.0)),
                    binary(terms[some].astype(_kind(len(idf))), own),
                    binary(counts[some].astype(_kind(most)), own),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["label", "weight", "length", "terms", "counts"])
            del terms, counts, lengths, batch
            release()

    return run


def _flat(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """The values of all rows, and how many each has."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    if data is None or offsets[0] == offsets[-1]:
        return np.zeros(0, kind), np.zeros(len(column), np.int64)
    size = np.dtype(kind).itemsize
    return np.frombuffer(data, kind, (offsets[-1] - offsets[0]) // size, offsets[0]), np.diff(offsets).astype(np.int64) // size


def _blocks(batches: Iterator[pa.RecordBatch], idf: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Label, weight and vector length of some rows; entries of each; terms and sublinear counts of their entries."""
    known = 1.0 + np.log(np.maximum(np.arange(min(most, 1 << 16) + 1), 1))
    for batch in batches:
        terms, entries = _flat(batch.column("terms"), _kind(len(idf)))
        counts, _ = _flat(batch.column("counts"), _kind(most))
        labels, costs, norms = (batch.column(c).to_numpy() for c in ("label", "weight", "length"))
        at = 0
        for first, last in slices(entries, SLICE_ENTRIES):
            some = slice(at, at := at + int(entries[first:last].sum()))
            sublinear = known.take(counts[some]) if most < len(known) else 1.0 + np.log(counts[some].astype(np.float64))
            yield labels[first:last], costs[first:last], norms[first:last], entries[first:last], terms[some].astype(np.int64), sublinear
        release()


def _margins(scaled: np.ndarray, intercepts: np.ndarray, norms: np.ndarray, entries: np.ndarray, terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """By class and row, from coefficients times idf."""
    held = np.flatnonzero(entries)
    begins = (np.cumsum(entries) - entries)[held]
    margins = np.repeat(intercepts[:, None], len(entries), axis=1)
    if len(held):
        for k in range(len(scaled)):
            margins[k, held] += np.add.reduceat(scaled[k].take(terms) * counts, begins) / norms[held]
    return margins


def _sums(coefficients: np.ndarray, intercepts: np.ndarray, idf: np.ndarray, most: int) -> Callable:
    """Of a task: gradient by coefficient and by intercept, loss and weight, as one binary value."""
    classes, width = coefficients.shape
    scaled = coefficients * idf

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(classes * width + classes + 2)
        gradient, rest = total[: classes * width].reshape(classes, width), total[classes * width :]
        for labels, costs, norms, entries, terms, counts in _blocks(batches, idf, most):
            margins = _margins(scaled, intercepts, norms, entries, terms, counts)
            rows = np.arange(len(labels))
            own, top = margins[labels, rows], margins.max(axis=0)
            share = np.exp(margins - top)
            whole = share.sum(axis=0)
            rest[-2] += costs @ (np.log(whole) + top - own)
            rest[-1] += costs.sum()
            share /= whole
            share[labels, rows] -= 1.0
            share *= costs
            rest[:classes] += share.sum(axis=1)
            for k in range(classes):
                gradient[k] += np.bincount(terms, np.repeat(share[k] / norms, entries) * counts, minlength=width)
        gradient *= idf
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    return run


def total_sums(rows: DataFrame, tasks: int, coefficients: np.ndarray, *others) -> np.ndarray:
    """The sums of one pass over all rows."""
    parts = rows.mapInArrow(_sums(coefficients, *others), "sums binary")
    if tasks * coefficients.nbytes > COLLECTED_BYTES:
        return parts.rdd.map(lambda r: np.frombuffer(r[0])).treeReduce(np.add)
    return np.sum([np.frombuffer(r[0]) for r in parts.collect()], axis=0)


def _inverse_factor(a: np.ndarray) -> None:
    """Puts the inverse of the lower Cholesky factor in the place of a matrix."""
    if len(a) <= 32:
        lower, inverse = np.tril(a), np.zeros_like(a)
        for j in range(len(a)):
            lower[j:, j] -= lower[j:, :j] @ lower[j, :j]
            # rounding may leave nothing of a term that depends on others
            lower[j:, j] /= np.sqrt(max(lower[j, j], LEAST_PIVOT))
        for j in range(len(a)):
            inverse[j, j] = 1.0
            inverse[j] = (inverse[j] - lower[j, :j] @ inverse[:j]) / lower[j, j]
        a[...] = inverse
        return
    m = len(a) // 2
    first, side, last = a[:m, :m], a[m:, :m], a[m:, m:]
    _inverse_factor(first)
    side[...] = side @ first.T
    last -= side @ side.T
    _inverse_factor(last)
    side[...] = -(last @ (side @ first))
    a[:m, m:] = 0.0


@dataclass
class Curvature:
    """Inverse of an approximate curvature of the objective, the same for all classes."""

    #: Of the intercept and the first terms, triangular.
    factor: np.ndarray
    #: Of each further term.
    further: np.ndarray

    def solve(self, gradient: np.ndarray, classes: int) -> np.ndarray:
        by_class, width = gradient[:-classes].reshape(classes, -1), len(self.factor) - 1
        size = np.abs(gradient).max() or 1.0
        part = np.column_stack([gradient[-classes:], by_class[:, :width]]) / size
        solved = size * (self.factor.T @ (self.factor @ part.T.astype(np.float32))).T.astype(np.float64)
        return np.concatenate([np.column_stack([solved[:, 1:], by_class[:, width:] * self.further]).ravel(), solved[:, 0]])


def _some_rows(rows: DataFrame, entry_bytes: int) -> bytes:
    """As an Arrow stream."""
    count, size = rows.agg(F.count(F.lit(1)), F.sum(F.octet_length("terms"))).first()
    share = min(1.0, MOMENT_ROWS / max(count, 1), MOMENT_ENTRIES * entry_bytes / max(size or 0, 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for n, batch in enumerate(batches):
            yield batch.filter(pa.array(np.random.default_rng([n, batch.num_rows]).random(batch.num_rows) < share))

    table, sink = rows.mapInArrow(run, STORED).toArrow(), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table, max_chunksize=DENSE_ROWS)
    return sink.getvalue().to_pybytes()


def _band_moments(sample, idf: np.ndarray, most: int, coefficients: np.ndarray | None, intercepts: np.ndarray, together: int) -> Callable:
    """Of some bands: ``first, moments, own, total``, the second moments of the intercept and the terms from ``first`` on with those
    before; the moments of each term; the weight of the rows."""
    classes, width = len(intercepts), len(idf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for first in (f for batch in batches for f in batch.column(0).to_pylist()):
            last = min(first + BAND_TERMS, together + 1)
            moments, own, total = np.zeros((last - first, last)), np.zeros(width), 0.0
            for _, costs, norms, entries, terms, counts in _blocks(pa.ipc.open_stream(sample.value), idf, most):
                curved = 0.5 * (1.0 - 1.0 / classes)
                if coefficients is not None:
                    margins = _margins(coefficients * idf, intercepts, norms, entries, terms, counts)
                    share = np.exp(margins - margins.max(axis=0))
                    share /= share.sum(axis=0)
                    curved = (share * (1.0 - share)).mean(axis=0)
                root = np.sqrt(costs * curved)
                row = np.repeat(np.arange(len(entries)), entries)
                scaled = counts * idf[terms] * (root / norms)[row]
                own += np.bincount(terms, scaled * scaled, minlength=width)
                total += costs.sum()
                inside = terms < last - 1
                dense = np.zeros((len(entries), last))
                # the first place is the intercept's
                dense[:, 0] = root
                dense[row[inside], 1 + terms[inside]] = scaled[inside]
                moments += dense[:, first:].T @ dense
            columns = [pa.array([first]), pa.array([moments.tobytes()], pa.binary()), pa.array([own.tobytes()], pa.binary()), pa.array([total])]
            yield pa.RecordBatch.from_arrays(columns, ["first", "moments", "own", "total"])
            release()

    return run


def curvature(spark: SparkSession, sample, idf: np.ndarray, most: int, regularization: float, coefficients: np.ndarray | None, intercepts: np.ndarray) -> Curvature:
    """From the second moments of the terms in a broadcast sample: the mean curvature of the classes, or without coefficients its bound."""
    together = min(len(idf), MOMENT_TERMS)
    bands = spark.range(0, together + 1, BAND_TERMS, -(-(together + 1) // BAND_TERMS))
    found = bands.mapInArrow(_band_moments(sample, idf, most, coefficients, intercepts, together), "first long, moments binary, own binary, total double").collect()
    total, own = found[0]["total"] or 1.0, np.frombuffer(found[0]["own"])
    moments = np.zeros((together + 1, together + 1))
    while found:
        r = found.pop()
        part = np.frombuffer(r["moments"]).reshape(-1, min(r["first"] + BAND_TERMS, together + 1))
        moments[r["first"] : r["first"] + len(part), : part.shape[1]] = part / total
    moments[np.diag_indices(together + 1)] += regularization
    _inverse_factor(moments)
    return Curvature(moments.astype(np.float32), 1.0 / (own[together:] / total + regularization))


def minimize(value: Callable, solve: Callable, start: np.ndarray, tolerance: float, most: int) -> np.ndarray:
    """L-BFGS from ``start``; ``value`` gives the objective and its gradient, ``solve`` applies a first guess of the inverse curvature."""
    x, (f, g), steps = start, value(start), []
    for _ in range(most):
        step, parts = g.copy(), []
        for s, y, scale in reversed(steps):
            parts.append(scale * (s @ step))
            step -= parts[-1] * y
        guess = solve(step)
        if steps:
            s, y, _ = steps[-1]
            guess *= (s @ y) / (y @ solve(y))
        for (s, y, scale), part in zip(steps, reversed(parts)):
            guess += s * (part - scale * (y @ guess))
        gain = g @ guess
        if gain <= tolerance:
            break
        size = 1.0
        while True:
            moved = x - size * guess
            f_new, g_new = value(moved)
            if f_new <= f - 1e-4 * size * gain or size < 1e-6:
                break
            size /= 2
        if f_new > f:
            break
        s, y = moved - x, g_new - g
        if s @ y > 0:
            steps = [*steps, (s, y, 1.0 / (s @ y))][-HISTORY:]
        x, f, g = moved, f_new, g_new
    return x


def fit(rows: DataFrame, idf: np.ndarray, most: int, classes: int, regularization: float, passes: int) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients by class and term, and intercepts, from ``STORED`` rows with counts of ``most`` at most."""
    width = len(idf)
    rows = rows.coalesce(TASKS_PER_CORE * rows.sparkSession.sparkContext.defaultParallelism)
    tasks = rows.rdd.getNumPartitions()
    spark = rows.sparkSession
    sample = spark.sparkContext.broadcast(_some_rows(rows, np.dtype(_kind(width)).itemsize))

    def value(x: np.ndarray) -> tuple[float, np.ndarray]:
        coefficients, intercepts = x[:-classes].reshape(classes, width), x[-classes:]
        sums = total_sums(rows, tasks, coefficients, intercepts, idf, most)
        gradient = sums[:-2] / sums[-1]
        gradient[:-classes] += regularization * x[:-classes]
        return sums[-2] / sums[-1] + 0.5 * regularization * (x[:-classes] @ x[:-classes]), gradient

    x = np.zeros(classes * width + classes)
    for near, until in ((False, NEAR), (True, TOLERANCE)):
        about = curvature(spark, sample, idf, most, regularization, x[:-classes].reshape(classes, width) if near else None, x[-classes:])
        x = minimize(value, lambda g, of=about: of.solve(g, classes), x, until, passes)
        del about
    sample.destroy()
    return x[:-classes].reshape(classes, width), x[-classes:] - x[-classes:].mean()
