"""Usable vectors in compact form, cross-polytope cells, and streams of rows grouped by a key."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemolith.session import materialize

DIM = 64
#: Rows of one key handled at once; a longer run is cut into parts of this size, which the caller has to join.
RUN = 8192
#: The second nearest axis is looked at where its value is at least this part of the largest one's.
PROBE = 0.9
#: Vectors that are rotated at once.
_COLUMNS = 2048


def usable(vectors: DataFrame) -> DataFrame:
    """Rows with an id and a vector of DIM finite values that are not all zero."""
    fine = F.expr(f"memory_id IS NOT NULL AND size(vector) = {DIM} AND forall(vector, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) <= 3.4028235E38) AND exists(vector, x -> x <> 0)")
    return vectors.where(fine).select("memory_id", "vector", "embedded_at")


def to_matrix(column: pa.Array) -> np.ndarray:
    """A list column without nulls as rows of unit length."""
    x = np.asarray(column.flatten(), np.float64).reshape(len(column), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def quantised(x: np.ndarray) -> np.ndarray:
    """Unit vectors as 16-bit integers, the largest component of each at 32,767; cosines keep an error below 2e-5."""
    return np.rint(x * (32767 / np.abs(x).max(axis=1, keepdims=True))).astype("<i2")


def packed(x: np.ndarray) -> pa.Array:
    q = quantised(x)
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * x.shape[1]), len(x), [None, pa.py_buffer(np.ascontiguousarray(q))]).cast(pa.binary())


def unpacked(column: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(column), "<i2").reshape(len(column), -1).astype(np.float32)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def repeats(rows: DataFrame) -> DataFrame:
    """(n) of rows (n, memory_id, embedded_at) that are not the first of their memory_id."""
    at = F.struct(F.coalesce(F.col("embedded_at").cast("timestamp_ntz"), F.lit("9999-12-31").cast("timestamp_ntz")).alias("t"), "n")
    many = rows.groupBy("memory_id").agg(F.min(at).alias("m"), F.collect_list("n").alias("all"), F.count(F.lit(1)).alias("c")).where("c > 1")
    return materialize(many.select(F.explode("all").alias("n"), F.col("m.n").alias("first")).where("n <> first").select("n"))


#: Handles of repeated rows are broadcast up to this number.
BROADCAST_ROWS = 2_000_000


def without(rows: DataFrame, dropped: DataFrame) -> DataFrame:
    """rows whose n is not in dropped; broadcast only after counting it."""
    n = dropped.count()
    if not n:
        return rows
    return rows.join(F.broadcast(dropped) if n <= BROADCAST_ROWS else dropped, "n", "left_anti")


def grouped_runs(df: DataFrame, keys: list[str], fn: Callable[[pa.Table], pa.Table | None], schema: str) -> DataFrame:
    """fn over runs of at most RUN consecutive rows of equal keys; df must be partitioned and sorted by them."""

    def flush(parts: list[pa.RecordBatch]) -> pa.Table:
        return pa.Table.from_batches(parts).combine_chunks()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows, last = 0, None
        results: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [np.asarray(batch.column(k)) for k in keys]
            change = np.zeros(batch.num_rows, bool)
            for c in cols:
                change[1:] |= c[1:] != c[:-1]
            first = tuple(c[0] for c in cols)
            change[0] = last is not None and first != last
            edges = [*np.flatnonzero(change).tolist(), batch.num_rows]
            start = 0
            for k, edge in enumerate(edges):
                while start < edge:
                    take = min(edge - start, RUN - rows)
                    held.append(batch.slice(start, take))
                    rows, start = rows + take, start + take
                    if rows == RUN:
                        results.append(fn(flush(held)))
                        held, rows = [], 0
                if k < len(edges) - 1 and rows:
                    results.append(fn(flush(held)))
                    held, rows = [], 0
            last = tuple(c[-1] for c in cols)
            done = [r for r in results if r is not None and r.num_rows]
            size = sum(r.num_rows for r in done)
            if size > 20_000:
                yield from pa.concat_tables(done).combine_chunks().to_batches()
                results = []
            else:
                results = done
        if rows:
            results.append(fn(flush(held)))
        done = [r for r in results if r is not None and r.num_rows]
        if done:
            yield from pa.concat_tables(done).combine_chunks().to_batches()

    return df.mapInArrow(run, schema)


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the columns, whose length is a power of two; keeps lengths."""
    n, h = x.shape[0], 1
    while h < n:
        pairs = x.reshape(n // (2 * h), 2, h, -1)
        x = np.empty_like(pairs)
        np.add(pairs[:, 0], pairs[:, 1], out=x[:, 0])
        np.subtract(pairs[:, 0], pairs[:, 1], out=x[:, 1])
        h *= 2
    return x.reshape(n, -1) / np.sqrt(n, dtype=x.dtype)


@lru_cache
def signs(tables: int, digits: int) -> np.ndarray:
    """(tables, digits, 3, DIM): the random signs of three rounds per digit."""
    return np.random.Generator(np.random.PCG64(7)).choice(np.array([-1.0, 1.0], np.float32), (tables, digits, 3, DIM))


def rotated(x: np.ndarray, rounds: np.ndarray) -> np.ndarray:
    """A pseudo-rotation of the columns: three rounds of signs and a Hadamard transform."""
    for s in rounds:
        x = hadamard(x * s[:, None])
    return x


def shape(rows: int, cell: int) -> tuple[int, int]:
    """(digits, axes of the last digit) that leave about so many unrelated rows in a cell."""
    cells, digits = max(2.0, rows / cell), 1
    while cells > (2 * DIM) ** digits:
        digits += 1
    return digits, min(DIM, max(1, round(cells / (2 * DIM) ** (digits - 1) / 2)))


def cells(x: np.ndarray, tables: int, digits: int, last: int, start: int = 0, stop: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(rows, tables) cells of unit vectors, and the cell across the nearest wall, -1 where none is near.

    A digit is the signed axis that is nearest after a pseudo-rotation, one of 2 * DIM, the last one of 2 * last.
    With start and stop, those tables only.
    """
    which = range(tables)[start:stop]
    keys, nearby = np.empty((len(x), len(which)), np.int64), np.empty((len(x), len(which)), np.int64)
    turns = signs(tables, digits)
    for at in range(0, len(x), _COLUMNS):
        part = np.ascontiguousarray(x[at : at + _COLUMNS].T, np.float32)
        rows = np.arange(part.shape[1])
        for k, t in enumerate(which):
            own, second, ratio = [], [], []
            for d in range(digits):
                y = rotated(part, turns[t, d])[: DIM if d < digits - 1 else last]
                size = np.abs(y)
                a = size.argmax(axis=0)
                top = size[a, rows]
                own.append(2 * a + (y[a, rows] < 0))
                if len(y) > 1:
                    size[a, rows] = -1
                    b = size.argmax(axis=0)
                    ratio.append(size[b, rows] / np.maximum(top, 1e-30))
                    second.append(2 * b + (y[b, rows] < 0))
                else:
                    # one axis: the wall is where its sign changes
                    ratio.append(np.where(top < 0.02, 1.0, 0.0))
                    second.append(2 * a + (y[a, rows] >= 0))
            key = np.full(len(rows), t, np.int64)
            other = key.copy()
            weak = np.argmax(ratio, axis=0)
            for d in range(digits):
                key = key * (2 * DIM) + own[d]
                other = other * (2 * DIM) + np.where(weak == d, second[d], own[d])
            keys[at : at + _COLUMNS, k] = key
            nearby[at : at + _COLUMNS, k] = np.where(np.max(ratio, axis=0) >= PROBE, other, -1)
    return keys, nearby


@lru_cache
def meeting_rate(digits: int, last: int, cosine: float, visitors: bool | None) -> float:
    """How often two vectors of that cosine meet in one table, by 4,000 random pairs.

    They meet where one of them, in its own cell or the one across, finds the other in its own; with visitors also
    where both stand across; with None only where both find each other in their own cells.
    """
    rng = np.random.Generator(np.random.PCG64(5))
    x, z = rng.normal(size=(2, 4000, DIM))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z -= (z * x).sum(axis=1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    (a, pa), (b, pb) = cells(x, 1, digits, last), cells(cosine * x + np.sqrt(1 - cosine**2) * z, 1, digits, last)
    met = a == b
    if visitors is not None:
        met |= (pa == b) | (a == pb)
    if visitors:
        met |= (pa == pb) & (pa >= 0)
    return float(met.mean())


def tables_for(rows: int, cell: int, cosine: float, miss: float, visitors: bool = False) -> tuple[int, int, int]:
    """(tables, digits, axes of the last digit): so many that a pair of that cosine meets in none at most so often."""
    digits, last = shape(rows, cell)
    rate = meeting_rate(digits, last, cosine, visitors)
    return max(2, int(np.ceil(np.log(miss) / np.log(1 - rate)))), digits, last


def listed(a: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.FixedSizeListArray.from_arrays(pa.array(a.ravel(), kind), a.shape[1]).cast(pa.list_(kind))
