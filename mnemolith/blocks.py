"""Exact comparison of the vectors of a group, block by block.

Every row that asks meets every home row of its group. A group beyond BLOCK rows on either side is divided evenly by a
hash of the handles into parts of about BLOCK, and each pair of parts is a block of its own, so that a hot group is
spread over tasks and no pair of it is left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mnemolith.session import arrow_map, materialize, ship

#: Rows of one side of a block, about.
BLOCK = 16384
#: Rows compared with a part at once.
STEP = 256
#: Divided groups are broadcast up to this number.
BROADCAST_GROUPS = 20_000


def packed(x: np.ndarray) -> pa.Array:
    """Rows of numbers as bytes."""
    wide = x.dtype.itemsize * x.shape[1]
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(wide), len(x), [None, pa.py_buffer(np.ascontiguousarray(x))]).cast(pa.binary())


def compared(rows: DataFrame, keys: list[str], fn: Callable[[pa.Table], Iterable[pa.Table]], schema: str, block: int | None = None) -> DataFrame:
    """fn over blocks of rows (keys, n, q, asks, home); within a block, every row that asks is to meet every home row."""
    block = block or BLOCK
    sized = rows.groupBy(*keys).agg(F.count_if("asks").alias("a"), F.count_if("home").alias("h")).where(F.greatest("a", "h") > block)
    heavy = materialize(sized.select(*keys, F.ceil(F.col("a") / block).cast("int").alias("pa"), F.ceil(F.col("h") / block).cast("int").alias("ph")).where("pa > 0 AND ph > 0"))
    count = heavy.count()
    if not count:
        laid = rows.withColumn("i", F.lit(0)).withColumn("j", F.lit(0))
    else:
        part = "CAST(pmod(xxhash64(n), {}) AS INT)"
        none = "CAST(array() AS array<struct<i: int, j: int, asks: boolean, home: boolean>>)"
        asked = f"IF(asks, transform(sequence(0, ph - 1), x -> named_struct('i', {part.format('pa')}, 'j', x, 'asks', true, 'home', false)), {none})"
        homes = f"IF(home, transform(sequence(0, pa - 1), x -> named_struct('i', x, 'j', {part.format('ph')}, 'asks', false, 'home', true)), {none})"
        side = F.broadcast(heavy) if count <= BROADCAST_GROUPS else heavy
        cells = F.expr(f"IF(pa IS NULL, array(named_struct('i', 0, 'j', 0, 'asks', asks, 'home', home)), concat({asked}, {homes}))")
        laid = rows.join(side, keys, "left").select(*keys, "n", "q", F.explode(cells).alias("z")).select(*keys, "n", "q", "z.i", "z.j", "z.asks", "z.home")
    cell = [*keys, "i", "j"]
    laid = laid.repartition(*cell).sortWithinPartitions(*cell).select(*cell, "n", "q", "asks", "home")
    return _by_cell(laid, cell, fn, schema)


def paired(rows: DataFrame, fn: Callable[[pa.Table], Iterable[pa.Table]], schema: str, block: int | None = None) -> DataFrame:
    """fn over blocks (n and the other columns of rows, asks, home) in which every two of the rows meet once.

    The rows are divided by a hash of the handles into parts of about block. Where both sides are one part, all rows
    ask and are home; else those of one part ask and those of the other are home. Nothing is shuffled but the rows
    themselves, one more time than there are parts.
    """
    parts = max(1, -(-rows.count() // (block or BLOCK)))
    later = f"transform(sequence(p, {parts - 1}), x -> named_struct('i', p, 'j', x, 'asks', true, 'home', x = p))"
    sooner = "IF(p > 0, transform(sequence(0, p - 1), x -> named_struct('i', x, 'j', p, 'asks', false, 'home', true)), array())"
    laid = rows.withColumn("p", F.expr(f"CAST(pmod(xxhash64(n), {parts}) AS INT)")).select(*rows.columns, F.explode(F.expr(f"concat({later}, {sooner})")).alias("z"))
    laid = laid.select("z.i", "z.j", *rows.columns, "z.asks", "z.home").repartition("i", "j").sortWithinPartitions("i", "j")
    return _by_cell(laid, ["i", "j"], fn, schema)


def _by_cell(df: DataFrame, cell: list[str], fn: Callable[[pa.Table], Iterable[pa.Table]], schema: str) -> DataFrame:
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        done: list[pa.Table] = []
        last = None

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal held, done
            for out in fn(pa.Table.from_batches(held).combine_chunks()):
                if out.num_rows:
                    done.append(out)
                if out.num_rows > 20_000:
                    yield from pa.concat_tables(done).combine_chunks().to_batches()
                    done = []
            held = []

        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in cell]
            change = np.zeros(batch.num_rows, bool)
            for c in cols:
                change[1:] |= c[1:] != c[:-1]
            start, first = 0, tuple(c[0] for c in cols)
            if held and first != last:
                yield from close()
            for edge in np.flatnonzero(change).tolist():
                held.append(batch.slice(start, edge - start))
                yield from close()
                start = edge
            held.append(batch.slice(start))
            last = tuple(c[-1] for c in cols)
            if sum(t.num_rows for t in done) > 20_000:
                yield from pa.concat_tables(done).combine_chunks().to_batches()
                done = []
        if held:
            yield from close()
        if done:
            yield from pa.concat_tables(done).combine_chunks().to_batches()

    return df.mapInArrow(run, schema)


def best(vectors: Callable[[list[bytes]], np.ndarray], most: int, least: float | None) -> Callable[[pa.Table], Iterable[pa.Table]]:
    """Within a block, for each row that asks the most similar home rows other than itself: (a, b, c)."""

    def rank(rows: pa.Table) -> Iterator[pa.Table]:
        asks, home = (rows.column(k).to_numpy() for k in ("asks", "home"))
        if len(asks) < 2 or not asks.any() or not home.any():
            return
        n, x = rows.column("n").to_numpy(), vectors(rows.column("q").to_pylist())
        an, ax, hn, hx = n[asks], x[asks], n[home], x[home]
        out_a, out_b, out_c = [], [], []
        for s in range(0, len(an), STEP):
            own = an[s : s + STEP]
            c = ax[s : s + STEP] @ hx.T
            c[own[:, None] == hn[None, :]] = -2
            fits = c >= (least if least is not None else -1.5)
            count = fits.sum(axis=1)
            few = np.flatnonzero((count > 0) & (count <= most))
            r, j = np.nonzero(fits[few])
            out_a.append(own[few[r]]), out_b.append(hn[j]), out_c.append(c[few[r], j])
            many = np.flatnonzero(count > most)
            if len(many):
                part = c[many]
                top = np.argpartition(part, -most, axis=1)[:, -most:]
                out_a.append(np.repeat(own[many], most)), out_b.append(hn[top].ravel()), out_c.append(np.take_along_axis(part, top, axis=1).ravel())
        if out_a:
            yield pa.table({"a": np.concatenate(out_a), "b": np.concatenate(out_b), "c": np.concatenate(out_c).astype(x.dtype)})

    return rank


def top(found: DataFrame, most: int) -> DataFrame:
    """(a, b, c): of all rows of a in found, the most similar ones."""
    order = F.array_sort(F.collect_list(F.struct((-F.col("c")).alias("d"), "b")))
    return found.groupBy("a").agg(F.slice(order, 1, most).alias("all")).select("a", F.explode("all").alias("m")).select("a", F.col("m.b").alias("b"), (-F.col("m.d")).alias("c"))


def numbered(rows: DataFrame, vector: str = "v", kind: str = "<f8") -> DataFrame:
    """rows with a handle n, and the unit vector as bytes q in place of its column."""
    kept = [f for f in rows.schema.fields if f.name != vector]
    schema = T.StructType([T.StructField("n", T.LongType()), *kept, T.StructField("q", T.BinaryType())])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        v = batch.column(vector)
        q = packed(np.asarray(v.flatten(), kind).reshape(len(v), -1))
        return pa.RecordBatch.from_arrays([batch.column("n"), *(batch.column(f.name) for f in kept), q], names=schema.names)

    return materialize(arrow_map(rows.withColumn("n", F.monotonically_increasing_id()), run, schema))


def unpacked(column: list[bytes], kind: str = "<f8") -> np.ndarray:
    return np.frombuffer(b"".join(column), kind).reshape(len(column), -1)


def pairs(least: float) -> Callable[[pa.Table], Iterable[pa.Table]]:
    """Within a block, the pairs (a, b, c), a < b, with a cosine c of least or more, of a row that asks and a home row."""

    def find(rows: pa.Table) -> Iterator[pa.Table]:
        n, x = rows.column("n").to_numpy(), unpacked(rows.column("q").to_pylist())
        asks, home = (rows.column(k).to_numpy() for k in ("asks", "home"))
        an, ax, hn, hx = n[asks], x[asks], n[home], x[home]
        low = hx.astype(np.float32)
        for s in range(0, len(an), STEP):
            own, own_x = an[s : s + STEP], ax[s : s + STEP]
            r, j = np.nonzero(own_x.astype(np.float32) @ low.T >= least - 1e-4)
            once = own[r] < hn[j]
            r, j = r[once], j[once]
            c = np.einsum("ij,ij->i", own_x[r], hx[j])
            fits = c >= least
            yield pa.table({"a": own[r[fits]], "b": hn[j[fits]], "c": c[fits]})

    return find
