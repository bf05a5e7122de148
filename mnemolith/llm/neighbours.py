"""Problem 5: the most similar vectors of every vector.

Cross-polytope hashing (``vectors.cells``). A pseudo-rotation (three rounds of random signs and a fast Hadamard
transform) is applied to the unit vectors, and the nearest signed axis is the digit of a hash. The digits of a cell
follow the number of rows, so that a cell holds a bounded number of unrelated ones at any size, and the number of
tables follows from the digits and the accepted loss. Each vector is indexed in its own cell of every table, and also
probes the cell with its second nearest axis where that is close. The candidates of a cell are ranked by their cosines.
A cell beyond blocks.BLOCK rows is divided into parts and every part meets every other one in a block of its own: no
task gets more than a bounded part of a hot group, and none of its pairs is left out.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemolith import blocks as B
from mnemolith.llm import vectors as V
from mnemolith.session import arrow_map, materialize, table

#: A pair at LEAST itself meets in no table at most so often; at 0.9 that is one in eight or less, at 0.95 one in 40.
MISS = 0.25
#: Unrelated rows of a cell, about.
CELL = 1024
NEIGHBOURS, LEAST = 5, 0.85
#: Tables that are laid out at once, so that what is shuffled at a time does not grow with their number.
AT_ONCE = 2


def hashed(vectors: DataFrame) -> DataFrame:
    """(n, memory_id, embedded_at, q, keys, probes) of the usable rows, n unique."""
    tables, digits, last = V.tables_for(vectors.count(), CELL, LEAST, MISS)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = V.to_matrix(batch.column("vector"))
        keys, probes = V.cells(x, tables, digits, last)
        cols = [batch.column("n"), batch.column("memory_id"), batch.column("embedded_at"), V.packed(x), V.listed(keys, pa.int64()), V.listed(probes, pa.int64())]
        return pa.RecordBatch.from_arrays(cols, names=["n", "memory_id", "embedded_at", "q", "keys", "probes"])

    rows = V.usable(vectors).withColumn("n", F.monotonically_increasing_id()).withColumn("embedded_at", F.col("embedded_at").cast("timestamp_ntz"))
    return materialize(arrow_map(rows, run, "n long, memory_id string, embedded_at timestamp_ntz, q binary, keys array<long>, probes array<long>"))


def neighbour_rows(rows: DataFrame, least: float | None) -> DataFrame:
    """(a, b, c): the NEIGHBOURS most similar rows b of each row a, by handle, with the cosine c."""
    return _near(V.without(rows, V.repeats(rows.select("n", "memory_id", "embedded_at"))), least)


def _near(live: DataFrame, least: float | None) -> DataFrame:
    tables, found = len(live.select("keys").first()["keys"]) if not live.isEmpty() else 0, None
    for t in range(0, max(tables, 1), AT_ONCE):
        some = [F.slice(k, t + 1, AT_ONCE) for k in ("keys", "probes")]
        own = live.select("n", "q", F.explode(some[0]).alias("key"), F.lit(True).alias("home"))
        more = live.select("n", "q", F.explode(some[1]).alias("key"), F.lit(False).alias("home")).where("key >= 0")
        every = own.unionByName(more).withColumn("asks", F.lit(True))
        part = B.compared(every, ["key"], B.best(V.unpacked, NEIGHBOURS, least), "a long, b long, c float")
        part = materialize(part, narrow=True) if tables > AT_ONCE else part
        found = part if found is None else found.unionByName(part)
    # the cosine of a pair differs in its last bits between tables, so a neighbour is counted once by its handle
    order = F.array_sort(F.collect_list(F.struct((-F.col("c")).alias("d"), "b")))
    best = found.groupBy("a").agg(order.alias("all")).withColumn("b", F.expr(f"slice(array_distinct(transform(all, m -> m.b)), 1, {NEIGHBOURS})"))
    best = best.withColumn("best", F.expr("transform(b, x -> named_struct('b', x, 'c', -element_at(filter(all, m -> m.b = x), 1).d))"))
    return best.select("a", F.explode("best").alias("m")).select("a", F.col("m.b").alias("b"), F.col("m.c").alias("c"))


def neighbours(vectors: DataFrame) -> DataFrame:
    """(memory_id, rank, neighbour_id, cosine): up to five most similar memories of each memory with a usable vector.

    Null, empty, short, zero and non-finite vectors are left out; a repeated memory_id counts once, with the vector of
    its first embedded_at; ties go to the row read first; an empty table gives no rows. The hash is made for cosines of
    LEAST and more, so a row for which it gives fewer than NEIGHBOURS of these is compared with the whole store, exactly.
    """
    rows = hashed(vectors)
    live = materialize(V.without(rows, V.repeats(rows.select("n", "memory_id", "embedded_at"))).select("n", "q", "keys", "probes"))
    near = materialize(_near(live, LEAST), narrow=True)
    full = near.groupBy("a").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") >= NEIGHBOURS).select(F.col("a").alias("n"))
    weak = live.join(full, "n", "left_anti").select("n", F.lit(True).alias("w"))
    every = live.select("n", "q").join(weak, "n", "left").select(F.lit(0).alias("g"), "n", "q", F.coalesce("w", F.lit(False)).alias("asks"), F.lit(True).alias("home"))
    exact = B.top(B.compared(every, ["g"], B.best(V.unpacked, NEIGHBOURS, None), "a long, b long, c float", 2 * B.BLOCK), NEIGHBOURS)
    found = near.join(full.withColumnRenamed("n", "a"), "a").unionByName(exact)
    ids = rows.select("n", "memory_id")
    named = found.join(ids.toDF("a", "memory_id"), "a").join(ids.toDF("b", "neighbour_id"), "b")
    rank = F.row_number().over(_by_memory())
    return named.withColumn("rank", rank).select("memory_id", "rank", "neighbour_id", F.round("c", 4).alias("cosine"))


def _by_memory():
    from pyspark.sql import Window

    return Window.partitionBy("a").orderBy(F.desc("c"), "neighbour_id")


def similar_pairs(vectors: DataFrame, least: float = LEAST) -> DataFrame:
    """(id_a, id_b), id_a < id_b: one is among the NEIGHBOURS most similar of the other, at a cosine of least or more."""
    rows = hashed(vectors)
    pairs = neighbour_rows(rows, least).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    ids = rows.select("n", "memory_id")
    named = pairs.join(ids.toDF("a", "ia"), "a").join(ids.toDF("b", "ib"), "b")
    return named.select(F.least("ia", "ib").alias("id_a"), F.greatest("ia", "ib").alias("id_b"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_pairs(table(spark, sf_dir, "memory_vectors"))


def p5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(table(spark, sf_dir, "memory_vectors"))
