"""The normalised memory store: one row per memory, defaults in place, and the same as SQL for the checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mnemolith.session import children, file_state, new_path, table

#: Columns with their defaults, as expressions that Spark and DuckDB both read.
COLUMNS = {
    "id": "id",
    "content": "coalesce(content, '')",
    "summary": "summary",
    "source_file": "source_file",
    "realm_name": "lower(trim(coalesce(realm_name, '')))",
    "importance": "coalesce(importance, CAST(1.0 AS DOUBLE))",
    "upvotes": "coalesce(upvotes, 0)",
    "access_count": "coalesce(access_count, 0)",
    "tags": "tags",
    "ingested_at": "ingested_at",
    "last_accessed": "last_accessed",
    "chunk_type": "coalesce(chunk_type, '')",
    "heading": "heading",
    "source_hash": "lower(coalesce(source_hash, ''))",
    "consolidated_from": "consolidated_from",
    "related_memory_ids": "related_memory_ids",
    "reaction_score": "coalesce(reaction_score, CAST(0.0 AS DOUBLE))",
    "verification_status": "CASE WHEN lower(trim(verification_status)) IN ('certified','verified','unverified','stale','contradicted') THEN lower(trim(verification_status)) ELSE 'unverified' END",
    "memory_type": "CASE WHEN coalesce(trim(memory_type), '') = '' THEN 'general' ELSE lower(trim(memory_type)) END",
    "visibility": "CASE WHEN lower(trim(visibility)) = 'public' THEN 'public' ELSE 'private' END",
    "batch_id": "batch_id",
    "arrived_at": "arrived_at",
}


#: Folder and schema of the snapshots that this process wrote.
_snapshots: dict[tuple[str, str, str], tuple[str, T.StructType]] = {}


def _snapshot(spark: SparkSession, sf_dir: str, name: str, build: Callable[[DataFrame], DataFrame], by: list[str] | None = None) -> DataFrame:
    """A normalised table in the shared folder, written once per application and state of its source files.

    Queries read it with their filters and columns pushed to the scan, in place of a window over the whole store each.
    """
    key = (spark.sparkContext.applicationId, name, f"{sf_dir}:{file_state(spark, f'{sf_dir}/{name}.parquet')}")
    path, schema = _snapshots.get(key, (None, None))
    if path is None or "_SUCCESS" not in children(spark, path):
        path, rows = new_path(spark), build(table(spark, sf_dir, name))
        rows.write.option("compression", "zstd").parquet(path, partitionBy=by)
        schema = rows.schema
        _snapshots[key] = path, schema
    return spark.read.schema(schema).parquet(path).select(*schema.names)


def normalised(rows: DataFrame) -> DataFrame:
    """One row per id, that of its first arrival, with defaults in place; rows without an id are left out."""
    first = Window.partitionBy("id").orderBy(F.col("arrived_at").asc_nulls_last(), F.col("access_count").asc_nulls_last(), "batch_id")
    once = rows.where("id IS NOT NULL").withColumn("_n", F.row_number().over(first)).where("_n = 1")
    return once.selectExpr(*(f"{e} AS {c}" for c, e in COLUMNS.items()))


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The normalised store: partitioned by visibility, sorted by realm and type within its files."""
    return _snapshot(spark, sf_dir, "memories", lambda rows: normalised(rows).sortWithinPartitions("visibility", "realm_name", "memory_type"), ["visibility"])


def live_memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The normalised store without the memories that a completed erasure names."""
    gone = table(spark, sf_dir, "erasure_intents").where("complete = 1").selectExpr("lower(trim(memory_id)) AS id").where("id <> ''").distinct()
    return memories(spark, sf_dir).join(gone, "id", "left_anti")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, v): the unit vector, as doubles, of every memory that has a usable one."""

    return _snapshot(spark, sf_dir, "memory_vectors", lambda rows: unit(usable_vectors(rows), "vector", "v").select("id", "v"))


def usable_vectors(rows: DataFrame) -> DataFrame:
    """(id, vector), as stored, of every memory that has a usable vector."""
    fine = rows.where("memory_id IS NOT NULL AND size(vector) = 64 AND forall(vector, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < 3.4e38) AND exists(vector, x -> x <> 0)")
    return fine.groupBy(F.col("memory_id").alias("id")).agg(F.min_by("vector", F.struct(F.coalesce("embedded_at", F.lit("9999-12-31").cast("timestamp_ntz")))).alias("vector"))


def unit(df: DataFrame, vector: str, out: str) -> DataFrame:
    norm = f"sqrt(aggregate({vector}, 0D, (m, x) -> m + CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))"
    return df.withColumn("_norm", F.expr(norm)).withColumn(out, F.expr(f"transform({vector}, x -> CAST(x AS DOUBLE) / _norm)")).drop("_norm")


def dot(a: str, b: str) -> str:
    return f"aggregate(zip_with({a}, {b}, (x, y) -> x * y), 0D, (m, v) -> m + v)"


MEM = (
    "mem AS (SELECT " + ", ".join(f"{e} AS {c}" for c, e in COLUMNS.items()) + " FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY arrived_at NULLS LAST, access_count NULLS LAST, batch_id) AS _n"
    " FROM memories WHERE id IS NOT NULL) WHERE _n = 1)"
)
ERASED = "gone AS (SELECT DISTINCT lower(trim(memory_id)) AS id FROM erasure_intents WHERE complete = 1 AND trim(memory_id) <> '')"
VEC = """vec AS (SELECT memory_id AS id, list_transform(vector::DOUBLE[], lambda x: x / len)::DOUBLE[64] AS v FROM (SELECT *, sqrt(list_sum(list_transform(vector::DOUBLE[], lambda x: x * x))) AS len FROM (
  SELECT *, row_number() OVER (PARTITION BY memory_id ORDER BY embedded_at NULLS LAST) AS _n FROM memory_vectors
  WHERE memory_id IS NOT NULL AND len(vector) = 64 AND len(list_filter(vector, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(vector, lambda x: x <> 0)) > 0) WHERE _n = 1))"""


class Catalogue:
    """Queries of a module, each registered together with its SQL."""

    def __init__(self):
        self.queries, self.sql = {}, {}

    def add(self, sql: str | None = None):
        def keep(fn):
            self.queries[fn.__name__] = fn
            if sql is not None:
                self.sql[fn.__name__] = sql
            return fn

        return keep
