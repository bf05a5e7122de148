"""Problem 4: references to memories that do not exist.

A Bloom filter of the parents' keys proves most orphans without a join; only references that pass it are joined with
the parents. References are reduced to one row per table, referrer, target and month before any join.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemolith.session import materialize, table

#: Bits of the filter per parent key; with four bits set in a block of 256, under 1 % of orphans pass.
BITS_PER_KEY = 16
#: The filter is broadcast up to this size, and joined by block beyond it.
BROADCAST_BYTES = 32 * 2**20

#: Bytes of bits in a block, and what it takes as a row of five numbers in a hashed relation.
BLOCK_BYTES, HELD_BYTES = 32, 128



def _shift(i: int, h: str) -> Column:
    return F.expr(f"shiftleft(1L, CAST(shiftrightunsigned({h}, {6 * i}) & 63L AS INT))")


def bloom_filter(keys: DataFrame, key: str, blocks: int) -> DataFrame:
    """(block, w0, w1, w2, w3): a blocked Bloom filter of a key column. Null keys are ignored."""
    rows = keys.where(F.col(key).isNotNull()).select(F.pmod(F.xxhash64(key), F.lit(blocks)).alias("block"), F.xxhash64(F.col(key), F.lit(1)).alias("h"))
    return rows.groupBy("block").agg(*(F.bit_or(_shift(i, "h")).alias(f"w{i}") for i in range(4)))


def maybe_present(refs: DataFrame, key: str, bloom: DataFrame, blocks: int) -> DataFrame:
    """refs with a column maybe: false where the filter proves that no parent has the key."""
    side = F.broadcast(bloom) if blocks * HELD_BYTES <= BROADCAST_BYTES else bloom
    tagged = refs.withColumn("block", F.pmod(F.xxhash64(key), F.lit(blocks))).withColumn("_h", F.xxhash64(F.col(key), F.lit(1)))
    joined = tagged.join(side, "block", "left")
    passes = F.lit(True)
    for i in range(4):
        passes = passes & ((F.col(f"w{i}").bitwiseAND(_shift(i, "_h"))) != 0)
    return joined.withColumn("maybe", F.coalesce(passes, F.lit(False))).drop("block", "_h", "w0", "w1", "w2", "w3")


def tidy(key: Column) -> Column:
    """Trimmed, lower-cased; null for what is empty then."""
    out = F.lower(F.regexp_replace(key, r"^\s+|\s+$", ""))
    return F.when(out != "", out)


def references(memories: DataFrame, source_records: DataFrame, relationships: DataFrame) -> DataFrame:
    """(ref_table, ref_key, target_id, period, at): one row per reference and month, with its earliest arrival."""
    first = memories.where("id IS NOT NULL").groupBy("id").agg(F.min("arrived_at").alias("at"))
    named = memories.where("id IS NOT NULL AND size(consolidated_from) > 0").select("id", "arrived_at", "consolidated_from")
    named = named.join(first, "id").where(F.col("arrived_at").eqNullSafe(F.col("at")))
    parts = [
        named.select(F.lit("memories").alias("ref_table"), F.col("id").alias("ref_key"), F.explode("consolidated_from").alias("target"), "at"),
        source_records.select(F.lit("source_records").alias("ref_table"), F.col("source_id").alias("ref_key"), F.col("memory_id").alias("target"), F.col("arrived_at").alias("at")),
        relationships.select(F.lit("relationships").alias("ref_table"), F.col("from_id").alias("ref_key"), F.col("to_id").alias("target"), F.col("arrived_at").alias("at")),
    ]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2]).withColumn("target_id", tidy(F.col("target"))).where("target_id IS NOT NULL")
    rows = rows.withColumn("period", F.date_format("at", "yyyy-MM"))
    return rows.groupBy("ref_table", "ref_key", "target_id", "period").agg(F.min("at").alias("at"))


def orphan_references(memories: DataFrame, source_records: DataFrame, relationships: DataFrame, erasure_intents: DataFrame) -> DataFrame:
    """(ref_table, ref_key, target_id, period, reason) of references that are erased, missing or later.

    reason is 'erased', 'missing' or 'later', the first that holds. Null, empty and blank targets are no references;
    a null arrival has the period null and is never earlier than a parent; repeated rows give one row; an empty table
    gives none, and an empty memories table makes all targets missing.
    """
    refs = materialize(references(memories, source_records, relationships))
    parents = materialize(memories.where("id IS NOT NULL").groupBy("id").agg(F.min("arrived_at").alias("first_at")), narrow=True)
    blocks = 1 << max(0, math.ceil(math.log2(max(1, parents.count() * BITS_PER_KEY / (8 * BLOCK_BYTES)))))
    marked = maybe_present(refs, "target_id", bloom_filter(parents, "id", blocks), blocks)
    erased = erasure_intents.where("complete = 1").select(tidy(F.col("memory_id")).alias("target_id")).where("target_id IS NOT NULL").distinct().withColumn("erased", F.lit(True))
    erased_blocks = 1 << max(0, math.ceil(math.log2(max(1, (erased := materialize(erased, narrow=True)).count() * BITS_PER_KEY / (8 * BLOCK_BYTES)))))
    marked = maybe_present(marked.withColumnRenamed("maybe", "there"), "target_id", bloom_filter(erased, "target_id", erased_blocks), erased_blocks)
    marked = materialize(marked.withColumnRenamed("maybe", "gone"), narrow=True)
    out = ["ref_table", "ref_key", "target_id", "period"]
    definite = marked.where("NOT there AND NOT gone").select(*out, F.lit("missing").alias("reason"))
    rest = marked.where("there OR gone").join(parents.withColumnRenamed("id", "target_id").withColumn("known", F.lit(True)), "target_id", "left").join(erased, "target_id", "left")
    reason = F.when(F.col("erased"), "erased").when(F.col("known").isNull(), "missing").when(F.col("first_at") > F.col("at"), "later")
    return definite.unionByName(rest.withColumn("reason", reason).where("reason IS NOT NULL").select(*out, "reason"))


def _all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphan_references(*(table(spark, sf_dir, t) for t in ("memories", "source_records", "relationships", "erasure_intents")))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _all(spark, sf_dir).select("ref_table", "ref_key", "target_id", "period")


def p4_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ref_table, period, reason, orphans): how many orphan references each table has in each month."""
    return _all(spark, sf_dir).groupBy("ref_table", "period", "reason").agg(F.count(F.lit(1)).alias("orphans"))


_SQL = r"""
WITH firsts AS (SELECT id, min(arrived_at) AS first_at FROM memories WHERE id IS NOT NULL GROUP BY id),
refs AS (
  SELECT 'memories' AS ref_table, m.id AS ref_key, unnest(m.consolidated_from) AS target, f.first_at AS seen
  FROM memories m JOIN firsts f ON m.id = f.id AND m.arrived_at IS NOT DISTINCT FROM f.first_at
  UNION ALL SELECT 'source_records', source_id, memory_id, arrived_at FROM source_records
  UNION ALL SELECT 'relationships', from_id, to_id, arrived_at FROM relationships),
tidy AS (
  SELECT ref_table, ref_key, lower(regexp_replace(target, '^\s+|\s+$', '', 'g')) AS target_id,
         strftime(seen, '%Y-%m') AS period, min(seen) AS first_seen
  FROM refs WHERE regexp_replace(target, '^\s+|\s+$', '', 'g') <> '' GROUP BY ALL),
erased AS (
  SELECT DISTINCT lower(regexp_replace(memory_id, '^\s+|\s+$', '', 'g')) AS target_id FROM erasure_intents WHERE complete = 1),
judged AS (
  SELECT t.ref_table, t.ref_key, t.target_id, t.period,
         CASE WHEN e.target_id IS NOT NULL THEN 'erased' WHEN f.id IS NULL THEN 'missing'
              WHEN f.first_at > t.first_seen THEN 'later' END AS reason
  FROM tidy t LEFT JOIN firsts f ON f.id = t.target_id LEFT JOIN erased e ON e.target_id = t.target_id)
"""

QUERIES = {"p4_found": p4_found, "p4_report": p4_report}
SQL = {
    "p4_found": _SQL + "SELECT ref_table, ref_key, target_id, period FROM judged WHERE reason IS NOT NULL",
    "p4_report": _SQL + "SELECT ref_table, period, reason, count(*) AS orphans FROM judged WHERE reason IS NOT NULL GROUP BY ALL",
}
