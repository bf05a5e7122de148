"""Upkeep of the store: pruning, decay, duplicates, consolidation, verification, journals and patches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mnemolith import blocks as B
from mnemolith import params as P
from mnemolith import tables as T
from mnemolith.operators.retrieval import HOURS, HOURS_SQL, TOKENS, TOKENS_SQL, recency
from mnemolith.session import materialize, table

C = T.Catalogue()

AGE, AGE_SQL = f"timestampdiff(DAY, ingested_at, {P.NOW_NTZ})", f"date_sub('day', ingested_at, {P.NOW})"


@C.add(f"WITH {T.MEM} SELECT verification_status, count(*) AS memories FROM mem GROUP BY ALL")
def verification_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.memories(spark, sf_dir).groupBy("verification_status").agg(F.count(F.lit(1)).alias("memories"))


@C.add(f"WITH {T.MEM} SELECT tag, count(*) AS uses FROM (SELECT unnest(tags) AS tag FROM mem) WHERE tag IS NOT NULL GROUP BY ALL ORDER BY uses DESC, tag LIMIT 20")
def tag_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.memories(spark, sf_dir).select(F.explode("tags").alias("tag")).where("tag IS NOT NULL").groupBy("tag").agg(F.count(F.lit(1)).alias("uses")).orderBy(F.desc("uses"), "tag").limit(20)


@C.add(f"WITH {T.MEM} SELECT realm_name, visibility, count(*) AS memories FROM mem GROUP BY GROUPING SETS ((realm_name, visibility), (realm_name), ())")
def realm_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.memories(spark, sf_dir)
    realm, seen = F.col("realm_name"), F.col("visibility")
    return rows.groupingSets([[realm, seen], [realm], []], realm, seen).agg(F.count(F.lit(1)).alias("memories"))


@C.add(f"WITH {T.MEM}, known AS (SELECT DISTINCT lower(trim(realm_name)) AS realm_name FROM duplicate_candidates WHERE trim(realm_name) <> '' UNION SELECT unnest(['attic', 'cellar'])) SELECT realm_name FROM known WHERE realm_name NOT IN (SELECT realm_name FROM mem)")
def empty_realms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Realms that are named somewhere but hold no live memory."""
    named = table(spark, sf_dir, "duplicate_candidates").selectExpr("lower(trim(realm_name)) AS realm_name").where("realm_name <> ''")
    known = named.unionByName(spark.createDataFrame([("attic",), ("cellar",)], "realm_name string")).distinct()
    return known.join(T.memories(spark, sf_dir).select("realm_name"), "realm_name", "left_anti")


_WORDS = "substring(CASE WHEN trim(coalesce(summary, '')) <> '' THEN summary ELSE content END, 1, 200)"


@C.add(f"WITH {T.MEM}, w AS (SELECT realm_name, unnest({TOKENS_SQL.format(t=_WORDS)}) AS word FROM mem), c AS (SELECT realm_name, word, count(*) AS n FROM w WHERE length(word) >= 4 GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY realm_name ORDER BY n DESC, word) AS r FROM c) SELECT realm_name, string_agg(word, ' ' ORDER BY r) AS label FROM r WHERE r <= 3 GROUP BY ALL")
def realm_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A label of the three most frequent words per realm. Words are counted before they are ranked."""
    words = T.memories(spark, sf_dir).select("realm_name", F.explode(F.expr(TOKENS.format(t=_WORDS))).alias("word")).where("char_length(word) >= 4")
    counted = words.groupBy("realm_name", "word").agg(F.count(F.lit(1)).alias("n"))
    ranked = counted.withColumn("r", F.row_number().over(Window.partitionBy("realm_name").orderBy(F.desc("n"), "word"))).where("r <= 3")
    return ranked.groupBy("realm_name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "word"))), lambda x: x.word), " ").alias("label"))


@C.add(f"WITH {T.MEM} SELECT id, memory_type, importance FROM mem WHERE verification_status <> 'certified' AND importance <= 0.3 AND (access_count = 0 OR coalesce({AGE_SQL} > ({P.DAYS}), false))")
def prune_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.memories(spark, sf_dir).where(f"verification_status <> 'certified' AND importance <= 0.3 AND (access_count = 0 OR coalesce({AGE} > ({P.DAYS}), false))").select("id", "memory_type", "importance")


_PRUNE = "verification_status <> 'certified' AND upvotes = 0 AND access_count <= 5 AND coalesce({age}, 0) > ({days}) AND importance * ({rec}) * (1 + access_count * CAST(0.05 AS DOUBLE)) < 0.1"


@C.add(f"WITH {T.MEM} SELECT id, 0 AS upvotes, CAST(0.01 AS DOUBLE) AS importance FROM mem WHERE {_PRUNE.format(age=AGE_SQL, days=P.DAYS, rec=recency(HOURS_SQL))}")
def prune_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The patches that archive unused old memories whose recall score has fallen under 0.1."""
    return T.memories(spark, sf_dir).where(_PRUNE.format(age=AGE, days=P.DAYS, rec=recency(HOURS))).selectExpr("id", "0 AS upvotes", "0.01D AS importance")


@C.add(
    f"""WITH {T.MEM}, d AS (SELECT id, importance, (epoch_us({P.NOW}) - epoch_us(last_accessed)) / 86400000000.0 AS days, reaction_score FROM mem WHERE verification_status <> 'certified' AND last_accessed IS NOT NULL),
n AS (SELECT id, importance, greatest(0.05, importance - days * 0.001 * (1 + 0.3 * reaction_score)) AS decayed FROM d WHERE days > 0)
SELECT id, round(decayed, 6) AS importance FROM n WHERE abs(decayed - importance) > 0.001"""
)
def decay_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.memories(spark, sf_dir).where("verification_status <> 'certified' AND last_accessed IS NOT NULL")
    rows = rows.withColumn("days", F.expr(f"timestampdiff(MICROSECOND, last_accessed, {P.NOW_NTZ}) / 86400000000D")).where("days > 0")
    rows = rows.withColumn("decayed", F.expr("greatest(0.05D, importance - days * 0.001D * (1 + 0.3D * reaction_score))"))
    return rows.where("abs(decayed - importance) > 0.001D").selectExpr("id", "round(decayed, 6) AS importance")


_EXACT = "source_hash <> '' AND content <> ''"


@C.add(f"WITH {T.MEM} SELECT source_hash, md5(content) AS content_md5, min(id) AS keeper, count(*) AS copies FROM mem WHERE {_EXACT} GROUP BY ALL HAVING count(*) > 1")
def dedup_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal hash and equal content: a row per group, never its pairs."""
    rows = T.memories(spark, sf_dir).where(_EXACT).select("source_hash", F.md5("content").alias("content_md5"), "id")
    return rows.groupBy("source_hash", "content_md5").agg(F.min("id").alias("keeper"), F.count(F.lit(1)).alias("copies")).where("copies > 1")


_ORDER = "CASE WHEN verification_status = 'certified' THEN 0 ELSE 1 END, upvotes DESC, importance DESC, ingested_at DESC NULLS LAST, id"


@C.add(f"WITH {T.MEM}, r AS (SELECT id, realm_name, row_number() OVER (PARTITION BY realm_name, source_hash, content ORDER BY {_ORDER}) AS r, first_value(id) OVER (PARTITION BY realm_name, source_hash, content ORDER BY {_ORDER}) AS winner_id, verification_status FROM mem WHERE {_EXACT}) SELECT winner_id, id AS loser_id, realm_name FROM r WHERE r > 1 AND verification_status <> 'certified'")
def dedup_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each exact duplicate within a realm against the winner of its group; certified ones are never losers."""
    rows = T.memories(spark, sf_dir).where(_EXACT)
    rows = rows.select("id", "realm_name", "source_hash", F.xxhash64("content").alias("h"), F.md5("content").alias("m"), "upvotes", "importance", "ingested_at", (F.col("verification_status") == "certified").alias("certified"))
    rank = F.struct((~F.col("certified")).alias("a"), (-F.col("upvotes")).alias("b"), (-F.col("importance")).alias("c"), F.coalesce(-F.unix_micros(F.col("ingested_at").cast("timestamp")), F.lit(2**62)).alias("d"), "id")
    best = rows.groupBy("realm_name", "source_hash", "h", "m").agg(F.min(rank).alias("w"), F.count(F.lit(1)).alias("n")).where("n > 1")
    joined = rows.join(best, ["realm_name", "source_hash", "h", "m"])
    return joined.where("id <> w.id AND NOT certified").select(F.col("w.id").alias("winner_id"), F.col("id").alias("loser_id"), "realm_name")


@C.add(
    f"""WITH {T.MEM}, {T.VEC}, c AS (SELECT winner_id, loser_id FROM duplicate_candidates GROUP BY ALL)
SELECT c.winner_id, c.loser_id, round(array_cosine_similarity(x.v, y.v), 4) AS cosine FROM c JOIN mem a ON a.id = c.winner_id JOIN mem b ON b.id = c.loser_id JOIN vec x ON x.id = a.id JOIN vec y ON y.id = b.id
WHERE a.realm_name = b.realm_name AND a.visibility = b.visibility AND round(array_cosine_similarity(x.v, y.v), 4) >= 0.95"""
)
def dedup_near_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The earlier run's candidates that still hold: live, same realm and visibility, cosine from 0.95 on."""
    pairs = table(spark, sf_dir, "duplicate_candidates").select("winner_id", "loser_id").distinct()
    side = T.memories(spark, sf_dir).select("id", "realm_name", "visibility").join(T.vectors(spark, sf_dir), "id")
    both = pairs.join(side.toDF("winner_id", "ra", "va", "xa"), "winner_id").join(side.toDF("loser_id", "rb", "vb", "xb"), "loser_id").where("ra = rb AND va = vb")
    return both.select("winner_id", "loser_id", F.expr(f"round({T.dot('xa', 'xb')}, 4)").alias("cosine")).where("cosine >= 0.95")


@C.add(
    f"""WITH {T.MEM}, {T.VEC}, r AS (SELECT id, realm_name, visibility, verification_status = 'certified' AS protected, v, row_number() OVER (ORDER BY {_ORDER}) AS r FROM mem JOIN vec USING (id))
SELECT a.id AS winner_id, b.id AS loser_id, a.realm_name, round(array_cosine_similarity(a.v, b.v), 4) AS cosine, b.protected FROM r a JOIN r b ON a.realm_name = b.realm_name AND a.visibility = b.visibility AND a.r < b.r
WHERE round(array_cosine_similarity(a.v, b.v), 4) >= 0.95"""
)
def dedup_near_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of live memories of one realm and visibility with a cosine from 0.95 on; certified losers are protected.

    dedup_near_pairs only judges an earlier run's list again; here every pair of a realm is compared.
    """
    rank = F.struct((F.col("verification_status") != "certified").alias("a"), (-F.col("upvotes")).alias("b"), (-F.col("importance")).alias("c"), F.coalesce(-F.unix_micros(F.col("ingested_at").cast("timestamp")), F.lit(2**62)).alias("d"), "id")
    side = T.memories(spark, sf_dir).select("id", "realm_name", "visibility", rank.alias("rank")).join(T.vectors(spark, sf_dir), "id")
    rows = B.numbered(side.drop("id"))
    both = rows.select("realm_name", "visibility", "n", "q", F.lit(True).alias("asks"), F.lit(True).alias("home"))
    found = B.compared(both, ["realm_name", "visibility"], B.pairs(0.9499), "a long, b long, c double").withColumn("cosine", F.round("c", 4)).where("cosine >= 0.95")
    named = found.join(rows.select(F.col("n").alias("a"), "realm_name", F.col("rank").alias("ra")), "a").join(rows.select(F.col("n").alias("b"), F.col("rank").alias("rb")), "b")
    named = named.withColumn("w", F.least("ra", "rb")).withColumn("l", F.greatest("ra", "rb"))
    return named.select(F.col("w.id").alias("winner_id"), F.col("l.id").alias("loser_id"), "realm_name", "cosine", (~F.col("l.a")).alias("protected"))


#: Types that live long; they only merge with their own type.
LONG_LIVED = "('profile', 'preference', 'entity', 'relationship')"
_COOLING = "run_at > TIMESTAMP{ntz} '2025-05-02 00:00:00'"


@C.add(
    f"""WITH {T.MEM}, {T.VEC}, cool AS (SELECT DISTINCT winner_id AS id FROM duplicate_candidates WHERE {_COOLING.format(ntz="")}),
r AS (SELECT id, realm_name, visibility, memory_type, list_sort(list_distinct(list_filter(coalesce(tags, []), lambda t: t LIKE 'project:%'))) AS projects, verification_status = 'certified' AS certified, v, row_number() OVER (ORDER BY {_ORDER}) AS r FROM mem JOIN vec USING (id) WHERE id NOT IN (SELECT id FROM cool)),
p AS (SELECT a.id AS winner_id, b.id AS loser_id, b.certified FROM r a JOIN r b ON a.realm_name = b.realm_name AND a.visibility = b.visibility AND a.projects = b.projects AND a.r < b.r AND (a.memory_type = b.memory_type OR (a.memory_type NOT IN {LONG_LIVED} AND b.memory_type NOT IN {LONG_LIVED}))
WHERE round(array_cosine_similarity(a.v, b.v), 4) >= 0.95)
SELECT loser_id, count(*) AS winners, min(winner_id) AS first_winner FROM p WHERE NOT certified GROUP BY ALL"""
)
def dedup_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(loser_id, winners, first_winner): memories that a better one of their realm repeats, a row per loser.

    Compatible are the same visibility and project tags, and the same type unless both types are short-lived. Winners of
    a merge of the last thirty days are left alone, certified memories are never losers.
    """
    cool = table(spark, sf_dir, "duplicate_candidates").where(_COOLING.format(ntz="_NTZ")).select(F.col("winner_id").alias("id")).distinct()
    rank = F.struct((F.col("verification_status") != "certified").alias("a"), (-F.col("upvotes")).alias("b"), (-F.col("importance")).alias("c"), F.coalesce(-F.unix_micros(F.col("ingested_at").cast("timestamp")), F.lit(2**62)).alias("d"), "id")
    projects = "array_join(array_sort(array_distinct(filter(coalesce(tags, array()), t -> t LIKE 'project:%'))), ',')"
    kind = f"IF(memory_type IN {LONG_LIVED}, memory_type, '')"
    live = T.memories(spark, sf_dir).join(cool, "id", "left_anti")
    side = live.select("id", "realm_name", "visibility", F.expr(projects).alias("projects"), F.expr(kind).alias("kind"), rank.alias("rank")).join(T.vectors(spark, sf_dir), "id")
    rows = B.numbered(side.drop("id"))
    keys = ["realm_name", "visibility", "projects", "kind"]
    both = rows.select(*keys, "n", "q", F.lit(True).alias("asks"), F.lit(True).alias("home"))
    found = B.compared(both, keys, B.pairs(0.9499), "a long, b long, c double").where(F.round("c", 4) >= 0.95)
    ranks = rows.select("n", "rank")
    named = found.join(ranks.toDF("a", "ra"), "a").join(ranks.toDF("b", "rb"), "b").select(F.least("ra", "rb").alias("w"), F.greatest("ra", "rb").alias("l"))
    return named.where("l.a").groupBy(F.col("l.id").alias("loser_id")).agg(F.count(F.lit(1)).alias("winners"), F.min("w.id").alias("first_winner"))


@C.add(f"WITH {T.MEM}, {T.VEC} SELECT (SELECT count(*) FROM mem) AS scanned, (SELECT count(*) FROM mem JOIN vec USING (id)) AS with_vector, (SELECT count(DISTINCT memory_id) FROM memory_vectors WHERE memory_id IN (SELECT id FROM mem) AND memory_id NOT IN (SELECT id FROM vec)) AS invalid_vectors, (SELECT count(*) FROM mem WHERE verification_status = 'certified') AS protected")
def dedup_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a duplicate pass looks at: memories, those with a usable vector, unusable vectors, protected ones."""
    mem, v = T.memories(spark, sf_dir).select("id", "verification_status"), T.vectors(spark, sf_dir).select("id", F.lit(1).alias("fine"))
    any_vector = table(spark, sf_dir, "memory_vectors").select(F.col("memory_id").alias("id"), F.lit(1).alias("there")).where("id IS NOT NULL").distinct()
    rows = mem.join(v, "id", "left").join(any_vector, "id", "left")
    return rows.agg(F.count(F.lit(1)).alias("scanned"), F.count("fine").alias("with_vector"), F.count_if(F.col("there").isNotNull() & F.col("fine").isNull()).alias("invalid_vectors"), F.count_if(F.col("verification_status") == "certified").alias("protected"))


@C.add(f"WITH {T.MEM}, {T.VEC}, c AS (SELECT id, list_sort(list_distinct(list_filter(list_transform(consolidated_from, lambda x: lower(trim(x))), lambda x: x <> ''))) AS sources FROM mem WHERE consolidated_from IS NOT NULL), e AS (SELECT id, unnest(sources) AS s FROM c) SELECT c.id, len(c.sources) AS sources, coalesce(sum(CASE WHEN m.id IS NOT NULL THEN 1 ELSE 0 END), 0)::BIGINT AS live, coalesce(bool_and(m.id IS NOT NULL), true) AS covered FROM c LEFT JOIN e USING (id) LEFT JOIN mem m ON m.id = e.s WHERE len(c.sources) > 0 GROUP BY ALL")
def covered_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether all sources of a merged memory are still there, so that merging them again would add nothing."""
    mem = T.memories(spark, sf_dir)
    sources = mem.where("consolidated_from IS NOT NULL").select("id", F.expr("array_distinct(filter(transform(consolidated_from, x -> lower(trim(x))), x -> x <> ''))").alias("l"))
    rows = sources.select("id", F.expr("CAST(size(l) AS BIGINT)").alias("sources"), F.explode("l").alias("s"))
    there = mem.select(F.col("id").alias("s"), F.lit(1).alias("there"))
    return rows.join(there, "s", "left").groupBy("id", "sources").agg(F.count("there").alias("live")).withColumn("covered", F.col("live") == F.col("sources"))


@C.add(f"WITH {T.MEM}, g AS (SELECT realm_name, source_hash, content, count(*) AS n, sum(access_count)::BIGINT AS access_count, max(importance) AS importance FROM mem WHERE {_EXACT} GROUP BY ALL HAVING count(*) > 1), t AS (SELECT realm_name, source_hash, content, string_agg(DISTINCT tag, ',' ORDER BY tag) AS tags FROM (SELECT realm_name, source_hash, content, unnest(tags) AS tag FROM mem WHERE {_EXACT}) WHERE tag IS NOT NULL GROUP BY ALL) SELECT g.realm_name, md5(g.content) AS content_md5, n AS members, access_count, importance, coalesce(t.tags, '') AS tags FROM g LEFT JOIN t USING (realm_name, source_hash, content)")
def dedup_merge_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a merged memory carries: summed accesses, the largest importance, the union of tags."""
    rows = T.memories(spark, sf_dir).where(_EXACT).select("realm_name", "source_hash", F.md5("content").alias("content_md5"), "access_count", "importance", "tags")
    keys = ["realm_name", "source_hash", "content_md5"]
    groups = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("members"), F.sum("access_count").alias("access_count"), F.max("importance").alias("importance")).where("members > 1")
    tags = rows.select(*keys, F.explode("tags").alias("tag")).where("tag IS NOT NULL").groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_set("tag")), ",").alias("tags"))
    return groups.join(tags, keys, "left").select("realm_name", "content_md5", "members", "access_count", "importance", F.coalesce("tags", F.lit("")).alias("tags"))


_INPUT = "chunk_type NOT IN ('session_summary', 'consolidated') AND verification_status <> 'certified' AND memory_type NOT IN ('profile', 'preference')"


@C.add(f"WITH {T.MEM}, r AS (SELECT id, realm_name, visibility, memory_type, importance, row_number() OVER (PARTITION BY realm_name, visibility ORDER BY importance DESC, id) AS r, count(*) OVER (PARTITION BY realm_name, visibility) AS n FROM mem WHERE {_INPUT}) SELECT realm_name, visibility, any_value(n) AS members, string_agg(id, ',' ORDER BY r) AS sources, max({P.PRIORITY}) AS priority FROM r WHERE n >= 2 AND r <= 8 GROUP BY ALL")
def consolidation_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight most important sources of each (realm, visibility) with at least two; ranks are cut before lists."""
    rows = T.memories(spark, sf_dir).where(_INPUT).select("id", "realm_name", "visibility", "memory_type", "importance")
    sizes = rows.groupBy("realm_name", "visibility").agg(F.count(F.lit(1)).alias("members")).where("members >= 2")
    top = rows.withColumn("r", F.row_number().over(Window.partitionBy("realm_name", "visibility").orderBy(F.desc("importance"), "id"))).where("r <= 8")
    lists = top.groupBy("realm_name", "visibility").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "id"))), lambda x: x.id), ",").alias("sources"), F.max(F.expr(P.PRIORITY)).alias("priority"))
    return lists.join(sizes, ["realm_name", "visibility"])


@C.add(f"WITH {T.MEM} SELECT realm_name, count(DISTINCT sha256(content)) AS contents, min(sha256(content)) AS first_fingerprint FROM mem GROUP BY ALL")
def source_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.memories(spark, sf_dir).select("realm_name", F.sha2("content", 256).alias("f"))
    return rows.groupBy("realm_name").agg(F.countDistinct("f").alias("contents"), F.min("f").alias("first_fingerprint"))


@C.add(
    f"""WITH {T.MEM}, {T.VEC}, e AS (SELECT least(from_id, to_id) AS a, greatest(from_id, to_id) AS b FROM (SELECT from_id, lower(trim(to_id)) AS to_id FROM relationships) WHERE from_id <> to_id GROUP BY ALL),
s AS (SELECT e.a, e.b, array_cosine_similarity(x.v, y.v) AS s, abs(epoch_us(n.ingested_at) - epoch_us(m.ingested_at)) // 1000000 AS gap, m.realm_name = n.realm_name AS same_realm, m.source_file = n.source_file AS same_file
 FROM e JOIN mem m ON m.id = e.a JOIN mem n ON n.id = e.b JOIN vec x ON x.id = e.a JOIN vec y ON y.id = e.b)
SELECT a AS from_id, b AS to_id, round(s, 4) AS similarity, CASE WHEN same_realm AND round(s, 4) > 0.7 THEN 'companion' WHEN gap < 300 THEN 'companion' WHEN gap > 0 AND gap < 3600 THEN 'temporal_next' WHEN round(s, 4) > 0.75 THEN 'companion' WHEN round(s, 4) > 0.5 THEN 'fill_gap' WHEN same_file THEN 'prerequisite' END AS link_type
FROM s WHERE round(s, 4) >= 0.3"""
)
def inferred_associations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linked memories whose vectors are alike, with the kind of their link."""
    edges = table(spark, sf_dir, "relationships").selectExpr("from_id", "lower(trim(to_id)) AS to_id").where("from_id <> to_id").select(F.least("from_id", "to_id").alias("a"), F.greatest("from_id", "to_id").alias("b")).distinct()
    side = T.memories(spark, sf_dir).select("id", "realm_name", "source_file", "ingested_at").join(T.vectors(spark, sf_dir), "id")
    both = edges.join(side.toDF("a", "ra", "fa", "ta", "va"), "a").join(side.toDF("b", "rb", "fb", "tb", "vb"), "b")
    both = both.withColumn("s", F.expr(f"round({T.dot('va', 'vb')}, 4)")).where("s >= 0.3").withColumn("gap", F.expr("abs(timestampdiff(MICROSECOND, ta, tb)) div 1000000"))
    kind = "CASE WHEN ra = rb AND s > 0.7 THEN 'companion' WHEN gap < 300 THEN 'companion' WHEN gap > 0 AND gap < 3600 THEN 'temporal_next' WHEN s > 0.75 THEN 'companion' WHEN s > 0.5 THEN 'fill_gap' WHEN fa = fb THEN 'prerequisite' END"
    return both.select(F.col("a").alias("from_id"), F.col("b").alias("to_id"), F.col("s").alias("similarity"), F.expr(kind).alias("link_type"))


_LINK = "CASE WHEN {same_realm} AND s > 0.7 THEN 'companion' WHEN gap < 300 THEN 'companion' WHEN gap > 0 AND gap < 3600 THEN 'temporal_next' WHEN s > 0.75 THEN 'companion' WHEN s > 0.5 THEN 'fill_gap' WHEN {same_file} THEN 'prerequisite' END"


@C.add(
    f"""WITH {T.MEM}, {T.VEC}, live AS (SELECT id, realm_name, source_file, ingested_at, v FROM mem JOIN vec USING (id)),
p AS (SELECT m.id AS a, n.id AS b, round(array_cosine_similarity(m.v, n.v), 4) AS s, abs(epoch_us(n.ingested_at) - epoch_us(m.ingested_at)) // 1000000 AS gap, m.realm_name = n.realm_name AS same_realm, m.source_file = n.source_file AS same_file FROM live m JOIN live n ON m.id < n.id),
k AS (SELECT a AS from_id, b AS to_id, s AS similarity, {_LINK.format(same_realm="same_realm", same_file="same_file")} AS link_type FROM p WHERE s >= 0.3)
SELECT * FROM k WHERE link_type IS NOT NULL"""
)
def inferred_associations_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of memories with a cosine from 0.3 on that are of some kind of link, with that kind.

    inferred_associations only classifies the pairs that relationships already links.
    """
    side = T.memories(spark, sf_dir).select("id", "realm_name", "source_file", F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ingested_at)").alias("at"))
    rows = B.numbered(side.join(T.usable_vectors(table(spark, sf_dir, "memory_vectors")), "id"), "vector", "<f4")
    return B.paired(rows, _links, "from_id string, to_id string, similarity double, link_type string", 2 * B.BLOCK)


_KINDS = ["companion", "temporal_next", "fill_gap", "prerequisite"]


def _links(rows: pa.Table) -> Iterator[pa.Table]:
    """Within a block, the pairs of a row that asks and a home row with a kind of link (_LINK), by their vectors q."""
    asks, home = (rows.column(k).to_numpy() for k in ("asks", "home"))
    x = B.unpacked(rows.column("q").to_pylist(), "<f4").astype(np.float64)
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    # equal strings have equal codes; null is like nothing
    realm, file = (pc.fill_null(pc.dictionary_encode(rows.column(k).combine_chunks()).indices, -1).to_numpy() for k in ("realm_name", "source_file"))
    at, dated = pc.fill_null(rows.column("at"), 0).to_numpy(), pc.is_valid(rows.column("at")).to_numpy()
    ids, names = rows.column("id").combine_chunks(), pa.array(_KINDS)
    a, h = np.flatnonzero(asks), np.flatnonzero(home)
    hx, once = np.ascontiguousarray(x[h].T), bool(asks.all() and home.all())
    for s in range(0, len(a), B.STEP):
        # of a part with itself, each pair once
        from_ = s + 1 if once else 0
        c = x[a[s : s + B.STEP]] @ hx[:, from_:]
        i, j = np.nonzero(c >= 0.2999)
        if once:
            later = j >= i
            i, j = i[later], j[later]
        # as SQL rounds; all are positive
        sim = np.floor(c[i, j] * 1e4 + 0.5) / 1e4
        i, j = a[s + i], h[from_ + j]
        gap = np.where(dated[i] & dated[j], np.abs(at[i] - at[j]) // 1_000_000, -1)
        cases = [(realm[i] == realm[j]) & (realm[i] >= 0) & (sim > 0.7) | (gap >= 0) & (gap < 300), (gap > 0) & (gap < 3600), sim > 0.75, sim > 0.5, (file[i] == file[j]) & (file[i] >= 0)]
        kind = np.select(cases, [0, 1, 0, 2, 3], -1)
        fits = (sim >= 0.3) & (kind >= 0)
        one, two = ids.take(pa.array(i[fits])), ids.take(pa.array(j[fits]))
        yield pa.table({"from_id": pc.min_element_wise(one, two), "to_id": pc.max_element_wise(one, two), "similarity": sim[fits], "link_type": names.take(pa.array(kind[fits]))})


@C.add(
    f"""WITH {T.MEM}, recent AS (SELECT realm_name, count(*) AS n FROM mem WHERE ingested_at >= {P.NOW} - INTERVAL 120 DAY GROUP BY ALL),
s AS (SELECT m.id, importance, date_sub('day', ingested_at, {P.NOW}) AS days, coalesce(r.n, 0) - CASE WHEN ingested_at >= {P.NOW} - INTERVAL 120 DAY THEN 1 ELSE 0 END > 0 AS followed FROM mem m LEFT JOIN recent r USING (realm_name) WHERE chunk_type = 'session_summary' AND verification_status <> 'certified' AND ingested_at IS NOT NULL),
n AS (SELECT id, importance AS old, CASE WHEN followed THEN least(3.0, importance * 1.1) WHEN days > 7 THEN greatest(0.5, importance * 0.95) ELSE importance END AS new FROM s)
SELECT id, round(new, 6) AS importance FROM n WHERE abs(new - old) > 0.01"""
)
def session_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session summaries gain weight when newer memories of their realm follow, and lose it otherwise.

    Recent memories are counted per realm, so a hot realm is one number and no join of all with all.
    """
    mem, start = T.memories(spark, sf_dir), f"{P.NOW_NTZ} - INTERVAL 120 DAYS"
    recent = mem.where(f"ingested_at >= {start}").groupBy("realm_name").agg(F.count(F.lit(1)).alias("n"))
    s = mem.where("chunk_type = 'session_summary' AND verification_status <> 'certified' AND ingested_at IS NOT NULL").join(recent, "realm_name", "left")
    s = s.withColumn("followed", F.expr(f"coalesce(n, 0) - IF(ingested_at >= {start}, 1, 0) > 0"))
    new = f"CASE WHEN followed THEN least(3D, importance * 1.1D) WHEN {AGE} > 7 THEN greatest(0.5D, importance * 0.95D) ELSE importance END"
    return s.withColumn("new", F.expr(new)).where("abs(new - importance) > 0.01D").selectExpr("id", "round(new, 6) AS importance")


_ELIGIBLE = "verification_status <> 'certified' AND trim(content) <> ''"


@C.add(
    f"""WITH {T.MEM}, e AS (SELECT id, access_count, realm_name, ingested_at, verification_status FROM mem WHERE {_ELIGIBLE}),
high AS (SELECT id, 'access' AS stratum FROM e WHERE verification_status = 'unverified' ORDER BY access_count DESC, id LIMIT 12),
old AS (SELECT id, 'oldest' AS stratum FROM e WHERE realm_name LIKE '%plans%' AND id NOT IN (SELECT id FROM high) ORDER BY ingested_at NULLS FIRST, id LIMIT 12),
rest AS (SELECT id, 'random' AS stratum FROM e WHERE id NOT IN (SELECT id FROM high UNION ALL SELECT id FROM old) ORDER BY md5(id), id LIMIT 6)
SELECT * FROM high UNION ALL SELECT * FROM old UNION ALL SELECT * FROM rest"""
)
def verification_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thirty memories to verify: much read, oldest of changing realms, and a rest in hash order."""
    e = T.memories(spark, sf_dir).where(_ELIGIBLE).select("id", "access_count", "realm_name", "ingested_at", "verification_status")
    high = e.where("verification_status = 'unverified'").orderBy(F.desc("access_count"), "id").limit(12).select("id", F.lit("access").alias("stratum"))
    old = e.where("realm_name LIKE '%plans%'").join(F.broadcast(high), "id", "left_anti").orderBy(F.asc_nulls_first("ingested_at"), "id").limit(12).select("id", F.lit("oldest").alias("stratum"))
    rest = e.join(F.broadcast(high.unionByName(old)), "id", "left_anti").orderBy(F.md5("id"), "id").limit(6).select("id", F.lit("random").alias("stratum"))
    return high.unionByName(old).unionByName(rest)


@C.add(f"WITH {T.MEM} SELECT m.id, round(least(1.0, greatest(0.0, d.c)), 6) AS confidence, CASE WHEN d.c >= 0.8 THEN 'verified' WHEN d.c >= 0.4 THEN 'stale' ELSE 'contradicted' END AS verification_status FROM (SELECT loser_id AS id, max(cosine) AS c FROM duplicate_candidates WHERE cosine IS NOT NULL GROUP BY ALL) d JOIN mem m USING (id) WHERE m.verification_status <> 'certified'")
def verification_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratings (here an earlier run's cosine) written back to live memories that are not certified."""
    ratings = table(spark, sf_dir, "duplicate_candidates").where("cosine IS NOT NULL").groupBy(F.col("loser_id").alias("id")).agg(F.max("cosine").alias("c"))
    live = T.memories(spark, sf_dir).where("verification_status <> 'certified'").select("id")
    return ratings.join(live, "id").selectExpr("id", "round(least(1D, greatest(0D, c)), 6) AS confidence", "CASE WHEN c >= 0.8 THEN 'verified' WHEN c >= 0.4 THEN 'stale' ELSE 'contradicted' END AS verification_status")


@C.add(f"WITH {T.MEM} SELECT id, CASE WHEN access_count >= 50 OR importance >= 0.95 THEN NULL WHEN access_count >= 20 OR importance >= 0.8 THEN 4 WHEN access_count = 0 AND importance < 0.3 THEN 2 ELSE 4 END AS bits FROM mem")
def bit_width_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.memories(spark, sf_dir).selectExpr("id", "CASE WHEN access_count >= 50 OR importance >= 0.95 THEN NULL WHEN access_count >= 20 OR importance >= 0.8 THEN 4 WHEN access_count = 0 AND importance < 0.3 THEN 2 ELSE 4 END AS bits")


@C.add(f"WITH {T.MEM} SELECT memory_type, any_value({P.DAYS}) AS days, count(*) AS memories, count(*) FILTER (WHERE {AGE_SQL} > ({P.DAYS})) AS over_age FROM mem GROUP BY ALL")
def archive_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.memories(spark, sf_dir).selectExpr("memory_type", f"{P.DAYS} AS days", f"{AGE} AS age")
    return rows.groupBy("memory_type").agg(F.any_value("days").alias("days"), F.count(F.lit(1)).alias("memories"), F.count_if(F.col("age") > F.col("days")).alias("over_age"))


@C.add(f"WITH {T.MEM} SELECT id, upvotes + 1 AS up_votes, round(least(1.0, importance + 0.1), 6) AS up_importance, greatest(upvotes - 1, 0) AS down_votes, round(greatest(0.01, importance - 0.1), 6) AS down_importance FROM mem")
def upvote_downvote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.memories(spark, sf_dir).selectExpr("id", "upvotes + 1 AS up_votes", "round(least(1D, importance + 0.1D), 6) AS up_importance", "greatest(upvotes - 1, 0) AS down_votes", "round(greatest(0.01D, importance - 0.1D), 6) AS down_importance")


@C.add(f"WITH {T.MEM}, hits AS (SELECT DISTINCT memory_id AS id FROM source_records WHERE memory_id IS NOT NULL) SELECT m.id, m.access_count + CASE WHEN h.id IS NULL THEN 0 ELSE 1 END AS access_count, round(CASE WHEN h.id IS NULL THEN importance ELSE least(1.0, importance + 0.02) END, 6) AS importance FROM mem m LEFT JOIN hits h USING (id)")
def touch_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A new snapshot after a read: touched rows count one access more and gain importance."""
    hits = table(spark, sf_dir, "source_records").select(F.col("memory_id").alias("id")).where("id IS NOT NULL").distinct().withColumn("hit", F.lit(1))
    return T.memories(spark, sf_dir).select("id", "access_count", "importance").join(hits, "id", "left").selectExpr("id", "access_count + coalesce(hit, 0) AS access_count", "round(IF(hit IS NULL, importance, least(1D, importance + 0.02D)), 6) AS importance")


@C.add(f"WITH {T.MEM}, p AS (SELECT from_id AS id, max(weight) AS importance FROM relationships WHERE weight IS NOT NULL GROUP BY ALL) SELECT m.id, CASE WHEN m.verification_status = 'certified' THEN m.importance ELSE coalesce(p.importance, m.importance) END AS importance, m.visibility FROM mem m LEFT JOIN p USING (id)")
def payload_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copy on write: a patch replaces its fields, certified rows stay as they are."""
    patch = table(spark, sf_dir, "relationships").where("weight IS NOT NULL").groupBy(F.col("from_id").alias("id")).agg(F.max("weight").alias("patched"))
    return T.memories(spark, sf_dir).select("id", "importance", "visibility", "verification_status").join(patch, "id", "left").selectExpr("id", "IF(verification_status = 'certified', importance, coalesce(patched, importance)) AS importance", "visibility")


@C.add(f"WITH {T.MEM} SELECT id, CASE WHEN verification_status = 'certified' THEN 'unverified' WHEN verification_status = 'verified' AND upvotes >= 3 THEN 'certified' ELSE verification_status END AS verification_status FROM mem WHERE verification_status = 'certified' OR (verification_status = 'verified' AND upvotes >= 3)")
def certify_revoke(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.memories(spark, sf_dir).where("verification_status = 'certified' OR (verification_status = 'verified' AND upvotes >= 3)").selectExpr("id", "CASE WHEN verification_status = 'certified' THEN 'unverified' ELSE 'certified' END AS verification_status")


_GONE = "gone AS (SELECT DISTINCT lower(trim(memory_id)) AS id FROM erasure_intents WHERE trim(memory_id) <> '')"


@C.add(f"WITH {T.MEM}, {_GONE} SELECT id, visibility FROM mem WHERE id NOT IN (SELECT id FROM gone)")
def erased_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a reader may see: every intent hides its memory, complete or not."""
    return T.memories(spark, sf_dir).select("id", "visibility").join(_gone(spark, sf_dir), "id", "left_anti")


def _gone(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "erasure_intents").selectExpr("lower(trim(memory_id)) AS id").where("id <> ''").distinct()


@C.add(f"WITH {T.MEM}, {_GONE}, r AS (SELECT m.id, unnest(related_memory_ids) AS ref, generate_subscripts(related_memory_ids, 1) AS pos FROM mem m), k AS (SELECT id, string_agg(ref, ',' ORDER BY pos) AS kept, count(*) AS n FROM r WHERE ref IN (SELECT id FROM mem) AND ref NOT IN (SELECT id FROM gone) GROUP BY ALL), a AS (SELECT id, count(*) AS was FROM r GROUP BY ALL) SELECT a.id, coalesce(kept, '') AS kept, was - coalesce(n, 0) AS dropped FROM a LEFT JOIN k USING (id) WHERE was > coalesce(n, 0)")
def delete_refs_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References left after deletions: dead ones go, the order of the others stays."""
    mem = T.memories(spark, sf_dir)
    refs = mem.select("id", F.posexplode("related_memory_ids").alias("pos", "ref"))
    live = mem.select(F.col("id").alias("ref")).join(_gone(spark, sf_dir).withColumnRenamed("id", "ref"), "ref", "left_anti").withColumn("ok", F.lit(1))
    g = refs.join(live, "ref", "left").groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("ok") == 1, F.struct("pos", "ref")))), lambda x: x.ref), ",").alias("kept"), F.count_if(F.col("ok").isNull()).alias("dropped"))
    return g.where("dropped > 0").select("id", "kept", "dropped")


@C.add("SELECT memory_id, count(*) AS steps, max_by(complete, requested_at) AS complete, max(requested_at) AS latest FROM (SELECT lower(trim(memory_id)) AS memory_id, complete, requested_at FROM erasure_intents) WHERE memory_id <> '' GROUP BY ALL")
def journal_latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest state of each operation of an append-only journal."""
    rows = table(spark, sf_dir, "erasure_intents").selectExpr("lower(trim(memory_id)) AS memory_id", "complete", "requested_at").where("memory_id <> ''")
    return rows.groupBy("memory_id").agg(F.count(F.lit(1)).alias("steps"), F.max_by("complete", "requested_at").alias("complete"), F.max("requested_at").alias("latest"))


@C.add(f"WITH {T.MEM}, r AS (SELECT source_file, id, importance, row_number() OVER (PARTITION BY source_file ORDER BY importance DESC, id) AS r FROM mem WHERE source_file IS NOT NULL) SELECT source_file, string_agg(id, ',' ORDER BY r) AS top FROM r WHERE r <= 5 GROUP BY ALL")
def digest_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.memories(spark, sf_dir).where("source_file IS NOT NULL").select("source_file", "id", "importance")
    top = rows.withColumn("r", F.row_number().over(Window.partitionBy("source_file").orderBy(F.desc("importance"), "id"))).where("r <= 5")
    return top.groupBy("source_file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "id"))), lambda x: x.id), ",").alias("top"))


_DREAMABLE = "trim(content) <> '' AND chunk_type <> 'consolidated' AND memory_type <> 'dream' AND NOT coalesce({has}(tags, 'cron-finding'), false) AND NOT contains(content, '[private]')"
#: Seeds of a dream, and the days that make a memory forgotten or recent.
SEEDS, FORGOTTEN, RECENT = 12, 30, 7
_SEED_NOW = "TIMESTAMP{ntz} '2025-02-10 00:00:00'"


@C.add(
    f"""WITH {T.MEM}, e AS (SELECT id, coalesce(last_accessed, ingested_at) AS touched, ingested_at, related_memory_ids, md5(id) AS o FROM mem WHERE {_DREAMABLE.format(has="list_contains")}),
a AS (SELECT id, 'forgotten' AS stratum FROM e WHERE date_sub('day', touched, {_SEED_NOW.format(ntz="")}) >= {FORGOTTEN} ORDER BY o LIMIT {-(-SEEDS // 2)}),
b AS (SELECT id, 'recent' AS stratum FROM e WHERE date_sub('day', ingested_at, {_SEED_NOW.format(ntz="")}) < {RECENT} AND id NOT IN (SELECT id FROM a) ORDER BY o LIMIT {SEEDS // 4}),
ab AS (SELECT * FROM a UNION ALL SELECT * FROM b),
c AS (SELECT id, 'linked' AS stratum FROM e WHERE id IN (SELECT unnest(related_memory_ids) FROM e WHERE id IN (SELECT id FROM ab)) AND id NOT IN (SELECT id FROM ab) ORDER BY o LIMIT {SEEDS // 4}),
abc AS (SELECT * FROM ab UNION ALL SELECT * FROM c),
d AS (SELECT id, stratum FROM (SELECT id, 'fill' AS stratum, row_number() OVER (ORDER BY o) AS r FROM e WHERE id NOT IN (SELECT id FROM abc)) WHERE r <= {SEEDS} - (SELECT count(*) FROM abc))
SELECT * FROM abc UNION ALL SELECT * FROM d"""
)
def dream_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeds of a dream, in hash order: half forgotten, a quarter recent, a quarter linked from those, the rest filled."""
    e = T.memories(spark, sf_dir).where(_DREAMABLE.format(has="array_contains")).select("id", F.coalesce("last_accessed", "ingested_at").alias("touched"), "ingested_at", "related_memory_ids", F.md5("id").alias("o"))
    now = _SEED_NOW.format(ntz="_NTZ")
    chosen = materialize(e.where(f"timestampdiff(DAY, touched, {now}) >= {FORGOTTEN}").orderBy("o").limit(-(-SEEDS // 2)).select("id", F.lit("forgotten").alias("stratum")))
    for stratum, most, rows in (("recent", SEEDS // 4, e.where(f"timestampdiff(DAY, ingested_at, {now}) < {RECENT}")), ("linked", SEEDS // 4, None), ("fill", SEEDS, e)):
        # at most SEEDS rows are chosen
        if rows is None:
            wanted = e.join(F.broadcast(chosen), "id", "left_semi").select(F.explode("related_memory_ids").alias("id"))
            rows = e.join(wanted.distinct(), "id", "left_semi")
        more = rows.join(F.broadcast(chosen), "id", "left_anti").orderBy("o").limit(min(most, SEEDS - chosen.count())).select("id", F.lit(stratum).alias("stratum"))
        chosen = materialize(chosen.unionByName(more))
    return chosen


@C.add("WITH cfg AS (SELECT * FROM (VALUES (1, true, 'daily', 3, NULL::DATE), (2, true, 'daily', 3, DATE '2025-05-31'), (3, true, 'daily', 3, DATE '2025-06-01'), (4, true, 'weekly', 3, DATE '2025-05-26'), (5, true, 'weekly', 3, DATE '2025-05-25'), (6, false, 'daily', 3, NULL), (7, true, 'daily', 4, NULL)) t(id, enabled, frequency, hour, last)) SELECT id, enabled AND hour = 3 AND (last IS NULL OR CASE WHEN frequency = 'weekly' THEN date_diff('day', last, DATE '2025-06-01') >= 7 ELSE last < DATE '2025-06-01' END) AS due FROM cfg")
def dream_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a dream is due at three o'clock of a day: enabled, its hour, and none since the day or the week began."""
    rows = [(1, True, "daily", 3, None), (2, True, "daily", 3, "2025-05-31"), (3, True, "daily", 3, "2025-06-01"), (4, True, "weekly", 3, "2025-05-26"), (5, True, "weekly", 3, "2025-05-25"), (6, False, "daily", 3, None), (7, True, "daily", 4, None)]
    cfg = spark.createDataFrame(rows, "id int, enabled boolean, frequency string, hour int, last string")
    return cfg.selectExpr("id", "enabled AND hour = 3 AND (last IS NULL OR CASE WHEN frequency = 'weekly' THEN datediff(DATE '2025-06-01', CAST(last AS DATE)) >= 7 ELSE CAST(last AS DATE) < DATE '2025-06-01' END) AS due")


@C.add(
    """WITH rules AS (SELECT 'ids_unique' AS rule, count(*) - count(DISTINCT id) AS violations FROM memories
UNION ALL SELECT 'vector_dimension', count(*) FILTER (WHERE vector IS NULL OR len(vector) <> 64) FROM memory_vectors
UNION ALL SELECT 'vector_finite', count(*) FILTER (WHERE len(list_filter(vector, lambda x: isnan(x) OR isinf(x))) > 0) FROM memory_vectors
UNION ALL SELECT 'edges_unique', count(*) - count(DISTINCT (from_id, to_id, relation_type)) FROM relationships WHERE from_id IS NOT NULL AND to_id IS NOT NULL AND relation_type IS NOT NULL
UNION ALL SELECT 'edge_weight', count(*) FILTER (WHERE weight IS NULL OR weight < 0 OR weight > 1) FROM relationships)
SELECT rule, violations FROM rules"""
)
def snapshot_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Integrity rules of a snapshot with the number of rows that break each."""
    m, v, r = (table(spark, sf_dir, t) for t in ("memories", "memory_vectors", "relationships"))
    one = lambda rule, df: df.select(F.lit(rule).alias("rule"), F.col("n").alias("violations"))
    edges = r.where("from_id IS NOT NULL AND to_id IS NOT NULL AND relation_type IS NOT NULL")
    parts = [
        one("ids_unique", m.groupBy("id").agg((F.count("id") - 1 + F.when(F.col("id").isNull(), F.count(F.lit(1)) + 1).otherwise(0)).alias("k")).agg(F.sum("k").alias("n"))),
        one("vector_dimension", v.agg(F.count_if(F.expr("vector IS NULL OR size(vector) <> 64")).alias("n"))),
        one("vector_finite", v.agg(F.count_if(F.expr("exists(vector, x -> isnan(x) OR abs(x) > 3.4028235E38)")).alias("n"))),
        one("edges_unique", edges.groupBy("from_id", "to_id", "relation_type").agg((F.count(F.lit(1)) - 1).alias("k")).agg(F.sum("k").alias("n"))),
        one("edge_weight", r.agg(F.count_if(F.expr("weight IS NULL OR weight < 0 OR weight > 1")).alias("n"))),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# ---------------------------------------------------------------- clusters by k-means (no SQL)


def kmeans(rows: DataFrame, k: int, rounds: int = 50) -> DataFrame:
    """(vec_id, cluster): cosine k-means; the first seed is the smallest id, each further one the farthest from the rest.

    Seeds and centroids, k vectors, are the only rows that reach the driver. A round is one pass with 64 partial means
    per cluster; it stops when no centroid moves. Clusters are numbered by size, ties by their smallest member.
    """
    first = rows.orderBy("vec_id").limit(1).collect()
    if not first:
        return rows.select("vec_id", F.lit(0).alias("cluster"))
    seeds = [list(first[0]["v"])]

    def nearest(centres: list[list[float]]) -> str:
        each = ", ".join(f"named_struct('s', {T.dot('v', 'array(' + ', '.join(f'{x!r}D' for x in c) + ')')}, 'c', {-i})" for i, c in enumerate(centres))
        return f"array_max(array({each}))"

    while len(seeds) < k:
        far = rows.select("v", "vec_id", F.expr(f"{nearest(seeds)}.s").alias("s")).orderBy(F.round("s", 9), "vec_id").limit(1).collect()[0]
        seeds.append(list(far["v"]))
    for _ in range(rounds):
        means = rows.withColumn("c", F.expr(f"-{nearest(seeds)}.c")).groupBy("c").agg(*(F.avg(F.col("v")[i]).alias(f"_{i}") for i in range(len(seeds[0]))))
        moved = 0.0
        for r in means.collect():  # k rows
            new = [r[f"_{i}"] for i in range(len(seeds[0]))]
            norm = sum(x * x for x in new) ** 0.5
            if norm > 0:
                new = [x / norm for x in new]
                moved = max(moved, max(abs(a - b) for a, b in zip(new, seeds[r["c"]])))
                seeds[r["c"]] = new
        if moved < 1e-9:
            break
    placed = materialize(rows.select("vec_id", F.expr(f"-{nearest(seeds)}.c").alias("c")))
    sizes = placed.groupBy("c").agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("m"))
    numbered = sizes.withColumn("cluster", F.row_number().over(Window.orderBy(F.desc("n"), "m")) - 1)  # k rows
    return placed.join(F.broadcast(numbered.select("c", "cluster")), "c").select("vec_id", "cluster")


@C.add()
def topic_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmeans(T.unit(table(spark, sf_dir, "embeddings"), "embedding", "v").select("vec_id", "v"), 8)


QUERIES, SQL = C.queries, C.sql
