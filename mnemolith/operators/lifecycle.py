"""Records around the store: journals, evidence, skills, durations, transcripts, context blocks, realm changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mnemolith import params as P
from mnemolith import tables as T
from mnemolith.session import table

C = T.Catalogue()


@C.add("SELECT event_id, concat('# Skill ', event_type, chr(10), 'input: ', CAST(json_extract(props, '$.k') AS VARCHAR), chr(10), 'result: ', CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR)) AS memory FROM events WHERE event_type IN ('purchase', 'signup')")
def skill_memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Markdown memory of each executed skill, from its JSON payload."""
    rows = table(spark, sf_dir, "events").where("event_type IN ('purchase', 'signup')")
    return rows.selectExpr("event_id", "concat('# Skill ', event_type, '\\n', 'input: ', get_json_object(props, '$.k'), '\\n', 'result: ', CAST(CAST(round(value * 100) AS BIGINT) AS STRING)) AS memory")


# fixed values: seconds of a unit
UNITS = {"s": 1, "m": 60, "h": 3600, "d": 86400}
_TEXT = "concat(CAST(event_id % 97 AS {t}), substring('smhdx', CAST(event_id % 5 + 1 AS INT), 1))"


def duration(text: str, extract: str) -> str:
    """A duration such as 10m as seconds, null for what is none; extract names the engine's function."""
    unit = P.case(extract.format(p="([smhd])$"), {k: v for k, v in UNITS.items()}, "NULL")
    return f"CAST(nullif({extract.format(p='^([0-9]+)[smhd]$')}, '') AS BIGINT) * {unit}"


@C.add(f"WITH t AS (SELECT event_id, {_TEXT.format(t='VARCHAR')} AS text FROM events) SELECT event_id, text, {duration('text', "regexp_extract(text, '{p}', 1)")} AS seconds FROM t")
def parse_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").selectExpr("event_id", f"{_TEXT.format(t='STRING')} AS text")
    return rows.selectExpr("event_id", "text", f"{duration('text', "regexp_extract(text, '{p}', 1)")} AS seconds")


@C.add(f"WITH {T.MEM}, c AS (SELECT winner_id AS id, max(run_at) AS run_at FROM duplicate_candidates GROUP BY ALL) SELECT mem.id, greatest(c.run_at, mem.arrived_at) + INTERVAL 30 DAY AS no_dedup_until, greatest(c.run_at, mem.arrived_at) + INTERVAL 30 DAY > TIMESTAMP '2025-05-01 00:00:00' AS on_cooldown FROM mem JOIN c USING (id)")
def cooldowns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When a merged memory may be merged again: thirty days after its last change."""
    runs = table(spark, sf_dir, "duplicate_candidates").groupBy(F.col("winner_id").alias("id")).agg(F.max("run_at").alias("run_at"))
    until = T.memories(spark, sf_dir).select("id", "arrived_at").join(runs, "id").selectExpr("id", "greatest(run_at, arrived_at) + INTERVAL 30 DAYS AS no_dedup_until")
    return until.withColumn("on_cooldown", F.expr("no_dedup_until > TIMESTAMP_NTZ '2025-05-01 00:00:00'"))


@C.add(f"WITH {T.MEM}, r AS (SELECT DISTINCT source_id, memory_id, content FROM source_records WHERE length(trim(content)) >= 12) SELECT r.source_id, r.memory_id, contains(lower(mem.content), lower(trim(r.content))) AS quoted FROM r JOIN mem ON mem.id = r.memory_id")
def quote_supported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a record's text stands in the memory that it belongs to, regardless of case and outer blanks."""
    r = table(spark, sf_dir, "source_records").where("char_length(trim(content)) >= 12").select("source_id", "memory_id", "content").distinct()
    m = T.memories(spark, sf_dir).select(F.col("id").alias("memory_id"), F.col("content").alias("body"))
    return r.join(m, "memory_id").selectExpr("source_id", "memory_id", "contains(lower(body), lower(trim(content))) AS quoted")


@C.add(f"WITH {T.MEM}, j AS (SELECT DISTINCT winner_id, loser_id FROM duplicate_candidates), s AS (SELECT j.winner_id, j.loser_id, CASE WHEN l.id IS NULL THEN 'restored' WHEN l.verification_status = 'certified' THEN 'retained' ELSE 'live' END AS outcome FROM j LEFT JOIN mem l ON l.id = j.loser_id) SELECT winner_id, count(*) AS sources, count(*) FILTER (WHERE outcome = 'restored') AS restored, count(*) FILTER (WHERE outcome = 'retained') AS retained FROM s GROUP BY ALL")
def restore_journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Undoing merges: sources that are gone are restored, certified ones stay as they are."""
    j = table(spark, sf_dir, "duplicate_candidates").select("winner_id", "loser_id").distinct()
    live = T.memories(spark, sf_dir).select(F.col("id").alias("loser_id"), "verification_status", F.lit(1).alias("there"))
    s = j.join(live, "loser_id", "left")
    return s.groupBy("winner_id").agg(F.count(F.lit(1)).alias("sources"), F.count_if(F.col("there").isNull()).alias("restored"), F.count_if(F.col("verification_status") == "certified").alias("retained"))


#: Characters of a context block, and of the body of one of its lines.
BUDGET, BODY = 4000, 200
_LINE = "concat('- [', realm_name, '] ', CASE WHEN {len}(trim(content)) > 200 THEN concat(substring(trim(content), 1, 197), '...') ELSE trim(content) END)"


@C.add(
    f"""WITH {T.MEM}, {T.ERASED}, l AS (SELECT realm_name, id, importance, length({_LINE.format(len="length")}) + 1 AS cost FROM mem WHERE id NOT IN (SELECT id FROM gone)),
g AS (SELECT realm_name, list({{'used': cost, 'kept': 1::BIGINT, 'ids': id}} ORDER BY importance DESC, id) AS items FROM l GROUP BY ALL),
r AS (SELECT realm_name, list_reduce(list_prepend({{'used': 0::BIGINT, 'kept': 0::BIGINT, 'ids': ''}}, items), lambda m, x: CASE WHEN m.used + x.used + 1 <= {BUDGET} THEN {{'used': m.used + x.used, 'kept': m.kept + 1, 'ids': concat(m.ids, x.ids, ',')}} ELSE m END) AS m FROM g)
SELECT realm_name, m.kept AS memories, m.used AS chars, md5(m.ids) AS ids_md5 FROM r"""
)
def context_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most important live memories of each realm that fit its budget; one that does not fit is passed over.

    Of lines of one length no more can be taken than the budget holds, so all others are left out before a realm is
    gathered, which leaves at most BUDGET * (1 + 1/2 + ... + 1/cost) lines of it, whatever its size.
    """
    rows = T.live_memories(spark, sf_dir).select("realm_name", "id", "importance", F.expr(f"CAST(char_length({_LINE.format(len='char_length')}) + 1 AS BIGINT)").alias("cost"))
    order = [F.desc("importance"), F.col("id")]
    fitting = rows.withColumn("r", F.row_number().over(Window.partitionBy("realm_name", "cost").orderBy(*order))).where(F.col("r") * F.col("cost") < BUDGET)
    items = F.array_sort(F.collect_list(F.struct((-F.col("importance")).alias("o"), "id", "cost")))
    step = f"(m, x) -> IF(m.used + x.cost + 1 <= {BUDGET}, named_struct('used', m.used + x.cost, 'kept', m.kept + 1L, 'ids', concat(m.ids, x.id, ',')), m)"
    found = fitting.groupBy("realm_name").agg(items.alias("items")).withColumn("m", F.expr(f"aggregate(items, named_struct('used', 0L, 'kept', 0L, 'ids', ''), {step})"))
    return found.select("realm_name", F.col("m.kept").alias("memories"), F.col("m.used").alias("chars"), F.md5("m.ids").alias("ids_md5"))


@C.add("WITH p AS (SELECT doc_id, text, unnest(range(CAST(ceil(length(text) / 1500.0) AS BIGINT))) AS part FROM documents WHERE length(text) > 1500) SELECT doc_id, part, md5(substring(text, CAST(part * 1500 + 1 AS BIGINT), 1500)) AS piece_md5 FROM p")
def transcript_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long transcripts in parts of 1,500 characters, each with its digest; joined in order they give the text again."""
    rows = table(spark, sf_dir, "documents").where("char_length(text) > 1500").selectExpr("doc_id", "text", "explode(sequence(0, CAST(ceil(char_length(text) / 1500) AS INT) - 1)) AS part")
    return rows.selectExpr("doc_id", "CAST(part AS BIGINT) AS part", "md5(substring(text, part * 1500 + 1, 1500)) AS piece_md5")


_PARTS = range(1, 61, 15)


@C.add(f"WITH {T.MEM}, h AS (SELECT length(id) + length(content) AS size, sha256(concat(id, chr(0), content)) AS h FROM mem) SELECT count(*) AS memories, sum(size)::BIGINT AS chars, " + ", ".join(f"CAST(sum(CAST(('0x' || substring(h, {k}, 15)) AS BIGINT)) AS VARCHAR) AS s{k}, bit_xor(CAST(('0x' || substring(h, {k}, 15)) AS BIGINT)) AS x{k}" for k in _PARTS) + " FROM h")
def corpus_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures of all ids and contents that do not depend on their order: any change shows, with a chance of 2^-240.

    Sums and exclusive ors of the parts of each row's digest; partial aggregates only, nothing is gathered.
    """
    h = T.memories(spark, sf_dir).select((F.char_length("id") + F.char_length("content")).alias("size"), F.sha2(F.concat("id", F.lit("\0"), "content"), 256).alias("h"))
    parts = h.select("size", *(F.conv(F.substring("h", k, 15), 16, 10).cast("long").alias(f"p{k}") for k in _PARTS))
    figures = [f for k in _PARTS for f in (F.sum(F.col(f"p{k}").cast("decimal(20,0)")).cast("string").alias(f"s{k}"), F.bit_xor(f"p{k}").alias(f"x{k}"))]
    return parts.agg(F.count(F.lit(1)).alias("memories"), F.sum("size").alias("chars"), *figures)


@C.add(f"WITH {T.MEM}, v AS (SELECT DISTINCT memory_id AS id FROM memory_vectors WHERE memory_id IS NOT NULL) SELECT 'without_vector' AS side, count(*) AS n FROM (SELECT id FROM mem EXCEPT SELECT id FROM v) UNION ALL SELECT 'without_memory', count(*) FROM (SELECT id FROM v EXCEPT SELECT id FROM mem)")
def index_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids that only one of store and vector table holds."""
    m, v = T.memories(spark, sf_dir).select("id"), table(spark, sf_dir, "memory_vectors").select(F.col("memory_id").alias("id")).where("id IS NOT NULL").distinct()
    a = m.join(v, "id", "left_anti").agg(F.count(F.lit(1)).alias("n")).select(F.lit("without_vector").alias("side"), "n")
    return a.unionByName(v.join(m, "id", "left_anti").agg(F.count(F.lit(1)).alias("n")).select(F.lit("without_memory").alias("side"), "n"))


@C.add(f"WITH {T.MEM}, r AS (SELECT CASE WHEN realm_name LIKE 'garden-%' THEN 'garden' ELSE realm_name END AS realm_name FROM mem) SELECT realm_name, count(*) AS memories FROM r GROUP BY ALL")
def merge_realms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several realms merged into one, with the new counts."""
    return T.memories(spark, sf_dir).selectExpr("CASE WHEN realm_name LIKE 'garden-%' THEN 'garden' ELSE realm_name END AS realm_name").groupBy("realm_name").agg(F.count(F.lit(1)).alias("memories"))


@C.add(f"WITH {T.MEM}, n AS (SELECT count(DISTINCT realm_name) AS realms FROM mem WHERE realm_name <> '') SELECT realms, CASE WHEN realms > 20 THEN 0.375 WHEN realms > 10 THEN 0.525 ELSE 0.75 END::DOUBLE AS threshold FROM n")
def realm_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The similarity that a memory needs to join a realm falls as realms grow in number."""
    n = T.memories(spark, sf_dir).where("realm_name <> ''").agg(F.countDistinct("realm_name").alias("realms"))
    return n.selectExpr("realms", "CAST(CASE WHEN realms > 20 THEN 0.375 WHEN realms > 10 THEN 0.525 ELSE 0.75 END AS DOUBLE) AS threshold")


@C.add(f"WITH {T.MEM} SELECT realm_name, arg_max(memory_type, ({P.PRIORITY}, memory_type)) AS inherited FROM mem GROUP BY ALL")
def inherited_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The type that a summary of a realm inherits: that of the highest priority."""
    return T.memories(spark, sf_dir).groupBy("realm_name").agg(F.max(F.struct(F.expr(P.PRIORITY).alias("p"), "memory_type")).alias("m")).select("realm_name", F.col("m.memory_type").alias("inherited"))


@C.add("WITH r AS (SELECT lower(trim(memory_id)) AS memory_id, source_id, count(DISTINCT lower(content_hash)) AS contents FROM source_records WHERE trim(memory_id) <> '' AND source_id IS NOT NULL GROUP BY ALL) SELECT memory_id, count(*) AS sources, sum(contents)::BIGINT AS contents, count(*) FILTER (WHERE contents > 1) AS conflicting FROM r GROUP BY ALL")
def evidence_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sources of each memory, and how many of them sent more than one content."""
    rows = table(spark, sf_dir, "source_records").where("trim(memory_id) <> '' AND source_id IS NOT NULL").selectExpr("lower(trim(memory_id)) AS memory_id", "source_id", "lower(content_hash) AS h")
    each = rows.groupBy("memory_id", "source_id").agg(F.countDistinct("h").alias("contents"))
    return each.groupBy("memory_id").agg(F.count(F.lit(1)).alias("sources"), F.sum("contents").alias("contents"), F.count_if(F.col("contents") > 1).alias("conflicting"))


QUERIES, SQL = C.queries, C.sql
