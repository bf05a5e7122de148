"""Search with its parameters, lookups by key, gaps, persons, intents and the reports around them."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mnemolith import params as P
from mnemolith import tables as T
from mnemolith.operators import retrieval as R
from mnemolith.session import table

C = T.Catalogue()


@dataclass(frozen=True)
class Search:
    """What a search asks for: words for the keyword side, names of a person, and filters that hold before any ranking."""

    terms: tuple[str, ...] = ()
    person: tuple[str, ...] = ()
    realm: str | None = None
    tags: tuple[str, ...] = ()
    visibility: str | None = None
    types: tuple[str, ...] = ()
    intent: str = "general"
    limit: int = 20
    offset: int = 0
    least: float = R.LEAST
    min_score: float = 0.0
    dreams: bool = field(default=False)


def retrieval_filter(memories: DataFrame, s: Search) -> DataFrame:
    """Realm, all tags, visibility and types; dream memories stay out unless the tag dream is asked for."""
    rows = memories
    if s.realm is not None:
        rows = rows.where(F.col("realm_name") == s.realm.strip().lower())
    if s.visibility is not None:
        rows = rows.where(F.col("visibility") == s.visibility)
    if s.types:
        rows = rows.where(F.col("memory_type").isin(*s.types))
    for tag in s.tags:
        rows = rows.where(F.array_contains("tags", tag))
    if not s.dreams and "dream" not in s.tags:
        rows = rows.where("memory_type <> 'dream'")
    return rows


#: Long-lived memories that a question about a person looks at, best importance first.
PERSON_TYPES = ("profile", "preference", "entity", "relationship")


def names_all(column: str, terms: tuple[str, ...]) -> str:
    """Whether a text holds every term as a whole word."""
    parts = sorted({p for t in terms for p in t.lower().replace("-", " ").split()})
    words = f"split(lower({column}), '[^\\\\p{{L}}\\\\p{{N}}]+')"
    return " AND ".join(f"array_contains({words}, '{p}')" for p in parts) or "false"


def search(memories: DataFrame, vectors: DataFrame, query: DataFrame, s: Search) -> DataFrame:
    """(pos, id, score, person): the page of results of one query vector (qv).

    memories are the live ones (no erased ones among them). Dense and keyword candidates are taken among those that
    pass the filters; a memory that names the person in full comes first, whatever its cosine. The score is that of
    ``retrieval.hybrid_search``; ties go to the smaller id. An empty store gives no rows.
    """
    wv, wi, wr = P.INTENTS[s.intent]
    kept = retrieval_filter(memories, s)
    cos = R.similar(vectors.join(kept.select("id"), "id", "left_semi"), query)
    found = cos.orderBy(F.desc(F.round("cosine", 6)), "id").limit(R.CANDIDATES).where(F.col("cosine") >= s.least).select("id", F.col("cosine").alias("s"))
    if s.terms:
        words = R.bm25(kept, list(s.terms)).orderBy(F.desc(F.round("bm25", 6)), "id").limit(R.CANDIDATES)
        words = words.withColumn("bonus", R.HYBRID_WEIGHT * F.col("bm25") / F.max("bm25").over(Window.partitionBy())).select("id", "bonus")
        lexical = cos.join(F.broadcast(words), "id").select("id", F.col("cosine").alias("c"), "bonus")
        blended = found.join(lexical, "id", "full")
        found = blended.where(F.col("s").isNotNull() | (F.col("c") + F.col("bonus") >= s.least)).select("id", (F.coalesce("s", "c") + F.coalesce("bonus", F.lit(0.0))).alias("s"))
    if s.person:
        named = kept.where(F.col("memory_type").isin(*PERSON_TYPES)).where(names_all("content", s.person)).orderBy(F.desc("importance"), "id").limit(R.CANDIDATES).select("id", F.lit(True).alias("person"))
        found = found.join(named, "id", "full").select("id", F.coalesce("s", F.lit(s.least)).alias("s"), F.coalesce("person", F.lit(False)).alias("person"))
    else:
        found = found.withColumn("person", F.lit(False))
    score = f"s * ({P.TRUST}) * {wv}D * (1 + (importance - 0.5D) * ({wi}D - 1)) * (1 + (({R.recency(R.HOURS)}) - 0.5D) * ({wr}D - 1)) * (1 + upvotes * 0.18D)"
    scored = kept.join(F.broadcast(found), "id").select("id", F.expr(f"round({score}, 5)").alias("score"), "person")
    order = [F.desc("person"), F.desc("score"), F.col("id")]
    # the limit comes before the least score, so a page can be short
    page = scored.orderBy(*order).limit(s.offset + s.limit).withColumn("pos", F.row_number().over(Window.orderBy(*order)) - 1)
    return page.where((F.col("pos") >= s.offset) & (F.col("score") >= s.min_score)).select("pos", "id", "score", "person")


#: The search that the queries below run, with every parameter in use.
ASKED = Search(terms=("planner", "backup", "realm"), person=("selma",), visibility="public", tags=("lang:en",), intent="preference", limit=20, offset=5)


def _search_sql(s: Search) -> str:
    wv, wi, wr = P.INTENTS[s.intent]
    where = " AND ".join([f"visibility = '{s.visibility}'", *(f"list_contains(tags, '{t}')" for t in s.tags), "memory_type <> 'dream'", "id NOT IN (SELECT id FROM gone)"])
    words = "regexp_split_to_array(lower(content), '[^\\p{L}\\p{N}]+')"
    types = ", ".join(f"'{t}'" for t in PERSON_TYPES)
    named = " AND ".join(f"list_contains({words}, '{p}')" for p in s.person)
    bm25 = R._bm25_sql(list(s.terms)).replace("FROM mem)", "FROM kept)")
    return f"""WITH {T.VEC}, {R._QUERY}, {T.MEM}, {T.ERASED}, kept AS (SELECT * FROM mem WHERE {where}), {bm25},
cos AS (SELECT id, array_cosine_similarity(v, qv) AS cosine FROM vec JOIN kept USING (id), q),
dense AS (SELECT * FROM (SELECT id, cosine FROM cos ORDER BY round(cosine, 6) DESC, id LIMIT {R.CANDIDATES}) WHERE cosine >= {s.least}),
words50 AS (SELECT id, bm25 FROM bm25 ORDER BY round(bm25, 6) DESC, id LIMIT {R.CANDIDATES}),
bonus AS (SELECT id, {R.HYBRID_WEIGHT} * bm25 / (SELECT max(bm25) FROM words50) AS bonus FROM words50),
blended AS (SELECT d.id, d.cosine + coalesce(b.bonus, 0) AS s FROM dense d LEFT JOIN bonus b USING (id)
  UNION ALL SELECT b.id, c.cosine + b.bonus FROM bonus b JOIN cos c USING (id) WHERE b.id NOT IN (SELECT id FROM dense) AND c.cosine + b.bonus >= {s.least}),
named AS (SELECT id FROM kept WHERE memory_type IN ({types}) AND {named} ORDER BY importance DESC, id LIMIT {R.CANDIDATES}),
found AS (SELECT coalesce(b.id, n.id) AS id, coalesce(b.s, {s.least}) AS s, n.id IS NOT NULL AS person FROM blended b FULL JOIN named n ON b.id = n.id),
scored AS (SELECT id, person, round(s * ({P.TRUST}) * {wv}::DOUBLE * (1 + (importance - 0.5) * ({wi}::DOUBLE - 1)) * (1 + (({R.recency(R.HOURS_SQL)}) - 0.5) * ({wr}::DOUBLE - 1)) * (1 + upvotes * CAST(0.18 AS DOUBLE)), 5) AS score FROM found JOIN kept USING (id)),
ranked AS (SELECT *, row_number() OVER (ORDER BY person DESC, score DESC, id) - 1 AS pos FROM scored)"""


_PAGE = f"pos >= {ASKED.offset} AND pos < {ASKED.offset + ASKED.limit}"


@C.add(f"{_search_sql(ASKED)} SELECT pos, id, score, person FROM ranked WHERE {_PAGE}")
def search_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of a search: filters, keywords, a person, erased and dream memories left out."""
    v = T.vectors(spark, sf_dir)
    return search(T.live_memories(spark, sf_dir), v, R.query_vector(v), ASKED)


_FULL = ("id", "realm_name", "memory_type", "importance", "upvotes", "access_count", "source_file", "chunk_type", "verification_status", "visibility", "ingested_at")


@C.add(f"{_search_sql(ASKED)} SELECT pos, score, {', '.join(f'kept.{c}' for c in _FULL)}, md5(kept.content) AS content_md5 FROM ranked JOIN kept USING (id) WHERE {_PAGE}")
def search_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same page with all public fields of its memories."""
    mem = T.live_memories(spark, sf_dir)
    return F.broadcast(search_page(spark, sf_dir).select("pos", "id", "score")).join(mem, "id").select("pos", "score", *_FULL, F.md5("content").alias("content_md5"))


@C.add(f"WITH {T.VEC}, {R._QUERY}, {T.MEM}, {T.ERASED}, s AS (SELECT m.id, m.realm_name, m.heading, round(array_cosine_similarity(v, qv), 5) AS score FROM vec JOIN mem m USING (id), q WHERE m.id NOT IN (SELECT id FROM gone) AND memory_type <> 'dream') SELECT * FROM (SELECT * FROM s ORDER BY score DESC, id LIMIT 10) WHERE score >= 0.3")
def graph_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten memories nearest to an entity, from 0.3 on, with realm and heading."""
    mem, v = T.live_memories(spark, sf_dir).where("memory_type <> 'dream'").select("id", "realm_name", "heading"), T.vectors(spark, sf_dir)
    near = R.similar(v.join(mem.select("id"), "id", "left_semi"), R.query_vector(v)).select("id", F.round("cosine", 5).alias("score"))
    top = near.orderBy(F.desc("score"), "id").limit(10).where("score >= 0.3")
    return mem.join(F.broadcast(top), "id").select("id", "realm_name", "heading", "score")


# ---------------------------------------------------------------- lookups by key

_SOME = "some AS (SELECT id FROM mem ORDER BY md5(id) LIMIT 1)"


@C.add(f"WITH {T.MEM}, {T.ERASED}, asked AS (SELECT id FROM (SELECT id FROM mem ORDER BY md5(id) LIMIT 1) UNION ALL SELECT max(id) FROM gone UNION ALL SELECT 'nobody') SELECT asked.id, CASE WHEN m.id IS NULL THEN 404 ELSE 200 END AS status, m.memory_type, m.realm_name FROM asked LEFT JOIN (SELECT * FROM mem WHERE id NOT IN (SELECT id FROM gone)) m USING (id)")
def memory_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single memories by id: one that exists, an erased one and an unknown one; the last two are not found."""
    gone = table(spark, sf_dir, "erasure_intents").where("complete = 1").selectExpr("max(lower(trim(memory_id))) AS id")
    asked = T.memories(spark, sf_dir).select("id").orderBy(F.md5("id")).limit(1).unionByName(gone).unionByName(spark.createDataFrame([("nobody",)], "id string"))
    live = T.live_memories(spark, sf_dir).select("id", "memory_type", "realm_name", F.lit(200).alias("found"))
    return F.broadcast(asked).join(live, "id", "left").select("id", F.coalesce("found", F.lit(404)).alias("status"), "memory_type", "realm_name")


_HASH = "(SELECT source_hash FROM mem WHERE source_hash <> '' GROUP BY source_hash ORDER BY count(*) DESC, source_hash LIMIT 1)"


@C.add(f"WITH {T.MEM} SELECT id, source_hash, memory_type FROM mem WHERE source_hash = {_HASH} ORDER BY id LIMIT 100")
def by_source_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hundred memories of one source hash, here the most frequent one."""
    mem = T.memories(spark, sf_dir)
    asked = mem.where("source_hash <> ''").groupBy("source_hash").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "source_hash").limit(1).select("source_hash")
    return mem.join(F.broadcast(asked), "source_hash", "left_semi").select("id", "source_hash", "memory_type").orderBy("id").limit(100)


@C.add(f"WITH {T.MEM} SELECT r.realm_name, r.tag, EXISTS (SELECT 1 FROM mem WHERE mem.realm_name = r.realm_name AND list_contains(mem.tags, r.tag)) AS present FROM (VALUES ('inbox', 'lang:en'), ('inbox', 'lang:xx'), ('nowhere', 'lang:en')) r(realm_name, tag)")
def has_matching_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a realm holds any memory with a tag: a semi join of the probes, the store is not counted."""
    probes = spark.createDataFrame([("inbox", "lang:en"), ("inbox", "lang:xx"), ("nowhere", "lang:en")], "realm_name string, tag string")
    held = T.memories(spark, sf_dir).where("realm_name IN ('inbox', 'nowhere')").select("realm_name", F.explode("tags").alias("tag")).where("tag IN ('lang:en', 'lang:xx')").distinct().withColumn("present", F.lit(True))
    return F.broadcast(probes).join(held, ["realm_name", "tag"], "left").select("realm_name", "tag", F.coalesce("present", F.lit(False)).alias("present"))


@C.add(f"WITH {T.MEM} SELECT id, list_contains(tags, 'project:p1') OR list_contains(tags, 'lang:en') AS in_scope FROM mem WHERE realm_name = 'inbox'")
def project_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a row may be handed to a reader of one project: its tag must be there."""
    return T.memories(spark, sf_dir).where("realm_name = 'inbox'").selectExpr("id", "array_contains(tags, 'project:p1') OR array_contains(tags, 'lang:en') AS in_scope")


@C.add(f"WITH {T.MEM} SELECT realm_name, len(list_filter(string_split(realm_name, '-'), lambda x: x IN ('a', 'b'))) AS split_depth, len(list_filter(string_split(realm_name, '-'), lambda x: x IN ('a', 'b'))) >= 2 AS corrupted, count(*) AS memories FROM (SELECT realm_name FROM mem UNION ALL SELECT concat(realm_name, '-a-b') FROM mem WHERE realm_name <> '') GROUP BY ALL")
def corrupted_realms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Realm names and how often they were split; twice and more is a name gone wrong. Half of the names are made so."""
    mem = T.memories(spark, sf_dir).select("realm_name")
    rows = mem.unionByName(mem.where("realm_name <> ''").select(F.concat("realm_name", F.lit("-a-b")).alias("realm_name")))
    counted = rows.groupBy("realm_name").agg(F.count(F.lit(1)).alias("memories"))
    return counted.selectExpr("realm_name", "CAST(size(filter(split(realm_name, '-'), x -> x IN ('a', 'b'))) AS BIGINT) AS split_depth", "size(filter(split(realm_name, '-'), x -> x IN ('a', 'b'))) >= 2 AS corrupted", "memories")


@C.add(f"WITH {T.MEM}, {T.ERASED} SELECT (SELECT count(*) FROM mem) AS memories, (SELECT count(DISTINCT realm_name) FROM mem WHERE realm_name <> '') AS realms, (SELECT count(*) FROM mem WHERE verification_status = 'certified') AS certified, (SELECT count(*) FROM mem WHERE id IN (SELECT id FROM gone)) AS erased, (SELECT count(DISTINCT tag) FROM (SELECT unnest(tags) AS tag FROM mem) WHERE tag IS NOT NULL) AS tags")
def memory_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts over the whole store: memories, realms, certified and erased ones, tags."""
    mem = T.memories(spark, sf_dir)
    gone = table(spark, sf_dir, "erasure_intents").where("complete = 1").selectExpr("lower(trim(memory_id)) AS id").where("id <> ''").distinct()
    one = mem.agg(F.count(F.lit(1)).alias("memories"), F.countDistinct(F.when(F.col("realm_name") != "", F.col("realm_name"))).alias("realms"), F.count_if(F.col("verification_status") == "certified").alias("certified"))
    erased = mem.select("id").join(gone, "id", "left_semi").agg(F.count(F.lit(1)).alias("erased"))
    tags = mem.select(F.explode("tags").alias("tag")).agg(F.countDistinct("tag").alias("tags"))
    return one.crossJoin(F.broadcast(erased)).crossJoin(F.broadcast(tags))  # single rows


# ---------------------------------------------------------------- gaps

_GAPS = """member AS (SELECT t.id AS cluster_id, coalesce(t.label, '') AS label, t.total_link_strength AS strength, unnest(t.memory_ids) AS mid FROM topic_clusters t),
live AS (SELECT cluster_id, any_value(label) AS label, any_value(strength) AS strength, count(DISTINCT mid) AS members, count(DISTINCT CASE WHEN m.id IS NOT NULL THEN mid END) AS there FROM member LEFT JOIN mem m ON m.id = mid GROUP BY cluster_id),
gaps AS (SELECT cluster_id, label, CASE WHEN there = members THEN 'closed' ELSE 'open' END AS status, CASE WHEN label = '' THEN 'unnamed' WHEN 2 * there < members THEN 'missing' ELSE 'thin' END AS gap_type, round(1 - there / CAST(members AS DOUBLE), 5) AS importance FROM live)"""


def gaps(memories: DataFrame, topic_clusters: DataFrame) -> DataFrame:
    """(cluster_id, label, status, gap_type, importance): what a topic of an earlier run has lost is a gap."""
    member = topic_clusters.select(F.col("id").alias("cluster_id"), F.coalesce("label", F.lit("")).alias("label"), F.explode("memory_ids").alias("id")).where("id IS NOT NULL").distinct()
    live = member.join(memories.select("id", F.lit(1).alias("there")), "id", "left").groupBy("cluster_id", "label").agg(F.count(F.lit(1)).alias("members"), F.count("there").alias("there"))
    return live.selectExpr("cluster_id", "label", "CASE WHEN there = members THEN 'closed' ELSE 'open' END AS status", "CASE WHEN label = '' THEN 'unnamed' WHEN 2 * there < members THEN 'missing' ELSE 'thin' END AS gap_type", "round(1 - there / CAST(members AS DOUBLE), 5) AS importance")


@C.add(f"WITH {T.MEM}, {_GAPS} SELECT cluster_id, label, status, gap_type, importance FROM gaps WHERE status = 'open' ORDER BY importance DESC, cluster_id LIMIT 100")
def list_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundred most important open gaps."""
    found = gaps(T.memories(spark, sf_dir), table(spark, sf_dir, "topic_clusters"))
    return found.where("status = 'open'").orderBy(F.desc("importance"), "cluster_id").limit(100)


TOPIC = "backup"


@C.add(
    f"""WITH {T.MEM}, {_GAPS}, score AS (SELECT cluster_id, count(DISTINCT mid) AS n FROM member JOIN mem m ON m.id = mid WHERE contains(lower(m.content), '{TOPIC}') GROUP BY ALL),
best AS (SELECT cluster_id FROM score ORDER BY n DESC, cluster_id LIMIT 1), kin AS (SELECT DISTINCT o.cluster_id FROM member o WHERE o.mid IN (SELECT mid FROM member WHERE cluster_id IN (SELECT cluster_id FROM best)))
SELECT cluster_id, gap_type, importance, cluster_id IN (SELECT cluster_id FROM best) AS is_target FROM gaps WHERE status = 'open' AND cluster_id IN (SELECT cluster_id FROM kin) ORDER BY importance DESC, cluster_id LIMIT 20"""
)
def infer_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open gaps around a topic: those of the cluster whose memories name it most, and of clusters that share a member."""
    mem, clusters = T.memories(spark, sf_dir), table(spark, sf_dir, "topic_clusters")
    member = clusters.select(F.col("id").alias("cluster_id"), F.explode("memory_ids").alias("mid")).where("mid IS NOT NULL").distinct()
    about = mem.where(F.contains(F.lower("content"), F.lit(TOPIC))).select(F.col("id").alias("mid"))
    best = member.join(about, "mid", "left_semi").groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "cluster_id").limit(1).select("cluster_id")
    # one cluster's members
    shared = member.join(F.broadcast(best), "cluster_id", "left_semi").select("mid")
    kin = member.join(shared, "mid", "left_semi").select("cluster_id").distinct()
    open_gaps = gaps(mem, clusters).where("status = 'open'").join(kin, "cluster_id", "left_semi").join(F.broadcast(best.withColumn("is_target", F.lit(True))), "cluster_id", "left")
    return open_gaps.select("cluster_id", "gap_type", "importance", F.coalesce("is_target", F.lit(False)).alias("is_target")).orderBy(F.desc("importance"), "cluster_id").limit(20)


_LABEL_WORDS = "list_filter(list_transform(regexp_split_to_array(substring(m.content, 1, 200), '[ \\t\\n\\r]+'), lambda w: lower(regexp_replace(w, '[^\\p{L}\\p{N}]', '', 'g'))), lambda w: length(w) >= 3 AND NOT list_contains([" + ", ".join(f"'{w}'" for w in P.STOPWORDS) + "], w))"
_LABEL_WORDS_SPARK = "filter(transform(split(substring(content, 1, 200), '[ \\\\t\\\\n\\\\r]+'), w -> lower(regexp_replace(w, '[^\\\\p{L}\\\\p{N}]', ''))), w -> char_length(w) >= 3 AND NOT array_contains(array(" + ", ".join(f"'{w}'" for w in P.STOPWORDS) + "), w))"


@C.add(
    f"""WITH {T.MEM}, member AS (SELECT DISTINCT t.id AS cluster_id, unnest(t.memory_ids) AS mid FROM topic_clusters t), w AS (SELECT cluster_id, unnest({_LABEL_WORDS}) AS word FROM member JOIN mem m ON m.id = mid),
c AS (SELECT cluster_id, word, count(*) AS n FROM w GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY n DESC, word) AS r FROM c)
SELECT cluster_id, coalesce(string_agg(concat(upper(substring(word, 1, 1)), substring(word, 2)), ' ' ORDER BY r) FILTER (WHERE n >= 2), concat('Topic-', substring(md5(cluster_id), 1, 6))) AS label FROM r WHERE r <= 3 GROUP BY cluster_id"""
)
def cluster_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A name for each topic: its three most frequent words that occur twice, else a name from its id."""
    member = table(spark, sf_dir, "topic_clusters").select(F.col("id").alias("cluster_id"), F.explode("memory_ids").alias("id")).distinct()
    words = member.join(T.memories(spark, sf_dir).select("id", "content"), "id").select("cluster_id", F.explode(F.expr(_LABEL_WORDS_SPARK)).alias("word"))
    counted = words.groupBy("cluster_id", "word").agg(F.count(F.lit(1)).alias("n"))
    top = counted.withColumn("r", F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.desc("n"), "word"))).where("r <= 3")
    kept = F.array_sort(F.collect_list(F.when(F.col("n") >= 2, F.struct("r", "word"))))
    named = top.groupBy("cluster_id").agg(F.array_join(F.transform(kept, lambda x: F.concat(F.upper(F.substring(x.word, 1, 1)), F.substring(x.word, 2, 1_000_000))), " ").alias("label"))
    return named.select("cluster_id", F.when(F.col("label") == "", F.concat(F.lit("Topic-"), F.substring(F.md5("cluster_id"), 1, 6))).otherwise(F.col("label")).alias("label"))


# ---------------------------------------------------------------- questions

# fixed values: the rules of a question's intent with their confidence; the first that matches decides
INTENT_RULES = (
    ("preference", 0.85, (r"\b(like|likes|liked|prefer|prefers|preferred|favorite|favourite|love|loves|hate|hates|enjoy|enjoys)\b", r"\bwhat\s+does\s+\w+\s+(like|prefer|love|hate|enjoy)\b", r"\b\w+'s\s+(favorite|favourite)\b")),
    ("temporal", 0.9, (r"\b(when|last|yesterday|today|tomorrow|ago|before|after|since|until|during|recently|lately)\b", r"\b(monday|tuesday|wednesday|thursday|friday|saturday|sunday)\b", r"\b(january|february|march|april|may|june|july|august|september|october|november|december)\b", r"\b\d{4}-\d{2}-\d{2}\b", r"\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b", r"\b(this|next|last)\s+(week|month|year|monday|tuesday|wednesday|thursday|friday|saturday|sunday)\b", r"\b\d+\s+(day|week|month|year|hour|minute)s?\s+(ago|from now|later|earlier)\b")),
    ("factual", 0.8, (r"\bwhat\s+is\b", r"\bwho\s+is\b", r"\bwhere\s+is\b", r"\b(definition|define|explain|meaning)\b", r"\bhow\s+(many|much|long|far)\b")),
    ("entity", 0.7, (r"\b(who|what)\s+(is|was|are|were)\s+\w+", r"\babout\s+\w+\b")),
    ("procedural", 0.8, (r"\bhow\s+(do|does|did|can|could|would|should|to)\b", r"\b(setup|install|configure|deploy|build|run|start|stop|restart|fix|debug|troubleshoot)\b", r"\b(step|steps|guide|tutorial|instructions?)\b")),
)


def _unicode(pattern: str) -> str:
    """The pattern with word characters and boundaries of all scripts, in a form that every engine reads alike."""
    word = r"\p{L}\p{N}_"
    head, tail = pattern.startswith(r"\b"), pattern.endswith(r"\b")
    core = pattern[2 if head else 0 : -2 if tail else None].replace(r"\w", f"[{word}]")
    return (f"(^|[^{word}])" if head else "") + core + (f"($|[^{word}])" if tail else "")


def intent_case(value, matches: str, escape: bool) -> str:
    """value(name, confidence) of the first rule that matches."""
    out = []
    for name, confidence, patterns in INTENT_RULES:
        for p in patterns:
            p = _unicode(p)
            p = p.replace("'", "''") if not escape else p.replace("\\", "\\\\").replace("'", "\\'")
            out.append(f"WHEN {matches.replace('<p>', p)} THEN {value(name, confidence)}")
    return "CASE " + " ".join(out) + f" ELSE {value('general', 0.5)} END"


_INTENT_VALUES = {
    "intent": lambda name, sure: f"'{name}'",
    "confidence": lambda name, sure: f"CAST({sure} AS DOUBLE)",
    **{f"{side}_bias": lambda name, sure, k=k: f"CAST({P.INTENTS[name][k]} AS DOUBLE)" for k, side in enumerate(("vector", "importance", "recency"))},
}


@C.add("SELECT item_id, " + ", ".join(f"{intent_case(v, "regexp_matches(lower(question), '<p>')", False)} AS {k}" for k, v in _INTENT_VALUES.items()) + " FROM eval_items WHERE question IS NOT NULL")
def intent_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a question is after, how sure that is, and how it weighs vector, importance and recency."""
    asked = table(spark, sf_dir, "eval_items").where("question IS NOT NULL")
    return asked.selectExpr("item_id", *(f"{intent_case(v, "lower(question) RLIKE '<p>'", True)} AS {k}" for k, v in _INTENT_VALUES.items()))


# fixed values: the question about a person, and words that are no names
PERSON_QUESTION = r"^\s*(?:who\s*(?:'s|’s|\s+is|\s+was|\s+are|\s+were)|tell\s+me\s+(?:more\s+)?about|what\s+do\s+(?:you|we)\s+know\s+about)\s+(.+?)[\s?.!]*$"
NO_NAMES = ("a", "an", "the", "my", "our", "your", "his", "her", "their", "is", "was", "are", "were", "of", "to", "me", "us", "about", "again", "exactly", "really", "mr", "mrs", "ms", "dr")


def person_terms_of(question: str) -> Column:
    """The names that a question about a person asks for, as an array; empty for another question."""
    got = F.regexp_extract(F.lower(question), PERSON_QUESTION, 1)
    parts = F.split(got, r"[^\p{L}\p{N}'’-]+")
    trimmed = F.transform(parts, lambda t: F.regexp_replace(F.regexp_replace(t, r"^['’-]+|['’-]+$", ""), r"['’]s$", ""))
    return F.filter(trimmed, lambda t: (F.char_length(t) >= 2) & ~t.isin(*NO_NAMES))


_ASKING = "CASE event_id % 5 WHEN 0 THEN concat('Who is Dr. Mara-', event_type, '’s boss?') WHEN 1 THEN concat('tell me more about ', upper(event_type), '.') WHEN 2 THEN concat('What do we know about the ', event_type, ' of user u', event_id % 7, '?') WHEN 3 THEN concat('How is ', event_type, '?') ELSE concat('WHO WAS ', event_type, ' really!') END AS question"
_PQ = PERSON_QUESTION.replace("'", "''")


@C.add(
    f"""WITH q AS (SELECT event_id, {_ASKING} FROM events), g AS (SELECT event_id, list_transform(regexp_split_to_array(regexp_extract(lower(question), '{_PQ}', 1), '[^\\p{{L}}\\p{{N}}''’-]+'), lambda t: regexp_replace(regexp_replace(t, '^[''’-]+|[''’-]+$', '', 'g'), '[''’]s$', '')) AS t FROM q)
SELECT event_id, array_to_string(list_filter(t, lambda x: length(x) >= 2 AND NOT list_contains([{", ".join(f"'{w}'" for w in NO_NAMES)}], x)), ' ') AS terms FROM g"""
)
def person_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The terms of questions about persons, made of the events."""
    rows = table(spark, sf_dir, "events").selectExpr("event_id", _ASKING)
    return rows.select("event_id", F.array_join(person_terms_of("question"), " ").alias("terms"))


# ---------------------------------------------------------------- small reports

_LEVEL = "CASE WHEN best >= 0.55 THEN 'high' WHEN best >= 0.40 THEN 'partial' ELSE 'none' END"


@C.add(f"WITH c AS (SELECT realm_name, max(cosine) AS best, count(*) FILTER (WHERE cosine >= 0.5) AS n FROM duplicate_candidates WHERE cosine IS NOT NULL GROUP BY ALL) SELECT realm_name, concat('coverage: ', {_LEVEL}, ' (best ', CAST(CAST(round(best * 100) AS BIGINT) AS VARCHAR), '%, ', CAST(n AS VARCHAR), ' results)') AS line FROM c")
def coverage_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One line per group that says how well it covers a query, here from an earlier run's cosines."""
    c = table(spark, sf_dir, "duplicate_candidates").where("cosine IS NOT NULL").groupBy("realm_name").agg(F.max("cosine").alias("best"), F.count_if(F.col("cosine") >= 0.5).alias("n"))
    return c.selectExpr("realm_name", f"concat('coverage: ', {_LEVEL}, ' (best ', CAST(CAST(round(best * 100) AS BIGINT) AS STRING), '%, ', CAST(n AS STRING), ' results)') AS line")


@C.add(f"WITH {T.MEM}, t AS (SELECT ingested_at AS moment FROM mem WHERE ingested_at IS NOT NULL ORDER BY md5(id) LIMIT 1), n AS (SELECT count(*) AS n FROM mem, t WHERE ingested_at >= moment - INTERVAL 3 DAY AND ingested_at < moment + INTERVAL 3 DAY) SELECT least(n, 200) AS scanned, n > 200 AS truncated FROM n")
def timeline_work_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows around a moment that a request may look at, and whether the limit cut them."""
    mem = T.memories(spark, sf_dir).where("ingested_at IS NOT NULL").select("id", "ingested_at")
    at = mem.orderBy(F.md5("id")).limit(1).select(F.col("ingested_at").alias("at"))
    near = mem.crossJoin(F.broadcast(at)).where("ingested_at >= at - INTERVAL 3 DAYS AND ingested_at < at + INTERVAL 3 DAYS").limit(201).agg(F.count(F.lit(1)).alias("n"))
    return near.selectExpr("least(n, 200) AS scanned", "n > 200 AS truncated")


QUERIES, SQL = C.queries, C.sql
