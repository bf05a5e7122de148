"""Reading the store: recall, hybrid search, coverage, timeline, lookups and listings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mnemolith import blocks as B
from mnemolith import params as P
from mnemolith import tables as T
from mnemolith.session import arrow_map, materialize, table

C = T.Catalogue()

#: Neighbours kept beyond those asked for, so that equal rounded cosines at the last rank are settled by id.
SPARE = 3
#: Realms that are compared with every memory at once.
REALMS = 4096

HOURS = f"CAST(greatest(timestampdiff(HOUR, last_accessed, {P.NOW_NTZ}), 0) AS DOUBLE)"
HOURS_SQL = f"CAST(greatest(date_sub('hour', last_accessed, {P.NOW}), 0) AS DOUBLE)"


def recency(hours: str) -> str:
    """1 for certified memories and unknown times, else the survival of the type's curve after whole hours."""
    return f"CASE WHEN verification_status = 'certified' OR last_accessed IS NULL THEN CAST(1.0 AS DOUBLE) ELSE exp(-power(greatest({hours}, CAST(1.0 AS DOUBLE) / 60) / ({P.ETA}), {P.K})) END"


SCORE = f"importance * ({{recency}}) * (1 + access_count * CAST(0.05 AS DOUBLE)) * (1 + upvotes * CAST(0.18 AS DOUBLE)) * ({P.TRUST})"


def recall(memories: DataFrame, limit: int = 20) -> DataFrame:
    """(id, memory_type, score): the memories of the highest recall score, ties by id."""
    scored = memories.select("id", "memory_type", F.expr(f"round({SCORE.format(recency=recency(HOURS))}, 6)").alias("score"))
    return scored.orderBy(F.desc("score"), "id").limit(limit)


@C.add(f"WITH {T.MEM} SELECT id, memory_type, round({SCORE.format(recency=recency(HOURS_SQL))}, 6) AS score FROM mem ORDER BY score DESC, id LIMIT 20")
def recall_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recall(T.memories(spark, sf_dir))


@C.add(f"WITH {T.MEM}, s AS (SELECT memory_type, realm_name, CAST(round({SCORE.format(recency=recency(HOURS_SQL))} * 1000000000) AS BIGINT) AS s FROM mem) SELECT memory_type, realm_name, count(*) AS memories, CAST(sum(s)::BIGINT // count(*) // 10000 AS DOUBLE) / 100000 AS mean_score, CAST(max(s) // 10000 AS DOUBLE) / 100000 AS best FROM s GROUP BY ALL")
def recall_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores per type and realm, to five places; they are summed as whole billionths, so the order of rows is no matter."""
    rows = T.memories(spark, sf_dir).select("memory_type", "realm_name", F.expr(f"CAST(round({SCORE.format(recency=recency(HOURS))} * 1000000000) AS BIGINT)").alias("s"))
    total = rows.groupBy("memory_type", "realm_name").agg(F.count(F.lit(1)).alias("memories"), F.sum("s").alias("total"), F.max("s").alias("top"))
    return total.selectExpr("memory_type", "realm_name", "memories", "CAST(total div memories div 10000 AS DOUBLE) / 100000 AS mean_score", "CAST(top div 10000 AS DOUBLE) / 100000 AS best")


@C.add(
    f"""WITH types(memory_type) AS (VALUES {", ".join(f"('{t}')" for t in [*P.WEIBULL, "unheard"])}),
ages(hours) AS (VALUES (0), (1), (24), (168), (720), (4380))
SELECT memory_type, hours, round(exp(-power(greatest(CAST(hours AS DOUBLE), CAST(1.0 AS DOUBLE) / 60) / ({P.ETA}), {P.K})), 6) AS boost FROM types, ages"""
)
def weibull_decay_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    types = spark.createDataFrame([(t,) for t in [*P.WEIBULL, "unheard"]], "memory_type string")
    rows = types.select("memory_type", F.explode(F.array(*(F.lit(h) for h in (0, 1, 24, 168, 720, 4380)))).alias("hours"))
    return rows.withColumn("boost", F.expr(f"round(exp(-power(greatest(CAST(hours AS DOUBLE), 1D / 60) / ({P.ETA}), {P.K})), 6)"))


# ---------------------------------------------------------------- words and BM25

TOKENS = "filter(split(lower({t}), '[^\\\\p{{L}}\\\\p{{N}}]+'), w -> w <> '' AND (char_length(w) > 1 OR w RLIKE '^[0-9]$') AND NOT array_contains(array(" + ", ".join(f"'{w}'" for w in P.STOPWORDS) + "), w))"
TOKENS_SQL = "list_filter(regexp_split_to_array(lower({t}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '' AND (length(w) > 1 OR regexp_matches(w, '^[0-9]$')) AND NOT list_contains([" + ", ".join(f"'{w}'" for w in P.STOPWORDS) + "], w))"
TEXT = "concat_ws(' ', heading, content, array_join(tags, ' '))"
TEXT_SQL = "concat_ws(' ', heading, content, array_to_string(tags, ' '))"
K1, SIZE = 1.2, 0.75


def bm25(memories: DataFrame, terms: list[str]) -> DataFrame:
    """(id, bm25): keyword score of every memory that holds one of the terms.

    Statistics (number and mean length of texts, frequency of terms) are taken over all texts; only the postings of
    the asked terms are counted, inside the row, so that nothing but a few numbers per text is shuffled.
    """
    wanted = ", ".join(f"'{t}'" for t in sorted(set(terms)))
    rows = memories.select("id", F.expr(TOKENS.format(t=TEXT)).alias("w")).select("id", F.size("w").alias("len"), F.expr(f"filter(w, x -> x IN ({wanted}))").alias("hit"))
    corpus = rows.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("mean"))
    tf = rows.where("size(hit) > 0").select("id", "len", F.explode("hit").alias("term")).groupBy("id", "len", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    joined = tf.join(F.broadcast(df), "term").crossJoin(F.broadcast(corpus))  # a row per asked term, and one row
    part = f"ln(1 + (n - df + 0.5D) / (df + 0.5D)) * tf * {K1 + 1}D / (tf + {K1}D * (1 - {SIZE}D + {SIZE}D * len / mean))"
    return joined.groupBy("id").agg(F.sum(F.expr(part)).alias("bm25"))


def _bm25_sql(terms: list[str]) -> str:
    wanted = ", ".join(f"'{t}'" for t in sorted(set(terms)))
    return f"""words AS (SELECT id, {TOKENS_SQL.format(t=TEXT_SQL)} AS w FROM mem),
sized AS (SELECT id, len(w) AS len, unnest(list_filter(w, lambda x: x IN ({wanted}))) AS term FROM words),
corpus AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM words),
tf AS (SELECT id, len, term, count(*) AS tf FROM sized GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY ALL),
bm25 AS (SELECT id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * {K1 + 1}::DOUBLE / (tf + {K1}::DOUBLE * (1 - {SIZE}::DOUBLE + {SIZE}::DOUBLE * len / mean))) AS bm25
  FROM tf JOIN df USING (term), corpus GROUP BY id)"""


QUERY_TERMS = ["planner", "prefers", "backup", "realm", "orphan"]


@C.add(f"WITH {T.MEM}, {_bm25_sql(QUERY_TERMS)} SELECT id, round(bm25, 6) AS bm25 FROM bm25 ORDER BY round(bm25, 6) DESC, id LIMIT 50")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bm25(T.memories(spark, sf_dir), QUERY_TERMS)
    return found.select("id", F.round("bm25", 6).alias("bm25")).orderBy(F.desc("bm25"), "id").limit(50)


# ---------------------------------------------------------------- vectors

#: The stand-in for an embedded query: the vector of the smallest id that has one.
_QUERY = "q AS (SELECT v AS qv FROM vec WHERE id = (SELECT min(id) FROM vec))"


def query_vector(vectors: DataFrame) -> DataFrame:
    return vectors.orderBy("id").limit(1).select(F.col("v").alias("qv"))


def similar(vectors: DataFrame, query: DataFrame) -> DataFrame:
    """(id, cosine) of every vector to the one row of query; that one vector travels, a batch is one product."""
    row = query.first()
    q = np.asarray(row["qv"], np.float64) if row else np.zeros(64)

    def score(batch: pa.RecordBatch) -> pa.RecordBatch:
        v = batch.column("v")
        x = np.asarray(v.flatten(), np.float64).reshape(len(v), -1)
        # summed component by component, so that the last bits do not depend on the size of a batch
        c = (x * q).cumsum(axis=1)[:, -1] if x.shape[1] else np.zeros(len(v))
        return pa.RecordBatch.from_arrays([batch.column("id"), pa.array(np.clip(c, -1.0, 1.0))], names=["id", "cosine"])

    return arrow_map(vectors.select("id", "v"), score, "id string, cosine double")


@C.add(f"WITH {T.VEC}, {_QUERY} SELECT id, round(array_cosine_similarity(v, qv), 5) AS cosine FROM vec, q ORDER BY cosine DESC, id LIMIT 25")
def knn_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = T.vectors(spark, sf_dir)
    found = similar(v, query_vector(v)).select("id", F.round("cosine", 5).alias("cosine"))
    return found.orderBy(F.desc("cosine"), "id").limit(25)


@C.add(
    f"""WITH {T.VEC}, {_QUERY}, {T.MEM}
SELECT m.id, m.realm_name, round(array_cosine_similarity(v, qv), 5) AS cosine FROM vec JOIN mem m USING (id), q
WHERE m.visibility = 'public' AND list_contains(m.tags, 'lang:en') AND m.memory_type IN ('fact', 'decision', 'preference')
ORDER BY cosine DESC, id LIMIT 25"""
)
def search_tag_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filters come before the ranking, so the limit is always filled."""
    keep = T.memories(spark, sf_dir).where("visibility = 'public' AND array_contains(tags, 'lang:en') AND memory_type IN ('fact', 'decision', 'preference')").select("id", "realm_name")
    v = T.vectors(spark, sf_dir)
    found = similar(v.join(keep, "id"), query_vector(v)).join(keep, "id").select("id", "realm_name", F.round("cosine", 5).alias("cosine"))
    return found.orderBy(F.desc("cosine"), "id").limit(25)


HYBRID_WEIGHT, CANDIDATES, LEAST = 0.15, 50, 0.3


def hybrid_search(memories: DataFrame, vectors: DataFrame, terms: list[str], intent: str = "preference", limit: int = 20) -> DataFrame:
    """(id, score): dense and keyword candidates blended, then weighted by trust, intent, importance, recency, votes.

    The CANDIDATES nearest by cosine from LEAST on, and the CANDIDATES best by keywords, which need LEAST after their
    bonus. Erased and dream memories are left out by search.search, which also takes filters. Ties go to the smaller id.
    """
    wv, wi, wr = P.INTENTS[intent]
    cos = similar(vectors, query_vector(vectors))
    dense = cos.orderBy(F.desc(F.round("cosine", 6)), "id").limit(CANDIDATES).where(F.col("cosine") >= LEAST).select("id", "cosine")
    words = bm25(memories, terms).orderBy(F.desc(F.round("bm25", 6)), "id").limit(CANDIDATES)
    # a window over the fifty candidates, so that the scores are computed once
    words = words.withColumn("bonus", HYBRID_WEIGHT * F.col("bm25") / F.max("bm25").over(Window.partitionBy())).select("id", "bonus")
    lexical = cos.join(F.broadcast(words), "id").select("id", F.col("cosine").alias("lexical"), "bonus")
    blended = dense.join(lexical, "id", "full").withColumn("s", F.coalesce("cosine", "lexical") + F.coalesce("bonus", F.lit(0.0)))
    blended = blended.where(F.col("cosine").isNotNull() | (F.col("s") >= LEAST)).select("id", "s")
    rows = blended.join(memories, "id")
    score = f"s * ({P.TRUST}) * {wv}D * (1 + (importance - 0.5D) * ({wi}D - 1)) * (1 + (({recency(HOURS)}) - 0.5D) * ({wr}D - 1)) * (1 + upvotes * 0.18D)"
    return rows.select("id", F.expr(f"round({score}, 5)").alias("score")).orderBy(F.desc("score"), "id").limit(limit)


_W = P.INTENTS["preference"]


@C.add(
    f"""WITH {T.VEC}, {_QUERY}, {T.MEM}, {_bm25_sql(QUERY_TERMS)},
cos AS (SELECT id, array_cosine_similarity(v, qv) AS cosine FROM vec, q),
dense AS (SELECT * FROM (SELECT id, cosine FROM cos ORDER BY round(cosine, 6) DESC, id LIMIT {CANDIDATES}) WHERE cosine >= {LEAST}),
words50 AS (SELECT id, bm25 FROM bm25 ORDER BY round(bm25, 6) DESC, id LIMIT {CANDIDATES}),
bonus AS (SELECT id, {HYBRID_WEIGHT} * bm25 / (SELECT max(bm25) FROM words50) AS bonus FROM words50),
blended AS (SELECT d.id, d.cosine + coalesce(b.bonus, 0) AS s FROM dense d LEFT JOIN bonus b USING (id)
  UNION ALL SELECT b.id, c.cosine + b.bonus FROM bonus b JOIN cos c USING (id) WHERE b.id NOT IN (SELECT id FROM dense) AND c.cosine + b.bonus >= {LEAST})
SELECT id, round(s * ({P.TRUST}) * {_W[0]}::DOUBLE * (1 + (importance - 0.5) * ({_W[1]}::DOUBLE - 1)) * (1 + (({recency(HOURS_SQL)}) - 0.5) * ({_W[2]}::DOUBLE - 1)) * (1 + upvotes * CAST(0.18 AS DOUBLE)), 5) AS score
FROM blended JOIN mem USING (id) ORDER BY score DESC, id LIMIT 20"""
)
def search_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hybrid_search(T.memories(spark, sf_dir), T.vectors(spark, sf_dir), QUERY_TERMS)


@C.add(
    f"""WITH {T.VEC}, {_QUERY}, cos AS (SELECT array_cosine_similarity(v, qv) AS c FROM vec, q ORDER BY round(array_cosine_similarity(v, qv), 6) DESC LIMIT 100),
agg AS (SELECT max(c) AS best, count(*) FILTER (WHERE c >= 0.5) AS above FROM cos)
SELECT CASE WHEN best >= 0.55 THEN 'high' WHEN best >= 0.40 THEN 'partial' ELSE 'none' END AS level, round(best, 5) AS best_score, above AS results_above_min FROM agg"""
)
def search_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well the store covers a query: the best of the 100 nearest scores, and how many reach 0.5."""
    v = T.vectors(spark, sf_dir)
    top = similar(v, query_vector(v)).orderBy(F.desc(F.round("cosine", 6))).limit(100)
    agg = top.agg(F.max("cosine").alias("best"), F.count_if(F.col("cosine") >= 0.5).alias("results_above_min"))
    return agg.selectExpr("CASE WHEN best >= 0.55 THEN 'high' WHEN best >= 0.40 THEN 'partial' ELSE 'none' END AS level", "round(best, 5) AS best_score", "results_above_min")


def centroids(memories: DataFrame, vectors: DataFrame) -> DataFrame:
    """(realm_name, members, cv): the unit mean vector of each named realm; one pass, 64 partial sums per realm."""
    rows = vectors.join(memories.where("realm_name <> ''").select("id", "realm_name"), "id")
    means = rows.groupBy("realm_name").agg(F.count(F.lit(1)).alias("members"), *(F.avg(F.col("v")[i]).alias(f"_{i}") for i in range(64)))
    return T.unit(means.select("realm_name", "members", F.array(*(f"_{i}" for i in range(64))).alias("mean")), "mean", "cv").select("realm_name", "members", "cv")


_MEANS = "pos AS (SELECT realm_name, i, avg(v[i]) AS x FROM vec JOIN mem USING (id), range(1, 65) r(i) WHERE realm_name <> '' GROUP BY ALL), cen AS (SELECT realm_name, list(x ORDER BY i)::DOUBLE[64] AS cv FROM pos GROUP BY ALL)"


@C.add(f"WITH {T.VEC}, {T.MEM}, {_MEANS} SELECT realm_name, (SELECT count(*) FROM vec JOIN mem USING (id) WHERE mem.realm_name = cen.realm_name) AS members, array_to_string(list_transform(cv::DOUBLE[], lambda x: CAST(CAST(round(x * 1000 / sqrt(list_sum(list_transform(cv::DOUBLE[], lambda y: y * y)))) AS BIGINT) AS VARCHAR)), ',') AS permille FROM cen")
def realm_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = centroids(T.memories(spark, sf_dir), T.vectors(spark, sf_dir))
    return found.select("realm_name", "members", F.expr("array_join(transform(cv, x -> CAST(CAST(round(x * 1000) AS BIGINT) AS STRING)), ',')").alias("permille"))


@C.add(f"WITH {T.VEC}, {_QUERY}, {T.MEM}, {_MEANS} SELECT realm_name, round(array_cosine_similarity(cv, qv), 5) AS cosine FROM cen, q WHERE realm_name IN (SELECT realm_name FROM mem WHERE visibility = 'public') ORDER BY cosine DESC, realm_name LIMIT 3")
def suggest_realms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three realms nearest to a query that have live public members."""
    mem, v = T.memories(spark, sf_dir), T.vectors(spark, sf_dir)
    live = mem.where("visibility = 'public'").select("realm_name").distinct()
    found = centroids(mem, v).join(live, "realm_name", "left_semi").crossJoin(F.broadcast(query_vector(v)))
    return found.select("realm_name", F.expr(f"round({T.dot('cv', 'qv')}, 5)").alias("cosine")).orderBy(F.desc("cosine"), "realm_name").limit(3)


@C.add(
    f"""WITH {T.VEC}, {T.MEM}, {_MEANS}, near AS (SELECT id, cen.realm_name, array_cosine_similarity(v, cv) AS c,
  row_number() OVER (PARTITION BY id ORDER BY round(array_cosine_similarity(v, cv), 6) DESC, cen.realm_name) AS r FROM vec, cen)
SELECT near.realm_name AS nearest, count(*) AS memories, count(*) FILTER (WHERE near.realm_name <> mem.realm_name) AS moved FROM near JOIN mem USING (id) WHERE r = 1 AND c >= 0.2 GROUP BY ALL"""
)
def realm_redistribute(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each memory goes to the realm of the nearest centroid (at 0.2 or more).

    Centroids, written once, travel with the function in blocks of REALMS; a batch is one matrix product, and of the
    blocks each memory keeps its best realm.
    """
    mem, v = T.memories(spark, sf_dir), T.vectors(spark, sf_dir)
    cen = materialize(centroids(mem, v).withColumn("block", F.floor((F.row_number().over(Window.orderBy("realm_name")) - 1) / REALMS)))  # a row per realm
    best = None
    for block in range(1 + (cen.agg(F.max("block")).first()[0] or 0)):
        rows = arrow_map(v, _nearest(cen.where(F.col("block") == block).orderBy("realm_name").select("realm_name", "cv").collect()), "id string, nearest string, s double")
        best = rows if best is None else best.unionByName(rows)
    if cen.where("block > 0").limit(1).count():
        best = best.groupBy("id").agg(F.min(F.struct((-F.col("s")).alias("d"), "nearest")).alias("m")).select("id", F.col("m.nearest").alias("nearest"))
    joined = best.select("id", "nearest").join(mem.select("id", "realm_name"), "id")
    return joined.groupBy("nearest").agg(F.count(F.lit(1)).alias("memories"), F.count_if(F.col("nearest") != F.col("realm_name")).alias("moved"))


def _nearest(cen: list):
    """A function of a batch of vectors: the realm of the nearest of these centroids, where it reaches 0.2."""
    names, c = np.array([r["realm_name"] for r in cen]), np.array([r["cv"] for r in cen]).reshape(len(cen), -1)

    def nearest(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        if not len(names):
            return None
        x = np.asarray(batch.column("v").flatten()).reshape(batch.num_rows, -1)
        s = np.round(x @ c.T, 6)
        best = s.argmax(axis=1)  # names are in order, so ties go to the smaller one
        top = s.max(axis=1)
        return pa.RecordBatch.from_arrays([batch.column("id"), pa.array(names[best]), pa.array(top)], names=["id", "nearest", "s"]).filter(pa.array(top >= 0.2))

    return nearest


@C.add(f"WITH {T.VEC}, {T.MEM}, {_MEANS} SELECT a.realm_name AS realm_a, b.realm_name AS realm_b, round(array_cosine_similarity(a.cv, b.cv), 5) AS cosine FROM cen a JOIN cen b ON a.realm_name < b.realm_name AND round(array_cosine_similarity(a.cv, b.cv), 5) > 0.3")
def realm_merge_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    cen = centroids(T.memories(spark, sf_dir), T.vectors(spark, sf_dir))
    a, b = cen.select(F.col("realm_name").alias("realm_a"), F.col("cv").alias("va")), cen.select(F.col("realm_name").alias("realm_b"), F.col("cv").alias("vb"))
    return a.join(b, F.col("realm_a") < F.col("realm_b")).select("realm_a", "realm_b", F.expr(f"round({T.dot('va', 'vb')}, 5)").alias("cosine")).where("cosine > 0.3")


# ---------------------------------------------------------------- associations on the embeddings table

_EMB = "emb AS (SELECT vec_id, label, embedding::DOUBLE[]::DOUBLE[64] AS v FROM embeddings)"


def _embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.unit(table(spark, sf_dir, "embeddings"), "embedding", "v").select("vec_id", "label", "v")


@C.add(
    f"""WITH {_EMB}, s AS (SELECT a.vec_id AS query_id, b.vec_id AS neighbour_id, round(array_cosine_similarity(a.v, b.v), 5) AS cosine FROM emb a JOIN emb b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, neighbour_id) AS rank FROM s)
SELECT query_id, rank, neighbour_id, cosine FROM r WHERE rank <= 5"""
)
def knn_associations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest of every vector whose id is divisible by 50, against all; a row keeps its best five by window."""
    rows = B.numbered(_embeddings(spark, sf_dir).select("vec_id", "v"))
    asks = rows.select(F.lit(0).alias("g"), "n", "q", (F.col("vec_id") % 50 == 0).alias("asks"), F.lit(True).alias("home"))
    # one more than asked for, so that ties of the rounded cosine are settled by id
    found = B.compared(asks, ["g"], B.best(B.unpacked, 5 + SPARE, None), "a long, b long, c double", 2 * B.BLOCK)
    ids = rows.select("n", "vec_id")
    pairs = found.join(ids.toDF("a", "query_id"), "a").join(ids.toDF("b", "neighbour_id"), "b").select("query_id", "neighbour_id", F.round("c", 5).alias("cosine"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("cosine"), "neighbour_id"))
    return pairs.withColumn("rank", rank).where("rank <= 5").select("query_id", "rank", "neighbour_id", "cosine")


def best_bridges(rows: DataFrame, cen: DataFrame) -> DataFrame:
    """(a, b, s): the largest cosine that a row of label a has with the centroid of b, for a <> b.

    The centroids travel with the function, in blocks of REALMS; a batch gives one row per pair of labels.
    """
    cen = materialize(cen.withColumn("block", F.floor((F.row_number().over(Window.orderBy("b")) - 1) / REALMS)))  # a row per label
    out = None
    for block in range(1 + (cen.agg(F.max("block")).first()[0] or 0)):
        part = arrow_map(rows, _bridges(cen.where(F.col("block") == block).orderBy("b").collect()), "a long, b long, s double")
        out = part if out is None else out.unionByName(part)
    return out.groupBy("a", "b").agg(F.round(F.max("s"), 5).alias("s"))


def _bridges(cen: list):
    names, c = np.array([r["b"] for r in cen], np.int64), np.array([r["cv"] for r in cen]).reshape(len(cen), -1)

    def bridge(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        if not len(names):
            return None
        x = np.asarray(batch.column("v").flatten()).reshape(batch.num_rows, -1)
        label = np.asarray(batch.column("label"), np.int64)
        order = np.argsort(label, kind="stable")
        own, at = np.unique(label[order], return_index=True)
        s = np.maximum.reduceat((x @ c.T)[order], at, axis=0)
        a, b = np.repeat(own, len(names)), np.tile(names, len(own))
        keep = a != b
        return pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep]), pa.array(s.ravel()[keep])], names=["a", "b", "s"])

    return bridge


@C.add(
    f"""WITH {_EMB}, pos AS (SELECT label, i, avg(v[i]) AS x FROM emb, range(1, 65) r(i) GROUP BY ALL), cen AS (SELECT label, list(x ORDER BY i)::DOUBLE[64] AS cv FROM pos GROUP BY ALL),
best AS (SELECT emb.label AS a, cen.label AS b, max(array_cosine_similarity(v, cv)) AS s FROM emb JOIN cen ON emb.label <> cen.label GROUP BY ALL)
SELECT x.a AS cluster_a, x.b AS cluster_b, round(x.s, 5) AS a_to_b, round(y.s, 5) AS b_to_a FROM best x JOIN best y ON x.a = y.b AND x.b = y.a WHERE x.a < x.b AND round(x.s, 5) < 0.4 AND round(y.s, 5) < 0.4"""
)
def cluster_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of clusters that no memory bridges: the best similarity to the other's centroid is under 0.4 both ways."""
    v = _embeddings(spark, sf_dir)
    means = v.groupBy("label").agg(*(F.avg(F.col("v")[i]).alias(f"_{i}") for i in range(64)))
    cen = T.unit(means.select("label", F.array(*(f"_{i}" for i in range(64))).alias("m")), "m", "cv").select(F.col("label").alias("b"), "cv")
    best = best_bridges(v.select("label", "v"), cen)
    back = best.select(F.col("a").alias("b"), F.col("b").alias("a"), F.col("s").alias("t"))
    return best.join(back, ["a", "b"]).where("a < b AND s < 0.4 AND t < 0.4").selectExpr("a AS cluster_a", "b AS cluster_b", "s AS a_to_b", "t AS b_to_a")


# ---------------------------------------------------------------- lists, lookups, previews

SNIPPET = "substring(CASE WHEN trim(coalesce(summary, '')) <> '' THEN summary ELSE content END, 1, 160)"


@C.add(f"WITH {T.MEM} SELECT id, realm_name, memory_type, importance, heading, ingested_at, {SNIPPET} AS snippet FROM mem WHERE verification_status = 'certified'")
def search_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.memories(spark, sf_dir).where("verification_status = 'certified'").selectExpr("id", "realm_name", "memory_type", "importance", "heading", "ingested_at", f"{SNIPPET} AS snippet")


@C.add(f"WITH {T.MEM} SELECT id, substring(content, 1, 280) AS preview, ingested_at FROM mem WHERE visibility = 'public' ORDER BY ingested_at DESC NULLS LAST, id LIMIT 50")
def public_previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.memories(spark, sf_dir).where("visibility = 'public'").selectExpr("id", "substring(content, 1, 280) AS preview", "ingested_at").orderBy(F.desc_nulls_last("ingested_at"), "id").limit(50)


@C.add(f"WITH {T.MEM} SELECT id, importance, access_count FROM mem WHERE realm_name = 'inbox' ORDER BY importance DESC, id LIMIT 50 OFFSET 50")
def list_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.memories(spark, sf_dir).where("realm_name = 'inbox'").select("id", "importance", "access_count").orderBy(F.desc("importance"), "id").offset(50).limit(50)


_ASKED = "SELECT memory_id AS id, row_number() OVER (ORDER BY memory_id NULLS FIRST, source_id, arrived_at) - 1 AS pos FROM (SELECT DISTINCT memory_id, source_id, arrived_at FROM source_records ORDER BY memory_id NULLS FIRST, source_id, arrived_at LIMIT 200)"


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two hundred asked ids, repeats and unknown ones among them, numbered."""
    rows = table(spark, sf_dir, "source_records").select("memory_id", "source_id", "arrived_at").distinct()
    order = [F.col("memory_id").asc_nulls_first(), F.col("source_id"), F.col("arrived_at")]
    return rows.orderBy(*order).limit(200).withColumn("pos", F.row_number().over(Window.orderBy(*order)) - 1).select(F.col("memory_id").alias("id"), "pos")


@C.add(f"WITH {T.MEM}, asked AS ({_ASKED}) SELECT pos, asked.id, memory_type, realm_name FROM asked JOIN mem ON asked.id = mem.id")
def batch_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = _asked(spark, sf_dir)
    return T.memories(spark, sf_dir).join(F.broadcast(asked), "id").select("pos", "id", "memory_type", "realm_name")


@C.add(f"WITH {T.MEM}, asked AS ({_ASKED}) SELECT pos, id FROM asked WHERE id IS NULL OR id NOT IN (SELECT id FROM mem)")
def batch_get_not_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _asked(spark, sf_dir).join(T.memories(spark, sf_dir).select("id"), "id", "left_anti").select("pos", "id")


_ANCHOR = "anchor AS (SELECT ingested_at AS t, id AS aid FROM mem WHERE ingested_at IS NOT NULL ORDER BY md5(id) LIMIT 1)"


def neighbours_in_time(memories: DataFrame, anchor: DataFrame, before, k: int = 5) -> DataFrame:
    """(side, n, id, ingested_at): the k memories before and after one anchor row (t, aid).

    Each side is an ordered limit, so no task ever holds the whole timeline; ids order equal times.
    """
    rows = memories.where("ingested_at IS NOT NULL").select("id", "ingested_at").crossJoin(F.broadcast(anchor))
    early = rows.where(before).orderBy(F.desc("ingested_at"), F.desc("id")).limit(k).withColumn("n", F.row_number().over(Window.orderBy(F.desc("ingested_at"), F.desc("id")))).withColumn("side", F.lit("before"))
    late = rows.where(~before & (F.col("id") != F.coalesce("aid", F.lit("")))).orderBy("ingested_at", "id").limit(k).withColumn("n", F.row_number().over(Window.orderBy("ingested_at", "id"))).withColumn("side", F.lit("after"))
    return early.unionByName(late).select("side", "n", "id", "ingested_at")


def _timeline_sql(anchor: str, before: str) -> str:
    return f"""WITH {T.MEM}, {anchor}, rows AS (SELECT id, ingested_at, {before} AS before, aid FROM mem, anchor WHERE ingested_at IS NOT NULL)
SELECT 'before' AS side, n, id, ingested_at FROM (SELECT *, row_number() OVER (ORDER BY ingested_at DESC, id DESC) AS n FROM rows WHERE before) WHERE n <= 5
UNION ALL SELECT 'after', n, id, ingested_at FROM (SELECT *, row_number() OVER (ORDER BY ingested_at, id) AS n FROM rows WHERE NOT before AND id <> coalesce(aid, '')) WHERE n <= 5"""


@C.add(_timeline_sql(_ANCHOR, "ingested_at < t OR (ingested_at = t AND id < aid)"))
def timeline_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    mem = T.memories(spark, sf_dir)
    anchor = mem.where("ingested_at IS NOT NULL").select("ingested_at", "id").orderBy(F.md5("id")).limit(1).select(F.col("ingested_at").alias("t"), F.col("id").alias("aid"))
    return neighbours_in_time(mem, anchor, (F.col("ingested_at") < F.col("t")) | ((F.col("ingested_at") == F.col("t")) & (F.col("id") < F.col("aid"))))


@C.add(_timeline_sql("anchor AS (SELECT TIMESTAMP '2025-02-10 12:00:00' AS t, NULL::VARCHAR AS aid)", "ingested_at < t"))
def timeline_by_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    anchor = spark.sql("SELECT TIMESTAMP_NTZ '2025-02-10 12:00:00' AS t, CAST(NULL AS STRING) AS aid")
    return neighbours_in_time(T.memories(spark, sf_dir), anchor, F.col("ingested_at") < F.col("t"))


@C.add(f"WITH {T.MEM}, top AS (SELECT id, related_memory_ids, round({SCORE.format(recency=recency(HOURS_SQL))}, 6) AS score FROM mem ORDER BY score DESC, id LIMIT 20) SELECT DISTINCT r.id, round(least(1.0, m.importance + 0.005), 6) AS importance, m.access_count + 1 AS access_count FROM (SELECT unnest(related_memory_ids) AS id FROM top) r JOIN mem m ON m.id = r.id")
def spreading_activation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memories related to the recalled ones get a small bump, once each."""
    mem = T.memories(spark, sf_dir)
    top = mem.select("id", "related_memory_ids", F.expr(f"round({SCORE.format(recency=recency(HOURS))}, 6)").alias("score")).orderBy(F.desc("score"), "id").limit(20)
    ids = top.select(F.explode("related_memory_ids").alias("id")).distinct()
    return mem.join(F.broadcast(ids), "id").selectExpr("id", "round(least(1D, importance + 0.005D), 6) AS importance", "access_count + 1 AS access_count")


# ---------------------------------------------------------------- persons and files

@C.add(f"WITH {T.MEM} SELECT id, round(importance, 6) AS importance FROM mem WHERE list_contains(regexp_split_to_array(lower(content), '[^\\p{{L}}\\p{{N}}]+'), 'selma')")
def person_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memories that name every term of a question about a person as a whole word."""
    return T.memories(spark, sf_dir).where("array_contains(split(lower(content), '[^\\\\p{L}\\\\p{N}]+'), 'selma')").selectExpr("id", "round(importance, 6) AS importance")


@C.add("SELECT doc_id, strpos(lower(text), 'planner') AS at, substring(text, greatest(1, CAST(strpos(lower(text), 'planner') AS INT) - 40), 120) AS preview FROM documents WHERE contains(lower(text), 'planner') AND contains(lower(text), 'threshold')")
def vault_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").where("contains(lower(text), 'planner') AND contains(lower(text), 'threshold')")
    return rows.selectExpr("doc_id", "CAST(locate('planner', lower(text)) AS BIGINT) AS at", "substring(text, greatest(1, locate('planner', lower(text)) - 40), 120) AS preview")


QUERIES, SQL = C.queries, C.sql
