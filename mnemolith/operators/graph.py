"""The knowledge graph: entities, edges, traversal, statistics, and retrieval metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mnemolith import blocks as B
from mnemolith import tables as T
from mnemolith.operators.retrieval import K1, SIZE, TOKENS, TOKENS_SQL
from mnemolith.session import materialize, table

C = T.Catalogue()

# fixed values: the patterns of entities, without look-around, so that every engine reads them alike
RULES = (
    ("code", "`([^`]+)`"),
    ("url", "(https?://[^ \\t\\n<>{{}}\"',;)]+)".replace("{{", "{").replace("}}", "}")),
    ("path", "(?:^|[ \\t\\n])([/~][A-Za-z0-9_./-]{3,})"),
    ("setting", "(?:^|[ \\t\\n])((?:port|host|provider|model|version|path|url|name|type):[ \\t]*[^ \\t\\n,;]+)"),
    ("acronym", "(?:^|[^A-Za-z0-9_À-ÿ])([A-Z]{2,5})(?:$|[^A-Za-z0-9_À-ÿ])"),
    ("sequence", "(?:^|[^A-Za-z0-9_À-ÿ])([A-Z][a-z]+(?: [A-Z][a-z]+)+)(?:$|[^A-Za-z0-9_À-ÿ])"),
)
#: Entities that so many memories share give their pairs; more common ones give one hub row per memory.
PAIRED = 20


def entities(memories: DataFrame) -> DataFrame:
    """(id, entity, kind): the distinct entities of each memory, by the first rule that finds them."""

    def tagged(n: int, kind: str, pattern: str):
        return F.transform(F.regexp_extract_all("content", F.lit(pattern), F.lit(1)), lambda e: F.struct(e.alias("entity"), F.lit(n).alias("rule"), F.lit(kind).alias("kind")))

    found = [tagged(n, k, p) for n, (k, p) in enumerate(RULES)]
    rows = memories.select("id", F.explode(F.flatten(F.array(*found))).alias("e")).where("trim(e.entity) <> ''")
    return rows.groupBy("id", F.col("e.entity").alias("entity")).agg(F.min(F.struct("e.rule", "e.kind")).alias("m")).select("id", "entity", F.col("m.kind").alias("kind"))


def _sql_text(p: str) -> str:
    return p.replace("'", "''")


_ENT = "ent AS (SELECT id, entity, arg_min(kind, rule) AS kind FROM (" + " UNION ALL ".join(f"SELECT id, unnest(regexp_extract_all(content, '{_sql_text(p)}', 1)) AS entity, '{k}' AS kind, {n} AS rule FROM mem" for n, (k, p) in enumerate(RULES)) + ") WHERE trim(entity) <> '' GROUP BY id, entity)"
_ENT = _ENT.replace("\\t", "\t").replace("\\n", "\n")


@C.add(f"WITH {T.MEM}, {_ENT} SELECT entity, kind, count(*) AS memories FROM ent GROUP BY ALL")
def graph_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities(T.memories(spark, sf_dir)).groupBy("entity", "kind").agg(F.count(F.lit(1)).alias("memories"))


@C.add(
    f"""WITH {T.MEM}, {_ENT}, df AS (SELECT entity, count(*) AS df FROM ent GROUP BY ALL HAVING count(*) > 1),
p AS (SELECT a.id AS from_id, b.id AS to_id, max(least(1.0, 2.0 / df)) AS weight FROM ent a JOIN ent b ON a.entity = b.entity AND a.id < b.id JOIN df ON df.entity = a.entity WHERE df <= {PAIRED} GROUP BY ALL)
SELECT 'pair' AS form, from_id, to_id, round(weight, 6) AS weight FROM p
UNION ALL SELECT 'hub', id, ent.entity, round(least(1.0, 2.0 / df), 6) FROM ent JOIN df USING (entity) WHERE df > {PAIRED}"""
)
def graph_cooccurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(form, from_id, to_id, weight): memories that share an entity.

    The pairs of rare entities are spelt out; a common one is a hub, linked to each of its memories, so a hot entity
    costs one row per memory and no link is lost.
    """
    ent = materialize(entities(T.memories(spark, sf_dir)).select("id", "entity"))
    df = ent.groupBy("entity").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    sized = materialize(ent.join(df, "entity").withColumn("weight", F.expr("least(1D, 2D / df)")))
    rare = sized.where(F.col("df") <= PAIRED)
    a, b = rare.select("entity", F.col("id").alias("from_id"), "weight"), rare.select("entity", F.col("id").alias("to_id"))
    pairs = a.join(b, "entity").where("from_id < to_id").groupBy("from_id", "to_id").agg(F.round(F.max("weight"), 6).alias("weight"))
    hubs = sized.where(F.col("df") > PAIRED).select(F.lit("hub").alias("form"), F.col("id").alias("from_id"), F.col("entity").alias("to_id"), F.round("weight", 6).alias("weight"))
    return pairs.select(F.lit("pair").alias("form"), "from_id", "to_id", "weight").unionByName(hubs)


def edges(relationships: DataFrame) -> DataFrame:
    """(a, b, weight, kind): undirected edges, a < b, the largest weight of each pair and kind."""
    rows = relationships.selectExpr("from_id", "lower(trim(to_id)) AS to_id", "coalesce(weight, 0D) AS weight", "lower(trim(coalesce(relation_type, ''))) AS kind").where("from_id IS NOT NULL AND to_id <> '' AND from_id <> to_id")
    return rows.groupBy(F.least("from_id", "to_id").alias("a"), F.greatest("from_id", "to_id").alias("b"), "kind").agg(F.max("weight").alias("weight"))


_EDGES = "e AS (SELECT least(from_id, to_id) AS a, greatest(from_id, to_id) AS b, kind, max(weight) AS weight FROM (SELECT from_id, lower(trim(to_id)) AS to_id, coalesce(weight, 0) AS weight, lower(trim(coalesce(relation_type, ''))) AS kind FROM relationships) WHERE from_id IS NOT NULL AND to_id <> '' AND from_id <> to_id GROUP BY ALL)"


@C.add(f"WITH {_EDGES} SELECT kind, count(*) AS edges, round(avg(weight), 5) AS mean_weight FROM e GROUP BY ALL UNION ALL SELECT 'nodes', (SELECT count(DISTINCT n) FROM (SELECT a AS n FROM e UNION ALL SELECT b FROM e)), NULL")
def graph_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(table(spark, sf_dir, "relationships"))
    kinds = e.groupBy("kind").agg(F.count(F.lit(1)).alias("edges"), F.round(F.avg("weight"), 5).alias("mean_weight"))
    nodes = e.select(F.explode(F.array("a", "b")).alias("n")).agg(F.countDistinct("n").alias("edges")).select(F.lit("nodes").alias("kind"), "edges", F.lit(None).cast("double").alias("mean_weight"))
    return kinds.unionByName(nodes)


_START = "start AS (SELECT n AS id FROM (SELECT a AS n FROM e UNION ALL SELECT b FROM e) GROUP BY n ORDER BY count(*) DESC, n LIMIT 1)"


def _start(e: DataFrame) -> DataFrame:
    """The node of most edges."""
    return e.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "id").limit(1).select("id")


def traverse(e: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """(id, depth): breadth-first search; each level joins its frontier with the edges and leaves out what was seen."""
    both = materialize(e.select("a", "b").union(e.select("b", "a")).distinct())
    seen = frontier = materialize(start.select("id", F.lit(0).alias("depth")))
    for d in range(1, depth + 1):
        step = both.join(frontier.select(F.col("id").alias("a")), "a").select(F.col("b").alias("id")).distinct()
        frontier = materialize(step.join(seen.select("id"), "id", "left_anti").withColumn("depth", F.lit(d)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


@C.add(f"WITH RECURSIVE {_EDGES}, {_START}, ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e), bfs AS (SELECT id, 0 AS depth FROM start UNION SELECT ways.b, depth + 1 FROM bfs JOIN ways ON ways.a = bfs.id WHERE depth < 3) SELECT id, min(depth) AS depth FROM bfs GROUP BY id")
def graph_bfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(table(spark, sf_dir, "relationships"))
    return traverse(e, _start(e), 3)


@C.add(f"WITH {_EDGES}, {_START} SELECT CASE WHEN a = id THEN b ELSE a END AS neighbour_id, count(*) AS edges, round(avg(weight), 5) AS mean_weight FROM e JOIN start ON a = id OR b = id GROUP BY ALL")
def graph_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(table(spark, sf_dir, "relationships"))
    s = F.broadcast(_start(e))
    sides = e.join(s, e.a == s.id).select(F.col("b").alias("neighbour_id"), "weight").unionByName(e.join(s, e.b == s.id).select(F.col("a").alias("neighbour_id"), "weight"))
    return sides.groupBy("neighbour_id").agg(F.count(F.lit(1)).alias("edges"), F.round(F.avg("weight"), 5).alias("mean_weight"))


@C.add(f"WITH {T.VEC}, {_EDGES}, s AS (SELECT a, b, array_cosine_similarity(x.v, y.v) AS c FROM (SELECT DISTINCT a, b FROM e) e JOIN vec x ON x.id = a JOIN vec y ON y.id = b) SELECT a AS from_id, b AS to_id, round(c, 4) AS weight FROM s WHERE round(c, 4) >= 0.6")
def graph_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, v = edges(table(spark, sf_dir, "relationships")).select("a", "b").distinct(), T.vectors(spark, sf_dir)
    both = e.join(v.toDF("a", "va"), "a").join(v.toDF("b", "vb"), "b")
    return both.select(F.col("a").alias("from_id"), F.col("b").alias("to_id"), F.expr(f"round({T.dot('va', 'vb')}, 4)").alias("weight")).where("weight >= 0.6")


@C.add()
def graph_similar_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(from_id, to_id, weight): every memory and its five nearest of the whole store, exactly, from a cosine of 0.6 on.

    graph_similar only weighs the links that relationships already holds.
    """
    live = T.memories(spark, sf_dir).select("id").join(T.vectors(spark, sf_dir), "id")
    rows = B.numbered(live, kind="<f4")
    every = rows.select(F.lit(0).alias("g"), "n", "q", F.lit(True).alias("asks"), F.lit(True).alias("home"))
    found = B.compared(every, ["g"], B.best(lambda q: B.unpacked(q, "<f4"), 5, 0.5999), "a long, b long, c float", 2 * B.BLOCK)
    near = B.top(found, 5).withColumn("weight", F.round(F.col("c").cast("double"), 4)).where("weight >= 0.6")
    pairs = near.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("weight").alias("weight"))
    named = pairs.join(rows.select(F.col("n").alias("a"), F.col("id").alias("ia")), "a").join(rows.select(F.col("n").alias("b"), F.col("id").alias("ib")), "b")
    return named.select(F.least("ia", "ib").alias("from_id"), F.greatest("ia", "ib").alias("to_id"), "weight")


@C.add(
    f"""WITH {T.MEM}, {T.VEC}, member AS (SELECT topic_clusters.id AS cluster_id, label, unnest(memory_ids) AS mid FROM topic_clusters),
live AS (SELECT cluster_id, label, mid, v FROM member JOIN vec ON vec.id = mid WHERE mid IN (SELECT id FROM mem)),
c AS (SELECT cluster_id, coalesce(label, '') AS label, count(DISTINCT mid) AS members FROM live GROUP BY ALL)
SELECT cluster_id, label, members, (SELECT count(*) FROM (SELECT DISTINCT cluster_id, mid FROM member) m WHERE m.cluster_id = c.cluster_id) - members AS gone FROM c"""
)
def topic_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each topic of an earlier run: live members, and those that are gone or lost their vector."""
    member = table(spark, sf_dir, "topic_clusters").select(F.col("id").alias("cluster_id"), F.coalesce("label", F.lit("")).alias("label"), F.explode("memory_ids").alias("id")).distinct()
    there = T.memories(spark, sf_dir).select("id").join(T.vectors(spark, sf_dir).select("id"), "id").withColumn("ok", F.lit(1))
    g = member.join(there, "id", "left").groupBy("cluster_id", "label").agg(F.count("ok").alias("members"), F.count_if(F.col("ok").isNull() & F.col("id").isNotNull()).alias("gone"), F.count_if(F.col("ok").isNull() & F.col("id").isNull()).alias("nulls"))
    return g.where("members > 0").selectExpr("cluster_id", "label", "members", "gone + nulls AS gone")


# ---------------------------------------------------------------- evaluation of retrieval

#: Ranks at which a retrieval is judged.
CUTS = (15, 50)
_TERMS_SQL = TOKENS_SQL.format(t="question")


@C.add(
    f"""WITH docs AS (SELECT doc_id, {TOKENS_SQL.format(t="coalesce(text, '')")} AS w, text FROM documents), corpus AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM docs),
asked AS (SELECT item_id, coalesce(family, '') AS family, lower(passage) AS passage, list_distinct({_TERMS_SQL}) AS terms FROM eval_items WHERE question IS NOT NULL AND length(passage) >= 40),
term AS (SELECT item_id, unnest(terms) AS term FROM asked), tf AS (SELECT doc_id, len, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS len, unnest(w) AS term FROM docs) WHERE term IN (SELECT term FROM term) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY ALL),
score AS (SELECT item_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * {K1 + 1}::DOUBLE / (tf + {K1}::DOUBLE * (1 - {SIZE}::DOUBLE + {SIZE}::DOUBLE * len / mean))), 6) AS s FROM tf JOIN df USING (term) JOIN term USING (term), corpus GROUP BY ALL),
got AS (SELECT * FROM (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY s DESC, doc_id) AS r FROM score) WHERE r <= {CUTS[-1]}),
gold AS (SELECT item_id, family, doc_id FROM asked JOIN documents ON contains(lower(text), substring(passage, 1, 40))),
per AS (SELECT gold.item_id, family, k, avg(CASE WHEN got.r <= k THEN 1.0 ELSE 0.0 END) AS support, max(CASE WHEN got.r <= k THEN 1.0 ELSE 0.0 END) AS witness, min(CASE WHEN got.r <= k THEN 1.0 ELSE 0.0 END) AS full_witness FROM gold LEFT JOIN got ON got.item_id = gold.item_id AND got.doc_id = gold.doc_id, (SELECT unnest([{", ".join(map(str, CUTS))}]) AS k) GROUP BY ALL)
SELECT family, k, count(*) AS queries, round(100 * avg(support), 3) AS support, round(100 * avg(witness), 3) AS witness, round(100 * avg(full_witness), 3) AS full_witness FROM per GROUP BY GROUPING SETS ((k), (family, k))"""
)
def retrieval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of the documents that hold an item's passage a keyword search for its question finds, per family.

    Support is their share among the best 15 and 50, witness whether any is there, full witness whether all are. The
    questions are a fixed set; a document counts the terms of all of them in one pass.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.expr(TOKENS.format(t="coalesce(text, '')")).alias("w"))
    asked = table(spark, sf_dir, "eval_items").where("question IS NOT NULL AND char_length(passage) >= 40").select("item_id", F.coalesce("family", F.lit("")).alias("family"), F.lower("passage").alias("passage"), F.array_distinct(F.expr(TOKENS.format(t="question"))).alias("terms"))
    # the items are a fixed set
    term = F.broadcast(asked.select("item_id", F.explode("terms").alias("term")))
    sized = docs.select("doc_id", F.size("w").alias("len"), F.explode("w").alias("term")).join(F.broadcast(term.select("term").distinct()), "term", "left_semi")
    tf = materialize(sized.groupBy("doc_id", "len", "term").agg(F.count(F.lit(1)).alias("tf")))
    corpus = docs.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("w")).alias("mean"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    part = f"ln(1 + (n - df + 0.5D) / (df + 0.5D)) * tf * {K1 + 1}D / (tf + {K1}D * (1 - {SIZE}D + {SIZE}D * len / mean))"
    score = tf.join(F.broadcast(df), "term").join(term, "term").crossJoin(F.broadcast(corpus)).groupBy("item_id", "doc_id").agg(F.round(F.sum(F.expr(part)), 6).alias("s"))
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("s"), "doc_id"))
    got = score.withColumn("r", rank).where(F.col("r") <= CUTS[-1]).select("item_id", "doc_id", "r")
    gold = docs.select("doc_id", F.lower("text").alias("text")).join(F.broadcast(asked.select("item_id", "family", F.expr("substring(passage, 1, 40)").alias("start"))), F.expr("contains(text, start)")).select("item_id", "family", "doc_id")
    cuts = F.explode(F.array(*(F.lit(k) for k in CUTS))).alias("k")
    hit = gold.join(got, ["item_id", "doc_id"], "left").select("item_id", "family", "r", cuts).withColumn("hit", F.when(F.col("r") <= F.col("k"), 1.0).otherwise(0.0))
    per = hit.groupBy("item_id", "family", "k").agg(F.avg("hit").alias("support"), F.max("hit").alias("witness"), F.min("hit").alias("full_witness"))
    family, k = F.col("family"), F.col("k")
    mean = lambda c: F.round(100 * F.avg(c), 3).alias(c)
    return per.groupingSets([[k], [family, k]], family, k).agg(F.count(F.lit(1)).alias("queries"), mean("support"), mean("witness"), mean("full_witness"))


QUERIES, SQL = C.queries, C.sql
