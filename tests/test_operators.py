"""Golden cases of single operators, and edge cases of problem 4."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from mnemolith import params as P
from mnemolith.operators import graph, maintenance, references, retrieval
from mnemolith.operators.components import connected_components
from mnemolith.sources import ingest
from mnemolith.streaming import events

DAY = dt.datetime(2025, 1, 1)


def test_archive_days():
    assert [P.archive_days(*P.WEIBULL[t]) for t in ("profile", "fact", "request", "general", "event")] == [365, 85, 7, 16, 14]


def test_recency_falls_with_age_and_certified_stays(spark):
    rows = [(f"m{h}", "fact", "unverified", dt.datetime(2025, 6, 1) - dt.timedelta(hours=h)) for h in (0, 1, 24, 720)]
    rows += [("c", "fact", "certified", dt.datetime(2020, 1, 1)), ("n", "fact", "unverified", None)]
    df = spark.createDataFrame(rows, "id string, memory_type string, verification_status string, last_accessed timestamp_ntz")
    got = dict(df.selectExpr("id", f"{retrieval.recency(retrieval.HOURS)} AS r").collect())
    assert 1 > got["m0"] > got["m1"] > got["m24"] > got["m720"] and got["c"] == got["n"] == 1.0
    assert math.isclose(got["m720"], math.exp(-1), rel_tol=1e-9)


def test_bm25_rare_term_first(spark):
    rows = [(f"d{i}", None, f"shared token{i % 3} word", ["x"]) for i in range(20)] + [("rare", None, "shared unicorn", None)]
    df = spark.createDataFrame(rows, "id string, heading string, content string, tags array<string>")
    top = retrieval.bm25(df, ["shared", "unicorn"]).orderBy(F.desc("bm25")).first()
    assert top["id"] == "rare"
    assert retrieval.bm25(df.limit(0), ["shared"]).count() == 0


def test_timeline_ties(spark):
    t = dt.datetime(2025, 1, 2)
    rows = [(f"m{i:02d}", t) for i in range(20)] + [("z", t + dt.timedelta(seconds=1)), ("a", t - dt.timedelta(seconds=1)), ("q", None)]
    df = spark.createDataFrame(rows, "id string, ingested_at timestamp_ntz")
    anchor = spark.createDataFrame([(t, "m10")], "t timestamp_ntz, aid string")
    before = (F.col("ingested_at") < F.col("t")) | ((F.col("ingested_at") == F.col("t")) & (F.col("id") < F.col("aid")))
    got = {(r["side"], r["n"]): r["id"] for r in retrieval.neighbours_in_time(df, anchor, before, 3).collect()}
    assert got == {("before", 1): "m09", ("before", 2): "m08", ("before", 3): "m07", ("after", 1): "m11", ("after", 2): "m12", ("after", 3): "m13"}


def test_components(spark):
    df = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y"), ("q", "q"), (None, "a"), ("b", "a")] + [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(40)], "u string, v string")
    got = dict(connected_components(df, "u", "v").collect())
    assert {got[k] for k in "abc"} == {"a"} and got["y"] == "x" and "q" not in got and {got[f"n{i:03d}"] for i in range(41)} == {"n000"}
    assert connected_components(df.limit(0), "u", "v").count() == 0


def test_kmeans_splits_two_directions(spark):
    v = [[1.0, 0.0], [0.99, 0.14], [0.98, -0.2], [0.0, 1.0], [0.1, 0.99]]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(v)], "vec_id long, v array<double>")
    got = dict(maintenance.kmeans(df, 2).collect())
    assert [got[i] for i in range(5)] == [0, 0, 0, 1, 1]


def test_entities_and_hubs(spark):
    df = spark.createDataFrame([("a", "see `run x` at /srv/data port: 80 via MX"), ("b", None), ("c", "")], "id string, content string")
    got = {(r["entity"], r["kind"]) for r in graph.entities(df).collect()}
    assert got == {("run x", "code"), ("/srv/data", "path"), ("port: 80", "setting"), ("MX", "acronym")}


def test_redaction_state_is_carried():
    assert ingest.redact(["a <private>x <private>y</private> z</private> b", "c <PRIVATE>d", "e</private> f", None]) == ["a [private] b", "c [private]", " f", ""]


def test_markdown_chunks():
    text = "intro\n\n# One\nbody\n```\n# no heading\n```\n## Two\nx"
    assert [h for h, _ in ingest.chunk_markdown(text)] == [None, "One", "Two"]
    assert ingest.chunk_markdown("", "file") == []
    assert len(ingest.chunk_markdown("line\n" * 4000)) > 1


def test_read_markdown(spark, tmp_path):
    (tmp_path / "a.md").write_text("# T\nsee <private>x</private>")
    (tmp_path / "b.md").write_bytes(b"\xff\xfe")
    (tmp_path / "c.md").write_text("\n \n")
    got = sorted((r["status"], r["heading"], r["content"]) for r in ingest.read_markdown(spark, str(tmp_path)).collect())
    assert got == [("empty", None, None), ("invalid_utf8", None, None), ("ok", "T", "# T\nsee [private]")]


def test_snapshot_round_trip(spark, tmp_path):
    from conftest import DATA

    manifest = ingest.export_snapshot(spark, DATA, str(tmp_path), ("relationships",))
    assert set(ingest.import_snapshot(spark, str(tmp_path), manifest)) == {"relationships"}
    with pytest.raises(ValueError):
        ingest.import_snapshot(spark, str(tmp_path), manifest.withColumn("rows", F.col("rows") + 1))


@pytest.mark.parametrize("field, value, hit", [("*", 5, True), ("*/15", 30, True), ("*/15", 31, False), ("5,35", 35, True), ("8-18", 18, True), ("8-18", 19, False), ("x", 1, False)])
def test_cron_field(spark, field, value, hit):
    schedule = events.Schedule(f"{field} * * * *")
    assert spark.sql(f"SELECT {schedule.predicate(f'TIMESTAMP_NTZ \'2025-01-01 00:{value:02d}:00\'', '3')} AS x").first()["x"] is hit


def test_streams_equal_batches(spark, tmp_path):
    from conftest import DATA

    (tmp_path / "in").mkdir()
    batch = spark.read.parquet(f"{DATA}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    batch.write.mode("overwrite").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    q = events.tumbling(stream).writeStream.outputMode("complete").format("memory").queryName("hourly").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("hourly").collect())) == sorted(map(tuple, events.tumbling(batch).collect()))


def test_bloom_filter_has_no_false_negative(spark):
    keys = spark.range(5000).selectExpr("CAST(id AS STRING) AS k")
    bloom = references.bloom_filter(keys, "k", 512)
    both = references.maybe_present(spark.range(10_000).selectExpr("CAST(id AS STRING) AS k"), "k", bloom, 512)
    got = both.selectExpr("CAST(k AS INT) < 5000 AS there", "maybe").groupBy("there", "maybe").count().collect()
    count = {(r["there"], r["maybe"]): r["count"] for r in got}
    assert count[True, True] == 5000 and (True, False) not in count and count.get((False, True), 0) < 250


MEM = "id string, arrived_at timestamp_ntz, consolidated_from array<string>, block long, maybe string"


def test_orphans(spark):
    late = DAY + dt.timedelta(days=40)
    memories = spark.createDataFrame([("a", DAY, ["b", " B ", None, "", "gone"], 1, "x"), ("a", late, ["zzz"], 1, "x"), ("b", late, None, 2, "y"), (None, DAY, ["q"], 3, "z"), ("e", DAY, [], 4, "w")], MEM)
    records = spark.createDataFrame([("s", " A ", DAY), ("s", " A ", DAY), ("s", "e", DAY), ("s", None, DAY), ("t", "  ", None), ("t", "nope", None)], "source_id string, memory_id string, arrived_at timestamp_ntz")
    links = spark.createDataFrame([("a", "b", late), ("a", "b", DAY)], "from_id string, to_id string, arrived_at timestamp_ntz")
    intents = spark.createDataFrame([(" E ", 1), ("a", 0), (None, 1), ("", 1)], "memory_id string, complete long")
    got = sorted(map(tuple, references.orphan_references(memories, records, links, intents).collect()), key=str)
    assert got == sorted([
        ("memories", "a", "b", "2025-01", "later"), ("memories", "a", "gone", "2025-01", "missing"),
        ("source_records", "s", "e", "2025-01", "erased"), ("source_records", "t", "nope", None, "missing"),
        ("relationships", "a", "b", "2025-01", "later"),
    ], key=str)
    empty = references.orphan_references(memories.limit(0), records, links.limit(0), intents.limit(0))
    assert {r["reason"] for r in empty.collect()} == {"missing"}
    assert references.orphan_references(memories.limit(0), records.limit(0), links.limit(0), intents.limit(0)).count() == 0


@pytest.mark.parametrize("text, at, expected", [
    ("*/15 * * * *", dt.datetime(2025, 1, 1, 0, 0), dt.datetime(2025, 1, 1, 0, 15)),
    ("0 3 * * *", dt.datetime(2025, 1, 1, 3, 0, 30), dt.datetime(2025, 1, 2, 3, 0)),
    ("30 8 * * mon-fri", dt.datetime(2025, 1, 3, 9, 0), dt.datetime(2025, 1, 6, 8, 30)),
    ("0 0 29 feb *", dt.datetime(2025, 1, 1), dt.datetime(2028, 2, 29)),
    ("10-20/5,40 1 1 1 7", dt.datetime(2025, 1, 1), dt.datetime(2034, 1, 1, 1, 10)),
    ("0 0 31 2 *", dt.datetime(2025, 1, 1), None),
    ("99 * * * *", dt.datetime(2025, 1, 1), None),
])
def test_schedule_next(text, at, expected):
    days = 366 * 10
    assert events.Schedule(text).next_after(at, days) == expected


def test_schedule_due():
    s, day = events.Schedule("0 3 * * *"), dt.datetime(2025, 1, 1)
    at = lambda h, m: day.replace(hour=h, minute=m)
    assert s.due(at(3, 0), None) and s.due(at(3, 4), None) and not s.due(at(3, 9), None) and not s.due(at(2, 59), None)
    assert not s.due(at(3, 2), at(3, 0)) and s.due(at(3, 2), day)
    with pytest.raises(ValueError):
        events.Schedule("* * *")


def test_stream_of_changes_and_repeats(spark, tmp_path):
    schema = "source_id string, content_hash string, captured_at timestamp"
    rows = [("a", "1", DAY), ("a", "1", DAY + dt.timedelta(hours=1)), ("b", "2", DAY)]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in" / "one"))
    seen = []
    read = lambda: spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    query = events.stream_once(read()).writeStream.foreachBatch(lambda df, n: seen.extend(tuple(r)[:2] for r in df.collect())).option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(seen) == [("a", "1"), ("b", "2")]
    batches = []
    for _ in range(2):
        events.stream_changes(spark, str(tmp_path / "in" / "one"), schema, lambda df, n: batches.append((n, df.count())), str(tmp_path / "c2")).awaitTermination(120)
    assert sum(n for _, n in batches) == 3


def test_snapshot_pushes_filters(spark):
    from conftest import DATA

    from mnemolith import tables

    mem = tables.memories(spark, DATA)
    plan = mem.where("visibility = 'public' AND realm_name = 'inbox' AND importance <= 0.3").select("id")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(realm_name,inbox)" in plan and "LessThanOrEqual(importa" in plan and "visibility" in plan.split("PartitionFilters: ")[1].split("]")[0] and "Window" not in plan
    assert mem.count() == mem.select("id").distinct().count()


def test_search_of_an_empty_store_and_page_over_the_end(spark):
    from conftest import DATA

    from mnemolith import tables
    from mnemolith.operators import search

    mem, v = tables.live_memories(spark, DATA), tables.vectors(spark, DATA)
    q = retrieval.query_vector(v)
    assert search.search(mem.limit(0), v, q, search.ASKED).count() == 0
    assert search.search(mem, v.limit(0), retrieval.query_vector(v.limit(0)), search.Search()).count() == 0
    assert search.search(mem, v, q, search.Search(offset=10_000)).count() == 0
    dreams = search.search(mem, v, q, search.Search(dreams=True, limit=500)).count()
    assert dreams >= search.search(mem, v, q, search.Search(limit=500)).count()
