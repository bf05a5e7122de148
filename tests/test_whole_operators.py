"""Operators over pairs of memories look at all of them, not only at pairs listed before."""

import numpy as np
from conftest import DATA
from pyspark.sql import functions as F

from mnemolith import blocks, tables
from mnemolith.operators import graph, maintenance


def test_near_duplicates_beyond_the_list(spark, monkeypatch):
    listed = {tuple(sorted(r)) for r in spark.read.parquet(f"{DATA}/duplicate_candidates.parquet").select("winner_id", "loser_id").collect()}
    whole = {tuple(r) for r in maintenance.dedup_near_all(spark, DATA).select("winner_id", "loser_id").collect()}
    assert {tuple(sorted(p)) for p in whole} - listed
    again = {tuple(sorted((r.winner_id, r.loser_id))) for r in maintenance.dedup_near_pairs(spark, DATA).where(F.col("winner_id") != F.col("loser_id")).collect()}
    assert again <= {tuple(sorted(p)) for p in whole}
    monkeypatch.setattr(blocks, "BLOCK", 7)
    assert {tuple(r) for r in maintenance.dedup_near_all(spark, DATA).select("winner_id", "loser_id").collect()} == whole


def test_similar_edges_beyond_the_relationships(spark, monkeypatch):
    rows = tables.memories(spark, DATA).select("id").join(tables.vectors(spark, DATA), "id").orderBy("id").collect()
    x = np.array([r.v for r in rows])
    c = x @ x.T - 3 * np.eye(len(x))
    true, sure = {}, set()
    for i in range(len(x)):
        order = np.argsort(-c[i])
        for j in order[:5]:
            if c[i, j] >= 0.6:
                true[tuple(sorted((rows[i].id, rows[int(j)].id)))] = c[i, j]
                if c[i, j] > c[i, order[5]] + 1e-6:
                    sure.add(tuple(sorted((rows[i].id, rows[int(j)].id))))
    for block in (blocks.BLOCK, 20):
        monkeypatch.setattr(blocks, "BLOCK", block)
        got = {(r.from_id, r.to_id): r.weight for r in graph.graph_similar_all(spark, DATA).collect()}
        assert sure <= set(got) and abs(len(got) - len(true)) <= len(true) - len(sure)
        assert all(abs(w - true[p]) < 1e-4 for p, w in got.items() if p in true)
    stored = {(r.from_id, r.to_id) for r in graph.graph_similar(spark, DATA).collect()}
    assert set(got) - stored


def test_associations_beyond_the_relationships(spark):
    stored = {(r.from_id, r.to_id) for r in maintenance.inferred_associations(spark, DATA).where("link_type IS NOT NULL").collect()}
    got = {(r.from_id, r.to_id) for r in maintenance.inferred_associations_all(spark, DATA).collect()}
    assert stored < got


def test_pairs_of_associations_are_not_shuffled(spark, oracle, monkeypatch):
    columns = "from_id, to_id, similarity, link_type"
    true = set(oracle.sql(f"SELECT {columns} FROM ({maintenance.C.sql['inferred_associations_all']})").fetchall())
    for block in (blocks.BLOCK, 15):
        monkeypatch.setattr(blocks, "BLOCK", block)
        found = maintenance.inferred_associations_all(spark, DATA)
        rows = [tuple(r) for r in found.select(*columns.split(", ")).collect()]
        assert len(rows) == len(true) and set(rows) == true
        # what is done with a pair is done in its block
        after = found._jdf.queryExecution().executedPlan().toString().partition("MapInArrow")[0]
        assert "Join" not in after and "Exchange" not in after
