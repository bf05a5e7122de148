"""The queries of this subpackage, and the SQL that checks those which SQL can express."""

from __future__ import annotations

from mnemolith.llm import history, leakage, near_duplicates, neighbours, packing, personal, sentences, splitting, topics

QUERIES = {
    f.__name__: f
    for f in (
        near_duplicates.p1_found,
        near_duplicates.p1_groups,
        history.p2_found,
        history.p2_batches,
        splitting.p3_found,
        splitting.p3_pieces,
        neighbours.p5_found,
        neighbours.p5_neighbours,
        personal.p6_found,
        personal.p6_redacted,
        topics.p7_found,
        topics.p7_topics,
        packing.p8_packed,
        packing.p8_fill,
        leakage.p9_found,
        leakage.p9_leaks,
        sentences.p10_found,
        sentences.p10_sentences,
    )
}

SQL = {
    "p7_found": """
WITH RECURSIVE fine AS (
  SELECT memory_id, vector::DOUBLE[] AS v,
         row_number() OVER (PARTITION BY memory_id ORDER BY embedded_at NULLS LAST) AS r
  FROM memory_vectors
  WHERE memory_id IS NOT NULL AND len(vector) = 64
    AND len(list_filter(vector, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(vector, lambda x: x <> 0)) > 0),
one AS MATERIALIZED (SELECT memory_id AS m, v::DOUBLE[64] AS v FROM fine WHERE r = 1),
edges AS MATERIALIZED (
  SELECT a.m AS a, b.m AS b FROM one a JOIN one b ON a.m <> b.m AND array_cosine_similarity(a.v, b.v) >= 0.85),
reach(a, b) AS (SELECT a, b FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a),
label AS (SELECT a AS memory_id, min(least(a, b)) AS cluster_id FROM reach GROUP BY a)
SELECT memory_id, cluster_id FROM label
WHERE cluster_id IN (SELECT cluster_id FROM label GROUP BY cluster_id HAVING count(*) >= 5)
""",
}
