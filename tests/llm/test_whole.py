"""Nothing is cut: results of groups far beyond one block against brute force."""

import datetime as dt

import numpy as np

from mnemolith import blocks
from mnemolith.llm import near_duplicates, neighbours, topics, words
from mnemolith.llm import vectors as V

DAY = dt.datetime(2025, 1, 1)


def frame(spark, x):
    rows = [(f"m{i:04d}", [float(f) for f in v], DAY + dt.timedelta(seconds=i)) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "memory_id string, vector array<float>, embedded_at timestamp_ntz")


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_hot_bucket_keeps_its_pairs(spark, monkeypatch):
    rng = np.random.default_rng(1)
    x = unit(unit(rng.normal(size=(1, 64))) + unit(rng.normal(size=(800, 64))) * 0.1)
    c = x @ x.T - 3 * np.eye(len(x))
    true = {tuple(sorted((f"m{i:04d}", f"m{j:04d}"))) for i in range(len(x)) for j in np.argsort(-c[i])[:5] if c[i, j] >= 0.85}
    monkeypatch.setattr(V, "RUN", 50)
    monkeypatch.setattr(blocks, "BLOCK", 50)
    got = {tuple(r) for r in neighbours.similar_pairs(frame(spark, x)).collect()}
    assert len(got & true) >= 0.97 * len(true) and len(got - true) <= 0.03 * len(true)


def test_far_neighbours_are_found(spark, monkeypatch):
    x = unit(np.random.default_rng(2).normal(size=(600, 64)))
    c = x @ x.T - 3 * np.eye(len(x))
    true = {(f"m{i:04d}", f"m{j:04d}") for i in range(len(x)) for j in np.argsort(-c[i])[:5]}
    for block in (blocks.BLOCK, 100):
        monkeypatch.setattr(blocks, "BLOCK", block)
        got = [tuple(r) for r in neighbours.neighbours(frame(spark, x)).select("memory_id", "neighbour_id").collect()]
        assert len(got) == len(set(got)) == 5 * len(x) and len(set(got) & true) >= 0.99 * len(true)


def test_chains_at_the_threshold_are_one_topic(spark, monkeypatch):
    # each group is a chain of six, every link between 0.85 and 0.87, and its other pairs far below
    rng, x = np.random.default_rng(3), []
    for _ in range(40):
        basis = np.linalg.qr(rng.normal(size=(64, 2)))[0].T
        x += [np.cos(k * 0.53) * basis[0] + np.sin(k * 0.53) * basis[1] for k in range(6)]
    true = {(f"m{i:04d}", f"m{i - i % 6:04d}") for i in range(len(x))}
    for block in (blocks.BLOCK, 25):
        monkeypatch.setattr(blocks, "BLOCK", block)
        assert {tuple(r) for r in topics.topic_members(frame(spark, np.array(x))).select("memory_id", "cluster_id").collect()} == true


def test_a_link_of_a_divided_cell_is_kept(spark, monkeypatch):
    # a ball, whose label is the smallest, and memories that each meet the threshold with one or two of the ball
    rng = np.random.default_rng(4)
    ball = unit(unit(rng.normal(size=(1, 64))) + unit(rng.normal(size=(60, 64))) * 0.35)
    away = rng.normal(size=(60, 64))
    away = unit(away - (away * ball).sum(axis=1, keepdims=True) * ball)
    x = np.concatenate([ball, 0.855 * ball + np.sqrt(1 - 0.855**2) * away])
    c, label = x @ x.T, np.arange(len(x))
    for _ in x:
        label = np.array([label[c[i] >= 0.85].min() for i in range(len(x))])
    true = {(f"m{i:04d}", f"m{g:04d}") for i, g in enumerate(label) if (label == g).sum() >= 5}
    assert len(true) == len(x)
    monkeypatch.setattr(V, "RUN", 4)
    members = topics.topic_members(frame(spark, x))
    assert {tuple(r) for r in members.select("memory_id", "cluster_id").collect()} == true


def test_links_by_a_hair_are_told_apart_without_densities(spark, monkeypatch):
    # chains of ten whose links are over the threshold by a hair, the middle one of every other chain under it by a hair
    rng, x, true = np.random.default_rng(6), [], set()
    for g in range(40):
        basis, at = np.linalg.qr(rng.normal(size=(64, 2)))[0].T, 0.0
        for k in range(10):
            at += np.arccos(0.8497 if k == 5 and g % 2 else 0.8503) if k else 0
            x.append(np.cos(at) * basis[0] + np.sin(at) * basis[1])
            true.add((f"m{len(x) - 1:04d}", f"m{10 * g + (5 if k >= 5 and g % 2 else 0):04d}"))
    for run in (V.RUN, 40):
        monkeypatch.setattr(V, "RUN", run)
        for density in (False, True):
            members = topics.topic_members(frame(spark, np.array(x)), density)
            assert {tuple(r) for r in members.select("memory_id", "cluster_id").collect()} == true


def test_upper_bytes_leave_no_link_out():
    rng = np.random.default_rng(7)
    x = unit(rng.normal(size=(4000, 64)) ** 3)
    # two thirds of them with one component that is nearly all
    x[::3, 0] = x[1::3, 0] = 3
    x, across = unit(x), rng.normal(size=x.shape)
    across = unit(across - (across * x).sum(axis=1, keepdims=True) * x)
    c = rng.uniform(0.8, 0.9, (len(x), 1))
    both = np.concatenate([x, c * x + np.sqrt(1 - c**2) * across])
    q = np.frombuffer(b"".join(topics._packed(both).to_pylist()), np.uint8).reshape(len(both), -1)
    whole, (coarse, sure, maybe) = topics._whole(q), topics._coarse(q[:, :64])
    assert np.abs(whole - both).max() < 1e-4
    near, rough = ((a[: len(x)] * a[len(x) :]).sum(axis=1) for a in (whole, coarse))
    assert (near[rough >= sure] >= topics.LEAST).all() and (rough[near >= topics.LEAST] >= maybe).all()
    assert maybe > topics.LEAST - 0.04 and sure < topics.LEAST + 0.04 and ((rough >= maybe) & (rough < sure)).any()


def test_grids_shuffle_half_of_a_vector(spark):
    x = unit(np.random.default_rng(8).normal(size=(6000, 64)))
    rows = frame(spark, x).repartition(4).cache()
    rows.count()

    def shuffled():
        """Bytes that each stage shuffled, by its number."""
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return {(s := stages.apply(i)).stageId(): s.shuffleWriteBytes() for i in range(stages.size())}

    before = max(shuffled())
    assert topics.topic_members(rows, density=False).count() == 0
    size = sum(v for k, v in shuffled().items() if k > before) / len(x)
    # half of a vector's 128 bytes for each grid, and what else a memory needs
    assert size < 100 * topics._grids(len(x))[0]
    rows.unpersist()


def test_a_pair_at_the_threshold_is_missed_as_seldom_as_stated():
    for rows in (1_000, 15_000, 1_500_000, 80_000_000):
        grids, digits, last = topics._grids(rows)
        first, further = (V.meeting_rate(digits, last, topics.LEAST, v) for v in (None, True))
        assert (1 - first) * (1 - further) ** (grids - 1) <= topics.MISS


def test_only_short_texts_get_a_digest_of_their_sequence():
    n, seq, at, found = near_duplicates.tokenised(["a b a", "a b " * 20, None])
    assert n == [3, 40, 0] and at == [1] and [s is None for s in seq] == [False, True, False]
    # the first occurrence of a word is its hash, each further one a token of its own
    assert len(set(found[0].tolist())) == 40 and {words.HASHES["a"], words.HASHES["b"]} <= set(found[0].tolist())
