import numpy as np
import pytest
from pyspark.sql import functions as F

from spendlens.llm import queries, vector_graph
from tests.conftest import SF_CHECK

SCHEMA = "vec_id long, embedding array<float>"


def brute(ids, vectors, threshold=0.95):
    x = np.array(vectors, np.float32).astype(np.float64)
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    hit = x @ x.T >= threshold
    np.fill_diagonal(hit, False)
    low = np.array(ids)
    while True:
        new = low.copy()
        for i in range(len(ids)):
            if hit[i].any():
                new[i] = min(low[i], low[hit[i]].min())
        if (new == low).all():
            return hit.sum(axis=1), low
        low = new


def check_recall(got, ids, vectors, share=0.9):
    n, low = brute(ids, vectors)
    assert n.sum() > 0
    found = np.array([got[i].n_links for i in ids])
    assert (found <= n).all() and found.sum() >= share * n.sum()
    assert all(got[i].component_id >= c for i, c in zip(ids, low))
    assert all(r.kept == (r.component_id == r.vec_id) for r in got.values())
    return n, low


def test_query_on_the_table(spark):
    """The table's own vectors hold no link (their largest cosine is below the threshold)."""
    rows = spark.read.parquet(f"{SF_CHECK}/embeddings.parquet").orderBy("vec_id").collect()
    n, low = brute([r.vec_id for r in rows], [r.embedding for r in rows])
    got = {r.vec_id: r for r in queries.op10_vector_graph(spark, SF_CHECK).collect()}
    assert {i: (r.n_links, r.component_id) for i, r in got.items()} == {r.vec_id: (k, c) for r, k, c in zip(rows, n, low)}


def test_recall_on_the_table_with_near_copies(spark, tmp_path):
    """Every fourth vector of the table comes again with noise, some several times."""
    rows = spark.read.parquet(f"{SF_CHECK}/embeddings.parquet").orderBy("vec_id").collect()
    rnd = np.random.RandomState(2)
    x = np.array([r.embedding for r in rows])
    scale = np.sqrt((x * x).sum(axis=1, keepdims=True) / x.shape[1])
    more = [x[i] + scale[i] * rnd.uniform(0.1, 0.4) * rnd.randn(x.shape[1]) for i in range(0, len(x), 4) for _ in range(1 + i % 3)]
    vectors = np.concatenate([x, more]).astype(np.float32)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], SCHEMA)
    frame.write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {r.vec_id: r for r in queries.op10_vector_graph(spark, str(tmp_path)).collect()}
    check_recall(got, list(range(len(vectors))), vectors, 0.97)


def test_narrow_cone(spark):
    """Vectors of a mean cosine of 0.85: no two link but the planted ones, and the cone keeps
    its centres."""
    rnd = np.random.RandomState(6)
    d = 48
    axis = np.zeros(d)
    axis[0] = np.sqrt(0.85 / 0.15)
    x = axis + rnd.randn(3000, d) / np.sqrt(d)
    unit = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    assert abs((unit[:500] @ unit[:500].T).mean() - 0.85) < 0.02
    x = np.concatenate([x, x[:200] + 0.05 * rnd.randn(200, d)]).astype(np.float32)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], SCHEMA)
    classes = frame.select(F.col("vec_id").alias("rep"), F.col("embedding").alias("v"))
    assert len(vector_graph._centres(classes, len(x), 100, 0.95)) > 20
    got = {r.vec_id: r for r in vector_graph.near_duplicates(frame, shard=100).collect()}
    check_recall(got, list(range(len(x))), x)


def test_links_are_found_across_shards(spark):
    """A vector whose neighbour is in none of the parts of its home shard finds it through the
    united lists."""
    rnd = np.random.RandomState(13)
    vectors = np.concatenate([[[1, 0.9, 0]] + 0.02 * rnd.randn(4, 3), [[1, 0, 0.9]] + 0.1 * rnd.randn(60, 3)]).astype(np.float32)
    n, _ = brute(range(64), vectors)
    frame = spark.createDataFrame([(i, 1, v.tolist()) for i, v in enumerate(vectors)], "rep long, copies long, v array<float>")
    for part in (10, 1000):
        links = vector_graph._linked(frame, np.eye(3), 2, 0.95, part).groupBy("u").agg(F.sum("n").alias("n")).where("n > 0")
        found = {r.u: r.n for r in links.collect()}
        assert all(found[i] <= n[i] for i in found) and sum(found.values()) >= 0.95 * n.sum()


def test_dense_groups_and_slices(spark, monkeypatch):
    rnd = np.random.RandomState(3)
    centres = rnd.randn(25, 16)
    vectors = np.concatenate([c + 0.12 * rnd.randn(24, 16) for c in centres] + [rnd.randn(100, 16)]).astype(np.float32)
    vectors[5] = vectors[0]
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    n, _ = brute(range(len(rows)), vectors)
    frame = spark.createDataFrame(rows, SCHEMA).withColumn("links", F.lit("clash"))
    found = {r.vec_id: r.n_links for r in vector_graph.near_duplicates(frame, shard=100).collect()}
    assert all(found[i] <= n[i] for i in found) and sum(found.values()) >= 0.9 * n.sum()


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0]), (2, [2.0, 0.01]), (3, None), (4, [0.0, 0.0]), (5, [None, 1.0]), (6, [nan, 1.0]),
        (7, [inf, 1.0]), (None, [1.0, 0.0]), (8, [1.0, 0.0]), (9, [0.0, 1.0]), (10, []),
    ]
    got = sorted(((r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in vector_graph.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()))
    alone = [(i, 0, i, True) for i in (3, 4, 5, 6, 7)]
    assert got == [(0, 0, None, True), (1, 2, 1, True), (2, 2, 1, False), *alone, (8, 2, 1, False), (9, 0, 9, True), (10, 0, 10, True)]
    empty = spark.createDataFrame([], SCHEMA)
    assert vector_graph.near_duplicates(empty).collect() == []


def test_widens_until_the_audit_passes(spark):
    vectors = np.random.RandomState(7).randn(600, 3).astype(np.float32)
    n, low = brute(range(600), vectors)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], SCHEMA)
    found = {r.vec_id: r.n_links for r in vector_graph.near_duplicates(frame, shard=20, overlap=(1,)).collect()}
    assert all(found[i] <= n[i] for i in found) and sum(found.values()) >= 0.9 * n.sum()


def test_raises_if_the_audit_never_passes(spark, monkeypatch):
    tried = []
    monkeypatch.setattr(vector_graph, "audit", lambda *a: tried.append(a) or 0.0)
    frame = spark.createDataFrame([(i, [float(i % 7), 1.0 + i % 5, float(i % 3)]) for i in range(60)], SCHEMA)
    with pytest.raises(RuntimeError, match="recall"):
        vector_graph.near_duplicates(frame, shard=5, overlap=(1,))
    assert len(tried) > 1


def test_audit_sees_links_that_few_vectors_have(spark):
    rnd = np.random.RandomState(11)
    vectors = rnd.randn(4000, 16)
    vectors[:2000] /= np.sqrt((vectors[:2000] ** 2).sum(axis=1, keepdims=True))
    vectors[1:4] = vectors[0] + 0.02 * rnd.randn(3, 16)
    rows = spark.createDataFrame([(i, 1, v.tolist()) for i, v in enumerate(vectors)], "rep long, copies long, v array<float>")
    links = spark.createDataFrame([(0, 1, 0), (1, 1, 0)], "u long, n long, v long")
    assert vector_graph.audit(rows, links, 0.95, 10) <= 0.4


def test_lengths_that_differ(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.01]), (3, [1.0]), (4, [1.0, 0.0, 0.0])]
    got = {r.vec_id: (r.n_links, r.component_id) for r in vector_graph.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (0, 3), 4: (0, 4)}


def near_copies(size, others):
    rnd = np.random.RandomState(5)
    base = rnd.randn(64)
    near = base / np.sqrt(base @ base) + 0.0238 * rnd.randn(size, 64)  # pairs at 0.965 or so
    return np.concatenate([near, rnd.randn(others, 64)]).astype(np.float32)


def test_parts_of_a_large_shard_are_all_searched(spark):
    vectors = near_copies(500, 100)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], SCHEMA)
    for part in (64, 2500):
        got = {r.vec_id: r for r in vector_graph.near_duplicates(frame, shard=50, part=part).collect()}
        check_recall(got, list(range(600)), vectors, 0.97)


def test_search_scores_few_of_many():
    """Over scattered groups, a search sees a small share of the graph."""
    rnd = np.random.RandomState(4)
    centres = rnd.randn(200, 24)
    x = np.concatenate([c + 0.1 * rnd.randn(15, 24) for c in centres])
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    bounds, neighbours = vector_graph._undirected(vector_graph.pruned_neighbours(x))
    starts = vector_graph.medoids(x, bounds, neighbours)
    true = x[:15] @ x.T >= 0.95
    nodes, cosines = vector_graph.search_in_range(x, bounds, neighbours, starts, x[:15], 0.95)
    assert (cosines >= 0.95).sum() >= 0.95 * true.sum()
    assert len(nodes) < 0.6 * len(x)
