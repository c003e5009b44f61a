import numpy as np
from pyspark.sql import functions as F

from feuillet.llm import ann


def brute(ids, x, k):
    x = x.astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    c = x @ x.T
    np.fill_diagonal(c, -9)
    return {(i, ids[j]) for r, i in enumerate(ids) for j in sorted(range(len(ids)), key=lambda j: (-round(c[r, j], 12), ids[j]))[:k]}


def rows_of(n=1500, dim=32):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((60, dim))
    x = (centres[rng.integers(0, 60, n)] + 0.35 * rng.standard_normal((n, dim))).astype(np.float32)
    return list(range(10, 10 + n)), x


def test_recall(spark):
    ids, x = rows_of()
    bad = [(1, None), (2, []), (3, [1.0] * 31), (4, [0.0] * 32), (5, [float("nan")] + [1.0] * 31)]
    data = [(i, v.tolist()) for i, v in zip(ids, x)] + [(ids[0], x[0].tolist())] + bad + [(None, x[1].tolist())]
    df = spark.createDataFrame(data, "chunk_id long, chunk_vectors array<float>").withColumn("neighbour", F.lit("clash"))
    got = ann.nearest_vectors(df, dim=32).collect()
    want = brute(ids, x, 5)
    assert len({(r.chunk_id, r.neighbour) for r in got} & want) >= 0.97 * len(want)
    assert {r.chunk_id for r in got} == set(ids) and all(r.chunk_id != r.neighbour for r in got)


def test_ties_go_to_the_smaller_id(spark):
    df = spark.createDataFrame([(i, [1.0, 2.0, 3.0, 4.0]) for i in range(30, 0, -1)], "chunk_id long, chunk_vectors array<float>")
    got = {}
    for r in ann.nearest_vectors(df, dim=4, k=3).collect():
        got.setdefault(r.chunk_id, set()).add(r.neighbour)
    assert got[30] == {1, 2, 3} and got[2] == {1, 3, 4}


def test_nothing_usable(spark):
    df = spark.createDataFrame([(1, None), (2, [0.0] * 4)], "chunk_id long, chunk_vectors array<float>")
    assert ann.nearest_vectors(df, dim=4).count() == 0 and ann.nearest_vectors(df.limit(0), dim=4).count() == 0


def test_differing_repeats_count_once(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.1]), (3, [0.1, 1.0])], "chunk_id long, chunk_vectors array<float>")
    got = ann.nearest_vectors(df, dim=2, k=5).groupBy("chunk_id").count().collect()
    assert {r.chunk_id: r["count"] for r in got} == {1: 2, 2: 2, 3: 2}


def test_storage_is_lossless():
    for row in (np.array([0.1, 0.5], np.float32), np.array([0.25, 0.5], np.float32)):
        assert (ann.unpack([ann.pack(row)], 2)[0] == row).all()


def test_many_coarse_lists_and_a_hot_vector(spark, monkeypatch):
    """A third of all rows holds one vector; rows are sent twice; several coarse lists, several steps for the hot list."""
    monkeypatch.setattr(ann, "LIST_SIZE", 40), monkeypatch.setattr(ann, "FAN", 6), monkeypatch.setattr(ann, "PART_IDS", 300)
    ids, x = rows_of()
    hot = [(100_000 + i, x[3].tolist()) for i in range(700)]
    data = [(i, v.tolist()) for i, v in zip(ids, x)] + hot
    df = spark.createDataFrame(data + data[::5], "chunk_id long, chunk_vectors array<float>").repartition(6)
    got = ann.nearest_vectors(df, dim=32).collect()
    near = {}
    for r in got:
        near.setdefault(r.chunk_id, []).append(r.neighbour)
    assert set(near) == {i for i, _ in data} and all(len(v) == 5 == len(set(v)) and i not in v for i, v in near.items())
    smallest = sorted([ids[3], *(i for i, _ in hot)])
    assert all(set(near[i]) == set([j for j in smallest if j != i][:5]) for i in smallest)
    want = brute([i for i, _ in data[:1500]], x, 5)
    plain = {(i, j) for i, j in want if i != ids[3] and ids[3] not in {b for a, b in want if a == i}}
    assert len(plain & {(i, j) for i, v in near.items() for j in v}) >= 0.95 * len(plain)


def test_every_candidate_is_tested_but_the_first():
    """A query without a neighbour is compared in full with FIRST candidates only; what the tests leave is right."""
    rng = np.random.default_rng(1)
    x = ann.unit(rng.standard_normal((900, 384)).astype(np.float32))
    turned = x @ ann.rotation(384)
    norms = np.stack([(turned[:, :b] ** 2).sum(axis=1) for b in ann.BLOCKS])
    q, row, s = ann.scan(turned[:50], norms[:, :50], turned, norms, np.full(50, -1.0, np.float32), 6)
    exact = turned[:50] @ turned.T
    best = {(i, j) for i in range(50) for j in np.argsort(-exact[i])[:6].tolist()}
    assert np.allclose(exact[q, row], s, atol=1e-5) and len(best & set(zip(q.tolist(), row.tolist()))) >= 0.97 * len(best)
