import random

import numpy as np
from pyspark.sql import functions as F

from feuillet.llm import neardup as N
from feuillet.llm.words import words


def brute(rows, n, t):
    sets = {i: {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} for i, w in ((i, words(a) + words(b)) for i, a, b in rows)}
    ids = sorted(i for i, s in sets.items() if s)
    return {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b])}


def table(n=220):
    rng = random.Random(4)
    vocabulary = [f"mot{i}" for i in range(400)]
    rows = []
    for i in range(n):
        if i % 3 and rows:
            w = rows[rng.randrange(len(rows))][2].split()
            for _ in range(rng.randrange(8)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
        else:
            w = rng.choices(vocabulary, k=rng.randint(30, 90))
        rows.append((i, f"f{i % 9}.pdf", " ".join(w)))
    return rows + [(900, None, None), (901, "", ""), (902, "un", "deux"), (903, "f1.pdf", rows[1][2]), (904, "f1.pdf", rows[1][2])]


def test_pairs_equal_brute_force(spark):
    rows = table()
    df = spark.createDataFrame(rows, "id long, file_name string, extracted_text string").withColumn("class_id", F.lit("clash")).withColumn("band", F.lit(1))
    got = {(r.id_a, r.id_b) for r in N.similar_pairs(df, 0.6, 3).collect()}
    assert got == brute(rows, 3, 0.6)
    assert {(r.id_a, r.id_b) for r in N.similar_pairs(df, name_col="file_name").collect()} == brute(rows, 5, 0.8)


def test_empty_and_repeats(spark):
    df = spark.createDataFrame([(1, "a", "un deux trois quatre"), (1, "a", "un deux trois quatre"), (None, "a", "un deux trois quatre"), (2, "a", "un deux trois quatre")], "id long, file_name string, extracted_text string")
    assert N.similar_pairs(df.limit(0), 0.6, 3).count() == 0
    assert [(r.id_a, r.id_b) for r in N.similar_pairs(df, 0.6, 3).collect()] == [(1, 2)]


def test_reference_table_loses_no_pair():
    """The coordinates differ by no more than the sets do."""
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 600, rng.integers(20, 200)).astype(np.uint64) << np.uint64(33)) for _ in range(60)]
    signer = N.Signer(N.topic_references(sets), 4)
    _, packed, _ = signer(sets)
    coordinates = np.stack([(packed.view(np.uint64)[:, j] >> np.uint64(16 * k)) & np.uint64(0xFFFF) for j in range(N.REFERENCES // 4) for k in range(4)], axis=1).astype(int)
    for i in range(60):
        for j in range(60):
            assert np.abs(coordinates[i] - coordinates[j]).max() <= len(np.setxor1d(sets[i], sets[j]))


def test_large_bands_are_paired_in_groups(spark, monkeypatch):
    """Every two members of a band meet exactly once, however it is cut."""
    keyed = spark.createDataFrame([(i, 7) for i in range(90)] + [(i, 8) for i in range(5)], "id long, band long")
    want = sorted([(a, b) for b in range(90) for a in range(b)] + [(a, b) for b in range(5) for a in range(b)])
    for size in (500, 20, 3):
        assert sorted((r.a, r.b) for r in N.band_pairs(keyed, size, 1).collect()) == want
    rows = table()
    df = spark.createDataFrame(rows, "id long, file_name string, extracted_text string")
    whole = {tuple(r) for r in N.similar_pairs(df, 0.6, 3).collect()}
    monkeypatch.setattr(N, "BAND_GROUP", 3)
    monkeypatch.setattr(N.band_pairs, "__defaults__", (None, 1))
    assert {tuple(r) for r in N.similar_pairs(df, 0.6, 3).collect()} == whole == brute(rows, 3, 0.6)
