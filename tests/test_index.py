import math

import pytest

from feuillet.functions.chunking import explode_passages, passages
from feuillet.operators import fusion, lexical, sync, vector
from feuillet.plans.cache import ResultCache
from feuillet.plans.numbering import number_rows
from feuillet.sources.store import IndexStore


def test_passages():
    assert passages(None) == [] and passages("  \n ") == [] and passages(" a ") == ["a"]
    text = "\n".join("ligne numéro %d du document" % i for i in range(200))
    got = passages(text)
    assert all(len(p) <= 900 for p in got) and got[0].startswith("ligne numéro 0") and got[-1].endswith("199 du document")
    assert "".join(passages("x" * 2000)).count("x") == 900 + 900 + 500


def test_explode_keeps_columns(spark):
    df = spark.createDataFrame([(1, "x" * 1000), (2, None), (3, "")], "id long, text string")
    assert [(r.id, r.chunk_no) for r in explode_passages(df, "text").orderBy("id", "chunk_no").collect()] == [(1, 0), (1, 1)]


def test_number_rows(spark):
    df = spark.range(1000).selectExpr("id % 7 as a", "id as b")
    rows = sorted(number_rows(df, ["a", "b"], "n").collect(), key=lambda r: r.n)
    assert [r.n for r in rows] == list(range(1, 1001)) and [(r.a, r.b) for r in rows] == sorted((r.a, r.b) for r in rows)


def literal_bm25(docs, query):
    n = len(docs)
    avgdl = sum(map(len, docs)) / n
    out = []
    for d in docs:
        s = 0
        for t in set(query):
            df = sum(t in x for x in docs)
            if df:
                tf = d.count(t)
                s += math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(d) / avgdl))
        out.append(s)
    return out


CORPUS = ["contrat bail location appartement loyer", "facture electricite consommation kwh montant", "releve bancaire compte solde virement", "bulletin salaire net brut cotisation", "assurance habitation sinistre garantie", "bail commercial loyer charges"]


def index_of(spark):
    chunks = spark.createDataFrame([(i + 1, f"C{i % 2}/d{i}.pdf", f"d{i}.pdf", ".pdf", f"C{i % 2}", t) for i, t in enumerate(CORPUS)], "chunk_id long, relative_path string, file_name string, file_type string, category string, text string")
    vectors = spark.createDataFrame([(i + 1, f"C{i % 2}", [1.0 if j == i else 0.1 for j in range(6)]) for i in range(6)], "chunk_id long, category string, vector array<float>")
    return fusion.SearchIndex(chunks, vectors, lexical.build_index(chunks))


def test_bm25(spark):
    index = index_of(spark)
    q = spark.createDataFrame([(1, "bail loyer loyer")], "qid long, query string")
    got = {r.chunk_id: r.score for r in lexical.bm25_scores(index.lexical, q).collect()}
    want = literal_bm25([c.split() for c in CORPUS], ["bail", "loyer"])
    assert got == {i + 1: pytest.approx(s, abs=1e-8) for i, s in enumerate(want) if s}


def test_hybrid_ranks_the_exact_document_first(spark):
    index = index_of(spark)
    q = spark.createDataFrame([(1, "bail commercial", 3, None, None), (2, "facture", 5, "C1", None), (3, "facture", 5, None, ".docx")], "qid long, query string, top_k int, category string, file_type string")
    asked = [(i, [1.0 if j == 5 else 0.1 for j in range(6)]) for i in (1, 2, 3)]
    rows = fusion.hybrid_search(index, q, asked).collect()
    by = {(r.qid, r["rank"]): r for r in rows}
    assert by[1, 1].relative_path == "C1/d5.pdf" and by[1, 1].relevance >= 90 and "bail commercial" in by[1, 1].text_preview
    assert all(r.category == "C1" for r in rows if r.qid == 2) and not [r for r in rows if r.qid == 3]


def test_vectors(spark):
    df = spark.createDataFrame([(1, [3.0, 4.0]), (1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, [float("nan"), 1.0]), (4, None), (5, [1.0]), (6, [1.0, 0.0])], "chunk_id long, chunk_vectors array<float>")
    good = vector.usable_vectors(df, 2)
    assert sorted(r.chunk_id for r in good.collect()) == [1, 6]
    near = vector.top_k(vector.cosines(good, [(9, [1.0, 0.0])], "chunk_vectors", ["chunk_id"]), 1, ["qid"]).first()
    assert (near.chunk_id, near.cosine) == (6, 1.0)


def test_incremental_equals_full(spark):
    before = spark.createDataFrame([("a/1", "h1", "t1"), ("a/2", "h2", "t2"), ("b/3", "h3", "t3")], "relative_path string, content_hash string, text string")
    after = spark.createDataFrame([("a/1", "h1", "t1"), ("a/2", "hx", "t2 new"), ("b/4", "h4", "t4")], "relative_path string, content_hash string, text string")
    changes = sync.detect_changes(after, before)
    assert {(r[0], r[1]) for r in changes.collect()} == {("a/2", "updated"), ("b/4", "added"), ("b/3", "deleted")}
    full = explode_passages(after.drop("content_hash"), "text")
    part = sync.rebuild_chunks(explode_passages(before.drop("content_hash"), "text"), changes, full)
    key = lambda df: sorted(tuple(r) for r in df.select("relative_path", "chunk_no", "text").collect())
    assert key(part) == key(full)
    assert sync.delete_not_in(before, after.limit(0)).count() == 3


def test_store(spark, tmp_path):
    store = IndexStore(spark, str(tmp_path / "index"))
    assert store.manifest() is None
    with pytest.raises(FileNotFoundError):
        store.load("chunks")
    chunks = spark.createDataFrame([(1, "A B", "x"), (2, "A_B", "y")], "chunk_id long, category string, text string")
    store.publish(chunks, {"extra": chunks.select("chunk_id")}, "hash")
    assert store.manifest()["categories"] == ["A B", "A_B"] and store.load("chunks").count() == 2
    store.replace_categories(chunks.where("chunk_id = 1").selectExpr("chunk_id + 10 as chunk_id", "category", "text"))
    assert sorted(r.chunk_id for r in store.load("chunks").collect()) == [2, 11]
    store.drop_category("A_B")
    assert [r.chunk_id for r in store.load("chunks").collect()] == [11]


def test_cache():
    now = [0.0]
    cache = ResultCache(most=2, ttl=10, clock=lambda: now[0])
    a = cache.key(" RIB ", 5)
    assert a == cache.key("rib", 5) and a != cache.key("rib", 6) and cache.get(a) is None
    cache.put(a, [1])
    assert cache.get(a) == [1]
    now[0] = 10.0
    assert cache.get(a) is None and cache.stats()["misses"] == 2
    for k in "xyz":
        cache.put(k, k)
    assert list(cache.entries) == ["y", "z"]


def test_best_cosines_are_the_top_k_of_all(spark):
    rows = spark.createDataFrame([(i, i % 3, [float((i * 7) % 11), float(i % 5), 1.0]) for i in range(200)], "chunk_id long, label int, v array<double>")
    asked = [(i, [float(i), 1.0, float(i % 2)]) for i in range(7)]
    for by in (None, "label"):
        keys = ["qid", *([by] if by else [])]
        want = vector.top_k(vector.cosines(rows, asked, "v", ["chunk_id", "label"]), 4, keys).collect()
        best = vector.best_cosines(rows, asked, "v", ["chunk_id", "label"], 4, by, block=3)
        assert sorted(vector.top_k(best, 4, keys).collect()) == sorted(want)
        assert best.count() < 7 * 200


def test_every_50th_vector_asks(spark):
    from feuillet.queries import QUERIES

    d = "/root/testdata/sf0.001"
    ids = {r[0] for r in spark.read.parquet(f"{d}/embeddings.parquet").where("vec_id % 50 = 0").select("vec_id").collect()}
    for name in ("dense_topk_50", "dense_topk_per_shard_50"):
        assert {r.qid for r in QUERIES[name](spark, d).select("qid").distinct().collect()} == ids and len(ids) > 4
