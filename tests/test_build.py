import numpy as np
import pytest
from pyspark.sql import functions as F

from feuillet.functions import embedding as E
from feuillet.operators import build, fusion, metrics, search, vector
from feuillet.operators.lexical import bm25_scores
from feuillet.plans.cache import ResultCache
from feuillet.plans.shared import drop_shared, shared_dir, write_shared
from feuillet.sources import pages
from feuillet.sources.store import IndexStore

NONE = "relative_path string, file_name string, file_type string, modified_at string, content_hash string"


def files(spark, texts, stamp="1"):
    rows = [(p, p.rsplit("/", 1)[-1], ".txt", stamp, t.encode() if t is not None else b"") for p, t in texts.items()]
    return spark.createDataFrame(rows, "relative_path string, file_name string, file_type string, modified_at string, content binary").withColumn("content_hash", F.sha2("content", 256))


def read(df):
    return df.withColumn("text", F.decode("content", "utf-8"))


TEXTS = {"Banque/rib.txt": "Relevé de compte trimestriel et taux d'intérêt", "Paie/bulletin.txt": "Bulletin de paie du mois de mai", "loose.txt": "Contrat de travail à durée indéterminée " * 40, "Banque/vide.txt": ""}


def stored(store):
    index = build.load_index(store)
    return sorted((r.chunk_id, r.relative_path, r.chunk_no) for r in index.chunks.collect()), {r.chunk_id for r in index.vectors.collect()}


def test_sync(spark, tmp_path):
    store, none = IndexStore(spark, str(tmp_path / "index")), spark.createDataFrame([], NONE)
    with pytest.raises(ValueError):
        build.run_sync(store, files(spark, {"a.txt": ""}), read, none)
    first = build.run_sync(store, files(spark, TEXTS), read, none)
    assert (first.mode, first.documents_indexed, first.catalogue.count()) == ("complete", 3, 4)
    assert build.run_sync(store, files(spark, TEXTS), read, first.catalogue).mode == "unchanged"
    calls = []

    def counted(df):
        calls.append(sorted(r.relative_path for r in df.select("relative_path").collect()))
        return read(df)

    changed = {**TEXTS, "Paie/bulletin.txt": "Bulletin corrigé", "Paie/nouveau.txt": "Avenant au contrat"}
    del changed["Banque/rib.txt"]
    second = build.run_sync(store, files(spark, changed, "2"), counted, first.catalogue)
    assert (second.mode, second.documents_indexed, calls) == ("incremental", 3, [["Paie/bulletin.txt", "Paie/nouveau.txt"]])
    assert {(r.relative_path, r.change_type) for r in second.changes.collect()} == {("Banque/rib.txt", "deleted"), ("Paie/bulletin.txt", "updated"), ("Paie/nouveau.txt", "added")}
    assert {r.relative_path for r in second.catalogue.collect()} == set(changed)
    # The same as a full build of the new files.
    other = IndexStore(spark, str(tmp_path / "other"))
    build.full_build(other, files(spark, changed), read, none)
    assert stored(store) == stored(other)
    documents = read(files(spark, changed))
    assert build.validated(store, documents).count() == 0
    assert {(r.relative_path, r.problem) for r in build.validated(store, read(files(spark, {**changed, "Paie/nouveau.txt": "Autre texte", "x.txt": "neuf"}))).collect()} == {("Paie/nouveau.txt", "changed"), ("x.txt", "missing")}


def test_failed_increment_rebuilds(spark, tmp_path):
    store, none = IndexStore(spark, str(tmp_path / "index")), spark.createDataFrame([], NONE)
    first = build.run_sync(store, files(spark, TEXTS), read, none)
    tries = []

    def once_broken(df):
        tries.append(1)
        if len(tries) == 1:
            raise OSError("no disk")
        return read(df)

    report = build.run_sync(store, files(spark, {**TEXTS, "z.txt": "dernier"}), once_broken, first.catalogue)
    assert report.mode == "complete" and "no disk" in report.error and report.documents_indexed == 4


def test_versions_change_at_once(spark, tmp_path):
    store = IndexStore(spark, str(tmp_path / "index"))
    chunks = spark.createDataFrame([(1, "0012", "x"), (2, "2020", "y")], "chunk_id long, category string, text string")
    old = store.publish(chunks, {}, "m")
    held = store.load("chunks")
    store.replace_categories(chunks.where("chunk_id = 1").withColumn("text", F.lit("new")))
    assert {(r.category, r.text) for r in store.load("chunks").collect()} == {("0012", "new"), ("2020", "y")}
    assert {(r.category, r.text) for r in held.collect()} == {("0012", "x"), ("2020", "y")}  # readers of the old version are not disturbed
    store.drop_old_versions()
    assert store.manifest()["version"] != old and store.load("chunks").count() == 2 and not (tmp_path / "index" / old).exists()


def test_embedding(spark):
    rows = E.embed_texts(["contrat de travail", "relevé"])
    assert rows.shape == (2, 64) and np.allclose(np.linalg.norm(rows, axis=1), 1) and np.allclose(E.embed_query("relevé"), rows[1])
    for bad in (lambda: E.embed_texts([]), lambda: E.embed_query("  "), lambda: E.load_model("unknown"), lambda: E.with_embedding(spark.range(1), "id", "unknown")):
        with pytest.raises(ValueError):
            bad()
    E.register_model("broken", lambda: 1 / 0)
    with pytest.raises(ValueError):
        E.load_model("broken")
    assert E.load_model("hash-384") is E.load_model("hash-384")
    E.register_model("lengths", lambda: lambda texts: np.array([[len(t), 1.0] for t in texts]))
    got = E.with_embedding(spark.createDataFrame([("abc",), (None,)], "t string"), "t", "lengths").collect()
    assert got[0].vector == pytest.approx([3 / 10**0.5, 1 / 10**0.5]) and got[1].vector is None


def test_service(spark, tmp_path):
    store = IndexStore(spark, str(tmp_path / "index"))
    build.run_sync(store, files(spark, TEXTS), read, spark.createDataFrame([], NONE))
    service = search.SearchService(spark, build.load_index(store), store.manifest()["version"])
    assert service.search("bulletin de paie")["results"][0].relative_path == "Paie/bulletin.txt"
    assert service.search(" Bulletin de paie ") == service.search("bulletin de paie") and service.cache.stats()["hits"] == 2
    nothing = service.search("bulletin relevé", category="inconnue")
    assert nothing["results"] == [] and {r.relative_path for r in nothing["suggestions"]} <= set(TEXTS) and nothing["suggestions"]
    for bad in (lambda: service.search("x", 0), lambda: service.search("x", 51), lambda: service.search(" ")):
        with pytest.raises(ValueError):
            bad()


def test_cache_forgets_in_order_of_use():
    cache, made = ResultCache(most=2), []
    ask = lambda k: cache.fetch(k, lambda: made.append(k) or k)
    assert [ask(k) for k in "abacb"] == list("abacb") and made == list("abcb")
    with pytest.raises(ZeroDivisionError):
        cache.fetch("z", lambda: 1 / 0)
    assert "z" not in cache.entries


def test_cache_replay_counts_from_the_put(spark):
    rows = [(1, "a", 0), (2, "a", 200), (3, "a", 400), (4, "a", 400), (5, "a", 699), (6, "a", 700), (7, "b", 5), (8, "b", 305), (9, "b", None), (1, "a", 0)]
    df = spark.createDataFrame(rows, "history_id long, key string, s long").withColumn("ts", F.timestamp_seconds("s"))
    got = metrics.cache_replay(df).first()
    # a: put at 0, hit at 200, put at 400, hits at 400 and 699, put at 700; b: put at 5, put at 305
    assert (got.hits, got.misses, got.untimed) == (3, 5, 1)


def test_limits_run_before_the_shuffle(spark):
    chunks = spark.createDataFrame([(i, "c", f"c/{i}.txt", "f", ".txt", f"mot{i % 7} texte") for i in range(200)], "chunk_id long, category string, relative_path string, file_name string, file_type string, text string")
    from feuillet.operators.lexical import build_index

    index = fusion.SearchIndex(chunks, chunks.select("chunk_id", "category", F.array(F.col("chunk_id") % 5 + 1.0, F.lit(1.0)).alias("vector")), build_index(chunks))
    q = spark.createDataFrame([(1, "mot1 texte", 5, None, None)], search.QUERY_SCHEMA)
    for plan in (fusion.dense_ranks(index, q, [(1, [1.0, 0.5])]), fusion.lexical_ranks(index, q, bm25_scores(index.lexical, q))):
        text = plan._jdf.queryExecution().executedPlan().toString()
        assert "WindowGroupLimit" in text


def test_approximate_lists_reach_their_recall(spark):
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((40, 24))
    x = centres[rng.integers(0, 40, 4000)] + 0.4 * rng.standard_normal((4000, 24))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "chunk_id long, v array<double>")
    asked = [(i, x[i].tolist()) for i in range(0, 4000, 50)]
    pairs = lambda found: {(r.qid, r.chunk_id) for r in found.collect()}
    exact = pairs(vector.top_k(vector.best_cosines(df, asked, "v", ["chunk_id"], 10), 10, ["qid"]))
    found = pairs(vector.nearest_by_lists(df, asked, "v", 10, size=100))
    assert len(found & exact) >= 0.9 * len(exact)
    few = df.limit(50)
    assert pairs(vector.nearest_by_lists(few, asked[:1], "v", 3)) == pairs(vector.top_k(vector.best_cosines(few, asked[:1], "v", ["chunk_id"], 3), 3, ["qid"]))


def test_images(spark):
    rng = np.random.default_rng(3)
    logo = rng.integers(0, 256, (96, 64, 3), np.uint8)
    larger = logo.repeat(2, axis=0).repeat(2, axis=1)
    assert pages.fingerprint(logo) == pages.fingerprint(larger) != pages.fingerprint(255 - logo)
    rows = [("p", 0, 0, 64, 96, logo), ("p", 1, 0, 128, 192, larger), ("p", 1, 1, 5, 5, logo[:5, :5]), ("q", 7, 0, 300, 200, rng.integers(0, 256, (200, 300, 3), np.uint8)), ("q", 0, 0, 64, 96, logo), ("r", 0, 0, 9, 9, logo)]
    images = spark.createDataFrame([(*r[:5], bytearray(r[5].tobytes())) for r in rows], "path string, page_no int, position int, width int, height int, image binary").withColumn("fingerprint", pages.raw_fingerprint())
    assert [(r.path, r.has_raster, r.n_images) for r in pages.raster_flags(images).orderBy("path").collect()] == [("p", False, 3), ("q", False, 2), ("r", False, 1)]
    unique = pages.unique_images(images)
    assert sorted((r.path, r.page_no, r.position) for r in unique.collect()) == [("p", 0, 0), ("q", 0, 0), ("q", 7, 0)]
    texts = pages.recognise_once(unique, lambda data: f"{len(data)} octets")
    assert texts.count() == 2
    assert pages.recognise_once(unique, lambda data: 1 / 0).where("text <> ''").count() == 0
    assert {r.path: r.text for r in pages.image_text(unique, texts).collect()} == {"p": f"{64 * 96 * 3} octets", "q": f"{64 * 96 * 3} octets\n\n{300 * 200 * 3} octets"}


def test_documents(spark):
    text = spark.createDataFrame([("a", 1, "seconde page"), ("a", 0, "première page"), ("b", 0, "du texte"), ("c", 0, "1 2 3"), ("d", 0, None)], "path string, page_no int, native string")
    images = spark.createDataFrame([("b", 0, 0, 300, 300, bytearray(b"tampon")), ("c", 0, 0, 300, 300, bytearray(b"image"))], "path string, page_no int, position int, width int, height int, image binary").withColumn("fingerprint", F.md5("image"))
    rendered = spark.createDataFrame([("c", 1, bytearray(b"page deux")), ("c", 0, bytearray(b"page une")), ("a", 0, bytearray(b"jamais lue"))], "path string, page_no int, image binary")
    got = {r.path: (r.case, r.text) for r in pages.documents_text(text, images, lambda b: bytes(b).decode(), rendered).collect()}
    assert got == {"a": ("A", "première page\n\nseconde page"), "b": ("B", "du texte\ntampon"), "c": ("C", "1 2 3\npage une\npage deux"), "d": ("C", "")}


def test_animation(spark):
    frames = spark.createDataFrame([("g", i, 6, t) for i, t in enumerate(["un", "x", "x", "un", "x", "fin"])] + [("h", i, 2, t) for i, t in enumerate(["a", "b"])], "path string, frame_no int, n_frames int, text string")
    assert {r.path: r.text for r in pages.animation_text(frames).collect()} == {"g": "un\n\nfin", "h": "a\n\nb"}


def test_shared_folder(spark):
    kept = write_shared(spark.range(3).toDF("n"), "t")
    assert kept.count() == 3 and f"feuillet-{spark.sparkContext.applicationId}" in shared_dir(spark)
    drop_shared(kept)
    assert not [f for f in kept.inputFiles() if __import__("os").path.exists(f.removeprefix("file://"))]
