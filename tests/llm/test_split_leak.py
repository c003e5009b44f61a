import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from feuillet.llm import leak, split
from feuillet.llm.words import fold, tokens, word_id, words


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab é.!?\n\r\t\f😀", max_size=3000), st.sampled_from([(900, 150), (40, 10), (50, 0)]))
def test_split_covers_everything(text, how):
    limit, overlap = how
    got = split.split_text(text, limit, overlap)
    whole = text.strip(split.TRIM)
    assert (not got) == (not whole) and all(0 < b - a <= limit and whole[a:b] == p for _, a, b, _, p in got)
    assert [n for n, *_ in got] == list(range(1, len(got) + 1))
    for (_, a, b, _, _), (_, c, d, _, _) in zip(got, got[1:]):
        assert a < c <= b < d and b - c <= overlap
    if got:
        assert got[0][1] == 0 and got[-1][2] == len(whole)


def test_boundaries():
    text = ("Une phrase assez courte. " * 20 + "\n\n") * 4
    kinds = [k for *_, k, _ in split.split_text(text)]
    assert kinds[-1] == "end" and set(kinds[:-1]) <= {"paragraph", "sentence"} and "paragraph" in kinds
    assert len(split.split_text("x" * 5000)) > 5


def test_marks_stay_with_their_letters():
    text = "e\u0301" * 2000
    got = split.split_text(text, 901, 0)
    assert "".join(p for *_, p in got) == text and all(p[0] == "e" and p[-1] == "\u0301" for *_, p in got)
    assert len(split.split_text("\u0301" * 2000)) > 1


def test_split_operator(spark):
    rows = [(1, None), (2, ""), (3, "a" * 900), (4, " \n" + "b " * 460 + "\t"), (4, "c" * 901), (5, "d " * 300_000)]
    df = spark.createDataFrame(rows, "id long, extracted_text string").selectExpr("*", "1 as passage_no")
    got = split.split_oversized(df).groupBy("id").count().collect()
    assert {r.id for r in got} == {4, 5} and split.split_oversized(df.limit(0)).count() == 0
    assert {r.id for r in split.split_oversized(df, only_oversized=False).collect()} == {3, 4, 5}


def plain_score(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(len(a)):
        for j in range(len(b)):
            h[i + 1, j + 1] = max(0, h[i, j] + (2 if a[i] == b[j] else -1), h[i, j + 1] - 1, h[i + 1, j] - 1)
    return h.max()


def test_smith_waterman_equals_the_plain_form():
    rng = np.random.default_rng(1)
    a = [rng.integers(0, 6, rng.integers(1, 30)).astype(np.uint64) for _ in range(50)]
    b = [rng.integers(0, 6, rng.integers(1, 30)).astype(np.uint64) for _ in range(50)]
    score, end = leak.smith_waterman(a, b, block=16)
    assert score.tolist() == [plain_score(x, y) for x, y in zip(a, b)]
    assert all(s == plain_score(x[:e], y) for s, e, x, y in zip(score, end, a, b))


def test_leaks_equal_brute_force(spark):
    rng = random.Random(6)
    vocabulary = [f"mot{i}é" for i in range(300)]
    items = [(k, " ".join(rng.choices(vocabulary, k=40))) for k in range(12)]
    docs = []
    for k in range(80):
        body = rng.choices(vocabulary, k=rng.randint(10, 120))
        if k % 2:
            w = rng.choice(items)[1].split()
            at, n = rng.randrange(20), rng.randint(8, 20)
            body[5:5] = w[at : at + n]
        docs.append((k, " ".join(body).upper() if k % 3 else " ".join(body).replace("é", "é")))
    docs += [(900, None), (901, ""), (902, items[0][1])]
    window = lambda t: {tuple(w[i : i + 13]) for w in [words(fold(t or ""))] for i in range(len(w) - 12)}
    want = {(d, i) for d, t in docs for i, x in items if window(t) & window(x)}
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' as item", "1 as score")
    held = spark.createDataFrame([*items, (50, None), (51, ""), (52, "trop court"), items[0]], "item_id long, text string")
    got = leak.leaked_items(df, held).where("longest_run >= 13")
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want and len(want) > 10
    assert leak.leaked_items(df, held.limit(0)).count() == 0 and leak.leaked_items(df.limit(0), held).count() == 0


def test_edited_copy_is_found(spark):
    item = "un deux trois quatre cinq six sept huit neuf dix onze douze treize quatorze quinze seize"
    edited = "début un deux trois quatre cinq six autre huit neuf dix onze douze treize rien quinze seize fin"
    got = leak.leaked_items(spark.createDataFrame([(1, edited)], "doc_id long, text string"), spark.createDataFrame([(7, item)], "item_id long, text string")).first()
    assert (got.doc_id, got.item_id, got.longest_run) == (1, 7, 6) and got.share > 0.7 and (got.start, got.end) == (1, 17)


def test_edited_copy_beside_a_verbatim_one_is_found(spark):
    words = [f"mot{i}" for i in range(40)]
    edited = [w if i % 8 != 7 else f"autre{i}" for i, w in enumerate(words)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(edited)), (3, "mot1 mot2 mot3 mot4 et rien de plus")], "doc_id long, text string")
    got = {r.doc_id: r for r in leak.leaked_items(docs, spark.createDataFrame([(7, " ".join(words))], "item_id long, text string")).collect()}
    assert set(got) == {1, 2} and got[2].longest_run == 7 and 0.7 < got[2].share < 1


def test_bounds_are_never_under_the_score():
    rng = np.random.default_rng(4)
    items = [rng.integers(0, 9, rng.integers(4, 30)).astype(np.uint64) for _ in range(40)]
    bounds = leak.ScoreBounds(items)
    for _ in range(20):
        text = rng.integers(0, 12, rng.integers(4, 40)).astype(np.uint64)
        chosen = rng.permutation(40)[:15].tolist()
        score, _ = leak.smith_waterman([text] * 15, [items[k] for k in chosen])
        assert (bounds(text, chosen) >= score).all()
    assert bounds(items[3], [5, 3]).tolist()[1] == 2 * len(items[3])


@pytest.mark.parametrize("every", [6, 5, 4])
def test_recall_of_edited_copies_beside_verbatim_ones(spark, every):
    """Twenty items, each once edited in every sixth, fifth or fourth word, with three verbatim copies in the same corpus."""
    rng = random.Random(every)
    vocabulary = [f"mot{i}" for i in range(900)]
    items = [(k, rng.choices(vocabulary, k=60)) for k in range(20)]
    docs = [(1000 + i, " ".join(rng.choices(vocabulary, k=150))) for i in range(100)]
    around = lambda w: " ".join([*rng.choices(vocabulary, k=20), *w, *rng.choices(vocabulary, k=20)])
    for k, w in items:
        docs += [(2000 + 10 * k + n, around(w)) for n in range(3)]
        docs.append((k, around([f"autre{i}" if i % every == every - 1 else x for i, x in enumerate(w)])))
    got = leak.leaked_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(k, " ".join(w)) for k, w in items], "item_id long, text string")).collect()
    pairs = {(r.doc_id, r.item_id) for r in got}
    assert sum((k, k) in pairs for k in range(20)) >= 18
    assert {(2000 + 10 * k + n, k) for k in range(20) for n in range(3)} <= pairs


def test_held_out_blocks_give_the_same(spark, monkeypatch):
    rng = random.Random(8)
    vocabulary = [f"mot{i}" for i in range(200)]
    items = [(k, " ".join(rng.choices(vocabulary, k=30))) for k in range(9)]
    docs = spark.createDataFrame([(k, "avant " + items[k % 9][1] + " après " + "et puis " * 50_000 * (k == 3)) for k in range(12)] + [(None, items[0][1])], "doc_id long, text string")
    held = spark.createDataFrame(items, "item_id long, text string")
    once = {tuple(r) for r in leak.leaked_items(docs, held).collect()}
    monkeypatch.setattr(leak, "BLOCK_CHARS", 500)
    assert {tuple(r) for r in leak.leaked_items(docs, held).collect()} == once and {(r[0], r[1]) for r in once} == {(k, k % 9) for k in range(12)} | {(None, 0)}


def test_tokens_equal_the_plain_form():
    rng = random.Random(2)
    alphabet = "ab é.Éàœ ﬁ½İΣς_-'ȩ́ 9²… —Ç한x😀𝐀ß\n"
    texts = ["".join(rng.choices(alphabet[: rng.randint(3, len(alphabet))], k=rng.randint(0, 60))) for _ in range(400)] + ["", None, "́", "́a"]
    for folded in (False, True):
        found = tokens(texts, folded)
        for k, t in enumerate(texts):
            assert found.of(k).tolist() == [word_id(w) for w in words(fold(t or "") if folded else t)]
