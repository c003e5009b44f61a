import random

import pytest

from feuillet.llm import mojibake as M

WORDS = "le délai de règlement prévu à l'annexe été précisé par la société cliente où l'intérêt général reçoit une pièce dès réception du dépôt contrôlé bientôt".split()


def corpus(n=400):
    rng = random.Random(1)
    return [" ".join(rng.choices(WORDS, k=60)) + "." for _ in range(n)]


@pytest.fixture(scope="module")
def judge():
    return M.fit(corpus())


@pytest.mark.parametrize("wrong, right", [("cp1252", "utf-8"), ("mac_roman", "utf-8"), ("cp850", "utf-8"), ("cp1251", "cp1252"), ("cp850", "cp1252"), ("cp1252", "cp850"), ("mac_roman", "cp1252")])
def test_round_trip(judge, wrong, right):
    text = corpus(450)[-1]
    bad = text.encode(right).decode(wrong)
    fixed, used, gain = judge.repair(bad)
    assert fixed == text and used and gain > judge.margin


def test_twice_and_partly(judge):
    a, b = corpus(460)[-2:]
    twice = b.encode().decode("cp1252").encode().decode("cp1252")
    assert judge.repair(a + " " + twice)[0] == a + " " + b


def test_held_out_accuracy(judge):
    rng = random.Random(2)
    clean = corpus(900)[500:]
    assert sum(judge.passes(*judge.best_chain(t)) for t in clean) == 0
    found = 0
    for t in clean:
        words = t.split(" ")
        k = rng.choice([i for i, w in enumerate(words) if not w.isascii()])
        words[k] = words[k].encode().decode("cp1252")
        found += judge.passes(*judge.best_chain(" ".join(words)))
    assert found >= 0.97 * len(clean)


def test_names_stay(judge):
    for t in ("João Sãntrel à São Vurela", "COMISSÃO DE NAÇÃO", "Торговый дом", "Žarnik & Škodar", "21 °C ± 2, soit ½ degré", "Ångelby et Ørnsvik"):
        assert judge.repair(t)[1] == []


def test_operator(spark):
    rows = [(i, t, "x") for i, t in enumerate(corpus(150))]
    rows += [(500, None, "x"), (501, "", "x"), (502, "plain ascii", "x"), (503, "dépôt prévu à l'été".encode().decode("cp1252"), "x"), (503, "le délai à la société", "x"), (504, "d�lai prévu", "x"), (505, "é" * 200_000, "x")]
    df = spark.createDataFrame(rows, "id long, extracted_text string, repaired string")
    got = {r.id: r for r in M.repair_encoding(df).collect()}
    assert set(got) == {503, 504} and got[503].repaired == "dépôt prévu à l'été" and got[504].lost == 1
    assert M.repair_encoding(df, only_found=False).count() == len(rows)
    assert M.repair_encoding(df.limit(0)).count() == 0


def test_lost_letters_that_were_encoded_again(judge):
    """U+FFFD itself read in a wrong encoding is damage, with a letter gone for good."""
    text = corpus(470)[-1]
    at = text.index("é")
    bad = text[:at] + "\ufffd".encode().decode("cp1252") + text[at + 1 :] 
    fixed, used, _ = judge.repair(bad)
    assert used and fixed == text[:at] + "\ufffd" + text[at + 1 :]
    assert judge.fill_lost("société d\ufffdlai")[-5:] == "délai" and set("éèà") <= set(judge.letters)


def test_model_and_margin_are_of_all_texts(spark):
    """More texts than the 3,000 that the model once was bounded to; a letter that stands in a few of them is counted in each."""
    texts = [f"{t} {k}" + " Łódź" * (k % 300 == 7) for k, t in enumerate(" ".join(random.Random(k).choices(WORDS, k=8)) for k in range(3600))]
    texts.append(texts[0].encode().decode("cp1252"))
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    judge = M.train_judge(df, "t")
    held = {r[0] for r in df.where(f"pmod(xxhash64(t, length(t)), {M.FOLDS}) = 0").collect()}
    rest = [t for t in texts[:-1] if t not in held]
    assert judge.model.tables == M.NgramModel.train(rest).tables
    assert judge.model.tables[1][ord("Ł")] == sum("Ł" in t for t in rest) > 0
    gains = sorted(judge.best_chain(t)[1] for t in texts[:-1] if t in held)
    assert judge.margin == max(4.0, gains[int(0.998 * (len(gains) - 1))] + 0.5)
