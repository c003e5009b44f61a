import os
import random

import pytest

from feuillet.llm import ocr as O

SENTENCES = ["Le conservateur précise le bordereau de versement au cours de la visite.", "Le registre relié est numérisé par le prestataire avant la fin du mois.", "La commission examine la demande du responsable et confirme le règlement.", "Restent à traiter la copie certifiée et le feuillet manquant du service technique.", "Le montant retenu pour le marché est prévu dans les locaux de l'établissement."]


def corpus(n=300):
    rng = random.Random(3)
    out = []
    for k in range(n):
        lines = []
        for _ in range(rng.randint(6, 14)):
            lines.append(rng.choice(SENTENCES))
        out.append(("Slide 1\n" if k % 10 == 0 else "") + "\n".join(lines))
    return out


@pytest.fixture(scope="module")
def cleaner():
    return O.fit(corpus())


def test_words(cleaner):
    for bad, good in (("rnois", "mois"), ("c0nservateur", "conservateur"), ("refenu", "retenu"), ("régIement", "règlement"), ("bordcreau", "bordereau"), ("numér!sé", "numérisé")):
        assert cleaner.word(bad) == good
    for fine in ("conservateur", "RJ45", "4x4", "2bis", "U1000", "B32.727", "inconnu"):
        assert cleaner.word(fine) == fine


def test_cuts(cleaner):
    text, n = cleaner.clean("Le conservateur précise le borde-\nreau de versement au cours de la visite.")
    assert text == "Le conservateur précise le bordereau de versement au cours de la visite." and n["cuts"] == 1
    assert "conservateur" in cleaner.clean("Le conser­\nvateur précise.")[0]


def test_furniture(cleaner):
    pages = []
    for k in range(4):
        pages += ["DIRECTION DES ARCHIVES", SENTENCES[k][:40], f"— {k + 3} —"]
        pages += []
    text = "\n".join(x for k in range(4) for x in ("DIRECTION DES ARCHIVES", SENTENCES[k], SENTENCES[(k + 1) % 5][:35], f"— {k + 3} —"))
    cleaned, n = cleaner.clean(text)
    assert n.get("numbers") == 4 and "— 3 —" not in cleaned and n.get("headers", 0) >= 3


def test_design_stays(cleaner):
    text = "Slide 1\nTitre\nSlide 2\nTitre\nSheet: Feuille 3\nLibellé | Référence\na | b\nSheet: Feuille 4\nLibellé | Référence\nc | d"
    cleaned, n = cleaner.clean(text)
    assert not any(n.values()) and cleaned.count("Libellé") == 2


def test_operator(spark):
    rows = [(i, t, 0) for i, t in enumerate(corpus(120))] + [(900, None, 0), (901, "", 0), (902, " \n ", 0), (903, SENTENCES[0].replace("bordereau", "bor¬\ndereau"), 0), (903, SENTENCES[0], 0), (904, SENTENCES[1] * 2000, 0)]
    df = spark.createDataFrame(rows, "id long, extracted_text string, cuts int")
    got = O.clean_scans(df).collect()
    assert [r.id for r in got] == [903] and got[0].cleaned == SENTENCES[0]
    assert O.clean_scans(df, only_found=False).count() == len(rows) and O.clean_scans(df.limit(0)).count() == 0


def test_words_are_counted_in_all_texts(spark):
    texts = corpus(60) + ["Le greffier range la quittance."] * 12 + ["Le greffier range la quiffance."]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, extracted_text string")
    sample = O.train_cleaner(df, "extracted_text", rows=20)
    counts = [sum(t.split().count(w) for t in texts) for w in ("quittance.", "registre")]
    assert [sample.counts.get(w, 0) for w in ("quittance", "registre")] == counts and counts[0] == 12


def test_rare_word_outside_the_sample_is_repaired(spark):
    texts = corpus(60) + ["Le greffier range la quittance."] * 12 + ["Le greffier range la quitfance."]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, extracted_text string")
    assert O.train_cleaner(df, "extracted_text", rows=20).word("quitfance") == "quittance"


def test_scripts_of_operations():
    assert O.script("rn", "m") == ["replace m", "delete"] and O.script("m", "rn") == ["replace r insert n"] and O.script("l", "l'") == ["keep insert '"]
    rng = random.Random(0)
    for word in ("commune", "ordinaire", "l'annexe", "village"):
        for _ in range(20):
            bad = O.damage_word(word, rng)
            assert bad is None or len(bad[0]) == len(bad[1])


def test_title_is_kept(cleaner):
    title = "Registre des archives"
    body = [" ".join(SENTENCES[k % 5].split()[k // 5 :]) for k in range(9)]
    text = "\n".join([title, *body[:3], title.upper(), *body[3:6], title.upper(), *body[6:]])
    cleaned, n = cleaner.clean(text)
    assert cleaned.startswith(title) and n.get("headers") == 2 and title.upper() not in cleaned
    again, more = cleaner.clean(cleaned)
    assert again == cleaned and not more.get("headers")


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def character_error(cleaner, texts, share, rng):
    """Character errors of damaged texts, before and after cleaning, against the texts themselves; and words wrongly edited."""
    before = after = size = touched = 0
    for t in texts:
        words = O.WORD.findall(t)
        for w in words:
            bad = O.damage_word(w, rng) if rng.random() < share and cleaner.is_editable(w) else None
            read = bad[0] if bad else w
            got = cleaner.word(read)
            before, after, size = before + distance(read, w), after + distance(got, w), size + len(w)
            touched += bad is None and got != w
    return before / size, after / size, touched


def test_character_error_falls(cleaner):
    before, after, touched = character_error(cleaner, corpus(400)[300:], 0.1, random.Random(9))
    assert before > 0.01 and after < 0.25 * before and touched == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_character_error_of_held_out_records():
    """Trained on three quarters of the catalogue, measured on clean-looking records of the last quarter."""
    import pyarrow.parquet as pq

    texts = [t for t in pq.read_table("/root/testdata/sf0.01/ged_documents.parquet", columns=["extracted_text"])["extracted_text"].to_pylist() if t]
    cut = 3 * len(texts) // 4
    cleaner = O.fit(texts[:cut])
    held = [t for t in texts[cut:] if not any(cleaner.clean(t)[1].values())]
    before, after, touched = character_error(cleaner, held, 0.05, random.Random(3))
    print(f"character error {before:.4f} before, {after:.4f} after, {touched} words wrongly edited in {len(held)} texts")
    assert after < 0.35 * before and touched <= 0.0005 * sum(len(O.WORD.findall(t)) for t in held)


def test_models_are_of_all_texts(spark):
    """Character sequences, training words and lessons on lines come from every text, how many there are."""
    texts = corpus(60) + ["Le greffier range la quittance."] * 12
    df = spark.createDataFrame([(t,) for t in texts], "t string").repartition(3)
    got, whole = O.train_cleaner(df, "t", rows=20), O.fit(texts)
    assert got.ngrams.tables == O.NgramModel.train([" ".join(t.split()) for t in texts]).tables
    assert got.page.weights and got.page.weights == whole.page.weights
    assert O.train_cleaner(df, "t").editor.weights == whole.editor.weights


def test_scanned_texts_teach_nothing_about_pages():
    text = "\n".join(["Registre des actes", *SENTENCES[:2], "Second titre", *SENTENCES[2:4], "Registre des actes", "Second titre", "Troisième", SENTENCES[4], "Troisième"])
    assert list(O.page_lessons(text)) and not list(O.page_lessons(text + "\nle borde-\nreau"))
