from pyspark.sql import functions as F

from feuillet.functions import text as T


def one(spark, expr, **values):
    names = list(values)
    df = spark.createDataFrame([tuple(values[n] for n in names)], ", ".join(f"{n} string" for n in names))
    return df.select(expr.alias("x")).first()[0]


def test_normalize_whitespace(spark):
    cases = {
        "a\r\nb\rc": "a\nb\nc", " a \t b\x0b\x0cc ": "a b c", "a\n\n\n\n b": "a\n\nb", " x ": "x", "": "", "a  \n  \n  b": "a\n\nb",
        "bonjour  le   monde": "bonjour le monde", "un\n\n\ndeux\n\n\n\n\ntrois": "un\n\ndeux\n\ntrois", "\u00a0dix\u2003": "dix",
    }
    for given, wanted in cases.items():
        assert one(spark, T.normalize_whitespace("t"), t=given) == wanted


def test_garbled(spark):
    assert one(spark, T.looks_garbled("t"), t="12 345 - 67 / 89 a") is True
    assert one(spark, T.looks_garbled("t"), t="un texte ordinaire") is False
    assert one(spark, T.looks_garbled("t"), t="") is False


def test_merge_layers(spark):
    assert one(spark, T.merge_text_layers("a", "b"), a="Un\nDeux", b="deux\nTrois\ntrois") == "Un\nDeux\nTrois"
    assert one(spark, T.merge_text_layers("a", "b"), a="", b="x\ny") == "x\ny"
    assert one(spark, T.merge_text_layers("a", "b"), a="x", b=None) == "x"


def test_tokenize(spark):
    assert one(spark, T.tokenize("t"), t="Le Congé ÉTÉ de l'œuvre, n° 12 ÷ 3") == ["congé", "été", "l", "uvre", "n", "12", "÷", "3"]
    assert one(spark, T.query_terms("t"), t="Congé ? a rib") == ["congé", "rib"]
    assert one(spark, T.query_terms("t"), t="?") == []


def test_category_and_suffix(spark):
    assert one(spark, T.category_of("t"), t="Banque\\2020\\a.pdf") == "Banque"
    assert one(spark, T.category_of("t"), t="a.pdf") == "_root"
    assert one(spark, T.is_supported("t"), t="x/A.PDF") is True
    assert one(spark, T.is_supported("t"), t="x/a.tif") is False


def test_preview(spark):
    text = "x" * 200 + " relevé " + "y" * 300
    got = one(spark, T.text_preview("t", T.query_terms(F.lit("relevé"))), t=text)
    assert got.startswith("…") and got.endswith("…") and "relevé" in got and len(got) <= 242
    assert one(spark, T.text_preview("t", T.query_terms(F.lit("?"))), t=text) == text[:240]


def test_account_functions(spark):
    assert one(spark, T.password_score("t"), t="Abcdefgh1234!") == 4
    assert one(spark, T.password_accepted("t"), t="abcdefgh") is False
    assert one(spark, T.initials("t"), t="  anne  marie dupont") == "AM"
    assert one(spark, T.initials("t"), t=None) is None or one(spark, T.initials("t"), t=None) == ""
    assert one(spark, T.epoch_date("t"), t="1647102218.0").isoformat() == "2022-03-12"
    assert one(spark, T.epoch_date("t"), t="soon") is None
    assert one(spark, T.french_percent(F.col("t").cast("double")), t="87.5") == "87,5 %"
    assert one(spark, T.highlight("t", "taux (fixe)"), t="Le TAUX (fixe)") == "Le <mark>TAUX</mark> <mark>(fixe)</mark>"
