import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from feuillet.llm import mixture, residue


def test_rake_meets_the_sources():
    rng = np.random.default_rng(0)
    tokens = rng.integers(100, 5000, 60).astype(float)
    source, lang, topic = rng.integers(0, 4, 60), rng.integers(0, 3, 60), rng.integers(0, 5, 60)
    wanted = np.array([0.1, 0.2, 0.3, 0.4]) * tokens.sum()
    most = np.array([3.0, 1.0, 2.0, 5.0])
    w = mixture.rake(tokens, source, lang, topic, wanted, most)
    size = np.bincount(source, tokens, 4)
    assert np.bincount(source, w * tokens, 4) == pytest.approx(np.minimum(wanted, most * size), rel=1e-6)
    assert (w <= most[source] + 1e-9).all() and (w >= 0).all()


def corpus(spark):
    rows = [(i, f"texte numéro {i} " + "é" * (i % 40), ["fr", "en", None][i % 3], [" A", "a", "B", None][i % 4], "t" + str(i % 5)) for i in range(4000)]
    return spark.createDataFrame(rows + [(9000, None, "fr", "a", "t1"), (9001, "", None, "b", None)], "doc_id long, text string, lang string, source string, category string").withColumn("copies", F.lit("clash"))


def test_mixture(spark):
    df = corpus(spark)
    targets = spark.createDataFrame([("a", 0.4, 1), ("b", 0.5, 3), ("leer", 0.1, 5)], "source string, target_share double, max_repeats int")
    report = {r.source: r for r in mixture.mixture_report(df, targets).collect()}
    assert report["leer"].short and report["leer"].drawn_tokens == 0 and not report["a"].short and not report["b"].short
    total = df.agg(F.sum(F.octet_length("text"))).first()[0]
    for s in "ab":
        assert report[s].drawn_tokens == pytest.approx(report[s].target_share * total, rel=0.05) and report[s].most_copies <= report[s].max_repeats
    assert sum(r.actual_share for r in report.values()) == pytest.approx(1)
    a, b = ({(r.doc_id, r.copies) for r in mixture.mix_sources(df.repartition(n), targets).collect()} for n in (2, 7))
    assert a == b
    assert [r.source for r in mixture.unreachable_sources(df, targets).collect()] == ["leer"]
    assert mixture.mix_sources(df.limit(0), targets).count() == 0 and mixture.mixture_report(df.limit(0), targets).count() == 3


REAL = "Le service examine la demande du client. La réponse est envoyée avant la fin du mois. Le dossier est complet."
CASES = {
    1: ("Madame, Monsieur {{nom}}, votre dossier est prêt. " + REAL, True), 2: ("Fait à [VILLE À\nCOMPLÉTER], le XX/XX/XXXX. " + REAL, True), 3: ("Lettre au %NOM%. " + REAL, True),
    4: ("Erreur 404\nLa page demandée est introuvable ou a été déplacée.", True), 5: ("Veuillez activer JavaScript pour afficher ce document.\nAccueil | Aide", True),
    6: ("Rapport annuel\nLorem ipsum dolor sit amet consectetur. Velit nulla magna sapien mauris lacus.", True), 7: ("bla bla bla bla", True), 8: ("VOTRE SESSION A EXPIRÉ, VEUILLEZ VOUS RECONNECTER.", True),
    20: (REAL, False), 21: (REAL + " L'usager signale « accès refusé » à l'écran.", False), 22: ("La citation est telle quelle [sic], voir note [3] et l'ensemble {x, y}. " + REAL, False), 23: (None, False), 24: ("", False),
    25: ("Réponse <interne> de Paul : remise de 10 % pour 100 $ de frais. " + REAL, False), 26: ("Merci.", False), 27: (REAL * 3000, False), 28: ("Bad gateway\nService momentanément indisponible, réessayez plus tard.", True),
}


def test_residue(spark):
    df = spark.createDataFrame([(k, t, f"s{k % 3}") for k, (t, _) in CASES.items()] + [(4, CASES[4][0], None)], "doc_id long, text string, source string").withColumn("kind", F.lit("clash")).withColumn("form", F.lit(1))
    got = {r.doc_id for r in residue.classify_residue(df).collect()}
    assert got == {k for k, (_, bad) in CASES.items() if bad}
    assert {r.doc_id for r in residue.without_residue(df).collect()} == {k for k, (_, bad) in CASES.items() if not bad}
    assert residue.classify_residue(df.limit(0)).count() == 0


def test_recurring_messages_need_several_sources(spark):
    odd = "Consultez le navigateur interne de la base"
    rows = [(i, odd, f"s{i % 4}") for i in range(40)] + [(100 + i, "Consultez le serveur voisin", "s1") for i in range(40)]
    got = {r.doc_id for r in residue.classify_residue(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got == set(range(40))


def test_every_text_is_judged(spark):
    latin = "Ut enim ad minim veniam, quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat."
    rows = [(1, latin, "s1"), (2, REAL, "s1")] + [(100 + i, "Modèle introuvable au guichet", f"s{i % 4}") for i in range(40)]
    got = {r.doc_id for r in residue.classify_residue(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got == {1, *range(100, 140)}


def test_null_ids_are_told_apart(spark):
    df = spark.createDataFrame([(None, CASES[4][0], "a"), (None, REAL, "a"), (None, None, "b"), (7, REAL, None), (7, CASES[5][0], "b")], "doc_id long, text string, source string")
    assert sorted((r.doc_id or 0, r.text or "") for r in residue.without_residue(df).collect()) == sorted([(0, REAL), (0, ""), (7, REAL)])


CUES = "erreur error indisponible unavailable introuvable maintenance script javascript cookie cookies navigateur browser session exception timeout serveur server exemple sample template modèle placeholder accueil".split()


def test_every_cue_word_is_grouped(spark):
    """A short message with each cue word that recurs in several sources is found, and the same in one source or within real texts is not."""
    message, quoted = "Consultez le {} voisin du guichet", "Voyez donc le {} de la mairie."
    rows = [(1000 * n + i, message.format(cue), f"s{i % 4}") for n, cue in enumerate(CUES) for i in range(25)]
    rows += [(1_000_000 + 1000 * n + i, message.format(cue).replace("voisin", "proche"), "s1") for n, cue in enumerate(CUES) for i in range(25)]
    rows += [(2_000_000 + 1000 * n + i, REAL + " " + quoted.format(cue), f"s{i % 4}") for n, cue in enumerate(CUES) for i in range(25)]
    found = residue.classify_residue(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert {r.doc_id for r in found} == {1000 * n + i for n in range(len(CUES)) for i in range(25)} and all(r.recurring for r in found)


def test_recurrence_decides(spark):
    """The same message beside a title counts where it recurs, and not where it stands once under real text."""
    text = "Note de service\nLa procédure est prête. Une erreur est survenue."
    one = spark.createDataFrame([(1, text, "a"), (2, REAL, "b")], "doc_id long, text string, source string")
    two = one.unionByName(spark.createDataFrame([(3, "Une erreur est survenue.", "b")], one.schema))
    assert [r.doc_id for r in residue.classify_residue(one).collect()] == []
    assert sorted(r.doc_id for r in residue.classify_residue(two).collect()) == [1, 3]


def test_literals_lose_no_rule():
    """Looking at the literals first gives what trying every rule gives."""
    kinds = residue.Kinds()
    forms = [residue.mask(p) for t, _ in CASES.values() if t for p in residue.CUT.split(t[:3000])]
    forms += [f"avant {s} après" for _, rule in residue.RULES for s in residue.stems(rule.pattern)] + [s for _, rule in residue.RULES for s in residue.stems(rule.pattern)]
    forms += [f"{a} {b}." for a in ("erreur", "page", "la page demandée", "veuillez activer", "votre session a", "bad gateway") for b in ("#", "javascript", "expiré", "est indisponible", "status", "introuvable")]
    for f in forms:
        plain = next((k for k, rule in residue.RULES if rule.fullmatch(f) and (k != "menu" or len(f) < 80)), None)
        assert kinds(f) == (plain, residue.CUE.search(f) is not None)


def test_cells_are_fitted_alike_where_they_lie(spark):
    """Many levels of topics, fitted on the driver and as a table, give the same draw."""
    rows = [(i, "x" * (50 + i % 300), ["fr", "en", None][i % 3], ["a", "b", None][i % 7 % 3], "t" + str(i % 200)) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, category string")
    targets = spark.createDataFrame([("a", 0.7, 1), ("b", 0.2, 2), (None, 0.1, 3)], "source string, target_share double, max_repeats int")
    here, there = mixture.plan_mixture(df, targets), mixture.plan_mixture(df, targets, driver_cells=10)
    assert {r.source: (r.size_tokens, r.short, round(r.fitted_tokens / r.wanted_tokens, 6)) for r in here.limits.collect()} == {r.source: (r.size_tokens, r.short, round(r.fitted_tokens / r.wanted_tokens, 6)) for r in there.limits.collect()}
    weights = [{(r.source, r.lang, r.topic): r.copies for r in m.cells.collect()} for m in (here, there)]
    assert weights[0].keys() == weights[1].keys() and len(weights[0]) > 600 and all(weights[0][k] == pytest.approx(weights[1][k], rel=1e-6) for k in weights[0])


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_shares_of_the_test_tables(spark):
    """Sources that can reach their share do so within the tokens of a few rows; short ones stand at their most copies."""
    read = lambda t: spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet")
    report = mixture.mixture_report(read("documents"), read("source_targets")).collect()
    longest = read("documents").agg(F.max(F.octet_length("text"))).first()[0]
    for r in report:
        if r.short:
            assert r.drawn_tokens == r.max_repeats * r.size_tokens
        else:
            assert r.fitted_tokens == pytest.approx(r.wanted_tokens, rel=1e-5)
            assert abs(r.drawn_tokens - r.wanted_tokens) <= 3 * longest * max(1, r.drawn_rows) ** 0.5 * 0.5
    assert sum(r.actual_share for r in report) == pytest.approx(1)
