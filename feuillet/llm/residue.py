"""Template residue, filler and error pages.

A text is cut into segments (lines, sentences, menu entries). Numbers, addresses and dates in a segment are masked, filler
vocabulary and repeated words collapse to one sign, and the exact masked form is hashed. Forms are grouped over all rows
and sources. A form that recurs is a message by its phrase (error, script notice, filler), or by a mere cue word if it
recurs widely, in several sources and mostly in texts with nothing else; a form that stands only once has to fill its
text. Placeholder rules look at the whole text. Whether a phrase or cue stands in a form depends on nothing but the form,
so that is looked at before the grouping, and only such forms are shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from re import _parser

import ahocorasick
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feuillet.plans.shared import write_shared
from feuillet.plans.spread import spread

# Forms of placeholders in common template languages and office forms.
PLACEHOLDERS = (
    r"\{\{[^{}]{1,80}\}\}",
    r"\[\[[^\[\]]{1,80}\]\]",
    r"\$\{[^{}]{1,80}\}",
    r"<%[^%]{1,80}%>",
    r"<<[^<>]{1,60}>>",
    r"\{%[^%]{1,80}%\}",
    r"%%?[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)*%%?(?![0-9])",
    r"#[A-Z][A-Z0-9]+(?:_[A-Z0-9]+)*#",
    r"(?<![\w.])@[a-z][a-z0-9]+(?:_[a-z0-9]+)*@(?!\w)",
    r"«[A-Z][A-Z0-9]+(?:_[A-Z0-9]+)*»",
    r"\{[a-z][a-z0-9]{2,}(?:_[a-z0-9]+)*\}",
    r"(?i:\[[^\[\]]{0,60}\b(?:à\s+compléter|a\s+completer|à\s+remplir|à\s+préciser|to\s+be\s+completed|to\s+complete|fill\s+in|tbd)\s*\])",
    r"(?i:\[\s*(?:insérer|inserer|insert|indiquer|saisir|renseigner|your|votre)\s[^\[\]]{1,60}\])",
    r"(?i:<[^\W\d][\w ]{1,40}\s(?:ici|here)>)",
    r"\bXX?[/.-]XX?[/.-]XX(?:XX)?\b",
    r"_{5,}",
)
PLACEHOLDER = re.compile("|".join(f"(?:{p})" for p in PLACEHOLDERS))
OPENING = re.compile(r"[{\[$<%#@«X_]")  # every placeholder begins with one of these
# Openings of whole messages. They are matched against a whole segment, case ignored.
ERRORS = (
    r"(?:erreur|error|http(?: status| error)?|status)(?: n°)?[ :]*#( - .*)?",
    r"(?:http )?(?:status|error|erreur)? ?# ?[-–:]? ?(?:not found|forbidden|bad gateway|internal (?:server )?(?:error|problem)|service unavailable|gateway time-?out|bad request|unauthorized)",
    r"(?:bad gateway|not found|forbidden|gateway time-?out|service unavailable|internal server error|request blocked|access denied|page not found|too many requests)",
    r"(?:bad gateway|not found|forbidden|service unavailable|request blocked\.?|(?:http status|erreur|error) #|code incident : #) .*\b(?:traceback|indisponible|introuvable|expiré|impossible|dépassé|refusé|fatal|exception|incident|gateway|status|erreur|unavailable|denied)\b.*",
    r"incident id.*", r"code (?:d')?incident.*", r"(?:request|error|trace) id.*",
    r"traceback \(.*", r"(?:file|at) [\w./<>]+, line #.*", r"(?:fatal|warning|exception|error|uncaught)[ :].* on line #", r"fatal: .*",
    r"unhandled exception.*", r"at [\w.<>$]+:#(?: at [\w.<>$]+:#)*", r"memory exhausted.*", r"stack ?trace.*",
    r"(?:la )?page (?:demandée |web )?(?:est |n'existe|n'a pas).*", r"(?:the )?(?:requested )?(?:page|url|resource) (?:was not|could not|cannot|you).*",
    r"(?:ce |le )?(?:service|site|serveur) (?:est )?(?:momentanément |temporairement )?(?:indisponible|en maintenance).*", r"(?:the )?(?:service|server|site) is (?:temporarily |currently )?(?:unavailable|down).*",
    r"(?:votre |la )?session (?:a |est |has )?expir.*", r"your session has.*",
    r"accès (?:refusé|interdit|non autorisé).*", r"vous n'(?:avez|êtes) pas (?:les droits|autorisé).*",
    r"délai d'attente (?:dépassé|expiré).*", r"(?:connection|connexion|request|requête) .*(?:impossible|timed out|refused|refusée|échoué|failed)\b.*",
    r"une erreur (?:est survenue|s'est produite|inattendue).*", r"an (?:unexpected )?error (?:has )?occurred.*", r"something went wrong.*", r"réessayez plus tard.*", r"(?:please )?try again later.*",
)
NOTICES = (
    r".*\b(?:activer|activez|autoriser|autorisez|enable|turn on|allow|nécessite|requires?|needs?)\b.*\b(?:java ?script|scripts?|cookies)\b.*",
    r"java ?script (?:est|is|doit|must|désactivé|disabled).*", r"noscript\b.*",
    r".*\b(?:sans|without) (?:java ?)?scripts?\b.*", r".*\bnavigateur\b.*\b(?:pris en charge|scripts? autoris\w*)\b.*", r".*\bbrowser\b.*\b(?:not supported|unsupported|javascript|scripts?)\b.*",
    r"activez-le puis rechargez la page.*",
)
FILLERS = (
    r"(?:votre|your) (?:texte|text|titre|contenu)\b.*(?:ici|here).*", r".*\btexte (?:de remplissage|à venir|factice|provisoire|d'exemple)\b.*", r"contenu (?:provisoire|à venir|factice).*",
    r".*\b(?:à rédiger|à venir|à remplacer|ne pas diffuser|merci de remplacer|replace before use|to be written|coming soon)\b.*", r"(?:rubrique|page|section|site) en construction.*", r"under construction.*",
    r"ceci est (?:un|une) (?:paragraphe|texte|phrase|contenu) (?:exemple|d'exemple|de test).*", r"(?:sample|dummy|placeholder|filler) (?:text|content|paragraph).*", r"this is (?:a |an )?(?:sample|dummy|test|example|placeholder).*",
    r"(?:insérer|insert|saisir|inserer)\b.*\b(?:ici|here|contenu|texte|text|content)\b.*", r"test test.*", r"(?:azerty|qwerty|asdf)\w*\b.*", r"(?:paragraphe|texte|lettre) type\b.*", r"titre de la section.*",
    r"ρ", r"λ", r"x{3,}(?: x{3,})*", r"lorem ipsum.*",
)
# The words of the usual Latin filler text.
LATIN = frozenset("""lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna
aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure
in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt
culpa qui officia deserunt mollit anim id est laborum vitae justo eget sapien lacus porta felis arcu nisl rutrum ornare
mauris congue erat vestibulum ante primis faucibus orci luctus ultrices posuere cubilia curae donec pellentesque habitant
morbi tristique senectus netus malesuada fames ac turpis egestas fusce viverra aenean massa pulvinar dapibus leo tellus
mattis ligula libero augue semper purus gravida nunc varius vel blandit lectus interdum integer neque bibendum metus
phasellus suspendisse praesent curabitur vivamus at sem tincidunt molestie facilisis risus nibh diam quam odio cursus
sodales imperdiet hendrerit convallis urna elementum dictum dui""".split())
CUE = re.compile(r"\b(?:erreur|error|indisponible|unavailable|introuvable|maintenance|script|javascript|cookies?|navigateur|browser|session|exception|timeout|serveur|server|exemple|sample|template|modèle|placeholder|accueil)\b")
MENU = re.compile(r"(?:retour (?:à|au)|back to|accueil|home|menu|aide|help|mes dossiers|mentions légales|contact|plan du site)\b.{0,40}")


RULES = [(kind, re.compile(f"(?:{p})[ .!…]*")) for kind, patterns in (("notice", NOTICES), ("error", ERRORS), ("filler", FILLERS)) for p in patterns] + [("menu", MENU)]
KINDS = ("", "notice", "error", "filler", "menu")
ADDRESS = re.compile(r"https?://\S+|www\.\S+|[\w.+-]+@[\w-]+\.[\w.]+")
MONTHS = "janvier février mars avril mai juin juillet août septembre octobre novembre décembre january february march april may june july august september october november december".split()
DATE = re.compile(r"\b\d{1,2}(?:er)?\s(?:" + "|".join(MONTHS) + r")\s\d{2,4}|\b\d{1,4}[./-]\d{1,2}[./-]\d{1,4}\b")
NUMBER = re.compile(r"\d+(?:[., -]\d+)*")
# A menu separator, a sentence end before anything but a small letter, or a new line that doesn't go on with a small letter.
CUT = re.compile(r"\s+\|\s+|(?<=[.!?…])\s+(?=[^\sa-zà-öø-ÿœ])|[ \t]*[\r\n\f]+\s*(?=[^\sa-zà-öø-ÿœ])")


DIGIT = re.compile(r"\d")
REPEATED = re.compile(r"([^\W\d_]+)(?: \1)+[ .!…]*")


def mask(segment: str) -> str:
    """Lower-case form with addresses, dates and numbers masked and white space joined; filler vocabulary becomes λ, one word
    said over and over ρ."""
    form = " ".join(segment.lower().split())
    if "@" in form or "http" in form or "www." in form:
        form = ADDRESS.sub("§", form)
    if DIGIT.search(form):
        form = NUMBER.sub("#", DATE.sub("¤", form))
    words = form.split(" ")
    if len(words) > 1 and words[0] == words[1] and REPEATED.fullmatch(form):
        return "ρ"
    if len(words) > 2 and (words[0] in LATIN or words[1] in LATIN or words[2] in LATIN):
        letters = re.findall(r"[^\W\d_]+", form)
        if len(letters) >= 3 and sum(w in LATIN for w in letters) >= 0.8 * len(letters):
            return "λ"
    return form


def stems(pattern: str) -> set[str] | None:
    """Literals one of which stands in every match of the pattern; null if none can be told from it."""

    def best(tree) -> set[str] | None:
        found: list[set[str]] = []
        run = ""
        for op, what in [*tree, (None, None)]:
            if op is _parser.LITERAL:
                run += chr(what)
                continue
            if run:
                found.append({run})
            run = ""
            if op is _parser.SUBPATTERN:
                found.append(best(what[-1]))
            elif op is _parser.MAX_REPEAT and what[0]:
                found.append(best(what[2]))
            elif op is _parser.BRANCH:
                options = [best(x) for x in what[1]]
                found.append(None if None in options else set().union(*options))
        found = [x for x in found if x]
        return max(found, key=lambda x: (min(map(len, x)), -len(x))) if found else None

    return best(_parser.parse(pattern))


class Kinds:
    """notice, error, filler or menu, by the whole masked form; null for anything else. Rules are tried in order, each only
    where a literal stands that it can't match without; all those literals are looked for in one pass."""

    def __init__(self) -> None:
        owners: dict[str, set[int]] = {}
        self.always = set()
        for n, (_, rule) in enumerate(RULES):
            needed = stems(rule.pattern)
            if needed is None:
                self.always.add(n)
            for stem in needed or ():
                owners.setdefault(stem, set()).add(n)
        for stem in stems(CUE.pattern):
            owners.setdefault(stem, set()).add(-1)
        self.found = ahocorasick.Automaton()
        for stem, rules in owners.items():
            self.found.add_word(stem, tuple(rules))
        self.found.make_automaton()

    def __call__(self, form: str) -> tuple[str | None, bool]:
        """(kind, whether a cue word stands in it)."""
        tried = self.always.union(*(rules for _, rules in self.found.iter(form)))
        cue = -1 in tried and CUE.search(form) is not None
        for n in sorted(tried - {-1}):
            kind, rule = RULES[n]
            if rule.fullmatch(form) and (kind != "menu" or len(form) < 80):
                return kind, cue
        return None, cue


class Judge:
    """(hash, kind, cue, number of words) of a masked form; the cache is emptied at `most` forms."""

    def __init__(self, most: int = 100_000) -> None:
        self.known: dict[str, tuple[int, str | None, bool, int]] = {}
        self.kinds, self.most = Kinds(), most

    def __call__(self, form: str) -> tuple[int, str | None, bool, int]:
        found = self.known.get(form)
        if found is None:
            if len(self.known) > self.most:
                self.known.clear()
            kind, cue = self.kinds(form)
            found = self.known[form] = xxhash.xxh64_intdigest(form) - (1 << 63), kind, cue and kind is None, form.count(" ") + 1
        return found


def examine(text: str | None, judged: Judge) -> tuple[bool, list[tuple[int, str | None, bool, bool, int]]]:
    """(holds a placeholder, all segments as (hash of the form, kind, cue, real sentence, length)). A segment over several
    lines that matches no rule is taken line by line if one of its lines does."""
    if not text:
        return False, []
    marked = OPENING.search(text) is not None and PLACEHOLDER.search(text) is not None

    def judge(part: str) -> tuple[int, str | None, bool, bool, int]:
        form, kind, cue, n_words = judged(mask(part))
        return form, kind, cue, kind is None and part[-1] in ".!?…" and n_words >= 4, len(part)

    out = []
    for part in filter(None, map(str.strip, CUT.split(text))):
        whole = judge(part)
        lines = [judge(x) for x in filter(None, map(str.strip, part.splitlines()))] if whole[1] is None and "\n" in part else []
        out += lines if any(x[1] not in (None, "menu") for x in lines) else [whole]
    return marked, out


def classify_residue(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source", min_rows: int = 20, min_sources: int = 3) -> DataFrame:
    """One row per text that is residue: `id_col`, placeholder (boolean), kind of the message (or null), recurring (whether a
    form that recurs makes it one), share of the characters in messages, n_real sentences, text_hash.

    A text is a message if it has a form that recurs (in two rows at least) and is a message, and beside titles and menu
    lines at most one real sentence, or if messages fill at least half of it. A phrase that stands in this text only counts
    if messages fill half of it and at most one real sentence is beside. Forms with a mere cue word are messages where they
    stand in `min_rows` rows of `min_sources` sources, half of these rows with at most one real sentence. Null and empty
    texts are never residue; each row is judged by itself, so repeated or null ids give a row for each of their texts. Other
    columns, whatever their names, play no part; an empty table gives an empty result. Texts are read once; only segments
    with a phrase or cue are stored, and their forms combined before the shuffle, so a hot form is one row a task.
    """
    kinds = {"bigint": "long", "int": "int", "string": "string"}
    rows = df.select(df[id_col].alias("row_id"), F.coalesce(F.lower(F.trim(df[source_col])), F.lit("")).alias("source"), F.xxhash64(df[text_col]).alias("text_hash"), df[text_col].alias("text")).where(F.length("text") > 0)
    id_kind = kinds[dict(rows.dtypes)["row_id"]]
    part = pa.struct([("form", pa.int64()), ("kind", pa.int8()), ("chars", pa.int32()), ("real", pa.int32())])
    schema = pa.schema([
        ("key", pa.int64()), ("row_id", {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}[id_kind]), ("source", pa.string()), ("text_hash", pa.int64()), ("placeholder", pa.bool_()),
        ("real", pa.int32()), ("chars", pa.int32()), ("parts", pa.list_(part)),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judged, key = Judge(), TaskContext.get().partitionId() << 40
        for batch in batches:
            out: list[tuple] = []
            for row, source, h, text in zip(*(c.to_pylist() for c in batch.columns)):
                marked, parts = examine(text, judged)
                told = [(form, 0 if cue else KINDS.index(kind), chars, int(real)) for form, kind, cue, real, chars in parts if cue or kind not in (None, "menu")]
                if marked or told:
                    key += 1
                    out.append((key, row, source, h, marked, sum(x[3] for x in parts), sum(x[4] for x in parts), [dict(zip(("form", "kind", "chars", "real"), x)) for x in told]))
            columns = zip(*out) if out else [[]] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    seen = spread(rows).mapInArrow(run, f"key long, row_id {id_kind}, source string, text_hash long, placeholder boolean, real int, chars int, parts array<struct<form long, kind tinyint, chars int, real int>>")
    seen = write_shared(seen, "residue")
    # Real sentences beside those that hold a cue: with at most one, the text is little but the form.
    alone = (F.col("real") - F.aggregate("parts", F.lit(0), lambda n, x: n + x["real"]) <= 1).cast("int")
    once = seen.select("source", alone.alias("alone"), F.explode(F.array_distinct(F.transform("parts", lambda x: F.struct(x["form"].alias("form"), x["kind"].alias("kind"))))).alias("x"))
    forms = once.groupBy(F.col("x.form").alias("form"), F.col("x.kind").alias("kind")).agg(F.count("*").alias("n"), F.count_distinct("source").alias("n_sources"), F.avg("alone").alias("alone"))
    by_cue = (F.col("n") >= min_rows) & (F.col("n_sources") >= min_sources) & (F.col("alone") >= 0.5)
    forms = forms.where((F.col("kind") > 0) | by_cue).select("form", (F.col("n") > 1).alias("recurs"))
    parts = seen.select("key", F.explode("parts").alias("x")).select("key", "x.*").join(forms, "form")
    name = F.element_at(F.array(*map(F.lit, ("recurring", *KINDS[1:]))), F.col("kind").cast("int") + 1)
    told = parts.groupBy("key").agg(F.bool_or("recurs").alias("recurring"), F.max(name).alias("kind"), F.sum("chars").alias("told_chars"), F.sum("real").alias("told_real"))
    all_rows = seen.select("key", "row_id", "text_hash", "placeholder", "real", "chars").join(told, "key", "left")
    n_real, share = F.col("real") - F.coalesce("told_real", F.lit(0)), F.coalesce(F.col("told_chars") / F.nullif(F.col("chars"), F.lit(0)), F.lit(0.0))
    message = F.col("kind").isNotNull() & F.when(F.col("recurring"), (n_real <= 1) | (share >= 0.5)).otherwise((n_real <= 1) & (share >= 0.5))
    found = all_rows.select(
        F.col("row_id").alias(id_col), "placeholder", F.when(message, F.col("kind")).alias("kind"), (message & F.col("recurring")).alias("recurring"), share.alias("share"), n_real.alias("n_real"), "text_hash",
    )
    return found.where(F.col("placeholder") | F.col("kind").isNotNull())


def without_residue(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """The rows of `df` that are no residue, all columns kept. Rows are told apart by id (null or not) and the hash of the text."""
    bad = classify_residue(df, text_col, id_col, source_col).select(F.col(id_col).alias("__bad"), F.col("text_hash").alias("__hash"))
    return df.join(bad, df[id_col].eqNullSafe(F.col("__bad")) & (F.xxhash64(df[text_col]) == F.col("__hash")), "left_anti")
