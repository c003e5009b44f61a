"""Text and scalar functions on columns. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The stop words of the lexical index, spelled without accents, and its token pattern.
STOPWORDS = """le la les un une des du de et est sont etre avec sans pour par sur dans en au aux ce cette ces cet il elle ils
elles je tu nous vous son sa ses leur leurs qui que quoi dont ou si mais ne pas plus moins tres ont etait celui celle ceux
cellees meme ainsi apres avant autre lors cas via""".split()
TOKEN = r"[a-zà-ÿ0-9]+"
# Suffixes of the files that can be indexed.
SUPPORTED = (".pdf", ".gif", ".png", ".jpg", ".jpeg", ".bmp", ".tiff", ".webp", ".docx", ".pptx", ".xlsx")
ROOT = "_root"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(col(c), r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def normalize_whitespace(c: Column | str) -> Column:
    """LF line ends, single blanks, no blanks beside line ends, at most one empty line, trimmed."""
    c = F.regexp_replace(col(c), r"\r\n?", "\n")
    c = F.regexp_replace(c, r"[ \t\f\x0B]+", " ")
    c = F.regexp_replace(c, r" *\n *", "\n")
    return strip(F.regexp_replace(c, r"\n{3,}", "\n\n"))


def looks_garbled(c: Column | str, least: float = 0.20) -> Column:
    """Whether fewer than `least` of the characters are letters; an empty text does not."""
    c = col(c)
    return (F.length(c) > 0) & (F.length(F.regexp_replace(c, r"[^\p{L}]", "")) / F.greatest(F.lit(1), F.length(c)) < least)


def merge_text_layers(base: Column | str, addition: Column | str) -> Column:
    """The lines of `base`, then the lines of `addition` not there yet (case ignored, each once). An empty side gives the other."""
    base, addition = col(base), col(addition)
    lines = lambda c: F.filter(F.transform(F.split(c, "\n"), strip), lambda x: F.length(x) > 0)
    kept = lines(base)
    merged = F.aggregate(lines(addition), kept, lambda acc, x: F.when(F.array_contains(F.transform(acc, F.lower), F.lower(x)), acc).otherwise(F.array_append(acc, x)))
    blank = lambda c: c.isNull() | (F.length(strip(c)) == 0)
    return F.when(blank(addition), base).when(blank(base), addition).otherwise(normalize_whitespace(F.array_join(merged, "\n")))


def tokenize(c: Column | str) -> Column:
    """Lexical tokens in order, repeats kept, without stop words."""
    return F.filter(F.regexp_extract_all(F.lower(col(c)), F.lit(TOKEN), F.lit(0)), lambda x: ~x.isin(STOPWORDS))


def query_terms(c: Column | str) -> Column:
    """Lower-case words of a query of more than one character; may be empty."""
    return F.filter(F.split(F.lower(col(c)), r"(?U)\W+"), lambda x: F.length(x) > 1)


def category_of(path: Column | str) -> Column:
    """First segment of a relative path, `_root` without a directory."""
    parts = F.split(F.translate(col(path), "\\", "/"), "/")
    return F.when(F.size(parts) > 1, parts[0]).otherwise(F.lit(ROOT))


def file_suffix(path: Column | str) -> Column:
    return F.lower(F.regexp_extract(col(path), r"(\.[^./\\]+)$", 1))


def is_supported(path: Column | str) -> Column:
    return file_suffix(path).isin(*SUPPORTED)


def contains_phrase(text_lower: Column, query: Column) -> Column:
    return F.contains(text_lower, F.lower(query))


def contains_all_terms(text_lower: Column, terms: Column) -> Column:
    """True for no terms at all."""
    return F.forall(terms, lambda t: F.contains(text_lower, t))


def text_preview(text: Column | str, terms: Column, length: int = 240, before: int = 90) -> Column:
    """An excerpt around the earliest first occurrence of a term, with ellipses; without one the head of the text."""
    text = col(text)
    low = F.lower(text)
    hits = F.filter(F.transform(terms, lambda t: F.instr(low, t)), lambda p: p > 0)
    start = F.greatest(F.lit(0), F.array_min(hits) - 1 - before)
    stop = F.least(F.length(text), start + length)
    cut = F.concat(F.when(start > 0, "…").otherwise(""), strip(F.substring(text, start + 1, stop - start)), F.when(stop < F.length(text), "…").otherwise(""))
    return F.when(F.size(hits) > 0, cut).otherwise(F.substring(text, 1, length))


def cache_key(query: Column, top_k: Column, category: Column, file_type: Column) -> Column:
    none = lambda c: F.coalesce(c, F.lit(""))
    return F.substring(F.sha2(F.concat_ws("|", F.lower(strip(query)), top_k.cast("string"), none(category), none(file_type)), 256), 1, 16)


def normalize_email(c: Column | str) -> Column:
    return F.lower(strip(c))


def highlight(text: Column | str, query: str) -> Column:
    """Each blank-separated query term wrapped in <mark>, case ignored."""
    import re

    terms = [re.sub(r"([.*+?^${}()|\[\]\\])", r"\\\1", t) for t in query.split()]
    return F.regexp_replace(col(text), "(?iu)(" + "|".join(terms) + ")", "<mark>$1</mark>") if terms else col(text)


def file_type_label(c: Column | str) -> Column:
    return F.upper(F.regexp_replace(col(c), r"^\.", ""))


def french_percent(c: Column | str) -> Column:
    return F.concat(F.translate(F.format_string("%.1f", col(c)), ".", ","), F.lit(" %"))


def epoch_date(c: Column | str) -> Column:
    """Date of epoch seconds, or of milliseconds from 10^12 on, given as text; null if it is no number."""
    n = F.try_to_number(F.regexp_extract(col(c), r"^(\d+)(?:\.\d+)?$", 1), F.lit("9999999999999999")).cast("long")
    return F.to_date(F.timestamp_seconds(F.when(n >= 10**12, F.floor(n / 1000)).otherwise(n)))


def password_score(c: Column | str) -> Column:
    """0 to 4: eight characters, twelve, both cases, a digit together with a sign."""
    c = col(c)
    tests = (F.length(c) >= 8, F.length(c) >= 12, c.rlike("[a-z]") & c.rlike("[A-Z]"), c.rlike("[0-9]") & c.rlike("[^A-Za-z0-9]"))
    return sum((x.cast("int") for x in tests), F.lit(0))


def password_accepted(c: Column | str) -> Column:
    c = col(c)
    return (F.length(c) >= 8) & c.rlike(r"\p{L}") & c.rlike(r"\p{Nd}")


def initials(c: Column | str) -> Column:
    """Upper-case first letters of the first two words."""
    words = F.slice(F.filter(F.split(strip(c), r"(?U)\s+"), lambda x: F.length(x) > 0), 1, 2)
    return F.array_join(F.transform(words, lambda w: F.upper(F.substring(w, 1, 1))), "")


def log_level(status: Column | str) -> Column:
    s = col(status)
    return F.when(s >= 500, "ERROR").when(s >= 400, "WARNING").otherwise("INFO")


def user_suffix(name: Column | str, email: Column | str) -> Column:
    """What a log line says of a user: the name, or the mail address where there is none, and the address beside a name."""
    mail = F.nullif(col(email), F.lit(""))
    shown = F.coalesce(F.nullif(col(name), F.lit("")), mail, F.lit("?"))
    return F.concat(F.lit(" — user: "), shown, F.when(mail != shown, F.concat(F.lit(" ("), mail, F.lit(")"))).otherwise(""))


def safe_name(c: Column | str) -> Column:
    """File name of a shard: anything but letters, digits, - and _ becomes _."""
    return F.regexp_replace(col(c), r"[^\p{L}\p{N}_-]", "_")
