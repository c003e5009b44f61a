"""Repair of text from scanned pages.

An averaged perceptron edits words character by character (keep, replace, delete, insert after) and decides on joining
lines at a hyphen-like sign. A word's possible readings, each a script of such operations, are scored by it and ranked by
a second perceptron, which weighs the score with what is known of both words (how often they stand in the collection, a
character n-gram model) as features; the best reading is taken beyond a validated margin, and edited again. A third one
removes page furniture (running headers, page numbers) by the position of lines on the page. All are trained here, on
what all records of the collection hold, damaged on purpose: words and character sequences are counted, and lessons on
lines are made text by text and counted where the texts lie.
"""

from __future__ import annotations

import math
import random
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feuillet.llm.mojibake import NgramModel, grams_of_all
from feuillet.plans.spread import spread

RATE_ROWS = 3000  # texts to which the next two refer; in fewer texts, as often in all
COMMON = 60  # times a word stands in them to pass without a check
SURE = 4  # times a word stands in them to be surely printed so; words that are rarer may be misreadings themselves
LESSONS = 20_000  # lessons on lines of an epoch, as many of each distinct one as its number says and at least one
RANK_FEATURES, GAINS = 16, [3, 11, 12]  # and which of them hold the gain under the n-gram model
HYPHENS = "-‐‑¬­–"
# What recognition makes of letters (printed -> read), from common confusion lists.
CONFUSIONS = {
    "m": ["rn", "in", "nn"], "n": ["ri", "ii", "u"], "u": ["ii", "n", "v"], "h": ["li", "b"], "d": ["cl"], "w": ["vv"], "k": ["lc"],
    "l": ["1", "I", "|", "!"], "i": ["1", "l", "!", "j"], "o": ["0", "c"], "s": ["5", "S"], "e": ["c", "é", "o"], "é": ["6", "e", "ó", "è"], "è": ["e", "6", "é"],
    "ê": ["e", "6"], "t": ["f", "l"], "f": ["t"], "g": ["9", "q"], "b": ["6", "h"], "c": ["e", "("], "a": ["o", "n", "4", "@"], "r": ["n"], "q": ["g", "9"],
    "z": ["2"], "B": ["8", "13"], "S": ["5", "8"], "O": ["0", "Q"], "I": ["1", "l", "|"], "E": ["F", "3"], "D": ["O"], "G": ["6", "C"], "l'": ["1'", "I'"],
    "ri": ["n"], "rn": ["m"], "li": ["h"], "cl": ["d"], "vv": ["w"], "nn": ["m"], "ii": ["u"], "à": ["a", "4"], "ç": ["c"], "y": ["v"], "v": ["y"], "p": ["n"], "A": ["4"], "T": ["7", "I"], "Z": ["2"],
}
READ = {(read, printed) for printed, reads in CONFUSIONS.items() for read in reads}
PRINTED: dict[str, list[str]] = {read: [p for r, p in sorted(READ) if r == read] for read, _ in READ}
WORD = re.compile(r"[^\W_]+(?:[!|@(][^\W_]+)*")
COUNTED = re.compile(r"[^\W_]+(?:-[^\W\d_]+)*")
LETTERS = re.compile(r"[^\W\d_]{3,}")
CODE = re.compile(r"\d\d")  # codes are never changed, and no edit gives one
PAGE_NUMBER = re.compile(r"[-–—\[(|. ]*(?:(?:page|p\.?|pg\.?|folio|f°|feuillet|page n°)\s*)?\d{1,4}(?:\s*(?:/|sur|of|de|-)\s*\d{1,4})?[-–—\])| ]*|[-–—\[( ]*[ivxl]{1,7}[-–—\]) ]*", re.I)
DESIGN_MARK = re.compile(r"(?:sheet|slide|diapo\w*|onglet)\b\s*:?.{0,60}", re.I)
LINE = re.compile(r"\r\n|\n|\r")
CUT = re.compile(rf"[{HYPHENS}](?<=[^\W\d_].)[^\S\r\n]*[\r\n]\s*[a-zà-ÿ]")


class WordCounts:
    """How often each word stands in the collection, by the word's hash: 16 bytes a word, looked up by bisection, and some four
    more for a table of bits that tells words that are not there."""

    def __init__(self, hashes: np.ndarray, n: np.ndarray) -> None:
        order = np.argsort(hashes)
        self.hashes, self.n = hashes[order], n[order]
        self.mask = (1 << max(10, 4 + len(hashes).bit_length())) - 1
        bits = np.zeros(self.mask + 1, bool)
        bits[hashes & self.mask] = True
        self.bits = np.packbits(bits, bitorder="little").tobytes()

    def get(self, word: str, default: int = 0) -> int:
        h = word_hash(word)
        bit = h & self.mask
        if not self.bits[bit >> 3] >> (bit & 7) & 1:  # most readings are no words
            return default
        at = int(self.hashes.searchsorted(np.int64(h)))
        return int(self.n[at]) if at < len(self.hashes) and self.hashes[at] == h else default


def word_hash(word: str) -> int:
    return xxhash.xxh64_intdigest(word) - (1 << 63)


class Perceptron:
    """Averaged multi-class perceptron over string features."""

    def __init__(self) -> None:
        self.weights: dict[str, dict[str, float]] = {}
        self._sum: dict[tuple[str, str], float] = defaultdict(float)
        self._at: dict[tuple[str, str], int] = defaultdict(int)
        self._step = 0

    def scores(self, features: list[str]) -> dict[str, float]:
        total: dict[str, float] = {}
        for f in features:
            for label, w in self.weights.get(f, {}).items():
                total[label] = total.get(label, 0.0) + w
        return total

    def learn(self, features: list[str], truth: str, allowed: set[str] | None = None) -> None:
        self._step += 1
        s = self.scores(features)
        options = [x for x in s if allowed is None or x in allowed]
        guess = max(options, key=lambda x: (s[x], x)) if options else ""
        if guess == truth:
            return
        for f in features:
            own = self.weights.setdefault(f, {})
            for label, change in ((truth, 1.0), (guess, -1.0)):
                if label:
                    key = f, label
                    value = own.get(label, 0.0)
                    self._sum[key] += (self._step - self._at[key]) * value
                    self._at[key] = self._step
                    own[label] = value + change

    def average(self) -> None:
        for f, own in self.weights.items():
            for label, value in own.items():
                key = f, label
                own[label] = (self._sum[key] + (self._step - self._at[key]) * value) / max(1, self._step)
        self._sum.clear()
        self._at.clear()


def char_features(word: str, i: int) -> list[str]:
    w = f"^^^{word}$$$"
    j = i + 3
    return [f"0{w[j]}", f"1{w[j - 1 : j + 1]}", f"2{w[j : j + 2]}", f"3{w[j - 1 : j + 2]}", f"4{w[j - 2 : j + 1]}", f"5{w[j : j + 3]}", f"6{w[j - 2 : j + 2]}", f"7{w[j - 1 : j + 3]}", f"8{w[j - 3 : j + 1]}", f"9{w[j : j + 4]}", f"a{w[j - 2 : j + 3]}"]


def join_features(left: str, right: str, sign: str, counts: dict[str, int]) -> list[str]:
    """Features of a hyphen-like sign at a line end: the sign, and how often joined word, compound and halves occur."""
    left, right = left.lower(), right.lower()
    joined, compound = counts.get(left + right, 0), counts.get(f"{left}-{right}", 0)
    size = lambda n: 0 if not n else 1 if n < 4 else 2
    kind = "plain" if sign in "-–" else "cutting"
    out = [f"sign {kind}", f"joined {size(joined)}", f"compound {size(compound)}", f"more {(joined > compound) - (joined < compound)}", f"halves {size(counts.get(left, 0))} {size(counts.get(right, 0))}"]
    return out + [f"{kind} {out[1]} {out[2]}", f"{kind} {out[3]}", f"{kind} {out[4]} {out[2]}", f"short {len(left) < 4} {len(right) < 4}"]


def script(read: str, printed: str) -> list[str]:
    """The operation on each character of `read` that makes `printed` of it. What is longer is inserted after the last one."""
    out = ["keep" if a == b else f"replace {b}" for a, b in zip(read, printed)]
    out += ["delete"] * (len(read) - len(printed))
    return out[:-1] + [f"{out[-1]} insert {printed[len(read):]}"] if len(printed) > len(read) else out


def damage_word(word: str, rng: random.Random) -> tuple[str, list[str]] | None:
    """(word as read, the operation on each of its characters); null if nothing in it is confusable."""
    spots = [(i, k) for i in range(len(word)) for k in (1, 2) if word[i : i + k] in CONFUSIONS and len(word[i : i + k]) == k]
    if not spots:
        return None
    i, k = rng.choice(spots)
    read = rng.choice(CONFUSIONS[word[i : i + k]])
    return word[:i] + read + word[i + k :], ["keep"] * i + script(read, word[i : i + k]) + ["keep"] * (len(word) - i - k)


def is_broken(word: str) -> bool:
    """Whether a sign, a digit or a capital stands where a small letter should."""
    return not word.isalpha() or any(a.islower() and b.isupper() for a, b in zip(word, word[1:]))


def unaccented(text: str) -> str:
    return unicodedata.normalize("NFD", text)[0] if len(text) == 1 else text


def readings(word: str) -> list[tuple[str, int, str, str]]:
    """(new word, place, what was read, what was printed) for every confusion undone once."""
    return [(word[:i] + printed + word[i + width :], i, word[i : i + width], printed) for i in range(len(word)) for width in (1, 2) for printed in PRINTED.get(word[i : i + width], ()) if i + width <= len(word)]


FOLD = [(c, to) for to, group in (("o", "0"), ("l", "1!|i"), ("s", "5"), ("c", "eéèêç6("), ("t", "f7"), ("g", "9q"), ("a", "4@à"), ("b", "8")) for c in group]
NUMBER = re.compile(r"\d(?<![^\W\d_]\d)[\d ./-]*(?![^\W\d_])")


def fold_lines(lines: list[str]) -> list[str]:
    """Keys under which readings of one printed line fall together: numbers masked, letters that are confused joined."""
    text = NUMBER.sub("#", "\n".join(" ".join(line.lower().split()) for line in lines))
    for read, printed in (("rn", "m"), ("ri", "n"), ("ii", "u"), ("li", "h"), ("cl", "d"), ("vv", "w"), *FOLD):
        text = text.replace(read, printed)
    return text.split("\n")


def line_features(lines: list[str], i: int, keys: list[str], counts: Counter, kinds: int, marked: bool) -> list[str]:
    """Features of a line by its form, its repeats and its place on the page."""
    line = lines[i].strip()
    around = [lines[j].strip() if 0 <= j < len(lines) else None for j in (i - 2, i - 1, i + 1, i + 2)]
    before, after = around[1], around[2]
    number = lambda x: bool(x) and PAGE_NUMBER.fullmatch(x) is not None
    repeats = counts[keys[i]]
    prose = next((lines[j].strip() for j in range(i - 1, max(-1, i - 6), -1) if lines[j].strip() and not number(lines[j].strip()) and counts[keys[j]] < 2), "")
    nxt = next((lines[j].strip() for j in range(i + 1, min(len(lines), i + 6)) if lines[j].strip() and not number(lines[j].strip()) and counts[keys[j]] < 2), "")
    out = [
        "bias", f"number {number(line)}", f"bare {line.isdigit()}", f"repeats {min(repeats, 3)}", f"end {line[-1:] in '.;,:'}", f"long {min(3, len(line) // 25)}",
        f"upper {line[:1].isupper() or not line[:1].isalnum()}", f"bars {min(2, line.count('|'))}", f"mark {DESIGN_MARK.fullmatch(line) is not None}", f"marked {marked}",
        f"cut {bool(prose) and prose[-1] not in '.!?:;'} {nxt[:1].islower()}", f"after {before is None} {before == ''} {number(before)}", f"before {after is None} {after == ''} {number(after)}",
        f"feed {chr(12) in lines[i]}", f"near {counts[keys[i - 1]] > 1 if i else None} {counts[keys[i + 1]] > 1 if i + 1 < len(lines) else None}", f"words {min(6, line.count(' ') + 1)}", f"kinds {min(3, kinds)} {number(line)}",
    ]
    return out + [f"{out[1]}+{out[3]}+{out[6]}", f"{out[3]}+{out[4]}+{out[6]}+{out[9]}", f"{out[1]}+{out[2]}+{out[4]}", f"{out[1]}+{out[3]}+{out[10]}", f"{out[3]}+{out[7]}+{out[9]}", f"{out[3]}+{out[10]}+{out[6]}", f"{out[16]}+{out[6]}+{out[4]}"]


def keys_of(lines: list[str]) -> tuple[list[str], Counter, int]:
    short = [i for i, x in enumerate(lines) if 2 < len(x.strip()) <= 90]
    keys = [""] * len(lines)
    for i, key in zip(short, fold_lines([lines[i] for i in short])):
        keys[i] = key
    counts = Counter(keys)
    counts[""] = 0
    return keys, counts, sum(n > 1 for n in counts.values())


@dataclass
class Cleaner:
    """The trained models and the decisions they lead to."""

    counts: dict[str, int] | WordCounts = field(default_factory=dict)
    common: float = COMMON
    ngrams: NgramModel | None = None
    editor: Perceptron = field(default_factory=Perceptron)
    ranker: np.ndarray = field(default_factory=lambda: np.zeros(RANK_FEATURES))
    page: Perceptron = field(default_factory=Perceptron)
    margin: float = 0.0
    fine: set[str] = field(default_factory=set)
    edited: dict[str, str] = field(default_factory=dict)

    def word(self, word: str) -> str:
        """The word as printed, or as it is if no reading of it passes the margin."""
        if word in self.fine:
            return word
        found = self.edited.get(word)
        if found is None:
            found = self._word(word)
            if len(self.fine) + len(self.edited) > 300_000:
                self.fine.clear(), self.edited.clear()
            if found == word:
                self.fine.add(word)
            else:
                self.edited[word] = found
        return found

    def is_editable(self, word: str) -> bool:
        """Not a code, no number, long enough."""
        if len(word) < 4 or word.isdigit():
            return False
        letters = sum(map(str.isalpha, word))
        return not (letters < 3 or word.isupper() and letters < len(word) or CODE.search(word) or letters < len(word) - 2)

    def _word(self, word: str) -> str:
        for n in range(3):
            own = self.counts.get(word.lower(), 0)
            if not self.is_editable(word) or own >= self.common or n and own and not is_broken(word):
                return word
            options = self.ranked(word, own)
            if not options or options[0][0] <= self.margin:
                return word
            word = options[0][1]
        return word

    def ranked(self, word: str, own: int) -> list[tuple[float, str]]:
        """(score, reading), the best first. `own` is how often the word stands as it is."""
        out = [(float(x @ self.ranker), new) for new, x in self.options(word, own)]
        return sorted(out, key=lambda o: (-o[0], o[1]))

    def options(self, word: str, own: int, hidden: str = "") -> list[tuple[str, np.ndarray]]:
        """Readings of a word with their features: those the collection knows better than the word itself, and of a broken
        word all that mend it, twice edited ones if the collection knows them. The word `hidden` is taken as unknown."""
        count = lambda w: 0 if w == hidden else self.counts.get(w.lower(), 0)
        broken, own = is_broken(word), max(1, own)
        found: dict[str, list[tuple[int, str, str]]] = {}
        for new, i, read, printed in readings(word):
            if count(new) > own or broken and printed.isalpha() and not read.isalpha():
                found.setdefault(new, [(i, read, printed)])
            if broken:
                for twice, j, more, made in readings(new):
                    if j >= i + len(printed) and count(twice) > own:
                        found.setdefault(twice, [(i, read, printed), (j - len(printed) + len(read), more, made)])
        found.pop(word, None)
        # All texts are counted, so the model knows the misreading as well: the word is judged without its own counts.
        base = self.ngrams.without(word, count(word)) if found else 0.0
        return [(new, self._features(word, new, own, count(new), base, edits, broken)) for new, edits in found.items()]

    def _features(self, word: str, new: str, own: int, known: int, base: float, edits: list[tuple[int, str, str]], broken: bool) -> np.ndarray:
        ops = 0.0  # what the editor's operations score against keeping the characters
        for i, read, printed in edits:
            for k, what in enumerate(script(read, printed), i):
                s = self.editor.scores(char_features(word, k))
                ops += s.get(what, -1.0) - s.get("keep", 0.0)
        ratio = min(12.0, math.log2((known + 0.5) / own)) / 4
        gain = max(-2.0, min(4.0, (float(self.ngrams.log_p(new).sum()) - base) / 6))
        ops = max(-2.0, min(2.0, ops / 10))
        accent = float(all(unaccented(r) == unaccented(p) for _, r, p in edits))
        mended = float(broken and not is_broken(new))
        return np.array([1.0, ratio, float(known > 0), gain, ops, float(broken), mended, len(edits) - 1.0, accent, accent * ratio, (1 - broken) * ratio, (1 - broken) * gain, (known == 0) * gain, mended * ops, len(word) / 8, broken * (known > 0)])

    def joins(self, left: str, right: str, sign: str) -> bool:
        """Whether a word was cut between two lines: the editor's join operation at the end of the first."""
        a, b = re.findall(r"[^\W\d_]+$", left), re.match(r"[^\W\d_]+", right)
        if not a or not b or not b[0][0].islower():
            return False
        whole = f"{re.findall(r'[^\W\d_]+(?:-[^\W\d_]+)*$', left)[0]}-{re.match(r'[^\W\d_]+(?:-[^\W\d_]+)*', right)[0]}".lower()
        if self.counts.get(whole, 0) > self.counts.get((a[0] + b[0]).lower(), 0):
            return False  # a compound of more parts
        s = self.editor.scores(join_features(a[0], b[0], sign, self.counts))
        return s.get("join", 0.0) > s.get("stay", 0.0)

    def furniture(self, lines: list[str]) -> list[bool]:
        keys, counts, kinds = keys_of(lines)
        marked = any(DESIGN_MARK.fullmatch(x.strip()) for x in lines)
        out, above = [], ""
        for i, line in enumerate(lines):
            before, above = above, line.strip() or above
            if DESIGN_MARK.fullmatch(line.strip()) or DESIGN_MARK.fullmatch(before):
                out.append(False)  # marks of sheets and slides, and the labels right under them, recur by design
                continue
            if not line.strip() or not (counts[keys[i]] > 1 or PAGE_NUMBER.fullmatch(line.strip())):
                out.append(False)
                continue
            s = self.page.scores(line_features(lines, i, keys, counts, kinds, marked))
            out.append(s.get("furniture", 0.0) > s.get("text", 0.0))
        return out

    def clean(self, text: str) -> tuple[str, dict[str, int]]:
        """(continuous paragraphs, how many cuts, words, headers and page numbers were repaired)."""
        raw = LINE.split(text.replace("\f", "\n\f"))
        away = self.furniture(raw)
        top = next((i for i, line in enumerate(raw) if line.strip()), 0)
        if away[top] and not PAGE_NUMBER.fullmatch(raw[top].strip()):
            away[top] = False  # the first reading of a header, at the very top, may be the title
        n = Counter()
        for line, gone in zip(raw, away):
            if gone:
                n["numbers" if PAGE_NUMBER.fullmatch(line.strip()) else "headers"] += 1
        body: list[str] = []
        for line, gone in zip(raw, away):
            if gone:
                # Blank lines around furniture inside a sentence are the page's, not the text's.
                while body and not body[-1].strip() and len(body) > 1 and body[-2].strip()[-1:] not in (".", "!", "?", ":", ""):
                    body.pop()
                body.append("\0")
            else:
                body.append(line.replace("\f", ""))
        lines: list[str] = []
        skip_blank = False
        for line in body:
            if line == "\0":
                skip_blank = bool(lines) and lines[-1].strip()[-1:] not in (".", "!", "?", ":", "")
                continue
            if not line.strip() and skip_blank:
                continue
            skip_blank = False
            lines.append(line)
        out: list[str] = []
        for line in lines:
            here = line.strip()
            if out and out[-1] and here:
                sign = out[-1][-1]
                if sign in HYPHENS and self.joins(out[-1][:-1], here, sign):
                    out[-1] = out[-1][:-1] + here
                    n["cuts"] += 1
                    continue
                if here[:1].islower() or out[-1][-1] not in ".!?:;" and len(out[-1]) > 40 and not DESIGN_MARK.fullmatch(here) and "|" not in here:
                    out[-1] += " " + here
                    continue
            out.append(here)

        text = re.sub(r"\n{3,}", "\n\n", "\n".join(out)).strip()
        new = set(WORD.findall(text)) - self.fine
        if any(self.word(w) != w for w in new):  # most texts have none
            def fix(m: re.Match) -> str:
                made = self.word(m[0])
                n["words"] += made != m[0]
                return made

            text = WORD.sub(fix, text)
        return text, dict(n)


def _paged(lines: list[str], rng: random.Random) -> tuple[list[str], list[bool]] | None:
    """A text with headers and page numbers put between its lines, and which lines are those."""
    lines = [x for x in lines if x.strip()]
    if len(lines) < 6:
        return None
    header = rng.choice(["{t}", "* {t} *", "{t} | copie", "{T}", "{t}   n° {r}", "{t} {r}", ""])
    title = " ".join(rng.choice(lines).split()[: rng.randint(1, 4)]).strip(".,;:").capitalize()
    if len(lines[0].strip()) <= 70 and rng.random() < 0.5:
        title = lines[0].strip()  # the document's own title stands above every page
    header = header.format(t=title, T=title.upper(), r=rng.randint(100, 9_999_999))
    form = rng.choice(["{n}", "- {n} -", "— {n} —", "[{n}]", "{n}/{m}", "Page {n}", "Page {n} sur {m}", "p. {n}", "{R}", "Page{n}", ""])
    if not header and not form:
        return None
    n, out, label = rng.randint(1, 30), [], []
    every = rng.randint(4, 14)
    roman = ["I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX", "X"]
    for at in range(0, len(lines), every):
        top = [header.upper() if rng.random() < 0.15 else header] if header and (at or rng.random() < 0.7) else []
        foot = [form.format(n=n, m=n + 9, R=roman[n % 10])] if form else []
        if rng.random() < 0.3 and foot and top:
            top, foot = [f"{top[0]}   {foot[0]}"], []
        blank = [""] if rng.random() < 0.4 else []
        page = [*((x, True) for x in top), *((x, False) for x in lines[at : at + every]), *((x, False) for x in blank), *((x, True) for x in foot), *((x, False) for x in blank)]
        out += [x for x, _ in page]
        label += [y for _, y in page]
        n += 1
    return out, label


def page_lessons(text: str) -> Iterator[tuple[str, str]]:
    """(features, label) of the lines of a text that recur or are numbers, as they are and on pages made of them. The pages
    are drawn by the text's own hash. A text with a word cut at a line end was scanned: its lines may be headers."""
    if CUT.search(text):
        return
    lines = LINE.split(text)
    keys, counts, kinds = keys_of(lines)
    marked = any(DESIGN_MARK.fullmatch(x.strip()) for x in lines)
    # Lines that recur may be headers; only lists, whose lines begin small or recur in many forms, teach that they need not.
    again = {k: line.strip() for k, line in zip(keys, lines) if counts[k] > 1}
    if not marked and (any(PAGE_NUMBER.fullmatch(x.strip()) for x in lines if x.strip()) or len(again) <= 2 and any(x[:1].isupper() for x in again.values())):
        return
    pages = [(lines, [False] * len(lines), keys, counts, kinds, marked)]
    made = None if marked else _paged(lines, random.Random(xxhash.xxh64_intdigest(text)))
    if made:
        pages.append((*made, *keys_of(made[0]), any(DESIGN_MARK.fullmatch(x.strip()) for x in made[0])))
    for lines, label, keys, counts, kinds, marked in pages:
        for i, y in enumerate(label):
            if lines[i].strip() and (counts[keys[i]] > 1 or PAGE_NUMBER.fullmatch(lines[i].strip())):
                yield "\n".join(line_features(lines, i, keys, counts, kinds, marked)), "furniture" if y else "text"


@dataclass
class Seen:
    """What texts hold for the training: how often each token and each lesson stands in them."""

    tokens: Counter = field(default_factory=Counter)
    lessons: Counter = field(default_factory=Counter)

    def add(self, text: str) -> None:
        self.tokens.update(COUNTED.findall(text))
        self.lessons.update(page_lessons(text))

    def words(self) -> tuple[Counter, Counter]:
        """The words and compounds in small letters, and the words of letters as written."""
        small, written = Counter(), Counter()
        for token, n in self.tokens.items():
            for w in COUNTED.findall(token.lower()):
                small[w] += n
            for w in LETTERS.findall(token):
                written[w] += n
        return small, written


def fit(texts: list[str], seed: int = 5) -> Cleaner:
    """Train on a list of texts that is the collection."""
    seen = Seen()
    texts = [t for t in texts if t]
    for t in texts:
        seen.add(t)
    counts, written = seen.words()
    compounds = [w for w, c in counts.items() if "-" in w and c >= 2]
    return fit_counted(counts, written, compounds, seen.lessons, NgramModel.train([" ".join(t.split()) for t in texts]), len(texts) / RATE_ROWS, seed)


def fit_counted(counts: Counter | WordCounts, written: Counter, compounds: list[str], lessons: Counter, ngrams: NgramModel, scale: float, seed: int = 5) -> Cleaner:
    """Train the perceptrons on what was counted in all texts: words are damaged on purpose and pages were made, so every
    label is known. `scale` says how many times RATE_ROWS the texts are."""
    rng = random.Random(seed)
    cleaner = Cleaner(counts=counts, common=COMMON * max(1.0, scale), ngrams=ngrams)
    words = sorted(w for w, c in written.items() if c >= SURE * max(1.0, scale))
    compounds = sorted(compounds)
    for _ in range(3):
        for w in rng.sample(words, len(words)):
            bad = damage_word(w, rng)
            for word, ops in ((w, ["keep"] * len(w)), *([bad] if bad else [])):
                for i, what in enumerate(ops):
                    cleaner.editor.learn(char_features(word, i), what)
            if len(w) > 4:
                at, sign = rng.randint(2, len(w) - 2), rng.choice(HYPHENS)
                # Half of the cut words are taken as unknown to the collection, as rare names are.
                known = cleaner.counts if rng.random() < 0.5 else {}
                cleaner.editor.learn(join_features(w[:at], w[at:], sign, known), "join")
        for compound in compounds:
            left, right = compound.rsplit("-", 1)
            cleaner.editor.learn(join_features(left.rsplit("-", 1)[-1], right, rng.choice("-–"), cleaner.counts), "stay")
    cleaner.editor.average()
    fit_ranker(cleaner, written, words, rng)
    # Lists with repeats are few beside the pages made here: their lines are learnt a third as often as those of headers.
    kept = {k for k in lessons if k[1] == "text" and not {"repeats 1", "repeats 0"} & set(k[0].split("\n"))}
    headers, n = (sum(c for k, c in lessons.items() if of(k)) for of in (lambda k: k[1] == "furniture", kept.__contains__))
    weights = {k: c * (1 + min(20, headers // max(1, 3 * n)) * (k in kept)) for k, c in lessons.items()}
    every = max(1.0, sum(weights.values()) / LESSONS)
    shown = [(k[0].split("\n"), k[1]) for k, c in sorted(weights.items()) for _ in range(max(1, round(c / every)))]
    rng = random.Random(seed)
    for _ in range(6):
        rng.shuffle(shown)
        for features, truth in shown:
            cleaner.page.learn(features, truth)
    cleaner.page.average()
    return cleaner


def fit_ranker(cleaner: Cleaner, written: Counter, words: list[str], rng: random.Random) -> None:
    """Train the ranking of readings, an averaged perceptron, on words damaged on purpose (the right reading against all
    others) and on words as they are (against all readings). The margin is the least at which at most 5 of 1,000 edited held-out
    words are words as they are. Words as they are that look like a rare misreading of a frequent word may be one and teach nothing."""
    often = lambda w: cleaner.counts.get(w.lower(), 0)
    plain = [w for w in sorted(written) if cleaner.is_editable(w) and not is_broken(w) and often(w) > 3]
    plain = [w for w in plain if not any(often(new) >= 16 * max(1, often(w)) for new, *_ in readings(w))]
    examples = [(True, [(False, x) for _, x in cleaner.options(w, often(w))]) for w in plain]
    for w in words:
        for _ in range(3):
            bad = damage_word(w, rng)
            again = damage_word(bad[0], rng) if bad and rng.random() < 0.15 else None
            word = (again or bad or (w,))[0]
            if word == w or not cleaner.is_editable(word) or often(word) > 0.02 * often(w):
                continue
            # It stands once, or as often as scans of such a frequent word would give; a third of the words are as unknown as rare names.
            own = max(1, often(word), int(often(w) * 10 ** -rng.uniform(2, 4)))
            examples.append((False, [(new == w, x) for new, x in cleaner.options(word, own, w if rng.random() < 0.33 else "")]))
        bare = "".join(map(unaccented, w))
        if bare != w:  # written without accents by people, not by a scanner: far more often
            own = max(1, often(bare), int(often(w) * 10 ** -rng.uniform(0.3, 1.7)))
            examples.append((True, [(False, x) for _, x in cleaner.options(bare, own)]))
    examples = [e for e in examples if e[1]]
    for fine, options in examples:
        if not fine and rng.random() < 0.3:  # words that the n-gram model has not been trained on say little by it
            gain = rng.uniform(-0.7, 0.7)
            for _, x in options:
                x[GAINS] = np.where(x[GAINS] != 0, gain, 0)
    rng.shuffle(examples)
    held, rest = examples[::5], [e for k, e in enumerate(examples) if k % 5]
    weight, total, steps = np.zeros(RANK_FEATURES), np.zeros(RANK_FEATURES), 0
    for _ in range(6):
        rng.shuffle(rest)
        for _, options in rest:
            for right, x in options:
                sign = 1.0 if right else -1.0
                if sign * (x @ weight) <= 1.0:
                    weight = weight + sign * x
                total += weight
                steps += 1
    cleaner.ranker = total / max(1, steps)
    taken = sorted(((max(float(x @ cleaner.ranker) for _, x in options), fine) for fine, options in held), reverse=True)
    wrong, cleaner.margin = 0, taken[0][0] if taken else 0.0
    for n, (score, fine) in enumerate(taken, 1):
        wrong += fine
        if score > 0 and wrong <= 0.005 * n:
            cleaner.margin = 0.999 * score


def count_texts(texts: DataFrame) -> tuple[WordCounts, Counter, list[str], Counter]:
    """The words and compounds that can be looked up, the words as written, the compounds that stand twice and the lessons on
    lines, counted over all texts (one column). Each task adds up its own, then they are grouped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Seen()

        def flush() -> Iterator[pa.RecordBatch]:
            small, written = seen.words()
            rows = [("", word_hash(w), "", c) for w, c in small.items() if not w.isdigit() and not CODE.search(w)]
            rows += [("written", 0, w, c) for w, c in written.items()]
            rows += [("compound", 0, w, c) for w, c in small.items() if "-" in w]
            rows += [(label, 0, features, c) for (features, label), c in seen.lessons.items()]
            seen.tokens.clear(), seen.lessons.clear()
            for at in range(0, len(rows), 50_000):
                columns = zip(*rows[at : at + 50_000])
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, (pa.string(), pa.int64(), pa.string(), pa.int64()))], names=["kind", "h", "what", "n"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen.add(text)
                if len(seen.tokens) + len(seen.lessons) > 500_000:
                    yield from flush()
        yield from flush()

    found = spread(texts).mapInArrow(run, "kind string, h long, what string, n long").groupBy("kind", "h", "what").agg(F.sum("n").alias("n")).toArrow()
    of = lambda kind: found.filter(pc.equal(found["kind"], kind))
    pairs = lambda rows: zip(rows["what"].to_pylist(), rows["n"].to_pylist())
    words = of("")
    lessons = Counter({(k, label): n for label in ("furniture", "text") for k, n in pairs(of(label))})
    return WordCounts(words["h"].to_numpy(), words["n"].to_numpy()), Counter(dict(pairs(of("written")))), [w for w, n in pairs(of("compound")) if n >= 2], lessons


def train_cleaner(df: DataFrame, text_col: str, rows: int = RATE_ROWS) -> Cleaner:
    """`fit` over all texts. The rates COMMON and SURE are meant for `rows` texts."""
    own = df.select(F.col(text_col).alias("t")).where(F.length("t") > 0)
    ngrams = NgramModel.counted(*grams_of_all(own, lambda t: " ".join(t.split())))
    return fit_counted(*count_texts(own), ngrams, own.count() / rows)


def clean_scans(df: DataFrame, text_col: str = "extracted_text", id_col: str = "id", only_found: bool = True) -> DataFrame:
    """One row per text with marks of the page image: `id_col`, cuts, words, headers, numbers (how many of each were
    repaired or removed), cleaned (continuous paragraphs).

    Null, empty and blank texts have none. With `only_found=False` every row comes out. Repeated ids are judged row by
    row; other columns, whatever their names, play no part. Only the counts of the tasks are shuffled (words, sequences of four
    characters, lessons on lines); they cover all texts. Those of words and sequences are broadcast with the models, words at
    some 20 bytes a distinct one (codes left out). Each text is read three times.
    """
    spark = df.sparkSession
    model = spark.sparkContext.broadcast(train_cleaner(df, text_col))
    kinds = {"bigint": ("long", pa.int64()), "int": ("int", pa.int32()), "string": ("string", pa.string())}
    rows = df.select(df[id_col].alias("id"), df[text_col].alias("text"))
    kind, arrow = kinds[dict(rows.dtypes)["id"]]
    what = ("cuts", "words", "headers", "numbers")
    schema = pa.schema([("id", arrow), *((c, pa.int32()) for c in what), ("cleaned", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                cleaned, n = model.value.clean(text) if text and text.strip() else (text, {})
                if n and any(n.values()) or not only_found:
                    out.append((key, *(n.get(c, 0) for c in what), cleaned))
            columns = zip(*out) if out else [[]] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return spread(rows).mapInArrow(run, f"id {kind}, " + ", ".join(f"{c} int" for c in what) + ", cleaned string").withColumnRenamed("id", id_col)
