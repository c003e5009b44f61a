"""Text decoded with the wrong encoding: detection and repair.

Character n-gram models with Jelinek-Mercer smoothing are trained on all clean records. Every candidate chain (take the
text's bytes in encoding W, read them in encoding R, once or repeatedly) is scored on each word that holds characters beyond
ASCII; a record is repaired by the likeliest chain if its gain passes a margin validated on held-out records.
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feuillet.plans.spread import spread

# Encodings met in practice. All leave ASCII as it is.
LEGACY = ("cp1252", "latin-1", "mac_roman", "cp850", "cp437", "cp1250", "cp1251", "iso8859-15", "cp1254")
UNITS = [(w, "utf-8") for w in (*LEGACY, "iso8859-2")] + [(w, r) for w in LEGACY for r in ("cp1252", "mac_roman", "cp850", "cp437") if w != r and {w, r} != {"cp1252", "latin-1"}]
CHAINS = [(u,) for u in UNITS] + [(a, b) for a in UNITS[:3] for b in UNITS[:3]] + [(UNITS[0],) * 3]
SWAP_EXTRA = 10.0  # further gain for chains that never pass UTF-8: single bytes swapped carry no check of their own
LOST = "�"
ORDER = 4
FOLDS = 5  # one of them, by a hash of the text, is held out of the model and validates the margin
BEYOND = re.compile(r"[^\x00-\x7f]+")


def _sloppy(text: str, encoding: str) -> bytes:
    """Bytes of the text; the code points 0x80 to 0x9f stand for themselves where cp125x leaves a byte undefined."""
    try:
        return text.encode(encoding)
    except UnicodeEncodeError:
        if not encoding.startswith("cp125"):
            raise
        return b"".join(bytes([ord(c)]) if 0x80 <= ord(c) <= 0x9F else c.encode(encoding) for c in text)


def apply_unit(text: str, wrong: str, right: str) -> str | None:
    """The text read again; where the whole doesn't decode, each run beyond ASCII by itself. Null if nothing changes."""
    try:
        out = _sloppy(text, wrong).decode(right)
        return out if out != text else None
    except UnicodeError:
        pass

    def one(m: re.Match) -> str:
        try:
            return _sloppy(m[0], wrong).decode(right)
        except UnicodeError:
            return m[0]

    out = BEYOND.sub(one, text)
    return out if out != text else None


def apply_chain(text: str, chain: tuple) -> str | None:
    for wrong, right in chain:
        text = apply_unit(text, wrong, right)
        if text is None:
            return None
    return text


def _summed(keys: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each key once, with the sum of its numbers."""
    if not len(keys):
        return keys, number
    order = np.argsort(keys, kind="stable")
    keys, number = keys[order], number[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(number, first)


def count_grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The sequences of ORDER characters (16 bits each, the last one lowest) and their numbers. Each text stands between
    blanks, so its counts don't depend on the texts beside it."""
    codes = np.frombuffer("\n\n\n".join(["", *texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.minimum(codes, 0xFFFF).astype(np.uint64)
    codes[(codes == 10) | (codes == 13) | (codes == 9) | (codes == 0xA0)] = 32
    key = codes[ORDER - 1 :].copy()
    for n in range(1, ORDER):
        key |= codes[ORDER - 1 - n : -n] << np.uint64(16 * n)
    keys, number = np.unique(key, return_counts=True)
    return keys, number.astype(np.int64)


@dataclass
class NgramModel:
    """log P of a character after its predecessors, interpolated from order 0 (uniform) to ORDER."""

    tables: list[dict] = field(default_factory=list)
    lambdas: tuple = (0.02, 0.08, 0.2, 0.35, 0.35)
    known: dict = field(default_factory=dict)

    @classmethod
    def train(cls, texts: list[str]) -> NgramModel:
        return cls.counted(*count_grams(texts))

    @classmethod
    def counted(cls, keys: np.ndarray, number: np.ndarray) -> NgramModel:
        """The model of counted sequences of ORDER characters; the counts of shorter ones are their sums."""
        tables: list[dict] = []
        for n in range(ORDER, 0, -1):
            keys, number = _summed(keys & np.uint64((1 << 16 * n) - 1), number)
            tables.append(dict(zip(keys.tolist(), number.tolist())))
        return cls([{0: int(number.sum())}, *reversed(tables)])

    def log_p(self, text: str) -> np.ndarray:
        """log P of each character of a word that stands after a space, and of the space after it."""
        own, known = f"{' ' * (ORDER - 1)}{text} ", self.known
        out = np.empty(len(text) + 1)
        for i in range(len(out)):
            p = known.get(own[i : i + ORDER])
            out[i] = self._log(own[i : i + ORDER]) if p is None else p
        return out

    def part(self, text: str, start: int, end: int, least: float = -np.inf) -> float:
        """The sum of `log_p` from `start` to `end`; it is broken off once it falls below `least`."""
        own, known, total = f"{' ' * (ORDER - 1)}{text} ", self.known, 0.0
        for i in range(start, min(end, len(text) + 1)):
            p = known.get(own[i : i + ORDER])
            total += self._log(own[i : i + ORDER]) if p is None else p
            if total < least:
                break
        return total

    def without(self, text: str, times: int) -> float:
        """The sum of `log_p` under a model that has not counted the word itself, which stands so many times in its texts."""
        codes = [32] * (ORDER - 1) + [min(ord(c), 0xFFFF) for c in text] + [32]
        sums: list[tuple[list[int], list[int]]] = []  # of each character: the keys of what ends with it, and of what stands before it
        mine: dict[tuple[int, int], int] = {}
        for at in range(ORDER - 1, len(codes)):
            key, before, keys, contexts = codes[at], 0, [codes[at]], [0]
            for n in range(1, ORDER):
                key |= codes[at - n] << 16 * n
                before |= codes[at - n] << 16 * (n - 1)
                keys.append(key)
                contexts.append(before)
            for n, key in enumerate(keys, 1):
                mine[n, key] = mine.get((n, key), 0) + times
            sums.append((keys, contexts))
        mine[0, 0] = times * len(sums)
        total = 0.0
        for keys, contexts in sums:
            p = self.lambdas[0] / 0x10000
            for n in range(1, ORDER + 1):
                below = self.tables[n - 1].get(contexts[n - 1], 0) - mine.get((n - 1, contexts[n - 1]), 0)
                if below > 0:
                    seen = self.tables[n].get(keys[n - 1], 0) - mine[n, keys[n - 1]]
                    if seen > 0:
                        p += self.lambdas[n] * min(1.0, seen / below)
            total += math.log(p)
        return total

    def _log(self, window: str) -> float:
        codes = [min(ord(c), 0xFFFF) for c in reversed(window)]
        p = self.lambdas[0] / 0x10000
        for n in range(1, ORDER + 1):
            below = self.tables[n - 1].get(sum(c << 16 * k for k, c in enumerate(codes[1:n])), 0)
            if below:
                p += self.lambdas[n] * self.tables[n].get(sum(c << 16 * k for k, c in enumerate(codes[:n])), 0) / below
        if len(self.known) > 400_000:
            self.known.clear()
        self.known[window] = p = math.log(p)
        return p


@dataclass
class Judge:
    """The model with its validated thresholds: gain a word needs, gain a record needs, and how likely a repaired word is at least."""

    model: NgramModel
    word_gain: float = 2.0
    margin: float = 6.0
    plausible: float = -4.5
    cache: dict = field(default_factory=dict)
    runs: dict = field(default_factory=dict)

    def word(self, word: str) -> list[tuple[int, float, str]]:
        """(chain, gain, repaired) for the chains that make the word likelier."""
        found = self.cache.get(word)
        if found is None:
            if len(self.cache) > 200_000:
                self.cache.clear()
            found = self.cache[word] = self._word(word)
        return found

    def _word(self, word: str) -> list[tuple[int, float, str]]:
        # A candidate differs only near the characters beyond ASCII, and no probability passes 1.
        spans = [(m.start(), m.end() + ORDER - 1) for m in BEYOND.finditer(word)]
        joined = [spans[0]] if spans else []
        for start, end in spans[1:]:
            joined[-1:] = [(joined[-1][0], end)] if start <= joined[-1][1] else [joined[-1], (start, end)]
        if -sum(self.model.part(word, *span) for span in joined) < self.word_gain:
            return []
        out, seen = [], {}
        for n in sorted({n for part in self._parts(word) for n in self._run(*part)}):
            fixed = self._candidate(word, n)
            if not fixed or fixed == word:
                continue
            if fixed not in seen:
                seen[fixed] = self._gain(word, fixed)
            if seen[fixed] >= self.word_gain:
                out.append((n, seen[fixed], fixed))
        return out

    def _gain(self, word: str, fixed: str) -> float:
        """How much likelier the candidate is than the word; -1 if that is too little or its own letters are not plausible."""
        if any(0x7F < ord(c) < 0xA0 for c in fixed):
            return -1.0
        most = min(len(word), len(fixed))
        a = next((k for k in range(most) if word[k] != fixed[k]), most)
        b = next((k for k in range(most - a) if word[-1 - k] != fixed[-1 - k]), most - a)
        here = self.model.part(word, a, len(word) - b + ORDER - 1)
        gain = self.model.part(fixed, a, len(fixed) - b + ORDER - 1, here + self.word_gain) - here
        if gain < self.word_gain:
            return -1.0
        there = self.model.log_p(fixed)
        marks = np.array([ord(c) > 127 and c != LOST for c in fixed] + [False])
        return gain if not marks.any() or there[marks].mean() >= self.plausible else -1.0

    @staticmethod
    def _parts(word: str) -> list[tuple[str, bool]]:
        """The runs beyond ASCII of a word, and whether each ends it."""
        return [(m[0], m.end() == len(word)) for m in BEYOND.finditer(word)]

    def _run(self, run: str, ends: bool) -> dict[int, str]:
        """What each chain makes of a run, for the chains that make known letters of it. All encodings leave ASCII alone,
        so a word is read run by run."""
        found = self.runs.get((run, ends))
        if found is None:
            if len(self.runs) > 100_000:
                self.runs.clear()
            found = self.runs[run, ends] = {}
            seen = self.model.tables[1]
            for n, chain in enumerate(CHAINS):
                fixed = apply_chain(run, chain)
                if ends and chain[0][1] == "utf-8" and (fixed is None or fixed[-1] == run[-1]):
                    # The no-break space that belonged to its last letter became a blank.
                    longer = apply_chain(run + "\xa0", chain)
                    fixed = longer if longer and "\xa0" not in longer else fixed
                if fixed and all(c == LOST or min(ord(c), 0xFFFF) in seen for c in fixed):
                    found[n] = fixed
        return found

    def _candidate(self, word: str, n: int) -> str:
        return BEYOND.sub(lambda m: self._run(m[0], m.end() == len(word)).get(n, m[0]), word)

    def _under(self, word: str, n: int, blank: str) -> str:
        """The word under a chain that the record has passed for: taken if that makes it likelier at all. A no-break space
        after it goes with it where it is the second half of its last letter."""
        if blank:
            whole = self._candidate(word + blank, n)
            return whole if blank not in whole and self.model.log_p(whole).sum() > self.model.log_p(word).sum() else self._under(word, n, "") + blank
        fixed = self._candidate(word, n)
        return fixed if fixed != word and self.model.log_p(fixed).sum() > self.model.log_p(word).sum() else word

    @property
    def letters(self) -> list[str]:
        """Letters beyond ASCII that the model has seen often, the ones that get lost."""
        own = {chr(k): n for k, n in self.model.tables[1].items() if k > 127 and chr(k).isalpha()}
        return sorted(c for c, n in own.items() if n >= 0.001 * sum(own.values()))

    def passes(self, n: int, gain: float) -> bool:
        return n >= 0 and gain >= self.margin + (0 if any(r == "utf-8" for _, r in CHAINS[n]) else SWAP_EXTRA)

    def is_clean(self, text: str, strict: bool) -> bool:
        """Whether a text may teach: not damaged, or, if strict, not even suspect. A first model has counted the damage as
        well, which hides a part of it, so its gains are too small."""
        if LOST in text:
            return False
        n, gain = self.best_chain(text) if not text.isascii() else (-1, 0.0)
        return not (n >= 0 and gain >= self.margin if strict else self.passes(n, gain))

    def best_chain(self, text: str) -> tuple[int, float]:
        """The chain with the largest gain over the words of a text, and the gain; (-1, 0) if there is none."""
        gains: dict[int, float] = {}
        for word in text.split():
            if not word.isascii():
                for n, gain, _ in self.word(word):
                    gains[n] = gains.get(n, 0.0) + gain
        return max(gains.items(), key=lambda x: (round(x[1], 6), -x[0])) if gains else (-1, 0.0)

    def repair(self, text: str) -> tuple[str, list[int], float]:
        """(repaired text, chains used, total gain). Chains are taken one after the other while each passes the margin."""
        used, total = [], 0.0
        for _ in range(4):
            n, gain = self.best_chain(text)
            if not self.passes(n, gain):
                break
            used.append(n)
            total += gain
            text = re.sub(r"(\S*[^\x00-\x7f\s]\S*)(\xa0?)", lambda m, n=n: self._under(m[1], n, m[2]), text)
        return text, used, total

    def fill_lost(self, text: str) -> str:
        """The letters lost for good, as the likeliest ones of the model's where one is clearly likelier than the next."""
        letters = self.letters or [" "]

        def one(m: re.Match) -> str:
            word = m[0]
            for _ in range(word.count(LOST)):
                at = word.index(LOST)
                tried = sorted(((float(self.model.log_p(word[:at] + c + word[at + 1 :]).sum()), c) for c in letters), reverse=True)
                if len(tried) < 2 or tried[0][0] - tried[1][0] < 1.0:
                    return m[0]
                word = word[:at] + tried[0][1] + word[at + 1 :]
            return word
        return re.sub(rf"\S*{LOST}\S*", one, text)


def _margin(gain: float) -> float:
    """The margin above the gain that 998 of 1,000 held-out clean records stay under."""
    return max(4.0, gain + 0.5)


def fit(texts: list[str]) -> Judge:
    """Train on the clean ones of a list of texts and validate the margin on a held-out fifth.

    A first model of all texts sorts out what is suspect, a second one of the rest what is damaged; the last is trained on all
    others. The margin is the gain that 998 of
    1,000 held-out clean records stay under plus a half, and at least 4.
    """
    texts = [t for t in texts if t]
    rough = Judge(NgramModel.train(texts)) if texts else Judge(NgramModel.train([" "]))
    second = Judge(NgramModel.train([t for t in texts if rough.is_clean(t, strict=True)]))
    clean = [t for t in texts if second.is_clean(t, strict=False)]
    held, rest = clean[::5], [t for k, t in enumerate(clean) if k % 5]
    judge = Judge(NgramModel.train(rest or [" "]))
    false_gains = sorted(judge.best_chain(t)[1] for t in held)
    judge.margin = _margin(false_gains[int(0.998 * (len(false_gains) - 1))] if false_gains else 0.0)
    judge.cache.clear()
    judge.runs.clear()
    judge.model.known.clear()
    return judge


def grams_of_all(texts: DataFrame, kept: Callable[[str], str | None] = lambda t: t) -> tuple[np.ndarray, np.ndarray]:
    """`count_grams` over what `kept` makes of every text (one column); texts it makes null are left out. Each task adds up its
    own, then the sequences are grouped; only each distinct one comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, number = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        own: list[str] = []
        size = held = 0
        for text in itertools.chain((t for batch in batches for t in batch.column(0).to_pylist()), [None]):
            whole = text is not None
            text = kept(text) if whole else None
            if text:
                own.append(text)
                size += len(text)
            if size > 1_000_000 or not whole and own:
                found.append(count_grams(own))
                held, own, size = held + len(found[-1][0]), [], 0
            if held > 2_000_000 or not whole:
                keys, number = (np.concatenate(x) for x in zip((keys, number), *found))
                keys, number = _summed(keys, number)
                found, held = [], 0
            if len(keys) > 2_000_000 or not whole:
                for at in range(0, len(keys), 100_000):
                    yield pa.RecordBatch.from_arrays([pa.array(keys[at : at + 100_000].view(np.int64)), pa.array(number[at : at + 100_000])], names=["key", "n"])
                keys, number = keys[:0], number[:0]

    rows = spread(texts).mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toPandas()
    return rows["key"].to_numpy(np.int64).view(np.uint64), rows["n"].to_numpy(np.int64)


def train_judge(df: DataFrame, text_col: str) -> Judge:
    """`fit` over all texts: one pass counts for the first model, each of two more sorts out texts by the model before and counts
    the others, one finds the gains of the held-out clean ones. Equal texts fall in the same fold. The margin's rank is exact."""
    sc = df.sparkSession.sparkContext
    own = df.select(F.col(text_col).alias("t")).where(F.length("t") > 0)
    held = F.pmod(F.xxhash64("t", F.length("t")), F.lit(FOLDS)) == 0
    first = sc.broadcast(Judge(NgramModel.counted(*grams_of_all(own))))
    second = sc.broadcast(Judge(NgramModel.counted(*grams_of_all(own, lambda t: t if first.value.is_clean(t, strict=True) else None))))
    judge = Judge(NgramModel.counted(*grams_of_all(own.where(~held), lambda t: t if second.value.is_clean(t, strict=False) else None)))
    last = sc.broadcast(judge)

    def gains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clean = [t for t in batch.column(0).to_pylist() if second.value.is_clean(t, strict=False)]
            yield pa.RecordBatch.from_arrays([pa.array([last.value.best_chain(t)[1] for t in clean], pa.float64())], names=["gain"])

    counts = spread(own.where(held)).mapInArrow(gains, "gain double").groupBy("gain").agg(F.count("*").alias("n")).orderBy("gain").toPandas()
    upto = counts["n"].to_numpy(np.int64).cumsum()
    if len(upto):
        judge.margin = _margin(float(counts["gain"].iloc[int(np.searchsorted(upto, int(0.998 * (upto[-1] - 1)), "right"))]))
    else:
        judge.margin = _margin(0.0)
    for made in (first, second, last):
        made.unpersist()
    return judge


def repair_encoding(df: DataFrame, text_col: str = "extracted_text", id_col: str = "id", only_found: bool = True) -> DataFrame:
    """One row per damaged text: `id_col`, chains (tried in order), gain, lost (letters gone for good), repaired.

    Null, empty and pure ASCII texts are never damaged. With `only_found=False` every row comes out, undamaged ones
    with their own text. Repeated ids are judged row by row. Other columns, whatever their names, play no part. Nothing
    is shuffled but counts of character sequences, gains of held-out texts and a table smaller than a split a core. The model
    counts all texts and is broadcast; it grows with the distinct sequences of four characters. Each text is read four times.
    """
    spark = df.sparkSession
    judge = spark.sparkContext.broadcast(train_judge(df, text_col))
    kinds = {"bigint": ("long", pa.int64()), "int": ("int", pa.int32()), "string": ("string", pa.string())}
    rows = df.select(df[id_col].alias("id"), df[text_col].alias("text"))
    kind, arrow = kinds[dict(rows.dtypes)["id"]]
    if only_found:
        rows = rows.where(F.length("text") != F.octet_length("text"))
    schema = pa.schema([("id", arrow), ("chains", pa.string()), ("gain", pa.float64()), ("lost", pa.int32()), ("repaired", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = judge.value
        for batch in batches:
            out = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                fixed, used, gain = own.repair(text) if text and not text.isascii() else (text, [], 0.0)
                lost = fixed.count(LOST) if text else 0
                if used or lost or not only_found:
                    names = [" + ".join(f"{r} read as {w}" for w, r in CHAINS[n]) for n in used] + ["lost letters"] * bool(lost)
                    out.append((key, "; ".join(names) or None, gain, lost, own.fill_lost(fixed) if lost else fixed))
            columns = zip(*out) if out else [[]] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return spread(rows).mapInArrow(run, f"id {kind}, chains string, gain double, lost int, repaired string").withColumnRenamed("id", id_col)
