"""Evaluation passages that stand in training texts.

Seeds are rare word n-grams of the test items: how many texts hold each n-gram of the items is counted first. Texts and
items that share a seed are joined; what their n-grams have in common bounds the alignment, and pairs that can reach the
wanted score are aligned by Smith-Waterman on words, which also scores edited copies. The corpus is cut into words once:
texts that hold any n-gram of an item are kept in the shared folder, with words that stand in no item left blank.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feuillet.llm.words import Tokens, ngram_hashes, tokens
from feuillet.plans.shared import write_shared
from feuillet.plans.spread import spread

BLOCK_CHARS = 8_000_000  # held-out text that is broadcast at once; a larger held-out side runs block by block
COMMON = 0.01  # an n-gram in more than this share of the texts is no seed, unless half of its item is as common


def smith_waterman(firsts: list[np.ndarray], seconds: list[np.ndarray], match: int = 2, mismatch: int = -1, gap: int = -1, block: int = 128, cells: int = 2_000_000) -> tuple[np.ndarray, np.ndarray]:
    """Best local alignment score of each pair of id sequences, and where it first ends in the first of them.

    Many pairs run side by side, one row of their matrices at a time; gaps along a row are resolved by a running maximum.
    Pairs are sorted by length, so a block holds pairs of like size; its rows are the shorter side.
    """
    score, end = np.zeros(len(firsts), np.int32), np.zeros(len(firsts), np.int32)
    order = sorted(range(len(firsts)), key=lambda k: (len(firsts[k]), len(seconds[k])))
    at = 0
    while at < len(order):
        own = order[at : at + max(1, min(block, cells // max(1, len(firsts[order[min(at + block, len(order)) - 1]]))))]
        at += len(own)
        turned = sum(len(firsts[k]) for k in own) > sum(len(seconds[k]) for k in own)
        down, across = (seconds, firsts) if turned else (firsts, seconds)
        rows, width = max(len(down[k]) for k in own), max(len(across[k]) for k in own)
        # Where a sequence has ended, no id is equal to any other.
        a, a_in = np.zeros((rows, len(own)), firsts[0].dtype), np.zeros((rows, len(own)), bool)
        b, b_in = np.zeros((len(own), width), firsts[0].dtype), np.zeros((len(own), width), bool)
        for j, k in enumerate(own):
            a[: len(down[k]), j], a_in[: len(down[k]), j] = down[k], True
            b[j, : len(across[k])], b_in[j, : len(across[k])] = across[k], True
        ramp = np.arange(width + 1, dtype=np.int32) * np.int32(gap)
        row = np.zeros((len(own), width + 1), np.int32)
        best, where = np.zeros(len(own), np.int32), np.zeros(len(own), np.int32)
        for i in range(rows):
            same = (b == a[i][:, None]) & b_in & a_in[i][:, None]
            new = row + np.int32(gap)
            np.maximum(new[:, 1:], row[:, :-1] + np.where(same, np.int32(match), np.int32(mismatch)), out=new[:, 1:])
            np.maximum(new, 0, out=new)
            new -= ramp
            np.maximum.accumulate(new, axis=1, out=new)
            new += ramp
            top = new.max(axis=1)
            if turned:
                level = np.nonzero((top >= best) & (top > 0))[0]
                place = new[level].argmax(axis=1)
                where[level] = np.where(top[level] > best[level], place, np.minimum(where[level], place))
            else:
                where[top > best] = i + 1
            best = np.maximum(best, top)
            row = new
        score[own], end[own] = best, where
    return score, end


class Held:
    """A block of items: their words as places in the block's vocabulary (from 1), and where each n-gram stands in them."""

    def __init__(self, keys: list, found: Tokens, n: int) -> None:
        self.keys, self.n = keys, n
        self.vocabulary = np.unique(found.ids)
        codes = np.searchsorted(self.vocabulary, found.ids).astype(np.int32) + 1
        self.codes = [codes[a:b] for a, b in zip(found.start[:-1], found.start[1:])]
        self.size = np.diff(found.start)
        grams, item, place = found.ngrams(n)
        self.grams, own = np.unique(grams, return_inverse=True)
        order = np.argsort(own, kind="stable")
        self.item, self.place = item[order].astype(np.int64), place[order].astype(np.int64)
        self.first = np.searchsorted(own[order], np.arange(len(self.grams) + 1))
        self.seed = np.zeros(len(order), bool)  # whether the n-gram is a seed of the item, for each place of one
        self._order, self._own, self._item = order, own, item

    def choose_seeds(self, frequency: np.ndarray, texts: int, run: int) -> None:
        """An n-gram is a seed of its item if at most COMMON of the texts hold it, or at most twice as many as hold the item's
        median one (an item may stand in a third of all texts). The rarest of every `run` words in a row is one in any case,
        so a verbatim run always holds a seed. `frequency` is that of the distinct n-grams."""
        own = frequency[self._own]
        seed = np.zeros(len(own), bool)
        starts = np.searchsorted(self._item, np.arange(len(self.keys) + 1))
        for a, b in zip(starts[:-1], starts[1:]):
            df = own[a:b]
            occurring = df[df > 0]
            if not len(occurring):
                continue
            seed[a:b] = (df > 0) & (df <= max(COMMON * texts, 2 * float(np.median(occurring))))
            width = run - self.n + 1
            if b - a >= width:
                rarest = np.lib.stride_tricks.sliding_window_view(np.where(df > 0, df, np.iinfo(np.int64).max), width).argmin(axis=1) + np.arange(b - a - width + 1)
                seed[a + np.unique(rarest)] = True
                seed[a:b] &= df > 0
        self.seed = seed[self._order]

    def hits(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of the n-grams stand in an item, their index)."""
        at = np.minimum(np.searchsorted(self.grams, grams), len(self.grams) - 1)
        hit = np.nonzero(self.grams[at] == grams)[0]
        return hit, at[hit]


def common_parts(held: Held, index: np.ndarray, text: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, item, longest run in words, words of the item in common n-grams, first and last place in the text) of each pair
    that shares a seed. `index`, `text` and `place` are those of the n-grams that stand in an item."""
    many = held.first[index + 1] - held.first[index]
    k = np.repeat(np.arange(len(index)), many)
    at = held.first[index][k] + np.arange(len(k)) - np.repeat(np.cumsum(many) - many, many)
    pair = text[k] * len(held.keys) + held.item[at]
    keep = np.isin(pair, np.unique(pair[held.seed[at]]))
    pair, here, there = pair[keep], place[k[keep]], held.place[at[keep]]
    if not len(pair):
        return (np.zeros(0, np.int64),) * 6
    # A run is a chain of common n-grams on one diagonal.
    order = np.lexsort((here, here - there, pair))
    p, h, d = pair[order], here[order], (here - there)[order]
    breaks = np.concatenate([[True], (np.diff(p) != 0) | (np.diff(d) != 0) | (np.diff(h) != 1)])
    start = np.nonzero(breaks)[0]
    length = np.diff(np.concatenate([start, [len(p)]]))
    pairs, first = np.unique(p, return_index=True)
    longest = np.maximum.reduceat(length, np.searchsorted(start, first, "right") - 1) + held.n - 1
    low, high = np.minimum.reduceat(h, first), np.maximum.reduceat(h, first)
    order = np.lexsort((there, pair))
    p, t = pair[order], there[order]
    gap = np.concatenate([np.minimum(np.diff(t), held.n), [held.n]])
    gap[np.concatenate([p[1:] != p[:-1], [True]])] = held.n
    covered = np.add.reduceat(gap, first)
    return pairs // len(held.keys), pairs % len(held.keys), longest, covered, low, high


class ScoreBounds:
    """What an item's alignment with a text can score at most, from the words and word pairs of the text alone.

    Every word of the item inside the alignment gives 2 if it stands in the text and costs 1 else; two words in a row that
    are both in the text, but nowhere in a row, have an insertion between them. The bound is the best stretch of that sum.
    """

    def __init__(self, items: list[np.ndarray]) -> None:
        pairs = [ngram_hashes(w, 2) for w in items]
        self.words, self.pairs = np.unique(np.concatenate(items)), np.unique(np.concatenate(pairs))
        none, free = len(self.words), len(self.pairs)  # one slot more each: a word that never stands, a pair that always does
        # Each item begins with a separator, which costs more than any item can gain.
        self.word_at = [np.concatenate([[none], np.searchsorted(self.words, w)]) for w in items]
        self.pair_at = [np.concatenate([[free, free], np.searchsorted(self.pairs, x)]) for x in pairs]
        self.apart = 4 * max(len(w) for w in items) + 8

    @staticmethod
    def _stands(known: np.ndarray, own: np.ndarray, last: bool) -> np.ndarray:
        out = np.zeros(len(known) + 1, bool)
        at = np.minimum(np.searchsorted(known, own), len(known) - 1)
        out[at[known[at] == own]] = True
        out[-1] = last
        return out

    def __call__(self, own: np.ndarray, chosen: list[int]) -> np.ndarray:
        """The bound of each chosen item for a text of these word ids."""
        words = np.concatenate([self.word_at[k] for k in chosen])
        here = self._stands(self.words, own, False)[words]
        paired = self._stands(self.pairs, ngram_hashes(own, 2), True)[np.concatenate([self.pair_at[k] for k in chosen])]
        value = np.where(here, 2, np.where(words == len(self.words), -self.apart, -1)).astype(np.int64)
        step = value.copy()
        step[1:] -= here[1:] & here[:-1] & ~paired[1:]
        total = np.cumsum(step)
        bound = total - np.minimum.accumulate(total - value)
        sizes = np.array([len(self.word_at[k]) for k in chosen])
        return np.maximum.reduceat(bound, np.cumsum(sizes) - sizes)


def leaked_items(
    corpus: DataFrame, items: DataFrame, text_col: str = "text", id_col: str = "doc_id", item_col: str = "item_id", item_text_col: str = "text",
    run: int = 13, seed_words: int = 3, min_share: float = 0.5,
) -> DataFrame:
    """One row per (text, item) that share a passage: `id_col`, `item_col`, longest_run (consecutive words in both), score
    (Smith-Waterman), share (score against a whole verbatim copy), start and end of the alignment in words of the text.

    A pair comes out if its alignment scores at least 2 x `run`, as any verbatim run of that length does, and it has such a
    run; or if the alignment reaches `min_share` of the item's own score, runs of at least `seed_words` common words cover
    half of that share of the item, and one of them is a seed (see `Held.choose_seeds`). Null and empty texts, and items of
    fewer than `seed_words` words, take no part; items of fewer than `run` words come out by their share only. Repeated rows
    of the corpus give a row each; repeated items count once. The items reach the workers as a broadcast of at most
    BLOCK_CHARS of text; more are done block by block, each a pass over the corpus. The corpus is never shuffled, only the
    counts of the items' n-grams are.
    """
    spark = corpus.sparkSession
    kinds = {"bigint": "long", "int": "int", "string": "string"}
    corpus = spread(corpus.select(corpus[id_col].alias("doc"), corpus[text_col].alias("text")).where(F.length("text") > 0))
    doc_kind, item_kind = kinds[dict(corpus.dtypes)["doc"]], kinds[dict(items.dtypes)[item_col]]
    schema = f"doc {doc_kind}, item {item_kind}, longest_run int, score int, share double, start int, end int"
    own = items.select(items[item_col].alias("item"), items[item_text_col].alias("text")).where(F.col("text").isNotNull() & F.col("item").isNotNull()).distinct()
    blocks = math.ceil((own.agg(F.sum(F.length("text"))).first()[0] or 0) / BLOCK_CHARS)
    out = None
    for k in range(blocks):
        rows = (own if blocks == 1 else own.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == k)).collect()
        found = tokens([r[1] for r in rows], folded=True)
        long = [n for n, size in enumerate(np.diff(found.start)) if size >= seed_words]
        if long:
            held = Held([rows[n][0] for n in long], Tokens(np.concatenate([found.of(n) for n in long]), np.concatenate([[0], np.cumsum([len(found.of(n)) for n in long])])), seed_words)
            part = _leaks_of(corpus, held, doc_kind, item_kind, schema, run, min_share)
            out = part if out is None else out.unionByName(part)
    out = spark.createDataFrame([], schema) if out is None else out
    return out.withColumnsRenamed({"doc": id_col, "item": item_col})


def _leaks_of(corpus: DataFrame, held: Held, doc_kind: str, item_kind: str, schema: str, run: int, min_share: float) -> DataFrame:
    spark, n = corpus.sparkSession, held.n
    known = spark.sparkContext.broadcast(held)
    arrow = {"string": pa.string(), "long": pa.int64(), "int": pa.int32()}
    kept_schema = pa.schema([("doc", arrow[doc_kind]), ("codes", pa.binary()), ("gram", pa.int64()), ("n", pa.int64())])

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The texts with an n-gram of an item, and at the end how many texts of the task hold each n-gram."""
        own = known.value
        total, n_texts = np.zeros(len(own.grams), np.int64), 0
        for batch in batches:
            n_texts += batch.num_rows
            found = tokens(batch.column(1).to_pylist(), folded=True)
            grams, text, _ = found.ngrams(n)
            hit, index = own.hits(grams)
            once = np.unique(text[hit] * len(own.grams) + index)
            total += np.bincount(once % len(own.grams), minlength=len(own.grams))
            some = np.unique(text[hit])
            at = np.minimum(np.searchsorted(own.vocabulary, found.ids), len(own.vocabulary) - 1)
            codes = np.where(own.vocabulary[at] == found.ids, at + 1, 0).astype(np.uint16 if len(own.vocabulary) < 0xFFFF else np.uint32)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(some)), pa.array([codes[found.start[k] : found.start[k + 1]].tobytes() for k in some], pa.binary()), pa.nulls(len(some), pa.int64()), pa.nulls(len(some), pa.int64()),
            ], schema=kept_schema)
        some = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.nulls(len(some) + 1, arrow[doc_kind]), pa.nulls(len(some) + 1, pa.binary()), pa.array([-1, *some]), pa.array([n_texts, *total[some]])], schema=kept_schema)

    kept = write_shared(corpus.mapInArrow(keep, f"doc {doc_kind}, codes binary, gram long, n long"), "leaks")
    counted = kept.where("gram is not null").groupBy("gram").agg(F.sum("n").alias("n")).toPandas()  # one row an n-gram of the block at most
    frequency = np.zeros(len(held.grams) + 1, np.int64)
    frequency[counted["gram"]] = counted["n"]  # the number of texts comes last
    held.choose_seeds(frequency[:-1], int(frequency[-1]), run)
    model = spark.sparkContext.broadcast(held)
    out_schema = pa.schema([("doc", arrow[doc_kind]), ("item", arrow[item_kind]), *((c, pa.int32()) for c in ("longest_run", "score")), ("share", pa.float64()), ("start", pa.int32()), ("end", pa.int32())])

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model.value
        bounds = ScoreBounds([c.astype(np.uint64) for c in own.codes])
        wide = np.concatenate([np.zeros(1, np.uint64), own.vocabulary])
        kind = np.uint16 if len(own.vocabulary) < 0xFFFF else np.uint32
        for whole in batches:
            for low in range(0, whole.num_rows, 1000):
                batch = whole.slice(low, 1000)
                texts = [np.frombuffer(x, kind) for x in batch.column(1).to_pylist()]
                flat = Tokens(np.concatenate(texts), np.concatenate([[0], np.cumsum([len(x) for x in texts])]))
                grams, text, place = Tokens(wide[flat.ids], flat.start).ngrams(n)
                hit, index = own.hits(grams)
                found = common_parts(own, index, text[hit], place[hit])
                yield pa.RecordBatch.from_pylist(list(_aligned(own, bounds, texts, batch.column(0), found, run, min_share)), schema=out_schema)

    return spread(kept.where("codes is not null").select("doc", "codes")).mapInArrow(align, schema)


def _aligned(held: Held, bounds: ScoreBounds, texts: list[np.ndarray], docs: pa.Array, found: tuple[np.ndarray, ...], run: int, min_share: float) -> Iterator[dict]:
    """The pairs of `common_parts` that pass, aligned."""
    text, item, longest, covered, low, high = found
    least = 2 * min_share * held.size[item]
    able = 2 * covered >= min_share * held.size[item]
    for k in np.unique(text[able]).tolist():  # the pairs of a text lie together
        at = np.arange(*np.searchsorted(text, [k, k + 1]))
        at = at[able[at]]
        able[at] = bounds(texts[k].astype(np.uint64), item[at].tolist()) >= least[at]
    tried = np.nonzero(able | (longest >= run))[0].tolist()
    # An alignment through common n-grams lies within twice the item's length of them.
    begin = [max(0, int(low[m]) - 2 * int(held.size[item[m]])) for m in tried]
    parts = [texts[text[m]][b : int(high[m]) + 2 * int(held.size[item[m]]) + 8].astype(np.int32) for m, b in zip(tried, begin)]
    targets = [held.codes[item[m]] for m in tried]
    score, end = smith_waterman(parts, targets)
    passed = [j for j, m in enumerate(tried) if score[j] >= 2 * run and longest[m] >= run or able[m] and score[j] >= least[m]]
    # The start is the end of the same alignment run backwards.
    _, back = smith_waterman([parts[j][: end[j]][::-1] for j in passed], [targets[j][::-1] for j in passed])
    for j, length in zip(passed, back.tolist()):
        m = tried[j]
        last = begin[j] + int(end[j])
        yield {"doc": docs[int(text[m])].as_py(), "item": held.keys[item[m]], "longest_run": int(longest[m]), "score": int(score[j]), "share": float(score[j] / (2 * held.size[item[m]])), "start": last - length, "end": last}
